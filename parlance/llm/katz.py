"""Language-model scores by a Katz back-off model of the corpus itself, of any order.

Tokens stand as 64-bit hashes. One pass over the texts writes them as chunks: about
``CHUNK_BYTES`` of text as ids into the chunk's own word list. From there on a chunk
asks the tables of counts for what it holds and nothing else moves. Level by level,
from single tokens up, every chunk sends each different n-gram that it holds once, packed
by bucket of the n-gram's context: context, token, times seen in training documents,
and what the level below says of the token, which that level has just answered. So a
bucket holds all there is to know of its contexts. It adds up the counts of its
n-grams, and writes them as a row of the level's table; the counts of counts of all
rows (six numbers) give the Good-Turing discounts, and a pass over the rows tells the
chunks that asked, in the order they asked in, the counts of their n-grams and the c(h)
and a(h) of their contexts. With these a chunk evaluates, token by token,

    P(w | h) = d c(h w) / c(h)           where the training documents have (h, w)
             = a(h) P(w | shorter h)     else; a(h) makes the sum over all w one

with a(h) = 1 where h was never seen, and sums by document. No join meets a single n-gram.

Contexts of more than their share of a bucket are spread over several by the hash of
the token. They are known exactly from the level below, where they were counted, and what
c(h) and a(h) need of them (a row a bucket and context) is added up before the pass.
Every conditional distribution over the known tokens and one unknown token sums to 1.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hand_back, saved, slices
from .quality import doc_remainder

DISCOUNTED = 5                              # counts to 5 are discounted
CHUNK_BYTES, PIECE_BYTES = 16 << 20, 1 << 20   # text in a chunk; of a long text read at once
BUCKET_TOKENS, LEAST_BUCKETS, MOST_TASKS = 2_000_000, 12, 10_000
_CHUNK = "chunk long, rows long, tokens long, docs binary, words binary, counts binary, ids binary"
_ASKED = "bucket int, chunk long, n long, data binary"
_MERGED = ("bucket int, chunks binary, at binary, contexts binary, c binary, lower binary, counts binary, tokens long, types long, "
           "heavy_x binary, heavy_t binary, spread_x binary, spread_sums binary")
_ANSWER = "chunk long, level int, bucket int, data binary"
_DOCS = np.dtype([("row", "<i8"), ("doc_id", "<i8"), ("flags", "<i8"), ("n", "<i8")])    # flags: 1 training, 2 null id
_SUMS = "row long, doc_id long, train boolean, n long, known long, base double, score double"


def token_hash(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word)


def marks() -> tuple[int, int]:
    """Hashes of the start and the end of a text: no word holds a space."""
    return token_hash(_START), token_hash(_END)


_START, _END = b" start", b" end"


def _zipped(a: np.ndarray) -> bytes:
    """Compressed with the first bytes of all items first: like bytes lie together."""
    import zstandard

    if not len(a):
        return b""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes())


def _unzipped(data: bytes, dtype) -> np.ndarray:
    import zstandard

    dtype = np.dtype(dtype)
    if not data:
        return np.empty(0, dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def _framed(*parts: bytes) -> bytes:
    """Parts one after another, their lengths before them."""
    return np.array([len(parts), *map(len, parts)], "<i8").tobytes() + b"".join(parts)


def _parts(data: bytes) -> list[bytes]:
    k = int(np.frombuffer(data, "<i8", 1)[0])
    ends = np.cumsum(np.frombuffer(data, "<i8", k, 8)) + 8 * (k + 1)
    return [data[a:b] for a, b in zip([8 * (k + 1), *ends.tolist()], ends.tolist(), strict=False)]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins, in sorted arrays."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _lengths(starts: np.ndarray, total: int) -> np.ndarray:
    return np.diff(np.append(starts, total))


def _mixed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from those of its context and token."""
    x = h * np.uint64(0x9E3779B97F4A7C15) + w
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def start_context(length: int) -> int:
    """The hash of ``length`` start marks in a row."""
    h = s = np.array([marks()[0]], np.uint64)
    for _ in range(length - 1):
        h = _mixed(h, s)
    return int(h[0])


def bucket_of(h: np.ndarray, w: np.ndarray, buckets: int, heavy: dict[int, int]) -> np.ndarray:
    """By the hash of the context; for contexts in ``heavy``, over as many buckets as it says."""
    b = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    if heavy:
        x = np.sort(np.array(list(heavy), np.uint64))
        spread = np.array([heavy[int(k)] for k in x], np.int64)
        i = np.minimum(np.searchsorted(x, h), len(x) - 1)
        s = np.where(x[i] == h, spread[i], 1)
        b = (b + ((w >> np.uint64(16)) % s.astype(np.uint64)).astype(np.int64)) % buckets
    return b


def good_turing(counts: dict[int, int]) -> dict[int, float]:
    """Katz's discounts d_1 .. d_5 from counts of counts. Where the plain ones do not
    all lie in (0, 1) and rise, as where groups of copies bend the counts, all five come from
    counts of counts smoothed by Gale's log-linear fit: with a slope below -1 it
    always gives rising factors in (0, 1). Only without such a slope (a handful of
    words, or more seen twice than once) absolute discounting by n1 / (n1 + 2 n2)."""
    n = {r: float(counts.get(r, 0)) for r in range(1, DISCOUNTED + 2)}
    d = _katz(n) if all(n.values()) else {}
    if d and all(a < b for a, b in itertools.pairwise([0, *d.values(), 1])):
        return d
    slope = _slope({r: m for r, m in n.items() if m})
    if slope < -1 - 1e-9:
        return _katz({r: r ** slope for r in n})
    cut = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return {r: (r - cut) / r for r in range(1, DISCOUNTED + 1)}


def _katz(n: dict[int, float]) -> dict[int, float]:
    """(r* / r - a) / (1 - a) with Turing's r* = (r + 1) n_(r+1) / n_r: counts over
    five stay whole, and what the others lose is n1 in all (of the ``n`` given)."""
    a = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1]
    return {r: ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, DISCOUNTED + 1)} if a < 1 else {}


def _slope(n: dict[int, float]) -> float:
    """Of log n_r over log r by least squares, each n_r first spread over the gap
    between its neighbours that occur (Gale's averaging transform)."""
    rs = sorted(n)
    if len(rs) < 2:
        return 0.0
    below, above = [0, *rs[:-1]], [*rs[1:], 2 * rs[-1] - rs[-2]]
    y = np.log([2 * n[r] / (b - a) for r, a, b in zip(rs, below, above, strict=True)])
    x = np.log(rs)
    x = x - x.mean()
    return float(x @ y / (x @ x))


class _Ids(dict):
    """Numbers words in the order they come in."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def _segments(raw: bytes):
    """The words of a long text in pieces that end between words."""
    at, space = 0, re.compile(rb"[\x09-\x0d\x20]")
    while len(raw) - at > PIECE_BYTES:
        m = space.search(raw, at + PIECE_BYTES)
        if not m:
            break
        yield raw[at:m.start()].split()
        at = m.end()
    yield raw[at:].split()


def _chunks(order: int, chunk_bytes: int):
    """Texts as rows of ``_CHUNK``. A document stands as order - 1 marks (or, where it goes
    on in a new chunk, the tokens before), its words and its end."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        made, row, ids, docs, parts, size = 0, 0, _Ids(), [], [], 0
        pad = [_START] * (order - 1)

        def flush():
            nonlocal made, ids, docs, parts, size
            info, at = np.array(docs, _DOCS), np.concatenate(parts)
            train = np.repeat(info["flags"] & 1 > 0, info["n"] + len(pad)) & ~_pads(info["n"], len(pad))
            words = np.fromiter(map(token_hash, ids), np.uint64, len(ids))
            counts = np.bincount(at[train], minlength=len(ids))
            cols = [base + made, len({d[0] for d in docs}), int(info["n"].sum()), _zipped(info), _zipped(words), _zipped(counts.astype(np.uint32)), _zipped(at.astype(np.uint32))]
            made, ids, docs, parts, size = made + 1, _Ids(), [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([c]) for c in cols], names=["chunk", "rows", "tokens", "docs", "words", "counts", "ids"])

        for batch in slices(batches):
            for doc_id, train, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                before, flags, n = pad, int(bool(train)) + 2 * (doc_id is None), 0
                for words in itertools.chain(_segments((text or "").encode("utf-8").lower()), [None]):
                    last = words is None
                    words = [_END] if last else words
                    if not words:
                        continue
                    if n == 0:
                        parts.append(np.fromiter(map(ids.__getitem__, before), np.int32, len(before)))
                    parts.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
                    n, size = n + len(words), size + sum(map(len, words)) + len(words)
                    before = [*before, *words[-order:]][len(before) + len(words[-order:]) - len(pad):]
                    if size >= chunk_bytes or last:
                        docs.append((base + row, doc_id or 0, flags, n))
                        n = 0
                    if size >= chunk_bytes:
                        yield flush()
                row += 1
        if docs:
            yield flush()
        hand_back()

    return run


def _pads(n: np.ndarray, pads: int) -> np.ndarray:
    """Which places of a chunk hold marks before a document's tokens."""
    out = np.zeros(int(n.sum()) + pads * len(n), bool)
    first = np.cumsum(n + pads) - (n + pads)
    for k in range(pads):
        out[first + k] = True
    return out


class _Chunk:
    """A chunk read back: ``rank(k)`` gives its different n-grams of k tokens."""

    def __init__(self, row: dict, order: int, buckets: int, heavy: dict[int, dict[int, int]]):
        self.info = _unzipped(row["docs"], _DOCS)
        self.words, self.ids = _unzipped(row["words"], "<u8"), _unzipped(row["ids"], "<u4").astype(np.int64)
        self.counts = _unzipped(row["counts"], "<u4").astype(np.int64)
        self.targets = np.flatnonzero(~_pads(self.info["n"], order - 1))
        self.train = np.repeat(self.info["flags"] & 1 > 0, self.info["n"])
        self.buckets, self.heavy, self.found = buckets, heavy, {}

    def _grams(self, k: int):
        """(n-gram of k tokens that ends at every place, hashes of context and token)."""
        if k == 1:
            return self.ids, np.zeros(len(self.words), np.uint64), self.words
        if k not in self.found:
            below, h, w = self._grams(k - 1)
            keys = self.ids.copy()
            keys[1:] |= below[:-1] << 32
            one, at = np.unique(keys, return_inverse=True)
            whole = self.words if k == 2 else _mixed(h, w)
            self.found[k] = at, whole[one >> 32], self.words[one & 0xFFFFFFFF]
        return self.found[k]

    def asks(self, k: int):
        """The n-grams that end at a token, in the order they are asked in, with the
        buckets' bounds: contexts, tokens, times (in training, in all), and for every token its place."""
        at, h, w = self._grams(k)
        if k == 1:
            b = bucket_of(w, w, self.buckets, {})
            order = np.lexsort((w, b))
        else:
            b = bucket_of(h, w, self.buckets, self.heavy.get(k, {}))
            order = np.lexsort((w, h, b))
        at = at[self.targets]
        times = np.bincount(at, minlength=len(h))
        seen = self.counts if k == 1 else np.bincount(at[self.train], minlength=len(h))
        order = order[times[order] > 0]            # n-grams over the border of two documents end at no token
        place = np.empty(len(h), np.int64)
        place[order] = np.arange(len(order))
        bounds = np.searchsorted(b[order], np.arange(self.buckets + 1))
        return h[order], w[order], seen[order], times[order], place[at], bounds


    def numbered(self, w: np.ndarray) -> np.ndarray:
        """Tokens, given as hashes, by the numbers of the first level: a place in a bucket and
        the bucket. One token, one number, of as many bits as the vocabulary needs."""
        tokens, numbers = self.numbers
        return numbers[np.searchsorted(tokens, w)]

    def told(self, answers: list[dict], levels: int, discounts: list[dict[int, float]], first) -> tuple[np.ndarray, np.ndarray]:
        """(training count, probability under the model of ``levels`` tokens) of every token,
        level by level from what the buckets answered."""
        for level in range(1, levels + 1):
            h, w, *_, place, bounds = self.asks(level)
            mine = {r["bucket"]: _parts(r["data"]) for r in answers if r["level"] == level}
            c, of, weight = (np.empty(len(h)) for _ in range(3))
            for b, (times, totals, weights) in mine.items():
                s = slice(int(bounds[b]), int(bounds[b + 1]))
                c[s] = _unzipped(times, "<i8")
                if level == 1:
                    of[s] = _unzipped(totals, "<u4") * float(self.buckets) + b
                else:
                    runs = _starts(h[s])
                    n = _lengths(runs, s.stop - s.start)
                    of[s], weight[s] = np.repeat(_unzipped(totals, "<f8"), n), np.repeat(_unzipped(weights, "<f8"), n)
            if level == 1:
                count = c[place]
                p = first(count)
                self.numbers = w, of.astype(np.uint64)       # tokens come sorted by hash
            else:
                p = np.where(c[place] > 0, (_discounted(c, discounts[level]) / np.maximum(of, 1))[place], weight[place] * p)
        return count, p


def _ask(level: int, order: int, buckets: int, heavy: dict[int, dict[int, int]], discounts: list[dict[int, float]], first):
    """Chunks, beside what the levels below answered, to rows of ``_ASKED``. The second
    level tells the count of a token, which packs better than its probability."""
    def run(batches):
        import pyarrow as pa

        for row, answers in _grouped(batches):
            chunk = _Chunk(row, order, buckets, heavy)
            lower = None
            if level > 1:
                told = chunk.told(answers, level - 1, discounts, first)[min(level - 2, 1)]
            h, w, seen, times, place, bounds = chunk.asks(level)
            if level > 1:
                lower = np.empty(len(h))
                lower[place] = told                 # one value an n-gram: the token and shorter context are its own
            if 1 < level == order:
                w = chunk.numbered(w)               # lower levels need hashes to name longer contexts
            out = []
            for b in np.flatnonzero(np.diff(bounds)).tolist():
                s = slice(int(bounds[b]), int(bounds[b + 1]))
                runs = _starts(h[s])
                parts = [h[s][runs], _lengths(runs, s.stop - s.start).astype(np.uint32), w[s], seen[s].astype(np.uint32)]
                parts += [times[s].astype(np.uint32)] if level < order else [np.empty(0, np.uint32)]
                parts += [lower[s]] if level > 1 else []
                out.append((b, s.stop - s.start, _framed(*map(_zipped, parts))))
            chunk = lower = h = w = None
            for at in range(0, len(out), 64):
                b, n, data = zip(*out[at:at + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array([row["chunk"]] * len(b), pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())],
                                                 names=["bucket", "chunk", "n", "data"])
        hand_back()

    return run


def _grouped(batches):
    """(chunk, its answers) from rows that come sorted by chunk, the chunk itself first."""
    row, answers = None, []
    for batch in slices(batches, 64):
        for r in batch.to_pylist():
            if r["level"] == 0:
                if row is not None:
                    yield row, answers
                row, answers = r, []
            else:
                answers.append(r)
    if row is not None:
        yield row, answers


def _merge(level: int, order: int, heavy: dict[int, int], share: int, value):
    """Rows of ``_ASKED`` that come sorted by bucket, a bucket to a row of ``_MERGED``."""
    spread = np.sort(np.array(list(heavy), np.uint64))
    kinds = {"int": "int32", "long": "int64", "binary": "binary"}

    def merged(bucket: int, rows: list[dict]) -> dict:
        asked = [_parts(r["data"]) for r in rows]
        column = lambda i, t: np.concatenate([_unzipped(p[i], t) for p in asked])
        h, w = np.repeat(column(0, "<u8"), column(1, "<u4")), column(2, "<u8")
        perm = np.lexsort((w, h))
        h, w = h[perm], w[perm]
        first = _starts(h, w)
        at = np.empty(len(perm), np.uint32)
        at[perm] = np.repeat(np.arange(len(first), dtype=np.uint32), _lengths(first, len(h)))
        h, w = h[first], w[first]
        c = np.add.reduceat(column(3, "<u4").astype(np.int64)[perm], first)
        lower = column(5, "<f8")[perm[first]] if level > 1 else np.empty(0)
        few = np.bincount(c[c <= DISCOUNTED + 1], minlength=DISCOUNTED + 2)
        heavy_x, heavy_t = np.empty(0, np.uint64), np.empty(0, np.int64)
        if level < order:
            t = np.add.reduceat(column(4, "<u4").astype(np.int64)[perm], first)
            big = np.flatnonzero(t >= share)
            heavy_x, heavy_t = (w if level == 1 else _mixed(h, w))[big], t[big]
        runs = _starts(h)
        length, open_ = _lengths(runs, len(h)), np.isin(h[runs], spread)
        beyond = []                                  # contexts that other buckets hold too
        for a, n in zip(runs[open_].tolist(), length[open_].tolist(), strict=True):
            own = c[a:a + n]
            beyond.append((own.sum(), value(lower[a:a + n][own > 0]).sum(), *np.bincount(own[own <= DISCOUNTED], minlength=DISCOUNTED + 1)[1:]))
        return {"bucket": bucket, "chunks": np.array([(r["chunk"], r["n"]) for r in rows], "<i8").tobytes(), "at": _zipped(at),
                "contexts": _framed(_zipped(length.astype(np.uint32)), h[runs[open_]].tobytes(), _zipped(open_.astype(np.uint8))),
                "c": _zipped(c), "lower": _zipped(lower), "counts": few[1:].tobytes(), "tokens": int(c.sum()), "types": int((c > 0).sum()),
                "heavy_x": heavy_x.tobytes(), "heavy_t": heavy_t.tobytes(), "spread_x": h[runs[open_]].tobytes(), "spread_sums": np.array(beyond, "<f8").tobytes()}

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([(f.split(" ")[0], kinds[f.split(" ")[1]]) for f in _MERGED.split(", ")])
        bucket, rows = None, []
        for batch in slices(batches, 64):
            for r in batch.to_pylist():
                if r["bucket"] != bucket:
                    if rows:
                        yield pa.RecordBatch.from_pylist([merged(bucket, rows)], schema=schema)
                    bucket, rows = r["bucket"], []
                rows.append(r)
        if rows:
            yield pa.RecordBatch.from_pylist([merged(bucket, rows)], schema=schema)
        hand_back()

    return run


def _discounted(c: np.ndarray, d: dict[int, float]) -> np.ndarray:
    out = c.astype(np.float64)
    for r, x in d.items():
        out[c == r] = r * x
    return out


def _answer(level: int, d: dict[int, float], value, spread: dict[int, tuple[float, float, float]]):
    """A row of ``_MERGED`` to what it tells each chunk that asked: the training counts of its
    n-grams; of single tokens also their places in the bucket, and of longer ones for each of its contexts what discounted counts are divided by and the back-off weight.
    ``spread``: count, discounted count and lower-order mass of contexts in several buckets."""
    xs = np.sort(np.array(list(spread), np.uint64))
    sums = np.array([spread[int(x)] for x in xs], np.float64).reshape(-1, 3)

    def contexts(r: dict, c: np.ndarray):
        length, own, open_ = _parts(r["contexts"])
        length, open_ = _unzipped(length, "<u4").astype(np.int64), _unzipped(open_, np.uint8) > 0
        runs, p = np.cumsum(length) - length, value(_unzipped(r["lower"], "<f8"))
        total, mass, covered = (np.add.reduceat(x, runs).astype(np.float64) for x in (c, _discounted(c, d), np.where(c > 0, p, 0.0)))
        i = np.searchsorted(xs, np.frombuffer(own, "<u8"))
        for k, x in enumerate((total, mass, covered)):
            x[open_] = sums[i, k]
        of = np.where(mass >= total * (1 - 1e-12), total + 1, total)
        seen = total > 0
        weight = np.ones(len(of))
        weight[seen] = (1 - mass[seen] / of[seen]) / (1 - covered[seen])
        return np.repeat(np.arange(len(length)), length), of, weight

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 1):
            r = batch.to_pylist()[0]
            c, at = _unzipped(r["c"], "<i8"), _unzipped(r["at"], "<u4")
            context, of, weight = contexts(r, c) if level > 1 else (None, np.empty(0), np.empty(0))
            chunks = np.frombuffer(r["chunks"], "<i8").reshape(-1, 2)
            ends = np.cumsum(chunks[:, 1])

            def told(i):
                own = at[ends[i] - chunks[i, 1]:ends[i]]
                mine = context[own][_starts(context[own])] if level > 1 else np.empty(0, np.int64)
                if level == 1:
                    return _framed(_zipped(c[own]), _zipped(own), b"")
                return _framed(_zipped(c[own]), _zipped(of[mine]), _zipped(weight[mine]))
            for k in range(0, len(chunks), 64):
                data = [told(i) for i in range(k, min(k + 64, len(chunks)))]
                yield pa.RecordBatch.from_arrays([pa.array(chunks[k:k + 64, 0]), pa.array([level] * len(data), pa.int32()), pa.array([r["bucket"]] * len(data), pa.int32()),
                                                  pa.array(data, pa.binary())], names=["chunk", "level", "bucket", "data"])
        hand_back()

    return run


def _sums(order: int, buckets: int, heavy: dict[int, dict[int, int]], discounts: list[dict[int, float]], first, every: float):
    """Chunks, beside the answers of all levels, to a row for each document (or part of one)."""
    def run(batches):
        import pyarrow as pa

        for row, answers in _grouped(batches):
            chunk = _Chunk(row, order, buckets, heavy)
            c, p = chunk.told(answers, order, discounts, first)
            info, starts = chunk.info, np.cumsum(chunk.info["n"]) - chunk.info["n"]
            known, base, score = (np.add.reduceat(x, starts) for x in ((c > 0).astype(np.int64), np.log10(c + 0.1) - every, np.log10(p)))
            yield pa.RecordBatch.from_arrays([pa.array(info["row"].copy()), pa.array(info["doc_id"].copy(), mask=info["flags"] & 2 > 0), pa.array(info["flags"] & 1 > 0),
                                              pa.array(info["n"].copy()), pa.array(known), pa.array(base), pa.array(score)],
                                             names=["row", "doc_id", "train", "n", "known", "base", "score"])
        hand_back()

    return run


def heavy_contexts(merged: DataFrame, buckets: int) -> dict[int, int]:
    """N-grams of a level that hold more than an eighth of a bucket's share of all tokens, at most
    ``8 * buckets`` of them, and over how many buckets the next level spreads what follows them."""
    rows = merged.select("heavy_x", "heavy_t", "share").filter(F.length("heavy_x") > 0).collect()
    found = {}
    for r in rows:
        for x, t in zip(np.frombuffer(r.heavy_x, "<u8").tolist(), np.frombuffer(r.heavy_t, "<i8").tolist(), strict=True):
            found[x] = min(buckets, -(-t // r.share))
    return found


def _spread_totals(merged: DataFrame, d: dict[int, float]) -> dict[int, tuple[float, float, float]]:
    """Count, discounted count and lower-order mass of the contexts in several buckets: at most
    ``16 * buckets`` rows are read."""
    totals: dict[int, np.ndarray] = {}
    for r in merged.select("spread_x", "spread_sums").filter(F.length("spread_x") > 0).orderBy("bucket").collect():
        for x, s in zip(np.frombuffer(r.spread_x, "<u8").tolist(), np.frombuffer(r.spread_sums, "<f8").reshape(-1, 2 + DISCOUNTED), strict=True):
            totals[x] = totals.get(x, 0) + s
    less = np.array([r * (1 - d[r]) for r in range(1, DISCOUNTED + 1)])
    return {x: (s[0], s[0] - float(s[2:] @ less), s[1]) for x, s in totals.items()}


def score_documents(docs: DataFrame, modulus: int = 10, held_out: int = 0, order: int = 2, chunk_bytes: int = CHUNK_BYTES,
                    bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """Scores of every row's whole text under a model of ``order`` tokens, learnt from the rows
    whose crc32 of the id, modulo ``modulus``, is not ``held_out``: ``doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score, score``. Every n-gram of the training rows
    is in the model. A text begins with ``order - 1`` marks that are never predicted.

    Null, empty and blank texts are the end token alone; a null ``doc_id`` counts
    as the empty id and stays null; repeated rows are counted and scored each;
    other columns are not read; an empty table gives no rows. Without training
    rows every token is unknown and has probability 1. Texts longer than a chunk
    go on in the next one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (doc_remainder(F.col("doc_id").cast("long"), modulus) != held_out).alias("train"), "text")
    chunks = saved(docs.mapInArrow(_chunks(order, chunk_bytes), _CHUNK), "chunks")
    size = chunks.agg(F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows"), F.count("*").alias("chunks"), F.max(F.col("chunk") % (1 << 40)).alias("most")).first()
    tokens = size.tokens or 0
    buckets = max(LEAST_BUCKETS, -(-tokens // bucket_tokens))
    share = max(1, tokens // (8 * buckets))
    parts, tasks = min(buckets, MOST_TASKS), min(max(LEAST_BUCKETS, size.chunks), MOST_TASKS)
    rows = chunks.select("chunk", F.lit(0).alias("level"), F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("data"), "docs", "words", "counts", "ids")

    slot = ((F.shiftright("chunk", 40) * (size.most + 1) + F.col("chunk") % (1 << 40)) % tasks).cast("int") if size.chunks else F.lit(0)

    def with_answers() -> DataFrame:
        told = rows
        for a in answers:
            told = told.unionByName(a, allowMissingColumns=True)
        return told.repartitionById(tasks, slot).sortWithinPartitions("chunk", "level") if answers else rows

    heavy, answers, discounts, value, first = {}, [], [{}], None, None
    for level in range(1, order + 1):
        if level > 1:
            starts = {start_context(level - 1): min(buckets, -(-(size.rows or 0) // share) or 1)}
            heavy[level] = starts | heavy_contexts(merged, buckets)
        asked = with_answers().mapInArrow(_ask(level, order, buckets, dict(heavy), list(discounts), first), _ASKED)
        by_bucket = asked.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket", "chunk")
        merged = saved(by_bucket.mapInArrow(_merge(level, order, heavy.get(level, {}), share, value), _MERGED), f"level{level}").withColumn("share", F.lit(share))
        stats = merged.select("counts", "tokens", "types").collect()              # a row a bucket
        few = sum((np.frombuffer(r.counts, "<i8") for r in stats), np.zeros(DISCOUNTED + 1, np.int64))
        d = good_turing({r: int(few[r - 1]) for r in range(1, DISCOUNTED + 2)})
        spread = _spread_totals(merged, d) if level > 1 else {}
        answers.append(merged.select("bucket", "chunks", "at", "contexts", "c", "lower").mapInArrow(_answer(level, d, value, spread), _ANSWER))
        discounts.append(d)
        if level == 1:
            n, v = sum(r.tokens for r in stats), sum(r.types for r in stats)
            value = first = _unigram(n, {r: int(few[r - 1]) for r in d}, d)
        else:
            value = _same
    every = math.log10(n + 0.1 * (v + 1))
    last = with_answers().mapInArrow(_sums(order, buckets, heavy, discounts, first, every), _SUMS)
    return last.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("train").alias("train"), *[F.sum(c).alias(c) for c in ("n", "known", "base", "score")]).select(
        "doc_id", (~F.col("train")).alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), "score")


def _unigram(n: int, few: dict[int, int], d: dict[int, float]):
    """Training count of a token -> its probability; tokens never seen are one, with what the others lost."""
    lost = sum(few[r] * r * (1 - x) for r, x in d.items())
    whole = n if lost > 0 else n + 1                     # the unknown token has mass in any case
    unknown = (whole - n + lost) / whole if n else 1.0

    def value(c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, _discounted(c, d) / max(whole, 1), unknown)

    return value


def _same(p: np.ndarray) -> np.ndarray:
    return p
