"""Alignment of two tokenizers' tokens, with an identity-map fast path.

A text's A and B tokens are cut into groups where both end at one byte. Most groups
are one A token beside one B token of the same bytes; an array over A's vocabulary
names that B id, so such a group is a bare A id, counted in a vector as long as the
vocabulary. Only the links of other (irregular) groups are pairs, summed in each task
before they are shuffled.

Texts are cut at white space where no token of either vocabulary goes across, and a
worker aligns each different unit once (``UNITS`` at most are remembered). A second
pass gives every link its pair's corpus-wide count: identity links from the broadcast
vector, the ``COMMON`` commonest irregular pairs from a broadcast table, the rest by
a join. Texts are tokenized once; what the second pass reads are ids.
"""

from __future__ import annotations

import re
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _L, _LIBRARY_ONLY, _PRETOKENS, _byte_symbols, bpe_encoder, hand_back, saved, slices
from .token_counts import PieceCounter

UNITS, LONGEST, TALLY, COMMON = 150_000, 48, 500_000, 1 << 20
_SPACE = "▁"                                            # fixed value: the vocabulary's mark for a space
_UNIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_WORDS = re.compile(rf"[ \n]*[{_L}]+(?=[,.;:!?])|[ \n]*[^ \n]+|[ \n]+")      # words also cut before a mark
_MIXED = re.compile(rf"[{_L}][,.;:!?]")
_PLAIN = re.compile(rf" [{_L}]+\Z")
_PIECES = re.compile(r" *[^ \n]+|\n| +")
_OTHER = re.compile(f"[^\\S \\n]|[{_SPACE}\x1c-\x1f]")   # white space beside space and line feed, and the mark itself
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")


class _Units(dict):
    """What units come to, in two generations: when the young one is full it becomes
    the old one, so what is asked for again and again is never computed again."""

    def __init__(self, fn, most: int):
        super().__init__()
        self.fn, self.most, self.old = fn, most, {}

    def __missing__(self, unit):
        if len(unit) > LONGEST:
            return self.fn(unit)
        found = self.old.get(unit)
        return self.keep(unit, self.fn(unit) if found is None else found)

    def keep(self, unit, found):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[unit] = found
        return found


class Aligner:
    """Alignments of whole texts: space + text by a byte-level BPE file (A), text by a
    sentencepiece file (B)."""

    def __init__(self, a_path: str, b_path: str):
        self.a = bpe_encoder(a_path, plain_specials=True)
        self.b = PieceCounter(b_path)
        back = {s: i for i, s in enumerate(_byte_symbols())}
        tokens = self.a.tokenizer.get_vocab()
        specials = set(self.a.tokenizer.get_added_tokens_decoder())
        self.a_bytes = [b""] * self.a.size
        for token, i in tokens.items():
            self.a_bytes[i] = token.encode() if i in specials else bytes([back[c] for c in token])
        library = self.b.library
        self.b_bytes = []
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            byte = _BYTE.match(piece)
            self.b_bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace(_SPACE, " ").encode())
        self.b_id = identity_map(self.a_bytes, self.b_bytes)
        # strings are kept once for each id, not for each unit
        self.one = [f"{a}|{b}" for a, b in enumerate(self.b_id)]
        self.same = [a.to_bytes(4, "little") for a in range(self.a.size)]
        self.memo = _Units(self._unit, UNITS)
        # A never joins a letter and a mark; where no piece of B does, words are cut there
        pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())]
        self.units = (_UNIT if any(map(_MIXED.search, pieces)) else _WORDS).findall
        self.spelt = {i: chr(i).encode().decode("latin-1").translate(self.a._symbols) for i in range(0x250)}

    def _a_ids(self, text: str) -> list[int]:
        a = self.a
        tokenize, symbols = a._model.tokenize, a._symbols
        if a.joined and not a.specials and len(text) <= LONGEST and _PLAIN.match(text):
            return [t.id for t in tokenize(text.translate(self.spelt))]
        if not a.joined or len(text) > LONGEST or _LIBRARY_ONLY.search(text) or any(s in text for s in a.specials):
            return np.frombuffer(a.encode_bytes(text), "<u4").tolist()
        return [t.id for p in _PRETOKENS.findall(text) for t in tokenize(p.encode().decode("latin-1").translate(symbols))]

    def _b_ids(self, unit: str) -> list[int]:
        """B's ids of a unit with just the spaces it begins with (see ``PieceCounter``)."""
        counter = self.b
        counter = self.b
        return [i for u in _PIECES.findall(unit) for i in counter.library.encode("\n" + u)[counter.lead:]]

    def ids(self, a: list[int], b: list[int], target: bytes):
        """``n_a, n_b, n_groups, same, pairs, shown`` of two id lists: ``same`` the A ids of
        identity groups, ``pairs`` the links of the others as a << 32 | b (little-endian),
        ``shown`` the groups. None where either list's bytes are not ``target``."""
        parts_a, parts_b = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if b"".join(parts_a) != target or b"".join(parts_b) != target:
            return None
        b_id, one = self.b_id, self.one
        if len(a) == 1 and len(b) == 1 and b_id[a[0]] == b[0]:
            return 1, 1, 1, self.same[a[0]], b"", one[a[0]]
        same, pairs, shown, i, j, n = [], [], [], 0, 0, len(a)
        long_a, long_b = list(map(len, parts_a)), list(map(len, parts_b))
        while i < n:
            x, y = a[i], b[j]
            end_a, end_b = long_a[i], long_b[j]
            if end_a == end_b and b_id[x] == y:
                same.append(self.same[x])
                shown.append(one[x])
            else:
                own_a, own_b = str(x), str(y)
                pairs.append(x << 32 | y)
                while end_a != end_b:                   # the one that ends first goes on; what it meets overlaps it
                    if end_a < end_b:
                        i += 1
                        x = a[i]
                        end_a += long_a[i]
                        own_a += f",{x}"
                    else:
                        j += 1
                        y = b[j]
                        end_b += long_b[j]
                        own_b += f",{y}"
                    pairs.append(x << 32 | y)
                shown.append(f"{own_a}|{own_b}")
            i += 1
            j += 1
        return n, len(b), len(shown), b"".join(same), struct.pack(f"<{len(pairs)}Q", *pairs), ";".join(shown)

    def _unit(self, unit: str):
        return self.ids(self._a_ids(unit), self._b_ids(unit), unit.encode())

    def learn(self, units: set[str]) -> None:
        """Align the units not met before, their B ids in one call."""
        memo = self.memo
        fresh = [u for u in units if u not in memo and u not in memo.old and len(u) <= LONGEST]
        pieces = [_PIECES.findall(u) for u in fresh]
        ids = iter(self.b.library.encode(["\n" + p for own in pieces for p in own], num_threads=1))
        lead = self.b.lead
        for unit, own in zip(fresh, pieces, strict=True):
            b = next(ids)[lead:]
            for _ in own[1:]:
                b = b + next(ids)[lead:]
            memo.keep(unit, self.ids(self._a_ids(unit), b, unit.encode()))

    def texts(self, texts: list[str]) -> list:
        """``text`` of each; texts of a few units are worth asking for together."""
        cut = [self.units(" " + t) if t and self.b.exact and not _OTHER.search(t) else None for t in texts]
        self.learn(set().union(*[c for c in cut if c]))
        return [self.joined(c) if c else self.text(t) for t, c in zip(texts, cut, strict=True)]

    def text(self, text: str):
        """What ``ids`` gives for space + text by A and text by B; None without tokens."""
        if not text:
            return None
        spaced = " " + text
        if not self.b.exact or _OTHER.search(spaced):
            return self.ids(self._a_ids(spaced), self.b.library.encode(text), spaced.encode())
        return self.joined(self.units(spaced))

    def joined(self, units: list[str]):
        """The alignments of a text's units, one after another."""
        found = list(map(self.memo.__getitem__, units))
        if None in found:
            return None
        n_a, n_b, groups, same, pairs, shown = zip(*found, strict=True)
        return sum(n_a), sum(n_b), sum(groups), b"".join(same), b"".join(pairs), ";".join(shown)


def identity_map(a_bytes: list[bytes], b_bytes: list[bytes]) -> list[int]:
    """For each A id the B id of the same bytes, -1 where there is none. Of several, a
    byte piece yields to a written one, then the smallest id is taken: an occurrence
    of another counts as irregular."""
    of: dict[bytes, int] = {}
    for i in reversed(range(len(b_bytes))):
        of[b_bytes[i]] = i
    for i in range(len(b_bytes) - 1, 255 + 3, -1):       # written pieces after the byte pieces
        if len(b_bytes[i]) == 1:
            of[b_bytes[i]] = i
    return [of.get(x, -1) if x else -1 for x in a_bytes]


_ALIGNERS: dict = {}


def _aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


class _Tally:
    """Counts of pairs, kept sorted; what has grown over ``TALLY`` is given out."""

    def __init__(self):
        self.waiting, self.held = [], 0

    def add(self, keys: np.ndarray):
        if len(keys):
            self.waiting.append(np.unique(keys, return_counts=True))
            self.held += len(self.waiting[-1][0])
        if self.held > 4 * TALLY:
            self.waiting = [self.merged()]
            self.held = len(self.waiting[0][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.waiting:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        keys, counts = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        whole, place = np.unique(keys, return_inverse=True)
        sums = np.zeros(len(whole), np.int64)
        np.add.at(sums, place, counts)
        return whole, sums

    def full(self) -> bool:
        return len(self.waiting) == 1 and self.held > TALLY

    def clear(self):
        self.waiting, self.held = [], 0


_ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, same binary, pairs binary, tally_pair binary, tally_n binary"


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``row`` and the alignment of every text, beside rows of tallies (``tally_pair``,
    ``tally_n``: pairs as a << 32 | b and their counts in the task's irregular groups;
    identity groups as a << 32 | 2 ** 32 - 1)."""
    def run(batches):
        import gc
        import hashlib

        import pyarrow as pa

        aligner = _aligner(a_path, b_path)
        vector, tally = np.zeros(aligner.a.size, np.int64), _Tally()
        gc.disable()                                    # no cycles here, and scans of the memo cost more than the work
        names = [c.split()[0] for c in _ROWS.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.string()] + [pa.binary()] * 4

        def out(columns):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        def told(keys, counts):
            for at in range(0, len(keys), 1 << 16):
                some = slice(at, at + (1 << 16))
                yield out([[None]] * 8 + [[keys[some].astype("<u8").tobytes()], [counts[some].astype("<i8").tobytes()]])

        for batch in slices(batches, 128):
            rows = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, found in zip(batch.column(0).to_pylist(), aligner.texts(texts), strict=True):
                if found is None:
                    rows.append((doc_id, 0, 0, 0, 0, "", b"", b"", None, None))
                    continue
                n_a, n_b, groups, same, pairs, shown = found
                keys = np.frombuffer(pairs, "<u8")
                vector += np.bincount(np.frombuffer(same, "<u4"), minlength=len(vector))
                tally.add(keys)
                rows.append((doc_id, n_a, n_b, groups, len(same) // 4 + len(keys), hashlib.sha256(shown.encode()).hexdigest(), same, pairs, None, None))
            if rows:
                yield out(list(zip(*rows, strict=True)))
            if tally.full():
                yield from told(*tally.merged())
                tally.clear()
        yield from told(*tally.merged())
        ids = np.flatnonzero(vector)
        yield from told(ids.astype(np.uint64) << np.uint64(32) | np.uint64(2**32 - 1), vector[ids])
        gc.enable()
        hand_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ROWS).withColumn("row", F.monotonically_increasing_id())


def pair_counts(aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``pair, n, best``: every linked id pair (a << 32 | b), its links, and whether no
    other pair of its B id has more. Identity counts go in as one row an A id."""
    def rows(batches):
        import pyarrow as pa

        of = np.array(_aligner(a_path, b_path).b_id, np.int64)
        for batch in batches:
            for keys, counts in zip(batch.column(0), batch.column(1), strict=True):
                k, n = np.frombuffer(keys.as_py(), "<u8").copy(), np.frombuffer(counts.as_py(), "<i8")
                a = (k >> np.uint64(32)).astype(np.int64)
                same = (k & np.uint64(2**32 - 1)) == np.uint64(2**32 - 1)
                k[same] = (a[same] << 32 | of[a[same]]).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(n)], names=["pair", "n"])

    each = aligned.filter("tally_pair is not null").select("tally_pair", "tally_n").mapInArrow(rows, "pair long, n long")
    counts = saved(each.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit(2**32 - 1)).alias("b")
    most = counts.groupBy(b).agg(F.max("n").alias("most"))         # a row a B id
    return counts.withColumn("b", F.col("pair").bitwiseAND(F.lit(2**32 - 1))).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_report(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    Null and empty texts, and texts whose joined A or B bytes differ from a space and the
    text, have no tokens: zeros and an empty ``groups_sha256``. Special strings inside
    texts are plain text. Repeated rows count each time; a null ``doc_id`` stays null;
    other columns are not read; an empty table gives no rows. Very long texts are
    aligned unit by unit.
    """
    spark = docs.sparkSession
    aligned = saved(align_documents(docs, a_path, b_path), "aligned")
    counts = saved(pair_counts(aligned, a_path, b_path), "pair_counts")
    # tier one: identity pairs (one an A id at most) and the commonest others
    size = _aligner(a_path, b_path).a.size
    identity = spark.createDataFrame([(int(a << 32 | b),) for a, b in enumerate(_aligner(a_path, b_path).b_id) if b >= 0], "pair long")
    same = counts.join(F.broadcast(identity), "pair").toPandas()
    vector, top = np.zeros(size, np.int64), np.zeros(size, bool)
    at = same["pair"].to_numpy() >> 32
    vector[at], top[at] = same["n"].to_numpy(), same["best"].to_numpy()
    common = counts.orderBy(F.desc("n"), "pair").limit(COMMON).orderBy("pair").toPandas()
    keys = common["pair"].to_numpy().astype(np.uint64)
    least = spark.sparkContext.broadcast((vector, top, keys, common["n"].to_numpy(), common["best"].to_numpy()))

    def look_up(batches):
        import pyarrow as pa

        vector, top, keys, n, best = least.value
        names = ["row", "n_best", "count_sum", "rare"]
        for batch in slices(batches, 512):
            got, sums, rare = [], [], []
            for same, pairs in zip(batch.column(1), batch.column(2), strict=True):
                ids, own = np.frombuffer(same.as_py(), "<u4"), np.frombuffer(pairs.as_py(), "<u8")
                place = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
                held = keys[place] == own if len(keys) else np.zeros(len(own), bool)
                place = place[held]
                got.append(int(top[ids].sum()) + int(best[place].sum()))
                sums.append(int(vector[ids].sum()) + int(n[place].sum()))
                rare.append(own[~held].astype(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64()), pa.array(sums, pa.int64()), pa.array(rare, pa.list_(pa.int64()))], names=names)

    texts = aligned.filter("tally_pair is null")
    looked = saved(texts.select("row", "same", "pairs").mapInArrow(look_up, "row long, n_best long, count_sum long, rare array<long>"), "looked")
    # tier two: links of rare pairs, joined
    rest = (looked.select("row", F.explode("rare").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("links"))
            .join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more_sum")))
    return (texts.join(looked.drop("rare"), "row").join(rest, "row", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
                    (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256"))
