"""Operators of parlance.llm against brute force on small tables that hold nulls,
empty texts, ties, repeated rows and columns with clashing names."""
import collections
import functools
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from parlance.llm import (chat_format, decontaminate, html_main, idpack, katz, packing, quality, simhash_bk, token_counts, topk_pivot)
from parlance.llm.common import BpeEncoder, vocabulary_path

BPE = vocabulary_path("byte_bpe_50k.json")
WORDS = "the of and thntst, Ering ouble de la être über 12 x_1 don't <|endoftext|> \n \n\n  ### </turn>".split(" ")
DOCS = "doc_id long, text string, score double, rank int, node long, start long"


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    made = [" ".join(draw.choices(WORDS, k=draw.randint(1, 400))) for _ in range(60)]
    return [None, "", " ", "a", "the the", made[0], made[0] + " of", "x " * 5000, *made]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, 0.5, 1, 2, 3) for i, t in enumerate(texts)] + [(7, texts[7], 0.5, 1, 2, 3)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def ids(texts):
    tokenizer = BpeEncoder(BPE).tokenizer
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_library(texts):
    encoder = BpeEncoder(BPE)
    for t in [t or "" for t in texts] + ["é²¼ ªµ x_1　y\x85z", "a \n b\x1c c", " 漢字 かな! 😀", "“naïve” — _x ’s 12ab34€"]:
        assert encoder.encode_bytes(t) == encoder._whole(t)


def test_chat_format(spark):
    hard = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", hard + "\\"), (1, 1, "assistant", "\\\\</turn> é<|endoftext|>"), (1, 2, "tool</turn>", None),
            (2, None, None, ""), (None, 3, "assistant", "x" * 50_000), (1, 1, "assistant", hard + "\\")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, chunk string")
    chunks = chat_format.format_conversations(turns, chunk_ids=16)
    got = {r.conv_id: r for r in chat_format.read_conversations(chunks).collect()}
    for conv in (1, 2, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] or -1, r[2] or "", r[3] or ""))
        said = "".join(r[3] for r in own if r[2] == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat_format.read_conversations(chat_format.format_conversations(turns.limit(0))).count() == 0
    for text in (hard, "\\\\" + hard, "### ### User: ", "</turn></turn>", "\\"):
        assert chat_format.unescape(chat_format.escape(text)) == text


def test_packing(docs, none, ids):
    rows = packing.pack_documents(docs).collect()
    by_doc, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, own in enumerate(ids):
        own, copies = [*own, 1], 2 if i == 7 else 1
        assert sum(r.length for r in by_doc[i]) == len(own) * copies
        for r in by_doc[i]:
            assert zlib.crc32(r.ids) == crc(own[r.start:r.start + r.length]) and r.doc_tokens == len(own)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0
    assert packing.pack_documents(none).count() == 0


def test_least_squares():
    a = np.random.default_rng(1).random((12, 30))
    b = a @ np.where(np.arange(30) % 5 == 0, 2.0, 0.0)
    x = packing.non_negative_least_squares(a, b)
    assert x.min() >= 0 and np.abs(a @ x - b).max() < 1e-8
    histogram = np.random.default_rng(2).integers(0, 500, 65)
    used = sum(need * times for need, times in packing.solve_repeats(histogram))
    assert (used[1:] <= histogram[1:]).all() and all(need @ np.arange(65) == 64 for need, _ in packing.solve_repeats(histogram))


@pytest.mark.parametrize(("order", "spread"), [(1, False), (2, False), (2, True), (3, True)])
def test_katz(docs, none, texts, monkeypatch, order, spread):
    if spread:
        monkeypatch.setattr(katz, "heavy_contexts", lambda d, b: {katz.token_hash(b"the"): 3, katz.token_hash(b"absent"): 2})
    rows = katz.score_documents(docs, order=order, chunk_bytes=4_000, bucket_tokens=23 if order == 3 else 500).collect()
    all_texts = [*enumerate(texts), (7, texts[7])]
    words = [(i, [b" s"] * (order - 1) + [*(t or "").encode().lower().split(), b" e"]) for i, t in all_texts]
    out = {i for i, _ in all_texts if zlib.crc32(str(i).encode()) % 10 == 0}
    seen = [collections.Counter() for _ in range(order + 1)]
    for i, w in words:
        for k in range(1, order + 1):
            if i not in out:
                seen[k].update(tuple(w[j - k + 1:j + 1]) for j in range(order - 1, len(w)))
    one = seen[1]
    n, v = sum(one.values()), len(one)
    d = [katz.good_turing(collections.Counter(c.values())) for c in seen]
    lost = sum(c * (1 - d[1][c]) for c in one.values() if c in d[1])
    whole = n if lost > 0 else n + 1
    follow = collections.defaultdict(list)
    for k in range(2, order + 1):
        for g, c in seen[k].items():
            follow[g[:-1]].append((g[-1], c))

    @functools.cache
    def back_off(h):
        mass, total = sum(d[len(h) + 1].get(c, 1) * c for _, c in follow[h]), sum(c for _, c in follow[h])
        of = total + (mass >= total * (1 - 1e-12))
        return of, (1 - mass / of) / (1 - sum(p(h[1:], w) for w, _ in follow[h])) if total else 1.0

    @functools.cache
    def p(h, w):
        if not h:
            return d[1].get(one[w,], 1) * one[w,] / whole if one[w,] else (whole - n + lost) / whole
        c = seen[len(h) + 1][(*h, w)]
        return d[len(h) + 1].get(c, 1) * c / back_off(h)[0] if c else back_off(h)[1] * p(h[1:], w)

    for h in [(b" s",) * (order - 1), (b"the", b"of")[:order - 1], (b"x", b"x")[:order - 1]]:
        assert abs(sum(p(h, w) for w, in one) + p(h, b"never") - 1) < 1e-9
    want = collections.defaultdict(list)
    for i, w in words:
        own = w[order - 1:]
        want[i].append((i in out, len(own), sum(one[t,] > 0 for t in own), n, sum(math.log10((one[t,] + .1) / (n + .1 * (v + 1))) for t in own),
                        sum(math.log10(p(tuple(w[j - order + 1:j]), w[j])) for j in range(order - 1, len(w)))))
    assert len(rows) == len(words)
    for r in rows:
        assert tuple(r)[1:5] == want[r.doc_id][0][:4]
        assert tuple(r)[5:] == pytest.approx(want[r.doc_id][0][4:], rel=1e-9)
    assert katz.score_documents(none, order=order).count() == 0


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def test_decontamination(spark, none):
    draw = random.Random(3)
    word = lambda: "".join(draw.choices("abcdefgh", k=draw.randint(2, 7)))
    items = [" ".join(word() for _ in range(30)) for _ in range(6)] + ["", None]
    rows, text = [(-1, None), (-2, "")], " ".join(word() for _ in range(40))
    for i in range(60):
        item = list(items[i % 6])
        for _ in range(draw.choice([0, 3, 8, 14, 20, 40])):
            at = draw.randrange(len(item))
            item[at:at + draw.choice([0, 1])] = draw.choice(["", "z", "q"])
        rows.append((i, text.upper() + " \n " + "".join(item).title() + "  tail " + text))
    benchmark = spark.createDataFrame([(i, t, 9) for i, t in enumerate(items)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    grouped = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark, group_bytes=500).collect()}
    want = {}
    for doc, t in rows:
        for k, item in enumerate(items):
            if t and item and (d := distance(item, decontaminate.normalised(t))) <= decontaminate.edit_budget(len(item)):
                want[doc, k] = d
    assert got == want == grouped and any(want.values())
    assert decontaminate.find_contaminated(none, benchmark).count() == 0


def test_quality(spark, none):
    draw = random.Random(1)
    good = lambda: " ".join(draw.choices("the of and ering ouble thnt".split(), k=40))
    rows = [(i, good() if i % 2 else good().upper() + " !! $$$", "clash") for i in range(300)] + [(500, None, ""), (501, "", ""), (None, "of the", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(300)] + [(None, 1, ""), (3, None, "")], "doc_id long, quality int, text string")
    got = quality.score_quality(docs, quality.train_quality(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all((r.score >= 0.5) == bool(r.doc_id % 2) for r in got if r.doc_id is not None and r.doc_id < 300)
    assert quality.score_quality(none, quality.train_quality(none, labels)).count() == 0


def test_bit_packing(spark, docs, none, texts, ids, tmp_path):
    for bits in (1, 7, 16, 17, 33, 63):
        some = np.random.default_rng(bits).integers(0, 1 << min(bits, 32), 1000).astype(np.uint64)
        assert (idpack.unpack_bits(idpack.pack_bits(some, bits), bits, 130, 777) == some[130:777]).all()
    idpack.write_ids(docs, str(tmp_path / "ids"), block_ids=500)
    rows = sorted(idpack.read_ids(spark, str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    want = [i for i in range(len(texts)) for _ in range(2 if i == 7 else 1)]
    at = 0
    for r, i in zip(rows, want, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) == (i, at, len(ids[i]) + 1, crc([*ids[i], 0]))
        at += r.n_tokens
    idpack.write_ids(none, str(tmp_path / "none"))
    assert idpack.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_simhash(docs, none, texts):
    import xxhash

    def brute(t):
        w = (t or "").encode().lower().split()
        grams = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        votes = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
        return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))

    prints = {i: brute(t) for i, t in enumerate(texts)}
    component = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    component[a] = component[b] = min(component[a], component[b])
    rows = simhash_bk.near_duplicates(docs).collect()
    assert len(rows) == len(texts) + 1
    assert all((r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", component[r.doc_id]) for r in rows)
    assert simhash_bk.near_duplicates(none).count() == 0


def test_near_links_of_full_shards(spark):
    draw = random.Random(4)
    base = draw.getrandbits(64)
    values = {base} | {draw.getrandbits(64) for _ in range(30)}
    while len(values) < 220:
        values.add(draw.choice(sorted(values)) ^ sum(1 << draw.randrange(64) for _ in range(draw.choice([1, 2, 5]))) & (1 << 64) - 1)
    nodes = list(enumerate(sorted(values)))
    parent = list(range(len(nodes)))
    for _ in nodes:
        for i, a in nodes:
            for j, b in nodes:
                if (a ^ b).bit_count() <= 2:
                    parent[i] = parent[j] = min(parent[i], parent[j])
    frame = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in nodes], "node long, fp long")
    for shard in (2, 1000):
        found = {r.node: r.component for r in simhash_bk.components(simhash_bk.near_links(frame, shard=shard)).collect()}
        assert all(found.get(i, i) == parent[i] for i, _ in nodes)


def test_token_counts(docs, none, texts):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    rows = token_counts.count_tokens(docs).collect()
    assert len(rows) == len(texts) + 1
    assert all((r.n_bytes, r.n_tokens) == (len((texts[r.doc_id] or "").encode()), len(library.encode(texts[r.doc_id] or ""))) for r in rows)
    counter = token_counts.PieceCounter(vocabulary_path("piece_bpe_32k.model"))
    assert counter.exact
    for t in ["▁x y ", "  a  b\n\n c\t<s>  ", "ﬁ Ａ é", " \n ", "a \n b", "漢字　😀"]:
        assert counter.count(t) == len(library.encode(t))
    assert token_counts.count_tokens(none).count() == 0


def test_top_k(spark):
    from pyspark.sql import functions as F

    draw = np.random.default_rng(6)
    v = [row.tolist() for row in draw.normal(size=(300, 8)) * 0.3] + [[0.25] * 8] * 40
    rows = [(i, x, 1) for i, x in enumerate(v)] + [(900, None, 1), (950, [1.0, None], 1), (951, [float("nan")], 1), (952, [float("inf")], 1), (None, [1.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(4)
    got = collections.defaultdict(list)
    for r in topk_pivot.exact_top_k(frame, F.col("vec_id") % 10 == 0, k=5, pivots=4).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    whole = np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)
    for q in range(0, 340, 10):
        scores = whole @ whole[q]
        best = [j for j in np.lexsort((np.arange(len(v)), -scores)) if j != q][:5]
        assert sorted(got.pop(q)) == [(n + 1, j, scores[j]) for n, j in enumerate(best)]
    assert not got
    assert topk_pivot.exact_top_k(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_main_text(spark):
    article = "<article><header class=x><h1>Head &amp; more</h1><p>by me</p></header><p>First <b>bold</b>\n text&nbsp;here.<br><p>Unclosed &lt;p&gt; 3 < 4</article>"
    page = ("<html><head><title>t</title><script>var t='</p>';</script></head><body class=no-sidebar><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies</div>"
            + article + "<div id=comments><p>I agree with all of this and that</p></div><form><input><label>Mail</label></form><aside>More</aside><footer>&copy; x</footer>")
    assert html_main.main_text(page) == "Head & more\nFirst bold text here.\nUnclosed <p> 3 < 4"
    long = "It is the way of the world that the men and the women of it are to be with each other and not by themselves for as long as they have been in it. " * 2
    plain = f"<div><a href=1>One</a> <a href=2>Two</a></div><h2>Title</h2><p>{long}</p><p>Short one.</p><p>{long}</p><div><a href=3>Imprint</a></div>"
    assert html_main.main_text(plain) == "\n".join(["Title", long.strip(), "Short one.", long.strip()])
    rows = [(1, None, page, 0), (2, "u", None, 0), (2, "u", "", 0), (None, "v", "<p", 0)]
    got = html_main.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 0, len(html_main.main_text(page))]


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    seen = collections.defaultdict(int)
    for r in rows:
        seen[r.doc_id] += r.length
    assert rows and all(seen[r.doc_id] == r.doc_tokens for r in rows)
