"""Alignment of two tokenizers against a byte-by-byte brute force."""
import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from parlance.llm import align
from parlance.llm.common import vocabulary_path

A, B = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = ["Plain words, and\nlines.\n\n\n end ", " lead  two", "trail  \n", "\n\n", "   ", "<|endoftext|> <s> x </s>", "▁mark", "tab\tx \t y\n\t", "emoji 😀 漢字 ﬁ é Ñandú",
         "\x00a b　c\r\nq y", "aaaaaaaaaaaaaaa " * 9, "xyzzy" * 60 + " q", "it's we'll 12345 9² ...", "", None, "Plain words, and\nlines.\n\n\n end "]


def slow(rows):
    """Token bytes and overlaps straight from the definition."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(A)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=B)
    back = {c: i for i, c in enumerate(align._byte_symbols())}
    a_of = lambda i: bytes(back[c] for c in a_tok.id_to_token(i))

    def b_of(i):
        p = b_tok.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode()

    found, total = [], collections.Counter()
    for doc_id, text in rows:
        a, b = (a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)) if text else ([], [])
        want = (" " + (text or "")).encode()
        if not text or b"".join(map(a_of, a)) != want or b"".join(map(b_of, b)) != want:
            found.append((doc_id, 0, 0, [], []))
            continue
        spans = []
        for ids, of in ((a, a_of), (b, b_of)):
            at, mine = 0, []
            for i in ids:
                mine.append((at, at + len(of(i)), i))
                at += len(of(i))
            spans.append(mine)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, begin = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for s, e, i in side if begin <= s and e <= end) for side in spans))
            begin = end
        links = [(i, j) for s, e, i in spans[0] for t, f, j in spans[1] if s < f and t < e]
        total.update(links)
        found.append((doc_id, len(a), len(b), groups, links))
    best = collections.Counter()
    for (_, j), n in total.items():
        best[j] = max(best[j], n)
    return sorted(((d, na, nb, len(g), len(ls), sum(total[x] == best[x[1]] for x in ls), sum(total[x] for x in ls),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, na, nb, g, ls in found), key=str)


@pytest.mark.parametrize("common", [align.COMMON, 3, 0])
def test_against_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(align, "COMMON", common)
    monkeypatch.setattr(align, "TALLY", 5)
    draw = random.Random(4)
    letters = "abcdeé \n"
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "some words"), (3, "other words"), (3, "other words")]
    rows += [(100 + i, "".join(draw.choices(letters, k=draw.randint(0, 60)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"row": F.lit("x"), "pairs": F.lit(1), "n_a": F.lit(2)})
    got = align.alignment_report(df, A, B).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == slow(rows)


def test_empty_table(spark):
    assert align.alignment_report(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_identity_map_prefers_written_pieces():
    b = [b"", b"", b"", *(bytes([i]) for i in range(256)), b"a", b"ab", b"ab"]
    assert align.identity_map([b"a", b"ab", b"\x00", b"zz", b""], b) == [259, 260, 3, -1, -1]


def test_very_long_text(spark):
    """A megabyte in one row, with one word of 40,000 characters."""
    text = "some words and others\n" * 45_000 + "q" * 40_000
    row = align.alignment_report(spark.createDataFrame([(1, text)], "doc_id long, text string"), A, B).first()
    aligner = align._aligner(A, B)
    want = aligner.ids(aligner._a_ids(" " + text), aligner.b.library.encode(text), (" " + text).encode())
    assert (row.n_a, row.n_b, row.n_groups) == want[:3] and row.groups_sha256 == hashlib.sha256(want[5].encode()).hexdigest()
