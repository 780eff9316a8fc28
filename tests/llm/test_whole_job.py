"""Cases in which an operator once did less than its whole job."""
import collections
import math
import random
import zlib

import pytest

from parlance.llm import html_main, katz, simhash_bk


def test_good_turing_with_a_bump_of_copies():
    plain = {1: 215810, 2: 61309, 3: 26017, 4: 14862, 5: 9741, 6: 7222}
    a = 6 * plain[6] / plain[1]
    want = {r: ((r + 1) * plain[r + 1] / (r * plain[r]) - a) / (1 - a) for r in range(1, 6)}
    assert katz.good_turing(plain) == pytest.approx(want)
    for bumped in (plain | {5: 13741}, {1: 1655711, 2: 262472, 3: 56325, 4: 23262, 5: 20048, 6: 8151}, plain | {4: 0}, plain | {3: 40000}):
        d = katz.good_turing(bumped)
        cut = bumped[1] / (bumped[1] + 2 * bumped[2])
        assert list(d) == [1, 2, 3, 4, 5] and all(0 < d[r] < 1 for r in d) and sorted(d.values()) == list(d.values())
        assert any(abs(d[r] - (r - cut) / r) > 0.01 for r in d)               # not absolute discounting
        e = katz._slope({r: m for r, m in bumped.items() if m}) + 1            # Good-Turing where n_r falls as r ** (e - 1)
        assert d == pytest.approx({r: ((1 + 1 / r) ** e - 6 ** e) / (1 - 6 ** e) for r in d})
    law = {r: 1e9 * r ** -2.5 for r in range(1, 7)}
    assert katz._slope(law) == pytest.approx(-2.5, abs=0.2)
    for few in ({}, {1: 3}, {1: 1, 2: 5, 3: 9}):
        assert all(0 < x < 1 for x in katz.good_turing(few).values())


def test_katz_keeps_bigrams_seen_once(spark, monkeypatch, tmp_path):
    from parlance.llm import plans

    draw = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(draw.choices(vocabulary, weights=[1 / (k + 1) for k in range(60)], k=draw.randint(0, 60)))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(katz, "heavy_contexts", lambda d, b: {katz.token_hash(b"w0"): 3})
    got = {r.doc_id: r.score for r in plans.op3_katz(spark, str(tmp_path)).collect()}
    words = {i: [*t.split(), "<e>"] for i, t in rows}
    one, two, context = collections.Counter(), collections.Counter(), collections.Counter()
    for i, w in words.items():
        if zlib.crc32(str(i).encode()) % 10:
            one.update(w)
            context.update(["<s>", *w[:-1]])
            two.update(zip(["<s>", *w[:-1]], w, strict=True))
    d1, d2 = (katz.good_turing(collections.Counter(c.values())) for c in (one, two))
    n, lost = sum(one.values()), sum(c * (1 - d1[c]) for c in one.values() if c in d1)
    whole = n + (lost == 0)
    p1 = {w: d1.get(c, 1) * c / whole for w, c in one.items()}
    unknown = (whole - n + lost) / whole
    mass, covered = collections.Counter(), collections.Counter()
    for (h, w), c in two.items():
        mass[h] += d2.get(c, 1) * c
        covered[h] += p1[w]
    of = {h: context[h] + (m >= context[h] * (1 - 1e-12)) for h, m in mass.items()}

    def p2(h, w):
        if two[h, w]:
            return d2.get(two[h, w], 1) * two[h, w] / of[h]
        return ((1 - mass[h] / of[h]) / (1 - covered[h]) if h in of else 1) * p1.get(w, unknown)

    assert sum(c == 1 for c in two.values()) > 100 and set(got) == set(words)
    for i, w in words.items():
        assert got[i] == pytest.approx(sum(math.log10(p2(h, x)) for h, x in zip(["<s>", *w[:-1]], w, strict=True)), rel=1e-9)


PROSE = {
    "en": "Thnterble the onthing erly of handed inre, thation to erentes shan and oneringly wheth thounder erhaat is thedor.",
    "de": "Enungber die chteein schung der tzstzu, erbenge und verlichkeit zu heitzust einßge nicht stieer enkeit ist ietzst.",
    "fr": "Oumentvi le tionêre ouchment de lareaux, et enleouoi les aieronaux pour érementé queon est mentouvi ouaireier.",
    "es": "Ciónento el mentarue de arociónta, y osllesó que erramente los doñado para ciónllos por queciónte aosuela."}


@pytest.mark.parametrize("lang", PROSE)
def test_main_text_without_article(lang):
    one, menu = PROSE[lang], "<div><a href=1>Aaa bbb</a> <a href=2>Ccc ddd</a></div>"
    two = f"{one} {one}"
    body = f"<div><h2>Xyz</h2><p>{two}</p><p>{one}</p></div>"
    want = "\n".join(["Xyz", two, one])
    assert html_main.main_text(f"<body>{menu}{body}{menu}</body>") == want
    # a teaser that the page marks does not hide the body
    assert html_main.main_text(f"<body>{menu}{body}<article><p>{two}</p></article>{menu}</body>") == f"{want}\n{two}"
    # few stop words: dropped beside the menu, kept in the midst of prose
    names = " ".join(f"Qxw{c}zz" for c in "abcdefghijklmnopqrst")
    assert html_main.main_text(f"<body>{body}<p>{names}</p>{menu}</body>") == want
    assert html_main.main_text(f"<body><p>{two}</p><p>{names}</p><p>{two}</p></body>") == "\n".join([two, names, two])


def test_stages_of_rows_without_an_id_or_of_one_id(spark, tmp_path):
    import corpus_pipeline

    draw = random.Random(4)
    text = lambda n=80: " ".join("".join(draw.choices("abcdefghij", k=5)) for _ in range(n))
    t, item = [text() for _ in range(8)], text(20)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = [(None, t[0]), (None, t[1]), (None, t[1]), (None, t[2]), (3, t[2]), (5, t[3]), (5, t[4]), (5, t[4]), (6, t[5]), (9, t[5]), (None, ""), (None, None)]
    frame = spark.createDataFrame([(i, x, "en", "web", len(x or "")) for i, x in docs], schema).repartition(3)
    got = corpus_pipeline.near_duplicate_stage(spark, frame, "").collect()
    first = lambda r: (r[0] or 0, r[1] or "")
    got = sorted(((r.doc_id, r.text) for r in got), key=first)
    assert got[0] in [(None, ""), (None, None)]
    assert got[1:] == sorted([(None, t[0]), (None, t[1]), (3, t[2]), (5, t[3]), (5, t[4]), (6, t[5])], key=first)
    spark.createDataFrame([(None, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(None, t[0]), (None, f"{t[1]} {item}"), (5, t[2]), (5, f"{t[3]} {item}"), (6, None)]
    frame = spark.createDataFrame([(i, x, "en", "web", 0) for i, x in docs], schema)
    got = corpus_pipeline.decontamination_stage(spark, frame, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=first) == sorted([(None, t[0]), (5, t[2]), (6, None)], key=first)


def test_rows_without_an_id_bridge(spark):
    draw = random.Random(2)
    base = ["".join(draw.choices("abcdefghij", k=5)) for _ in range(400)]
    found = {}
    for _ in range(400):
        w = list(base)
        for _ in range(3):
            w[draw.randrange(400)] = "zzz" + draw.choice("abcdef")
        found[simhash_bk.simhash([x.encode() for x in w])] = " ".join(w)
    near = lambda a, b: (a ^ b).bit_count() <= 2
    a, m, b = next((a, m, b) for m in found for a in found for b in found if a != m != b and near(a, m) and near(m, b) and not near(a, b))
    rows = [(8, found[a]), (None, found[m]), (4, found[b])]
    got = simhash_bk.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.component_id for r in got] == [4, 4, 4]
