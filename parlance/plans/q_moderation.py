"""Moderation queries: rule tables from wordlist lines, scores, words, regexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import moderation as M
from ..operators import rule_index as RI
from . import fixtures as X
from .registry import query, with_ctes

# Test wordlist lines (fixture input, not reference values): the ten lexicon
# words, a repeat, upper/mixed case with padding, blank lines, three
# start-anchored regexes and an upper-case 'R/' line that stays literal.
WORDLIST_LINES = ["trash", "clown", "idiot", "scum", "worthless", "moron", "pathetic", "loser", "disgusting",
                  "stupid", "idiot", "  STUPID ", "Moron\t", "", "   ", "r/Thi/", "r/(?:En|In) /", "r/[A-Z]ió/",
                  "R/Und/"]


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\t", "' || chr(9) || '") + "'"


CTE_LINES = ("fx_lines", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {_sql_lit(s)})" for i, s in enumerate(WORDLIST_LINES)) + ") t(rule_id, line)")

_RULE_SQL = r"""
SELECT *, CASE WHEN is_re THEN 'regex' ELSE 'word' END AS kind,
       CASE WHEN is_re THEN substr(s, 3, length(s) - 3) ELSE lower(s) END AS pattern
FROM (SELECT *, starts_with(s, 'r/') AND suffix(s, '/') AND length(s) > 3 AS is_re
      FROM (SELECT *, regexp_replace(line, '^\s+|\s+\z', '', 'g') AS s FROM {src}))
WHERE length(s) > 0"""

CTE_RULES = ("fx_rules", _RULE_SQL.format(src="fx_lines"))


def fx_lines(spark):
    return spark.createDataFrame(list(enumerate(WORDLIST_LINES)), "rule_id int, line string")


def fx_rules(spark):
    return M.rule_table(fx_lines(spark))


def _all_lines(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents")
    doc_lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    fix = fx_lines(spark).select(F.lit(-1).cast("bigint").alias("doc_id"), F.col("rule_id").alias("line_no"), "line")
    return fix.unionByName(doc_lines)


CTE_ALL_LINES = ("all_lines", """
SELECT CAST(-1 AS BIGINT) AS doc_id, rule_id AS line_no, line FROM fx_lines
UNION ALL
SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS line_no, unnest(parts) AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)""")


@query("rule_table", with_ctes(CTE_LINES, CTE_ALL_LINES, ("all_rules", _RULE_SQL.format(src="all_lines"))) + """
SELECT doc_id, line_no, kind, pattern FROM all_rules""")
def q_rule_table(spark, sf_dir):
    return M.rule_table(_all_lines(spark, sf_dir)).select("doc_id", "line_no", "kind", "pattern")


@query("literal_rules", with_ctes(CTE_LINES, CTE_ALL_LINES, ("all_rules", _RULE_SQL.format(src="all_lines"))) + """
SELECT DISTINCT pattern FROM all_rules WHERE kind = 'word'
  AND pattern NOT IN (SELECT 'r/' || pattern || '/' FROM all_rules WHERE kind = 'regex')""")
def q_literal_rules(spark, sf_dir):
    return M.literal_rules(M.rule_table(_all_lines(spark, sf_dir)))


def fx_scores(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = X.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    j = d.join(lab, on="doc_id", how="left")
    did = F.col("doc_id")
    return j.select("doc_id", "text",
                    ((did % 100).cast("double") / 900.0).alias("sexual_explicit"),
                    (((did * 7) % 100).cast("double") / 190.0).alias("obscene"),
                    F.when(F.col("toxic") == 1, F.lit(0.9)).otherwise(F.lit(0.1)).alias("toxicity"),
                    (((did * 13) % 100).cast("double") / 190.0).alias("severe_toxicity"),
                    (((did * 29) % 100).cast("double") / 180.0).alias("identity_attack"))


CTE_SCORES = ("fx_scores", """
SELECT d.doc_id, d.text,
       CAST(d.doc_id % 100 AS DOUBLE) / 900.0 AS sexual_explicit,
       CAST((d.doc_id * 7) % 100 AS DOUBLE) / 190.0 AS obscene,
       CASE WHEN l.toxic = 1 THEN 0.9 ELSE 0.1 END::DOUBLE AS toxicity,
       CAST((d.doc_id * 13) % 100 AS DOUBLE) / 190.0 AS severe_toxicity,
       CAST((d.doc_id * 29) % 100 AS DOUBLE) / 180.0 AS identity_attack
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")

_SCORE_FLAG = ("(sexual_explicit > 0.1 OR obscene > 0.5 OR toxicity > 0.8 OR severe_toxicity > 0.5 "
               "OR identity_attack > 0.5)")


@query("moderate_scores", with_ctes(CTE_SCORES) + f"""
SELECT doc_id, COALESCE({_SCORE_FLAG}, false) AS flagged FROM fx_scores""")
def q_moderate_scores(spark, sf_dir):
    return fx_scores(spark, sf_dir).select("doc_id", M.moderate_scores(K.THRESHOLDS).alias("flagged"))


_WORDS = ("w_rules", "SELECT pattern, min(rule_id) AS o FROM fx_rules WHERE kind = 'word' GROUP BY pattern")
_REGEX = ("r_rules", "SELECT pattern, min(rule_id) AS o FROM fx_rules WHERE kind = 'regex' GROUP BY pattern")
_WORD_HITS = ("word_hits", """
SELECT d.doc_id, arg_min(w.pattern, w.o) AS word_hit
FROM documents d LEFT JOIN w_rules w ON contains(lower(d.text), w.pattern) GROUP BY d.doc_id""")
_REGEX_HITS = ("regex_hits", """
SELECT d.doc_id, arg_min(r.pattern, r.o) AS regex_hit
FROM documents d LEFT JOIN r_rules r ON regexp_matches(d.text, '^(?:' || r.pattern || ')') GROUP BY d.doc_id""")


@query("moderate_words", with_ctes(CTE_LINES, CTE_RULES, _WORDS, _WORD_HITS) + """
SELECT doc_id, word_hit FROM word_hits""")
def q_moderate_words(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select("doc_id", "text")
    return M.moderate_words(d, fx_rules(spark), "text").select("doc_id", "word_hit")


@query("moderate_regex", with_ctes(CTE_LINES, CTE_RULES, _REGEX, _REGEX_HITS) + """
SELECT doc_id, regex_hit FROM regex_hits""")
def q_moderate_regex(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select("doc_id", "text")
    return M.moderate_regex(d, fx_rules(spark), "text").select("doc_id", "regex_hit")


@query("moderate", with_ctes(CTE_LINES, CTE_RULES, _WORDS, _REGEX, _WORD_HITS, _REGEX_HITS, CTE_SCORES) + f"""
SELECT s.doc_id, reason, reason IS NOT NULL AS flagged FROM (
  SELECT s.doc_id, CASE WHEN s.text IS NULL THEN NULL WHEN COALESCE({_SCORE_FLAG}, false) THEN 'score'
                        WHEN r.regex_hit IS NOT NULL THEN 'regex:' || r.regex_hit
                        WHEN w.word_hit IS NOT NULL THEN 'word:' || w.word_hit END AS reason
  FROM fx_scores s JOIN word_hits w ON w.doc_id = s.doc_id JOIN regex_hits r ON r.doc_id = s.doc_id) s""")
def q_moderate(spark, sf_dir):
    return M.moderate(fx_scores(spark, sf_dir), fx_rules(spark), "text").select("doc_id", "reason", "flagged")


# ------------------------------------------------------------------ a wordlist of real size

# every long word of the benchmark, and for each of its items a regex: the first word,
# any one word, the third word
_BIG_LINES = r"""
SELECT item_id * 1000 + pos AS rule_id, 'word' AS kind, lower(w) AS pattern FROM (
  SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]{7,}') AS ws FROM benchmark))
UNION ALL
SELECT item_id * 1000 AS rule_id, 'regex' AS kind, ws[1] || ' \S+ ' || ws[3] || '( |,)' AS pattern
FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM benchmark) WHERE len(ws) >= 3"""


def fx_big_rules(spark, sf_dir):
    items = X.table(spark, sf_dir, "benchmark")
    long = items.select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit("([A-Za-z]{7,})"), 1)).alias("pos", "w"))
    ws = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)
    regexes = items.select("item_id", ws.alias("ws")).filter(F.size("ws") >= 3)
    return (long.select((F.col("item_id") * 1000 + F.col("pos") + 1).alias("rule_id"), F.lit("word").alias("kind"), F.lower("w").alias("pattern"))
            .unionByName(regexes.select((F.col("item_id") * 1000).alias("rule_id"), F.lit("regex").alias("kind"),
                                        F.concat(F.get("ws", F.lit(0)), F.lit(" \\S+ "), F.get("ws", F.lit(2)), F.lit("( |,)")).alias("pattern"))))


@query("moderate_index", with_ctes(("big", _BIG_LINES), ("big_rules", "SELECT kind, pattern, min(rule_id) AS o FROM big GROUP BY kind, pattern")) + """
SELECT d.doc_id, arg_min(r.pattern, r.o) FILTER (WHERE r.kind = 'word') AS word_hit, arg_min(r.pattern, r.o) FILTER (WHERE r.kind = 'regex') AS regex_hit
FROM documents d LEFT JOIN big_rules r ON CASE WHEN r.kind = 'word' THEN contains(lower(d.text), r.pattern) ELSE regexp_matches(d.text, '^(?:' || r.pattern || ')') END
GROUP BY d.doc_id""")
def q_moderate_index(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents").select("doc_id", "text")
    return RI.rule_hits(docs, fx_big_rules(spark, sf_dir), "doc_id").select("doc_id", "word_hit", "regex_hit")
