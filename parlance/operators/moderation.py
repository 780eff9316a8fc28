"""Prompt moderation: score thresholds, substring wordlists, anchored regexes.

Rules are a small table (``rule_table``). Its size is checked before use:
regexes, and up to ``EXPR_RULES`` words, become one flat JVM expression (its
depth does not follow the number of rules) with no join; a longer wordlist
switches to an Aho-Corasick automaton built once per Python worker (pandas
UDF) — exact either way.
"""

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K

EXPR_RULES = 512
MAX_RULES = 1_000_000


def rule_table(lines: DataFrame, line: str = "line") -> DataFrame:
    """Wordlist lines -> (kind, pattern). Lines are stripped; ``r/.../`` lines
    are regexes (delimiters removed, case kept); other lines are lower-cased
    literal words; blank lines are dropped."""
    s = F.regexp_replace(F.col(line), r"^\s+|\s+$", "")
    is_re = s.startswith("r/") & s.endswith("/") & (F.length(s) > 3)
    return (lines.withColumn("_s", s)
            .filter(F.length("_s") > 0)
            .withColumn("kind", F.when(is_re, F.lit("regex")).otherwise(F.lit("word")))
            .withColumn("pattern", F.when(is_re, F.substr("_s", F.lit(3), F.length("_s") - 3)).otherwise(F.lower("_s")))
            .drop("_s"))


def literal_rules(rules: DataFrame) -> DataFrame:
    """Distinct literal entries minus the regex entries (as written, ``r/p/``)."""
    words = rules.filter(F.col("kind") == "word").select("pattern").distinct()
    regex_lines = rules.filter(F.col("kind") == "regex").select(F.concat(F.lit("r/"), "pattern", F.lit("/")).alias("pattern"))
    return words.join(regex_lines, on="pattern", how="left_anti")


def moderate_scores(thresholds: dict = K.THRESHOLDS) -> Column:
    """Flag when any score is strictly above its threshold."""
    cond = F.lit(False)
    for name, thr in thresholds.items():
        cond = cond | F.coalesce(F.col(name) > F.lit(thr), F.lit(False))
    return cond


def _ordered_rules(rules: DataFrame, kind: str, order: str = "rule_id") -> list[str]:
    """Collect a rule list after checking its size; first occurrence order."""
    sub = (rules.filter(F.col("kind") == kind).groupBy("pattern").agg(F.min(order).alias("_o")))
    rows = sub.limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} {kind} rules")
    return [r["pattern"] for r in sorted(rows, key=lambda r: r["_o"])]


def word_hit(text, words: list[str]) -> Column:
    """First word (in rule order) that is a substring of lower(text), else null."""
    low = F.lower(text if isinstance(text, Column) else F.col(text))
    if len(words) <= EXPR_RULES:
        rules = F.from_json(F.lit(json.dumps(words)), "array<string>")    # one folded literal
        # the text is bound once, so it is not lower-cased again for every word
        return F.get(F.transform(F.array(low), lambda t: F.get(F.filter(rules, lambda w: t.contains(w)), F.lit(0))), F.lit(0))
    return _ac_first_hit(words)(low)


def _ac_first_hit(words: list[str]):
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    order = {w: i for i, w in enumerate(words)}
    cache = {}

    @pandas_udf("string")
    def first_hit(s: pd.Series) -> pd.Series:
        import ahocorasick
        if "a" not in cache:
            a = ahocorasick.Automaton()
            for w in words:
                a.add_word(w, w)
            a.make_automaton()
            cache["a"] = a
        a = cache["a"]

        def one(t):
            if t is None:
                return None
            best = None
            for _end, w in a.iter(t):
                if best is None or order[w] < order[best]:
                    best = w
            return best
        return s.map(one)
    return first_hit


def regex_hit(text, patterns: list[str]) -> Column:
    """First regex (in rule order) matching at the start of the raw text."""
    t = text if isinstance(text, Column) else F.col(text)
    return F.coalesce(*(F.when(t.rlike("^(?:" + p + ")"), F.lit(p)) for p in patterns), F.lit(None).cast("string"))


def _hits(df: DataFrame, rules: DataFrame, text: str, key: str) -> DataFrame:
    from .rule_index import rule_hits
    return df.join(rule_hits(df, rules, key, text), key)


def moderate_words(df: DataFrame, rules: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """Adds ``word_hit``. With ``key`` (a column that tells rows apart) rules are looked up in
    ``rule_index``, for wordlists of any size; else they are one expression."""
    if key:
        return _hits(df, rules, text, key).drop("regex_hit")
    return df.withColumn("word_hit", word_hit(text, _ordered_rules(rules, "word")))


def moderate_regex(df: DataFrame, rules: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """Adds ``regex_hit``; ``key`` as in ``moderate_words``."""
    if key:
        return _hits(df, rules, text, key).drop("word_hit")
    return df.withColumn("regex_hit", regex_hit(text, _ordered_rules(rules, "regex")))


def moderate(df: DataFrame, rules: DataFrame, text: str = "text", scores: dict | None = K.THRESHOLDS, key: str | None = None) -> DataFrame:
    """Null text is never flagged. Scores first, then regexes, then words;
    adds ``flagged`` and ``reason`` (``score`` / ``regex:<p>`` / ``word:<p>``); ``key`` as in
    ``moderate_words``."""
    t = F.col(text)
    by_score = moderate_scores(scores) if scores else F.lit(False)
    if key:
        df, rh, wh = _hits(df, rules, text, key), F.col("regex_hit"), F.col("word_hit")
    else:
        rh = regex_hit(text, _ordered_rules(rules, "regex"))
        wh = word_hit(text, _ordered_rules(rules, "word"))
    reason = (F.when(t.isNull(), F.lit(None).cast("string"))
              .when(by_score, F.lit("score"))
              .when(rh.isNotNull(), F.concat(F.lit("regex:"), rh))
              .when(wh.isNotNull(), F.concat(F.lit("word:"), wh)))
    out = df.withColumn("reason", reason).withColumn("flagged", F.col("reason").isNotNull())
    return out.drop("word_hit", "regex_hit") if key else out
