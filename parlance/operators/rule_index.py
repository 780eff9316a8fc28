"""Moderation by wordlists of any size: a rare-gram index.

Every rule is filed under one gram of up to ``GRAM`` characters that a text must hold for
the rule to hit: the rarest (in a bounded sample of texts) of a word, or of the
longest literal run that a regex requires. Texts give their distinct grams, which
meet the rules in an equi-join, and only the pairs that meet are verified. A regex
without a required literal is filed under the empty gram and verified on every text.
Rules never pass through the driver; a text meets a rule once however often it
holds the gram.
"""

from __future__ import annotations

import re
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .sizing import MAX_BROADCAST_ROWS

GRAM = 5
MAX_TASK_GRAMS = 200_000  # distinct grams that a task holds as a set
GRAM_COST = 10           # finding one string in a text costs less than cutting it at so many characters a gram
SAMPLE = 2_000           # texts that say how rare a gram is; they only decide where a rule is filed


def required_literal(pattern: str) -> str:
    """The longest run of characters that any match of ``pattern`` holds; empty where that
    cannot be told for certain (flags, classes within classes, foreign syntax)."""
    if re.search(r"&&|\[[^\]]*\[|\(\?|\\[QEGXRhHvVN]", pattern.replace("(?:", "(")):
        return ""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            tree = re._parser.parse(pattern)
    except (re.error, OverflowError, RecursionError, Warning):
        return ""
    runs = [""]

    def walk(items) -> None:
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                runs[-1] += chr(arg)
            elif name == "SUBPATTERN":
                walk(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
                runs.append("")
                walk(arg[2])
                runs.append("")
            else:
                runs.append("")

    walk(tree)
    return max(runs, key=len)


def grams(text: Column, size: int) -> Column:
    """The text's distinct runs of ``size`` characters, by a look-ahead at every place. Beside
    characters beyond the basic plane there can be broken ones too, which no rule has."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _all_grams(text: Column, sizes) -> Column:
    """Those of the given sizes, 0 for the empty one."""
    return F.flatten(F.array(*[grams(text, n) if n else F.array(F.lit("")) for n in sorted(sizes)]))


def _filed_grams(kind: Column, seen: Column, filed: dict[str, dict[str, list[str]]]) -> Column:
    """Of the distinct grams of the text, those that ``filed`` has for its kind with a string
    that the text holds: no other gram becomes a row."""
    sizes = {k: {n: {g for g in gs if len(g) == n} for n in {len(g) for g in gs}} for k, gs in filed.items()}

    def held(kinds: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for k, t in zip(kinds, texts, strict=True):
            found: list[str] = []
            for n, gs in sizes.get(k, {}).items():
                many = n and len(gs) * GRAM_COST > len(t)
                for g in gs.intersection([t[i:i + n] for i in range(len(t) - n + 1)]) if many else gs:
                    if any(need in t for need in filed[k][g]):
                        found.append(g)
            out.append(found)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(held, "array<string>")(kind, seen)


def _few(table: DataFrame, need: str) -> dict[str, dict[str, list[str]]] | None:
    """The distinct grams of each kind with the strings ``need`` beside them, None where they
    are too many for a task."""
    rows = table.select("kind", "gram", F.col(need).alias("need")).distinct().limit(MAX_TASK_GRAMS + 1).collect()
    if len(rows) > MAX_TASK_GRAMS:
        return None
    out: dict[str, dict[str, list[str]]] = {}
    for r in rows:
        out.setdefault(r["kind"], {}).setdefault(r["gram"], []).append(r["need"])
    return out


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row a kind of rule: words look at the lower-cased text, regexes at it as it is."""
    return df.filter(F.col(text).isNotNull()).select(
        F.col(key).alias("_id"), F.explode(F.array(F.struct(F.lit("word").alias("kind"), F.lower(text).alias("seen")), F.struct(F.lit("regex").alias("kind"), F.col(text).alias("seen")))).alias("t")
    ).select("_id", "t.kind", "t.seen")


def filed_rules(rules: DataFrame, texts: DataFrame, order: str = "rule_id") -> DataFrame:
    """``kind, pattern, at`` (its first place) and the ``gram`` of every distinct rule."""
    def needs(batches):
        for pdf in batches:
            pdf["need"] = [p if k == "word" else required_literal(p) for k, p in zip(pdf["kind"], pdf["pattern"], strict=True)]
            yield pdf

    each = rules.groupBy("kind", "pattern").agg(F.min(F.col(order)).cast("long").alias("at"))
    needed = checkpointed(each.mapInPandas(needs, "kind string, pattern string, at long, need string"))
    size = F.least(F.length("need"), F.lit(GRAM))
    own = F.when(size == 0, F.array(F.lit("")))
    for n in range(1, GRAM + 1):
        own = own.when(size == n, grams(F.col("need"), n))
    asked = needed.select("kind", "pattern", "at", F.explode(own).alias("gram"))
    sample = texts.orderBy(F.xxhash64("seen"), "_id").limit(SAMPLE)
    filed = _few(asked, "gram")
    held = _all_grams(F.col("seen"), range(GRAM + 1)) if filed is None else _filed_grams(F.col("kind"), F.col("seen"), filed)
    seen = sample.select("kind", F.explode(held).alias("gram")).groupBy("kind", "gram").agg(F.count("*").alias("n"))
    rare = asked.join(seen, ["kind", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return checkpointed(rare.groupBy("kind", "pattern", "at").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram")))


def rule_hits(df: DataFrame, rules: DataFrame, key: str, text: str = "text", order: str = "rule_id") -> DataFrame:
    """``key, word_hit, regex_hit`` of every row: the first word (in rule order) that is a
    substring of the lower-cased text, the first regex that matches at the start of
    the raw text, null without one. ``key`` tells rows apart. Null texts hit nothing."""
    texts = _texts(df, key, text)
    index = filed_rules(rules, texts, order)
    used: dict[str, set[int]] = {"word": set(), "regex": set()}      # gram sizes that a kind of rule is filed under
    for r in index.select("kind", F.length("gram").alias("size")).distinct().collect():
        used[r["kind"]].add(r["size"])
    own = F.array().cast("array<string>")
    for kind, sizes in used.items():
        if sizes:
            own = F.when(F.col("kind") == kind, _all_grams(F.col("seen"), sizes)).otherwise(own)
    hit = (F.when(F.col("kind") == "word", F.contains("seen", "pattern"))
           .otherwise(F.regexp_like("seen", F.concat(F.lit("^(?:"), "pattern", F.lit(")")))))
    if index.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        # verified where the text is read: nothing but hits is shuffled
        filed = _few(index, "pattern")
        if filed is not None:
            filed["regex"] = {g: [required_literal(p) for p in ps] for g, ps in filed.get("regex", {}).items()}
            own = _filed_grams(F.col("kind"), F.col("seen"), filed)
        sure = texts.withColumn("gram", F.explode(own)).join(F.broadcast(index), ["kind", "gram"]).filter(hit)
    else:
        met = texts.select("_id", "kind", F.explode(own).alias("gram")).join(index, ["kind", "gram"]).select("_id", "kind", "pattern", "at")
        sure = met.join(texts, ["_id", "kind"]).filter(hit)
    first = lambda kind: F.min_by("pattern", F.when(F.col("kind") == kind, F.col("at")))
    hits = sure.groupBy("_id").agg(first("word").alias("word_hit"), first("regex").alias("regex_hit"))
    return df.select(F.col(key).alias("_id")).join(hits, "_id", "left").withColumnRenamed("_id", key)
