"""Conversation threads: parents, continuations, whole-thread prompts, retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import strip_echo
from ..session import checkpointed


def attach_parent(df: DataFrame, key: str = "uid", sid: str = "short_id", parent: str = "short_id_parent",
                  fields=("prompt", "output", "max_tokens", "temperature", "top_p")):
    """Join each continuation to its parent record on (uid, parent id).

    Returns (joined, orphans): joined carries ``parent_<field>`` columns;
    orphans are continuations whose parent is missing (left anti)."""
    par = df.select(F.col(key), F.col(sid).alias(parent), *[F.col(f).alias(f"parent_{f}") for f in fields])
    children = df.filter(F.col(parent).isNotNull())
    return children.join(par, on=[key, parent], how="inner"), children.join(par, on=[key, parent], how="left_anti")


def _template_context(prompt, prev_out, root_prompt, drop_last: bool):
    """A turn's templated prompt: the thread's text up to its first answer marker, the
    previous answer and the newly templated instruction; a first turn's own template."""
    from ..functions.text import drop_last_char, format_instruction
    first_t = format_instruction(root_prompt, None, True, False)
    at = F.locate(K.ANSWER, first_t)
    head = F.when(at > 0, F.substr(first_t, F.lit(1), at - 1 + len(K.ANSWER))).otherwise(first_t)
    ans = F.substring_index(F.concat(F.lit(" "), prev_out), K.ANSWER, -1)
    ans = drop_last_char(ans) if drop_last else ans
    templ_new = F.concat(F.lit(K.PREFIX_NO_INPUT + K.INSTRUCT), prompt, F.lit(K.ANSWER))
    base = F.concat(head, F.lit("\n"), ans)
    cont = F.when(prompt.isNotNull() & (F.length(prompt) > 0), F.concat(base, F.lit("\n"), templ_new)).otherwise(base)
    return F.when(prev_out.isNull(), format_instruction(prompt, None, True, False)).otherwise(cont)


def _climb(nodes: DataFrame, key: str, carried: dict, rounds: int) -> DataFrame:
    """Ancestor doubling: ``key, node, up`` and what ``carried`` names, taken from each node
    (with ``up`` its parent) to as far as its ancestors reach, at most 2 ** rounds up.
    ``carried`` maps a column to how the upper part's value joins the lower one's."""
    now = checkpointed(nodes)
    for _ in range(rounds):
        open_ones = now.filter(F.col("up").isNotNull())
        if open_ones.isEmpty():
            break
        upper = now.select(key, F.col("node").alias("up"), F.col("up").alias("_up"), *[F.col(c).alias(f"_{c}") for c in carried])
        met = open_ones.join(upper, [key, "up"]).select(key, "node", F.col("_up").alias("up"), *[fn(F.col(f"_{c}"), F.col(c)).alias(c) for c, fn in carried.items()])
        now = checkpointed(now.filter(F.col("up").isNull()).unionByName(met))
    return now


def thread_forest(turns: DataFrame, key: str = "uid", sid: str = "short_id", parent: str = "short_id_parent",
                  template: bool = False, drop_last: bool = True) -> DataFrame:
    """Full prompt at every turn of branching threads, along the path of stored parents:
    the fold of ``continue_prompt`` over a turn's ancestors, using echo-stripped outputs.

    Roots are rows without a parent. Adds ``depth`` (turns before this one), ``orphan``
    and ``context``. A turn whose path ends at a parent that is missing, or that runs
    in a circle, is an orphan: reported with null ``depth`` and ``context``. (key, sid)
    must tell turns apart. Paths of any length are folded in log2(length) joins; the
    ids are resolved first, so texts are only joined along paths that end at a root.
    """
    stripped = turns.select(key, F.col(sid).alias(parent), strip_echo("output", "prompt").alias("_po"), F.lit(True).alias("_has"))
    rows = checkpointed(turns.join(stripped, [key, parent], "left").withColumn("_has", F.coalesce("_has", F.lit(False))))
    lost = F.col(parent).isNotNull() & ~F.col("_has")
    count = max(2, rows.count())
    ids = rows.select(key, F.col(sid).alias("node"), F.when(F.col("_has"), F.col(parent)).alias("up"),
                      F.when(F.col("_has"), 1).otherwise(0).cast("long").alias("depth"),
                      F.when(~F.col("_has"), F.col(sid)).alias("root"), F.when(~F.col("_has"), lost).alias("lost"))
    upper = lambda up, own: up
    ends = _climb(ids, key, {"depth": lambda up, own: up + own, "root": upper, "lost": upper}, count.bit_length())
    fate = ends.select(key, F.col("node").alias(sid), F.when(F.col("up").isNull() & ~F.col("lost"), F.col("depth")).alias("depth"),
                       (F.col("up").isNotNull() | F.col("lost")).alias("orphan"), F.col("root").alias("_root"))
    rows = rows.join(fate, [key, sid])
    if template:
        roots = rows.filter("depth = 0").select(key, F.col(sid).alias("_root"), F.col("prompt").alias("_first"))
        context = F.when(~F.col("orphan"), _template_context(F.col("prompt"), F.col("_po"), F.col("_first"), drop_last))
        return rows.join(roots, [key, "_root"], "left").select(*turns.columns, "depth", "orphan", context.alias("context"))
    piece = F.when(F.col("_po").isNull(), F.col("prompt")).otherwise(F.concat(F.lit(" "), "_po", F.lit("\n"), "prompt"))
    good = rows.filter(~F.col("orphan")).select(key, F.col(sid).alias("node"), F.when(F.col("depth") > 0, F.col(parent)).alias("up"), piece.alias("text"))
    texts = _climb(good, key, {"text": lambda up, own: F.concat(up, own)}, count.bit_length())
    return (rows.join(texts.select(key, F.col("node").alias(sid), F.col("text").alias("context")), [key, sid], "left")
            .select(*turns.columns, "depth", "orphan", "context"))


def thread_context(pairs: DataFrame, key: str = "uid", order: str = "turn", template: bool = False,
                   drop_last: bool = True) -> DataFrame:
    """Full prompt at every turn of a thread: the fold of ``continue_prompt``
    over the ancestors, using echo-stripped outputs.

    Plain: ``p0 + ' ' + o0 + '\n' + p1 + ... + pk`` (ordered collect over the
    running frame). Template: every templated prompt ends with the answer
    marker, so the fold keeps the text up to the thread's first marker, the
    previous answer (after its last marker, minus the final character) and the
    newly templated instruction — a closed form needing only ``first`` and
    ``lag``. One window pass per thread (threads are bounded by their turns).
    """
    w = Window.partitionBy(key).orderBy(order)
    prev_out = F.lag(strip_echo("output", "prompt")).over(w)
    if template:
        first = F.first("prompt").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return pairs.withColumn("context", _template_context(F.col("prompt"), prev_out, first, drop_last))
    piece = F.when(prev_out.isNull(), F.col("prompt")).otherwise(F.concat(F.lit(" "), prev_out, F.lit("\n"), F.col("prompt")))
    acc = F.collect_list(F.struct(F.col(order).alias("o"), F.col("_piece").alias("p"))).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (pairs.withColumn("_piece", piece)
            .withColumn("context", F.array_join(F.transform(F.array_sort(acc), lambda x: x["p"]), ""))
            .drop("_piece"))


def first_valid_attempt(attempts: DataFrame, keys=("uid", "short_id"), attempt: str = "attempt",
                        output: str = "output", prompt: str = "prompt", max_tries: int = K.MAX_ATTEMPTS,
                        fallback: str = K.FALLBACK_ANSWER) -> DataFrame:
    """First attempt (<= max_tries) whose output differs from the prompt, else
    the fallback answer. A grouped min_by: partial aggregation, no sort."""
    valid = (F.col(attempt) <= max_tries) & (F.col(output) != F.col(prompt))
    ordk = F.when(valid, F.col(attempt))
    return (attempts.groupBy(*keys)
            .agg(F.min_by(F.col(output), ordk).alias("_ans"), F.min(ordk).alias("chosen_attempt"))
            .withColumn("answer", F.coalesce(F.col("_ans"), F.lit(fallback)))
            .drop("_ans"))
