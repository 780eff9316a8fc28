"""Column -> Column helpers for prompt and response text. All JVM-side expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _flag(v) -> Column:
    return F.lit(bool(v)) if isinstance(v, bool) else _col(v)


def format_instruction(prompt, input=None, enabled=True, bypass=False) -> Column:
    """Wrap a prompt in the instruction template (with or without an input block).

    Unchanged when templating is off, bypassed, or the prompt already carries an
    input marker.
    """
    p = _col(prompt)
    inp = F.lit(None).cast("string") if input is None else _col(input)
    with_input = F.concat(F.lit(K.PREFIX_INPUT + K.INSTRUCT), p, F.lit(K.INPUT), inp, F.lit(K.ANSWER))
    without = F.concat(F.lit(K.PREFIX_NO_INPUT + K.INSTRUCT), p, F.lit(K.ANSWER))
    templated = F.when(inp.isNull(), without).otherwise(with_input)
    apply = _flag(enabled) & ~_flag(bypass) & ~p.contains(K.INPUT_MARKER)
    return F.when(apply, templated).otherwise(p)


def extract_response(s, marker: str = K.ANSWER) -> Column:
    """Text after the last answer marker; the input unchanged when there is none."""
    return F.substring_index(_col(s), marker, -1)


def strip_echo(output, prompt) -> Column:
    """When the output contains the prompt anywhere, drop the first len(prompt) chars."""
    o, p = _col(output), _col(prompt)
    return F.when(F.instr(o, p) > 0, F.substr(o, F.length(p) + 1, F.greatest(F.length(o), F.lit(1)))).otherwise(o)


def display_prompt(prompt, input=None, template: bool = True, n: int = K.PROMPT_IN_TRUNCATION_LENGTH) -> Column:
    """Prompt as shown to a user: template strings removed; long raw prompts show
    '...' plus their last n characters (the clean-up is then discarded)."""
    p = _col(prompt)
    t = F.replace(p, F.lit(K.EXTRA_MYSTERY_LINE), F.lit(""))
    if template:
        inp = F.lit(None).cast("string") if input is None else _col(input)
        no_in = F.replace(F.replace(F.replace(t, F.lit(K.PREFIX_NO_INPUT), F.lit("")),
                                    F.lit(K.INSTRUCT), F.lit("")), F.lit(K.ANSWER), F.lit(""))
        with_in = F.replace(F.replace(F.replace(F.replace(t, F.lit(K.PREFIX_INPUT), F.lit("")),
                                                F.lit(K.INPUT), F.lit("\n\n")),
                                      F.lit(K.INSTRUCT), F.lit("")), F.lit(K.ANSWER), F.lit(""))
        t = F.when(inp.isNull(), no_in).otherwise(with_in)
    return F.when(F.length(p) > n, F.concat(F.lit("..."), F.right(p, F.lit(n)))).otherwise(t)


def tail_text(s, n: int = K.MESSAGE_MAX_LENGTH - 100) -> Column:
    return F.right(_col(s), F.lit(n))


def drop_last_char(s) -> Column:
    s = _col(s)
    return F.when(F.length(s) > 0, F.substr(s, F.lit(1), F.length(s) - 1)).otherwise(F.lit(""))


def continue_prompt(prompt, output, new=None, template: bool = False, drop_last: bool = True) -> Column:
    """The prompt for one 'continue' step built from the parent's prompt and output.

    Plain: ``prompt + ' ' + output`` and, when new text is given, ``'\\n' + new``.
    Template: the text up to and including the first answer marker, a newline,
    the text after the last marker (minus its final character when
    ``drop_last``), then the templated new text. Without a marker the whole
    text counts as the prompt and the answer is empty.
    """
    text = F.concat(_col(prompt), F.lit(" "), _col(output))
    nw = F.lit(None).cast("string") if new is None else _col(new)
    has_new = nw.isNotNull() & (F.length(nw) > 0)
    if not template:
        return F.when(has_new, F.concat(text, F.lit("\n"), nw)).otherwise(text)
    at = F.locate(K.ANSWER, text)
    head = F.when(at > 0, F.substr(text, F.lit(1), at - 1 + len(K.ANSWER))).otherwise(text)
    answer = F.when(at > 0, F.substring_index(text, K.ANSWER, -1)).otherwise(F.lit(""))
    if drop_last:
        answer = drop_last_char(answer)
    base = F.concat(head, F.lit("\n"), answer)
    templ_new = F.concat(F.lit(K.PREFIX_NO_INPUT + K.INSTRUCT), nw, F.lit(K.ANSWER))
    return F.when(has_new, F.concat(base, F.lit("\n"), templ_new)).otherwise(base)


def completion_link(guild, channel, message) -> Column:
    g = F.coalesce(_col(guild).cast("string"), F.lit("@me"))
    return F.concat_ws("/", F.lit(K.LINK_BASE), g, _col(channel).cast("string"), _col(message).cast("string"))


def short_id(key) -> Column:
    """Deterministic 12-character [a-zA-Z0-9] id: byte i of md5(key) mod 62."""
    h = F.md5(_col(key).cast("string"))
    chars = []
    for i in range(K.ID_LENGTH):
        byte = F.conv(F.substr(h, F.lit(2 * i + 1), F.lit(2)), 16, 10).cast("int")
        chars.append(F.substr(F.lit(K.ID_ALPHABET), byte % 62 + 1, F.lit(1)))
    return F.concat(*chars)


def _stops_literal(stops: Sequence[Sequence[str]]) -> Column:
    return F.array(*[F.array(*[F.lit(t) for t in seq]) for seq in stops])


def _ends_with(arr: Column, seq: Column) -> Column:
    n = F.size(seq)
    return (F.size(arr) >= n) & (F.slice(arr, -n, n) == seq)


def ends_with_seq(arr: Column, seq: Sequence[str]) -> Column:
    return _ends_with(arr, F.array(*[F.lit(t) for t in seq]))


def ends_with_any(arr: Column, stops: Sequence[Sequence[str]]) -> Column:
    return F.exists(_stops_literal(stops), lambda s: _ends_with(arr, s))


def trim_stop(tokens, stops: Sequence[Sequence[str]]) -> Column:
    """For each stop sequence in list order, drop it when the array ends with it
    (so several can be stripped in one pass). One ``aggregate`` over the stop
    list keeps the expression linear in the number of stops."""
    return F.aggregate(_stops_literal(stops), _col(tokens),
                       lambda acc, s: F.when(_ends_with(acc, s), F.slice(acc, 1, F.size(acc) - F.size(s)))
                       .otherwise(acc))


def drop_end_marker(text, marker: str = K.END_MARKER) -> Column:
    t = _col(text)
    return F.when(t.endswith(marker), F.substr(t, F.lit(1), F.length(t) - len(marker))).otherwise(t)


def truncate_context(tokens, n: int = K.MAX_TOKEN_WINDOW) -> Column:
    """Keep the last n tokens."""
    arr = _col(tokens)
    return F.when(F.size(arr) > n, F.slice(arr, F.size(arr) - n + 1, F.lit(n))).otherwise(arr)


def mask_labels(tokens, ignore: int = K.LABEL_IGNORE) -> Column:
    """Labels for a calibration window: every position but the last set to ``ignore``."""
    arr = _col(tokens)
    return F.when(F.size(arr) > 0, F.concat(F.array_repeat(F.lit(ignore), F.size(arr) - 1), F.slice(arr, -1, 1))).otherwise(arr)


def tokenize_ws(text) -> Column:
    """Lower-case whitespace tokenization: split on runs of whitespace, drop empties."""
    return F.filter(F.split(F.lower(_col(text)), r"\s+"), lambda x: x != "")


def cross_entropy(logits, label) -> Column:
    """logsumexp(logits) - logits[label] with a max shift for stability (the max
    is evaluated once per row and handed to the element lambda by zip)."""
    l = _col(logits)
    m = F.array_max(l)
    shifted = F.zip_with(l, F.array_repeat(m, F.size(l)), lambda x, mm: F.exp(x - mm))
    lse = m + F.log(F.aggregate(shifted, F.lit(0.0).cast("double"), lambda acc, e: acc + e))
    return lse - F.element_at(l, _col(label) + 1)
