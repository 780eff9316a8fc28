"""Request validation and admission gates (stateless, one projection each)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K

BOUNDS = {
    "max_tokens": (K.MAX_TOKENS_MIN, K.MAX_TOKENS_MAX),
    "temperature": (K.TEMPERATURE_MIN, K.TEMPERATURE_MAX),
    "top_p": (K.TOP_P_MIN, K.TOP_P_MAX),
}
DEFAULTS = {"max_tokens": K.DEFAULT_MAX_TOKENS, "temperature": K.DEFAULT_TEMPERATURE, "top_p": K.DEFAULT_TOP_P}
US_PER_HOUR = 3600 * 1_000_000


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def validate_request(df: DataFrame, bounds: dict = BOUNDS, defaults: dict = DEFAULTS) -> DataFrame:
    """Fill defaults for null parameters, then check inclusive bounds in order.

    Adds ``valid`` and ``reason`` (the first parameter out of range, else null)."""
    for name, dv in defaults.items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(dv).cast(dict(df.dtypes)[name])))
    reason = F.lit(None).cast("string")
    for name in reversed(list(bounds)):
        lo, hi = bounds[name]
        reason = F.when(~F.col(name).between(lo, hi), F.lit(name)).otherwise(reason)
    return df.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def gate_channel(channel, allowed) -> Column:
    """Pass when there is no restriction or the request is in the allowed channel."""
    a = F.lit(None) if allowed is None else (F.lit(allowed) if isinstance(allowed, (str, int)) else _col(allowed))
    return a.isNull() | (_col(channel) == a)


def gate_instruction_input(input, enabled) -> Column:
    """Reject an instruction input when template mode is off."""
    en = F.lit(bool(enabled)) if isinstance(enabled, bool) else _col(enabled)
    return _col(input).isNull() | en


def tenure_hours(joined_us, now_us) -> Column:
    """Whole hours held: ``int(seconds) // 3600``."""
    return F.floor(F.floor((_col(now_us) - _col(joined_us)) / 1_000_000) / 3600).cast("bigint")


def gate_tenure(joined_us, now_us, hours) -> Column:
    """Pass when ``now - joined_at >= hours`` (0 or null hours disables the gate;
    hours may be fractional)."""
    h = F.lit(hours) if hours is None or isinstance(hours, (int, float)) else _col(hours)
    off = h.isNull() | (h == 0)
    return off | ((_col(now_us) - _col(joined_us)) >= h.cast("double") * US_PER_HOUR)


def gate_chain(df: DataFrame, gates: Sequence[tuple[str, Column]]) -> DataFrame:
    """First failing gate wins: adds ``admitted`` and ``reason``."""
    reason = F.lit(None).cast("string")
    for name, ok in reversed(list(gates)):
        reason = F.when(~ok, F.lit(name)).otherwise(reason)
    return df.withColumn("reason", reason).withColumn("admitted", F.col("reason").isNull())


def restore_views(views: DataFrame, now, horizon_s: int, known_labels: Sequence[str]):
    """Views to reload after a restart: those with ``time >= now - horizon``
    whose item labels are all known. Returns (kept, skipped); skipped rows are
    in the horizon but carry an unknown label or no items, or have no time."""
    now_c = F.lit(now) if isinstance(now, int) else now
    recent = views.filter(F.col("time").isNull() | (F.col("time") >= now_c - F.lit(horizon_s)))
    known = F.array(*[F.lit(x) for x in known_labels])
    ok = F.coalesce(F.forall("items", lambda it: F.array_contains(known, it["label"])), F.lit(False)) & F.col("time").isNotNull()
    return recent.filter(ok), recent.filter(~ok)
