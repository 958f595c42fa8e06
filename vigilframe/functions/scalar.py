"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilframe.config import LABELS, RAMP_BOUNDS


def clamp01(x: Column) -> Column:
    """Clamp to [0, 1]; null counts as 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x.cast("double"), F.lit(0.0))))


def or_default(x: Column, default) -> Column:
    """Null and zero both give the default."""
    return F.when(x.isNull() | (x == 0), F.lit(default)).otherwise(x)


def ramp(x: Column, low: float, high: float) -> Column:
    """Linear 0..1 between two bounds; works downwards when high < low."""
    return clamp01((x - F.lit(low)) / F.lit(high - low))


def named_ramp(x: Column, name: str) -> Column:
    low, high = RAMP_BOUNDS[name]
    return ramp(x, low, high)


def parse_event_time(text: Column) -> Column:
    """ISO time with Z, offset or neither (session zone) as a timestamp; null if unreadable."""
    return F.try_to_timestamp(text)


def risk_rank(risk: Column) -> Column:
    """LOW, MEDIUM, HIGH as 0, 1, 2; anything else 0."""
    return F.coalesce(map_risk(risk), F.lit(0))


def map_risk(risk: Column) -> Column:
    """LOW, MEDIUM, HIGH as 0, 1, 2; anything else null."""
    return F.when(risk == "LOW", 0).when(risk == "MEDIUM", 1).when(risk == "HIGH", 2)


def label_to_int(label: Column) -> Column:
    """1 for MEDIUM in any case and padding, else 0."""
    return F.when(F.trim(F.upper(label)) == "MEDIUM", 1).otherwise(0)


def safe_label(label: Column) -> Column:
    text = F.trim(F.upper(label.cast("string")))
    return F.when(text.isin(*LABELS), text).otherwise(F.lit("LOW"))


def fixed(x: Column, digits: int) -> Column:
    """A number with a fixed count of decimals, as text."""
    return F.format_string(f"%.{digits}f", F.coalesce(x.cast("double"), F.lit(0.0)))


def percent(x: Column) -> Column:
    return F.concat(fixed(100.0 * F.coalesce(x, F.lit(0.0)), 0), F.lit("%"))


def format_duration(seconds: Column) -> Column:
    """h:mm:ss, or m:ss below an hour; a dash for nothing."""
    s = seconds.cast("double")
    whole = F.floor(s)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    h, m, sec = F.floor(whole / 3600), F.floor((whole % 3600) / 60), whole % 60
    nothing = s.isNull() | F.isnan(s) | (s <= 0) | (s == float("inf"))
    return (
        F.when(nothing, F.lit("—"))
        .when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(sec)))
        .otherwise(F.concat_ws(":", m.cast("string"), two(sec)))
    )


def paste_size_category(length: Column) -> Column:
    n = length.cast("double")
    return (
        F.when(n.isNull() | F.isnan(n) | (n <= 0) | (n == float("inf")), "unknown")
        .when(n <= 20, "small")
        .when(n <= 120, "medium")
        .otherwise("large")
    )


def filled(*choices) -> Column:
    """First choice that is neither null nor empty; plain strings are literals."""
    columns = [F.lit(c) if isinstance(c, str) else F.nullif(c, F.lit("")) for c in choices]
    return F.coalesce(*columns)
