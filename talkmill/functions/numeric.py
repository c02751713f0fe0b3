"""Number, time and vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(value: Column, digits: int = 0) -> Column:
    """Round halves towards plus infinity."""
    scale = F.lit(float(10**digits))
    return F.floor(value * scale + F.lit(0.5)).cast("double") / scale


def clamp01(value: Column) -> Column:
    return F.when(value.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def session_time(started: str = "started_at", created: str = "created_at") -> Column:
    return F.coalesce(F.col(started), F.col(created))


def days_between_truncated(later: Column, earlier: Column) -> Column:
    """Whole days between two instants, cut towards zero."""
    day = F.lit(86_400_000_000)
    return ((F.unix_micros(later) - F.unix_micros(earlier)) / day).cast("int")


def days_between_floored(later: Column, earlier: Column) -> Column:
    day = F.lit(86_400_000)
    return F.floor((F.unix_millis(later) - F.unix_millis(earlier)) / day).cast("int")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two word sets: 1 when both are empty, 0 when one is."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / F.when(union != 0, union))


def interval_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap over union of two time spans in milliseconds; reversed spans are turned round."""
    lo_a, hi_a = F.least(a0, a1), F.greatest(a0, a1)
    lo_b, hi_b = F.least(b0, b1), F.greatest(b0, b1)
    overlap = F.greatest(F.lit(0), F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b))
    union = F.greatest(hi_a, hi_b) - F.least(lo_a, lo_b)
    return F.when(union <= 0, F.lit(1.0)).otherwise(overlap / F.when(union > 0, union))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for unequal or zero length, and for a zero norm."""
    zero = F.lit(0.0)

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), zero, lambda acc, v: acc + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(usable & (norm != 0), dot(a, b) / F.when(norm != 0, norm)).otherwise(zero)
