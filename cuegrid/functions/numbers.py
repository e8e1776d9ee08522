"""Column functions on numbers: rounding, length fit, levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(x: Column) -> Column:
    """To the nearest whole number, halves upwards."""
    return F.floor(x + F.lit(0.5))


def places(x: Column, n: int) -> Column:
    """To n decimal places, halves upwards."""
    return F.floor(x * F.lit(float(10**n)) + F.lit(0.5)) / F.lit(float(10**n))


def speech_seconds(chars: Column, rate: float, overhead: float = 0.0) -> Column:
    """Estimated seconds to speak so many characters."""
    return F.lit(float(overhead)) + chars / F.lit(float(rate))


def target_chars(slot: Column, rate: float, tolerance: float = 0.0, overhead: float = 0.0) -> Column:
    """Characters that fit a slot, at least one."""
    return F.greatest(F.lit(1), whole(F.greatest(F.lit(0.0), slot - F.lit(float(overhead))) * F.lit(float(rate)) * F.lit(1.0 + tolerance)))


def bounded_target_chars(source_chars: Column, slot: Column, rate: float, cap: float, overhead: float = 0.0) -> Column:
    """target_chars, but not beyond cap times the source's length (8 at least)."""
    return F.least(target_chars(slot, rate, 0.0, overhead), F.greatest(F.lit(8), whole(source_chars * F.lit(float(cap)))))


def shorten_target_chars(slot: Column, rate: float, most_tempo: float, overhead: float = 0.0) -> Column:
    """Characters that fit a slot at the greatest tempo, at least four."""
    return F.greatest(F.lit(4), whole(F.greatest(F.lit(0.0), slot * F.lit(float(most_tempo)) - F.lit(float(overhead))) * F.lit(float(rate))))


def within_length(seconds: Column, slot: Column, tolerance: float, floor: float = 0.0) -> Column:
    return F.abs(seconds - slot) <= F.greatest(slot * F.lit(float(tolerance)), F.lit(float(floor)))


def length_ratio(seconds: Column, slot: Column) -> Column:
    return F.when(slot > 0, seconds / slot).otherwise(F.lit(float("inf")))


def miss_by(seconds: Column, slot: Column, tolerance: float, floor: float = 0.0) -> Column:
    """0 within the tolerance, else the excess in seconds, or a third of the shortfall."""
    excess = seconds - slot
    return F.when(within_length(seconds, slot, tolerance, floor), 0.0).when(excess > 0, excess).otherwise(-excess * F.lit(1 / 3))


def fits_length(got: Column, wanted: Column) -> Column:
    return got <= wanted + F.greatest(F.lit(0.3), wanted * 0.1)


def db_to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def usable_rate(rate: Column) -> Column:
    """A finite speech rate of 5 to 30 characters a second."""
    return F.coalesce(~F.isnan(rate) & rate.between(5, 30), F.lit(False))


def atempo_chain(tempo: Column) -> Column:
    """A tempo as steps within 0.5 and 2, whose product it is."""
    steps = F.greatest(F.lit(1), F.ceil(F.abs(F.log2(tempo)) - F.lit(1e-9))).cast("int")
    limit = F.when(tempo > 1, F.lit(2.0)).otherwise(F.lit(0.5))
    return F.transform(F.sequence(F.lit(1), steps), lambda i: F.when(i < steps, limit).otherwise(tempo / F.pow(limit, steps - 1)))


def intake_verdict(container: Column, extracted: Column) -> Column:
    """Whether enough of a recording's sound was extracted."""
    missing = container - extracted
    ok = ~(container > 0) | (missing <= 1) | (missing / container <= 0.01)
    return F.when(F.coalesce(ok, F.lit(True)), "ok").when(missing / container > 0.25, "broken").otherwise("warn")
