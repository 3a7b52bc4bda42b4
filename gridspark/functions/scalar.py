"""Scalar cleaning and transformation expressions. Missing is always NULL, never NaN."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# No-data markers of the source rasters.
SENTINELS = (65535.0, -9999.0)
INF = float("inf")


def is_finite(x: Column) -> Column:
    """False for NULL, NaN and both infinities."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(INF)), F.lit(False))


def null_sentinels(x: Column, sentinels: Sequence[float] = SENTINELS, negative_is_null: bool = False) -> Column:
    keep = is_finite(x) & ~x.isin(*sentinels)
    if negative_is_null:
        keep = keep & (x >= 0)
    return F.when(keep, x)


def numeric_coerce(text: Column) -> Column:
    """Text to number; anything unreadable becomes missing."""
    number = text.try_cast("double")
    return F.when(is_finite(number), number)


def safe_log1p(x: Column, keep_null: bool = False) -> Column:
    """``log1p`` of the positive part; missing counts as 0 unless ``keep_null``."""
    zero_or_missing = F.when(is_finite(x), F.lit(0.0)) if keep_null else F.lit(0.0)
    return F.when(is_finite(x) & (x > 0), F.log1p(x)).otherwise(zero_or_missing)


def nonneg_or_null(x: Column) -> Column:
    return F.when(is_finite(x) & (x >= 0), x)


def log_nonneg(x: Column) -> Column:
    return F.log1p(nonneg_or_null(x))


def log10p(x: Column) -> Column:
    return F.when(is_finite(x), F.log10(F.lit(1.0) + F.greatest(x, F.lit(0.0))))


def positive_raw(x: Column) -> Column:
    return F.when(is_finite(x) & (x > 0), x).otherwise(F.lit(0.0))


def positive_flags(x: Column) -> tuple[Column, Column, Column]:
    """(cleaned value, exists flag, missing flag)."""
    exists = is_finite(x) & (x > 0)
    return positive_raw(x), exists.cast("int"), (~is_finite(x)).cast("int")


def paired_gain(irrigated: Column, rainfed: Column, signed: bool = False) -> Column:
    """Gain of the first over the second where both are valid, else 0."""
    gain = irrigated - rainfed
    both = is_finite(irrigated) & is_finite(rainfed)
    return F.when(both, gain if signed else F.greatest(gain, F.lit(0.0))).otherwise(F.lit(0.0))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def safe_divide(num: Column, den: Column, default: float | None = None) -> Column:
    fallback = F.lit(default).cast("double")
    return F.when(den > 0, num / den).otherwise(fallback)


def prior_shift(p: Column, sample_prior: Column, population_prior: Column, eps: float = 1e-6) -> Column:
    """Move a probability from the prior it was trained under to the population's."""
    clipped = clip(p, eps, 1.0 - eps)
    sp = clip(sample_prior, eps, 1.0 - eps)
    pp = clip(population_prior, eps, 1.0 - eps)
    one = F.lit(1.0)
    odds = clipped / (one - clipped) * (pp / (one - pp)) / (sp / (one - sp))
    return odds / (one + odds)


def expected_fraction(p: Column, q: Column) -> Column:
    """Hurdle composition: probability of presence times the clipped conditional fraction."""
    return p * clip(q)


def class_isin(x: Column, classes: Sequence[int]) -> Column:
    return F.when(x.isin(*classes), x)


def all_of(rules: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, rules)


def land_mask(
    elevation: Column, fraction: Column, population: Column, exclusion: Column, soil: Column
) -> Column:
    """Cells that may enter the analysis: valid layers, no permanent wetland, a known soil group."""
    # Exclusion classes 1-6 with wetland 5 left out, soil groups 1-33.
    return all_of(
        [
            is_finite(elevation),
            is_finite(fraction),
            is_finite(population) & (population >= 0),
            F.coalesce(exclusion.between(1, 6) & (exclusion != 5), F.lit(False)),
            F.coalesce(soil.between(1, 33), F.lit(False)),
        ]
    )


def presence_flag(fraction: Column, threshold: float = 0.01) -> Column:
    return F.coalesce(fraction > threshold, F.lit(False)).cast("int")


def noleap_year(days: Column, ref_year: int, ref_day_of_year: int = 0) -> Column:
    """Calendar year of a day offset in a 365-day calendar."""
    return F.floor((F.lit(ref_year * 365.0 + ref_day_of_year) + days) / F.lit(365.0)).cast("int")


def standard_year(days: Column, ref_date: str) -> Column:
    return F.year(F.date_add(F.lit(ref_date).cast("date"), days.cast("int")))


def mean_calendar_year(days: Column, ref_year: int, ref_day_of_year: int = 0) -> Column:
    """Calendar year of a day offset with the mean Gregorian year length."""
    # Fixed value: days per mean Gregorian year.
    length = 365.2425
    return F.floor((F.lit(ref_year * length + ref_day_of_year) + days) / F.lit(length)).cast("int")


def to_mm_per_year(value: Column, unit: Column) -> Column:
    """Water flux to mm/yr by the rate named in the unit text; unknown units pass unchanged."""
    u = F.regexp_replace(F.lower(unit), " ", "")
    # Unit spellings, and days / seconds per mean year.
    day = 365.25
    return (
        F.when(u.rlike(r"s-1|/s|s\^-1"), value * F.lit(day * 24 * 60 * 60))
        .when(u.rlike(r"d-1|/d|d\^-1"), value * F.lit(day))
        .when(u.rlike(r"month-1|/month|monthly"), value * F.lit(12.0))
        .otherwise(value)
    )


def to_meters(value: Column, unit: Column) -> Column:
    u = F.lower(unit)
    return F.when(u.contains("cm"), value / 100.0).when(u.contains("mm"), value / 1000.0).otherwise(value)


def threshold_label(threshold: float) -> str:
    """``10 -> "10"``, ``0.1 -> "0p1"``."""
    return f"{threshold:g}".replace(".", "p")
