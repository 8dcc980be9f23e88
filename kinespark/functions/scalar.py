"""Column expressions: rounding, timestamps, text clean-up, symmetry measures, safe statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_even(c: str | Column, places: int = 3) -> Column:
    """Scale, round to the nearest even integer, scale back."""
    scale = float(10**places)
    return F.rint(_col(c) * scale) / scale


def nan_to_null(c: str | Column) -> Column:
    """NaN compares as larger than everything and equal to itself; NULL is the only missing value."""
    return F.nanvl(_col(c), F.lit(None).cast("double"))


def clean_timestamp_text(c: str | Column) -> Column:
    """'2024-08-21T09:35:00.010' → '2024-08-21 09:35:00:010'."""
    return F.trim(F.replace(F.replace(_col(c), F.lit("T"), F.lit(" ")), F.lit("."), F.lit(":")))


def parse_timestamp(c: str | Column) -> Column:
    """Zone-free timestamp of a text with a fraction of 1–6 digits; NULL if it does not parse."""
    text = clean_timestamp_text(c)
    whole = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}:\d{1,6}$"
    iso = F.regexp_replace(text, r":(\d{1,6})$", r".$1")
    return F.when(text.rlike(whole), iso.try_cast("timestamp_ntz"))


def epoch_millis(ts: str | Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), _col(ts)) / 1000


def seconds_between(start: str | Column, end: str | Column) -> Column:
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end)) / 1_000_000


def plus_seconds(base: Column, seconds: str | Column) -> Column:
    """``base`` + seconds, to the microsecond."""
    zero = F.lit(0)
    return base + F.make_dt_interval(zero, zero, zero, _col(seconds).cast("decimal(18,6)"))


def unbracket(c: str | Column) -> Column:
    """'[0.25]' → 0.25."""
    return F.trim(_col(c), F.lit("[] ")).cast("double")


def asymmetry_index(left: str | Column, right: str | Column) -> Column:
    """(l − r) / (l + r), 0 where the sum is 0."""
    l, r = _col(left), _col(right)
    return F.when((l + r) == 0, F.lit(0.0)).otherwise(F.try_divide(l - r, l + r)).cast("double")


def symmetry_ratio(left: str | Column, right: str | Column) -> Column:
    """Smaller over larger, 0 where the larger is 0."""
    l, r = _col(left), _col(right)
    both = l.isNotNull() & r.isNotNull()
    high = F.greatest(l, r)
    ratio = F.when(high == 0, F.lit(0.0)).otherwise(F.try_divide(F.least(l, r), high))
    return F.when(both, ratio.cast("double"))


def percent_difference(left: str | Column, right: str | Column) -> Column:
    """|l − r| in percent of the larger; NULL where both are 0."""
    l, r = _col(left), _col(right)
    return F.when(l.isNotNull() & r.isNotNull(), F.try_divide(F.abs(l - r), F.greatest(l, r)) * 100)


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson r over rows where both are present; NULL for a constant input."""
    x, y = _col(x), _col(y)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def mixed_skewness(c: str | Column) -> Column:
    """Population third moment over the cube of the sample standard deviation."""
    n = F.count(_col(c))
    return F.when(n > 1, F.skewness(_col(c)) * F.pow((n - 1) / n, 1.5))


def mixed_kurtosis(c: str | Column) -> Column:
    """Population fourth moment over the fourth power of the sample standard deviation (not excess)."""
    n = F.count(_col(c))
    return F.when(n > 1, (F.kurtosis(_col(c)) + 3) * F.pow((n - 1) / n, 2))


def mean_or_zero(c: str | Column) -> Column:
    return F.coalesce(F.avg(_col(c)), F.lit(0.0))
