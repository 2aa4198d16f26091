"""Statistics that Spark lacks or defines otherwise, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 97.5 % point of the normal distribution.
Z_95 = 1.959963984540054


def ratio(over: Column, under: Column, empty: float | None = 0.0) -> Column:
    """over / under, and `empty` where under is zero; null where either is."""
    return F.when(under == 0, F.lit(empty).cast("double")).otherwise(over / F.when(under != 0, under))


def sample_skewness(x: Column | str) -> Column:
    """Aggregate: bias-corrected skewness, null for fewer than three values and zero without spread."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2) * F.skewness(x))


def wilson(p: Column, n: Column, z: float = Z_95) -> tuple[Column, Column]:
    """Wilson score interval of a share p of n; the point itself for n of zero or less."""
    safe = F.when(n > 0, n)
    centre = (p + z * z / (2 * safe)) / (1 + z * z / safe)
    half = z / (1 + z * z / safe) * F.sqrt(p * (1 - p) / safe + z * z / (4 * safe * safe))
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.when(n > 0, low).otherwise(p), F.when(n > 0, high).otherwise(p)


def rating_interval(rating: Column, n: Column) -> tuple[Column, Column]:
    """The interval of a rating from 1 to 5."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (rating - 1) / 4))
    low, high = wilson(share, n)
    return 1 + 4 * low, 1 + 4 * high


def seconds_between(a: Column, b: Column) -> Column:
    """From a to b, with fractions."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6


def days_crossed(a: Column, b: Column) -> Column:
    """Midnights between a and b."""
    return F.datediff(b, a)


def days_elapsed(a: Column, b: Column) -> Column:
    """Whole days that have passed from a to b, towards zero."""
    return F.timestamp_diff("DAY", a, b)


def histogram_bin(x: Column, bins: int = 10) -> Column:
    """Bin of a value in [0, 1]; values beyond land in the last ones. Null stays null."""
    return F.when(x.isNotNull(), F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(x * bins))).cast("int"))


def half_stars(x: Column) -> Column:
    return F.round(x * 2) / 2


#: What is shown for a missing value.
MISSING = "—"


def shown_rating(x: Column) -> Column:
    """Two decimals."""
    return F.when(x.isNull(), MISSING).otherwise(F.format_string("%.2f", x.cast("double")))


def shown_share(x: Column) -> Column:
    """Whole percent of a share."""
    return F.when(x.isNull(), MISSING).otherwise(F.concat(F.round(x * 100).cast("long").cast("string"), F.lit("%")))


def shown_count(x: Column) -> Column:
    """With commas between thousands."""
    return F.when(x.isNull(), MISSING).otherwise(F.format_number(x.cast("long"), 0))


def shown_date(x: Column) -> Column:
    """As Jan 2, 2020."""
    return F.coalesce(F.date_format(x, "MMM d, yyyy"), F.lit(MISSING))
