"""Live burst flags: daily counts per business from a stream of reviews, with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_daily_counts(reviews: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts by business and calendar day; a day is final once the watermark has passed it."""
    days = reviews.withWatermark("date", late).groupBy("business_id", F.window("date", "1 day"))
    return days.agg(F.count(F.lit(1)).alias("n")).select("business_id", F.col("window.start").cast("date").alias("day"), "n")
