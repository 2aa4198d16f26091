"""The profile of a loaded metro: ten small aggregates and a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SNAPSHOT = "2022-01-19"


def overview(**tables: DataFrame) -> DataFrame:
    counts = [df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def geo_breakdown(businesses: DataFrame) -> DataFrame:
    return businesses.groupBy("state").agg(F.count(F.lit(1)).alias("businesses"), F.sum("review_count").alias("listed_reviews")).orderBy(F.desc("businesses"), "state")


def top_cities(businesses: DataFrame, n: int = 15) -> DataFrame:
    return businesses.groupBy("city", "state").agg(F.count(F.lit(1)).alias("businesses")).orderBy(F.desc("businesses"), "city", "state").limit(n)


def date_range(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.min("date").alias("first_review"), F.max("date").alias("last_review"), F.count(F.lit(1)).alias("n_reviews"))


def _spread(reviews: DataFrame, key: str) -> tuple[DataFrame, list[Column]]:
    per = reviews.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per, [F.min("n").alias("min"), *[F.percentile("n", F.lit(q)).alias(f"p{round(100 * q)}") for q in (0.5, 0.9, 0.99)], F.max("n").alias("max"), F.avg("n").alias("mean")]


def reviews_per_user(reviews: DataFrame) -> DataFrame:
    per, spread = _spread(reviews, "user_id")
    return per.agg(F.count(F.lit(1)).alias("n_users"), *spread, F.sum((F.col("n") == 1).cast("long")).alias("one_review_users"))


def reviews_per_business(reviews: DataFrame) -> DataFrame:
    per, spread = _spread(reviews, "business_id")
    return per.agg(F.count(F.lit(1)).alias("n_businesses"), *spread)


def rating_distribution(reviews: DataFrame) -> DataFrame:
    per = reviews.groupBy("stars").agg(F.count(F.lit(1)).alias("n"))  # a row a rating, so one task can hold the window
    return per.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


def reviews_per_year(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy(F.year("date").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def review_length(texts: DataFrame) -> DataFrame:
    n = F.length("text")
    return texts.agg(F.min(n).alias("min"), *[F.percentile(n, F.lit(q)).alias(f"p{round(100 * q)}") for q in (0.5, 0.9, 0.99)], F.max(n).alias("max"), F.avg(n).alias("mean"))


def account_age_buckets(users: DataFrame, snapshot: str = SNAPSHOT) -> DataFrame:
    days = F.datediff(F.lit(snapshot).cast("date"), "yelping_since")
    # The bucket names.
    bucket = F.when(days < 30, "0  <30d").when(days < 180, "1  30-180d").when(days < 365, "2  180-365d").when(days < 1095, "3  1-3y").otherwise("4  >3y")
    return users.groupBy(bucket.alias("account_age")).agg(F.count(F.lit(1)).alias("n_users"), F.avg("review_count").alias("avg_lifetime_reviews"), F.median("review_count").alias("median_lifetime_reviews"))


def reviews_per_user_histogram(reviews: DataFrame, clip: int = 30) -> DataFrame:
    per = reviews.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(F.least("n", F.lit(clip)).alias("reviews")).agg(F.count(F.lit(1)).alias("users"))
