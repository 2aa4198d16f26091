"""What businesses and authors do over time: bursts, gaps, first weeks, positions, posting hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candor.functions.stats import days_crossed, sample_skewness, seconds_between
from candor.functions.text import friend_count

BURST_DAYS = 14
BURST_SIGMA = 3.0
BURST_LEAST = 3


def daily_counts(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("business_id", F.to_date("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def burst_days(reviews: DataFrame) -> DataFrame:
    """Days on which a business got more reviews than its last BURST_DAYS active days explain.

    The window runs over days, not reviews, so a business is one row a day however many reviews it has.
    """
    before = Window.partitionBy("business_id").orderBy("day").rowsBetween(-BURST_DAYS, -1)
    days = daily_counts(reviews).select("*", F.avg("n").over(before).alias("mean"), F.stddev_samp("n").over(before).alias("sd"), F.count("n").over(before).alias("days"))
    return days.filter((F.col("days") >= 3) & (F.col("sd") > 0) & (F.col("n") > F.col("mean") + BURST_SIGMA * F.col("sd"))).select("business_id", "day", "n")


def with_burst_flag(reviews: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """days: the days of bursts, if they are known."""
    days = (burst_days(reviews) if days is None else days).select(F.col("business_id").alias("_b"), F.col("day").alias("_day"))
    flagged = reviews.join(days, (F.col("business_id") == F.col("_b")) & (F.to_date("date") == F.col("_day")), "left")
    return flagged.withColumn("in_burst", F.col("_b").isNotNull().cast("int")).drop("_b", "_day")


def gap_stats(reviews: DataFrame) -> DataFrame:
    """Mean, deviation and number of the days between an author's reviews; authors with one review have no row."""
    by_user = Window.partitionBy("user_id").orderBy("date", "review_id")
    gaps = reviews.select("user_id", (seconds_between(F.lag("date").over(by_user), F.col("date")) / 86400.0).alias("gap")).filter("gap is not null")
    return gaps.groupBy("user_id").agg(F.avg("gap").alias("gap_mean"), F.stddev_samp("gap").alias("gap_std"), F.count("gap").alias("n_gaps"))


def first_week(reviews: DataFrame, users: DataFrame) -> DataFrame:
    """Reviews that each known author wrote within a week of joining; zero included. The join yields the users and their hits."""
    since = users.select(F.col("user_id"), "yelping_since")
    week = reviews.select(F.col("user_id").alias("_u"), "date", "review_id")
    hit = (F.col("user_id") == F.col("_u")) & (F.col("date") >= F.col("yelping_since")) & (F.col("date") < F.col("yelping_since") + F.expr("interval '7' day"))
    return since.join(week, hit, "left").groupBy("user_id").agg(F.count("review_id").alias("first_week_count"))


CONTEXT = ["stars_delta_from_business_mean", "stars_delta_from_user_mean", "hours_since_prev_review_on_business", "business_review_count_at_time", "is_in_burst_window"]


def with_context(reviews: DataFrame, businesses: DataFrame, users: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Adds to each review: distance from both averages, hours since the business's last review, place in its sequence, burst.

    The columns ride along through one window and the joins, so nothing is joined back by review.
    """
    in_order = Window.partitionBy("business_id").orderBy("date", "review_id")
    placed = reviews.withColumns({
        "hours_since_prev_review_on_business": seconds_between(F.lag("date").over(in_order), F.col("date")) / 3600.0, "business_review_count_at_time": F.row_number().over(in_order),
    })
    means = businesses.select("business_id", F.col("stars").alias("_business_mean"))
    own = users.select("user_id", F.col("average_stars").alias("_user_mean"))
    joined = with_burst_flag(placed, days).withColumnRenamed("in_burst", "is_in_burst_window").join(means, "business_id", "left").join(own, "user_id", "left")
    deltas = {"stars_delta_from_business_mean": F.col("stars") - F.col("_business_mean"), "stars_delta_from_user_mean": F.col("stars") - F.col("_user_mean")}
    return joined.withColumns(deltas).drop("_business_mean", "_user_mean")


def context_features(reviews: DataFrame, businesses: DataFrame, users: DataFrame) -> DataFrame:
    return with_context(reviews.select("review_id", "user_id", "business_id", "stars", "date"), businesses, users).select("review_id", *CONTEXT)


def hour_entropy(reviews: DataFrame) -> DataFrame:
    """Shannon entropy of each author's posting hours: at most 24 rows an author pass the window."""
    hours = reviews.groupBy("user_id", F.hour("date").alias("hour")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    shares = hours.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))
    return shares.groupBy("user_id").agg((-F.sum(F.col("p") * F.ln("p"))).alias("posting_hour_entropy"))


def reviewer_features(reviews: DataFrame, users: DataFrame, snapshot: str) -> DataFrame:
    """Per known author; history statistics are zero where they are undefined. reviews: with their text or its text_length."""
    length = F.length("text") if "text" in reviews.columns else F.col("text_length")
    history = reviews.groupBy("user_id").agg(
        F.var_samp("stars").alias("rating_variance"), sample_skewness(F.col("stars")).alias("rating_skew"), F.avg(length).alias("avg_review_length"),
        F.avg(F.when(F.col("stars").isin(1.0, 5.0), 1.0).otherwise(0.0)).alias("fraction_extreme_ratings"),
    )
    age = days_crossed(F.col("yelping_since"), F.lit(snapshot).cast("date"))
    known = ["rating_variance", "rating_skew", "avg_review_length", "fraction_extreme_ratings", "posting_hour_entropy"]
    return (
        users.join(history, "user_id", "left").join(hour_entropy(reviews), "user_id", "left")
        .select(
            "user_id", F.col("review_count").alias("total_reviews"), F.col("fans").alias("fan_count"), F.col("compliment_photos").alias("photo_count"), age.alias("account_age_days_snapshot"),
            (F.col("review_count") / F.greatest(age / 30.44, F.lit(1.0))).alias("reviews_per_month"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in known],
            "yelping_since", friend_count(F.col("friends")).alias("friend_count"),
        )
    )
