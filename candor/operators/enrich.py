"""Reviews with all that the voting rules look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.functions.stats import days_crossed, ratio
from candor.functions.text import friend_count
from candor.operators.behaviour import burst_days, first_week, gap_stats, with_burst_flag
from candor.operators.similarity import referred_similarity, text_similarity
from candor.sources.staging import sized_broadcast, written


def text_measures(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    return {"text_len": n, "exclamation_count": F.regexp_count(text, F.lit("!")), "caps_ratio": ratio(F.regexp_count(text, F.lit("[A-Z]")).cast("double"), n)}


def with_text_measures(reviews: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    if texts is None:
        return reviews.withColumns(text_measures(F.col("text")))
    told = sized_broadcast(written(texts.select("text_id", *[v.alias(k) for k, v in text_measures(F.col("text")).items()]), "text-measures"), 100)
    none = text_measures(F.lit(None).cast("string"))
    return reviews.join(told, "text_id", "left").withColumns({k: F.coalesce(k, v) for k, v in none.items()}).drop("text_id")


def authors(reviews: DataFrame, users: DataFrame) -> DataFrame:
    """A row for each author with a user row or a gap: the user's columns, the gaps and the first week."""
    known = users.select(
        "user_id", F.col("review_count").alias("user_review_count"), "yelping_since", "friends", "fans", F.col("average_stars").alias("user_avg_stars"), "compliment_photos",
        friend_count(F.col("friends")).alias("friend_count"),
    )
    return known.join(gap_stats(reviews), "user_id", "full").join(first_week(reviews, users), "user_id", "left")


def enriched(reviews: DataFrame, businesses: DataFrame, users: DataFrame, texts: DataFrame | None = None, rows: DataFrame | None = None, friends: bool = True) -> DataFrame:
    """Authors without a user row have null user columns, no friends and no first week.

    Texts are measured before the first shuffle, so they only travel if the caller selects them. With texts (text_id and
    text), reviews have a text_id in place of a text, and each text is measured once. rows: the reviews with further columns,
    which ride along. What is known of authors is written first, a row each, and what is small goes to the reviews: they are
    shuffled once, by author, with few columns. Without friends the lists of friends are only counted.
    """
    of_authors = authors(reviews, users)
    of_authors = written(of_authors if friends else of_authors.drop("friends"), "authors")
    b = sized_broadcast(businesses.select("business_id", F.col("stars").alias("business_mean_stars"), F.col("review_count").alias("business_total_reviews")), 100)
    days = sized_broadcast(written(burst_days(reviews).select("business_id", "day"), "burst-days"), 100)
    joined = (reviews if rows is None else rows).join(of_authors, "user_id", "left")
    joined = with_burst_flag(with_text_measures(joined, texts), days).withColumnRenamed("in_burst", "in_burst_window").join(b, "business_id", "left")
    return joined.withColumns({
        "account_age_days_at_review": days_crossed(F.col("yelping_since"), F.col("date")), "first_week_count": F.coalesce("first_week_count", F.lit(0)), "friend_count": F.coalesce("friend_count", friend_count(F.lit(None).cast("string"))),
    })


def with_copies(df: DataFrame, reviews: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Adds max_dup_sim: how similar the author's most similar other review is."""
    sims = text_similarity(reviews, "user_id", "review_id") if texts is None else referred_similarity(reviews, texts, "user_id", "review_id", "text_id")
    return df.join(sims.withColumnRenamed("max_sim", "max_dup_sim"), "review_id", "left")
