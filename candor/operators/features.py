"""The model's feature table: content, context, author and similarity features per review."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.functions import text as text_functions
from candor.functions.sentiment import Scorer, lexicon_scorer
from candor.functions.stats import days_elapsed
from candor.operators.behaviour import burst_days, reviewer_features, with_context
from candor.operators.similarity import referred_vector_similarity, vector_similarity
from candor.sources.staging import sized_broadcast, written

IDS = ("review_id", "user_id", "business_id")
DATES = ("date", "yelping_since")
LEAKY_DROPPED = ("account_age_days_snapshot",)
SENTIMENT = ("vader_compound", "vader_pos", "vader_neg", "vader_neu")
# The order of the feature table's columns.
ORDER = (
    "review_id user_id business_id stars date char_length word_count sentence_count exclamation_ratio caps_ratio first_person_ratio vader_compound vader_pos vader_neg vader_neu flesch_reading_ease "
    "stars_delta_from_business_mean stars_delta_from_user_mean hours_since_prev_review_on_business business_review_count_at_time is_in_burst_window "
    "total_reviews fan_count photo_count account_age_days_snapshot reviews_per_month rating_variance rating_skew avg_review_length fraction_extreme_ratings posting_hour_entropy yelping_since friend_count "
    "account_age_days_at_review max_sim_to_user_history max_sim_to_business_reviews"
).split()
HARD_LABEL = 0.5
SPLIT, TUNE_FROM = "2020-01-01", "2019-01-01"


def with_content(reviews: DataFrame, scorer: Scorer = lexicon_scorer) -> DataFrame:
    """The reviews with everything that the text alone tells in its place. Only sentiment needs Python workers, in Arrow batches."""

    def sentiment(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = scorer()
        for texts in batches:
            yield pd.DataFrame([score(t or "") for t in texts], columns=list(SENTIMENT)).astype("float32")

    told = F.pandas_udf(sentiment, ", ".join(f"{c} float" for c in SENTIMENT))
    named = {k: v.alias(k) for k, v in text_functions.features(F.col("text")).items()}
    rest = [c for c in reviews.columns if c != "text"]
    out = reviews.select(*rest, *named.values(), text_functions.flesch(F.col("text")).cast("float").alias("flesch_reading_ease"), told(F.col("text")).alias("_s"))
    return out.select(*rest, *named, *[F.col(f"_s.{c}").alias(c) for c in SENTIMENT], "flesch_reading_ease")


def with_content_of(reviews: DataFrame, texts: DataFrame, scorer: Scorer = lexicon_scorer) -> DataFrame:
    """As with_content, for reviews with a text_id; each text (text_id and text) is measured once."""
    told = written(with_content(texts.select("text_id", "text"), scorer), "content")
    nothing = F.lit(None).cast("string")
    none = text_functions.features(nothing) | {"flesch_reading_ease": text_functions.flesch(nothing)} | {c: F.lit(float(v)) for c, v in zip(SENTIMENT, scorer()(""), strict=True)}
    whole = {c: F.coalesce(c, v.cast(told.schema[c].dataType)) for c, v in none.items()}
    return reviews.join(sized_broadcast(told, 200), "text_id", "left").withColumns(whole).drop("text_id")


def feature_table(
    reviews: DataFrame, businesses: DataFrame, users: DataFrame, snapshot: str, embeddings: DataFrame | None = None, scorer: Scorer = lexicon_scorer, texts: DataFrame | None = None, vectors: DataFrame | None = None, riding: tuple[str, ...] = ()
) -> DataFrame:
    """All features by review. embeddings: review_id and a unit vector; without them both similarities are null.

    With texts (text_id and text), reviews have a text_id in place of a text; with vectors (vector_id and embedding), a
    vector_id in place of embeddings. What is known of authors is written first, and similarities join the reviews while
    these have few columns. riding: columns of the reviews that are given back after the features.
    """
    base = reviews.select("review_id", "user_id", "business_id", "stars", "date")
    if texts is None:
        told, history = with_content(reviews.select(*base.columns, *riding, "text"), scorer), reviews  # before any shuffle, so texts are left behind
    else:
        told = reviews.select(*base.columns, *riding, "text_id")
        history = told.join(sized_broadcast(written(texts.select("text_id", F.length("text").alias("text_length")), "text-lengths"), 100), "text_id", "left")
    of_authors = written(reviewer_features(history, users, snapshot), "authors")
    days = sized_broadcast(written(burst_days(base).select("business_id", "day"), "burst-days"), 100)
    for key, name in (("user_id", "max_sim_to_user_history"), ("business_id", "max_sim_to_business_reviews")):
        if vectors is not None:
            sims = referred_vector_similarity(reviews, vectors, key, "review_id", "vector_id", "embedding")
        elif embeddings is not None:
            sims = vector_similarity(base.select("review_id", key).join(embeddings, "review_id"), key, "review_id", "embedding")
        else:
            told = told.withColumn(name, F.lit(None).cast("float"))
            continue
        told = told.join(written(sims.select("review_id", F.col("max_sim").cast("float").alias(name)), "vector-nearest"), "review_id", "left")
    placed = written(with_context(told, sized_broadcast(businesses.select("business_id", "stars"), 100), users, days), "context")
    out = placed.join(of_authors, "user_id", "left")
    out = out if texts is None else with_content_of(out, texts, scorer)
    out = out.withColumn("account_age_days_at_review", days_elapsed(F.col("yelping_since"), F.col("date")).cast("int"))
    return out.select(*ORDER, *riding)


def write_features(features: DataFrame, path: str) -> None:
    """Sorted by business in few files: one directory a business would be tens of thousands."""
    features.repartitionByRange("business_id").sortWithinPartitions("business_id").write.mode("overwrite").parquet(path)


def feature_columns(columns: list[str]) -> list[str]:
    left_out = {*IDS, *DATES, *LEAKY_DROPPED, "p_suspicious"}
    return [c for c in columns if c not in left_out]


class RowMismatch(ValueError):
    pass


def join_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    joined = features.join(labels.select("review_id", "p_suspicious"), "review_id")
    n, both = features.count(), joined.count()
    if n != both:
        raise RowMismatch(f"{n} feature rows, {both} with labels")
    return joined


def time_split(joined: DataFrame, split: str = SPLIT) -> tuple[DataFrame, DataFrame]:
    """Train before the date, test from it on; both with hard_label."""
    marked = joined.withColumn("hard_label", (F.col("p_suspicious") >= HARD_LABEL).cast("byte"))
    at = F.lit(split).cast("timestamp")
    return marked.filter(F.col("date") < at), marked.filter(F.col("date") >= at)


def hash_sample(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """The same n rows whatever their order."""
    return df.orderBy(F.xxhash64(id_col), id_col).limit(n)
