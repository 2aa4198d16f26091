"""The questions that an API asks: search, one business, a page of its reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.operators.model import SoftModel
from candor.operators.signals import with_signals
from candor.sources.staging import written

# The bounds of the requests.
SEARCH_LIMIT, SEARCH_MOST = 20, 100
PAGE_LIMIT, PAGE_MOST = 50, 200
SCORE_FIELDS = ("rrs", "rrs_ci_low", "rrs_ci_high", "pct_flagged", "n_flagged", "n_authentic_reviews", "n_reviews")


class NotFound(LookupError):
    pass


class BadRequest(ValueError):
    pass


def health(metro: str) -> dict[str, str]:
    return {"status": "ok", "metro": metro}


def _within(name: str, value: int, low: int, high: int | None = None) -> int:
    if value < low or (high is not None and value > high):
        raise BadRequest(f"{name} must be at least {low}" + (f" and at most {high}" if high is not None else ""))
    return value


def search_businesses(businesses: DataFrame, scores: DataFrame, q: str, city: str | None = None, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Businesses whose name holds q, most reviewed first. % and _ in q stand for any characters."""
    if not q:
        raise BadRequest("q must not be empty")
    found = businesses.filter(F.lower("name").like(f"%{q.lower()}%"))
    if city is not None:
        found = found.filter(F.lower("city") == city.lower())
    top = found.orderBy(F.desc("review_count"), "business_id").limit(_within("limit", limit, 1, SEARCH_MOST))
    return top.join(scores.select("business_id", "rrs"), "business_id", "left").select("business_id", "name", "city", "state", F.col("stars").alias("yelp_rating"), F.col("review_count").alias("yelp_review_count"), "rrs").orderBy(F.desc("yelp_review_count"), "business_id")


def _existing(businesses: DataFrame, business_id) -> DataFrame:
    row = businesses.filter(F.col("business_id") == business_id).limit(1)
    if row.isEmpty():
        raise NotFound(f"no business {business_id!r}")
    return row


def business_detail(businesses: DataFrame, scores: DataFrame, business_id) -> DataFrame:
    row = _existing(businesses, business_id)
    return row.join(scores.select("business_id", *SCORE_FIELDS), "business_id", "left").select(
        "business_id", "name", "address", "city", "state", "categories", F.col("stars").alias("yelp_rating"), F.col("review_count").alias("yelp_review_count"), *SCORE_FIELDS,
    )


def review_page(businesses: DataFrame, reviews: DataFrame, predictions: DataFrame, business_id, limit: int = PAGE_LIMIT, offset: int = 0) -> DataFrame:
    """One page of a business's reviews, the latest first, with p_fake where there is one."""
    _existing(businesses, business_id)
    own = reviews.filter(F.col("business_id") == business_id).orderBy(F.desc("date"), "review_id").offset(_within("offset", offset, 0)).limit(_within("limit", limit, 1, PAGE_MOST))
    told = predictions.select("review_id", "p_fake").join(F.broadcast(own.select("review_id")), "review_id", "left_semi")  # at most PAGE_MOST ids, so only their scores travel
    return own.join(F.broadcast(told), "review_id", "left").select("review_id", "stars", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), "text", "p_fake").orderBy(F.desc("date"), "review_id")


def review_page_signals(businesses: DataFrame, reviews: DataFrame, predictions: DataFrame, business_id, features: DataFrame, model: SoftModel, limit: int = PAGE_LIMIT, offset: int = 0) -> DataFrame:
    """The page with the signals of each review; none where a review has no features. The page is read twice, so it is written."""
    page = written(review_page(businesses, reviews, predictions, business_id, limit, offset), "page")
    rows = features.join(F.broadcast(page.select("review_id")), "review_id", "left_semi")  # at most PAGE_MOST ids
    told = with_signals(rows, model).select("review_id", "signals")
    return page.join(told, "review_id", "left").withColumn("signals", F.coalesce("signals", F.array().cast("array<string>"))).orderBy(F.desc("date"), "review_id")


def review_page_json(businesses: DataFrame, reviews: DataFrame, predictions: DataFrame, business_id, features: DataFrame | None = None, model: SoftModel | None = None, include_flags: bool = True, limit: int = PAGE_LIMIT, offset: int = 0) -> list[dict]:
    """The page as dictionaries, with the signals of each review when they are asked for. At most PAGE_MOST rows."""
    if include_flags and features is not None and model is not None:
        page = review_page_signals(businesses, reviews, predictions, business_id, features, model, limit, offset)
    else:
        page = review_page(businesses, reviews, predictions, business_id, limit, offset).withColumn("signals", F.array().cast("array<string>"))
    return [r.asDict() for r in page.collect()]


def latest_metro(spark: SparkSession, meta: DataFrame) -> str:
    row = meta.limit(1).first()
    return row["metro"] if row else "unknown"
