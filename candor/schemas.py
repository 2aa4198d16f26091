"""Declared schemas of the source tables. Nothing is inferred, and undeclared nested fields are never read."""

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType


def _table(**kinds: str) -> StructType:
    types = {"text": StringType(), "whole": LongType(), "real": DoubleType(), "time": TimestampType()}
    return StructType([StructField(name, types[kind]) for kind, names in kinds.items() for name in names.split()])


def _ordered(schema: StructType, names: str) -> StructType:
    return StructType([schema[n] for n in names.split()])


BUSINESSES = _ordered(_table(text="business_id name address city state postal_code categories", real="latitude longitude stars", whole="review_count is_open"), "business_id name address city state postal_code latitude longitude stars review_count is_open categories")
REVIEWS = _ordered(_table(text="review_id user_id business_id text", real="stars", whole="useful funny cool", time="date"), "review_id user_id business_id stars useful funny cool text date")
# The kinds of compliments.
COMPLIMENTS = "hot more profile cute list note plain cool funny writer photos".split()
USERS = _ordered(
    _table(text="user_id name elite friends", whole=" ".join(["review_count useful funny cool fans", *(f"compliment_{c}" for c in COMPLIMENTS)]), real="average_stars", time="yelping_since"),
    " ".join(["user_id name review_count yelping_since useful funny cool elite friends fans average_stars", *(f"compliment_{c}" for c in COMPLIMENTS)]),
)
TIPS = _ordered(_table(text="user_id business_id text", time="date", whole="compliment_count"), "user_id business_id text date compliment_count")
CHECKINS = _table(text="business_id date")

TABLES = {"businesses": BUSINESSES, "reviews": REVIEWS, "users": USERS, "tips": TIPS, "checkins": CHECKINS}
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
