"""The driver's star schema seen as businesses, users and reviews.

Three views: orders as reviews of suppliers (with texts), events as reviews of the number in their properties, and line
items as reviews that already have a probability of being fake.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as business_id", "s_name as name", "concat(cast(s_suppkey as string), ' Main St') as address", "concat('City', cast(s_suppkey % 7 as string)) as city",
        "concat('S', cast(s_nationkey as string)) as state", "case when s_suppkey % 3 = 0 then 'Bars, Food' else 'Food' end as categories", "1.0d + 0.5d * (s_suppkey % 9) as stars", "5 + s_suppkey % 60 as review_count",
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some authors have no row, as in the real data."""
    return table(spark, sf_dir, "customer").filter("c_custkey % 211 <> 0").selectExpr(
        "c_custkey as user_id", "c_name as name", "c_custkey % 30 as review_count", "c_custkey % 7 as fans", "c_custkey % 3 as compliment_photos", "1.0d + 0.5d * (c_custkey % 9) as average_stars",
        "case when c_custkey % 4 = 0 then 'None' else concat(repeat('f,', cast(c_custkey % 25 as int)), 'f') end as friends",
        "timestamp '1994-06-01 00:00:00' + make_dt_interval(cast(c_custkey % 1500 as int)) as yelping_since",
    )


def reviews(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("business_id"))
    found = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).selectExpr(
        "o_orderkey as review_id", "o_custkey as user_id", "business_id", "cast(substr(o_orderpriority, 1, 1) as double) as stars",
        "cast(o_orderdate as timestamp) + make_dt_interval(0, 0, 0, cast(round(o_totalprice * 100) as bigint) % 86400) as date",
    )
    if not text:
        return found
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = max(documents.count(), 1)
    return found.join(documents, F.col("review_id") % n == F.col("doc_id"), "left").drop("doc_id")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")


def referring_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviews with the ids of their texts in place of the texts."""
    n = max(table(spark, sf_dir, "documents").count(), 1)
    return reviews(spark, sf_dir).withColumn("text_id", F.col("review_id") % n)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vector_id"), "embedding")


def with_vector_ids(spark: SparkSession, sf_dir: str, reviews: DataFrame) -> DataFrame:
    """The reviews with the id of a supplied unit vector for each."""
    n = max(table(spark, sf_dir, "embeddings").count(), 1)
    return reviews.withColumn("vector_id", F.col("review_id") % n)


def event_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"error": 1.0, "view": 3.0, "click": 4.0, "purchase": 5.0}
    stars = F.lit(2.0)
    for kind, value in kinds.items():
        stars = F.when(F.col("event_type") == kind, value).otherwise(stars)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("review_id"), "user_id", F.get_json_object("props", "$.k").cast("long").alias("business_id"), stars.alias("stars"), F.col("ts").cast("timestamp").alias("date"))


def event_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_reviews(spark, sf_dir).groupBy("user_id").agg(F.min("date").alias("yelping_since"))


def scored_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as business_id", "1.0d + floor((l_quantity - 1) / 10) as stars", "l_discount * 10 as p_fake")


# The same views in SQL.
SQL = """
businesses as (select s_suppkey as business_id, s_name as name, concat(cast(s_suppkey as varchar), ' Main St') as address, concat('City', cast(s_suppkey % 7 as varchar)) as city,
  concat('S', cast(s_nationkey as varchar)) as state, case when s_suppkey % 3 = 0 then 'Bars, Food' else 'Food' end as categories, 1.0e0 + 0.5e0 * (s_suppkey % 9) as stars, 5 + s_suppkey % 60 as review_count from supplier),
users as (select c_custkey as user_id, c_name as name, c_custkey % 30 as review_count, c_custkey % 7 as fans, c_custkey % 3 as compliment_photos, 1.0e0 + 0.5e0 * (c_custkey % 9) as average_stars,
  case when c_custkey % 4 = 0 then 'None' else concat(repeat('f,', cast(c_custkey % 25 as int)), 'f') end as friends, timestamp '1994-06-01' + (c_custkey % 1500) * interval '1' day as yelping_since from customer where c_custkey % 211 <> 0),
reviews as (select o_orderkey as review_id, o_custkey as user_id, l.sk as business_id, cast(substr(o_orderpriority, 1, 1) as double) as stars,
  cast(o_orderdate as timestamp) + cast(cast(round(o_totalprice * 100) as bigint) % 86400 as int) * interval '1' second as date
  from orders join (select l_orderkey, min(l_suppkey) as sk from lineitem group by l_orderkey) l on o_orderkey = l.l_orderkey),
texts as (select r.*, d.text from reviews r left join documents d on d.doc_id = r.review_id % (select count(*) from documents)),
vectors as (select r.review_id, r.user_id, r.business_id, e.embedding::double[] as v from reviews r join embeddings e on e.vec_id = r.review_id % (select count(*) from embeddings)),
event_reviews as (select event_id as review_id, user_id, cast(json_extract_string(props, '$.k') as bigint) as business_id,
  case event_type when 'error' then 1.0e0 when 'view' then 3.0e0 when 'click' then 4.0e0 when 'purchase' then 5.0e0 else 2.0e0 end as stars, cast(ts as timestamp) as date from events),
event_users as (select user_id, min(date) as yelping_since from event_reviews group by user_id),
scored as (select l_suppkey as business_id, 1.0e0 + floor((l_quantity - 1) / 10) as stars, l_discount * 10 as p_fake from lineitem)"""


def sql(body: str) -> str:
    """A query over the views; DuckDB computes only those that it names."""
    return f"with {SQL.strip()}\n{body}" if not body.lstrip().startswith(",") else f"with {SQL.strip()}{body}"
