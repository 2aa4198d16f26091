"""From newline-delimited JSON to the metro's tables.

Reviews, tips and check-ins are reduced by a semi join with the metro's businesses, users by one with the reviews that
were kept. Each table is a full refresh, clustered by business so that row-group statistics serve key lookups.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, TimestampType

from candor.config import Metro
from candor.schemas import TABLES, TIMESTAMP_FORMAT

#: The dataset's file names.
FILES = {"businesses": "business", "reviews": "review", "users": "user", "tips": "tip", "checkins": "checkin"}


class MissingInput(FileNotFoundError):
    pass


class EmptyMetro(ValueError):
    pass


def reader_options(schema: StructType) -> dict[str, str]:
    """The timestamp format, only where a timestamp is declared."""
    return {"timestampFormat": TIMESTAMP_FORMAT} if any(isinstance(f.dataType, TimestampType) for f in schema) else {}


def read_ndjson(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).options(**reader_options(schema)).json(path)
    except AnalysisException as e:
        raise MissingInput(path) from e


def read_table(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise MissingInput(path) from e


def metro_businesses(businesses: DataFrame, metro: Metro) -> DataFrame:
    return businesses.filter(metro.predicate())


def of_businesses(rows: DataFrame, businesses: DataFrame) -> DataFrame:
    """Rows of the kept businesses. Spark broadcasts their ids where their size allows."""
    return rows.join(businesses.select("business_id"), "business_id", "left_semi").select(*rows.columns)


def of_authors(users: DataFrame, reviews: DataFrame) -> DataFrame:
    """Users who wrote a kept review."""
    return users.join(reviews.select("user_id").distinct(), "user_id", "left_semi").select(*users.columns)


def refresh(df: DataFrame, path: str, cluster: str | None = None) -> int:
    """Replaces the table and returns its row count. With cluster: ranges of that key, sorted, in few files."""
    laid = df.repartitionByRange(F.col(cluster)).sortWithinPartitions(cluster) if cluster else df
    laid.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path).count()


def stamp(spark: SparkSession, metro: Metro) -> DataFrame:
    """One row: which metro the tables hold, and when they were loaded."""
    return spark.createDataFrame([(metro.key, metro.name)], "metro string, name string").withColumn("loaded_at", F.current_timestamp())


def metro_label(meta: DataFrame | None) -> str:
    """The metro's name for file names; unknown without a stamp."""
    row = meta.select("name").limit(1).first() if meta is not None else None
    return row["name"].lower().replace(" ", "_") if row and row["name"] else "unknown"


def ingest(spark: SparkSession, raw: str, out: str, metro: Metro) -> dict[str, int]:
    source = {t: read_ndjson(spark, f"{raw}/yelp_academic_dataset_{FILES[t]}.json", schema) for t, schema in TABLES.items()}
    counts = {"businesses": refresh(metro_businesses(source["businesses"], metro), f"{out}/businesses", "business_id")}
    if not counts["businesses"]:
        raise EmptyMetro(metro.key)
    businesses = read_table(spark, f"{out}/businesses")
    for name in ("reviews", "tips", "checkins"):
        counts[name] = refresh(of_businesses(source[name], businesses), f"{out}/{name}", "business_id")
    counts["users"] = refresh(of_authors(source["users"], read_table(spark, f"{out}/reviews")), f"{out}/users", "user_id")
    refresh(stamp(spark, metro), f"{out}/meta")
    return counts


def loaded_at(meta: DataFrame) -> datetime:
    return meta.first()["loaded_at"]
