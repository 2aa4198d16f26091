"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.sources.staging import BROADCAST_BYTES as BROADCAST_BYTES
from candor.sources.staging import new_path as new_path
from candor.sources.staging import shared_dir as shared_dir
from candor.sources.staging import sized_broadcast as sized_broadcast
from candor.sources.staging import written as written

#: Of an Arrow batch of texts.
TEXT_BYTES = 4 * 1024 * 1024

#: ASCII white space, the only characters that separate words in most contracts.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released() -> None:
    """Gives back what a worker has freed, of Arrow's memory and the allocator's where there is a call for it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def fresh(taken: list[str], name: str) -> str:
    """A column name that no column has, in any case of its letters."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; lower() would also fold other letters."""
    return F.translate(text, _UPPER, _UPPER.lower())


def doc_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def text_key(text: Column) -> Column:
    """128 bits that stand for a whole text: equal texts have equal results, so work is done once a text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns, replacing those of the same name, as the output of a generator of one row.

    Unlike a projection, a generator is never merged into what uses it, so costly columns are made once a row
    even if a filter on them is pushed down or a lambda refers to them.
    """
    new = {c.lower() for c in columns}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in new], F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def shielded(df: DataFrame, *keep: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The frame with all columns but `keep` under names that no result can clash with, and what gives them their names back."""
    low = {c.lower() for c in keep}
    hidden = {c: c if c.lower() in low else fresh(df.columns, f"_own_{i}") for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(h) for c, h in hidden.items()]), lambda out: out.select(*[F.col(h).alias(c) for c, h in hidden.items()])
