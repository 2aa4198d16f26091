"""Line dedup by distinct-site spread.

A line that many sites show is boilerplate. Each line hash gets a HyperLogLog sketch of the sites it stands on;
sketches are built before the shuffle and merged by aggregation, so a line that every document has costs one sketch a
task. Estimates clear of the threshold decide; lines whose estimate lies within BAND standard errors of it (one site
at least) get an exact distinct count. Every occurrence of a boilerplate line goes, except in the document with the
smallest id that has it, so copied documents leave one whole copy behind.

Lines are split at \\n and compared without the ASCII white space around them. What goes from a text depends on the
text and its id alone.

Defined cases
* null text: stays null, no lines. Blank lines are never boilerplate.
* null site: the line counts, the site does not. Null ids never hold the kept copy unless only null ids have the line.
* repeated rows: alike rows keep alike texts. Several rows of the smallest id all keep the line.
* empty table: no rows. Result columns replace input columns of the same name; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import computed, fresh, shielded, sized_broadcast, text_key, written

MIN_SITES = 10
#: 2^11 registers: a standard error of 2.3 %.
LOG_K = 11
BAND = 4.0


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\n\x0b\x0c\r"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hash(line: Column) -> Column:
    """Null for a blank line."""
    return F.when(_trimmed(line) != "", F.xxhash64(_trimmed(line)))


def exploded(docs: DataFrame, id_col: str, text_col: str, *more: Column, places: bool = False) -> DataFrame:
    """A row for each line hash of a text; with places one for each line, with its number from 0 as at."""
    hashes = F.transform(_lines(F.col("_text")), _hash)
    own = computed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"), *more), hashes=hashes if places else F.array_distinct(hashes))
    own = computed(own, key=text_key(F.col("_text"))).drop("_text")
    each = F.posexplode("hashes").alias("at", "hash") if places else F.explode("hashes").alias("hash")
    return own.select("id", "key", *[c for c in own.columns if c not in ("id", "key", "hashes")], each).filter("hash is not null")


def boilerplate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, log_k: int = LOG_K) -> DataFrame:
    """hash, keeper (the smallest id that has the line) and sites (estimate, or exact near the threshold) of every boilerplate line."""
    lines = exploded(docs, id_col, text_col, F.col(site_col).cast("string").alias("site"))
    sketched = lines.groupBy("hash").agg(F.hll_sketch_agg("site", F.lit(log_k)).alias("sketch"), F.count(F.lit(1)).alias("n"), F.min("id").alias("keeper"))
    margin = max(1, math.ceil(BAND * 1.04 / math.sqrt(1 << log_k) * min_sites))
    spread = sketched.filter(F.col("n") >= min_sites).select("hash", "keeper", F.hll_sketch_estimate("sketch").alias("estimate"))
    spread = written(spread.filter(F.col("estimate") >= min_sites - margin), "line-spread")
    clear = spread.filter(F.col("estimate") > min_sites + margin).select("hash", "keeper", F.col("estimate").alias("sites"))
    near = spread.filter(F.col("estimate") <= min_sites + margin)
    pairs = lines.join(sized_broadcast(near.select("hash"), 24), "hash").select("hash", "site").distinct()
    exact = pairs.groupBy("hash").agg(F.count("site").alias("sites")).filter(F.col("sites") >= min_sites)
    return clear.union(exact.join(near, "hash").select("hash", "keeper", "sites"))


def drop_boilerplate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, log_k: int = LOG_K) -> DataFrame:
    """The documents with cleaned texts, n_lines and n_removed."""
    bad = written(boilerplate(docs, id_col=id_col, text_col=text_col, site_col=site_col, min_sites=min_sites, log_k=log_k).select("hash", "keeper"), "boilerplate")
    hits = exploded(docs, id_col, text_col, places=True).join(sized_broadcast(bad, 40), "hash").filter(~F.col("id").eqNullSafe(F.col("keeper")))
    key, gone, fkey, fid, left = (fresh(docs.columns, f"_line_{n}") for n in ("key", "gone", "found_key", "found_id", "left"))
    # rows alike in id and text have the same lines; the set is at most one text's lines
    hits = written(hits.groupBy("id", "key").agg(F.collect_set("at").alias(gone)).select(F.col("id").alias(fid), F.col("key").alias(fkey), gone), "line-hits")
    keyed = computed(docs, **{key: text_key(F.col(text_col))})
    found = keyed.join(sized_broadcast(hits, 80, F.size(gone) * 4), keyed[id_col].eqNullSafe(hits[fid]) & (keyed[key] == hits[fkey]), "left")
    # array_except goes by a hash set, so a text of many lines costs no more a line than a short one
    lines = _lines(F.col(text_col))
    found = computed(found, **{left: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce(gone, F.array().cast("array<int>"))), "n_lines": F.when(F.col(text_col).isNotNull(), F.size(lines)).otherwise(0).cast("long")})
    kept = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    out = computed(found, n_removed=F.when(F.col(gone).isNotNull(), F.col("n_lines") - F.size(left)).otherwise(0).cast("long"), **{text_col: F.when(F.col(gone).isNotNull(), kept).otherwise(F.col(text_col))})
    order = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return out.select(*order, "n_lines", "n_removed")


def clean_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, log_k: int = LOG_K) -> DataFrame:
    """The documents with cleaned texts and their own columns alone."""
    own, restored = shielded(docs, id_col, text_col, site_col)
    return restored(drop_boilerplate(own, id_col=id_col, text_col=text_col, site_col=site_col, min_sites=min_sites, log_k=log_k))
