"""Language identification: multinomial naive Bayes over hashed character n-grams.

Every labelled training text is counted: a task adds up its texts' n-grams by language and bucket, Spark adds up the
tasks. The counts become one matrix of log probabilities, buckets by languages, which is broadcast; its size is bounded
by MATRIX_CELLS, since the number of buckets shrinks as languages are added. Texts are scored whole and in batches:
n-gram hashes are rolled over the characters in numpy, equal buckets of a text are counted once, and a batch's counts are
one sparse matrix of texts by buckets (row starts, buckets, counts) that meets the matrix rows that it names.

Defined cases
* null text, or text without any letter: `und`, score 0.
* null language: not learned from. Nothing to learn from at all: `und`, score 0 for every text.
* more than 128 languages: with each doubling of their number half as many buckets. More than 32768: ValueError, as an
  n-gram model of under 256 buckets would tell nothing.
* one language: predicted for every text with a letter, score 1.
* ties: the language that sorts first. Repeated rows count and are returned as often as they stand.
* empty table: no rows. Only the id is carried over, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERS = (1, 2, 3)
#: Cells of the matrix: 32 MB as 32-bit floats. More languages get fewer buckets.
MATRIX_CELLS = 1 << 23
MAX_BUCKETS = 1 << 16
#: Characters hashed at a time.
SLAB = 1 << 20
#: Texts scored at a time.
TEXTS = 256
UNKNOWN = "und"

_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_probability: np.ndarray  # buckets x languages
    log_prior: np.ndarray
    orders: tuple[int, ...]


def bucket_counts(text: str, buckets: int, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's character n-grams and how often each occurs. The text is lower-cased, white space counts as one space."""
    codes = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    shift = np.uint64(64 - buckets.bit_length() + 1)
    total = None
    for s in range(0, len(codes), SLAB):
        part = codes[s : s + SLAB + max(orders) - 1]
        found = []
        rolled = np.zeros(len(part), np.uint64)
        for n in range(1, max(orders) + 1):
            rolled = (rolled[: len(part) - n + 1] * np.uint64(0x100000001B3)) + part[n - 1 :] + np.uint64(n)
            if n in orders:
                found.append((rolled[:SLAB] * _MIX) >> shift)
        got = np.unique(np.concatenate(found), return_counts=True)
        if total is None:
            total = got
        else:
            at, inverse = np.unique(np.concatenate([total[0], got[0]]), return_inverse=True)
            total = at, np.bincount(inverse, np.concatenate([total[1], got[1]])).astype(np.int64)
    return total[0].astype(np.int64), total[1]


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", orders: tuple[int, ...] = ORDERS, max_buckets: int = MAX_BUCKETS) -> LanguageModel | None:
    """Learns from all rows with a text and a language; None if there are none."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    priors = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MATRIX_CELLS // 256 + 1).collect()}
    if not priors:
        return None
    if len(priors) > MATRIX_CELLS // 256:
        raise ValueError(f"more than {MATRIX_CELLS // 256} languages")
    languages = tuple(sorted(priors))
    buckets = max_buckets
    while buckets * len(languages) > MATRIX_CELLS:
        buckets //= 2
    place = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                at, n = bucket_counts(text.as_py(), buckets, orders)
                total.setdefault(place[lang.as_py()], np.zeros(buckets, np.int64))[at] += n
        for lang, sums in total.items():
            at = np.nonzero(sums)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), lang, np.int32)), pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["lang", "bucket", "n"])

    counted = rows.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most MATRIX_CELLS rows
    matrix = np.ones((buckets, len(languages)))
    matrix[counted["bucket"].to_numpy(), counted["lang"].to_numpy()] += counted["n"].to_numpy()
    prior = np.array([priors[x] for x in languages], float)
    return LanguageModel(languages, np.log(matrix / matrix.sum(axis=0)).astype(np.float32), np.log(prior / prior.sum()), orders)


def log_posterior(texts: list[str], model: LanguageModel) -> np.ndarray:
    """Texts by languages, up to a constant a text: the prior, and the sparse counts times the log probabilities, SLAB cells of the product at a time."""
    out = np.tile(model.log_prior, (len(texts), 1))
    found = [bucket_counts(t, len(model.log_probability), model.orders) for t in texts]
    starts = np.cumsum([0, *[len(at) for at, _ in found]])
    buckets, counts = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    step = max(1, SLAB // len(model.languages))
    for a in range(0, len(buckets), step):
        b = min(a + step, len(buckets))
        first = int(np.searchsorted(starts, a, "right")) - 1
        last = int(np.searchsorted(starts, b, "left"))
        cells = model.log_probability[buckets[a:b]].astype(np.float64) * counts[a:b, None]
        out[first:last] += np.add.reduceat(cells, np.maximum(starts[first:last], a) - a)
    return out


def predict_texts(texts: list[str], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Languages and their posterior probabilities."""
    log = log_posterior(texts, model)
    best = log.argmax(axis=1)
    return [model.languages[k] for k in best], 1 / np.exp(log - log.max(axis=1, keepdims=True)).sum(axis=1)


def predict(docs: DataFrame, model: LanguageModel | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, lang_pred and score (the posterior probability) of every row."""
    schema = T.StructType([docs.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    rows = docs.select(F.col(id_col), F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).alias("_text"))
    if model is None:
        return rows.select(id_col, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = np.flatnonzero(batch.column(1).is_valid().to_numpy(zero_copy_only=False))
            langs, scores = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            for part in np.array_split(told, 1 + len(told) // TEXTS):
                if len(part):
                    langs[part], scores[part] = predict_texts([batch.column(1)[int(i)].as_py() for i in part], shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)], names=schema.names)

    return rows.mapInArrow(run, schema)
