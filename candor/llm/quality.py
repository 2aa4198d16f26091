"""Quality rules: a hashed n-gram log-likelihood ratio behind a few base rules.

Two multinomials over hashed word unigrams and bigrams are counted: one over the documents that a trusted
label marks as target, one over the whole raw corpus. A document's score is the mean over its n-grams of
log(target probability / raw probability), so length does not matter. The threshold is fixed before any
document is judged: SPREAD standard deviations under the mean score of the target documents themselves, which
keeps what looks like the target and does not depend on the order of rows.

Everything is DataFrame expressions; the only data that reaches the driver is one count pair per bucket.

Defined cases
* null text: no words, score null, base rules fail (fewer than MIN_WORDS words), not kept.
* empty text, or white space alone: as null text.
* no target label at all: no ratio can be learned, the base rules alone decide.
* a single target, or targets of one score: the threshold is that score, rounded down to six digits; ties with it stay.
* repeated rows: each counts and each is judged; several labels for one id: it is target if any row is.
* result columns replace input columns of the same name; other columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, computed, fresh, shielded, sized_broadcast

#: Hash buckets of the multinomials. Two counts each, so at most 256 KB reach the driver.
BUCKETS = 1 << 14
#: Standard deviations under the target's mean score at which documents go.
SPREAD = 5.0
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = r"[#*$%&|<>]"

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class RatioModel:
    """Log ratio by bucket, and the score under which a document is rejected."""

    weights: tuple[float, ...]
    threshold: float

    def column(self) -> Column:
        # split() and the cast fold to one literal array, where array() would plan one node a bucket
        return F.split(F.lit(",".join(map(repr, self.weights))), ",").cast("array<double>")


def _hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def _buckets(h: Column, buckets: int) -> Column:
    """Buckets of all unigrams and bigrams of the word hashes."""
    rest = F.greatest(F.size(h) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(h, F.lit(1), rest), F.slice(h, F.lit(2), rest), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)))
    return F.concat(F.transform(h, lambda x: F.pmod(x, F.lit(buckets))), pairs)


def _mean_ratio(grams: Column, weights: Column) -> Column:
    total = F.aggregate(grams, F.lit(0.0), lambda acc, b: acc + F.get(weights, b.cast("int")))
    return F.round(total / F.when(F.size(grams) > 0, F.size(grams)), 9)


def fit_ratio(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, spread: float = SPREAD) -> RatioModel | None:
    """Counts both multinomials over all documents; None if no document is labelled as target (quality 1, not toxic)."""
    target = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col(id_col).isNotNull())
    target = target.select(F.col(id_col).alias("_id"), F.lit(1).alias("_target")).distinct()
    target = sized_broadcast(target, 40)
    marked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(target, "_id", "left")
    hashed = computed(marked, _h=_hashes(F.col("_text"))).drop("_text")
    grams = hashed.select(F.explode(_buckets(F.col("_h"), buckets)).alias("b"), "_target")
    counted = grams.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.count("_target").alias("t")).collect()
    raw, own = [1] * buckets, [1] * buckets
    for b, n, t in counted:
        raw[b] += n
        own[b] += t
    if sum(own) == buckets:
        return None
    all_raw, all_own = math.log(sum(raw)), math.log(sum(own))
    model = RatioModel(tuple(round(math.log(o) - all_own - math.log(r) + all_raw, 9) for o, r in zip(own, raw, strict=True)), 0.0)
    own_docs = computed(hashed.filter(F.col("_target") == 1), _g=_buckets(F.col("_h"), buckets))
    mean, sd = own_docs.select(_mean_ratio(F.col("_g"), model.column()).alias("s")).agg(F.avg("s"), F.stddev_pop("s")).first()
    # rounded down, so that targets of one score pass their own threshold
    return RatioModel(model.weights, math.floor(((mean or 0.0) - spread * (sd or 0.0)) * 1e6) / 1e6)


def _repeat_words(ordered: Column) -> Column:
    """Words that lie in a window found twice or more. ordered: the windows as (hash, place), sorted."""
    n = F.size(ordered)
    same = lambda i, j: F.get(ordered, i)["h"] == F.get(ordered, j)["h"]
    places = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.when(F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)), F.get(ordered, k)["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(
        F.array_sort(F.filter(places, lambda p: p.isNotNull())), start,
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")), lambda acc: acc["n"],
    )
    return F.when(n > 0, covered).otherwise(0)


def judge(docs: DataFrame, model: RatioModel | None, *, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """The documents with the base statistics, base_failed, score and kept."""
    taken = docs.columns
    words, lines, hashes, windows, grams, ordered = (fresh(taken, f"_q_{n}") for n in ("words", "lines", "hashes", "windows", "grams", "ordered"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = computed(docs, **{words: F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lines: F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long")})
    out = computed(out, **{
        "n_words": F.size(words).cast("long"), "word_chars": F.length(F.array_join(F.col(words), "")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(F.col(lines)))).cast("long"), hashes: F.transform(F.col(words), lambda w: F.xxhash64(w)),
    }).drop(words, lines)
    h = F.col(hashes)
    triple = F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))
    out = computed(out, **{windows: F.when(F.size(h) >= 3, triple).otherwise(F.array().cast("array<bigint>")), grams: _buckets(h, buckets)}).drop(hashes)
    w = F.col(windows)
    repeats = F.size(F.array_distinct(w)) < F.size(w)
    places = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    out = computed(out, **{ordered: F.when(repeats, places).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))}).drop(windows)
    score = _mean_ratio(F.col(grams), model.column()) if model else F.lit(None).cast("double")
    out = computed(out, n_repeat_words=_repeat_words(F.col(ordered)).cast("long"), score=score).drop(ordered, grams)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    verdict = F.coalesce(F.col("score") >= model.threshold, F.lit(False)) if model else F.lit(True)
    return out.withColumn("kept", ~F.col("base_failed") & verdict)


def quality_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, spread: float = SPREAD) -> DataFrame:
    """Learns the ratio from docs and labels, and judges every document."""
    return judge(docs, fit_ratio(docs, labels, id_col=id_col, text_col=text_col, buckets=buckets, spread=spread), text_col=text_col, buckets=buckets)


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, spread: float = SPREAD) -> DataFrame:
    """The documents that are kept, with their own columns alone."""
    own, restored = shielded(docs, id_col, text_col)
    return restored(quality_rules(own, labels, id_col=id_col, text_col=text_col, buckets=buckets, spread=spread).filter("kept"))
