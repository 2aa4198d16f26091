"""Trust-adjusted ratings: every review counts with the probability that it is genuine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.functions.stats import histogram_bin, rating_interval
from candor.operators.metrics import exact_quantiles

PRIOR_WEIGHT = 10.0
FLAG_ABOVE = 0.5


class RowMismatch(ValueError):
    pass


def join_scores(predictions: DataFrame, features: DataFrame) -> DataFrame:
    """One row a review; raises if a side has rows that the other lacks."""
    joined = features.select("review_id", "business_id", "stars").join(predictions.select("review_id", "p_fake"), "review_id")
    a, b, both = predictions.count(), features.count(), joined.count()
    if not a == b == both:
        raise RowMismatch(f"{a} predictions and {b} feature rows share {both}")
    return joined


def global_trust_mean(reviews: DataFrame) -> DataFrame:
    """One row: the trust-weighted mean rating, or the plain mean where nothing is trusted."""
    trust = 1 - F.col("p_fake")
    total = F.sum(trust)
    return reviews.agg(F.when(total > 0, F.sum(F.col("stars") * trust) / F.when(total > 0, total)).otherwise(F.avg("stars")).alias("global_mean"))


def score_businesses(reviews: DataFrame, prior_weight: float = PRIOR_WEIGHT) -> DataFrame:
    """Per business: counts, plain mean, the rating shrunk towards the global mean, and its interval.

    The reviews are read once: the global mean is that of the businesses' sums. It is one row, so joining it without a
    key multiplies nothing.
    """
    trust, flag = 1 - F.col("p_fake"), (F.col("p_fake") > FLAG_ABOVE).cast("long")
    sums = reviews.groupBy("business_id").agg(
        F.count(F.lit(1)).alias("n_reviews"), F.avg("stars").alias("naive_mean"), F.sum(F.col("stars") * trust).alias("_weighted"), F.sum("stars").alias("_stars"), F.count("stars").alias("_rated"),
        F.sum(trust).alias("n_eff"), F.sum(flag).alias("n_flagged"),
    )
    total = F.sum("n_eff")
    mean = sums.agg(F.when(total > 0, F.sum("_weighted") / F.when(total > 0, total)).otherwise(F.sum("_stars") / F.sum("_rated")).alias("global_mean"))
    scored = sums.join(F.broadcast(mean))  # one row
    rrs = (F.col("_weighted") + prior_weight * F.col("global_mean")) / (F.col("n_eff") + prior_weight)
    scored = scored.withColumn("rrs", rrs)
    low, high = rating_interval(F.col("rrs"), F.col("n_eff"))
    return scored.select(
        "business_id", "n_reviews", "naive_mean", "rrs", (F.col("rrs") - F.col("naive_mean")).alias("rrs_delta"), low.alias("rrs_ci_low"), high.alias("rrs_ci_high"), "n_eff",
        (F.col("n_flagged") / F.col("n_reviews")).alias("pct_flagged"), "n_flagged", (F.col("n_reviews") - F.col("n_flagged")).alias("n_authentic_reviews"), "global_mean",
    )


def largest_downward(scores: DataFrame, n: int = 15, least_reviews: int = 20) -> DataFrame:
    return scores.filter(F.col("n_reviews") >= least_reviews).orderBy("rrs_delta", "business_id").limit(n)


def distribution(scores: DataFrame) -> DataFrame:
    """One row: mean, quantiles, mean size of the change, and the median share flagged."""
    both = scores.agg(F.count(F.lit(1)).alias("n_businesses"), F.avg("rrs").alias("mean_rrs"), F.avg(F.abs("rrs_delta")).alias("mean_abs_delta"))
    parts = [both, exact_quantiles(scores, "rrs", {f"p{round(q * 100):02d}": q for q in (0.05, 0.25, 0.5, 0.75, 0.95)}, 1.0, 5.0), exact_quantiles(scores, "pct_flagged", {"median_pct_flagged": 0.5})]
    return parts[0].join(F.broadcast(parts[1])).join(F.broadcast(parts[2]))  # each is one row


def fake_histogram(reviews: DataFrame, bins: int = 10) -> DataFrame:
    """Reviews by tenth of p_fake; unknown ones are left out."""
    return reviews.select(histogram_bin(F.col("p_fake"), bins).alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
