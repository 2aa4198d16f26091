"""Markdown reports from small aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.functions.text import snippet
from candor.operators import labeling, metrics, scoring
from candor.plans import profile


def table(df: DataFrame, digits: int = 3, most: int = 200) -> str:
    """A Markdown table of a small frame."""
    show = lambda v: "" if v is None else f"{v:,.{digits}f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v)
    rows = [df.columns, ["---"] * len(df.columns), *[[show(v).replace("|", "\\|") for v in r] for r in df.limit(most).collect()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def _document(title: str, sections: dict[str, str]) -> str:
    return "\n\n".join([f"# {title}", *[f"## {name}\n\n{body}" for name, body in sections.items()]]) + "\n"


def profile_report(title: str, businesses: DataFrame, reviews: DataFrame, users: DataFrame, **others: DataFrame) -> str:
    return _document(title, {
        "Overview": table(profile.overview(businesses=businesses, reviews=reviews, users=users, **others)),
        "Where": table(profile.geo_breakdown(businesses)), "Cities": table(profile.top_cities(businesses)), "When": table(profile.date_range(reviews)),
        "Reviews per user": table(profile.reviews_per_user(reviews)), "Reviews per business": table(profile.reviews_per_business(reviews)), "Ratings": table(profile.rating_distribution(reviews).orderBy("stars")),
        "Years": table(profile.reviews_per_year(reviews).orderBy("year")), "Text length": table(profile.review_length(reviews)), "Account age": table(profile.account_age_buckets(users).orderBy("account_age")),
        "Chart: users by number of reviews": table(profile.reviews_per_user_histogram(reviews).orderBy("reviews")),
    })


def audit_report(title: str, voted: DataFrame, labels: DataFrame, reviews: DataFrame, n: int = 100) -> str:
    """What the rules did, and the most suspicious reviews to read."""
    p = F.col("p_suspicious").cast("double")
    spread = labels.agg(F.avg((p > 0.5).cast("double")).alias("share_flagged")).join(F.broadcast(metrics.exact_quantiles(labels, "p_suspicious", {f"p{round(100 * q)}": q for q in (0.5, 0.9, 0.99)})))  # each is one row
    silent = voted.agg(F.sum(labeling.all_abstain(voted).cast("long")).alias("all_abstain"))
    top = labels.select("review_id", p.alias("p_suspicious")).orderBy(F.desc("p_suspicious"), "review_id").limit(n).join(reviews.select("review_id", "stars", snippet(F.col("text")).alias("text")), "review_id").orderBy(F.desc("p_suspicious"), "review_id")
    return _document(title, {"Labels": table(spread), "Rules": table(labeling.summary(voted)), "Silent rows": table(silent), "Most suspicious": table(top)})


def model_report(title: str, quality: DataFrame, importances: list[tuple[str, float, int]], injection: DataFrame, verdict: str) -> str:
    gains = "\n".join(["| feature | gain | splits |", "| --- | --- | --- |", *[f"| {f} | {g:.4f} | {s} |" for f, g, s in importances]])
    return _document(title, {"Metrics": table(quality, 4), "Importances": gains, "Injection": table(injection, 4), "Ablation": verdict})


def score_report(title: str, scores: DataFrame) -> str:
    return _document(title, {"Distribution": table(scoring.distribution(scores)), "Largest downward adjustments": table(scoring.largest_downward(scores))})

