"""The registered queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.config import Metro
from candor.functions import stats, text
from candor.operators import behaviour, enrich, features, labeling, metrics, model, scoring, similarity
from candor.plans import profile, serving
from candor.operators.signals import with_signals
from candor.sources import adapters, ingest
from candor.sources.staging import written

SNAPSHOT = "1999-01-01"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as floats add up in no fixed order, but for shares of counts, which are exact; whole numbers as longs."""
    kinds = dict(df.dtypes)
    fix = {"double": lambda c: F.round(c, digits), "float": lambda c: F.round(c.cast("double"), digits), "int": lambda c: c.cast("long"), "tinyint": lambda c: c.cast("long")}
    return df.select(*[F.col(c) if c == "pct_flagged" else fix.get(kinds[c], lambda x: x)(F.col(c)).alias(c) for c in df.columns])


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score_businesses(adapters.scored_reviews(spark, d))


@query
def rrs_scores(spark, d):
    return rounded(_scores(spark, d))


@query
def global_trust_mean(spark, d):
    return rounded(scoring.global_trust_mean(adapters.scored_reviews(spark, d)))


@query
def rrs_top_downward(spark, d):
    s = rounded(_scores(spark, d))  # rounded first, so equal changes tie on both sides
    return scoring.largest_downward(s).select("business_id", "n_reviews", "naive_mean", "rrs", "rrs_delta")


@query
def rrs_distribution(spark, d):
    return rounded(scoring.distribution(_scores(spark, d)))


@query
def pfake_histogram(spark, d):
    return rounded(scoring.fake_histogram(adapters.scored_reviews(spark, d)))


@query
def overview(spark, d):
    return profile.overview(businesses=adapters.businesses(spark, d), reviews=adapters.reviews(spark, d), users=adapters.users(spark, d))


@query
def geo_breakdown(spark, d):
    return profile.geo_breakdown(adapters.businesses(spark, d))


@query
def top_cities(spark, d):
    return profile.top_cities(adapters.businesses(spark, d))


@query
def date_range(spark, d):
    return profile.date_range(adapters.reviews(spark, d))


@query
def reviews_per_user(spark, d):
    return rounded(profile.reviews_per_user(adapters.reviews(spark, d)))


@query
def reviews_per_business(spark, d):
    return rounded(profile.reviews_per_business(adapters.reviews(spark, d)))


@query
def rating_distribution(spark, d):
    return profile.rating_distribution(adapters.reviews(spark, d)).withColumn("pct", F.col("pct").cast("double"))


@query
def reviews_per_year(spark, d):
    return profile.reviews_per_year(adapters.reviews(spark, d))


@query
def review_length(spark, d):
    return rounded(profile.review_length(adapters.reviews(spark, d, text=True)))


@query
def account_age_buckets(spark, d):
    return rounded(profile.account_age_buckets(adapters.users(spark, d), "1996-06-01"))


@query
def reviews_per_user_hist(spark, d):
    return profile.reviews_per_user_histogram(adapters.reviews(spark, d), 15)


METRO = Metro("demo", "Demo", ("S1", "S2", "S3", "S4", "S5"), ("City1", "City2", "City3"))


@query
def metro_filter(spark, d):
    return ingest.metro_businesses(adapters.businesses(spark, d), METRO).select("business_id", "city", "state")


@query
def semi_join_reviews(spark, d):
    kept = ingest.metro_businesses(adapters.businesses(spark, d), METRO)
    return ingest.of_businesses(adapters.reviews(spark, d), kept)


@query
def semi_join_users(spark, d):
    kept = ingest.metro_businesses(adapters.businesses(spark, d), METRO)
    return ingest.of_authors(adapters.users(spark, d), ingest.of_businesses(adapters.reviews(spark, d), kept)).select("user_id", "name", "review_count")


@query
def burst_days(spark, d):
    return behaviour.burst_days(adapters.reviews(spark, d))


@query
def burst_days_events(spark, d):
    return behaviour.burst_days(adapters.event_reviews(spark, d))


@query
def context_features(spark, d):
    return rounded(behaviour.context_features(adapters.reviews(spark, d), adapters.businesses(spark, d), adapters.users(spark, d)))


@query
def user_gap_stats(spark, d):
    return rounded(behaviour.gap_stats(adapters.reviews(spark, d)))


@query
def first_week_counts(spark, d):
    return behaviour.first_week(adapters.reviews(spark, d), adapters.users(spark, d))


@query
def first_week_counts_events(spark, d):
    return behaviour.first_week(adapters.event_reviews(spark, d), adapters.event_users(spark, d))


@query
def reviewer_features(spark, d):
    return rounded(behaviour.reviewer_features(adapters.reviews(spark, d, text=True), adapters.users(spark, d), SNAPSHOT))


@query
def posting_hour_entropy(spark, d):
    return rounded(behaviour.hour_entropy(adapters.reviews(spark, d)))


@query
def friend_count(spark, d):
    return adapters.users(spark, d).select("user_id", text.friend_count(F.col("friends")).cast("long").alias("friend_count"))


@query
def text_features(spark, d):
    docs = adapters.table(spark, d, "documents")
    return rounded(docs.select("doc_id", *[c.alias(n) for n, c in text.features(F.col("text")).items()]))


@query
def flesch(spark, d):
    return rounded(adapters.table(spark, d, "documents").select("doc_id", text.flesch(F.col("text")).alias("flesch_reading_ease")))


@query
def caps_excl_ratio(spark, d):
    docs, body = adapters.table(spark, d, "conversations"), F.coalesce("text", F.lit(""))
    n = F.length(body)
    return rounded(docs.select("conv_id", "turn", F.regexp_count(body, F.lit("!")).alias("exclamation_count"), stats.ratio(F.regexp_count(body, F.lit("[A-Z]")).cast("double"), n).alias("caps_ratio")))


@query
def account_age_elapsed(spark, d):
    joined = adapters.reviews(spark, d).join(adapters.users(spark, d).select("user_id", "yelping_since"), "user_id")
    since, date = F.col("yelping_since"), F.col("date")
    return joined.select("review_id", stats.days_elapsed(since, date).cast("long").alias("days_elapsed"), stats.days_crossed(since, date).cast("long").alias("days_crossed"))


@query
def dup_text_max_sim(spark, d):
    return rounded(similarity.text_similarity(adapters.table(spark, d, "documents"), "source", "doc_id"), 5)


@query
def embedding_max_sim_label(spark, d):
    return rounded(similarity.vector_similarity(adapters.table(spark, d, "embeddings"), "label", "vec_id", "embedding"), 5)


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    """The reviews with the ids of their texts, written once: every family of signals reads them again."""
    return written(adapters.referring_reviews(spark, d), "reviews")


def _enriched(spark: SparkSession, d: str, reviews: DataFrame | None = None) -> DataFrame:
    reviews = _reviews(spark, d) if reviews is None else reviews
    texts = adapters.texts(spark, d)
    rows = enrich.with_copies(reviews, reviews, texts)
    out = enrich.enriched(reviews, adapters.businesses(spark, d), adapters.users(spark, d), texts, rows, friends=False)
    return out.select(*[c for c in out.columns if c != "max_dup_sim"], "max_dup_sim")


@query
def enriched_reviews(spark, d):
    return rounded(_enriched(spark, d))


@query
def lf_votes(spark, d):
    return rounded(labeling.votes(_enriched(spark, d)))


@query
def lf_coverage(spark, d):
    return rounded(labeling.coverage(labeling.votes(_enriched(spark, d))))


@query
def lf_summary(spark, d):
    return rounded(labeling.summary(labeling.votes(_enriched(spark, d))))


@query
def majority_vote(spark, d):
    return labeling.majority(labeling.votes(_enriched(spark, d)))


#: A model with given parameters, so that its scores can be checked against SQL.
FIXED_MODEL = labeling.LabelModel(tuple(labeling.NAMES), tuple(((0.1 + 0.03 * i, 0.5 - 0.02 * i), (0.4 - 0.02 * i, 0.05 + 0.03 * i)) for i in range(len(labeling.NAMES))))


@query
def label_model_scores(spark, d):
    return rounded(labeling.votes(_enriched(spark, d)).select("review_id", FIXED_MODEL.probability().alias("p_suspicious")))


@query
def label_model_fitted(spark, d):
    voted = written(labeling.votes(_enriched(spark, d)), "votes")  # read once to fit and once to score
    return labeling.weak_labels(voted, labeling.fit_label_model(labeling.overlaps(voted)))


def _features(spark: SparkSession, d: str, reviews: DataFrame | None = None, riding: tuple[str, ...] = ()) -> DataFrame:
    reviews = _reviews(spark, d) if reviews is None else reviews
    reviews = adapters.with_vector_ids(spark, d, reviews)
    return features.feature_table(reviews, adapters.businesses(spark, d), adapters.users(spark, d), SNAPSHOT, texts=adapters.texts(spark, d), vectors=adapters.vectors(spark, d), riding=riding)


@query
def feature_table(spark, d):
    """Without sentiment, whose scorer SQL cannot express."""
    return rounded(_features(spark, d).drop(*features.SENTIMENT))


@query
def feature_table_full(spark, d):
    return _features(spark, d)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Features with the fixed model's labels, and whether the rule on copied text found the review suspicious; written once."""
    reviews = _reviews(spark, d)
    voted = written(labeling.votes(_enriched(spark, d, reviews)), "votes")
    joined = features.join_labels(reviews, voted.select("review_id", FIXED_MODEL.probability().alias("p_suspicious")))
    joined = joined.join(voted.select("review_id", (F.col("lf_duplicate_text") == labeling.SUSPICIOUS).cast("byte").alias("copied")), "review_id")
    # labels ride along: joined to the features, all of these would be shuffled once more
    return written(_features(spark, d, written(joined, "labelled-reviews"), ("p_suspicious", "copied")), "labelled")


@query
def time_split_counts(spark, d):
    soft = adapters.reviews(spark, d).withColumn("p_suspicious", (F.col("review_id") % 11) / 10.0)
    parts = features.time_split(soft, "1997-01-01")
    counts = [p.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.sum(F.col("hard_label").cast("long")).alias("positives")) for name, p in zip(("train", "test"), parts, strict=True)]
    return counts[0].unionByName(counts[1])


@query
def hash_sample(spark, d):
    return features.hash_sample(adapters.reviews(spark, d), "review_id", 500)


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """Labels with a made-up score that has many ties."""
    labels = adapters.table(spark, d, "labels")
    return labels.select("doc_id", F.col("quality").alias("y"), ((F.col("doc_id") * 37 % 101 + 20 * F.col("quality")) / 121.0).alias("p"), ((F.col("doc_id") * 13 % 11) / 10.0).alias("soft"))


@query
def roc_auc(spark, d):
    return rounded(metrics.roc_auc(_ranked(spark, d), "p", "y"))


@query
def average_precision(spark, d):
    return rounded(metrics.average_precision(_ranked(spark, d), "p", "y"))


@query
def precision_at_k(spark, d):
    return rounded(metrics.precision_at(_ranked(spark, d), "p", "y", "doc_id", (50, 100)))


@query
def soft_logloss(spark, d):
    return rounded(_ranked(spark, d).agg(metrics.soft_log_loss(F.col("soft"), F.col("p")).alias("soft_logloss")))


@query
def pearson(spark, d):
    return rounded(metrics.pearson(_ranked(spark, d), "soft", "p"))


#: As the phases train without a search: the default trees, and as many rounds as a last fit has at least.
SETTINGS = model.Settings(rounds=model.final_rounds(model.Settings().rounds))


def _trained(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[str], model.SoftModel]:
    train, test = features.time_split(_labelled(spark, d), "1997-01-01")
    chosen = features.feature_columns([c for c in train.columns if c not in ("hard_label", "copied")])
    return train, test, chosen, model.fit(train, chosen, settings=SETTINGS)


@query
def gbt_predictions(spark, d):
    train, test, _, fitted = _trained(spark, d)
    return model.predict(train.unionByName(test), fitted).select("review_id", "p_fake")


@query
def model_metrics(spark, d):
    _, test, _, fitted = _trained(spark, d)
    return model.evaluate(model.predict(test, fitted))


@query
def feature_importance(spark, d):
    *_, fitted = _trained(spark, d)
    return spark.createDataFrame(model.importances(fitted), "feature string, gain_frac double, splits long")


@query
def synthetic_injection(spark, d):
    _, test, _, fitted = _trained(spark, d)
    return model.synthetic_injection(test, fitted)


@query
def ablation(spark, d):
    train, test, chosen, _ = _trained(spark, d)
    return model.ablation(train, test, chosen, SETTINGS)


@query
def shap_topk(spark, d):
    """Mean absolute contribution by feature, over the report's hash sample of 5,000 rows."""
    _, test, chosen, fitted = _trained(spark, d)
    return model.mean_contributions(model.explain(features.hash_sample(test, "review_id", 5000), fitted), chosen)


@query
def top_signals(spark, d):
    """The strongest reasons of 200 reviews in words."""
    _, test, _, fitted = _trained(spark, d)
    return with_signals(features.hash_sample(test, "review_id", 200), fitted).select("review_id", "signals")


@query
def business_reviews_signals(spark, d):
    """A page of reviews with texts and reasons."""
    train, test, _, fitted = _trained(spark, d)
    table = train.unionByName(test)
    return serving.review_page_signals(adapters.businesses(spark, d), adapters.reviews(spark, d, text=True), model.predict(table, fitted), 7, table, fitted, 20, 5)


@query
def search_businesses(spark, d):
    return rounded(serving.search_businesses(adapters.businesses(spark, d), _scores(spark, d), "SUPPLIER#0", "city3"))


@query
def business_detail(spark, d):
    return rounded(serving.business_detail(adapters.businesses(spark, d), _scores(spark, d), 7))


@query
def business_reviews_page(spark, d):
    reviews = adapters.reviews(spark, d, text=True)
    p = reviews.select("review_id", ((F.col("review_id") % 10) / 10.0).alias("p_fake"))
    return serving.review_page(adapters.businesses(spark, d), reviews, p, 7, 20, 5).drop("text")


@query
def display_formats(spark, d):
    """Numbers and dates as a page shows them."""
    b, r = adapters.businesses(spark, d), adapters.reviews(spark, d)
    shown = b.select("business_id", stats.half_stars(F.col("stars") - 0.2).alias("half_stars"), stats.shown_rating(F.col("stars") / 3).alias("rating"), stats.shown_share(F.col("review_count") / 64.0).alias("share"), stats.shown_count(F.col("review_count") * 1000 + 7).alias("count"), F.array_join(text.category_list(F.col("categories")), "|").alias("categories"))
    last = r.groupBy("business_id").agg(F.max("date").alias("last"))
    return shown.join(last, "business_id", "left").select("*", stats.shown_date(F.col("last")).alias("last_review")).drop("last")


@query
def audit_snippets(spark, d):
    docs = adapters.table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(100)
    return docs.select("doc_id", text.snippet(F.col("text")).alias("snippet"))
