"""The seven phases end to end, each reading and writing Parquet tables under one root folder.

root/tables/{businesses,reviews,users,tips,checkins,meta}, root/labels, root/features, root/embeddings, root/model,
root/predictions, root/importances, root/scores, and reports as Markdown beside them.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.config import DEFAULT_METRO, get_metro
from candor.operators import enrich, features, labeling, model, scoring, similarity
from candor.plans import profile, reports
from candor.sources import ingest as source
from candor.sources.staging import written


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return source.read_table(spark, f"{root}/tables/{name}")


def _report(spark: SparkSession, text: str, path: str) -> None:
    """One text file, by Spark, so the root may be in any store."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def ingest(spark: SparkSession, root: str, raw: str, metro: str = DEFAULT_METRO) -> dict[str, int]:
    return source.ingest(spark, raw, f"{root}/tables", get_metro(metro))


def profile_tables(spark: SparkSession, root: str) -> str:
    tables = {n: _table(spark, root, n) for n in ("businesses", "reviews", "users", "tips", "checkins")}
    label = source.metro_label(_table(spark, root, "meta"))
    text = reports.profile_report(f"Profile: {label}", tables["businesses"], tables["reviews"], tables["users"], tips=tables["tips"], checkins=tables["checkins"])
    _report(spark, text, f"{root}/reports/profile_{label}")
    return text


def label(spark: SparkSession, root: str) -> int:
    reviews, businesses, users = (_table(spark, root, n) for n in ("reviews", "businesses", "users"))
    voted = labeling.votes(enrich.with_copies(enrich.enriched(reviews, businesses, users), reviews))
    source.refresh(voted, f"{root}/votes")
    voted = source.read_table(spark, f"{root}/votes")  # the model reads the votes once to fit and once to score
    n = source.refresh(labeling.weak_labels(voted, labeling.fit_label_model(labeling.overlaps(voted))), f"{root}/labels")
    name = source.metro_label(_table(spark, root, "meta"))
    _report(spark, reports.audit_report(f"Labels: {name}", voted, source.read_table(spark, f"{root}/labels"), reviews), f"{root}/reports/labels_{name}")
    return n


def build_features(spark: SparkSession, root: str, snapshot: str = profile.SNAPSHOT, sample: int | None = None, embed: bool = True, encoder=None) -> int:
    reviews, businesses, users = (_table(spark, root, n) for n in ("reviews", "businesses", "users"))
    vectors = None
    if embed:
        source.refresh(similarity.encoded(reviews.select("review_id", "text"), "text", encoder).drop("text"), f"{root}/embeddings")
        vectors = source.read_table(spark, f"{root}/embeddings")
    table = features.feature_table(reviews, businesses, users, snapshot, vectors)
    if sample is not None:
        table = table.join(features.hash_sample(reviews.select("review_id"), "review_id", sample), "review_id", "left_semi").select(*table.columns)
    features.write_features(table, f"{root}/features")
    return source.read_table(spark, f"{root}/features").count()


def train(spark: SparkSession, root: str, trials: int = model.TRIALS, split: str = features.SPLIT, tune_from: str = features.TUNE_FROM, settings: model.Settings | None = None) -> dict:
    joined = features.join_labels(source.read_table(spark, f"{root}/features"), source.read_table(spark, f"{root}/labels"))
    joined = written(joined, "labelled")
    past, later = features.time_split(joined, split)
    chosen = features.feature_columns([c for c in past.columns if c != "hard_label"])
    if settings is None:
        settings, _ = model.tune(past, chosen, tune_from, trials)
        settings = model.Settings(**asdict(settings) | {"rounds": model.final_rounds(settings.rounds)})
    fitted = model.fit(past, chosen, settings=settings)
    fitted.trees.write().overwrite().save(f"{root}/model/trees")
    spark.createDataFrame([(json.dumps(chosen),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/model/features")
    source.refresh(model.predict(joined, fitted).select("review_id", "p_fake"), f"{root}/predictions")
    gains = model.importances(fitted)
    source.refresh(spark.createDataFrame(gains, "feature string, gain_frac double, splits long"), f"{root}/importances")
    metrics = written(model.evaluate(model.predict(later, fitted)), "metrics")
    copied = later.join(source.read_table(spark, f"{root}/votes").select("review_id", (F.col("lf_duplicate_text") == labeling.SUSPICIOUS).cast("byte").alias("copied")), "review_id", "left")
    aucs = model.ablation(past, copied, chosen, settings).first()
    verdict = model.ablation_verdict(aucs["full_auc"] or 0.0, aucs["ablated_auc"] or 0.0)
    name = source.metro_label(_table(spark, root, "meta"))
    _report(spark, reports.model_report(f"Model: {name}", metrics, gains, model.synthetic_injection(later, fitted), verdict), f"{root}/reports/model_{name}")
    return metrics.first().asDict()


def load_model(spark: SparkSession, root: str) -> model.SoftModel:
    return model.SoftModel(GBTClassificationModel.load(f"{root}/model/trees"), json.loads(spark.read.text(f"{root}/model/features").first()[0]))


def score(spark: SparkSession, root: str, prior_weight: float = scoring.PRIOR_WEIGHT) -> int:
    joined = scoring.join_scores(source.read_table(spark, f"{root}/predictions"), source.read_table(spark, f"{root}/features"))
    n = source.refresh(scoring.score_businesses(joined, prior_weight), f"{root}/scores", "business_id")
    name = source.metro_label(_table(spark, root, "meta"))
    _report(spark, reports.score_report(f"Scores: {name}", source.read_table(spark, f"{root}/scores")), f"{root}/reports/scores_{name}")
    return n
