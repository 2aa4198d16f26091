"""The registered queries do the whole job, and no more: their parameters leave nothing out, and a page scores its own rows."""

from pyspark.sql import functions as F

from candor.operators import model
from candor.plans import queries, serving


def test_registered_queries_train_whole_models():
    assert queries.SETTINGS.rounds >= model.final_rounds(model.Settings().rounds) >= 50
    assert queries.SETTINGS.depth >= model.Settings().depth and queries.SETTINGS.rows == 1 and queries.SETTINGS.columns == "all"


def test_page_scores_its_own_rows_only(spark):
    reviews = spark.range(200).selectExpr("id as review_id", "id div 50 as business_id", "4.0d as stars", "timestamp_seconds(id) as date", "'t' as text")

    @F.udf("double")
    def score(i):
        if i >= 50:
            raise ValueError("a row of another business")
        return i / 100

    page = serving.review_page(reviews.select("business_id").distinct(), reviews, reviews.select("review_id", score("review_id").alias("p_fake")), 0, 3)
    assert [(r.review_id, r.p_fake) for r in page.collect()] == [(49, 0.49), (48, 0.48), (47, 0.47)]
