import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from candor import config
from candor.operators import signals
from candor.plans import reports, serving
from candor.sources import adapters, ingest
from candor.streaming.bursts import live_daily_counts

SIGNALS = [
    ("max_sim_to_user_history", 0.94, "Text 94% similar to another review by the same user"), ("account_age_days_at_review", 3, "Account created 3 days before the review"), ("account_age_days_at_review", 1, "Account created 1 day before the review"),
    ("account_age_days_at_review", 0, "Account created the same day as the review"), ("is_in_burst_window", 1, "Posted during a burst of reviews on this business"), ("total_reviews", 1, "This is among the reviewer's very first reviews"), ("total_reviews", 4, "Reviewer has only 4 total reviews"),
    ("friend_count", 0, "Reviewer has no friends on the platform"), ("fan_count", 2, "Followers of the reviewer: 2"), ("stars", 5, "An extreme 5-star rating"), ("hours_since_prev_review_on_business", 0.5, "Came within the hour of the review before it"),
    ("word_count", 1, "The text has just 1 word"), ("stars_delta_from_user_mean", -1.25, "1.2 stars below what this reviewer usually gives"), ("some_new_feature", 1, "Atypical value for some new feature"),
]


def test_signals():
    assert [signals.render(f, v) for f, v, _ in SIGNALS] == [s for *_, s in SIGNALS]
    assert len(signals.WORDING) == 31
    assert signals.top_signals(["stars", "fan_count", "caps_ratio", "exclamation_ratio", "rating_skew"], [5, 0, 1, 1, 1], [0.1, 0.5, -1.0, 0.3, 0.2]) == ["Nobody follows the reviewer", "Many of the characters are exclamation marks", "The reviewer's ratings lean to one side"]
    assert signals.top_signals(["stars"], [5], [0.0]) == []


def test_requests(spark, sf):
    from candor.operators.scoring import score_businesses

    b, r = adapters.businesses(spark, sf), adapters.reviews(spark, sf, text=True)
    scores = score_businesses(adapters.scored_reviews(spark, sf))
    found = serving.search_businesses(b, scores, "SUPPLIER", limit=3)
    assert found.columns == ["business_id", "name", "city", "state", "yelp_rating", "yelp_review_count", "rrs"] and found.count() == 3
    assert serving.search_businesses(b, scores, "supplier#%7", "CITY0").count() == 1
    assert len(serving.business_detail(b, scores, 3).columns) == 15
    page = serving.review_page_json(b, r, r.select("review_id", F.lit(0.5).alias("p_fake")), 3, limit=4)
    assert len(page) == 4 and set(page[0]) == {"review_id", "stars", "date", "text", "p_fake", "signals"} and page[0]["signals"] == [] and page[0]["date"] >= page[1]["date"]
    for bad in (lambda: serving.search_businesses(b, scores, ""), lambda: serving.search_businesses(b, scores, "x", limit=101), lambda: serving.review_page(b, r, r, 3, limit=0), lambda: serving.review_page(b, r, r, 3, offset=-1)):
        with pytest.raises(serving.BadRequest):
            bad()
    for unknown in (lambda: serving.business_detail(b, scores, -5), lambda: serving.review_page(b, r, r, -5)):
        with pytest.raises(serving.NotFound):
            unknown()
    assert serving.health("x") == {"status": "ok", "metro": "x"}


def test_signals_of_a_page(spark, sf):
    from candor.plans import queries

    train, test, _, fitted = queries._trained(spark, sf)
    b, r = adapters.businesses(spark, sf), adapters.reviews(spark, sf, text=True)
    page = serving.review_page_json(b, r, r.select("review_id", F.lit(0.5).alias("p_fake")), 3, features=train.unionByName(test), model=fitted, limit=5)
    assert len(page) == 5 and any(x["signals"] for x in page) and all(len(x["signals"]) <= 3 for x in page)


def test_ingest(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    rows = {
        "business": [{"business_id": "b1", "name": "N", "city": "Goleta", "state": "CA", "stars": 4.5, "review_count": 3, "attributes": {"x": {"y": 1}}}, {"business_id": "b2", "city": "Fresno", "state": "CA"}],
        "review": [{"review_id": "r1", "user_id": "u1", "business_id": "b1", "stars": 5, "text": "a\nb", "date": "2020-01-02 03:04:05"}, {"review_id": "r2", "user_id": "u2", "business_id": "b2", "stars": 1, "date": "2020-01-02 03:04:05"}],
        "user": [{"user_id": "u1", "yelping_since": "2010-01-01 00:00:00"}, {"user_id": "u2"}],
        "tip": [{"user_id": "u9", "business_id": "b1", "text": "t", "date": "2020-01-01 00:00:00"}],
        "checkin": [{"business_id": "b1", "date": "2020-01-01 00:00:00, 2020-01-02 00:00:00"}, {"business_id": "b2", "date": ""}],
    }
    for name, own in rows.items():
        (raw / f"yelp_academic_dataset_{name}.json").write_text("".join(json.dumps(r) + "\n" for r in own))
    out = f"{tmp_path}/out"
    for _ in range(2):  # a second load replaces the first
        assert ingest.ingest(spark, str(raw), out, config.get_metro("santa_barbara")) == {"businesses": 1, "reviews": 1, "tips": 1, "checkins": 1, "users": 1}
    r = ingest.read_table(spark, f"{out}/reviews").first()
    assert (r.review_id, r.date, r.text) == ("r1", datetime(2020, 1, 2, 3, 4, 5), "a\nb") and ingest.read_table(spark, f"{out}/users").first().user_id == "u1"
    meta = ingest.read_table(spark, f"{out}/meta")
    assert ingest.metro_label(meta) == "santa_barbara" and ingest.metro_label(None) == "unknown" and ingest.loaded_at(meta)
    with pytest.raises(ingest.EmptyMetro):
        ingest.ingest(spark, str(raw), out, config.get_metro("boise"))
    with pytest.raises(ingest.MissingInput):
        ingest.ingest(spark, f"{tmp_path}/none", out, config.get_metro("boise"))
    with pytest.raises(config.UnknownMetro):
        config.get_metro("atlantis")


def test_reader_options():
    from candor.schemas import TABLES

    assert {t for t, s in TABLES.items() if ingest.reader_options(s)} == {"reviews", "users", "tips"} and len(TABLES["users"]) == 22


def test_reports(spark, sf):
    b, r, u = adapters.businesses(spark, sf), adapters.reviews(spark, sf, text=True), adapters.users(spark, sf)
    body = reports.profile_report("Profile", b, r, u)
    assert body.startswith("# Profile") and body.count("\n## ") == 11 and "| businesses | 10 |" in body
    from candor.operators.scoring import score_businesses

    assert "Largest downward" in reports.score_report("Scores", score_businesses(adapters.scored_reviews(spark, sf)))


def test_live_counts_match_batch(spark, sf, tmp_path):
    from candor.operators.behaviour import daily_counts

    reviews = adapters.event_reviews(spark, sf)
    reviews.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(reviews.schema).parquet(f"{tmp_path}/in")
    q = live_daily_counts(stream).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(90)
    key = lambda df: sorted((r.business_id or -1, r.day, r.n) for r in df.collect())
    assert key(spark.table("live")) == key(daily_counts(reviews))
