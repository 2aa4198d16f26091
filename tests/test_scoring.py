import math

import pytest
from pyspark.sql import functions as F

from candor.functions import stats, text
from candor.operators import metrics, scoring

SCORED = "business_id string, stars double, p_fake double"


def test_wilson(spark):
    rows = [(0.5, 100.0), (0.5, 10.0), (0.0, 5.0), (1.0, 5.0), (0.4, 0.0)]
    low, high = stats.wilson(F.col("p"), F.col("n"))
    a, b, c, d, e = spark.createDataFrame(rows, "p double, n double").select(low.alias("lo"), high.alias("hi")).collect()
    assert a.lo < 0.5 < a.hi and b.hi - b.lo > a.hi - a.lo and c.lo == pytest.approx(0) and d.hi == pytest.approx(1) and (e.lo, e.hi) == (0.4, 0.4)


def test_trust_mean(spark):
    rows = [("A", 5.0, 0.0), ("A", 5.0, 0.99), ("A", 1.0, 0.0)]
    assert scoring.global_trust_mean(spark.createDataFrame(rows, SCORED)).first()[0] == pytest.approx(6.05 / 2.01)
    nothing = spark.createDataFrame([("A", 5.0, 1.0), ("A", 2.0, 1.0)], SCORED)
    assert scoring.global_trust_mean(nothing).first()[0] == 3.5


def test_shrinkage(spark):
    rows = [("A", 5.0, 0.0)] * 50 + [("B", 5.0, 0.0)] + [("C", 2.0, 0.0)] * 20
    by = {r.business_id: r for r in scoring.score_businesses(spark.createDataFrame(rows, SCORED)).collect()}
    mu = by["A"].global_mean
    assert by["A"].rrs > 4.5 and by["B"].rrs < by["A"].rrs and abs(by["B"].rrs - mu) < abs(5 - by["B"].rrs) and by["A"].n_eff == 50


def test_flags_and_interval(spark):
    rows = [("X", 5.0, 0.9), ("X", 5.0, 0.1), ("X", 1.0, 0.2), ("X", 1.0, 0.8), ("Y", 3.0, 0.5)]
    by = {r.business_id: r for r in scoring.score_businesses(spark.createDataFrame(rows, SCORED)).collect()}
    x = by["X"]
    assert (x.n_reviews, x.n_flagged, x.n_authentic_reviews, x.pct_flagged) == (4, 2, 2, 0.5) and 1 <= x.rrs_ci_low <= x.rrs <= x.rrs_ci_high <= 5
    assert by["Y"].n_flagged == 0  # a probability of exactly one half is not flagged


def test_guard_and_reports(spark):
    p = spark.createDataFrame([("r1", 0.1), ("r2", 0.9)], "review_id string, p_fake double")
    f = spark.createDataFrame([("r1", "B", 5.0)], "review_id string, business_id string, stars double")
    with pytest.raises(scoring.RowMismatch):
        scoring.join_scores(p, f)
    assert scoring.join_scores(p.filter("review_id = 'r1'"), f).count() == 1
    few = scoring.score_businesses(spark.createDataFrame([("A", 5.0, 0.9)] * 20 + [("B", 5.0, 0.9)] * 19, SCORED))
    assert [r.business_id for r in scoring.largest_downward(few).collect()] == ["A"]
    assert {r.bin: r.n for r in scoring.fake_histogram(spark.createDataFrame([(v,) for v in (0.0, 0.05, 0.95, 1.0, 1.5, -1.0, None)], "p_fake double")).collect()} == {0: 3, 9: 3}


def test_skewness(spark):
    rows = [("a", x) for x in (1.0, 2.0, 5.0)] + [("b", x) for x in (1.0, 2.0)] + [("c", 4.0)]
    out = {r.k: r.s for r in spark.createDataFrame(rows, "k string, x double").groupBy("k").agg(stats.sample_skewness(F.col("x")).alias("s")).collect()}
    m = 8 / 3
    m2, m3 = (sum((x - m) ** k for x in (1, 2, 5)) / 3 for k in (2, 3))
    assert out["a"] == pytest.approx(math.sqrt(6) * m3 / m2**1.5) and out["b"] is None and out["c"] is None


def test_text_features(spark):
    rows = [(1, "Hello world!"), (2, "WOW SO GOOD!!!"), (3, "i went there with my friends"), (4, ""), (5, None), (6, "x"), (7, "éme my-US Our. A...b?!")]
    out = {r.i: r for r in spark.createDataFrame(rows, "i int, text string").select("i", *[c.alias(n) for n, c in text.features(F.col("text")).items()], text.flesch(F.col("text")).alias("flesch")).collect()}
    assert [out[i].char_length for i in (1, 2, 3)] == [12, 14, 28] and [out[i].word_count for i in (1, 2, 3)] == [2, 3, 6]
    assert out[1].first_person_ratio == 0 and out[3].first_person_ratio == pytest.approx(2 / 6) and out[7].first_person_ratio == pytest.approx(3 / 6) and out[7].sentence_count == 3
    assert all(v is not None and v == v for r in out.values() for v in r) and out[4].flesch == out[5].flesch == 0
    assert out[1].flesch == pytest.approx(206.835 - 1.015 * 2 - 84.6 * 3 / 2)
    friends = spark.createDataFrame([(v,) for v in ("None", "", "a", "a,b,c,d,e", None)], "f string").select(text.friend_count(F.col("f")))
    assert [r[0] for r in friends.collect()] == [0, 0, 1, 5, 0]
    s = spark.createDataFrame([("a\n" * 150, "x, y , ,z")], "t string, c string").select(text.snippet(F.col("t")).alias("t"), text.category_list(F.col("c"), 2).alias("c")).first()
    assert s.t == "a " * 100 + "…" and s.c == ["x", "y"]


def test_sentiment():
    from candor.functions.sentiment import lexicon_scorer

    score = lexicon_scorer()
    assert score("") == (0.0, 0.0, 0.0, 1.0) and score("great, friendly place!")[0] > 0.3 > -0.3 > score("awful and rude")[0] and score("not good")[0] < 0
    for t in ("great food", "the and", "bad bad good!!!"):
        c, *shares = score(t)
        assert -1 <= c <= 1 and sum(shares) == pytest.approx(1)


def test_metrics(spark):
    rows = [(i, float(p), y, s) for i, (p, y, s) in enumerate([(0.9, 1, 0.9), (0.8, 0, 0.1), (0.8, 1, 0.5), (0.3, 1, 0.0), (0.3, 0, 1.0), (0.1, 0, 0.2), (1.0, 0, 0.3), (0.0, 1, 0.4)])]
    df = spark.createDataFrame(rows, "i int, p double, y int, s double")
    won = [(a > b) + (a == b) / 2 for _, a, ya, _ in rows if ya for _, b, yb, _ in rows if not yb]
    assert metrics.roc_auc(df, "p", "y").first()[0] == pytest.approx(sum(won) / len(won))
    ap, seen, hits = 0.0, 0, 0
    for t in sorted({r[1] for r in rows}, reverse=True):
        own = [r[2] for r in rows if r[1] == t]
        seen, hits = seen + len(own), hits + sum(own)
        ap += sum(own) / 4 * hits / seen
    assert metrics.average_precision(df, "p", "y").first()[0] == pytest.approx(ap)
    assert {r.k: r.precision for r in metrics.precision_at(df, "p", "y", "i", (1, 3, 100)).collect()} == {1: 0.0, 3: pytest.approx(1 / 3), 100: 0.5}
    own, flat = (df.agg(metrics.soft_log_loss(F.col("s"), c)).first()[0] for c in (F.col("s"), F.lit(0.5)))
    assert own < flat and math.isfinite(own)
    assert metrics.roc_auc(df.filter("y = 1"), "p", "y").first()[0] is None and metrics.average_precision(df.limit(0), "p", "y").first()[0] is None


def test_reading_ease_of_all_texts(spark, sf):
    import re

    from candor.plans.queries import QUERIES

    def syllables(w):
        n = len(re.findall("[aeiouy]+", w.lower()))
        return max(1, n - (n > 1 and w.lower().endswith("e")))

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["flesch"](spark, sf).collect():
        words = re.findall(r"\b[a-zA-Z']+\b", texts[r.doc_id])
        ends = max(1, sum(texts[r.doc_id].count(c) for c in ".!?"))
        want = 206.835 - 1.015 * len(words) / ends - 84.6 * sum(map(syllables, words)) / len(words) if words else 0.0
        assert r.flesch_reading_ease == pytest.approx(want, abs=1e-5)
