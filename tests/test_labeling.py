from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from candor.operators import features, labeling, similarity
from candor.operators.similarity import text_similarity, vector_similarity
from candor.plans import queries

#: A review about which every rule is silent.
SILENT = {
    "review_id": "x", "user_id": "ann", "business_id": "cafe", "stars": 3.0, "business_mean_stars": 3.8, "user_avg_stars": 3.2, "business_total_reviews": 7, "user_review_count": 6, "in_burst_window": 0,
    "gap_mean": 12.0, "gap_std": 3.6, "n_gaps": 8, "max_dup_sim": 0.55, "text_len": 340, "exclamation_count": 1, "caps_ratio": 0.03, "account_age_days_at_review": 190, "friend_count": 9, "fans": 2, "compliment_photos": 0, "first_week_count": 3,
}
KINDS = {str: "string", float: "double", int: "long"}
SCHEMA = ", ".join(f"{name} {KINDS[type(value)]}" for name, value in SILENT.items())

#: By rule: what is changed, on both sides of each threshold, and the vote.
EDGES = {
    "lf_burst": "in_burst_window=1 : 1 | business_total_reviews=20 : 0 | business_total_reviews=19 : -1 | business_total_reviews=None : -1 | in_burst_window=1 business_total_reviews=None : 1",
    "lf_one_shot_extreme": "user_review_count=2 stars=1.0 : 1 | user_review_count=2 stars=5.0 : 1 | user_review_count=2 stars=4.0 : -1 | user_review_count=3 stars=1.0 : -1 | user_review_count=10 : 0 | user_review_count=9 : -1 | user_review_count=None stars=1.0 : -1",
    "lf_rating_deviation": "business_mean_stars=5.0 user_avg_stars=5.0 : -1 | stars=2.0 business_mean_stars=4.5 user_avg_stars=4.25 : 1 | stars=2.0 business_mean_stars=4.5 user_avg_stars=4.0 : -1 | business_mean_stars=3.4 : 0 | business_mean_stars=3.5 : -1 | business_mean_stars=None : -1",
    "lf_temporal_regularity": "gap_std=1.0 : 1 | gap_std=1.25 : -1 | gap_std=6.0 : -1 | gap_std=6.1 : 0 | gap_std=1.0 n_gaps=3 : 1 | gap_std=1.0 n_gaps=2 : -1 | gap_mean=0.0 gap_std=0.0 : 0 | gap_mean=None gap_std=None n_gaps=None : -1",
    "lf_duplicate_text": "max_dup_sim=0.91 : 1 | max_dup_sim=0.9 : -1 | max_dup_sim=0.29 user_review_count=5 : 0 | max_dup_sim=0.29 user_review_count=4 : -1 | max_dup_sim=0.3 : -1 | max_dup_sim=None : -1",
    "lf_template_text": "text_len=199 exclamation_count=3 stars=5.0 : 1 | text_len=199 caps_ratio=0.21 stars=1.0 : 1 | text_len=199 caps_ratio=0.2 stars=1.0 : -1 | text_len=200 exclamation_count=3 stars=5.0 : -1 | text_len=199 exclamation_count=3 : -1 | text_len=501 : 0 | text_len=500 : -1",
    "lf_extreme_brevity": "text_len=19 stars=5.0 : 1 | text_len=20 stars=5.0 : -1 | text_len=200 stars=5.0 : -1 | text_len=201 stars=5.0 : 0 | text_len=19 stars=4.0 : -1",
    "lf_new_account": "account_age_days_at_review=29 : 1 | account_age_days_at_review=30 : -1 | account_age_days_at_review=365 : -1 | account_age_days_at_review=366 : 0 | account_age_days_at_review=None : -1",
    "lf_no_social": "friend_count=0 fans=0 : 1 | friend_count=0 fans=0 compliment_photos=1 : -1 | fans=5 : 0 | friend_count=20 : 0 | friend_count=19 fans=4 : -1 | friend_count=0 fans=None : -1",
    "lf_account_burst": "first_week_count=6 : 1 | first_week_count=5 : -1 | first_week_count=2 : -1 | first_week_count=1 : 0 | first_week_count=None : -1",
}


def read(case):
    changes, vote = case.rsplit(":", 1)
    return dict((k, eval(v)) for k, v in (x.split("=") for x in changes.split())), int(vote)


def test_every_rule_at_its_thresholds(spark):
    assert set(EDGES) == set(labeling.NAMES) and len(labeling.NAMES) == 10
    rows, wanted = [tuple(SILENT.values())], {"x": dict.fromkeys(labeling.NAMES, -1)}
    for rule, cases in EDGES.items():
        for n, (changes, vote) in enumerate(map(read, cases.split("|"))):
            wanted[f"{rule} {n}"] = {rule: vote}
            rows.append(tuple((SILENT | changes | {"review_id": f"{rule} {n}"}).values()))
    for voted in labeling.votes(spark.createDataFrame(rows, SCHEMA)).collect():
        for rule, vote in wanted[voted.review_id].items():
            assert voted[rule] == vote, (voted.review_id, rule)


def votes_frame(spark, rows):
    return spark.createDataFrame([(f"r{i}", *map(int, r)) for i, r in enumerate(rows)], "review_id string, " + ", ".join(f"{n} byte" for n in labeling.NAMES))


def test_majority_and_summary(spark):
    rows = [[1, 1, 0] + [-1] * 7, [-1] * 10, [0] + [-1] * 9, [1, 0] + [-1] * 8]
    voted = votes_frame(spark, rows)
    assert [r.p_suspicious for r in labeling.majority(voted).orderBy("review_id").collect()] == [1.0, 0.5, 0.0, 0.5]
    by = {r.lf: r for r in labeling.summary(voted).collect()}
    assert (by["lf_burst"].polarity, by["lf_burst"].coverage, by["lf_burst"].overlaps, by["lf_burst"].conflicts) == ("0,1", 0.75, 0.5, 0.5)
    assert by["lf_account_burst"].polarity == "" and by["lf_account_burst"].coverage == 0
    assert voted.filter(labeling.all_abstain(voted)).count() == 1


def test_label_model_recovers_planted_accuracies(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 20000)
    accuracy = np.linspace(0.62, 0.9, 10)
    right = rng.random((20000, 10)) < accuracy
    voted = np.where(rng.random((20000, 10)) < 0.7, np.where(right, y[:, None], 1 - y[:, None]), -1)
    hot = np.stack([voted == v for v in (0, 1)], axis=2).reshape(20000, 20).astype(float)
    model = labeling.fit_label_model(hot.T @ hot / 20000)
    mu = np.array(model.mu)  # rule, vote, class
    found = (mu[:, 0, 0] / mu[:, :, 0].sum(axis=1) + mu[:, 1, 1] / mu[:, :, 1].sum(axis=1)) / 2
    assert np.abs(found - accuracy).max() < 0.03
    frame = votes_frame(spark, [*voted[:300].tolist(), [-1] * 10])
    out = labeling.weak_labels(frame, model).orderBy("review_id").collect()
    by = {r.review_id: r for r in out}
    assert by["r300"].p_suspicious == 0.5 and by["r300"].predicted_label == 0
    assert np.mean([by[f"r{i}"].predicted_label == y[i] for i in range(300)]) > 0.9
    assert np.allclose(labeling.overlaps(votes_frame(spark, voted[:500].tolist())), hot[:500].T @ hot[:500] / 500)


def nearest(texts):
    """The greatest cosine of TF-IDF vectors, with dictionaries."""
    import math
    import re
    from collections import Counter

    words = [re.findall(r"\b\w\w+\b", (t or "").lower()) for t in texts]
    tf = [Counter(w) + Counter(zip(w, w[1:])) for w in words]
    df = Counter(t for c in tf for t in c)
    v = [{t: k * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, k in c.items()} for c in tf]
    norm = [math.sqrt(sum(x * x for x in u.values())) or 1.0 for u in v]
    cos = lambda i, j: sum(x * v[j].get(t, 0.0) for t, x in v[i].items()) / norm[i] / norm[j]
    return [max([0.0, *(cos(i, j) for j in range(len(texts)) if j != i)]) for i in range(len(texts))]


def test_text_similarity_of_whole_and_of_cut_groups(spark):
    rng = np.random.default_rng(7)
    words = [f"wörd{i}" for i in range(30)]
    groups = {k: [" ".join(rng.choice(words, rng.integers(0, 25))) for _ in range(n)] for k, n in (("ann", 60), ("bob", 9), ("one", 1))}
    groups["ann"] += groups["ann"][:5] + ["", ".", "the same " * 40]
    groups["bob"].append(None)
    rows = [(k, 100 * i + j, t) for i, (k, texts) in enumerate(groups.items()) for j, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "k string, i long, text string")
    want = {100 * i + j: s for i, texts in enumerate(groups.values()) for j, s in enumerate(nearest(texts))}
    for most in (1 << 21, 150):  # each group by itself, and in blocks
        out = {r.i: r.max_sim for r in text_similarity(frame, "k", "i", most_terms=most).collect()}
        assert out.keys() == want.keys() and all(out[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_rows_that_refer_to_texts(spark, monkeypatch):
    """Many groups over few texts, dealt out to several tasks in turns, and terms in slices."""
    for name, n in (("ROWS", 40), ("LEAST_ROWS", 10), ("SLICE", 64), ("ROUND", 500), ("WIDE", 30)):
        monkeypatch.setattr(similarity, name, n)
    rng = np.random.default_rng(11)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(25)], rng.integers(0, 20))) for _ in range(30)]
    texts += [texts[0], None]  # a copy; and no text
    rows = [(int(i) // 7, int(i), int(t)) for i, t in enumerate(rng.integers(0, 34, 200))] + [(None, 900, 0), (77, 901, 1)]  # 32 and 33 name no text
    frame, table = spark.createDataFrame(rows, "k long, i long, t long"), spark.createDataFrame(list(enumerate(texts)), "t long, text string")
    groups = {}
    for k, i, t in rows:
        groups.setdefault(i + 1000 if k is None else k, []).append((i, texts[t] if t < len(texts) else None))
    want = {i: s for members in groups.values() for (i, _), s in zip(members, nearest([t for _, t in members]), strict=True)}
    for most in (1 << 21, 60):
        out = {r.i: r.max_sim for r in similarity.referred_similarity(frame, table, "k", "i", "t", most_terms=most).collect()}
        assert out.keys() == want.keys() and all(out[i] == pytest.approx(want[i], abs=1e-9) for i in want)


@pytest.mark.parametrize("texts", [30, 60])
def test_blocks_of_a_large_group_meet_once_in_strips(spark, monkeypatch, texts):
    """an odd and an even number of blocks, several strips and tiles, copies and two vocabularies."""
    for name, n in (("TEXTS", texts), ("TILE", 16), ("STRIP", 2), ("SENT", 20000), ("TELLING", 5), ("PRODUCTS", 64)):
        monkeypatch.setattr(similarity, name, n)
    rng = np.random.default_rng(5)
    found = [" ".join(rng.choice([f"{'ab'[i % 2]}{j}" for j in range(60)], rng.integers(0, 20))) for i in range(200)]
    found += [*found[:4], "", "alone once", "a1 " * 300]
    out = text_similarity(spark.createDataFrame([("k", i, t) for i, t in enumerate(found)], "k string, i long, text string"), "k", "i", most_terms=3000).collect()
    want = nearest(found)
    assert len(out) == len(want) and all(r.max_sim == pytest.approx(want[r.i], abs=1e-9) for r in out)


def test_words_are_found_once_for_all_terms(spark):
    """finding a text's words was repeated for every part of the expression."""
    frame = spark.createDataFrame([("The same, the same",), ("",), (None,)], "text string").select(similarity.terms(F.col("text")).alias("t"))
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [r.t for r in frame.collect()] == [["the", "same", "the", "same", "the same", "same the", "the same"], [], []]


def test_texts_are_not_written_with_each_review(spark, sf):
    """F2 to F16: a text that many reviews have is stored and measured once."""
    assert "text" not in queries._reviews(spark, sf).columns


def test_votes_shuffle_reviews_once_by_review_and_once_by_author(spark, sf):
    """F6 to F10: all shuffle files of the last job lie on disk at once, so what is small goes to the reviews."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = labeling.votes(queries._enriched(spark, sf))._jdf.queryExecution().sparkPlan().toString()
        told = labeling.votes(queries._enriched(spark, sf))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("SortMergeJoin") == 2 and told.count("Exchange hashpartitioning") <= 4, told


def test_content_of_reviews_that_refer_to_texts(spark):
    texts = spark.createDataFrame([(0, "I liked it! VERY good."), (1, None)], "text_id long, text string")
    reviews = spark.createDataFrame([(1, 0), (2, 1), (3, 9), (4, 0)], "review_id long, text_id long")
    beside = features.with_content(reviews.join(texts, "text_id", "left").drop("text_id"))
    assert sorted(features.with_content_of(reviews, texts).select(beside.columns).collect()) == sorted(beside.collect())


def test_products_by_columns_and_by_holders():
    rng = np.random.default_rng(3)
    a, b = (np.where(rng.random((n, 50)) < rng.random(50) ** 3, rng.random((n, 50)), 0) for n in (150, 90))
    sparse = lambda m: (lambda t, r: (r, t, m[r, t]))(*np.nonzero(m.T))
    assert np.allclose(similarity.products(sparse(a), sparse(b), 150, 90), a @ b.T)


def test_vector_similarity(spark, monkeypatch):
    rows = [("A", 1, [1.0, 0.0]), ("A", 2, [1.0, 0.0]), ("B", 3, [1.0, 0.0]), ("B", 4, [0.0, 1.0]), ("C", 5, [1.0, 0.0]), ("D", 6, [1.0, 0.0]), ("D", 7, [-1.0, 0.0])]
    frame = spark.createDataFrame(rows, "k string, i long, v array<double>")
    want = {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: -1, 7: -1}
    assert {r.i: r.max_sim for r in vector_similarity(frame, "k", "i", "v").collect()} == want
    rng = np.random.default_rng(1)
    v = rng.normal(size=(90, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    sims = v @ v.T - 9 * np.eye(90)
    monkeypatch.setattr(similarity, "BLOCK", 16)
    out = vector_similarity(spark.createDataFrame([("g", i, x.tolist()) for i, x in enumerate(v)], "k string, i long, v array<double>"), "k", "i", "v")
    assert np.allclose([r.max_sim for r in out.orderBy("i").collect()], sims.max(axis=1))


def test_rows_that_refer_to_vectors(spark, monkeypatch):
    """F13 to F15: vectors that many rows share do not travel with each row."""
    rng = np.random.default_rng(4)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(20, 6)).tolist())], "ref long, v array<float>")
    rows = [(f"k{int(k)}", i, int(r)) for i, (k, r) in enumerate(zip(rng.integers(0, 40, 300) ** 2 // 40, rng.integers(0, 23, 300), strict=True))] + [(None, 900, 1), ("alone", 901, 2)]
    frame = spark.createDataFrame(rows, "k string, i long, ref long")  # 20 to 22 name no vector
    want = {r.i: r.max_sim for r in vector_similarity(frame.join(table, "ref"), "k", "i", "v").collect()}
    assert want[900] == want[901] == 0 and len(want) < len(rows)
    for block, most in ((1024, 1 << 20), (16, 1 << 20), (1024, 10)):  # whole groups, some in blocks, and vectors that are too many
        monkeypatch.setattr(similarity, "BLOCK", block)
        found = similarity.referred_vector_similarity(frame, table, "k", "i", "ref", "v", most)
        out = {r.i: r.max_sim for r in found.collect()}
        assert out.keys() == want.keys() and all(out[i] == pytest.approx(want[i], abs=1e-6) for i in want)
        assert most == 10 or block < 1024 or "array<float>" not in found._jdf.queryExecution().executedPlan().treeString()


def test_labels_ride_along_with_the_features(spark, sf, monkeypatch):
    """F13 to F15: the features are written once, with their labels, and not shuffled again to join them."""
    names, write = [], queries.written
    for place in (queries, features):
        monkeypatch.setattr(place, "written", lambda df, label, *more: names.append(label) or write(df, label, *more))
    table = queries._labelled(spark, sf)
    assert "features" not in names and table.columns == [*features.ORDER, "p_suspicious", "copied"]
    voted = labeling.votes(queries._enriched(spark, sf))
    want = voted.select("review_id", queries.FIXED_MODEL.probability().alias("p"), (voted.lf_duplicate_text == 1).cast("byte").alias("c")).collect()
    assert sorted((r.review_id, round(r.p_suspicious, 12), r.copied) for r in table.collect()) == sorted((r.review_id, round(r.p, 12), r.c) for r in want)


def test_embeddings(spark):
    frame = spark.createDataFrame([(1, "good good food"), (2, None), (3, " "), (4, "food good good")], "i long, text string")
    out = {r.i: np.array(r.embedding) for r in similarity.encoded(frame, "text").collect()}
    assert np.allclose(np.linalg.norm(out[1]), 1) and not out[2].any() and not out[3].any() and np.allclose(out[1], out[4]) and np.count_nonzero(out[1]) == 2
    given = similarity.encoded(frame, "text", lambda: lambda texts: [[len(t), 1.0] for t in texts]).collect()
    assert {r.i: list(r.embedding) for r in given} == {1: [14, 1], 2: [0, 1], 3: [1, 1], 4: [14, 1]}


def test_dates(spark):
    from candor.functions import stats

    rows = [(datetime(2020, 1, 1, 23), datetime(2020, 1, 2, 1)), (datetime(2020, 1, 1), datetime(2020, 1, 11, 5)), (datetime(2020, 1, 5), datetime(2020, 1, 1, 12))]
    f = stats.F
    out = spark.createDataFrame(rows, "a timestamp, b timestamp").select(stats.days_crossed(f.col("a"), f.col("b")), stats.days_elapsed(f.col("a"), f.col("b"))).collect()
    assert [tuple(r) for r in out] == [(1, 0), (10, 10), (-4, -3)]


def test_shown_values(spark):
    from candor.functions import stats, text

    f = stats.F
    frame = spark.createDataFrame([(4.24, 0.125, 1234567, datetime(2020, 1, 2), "Bars, Food,, Tea"), (None,) * 5], "r double, s double, n long, d timestamp, c string")
    shown = frame.select(stats.half_stars(f.col("r")), stats.shown_rating(f.col("r")), stats.shown_share(f.col("s")), stats.shown_count(f.col("n")), stats.shown_date(f.col("d")), text.category_list(f.col("c"), 2))
    assert [tuple(r) for r in shown.collect()] == [(4.0, "4.24", "13%", "1,234,567", "Jan 2, 2020", ["Bars", "Food"]), (None, "—", "—", "—", "—", None)]


def test_exact_quantiles(spark):
    from candor.operators.metrics import exact_quantiles

    rng = np.random.default_rng(5)
    values = [*rng.random(500).tolist(), *[0.25] * 300, 0.0, 1.0, 1.7]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    shares = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.99, "e": 1.0}
    got = exact_quantiles(frame, "x", shares).first()
    assert all(got[k] == pytest.approx(np.quantile(values, q)) for k, q in shares.items())
    assert exact_quantiles(frame.filter("x is null"), "x", shares).first().c is None
