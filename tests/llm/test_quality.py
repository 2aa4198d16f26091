import math
import re
import statistics
import struct
from collections import Counter

import pytest
import xxhash

from candor.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")

LABELS = "doc_id long, quality int, toxic int"


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    found = Counter(zip(words, words[1:], words[2:]))
    hit = {j for i, w in enumerate(zip(words, words[1:], words[2:])) if found[w] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_statistics_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = quality.quality_rules(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert len(out) == docs.count()
    for r in out:
        stats = brute(r.text)
        assert tuple(r[c] for c in quality.STATS) == stats
        assert r.base_failed == (stats[0] < 50 or 100 * stats[4] > 50 * stats[0])
        assert not (r.kept and r.base_failed)


def brute_buckets(text):
    hashed = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in WORD.findall(text or "")]
    pairs = [xxhash.xxh64_intdigest(struct.pack("<Q", b), seed=xxhash.xxh64_intdigest(struct.pack("<Q", a), seed=42)) for a, b in zip(hashed, hashed[1:])]
    return [x % quality.BUCKETS for x in hashed + pairs]


def brute_scores(rows, targets):
    """Scores of (id, text) rows in their order, and the threshold."""
    grams = [brute_buckets(t) for _, t in rows]
    raw, own = ([1] * quality.BUCKETS for _ in range(2))
    for (i, _), found in zip(rows, grams):
        for b in found:
            raw[b] += 1
            own[b] += i in targets
    weight = [math.log(o / sum(own)) - math.log(r / sum(raw)) for o, r in zip(own, raw)]
    scores = [sum(weight[b] for b in found) / len(found) if found else None for found in grams]
    trusted = [s for (i, _), s in zip(rows, scores) if i in targets and s is not None]
    return scores, statistics.fmean(trusted) - quality.SPREAD * statistics.pstdev(trusted)


def test_scores_and_verdicts_match_brute_force(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    targets = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    scores, threshold = brute_scores(rows, targets)
    told = {i: s for (i, _), s in zip(rows, scores)}
    out = quality.quality_rules(docs, labels).collect()
    assert len(told) == len(out)
    for r in out:
        assert r.score == pytest.approx(told[r.doc_id], abs=1e-7)
        if abs(told[r.doc_id] - threshold) > 1e-5:
            assert r.kept == (not r.base_failed and told[r.doc_id] > threshold)


@pytest.mark.parametrize("n", range(6))
def test_a_single_target_is_kept_by_its_own_threshold(spark, n):
    texts = {i: " ".join(f"w{(i * 7 + j * j * (i + n + 1)) % 83}" for j in range(80)) for i in range(4)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(n % 4, 1, 0)], LABELS)
    assert {r.doc_id for r in quality.quality_rules(docs, labels).collect() if r.kept} >= {n % 4}


def test_two_targets_are_kept(spark):
    rows = [(i, " ".join(f"{'good' if i < 2 else 'poor'}{(j * (i + 2)) % 71}" for j in range(60))) for i in range(8)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0, 1, 0), (1, 1, None), (5, 1, 1)], LABELS)
    scores, threshold = brute_scores(rows, {0, 1})
    out = {r.doc_id: r for r in quality.quality_rules(docs, labels).collect()}
    assert [out[i].score for i in range(8)] == pytest.approx(scores, abs=1e-7)
    assert {i for i, r in out.items() if r.kept} == {i for i, s in enumerate(scores) if s >= threshold and not out[i].base_failed} >= {0, 1}


def test_clean_stays_and_junk_goes(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.quality_rules(docs, labels).join(labels, "doc_id").filter(~quality.F.col("base_failed"))
    kept = {(r.quality, r.kept): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert kept[1, True] / (kept[1, True] + kept.get((1, False), 0)) > 0.995
    assert kept[0, False] / (kept[0, False] + kept.get((0, True), 0)) > 0.8


@pytest.fixture
def odd(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a b c a b c"), (5, "x\ny\nx\n\nx"), (5, "x\ny\nx\n\nx"), (6, long), (7, "ü#é 𝒳𝒳 ß"), (8, "a " * 200)]
    return spark.createDataFrame([(*r, "keep") for r in rows], "doc_id long, text string, SCORE string")


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(6, 1, 0), (6, 1, 0), (8, 1, 1), (None, 1, 0), (2, None, None)], LABELS)
    out = quality.quality_rules(odd, labels).collect()
    assert len(out) == odd.count()
    for r in out:
        assert tuple(r[c] for c in quality.STATS) == brute(r.text)
    by = {r.doc_id: r for r in out}
    assert by[1].base_failed and by[1].score is None and not by[1].kept
    assert by[8].base_failed and by[8].n_repeat_words == 200
    assert by[6].kept


def test_no_labels_and_no_rows(spark, odd):
    none = spark.createDataFrame([], LABELS)
    assert {r.kept for r in quality.quality_rules(odd, none).filter("not base_failed").collect()} == {True}
    assert quality.quality_rules(odd.limit(0), none).count() == 0


def test_order_of_rows_does_not_matter(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    one, two = quality.fit_ratio(docs, labels), quality.fit_ratio(docs.repartition(7).orderBy("n_chars"), labels)
    assert one == two
