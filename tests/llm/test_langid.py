import math
import zlib
from collections import Counter

import numpy as np

from candor.llm import langid, queries


def test_held_out_accuracy(spark, sf):
    path = sf.replace("0.001", "0.1")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang").collect()}
    out = queries.op10_language_id(spark, path).collect()
    assert len(out) == len(truth) and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    own = [r for r in out if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id] for r in own) / len(own) > 0.97


def plain_grams(text, buckets):
    codes = (" " + " ".join(text.lower().split()) + " ").encode("utf-32-le")
    codes = [int.from_bytes(codes[i : i + 4], "little") for i in range(0, len(codes), 4)]
    found = Counter()
    for i in range(len(codes)):
        h = 0
        for n in range(1, 4):
            if i + n <= len(codes):
                h = (h * 0x100000001B3 + codes[i + n - 1] + n) % 2**64
                found[(h * 0x9E3779B97F4A7C15) % 2**64 >> (64 - buckets.bit_length() + 1)] += 1
    return found


def test_counts_and_posterior_match_plain_code(spark, monkeypatch):
    monkeypatch.setattr(langid, "SLAB", 8)
    for text in ("", "a", "Ünï  code\n𝒳 text that spans slabs"):
        at, n = langid.bucket_counts(text, 256)
        assert dict(zip(at.tolist(), n.tolist())) == plain_grams(text, 256)
    train = [("aa", "the cat sat"), ("bb", "der hund lag"), ("aa", "on the mat")]
    docs = spark.createDataFrame(train, "lang string, text string")
    model = langid.fit(docs, max_buckets=256)
    counts = {x: sum((plain_grams(t, 256) for la, t in train if la == x), Counter()) for x in ("aa", "bb")}
    log = {x: math.log((2 if x == "aa" else 1) / 3) + sum(k * math.log((counts[x][b] + 1) / (sum(counts[x].values()) + 256)) for b, k in plain_grams("the hat", 256).items()) for x in counts}
    (lang,), (score,) = langid.predict_texts(["the hat"], model)
    assert lang == max(log, key=log.get) and abs(score - 1 / sum(math.exp(v - max(log.values())) for v in log.values())) < 1e-4
    # slabs of the product that end inside texts, or hold many
    texts = ["the hat", "", "der " * 30, "x", "the cat sat on the mat"]
    alone = np.concatenate([langid.log_posterior([t], model) for t in texts])
    for slab in (2, 14, 1 << 20):
        monkeypatch.setattr(langid, "SLAB", slab)
        assert np.allclose(langid.log_posterior(texts, model), alone)


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([("zz", "same text"), ("aa", "same text")], "lang string, text string")
    (lang, other), scores = langid.predict_texts(["same", "quite another"], langid.fit(docs))
    assert (lang, other) == ("aa", "aa") and np.allclose(scores, 0.5)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", 0.5), (2, "", "en", 0.5), (3, "12 + 3!", "en", 0.5), (None, "hello world", "en", 0.5), (5, "hello world", None, 0.5), (6, "bonjour le monde " * 20000, "fr", 0.5), (6, "é", "fr", 0.5)], "doc_id long, text string, lang string, score double")
    model = langid.fit(docs)
    assert model.languages == ("en", "fr")
    out = langid.predict(docs, model).collect()
    assert len(out) == 7 and [r.lang_pred for r in sorted(out, key=lambda r: (r.doc_id is None, r.doc_id or 0))][:3] == ["und"] * 3
    assert {r.lang_pred for r in out if r.doc_id == 6} <= {"en", "fr"} and {r.lang_pred for r in out if r.doc_id == 5} == {"en"}
    assert langid.fit(docs.filter("lang is null")) is None and {(r.lang_pred, r.score) for r in langid.predict(docs, None).collect()} == {("und", 0.0)}
    assert langid.predict(docs.limit(0), model).count() == 0
    one = langid.predict(docs, langid.fit(docs.filter("lang = 'fr'"))).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("und", 0.0), ("fr", 1.0)}


def test_many_languages_get_fewer_buckets(spark, monkeypatch):
    monkeypatch.setattr(langid, "MATRIX_CELLS", 1 << 12)
    docs = spark.createDataFrame([(f"l{i}", f"text {i}") for i in range(10)], "lang string, text string")
    assert langid.fit(docs).log_probability.size <= 1 << 12 and np.isfinite(langid.fit(docs).log_probability).all()
