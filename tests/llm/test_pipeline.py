import random

import corpus_pipeline
from candor.llm import quality
from tests.llm import test_decontam, test_linededup, test_packing, test_simhash


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {x.doc_id for x in quality.quality_rules(docs, labels).filter("kept").collect()}
    want = {i: r.text for i, r in rows.items() if i in kept}
    for name, stage in corpus_pipeline.STAGES:
        if name == "line_dedup":
            want = {d: t for d, *_, t in test_linededup.brute([(i, t, rows[i].source) for i, t in want.items()], 10)}
        elif name == "simhash_near_dedup":
            ids = list(want)
            roots = test_simhash.slow_components(ids, [test_simhash.slow_print(want[i]) for i in ids])
            want = {i: want[i] for i in set(roots)}
        elif name == "benchmark_decontamination":
            bad = {r[0] for r in test_decontam.brute(want.items(), items) if r[5]}
            want = {i: t for i, t in want.items() if i not in bad}
        docs = stage(spark, docs, sf)
        if name != "best_fit_packing":
            assert docs.columns == columns
            path = f"{spark.conf.get('spark.checkpoint.dir')}/pipeline-{name}"
            docs.write.mode("overwrite").parquet(path)
            docs = spark.read.parquet(path)
            assert {r.doc_id: r.text for r in docs.collect()} == want
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == set(want)
    test_packing.check_places(pieces)


def test_run_and_empty(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_nulls_repeats_and_clashing_columns(spark, sf):
    """Every stage returns the columns it was given, untouched but for text and n_chars."""
    extra = "kept string, score string, n_words string, hits string, items string, n_lines string, hash string, fingerprint string, root string, key string, tokens string, length string, piece string, offset string"
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + extra
    prose = {k: " ".join(random.Random(k).choices([f"word{i}" for i in range(60)], k=400)) for k in range(6)}  # alike in words, not in order
    rows = [(1, prose[0], "en", "a", None), (1, prose[0], "en", "a", None), (None, prose[1], None, None, 7), (None, prose[2], "en", "b", 1), (4, None, "en", "c", 0), (5, "", None, "c", 0), (6, prose[3] + "\n" + "x" * 30000, "en", "d", 1), (7, prose[4], "en", None, 1)]
    # no label has these ids, so the base rules alone decide
    docs = spark.createDataFrame([(r[0] and r[0] + 10**9, *r[1:], *[f"own{i}"] * 14) for i, r in enumerate(rows)], schema)
    columns, mine = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        mine[name] = [r.kept for r in docs.collect()]
        assert all(set(r[5:]) == {r.kept} for r in docs.collect())
    assert sorted(mine["quality_rules"]) == ["own0", "own1", "own2", "own3", "own6", "own7"]
    assert len(mine["simhash_near_dedup"]) == 5
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len({(r.doc_id) for r in pieces}) == 4
