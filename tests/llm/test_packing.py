import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from candor.llm import packing, queries


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.tokenizer_path())


def check_places(rows, capacity=2048):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_query_against_the_tokenizer(spark, sf, tokenizer):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op1_best_fit_packing(spark, sf).collect()
    found = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    assert len(found) == len(rows)
    want = {}
    for d, t in docs.items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[d, k // 2048] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert found == want
    assert check_places(rows) == -(-sum(v[1] for v in want.values()) // 2048)  # the lower bound is met here


def test_odd_rows(spark, tokenizer):
    texts = [None, "", " \t\n", "a b", "a b", "É ü x y 'll don't <|endoftext|>z", "x" * 5000, "é ́e", "word " * 9000, "a\x1cb\x85c"]
    docs = spark.createDataFrame([(None if i == 3 else i % 7, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    rows = packing.pack(docs, queries.tokenizer_path()).collect()
    check_places(rows)
    whole = defaultdict(bytes)
    for r in sorted(rows, key=lambda r: r.piece):
        whole[r.doc_id] += bytes(r.tokens)
    for i in (4, 5, 6):
        assert np.frombuffer(whole[i], "<u4").tolist() == [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 0]
    assert sum(r.length for r in rows) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    assert packing.pack(docs.limit(0), queries.tokenizer_path()).count() == 0


def used(plan):
    got = Counter()
    for filling, n in plan.fillings:
        assert sum(filling) <= plan.capacity
        for x in filling:
            got[x] += n
    return got


def optimum(items, capacity):
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for r in set(rooms):
            if r >= items[i]:
                go(i + 1, [*rooms[: rooms.index(r)], r - items[i], *rooms[rooms.index(r) + 1 :]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


def test_plans_are_whole_and_near_the_optimum():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.choice([10, 20, 50])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        plan = packing.plan_sequences(Counter(items), capacity)
        assert used(plan) == Counter(items)
        assert plan.sequences == optimum(items, capacity)


def test_never_worse_than_best_fit():
    rng = random.Random(5)
    for _ in range(15):
        counts = {rng.randint(1, 200): rng.randint(1, 3000) for _ in range(60)}
        plan = packing.plan_sequences(counts, 200, nodes=300)
        assert used(plan) == Counter(counts)
        assert plan.sequences <= sum(n for _, n in packing.best_fit(counts, 200))
    assert packing.plan_sequences({}, 200).sequences == 0


@pytest.mark.parametrize("times", [1, 10, 1000])
def test_largest_lengths_with_different_fillings(times):
    counts = {1200: 2, 1112: 1, 650: 1, 638: 1, 512: 2, 424: 4, 336: 2}
    plan = packing.plan_sequences({x: n * times for x, n in counts.items()})
    assert used(plan) == {x: n * times for x, n in counts.items()}
    assert plan.sequences == 4 * times


def test_every_filling_is_maximal_and_all_are_found():
    from itertools import product

    rng = random.Random(3)
    for _ in range(100):
        capacity = rng.randint(10, 40)
        counts = np.zeros(capacity + 1, np.int64)
        for _ in range(rng.randint(1, 8)):
            counts[rng.randint(1, capacity - 1)] += rng.randint(1, 3)
        first = int(np.nonzero(counts)[0][-1])
        left = {int(x): int(counts[x]) - (x == first) for x in np.nonzero(counts)[0]}
        want = set()
        for ks in product(*[range(n + 1) for n in left.values()]):
            room = capacity - first - sum(k * x for k, x in zip(ks, left))
            if room >= 0 and not any(x <= room and k < n for k, (x, n) in zip(ks, left.items())):
                want.add((first, *sorted((x for k, x in zip(ks, left) for _ in range(k)), reverse=True)))
        got = list(packing.every_filling(counts, first, capacity, iter(range(10**6))))
        assert len(got) == len(set(got)) and set(got) == want


def test_any_other_vocabulary(spark):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    texts = ["Hello there, don't", None, "É ü <|endoftext|> 12", " a  b"]
    rows = packing.cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    assert {r.doc_id: np.frombuffer(bytes(r.tokens), "<u4").tolist() for r in rows} == {i: [*other.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}


def test_hot_lengths_are_ranked_in_parts(spark):
    lengths = [2048] * 300 + [1500] * 400 + [548] * 390 + [7] * 2000
    frame = spark.createDataFrame([(i % 50, x) for i, x in enumerate(lengths)], "doc_id long, length long")
    rows = packing.assign(frame, ranked=64).collect()
    assert Counter(r.length for r in rows) == Counter(lengths)
    assert check_places(rows) == packing.plan_sequences(Counter(lengths)).sequences


def test_workers_keep_no_words(spark):
    """What a task has met goes with its end; a worker that waits would else hold it beside the stages that follow."""
    path = queries.tokenizer_path()
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(80)], "doc_id long, text string").repartition(8)
    assert packing.cut(docs, path).count() == 80

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, packing._KNOWN.values()))])], names=["n"])

    assert spark.range(0, 80, 1, 8).mapInArrow(held, "n long").agg({"n": "max"}).first()[0] == 0


def test_a_worker_holds_few_texts_at_a_time(spark, monkeypatch):
    """Some 4 MB of texts come to a worker at once, however many rows that is, and are tokenized 512 KB at a time."""
    asked = []

    class Spy(dict):
        def tokenize(self, texts):
            asked.append(sum(map(len, texts)))
            return [b"" for _ in texts]

    class Docs:
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
        select = lambda self, *_: self
        mapInArrow = lambda self, f, _: f  # noqa: E731, N815

    monkeypatch.setitem(packing._KNOWN, "spy", Spy())
    texts = ["a" * 10_000] * 400
    list(packing.cut(Docs(), "spy")(iter([pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts)], names=["doc_id", "text"])])))
    assert sum(asked) == 4_000_000 and max(asked) <= (1 << 19) + 10_000

    docs = spark.range(0, 1000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a"), 20_000).alias("text"))
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches)
    seen = [r.n for r in packing.written(docs.mapInArrow(sizes, "n long"), "sizes", batch_bytes=packing.TEXT_BYTES).collect()]
    assert sum(seen) >= 20_000_000 and max(seen) < 6_000_000
