import random
from collections import Counter

import numpy as np
import xxhash

from candor.llm import queries, simhash


def slow_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(ids))]


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = [slow_print(r.text) for r in docs]
    roots = slow_components([r.doc_id for r in docs], prints)
    out = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash_near_dedup(spark, sf).collect()}
    assert out == {r.doc_id: (f"{p:016x}", c) for r, p, c in zip(docs, prints, roots)}
    assert max(Counter(roots).values()) > 1


def test_odd_rows_and_dropping(spark):
    long = " ".join(f"w{i % 977}" for i in range(30000))
    texts = [None, "", " \n", "A b", "a B", "É x y z", "é x y z", long, long, long + " end"]
    docs = spark.createDataFrame([(None if i in (2, 5) else 20 - i, t, i) for i, t in enumerate(texts)] + [(1, "same text here now", 5)] * 3, "doc_id long, text string, component_id int")
    rows = docs.collect()
    want = slow_components([r.doc_id for r in rows], [slow_print(r.text) for r in rows])
    out = simhash.near_duplicates(docs.drop("component_id")).collect()
    assert sorted((str(r.doc_id), r.fingerprint % 2**64, str(r.component_id)) for r in out) == sorted((str(r.doc_id), slow_print(r.text), str(c)) for r, c in zip(rows, want))
    kept = simhash.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x or 0)) == sorted(set(want), key=lambda x: (x is None, x or 0))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.drop_duplicates(docs.limit(0)).count() == 0


def test_links_are_complete_with_small_chunks(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for b in base for _ in range(12)} | {0, 1, 3, 2**64 - 1, 2**64 - 2}
    prints |= {sum(1 << b for b in rng.sample(range(16), 2)) for _ in range(60)}
    prints = sorted(p % 2**64 for p in prints)
    frame = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)), i) for i, p in enumerate(prints)], "fingerprint long, low long")
    for tile, part in ((16, 40), (4096, 65536), (3, 5)):
        out = simhash.classes(frame, tile=tile, part=part).join(frame.select("fingerprint", frame["low"].alias("i")), "fingerprint").collect()
        assert [c for _, c in sorted((r.i, r.component_id) for r in out)] == slow_components(list(range(len(prints))), prints)


def test_no_task_gets_more_as_tiles_grow(spark):
    most = {}
    for n in (2000, 8000):
        # all in one tile and its neighbours: at most 60 of the chunk itself, and some 100 that it is compared with
        frame = spark.createDataFrame([(sum(1 << b for b in random.Random(i).sample(range(16), 8)) | i << 40,) for i in range(n)], "fingerprint long").distinct()
        groups = simhash.dealt(frame, 2, tile=30, part=100).groupBy("at", "role").count().collect()
        most[n] = max(r["count"] for r in groups)
    assert most[8000] < 1.3 * most[2000] + 30 and most[8000] < 250


def test_the_same_row_stays_whatever_the_order(spark):
    rows = [(1, "a b c d", f"x{i}", None) for i in range(50)]
    schema = "doc_id long, text string, other string, `odd.name` int"
    kept = [simhash.drop_duplicates(spark.createDataFrame(r, schema).repartition(k)).collect() for k, r in ((1, rows), (5, rows[::-1]))]
    assert kept[0] == kept[1] and len(kept[0]) == 1


def test_forest_keeps_components():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 200, (2, 150)).astype(np.uint64)
    x, y = simhash.forest(a, b)
    assert len(x) < len(set(a) | set(b))

    def groups(p, q):
        root = {int(v): int(v) for v in [*a, *b]}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for u, v in zip(p, q):
            root[find(int(u))] = find(int(v))
        by = {}
        for v in root:
            by.setdefault(find(v), set()).add(v)
        return sorted(map(sorted, by.values()))

    assert groups(a, b) == groups(x, y)
