import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from candor.llm import lmscore, queries

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORDS.findall((text or "").translate(LOW)), None]


def crc(i):
    return zlib.crc32((str(i) if i is not None else "").encode())


def brute(rows, order, rounds=lmscore.ROUNDS, dev=lmscore.DEV):
    """The same model with dictionaries."""
    train = [(i, t) for i, t in rows if crc(i) % 7 != 2]
    held = [(i, t) for i, t in train if crc(i) // 7 % dev == 0]

    def counted(part):
        grams, contexts = Counter(), Counter()
        for _, t in part:
            line = [0] * (order - 1) + tokens(t)
            for j in range(order - 1, len(line)):
                for k in range(order):
                    grams[tuple(line[j - k : j + 1])] += 1
                    contexts[tuple(line[j - k : j])] += 1
        return grams, contexts

    every, kept = counted(train), counted([x for x in train if x not in held])
    n, v = sum(c for g, c in every[0].items() if len(g) == 1), sum(len(g) == 1 for g in every[0])

    def situation(line, j, grams, contexts):
        p = [1 / (v + 1), grams[(line[j],)] / max(contexts[()], 1)]  # the empty context: all tokens that are counted
        for k in range(1, order):
            c = contexts[tuple(line[j - k : j])]
            p.append(grams[tuple(line[j - k : j + 1])] / c if c else 0.0)
        c = contexts[tuple(line[j - order + 1 : j])] if order > 1 else 0
        return p, min(c.bit_length(), lmscore.BUCKETS - 1)

    weights = np.full((lmscore.BUCKETS, order + 1), 1 / (order + 1))
    seen = [situation(line, j, *kept) for line in ([0] * (order - 1) + tokens(t) for _, t in held) for j in range(order - 1, len(line))]
    for _ in range(rounds):
        sums = np.zeros_like(weights)
        for p, b in seen:
            m = weights[b] * p
            sums[b] += m / m.sum()
        last = weights.copy()
        for b in np.nonzero(sums.sum(axis=1))[0]:
            weights[b] = sums[b] / sums[b].sum()
        if np.abs(weights - last).max() < 1e-4:
            break
    weights[:, 0] = np.maximum(weights[:, 0], 1e-6)
    weights /= weights.sum(axis=1, keepdims=True)
    out = []
    for i, t in rows:
        line = [0] * (order - 1) + tokens(t)
        base = mixed = 0.0
        known = 0
        for j in range(order - 1, len(line)):
            c = every[0][(line[j],)]
            known += c > 0
            base += math.log10((c + 1) / (n + v + 1))
            p, b = situation(line, j, *every)
            mixed += math.log10(float(weights[b] @ p))
        out.append((str(i), crc(i) % 7 != 2, len(line) - order + 1, known, n, base, mixed))
    return out


def same(df, want):
    rows = df if isinstance(df, list) else df.collect()
    got = sorted((str(r.doc_id), r.train, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows)
    want = sorted(want)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-6)


def train():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) != 2


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force(spark, sf, order):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 120")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], order)
    same(lmscore.score(docs, train(), order=order, block_chars=40_000, shard_chars=50_000), want)


def test_odd_rows(spark):
    rows = [(None, "a b A b"), (1, None), (2, ""), (3, "É x É y"), (3, "É x É y"), *((i, f"a b c{i % 5} \x1f a b") for i in range(4, 400)), (500, "a b c " * 30000)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_tokens int")
    same(lmscore.score(docs, train()), brute(rows, 3))
    assert lmscore.score(docs.limit(0), train()).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in lmscore.score(docs, F.lit(False)).collect()}
    assert out[1].n_tokens == 3 and out[1].n_known == 0 and out[1].base_score == 0 and out[1].train_tokens == 0


def test_query_beats_the_base(spark, sf):
    out = queries.op5_lm_scoring(spark, sf).filter("held_out").collect()
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_masses_of_equal_rows_are_dealt_out(spark):
    docs = spark.range(100_000).select(F.lit(4).alias("doc_id"), F.lit("a b a").alias("text"))
    blocks = lmscore.blocked(docs, "doc_id", "text", train(), F.lit(False), 20_000)
    sizes = [r.chars for r in blocks.select("chars").collect()]
    assert sum(sizes) == 600_000 and len(sizes) >= 20 and max(sizes) <= 20_006
    rows = lmscore.score(docs.union(spark.createDataFrame([(5, "b c")], "doc_id int, text string")), train(), block_chars=20_000, shard_chars=10_000).distinct().collect()
    same(rows, {r for r in brute([(4, "a b a")] * 100_000 + [(5, "b c")], 3)})


def test_slices_of_a_block_add_up(monkeypatch):
    texts = [("a b c " * 30 + f"d{i} " * (i % 3)).encode() for i in range(20)]
    dealer = lmscore.Dealer()
    for i, t in enumerate(texts):
        dealer.add(i, t)
    tokens, words = dealer.payload()
    table = lmscore.pa.table({"dev": [False], "ids": [list(range(20))], "train": [[i % 4 > 0 for i in range(20)]], "sizes": [lmscore.packed(np.array(dealer.sizes, "<i8"))], "tokens": [tokens], "words": [words]})
    found = {}
    for size in (1 << 19, 7, 1):
        monkeypatch.setattr(lmscore, "SLICE", size)
        block = lmscore.Block(table, 3)
        alive = np.arange(len(block.learned)) % 3 > 0
        keys, *counts = block.distinct((1, 2), None)
        some, *fewer = block.distinct((3,), alive)
        found[size] = [x.tolist() for x in (keys, *counts, some, *fewer, *block.totals(2, None, keys, *counts), *block.totals(3, alive, some, *fewer))]
    assert found[7] == found[1] == found[1 << 19] and sum(found[7][1]) == 2 * len(alive)
