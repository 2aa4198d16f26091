from collections import defaultdict

import pytest

from candor.llm import linededup


def brute(rows, least):
    sites, keeper = defaultdict(set), {}
    trim = lambda x: x.strip(" \t\n\x0b\x0c\r")
    for d, t, s in rows:
        for x in map(trim, (t or "").split("\n")):
            if x:
                if s is not None:
                    sites[x].add(s)
                if d is not None:
                    keeper[x] = min(d, keeper.get(x, d))
    out = []
    for d, t, _ in rows:
        if t is None:
            out.append((d, 0, 0, None))
            continue
        lines = t.split("\n")
        left = [x for x in lines if not (len(sites[trim(x)]) >= least and keeper.get(trim(x)) != d)]
        out.append((d, len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def rows(df):
    return [(r.doc_id, r.n_lines, r.n_removed, r.text) for r in df.collect()]


@pytest.mark.parametrize("least", [3, 10])
def test_against_brute_force(spark, sf, least):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text, r.source) for r in docs.collect()], least)
    assert sorted(rows(linededup.drop_boilerplate(docs, min_sites=least))) == sorted(want)
    assert any(w[2] for w in want)


def test_many_sites_and_near_threshold(spark):
    data = [(k * 1000 + s, f"head {k}\nown {k} {s}", f"s{s}") for k, n in enumerate([1, 98, 99, 100, 101, 102, 140, 400]) for s in range(n)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    assert sorted(rows(linededup.drop_boilerplate(docs, min_sites=100))) == sorted(brute(data, 100))


def test_odd_rows(spark):
    long = "\n".join(f"line {i}" for i in range(5000))
    data = [(1, None, "a"), (2, "", "b"), (3, " same \nx\n\nx", "a"), (4, "same", "b"), (4, "same", "b"), (None, "same\ny", None), (None, "same", "c"), (7, long, "a"), (8, long, "b"), (9, long + "\n", "c"), (10, "only null\n", None)]
    docs = spark.createDataFrame([(*r, 1, "t") for r in data], "doc_id long, text string, source string, hash int, n_lines string")
    key = lambda x: str(x)
    out = linededup.drop_boilerplate(docs, min_sites=3)
    assert sorted(rows(out), key=key) == sorted(brute(data, 3), key=key)
    assert out.columns == ["doc_id", "text", "source", "hash", "n_lines", "n_removed"]
    assert linededup.drop_boilerplate(docs.limit(0)).count() == 0
