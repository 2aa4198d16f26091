import hashlib
import re

import pytest

from candor.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), 10)
        for p in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[p : p + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for p in range(len(w) - n + 1):
                if (own := wins.get(tuple(w[p : p + n]))) is not None:
                    hit |= set(range(p, p + n))
                    found |= own
        ids = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def rows(df):
    return [(r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in df.collect()]


def test_against_brute_force(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute(((r.doc_id, r.text) for r in docs.collect()), [tuple(r) for r in items.collect()])
    assert sorted(rows(decontam.scan(docs, items))) == sorted(want) and any(w[5] for w in want)


@pytest.fixture
def odd(spark):
    ten = "one two Three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, ten + " eleven"), (2, "ÉA short"), (3, None), (4, ""), (None, "x y z q"), (10, ten), (10, ten), (5, "...")], "item_id long, text string")
    texts = [None, "", "..", "zero ONE, two\nthree four-five six seven eight nine ten! eleven twelve", "éa short", "ÉA-SHORT; ÉA short", "x y z q", ("pad " * 20 + ten + " ") * 300, "one two three", "ÉA short", "ÉA short"]
    docs = spark.createDataFrame([(i if i != 6 else None, t, "h", 7) for i, t in enumerate(texts)], "doc_id long, text string, hits string, Key int")
    return docs, items


def test_odd_rows(spark, odd):
    docs, items = odd
    want = brute(((r.doc_id, r.text) for r in docs.collect()), [tuple(r) for r in items.collect()])
    key = lambda x: str(x)
    assert sorted(rows(decontam.scan(docs, items)), key=key) == sorted(want, key=key)
    assert decontam.scan(docs.limit(0), items).count() == 0
    assert not any(r[5] for r in rows(decontam.scan(docs, items.limit(0))))


def test_drop_and_cut(spark, odd):
    docs, items = odd
    bad = {w[0] for w in brute(((r.doc_id, r.text) for r in docs.collect()), [tuple(r) for r in items.collect()]) if w[5]}
    kept = decontam.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({*range(11), None} - {6} - bad, key=lambda x: x or 0)
    cut = {r.doc_id: r.text for r in decontam.cut_spans(docs, items).collect()}
    assert cut[3] == "zero twelve" and cut[4] == "éa short" and cut[0] is None and words(cut[7]) == ["pad"] * 6000
