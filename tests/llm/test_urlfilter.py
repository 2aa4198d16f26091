import re

import pytest

from candor.llm import queries, urlfilter

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(url):
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOW), re.match(r"[^?#]*", rest[len(host) :])[0]


def explicit(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "no scheme.net/", "http://net/", "HTTP://A.Example.NET/en/x?q=/de/", "http://example.net/EN/", "http://x.example.com/de/1", "http://example.com/de", "http://a.org/fr/", "http://org/fr/#a", "http://b.org/", "http://fakenet/x", "http://x.net", "http://x.net?a/b", "http://É.NET/é", "a://b://c.net/x", "http://x.net:80/", "http://\nx.net/", "http:///net/", "http://bad.example.com/spam/1", "x" * 50000 + "://y.net/"]


def test_explicit_rules(spark):
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS)] + [(3, URLS[3], "old")], "page_id long, url string, rule string")
    none = spark.createDataFrame([], "page_id long, quality int, toxic int")
    out = urlfilter.judge(pages, none).collect()
    assert len(out) == len(URLS) + 1
    for r in out:
        host, path = split(r.url)
        rule, verdict = explicit(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert urlfilter.judge(pages.limit(0), none).count() == 0


def tokens(url):
    host, path = split(url)
    query = re.match(r"[^#]*?\?([^#]*)", url or "")
    out = {f"h:{x}" for x in host.split(".") if x} | {f"p:{x.translate(LOW)}" for x in path.split("/") if x}
    return out | {f"q:{x.partition('=')[0].translate(LOW)}" for x in (query[1] if query else "").split("&") if x} if "://" in (url or "") else set()


def test_mined_rules_match_brute_force(spark):
    from itertools import combinations

    urls = [f"http://{h}.example.edu/{p}/{i}?{q}=1" for i in range(40) for h, p, q in [("spam", "buy", "ref"), ("spam", "news", "x"), ("good", "buy", "x"), ("good", "news", "ref")]]
    pages = [(i, u) for i, u in enumerate(urls)] + [(i + 1000, u + "&z=1") for i, u in enumerate(urls)]
    bad = {i: int(i % 4 == 0 or (i % 4 == 2 and i % 3 == 0)) for i in range(len(urls))}
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, b in bad.items()] + [(1, None, None), (None, 0, 1)], "page_id long, quality int, toxic int")
    frame = spark.createDataFrame(pages, "page_id long, url string")
    support, confidence = 0.05, 0.6
    baskets = [(tokens(u), bad[i]) for i, u in pages if i in bad]
    rules = {}
    for k in (1, 2, 3):
        for rule in {c for t, b in baskets if b for c in combinations(sorted(t), k)}:
            own = [b for t, b in baskets if t.issuperset(rule)]
            if sum(own) >= urlfilter.LEAST_URLS and sum(own) / len(baskets) >= support and sum(own) / len(own) >= confidence:
                rules[rule] = sum(own) / len(own)
    kept = {r: c for r, c in rules.items() if not any(set(s) < set(r) and rules[s] >= c for s in rules)}
    got = {tuple(r.rule): r.confidence for r in urlfilter.mine(frame, labels, support=support, confidence=confidence).collect()}
    assert got.keys() == kept.keys() and kept and all(abs(got[r] - kept[r]) < 1e-9 for r in got)
    for r in urlfilter.judge(frame, labels, support=support, confidence=confidence).collect():
        best = max((c for rule, c in kept.items() if tokens(r.url).issuperset(rule)), default=None)
        assert r.verdict == ("allow" if best is None else "block") and r.confidence == (best if best is None else pytest.approx(best))


def test_query(spark, sf):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = queries.op2_url_filters(spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:
        assert (r.host, r.path) == split(pages[r.page_id])
        rule, verdict = explicit(r.host, r.path)
        assert r.rule == rule and r.verdict == (verdict or ("allow" if r.confidence is None else "block"))


def test_copies_of_a_long_url_do_not_blow_up(spark):
    long = "http://a.b.c/" + "/".join(f"x{i}" for i in range(60))
    pages = spark.createDataFrame([(i, long if i % 3 == 0 else f"http://ok.b.c/{i}") for i in range(300)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "page_id long, quality int, toxic int")
    out = urlfilter.judge(pages, labels).collect()
    assert {(r.page_id % 3 == 0, r.verdict) for r in out} == {(True, "block"), (False, "allow")}


def mined(spark, rows, support, confidence):
    """Rules that are mined from (url, bad) rows, and those of counting every set of up to three tokens."""
    from itertools import combinations

    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, (_, b) in enumerate(rows)], "page_id long, quality int, toxic int")
    got = {tuple(r.rule): (r.confidence, r.support) for r in urlfilter.mine(pages, labels, support=support, confidence=confidence).collect()}
    seen = {}
    for u, b in rows:
        for rule in {c for k in (1, 2, 3) for c in combinations(sorted(tokens(u)), k)}:
            n, bad = seen.get(rule, (0, 0))
            seen[rule] = (n + 1, bad + b)
    rules = {r: (bad / n, bad / len(rows)) for r, (n, bad) in seen.items() if bad >= urlfilter.LEAST_URLS and bad / len(rows) >= support and bad / n >= confidence}
    return got, {r: v for r, v in rules.items() if not any(rules.get(s, (0,))[0] >= v[0] for k in range(1, len(r)) for s in combinations(r, k))}


def test_a_few_urls_are_no_rule(spark):
    got, want = mined(spark, [("http://a.b/x", 1)] * 4 + [("http://a.b/y", 1)] * 5 + [("http://a.b/z", 0)] * 90, 0.002, 0.6)
    assert got == want == {("p:y",): (1.0, pytest.approx(5 / 99))}


def test_whole_query_against_brute_force(spark, sf):
    """Every verdict of the registered query on the larger table, from counting all sets of up to three tokens."""
    from itertools import combinations

    sf = sf.replace("0.001", "0.1")
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    bad = {r.doc_id: int(r.quality == 0 or r.toxic == 1) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = {}
    known = [(tokens(pages[i]), b) for i, b in bad.items() if i in pages]
    known = [x for x in known if x[0] or x[1]]
    for own, b in known:
        for rule in {c for k in (1, 2, 3) for c in combinations(sorted(own), k)}:
            n, m = seen.get(rule, (0, 0))
            seen[rule] = (n + 1, m + b)
    rules = {r: m / n for r, (n, m) in seen.items() if m >= urlfilter.LEAST_URLS and m / len(known) >= urlfilter.SUPPORT and m / n >= urlfilter.CONFIDENCE}
    out = queries.op2_url_filters(spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:
        own = sorted(tokens(pages[r.page_id]))
        best = max((rules[c] for k in (1, 2, 3) for c in combinations(own, k) if c in rules), default=None)
        rule, verdict = explicit(*split(pages[r.page_id]))
        assert (r.rule, r.verdict) == (rule, verdict or ("allow" if best is None else "block")) and (best is None) == (r.confidence is None)


def test_long_good_urls_count_against_a_rule(spark):
    rows = [("http://www.shop.com/x", 1)] * 100 + [("http://www.shop.com/" + "/".join(f"g{k}" for k in range(14)) + f"/{i % 2}", 0) for i in range(200)]
    got, want = mined(spark, rows, 0.002, 0.6)
    assert got == want == {("p:x",): (1.0, pytest.approx(1 / 3))}
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, (_, b) in enumerate(rows)], "page_id long, quality int, toxic int")
    assert all((r.verdict == "block") == bool(rows[r.page_id][1]) for r in urlfilter.judge(pages, labels).collect())


def test_rules_of_long_urls_match_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = []
    for _ in range(60):  # near copies with mixed labels: no token tells by itself, and no two stand in the same URLs
        own = [f"t{k}" for k in range(28) if rng.random() < 0.7]
        rows.append(("http://a.b/" + "/".join(own), int(("t1" in own and "t2" in own) != (rng.random() < 0.2))))
    twins = "/".join(f"w{k}" for k in range(20))
    rows += [(f"http://c.d/{twins}?u&v", 1)] * 6 + [(f"http://c.d/{twins}?z", 0)] * 5 + [("http://c.d/?u&v", 0)] * 5
    got, want = mined(spark, rows, 0.05, 0.7)
    assert got.keys() == want.keys() and max(map(len, want)) == 3
    assert all(got[r] == pytest.approx(want[r]) for r in want)
    assert ("p:w0", "q:u") in want and ("p:w19", "q:v") in want
