import gzip
import hashlib
import io

import pytest

from candor.llm import queries, warc


def brute(pages):
    last = {}
    for i, h in pages:
        h = (h or "").encode()
        if len(h) >= 1000 and i is not None:
            last[h] = max(i, last.get(h, i))
    out = []
    for i, h in pages:
        h = (h or "").encode()
        to = last.get(h)
        out.append((i, len(h), hashlib.sha1(h).hexdigest(), *(("response", None) if to is None or to == i else ("revisit", to))))
    return out


def rows(df):
    return [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()]


def test_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert sorted(rows(queries.op7_warc(spark, sf)), key=str) == sorted(brute([(r.page_id, r.html) for r in pages.collect()]), key=str)


@pytest.fixture
def odd(spark):
    big = "é" * 700
    data = [(1, "http://a/é b\r\nX: y", big), (2, None, big), (None, "u", big), (2, "v", big), (3, "w", None), (4, "", ""), (5, "x", "short"), (6, "x", "short"), (None, "y", "z" * 2000), (None, "y", "z" * 2000), (7, "r", "a\r\n\r\nWARC/1.1\r\n\r\n" * 400), (8, "huge", "0123456789abcdef" * (1 << 20) + "!")]
    return data, spark.createDataFrame([(*r, "t") for r in data], "page_id long, url string, html string, _sum string")


def test_odd_rows(spark, odd, tmp_path):
    data, pages = odd
    path = f"file://{tmp_path}/warc"
    warc.write_archives(pages, path)
    back = warc.read_archives(spark, path)
    assert sorted(rows(back), key=str) == sorted(brute([(r[0], r[2]) for r in data]), key=str)
    full = {(r.page_id, bytes(r.payload)) for r in back.filter("record_type = 'response'").collect()}
    assert (7, data[10][2].encode()) in full and (8, data[11][2].encode()) in full and (2, data[0][2].encode()) in full
    for f in (tmp_path / "warc").glob("part-*"):  # any gzip reader takes the files
        assert gzip.decompress(f.read_bytes()).count(b"WARC-Record-ID") >= 0
    assert rows(warc.round_trip(pages.limit(0))) == []


def one(payload=b"<p>" * 900):
    return warc.member("response", 5, "http://a.b/", payload, None, "2020-01-01T00:00:00Z")


class Drip(io.BytesIO):
    def read(self, n=-1):
        return super().read(min(n, 7) if n and n > 0 else 7)


def test_reader_is_incremental_and_strict():
    data = one() + one(b"") + one(b"x" * 70_000)
    whole = list(warc.read_records(io.BytesIO(data)))
    assert [r.http()[1] for r in whole] == [b"<p>" * 900, b"", b"x" * 70_000]
    assert [r.http()[1] for r in warc.read_records(Drip(data))] == [r.http()[1] for r in whole]
    assert whole[1].offset == len(one()) and not any(r.problems for r in whole)
    assert list(warc.read_records(io.BytesIO(b""))) == []
    with pytest.raises(warc.WarcError, match="cut off"):
        list(warc.read_records(io.BytesIO(data[:-5])))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(data + b"junk")))
    plain = gzip.decompress(one(b"hello"))
    (bad,) = warc.read_records(io.BytesIO(gzip.compress(plain.replace(b"hello", b"hullo"))))
    assert bad.problems == ["block digest", "payload digest"]
    with pytest.raises(warc.WarcError, match="content length"):
        list(warc.read_records(io.BytesIO(gzip.compress(plain + b"more"))))
    with pytest.raises(warc.WarcError, match="content length"):
        list(warc.read_records(io.BytesIO(gzip.compress(plain[:-6]))))


def test_damage_stops_the_query(spark, tmp_path):
    (tmp_path / "a").write_bytes(gzip.compress(gzip.decompress(one(b"hello")).replace(b"hello", b"hullo")))
    with pytest.raises(Exception, match="wrong block digest"):
        warc.read_archives(spark, f"file://{tmp_path}").collect()


def test_headers_of_any_length():
    url = "http://a/" + "é \n" * 1_000_000
    data = warc.member("response", 1, url, b"x" * 2000, None, "d") + warc.member("response", 2, "u", b"y", None, "d")
    first, second = warc.read_records(io.BytesIO(data))
    assert first.headers["warc-target-uri"] == url.replace(" ", "%20").replace("\n", "%0A") and first.http()[1] == b"x" * 2000
    assert second.http()[1] == b"y" and not first.problems + second.problems
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(gzip.compress(b"WARC/1.1\r\n" + b"a" * 3_000_000))))
