import json
import random
import threading
import urllib.error
import urllib.request

import pytest

from candor import __main__ as cli
from candor.operators.model import Settings
from candor.plans import http, phases


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """A small made-up dataset, taken through every phase."""
    raw, root = tmp_path_factory.mktemp("raw"), str(tmp_path_factory.mktemp("root"))
    rng = random.Random(0)
    words = "the food was great and we loved it but service is slow my friend said not bad really nice place".split()
    stamp = lambda: f"{rng.randint(2015, 2021)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d} {rng.randint(0, 23):02d}:00:00"
    tables = {
        "business": [{"business_id": f"b{i}", "name": f"Cafe {i}", "city": "Boise", "state": "ID", "stars": 3.5, "review_count": 10 + i, "categories": "Food"} for i in range(8)],
        "user": [{"user_id": f"u{i}", "name": "n", "review_count": rng.randint(1, 40), "yelping_since": "2014-01-01 00:00:00", "fans": rng.randint(0, 9), "friends": rng.choice(["None", "a, b"]), "average_stars": 3.5, "compliment_photos": rng.randint(0, 2)} for i in range(40)],
        "review": [{"review_id": f"r{i}", "user_id": f"u{rng.randint(0, 41)}", "business_id": f"b{rng.randint(0, 7)}", "stars": rng.randint(1, 5), "text": " ".join(rng.choices(words, k=rng.randint(3, 60))) + rng.choice(["", "!!!"]), "date": stamp()} for i in range(500)],
        "tip": [{"user_id": "u1", "business_id": "b1", "text": "t", "date": stamp()}],
        "checkin": [{"business_id": "b1", "date": stamp()}],
    }
    for name, rows in tables.items():
        (raw / f"yelp_academic_dataset_{name}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    assert phases.ingest(spark, root, str(raw), "boise")["reviews"] == 500
    assert "| reviews | 500 |" in phases.profile_tables(spark, root)
    assert phases.label(spark, root) == 500
    assert phases.build_features(spark, root) == 500
    metrics = phases.train(spark, root, settings=Settings(rounds=8, depth=3, least_rows=5))
    assert 0 < metrics["roc_auc"] <= 1
    assert phases.score(spark, root) == 8
    return root


def test_tables_and_reports(spark, root):
    assert len(spark.read.parquet(f"{root}/features").columns) == 36
    sims = spark.read.parquet(f"{root}/features").agg({"max_sim_to_user_history": "max", "max_sim_to_business_reviews": "min"}).first()
    assert sims[0] <= 1.0001 and sims[1] > -1.0001
    assert spark.read.parquet(f"{root}/predictions").count() == 500
    assert spark.read.parquet(f"{root}/importances").count() == 30
    for name in ("profile", "labels", "model", "scores"):
        assert spark.read.text(f"{root}/reports/{name}_boise").first()[0].startswith("# ")


def test_search_over_settings(spark, root):
    from candor.operators import features, model

    joined = features.join_labels(spark.read.parquet(f"{root}/features"), spark.read.parquet(f"{root}/labels"))
    past, _ = features.time_split(joined)
    chosen, auc = model.tune(past, ["stars", "char_length", "fan_count"], "2019-01-01", trials=2)
    assert 0 < auc <= 1 and chosen != model.Settings()


def test_http(spark, root):
    service = http.Service(spark, root)
    server = http.serve(service, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def get(path):
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}", timeout=60) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert get("/health") == (200, {"status": "ok", "metro": "boise"})
    status, found = get("/businesses/search?q=cafe&limit=3")
    assert status == 200 and len(found) == 3 and found[0]["business_id"] == "b7"
    assert get("/businesses/b2")[1]["n_reviews"] > 0 and get("/businesses/zz")[0] == 404
    status, page = get("/businesses/b2/reviews?limit=5")
    assert status == 200 and len(page) == 5 and all(len(r["signals"]) <= 3 and 0 <= r["p_fake"] <= 1 for r in page)
    assert all(r["signals"] == [] for r in get("/businesses/b2/reviews?include_flags=false&limit=2")[1])
    assert get("/businesses/search?q=cafe&limit=0")[0] == 422 and get("/businesses/b2/reviews?limit=x")[0] == 422 and get("/nothing")[0] == 404
    server.shutdown()


def test_command_line():
    with pytest.raises(SystemExit):
        cli.main(["ingest", "/nowhere", "/raw", "--metro", "atlantis"])
