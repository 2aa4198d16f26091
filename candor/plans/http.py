"""The four requests over HTTP, with nothing but the standard library."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import SparkSession

from candor.plans import phases, serving
from candor.sources import ingest


class Service:
    """Answers paths with a status and a body."""

    def __init__(self, spark: SparkSession, root: str):
        self.businesses, self.reviews = (ingest.read_table(spark, f"{root}/tables/{n}") for n in ("businesses", "reviews"))
        self.scores, self.predictions, self.features = (ingest.read_table(spark, f"{root}/{n}") for n in ("scores", "predictions", "features"))
        self.model = phases.load_model(spark, root)
        self.metro = serving.latest_metro(spark, ingest.read_table(spark, f"{root}/tables/meta"))

    def answer(self, target: str) -> tuple[int, object]:
        url = urlsplit(target)
        q = {k: v[-1] for k, v in parse_qs(url.query).items()}
        parts = [unquote(p) for p in url.path.strip("/").split("/")]
        try:
            match parts:
                case ["health"]:
                    return 200, serving.health(self.metro)
                case ["businesses", "search"]:
                    found = serving.search_businesses(self.businesses, self.scores, q.get("q", ""), q.get("city"), int(q.get("limit", serving.SEARCH_LIMIT)))
                    return 200, [r.asDict() for r in found.collect()]
                case ["businesses", business]:
                    return 200, serving.business_detail(self.businesses, self.scores, business).first().asDict()
                case ["businesses", business, "reviews"]:
                    flags = q.get("include_flags", "true").lower() in ("1", "true", "yes", "on")
                    return 200, serving.review_page_json(self.businesses, self.reviews, self.predictions, business, self.features, self.model, flags, int(q.get("limit", serving.PAGE_LIMIT)), int(q.get("offset", 0)))
        except serving.NotFound as e:
            return 404, {"detail": str(e)}
        except ValueError as e:
            return 422, {"detail": str(e)}
        return 404, {"detail": "unknown path"}


def serve(service: Service, port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, body = service.answer(self.path)
            data = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
