"""python -m candor PHASE ROOT [options]: ingest, profile, label, features, train, score or serve."""

from __future__ import annotations

import argparse

from candor.config import DEFAULT_METRO, METROS
from candor.plans import http, phases
from candor.session import session


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="candor")
    sub = parser.add_subparsers(dest="phase", required=True)
    for name in ("ingest", "profile", "label", "features", "train", "score", "serve"):
        p = sub.add_parser(name)
        p.add_argument("root")
        if name == "ingest":
            p.add_argument("raw")
            p.add_argument("--metro", default=DEFAULT_METRO, choices=sorted(METROS))
        elif name == "features":
            p.add_argument("--sample", type=int)
            p.add_argument("--skip-embeddings", action="store_true")
        elif name == "train":
            p.add_argument("--trials", type=int, default=phases.model.TRIALS)
        elif name == "score":
            p.add_argument("--prior-weight", type=float, default=phases.scoring.PRIOR_WEIGHT)
        elif name == "serve":
            p.add_argument("--port", type=int, default=8000)
    a = parser.parse_args(argv)
    spark = session()
    run = {
        "ingest": lambda: phases.ingest(spark, a.root, a.raw, a.metro), "profile": lambda: phases.profile_tables(spark, a.root), "label": lambda: phases.label(spark, a.root),
        "features": lambda: phases.build_features(spark, a.root, sample=a.sample, embed=not a.skip_embeddings), "train": lambda: phases.train(spark, a.root, a.trials), "score": lambda: phases.score(spark, a.root, a.prior_weight),
        "serve": lambda: http.serve(http.Service(spark, a.root), a.port).serve_forever(),
    }
    print(run[a.phase]())


if __name__ == "__main__":
    main()
