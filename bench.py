"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from candor.plans.queries import QUERIES
from candor.session import session

HEADLINE = "dup_text_max_sim label_model_fitted gbt_predictions shap_topk rrs_scores rrs_distribution pfake_histogram overview geo_breakdown reviews_per_user rating_distribution burst_days context_features user_gap_stats first_week_counts reviewer_features posting_hour_entropy text_features flesch enriched_reviews lf_votes lf_summary label_model_scores embedding_max_sim_label feature_table roc_auc average_precision search_businesses business_reviews_page".split()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{"spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["rrs_scores"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's workers
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
