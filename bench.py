"""Time the headline queries; prints one JSON line.

The time of a query is the median of three passes, the first of which also warms up; the
model queries, which take many seconds, are timed once and have a total of their own. The result is fully computed
into Spark's no-op sink, so neither column pruning nor the driver shortens the work.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tenure.session import build_session, release_staging  # noqa: E402
from verification.queries import REGISTRY  # noqa: E402

HEADLINE = [
    "subscription_cohort", "cohort_via_users", "user_flags", "action_features_prefix",
    "weekly_update_features", "wide_update_features", "update_summary", "update_growth",
    "update_recency", "support_email_features", "churn_dataset", "scoring_dataset",
    "derived_flags", "share_within_label", "density_log", "ecdf_continuous", "deciles_by_label",
    "label_correlations", "auc_by_group", "threshold_metrics", "categorical_rate_model",
    "binned_rate_model", "single_variable_report", "upsert_predictions", "logit_scores",
    "feature_file_dataset",
]
MODELS = [
    "forest_scores", "network_scores", "support_vector_scores", "permutation_importance",
    "forest_cross_validation", "export_validation",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or [*HEADLINE, *MODELS]
    times: dict[str, float] = {}
    for name in chosen:
        passes = []
        for _ in range(1 if name in MODELS else 3):
            start = time.perf_counter()
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            passes.append(time.perf_counter() - start)
        times[name] = round(median(passes), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(t for n, t in times.items() if n not in MODELS), 3),
                "models_total": round(sum(t for n, t in times.items() if n in MODELS), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    release_staging(spark)
    spark.stop()


if __name__ == "__main__":
    main()
