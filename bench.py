"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from cairn.plans import registry
from cairn.runtime import build_session

HEADLINE = (
    "clean_rows", "column_profile", "eda_summary", "engineered_features", "standard_scale", "temporal_split", "correlation_matrix", "pca_variance", "hopkins",
    "distance_metric_diagnostics", "kmeans_search", "kmeans_grid", "hierarchy_cut", "dbscan_labels", "gmm_labels", "silhouette", "davies_bouldin", "ari", "agreement_matrix",
    "base_clusterings", "consensus_vs_best_base", "coassociation", "medoids", "anomaly_ranking", "cluster_profiles", "registry_assign", "psi", "ks", "drift_report", "gmm_search", "umap_layout",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, **{"spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("OFF")
    queries = registry.queries()
    queries["value_counts"](spark, sf).collect()  # the session's own start isn't timed
    seconds: dict[str, float] = {}
    for name in [q for q in sys.argv[1:] or HEADLINE]:
        began = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
