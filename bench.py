"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from shutterlake.catalog import registry  # noqa: E402
from shutterlake.session import local_session  # noqa: E402

HEADLINE = (
    "wasted_space_by_library",
    "c1_reconcile",
    "e1_keep_best",
    "e5_collision_names",
    "h4_average_hash",
    "c17_d7_hash_distance_stats",
    "i8_segment_events",
    "i8_segment_events_per_owner",
    "d11_event_summary",
    "i9_group_similar",
    "d14_centroids",
    "d15_cluster_statistics",
    "d25_separation",
    "c12_knn_join",
    "i1_similarity_join",
    "c14_cluster_candidates",
    "c15_search_prefiltered",
    "i3_connected_components",
    "i4_seed_clusters",
    "i5_assign_noise",
    "i6_merge_clusters",
    "i10_dbscan",
    "i12_average_linkage",
    "i14_boundary_suggestions",
    "i15_outlier_suggestions",
    "i17_full_clustering",
    "c22_triplets",
    "k2_session_stream",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = local_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = registry()

    def run(name: str) -> float:
        at = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - at

    # One untimed query starts the JVM's compiler and the Python workers.
    run("c12_knn_join")
    times = {n: round(run(n), 3) for n in HEADLINE if not only or n in only}
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
