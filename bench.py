"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Every query is planned and
run to completion into a sink that discards rows; the time includes any job it starts
while being built.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pairframe.plans import load_queries  # noqa: E402
from pairframe.session import build_session  # noqa: E402

HEADLINE = (
    "obs_conform obs_generated_id obs_ordered_id select_ids select_cells min_count_filter dataset_summary lookup_map "
    "intersect_keys metadata_join feature_variance variance_filter scale_features fingerprint_bits encode_matrix encode_pair "
    "scale_global scale_grouped scale_grouped_parts scale_grouped_matrix scale_fit_apply sample_obs sample_cells shuffle_rank "
    "stratified_holdout holdout_small_strata apply_split kfold_splits batch_assign batch_ordered batch_ordered_text batch_slice batch_features batch_store metric_by_drug "
    "graph_walk graph_conv graph_conv_walked graph_maxpool graph_avgpool softmax_pool additive_score vector_dot "
    "bundle_roundtrip metric_bundle csv_quoted csv_missing gmt_sets delimited_rows response_regression stream_scale_encode"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load_queries().QUERIES
    catalog["scale_grouped"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    times = {}
    for name in names:
        if name not in catalog:
            raise KeyError(f"no query {name!r}")
        start = time.perf_counter()
        catalog[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
