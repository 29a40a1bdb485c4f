"""Times the headline queries; prints one JSON line.

The ledger is prepared once (``prepare``), as every query of a session shares it; each query is then run to completion
on all rows and columns.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from basketry.queries import REGISTRY  # noqa: E402
from basketry.queries.base import Tables  # noqa: E402
from basketry.session import build_session  # noqa: E402

HEADLINE = [
    "s00_ledger",
    "s02_clean",
    "b00_purchase_map",
    "b01_all_features",
    "b05_state_toggles",
    "r01_lags_on_grid",
    "r05_filled_limit",
    "d03_decayed_features",
    "d04_parameter_sets",
    "n01_cosine_neighbors",
    "n05_equal_attribute_blend",
    "a01_group_stats",
    "a02_each_attribute",
    "a10_amount_quartiles",
    "j06_oof_merge",
    "l02_warm_clients",
    "w04_final_weights",
    "k01_rank_by_probability",
    "k02_baseline_ndcg",
    "k04_rank_by_vector",
    "m09_model_discrepancy",
    "p08_blend",
    "p09_blend_weight_search",
    "p13_dataset",
    "p02_predictions",
]


def _finish(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "basketry-bench")
    spark.sparkContext.setLogLevel("ERROR")
    _finish(spark.range(1000).groupBy("id").count())  # start the executors and the code generator
    start = time.perf_counter()
    tables = Tables(spark, sf_dir)
    _finish(tables.ledger.groupBy("dt").count())
    _finish(tables.profile.groupBy("dt").count())
    times = {"prepare": round(time.perf_counter() - start, 3)}
    for name in HEADLINE:
        start = time.perf_counter()
        _finish(REGISTRY[name].run(spark, sf_dir))
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
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
