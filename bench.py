"""Headline queries, timed: prints one JSON line.

`BENCH_SF_DIR` names the data, `BENCH_CPUS` the threads. Every query is built and run to the end once (into Spark's
no-op sink, so every output column is computed) after one untimed query has started the JVM's compiler.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wardline import catalog  # noqa: E402
from wardline.session import build  # noqa: E402

HEADLINE = [
    "agg_count", "guarded_scan", "leak_predicate", "policy_ablation", "verify_tokens", "current_auth", "delegation_check",
    "audit_allow", "audit_verify", "audit_reconcile", "replay_live", "replay_cache",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build(
        "wardline-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    run = lambda n: catalog.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("whoami")
    took = {}
    for name in names:
        t0 = time.perf_counter()
        run(name)
        took[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
