"""Bench: fresh ingest (parse + categorise + score + write) and every
registered query run to completion, on $BENCH_SF_DIR with local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Queries are executed with the ``noop`` sink, so every row is computed and
nothing is collected to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from logweave.plans import store
    from logweave.plans.catalog import QUERIES
    from logweave.session import get_session
    from logweave.sources.tables import read_table

    spark = get_session(f"local[{cpus}]", app="logweave-bench", shuffle_partitions=int(cpus) * 2)
    n_lines = read_table(spark, sf_dir, "events").count()

    t0 = time.time()
    store.materialize(spark, sf_dir, force=True)
    ingest = time.time() - t0

    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t, 3)
        except Exception as e:  # noqa: BLE001
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    total = round(sum(times.values()), 3)
    out = {
        "metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")), "ingest_sec": round(ingest, 3),
        "ingest_lines": n_lines, "ingest_lines_per_sec": round(n_lines / ingest, 1) if ingest else None,
        "n_queries": len(times), "cpus": int(cpus),
    }
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
