"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

The inputs are a data release made once of the tables before anything is
timed: one ``sourceId=`` folder a source, entity tables and the study list, as
the analysis reads them.  ``from_tables`` has the same queries with every
source derived from ``lineitem`` inside the timed part, as in earlier rounds.

Each query is executed in full with the ``noop`` sink (every row computed,
nothing collected to the driver), with nothing cached from the one before.
The seconds are those to build the plan and run it, ``build`` the part of them
before the run, ``open`` those to list the release and read its footers, once.
``end_to_end`` is the production run: assessment -> scored subsets
(checkpointed) -> contingency report written as partitioned Parquet.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from doeffect.plans.inputs import fixture_inputs, release_inputs
    from doeffect.plans.registry import HEADLINE
    from doeffect.plans.run import run
    from doeffect.session import local_session
    from doeffect.sources.fixtures import FIXTURE_VAR_FILTER_LOF, write_release

    spark = local_session(
        cores=cpus,
        shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", int(cpus) * 2)),
        app="doeffect-bench",
    )
    spark.sparkContext.setLogLevel("ERROR")
    scratch = tempfile.mkdtemp(prefix="doeffect-bench-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(os.path.join(scratch, "ckpt"))

    def release(tables: str, name: str):
        root = write_release(spark, tables, os.path.join(scratch, name))
        t0 = time.perf_counter()
        return release_inputs(spark, root, f"{root}/study.csv", FIXTURE_VAR_FILTER_LOF), time.perf_counter() - t0

    # Warm-up on the smallest tables: JVM start, class loading, compiling the
    # generated code of every stage (identical at any scale).
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    warm_inputs, _ = release(warm if os.path.isdir(warm) else sf_dir, "warm-release")
    HEADLINE["contingency_grid"](warm_inputs).write.format("noop").mode("overwrite").save()

    def timed(open_inputs, name: str) -> tuple[dict, dict]:
        times: dict[str, float] = {}
        build: dict[str, float] = {}
        for query, of in HEADLINE.items():
            spark.catalog.clearCache()
            t0 = time.perf_counter()
            df = of(open_inputs())
            build[query] = round(time.perf_counter() - t0, 3)
            df.write.format("noop").mode("overwrite").save()
            times[query] = round(time.perf_counter() - t0, 3)
        spark.catalog.clearCache()
        t0 = time.perf_counter()
        run(spark, open_inputs(), os.path.join(scratch, f"report-{name}"), "bench")
        times["end_to_end"] = round(time.perf_counter() - t0, 3)
        return times, build

    inputs, opened = release(sf_dir, "release")
    times, build = timed(lambda: inputs, "release")
    tables, _ = timed(lambda: fixture_inputs(spark, sf_dir), "tables")

    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_sec",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "build": build,
                "open": round(opened, 3),
                "from_tables": tables,
                "from_tables_total": round(sum(tables.values()), 3),
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
