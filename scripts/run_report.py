"""Run the full analysis on a data release and write the contingency report.

    spark-submit scripts/run_report.py \\
        --release s3://bucket/release --study-csv s3://bucket/study.csv \\
        --var-filter-lof SO_0001587,SO_0001589 \\
        --out s3://bucket/report --run-date 2024-06-01

The release holds ``evidence/sourceId=<source>/``, ``targets/``, ``diseases/``
and ``mechanismOfAction/`` Parquet folders.  The session comes from
spark-submit; on a cluster set ``spark.checkpoint.dir`` to a shared folder.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from doeffect.plans.inputs import release_inputs  # noqa: E402
from doeffect.plans.run import run  # noqa: E402


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--release", required=True, help="release root folder")
    parser.add_argument("--study-csv", required=True, help="curated gene-burden study list")
    parser.add_argument(
        "--var-filter-lof", required=True, help="comma-separated loss-of-function consequence ids"
    )
    parser.add_argument("--out", required=True, help="report folder (partitioned Parquet)")
    parser.add_argument("--run-date", required=True, help="run label, one partition per value")
    parser.add_argument("--ontology-csv", default=None, help="sequence ontology export (optional)")
    args = parser.parse_args()

    spark = SparkSession.builder.appName("doeffect-report").getOrCreate()
    inputs = release_inputs(
        spark,
        args.release,
        args.study_csv,
        [x.strip() for x in args.var_filter_lof.split(",") if x.strip()],
        ontology_csv=args.ontology_csv,
    )
    run(spark, inputs, args.out, args.run_date)
    spark.stop()


if __name__ == "__main__":
    main()
