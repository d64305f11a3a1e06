"""Command line: build one tenant's report for one period.

    python -m tracklens.cli --org_subdomain pip --source /data/detections \\
        --out /data/reports [--start 2026-01-19T00:00:00 --end 2026-01-19T23:59:59]

The period defaults to ``PERIOD_START`` / ``PERIOD_END`` from the
environment, then to one day.  ``--source`` is a folder holding one
Parquet table per tenant (``<source>/<table name>``) or, with
``--database``, a catalog database.  Results are written (never printed)
under ``<out>/org=<slug>/period=<start>_to_<end>/``.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from tracklens.params import DEFAULT_MIN_POINTS, DEFAULT_PRECISION, Period, ThinParams, validate_slug
from tracklens.plans.report import build_report
from tracklens.sources.detections import tenant_detections

# --- fixed values: the default reporting period ---
DEFAULT_START = "2026-01-19T00:00:00"
DEFAULT_END = "2026-01-19T23:59:59"
# --------------------------------------------------


def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tracklens")
    p.add_argument("--org_subdomain", required=True)
    p.add_argument("--source", help="folder with one Parquet table per tenant")
    p.add_argument("--database", help="catalog database holding the tenant tables")
    p.add_argument("--out", required=True)
    p.add_argument("--start", default=os.environ.get("PERIOD_START", DEFAULT_START))
    p.add_argument("--end", default=os.environ.get("PERIOD_END", DEFAULT_END))
    p.add_argument("--max-tracks", type=int, help="keep the tracks seen first (the report page: 500); all by default")
    p.add_argument("--date-col", help="date partition column of the raw table")
    p.add_argument("--map-precision", type=int, default=DEFAULT_PRECISION)
    p.add_argument("--map-min-points", type=int, default=DEFAULT_MIN_POINTS)
    p.add_argument("--thin-interval-ms", type=int, default=ThinParams().interval_ms)
    p.add_argument("--min-distance-m", type=float, default=ThinParams().min_distance_m)
    p.add_argument("--format", default="json")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, str]:
    args = parse_args(argv)
    org = validate_slug(args.org_subdomain)
    if not args.source and not args.database:
        raise SystemExit("one of --source or --database is required")
    spark = spark or SparkSession.builder.appName(f"tracklens-{org}").getOrCreate()
    raw = tenant_detections(spark, org, database=args.database, root=args.source)
    period = Period(args.start, args.end)
    thin = ThinParams(args.max_tracks, args.thin_interval_ms, args.min_distance_m)
    paths = build_report(
        spark, raw, org, period, args.out, thin, fmt=args.format, date_col=args.date_col,
        map_precision=args.map_precision, map_min_points=args.map_min_points,
    )
    print(json.dumps(paths), file=sys.stderr)
    return paths


if __name__ == "__main__":
    main()
