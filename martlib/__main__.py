"""Command line: build the star schema, train the model, or forecast from stored tables.

    python -m martlib build-star --csv RAW.csv --dump RAW.sql --star STAR
    python -m martlib train --star STAR --model MODEL [--no-tune]
    python -m martlib forecast --star STAR --model MODEL --weeks 12 --out OUT
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from martlib.operators import forecast, model, panel
from martlib.operators.star import build_star, read_star, verify_counts
from martlib.plans import pipeline
from martlib.sources.raw import resolve_raw, write_raw_table
from martlib.storage import new_path


def _arguments() -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="martlib")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build-star")
    build.add_argument("--csv", required=True)
    build.add_argument("--dump", required=True)
    build.add_argument("--star", required=True)
    build.add_argument("--week-rule", default="monday_w1", choices=["monday_w1", "iso"])
    train = commands.add_parser("train")
    train.add_argument("--star", required=True)
    train.add_argument("--model", required=True)
    train.add_argument("--split-date", default=pipeline.SPLIT_DATE)
    train.add_argument("--no-tune", action="store_true")
    ahead = commands.add_parser("forecast")
    ahead.add_argument("--star", required=True)
    ahead.add_argument("--model", required=True)
    ahead.add_argument("--weeks", type=int, default=12)
    ahead.add_argument("--out", required=True)
    return parser.parse_args()


def main() -> None:
    args = _arguments()
    spark = SparkSession.builder.appName("martlib").getOrCreate()
    if args.command == "build-star":
        raw = resolve_raw(spark, args.csv, args.dump)
        table = write_raw_table(raw, new_path(spark, "weekly-sales"))
        verify_counts(build_star(table, args.star, args.week_rule)).show(truncate=False)
    elif args.command == "train":
        trained = pipeline.train_pipeline(
            read_star(spark, args.star),
            args.model,
            args.split_date,
            grid=None if args.no_tune else model.GRID,
        )
        print(trained.params)
        trained.metrics.show(truncate=False)
        trained.steps.orderBy("step").show(truncate=False)
        trained.importance.limit(8).show(truncate=False)
    else:
        made = panel.engineer_features(panel.panel_weekly(read_star(spark, args.star)))
        fitted = model.load_model(spark, args.model)
        forecast.forecast(fitted, made, args.weeks).write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
