"""Changes of the timescales as a table of signals."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from tidewheel.plans.timescale import Registry

SCHEMA = "window long, interval long, type int, start_time long"
ADD, REMOVE = 1, 2


def signals(spark: SparkSession, rows: list[tuple[int, int, int, int]]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def send(spark: SparkSession, path: str, window: int, interval: int, kind: str, start_time: int) -> None:
    """Appends one signal, "addition" or "deletion", to the table at path."""
    kinds = {"addition": ADD, "deletion": REMOVE}
    signals(spark, [(window, interval, kinds[kind], start_time)]).coalesce(1).write.mode("append").parquet(path)


def registry_of(table: DataFrame, timescales=(), start: int = 0, align: str = "own") -> Registry:
    """The initial timescales with all signals of a table applied; a table of signals is as small as the changes are few."""
    rows = [tuple(r) for r in table.select("window", "interval", "type", "start_time").collect()]
    return Registry.of(timescales, start).apply(rows, align)


def main(args: list[str] | None = None) -> None:
    """python -m tidewheel.sources.signals --path P --w 30 --i 2 --type addition --at 100"""
    parser = argparse.ArgumentParser(description="Append a change of the timescales to a signal table.")
    parser.add_argument("--path", required=True)
    parser.add_argument("--w", type=int, required=True)
    parser.add_argument("--i", type=int, required=True)
    parser.add_argument("--type", choices=("addition", "deletion"), default="addition")
    parser.add_argument("--at", type=int, default=0)
    a = parser.parse_args(args)
    send(SparkSession.builder.getOrCreate(), a.path, a.w, a.i, a.type, a.at)


if __name__ == "__main__":
    main()
