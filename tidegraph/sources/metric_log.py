"""Metrics written as JSON lines in logs, and their reduction."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

logger = logging.getLogger("tidegraph")
REDUCTIONS = ("mean", "median", "min", "max", "last", "full")
PERCENTILES = (5, 25, 50, 75, 95)


def enable_logging(path: str | None = None, level: int = logging.INFO) -> None:
    """Send the engine's log to a file, or else to the console."""
    handler = logging.FileHandler(path) if path else logging.StreamHandler()
    handler.setFormatter(logging.Formatter("%(message)s"))
    logger.addHandler(handler)
    logger.setLevel(level)


def log_metric(name: str, value: float, epoch: int | None = None, **extra) -> None:
    """Write one metric as a JSON line."""
    logger.info(json.dumps({"metric": name, "value": value} | ({"epoch": epoch} if epoch is not None else {}) | extra))


@contextmanager
def latency(name: str) -> Iterator[None]:
    began = time.perf_counter()
    yield
    log_metric(f"{name} latency", time.perf_counter() - began)


def log_latency(function: Callable) -> Callable:
    """Decorator: write how long each call took as a metric."""

    @wraps(function)
    def timed(*args, **kwargs):
        with latency(function.__name__):
            return function(*args, **kwargs)

    return timed


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """``line, metric, value, epoch`` of a log's JSON lines with a metric and a number; other lines are left out."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    begin = F.instr("value", "{")
    body = F.when(begin > 0, F.expr("substring(value, instr(value, '{'))"))
    rows = lines.where(begin > 0).select("line", F.from_json(body, "metric string, value double, epoch int").alias("j"))
    return rows.select("line", "j.metric", "j.value", "j.epoch").where("metric IS NOT NULL AND value IS NOT NULL")


def reduce_metrics(metrics: DataFrame, how: str = "mean") -> DataFrame:
    """One row a metric: ``value``, or with ``full`` mean, deviation, extremes, count and percentiles."""
    if how not in REDUCTIONS:
        raise ValueError(f"unknown reduction {how!r}; one of {REDUCTIONS}")
    one = {"mean": F.avg("value"), "median": F.percentile("value", 0.5), "min": F.min("value"), "max": F.max("value"), "last": F.max_by("value", "line")}
    grouped = metrics.groupBy("metric")
    if how != "full":
        return grouped.agg(one[how].alias("value"))
    return grouped.agg(F.count("*").alias("n"), *(f.alias(k) for k, f in one.items()), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), *(F.percentile("value", p / 100).alias(f"p{p}") for p in PERCENTILES))


def compare_metrics(a: DataFrame, b: DataFrame) -> DataFrame:
    """``metric, a, b, delta, delta_pct`` of two reductions; metrics of one only have nulls."""
    both = a.select("metric", F.col("value").alias("a")).join(b.select("metric", F.col("value").alias("b")), "metric", "full")
    delta = F.col("b") - F.col("a")
    return both.select("metric", "a", "b", delta.alias("delta"), (100 * F.try_divide(delta, F.abs("a"))).alias("delta_pct"))
