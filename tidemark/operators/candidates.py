"""Rows that a job should take next, in order."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.order import numbered


def due(keys: DataFrame, audits: DataFrame, key: str, at: str, now: datetime, gap: timedelta, limit: int | None = None) -> DataFrame:
    """(key, last, place): keys without an audit in the gap before now, those never audited first, then the longest ago; the
    first `limit` of them where a job takes no more at a time."""
    last = audits.groupBy(key).agg(F.max(at).alias("last"))
    open_ = keys.select(key).distinct().join(last, key, "left").where(F.col("last").isNull() | (F.col("last") < F.lit(now - gap).cast("timestamp_ntz")))
    placed = numbered(open_, [], [F.col("last").asc_nulls_first(), F.col(key)]).select(key, "last", "place")
    return placed if limit is None else placed.where(F.col("place") <= limit)


def repeated(df: DataFrame, key: list[str], newest: str, done: DataFrame | None = None) -> DataFrame:
    """(key, n, newest, place): keys of more than one row, those with the newest row first, without those already done."""
    found = df.groupBy(*key).agg(F.count("*").alias("n"), F.max(newest).alias("newest")).where("n > 1")
    if done is not None:
        found = found.join(done.select(*[c for c in key if c in done.columns]).distinct(), [c for c in key if c in done.columns], "left_anti")
    return numbered(found, [], [F.col("newest").desc_nulls_last(), *map(F.col, key)]).select(*key, "n", "newest", "place")


def out_of_step(latest: DataFrame, main: DataFrame, key: str, value: str, least: float) -> DataFrame:
    """(key, latest, main, place): keys whose latest good value is missing from main or differs by more than `least`, the
    largest difference first, missing ones before all."""
    good = latest.where(F.col(value).isNotNull()).select(key, F.col(value).alias("latest"))
    both = good.join(main.select(key, F.col(value).alias("main")), key, "left")
    size = F.abs(F.col("latest") - F.col("main"))
    found = both.where(F.col("main").isNull() | (size > least)).withColumn("_size", size)
    return numbered(found, [], [F.col("_size").desc_nulls_first(), F.col(key)]).select(key, "latest", "main", "place")


def severity(decision: Column, rules: list[tuple[Column, int]]) -> Column:
    """The greatest of a decided level (null: 0) and the levels of the rules that hold."""
    return F.greatest(F.coalesce(decision, F.lit(0)), *[F.when(holds, level).otherwise(0) for holds, level in rules], F.lit(0))


def first_code(rules: list[tuple[Column, int]], otherwise: int = 0) -> Column:
    """The code of the first rule that holds."""
    return F.coalesce(*[F.when(holds, F.lit(code)) for holds, code in rules], F.lit(otherwise))
