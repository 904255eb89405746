"""Weighted weights of evidence: tables, scores, and scores of folds by the other folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISSING = "missing"


def long_form(rows: DataFrame, names: list[str], kept: list[str], partial: dict[str, Column] | None = None) -> DataFrame:
    """One row for each (row, name) with its value; a null is the value `missing`. A name in `partial` has rows only where its
    condition holds, so that its totals are those of such rows."""
    partial = partial or {}
    pairs = [F.when(partial.get(n, F.lit(True)), F.struct(F.lit(n).alias("name"), F.coalesce(F.col(n).cast("string"), F.lit(MISSING)).alias("value"))) for n in names]
    return rows.select(*kept, F.explode(F.array_compact(F.array(*pairs))).alias("x")).select(*kept, "x.name", "x.value")


def _evidence(p: Column, q: Column, all_p: Column, all_q: Column, eps: float) -> Column:
    return F.ln(((p + eps) / all_p) / ((q + eps) / all_q))


def evidence(rows: DataFrame, y: str = "y", weight: str | None = None, eps: float = 0.5) -> DataFrame:
    """(name, value, woe, positive, negative): ln of the share of positive weight over the share of negative weight that a value
    holds. Weights have mean one over the rows of a name; without a column of weights each row weighs one."""
    w = F.col(weight) if weight else F.lit(1.0)
    per = rows.groupBy("name", "value").agg(F.sum(w * F.col(y)).alias("p"), F.sum(w * (1 - F.col(y))).alias("q"))
    whole = Window.partitionBy("name")
    woe = _evidence(F.col("p"), F.col("q"), F.sum("p").over(whole), F.sum("q").over(whole), eps)
    return per.select("name", "value", woe.alias("woe"), F.col("p").alias("positive"), F.col("q").alias("negative"))


def base_logit(rows: DataFrame, y: str, weight: str) -> DataFrame:
    """One row (base): the logit of the weighted share of positives."""
    share = F.sum(F.col(weight) * F.col(y)) / F.sum(weight)
    bound = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.coalesce(share, F.lit(0.5))))
    return rows.agg(F.ln(bound / (1 - bound)).alias("base"))


def score(rows: DataFrame, long: DataFrame, key: str, table: DataFrame, base: DataFrame) -> DataFrame:
    """(key, logit): the base and what the values of a row add; a value without evidence adds nothing."""
    added = long.join(table.select("name", "value", "woe"), ["name", "value"]).groupBy(key).agg(F.sum("woe").alias("z"))
    return rows.select(key).join(added, key, "left").join(F.broadcast(base)).select(key, (F.col("base") + F.coalesce("z", F.lit(0.0))).alias("logit"))


def day_folds(rows: DataFrame, day: str, folds: int) -> DataFrame:
    """(day, fold): distinct days in order, cut into blocks of about equal numbers. One row a day is all that meets in a task."""
    days = rows.select(day).distinct()
    n = days.agg(F.count("*").alias("_n"))
    placed = days.join(F.broadcast(n)).withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(day)) - 1)
    return placed.select(day, F.floor(F.col("_i") * folds / F.col("_n")).cast("bigint").alias("fold"))


def fold_evidence(long: DataFrame, rows: DataFrame, y: str, raw: str, eps: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(fold, name, value, woe) and (fold, base), each from the rows of the other folds: totals less the fold's own.

    Raw weights are scaled to mean one over the rows that a fold learns from. A value that those lack has no evidence."""
    own = rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum(raw).alias("w"), F.sum(F.col(raw) * F.col(y)).alias("p"))
    all_ = Window.partitionBy()  # one row a fold
    rest = lambda c: F.sum(c).over(all_) - F.col(c)
    share = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), rest("p") / rest("w")))
    folds = own.select("fold", (rest("w") / rest("n")).alias("mean"), F.ln(share / (1 - share)).alias("base"))
    g = long.groupBy("fold", "name", "value").agg(F.count("*").alias("n"), F.sum(F.col(raw) * F.col(y)).alias("p"), F.sum(F.col(raw) * (1 - F.col(y))).alias("q"))
    others = lambda c: F.sum(c).over(Window.partitionBy("name", "value")) - F.col(c)
    totals = lambda c: F.sum(c).over(Window.partitionBy("name")) - F.sum(c).over(Window.partitionBy("fold", "name"))
    parts = g.select("fold", "name", "value", others("n").alias("n"), *[x.alias(a) for a, x in (("p", others("p")), ("q", others("q")), ("tp", totals("p")), ("tq", totals("q")))]).where("n > 0")
    m = F.col("mean")
    woe = _evidence(F.col("p") / m, F.col("q") / m, F.col("tp") / m, F.col("tq") / m, eps)
    return parts.join(F.broadcast(folds), "fold").select("fold", "name", "value", woe.alias("woe")), folds.select("fold", "base")
