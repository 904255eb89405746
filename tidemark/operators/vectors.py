"""Vectors in array columns: pooling, prototypes and attachment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Prototypes up to which they are sent to all tasks in one row; more of them raise.
MOST_PROTOTYPES = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector of doubles scaled to length one; null for a null vector or one of length zero."""
    doubles = v.cast("array<double>")
    length = F.sqrt(dot(doubles, doubles))
    return F.when(length > 0, F.transform(doubles, lambda x: x / length))


def mean_pool(df: DataFrame, key: list[str], vector: str) -> DataFrame:
    """(key, n, vector): mean of the unit vectors of each key, scaled to length one again; zero vectors do not count.

    Means are taken for each key and place, so a key with many rows is summed up before it moves.
    """
    units = df.select(*key, unit(F.col(vector)).alias("_u")).where("_u is not null")
    parts = units.select(*key, F.posexplode("_u").alias("_at", "_x")).groupBy(*key, "_at").agg(F.avg("_x").alias("_m"), F.count("*").alias("_n"))
    whole = parts.groupBy(*key).agg(F.max("_n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("_at", "_m"))), lambda x: x["_m"]).alias("_v"))
    return whole.select(*key, "n", unit(F.col("_v")).alias(vector)).where(F.col(vector).isNotNull())


def prototype_similarity(df: DataFrame, key: str, vector: str, label: str, least: int = 1) -> DataFrame:
    """(key, nearest, similarity, margin, novelty) of each row: cosines to the mean vector of every label with enough rows.

    novelty is one less the greatest cosine, margin the greatest less the second.
    """
    means = mean_pool(df.where(F.col(label).isNotNull()), [label], vector).where(F.col("n") >= least).select(F.col(label).alias("label"), F.col(vector).alias("v")).limit(MOST_PROTOTYPES + 1)
    one = means.agg(F.sort_array(F.collect_list(F.struct("label", "v"))).alias("_p"))
    if one.select(F.size("_p")).first()[0] > MOST_PROTOTYPES:
        raise ValueError(f"more than {MOST_PROTOTYPES} prototypes")
    near = F.transform("_p", lambda p: F.struct(dot(F.col("_u"), p["v"]).alias("s"), p["label"].alias("label")))
    rows = df.select(key, unit(F.col(vector)).alias("_u")).where("_u is not null").join(F.broadcast(one)).select(key, F.sort_array(near, asc=False).alias("_s"))
    first, second = F.get("_s", F.lit(0)), F.get("_s", F.lit(1))
    return rows.select(key, first["label"].alias("nearest"), first["s"].alias("similarity"), (first["s"] - second["s"]).alias("margin"), (1 - first["s"]).alias("novelty"))


def attach_vector(base: DataFrame, vectors: DataFrame, key: str, order: list[str], vector: str, size: int) -> DataFrame:
    """base with the latest vector of its key and `has_vector`; without one of the right size, the vector is all zeros."""
    latest = vectors.where(F.size(vector) == size).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).where("_n = 1").select(key, vector)
    joined = base.join(latest, key, "left")
    return joined.withColumn("has_vector", F.col(vector).isNotNull()).withColumn(vector, F.coalesce(vector, F.array_repeat(F.lit(0.0).cast("float"), size)))
