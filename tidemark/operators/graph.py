"""Walks over tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.shared import dropped, shared_path

#: Rounds of one step each before a round follows several steps.
SHORT = 3


def closure(edges: DataFrame, roots: DataFrame, rounds: int = 1000, hops: int = 8) -> DataFrame:
    """(node): the roots (node) and all that edges (a, b) lead to from them; null nodes are none.

    Each round follows the edges of the nodes found last only, and writes what is new to the shared folder: the next round reads
    tables, so plans do not grow with the walk. After the first rounds a round follows up to `hops` steps, so that a long chain
    takes fewer of them. A walk that has not ended after `rounds` rounds raises. The result is a table of the shared folder.
    """
    spark = edges.sparkSession
    folder = shared_path(spark, "closure")
    links = edges.select(F.col("a").alias("node"), "b").where("node is not null and b is not null").distinct()
    links.write.parquet(f"{folder}/links")
    links = spark.read.schema(links.schema).parquet(f"{folder}/links")
    first = roots.select("node").where("node is not null").distinct()
    first.write.parquet(f"{folder}/reached/0")
    reached = lambda part: spark.read.schema(first.schema).parquet(f"{folder}/reached/{part}")
    try:
        for k in range(1, rounds + 1):
            step = reached(k - 1)
            found = None
            for _ in range(1 if k <= SHORT else hops):
                step = step.join(links, "node").select(F.col("b").cast(first.schema[0].dataType).alias("node")).distinct()
                found = step if found is None else found.unionByName(step)
            found.distinct().join(reached("*"), "node", "left_anti").write.parquet(f"{folder}/reached/{k}")
            if reached(k).isEmpty():
                return reached("*")
        raise RuntimeError(f"the walk did not end in {rounds} rounds")
    finally:
        dropped(spark, f"{folder}/links")
