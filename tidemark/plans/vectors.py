"""Embeddings: pooling, prototypes and attachment to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import vectors
from tidemark.registry import query

from .roles import table

UNITS = "u AS (SELECT vec_id, label, list_transform(v, lambda x: x / n) AS u FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)) WHERE n > 0)"
MEANS = """m AS (SELECT label, place, avg(x) AS x, count(*) AS k FROM (SELECT label, unnest(u) AS x, unnest(range(len(u))) AS place FROM u) GROUP BY 1, 2),
p AS (SELECT label, list(x / n ORDER BY place) AS c, max(k) AS n FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY label)) AS n FROM m) GROUP BY 1)"""


@query(f"WITH {UNITS}, {MEANS} SELECT label, n, unnest(range(len(c))) AS place, round(unnest(c), 6) AS x FROM p")
def vector_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = vectors.mean_pool(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return pooled.select("label", "n", F.posexplode("embedding").alias("place", "x")).select("label", "n", F.col("place").cast("bigint").alias("place"), F.round("x", 6).alias("x"))


@query(f"""WITH {UNITS}, {MEANS}, s AS (SELECT vec_id, p.label, list_dot_product(u, c) AS s FROM u, p WHERE p.n >= 20), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label DESC) AS k FROM s)
SELECT vec_id, max(label) FILTER (WHERE k = 1) AS nearest, round(max(s), 6) AS similarity, round(max(s) - max(s) FILTER (WHERE k = 2), 6) AS margin, round(1 - max(s), 6) AS novelty FROM r GROUP BY 1""")
def prototype_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.prototype_similarity(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", least=20)
    return out.select("vec_id", "nearest", *[F.round(c, 6).alias(c) for c in ("similarity", "margin", "novelty")])


@query("""WITH l AS (SELECT label AS k, arg_max(CAST(embedding AS DOUBLE[]), vec_id) AS v FROM embeddings WHERE len(embedding) = 64 GROUP BY 1)
SELECT o_orderkey, v IS NOT NULL AS has_vector, round(coalesce(list_sum(list_transform(v, lambda x: x * x)), 0), 4) AS energy FROM orders LEFT JOIN l ON k = o_orderkey % 13""")
def vector_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with the latest vector of its key, or zeros."""
    base = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 13).cast("int").alias("label"))
    out = vectors.attach_vector(base, table(spark, sf_dir, "embeddings"), "label", ["vec_id"], "embedding", 64)
    doubles = F.col("embedding").cast("array<double>")
    return out.select("o_orderkey", "has_vector", F.round(vectors.dot(doubles, doubles), 4).alias("energy"))
