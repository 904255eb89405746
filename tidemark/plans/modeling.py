"""Models, weights and evaluations bound to the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import shaped_weight
from tidemark.operators import boosting, factors, merge, modeling
from tidemark.operators.asof import latest_per_key
from tidemark.registry import query
from tidemark.sources.ingest import insert_new

from .encoding import outcomes
from .measuring import SCORED, scored
from .roles import LISTINGS, listings, table


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.greatest(F.lit(0), F.datediff(F.to_date(F.coalesce("sold_at", "last_seen")), F.to_date("t0")))
    return listings(spark, sf_dir).where("last_seen is not null").select("listing_id", "price", "n_images", "battery", days.alias("days"), F.col("sold_at").isNotNull().alias("sold"), "t0")


@query()
def survival_aft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected days to a sale, from listings of the years before 1997, censored ones included."""
    rows = durations(spark, sf_dir)
    out = modeling.survival(rows.where(F.col("t0") < F.lit("1997-01-01").cast("timestamp_ntz")), rows, ["price", "n_images", "battery"], "days", "sold")
    return out.select("listing_id", "days", "sold", "expected")


@query()
def survival_boosted(spark: SparkSession, sf_dir: str, trees: int = 10) -> DataFrame:
    """The same by boosted trees, which see what features do together."""
    rows = durations(spark, sf_dir)
    model = boosting.fit(rows.where(F.col("t0") < F.lit("1997-01-01").cast("timestamp_ntz")), ["price", "n_images", "battery"], "days", "sold", trees)
    return model.predict(rows).select("listing_id", "days", "sold", "expected")


@query()
def logistic_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modeling.out_of_fold(outcomes(spark, sf_dir), "listing_id", ["price", "n_images"], "y")


@query()
def calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores on an isotonic curve."""
    rows = modeling.out_of_fold(outcomes(spark, sf_dir), "listing_id", ["price", "n_images"], "y")
    return modeling.calibrate(rows, "score", "label")


@query()
def text_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents on the main directions of the words and pairs of words of those with a language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return factors.project(docs, "doc_id", "text", factors.fit(docs.where("lang is not null"), "doc_id", "text"))


@query()
def embedding_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return modeling.principal_components(rows, rows, "vec_id", "embedding", 8)


@query(f"""WITH {LISTINGS}, d AS (SELECT listing_id, CAST(t0 AS DATE) AS day, 24.0 * greatest(0, date_diff('day', CAST(t0 AS DATE), CAST(coalesce(sold_at, last_seen) AS DATE))) AS h FROM listings WHERE last_seen IS NOT NULL), m AS (SELECT max(day) AS last FROM d),
w AS (SELECT listing_id, pow(0.5, date_diff('day', day, last) / 120.0) * CASE WHEN h > 168 THEN 1.5 ELSE 1 END * CASE WHEN h > 504 THEN 1.25 ELSE 1 END * (1 + 2 * exp(-pow(abs(h - 504) / 96, 2))) * CASE WHEN h < 240 THEN 1.5 ELSE 1 END AS w FROM d, m)
SELECT listing_id, round(w / (SELECT avg(w) FROM w), 6) AS weight FROM w""")
def loss_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of training rows with mean one: recent, slow, near the boundary of 21 days and very fast ones weigh more."""
    rows = durations(spark, sf_dir).withColumn("day", F.to_date("t0"))
    aged = rows.join(F.broadcast(rows.agg(F.max("day").alias("last"))))
    weight = shaped_weight(F.datediff("last", "day"), 120.0, F.col("days") * 24.0, 1.5, 1.25, 2.0, 96.0, 0.25)
    weighed = aged.select("listing_id", weight.alias("w"))
    return weighed.join(F.broadcast(weighed.agg(F.avg("w").alias("m")))).select("listing_id", F.round(F.col("w") / F.col("m"), 6).alias("weight"))


@query(f"""WITH {SCORED}, n AS (SELECT doc_id, round(score, 6) AS score, CASE WHEN y = 1 THEN 'a' ELSE 'b' END AS cohort FROM s), o AS (SELECT doc_id, 0.5 AS score, 'a' AS cohort FROM s WHERE y = 0),
p AS (SELECT * FROM o UNION ALL SELECT * FROM n WHERE doc_id NOT IN (SELECT doc_id FROM o)) SELECT cohort, count(*) AS n, round(avg(score), 6) AS mean FROM p GROUP BY 1""")
def eval_persist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions added to those that are there (repeats are ignored), and the summary by cohort that replaces the old one."""
    rows = scored(spark, sf_dir)
    new = rows.select("doc_id", F.round("score", 6).alias("score"), F.when(F.col("y") == 1, "a").otherwise("b").alias("cohort"))
    old = rows.where("y = 0").select("doc_id", F.lit(0.5).alias("score"), F.lit("a").alias("cohort"))
    kept = insert_new(latest_per_key(old, ["doc_id"], [F.col("score")]), new, ["doc_id"], [F.col("score")])
    before = old.groupBy("cohort").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.lit(1).alias("made"))
    now = kept.groupBy("cohort").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.lit(2).alias("made"))
    return merge.upsert(before, now, ["cohort"], overwrite=["n", "mean"], earliest=["made"]).drop("made")
