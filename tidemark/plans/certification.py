"""Checks of surfaces: keys, invariants, hashes and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import certify
from tidemark.registry import query

from .roles import LISTINGS, listings, table


@query("""SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def unique_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count("*").alias("n")).where("n > 1")


@query(f"""WITH {LISTINGS} SELECT 'sold_before_t0' AS name, count(*) FILTER (WHERE sold_at < t0) AS n FROM listings UNION ALL SELECT 'sale_after_last_sight', count(*) FILTER (WHERE sold_at > last_seen) FROM listings UNION ALL SELECT 'no_price', count(*) FILTER (WHERE price IS NULL OR price <= 0) FROM listings""")
def invariant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"sold_before_t0": F.col("sold_at") < F.col("t0"), "sale_after_last_sight": F.col("sold_at") > F.col("last_seen"), "no_price": F.col("price").isNull() | (F.col("price") <= 0)}
    return certify.invariants(listings(spark, sf_dir), rules)


@query("""WITH r AS (SELECT CAST(o_orderdate AS DATE) AS d, o_orderkey, concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), coalesce(o_orderstatus, ''), CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR)) AS r, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS n FROM orders)
SELECT strftime(d, '%Y-%m-%d') AS day, count(*) AS n, sha256(string_agg(sha256(r), '' ORDER BY n)) AS hash, sha256(string_agg(r, chr(10) ORDER BY n)) AS hash_of_rows FROM r WHERE n <= 2000 GROUP BY 1""")
def dataset_hash_day(spark: SparkSession, sf_dir: str, sample: int = 2000) -> DataFrame:
    """Two hashes per day over its first rows by key; all days in one job."""
    columns = [F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"), F.round(F.col("o_totalprice") * 100).cast("bigint")]
    return certify.day_hashes(table(spark, sf_dir, "orders"), F.date_format("o_orderdate", "yyyy-MM-dd"), ["o_orderkey"], columns, sample)


@query("""WITH b AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderkey % 100 <> 0 AND o_orderdate >= TIMESTAMP '1992-03-01' GROUP BY 1)
SELECT coalesce(b.month, c.month) AS month, b.n IS DISTINCT FROM c.n AS drift, c.n IS NULL AS missing FROM b FULL JOIN c ON b.month = c.month""")
def drift_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    base = orders.groupBy("month").agg(F.count("*").alias("a"))
    now = orders.where((F.col("o_orderkey") % 100 != 0) & (F.col("o_orderdate") >= F.lit("1992-03-01").cast("timestamp_ntz"))).groupBy("month").agg(F.count("*").alias("b"))
    return base.join(now, "month", "full").select("month", (~F.col("a").eqNullSafe(F.col("b"))).alias("drift"), F.col("b").isNull().alias("missing"))


GATED = ["battery", "n_images", "status", "seller"]


@query(f"""WITH {LISTINGS}, g AS (SELECT *, coalesce(sold_at, TIMESTAMP '1970-01-01') <= t0 + INTERVAL 24 HOURS AS inside FROM listings)
SELECT listing_id, {', '.join(f'CASE WHEN inside THEN {c} END AS {c}' for c in GATED)} FROM g""")
def sla_gate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that was finished too late is gone as a whole; evidence without a time counts as inside."""
    return certify.sla_gate(listings(spark, sf_dir), GATED, "sold_at", "t0").select("listing_id", *GATED)


@query(f"""WITH {LISTINGS} SELECT 'raw' AS surface, count(*) AS n FROM listings WHERE sold_at > t0 + INTERVAL 24 HOURS AND (battery IS NOT NULL OR n_images IS NOT NULL OR status IS NOT NULL OR seller IS NOT NULL) UNION ALL SELECT 'gated', 0""")
def sla_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows outside the SLA that still have a gated value, before and after the gate; the gate leaves none."""
    raw = listings(spark, sf_dir)
    counts = [certify.sla_leaks(df, GATED, "sold_at", "t0").agg(F.lit(name).alias("surface"), F.count("*").alias("n")) for name, df in (("raw", raw), ("gated", certify.sla_gate(raw, GATED, "sold_at", "t0")))]
    return counts[0].unionByName(counts[1])
