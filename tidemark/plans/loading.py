"""Loading of releases and exports of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.registry import query
from tidemark.shared import shared_path
from tidemark.sources.ingest import load_release, release_problems, write_days

from .roles import table


@query("""SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS code, c_name AS name, 'r2024_01' AS release_id FROM customer""")
def csv_release_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes written as CSV with leading zeros, and read back as text, stamped with their release."""
    folder = shared_path(spark, "release")
    codes = table(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("code"), F.col("c_name").alias("name"))
    codes.write.csv(folder, header=True)
    return load_release(spark, [folder], ["code", "name"], "r2024_01")


@query("""WITH k AS (SELECT lower(trim(p_brand)) AS code, count(*) AS n, count(*) FILTER (WHERE NOT regexp_matches(p_brand, '^Brand#[0-9]{2}$')) AS bad, count(*) FILTER (WHERE trim(p_name) = '') AS blank FROM part GROUP BY 1)
SELECT count(*) AS codes, CAST(sum(bad) AS BIGINT) AS bad_codes, CAST(sum(blank) AS BIGINT) AS blanks, count(*) FILTER (WHERE n > 1) AS repeated, (SELECT round(count(*) FILTER (WHERE lower(trim(p_brand)) IN (SELECT code FROM k WHERE bad = 0)) / count(*), 7) FROM part JOIN lineitem ON l_partkey = p_partkey) AS coverage FROM k""")
def release_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates before a load (bad, blank and repeated codes), and after it the share of rows that a good code covers."""
    used = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("p_brand")
    return release_problems(table(spark, sf_dir, "part"), "p_brand", "p_name", "^Brand#[0-9]{2}$", used)


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY 1""")
def csv_parquet_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders exported by month as Parquet and CSV; what both hold is read back (as long as they agree)."""
    folder = shared_path(spark, "export")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    totals = []
    for form in ("parquet", "csv"):
        write_days(orders, f"{folder}/{form}", "month", form)
        back = spark.read.schema("o_orderkey bigint, cents bigint, month string").format(form).load(f"{folder}/{form}")
        totals.append(back.groupBy("month").agg(F.count("*").alias("n"), F.sum("cents").alias("cents")))
    return totals[0].intersect(totals[1])


@query("""WITH first AS (SELECT c_nationkey AS area, min(c_custkey) AS key FROM customer WHERE c_acctbal < 0 GROUP BY 1), now AS (SELECT c_nationkey AS area, max(c_custkey) AS key FROM customer GROUP BY 1)
SELECT area, key, '2024-01-01' AS snapshot_date FROM first UNION ALL SELECT area, key, '2024-02-01' FROM now UNION ALL SELECT area, key, '2024-03-01' FROM now""")
def snapshot_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots appended twice to a target that has one already; a date that is there is not appended again."""
    from tidemark.sources.ingest import append_snapshot

    people = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("area"), F.col("c_custkey").alias("key"), "c_acctbal")
    now = people.groupBy("area").agg(F.max("key").alias("key"))
    target = people.where("c_acctbal < 0").groupBy("area").agg(F.min("key").alias("key")).withColumn("snapshot_date", F.lit("2024-01-01"))
    for date in ("2024-02-01", "2024-03-01", "2024-02-01"):
        target = append_snapshot(target, now, ["area"], "snapshot_date", date)
    return target
