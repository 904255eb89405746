"""How plain tables play the roles of listings, sales, evidence and event logs; each role as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of the largest table that one task of a join may get.
ROWS_OF_TASK = 400_000


def dealt(rows: DataFrame, key: str, tasks: int) -> DataFrame:
    """rows by their key over so many tasks, where the session's partitions are fewer."""
    return rows.repartition(tasks, key) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def listings(spark: SparkSession, sf_dir: str, people: bool = True) -> DataFrame:
    """One row per order: key, decision time t0, price, cohort, seller value, region, sale and last sight.

    The joins are dealt over more tasks the more rows there are, so that what a task sorts does not grow with the tables.
    Without people the columns of the customer are left out, and so is their join, unless a customer stands there twice,
    whose orders it would repeat."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    tasks = -(-lines.count() // ROWS_OF_TASK)
    own = dealt(orders.select("o_orderkey", "o_orderdate"), "o_orderkey", tasks)
    times = own.join(dealt(lines.select("l_orderkey", "l_shipdate", "l_quantity"), "l_orderkey", tasks), F.col("o_orderkey") == F.col("l_orderkey"))
    sales = times.groupBy(F.col("o_orderkey").alias("sale_key")).agg(
        F.min(F.when(F.col("l_shipdate") >= F.col("o_orderdate"), F.col("l_shipdate"))).alias("sold_at"),
        F.max("l_shipdate").alias("last_seen"),
        F.count("*").alias("n_images"),
        F.avg("l_quantity").alias("battery"),
    )
    sellers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_acctbal", "c_mktsegment", "n_name", "n_regionkey")
    placed = orders
    if people or not sellers.where("c_custkey is not null").groupBy("c_custkey").count().where("count > 1").isEmpty():
        placed = dealt(orders, "o_custkey", tasks).join(dealt(sellers, "c_custkey", tasks), F.col("o_custkey") == F.col("c_custkey"), "left")
    joined = dealt(placed, "o_orderkey", tasks).join(sales, F.col("o_orderkey") == F.col("sale_key"), "left")
    seller = [F.col("c_acctbal").alias("seller"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("region"), F.col("n_regionkey").cast("bigint").alias("region_key")]
    return joined.select(
        F.col("o_orderkey").alias("listing_id"),
        (13 + F.col("o_orderkey") % 5).cast("bigint").alias("generation"),
        F.col("o_orderdate").alias("t0"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("cohort"),
        F.col("o_orderstatus").alias("status"),
        *(seller if people else []),
        "sold_at",
        "last_seen",
        F.coalesce("n_images", F.lit(0)).cast("bigint").alias("n_images"),
        "battery",
    )


def sold_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales: cohort, day and price."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("cohort"), F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").alias("price"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rows per image of a listing."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("listing_id"),
        F.col("l_partkey").alias("image_key"),
        (F.col("l_linenumber") % 5).cast("bigint").alias("quality"),
        F.nullif(F.col("l_quantity").cast("int") % 11, F.lit(10)).cast("bigint").alias("damage"),
        (F.col("l_returnflag") == "R").alias("stock"),
        F.concat("l_returnflag", "l_linestatus").alias("colour"),
        F.col("l_discount").alias("confidence"),
        F.col("l_extendedprice").alias("value"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log: one row per observation of a listing."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("listing_id"), "event_id", F.col("ts").alias("observed_at"), F.col("value").alias("price"), F.col("event_type").alias("status"), (F.col("event_type") == "error").alias("inactive"), "props")


LISTINGS = """listings AS (
  SELECT o_orderkey AS listing_id, 13 + o_orderkey % 5 AS generation, o_orderdate AS t0, o_totalprice AS price, o_orderpriority AS cohort,
         o_orderstatus AS status, c_acctbal AS seller, c_mktsegment AS segment, n_name AS region, n_regionkey AS region_key, sold_at, last_seen,
         coalesce(n_images, 0) AS n_images, battery
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o.o_orderkey AS sale_key, min(CASE WHEN l_shipdate >= o.o_orderdate THEN l_shipdate END) AS sold_at, max(l_shipdate) AS last_seen,
                    count(*) AS n_images, avg(l_quantity) AS battery
             FROM orders o JOIN lineitem ON o.o_orderkey = l_orderkey GROUP BY 1) ON o_orderkey = sale_key)"""
POOL = "pool AS (SELECT o_orderpriority AS cohort, CAST(l_shipdate AS DATE) AS day, l_extendedprice AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
IMAGES = """images AS (SELECT l_orderkey AS listing_id, l_partkey AS image_key, l_linenumber % 5 AS quality, nullif(CAST(floor(l_quantity) AS INT) % 11, 10) AS damage,
  l_returnflag = 'R' AS stock, l_returnflag || l_linestatus AS colour, l_discount AS confidence, l_extendedprice AS value FROM lineitem)"""
HISTORY = "history AS (SELECT user_id AS listing_id, event_id, ts AS observed_at, value AS price, event_type AS status, event_type = 'error' AS inactive, props FROM events)"
