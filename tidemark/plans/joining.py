"""Joins and windows in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import asof, order
from tidemark.registry import query

from .roles import HISTORY, LISTINGS, POOL, history, listings, sold_pool, table

SNAPSHOTS = """snapshots AS (SELECT n_name AS region, date_trunc('month', l_shipdate) AS snapshot_at, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / count(*) AS income FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return lines.groupBy(F.col("n_name").alias("region"), F.date_trunc("month", F.col("l_shipdate").cast("timestamp")).cast("timestamp_ntz").alias("snapshot_at")).agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / F.count("*")).alias("income"))


@query(f"""WITH {LISTINGS}, {SNAPSHOTS} SELECT listing_id, income, strftime(snapshot_at, '%Y-%m-%d') AS snapshot_date
FROM listings ASOF LEFT JOIN snapshots ON listings.region = snapshots.region AND t0 >= snapshot_at""")
def asof_join_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = asof.asof_join(listings(spark, sf_dir).select("listing_id", "region", "t0"), snapshots(spark, sf_dir), ["region"], "t0", "snapshot_at")
    return out.select("listing_id", "income", F.date_format("snapshot_at", "yyyy-MM-dd").alias("snapshot_date"))


@query(f"""WITH {LISTINGS}, {SNAPSHOTS} SELECT listing_id, income FROM listings ASOF LEFT JOIN snapshots ON listings.region = snapshots.region AND t0 + INTERVAL 1 DAY >= snapshot_at
WHERE income IS NULL OR income <> 0""")
def asof_with_grace(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = asof.asof_join(listings(spark, sf_dir).select("listing_id", "region", "t0"), snapshots(spark, sf_dir), ["region"], "t0", "snapshot_at", grace=F.expr("INTERVAL 1 DAY"))
    return out.where(F.col("income").isNull() | (F.col("income") != 0)).select("listing_id", "income")


@query(f"""WITH {HISTORY}, first_sold AS (SELECT listing_id, min(observed_at) AS sold_at FROM history WHERE status = 'purchase' GROUP BY 1)
SELECT f.listing_id, strftime(sold_at, '%Y-%m-%d %H:%M:%S') AS sold_at, arg_max(h.event_id, (h.observed_at, h.event_id)) AS last_event FROM first_sold f LEFT JOIN history h ON h.listing_id = f.listing_id AND h.observed_at < sold_at GROUP BY 1, 2""")
def first_last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = history(spark, sf_dir)
    sold = log.where("status = 'purchase'").groupBy("listing_id").agg(F.min("observed_at").alias("sold_at"))
    before = log.join(sold, "listing_id").where("observed_at < sold_at").groupBy("listing_id").agg(F.max_by("event_id", F.struct("observed_at", "event_id")).alias("last_event"))
    return sold.join(before, "listing_id", "left").select("listing_id", F.date_format("sold_at", "yyyy-MM-dd HH:mm:ss").alias("sold_at"), "last_event")


@query(f"""WITH {HISTORY}, views AS (SELECT listing_id, event_id, observed_at FROM history WHERE status = 'view'), errs AS (SELECT listing_id, event_id AS error_id, observed_at AS error_at FROM history WHERE inactive)
SELECT v.event_id, max(e.error_id) FILTER (WHERE e.rn = 1) AS error_id FROM views v LEFT JOIN LATERAL (SELECT error_id, row_number() OVER (ORDER BY error_at DESC, error_id DESC) AS rn FROM errs WHERE errs.listing_id = v.listing_id AND error_at < v.observed_at) e ON true GROUP BY 1""")
def last_event_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = history(spark, sf_dir)
    errors = log.where("inactive").select("listing_id", F.col("event_id").alias("error_id"), F.col("observed_at").alias("error_at"))
    return asof.asof_join(log.where("status = 'view'").select("listing_id", "event_id", "observed_at"), errors, ["listing_id"], "observed_at", "error_at", tie=["error_id"], strict=True).select("event_id", "error_id")


@query(f"""WITH {LISTINGS}, {POOL}, t AS (SELECT DISTINCT cohort, CAST(t0 AS DATE) AS day FROM listings)
SELECT t.cohort, strftime(t.day, '%Y-%m-%d') AS day, count(p.price) AS n, round(sum(p.price), 2) AS total FROM t JOIN pool p ON p.cohort = t.cohort AND p.day >= t.day - 35 AND p.day < t.day - 5 GROUP BY 1, 2""")
def embargo_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = listings(spark, sf_dir).select("cohort", F.to_date("t0").alias("at"))
    sums = {"n": F.count("price"), "cents": F.sum(F.round(F.col("price") * 100).cast("bigint"))}
    out = asof.embargo_sums(targets, sold_pool(spark, sf_dir), ["cohort"], "at", "day", sums, 35, 5).where("n > 0")
    return out.select("cohort", F.date_format("at", "yyyy-MM-dd").alias("day"), "n", (F.col("cents") / 100).alias("total"))


@query("""WITH live AS (SELECT o_orderpriority AS cohort, least(o_orderdate, l_shipdate) AS s, greatest(o_orderdate, l_shipdate) AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
t AS (SELECT DISTINCT o_orderpriority AS cohort, o_orderdate AS at FROM orders)
SELECT t.cohort, strftime(t.at, '%Y-%m-%d') AS at, count(s) AS n_active FROM t LEFT JOIN live ON live.cohort = t.cohort AND s <= t.at AND e >= t.at GROUP BY 1, 2""")
def interval_stab_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    live = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("cohort"), F.least("o_orderdate", "l_shipdate").alias("s"), F.greatest("o_orderdate", "l_shipdate").alias("e"))
    points = orders.select(F.col("o_orderpriority").alias("cohort"), F.col("o_orderdate").alias("at")).distinct()
    return asof.active_count(points, live, ["cohort"], "at", "s", "e").select("cohort", F.date_format("at", "yyyy-MM-dd").alias("at"), "n_active")


@query(f"""WITH {LISTINGS} SELECT listing_id, strftime(least(t0, last_seen), '%Y-%m-%d') AS start_day, strftime(least(sold_at, last_seen), '%Y-%m-%d') AS end_day FROM listings WHERE last_seen IS NOT NULL AND status <> 'P' AND coalesce(battery, 0) < 45 AND coalesce(least(sold_at, last_seen), last_seen) >= least(t0, last_seen)""")
def interval_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = F.least("t0", "last_seen"), F.least("sold_at", "last_seen")
    return listings(spark, sf_dir).where("status <> 'P' and coalesce(battery, 0) < 45").where(F.col("last_seen").isNotNull() & (end >= start)).select("listing_id", F.date_format(start, "yyyy-MM-dd").alias("start_day"), F.date_format(end, "yyyy-MM-dd").alias("end_day"))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_nationkey % 3 <> 0 THEN n_name END, r_name, 'other') AS area, CASE WHEN c_nationkey % 3 <> 0 AND n_name IS NOT NULL THEN 'primary' WHEN r_name IS NOT NULL THEN 'secondary' ELSE 'default' END AS matched
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON r_regionkey = c_nationkey % 7""")
def dim_fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("code"), (F.col("c_nationkey") % 7).alias("wide"))
    primary = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("area"))
    secondary = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("wide"), F.col("r_name").alias("area"))
    return asof.dimension_fallback(people, primary, secondary, "code", "wide", "area", F.lit("other")).select("c_custkey", "area", "matched")


@query(f"""WITH {LISTINGS}, a AS (SELECT l_orderkey AS listing_id, sum(l_quantity) AS q FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey AS listing_id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT listing_id, a.q AS lines__q, b.n AS returns__n FROM listings LEFT JOIN a USING (listing_id) LEFT JOIN b USING (listing_id)""")
def wide_prefixed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "listing_id")
    surfaces = {"lines": lines.groupBy("listing_id").agg(F.sum("l_quantity").alias("q")), "returns": lines.where("l_returnflag = 'R'").groupBy("listing_id").agg(F.count("*").alias("n"))}
    return asof.wide_join(listings(spark, sf_dir).select("listing_id"), ["listing_id"], surfaces)


@query("""SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN b.n IS NULL THEN 'only_a' WHEN a.n IS NULL THEN 'only_b' ELSE 'differs' END AS state
FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.o_custkey = b.o_custkey WHERE a.n IS DISTINCT FROM b.n""")
def null_safe_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    sides = [orders.where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.count("*").alias("n")) for s in "FO"]
    return asof.null_safe_diff(*sides, ["o_custkey"], ["n"])


@query("""SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND date_trunc('month', l_shipdate) = date_trunc('month', o_orderdate))""")
def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.trunc(F.to_date("l_shipdate"), "month").alias("day"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.trunc(F.to_date("o_orderdate"), "month").alias("day")).join(lines, ["o_orderkey", "day"], "left_semi").select("o_orderkey")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-06-01')""")
def missing_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1998-06-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(recent, "c_custkey", "left_anti")


@query(f"""WITH {LISTINGS}, g AS (SELECT DISTINCT cohort FROM listings) SELECT cohort, region, count(listing_id) AS n FROM (SELECT g.cohort, n_name AS region FROM g CROSS JOIN nation) LEFT JOIN listings USING (cohort, region) GROUP BY 1, 2""")
def param_cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).select("listing_id", "cohort", "region")
    cohorts = rows.agg(F.array_sort(F.collect_set("cohort")).alias("cohorts"))
    grid = table(spark, sf_dir, "nation").select(F.col("n_name").alias("region")).join(F.broadcast(cohorts)).select("region", F.explode("cohorts").alias("cohort"))
    return grid.join(rows, ["cohort", "region"], "left").groupBy("cohort", "region").agg(F.count("listing_id").alias("n"))


@query(f"""WITH {LISTINGS} SELECT listing_id, count(price) OVER w AS n_before, round(avg(price) OVER w, 4) AS mean_before, max(price) OVER w AS max_before FROM listings
WINDOW w AS (PARTITION BY cohort ORDER BY t0 RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)""")
def trailing_strict_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = asof.trailing_strict(listings(spark, sf_dir).select("listing_id", "cohort", "t0", "price"), ["cohort"], "t0", "price", 30)
    return out.select("listing_id", "n_before", F.round("mean_before", 4).alias("mean_before"), "max_before")


@query(f"""WITH {LISTINGS} SELECT listing_id, count(price) OVER w AS n_before, round(avg(price) OVER w, 4) AS mean_before FROM listings
WINDOW w AS (ORDER BY t0 RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)""")
def trailing_strict_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = asof.trailing_strict(listings(spark, sf_dir).select("listing_id", "t0", "price"), [], "t0", "price", 30)
    return out.select("listing_id", "n_before", F.round("mean_before", 4).alias("mean_before"))


@query(f"""WITH {LISTINGS} SELECT listing_id, round(price - avg(price) OVER (PARTITION BY segment), 4) AS residual FROM listings""")
def segment_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).select("listing_id", "segment", "price")
    means = rows.groupBy("segment").agg(F.avg("price").alias("mean"))
    return rows.join(means, "segment").select("listing_id", F.round(F.col("price") - F.col("mean"), 4).alias("residual"))


@query(f"""WITH {LISTINGS} SELECT listing_id, ntile(10) OVER (PARTITION BY region, cohort ORDER BY price, listing_id) AS decile FROM listings WHERE price IS NOT NULL""")
def ntile_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).where("price is not null")
    placed = order.numbered(rows.select("listing_id", "region", "cohort", "price"), ["region", "cohort"], [F.col("price"), F.col("listing_id")])
    return placed.select("listing_id", order.tile(F.col("place"), F.col("size"), 10).alias("decile"))


@query(f"""WITH {HISTORY} SELECT listing_id, arg_max(event_id, (observed_at, event_id)) AS last_event, arg_max(status, (observed_at, event_id)) AS last_status FROM history GROUP BY 1""")
def row_number_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("observed_at", "event_id")
    return history(spark, sf_dir).groupBy("listing_id").agg(F.max_by("event_id", at).alias("last_event"), F.max_by("status", at).alias("last_status"))


@query(f"""WITH {HISTORY} SELECT event_id, round(price - lag(price) OVER w, 4) AS delta, coalesce(price < lag(price) OVER w, false) AS cut FROM history WINDOW w AS (PARTITION BY listing_id ORDER BY observed_at, event_id)""")
def lag_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("price").over(Window.partitionBy("listing_id").orderBy("observed_at", "event_id"))
    return history(spark, sf_dir).select("event_id", F.round(F.col("price") - before, 4).alias("delta"), F.coalesce(F.col("price") < before, F.lit(False)).alias("cut"))


@query(f"""WITH {HISTORY}, d AS (SELECT listing_id, event_id, observed_at, price - lag(price) OVER (PARTITION BY listing_id ORDER BY observed_at, event_id) AS delta FROM history)
SELECT listing_id, count(*) AS cuts, round(sum(delta), 4) AS total, string_agg(CAST(event_id AS VARCHAR), '>' ORDER BY observed_at, event_id) AS timeline FROM d WHERE delta < 0 GROUP BY 1""")
def cut_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("price").over(Window.partitionBy("listing_id").orderBy("observed_at", "event_id"))
    cuts = history(spark, sf_dir).withColumn("delta", F.col("price") - before).where("delta < 0")
    events = F.transform(F.sort_array(F.collect_list(F.struct("observed_at", "event_id"))), lambda x: x["event_id"].cast("string"))
    return cuts.groupBy("listing_id").agg(F.count("*").alias("cuts"), F.round(F.sum("delta"), 4).alias("total"), F.array_join(events, ">").alias("timeline"))


@query(f"""WITH {LISTINGS}, c AS (SELECT segment, region, count(*) AS n FROM listings GROUP BY 1, 2) SELECT segment, region, n, dense_rank() OVER (PARTITION BY segment ORDER BY n DESC) AS place FROM c""")
def dense_rank_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = listings(spark, sf_dir).groupBy("segment", "region").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.dense_rank().over(Window.partitionBy("segment").orderBy(F.desc("n"))).cast("bigint"))


@query(f"""WITH {LISTINGS}, d AS (SELECT segment, CAST(t0 AS DATE) AS day, count(*) AS n FROM listings GROUP BY 1, 2)
SELECT segment, strftime(day, '%Y-%m-%d') AS day, CAST(coalesce(sum(n) OVER (PARTITION BY segment ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM d""")
def cumulative_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = listings(spark, sf_dir).groupBy("segment", F.to_date("t0").alias("d")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("segment").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    return days.select("segment", F.date_format("d", "yyyy-MM-dd").alias("day"), F.coalesce(F.sum("n").over(order), F.lit(0)).cast("bigint").alias("before"))


@query(f"""WITH {LISTINGS}, m AS (SELECT segment, region, median(price) AS fine FROM listings GROUP BY 1, 2), s AS (SELECT segment, median(price) AS wide, count(*) AS n FROM listings GROUP BY 1)
SELECT listing_id, round(price / coalesce(nullif(fine, 0), wide), 6) AS ratio FROM listings LEFT JOIN m USING (segment, region) LEFT JOIN s USING (segment)""")
def group_median_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).select("listing_id", "segment", "region", "price")
    fine = order.quantiles(rows, ["segment", "region"], {"fine": ("price", 0.5)})
    wide = order.quantiles(rows, ["segment"], {"wide": ("price", 0.5)})
    return rows.join(fine, ["segment", "region"], "left").join(wide, "segment", "left").select("listing_id", F.round(F.col("price") / F.coalesce(F.nullif(F.col("fine"), F.lit(0.0)), F.col("wide")), 6).alias("ratio"))


@query(f"""WITH {HISTORY}, f AS (SELECT listing_id, observed_at, event_id, inactive, coalesce(lag(inactive) OVER (PARTITION BY listing_id ORDER BY observed_at, event_id), NOT inactive) <> inactive AS flip FROM history)
SELECT listing_id, count(*) FILTER (WHERE flip) AS runs, max(CASE WHEN inactive AND flip THEN event_id END) AS last_start FROM f GROUP BY 1""")
def inactive_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("listing_id").orderBy("observed_at", "event_id")
    rows = history(spark, sf_dir).withColumn("flip", F.coalesce(F.lag("inactive").over(order), ~F.col("inactive")) != F.col("inactive"))
    return rows.groupBy("listing_id").agg(F.count_if("flip").alias("runs"), F.max(F.when(F.col("inactive") & F.col("flip"), F.col("event_id"))).alias("last_start"))


@query("""WITH keys AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
SELECT o_orderkey, o_totalprice, r_name FROM keys JOIN orders ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def key_lookup_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features for a table of keys (the orders with a returned line), by one plain join."""
    keys = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    areas = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    people = table(spark, sf_dir, "customer").join(areas, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "r_name")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return keys.join(orders, "o_orderkey").join(people, "o_custkey").select("o_orderkey", "o_totalprice", "r_name")


BANDS = """m AS (SELECT 'flag' AS name, l_returnflag AS value, count(*) % 10 + 1 AS points FROM lineitem GROUP BY 2 UNION ALL SELECT 'line', l_linestatus, count(*) % 7 + 1 FROM lineitem WHERE l_linestatus <> 'O' GROUP BY 2)"""


@query(f"""WITH {BANDS} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, coalesce(a.points, 0) + coalesce(b.points, 0) AS points FROM lineitem LEFT JOIN m a ON a.name = 'flag' AND a.value = l_returnflag LEFT JOIN m b ON b.name = 'line' AND b.value = l_linestatus""")
def band_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several lookups in one long table of (name, value, points); a value that it does not have gives nothing."""
    lines = table(spark, sf_dir, "lineitem")
    sides = [lines.groupBy(F.lit(n).alias("name"), F.col(c).alias("value")).agg((F.count("*") % k + 1).alias("points")) for n, c, k in (("flag", "l_returnflag", 10), ("line", "l_linestatus", 7))]
    bands = sides[0].unionByName(sides[1].where("value <> 'O'"))
    out = asof.band_points(lines, {"flag": "l_returnflag", "line": "l_linestatus"}, bands)
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "points")



@query("""SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 2) ON c_nationkey = n_nationkey""")
def pinned_release_join(spark: SparkSession, sf_dir: str, release: int = 2) -> DataFrame:
    """A dimension restricted to one release; it is an error if the release is not there exactly once."""
    if table(spark, sf_dir, "region").where(F.col("r_regionkey") == release).count() != 1:
        raise ValueError(f"release {release} is not there exactly once")
    pinned = table(spark, sf_dir, "nation").where(F.col("n_regionkey") == release).select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf_dir, "customer").join(pinned, "c_nationkey", "left").select("c_custkey", "n_name")


CHAIN = f"""{LISTINGS}, {SNAPSHOTS}, first AS (SELECT region, snapshot_at, CASE WHEN income >= 25000 THEN 'high' WHEN income >= 22000 THEN 'mid' ELSE 'low' END AS area FROM snapshots),
second AS (SELECT area, s.snapshot_at, round(avg(income), 4) AS wealth FROM snapshots s JOIN first f ON f.region = s.region AND f.snapshot_at = s.snapshot_at GROUP BY 1, 2),
a AS (SELECT listing_id, t0, area FROM listings ASOF LEFT JOIN first ON listings.region = first.region AND t0 >= first.snapshot_at)"""


@query(f"""WITH {CHAIN} SELECT listing_id, a.area, wealth, strftime(second.snapshot_at, '%Y-%m-%d') AS snapshot_date FROM a ASOF LEFT JOIN second ON a.area = second.area AND a.t0 >= second.snapshot_at""")
def asof_join_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area that a region had at decision time, then what was known of that area at the same time."""
    income = snapshots(spark, sf_dir)
    area = F.when(F.col("income") >= 25000, "high").when(F.col("income") >= 22000, "mid").otherwise("low")
    first = income.select("region", "snapshot_at", area.alias("area"))
    second = income.select("snapshot_at", area.alias("area"), "income").groupBy("area", "snapshot_at").agg(F.round(F.avg("income"), 4).alias("wealth"))
    base = listings(spark, sf_dir).select("listing_id", "region", "t0")
    found = asof.asof_join(base, first, ["region"], "t0", "snapshot_at").select("listing_id", "t0", "area")
    out = asof.asof_join(found, second.withColumnRenamed("snapshot_at", "known_at"), ["area"], "t0", "known_at")
    return out.select("listing_id", "area", "wealth", F.date_format("known_at", "yyyy-MM-dd").alias("snapshot_date"))


@query(f"""WITH {LISTINGS}, t AS (SELECT DISTINCT cohort, segment, CAST(t0 AS DATE) AS d FROM listings), s AS (SELECT cohort, segment, CAST(sold_at AS DATE) AS day, price FROM listings WHERE sold_at IS NOT NULL)
SELECT cohort, segment, strftime(d, '%Y-%m-%d') AS day, coalesce(median(price) FILTER (WHERE s.day >= d - 14), median(price)) AS anchor_14, coalesce(median(price) FILTER (WHERE s.day >= d - 30 AND s.day < d - 5), median(price) FILTER (WHERE s.day < d - 5)) AS anchor_30,
 median(price) FILTER (WHERE s.day >= d - 60) AS anchor_60, count(price) FILTER (WHERE s.day >= d - 14) AS n_14 FROM t LEFT JOIN s USING (cohort, segment) WHERE s.day IS NULL OR s.day < d GROUP BY 1, 2, 3
UNION ALL SELECT cohort, segment, strftime(d, '%Y-%m-%d'), NULL, NULL, NULL, 0 FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.cohort = t.cohort AND s.segment = t.segment AND s.day < d) AND EXISTS (SELECT 1 FROM s WHERE s.cohort = t.cohort AND s.segment = t.segment)""")
def rolling_median_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of the 14 and 30 days before a day (the latter with an embargo of five), of all days before where a window is
    empty, and of 60 days without that fallback."""
    rows = listings(spark, sf_dir)
    targets = rows.select("cohort", "segment", F.to_date("t0").alias("at"))
    sold = rows.where("sold_at is not null").select("cohort", "segment", F.to_date("sold_at").alias("day"), "price")
    found = asof.rolling_median(targets, sold, ["cohort", "segment"], "at", "day", "price", {"14": (14, 0), "30": (30, 5)}, {"60": (60, 0)})
    return found.select("cohort", "segment", F.date_format("at", "yyyy-MM-dd").alias("day"), *[f"anchor_{n}" for n in ("14", "30", "60")], "n_14")


@query(f"""WITH {LISTINGS}, live AS (SELECT cohort, least(t0, last_seen) AS s, greatest(t0, last_seen) AS e FROM listings WHERE last_seen IS NOT NULL), t AS (SELECT DISTINCT cohort, t0 FROM listings),
n AS (SELECT t.cohort, t.t0, count(s) AS n_active FROM t LEFT JOIN live ON live.cohort = t.cohort AND s <= t.t0 AND e >= t.t0 GROUP BY 1, 2),
d AS (SELECT DISTINCT cohort, CAST(t0 AS DATE) AS day FROM listings), p AS (SELECT cohort, CAST(t0 AS DATE) AS day, price FROM listings),
m AS (SELECT d.cohort, d.day, median(price) AS middle, quantile_cont(price, 0.5) AS q FROM d LEFT JOIN p ON p.cohort = d.cohort AND p.day >= d.day - 30 AND p.day < d.day GROUP BY 1, 2),
r AS (SELECT listing_id, round(percent_rank() OVER (PARTITION BY cohort, CAST(date_trunc('month', t0) AS DATE) ORDER BY price), 7) AS place FROM listings)
SELECT listing_id, n_active, middle AS ob_median, round(ln(price) - ln(middle), 7) AS ob_log_ratio, place AS ob_percentile FROM listings l JOIN n ON n.cohort = l.cohort AND n.t0 = l.t0 JOIN m ON m.cohort = l.cohort AND m.day = CAST(l.t0 AS DATE) JOIN r USING (listing_id)""")
def orderbook_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing among those on offer: how many are live, the median ask of the 30 days before, and where its price stands.

    Only the names of these columns are given in the inventory; the definition is our own.
    """
    rows = listings(spark, sf_dir).select("listing_id", "cohort", "t0", "last_seen", "price", F.to_date("t0").alias("at"))
    live = rows.where("last_seen is not null").select("cohort", F.least("t0", "last_seen").alias("s"), F.greatest("t0", "last_seen").alias("e"))
    counted = asof.active_count(rows.select("cohort", "t0").distinct(), live, ["cohort"], "t0", "s", "e")
    medians = asof.embargo_median(rows.select("cohort", "at"), rows.select("cohort", F.col("at").alias("day"), "price"), ["cohort"], "at", "day", "price", {"30": (30, 0)})
    place = F.percent_rank().over(Window.partitionBy("cohort", F.trunc("at", "month")).orderBy("price"))
    joined = rows.withColumn("place", place).join(counted, ["cohort", "t0"]).join(medians, ["cohort", "at"])
    return joined.select("listing_id", "n_active", F.col("median_30").alias("ob_median"), F.round(F.ln("price") - F.ln("median_30"), 7).alias("ob_log_ratio"), F.round("place", 7).alias("ob_percentile"))
