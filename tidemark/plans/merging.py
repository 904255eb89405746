"""Merging new observations into tables of record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import candidates, merge
from tidemark.registry import query

from .roles import HISTORY, history, table


@query("""WITH t AS (SELECT user_id, max(event_id) AS v, min(ts) AS created FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, max(event_id) AS v, min(ts) AS created FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT user_id, coalesce(b.v, t.v) AS v, strftime(least(t.created, b.created), '%Y-%m-%d %H:%M:%S') AS created FROM t FULL JOIN b USING (user_id)""")
def upsert_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events")
    sides = [log.where(F.col("event_type") == k).groupBy("user_id").agg(F.max("event_id").alias("v"), F.min("ts").alias("created")) for k in ("view", "click")]
    return merge.upsert(*sides, ["user_id"], overwrite=["v"], earliest=["created"]).withColumn("created", F.date_format("created", "yyyy-MM-dd HH:mm:ss"))


@query(f"""WITH {HISTORY}, p AS (SELECT listing_id, date_trunc('hour', observed_at) AS h, arg_max(status, (observed_at, event_id)) AS status, arg_max(price, (observed_at, event_id)) AS price FROM history WHERE event_id % 2 = 0 GROUP BY 1, 2),
e AS (SELECT listing_id, date_trunc('hour', observed_at) AS h, arg_max(status, (observed_at, event_id)) AS status, arg_max(price, (observed_at, event_id)) AS price FROM history WHERE event_id % 2 = 1 GROUP BY 1, 2)
SELECT listing_id, strftime(h, '%Y-%m-%d %H') AS hour, CASE WHEN p.status = 'purchase' OR e.status = 'purchase' THEN 'purchase' WHEN e.status = 'error' THEN 'error' ELSE coalesce(p.status, e.status) END AS status,
 CASE WHEN e.status = 'purchase' AND e.price > 0 THEN e.price WHEN p.status IS NULL THEN e.price WHEN e.price > 0 AND e.status <> 'error' AND p.status <> 'purchase' THEN e.price ELSE p.price END AS price FROM p FULL JOIN e USING (listing_id, h)""")
def history_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = history(spark, sf_dir).withColumn("h", F.date_trunc("hour", F.col("observed_at").cast("timestamp")).cast("timestamp_ntz"))
    at = F.struct("observed_at", "event_id")
    old, new = [log.where(F.col("event_id") % 2 == k).groupBy("listing_id", "h").agg(F.max_by("status", at).alias("status"), F.max_by("price", at).alias("price")) for k in (0, 1)]
    return merge.merge_history(old, new, ["listing_id", "h"], sold="purchase", removed="error").select("listing_id", F.date_format("h", "yyyy-MM-dd HH").alias("hour"), "status", "price")


SIDE = "SELECT listing_id, date_trunc('day', observed_at) AS h, arg_max(status, (observed_at, event_id)) AS status, arg_max(price, (observed_at, event_id)) AS price, max(observed_at) AS seen, arg_max(src, (observed_at, event_id)) AS source"


@query(f"""WITH {HISTORY}, t AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN 'audit' ELSE 'monitor' END AS src FROM history), a AS ({SIDE} FROM t WHERE event_id % 2 = 0 GROUP BY 1, 2), b AS ({SIDE} FROM t WHERE event_id % 2 = 1 GROUP BY 1, 2)
SELECT listing_id, strftime(h, '%Y-%m-%d') AS day, CASE WHEN a.status IS NULL THEN b.status WHEN b.status IS NULL THEN a.status WHEN 'purchase' IN (a.status, b.status) THEN 'purchase' WHEN a.source <> 'monitor' THEN a.status WHEN b.status = 'error' THEN 'error' ELSE a.status END AS status,
 CASE WHEN a.status IS NULL THEN b.price WHEN b.status IS NULL THEN a.price WHEN b.status = 'purchase' AND b.price > 0 THEN b.price WHEN a.source <> 'monitor' THEN a.price WHEN b.status <> 'error' AND a.status NOT IN ('purchase', 'error') AND b.price > 0 THEN b.price ELSE a.price END AS price,
 strftime(CASE WHEN a.status IS NULL THEN b.seen WHEN b.status IS NULL THEN a.seen WHEN b.status = 'purchase' THEN b.seen WHEN a.status = 'purchase' THEN a.seen WHEN a.source <> 'monitor' THEN a.seen ELSE greatest(a.seen, b.seen) END, '%Y-%m-%d %H:%M:%S') AS seen,
 CASE WHEN a.status IS NULL THEN b.source WHEN b.status IS NULL OR a.source <> 'monitor' THEN a.source ELSE b.source END AS source FROM a FULL JOIN b USING (listing_id, h)""")
def history_merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two days' histories merged; what another source wrote stands but for a sale."""
    log = history(spark, sf_dir).withColumn("h", F.date_trunc("day", F.col("observed_at").cast("timestamp")).cast("timestamp_ntz")).withColumn("src", F.when(F.col("event_id") % 4 == 0, "audit").otherwise("monitor"))
    at = F.struct("observed_at", "event_id")
    old, new = [log.where(F.col("event_id") % 2 == k).groupBy("listing_id", "h").agg(F.max_by("status", at).alias("status"), F.max_by("price", at).alias("price"), F.max("observed_at").alias("seen"), F.max_by("src", at).alias("source")) for k in (0, 1)]
    out = merge.merge_sourced(old, new, ["listing_id", "h"], own="monitor", sold="purchase", removed="error")
    return out.select("listing_id", F.date_format("h", "yyyy-MM-dd").alias("day"), "status", "price", F.date_format("seen", "yyyy-MM-dd HH:mm:ss").alias("seen"), "source")


@query(f"""WITH {HISTORY}, d AS (SELECT *, CAST(observed_at AS DATE) AS day, CASE WHEN status IN ('view', 'signup') THEN 'audit' ELSE 'monitor' END AS source FROM history),
o AS (SELECT listing_id, day, arg_min(price, (observed_at, event_id)) AS price, arg_min(source, (observed_at, event_id)) AS source, min(observed_at) AS seen FROM d WHERE status IN ('view', 'click') GROUP BY 1, 2),
n AS (SELECT listing_id, day, arg_max(CASE WHEN price > 5 THEN price ELSE 0 END, (observed_at, event_id)) AS price, 'monitor' AS source, max(observed_at) AS seen FROM d WHERE status IN ('purchase', 'error') GROUP BY 1, 2)
SELECT listing_id, strftime(day, '%Y-%m-%d') AS day, CASE WHEN o.source <> 'monitor' THEN o.price WHEN o.source IS NULL OR n.price > 0 THEN n.price ELSE o.price END AS price, CASE WHEN o.source <> 'monitor' THEN o.source ELSE coalesce(n.source, o.source) END AS source,
 strftime(CASE WHEN o.source <> 'monitor' THEN o.seen ELSE greatest(o.seen, n.seen) END, '%Y-%m-%d %H:%M:%S') AS seen FROM o FULL JOIN n USING (listing_id, day)""")
def daily_baseline_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's new rows merged into the baselines: rows of another source stay, prices count where they are over 0."""
    at = F.struct("observed_at", "event_id")
    rows = history(spark, sf_dir).withColumn("day", F.to_date("observed_at")).withColumn("source", F.when(F.col("status").isin("view", "signup"), "audit").otherwise("monitor"))
    old = rows.where("status in ('view', 'click')").groupBy("listing_id", "day").agg(F.min_by("price", at).alias("price"), F.min_by("source", at).alias("source"), F.min("observed_at").alias("seen"))
    new = rows.where("status in ('purchase', 'error')").groupBy("listing_id", "day").agg(F.max_by(F.when(F.col("price") > 5, F.col("price")).otherwise(0.0), at).alias("price"), F.lit("monitor").alias("source"), F.max("observed_at").alias("seen"))
    out = merge.merge_daily(old, new, ["listing_id", "day"], "monitor")
    return out.select("listing_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "price", "source", F.date_format("seen", "yyyy-MM-dd HH:mm:ss").alias("seen"))


@query(f"""WITH {HISTORY}, l AS (SELECT listing_id, arg_max(status, (observed_at, event_id)) AS status, arg_max(price, (observed_at, event_id)) AS price, max(price) FILTER (WHERE price > 0) AS known FROM history GROUP BY 1)
SELECT listing_id, CASE WHEN status = 'purchase' THEN 'sold' WHEN status = 'error' THEN 'removed' ELSE 'live' END AS state, CASE WHEN price > 50 THEN 'event' WHEN known IS NOT NULL THEN 'db_fallback' ELSE 'none' END AS price_source FROM l""")
def state_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("observed_at", "event_id")
    last = history(spark, sf_dir).groupBy("listing_id").agg(F.max_by("status", at).alias("status"), F.max_by("price", at).alias("price"), F.max(F.when(F.col("price") > 0, F.col("price"))).alias("known"))
    state = F.when(F.col("status") == "purchase", "sold").when(F.col("status") == "error", "removed").otherwise("live")
    return last.select("listing_id", state.alias("state"), F.when(F.col("price") > 50, "event").when(F.col("known").isNotNull(), "db_fallback").otherwise("none").alias("price_source"))


@query(f"""WITH {HISTORY}, f AS (SELECT *, lag(inactive) OVER (PARTITION BY listing_id ORDER BY observed_at, event_id) AS was FROM history) SELECT listing_id, event_id, inactive FROM f WHERE (was IS NULL AND inactive) OR was <> inactive""")
def change_only_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.change_log(history(spark, sf_dir), ["listing_id"], ["observed_at", "event_id"], "inactive").select("listing_id", "event_id", "inactive")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 'sold' WHEN o_orderstatus = 'P' THEN 'removed' ELSE 'live' END AS expected, o_orderstatus <> CASE WHEN o_totalprice > 150000 THEN 'F' ELSE 'O' END AS mismatch,
 concat_ws(';', CASE WHEN o_totalprice > 150000 THEN 'high_price' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END) AS reasons FROM orders""")
def status_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    expected = F.when((status == "F") & (price > 100000), "sold").when(status == "P", "removed").otherwise("live")
    return table(spark, sf_dir, "orders").select("o_orderkey", expected.alias("expected"), (status != F.when(price > 150000, "F").otherwise("O")).alias("mismatch"), F.concat_ws(";", F.when(price > 150000, "high_price"), F.when(status == "P", "pending")).alias("reasons"))


@query("""WITH s AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'live' WHEN 'P' THEN 'stale' ELSE 'sold' END AS was, CASE WHEN o_totalprice > 200000 THEN 'sold' WHEN o_totalprice < 20000 THEN 'removed' ELSE 'live' END AS seen, o_orderpriority = '5-LOW' AS flag FROM orders),
a AS (SELECT *, (was IN ('live', 'stale') AND seen IN ('sold', 'removed')) OR (was = 'stale' AND seen = 'live') AS applied FROM s)
SELECT o_orderkey, 'status:' || was || '->' || seen AS action FROM a WHERE applied UNION ALL SELECT o_orderkey, 'inactive:' || CAST(seen <> 'live' AS VARCHAR) FROM a WHERE applied AND flag <> (seen <> 'live')""")
def safe_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of what a policy changes: statuses, and inactive flags that go with them."""
    price = F.col("o_totalprice")
    was = F.when(F.col("o_orderstatus") == "O", "live").when(F.col("o_orderstatus") == "P", "stale").otherwise("sold")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", was.alias("was"), F.when(price > 200000, "sold").when(price < 20000, "removed").otherwise("live").alias("seen"), (F.col("o_orderpriority") == "5-LOW").alias("flag"))
    return merge.apply_with_log(rows, "o_orderkey", "was", "seen", "flag", mode="all", allow_revive=True)[1]


@query("""WITH r AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 2 ELSE 1 END AS rank, o_orderdate, o_orderkey, o_totalprice FROM orders)
SELECT o_custkey, max(rank) AS rank, arg_max(o_orderkey, (rank, o_orderdate, o_orderkey)) AS kept, max(o_totalprice) FILTER (WHERE rank = 3) AS sold_price FROM r GROUP BY 1""")
def canonical_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("rank", F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "P", 2).otherwise(1))
    return rows.groupBy("o_custkey").agg(F.max("rank").alias("rank"), F.max_by("o_orderkey", F.struct("rank", "o_orderdate", "o_orderkey")).alias("kept"), F.max(F.when(F.col("rank") == 3, F.col("o_totalprice"))).alias("sold_price"))


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority <> '5-LOW' DESC, o_orderdate DESC, o_orderkey) = 1 OR max(o_totalprice > 400000) OVER (PARTITION BY o_custkey) AS keep FROM orders""")
def dedupe_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return merge.keep_newest_consistent(rows, ["o_custkey"], F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice") > 400000, [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "keep")


@query(f"""WITH {HISTORY}, l AS (SELECT listing_id, arg_max(price, (observed_at, event_id)) AS latest, avg(price) AS main FROM history WHERE price IS NOT NULL GROUP BY 1) SELECT listing_id, latest FROM l WHERE abs(latest - main) > 20""")
def snapshot_sync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history(spark, sf_dir).where("price is not null").groupBy("listing_id").agg(F.max_by("price", F.struct("observed_at", "event_id")).alias("latest"), F.avg("price").alias("main"))
    return rows.where(F.abs(F.col("latest") - F.col("main")) > 20).select("listing_id", "latest")


@query(f"""WITH {HISTORY}, l AS (SELECT listing_id, arg_max(price, (observed_at, event_id)) AS latest FROM history WHERE price > 0 GROUP BY 1), m AS (SELECT c_custkey AS listing_id, c_acctbal AS main FROM customer WHERE c_custkey % 7 <> 0)
SELECT listing_id, latest, main, row_number() OVER (ORDER BY abs(latest - main) DESC NULLS FIRST, listing_id) AS place FROM l LEFT JOIN m USING (listing_id) WHERE main IS NULL OR abs(latest - main) > 500""")
def snapshot_sync_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sync of the latest good prices into another table has to do, the largest differences first."""
    latest = history(spark, sf_dir).where("price > 0").groupBy("listing_id").agg(F.max_by("price", F.struct("observed_at", "event_id")).alias("price"))
    main = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("listing_id"), F.col("c_acctbal").alias("price"))
    return candidates.out_of_step(latest, main, "listing_id", "price", 500)


@query("""WITH c AS (SELECT conv_id, turn, text, sha256(coalesce(text, '')) AS h, lag(sha256(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn) AS was FROM conversations) SELECT conv_id, turn, CASE WHEN was IS NULL OR was <> h THEN text END AS stored, coalesce(was = h, false) AS unchanged FROM c""")
def snapshot_change_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.sha2(F.coalesce("text", F.lit("")), 256)
    was = F.lag("h").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").withColumn("h", h).withColumn("was", was)
    return rows.select("conv_id", "turn", F.when(F.col("was").isNull() | (F.col("was") != F.col("h")), F.col("text")).alias("stored"), F.coalesce(F.col("was") == F.col("h"), F.lit(False)).alias("unchanged"))


@query("""WITH d AS (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-01-01')
SELECT count(*) AS due, count(*) FILTER (WHERE n <= 5000) AS swept, strftime(min(o_orderdate) FILTER (WHERE n <= 5000), '%Y-%m-%d') AS oldest, strftime(max(o_orderdate) FILTER (WHERE n <= 5000), '%Y-%m-%d') AS newest, false AS dry_run,
 (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') - count(*) FILTER (WHERE n <= 5000) AS live_after FROM d""")
def stale_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run log of one sweep of at most 5000 rows, and how many live rows are left."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") == "O", "live").otherwise("other").alias("status"))
    after, log = merge.sweep(rows, "o_orderkey", "status", "o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz"), 5000)
    left = after.agg(F.count_if(F.col("status") == "live").alias("live_after"))
    return log.join(F.broadcast(left)).select("due", "swept", F.date_format("oldest", "yyyy-MM-dd").alias("oldest"), F.date_format("newest", "yyyy-MM-dd").alias("newest"), "dry_run", "live_after")


@query("""SELECT p_partkey, p_brand, p_partkey = max(p_partkey) OVER (PARTITION BY p_brand) AS is_current FROM part""")
def activate_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each group exactly one release is current: the one that a table of targets names."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    targets = parts.groupBy("p_brand").agg(F.max("p_partkey").alias("p_partkey"))
    return merge.activate(parts, targets, ["p_brand"], "p_partkey")


@query("""SELECT l_orderkey, coalesce(max(l_quantity) FILTER (WHERE l_returnflag = 'R'), max(l_quantity) FILTER (WHERE l_returnflag = 'A'), 0) AS value, coalesce(max(l_quantity) FILTER (WHERE l_returnflag = 'R') <> max(l_quantity) FILTER (WHERE l_returnflag = 'A'), false) AS conflict FROM lineitem GROUP BY 1""")
def reconcile_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, main = [F.max(F.when(F.col("l_returnflag") == k, F.col("l_quantity"))) for k in "RA"]
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.coalesce(after, main, F.lit(0.0)).alias("value"), F.coalesce(after != main, F.lit(False)).alias("conflict"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 3 WHEN o_totalprice > 200000 THEN 2 WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS rank FROM orders""")
def status_escalate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status rank that never falls: the greater of what is there and what was seen."""
    there = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "P", 2).otherwise(1)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.greatest(there, F.when(F.col("o_totalprice") > 200000, 2).otherwise(1)).alias("rank"))


@query("""SELECT p_partkey, CASE WHEN p_size = 1 THEN 0 WHEN p_size = 2 THEN 3 END AS stamped, p_size IN (1, 2) AS by_rule FROM part""")
def hard_rule_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(size == 1, 0).when(size == 2, 3).alias("stamped"), size.isin(1, 2).alias("by_rule"))


@query("""WITH m AS (SELECT c_custkey AS old, c_custkey + 1000000 AS new FROM customer WHERE c_acctbal < 0) SELECT 'orders' AS "table", old, new, count(*) AS n FROM m JOIN orders ON o_custkey = old GROUP BY 2, 3
UNION ALL SELECT 'customer', old, new, count(*) FROM m JOIN customer ON c_custkey = old GROUP BY 2, 3 UNION ALL SELECT 'events', old, new, count(*) FROM m JOIN events ON user_id = old GROUP BY 2, 3""")
def key_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of a correction of keys over three tables."""
    people = table(spark, sf_dir, "customer")
    mapping = people.where("c_acctbal < 0").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1000000).alias("new"))
    return merge.correct_keys({"orders": (table(spark, sf_dir, "orders"), "o_custkey"), "customer": (people, "c_custkey"), "events": (table(spark, sf_dir, "events"), "user_id")}, mapping, "old", "new")[1]


@query(f"""WITH {HISTORY}, s AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY listing_id) AS total, lag(price) OVER w AS last_price, coalesce(lag(inactive) OVER w, false) AS was_inactive, first_value(price) OVER w AS main_price,
 count(*) OVER (PARTITION BY listing_id, CAST(observed_at AS DATE) ORDER BY observed_at, event_id) > 1 AS has_baseline FROM history WINDOW w AS (PARTITION BY listing_id ORDER BY observed_at, event_id)),
f AS (SELECT listing_id, event_id, status, price, price > 40 AND status <> 'click' AS sure, inactive, was_inactive, last_price, main_price, has_baseline, CASE WHEN price > 40 AND status <> 'click' THEN price WHEN last_price > 0 THEN last_price ELSE main_price END AS base FROM s)
SELECT event_id, 'event' AS kind, price, 'sold' AS status, 'terminal_sold' AS reason FROM f WHERE status = 'purchase' UNION ALL SELECT event_id, 'event', base, 'removed', 'terminal_removed' FROM f WHERE status = 'signup'
UNION ALL SELECT event_id, 'baseline', base, 'live', 'daily_baseline_missing' FROM f WHERE status NOT IN ('purchase', 'signup') AND NOT has_baseline
UNION ALL SELECT event_id, 'event', price, 'live', 'price_changed' FROM f WHERE status NOT IN ('purchase', 'signup') AND sure AND (coalesce(last_price, 0) = 0 OR price <> last_price)
UNION ALL SELECT event_id, 'event', base, 'live', 'inactive_flip' FROM f WHERE status NOT IN ('purchase', 'signup') AND NOT (sure AND (coalesce(last_price, 0) = 0 OR price <> last_price)) AND inactive <> was_inactive""")
def sparse_history_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sparse history writes at every observation, given what was known before it."""
    order = Window.partitionBy("listing_id").orderBy("observed_at", "event_id")
    day = Window.partitionBy("listing_id", F.to_date("observed_at")).orderBy("observed_at", "event_id")
    log = history(spark, sf_dir)
    facts = log.select(
        "event_id", F.when(F.col("status") == "purchase", "sold").when(F.col("status") == "signup", "removed").otherwise("live").alias("status"), "price", (F.col("price") > 40).alias("reliable"), (F.col("status") == "click").alias("bidding"),
        F.first("price").over(order).alias("main_price"), "inactive", F.coalesce(F.lag("inactive").over(order), F.lit(False)).alias("was_inactive"), F.lag("price").over(order).alias("last_price"), (F.row_number().over(day) > 1).alias("has_baseline"),
    )
    return merge.history_plan(facts, ["event_id"])


@query(f"""WITH {HISTORY}, m AS (SELECT listing_id, arg_min(round(price / 100, 1), (observed_at, event_id)) AS score FROM history GROUP BY 1), s AS (SELECT listing_id, arg_max(round(price / 100, 1), (observed_at, event_id)) AS score FROM history WHERE status IN ('view', 'click') GROUP BY 1)
SELECT listing_id, CASE WHEN abs(s.score - m.score) > 1e-9 THEN s.score ELSE m.score END AS score, CASE WHEN abs(s.score - m.score) > 1e-9 THEN CAST(m.score AS VARCHAR) || '->' || CAST(s.score AS VARCHAR) ELSE '' END AS log,
 CASE WHEN abs(s.score - m.score) > 1e-9 THEN CASE WHEN abs(s.score - 1.0) < 1e-9 THEN 0 WHEN abs(s.score - 0.2) < 1e-9 THEN 3 END END AS severity, coalesce(abs(s.score - m.score) > 1e-9 AND abs(s.score - 1.0) >= 1e-9 AND abs(s.score - 0.2) >= 1e-9, false) AS queued FROM m LEFT JOIN s USING (listing_id)""")
def sync_apply_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores taken over from snapshots, with an entry in the log of each row, fixed severities and a queue for the rest."""
    at, log = F.struct("observed_at", "event_id"), history(spark, sf_dir).withColumn("s", F.round(F.col("price") / 100, 1))
    main = log.groupBy("listing_id").agg(F.min_by("s", at).alias("score")).withColumn("log", F.array().cast("array<struct<was:double,now:double>>"))
    snaps = log.where("status in ('view', 'click')").groupBy("listing_id").agg(F.max_by("s", at).alias("score"))
    out = merge.sync_with_audit(main, snaps, "listing_id", "score", "log", {1.0: 0, 0.2: 3})
    shown = F.array_join(F.transform("log", lambda x: F.concat(x["was"].cast("string"), F.lit("->"), x["now"].cast("string"))), ",")
    return out.select("listing_id", "score", shown.alias("log"), "severity", "queued")


@query("""WITH l AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE length(coalesce(text, '')) <= 300), f AS (SELECT conv_id, arg_max(text, (length(text), turn)) AS text FROM conversations WHERE text IS NOT NULL GROUP BY 1)
SELECT conv_id, turn, length(l.text) AS old_length, f.text AS text, 'by=refresh,turn=' || CAST(turn AS VARCHAR) AS evidence FROM l JOIN f USING (conv_id) WHERE n = 1""")
def refresh_short_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest short text of each key, patched with the longest one that was found, evidence maps merged."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    snaps = turns.withColumn("evidence", F.create_map(F.lit("turn"), F.col("turn").cast("string"), F.lit("by"), F.lit("scan")))
    fresh = turns.where("text is not null").groupBy("conv_id").agg(F.max_by("text", F.struct(F.length("text"), "turn")).alias("text")).withColumn("evidence", F.create_map(F.lit("by"), F.lit("refresh")))
    out = merge.refresh_short(snaps, fresh, ["conv_id"], ["turn"], "text", "evidence", 300)
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("evidence"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ",")
    return out.select("conv_id", "turn", "old_length", "text", shown.alias("evidence"))


@query("""WITH b AS (SELECT conv_id, arg_max(text, (length(text), text)) AS t, max(turn) AS seen FROM conversations WHERE trim(coalesce(text, '')) <> '' GROUP BY 1), s AS (SELECT conv_id, sha1(arg_max(text, length(text))) AS digest, min(turn) AS made FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT conv_id, CASE WHEN s.digest = sha1(t) THEN 'touched' WHEN s.digest IS NULL THEN 'new' ELSE 'replaced' END AS action, sha1(t) AS digest, greatest(made, seen) AS made FROM b LEFT JOIN s USING (conv_id)""")
def touch_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several texts of a key the longest one; where its digest is what is stored, only the time moves on. Of the user's texts
    of one length the first counts."""
    turns = table(spark, sf_dir, "conversations")
    stored = turns.where("role = 'user'").groupBy("conv_id").agg(F.sha1(F.max_by("text", F.struct(F.length("text"), -F.col("turn")))).alias("digest"), F.min("turn").alias("made"))
    return merge.touch_or_replace(stored, turns, ["conv_id"], "text", "digest", "made", "turn")
