"""Scores against outcomes, rates over time and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import order
from tidemark.operators.merge import change_log
from tidemark.registry import query
from tidemark.shared import once

from .roles import HISTORY, LISTINGS, history, listings, table

SCORED = "s AS (SELECT labels.doc_id, quality AS y, least(1.0, n_chars / 4000.0) AS score FROM labels JOIN documents ON labels.doc_id = documents.doc_id)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.col("quality").alias("y"), F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("score"))


@query(f"""WITH {SCORED}, c AS (SELECT t, count(*) FILTER (WHERE score >= t AND y = 1) AS tp, count(*) FILTER (WHERE score >= t AND y = 0) AS fp, count(*) FILTER (WHERE score < t AND y = 1) AS fn, count(*) FILTER (WHERE score < t AND y = 0) AS tn FROM s, (SELECT unnest([0.1, 0.25, 0.5, 0.75]) AS t) GROUP BY 1)
SELECT CAST(t AS DOUBLE) AS threshold, tp, fp, fn, tn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f1 FROM c""")
def metrics_threshold(spark: SparkSession, sf_dir: str, thresholds: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75)) -> DataFrame:
    """Counts and rates at several thresholds, in one pass over the scores."""
    y, counts = F.col("y") == 1, []
    for i, t in enumerate(thresholds):
        hit = F.col("score") >= t
        counts += [F.count_if(hit & y).alias(f"tp{i}"), F.count_if(hit & ~y).alias(f"fp{i}"), F.count_if(~hit & y).alias(f"fn{i}"), F.count_if(~hit & ~y).alias(f"tn{i}")]
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), *[F.col(f"{k}{i}").alias(k) for k in ("tp", "fp", "fn", "tn")]) for i, t in enumerate(thresholds)])).alias("x")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def share(part, whole):
        return F.when(whole > 0, part / whole)

    return scored(spark, sf_dir).agg(*counts).select(rows).select("x.*").select("*", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


@query(f"""WITH {SCORED}, h AS (SELECT CAST(floor(score * 20) AS BIGINT) AS k, sum(y) AS p, count(*) AS n FROM s GROUP BY 1), c AS (SELECT k, sum(p) OVER (ORDER BY k DESC) AS tp, sum(n) OVER (ORDER BY k DESC) AS n, sum(p) OVER () AS pos FROM h),
m AS (SELECT k, CAST(tp AS BIGINT) AS tp, CAST(n AS BIGINT) AS n, round(tp / n, 7) AS precision, round(tp / pos, 7) AS recall FROM c)
SELECT k, precision, recall, CASE WHEN precision >= 0.8 THEN 'strict' WHEN precision >= 0.6 THEN 'relaxed' WHEN recall >= 0.5 THEN 'recall' ELSE 'any' END AS rule FROM m
ORDER BY CASE WHEN precision >= 0.8 THEN 0 WHEN precision >= 0.6 THEN 1 WHEN recall >= 0.5 THEN 2 ELSE 3 END, CASE WHEN precision >= 0.6 THEN recall ELSE precision END DESC, k DESC LIMIT 1""")
def threshold_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold with most recall at a precision of 0.8; failing that at 0.6; else the most precise one with half of the
    recall, or of all."""
    precision, recall = F.col("precision"), F.col("recall")
    level = F.when(precision >= 0.8, 0).when(precision >= 0.6, 1).when(recall >= 0.5, 2).otherwise(3)
    rule = F.when(precision >= 0.8, "strict").when(precision >= 0.6, "relaxed").when(recall >= 0.5, "recall").otherwise("any")
    ordered = threshold_sweep(spark, sf_dir).orderBy(level, F.desc(F.when(precision >= 0.6, recall).otherwise(precision)), F.desc("k"))
    return ordered.limit(1).select("k", "precision", "recall", rule.alias("rule"))


@query(f"""WITH {SCORED}, h AS (SELECT CAST(floor(score * 20) AS BIGINT) AS k, sum(y) AS p, count(*) AS n FROM s GROUP BY 1), c AS (SELECT k, sum(p) OVER (ORDER BY k DESC) AS tp, sum(n) OVER (ORDER BY k DESC) AS n, sum(p) OVER () AS pos FROM h)
SELECT k, CAST(tp AS BIGINT) AS tp, CAST(n AS BIGINT) AS n, round(tp / n, 7) AS precision, round(tp / pos, 7) AS recall FROM c""")
def threshold_sweep(spark: SparkSession, sf_dir: str, steps: int = 20) -> DataFrame:
    """Every threshold from one histogram of scores and running sums from the top; no pass per threshold."""
    bins = scored(spark, sf_dir).groupBy(F.floor(F.col("score") * steps).cast("bigint").alias("k")).agg(F.sum("y").alias("p"), F.count("*").alias("c"))
    down, every = Window.orderBy(F.desc("k")), Window.partitionBy()
    rows = bins.select("k", F.sum("p").over(down).alias("tp"), F.sum("c").over(down).alias("n"), F.sum("p").over(every).alias("pos"))
    return rows.select("k", "tp", "n", F.round(F.col("tp") / F.col("n"), 7).alias("precision"), F.round(F.col("tp") / F.col("pos"), 7).alias("recall"))


@query(f"""WITH {LISTINGS}, e AS (SELECT segment, price / 1000 AS y, battery * 6 AS p FROM listings WHERE battery IS NOT NULL)
SELECT segment, round(avg(abs(y - p)), 5) AS mae, round(median(abs(y - p)), 5) AS med, round(quantile_cont(abs(y - p), 0.9), 5) AS p90, round(sqrt(avg((y - p) * (y - p))), 5) AS rmse, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2 FROM e GROUP BY 1""")
def metrics_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.col("price") / 1000 - F.col("battery") * 6
    rows = once(listings(spark, sf_dir).where("battery is not null").select("segment", "price", "battery", F.abs(gap).alias("off")))
    cuts = order.quantiles(rows, ["segment"], {"med": ("off", 0.5), "p90": ("off", 0.9)}).select(F.col("segment").alias("of"), F.round("med", 5).alias("med"), F.round("p90", 5).alias("p90"))
    means = rows.groupBy("segment").agg(F.round(F.avg("off"), 5).alias("mae"), F.round(F.sqrt(F.avg(gap * gap)), 5).alias("rmse"), F.round(1 - F.avg(gap * gap) / F.var_pop(F.col("price") / 1000), 6).alias("r2"))
    return means.join(cuts, F.col("segment").eqNullSafe(F.col("of"))).drop("of")


@query(f"""WITH {LISTINGS}, d AS (SELECT price > 150000 AS slow, date_diff('day', CAST(t0 AS DATE), CAST(sold_at AS DATE)) AS days FROM listings WHERE sold_at IS NOT NULL)
SELECT count(*) FILTER (WHERE slow AND days < 10) / count(*) FILTER (WHERE days < 10) AS fast_lost, count(*) FILTER (WHERE slow AND days BETWEEN 10 AND 21) / count(*) FILTER (WHERE days BETWEEN 10 AND 21) AS mid_lost FROM d""")
def metrics_sacrifice(spark: SparkSession, sf_dir: str) -> DataFrame:
    days, slow = F.datediff(F.to_date("sold_at"), F.to_date("t0")), F.col("price") > 150000
    fast, mid = days < 10, days.between(10, 21)
    return listings(spark, sf_dir).where("sold_at is not null").agg((F.count_if(slow & fast) / F.count_if(fast)).alias("fast_lost"), (F.count_if(slow & mid) / F.count_if(mid)).alias("mid_lost"))


@query(f"""WITH {HISTORY} SELECT strftime(date_trunc('hour', observed_at), '%Y-%m-%d %H') AS hour, count(*) AS n, count(*) FILTER (WHERE inactive) / count(*) AS rate FROM history GROUP BY 1""")
def rate_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).groupBy(F.date_format("observed_at", "yyyy-MM-dd HH").alias("hour")).agg(F.count("*").alias("n"), (F.count_if("inactive") / F.count("*")).alias("rate"))


@query(f"""WITH {HISTORY} SELECT 'events' AS section, 'n' AS metric, count(*) AS value FROM history UNION ALL SELECT 'events', 'inactive', count(*) FILTER (WHERE inactive) FROM history UNION ALL SELECT 'keys', 'n', count(DISTINCT listing_id) FROM history""")
def metrics_union_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = history(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if("inactive").alias("i"), F.count_distinct("listing_id").alias("k"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), F.col(c).alias("value")) for s, m, c in (("events", "n", "n"), ("events", "inactive", "i"), ("keys", "n", "k"))])).alias("x")).select("x.*")


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS base, count(k) AS covered, count(k) / count(*) AS share FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') ON k = o_orderkey GROUP BY 1""")
def minmax_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")).distinct()
    joined = table(spark, sf_dir, "orders").join(covered, F.col("o_orderkey") == F.col("k"), "left")
    return joined.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("base"), F.count("k").alias("covered"), (F.count("k") / F.count("*")).alias("share"))


@query(f"""WITH {HISTORY}, f AS (SELECT listing_id, min(observed_at) AS first_seen, min(observed_at) FILTER (WHERE inactive) AS first_inactive FROM history GROUP BY 1) SELECT listing_id, date_diff('day', CAST(first_seen AS DATE), CAST(first_inactive AS DATE)) AS days FROM f WHERE first_inactive IS NULL OR first_inactive >= first_seen + INTERVAL 1 DAY""")
def first_intervention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history(spark, sf_dir).groupBy("listing_id").agg(F.min("observed_at").alias("a"), F.min(F.when(F.col("inactive"), F.col("observed_at"))).alias("b"))
    return rows.where(F.col("b").isNull() | (F.col("b") >= F.col("a") + F.expr("INTERVAL 1 DAY"))).select("listing_id", F.datediff(F.to_date("b"), F.to_date("a")).cast("bigint").alias("days"))


@query(f"""WITH {LISTINGS}, t AS (SELECT listing_id, price AS score, 1 AS trial FROM listings WHERE price > 150000 UNION ALL SELECT listing_id, price, 2 FROM listings WHERE seller > 3000 UNION ALL SELECT listing_id, price, 3 FROM listings WHERE n_images >= 4) SELECT listing_id, count(*) AS n, max(score) AS score FROM t GROUP BY 1 HAVING count(*) >= 2""")
def consensus_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings that two trials or more pick; one pass over the listings, whose trials are told apart within a row."""
    picked = [F.when(F.expr(c), F.struct(F.col("price").alias("score"))) for c in ("price > 150000", "seller > 3000", "n_images >= 4")]
    picks = listings(spark, sf_dir).select("listing_id", F.explode(F.array_compact(F.array(*picked))).alias("x"))
    return picks.groupBy("listing_id").agg(F.count("*").alias("n"), F.max("x.score").alias("score")).where("n >= 2")


@query(f"""WITH {LISTINGS}, z AS (SELECT segment, price, date_diff('day', CAST(t0 AS DATE), CAST(sold_at AS DATE)) AS days FROM listings WHERE sold_at IS NOT NULL AND price > 20000)
SELECT segment, count(*) FILTER (WHERE days <= 2) AS hits, count(*) FILTER (WHERE days > 3) AS misses, count(*) FILTER (WHERE days = 3) AS neutral FROM z GROUP BY 1""")
def metrics_midband(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff(F.to_date("sold_at"), F.to_date("t0"))
    return listings(spark, sf_dir).where("sold_at is not null and price > 20000").groupBy("segment").agg(F.count_if(days <= 2).alias("hits"), F.count_if(days > 3).alias("misses"), F.count_if(days == 3).alias("neutral"))


@query(f"""WITH {HISTORY}, x AS (SELECT status, inactive, lead(inactive) OVER (PARTITION BY listing_id ORDER BY observed_at, event_id) AS after FROM history)
SELECT status, count(*) FILTER (WHERE inactive = after) AS kept, count(*) FILTER (WHERE NOT inactive AND after) AS new, count(*) FILTER (WHERE inactive AND NOT after) AS removed, count(*) FILTER (WHERE after IS NULL) AS last FROM x GROUP BY 1""")
def transition_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.lead("inactive").over(Window.partitionBy("listing_id").orderBy("observed_at", "event_id"))
    rows = history(spark, sf_dir).withColumn("after", after)
    was, now = F.col("inactive"), F.col("after")
    return rows.groupBy("status").agg(F.count_if(was == now).alias("kept"), F.count_if(~was & now).alias("new"), F.count_if(was & ~now).alias("removed"), F.count_if(now.isNull()).alias("last"))


@query(f"""WITH {LISTINGS} SELECT segment, round(avg(battery), 6) AS mean_score, count(*) AS n FROM listings GROUP BY 1""")
def group_mean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).groupBy("segment").agg(F.round(F.avg("battery"), 6).alias("mean_score"), F.count("*").alias("n"))


@query(f"""WITH {LISTINGS} SELECT listing_id, segment, row_number() OVER (PARTITION BY segment ORDER BY price DESC, listing_id) AS place FROM listings""")
def rank_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.numbered(listings(spark, sf_dir).select("listing_id", "segment", "price"), ["segment"], [F.desc("price"), F.col("listing_id")]).select("listing_id", "segment", "place")


@query(f"""WITH {HISTORY}, f AS (SELECT *, lag(inactive) OVER (PARTITION BY listing_id ORDER BY observed_at, event_id) AS was FROM history), c AS (SELECT listing_id, observed_at, event_id FROM f WHERE (was IS NULL AND inactive) OR was <> inactive),
g AS (SELECT *, lag(observed_at, 5) OVER (PARTITION BY listing_id ORDER BY observed_at, event_id) AS back FROM c) SELECT listing_id, count(*) AS flips, count(*) FILTER (WHERE back >= observed_at - INTERVAL 7 DAYS) > 0 AS flapping FROM g GROUP BY 1""")
def flapping_report(spark: SparkSession, sf_dir: str, times: int = 6, days: int = 7) -> DataFrame:
    """How often each key flips, and whether it ever does so six times within seven days."""
    flips = change_log(history(spark, sf_dir), ["listing_id"], ["observed_at", "event_id"], "inactive")
    back = F.lag("observed_at", times - 1).over(Window.partitionBy("listing_id").orderBy("observed_at", "event_id"))
    near = F.coalesce(F.col("back") >= F.col("observed_at") - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))
    return flips.withColumn("back", back).groupBy("listing_id").agg(F.count("*").alias("flips"), F.bool_or(near).alias("flapping"))
