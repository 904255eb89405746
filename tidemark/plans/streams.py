"""Streaming forms of the event-log operators; each drains what lies in the folder and returns the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import woe
from tidemark.operators.asof import latest_per_key
from tidemark.registry import query
from tidemark.streaming import logs

from .roles import HISTORY, history

#: What the watermark has passed after all events, with a day for late ones.
CLOSED = "(SELECT max(observed_at) - INTERVAL 1 DAY FROM history)"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return stream.select(F.col("user_id").alias("listing_id"), "event_id", F.col("ts").cast("timestamp").alias("observed_at"), F.col("value").alias("price"), F.col("event_type").alias("status"), (F.col("event_type") == "error").alias("inactive"))


@query(f"""WITH {HISTORY} SELECT listing_id, strftime(CAST(observed_at AS DATE), '%Y-%m-%d') AS day, min(event_id) AS event_id, count(*) AS n FROM history GROUP BY listing_id, CAST(observed_at AS DATE) HAVING CAST(observed_at AS DATE) + INTERVAL 1 DAY <= {CLOSED}""")
def stream_daily_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per key and closed day from tumbling windows."""
    out = logs.drained(logs.daily_baseline(event_stream(spark, sf_dir)))
    return out.select("listing_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "event_id", "n")


@query(f"""WITH {HISTORY} SELECT DISTINCT listing_id, strftime(date_trunc('hour', observed_at), '%Y-%m-%d %H') AS hour, price FROM history""")
def stream_hour_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key, hour and price once; state is dropped behind the watermark."""
    out = logs.drained(logs.hour_dedupe(event_stream(spark, sf_dir)))
    return out.select("listing_id", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "price")


@query(f"""WITH {HISTORY}, f AS (SELECT *, lag(inactive) OVER (PARTITION BY listing_id ORDER BY observed_at, event_id) AS was FROM history) SELECT listing_id, event_id, inactive FROM f WHERE ((was IS NULL AND inactive) OR was <> inactive) AND observed_at <= {CLOSED}""")
def stream_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flips of a flag among the events that the watermark has passed, as the batch form finds them."""
    return logs.drained(logs.change_log(event_stream(spark, sf_dir)), rocks=True)


@query(f"""WITH {HISTORY}, w AS (SELECT listing_id, CAST(observed_at AS DATE) + CAST(k AS INTEGER) AS until, price FROM history, unnest(range(1, 8)) AS x(k)) SELECT listing_id, strftime(until, '%Y-%m-%d') AS until, count(*) AS n, round(avg(price), 6) AS mean FROM w WHERE until <= {CLOSED} GROUP BY 1, 2""")
def stream_trailing_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the seven days before each midnight, from sliding windows."""
    out = logs.drained(logs.trailing_counts(event_stream(spark, sf_dir)))
    return out.select("listing_id", F.date_format("until", "yyyy-MM-dd").alias("until"), "n", F.round("mean", 6).alias("mean"))


@query(f"""WITH {HISTORY} SELECT d.event_id, e.event_id AS evidence_id FROM history d JOIN history e ON e.listing_id = d.listing_id AND d.status = 'view' AND e.status = 'click' AND e.observed_at >= d.observed_at AND e.observed_at <= d.observed_at + INTERVAL 24 HOURS""")
def stream_sla_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that was there within a day of its decision, from a join of two streams."""
    log = event_stream(spark, sf_dir)
    return logs.drained(logs.evidence_in_time(log.where("status = 'view'"), event_stream(spark, sf_dir).where("status = 'click'")))


@query(f"""WITH {HISTORY}, g AS (SELECT listing_id, observed_at, CASE WHEN observed_at < lag(observed_at) OVER w + INTERVAL 12 HOURS THEN 0 ELSE 1 END AS fresh FROM history WINDOW w AS (PARTITION BY listing_id ORDER BY observed_at, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY listing_id ORDER BY observed_at ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT listing_id, strftime(min(observed_at), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY listing_id, k HAVING max(observed_at) + INTERVAL 12 HOURS <= {CLOSED}""")
def stream_session_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of edits of a listing in quick succession, from session windows."""
    out = logs.drained(logs.sessions(event_stream(spark, sf_dir)))
    return out.select("listing_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query(f"""WITH {HISTORY} SELECT listing_id, arg_max(event_id, (observed_at, event_id)) AS event_id, arg_max(price, (observed_at, event_id)) AS price FROM history GROUP BY 1""")
def stream_upsert_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each key in a table that the batches of a stream are merged into."""
    newest = [F.desc("observed_at"), F.desc("event_id")]
    rows = event_stream(spark, sf_dir).select("listing_id", "event_id", "observed_at", "price")
    return logs.upserted(rows, "listing_id", lambda table, batch: latest_per_key(table.unionByName(batch), ["listing_id"], newest)).select("listing_id", "event_id", "price")


@query(f"""WITH {HISTORY}, o AS (SELECT event_id, CASE WHEN price > 60 THEN 1 ELSE 0 END AS y, status, CAST(listing_id % 7 AS VARCHAR) AS shard FROM history), l AS (SELECT event_id, y, 'status' AS name, status AS value FROM o UNION ALL SELECT event_id, y, 'shard', shard FROM o),
w AS (SELECT name, value, ln(((sum(y) + 0.5) / max(p)) / ((sum(1 - y) + 0.5) / max(q))) AS woe FROM (SELECT *, sum(y) OVER (PARTITION BY name) AS p, sum(1 - y) OVER (PARTITION BY name) AS q FROM l) GROUP BY 1, 2)
SELECT event_id, round(sum(woe), 7) AS score FROM l JOIN w USING (name, value) GROUP BY 1""")
def stream_incremental_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a stream scored by a static table of bands."""
    shard = (F.col("listing_id") % 7).cast("string").alias("shard")
    past = history(spark, sf_dir).select("event_id", F.when(F.col("price") > 60, 1).otherwise(0).alias("y"), "status", shard)
    bands = woe.evidence(woe.long_form(past, ["status", "shard"], ["event_id", "y"]))
    touched = logs.drained(logs.score_touched(event_stream(spark, sf_dir).select("event_id", "status", shard), bands, ["status", "shard"]))
    return touched.groupBy("event_id").agg(F.round(F.sum("woe"), 7).alias("score"))
