"""Ingestion, filters, work queues, top-k and set operations."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import candidates, order
from tidemark.operators.asof import latest_per_key
from tidemark.registry import query
from tidemark.sources.ingest import html_fields, insert_new, normalize_rows

from .roles import HISTORY, LISTINGS, history, listings, table


@query(r"""SELECT c_custkey, nullif(trim(c_name), '') AS name, regexp_replace(c_name, '[^0-9]', '', 'g') AS postal, CASE WHEN c_acctbal IS NULL THEN 'no_price' WHEN c_acctbal < 100 THEN 'below_minimum' END AS reason FROM customer""")
def ingest_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_rows(table(spark, sf_dir, "customer"), "c_custkey", "c_name", "c_acctbal", 100.0)


@query("""SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1
UNION ALL SELECT o_custkey, min(o_orderkey) FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def ingest_insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    target = latest_per_key(orders.where("o_orderstatus = 'F'"), ["o_custkey"], [F.col("o_orderkey")])
    return insert_new(target, orders.where("o_orderstatus = 'O'"), ["o_custkey"], [F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events WHERE event_type <> '') WHERE n = 1""")
def ingest_batch_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_per_key(table(spark, sf_dir, "events").where("event_type <> ''"), ["user_id", "event_type"], [F.col("event_id")]).select("user_id", "event_id")


LINKED = r"""o AS (SELECT page_id, html, flatten(list_transform(regexp_extract_all(html, '<script[^>]*ld\+json[^>]*>(.*?)</script>', 1, 'is'), lambda x: CASE WHEN json_valid(x) THEN CASE json_type(x) WHEN 'ARRAY' THEN json_extract(x, '$[*]') ELSE [CAST(x AS JSON)] END ELSE [] END)) AS os FROM p),
c AS (SELECT page_id, html, list_transform(os, lambda x: trim(coalesce(json_extract_string(x, '$.name'), ''))) AS names, list_transform(os, lambda x: trim(coalesce(json_extract_string(x, '$.description'), ''))) AS texts FROM o), """
FIELDS = r"""f AS (SELECT page_id,
 nullif(trim(regexp_replace(list_reduce(list_prepend('', names), lambda b, x: CASE WHEN length(x) > length(b) THEN x ELSE b END), '<[^>]*>|\s+', ' ', 'g')), '') AS a, nullif(trim(regexp_replace(regexp_extract(html, '<meta[^>]+og:title"[^>]+content="([^"]*)"', 1, 'is'), '<[^>]*>|\s+', ' ', 'g')), '') AS b,
 nullif(trim(regexp_replace(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 'is'), '<[^>]*>|\s+', ' ', 'g')), '') AS c, nullif(trim(regexp_replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), '<[^>]*>|\s+', ' ', 'g')), '') AS d,
 nullif(trim(regexp_replace(list_reduce(list_prepend('', texts), lambda b, x: CASE WHEN length(x) > length(b) THEN x ELSE b END), '<[^>]*>|\s+', ' ', 'g')), '') AS e, nullif(trim(regexp_replace(regexp_extract(html, '<meta[^>]+og:description"[^>]+content="([^"]*)"', 1, 'is'), '<[^>]*>|\s+', ' ', 'g')), '') AS g,
 nullif(trim(regexp_replace(regexp_extract(html, '<meta[^>]+name="description"[^>]+content="([^"]*)"', 1, 'is'), '<[^>]*>|\s+', ' ', 'g')), '') AS h FROM c)
SELECT page_id, coalesce(a, b, c, d) AS title, CASE WHEN a IS NOT NULL THEN 'jsonld' WHEN b IS NOT NULL THEN 'og' WHEN c IS NOT NULL THEN 'h1' WHEN d IS NOT NULL THEN 'title' END AS title_source,
 coalesce(e, g, h) AS description, CASE WHEN e IS NOT NULL THEN 'jsonld' WHEN g IS NOT NULL THEN 'og' WHEN h IS NOT NULL THEN 'meta' END AS description_source FROM f"""


@query(f"WITH p AS (SELECT page_id, html FROM pages), {LINKED}{FIELDS}")
def html_field_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_fields(table(spark, sf_dir, "pages"), "page_id", "html")


@query(f"""WITH p AS (SELECT page_id, concat('<script type="application/ld+json">', json_object('name', url, 'offer', json_object('name', 'a name that is too deep to count')), '</script><script type="application/ld+json">[',
  json_object('name', 'Page ' || page_id || ' of this site', 'description', 'about ' || url), ',', json_object('name', CAST(length(html) AS VARCHAR)), ']</script><script type="application/ld+json">{{"name": broken</script>', html) AS html FROM pages), {LINKED}{FIELDS}""")
def jsonld_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where pages say their name in linked data, in several scripts and lists."""
    block = lambda *parts: F.concat(F.lit('<script type="application/ld+json">'), *parts, F.lit("</script>"))
    one = F.to_json(F.struct(F.col("url").alias("name"), F.struct(F.lit("a name that is too deep to count").alias("name")).alias("offer")))
    two = F.to_json(F.array(F.struct(F.concat(F.lit("Page "), F.col("page_id"), F.lit(" of this site")).alias("name"), F.concat(F.lit("about "), F.col("url")).alias("description")), F.struct(F.length("html").cast("string").alias("name"), F.lit(None).cast("string").alias("description"))))
    html = F.concat(block(one), block(two), block(F.lit('{"name": broken')), F.col("html"))
    return html_fields(table(spark, sf_dir, "pages").withColumn("html", html), "page_id", "html")


@query("""SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')""")
def spam_anti_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.join(orders.where("o_orderpriority = '5-LOW'").select("o_custkey"), "o_custkey", "left_anti").select("o_custkey", "o_orderkey")


@query("""SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 30)""")
def todo_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 30").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(done, "p_partkey", "left_anti")


@query(f"""WITH {HISTORY}, media AS (SELECT listing_id, max(observed_at) AS media_at FROM history WHERE status = 'view' GROUP BY 1), made AS (SELECT listing_id, max(observed_at) AS made_at FROM history WHERE status = 'purchase' GROUP BY 1)
SELECT listing_id FROM media LEFT JOIN made USING (listing_id) WHERE made_at IS NULL OR made_at < media_at ORDER BY media_at DESC, listing_id LIMIT 50""")
def todo_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = history(spark, sf_dir)
    media = log.where("status = 'view'").groupBy("listing_id").agg(F.max("observed_at").alias("media_at"))
    made = log.where("status = 'purchase'").groupBy("listing_id").agg(F.max("observed_at").alias("made_at"))
    stale = media.join(made, "listing_id", "left").where("made_at is null or made_at < media_at")
    return stale.orderBy(F.desc("media_at"), "listing_id").limit(50).select("listing_id")


@query(f"""WITH {HISTORY}, a AS (SELECT listing_id, max(observed_at) AS last FROM history WHERE inactive GROUP BY 1) SELECT DISTINCT h.listing_id FROM history h LEFT JOIN a USING (listing_id) WHERE last IS NULL OR last < TIMESTAMP '2024-01-25'""")
def cadence_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = history(spark, sf_dir)
    recent = log.where(F.col("inactive") & (F.col("observed_at") >= F.lit("2024-01-25").cast("timestamp_ntz"))).select("listing_id")
    return log.select("listing_id").distinct().join(recent, "listing_id", "left_anti")


@query(f"""WITH {LISTINGS} SELECT segment, listing_id, n FROM (SELECT segment, listing_id, row_number() OVER (PARTITION BY segment ORDER BY t0 DESC, listing_id) AS n FROM listings) WHERE n <= 20""")
def per_group_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = Window.partitionBy("segment").orderBy(F.desc("t0"), "listing_id")
    # each task passes on the first rows of its own segments only
    return listings(spark, sf_dir).select("segment", "listing_id", F.row_number().over(newest).cast("bigint").alias("n")).where("n <= 20")


@query(f"""WITH {LISTINGS} SELECT listing_id FROM listings WHERE price BETWEEN 50000 AND 250000 AND status IN ('F', 'O') AND (battery IS NULL OR battery BETWEEN 15 AND 40) AND seller >= 0""")
def segment_hard_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = {"price": F.col("price").between(50000, 250000), "status": F.col("status").isin("F", "O"), "battery": F.col("battery").isNull() | F.col("battery").between(15, 40), "seller": F.col("seller") >= 0}
    rows = listings(spark, sf_dir)
    for gate in gates.values():
        rows = rows.where(gate)
    return rows.select("listing_id")


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def dup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query(f"""WITH {HISTORY}, a AS (SELECT listing_id, max(observed_at) AS last FROM history WHERE inactive GROUP BY 1), k AS (SELECT DISTINCT c_custkey AS listing_id FROM customer),
d AS (SELECT listing_id, last, row_number() OVER (ORDER BY last NULLS FIRST, listing_id) AS place FROM k LEFT JOIN a USING (listing_id) WHERE last IS NULL OR last < TIMESTAMP '2024-01-25')
SELECT listing_id, strftime(last, '%Y-%m-%d %H:%M:%S') AS last, place FROM d WHERE place <= 2000""")
def cadence_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 2,000 keys to audit: never audited ones first, then those whose audit is longest ago; none of the last five days."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("listing_id"))
    out = candidates.due(keys, history(spark, sf_dir).where("inactive"), "listing_id", "observed_at", datetime(2024, 1, 30), timedelta(days=5), 2000)
    return out.select("listing_id", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"), "place")


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS n, max(l_shipdate) AS newest FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
SELECT l_orderkey, l_linenumber, n, strftime(newest, '%Y-%m-%d') AS newest, row_number() OVER (ORDER BY g.newest DESC, l_orderkey, l_linenumber) AS place FROM g WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def dup_keys_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated keys that no finished order has dealt with, the newest first."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    out = candidates.repeated(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate", done)
    return out.select("l_orderkey", "l_linenumber", "n", F.date_format("newest", "yyyy-MM-dd").alias("newest"), "place")


@query(f"""WITH {LISTINGS} SELECT listing_id, date_diff('day', CAST(t0 AS DATE), DATE '1998-08-01') AS age FROM listings WHERE date_diff('day', CAST(t0 AS DATE), DATE '1998-08-01') >= 21""")
def age_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.datediff(F.to_date(F.lit("1998-08-01")), F.to_date("t0")).cast("bigint")
    return listings(spark, sf_dir).select("listing_id", age.alias("age")).where("age >= 21")


@query(f"""WITH {LISTINGS} SELECT listing_id, price FROM listings ORDER BY price DESC, listing_id LIMIT 25""")
def topk_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("listing_id", "price").orderBy(F.desc("price"), "listing_id").limit(25)


@query(f"""WITH {LISTINGS}, r AS (SELECT segment, listing_id, row_number() OVER (PARTITION BY segment ORDER BY seller >= 0 DESC, price DESC, listing_id) AS n, count(*) OVER (PARTITION BY segment) AS total FROM listings)
SELECT segment, listing_id FROM r WHERE n <= greatest(5, ceil(0.05 * total))""")
def promote_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).select("segment", "listing_id", "price", (F.col("seller") >= 0).alias("eligible"))
    placed = order.numbered(rows, ["segment"], [F.desc("eligible"), F.desc("price"), F.col("listing_id")])
    return placed.where(F.col("place") <= F.greatest(F.lit(5), F.ceil(0.05 * F.col("size")))).select("segment", "listing_id")


@query("""SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY day DESC LIMIT 10""")
def days_recent_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).distinct().orderBy(F.desc("day")).limit(10)


@query("""WITH m AS (SELECT max(CAST(o_orderdate AS DATE)) AS last FROM orders) SELECT DISTINCT strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day FROM orders, m WHERE date_diff('day', CAST(o_orderdate AS DATE), last) IN (30, 90, 180, 365, 540)""")
def sample_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    last = days.agg(F.max("d").alias("last"))
    return days.join(F.broadcast(last)).where(F.datediff("last", "d").isin(30, 90, 180, 365, 540)).select(F.date_format("d", "yyyy-MM-dd").alias("day"))


@query(f"""WITH {LISTINGS} SELECT 'segment' AS level, segment AS name, count(*) AS n FROM listings GROUP BY 2 UNION ALL SELECT 'region', region, count(*) FROM listings GROUP BY 2 UNION ALL SELECT 'all', 'all', count(*) FROM listings""")
def union_all_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    # one pass over the rows: each counts once for every level
    levels = F.array(*[F.struct(F.lit(k).alias("level"), v.alias("name")) for k, v in (("segment", F.col("segment")), ("region", F.col("region")), ("all", F.lit("all")))])
    return rows.select(F.explode(levels).alias("x")).groupBy("x.level", "x.name").agg(F.count("*").alias("n"))


@query(f"""WITH {LISTINGS} SELECT DISTINCT segment, strftime(t0, '%Y-%m') AS month FROM listings""")
def distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("segment", F.date_format("t0", "yyyy-MM").alias("month")).distinct()
