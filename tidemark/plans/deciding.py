"""Decisions about listings, and what texts and fixed conditions say of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import verdicts
from tidemark.operators.asof import asof_join
from tidemark.registry import query

from .roles import HISTORY, history, table

REVIEW = {"sold": "sold_row_appears_live", "removed": "removed_row_appears_live", "stale": "stale_row_appears_live"}


@query(f"""WITH {HISTORY}, p AS (SELECT listing_id, observed_at AS seen_at, arg_max(price, event_id) AS last_price FROM history WHERE price > 0 GROUP BY 1, 2),
s AS (SELECT h.listing_id, event_id, CASE WHEN event_id % 17 = 0 THEN 410 WHEN status = 'error' AND event_id % 2 = 0 THEN 404 ELSE 200 END AS http, CASE status WHEN 'purchase' THEN 'sold' WHEN 'error' THEN 'removed' ELSE 'live' END AS status,
 CASE WHEN event_id % 3 > 0 THEN price END AS price, CASE WHEN event_id % 5 < 2 THEN price ELSE 0 END AS sold_price, CASE WHEN event_id % 7 > 0 THEN observed_at END AS sold_at, CASE WHEN event_id % 4 = 0 THEN 'seen on page' WHEN event_id % 4 = 1 THEN ' ' END AS evidence, last_price
 FROM history h ASOF LEFT JOIN p ON h.listing_id = p.listing_id AND h.observed_at > p.seen_at),
v AS (SELECT *, CASE WHEN http IN (404, 410) OR status = 'removed' THEN 'removed' WHEN status = 'sold' AND sold_at IS NOT NULL THEN 'sold' ELSE 'live' END AS verdict FROM s)
SELECT listing_id, event_id, verdict, strftime(CASE WHEN verdict = 'sold' THEN sold_at END, '%Y-%m-%d %H:%M:%S') AS sold_date,
 CASE WHEN verdict = 'removed' THEN coalesce(last_price, 0) WHEN verdict = 'sold' AND sold_price > 0 THEN sold_price WHEN price > 0 THEN price ELSE coalesce(last_price, 0) END AS verdict_price,
 CASE WHEN verdict = 'removed' THEN CASE WHEN last_price > 0 THEN 'db_fallback' ELSE 'none' END
  WHEN verdict = 'sold' THEN CASE WHEN sold_price > 0 THEN 'adapter_sold_price' WHEN price > 0 OR last_price IS NULL THEN 'adapter_price_as_sold_price' ELSE 'db_fallback' END
  WHEN price > 0 THEN 'adapter' WHEN last_price > 0 THEN 'db_fallback' ELSE 'none' END AS price_source,
 CASE WHEN trim(evidence) <> '' THEN evidence WHEN verdict = 'removed' THEN 'http_' || http ELSE 'adapter_' || verdict END AS reason FROM v""")
def snapshot_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each snapshot says of its listing, with the last price known before it."""
    log, n = history(spark, sf_dir), F.col("event_id")
    priced = log.where("price > 0").select("listing_id", F.col("observed_at").alias("seen_at"), F.col("event_id").alias("seen_id"), F.col("price").alias("last_price"))
    known = asof_join(log, priced, ["listing_id"], "observed_at", "seen_at", tie=["seen_id"], strict=True)
    rows = known.select(
        "listing_id",
        "event_id",
        F.when(n % 17 == 0, 410).when((F.col("status") == "error") & (n % 2 == 0), 404).otherwise(200).alias("http"),
        F.when(F.col("status") == "purchase", "sold").when(F.col("status") == "error", "removed").otherwise("live").alias("status"),
        F.when(n % 3 > 0, F.col("price")).alias("price"),
        F.when(n % 5 < 2, F.col("price")).otherwise(0.0).alias("sold_price"),
        F.when(n % 7 > 0, F.col("observed_at")).alias("sold_at"),
        F.when(n % 4 == 0, "seen on page").when(n % 4 == 1, " ").alias("evidence"),
        "last_price",
    )
    return verdicts.decide(rows).select("listing_id", "event_id", "verdict", F.date_format("sold_date", "yyyy-MM-dd HH:mm:ss").alias("sold_date"), "verdict_price", "price_source", "reason")


@query("""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'live' WHEN 1 THEN 'sold' WHEN 2 THEN 'removed' ELSE 'stale' END AS main_status, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 3 = 1 END AS main_inactive,
 CASE WHEN o_orderstatus = 'F' THEN 'sold' WHEN o_totalprice > 250000 THEN 'removed' WHEN o_totalprice > 200000 THEN 'blocked' WHEN o_orderpriority = '5-LOW' THEN 'inactive' ELSE 'live' END AS detected, o_custkey % 5 > 0 AS flag_seen, CASE WHEN o_custkey % 7 > 0 THEN o_orderpriority = '5-LOW' END AS detected_inactive FROM orders),
e AS (SELECT *, CASE detected WHEN 'inactive' THEN 'live' WHEN 'blocked' THEN NULL ELSE detected END AS expected FROM s),
f AS (SELECT *, coalesce(expected <> main_status, false) AS wrong, coalesce(expected = 'live' AND flag_seen AND detected_inactive IS NOT NULL AND detected_inactive IS DISTINCT FROM main_inactive, false) AS other FROM e)
SELECT o_orderkey, expected, wrong AS mismatch_status, other AND main_inactive IS NOT NULL AS mismatch_inactive, CASE WHEN wrong THEN expected END AS suggested_status, CASE WHEN other THEN detected_inactive END AS suggested_inactive,
 nullif(concat_ws('; ', CASE WHEN wrong THEN 'status_mismatch main=' || main_status || ' detected=' || detected END, CASE WHEN other THEN 'inactive_flag_mismatch' END, CASE WHEN expected = 'live' AND main_status <> 'live' THEN main_status || '_row_appears_live' END), '') AS reasons FROM f""")
def status_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected statuses and flags against the table of record, with suggestions and reasons."""
    key, customer, price, low = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice"), F.col("o_orderpriority") == "5-LOW"
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(key % 4 == 0, "live").when(key % 4 == 1, "sold").when(key % 4 == 2, "removed").otherwise("stale").alias("main_status"),
        F.when(customer % 3 > 0, customer % 3 == 1).alias("main_inactive"),
        F.when(F.col("o_orderstatus") == "F", "sold").when(price > 250000, "removed").when(price > 200000, "blocked").when(low, "inactive").otherwise("live").alias("detected"),
        (customer % 5 > 0).alias("flag_seen"),
        F.when(customer % 7 > 0, low).alias("detected_inactive"),
    )
    return verdicts.compare(rows, REVIEW).select("o_orderkey", "expected", "mismatch_status", "mismatch_inactive", "suggested_status", "suggested_inactive", "reasons")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 45 THEN 1.0 WHEN l_quantity <= 5 THEN 0.2 ELSE 0.5 END AS condition FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE condition WHEN 1.0 THEN 0 WHEN 0.2 THEN 1 ELSE NULL END AS damaged, CASE condition WHEN 1.0 THEN 0 WHEN 0.2 THEN 3 ELSE l_linenumber END AS severity,
 CASE condition WHEN 1.0 THEN 'brand new (cs1.0)' WHEN 0.2 THEN 'pre-determined sev3 (cs0.2)' ELSE 'model' END AS reason, CASE WHEN condition <> 0.5 THEN 'rule-1' ELSE 'model-7' END AS version, CASE WHEN condition = 0.5 THEN '{}' END AS raw FROM r""")
def condition_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that two condition values fix; what a model said of such rows is cleared."""
    quantity = F.col("l_quantity")
    condition = F.when(quantity >= 45, 1.0).when(quantity <= 5, 0.2).otherwise(0.5)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", condition.alias("condition"), F.lit(None).cast("int").alias("damaged"), F.col("l_linenumber").cast("int").alias("severity"), F.lit("model").alias("reason"), F.lit("model-7").alias("version"), F.lit("{}").alias("raw"))
    rules = {1.0: {"damaged": 0, "severity": 0, "reason": "brand new (cs1.0)"}, 0.2: {"damaged": 1, "severity": 3, "reason": "pre-determined sev3 (cs0.2)"}}
    return verdicts.stamp(rows, "condition", rules, "rule-1", "version", cleared=("raw",)).drop("condition")


@query("""WITH p AS (SELECT p_partkey, p_brand AS model, CASE WHEN p_partkey % 3 = 0 THEN 'bundle' END AS spam, p_name AS title, p_type AS description, p_size FROM part),
m AS (SELECT l_partkey AS p_partkey, max((l_shipdate, l_returnflag)) AS m FROM lineitem JOIN p ON l_partkey = p_partkey WHERE p_size <= 5 GROUP BY 1),
e AS (SELECT p_partkey, model, json_object('type', 'spam_below', 'at', strftime(m[1], '%Y-%m-%dT%H:%M:%S'), 'source', m[2], 'reason', 'size', 'p_partkey', p_partkey, 'title', coalesce(title, ''), 'description', coalesce(description, ''), 'old_spam', spam, 'new_spam', 'below', 'old_model', model) AS evidence FROM p JOIN m USING (p_partkey))
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'earlier' WHEN evidence IS NOT NULL THEN model END AS fix_old, CASE WHEN evidence IS NOT NULL THEN model END AS fix_new, CASE WHEN evidence IS NOT NULL THEN 'spam_below' END AS fix_reason, CAST(evidence AS VARCHAR) AS fix_evidence FROM lineitem LEFT JOIN e ON l_partkey = p_partkey""")
def scope_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings out of scope are marked; every feature row of them gets the evidence."""
    parts, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    listings = parts.select("p_partkey", F.col("p_brand").alias("model"), F.when(F.col("p_partkey") % 3 == 0, "bundle").alias("spam"), F.col("p_name").alias("title"), F.col("p_type").alias("description"))
    marks = lines.select(F.col("l_partkey").alias("p_partkey"), F.col("l_shipdate").alias("at"), F.col("l_returnflag").alias("source"), F.lit("size").alias("reason")).join(parts.where("p_size <= 5").select("p_partkey"), "p_partkey", "left_semi")
    _, evidence = verdicts.mark(listings, marks, ["p_partkey"], "below")
    nothing = F.lit(None).cast("string")
    features = lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), F.when(F.col("l_linenumber") == 1, "earlier").alias("fix_old"), nothing.alias("fix_new"), nothing.alias("fix_reason"), nothing.alias("fix_evidence"), F.lit(None).cast(lines.schema["l_shipdate"].dataType).alias("fix_at"))
    return verdicts.attach_fix(features, evidence, ["p_partkey"], "spam_below").drop("p_partkey", "fix_at")


def _phrase_sql(phrases: list[str]) -> str:
    return r"(?i)(^|[^\p{L}\p{N}_])(" + "|".join(r"\s+".join(p.split()) for p in phrases) + r")([^\p{L}\p{N}_]|$)"


NOTICE_PHRASES = ["all rights reserved", "licensed under", "the of", "and the"]


@query(rf"""WITH d AS (SELECT doc_id, text, source, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS plain, trim(regexp_replace(lower(lang), '[^a-z0-9]+', ' ', 'g')) AS model FROM documents)
SELECT doc_id, regexp_matches(text, '{_phrase_sql(C.BUYER_PHRASES)}') AS buyer, regexp_matches(text, '{_phrase_sql(C.BUNDLE_PHRASES)}') AS bundle, regexp_matches(text, '{_phrase_sql(NOTICE_PHRASES)}') AS notice,
 coalesce(model <> '' AND contains(coalesce(plain, ''), model), false) AND NOT regexp_matches(' ' || coalesce(text, ''), '{_phrase_sql(NOTICE_PHRASES)}') AS consistent FROM d""")
def listing_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of phrases in whole texts, and whether a text names its model and asks for nothing."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", C.has_phrase(text, C.BUYER_PHRASES).alias("buyer"), C.has_phrase(text, C.BUNDLE_PHRASES).alias("bundle"), C.has_phrase(text, NOTICE_PHRASES).alias("notice"), verdicts.consistent(F.lit(""), text, F.col("lang"), NOTICE_PHRASES).alias("consistent"))


@query("""WITH r AS (SELECT p_brand, lower(p_type || ' ' || p_name) AS t, nullif(p_size % 11, 10) AS level FROM part)
SELECT p_brand, bool_or((contains(t, 'large') OR contains(t, 'promo')) AND (contains(t, 'rod') OR contains(t, 'bolt')) AND level >= 9) FILTER (WHERE level IS NOT NULL) AS long_part,
 bool_or(contains(t, 'blue') AND contains(t, 'widget') AND level >= 9) FILTER (WHERE level IS NOT NULL) AS blue_widget,
 bool_or((contains(t, 'lcd') OR contains(t, 'oled') OR contains(t, 'stripe') OR contains(t, 'vertical line') OR contains(t, 'horizontal line') OR contains(t, 'screen line')) AND level >= 9) FILTER (WHERE level IS NOT NULL) AS display_fault FROM r GROUP BY 1""")
def damage_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of words in the rows of a key that are bad enough."""
    rows = table(spark, sf_dir, "part").select("p_brand", F.concat_ws(" ", "p_type", "p_name").alias("text"), F.nullif(F.col("p_size") % 11, F.lit(10)).alias("level"))
    families = {"long_part": [["large", "promo"], ["rod", "bolt"]], "blue_widget": [["blue"], ["widget"]], "display_fault": C.DAMAGE_WORDS["display_fault"]}
    return verdicts.keyword_flags(rows, ["p_brand"], "text", "level", families, 9)
