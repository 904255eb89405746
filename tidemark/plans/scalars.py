"""Projections, bands and text rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.asof import map_alias
from tidemark.registry import query

from .roles import HISTORY, LISTINGS, history, listings, table


@query("""SELECT p_partkey, CASE WHEN p_retailprice >= 1500 THEN 1024 WHEN p_retailprice >= 1200 THEN 512 WHEN p_retailprice >= 1000 THEN 256 ELSE p_retailprice END AS bucket FROM part""")
def bucket_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", C.bucketize(F.col("p_retailprice"), [(1500, 1024.0), (1200, 512.0), (1000, 256.0)]).alias("bucket"))


@query("""WITH p AS (SELECT p_partkey, p_retailprice / 1200 AS r FROM part)
SELECT p_partkey, CASE WHEN r < 0.5 OR r > 2.5 OR r < 0.7 THEN NULL WHEN r >= 1.3 THEN 3 WHEN r >= 1.0 THEN 2 WHEN r >= 0.85 THEN 1 ELSE 0 END AS bin FROM p""")
def ptv_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.col("p_retailprice") / 1200
    return table(spark, sf_dir, "part").select("p_partkey", C.half_open_bins(ratio, [0.7, 0.85, 1.0, 1.3], 0.5, 2.5).alias("bin"))


@query("""SELECT p_partkey, CASE WHEN p_type IS NULL OR trim(p_type) = '' THEN 'unknown' WHEN contains(lower(p_type), 'pro max') THEN 'pro_max'
 WHEN contains(lower(p_type), 'promo') THEN 'promo' WHEN contains(lower(p_type), 'standard') THEN 'base' WHEN contains(lower(p_type), 'small') THEN 'mini' ELSE 'other' END AS tier FROM part""")
def text_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("pro max", "pro_max"), ("promo", "promo"), ("standard", "base"), ("small", "mini")]
    return table(spark, sf_dir, "part").select("p_partkey", C.first_match(F.col("p_type"), rules, "other", "unknown").alias("tier"))


@query(r"""SELECT p_partkey, nullif(trim(regexp_replace(lower(p_name), '\s+', ' ', 'g')), '') AS text, nullif(regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g'), '') AS alnum FROM part""")
def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", C.norm_text(F.col("p_name")).alias("text"), C.norm_alnum(F.col("p_name")).alias("alnum"))


@query("""WITH d AS (SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, regexp_replace(substr(c_name, length(c_name) - 3), '[^0-9]', '', 'g') AS tail FROM customer)
SELECT c_custkey, CASE WHEN length(tail) = 4 THEN tail END AS postal, CASE WHEN length(digits) = 4 THEN digits END AS strict_postal, lpad(digits, 4, '0') AS padded FROM d""")
def norm_postal(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", C.norm_postal(F.substring(name, F.length(name) - 3, F.lit(4))).alias("postal"), C.norm_postal(name).alias("strict_postal"), C.pad_postal(name).alias("padded"))


@query(f"""WITH {LISTINGS} SELECT listing_id, CASE WHEN price >= 0 AND seller > 0 THEN round(greatest(-1.0, least(4.0, ln((price + 1) / seller))), 6) END AS log_ratio,
 CASE WHEN seller > 0 THEN round(12 * price / seller, 4) END AS year_ratio FROM listings""")
def winsor_log_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, income = F.col("price"), F.col("seller")
    return listings(spark, sf_dir).select("listing_id", F.round(C.clamped_log_ratio(price, income, -1.0, 4.0), 6).alias("log_ratio"), F.round(C.guarded_ratio(12 * price, income), 4).alias("year_ratio"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS priority_urgent, CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS priority_high,
 CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS priority_other, CASE WHEN o_orderpriority IS NULL THEN 1 ELSE 0 END AS priority_missing FROM orders""")
def one_hot_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = C.one_hot(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"], "p")
    names = ["priority_urgent", "priority_high", "priority_other", "priority_missing"]
    return table(spark, sf_dir, "orders").select("o_orderkey", *[f.alias(n) for f, n in zip(flags, names, strict=True)])


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned, greatest(0.0, least(1.0, l_discount * 12)) AS share,
 greatest(0.0, least(5.0, l_quantity / 8)) AS level, CASE WHEN l_tax > 0 THEN round(l_discount / l_tax, 6) END AS ratio FROM lineitem""")
def clip_bool_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.coalesce((F.col("l_returnflag") == "R").cast("int"), F.lit(0)).alias("returned"),
        C.clamp(F.col("l_discount") * 12, 0.0, 1.0).alias("share"),
        C.clamp(F.col("l_quantity") / 8, 0.0, 5.0).alias("level"),
        F.round(C.guarded_ratio(F.col("l_discount"), F.col("l_tax")), 6).alias("ratio"),
    )


@query("""SELECT event_id, CASE WHEN regexp_matches(json_extract_string(props, '$.k'), '^[0-9]+$') THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
 json_extract_string(props, '$.k') IS NOT NULL AS has_k, coalesce(json_extract_string(props, '$.flag') = 'true', false) AS flag FROM events""")
def json_evidence_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", C.json_number(props, "$.k").alias("k"), F.get_json_object(props, "$.k").isNotNull().alias("has_k"), F.coalesce(F.get_json_object(props, "$.flag") == "true", F.lit(False)).alias("flag"))


@query("""WITH x AS (SELECT p_partkey, p_size, TRY_CAST(nullif(regexp_extract(p_brand, '([0-9]+)', 1), '') AS INT) AS number FROM part) SELECT p_partkey, number, coalesce(number <> p_size, false) AS differs FROM x""")
def regex_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = C.integer_in(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", number.alias("number"), F.coalesce(number != F.col("p_size"), F.lit(False)).alias("differs"))


@query("""SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INT) AS weekday, isodow(o_orderdate) >= 6 AS weekend FROM orders""")
def calendar_feats(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.weekday("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", day.alias("weekday"), (day >= 5).alias("weekend"))


@query(f"""WITH {LISTINGS}, b AS (SELECT listing_id, CASE WHEN n_images > 3 THEN battery END AS img, nullif(floor(price / 5000), 0) AS txt FROM listings)
SELECT listing_id, round(coalesce(img, txt), 6) AS fused, round(img - txt, 6) AS gap, CASE WHEN abs(img - txt) >= 7 THEN 1 ELSE 0 END AS conflict FROM b""")
def battery_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).select("listing_id", F.when(F.col("n_images") > 3, F.col("battery")).alias("img"), F.nullif(F.floor(F.col("price") / 5000).cast("double"), F.lit(0.0)).alias("txt"))
    gap = F.col("img") - F.col("txt")
    return rows.select("listing_id", F.round(F.coalesce("img", "txt"), 6).alias("fused"), F.round(gap, 6).alias("gap"), F.when(F.abs(gap) >= 7, 1).otherwise(0).alias("conflict"))


@query(f"""WITH {LISTINGS} SELECT listing_id, CASE WHEN price > 200000 AND n_images >= 5 THEN 1 ELSE 0 END AS high_value, CASE WHEN seller < 0 OR battery < 15 THEN 1 ELSE 0 END AS risky,
 CASE WHEN battery IS NULL THEN 1 ELSE 0 END AS battery__missing, CASE WHEN sold_at IS NULL THEN 1 ELSE 0 END AS sold_at__missing FROM listings""")
def rule_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    return rows.select("listing_id", F.when((F.col("price") > 200000) & (F.col("n_images") >= 5), 1).otherwise(0).alias("high_value"), F.when((F.col("seller") < 0) | (F.col("battery") < 15), 1).otherwise(0).alias("risky"), *[F.col(c).isNull().cast("int").alias(f"{c}__missing") for c in ("battery", "sold_at")])


@query("""SELECT s_suppkey, coalesce(CASE WHEN n_regionkey <> 3 THEN lower(r_name) END, 'unknown') AS area FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def enum_alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alias of each row mapped by a table of aliases, with a default where the table has none."""
    aliases = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("n_regionkey <> 3").select(F.col("n_nationkey").alias("alias"), F.lower("r_name").alias("meaning"))
    return map_alias(table(spark, sf_dir, "supplier"), "s_nationkey", aliases, "unknown").select("s_suppkey", F.col("meaning").alias("area"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_quantity BETWEEN 10 AND 40 THEN l_quantity END AS kept, coalesce(CASE WHEN l_quantity BETWEEN 10 AND 40 THEN l_quantity END, CASE WHEN l_linenumber * 12.0 BETWEEN 10 AND 40 THEN l_linenumber * 12.0 END) AS first_valid,
 CASE WHEN l_quantity BETWEEN 10 AND 40 THEN 0 ELSE 1 END AS suspicious FROM lineitem""")
def range_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity, other = C.in_range(F.col("l_quantity"), 10, 40), C.in_range(F.col("l_linenumber") * F.lit(12.0), 10, 40)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", quantity.alias("kept"), F.coalesce(quantity, other).alias("first_valid"), quantity.isNull().cast("int").alias("suspicious"))


@query(r"""SELECT doc_id, regexp_matches(lower(text), '(password|token)\s*=') AS secret, regexp_matches(lower(text), '\b(licensed|license)\b') AS license, regexp_matches(text, '[!]{2}') AS shouting FROM documents""")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.lower(text).rlike(r"(password|token)\s*=").alias("secret"), F.lower(text).rlike(r"\b(licensed|license)\b").alias("license"), text.rlike("[!]{2}").alias("shouting"))


@query(f"""WITH {LISTINGS} SELECT listing_id, round(coalesce(seller, 0) * ln(1 + n_images) * greatest(0, 2025 - year(t0)), 4) AS quality FROM listings""")
def seller_quality(spark: SparkSession, sf_dir: str, reference_year: int = 2025) -> DataFrame:
    score = F.coalesce("seller", F.lit(0.0)) * F.log1p("n_images") * F.greatest(F.lit(0), reference_year - F.year("t0"))
    return listings(spark, sf_dir).select("listing_id", F.round(score, 4).alias("quality"))


@query(f"""WITH {LISTINGS} SELECT listing_id, round(coalesce(greatest(0.2, least(1.0, price / 150000)), 1.0) * coalesce(greatest(0.2, least(1.0, battery / 30)), 1.0), 6) AS penalty,
 CASE WHEN price <= 90000 THEN 1 ELSE 0 END AS under_knot, round(greatest(0.0, 90000 - price), 4) AS below, round(greatest(0.0, 90000 - price) * n_images, 4) AS pairwise FROM listings""")
def soft_gate_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, battery = F.col("price"), F.col("battery")
    under, below = C.hinge(price, 90000.0)
    return listings(spark, sf_dir).select("listing_id", F.round(C.penalty_product([price / 150000, battery / 30], 0.2, 1.0), 6).alias("penalty"), under.alias("under_knot"), F.round(below, 4).alias("below"), F.round(below * F.col("n_images"), 4).alias("pairwise"))


@query(f"""WITH {LISTINGS} SELECT listing_id, CASE WHEN seller >= 5000 AND n_images >= 4 AND year(t0) <= 1995 THEN 'HIGH' WHEN seller >= 0 AND n_images >= 2 THEN 'MED' ELSE 'LOW' END AS trust FROM listings""")
def trust_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    seller, n = F.col("seller"), F.col("n_images")
    return listings(spark, sf_dir).select("listing_id", F.when((seller >= 5000) & (n >= 4) & (F.year("t0") <= 1995), "HIGH").when((seller >= 0) & (n >= 2), "MED").otherwise("LOW").alias("trust"))


@query("""SELECT doc_id, md5(coalesce(text, '')) AS md5, sha256(coalesce(text, '')) AS sha256 FROM documents""")
def hash_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.cast("binary")).alias("md5"), F.sha2(text, 256).alias("sha256"))


@query("""SELECT c_custkey, upper(trim(c_name)) AS upper_name, split_part(c_name, '#', 2) AS tail, length(c_name) AS n, lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS nation, starts_with(c_mktsegment, 'B') AS b FROM customer""")
def scalar_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.upper(F.trim("c_name")).alias("upper_name"), F.split_part(F.col("c_name"), F.lit("#"), F.lit(2)).alias("tail"), F.length("c_name").cast("bigint").alias("n"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("nation"), F.startswith(F.col("c_mktsegment"), F.lit("B")).alias("b"))


@query("""SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, year(o_orderdate) AS y, strftime(CAST(o_orderdate AS DATE) - 5, '%Y-%m-%d') AS embargo, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS age FROM orders""")
def scalar_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(F.trunc(F.to_date(t), "month"), "yyyy-MM-dd").alias("month"), F.year(t).cast("bigint").alias("y"), F.date_format(F.date_sub(F.to_date(t), 5), "yyyy-MM-dd").alias("embargo"), F.datediff(F.to_date(t), F.to_date(F.lit("1992-01-01"))).cast("bigint").alias("age"))


@query("""WITH j AS (SELECT event_id, props, CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 3 = 1 THEN '[]' ELSE '[1,2]' END AS list, user_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, json_merge_patch(CAST(props AS JSON), json_object('k', k + 1))::VARCHAR AS raised, json_merge_patch(CAST(props AS JSON), json_object('user', user_id))::VARCHAR AS added, json_contains(json_keys(props)::JSON, '"k"') AS has_k, list_contains(json_keys(props), 'user') AS has_user,
 CASE WHEN list IS NULL OR list = '[]' THEN '[' || event_id || ']' ELSE '[1,2,' || event_id || ']' END AS list, list_aggregate(list_transform(json_keys(props), lambda x: x || '=' || json_extract_string(props, '$.' || x)), 'string_agg', ';') AS pairs FROM j""")
def scalar_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys set, added and looked for in JSON objects, a list with one more entry, and all pairs of an object."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    held = F.when(F.col("user_id") % 3 == 0, None).when(F.col("user_id") % 3 == 1, "[]").otherwise("[1,2]")
    return table(spark, sf_dir, "events").select(
        "event_id", C.json_set(F.col("props"), "k", k + 1).alias("raised"), C.json_set(F.col("props"), "user", F.col("user_id")).alias("added"), C.json_has(F.col("props"), "k").alias("has_k"), C.json_has(F.col("props"), "user").alias("has_user"),
        C.json_append(held, F.col("event_id")).alias("list"), F.array_join(F.transform(C.json_each(F.col("props")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("pairs"),
    )


@query(f"""WITH {HISTORY}, p AS (SELECT event_id, CASE WHEN price > 100 THEN json_object('state', status, 'current_price', CAST(round(price) AS BIGINT)) WHEN price > 40 THEN json_object('status', status, 'is_inactive', inactive) ELSE json_object('note', status) END AS j FROM history),
f AS (SELECT event_id, coalesce(json_extract_string(j, '$.status'), json_extract_string(j, '$.state')) AS st, coalesce(try_cast(json_extract_string(j, '$.price') AS BIGINT), try_cast(json_extract_string(j, '$.current_price') AS BIGINT)) AS price, json_extract_string(j, '$.is_inactive') AS flag FROM p)
SELECT event_id, CASE WHEN st = 'purchase' THEN 'sold' WHEN st = 'error' OR flag = 'true' THEN 'inactive' WHEN st IS NULL THEN CASE WHEN price > 0 THEN 'live' ELSE 'unknown' END ELSE 'live' END AS canonical, CASE WHEN price > 0 THEN price END AS valid_price, flag IS NOT NULL AS flag_seen, coalesce(flag = 'true', false) AS inactive FROM f""")
def payload_status_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, price and flag of JSON payloads, each under the first key that is there; a flag that is not there is told apart
    from a false one."""
    price, status = F.col("price"), F.col("status")
    payload = F.when(price > 100, F.to_json(F.struct(status.alias("state"), F.round(price).cast("bigint").alias("current_price")))).when(price > 40, F.to_json(F.struct("status", F.col("inactive").alias("is_inactive")))).otherwise(F.to_json(F.struct(status.alias("note"))))
    return C.parse_payload(history(spark, sf_dir).select("event_id", payload.alias("payload")), "payload", sold="purchase", gone="error").drop("payload")


@query("""WITH t AS (SELECT conv_id, string_agg(nullif(trim(text), ''), ' | ' ORDER BY turn) AS captions, min(nullif(trim(text), '')) AS title FROM conversations GROUP BY conv_id)
SELECT conv_id, concat_ws(chr(10) || chr(10), title, captions) AS merged FROM t""")
def merged_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.nullif(F.trim("text"), F.lit(""))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", text.alias("text")))).alias("xs"), F.min(text).alias("title"))
    captions = F.nullif(F.array_join(F.transform("xs", lambda x: x["text"]), " | "), F.lit(""))
    return rows.select("conv_id", F.concat_ws("\n\n", "title", captions).alias("merged"))


@query("""WITH a AS (SELECT p_size, p_type, p_brand FROM part GROUP BY 1, 2, 3 HAVING count(*) >= 2) SELECT p_partkey, a.p_brand AS name, replace(replace(replace(lower(trim(a.p_brand)), '(', ''), ')', ''), ' ', '_') AS key FROM part LEFT JOIN a USING (p_size, p_type, p_brand)""")
def vocab_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name stays where the vocabulary of its generation and variant has it, with its canonical key; else both are null."""
    parts = table(spark, sf_dir, "part")
    allowed = parts.groupBy("p_size", "p_type", "p_brand").count().where("count >= 2").select("p_size", "p_type", "p_brand", F.lit(True).alias("known"))
    name = F.when(F.col("known"), F.col("p_brand"))
    return parts.join(allowed, ["p_size", "p_type", "p_brand"], "left").select("p_partkey", name.alias("name"), C.canonical_key(name).alias("key"))


@query(f"""WITH {LISTINGS} SELECT listing_id, CASE WHEN battery IS NULL THEN 1 ELSE 0 END AS battery__missing, CASE WHEN sold_at IS NULL THEN 1 ELSE 0 END AS sold_at__missing, CASE WHEN region IS NULL THEN 1 ELSE 0 END AS region__missing FROM listings""")
def missing_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("listing_id", *C.missing_flags(["battery", "sold_at", "region"]))


@query(f"""WITH {LISTINGS} SELECT listing_id, round(price * battery, 3) AS price_x_battery, round(price * n_images, 3) AS price_x_n_images, round(battery * n_images, 5) AS battery_x_n_images,
 round(coalesce(greatest(0.0, 0.8 - price / 150000), 0.0) + coalesce(greatest(0.0, 0.95 - price / 150000), 0.0), 7) AS underprice FROM listings""")
def hinge_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of every two features, and how far a price ratio lies below two knots."""
    products = C.interactions(["price", "battery", "n_images"])
    rounded = [F.round(c, d).alias(n) for c, d, n in zip(products, (3, 3, 5), ("price_x_battery", "price_x_n_images", "battery_x_n_images"), strict=True)]
    return listings(spark, sf_dir).select("listing_id", *rounded, F.round(C.underprice_score(F.col("price") / 150000, [0.8, 0.95]), 7).alias("underprice"))
