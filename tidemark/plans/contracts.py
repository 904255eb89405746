"""Certification, contracts and registries bound to the tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import allowed_columns, feature_block
from tidemark.operators import certify
from tidemark.operators.graph import closure
from tidemark.registry import query

from .roles import LISTINGS, listings, table

def _tree(name: str, where: str) -> str:
    leaf = f"{name}0 AS (SELECT CAST(o_orderdate AS DATE) AS d, o_orderkey // 1000 AS p, sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)) AS hash FROM orders WHERE {where} GROUP BY 1, 2)"
    return f"{leaf}, {name}1 AS (SELECT d, p // 1000 AS p, sha256(string_agg(hash, '' ORDER BY p)) AS hash FROM {name}0 GROUP BY 1, 2), {name} AS (SELECT d, sha256(string_agg(hash, '' ORDER BY p)) AS hash FROM {name}1 GROUP BY 1)"


DAYS = f"{_tree('b', chr(39).join(['o_orderstatus <> ', 'P', '']))}, {_tree('c', 'true')}"


def _leaves(orders: DataFrame) -> DataFrame:
    return certify.leaf_hashes(orders.withColumn("d", F.to_date("o_orderdate")), ["d"], "o_orderkey")


def _day_keys(orders: DataFrame) -> DataFrame:
    return certify.root_hashes(_leaves(orders), ["d"])


@query(f"""WITH {DAYS} SELECT strftime(coalesce(b0.d, c0.d), '%Y-%m-%d') AS day, coalesce(b0.p, c0.p) AS part, b0.hash AS was, c0.hash AS now FROM b0 FULL JOIN c0 ON b0.d = c0.d AND b0.p = c0.p WHERE b0.hash IS DISTINCT FROM c0.hash""")
def drift_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranges of keys in which days drifted from a baseline without the pending orders."""
    orders = table(spark, sf_dir, "orders")
    out = certify.drifted_ranges(_leaves(orders.where("o_orderstatus <> 'P'")), _leaves(orders), ["d"])
    return out.select(F.date_format("d", "yyyy-MM-dd").alias("day"), "part", "was", "now")


@query(f"""WITH {DAYS}, n AS (SELECT d, hash FROM c ORDER BY d DESC LIMIT 60) SELECT strftime(coalesce(b.d, n.d), '%Y-%m-%d') AS day, coalesce(n.hash, b.hash) AS hash, n.hash IS NOT NULL AS rebaselined FROM b FULL JOIN n ON b.d = n.d""")
def rebaseline_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    out = certify.rebaseline(_day_keys(orders.where("o_orderstatus <> 'P'")), _day_keys(orders), "d", "hash", 60)
    return out.select(F.date_format("d", "yyyy-MM-dd").alias("day"), "hash", "rebaselined")


@query(f"""WITH {DAYS}, n AS (SELECT d, hash FROM c ORDER BY d DESC LIMIT 90) SELECT strftime(n.d, '%Y-%m-%d') AS day, b.hash IS DISTINCT FROM n.hash AS drifted, n.hash AS hash FROM n LEFT JOIN b ON b.d = n.d""")
def drift_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest days after a check that takes the current hash of those that drifted."""
    orders = table(spark, sf_dir, "orders")
    out = certify.apply_drift_policy(_day_keys(orders.where("o_orderstatus <> 'P'")), _day_keys(orders), "d", "hash", "rebaseline", 90)
    return out.select(F.date_format("d", "yyyy-MM-dd").alias("day"), "drifted", "hash")


@query(r"""WITH d AS (SELECT conv_id, sha256(trim(regexp_replace(lower(arg_min(text, turn)), '\s+', ' ', 'g'))) AS a, sha256(trim(regexp_replace(lower(arg_max(text, turn)), '\s+', ' ', 'g'))) AS b, max(role = 'system') AS sys FROM conversations WHERE text IS NOT NULL GROUP BY 1)
SELECT conv_id, CASE WHEN sys THEN 'only_b' ELSE 'differs' END AS state FROM d WHERE sys OR a <> b""")
def definition_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions (here the first and the last text of a conversation) that came or changed; a null definition has no hash."""
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    ends = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"), F.max_by("text", "turn").alias("last"), F.max(F.col("role") == "system").alias("fresh"))
    before = certify.definition_hashes(ends.where(~F.col("fresh")), "conv_id", "first")
    return certify.definition_drift(before, certify.definition_hashes(ends, "conv_id", "last"), "conv_id")


@query(r"""WITH t AS (SELECT unnest(['license', 'apache', 'password', 'now', 'version']) AS token) SELECT doc_id, string_agg(token, ',' ORDER BY list_position(['license', 'apache', 'password', 'now', 'version'], token)) AS tokens FROM documents, t
WHERE regexp_matches(lower(text), '(^|[^a-z0-9_])' || token || '([^a-z0-9_]|$)') GROUP BY 1""")
def time_token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions (here documents) with forbidden tokens, and which."""
    return certify.tokens_found(table(spark, sf_dir, "documents"), "doc_id", "text", ["license", "apache", "password", "now", "version"])


@query(f"""WITH {LISTINGS} SELECT * FROM (VALUES ('base', false, ''), ('renamed', false, ''), ('filtered', true, ''), ('dated', true, 'CurrentDate')) v(surface, drifted, tokens), LATERAL (SELECT count(*) FILTER (WHERE surface <> 'filtered' OR price > 100000) AS n FROM listings)""")
def plan_certification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces over the listings: whether each computes what the certified one does, what in its plan moves with time (found
    two views deep), and its rows."""
    rows = listings(spark, sf_dir).select("listing_id", "price", "t0")
    rows.createOrReplaceTempView("_plan_base")
    spark.sql("create or replace temporary view _plan_inner as select listing_id, price, t0, current_date() as seen from _plan_base")
    spark.sql("create or replace temporary view _plan_outer as select listing_id, price, t0 from _plan_inner where seen > date'2000-01-01'")

    def through(*names: str) -> DataFrame:
        """The base with other names on the way."""
        return listings(spark, sf_dir).select(*[F.col(c).alias(n) for c, n in zip(rows.columns, names, strict=True)]).select(*[F.col(n).alias(c) for c, n in zip(rows.columns, names, strict=True)])

    base, renamed = through("x", "y", "z"), through("a", "b", "c")
    surfaces = {"base": base, "renamed": renamed, "filtered": rows.where("price > 100000"), "dated": spark.table("_plan_outer")}
    certified = certify.plan_hash(base)
    out = [df.agg(F.lit(name).alias("surface"), F.lit(certify.plan_hash(df) != certified).alias("drifted"), F.lit(",".join(certify.plan_tokens(df))).alias("tokens"), F.count("*").alias("n")) for name, df in surfaces.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


EDGES = """e AS (SELECT DISTINCT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem),
walk AS (SELECT l_partkey AS node FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.1 AND l_tax >= 0.08 UNION SELECT b FROM walk JOIN e ON a = node WHERE b > a)"""


def part_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges from a part to the next part of its order, where that has a greater key; and the parts to start from."""
    lines = table(spark, sf_dir, "lineitem")
    following = F.expr("lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)")
    edges = lines.select(F.col("l_partkey").alias("a"), following.alias("b")).where("b > a").distinct()
    return edges, lines.where("l_quantity >= 50 and l_discount >= 0.1 and l_tax >= 0.08").select(F.col("l_partkey").alias("node"))


@query(f"WITH RECURSIVE {EDGES} SELECT node FROM walk")
def recursive_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure(*part_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {EDGES} SELECT node, p_size FROM walk JOIN part ON p_partkey = node WHERE p_size <= 3 OR p_brand LIKE '%5'")
def forbidden_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a surface depends on, directly or through others, although it must not."""
    banned = table(spark, sf_dir, "part").where("p_size <= 3 or p_brand like '%5'").select(F.col("p_partkey").alias("node"), "p_size")
    return closure(*part_edges(spark, sf_dir)).join(banned, "node")


CONTRACT = [("o_orderkey", "bigint", False), ("o_custkey", "bigint", False), ("o_orderdate", "timestamp_ntz", False), ("o_totalprice", "float", False), ("o_comment", "string", True), ("o_orderpriority", "string", False)]


@query("""SELECT * FROM (VALUES (0, 'o_orderkey', 'bigint', 'bigint', true), (1, 'o_custkey', 'bigint', 'bigint', true), (2, 'o_orderdate', 'timestamp_ntz', 'timestamp_ntz', true), (3, 'o_totalprice', 'float', 'double', false), (4, 'o_comment', 'string', NULL, false), (5, 'o_orderpriority', 'string', 'string', true)) v(place, name, expected, found, ok)
JOIN (SELECT unnest([0, 1, 2, 3, 4, 5]) AS place, unnest([count(*) - count(o_orderkey), count(*) - count(o_custkey), count(*) - count(o_orderdate), count(*) - count(o_totalprice), NULL, count(*) - count(o_orderpriority)]) AS nulls FROM orders) n USING (place)""")
def schema_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return certify.check_schema(table(spark, sf_dir, "orders"), CONTRACT)


REGISTRY = """reg AS (SELECT user_id, CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'FAILED' ELSE 'CERTIFIED' END AS status, max(ts) FILTER (WHERE event_type = 'purchase') AS certified_at FROM events WHERE event_type <> 'view' GROUP BY 1),
need AS (SELECT DISTINCT user_id FROM events), chg AS (SELECT DISTINCT user_id FROM events WHERE value > 200)"""


def registry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A registry, the surfaces needed and those that changed, from the event log."""
    log = table(spark, sf_dir, "events")
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    reg = log.where("event_type <> 'view'").groupBy("user_id").agg(F.when(last == "error", "FAILED").otherwise("CERTIFIED").alias("status"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("certified_at"))
    return reg, log.select("user_id"), log.where("value > 200").select("user_id")


@query(f"""WITH {REGISTRY} SELECT user_id, CASE WHEN status IS NULL THEN 'missing' WHEN status <> 'CERTIFIED' THEN 'not_certified' WHEN coalesce(certified_at < TIMESTAMP '2024-01-29', true) THEN 'expired' WHEN user_id IN (SELECT user_id FROM chg) THEN 'drifted' ELSE 'certified' END AS state FROM need LEFT JOIN reg USING (user_id)""")
def registry_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that decides whether each surface may be read."""
    reg, needed, changed = registry(spark, sf_dir)
    return certify.registry_state(reg, needed, "user_id", datetime(2024, 1, 30), timedelta(hours=24), changed)


@query(f"""WITH {REGISTRY} SELECT CASE WHEN status IS NULL THEN 'missing' WHEN status <> 'CERTIFIED' THEN 'not_certified' WHEN coalesce(certified_at < TIMESTAMP '2024-01-27', true) THEN 'expired' ELSE 'certified' END AS state, count(*) AS n FROM need LEFT JOIN reg USING (user_id) GROUP BY 1""")
def preflight_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the surfaces that a model reads are in which state, with a longer age allowed."""
    reg, needed, _ = registry(spark, sf_dir)
    return certify.registry_state(reg, needed, "user_id", datetime(2024, 1, 30), timedelta(hours=72)).groupBy("state").agg(F.count("*").alias("n"))


@query(f"""WITH {LISTINGS}, s AS (SELECT segment, count(*) AS n, min(price) AS least FROM listings GROUP BY 1) SELECT 'base' AS surface, 'rows' AS name, count(*) AS n FROM listings UNION ALL SELECT 'base', 'no_price', count(*) FILTER (WHERE price IS NULL OR price <= 0) FROM listings
UNION ALL SELECT 'segments', 'rows', count(*) FROM s UNION ALL SELECT 'segments', 'cheap', count(*) FILTER (WHERE least < 2000) FROM s""")
def refresh_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two surfaces rebuilt in order, the second from the first as written, and their checks."""
    steps = {"base": lambda _: listings(spark, sf_dir).select("listing_id", "segment", "price"), "segments": lambda done: done["base"].groupBy("segment").agg(F.count("*").alias("n"), F.min("price").alias("least"))}
    rules = {"base": {"no_price": F.col("price").isNull() | (F.col("price") <= 0)}, "segments": {"cheap": F.col("least") < 2000}}
    return certify.refresh_chain(spark, steps, rules)[1]


@query("""SELECT count(*) FILTER (WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)) AS final_rows, (SELECT count(DISTINCT l_returnflag || l_linestatus) FROM lineitem) AS groups,
count(*) FILTER (WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)) = 1 AND (SELECT count(DISTINCT l_returnflag || l_linestatus) FROM lineitem) >= 7 AS ready FROM orders""")
def artifact_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    top = orders.agg(F.max("o_totalprice").alias("top"))
    bands = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("band"))
    return certify.artifact_ready(orders.join(F.broadcast(top)), bands, F.col("o_totalprice") == F.col("top"), "band", 7)


@query("""SELECT l_orderkey AS listing, l_partkey AS image, CAST(l_quantity AS BIGINT) AS amount, l_extendedprice * (1 - l_discount) AS net, upper(l_returnflag) AS flag FROM lineitem""")
def contract_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("listing", "l_orderkey"), ("image", "l_partkey"), ("amount", "cast(l_quantity as bigint)"), ("net", "l_extendedprice * (1 - l_discount)"), ("flag", "upper(l_returnflag)")]
    return certify.contract_select(table(spark, sf_dir, "lineitem"), rows)


@query("""SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_discount', 'l_tax']) AS name, unnest([count(l_orderkey), count(l_partkey), count(l_suppkey), count(l_linenumber), count(l_discount), count(l_tax)]) AS n FROM lineitem""")
def leakage_column_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a table that may be features, and how many values each has."""
    lines = table(spark, sf_dir, "lineitem")
    names = allowed_columns(lines.columns, ["date", "price", "flag", "status", "quantity"])
    one = lines.agg(*[F.count(n).alias(n) for n in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in names])).alias("x")).select("x.*")


#: Rules for the block of a feature name.
BLOCKS = [("is", "brand#4 large", "special"), ("ends", "economy", "economy"), ("ends", "promo", "promo"), ("starts", "brand#1", "ones"), ("has", "standard", "plain"), ("has", "medium", "plain")]
NAME_SQL = "lower(p_brand || ' ' || p_type)"
BLOCK_SQL = f"CASE WHEN {NAME_SQL} = 'brand#4 large' THEN 'special' WHEN {NAME_SQL} LIKE '%economy' THEN 'economy' WHEN {NAME_SQL} LIKE '%promo' THEN 'promo' WHEN {NAME_SQL} LIKE 'brand#1%' THEN 'ones' WHEN {NAME_SQL} LIKE '%standard%' THEN 'plain' WHEN {NAME_SQL} LIKE '%medium%' THEN 'plain' ELSE 'other' END"


def block(names: tuple[str, ...] = ("p_brand", "p_type")):
    return feature_block(F.lower(F.concat_ws(" ", *names)), BLOCKS, "other").alias("block")


@query(f"SELECT p_partkey, {BLOCK_SQL} AS block FROM part")
def feature_block_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", block())


@query(f"WITH b AS (SELECT {BLOCK_SQL} AS block, p_retailprice AS v FROM part) SELECT block, count(*) AS n, round(sum(v) / (SELECT sum(v) FROM b), 7) AS share FROM b GROUP BY 1")
def importance_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of all importance that each block of features has."""
    per = table(spark, sf_dir, "part").groupBy(block()).agg(F.count("*").alias("n"), F.sum("p_retailprice").alias("v"))
    return per.join(F.broadcast(per.agg(F.sum("v").alias("total")))).select("block", "n", F.round(F.col("v") / F.col("total"), 7).alias("share"))
