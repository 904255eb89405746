"""Price anchors, censored labels and prior statistics at decision time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import asof, order
from tidemark.registry import query

from .roles import LISTINGS, POOL, listings, sold_pool, table

TARGETS = "targets AS (SELECT DISTINCT cohort, CAST(t0 AS DATE) AS day FROM listings)"


@query(f"""WITH {LISTINGS} SELECT listing_id, sold_at IS NOT NULL AS sold_event, greatest(0, date_diff('day', CAST(t0 AS DATE), CAST(coalesce(sold_at, last_seen) AS DATE))) AS duration FROM listings WHERE last_seen IS NOT NULL""")
def labels_censored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sold or censored, and the days from decision to sale or last sight."""
    days = F.datediff(F.to_date(F.coalesce("sold_at", "last_seen")), F.to_date("t0"))
    return listings(spark, sf_dir).where("last_seen is not null").select("listing_id", F.col("sold_at").isNotNull().alias("sold_event"), F.greatest(F.lit(0), days).cast("bigint").alias("duration"))


@query("""SELECT o_custkey, o_orderkey, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE r = 1""")
def t0_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest row of each key."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.count("*").alias("n"))


@query(f"""WITH {POOL} SELECT cohort, strftime(day, '%Y-%m-%d') AS day, median(price) AS median_price, count(*) AS n FROM pool GROUP BY 1, 2""")
def cohort_median_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sold_pool(spark, sf_dir).groupBy("cohort", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.percentile("price", 0.5).alias("median_price"), F.count("*").alias("n"))


@query(f"""WITH {LISTINGS}, {POOL}, {TARGETS} SELECT t.cohort, strftime(t.day, '%Y-%m-%d') AS day, median(price) FILTER (WHERE p.day >= t.day - 14) AS median_14, count(price) FILTER (WHERE p.day >= t.day - 14) AS n_14,
 median(price) AS median_30, count(price) AS n_30 FROM targets t LEFT JOIN pool p ON p.cohort = t.cohort AND p.day >= t.day - 30 AND p.day < t.day GROUP BY 1, 2""")
def embargo_median_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = listings(spark, sf_dir).select("cohort", F.to_date("t0").alias("at"))
    out = asof.embargo_median(targets, sold_pool(spark, sf_dir), ["cohort"], "at", "day", "price", {"14": (14, 0), "30": (30, 0)})
    return out.select("cohort", F.date_format("at", "yyyy-MM-dd").alias("day"), "median_14", "n_14", "median_30", "n_30")


@query(f"""WITH {LISTINGS}, {POOL}, {TARGETS}, m AS (SELECT t.cohort, t.day, median(price) FILTER (WHERE p.day >= t.day - 35) AS m30, count(price) FILTER (WHERE p.day >= t.day - 35) AS n30, median(price) AS m60, count(price) AS n60
 FROM targets t LEFT JOIN pool p ON p.cohort = t.cohort AND p.day >= t.day - 65 AND p.day < t.day - 5 GROUP BY 1, 2)
SELECT cohort, strftime(day, '%Y-%m-%d') AS day, n30, n60, round(CASE WHEN n30 >= 10 THEN m30 WHEN n30 + n60 > 0 THEN ((n30 + 4) * coalesce(m30, 0) + (n60 + 2) * coalesce(m60, 0)) / ((n30 + 4) + (n60 + 2)) END, 5) AS anchor FROM m""")
def strict_anchor_blend(spark: SparkSession, sf_dir: str, least: int = 10) -> DataFrame:
    targets = listings(spark, sf_dir).select("cohort", F.to_date("t0").alias("at"))
    out = asof.embargo_median(targets, sold_pool(spark, sf_dir), ["cohort"], "at", "day", "price", {"30": (35, 5), "60": (65, 5)})
    n30, n60 = F.col("n_30"), F.col("n_60")
    blend = ((n30 + 4) * F.coalesce("median_30", F.lit(0.0)) + (n60 + 2) * F.coalesce("median_60", F.lit(0.0))) / ((n30 + 4) + (n60 + 2))
    anchor = F.when(n30 >= least, F.col("median_30")).when(n30 + n60 > 0, blend)
    return out.select("cohort", F.date_format("at", "yyyy-MM-dd").alias("day"), n30.alias("n30"), n60.alias("n60"), F.round(anchor, 5).alias("anchor"))


RELATIVE = f"""WITH {LISTINGS}, {POOL}, {TARGETS}, m AS (SELECT t.cohort, t.day, median(price) AS anchor, count(price) AS n FROM targets t LEFT JOIN pool p ON p.cohort = t.cohort AND p.day >= t.day - 30 AND p.day < t.day GROUP BY 1, 2)"""


def cohort_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cohorts and days of all listings; the orders alone know them."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("cohort"), F.to_date("o_orderdate").alias("at"))


@query(f"""{RELATIVE} SELECT listing_id, round(price / nullif(anchor, 0), 7) AS ptv, round(price - anchor, 3) AS delta, round(CASE WHEN n >= 20 THEN ln(price) - ln(anchor) END, 7) AS rel_log, CASE WHEN anchor IS NULL THEN 1 ELSE 0 END AS missing
FROM listings JOIN m ON m.cohort = listings.cohort AND m.day = CAST(t0 AS DATE)""")
def relative_price(spark: SparkSession, sf_dir: str, support: int = 20) -> DataFrame:
    rows = listings(spark, sf_dir, people=False).select("listing_id", "cohort", "price", F.to_date("t0").alias("at"))
    anchors = asof.embargo_median(cohort_days(spark, sf_dir), sold_pool(spark, sf_dir), ["cohort"], "at", "day", "price", {"30": (30, 0)})
    price, anchor = F.col("price"), F.col("median_30")
    return rows.join(anchors, ["cohort", "at"]).select("listing_id", F.round(price / F.nullif(anchor, F.lit(0.0)), 7).alias("ptv"), F.round(price - anchor, 3).alias("delta"), F.round(F.when(F.col("n_30") >= support, F.ln(price) - F.ln(anchor)), 7).alias("rel_log"), anchor.isNull().cast("int").alias("missing"))


@query(f"""{RELATIVE} SELECT listing_id, round(CASE WHEN n >= 10 THEN price / anchor WHEN n_images >= 5 THEN price / 100000 END, 7) AS ptv FROM listings JOIN m ON m.cohort = listings.cohort AND m.day = CAST(t0 AS DATE)""")
def reliability_gated_ptv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir, people=False).select("listing_id", "cohort", "price", "n_images", F.to_date("t0").alias("at"))
    anchors = asof.embargo_median(cohort_days(spark, sf_dir), sold_pool(spark, sf_dir), ["cohort"], "at", "day", "price", {"30": (30, 0)})
    ptv = F.when(F.col("n_30") >= 10, F.col("price") / F.col("median_30")).when(F.col("n_images") >= 5, F.col("price") / 100000)
    return rows.join(anchors, ["cohort", "at"]).select("listing_id", F.round(ptv, 7).alias("ptv"))


@query(f"""WITH {LISTINGS}, sold AS (SELECT generation, segment, CAST(sold_at AS DATE) AS day, date_diff('day', CAST(t0 AS DATE), CAST(sold_at AS DATE)) AS duration FROM listings WHERE sold_at IS NOT NULL),
a AS (SELECT CAST(range AS DATE) AS td FROM range((SELECT min(CAST(t0 AS DATE)) FROM listings)::TIMESTAMP, (SELECT max(CAST(t0 AS DATE)) + 1 FROM listings)::TIMESTAMP, INTERVAL 1 DAY))
SELECT strftime(td, '%Y-%m-%d') AS "at", generation, segment, count(*) AS n, round(sum(CASE WHEN duration <= 1 THEN w ELSE 0 END) / sum(w), 6) AS rate_24, round(sum(CASE WHEN duration <= 3 THEN w ELSE 0 END) / sum(w), 6) AS rate_72,
 round(sum(CASE WHEN duration <= 7 THEN w ELSE 0 END) / sum(w), 6) AS rate_168, median(duration) AS median_days, round(sum(w) * sum(w) / sum(w * w), 6) AS n_eff, strftime(min(day), '%Y-%m-%d') AS first_sold, strftime(max(day), '%Y-%m-%d') AS last_sold
FROM (SELECT td, day, generation, segment, duration, pow(0.5, date_diff('day', day, td) / 90.0) AS w FROM a JOIN sold ON day >= td - 90 AND day < td) GROUP BY 1, 2, 3""")
def speed_anchor_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every day of the calendar and each generation and segment: recency-weighted shares of quick sales before it, the
    median duration, the effective number of sales, and the first and last sale that counted."""
    rows = listings(spark, sf_dir)
    sold = rows.where("sold_at is not null").select("generation", "segment", F.to_date("sold_at").alias("day"), F.datediff(F.to_date("sold_at"), F.to_date("t0")).alias("duration"))
    span = rows.agg(F.min(F.to_date("t0")).alias("a"), F.max(F.to_date("t0")).alias("b"))
    calendar = span.select(F.explode(F.sequence("a", "b")).alias("at"))
    return asof.speed_series(calendar, sold, ["generation", "segment"], "at", "day", "duration", {"rate_24": 1, "rate_72": 3, "rate_168": 7}, 90, 90.0).select(F.date_format("at", "yyyy-MM-dd").alias("at"), "generation", "segment", "n", *[F.round(c, 6).alias(c) for c in ("rate_24", "rate_72", "rate_168")], "median_days", F.round("n_eff", 6).alias("n_eff"), F.date_format("first_sold", "yyyy-MM-dd").alias("first_sold"), F.date_format("last_sold", "yyyy-MM-dd").alias("last_sold"))


#: The cohorts of the five levels, from the narrowest to the widest.
LEVELS = (("generation", "segment", "region", "cohort"), ("generation", "segment", "cohort"), ("generation", "segment"), ("generation",), ("segment",))
HIER = f"WITH {LISTINGS}, sold AS (SELECT generation, segment, region, cohort, price, CAST(sold_at AS DATE) AS day FROM listings WHERE sold_at IS NOT NULL), base AS (SELECT listing_id, generation, segment, region, cohort, CAST(t0 AS DATE) AS td FROM listings), " + ", ".join(
    f"t{k} AS (SELECT {', '.join('b.' + c for c in key)}, td, median(s.price) AS price, count(s.price) AS n FROM (SELECT DISTINCT {', '.join(key)}, td FROM base) b LEFT JOIN sold s ON {' AND '.join(f's.{c} = b.{c}' for c in key)} AND day >= td - 365 AND day < td - 5 GROUP BY ALL)"
    for k, key in enumerate(LEVELS)
) + ", lv AS (" + " UNION ALL ".join(f"SELECT listing_id, {k} AS k, t.price, coalesce(n, 0) AS n FROM base b LEFT JOIN t{k} t ON {' AND '.join(f't.{c} = b.{c}' for c in key)} AND t.td = b.td" for k, key in enumerate(LEVELS)) + ")"


@query(f"""{HIER} SELECT listing_id, price, n, k AS level FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY CASE WHEN n >= 200 THEN 0 ELSE 1 END, CASE WHEN n >= 200 THEN k ELSE -k END, n DESC) AS r FROM lv) WHERE r = 1""")
def hier_anchor_fallback(spark: SparkSession, sf_dir: str, support: int = 200) -> DataFrame:
    """The median of the narrowest cohort with enough sales in the year before, embargoed by five days; else the widest."""
    rows = listings(spark, sf_dir)
    base = rows.select("listing_id", "generation", "segment", "region", "cohort", F.to_date("t0").alias("at"))
    sold = rows.where("sold_at is not null").select("generation", "segment", "region", "cohort", "price", F.to_date("sold_at").alias("day"))
    return asof.hier_median(base, sold, "listing_id", LEVELS, "at", "day", "price", 365, 5, support)


@query(f"""WITH {LISTINGS}, d AS (SELECT DISTINCT CAST(t0 AS DATE) AS day FROM listings), k AS (SELECT DISTINCT segment, cohort FROM listings),
c AS (SELECT d.day, k.segment, k.cohort, count(listing_id) AS n FROM d CROSS JOIN k LEFT JOIN listings l ON l.segment = k.segment AND l.cohort = k.cohort AND CAST(l.t0 AS DATE) = d.day GROUP BY 1, 2, 3),
p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY segment, cohort ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
s AS (SELECT *, (before + 0.5) / (sum(before) OVER (PARTITION BY segment, day) + 0.5 * count(*) OVER (PARTITION BY segment, day)) AS share, (sum(before) OVER (PARTITION BY cohort, day) + 0.5) / (sum(before) OVER (PARTITION BY day) + 0.5 * 5) AS global_share FROM p)
SELECT segment, cohort, strftime(day, '%Y-%m-%d') AS day, CAST(before AS BIGINT) AS n_before, round(share, 7) AS share, round(global_share, 7) AS global_share, round(-ln(greatest(share, 1e-12)), 7) AS rarity, dense_rank() OVER (PARTITION BY segment, day ORDER BY before DESC) AS place,
 round(-sum(share * ln(share)) OVER (PARTITION BY segment, day), 6) AS entropy, round(exp(-sum(share * ln(share)) OVER (PARTITION BY segment, day)), 5) AS diversity FROM s""")
def prior_cumulative_stats(spark: SparkSession, sf_dir: str, alpha: float = 0.5, kinds: int = 5) -> DataFrame:
    """For every day and every cohort of a segment what the days before show: counts, smoothed shares in the segment and in
    all, rarity, rank, and the entropy and diversity of the segment."""
    rows = listings(spark, sf_dir).select("segment", "cohort", F.to_date("t0").alias("d"))
    # asked for: every cohort of a segment on every day of the calendar
    asked = rows.select("segment", "cohort").distinct().join(F.broadcast(rows.agg(F.collect_set("d").alias("days")))).select("segment", "cohort", F.explode("days").alias("at"))
    found = asof.prior_stats(rows, asked, "segment", "cohort", "d", "at", alpha, kinds)
    return found.select("segment", "cohort", F.date_format("at", "yyyy-MM-dd").alias("day"), "n_before", *[F.round(c, 7).alias(c) for c in ("share", "global_share", "rarity")], "place", F.round("entropy", 6).alias("entropy"), F.round("diversity", 5).alias("diversity"))


@query(f"""WITH {LISTINGS}, m AS (SELECT segment, median(price) AS anchor FROM listings WHERE t0 < TIMESTAMP '1996-01-01' GROUP BY 1) SELECT listing_id, round(price / anchor, 7) AS ratio, round(price - anchor, 3) AS delta FROM listings LEFT JOIN m USING (segment)""")
def ask_anchor_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).select("listing_id", "segment", "price", "t0")
    anchors = rows.where(F.col("t0") < F.lit("1996-01-01").cast("timestamp_ntz")).select("segment", "price")
    anchors = order.quantiles(anchors, ["segment"], {"anchor": ("price", 0.5)})
    return rows.join(anchors, "segment", "left").select("listing_id", F.round(F.col("price") / F.col("anchor"), 7).alias("ratio"), F.round(F.col("price") - F.col("anchor"), 3).alias("delta"))
