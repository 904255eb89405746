"""Target encodings, weights of evidence and shrunk priors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import half_life_weight, sigmoid
from tidemark.operators import order, woe
from tidemark.registry import query

from .roles import LISTINGS, listings, table

OUTCOME = f"""{LISTINGS}, o AS (SELECT listing_id, segment, cohort, region, price, n_images, CASE WHEN date_diff('day', CAST(t0 AS DATE), CAST(coalesce(sold_at, last_seen) AS DATE)) > 21 THEN 1 ELSE 0 END AS y, CAST(t0 AS DATE) AS day FROM listings WHERE last_seen IS NOT NULL),
l AS (SELECT listing_id, y, day, 'segment' AS name, coalesce(segment, 'missing') AS value FROM o UNION ALL SELECT listing_id, y, day, 'cohort', coalesce(cohort, 'missing') FROM o),
w AS (SELECT name, value, ln(((sum(y) + 0.5) / max(p)) / ((sum(1 - y) + 0.5) / max(q))) AS woe FROM (SELECT *, sum(y) OVER (PARTITION BY name) AS p, sum(1 - y) OVER (PARTITION BY name) AS q FROM l) GROUP BY 1, 2)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with y = 1 where the sale (or last sight) came after more than three weeks."""
    late = F.datediff(F.to_date(F.coalesce("sold_at", "last_seen")), F.to_date("t0")) > 21
    return listings(spark, sf_dir).where("last_seen is not null").select("listing_id", "segment", "cohort", "region", "price", "n_images", F.when(late, 1).otherwise(0).alias("y"), F.to_date("t0").alias("day"))


#: Weights halve every 90 days; the images of a listing are evidence where there are three or more.
EVIDENCE_OF = f"""{OUTCOME.rsplit(",\nl AS", 1)[0]}, d AS (SELECT o.*, pow(0.5, date_diff('day', day, (SELECT max(day) FROM o)) / 90.0) AS raw, CASE WHEN n_images >= 5 THEN 'many' ELSE 'some' END AS shown FROM o),
l AS (SELECT listing_id, y, day, raw, 'segment' AS name, coalesce(segment, 'missing') AS value FROM d UNION ALL SELECT listing_id, y, day, raw, 'cohort', coalesce(cohort, 'missing') FROM d UNION ALL SELECT listing_id, y, day, raw, 'shown', shown FROM d WHERE n_images >= 3)"""
TABLE_OF = f"""{EVIDENCE_OF}, m AS (SELECT avg(raw) AS m, ln(sum(raw * y) / sum(raw * (1 - y))) AS base FROM d), g AS (SELECT name, value, sum(raw * y) / max(m) AS p, sum(raw * (1 - y)) / max(m) AS q FROM l, m GROUP BY 1, 2),
w AS (SELECT name, value, p, q, ln(((p + 0.5) / sum(p) OVER (PARTITION BY name)) / ((q + 0.5) / sum(q) OVER (PARTITION BY name))) AS woe FROM g)"""
FOLDS_OF = f"""{EVIDENCE_OF}, k AS (SELECT day, CAST(floor((row_number() OVER (ORDER BY day) - 1) * 4 / count(*) OVER ()) AS BIGINT) AS fold FROM (SELECT DISTINCT day FROM d)),
z AS (SELECT fold, count(*) AS n, sum(raw) AS w, sum(raw * y) AS p FROM d JOIN k USING (day) GROUP BY 1), f AS (SELECT fold, (sum(w) OVER () - w) / (sum(n) OVER () - n) AS m, (sum(p) OVER () - p) / (sum(w) OVER () - w) AS share FROM z),
g AS (SELECT fold, name, value, count(*) AS n, sum(raw * y) AS p, sum(raw * (1 - y)) AS q FROM l JOIN k USING (day) GROUP BY 1, 2, 3),
r AS (SELECT fold, name, value, sum(n) OVER v - n AS n, sum(p) OVER v - p AS p, sum(q) OVER v - q AS q, sum(p) OVER a - sum(p) OVER o AS tp, sum(q) OVER a - sum(q) OVER o AS tq FROM g WINDOW v AS (PARTITION BY name, value), a AS (PARTITION BY name), o AS (PARTITION BY fold, name)),
w AS (SELECT fold, name, value, ln(((p / m + 0.5) / (tp / m)) / ((q / m + 0.5) / (tq / m))) AS woe FROM r JOIN f USING (fold) WHERE n > 0)"""
NAMES = ["segment", "cohort", "shown"]


def weighed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes with raw weights, and a band of images that counts for listings with three or more."""
    rows = outcomes(spark, sf_dir)
    aged = rows.join(F.broadcast(rows.agg(F.max("day").alias("last"))))
    return aged.select(*rows.columns, half_life_weight(F.datediff("last", "day"), 90.0).alias("raw"), F.when(F.col("n_images") >= 5, "many").otherwise("some").alias("shown"))


def as_long(rows: DataFrame, kept: list[str]) -> DataFrame:
    return woe.long_form(rows, NAMES, kept, {"shown": F.col("n_images") >= 3})


@query(f"WITH {TABLE_OF} SELECT name, value, round(woe, 7) AS woe, round(p, 5) AS positive, round(q, 5) AS negative FROM w")
def woe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted evidence of each value; that of images among listings with images only."""
    rows = weighed(spark, sf_dir)
    scaled = rows.join(F.broadcast(rows.agg(F.avg("raw").alias("m")))).withColumn("w", F.col("raw") / F.col("m"))
    return woe.evidence(as_long(scaled, ["y", "w"]), "y", "w").select("name", "value", F.round("woe", 7).alias("woe"), F.round("positive", 5).alias("positive"), F.round("negative", 5).alias("negative"))


@query(f"WITH {TABLE_OF} SELECT d.listing_id, round(1 / (1 + exp(-(max(base) + coalesce(sum(woe), 0)))), 7) AS score FROM d JOIN m ON true LEFT JOIN l ON l.listing_id = d.listing_id LEFT JOIN w ON w.name = l.name AND w.value = l.value GROUP BY 1")
def woe_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base logit and the evidence of each row's values as a probability."""
    rows = weighed(spark, sf_dir)
    scaled = rows.join(F.broadcast(rows.agg(F.avg("raw").alias("m")))).withColumn("w", F.col("raw") / F.col("m"))
    long = as_long(scaled, ["listing_id", "y", "w"])
    scored = woe.score(scaled, long, "listing_id", woe.evidence(long, "y", "w"), woe.base_logit(scaled, "y", "w"))
    return scored.select("listing_id", F.round(sigmoid(F.col("logit")), 7).alias("score"))


@query(f"WITH {FOLDS_OF} SELECT fold, name, value, round(woe, 7) AS woe FROM w")
def woe_oof(spark: SparkSession, sf_dir: str, folds: int = 4) -> DataFrame:
    """The evidence that each fold of days is scored with, from the others' counts: totals less the fold's own."""
    rows = weighed(spark, sf_dir)
    rows = rows.join(woe.day_folds(rows, "day", folds), "day")
    return woe.fold_evidence(as_long(rows, ["fold", "y", "raw"]), rows, "y", "raw")[0].withColumn("woe", F.round("woe", 7))


@query(f"WITH {FOLDS_OF} SELECT d.listing_id, k.fold, round(1 / (1 + exp(-(max(ln(share / (1 - share))) + coalesce(sum(woe), 0)))), 7) AS score FROM d JOIN k USING (day) JOIN f USING (fold) LEFT JOIN l ON l.listing_id = d.listing_id LEFT JOIN w ON w.fold = k.fold AND w.name = l.name AND w.value = l.value GROUP BY 1, 2")
def woe_oof_score(spark: SparkSession, sf_dir: str, folds: int = 4) -> DataFrame:
    """Every row scored with base and evidence of the folds that it is not in."""
    rows = weighed(spark, sf_dir)
    rows = rows.join(woe.day_folds(rows, "day", folds), "day")
    long = as_long(rows, ["listing_id", "fold", "y", "raw"])
    table, base = woe.fold_evidence(long, rows, "y", "raw")
    added = long.join(table, ["fold", "name", "value"]).groupBy("listing_id").agg(F.sum("woe").alias("z"))
    scored = rows.select("listing_id", "fold").join(added, "listing_id", "left").join(F.broadcast(base), "fold")
    return scored.select("listing_id", "fold", F.round(sigmoid(F.col("base") + F.coalesce("z", F.lit(0.0))), 7).alias("score"))


#: What the bands are cut from: a name and an expression that both engines read.
BANDED = {"price": "price", "images": "n_images", "battery": "battery", "seller": "seller", "presentation": "10 * coalesce(q, 0) - 5 * coalesce(st, 0)", "accessory": "coalesce(ac, 0) * 1.0", "damage": "coalesce(dm, 0) * 1.0", "confidence": "cf"}
EVIDENCE = f"""{LISTINGS}, ev AS (SELECT l_orderkey AS k, avg(l_linenumber % 5) AS q, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS st, count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS ac, max(nullif(CAST(floor(l_quantity) AS INT) % 11, 10)) AS dm, avg(l_discount) AS cf FROM lineitem GROUP BY 1),
b AS (SELECT listing_id, segment, t0, {', '.join(f'{e} AS {n}' for n, e in BANDED.items())} FROM listings LEFT JOIN ev ON k = listing_id)"""


@query(f"""WITH {EVIDENCE}, c AS (SELECT {', '.join(f"quantile_cont({n}, [1.0/3, 2.0/3]) AS {n}" for n in BANDED)} FROM b WHERE t0 < TIMESTAMP '1997-01-01')
SELECT listing_id, {', '.join(f"CASE WHEN b.{n} IS NULL THEN 'missing' WHEN b.{n} < c.{n}[1] THEN 'low' WHEN b.{n} < c.{n}[2] THEN 'mid' ELSE 'high' END AS {n}" for n in BANDED)}, coalesce(segment, 'missing') AS segment, CASE WHEN b.seller >= 5000 THEN 'HIGH' WHEN b.seller >= 0 THEN 'MED' ELSE 'LOW' END AS trust FROM b, c""")
def woe_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten bands of each listing: terciles learned before a date and then kept, presentation and accessory scores among them."""
    lines = table(spark, sf_dir, "lineitem").withColumn("at", F.struct("_metadata.file_name", "_metadata.row_index"))
    # sums of doubles depend on their order, and cuts lie on such values: the order is that of the rows in the files
    placed = F.array_sort(F.collect_list(F.when(F.col("l_discount").isNotNull(), F.struct("at", F.col("l_discount").alias("v")))))
    mean = F.aggregate(placed, F.lit(0.0), lambda s, x: s + x["v"]) / F.nullif(F.count("l_discount"), F.lit(0))
    damage = F.max(F.nullif(F.floor("l_quantity").cast("int") % 11, F.lit(10)))
    ev = lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.avg(F.col("l_linenumber") % 5).alias("q"), F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("st"), F.count_if(F.col("l_linestatus") == "O").alias("ac"), damage.alias("dm"), mean.alias("cf"))
    rows = listings(spark, sf_dir).join(ev, F.col("k") == F.col("listing_id"), "left")
    rows = rows.select("listing_id", "segment", "t0", *[F.expr(e).cast("double").alias(n) for n, e in BANDED.items()])
    past = rows.where(F.col("t0") < F.lit("1997-01-01").cast("timestamp_ntz"))
    cuts = order.quantiles(past, [], {f"{n}_{k}": (n, k / 3) for n in BANDED for k in (1, 2)})

    def band(n: str):
        own = F.col(n)
        return F.when(own.isNull(), "missing").when(own < F.col(f"{n}_1"), "low").when(own < F.col(f"{n}_2"), "mid").otherwise("high").alias(n)

    trust = F.when(F.col("seller") >= 5000, "HIGH").when(F.col("seller") >= 0, "MED").otherwise("LOW")
    return rows.join(F.broadcast(cuts)).select("listing_id", *[band(n) for n in BANDED], F.coalesce("segment", F.lit("missing")).alias("segment"), trust.alias("trust"))


PRIORS = f"""{OUTCOME}, r AS (SELECT max(day) AS last FROM o), d AS (SELECT coalesce(region, 'missing') AS region, y, pow(0.5, date_diff('day', day, last) / 90.0) AS w FROM o, r WHERE day < DATE '1997-01-01'), b AS (SELECT sum(w * y) / sum(w) AS base FROM d),
p AS (SELECT region, (sum(w * y) + 20 * max(base)) / (sum(w) + 20) AS prior, sum(w) AS n_eff FROM d, b WHERE region <> 'FRANCE' GROUP BY 1)"""


@query(f"""WITH {PRIORS} SELECT listing_id, round(coalesce(prior, base), 7) AS prior, round(coalesce(n_eff, 0), 5) AS n_eff FROM o LEFT JOIN p ON p.region = coalesce(o.region, 'missing'), b""")
def shrunk_priors(spark: SparkSession, sf_dir: str, k: float = 20.0) -> DataFrame:
    """Decay-weighted shares by region shrunk to the share of all, learned before a date and applied to every row; a region
    without a share (one is left out on purpose) gets that of all."""
    rows = outcomes(spark, sf_dir).withColumn("region", F.coalesce("region", F.lit("missing")))
    past = rows.where("day < date'1997-01-01'").join(F.broadcast(rows.agg(F.max("day").alias("last")))).withColumn("w", half_life_weight(F.datediff("last", "day"), 90.0))
    base = past.agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("base"))
    per = past.where("region <> 'FRANCE'").groupBy("region").agg(F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum("w").alias("w"))
    joined = rows.join(per, "region", "left").join(F.broadcast(base))
    prior = F.coalesce((F.col("wy") + k * F.col("base")) / (F.col("w") + k), F.col("base"))
    return joined.select("listing_id", F.round(prior, 7).alias("prior"), F.round(F.coalesce("w", F.lit(0.0)), 5).alias("n_eff"))


@query(f"""WITH {LISTINGS}, c AS (SELECT region, count(*) AS n FROM listings GROUP BY 1) SELECT listing_id, CASE WHEN region IS NULL THEN 'missing' WHEN n >= 60 THEN region ELSE '__rare__' END AS region FROM listings LEFT JOIN c USING (region)""")
def rare_ohe_template(spark: SparkSession, sf_dir: str, least: int = 60) -> DataFrame:
    rows = listings(spark, sf_dir).select("listing_id", "region")
    counts = rows.groupBy("region").agg(F.count("*").alias("n"))
    return rows.join(counts, "region", "left").select("listing_id", F.when(F.col("region").isNull(), "missing").when(F.col("n") >= least, F.col("region")).otherwise("__rare__").alias("region"))


@query("""WITH s AS (SELECT quantile_cont(l_extendedprice, 0.99) AS cap FROM lineitem) SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, greatest(0, least(l_extendedprice, cap)) AS price FROM lineitem, s""")
def winsor_quantile(spark: SparkSession, sf_dir: str, q: float = 0.99) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    cap = order.quantiles(lines, [], {"cap": ("l_extendedprice", q)})
    return lines.join(F.broadcast(cap)).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.greatest(F.lit(0.0), F.least("l_extendedprice", "cap")).alias("price"))


@query(f"""WITH {LISTINGS}, m AS (SELECT median(battery) AS m FROM listings WHERE t0 < TIMESTAMP '1996-01-01') SELECT listing_id, round(coalesce(battery, m), 7) AS battery FROM listings, m""")
def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    middle = rows.where(F.col("t0") < F.lit("1996-01-01").cast("timestamp_ntz")).select("battery")
    middle = order.quantiles(middle, [], {"m": ("battery", 0.5)})
    return rows.join(F.broadcast(middle)).select("listing_id", F.round(F.coalesce("battery", "m"), 7).alias("battery"))


@query(f"""WITH {LISTINGS}, m AS (SELECT max(sold_at) AS last FROM listings) SELECT listing_id, CASE WHEN sold_at < last - INTERVAL 365 DAYS THEN 'train' WHEN sold_at IS NOT NULL THEN 'eval' WHEN t0 < last - INTERVAL 386 DAYS THEN 'censored_train' ELSE 'censored_eval' END AS part
FROM listings, m WHERE sold_at IS NOT NULL OR t0 <= last - INTERVAL 21 DAYS""")
def time_split(spark: SparkSession, sf_dir: str, days: int = 365, least: int = 21) -> DataFrame:
    """Training and evaluation by the time of the sale; rows without one count by their decision time, and only if they are
    old enough at the end of their part."""
    rows = listings(spark, sf_dir).select("listing_id", "t0", "sold_at")
    last = rows.agg(F.max("sold_at").alias("last"))
    cut = F.col("last") - F.expr(f"INTERVAL {days} DAYS")
    part = F.when(F.col("sold_at") < cut, "train").when(F.col("sold_at").isNotNull(), "eval").when(F.col("t0") < cut - F.expr(f"INTERVAL {least} DAYS"), "censored_train").otherwise("censored_eval")
    old_enough = F.col("sold_at").isNotNull() | (F.col("t0") <= F.col("last") - F.expr(f"INTERVAL {least} DAYS"))
    return rows.join(F.broadcast(last)).where(old_enough).select("listing_id", part.alias("part"))


@query(f"""WITH {LISTINGS}, x AS (SELECT listing_id, region, price, pow(0.5, date_diff('day', CAST(t0 AS DATE), DATE '1999-01-01') / 720.0) AS w FROM listings), a AS (SELECT sum(w * price) / sum(w) AS m, sqrt(sum(w * price * price) / sum(w) - pow(sum(w * price) / sum(w), 2)) AS s FROM x),
g AS (SELECT region, sum(w) AS n, sum(w * price) / sum(w) AS m, sqrt(greatest(0, sum(w * price * price) / sum(w) - pow(sum(w * price) / sum(w), 2))) AS s FROM x GROUP BY 1)
SELECT listing_id, round((price - (g.n * g.m + 30 * a.m) / (g.n + 30)) / ((g.n * g.s + 30 * a.s) / (g.n + 30)), 5) AS z FROM x JOIN g USING (region), a""")
def region_z(spark: SparkSession, sf_dir: str, k: float = 30.0) -> DataFrame:
    """Price against the weighted mean of its region in units of its deviation, both shrunk to those of all."""
    w = half_life_weight(F.datediff(F.to_date(F.lit("1999-01-01")), F.to_date("t0")), 720.0)
    rows = listings(spark, sf_dir).select("listing_id", "region", "price", w.alias("w"))
    mean = F.sum(F.col("w") * F.col("price")) / F.sum("w")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("w") * F.col("price") * F.col("price")) / F.sum("w") - mean * mean))
    per = rows.groupBy("region").agg(F.sum("w").alias("n"), mean.alias("m"), spread.alias("s"))
    every = rows.agg(mean.alias("am"), spread.alias("as"))
    shrunk = lambda own, all_: (F.col("n") * F.col(own) + k * F.col(all_)) / (F.col("n") + k)
    return rows.join(per, "region").join(F.broadcast(every)).select("listing_id", F.round((F.col("price") - shrunk("m", "am")) / shrunk("s", "as"), 5).alias("z"))


@query(f"""WITH {OUTCOME}, r AS (SELECT max(day) AS last FROM o), d AS (SELECT listing_id, pow(0.5, date_diff('day', day, last) / 90.0) AS w, 1 + 2 * exp(-pow(abs(price / 1000 - 150) / 40, 2)) AS bump FROM o, r), m AS (SELECT avg(w) AS m FROM d) SELECT listing_id, round(w / m * bump, 6) AS weight FROM d, m""")
def decay_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-life weights with mean one, raised near a boundary value."""
    rows = outcomes(spark, sf_dir)
    bump = 1 + 2 * F.exp(-F.pow(F.abs(F.col("price") / 1000 - 150) / 40, 2))
    weighed = rows.join(F.broadcast(rows.agg(F.max("day").alias("last")))).select("listing_id", half_life_weight(F.datediff("last", "day"), 90.0).alias("w"), bump.alias("bump"))
    return weighed.join(F.broadcast(weighed.agg(F.avg("w").alias("m")))).select("listing_id", F.round(F.col("w") / F.col("m") * F.col("bump"), 6).alias("weight"))
