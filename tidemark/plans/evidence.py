"""Roll-ups of evidence rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import evidence_kept
from tidemark.operators import candidates, order
from tidemark.operators.asof import wide_join
from tidemark.registry import query

from .roles import IMAGES, images


@query(f"""WITH {IMAGES} SELECT listing_id, count(*) AS n, count(*) FILTER (WHERE quality >= 2) AS n_q2, max(damage) FILTER (WHERE quality >= 2) AS max_q2, sum(quality) FILTER (WHERE NOT stock) AS real_quality FROM images GROUP BY 1""")
def filtered_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.col("quality") >= 2
    return images(spark, sf_dir).groupBy("listing_id").agg(F.count("*").alias("n"), F.count_if(good).alias("n_q2"), F.max(F.when(good, F.col("damage"))).alias("max_q2"), F.sum(F.when(~F.col("stock"), F.col("quality"))).alias("real_quality"))


@query(f"""WITH {IMAGES}, g AS (SELECT listing_id, bool_or(damage >= 5) AS present, count(damage) > 0 AS observed FROM images GROUP BY 1) SELECT listing_id, coalesce(present, false) AS present, observed AS known, CASE WHEN NOT observed THEN 'unknown' WHEN present THEN 'yes' ELSE 'no' END AS level FROM g""")
def tri_state_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = images(spark, sf_dir).groupBy("listing_id").agg(F.bool_or(F.col("damage") >= 5).alias("p"), (F.count("damage") > 0).alias("known"))
    return rows.select("listing_id", F.coalesce("p", F.lit(False)).alias("present"), "known", F.when(~F.col("known"), "unknown").when(F.col("p"), "yes").otherwise("no").alias("level"))


@query(f"""WITH {IMAGES} SELECT colour, quantile_cont(damage, 0.1) AS p10, quantile_cont(damage, 0.5) AS p50, quantile_cont(damage, 0.9) FILTER (WHERE quality >= 2) AS p90 FROM images GROUP BY 1""")
def ordered_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = images(spark, sf_dir).select("colour", "damage", F.when(F.col("quality") >= 2, F.col("damage")).alias("clear"))
    return order.quantiles(rows, ["colour"], {"p10": ("damage", 0.1), "p50": ("damage", 0.5), "p90": ("clear", 0.9)})


@query(f"""WITH {IMAGES} SELECT listing_id, round(count(damage) / count(*), 7) AS share, count(*) - count(damage) AS undone, count(damage) < count(*) AS incomplete, count(*) >= 8 AS cap_hit FROM images GROUP BY 1""")
def coverage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, done = F.count("*"), F.count("damage")
    return images(spark, sf_dir).groupBy("listing_id").agg(F.round(done / n, 7).alias("share"), (n - done).alias("undone"), (done < n).alias("incomplete"), (n >= 8).alias("cap_hit"))


@query(f"""WITH {IMAGES}, v AS (SELECT listing_id, colour, count(*) AS votes, max(confidence) AS best, sum(quality) AS quality, max(value) AS top, min(image_key) AS first FROM images WHERE damage IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY votes DESC, best DESC, quality DESC, top DESC, first, colour) AS n, sum(votes) OVER (PARTITION BY listing_id) AS total FROM v)
SELECT listing_id, max(colour) FILTER (WHERE n = 1) AS winner, max(colour) FILTER (WHERE n = 2) AS second, round(max(votes / total) FILTER (WHERE n = 1), 7) AS share, max(votes) FILTER (WHERE n = 1) - max(votes) FILTER (WHERE n = 2) AS margin,
 CASE WHEN max(n) = 1 OR max(votes / total) FILTER (WHERE n = 1) >= 0.67 THEN max(colour) FILTER (WHERE n = 1) END AS strict FROM r GROUP BY 1""")
def vote_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = images(spark, sf_dir).where("damage is not null").groupBy("listing_id", "colour").agg(F.count("*").alias("votes"), F.max("confidence").alias("best"), F.sum("quality").alias("quality"), F.max("value").alias("top"), F.min("image_key").alias("first"))
    order = Window.partitionBy("listing_id").orderBy(F.desc("votes"), F.desc("best"), F.desc("quality"), F.desc("top"), "first", "colour")
    ranked = votes.select("*", F.row_number().over(order).alias("n"), F.sum("votes").over(Window.partitionBy("listing_id")).alias("total"))
    top, second = F.col("n") == 1, F.col("n") == 2
    share = F.max(F.when(top, F.col("votes") / F.col("total")))
    winner = F.max(F.when(top, F.col("colour")))
    return ranked.groupBy("listing_id").agg(
        winner.alias("winner"), F.max(F.when(second, F.col("colour"))).alias("second"), F.round(share, 7).alias("share"),
        (F.max(F.when(top, F.col("votes"))) - F.max(F.when(second, F.col("votes")))).alias("margin"),
        F.when((F.max("n") == 1) | (share >= 0.67), winner).alias("strict"),
    )


@query(f"""WITH {IMAGES} SELECT listing_id, count(*) AS n, round(stddev_samp(value), 4) AS spread, round(avg(CASE WHEN damage >= 5 THEN 1.0 ELSE 0.0 END), 7) AS share, CASE WHEN max(damage) >= 8 THEN 'high' WHEN max(damage) >= 4 THEN 'mid' ELSE 'low' END AS band FROM images WHERE quality >= 2 AND NOT stock GROUP BY 1""")
def dmg_hq_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.max("damage")
    return images(spark, sf_dir).where("quality >= 2 and not stock").groupBy("listing_id").agg(F.count("*").alias("n"), F.round(F.stddev_samp("value"), 4).alias("spread"), F.round(F.avg(F.when(F.col("damage") >= 5, 1.0).otherwise(0.0)), 7).alias("share"), F.when(top >= 8, "high").when(top >= 4, "mid").otherwise("low").alias("band"))


FUSED = f"""WITH {IMAGES}, a AS (SELECT listing_id, count(*) AS n, count(damage) AS done, count(*) FILTER (WHERE NOT stock) AS real, count(*) FILTER (WHERE NOT stock AND quality >= 2) AS q2, count(*) FILTER (WHERE NOT stock AND quality >= 1) AS q1,
 max(damage) FILTER (WHERE NOT stock AND quality >= 2) AS m2, max(damage) FILTER (WHERE NOT stock AND quality >= 1) AS m1, max(damage) AS any_damage FROM images GROUP BY 1)"""


@query(f"""{FUSED}, s AS (SELECT *, CASE WHEN q2 >= 2 AND m2 IS NOT NULL THEN m2 WHEN q1 >= 1 AND m1 IS NOT NULL THEN m1 END AS score, CASE WHEN q2 >= 2 AND m2 IS NOT NULL THEN 2 WHEN q1 >= 1 AND m1 IS NOT NULL THEN 1 ELSE 0 END AS level FROM a)
SELECT listing_id, score, level, CASE WHEN done = 0 THEN 2 WHEN real = 0 THEN 3 WHEN q2 = 0 THEN 4 WHEN q2 < 2 AND q1 >= 2 THEN 7 WHEN q2 < 2 THEN 6 ELSE 0 END AS reason,
 CASE WHEN any_damage >= 8 THEN 3 WHEN score >= 3 THEN 2 WHEN score = 2 THEN 1 ELSE 0 END AS tier FROM s""")
def fusion_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = ~F.col("stock")
    good, fair = real & (F.col("quality") >= 2), real & (F.col("quality") >= 1)
    rows = images(spark, sf_dir).groupBy("listing_id").agg(
        F.count("damage").alias("done"), F.count_if(real).alias("real"), F.count_if(good).alias("q2"), F.count_if(fair).alias("q1"),
        F.max(F.when(good, F.col("damage"))).alias("m2"), F.max(F.when(fair, F.col("damage"))).alias("m1"), F.max("damage").alias("any_damage"),
    )
    first, second = (F.col("q2") >= 2) & F.col("m2").isNotNull(), (F.col("q1") >= 1) & F.col("m1").isNotNull()
    score = F.when(first, F.col("m2")).when(second, F.col("m1"))
    reason = F.when(F.col("done") == 0, 2).when(F.col("real") == 0, 3).when(F.col("q2") == 0, 4).when((F.col("q2") < 2) & (F.col("q1") >= 2), 7).when(F.col("q2") < 2, 6).otherwise(0)
    return rows.select("listing_id", score.alias("score"), F.when(first, 2).when(second, 1).otherwise(0).alias("level"), reason.alias("reason"), F.when(F.col("any_damage") >= 8, 3).when(score >= 3, 2).when(score == 2, 1).otherwise(0).alias("tier"))


#: Visible: value above 20,000. Without a protector: confidence below 0.05. The text's level is that of the stock images.
@query(f"""WITH {IMAGES}, a AS (SELECT listing_id, count(damage) AS done, count(*) FILTER (WHERE NOT stock) AS real, count(*) FILTER (WHERE NOT stock AND quality >= 2) AS q2, count(*) FILTER (WHERE NOT stock AND quality >= 2 AND value > 20000) AS v2,
  count(*) FILTER (WHERE NOT stock AND quality >= 1 AND value > 20000) AS v1, max(damage) FILTER (WHERE NOT stock AND quality >= 2 AND value > 20000) AS m2, max(damage) FILTER (WHERE NOT stock AND quality >= 1 AND value > 20000) AS m1,
  max(damage) FILTER (WHERE NOT stock AND quality >= 2 AND confidence < 0.05) AS bare, max(quality) FILTER (WHERE stock) AS decided, bool_or(stock AND damage >= 9) AS glass, bool_or(stock) AS told, 100 - 4 * max(damage) FILTER (WHERE quality = 0) AS battery FROM images GROUP BY 1),
s AS (SELECT *, CASE WHEN v2 >= 2 AND m2 IS NOT NULL THEN 2 WHEN v1 >= 2 AND m1 IS NOT NULL THEN 1 ELSE 0 END AS level, CASE WHEN v2 >= 2 AND m2 IS NOT NULL THEN m2 WHEN v1 >= 2 AND m1 IS NOT NULL THEN m1 END AS score,
  greatest(least(coalesce(decided, 0), 2), CASE WHEN battery < 80 THEN 2 ELSE 0 END, CASE WHEN glass THEN 3 ELSE 0 END) AS sev FROM a),
t AS (SELECT *, CASE WHEN bare >= 8 OR sev >= 3 THEN 3 WHEN score >= 3 THEN 2 WHEN score = 2 OR sev >= 2 THEN 1 ELSE 0 END AS tier FROM s)
SELECT listing_id, level, score, CASE WHEN done = 0 THEN 2 WHEN real = 0 THEN 3 WHEN q2 = 0 THEN 4 WHEN v2 = 0 THEN 5 WHEN v2 < 2 AND v1 >= 2 THEN 7 WHEN v2 < 2 THEN 6 ELSE 0 END AS reason, CASE WHEN told OR battery IS NOT NULL THEN sev END AS severity_known, CASE WHEN level >= 1 OR told OR battery IS NOT NULL THEN tier END AS tier_known FROM t""")
def fusion_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion with all reasons, the severity of texts corrected by battery and glass, damage without a protector before the
    rest, and levels only where something is known."""
    real, damage = ~F.col("stock"), F.col("damage")
    seen = F.col("value") > 20000
    good, fair = real & (F.col("quality") >= 2), real & (F.col("quality") >= 1)
    rows = images(spark, sf_dir).groupBy("listing_id").agg(
        F.count("damage").alias("done"), F.count_if(real).alias("real"), F.count_if(good).alias("q2"), F.count_if(good & seen).alias("v2"), F.count_if(fair & seen).alias("v1"), F.max(F.when(good & seen, damage)).alias("m2"), F.max(F.when(fair & seen, damage)).alias("m1"),
        F.max(F.when(good & (F.col("confidence") < 0.05), damage)).alias("bare"), F.max(F.when(F.col("stock"), F.col("quality"))).alias("decided"), F.coalesce(F.bool_or(F.col("stock") & (damage >= 9)), F.lit(False)).alias("glass"), F.bool_or("stock").alias("told"),
        (100 - 4 * F.max(F.when(F.col("quality") == 0, damage))).alias("battery"),
    )
    two, one = (F.col("v2") >= 2) & F.col("m2").isNotNull(), (F.col("v1") >= 2) & F.col("m1").isNotNull()
    low = F.coalesce(F.col("battery") < 80, F.lit(False))
    rows = rows.withColumn("score", F.when(two, F.col("m2")).when(one, F.col("m1"))).withColumn("level", F.when(two, 2).when(one, 1).otherwise(0))
    rows = rows.withColumn("sev", candidates.severity(F.least(F.coalesce("decided", F.lit(0)), F.lit(2)), [(low, 2), (F.col("glass"), 3)]))
    reason = candidates.first_code([(F.col("done") == 0, 2), (F.col("real") == 0, 3), (F.col("q2") == 0, 4), (F.col("v2") == 0, 5), ((F.col("v2") < 2) & (F.col("v1") >= 2), 7), (F.col("v2") < 2, 6)])
    tier = candidates.first_code([((F.col("bare") >= 8) | (F.col("sev") >= 3), 3), (F.col("score") >= 3, 2), ((F.col("score") == 2) | (F.col("sev") >= 2), 1)])
    told = F.col("told") | F.col("battery").isNotNull()
    return rows.select("listing_id", "level", "score", reason.alias("reason"), F.when(told, F.col("sev")).alias("severity_known"), F.when((F.col("level") >= 1) | told, tier).alias("tier_known"))


@query(f"""WITH {IMAGES}, c AS (SELECT listing_id, image_key, 10 * quality + 3 * coalesce(damage, 0) AS score, stock, count(*) FILTER (WHERE NOT stock) OVER (PARTITION BY listing_id) AS real, value FROM images),
r AS (SELECT listing_id, image_key, row_number() OVER (PARTITION BY listing_id ORDER BY CASE WHEN real = 0 THEN 0 ELSE score END DESC, image_key, value) AS n FROM c WHERE real = 0 OR NOT stock) SELECT listing_id, image_key, n FROM r WHERE n <= 2""")
def topk_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = F.count_if(~F.col("stock")).over(Window.partitionBy("listing_id"))
    rows = images(spark, sf_dir).withColumn("real", real).where("real = 0 or not stock")
    score = F.when(F.col("real") == 0, 0).otherwise(10 * F.col("quality") + 3 * F.coalesce("damage", F.lit(0)))
    order = Window.partitionBy("listing_id").orderBy(F.desc(score), "image_key", "value")
    return rows.select("listing_id", "image_key", F.row_number().over(order).cast("bigint").alias("n")).where("n <= 2")


@query(f"""WITH {IMAGES}, a AS (SELECT listing_id, count(*) AS n, count(*) FILTER (WHERE quality >= 1) AS usable FROM images GROUP BY 1),
c AS (SELECT listing_id, arg_max(colour, (votes, colour)) AS colour, max(votes) AS votes FROM (SELECT listing_id, colour, count(*) AS votes FROM images WHERE damage IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
d AS (SELECT listing_id, max(damage) AS top, count(damage) AS done FROM images WHERE quality >= 2 GROUP BY 1), q AS (SELECT listing_id, round(avg(quality), 6) AS mean FROM images WHERE NOT stock GROUP BY 1), s AS (SELECT listing_id, count(*) AS n FROM images WHERE stock GROUP BY 1)
SELECT a.listing_id, a.n AS assets__n, nullif(a.usable, 0) AS assets__usable, c.colour AS colour__colour, c.votes AS colour__votes, d.top AS damage__top, d.done AS damage__done, q.mean AS quality__mean, coalesce(s.n, 0) AS stock__n
FROM a LEFT JOIN c USING (listing_id) LEFT JOIN d USING (listing_id) LEFT JOIN q USING (listing_id) LEFT JOIN s USING (listing_id)""")
def unified_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each listing with assets, with four roll-ups joined to it; a count of none is null in the old column."""
    rows = images(spark, sf_dir)
    driver = rows.groupBy("listing_id").agg(F.count("*").alias("assets__n"), F.nullif(F.count_if(F.col("quality") >= 1), F.lit(0)).alias("assets__usable"))
    votes = rows.where("damage is not null").groupBy("listing_id", "colour").agg(F.count("*").alias("votes"))
    surfaces = {
        "colour": votes.groupBy("listing_id").agg(F.max_by("colour", F.struct("votes", "colour")).alias("colour"), F.max("votes").alias("votes")),
        "damage": rows.where("quality >= 2").groupBy("listing_id").agg(F.max("damage").alias("top"), F.count("damage").alias("done")),
        "quality": rows.where("not stock").groupBy("listing_id").agg(F.round(F.avg("quality"), 6).alias("mean")),
        "stock": rows.where("stock").groupBy("listing_id").agg(F.count("*").alias("n")),
    }
    return wide_join(driver, ["listing_id"], surfaces).withColumn("stock__n", F.coalesce("stock__n", F.lit(0)))


@query(f"""WITH {IMAGES} SELECT listing_id, count(*) AS n_in, count(*) FILTER (WHERE confidence >= 0.05 AND s >= 0 AND s < e AND e <= len) AS n_kept, coalesce(string_agg(colour, ',' ORDER BY colour, s) FILTER (WHERE confidence >= 0.05 AND s >= 0 AND s < e AND e <= len), '') AS codes
FROM (SELECT listing_id, colour, confidence, quality * 30 - 10 AS s, CAST(floor(value / 500) AS BIGINT) AS e, 180 AS len FROM images) GROUP BY 1""")
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of a listing whose confidence is enough and whose span lies inside the text."""
    item = F.struct(F.col("colour").alias("code"), (F.col("quality") * 30 - 10).alias("start"), "confidence", F.floor(F.col("value") / 500).cast("bigint").alias("end"))
    lists = images(spark, sf_dir).groupBy("listing_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    kept = lists.withColumn("kept", evidence_kept(F.col("items"), F.lit(180), 0.05))
    return kept.select("listing_id", F.size("items").cast("bigint").alias("n_in"), F.size("kept").cast("bigint").alias("n_kept"), F.array_join(F.transform("kept", lambda x: x["code"]), ",").alias("codes"))
