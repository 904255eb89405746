"""Reading, cleaning and adding rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.operators.asof import latest_per_key


def normalize_rows(df: DataFrame, key: str, name: str, price: str, minimum: float) -> DataFrame:
    """Trimmed name, digits of the name as postal code, and the reason to reject a row (null for rows that stay)."""
    reason = F.when(F.col(price).isNull(), "no_price").when(F.col(price) < minimum, "below_minimum")
    return df.where(F.col(key).isNotNull()).select(key, F.nullif(F.trim(name), F.lit("")).alias("name"), F.regexp_replace(name, "[^0-9]", "").alias("postal"), reason.alias("reason"))


def insert_new(target: DataFrame, batch: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """target plus the first batch row of each key that it lacks; rows of known keys are ignored."""
    fresh = latest_per_key(batch, key, order).join(target.select(*key), key, "left_anti")
    return target.unionByName(fresh)


def load_release(spark: SparkSession, paths: list[str], columns: list[str], release: str) -> DataFrame:
    """CSV files with a header, read as text so that leading zeros stay, stamped with the release."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.csv(paths, schema=schema, header=True).withColumn("release_id", F.lit(release))


def html_fields(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Title and description of web pages from the first source that has them, and which one that was.

    Linked data is read as JSON: of all its scripts, each an object or a list of objects, the longest name and description
    count; a script that is no JSON has none."""
    scripts = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<script[^>]*ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    # a list gives the text of each of its entries, anything else stands for itself
    entries = F.flatten(F.transform(F.filter(scripts, lambda s: F.try_parse_json(s).isNotNull()), lambda s: F.coalesce(F.from_json(s, "array<string>"), F.array(s))))

    def plain(text: Column) -> Column:
        return F.nullif(F.trim(F.regexp_replace(text, r"<[^>]*>|\s+", " ")), F.lit(""))

    def longest(field: str) -> Column:
        texts = F.transform(entries, lambda e: F.trim(F.coalesce(F.get_json_object(e, f"$.{field}"), F.lit(""))))
        return plain(F.aggregate(texts, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best)))

    def found(pattern: str) -> Column:
        return plain(F.regexp_extract(html, pattern, 1))

    titles = {"jsonld": longest("name"), "og": found(r'(?is)<meta[^>]+og:title"[^>]+content="([^"]*)"'), "h1": found(r"(?is)<h1[^>]*>(.*?)</h1>"), "title": found(r"(?is)<title[^>]*>(.*?)</title>")}
    texts = {"jsonld": longest("description"), "og": found(r'(?is)<meta[^>]+og:description"[^>]+content="([^"]*)"'), "meta": found(r'(?is)<meta[^>]+name="description"[^>]+content="([^"]*)"')}

    def source(options: dict[str, Column]) -> Column:
        return F.coalesce(*[F.when(v.isNotNull(), F.lit(k)) for k, v in options.items()])

    return pages.select(key, F.coalesce(*titles.values()).alias("title"), source(titles).alias("title_source"), F.coalesce(*texts.values()).alias("description"), source(texts).alias("description_source"))


def release_problems(rows: DataFrame, code: str, name: str, pattern: str, used: DataFrame) -> DataFrame:
    """One row: codes, bad_codes, blanks, repeated, and the share of used rows (code) that a well-formed code covers.

    Codes are compared in lower case without white space at the ends.
    """
    normal = F.lower(F.trim(code))
    per = rows.groupBy(normal.alias("_code")).agg(F.count("*").alias("n"), F.count_if(~F.col(code).rlike(pattern)).alias("bad"), F.count_if(F.trim(name) == "").alias("blank"))
    one = per.agg(F.count("*").alias("codes"), F.sum("bad").alias("bad_codes"), F.sum("blank").alias("blanks"), F.count_if(F.col("n") > 1).alias("repeated"))
    good = per.where("bad = 0").select("_code", F.lit(True).alias("_good"))
    met = used.select(normal.alias("_code")).groupBy("_code").agg(F.count("*").alias("n")).join(good, "_code", "left")
    share = met.agg(F.round(F.sum(F.when(F.col("_good"), F.col("n")).otherwise(0)) / F.sum("n"), 7).alias("coverage"))
    return one.join(F.broadcast(share))


def append_snapshot(target: DataFrame, rows: DataFrame, key: list[str], dated: str, date: str) -> DataFrame:
    """target plus rows stamped with a date, without the keys that it has for that date."""
    there = target.where(F.col(dated) == date).select(*key)
    return target.unionByName(rows.join(there, key, "left_anti").withColumn(dated, F.lit(date)))


def write_days(df: DataFrame, path: str, day: str, form: str = "parquet") -> None:
    """Rows written by day."""
    df.repartition(day).write.mode("overwrite").partitionBy(day).format(form).save(path)
