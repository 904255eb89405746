"""What observations say about listings: statuses decided and compared, constant labels, marks with evidence, flags of texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C


def _filled(*texts: Column) -> Column:
    """The first text that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(t) != "", t) for t in texts])


def decide(snapshots: DataFrame) -> DataFrame:
    """snapshots with verdict, verdict_price, price_source, sold_date and reason.

    Snapshots have http, status, price, sold_price, sold_at, last_price and evidence, any of which may be null. Pages that are
    gone (404, 410) and removed listings keep the last known price. A sale needs its time, without one the listing counts as
    live; its price is the sold price, else the listed one, else the last known one. All other listings are live. A price that
    is null or not over 0 is unknown.
    """
    price, sold_price, last = (F.when(F.col(c) > 0, F.col(c)) for c in ("price", "sold_price", "last_price"))
    gone = F.coalesce(F.col("http").isin(404, 410), F.lit(False)) | F.col("status").eqNullSafe("removed")
    sold = ~gone & F.col("status").eqNullSafe("sold") & F.col("sold_at").isNotNull()
    ways = {
        "removed": [("db_fallback", last)],
        "sold": [("adapter_sold_price", sold_price), ("adapter_price_as_sold_price", price), ("db_fallback", last)],
        "live": [("adapter", price), ("db_fallback", last)],
    }

    def first_of(verdict: str) -> Column:
        found = [F.when(value.isNotNull(), F.struct(F.lit(source).alias("source"), value.cast("double").alias("price"))) for source, value in ways[verdict]]
        # a sale without any price names the last source that was asked before the fallback
        none = "adapter_price_as_sold_price" if verdict == "sold" else "none"
        return F.coalesce(*found, F.struct(F.lit(none).alias("source"), F.lit(0.0).alias("price")))

    verdict = F.when(gone, "removed").when(sold, "sold").otherwise("live")
    chosen = F.when(gone, first_of("removed")).when(sold, first_of("sold")).otherwise(first_of("live"))
    default = F.when(gone, F.concat(F.lit("http_"), F.coalesce("http", F.lit(0)).cast("string"))).when(sold, "adapter_sold").otherwise("adapter_live")
    return snapshots.withColumns({"verdict": verdict, "verdict_price": chosen["price"], "price_source": chosen["source"], "sold_date": F.when(sold, F.col("sold_at")), "reason": _filled(F.col("evidence"), default)})


#: What a detected status means for the table of record; other detections say nothing.
EXPECTED = {"sold": "sold", "removed": "removed", "live": "live", "inactive": "live"}


def compare(rows: DataFrame, review: dict[str, str]) -> DataFrame:
    """rows with expected, mismatch_status, mismatch_inactive, suggested_status, suggested_inactive and reasons (null: none).

    Rows have main_status, main_inactive, detected, flag_seen and detected_inactive. The inactive flag counts only where a live
    row is expected and the page had the flag; an unknown main flag is no mismatch, but is suggested. `review` gives a reason
    for each main status that should be looked at by hand where the row appears live.
    """
    main, flag, seen = F.col("main_status"), F.col("main_inactive"), F.col("detected_inactive")
    expected = reduce(lambda out, kv: F.when(F.col("detected") == kv[0], kv[1]).otherwise(out), EXPECTED.items(), F.lit(None).cast("string"))
    wrong = expected.isNotNull() & ~main.eqNullSafe(expected)
    live = expected.eqNullSafe("live")
    known = live & F.coalesce("flag_seen", F.lit(False)) & seen.isNotNull()
    other = known & ~flag.eqNullSafe(seen)
    reasons = [
        F.when(wrong, F.concat(F.lit("status_mismatch main="), F.coalesce(main, F.lit("")), F.lit(" detected="), F.col("detected"))),
        F.when(other, F.lit("inactive_flag_mismatch")),
        *[F.when(live & (main == status), F.lit(text)) for status, text in review.items()],
    ]
    return rows.withColumns({
        "expected": expected,
        "mismatch_status": wrong,
        "mismatch_inactive": other & flag.isNotNull(),
        "suggested_status": F.when(wrong, expected),
        "suggested_inactive": F.when(other, seen),
        "reasons": F.nullif(F.concat_ws("; ", *reasons), F.lit("")),
    })


def stamp(rows: DataFrame, value: str, rules: dict[float, dict[str, object]], version: str, version_column: str, cleared: tuple[str, ...] = ()) -> DataFrame:
    """rows with constant labels where `value` is a key of rules: its labels and the version are set, `cleared` columns become
    null. All other rows stay as they are, and a second stamp changes nothing."""
    kinds = {f.name: f.dataType for f in rows.schema}
    hit = F.col(value).isin(*rules)
    out = {}
    for name in dict.fromkeys(c for labels in rules.values() for c in labels):
        out[name] = reduce(lambda kept, rule: F.when(F.col(value) == rule[0], F.lit(rule[1][name]).cast(kinds[name])).otherwise(kept), ((v, labels) for v, labels in rules.items() if name in labels), F.col(name))  # noqa: B023
    out[version_column] = F.when(hit, F.lit(version)).otherwise(F.col(version_column))
    out |= {c: F.when(hit, F.lit(None).cast(kinds[c])).otherwise(F.col(c)) for c in cleared}
    return rows.withColumns(out)


def mark(listings: DataFrame, marks: DataFrame, key: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """(listings with `spam` set to the label where a mark names them, evidence (key, old_model, evidence) of each mark).

    Listings have model, spam, title and description; marks have source, reason and at. Of several marks of a listing the
    latest counts (then the greater source and reason); marks of unknown listings do nothing.
    """
    latest = marks.groupBy(*key).agg(F.max(F.struct("at", "source", "reason")).alias("_mark"))
    joined = listings.join(latest, key, "left")
    held = joined.where("_mark is not null")
    fields = {
        "type": F.lit(f"spam_{label}"),
        "at": F.date_format("_mark.at", "yyyy-MM-dd'T'HH:mm:ss"),
        "source": F.col("_mark.source"),
        "reason": F.col("_mark.reason"),
        **{k: F.col(k) for k in key},
        "title": F.coalesce("title", F.lit("")),
        "description": F.coalesce("description", F.lit("")),
        "old_spam": F.col("spam"),
        "new_spam": F.lit(label),
        "old_model": F.col("model"),
    }
    evidence = held.select(*key, F.col("model").alias("old_model"), F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"}).alias("evidence"), F.col("_mark.at").alias("at"))
    after = joined.withColumn("spam", F.when(F.col("_mark").isNotNull(), label).otherwise(F.col("spam"))).select(*listings.columns)
    return after, evidence


def attach_fix(features: DataFrame, evidence: DataFrame, key: list[str], reason: str) -> DataFrame:
    """features with fix_old, fix_new, fix_reason, fix_evidence and fix_at from the evidence of their listing; models that an
    earlier fix wrote down stay."""
    new = evidence.select(*key, F.col("old_model").alias("_model"), F.col("evidence").alias("_evidence"), F.col("at").alias("_at"))
    hit = F.col("_evidence").isNotNull()
    taken = {"fix_old": F.coalesce("fix_old", "_model"), "fix_new": F.coalesce("fix_new", "_model"), "fix_reason": F.lit(reason), "fix_evidence": F.col("_evidence"), "fix_at": F.col("_at")}
    return features.join(new, key, "left").select(*[F.when(hit, taken[c]).otherwise(F.col(c)).alias(c) if c in taken else F.col(c) for c in features.columns])


def consistent(title: Column, description: Column, model: Column, buyer: list[str]) -> Column:
    """True where neither text asks to buy (any phrase of `buyer`) and one of them names the model; null texts are empty."""
    title, description = F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))
    name, texts = C.letters_and_digits(model), [C.letters_and_digits(t) for t in (title, description)]
    named = (name != "") & (texts[0].contains(name) | texts[1].contains(name))
    return F.coalesce(named, F.lit(False)) & ~C.has_phrase(F.concat_ws(" ", title, description), buyer)


def keyword_flags(rows: DataFrame, key: list[str], text: str, level: str, families: dict[str, list[list[str]]], least: float) -> DataFrame:
    """(key, a flag for each family): whether any row of the key with a known level has a level of at least `least` and a text
    with a word of every list of the family; null where no row can tell (three-valued, as SQL's bool_or with a filter)."""
    known = F.col(level).isNotNull()
    flags = [F.bool_or(F.when(known, C.has_words(F.col(text), words) & (F.col(level) >= least))).alias(name) for name, words in families.items()]
    return rows.groupBy(*key).agg(*flags)
