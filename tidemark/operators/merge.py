"""Set-based merges: a new version of a table from the old one and a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, batch: DataFrame, key: list[str], overwrite: list[str], earliest: list[str]) -> DataFrame:
    """Rows of both; where a key is in both, `overwrite` columns come from the batch and `earliest` ones are the lesser."""
    a, b = target.alias("a"), batch.alias("b")
    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key], "full")
    keys = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key]
    return joined.select(*keys, *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in overwrite], *[F.least(f"a.{c}", f"b.{c}").alias(c) for c in earliest])


def merge_history(old: DataFrame, new: DataFrame, key: list[str], sold: str, removed: str) -> DataFrame:
    """One row per key with status and price: a sale outranks all, then a removal, then what was there first."""
    joined = old.select(*key, F.struct("status", "price").alias("p")).join(new.select(*key, F.struct("status", "price").alias("e")), key, "full")
    was, now, paid = F.col("p.status"), F.col("e.status"), F.col("e.price") > 0
    status = F.when((was == sold) | (now == sold), sold).when(now == removed, removed).otherwise(F.coalesce(was, now))
    price = F.when((now == sold) & paid, F.col("e.price")).when(was.isNull(), F.col("e.price")).when(paid & (now != removed) & (was != sold), F.col("e.price")).otherwise(F.col("p.price"))
    return joined.select(*key, status.alias("status"), price.alias("price"))


def change_log(log: DataFrame, key: list[str], order: list[str], flag: str) -> DataFrame:
    """The rows where the flag flips; a first false is no change, an unknown flag is not logged."""
    known = log.where(F.col(flag).isNotNull())
    was = F.lag(flag).over(Window.partitionBy(*key).orderBy(*order))
    return known.withColumn("_was", was).where((F.col("_was").isNull() & F.col(flag)) | (F.col("_was") != F.col(flag))).drop("_was")


def apply_status(rows: DataFrame, was: str, seen: str, mode: str = "safe", allow_unsell: bool = False, allow_revive: bool = False) -> DataFrame:
    """rows with `status` after the policy (none, safe or all) and `applied`."""
    old, new = F.col(was), F.col(seen)
    rule = F.lit(False)
    if mode in ("safe", "all"):
        rule = old.isin("live", "stale") & new.isin("sold", "removed")
    if mode == "all" and allow_unsell:
        rule = rule | ((old == "sold") & (new == "live"))
    if mode == "all" and allow_revive:
        rule = rule | (old.isin("removed", "stale") & (new == "live"))
    return rows.withColumn("applied", F.coalesce(rule, F.lit(False))).withColumn("status", F.when(F.col("applied"), new).otherwise(old))


def merge_daily(old: DataFrame, new: DataFrame, key: list[str], source: str) -> DataFrame:
    """One row (key, price, source, seen) for each key of either: a day's row from a foreign source stays as it is; else the
    new price counts where it is over 0, and the time is the later one."""
    cells = ["price", "source", "seen"]
    joined = old.select(*key, F.struct(*cells).alias("p")).join(new.select(*key, F.struct(*cells).alias("e")), key, "full")
    foreign = F.col("p").isNotNull() & (F.col("p.source") != source)
    paid = F.coalesce(F.col("e.price") > 0, F.lit(False))
    price = F.when(foreign, F.col("p.price")).when(F.col("p").isNull() | paid, F.col("e.price")).otherwise(F.col("p.price"))
    seen = F.when(foreign, F.col("p.seen")).otherwise(F.greatest("p.seen", "e.seen"))
    return joined.select(*key, price.alias("price"), F.when(foreign, F.col("p.source")).otherwise(F.coalesce("e.source", "p.source")).alias("source"), seen.alias("seen"))


def history_plan(facts: DataFrame, key: list[str]) -> DataFrame:
    """(key, kind, price, status, reason): what a sparse history has to write for each row of facts.

    facts has status (sold, removed or live), price, reliable, bidding, main_price, was_inactive, inactive (null: unknown),
    last_price (0 or null: none) and has_baseline. A sale or removal is always written. A live row is written once a day as a
    baseline, and where a reliable price changed or else the inactive flag flipped; bidding makes a price unreliable.
    """
    last = F.coalesce("last_price", F.lit(0.0))
    sure = F.coalesce("reliable", F.lit(False)) & ~F.coalesce("bidding", F.lit(False))
    base = F.when(sure, F.col("price")).when(last > 0, last).otherwise(F.greatest(F.coalesce("main_price", F.lit(0.0)), F.lit(0.0)))
    changed = sure & ((last == 0) | (F.col("price") != last))
    flipped = F.coalesce(F.col("inactive") != F.col("was_inactive"), F.lit(False))

    def action(kind: str, price: Column, status: str, reason: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), price.cast("double").alias("price"), F.lit(status).alias("status"), F.lit(reason).alias("reason"))

    live = F.array(
        F.when(~F.coalesce("has_baseline", F.lit(False)), action("baseline", base, "live", "daily_baseline_missing")),
        F.when(changed, action("event", F.col("price"), "live", "price_changed")).when(flipped, action("event", base, "live", "inactive_flip")),
    )
    acts = F.when(F.col("status") == "sold", F.array(action("event", F.col("price"), "sold", "terminal_sold"))).when(F.col("status") == "removed", F.array(action("event", base, "removed", "terminal_removed"))).otherwise(F.array_compact(live))
    return facts.select(*key, F.explode(acts).alias("x")).select(*key, "x.*")


def sync_with_audit(main: DataFrame, snaps: DataFrame, key: str, value: str, log: str, clamps: dict[float, int], eps: float = 1e-9) -> DataFrame:
    """main with value taken from the snapshots (key, value) where it differs, an entry of the log for each change, `severity`
    set where the new value has a clamp, and `queued` where it has none."""
    joined = main.join(snaps.select(key, F.col(value).alias("_snap")), key, "left")
    differs = F.col("_snap").isNotNull() & F.coalesce(F.abs(F.col("_snap") - F.col(value)) > eps, F.lit(True))
    clamp = F.lit(None).cast("int")
    for at, severity in clamps.items():
        clamp = F.when(F.abs(F.col("_snap") - at) < eps, severity).otherwise(clamp)
    entry = F.struct(F.col(value).alias("was"), F.col("_snap").alias("now"))
    return joined.select(
        *[c for c in main.columns if c not in (value, log)],
        F.when(differs, F.col("_snap")).otherwise(F.col(value)).alias(value),
        F.when(differs, F.array_append(F.coalesce(log, F.array().cast(main.schema[log].dataType)), entry)).otherwise(F.col(log)).alias(log),
        F.when(differs, clamp).alias("severity"),
        (differs & clamp.isNull()).alias("queued"),
    )


def refresh_short(snapshots: DataFrame, fresh: DataFrame, key: list[str], order: list[str], text: str, evidence: str, most: int) -> DataFrame:
    """The latest snapshot with a text of at most `most` characters of each key, with the fresh text (key, text, evidence) and
    the maps of evidence merged, the fresh one winning; keys without a fresh row are left out."""
    short = snapshots.where(F.coalesce(F.length(text), F.lit(0)) <= most)
    latest = short.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))).where("_n = 1").drop("_n")
    new = fresh.select(*key, F.col(text).alias("_text"), F.col(evidence).alias("_evidence"))
    kept = F.map_filter(F.coalesce(evidence, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, _: ~F.array_contains(F.map_keys("_evidence"), k))
    joined = latest.join(new, key)
    return joined.select(*[c for c in snapshots.columns if c not in (text, evidence)], F.length(text).alias("old_length"), F.col("_text").alias(text), F.map_concat(kept, "_evidence").alias(evidence))


def touch_or_replace(stored: DataFrame, batch: DataFrame, key: list[str], text: str, digest: str, made: str, seen: str) -> DataFrame:
    """(key, action, digest, made): what a batch (key, text, seen) does to the stored rows (key, digest, made).

    Of several texts of a key the longest counts (then the greater). The same digest only moves the time on; empty texts do
    nothing.
    """
    longest = batch.where(F.coalesce(F.trim(text), F.lit("")) != "").groupBy(*key).agg(F.max(F.struct(F.length(text).alias("n"), F.col(text).alias("t"))).alias("x"), F.max(seen).alias("_seen"))
    new = longest.select(*key, F.sha1("x.t").alias("_digest"), "_seen")
    joined = new.join(stored.select(*key, digest, made), key, "left")
    same = F.coalesce(F.col(digest) == F.col("_digest"), F.lit(False))
    action = F.when(same, "touched").when(F.col(digest).isNull(), "new").otherwise("replaced")
    return joined.select(*key, action.alias("action"), F.col("_digest").alias(digest), F.greatest(made, "_seen").alias(made))


def apply_with_log(rows: DataFrame, key: str, was: str, seen: str, inactive: str, mode: str = "safe", allow_unsell: bool = False, allow_revive: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows after `apply_status` with the inactive flag in step with the status, and a log (key, action) of what changed."""
    done = apply_status(rows, was, seen, mode, allow_unsell, allow_revive)
    wanted = F.when(F.col("applied"), F.col("status") != "live").otherwise(F.col(inactive))
    done = done.withColumn("_flag", wanted)
    acts = F.array_compact(F.array(F.when(F.col("applied"), F.concat(F.lit("status:"), F.col(was), F.lit("->"), F.col("status"))), F.when(F.col("_flag") != F.col(inactive), F.concat(F.lit("inactive:"), F.col("_flag").cast("string")))))
    log = done.select(key, F.explode(acts).alias("action"))
    return done.withColumn(inactive, F.col("_flag")).drop("_flag"), log


def correct_keys(tables: dict[str, tuple[DataFrame, str]], mapping: DataFrame, old: str, new: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table (frame, key column) with corrected keys, and an audit (table, old, new, n) of the rows that moved."""
    out, audit = {}, None
    for name, (df, key) in tables.items():
        joined = df.join(mapping.select(F.col(old).alias("_old"), F.col(new).alias("_new")), F.col(key) == F.col("_old"), "left")
        moved = joined.where("_new is not null").groupBy(F.lit(name).alias("table"), F.col("_old").alias(old), F.col("_new").alias(new)).agg(F.count("*").alias("n"))
        out[name] = joined.withColumn(key, F.coalesce("_new", key)).drop("_old", "_new")
        audit = moved if audit is None else audit.unionByName(moved)
    return out, audit


def sweep(rows: DataFrame, key: str, status: str, seen: str, cutoff: Column, batch: int, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows after, run log): the oldest `batch` live rows last seen before the cutoff become stale (the batch is a limit by
    design); the log has due, swept, oldest and newest of them. A dry run changes nothing."""
    due = rows.where((F.col(status) == "live") & (F.col(seen) < cutoff))
    taken = due.orderBy(seen, key).limit(batch).select(key, F.lit(True).alias("_swept"))
    after = rows.join(taken, key, "left").withColumn(status, F.when(F.col("_swept") & F.lit(not dry_run), "stale").otherwise(F.col(status)))
    log = due.join(taken, key, "left").agg(F.count("*").alias("due"), F.count_if("_swept").alias("swept"), F.min(F.when(F.col("_swept"), F.col(seen))).alias("oldest"), F.max(F.when(F.col("_swept"), F.col(seen))).alias("newest"))
    return after.drop("_swept"), log.withColumn("dry_run", F.lit(dry_run))


def keep_newest_consistent(rows: DataFrame, key: list[str], consistent: Column, bundle: Column, order: list[Column]) -> DataFrame:
    """rows with `keep`: the newest consistent row of each key, else the newest; where any row of a key is a bundle, all stay."""
    whole = Window.partitionBy(*key)
    n = F.row_number().over(whole.orderBy(F.desc(F.coalesce(consistent, F.lit(False))), *order))
    return rows.withColumn("keep", (n == 1) | F.coalesce(F.max(bundle).over(whole), F.lit(False)))


def activate(rows: DataFrame, targets: DataFrame, group: list[str], key: str) -> DataFrame:
    """rows with `is_current`: true for the one row of each group that targets (group, key) names, false for all others."""
    chosen = targets.select(*group, F.col(key).alias("_target"))
    return rows.join(chosen, group, "left").withColumn("is_current", F.coalesce(F.col(key) == F.col("_target"), F.lit(False))).drop("_target")


def merge_sourced(old: DataFrame, new: DataFrame, key: list[str], own: str, sold: str, removed: str) -> DataFrame:
    """(key, status, price, seen, source) of two histories with the columns status, price, seen and source.

    Rows of other sources than `own` stand, but for a sale: it ends the matter whoever saw it first, with its price (if there
    is one) and its time. Among own rows a removal counts unless there was a sale, a price only while the listing is live, and
    the later time. A row of one side only is taken as it is.
    """
    fields = ["status", "price", "seen", "source"]
    a, b = (df.select(*key, F.struct(*fields).alias(side)) for df, side in ((old, "_a"), (new, "_b")))
    both = a.join(b, key, "full")
    was, now = F.col("_a"), F.col("_b")
    is_ = lambda side, status: F.coalesce(side["status"] == status, F.lit(False))
    foreign = ~F.coalesce(was["source"] == own, F.lit(False))
    ended, gone = is_(was, sold) | is_(now, sold), is_(now, removed)
    priced = F.coalesce(now["price"] > 0, F.lit(False))
    live = ~gone & ~is_(was, sold) & ~is_(was, removed)
    # for each field: what the first rule that holds takes, else the old one
    taken = {
        "status": F.when(ended, F.lit(sold)).when(~foreign & gone, F.lit(removed)),
        "price": F.when(priced & (is_(now, sold) | (~foreign & live)), now["price"]),
        "seen": F.when(is_(now, sold), now["seen"]).when(~is_(was, sold) & ~foreign, F.greatest(was["seen"], now["seen"])),
        "source": F.when(~foreign, now["source"]),
    }
    alone = was.isNull() | now.isNull()
    return both.select(*key, *[F.when(alone, F.coalesce(was, now)[f]).otherwise(F.coalesce(taken[f], was[f])).alias(f) for f in fields])
