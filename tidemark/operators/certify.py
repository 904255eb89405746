"""Certification: hashes of days and definitions, drift and its policies, contracts, registries and chains of rebuilds."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import null_safe_diff
from tidemark.shared import shared_path


class NotCertified(RuntimeError):
    """A surface may not be read, or a check of it failed."""


def day_hashes(df: DataFrame, day: Column, order: list[str], columns: list[Column], sample: int) -> DataFrame:
    """(day, n, hash, hash_of_rows): two hashes of the first `sample` rows of each day by `order`, all days in one job.

    `hash` is taken over the hashes of the rows, `hash_of_rows` over the rows themselves, one to a line.
    """
    rows = df.select(day.alias("day"), F.struct(*order).alias("_at"), F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]).alias("_row"))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("day").orderBy("_at", "_row"))).where(F.col("_n") <= sample)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("_n", "_row"))), lambda x: x["_row"])
    lists = first.groupBy("day").agg(F.count("*").alias("n"), ordered.alias("_rows"))
    return lists.select("day", "n", F.sha2(F.array_join(F.transform("_rows", lambda r: F.sha2(r, 256)), ""), 256).alias("hash"), F.sha2(F.array_join("_rows", "\n"), 256).alias("hash_of_rows"))


#: Keys of one leaf of a hash tree, and children of one node.
WIDTH = 1000


def leaf_hashes(df: DataFrame, by: list[str], key: str, width: int = WIDTH) -> DataFrame:
    """(by, part, n, hash): a hash of the keys of each range of `width` whole numbers, in order; null keys are in none."""
    keys = df.where(F.col(key).isNotNull()).select(*by, F.floor(F.col(key) / width).cast("bigint").alias("part"), F.col(key).alias("_key"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("_key")), lambda k: k.cast("string")), ",")
    return keys.groupBy(*by, "part").agg(F.count("*").alias("n"), F.sha2(text, 256).alias("hash"))


def root_hashes(leaves: DataFrame, by: list[str], levels: int = 2, width: int = WIDTH) -> DataFrame:
    """(by, hash): leaves hashed in the order of their ranges, `width` neighbours to a node and level, all nodes into the root.

    No node holds more than `width` hashes but the root, which holds one for each width ** levels keys."""
    nodes = leaves.select(*by, "part", "hash")
    joined = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "hash"))), lambda x: x["hash"]), ""), 256)
    for _ in range(levels - 1):
        nodes = nodes.withColumn("_up", F.floor(F.col("part") / width).cast("bigint")).groupBy(*by, "_up").agg(joined.alias("hash")).withColumnRenamed("_up", "part")
    return nodes.groupBy(*by).agg(joined.alias("hash"))


def drifted_ranges(baseline: DataFrame, current: DataFrame, by: list[str]) -> DataFrame:
    """(by, part, was, now): the ranges of keys whose leaves differ, came or went."""
    was, now = (df.select(*by, "part", F.col("hash").alias(name)) for df, name in ((baseline, "was"), (current, "now")))
    return was.join(now, [*by, "part"], "full").where(~F.col("was").eqNullSafe(F.col("now")))


#: Expressions of a plan that make a surface differ from one reading to the next.
MOVING = ("CurrentDate", "CurrentTimestamp", "Now", "LocalTimestamp", "CurrentBatchTimestamp", "CurrentTime", "Rand", "Randn", "Uuid", "MonotonicallyIncreasingID", "InputFileName")


def _nodes(plan):
    """A plan's nodes with those of its subqueries, from the top."""
    yield plan
    for part in (plan.children(), plan.subqueries() if hasattr(plan, "subqueries") else None):
        if part is not None:
            for i in range(part.size()):
                yield from _nodes(part.apply(i))


def _expressions(expression):
    yield expression
    inner = expression.children()
    for i in range(inner.size()):
        yield from _expressions(inner.apply(i))


def plan_tokens(df: DataFrame, moving: tuple[str, ...] = MOVING) -> list[str]:
    """The expressions of the analysed plan, views within views and subqueries included, that depend on when or where it runs."""
    found = set()
    for node in _nodes(df._jdf.queryExecution().analyzed()):
        own = node.expressions()
        for i in range(own.size()):
            for e in _expressions(own.apply(i)):
                name = e.getClass().getSimpleName().rstrip("$")
                if name in moving:
                    found.add(name)
    return sorted(found)


def plan_hash(df: DataFrame) -> str:
    """One hash of what a surface computes: the analysed plan in canonical form and the places and columns that it reads.

    Names given to columns on the way do not count, those that come out do."""
    plan = df._jdf.queryExecution().analyzed()
    lines = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields]
    for node in _nodes(plan.canonicalized()):
        own = node.expressions()
        lines.append(f"{node.nodeName()} {[own.apply(i).canonicalized().toString() for i in range(own.size())]}")
    for node in _nodes(plan):
        if node.getClass().getSimpleName() == "LogicalRelation" and hasattr(node.relation(), "location"):
            roots = node.relation().location().rootPaths()
            lines.append(f"reads {sorted(roots.apply(i).toString() for i in range(roots.size()))} {node.schema().simpleString()}")
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def require_fixed(df: DataFrame) -> DataFrame:
    """df, if nothing in its plan depends on when it runs; raises NotCertified otherwise."""
    if found := plan_tokens(df):
        raise NotCertified(f"the plan holds {', '.join(found)}")
    return df


def drift(baseline: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """(key, was, now, drifted) for the keys of both; a hash that one side lacks is drift."""
    joined = baseline.select(key, F.col(value).alias("was")).join(current.select(key, F.col(value).alias("now")), key, "full")
    return joined.withColumn("drifted", ~F.col("was").eqNullSafe(F.col("now")))


def newest(df: DataFrame, day: str, days: int) -> DataFrame:
    """The newest `days` distinct values of a day column (a report's limit)."""
    return df.select(day).distinct().orderBy(F.desc(day)).limit(days)


def rebaseline(baseline: DataFrame, current: DataFrame, day: str, value: str, days: int) -> DataFrame:
    """The baseline with the hashes of the newest days of current in place of its own; days that it lacks are added."""
    fresh = current.join(newest(current, day, days), day, "left_semi").select(day, F.col(value).alias("_new"))
    return baseline.select(day, value).join(fresh, day, "full").select(day, F.coalesce("_new", value).alias(value), F.col("_new").isNotNull().alias("rebaselined"))


def apply_drift_policy(baseline: DataFrame, current: DataFrame, day: str, value: str, policy: str, days: int) -> DataFrame:
    """(day, drifted, hash): what holds after a check of the newest days under a policy.

    `fail` raises NotCertified if any of them drifted, `allow` keeps the baseline, `rebaseline` takes the current hash.
    """
    if policy not in ("fail", "allow", "rebaseline"):
        raise ValueError(f"unknown policy {policy}")
    checked = drift(baseline.join(newest(current, day, days), day, "left_semi"), current.join(newest(current, day, days), day, "left_semi"), day, value)
    if policy == "fail" and (n := checked.where("drifted").count()):
        raise NotCertified(f"{n} of the newest {days} days drifted")
    kept = F.when(F.col("drifted"), F.col("now")).otherwise(F.col("was")) if policy == "rebaseline" else F.col("was")
    return checked.select(day, "drifted", kept.alias(value))


def definition_hashes(definitions: DataFrame, name: str, body: str) -> DataFrame:
    """(name, hash): hash of each definition in lower case with white space folded; a null one has no hash."""
    return definitions.select(name, F.sha2(F.trim(F.regexp_replace(F.lower(body), r"\s+", " ")), 256).alias("hash"))


def definition_drift(baseline: DataFrame, current: DataFrame, name: str) -> DataFrame:
    """Names whose definition hash changed, came or went."""
    return null_safe_diff(baseline, current, [name], ["hash"])


def tokens_found(definitions: DataFrame, name: str, body: str, tokens: list[str]) -> DataFrame:
    """(name, tokens): the definitions that contain any of the tokens as a whole word, in any case, and which.

    A text is put into lower case once, and only what contains a token is searched for it as a word. \u0130 is an i, as in the SQL."""

    def found(text: Column, token: str) -> Column:
        word = re.escape(token)
        return F.contains(text, F.lit(token)) & F.regexp_like(text, F.lit(rf"{word}(?<![a-z0-9_]{word})(?![a-z0-9_])"))

    # exploded, as a filter on a plain column is pushed below it, where each token puts the text into lower case anew
    low = F.array(F.lower(F.replace(F.col(body), F.lit("\u0130"), F.lit("i"))))
    hits = F.transform(low, lambda text: F.array_join(F.array_compact(F.array(*[F.when(found(text, t.lower()), F.lit(t)) for t in tokens])), ","))
    return definitions.select(name, F.explode(hits).alias("tokens")).where("tokens != ''")


def sla_gate(df: DataFrame, columns: list[str], finished: str, t0: str, hours: int = 24) -> DataFrame:
    """df with all the columns null where the evidence was finished after t0 + hours; evidence without a time is inside."""
    inside = F.coalesce(F.col(finished) <= F.col(t0) + F.expr(f"INTERVAL {hours} HOURS"), F.col(finished).isNull(), F.lit(False))
    return df.withColumns({c: F.when(inside, F.col(c)) for c in columns})


def sla_leaks(df: DataFrame, columns: list[str], finished: str, t0: str, hours: int = 24) -> DataFrame:
    """Rows outside the SLA that have a value in any of the gated columns."""
    outside = F.col(finished) > F.col(t0) + F.expr(f"INTERVAL {hours} HOURS")
    return df.where(F.coalesce(outside, F.lit(False)) & (F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()))


def invariants(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(name, n): how many rows break each rule, in one pass."""
    one = df.agg(*[F.count_if(r).alias(f"_{i}") for i, r in enumerate(rules.values())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(f"_{i}").alias("n")) for i, k in enumerate(rules)])).alias("x")).select("x.*")


def check_schema(df: DataFrame, contract: list[tuple[str, str, bool]]) -> DataFrame:
    """(place, name, expected, found, nulls, ok) for the rows (name, type, nullable) of a contract.

    A column must be there, of its type, and without nulls where the contract says so.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    nulls = [(F.count_if(F.col(f"`{n}`").isNull()) if n in kinds else F.lit(None).cast("bigint")).alias(f"_{i}") for i, (n, _, _) in enumerate(contract)]
    one = df.agg(F.count("*").alias("_rows"), *nulls)
    rows = []
    for i, (name, kind, nullable) in enumerate(contract):
        found = kinds.get(name)
        fits = F.lit(found == kind) & (F.lit(nullable) | (F.col(f"_{i}") == 0))
        rows.append(F.struct(F.lit(i).alias("place"), F.lit(name).alias("name"), F.lit(kind).alias("expected"), F.lit(found).cast("string").alias("found"), F.col(f"_{i}").alias("nulls"), F.coalesce(fits, F.lit(False)).alias("ok")))
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def contract_hash(contract: list[tuple[str, str, bool]]) -> Column:
    """One hash of an ordered contract."""
    return F.sha2(F.lit("\n".join(f"{i}|{n}|{k}|{'null' if m else 'not null'}" for i, (n, k, m) in enumerate(contract))), 256)


def contract_select(df: DataFrame, contract: list[tuple[str, str]]) -> DataFrame:
    """The columns of an ordered contract of (name, expression)."""
    return df.select(*[F.expr(e).alias(n) for n, e in contract])


def registry_state(registry: DataFrame, needed: DataFrame, entrypoint: str, as_of: datetime, max_age: timedelta, drifted: DataFrame | None = None) -> DataFrame:
    """(entrypoint, state) of every needed surface: certified, missing, not_certified, expired or drifted.

    registry has the columns status and certified_at; drifted names surfaces whose definition changed.
    """
    cut = F.lit(as_of - max_age).cast("timestamp_ntz")
    rows = needed.select(entrypoint).distinct().join(registry.select(entrypoint, "status", "certified_at"), entrypoint, "left")
    changed = F.lit(False)
    if drifted is not None:
        rows = rows.join(drifted.select(entrypoint, F.lit(True).alias("_changed")).distinct(), entrypoint, "left")
        changed = F.coalesce("_changed", F.lit(False))
    state = F.when(F.col("status").isNull(), "missing").when(F.col("status") != "CERTIFIED", "not_certified").when(F.coalesce(F.col("certified_at") < cut, F.lit(True)), "expired").when(changed, "drifted").otherwise("certified")
    return rows.select(entrypoint, state.alias("state"))


def require_certified(registry: DataFrame, surface: DataFrame, entrypoint: str, name: object, as_of: datetime, max_age: timedelta, drifted: DataFrame | None = None) -> DataFrame:
    """surface, if its registry entry is certified and young enough; raises NotCertified otherwise."""
    needed = registry.sparkSession.createDataFrame([(name,)], registry.select(entrypoint).schema)
    state = registry_state(registry, needed, entrypoint, as_of, max_age, drifted).first()["state"]
    if state != "certified":
        raise NotCertified(f"{name} is {state}")
    return surface


def require_all(registry: DataFrame, needed: DataFrame, entrypoint: str, as_of: datetime, max_age: timedelta, drifted: DataFrame | None = None) -> None:
    """Raises NotCertified if any needed surface may not be read, and says how many in which state."""
    states = registry_state(registry, needed, entrypoint, as_of, max_age, drifted).where("state != 'certified'").groupBy("state").count().collect()
    if states:
        raise NotCertified(", ".join(f"{r['count']} {r['state']}" for r in sorted(states)))


Step = Callable[[dict[str, DataFrame]], DataFrame]


def refresh_chain(spark: SparkSession, steps: dict[str, Step], rules: dict[str, dict[str, Column]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables of all steps, and (surface, name, n) of the broken rules.

    Each step is built from the tables before it, written to the shared folder and read again; then its rules are checked.
    """
    folder, tables, checks = shared_path(spark, "refresh"), {}, None
    for name, build in steps.items():
        build(tables).write.mode("overwrite").parquet(f"{folder}/{name}")
        tables[name] = spark.read.parquet(f"{folder}/{name}")
        broken = invariants(tables[name], {"rows": F.lit(True), **rules.get(name, {})}).select(F.lit(name).alias("surface"), "name", "n")
        checks = broken if checks is None else checks.unionByName(broken)
    return tables, checks


def artifact_ready(cuts: DataFrame, bands: DataFrame, final: Column, group: str, least: int) -> DataFrame:
    """(final_rows, groups, ready): exactly one final row of cuts, and at least so many groups of bands."""
    one = cuts.agg(F.count_if(final).alias("final_rows"))
    groups = bands.agg(F.count_distinct(group).alias("groups"))
    return one.join(F.broadcast(groups)).withColumn("ready", (F.col("final_rows") == 1) & (F.col("groups") >= least))
