"""Exact quantiles and ranks of groups of any size: no task holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shared import shared_path

#: Rows of a group that one task may sort.
MOST = 1_000_000
#: Parts that a bracket is cut into.
PARTS = 64


def quantiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]], most: int = MOST) -> DataFrame:
    """(by, names): for each name (column, share) the exact quantile of the group, between two values in proportion.

    Groups of up to `most` values are sorted by the task that has them. The others are only counted: a sketch of the values in
    a bracket proposes cuts, exact counts tell the part that holds the rank, and that part is the next bracket, until it has
    `most` values or one. A pass reads the table and moves some counts; what is sorted in the end is the last bracket. There
    are no more such groups than rows / `most`. Groups are those with any row; a group without a value has nulls. A null key
    is a group.
    """
    columns = sorted({c for c, _ in wanted.values()})
    values = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    sizes = values.groupBy(*by).agg(*[F.count(c).alias(f"_n_{c}") for c in columns])
    large = F.greatest(*[F.col(f"_n_{c}") for c in columns], F.lit(0)) > most
    big = sizes.where(large).collect()
    plain = [F.percentile(c, q).alias(name) for name, (c, q) in wanted.items()]
    if not big:
        return values.groupBy(*by).agg(*plain)
    spark = df.sparkSession
    # a group of a million rows each: few, and each a row here
    keys = F.broadcast(spark.createDataFrame([tuple(r[k] for k in by) + (i,) for i, r in enumerate(big)], values.select(*by, F.lit(0).alias("_g")).schema)) if by else None
    if by:
        marked = values.join(keys.select("_g", *[F.col(k).alias(f"_k_{k}") for k in by]), [values[k].eqNullSafe(F.col(f"_k_{k}")) for k in by], "left").select(*values.columns, "_g")
    else:
        marked = values.withColumn("_g", F.lit(0))
    asks = []
    for g, r in enumerate(big):
        for name, (c, q) in wanted.items():
            n = r[f"_n_{c}"]
            if n:
                place = q * (n - 1)
                asks += [{"g": g, "name": name, "side": side, "column": c, "rank": rank, "low": None, "high": None, "count": n} for side, rank in enumerate((int(place), min(n - 1, int(place) + 1)))]
    ranked = {(a["g"], a["column"], a["rank"]): a for a in asks}
    found = _selected(marked.where("_g is not null"), list(ranked.values()), most)
    rows = []
    for g, r in enumerate(big):
        out = []
        for c, q in wanted.values():
            n = r[f"_n_{c}"]
            if not n:
                out.append(None)
                continue
            place = q * (n - 1)
            low, high = (found[g, c, k] for k in (int(place), min(n - 1, int(place) + 1)))
            out.append(low + (high - low) * (place - int(place)))
        rows.append(tuple(r[k] for k in by) + tuple(out))
    small = marked.where("_g is null").groupBy(*by).agg(*plain) if by else None
    held = spark.createDataFrame(rows, values.select(*by, *[F.lit(0.0).alias(name) for name in wanted]).schema if small is None else small.schema)
    return held if small is None else small.unionByName(held)


def _selected(marked: DataFrame, asks: list[dict], most: int) -> dict:
    """{(g, column, rank): value} of asks (g, column, rank, count); brackets are open below and closed above."""
    spark, found = marked.sparkSession, {}
    while asks:
        table = F.broadcast(spark.createDataFrame([(i, a["g"], a["column"], a["low"], a["high"]) for i, a in enumerate(asks)], "_i int, _g int, _c string, _low double, _high double"))
        columns = sorted({a["column"] for a in asks})
        long = marked.select("_g", F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).alias("_v")) for c in columns])).alias("_x")).select("_g", "_x.*").where("_v is not null")
        inside = long.join(table, ["_g", "_c"]).where("(_low is null or _v > _low) and (_high is null or _v <= _high)")
        if all(a["count"] <= most for a in asks):
            counted = inside.groupBy("_i", "_v").agg(F.count("*").alias("_n"))
            ranks = F.create_map(*[F.lit(x) for i, a in enumerate(asks) for x in (i, a["rank"])])
            upto = F.sum("_n").over(Window.partitionBy("_i").orderBy("_v"))
            at = counted.select("_i", "_v", (upto - F.col("_n")).alias("_from"), upto.alias("_to")).where((ranks[F.col("_i")] >= F.col("_from")) & (ranks[F.col("_i")] < F.col("_to")))
            for r in at.collect():
                a = asks[r["_i"]]
                found[a["g"], a["column"], a.get("key", a["rank"])] = r["_v"]
            break
        cuts = {r["_i"]: sorted(set(r["cuts"])) for r in inside.groupBy("_i").agg(F.percentile_approx("_v", [i / PARTS for i in range(1, PARTS)], 20 * PARTS).alias("cuts")).collect()}
        edges = F.broadcast(spark.createDataFrame(list(cuts.items()), "_i int, _cuts array<double>"))
        parts = inside.join(edges, "_i").select("_i", "_v", F.size(F.filter("_cuts", lambda e: e < F.col("_v"))).alias("_p")).groupBy("_i", "_p").agg(F.count("*").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        by_ask: dict = {}
        for r in parts.collect():
            by_ask.setdefault(r["_i"], []).append(r)
        after = []
        for i, a in enumerate(asks):
            before = 0
            for r in sorted(by_ask[i], key=lambda r: r["_p"]):
                if a["rank"] < before + r["n"]:
                    break
                before += r["n"]
            key = a.get("key", a["rank"])
            if r["least"] == r["most"]:
                found[a["g"], a["column"], key] = r["least"]
                continue
            at, ends = r["_p"], cuts[i]
            after.append({**a, "key": key, "rank": a["rank"] - before, "count": r["n"], "low": ends[at - 1] if at else a["low"], "high": ends[at] if at < len(ends) else a["high"]})
        asks = after
    return found


def numbered(df: DataFrame, by: list[str], order: list[Column], partitions: int | None = None) -> DataFrame:
    """df with `place` (1, 2, ... within its group in the given order) and `size` (rows of the group).

    Rows are dealt by ranges of (group, order) and sorted side by side; a row's place is its place within its range plus the
    rows of its group in the ranges before. A group is spread over as many ranges as its share of the rows asks for. Rows that
    the order leaves equal have places of any order among them.
    """
    spark = df.sparkSession
    shared_path(spark, "numbered")  # ranges are fixed by a checkpoint
    ranges = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(k) for k in by]
    dealt = df.repartitionByRange(ranges, *keys, *order).sortWithinPartitions(*keys, *order)
    placed = dealt.withColumn("_m", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_m", 33)
    pieces = placed.groupBy(*by, part.alias("_part")).agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    pieces = pieces.select(*[F.col(k).alias(f"_k_{k}") for k in by], "_part", "_first", F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(group).alias("size"))
    same = placed.withColumn("_at", part)
    met = F.col("_at") == F.col("_part")
    for k in by:
        met = met & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = same.join(pieces, met)
    return joined.select(*df.columns, (F.col("_m") - F.col("_first") + F.col("_before") + 1).alias("place"), "size")


def tile(place: Column, size: Column, tiles: int) -> Column:
    """The tile of a place when `size` rows are dealt to tiles of equal size, the first ones getting what is left over."""
    base, extra = F.floor(size / tiles), size % tiles
    wide = extra * (base + 1)
    return F.when(place <= wide, F.floor((place - 1) / (base + 1)) + 1).otherwise(F.floor((place - 1 - wide) / F.greatest(base, F.lit(1))) + extra + 1).cast("bigint")
