"""Joins in time: as-of, embargoed ranges and interval counts, all as equi-joins or windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shared import once, shipped


#: Days of one stretch of time: within it rows are handled in order, between stretches only its last value or sum is passed on.
STRETCH = 32
DAY = 86_400_000_000


def _stretch(when: Column, days: int) -> Column:
    return F.floor(F.unix_micros(when.cast("timestamp")) / F.lit(days * DAY))


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, tie: list[str] | None = None, strict: bool = False, grace: Column | None = None, days: int = STRETCH) -> DataFrame:
    """Each left row with the latest right row of its key at or before (strict: before) its time, plus a grace if given.

    Left rows without a match stay, with nulls; a null key matches nothing. Both sides become one stream per key and stretch of
    time, in which the last right row seen so far is carried along; the last row of each stretch goes on to the later ones. No
    pairs are compared, and a key with many rows is split by time. `tie` orders right rows of equal time.
    """
    values = [c for c in right.columns if c not in on]
    when = F.col(left_time) if grace is None else F.col(left_time) + grace
    known = right.where(F.col(right_time).isNotNull())
    for k in on:
        known = known.where(F.col(k).isNotNull())
    right_kind = right.select(F.struct(*values)).schema[0].dataType
    lefts = left.select(*on, when.alias("_t"), F.lit(0 if strict else 2).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right_kind).alias("_right"))
    rights = known.select(*on, F.col(right_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_left"), F.struct(*values).alias("_right"))
    stream = lefts.unionByName(rights).withColumn("_part", _stretch(F.col("_t"), days))
    ties = [F.col(f"_right.{c}") for c in tie or []]
    order = Window.partitionBy(*on, "_part").orderBy("_t", "_side", *ties).rowsBetween(Window.unboundedPreceding, 0)
    within = stream.withColumn("_seen", F.last("_right", ignorenulls=True).over(order)).where(F.col("_left").isNotNull())
    lasts = stream.groupBy(*on, "_part").agg(F.max_by("_right", F.when(F.col("_side") == 1, F.struct("_t", *ties))).alias("_last"))
    earlier = Window.partitionBy(*on).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = lasts.select(*on, "_part", F.last("_last", ignorenulls=True).over(earlier).alias("_before")).where(F.col("_before").isNotNull())
    found = within.join(before, [*on, "_part"], "left").withColumn("_right", F.coalesce("_seen", "_before"))
    return found.select(*[F.col(f"_left.{c}").alias(c) for c in left.columns], *[F.col(f"_right.{c}").alias(c) for c in values if c not in left.columns])


def embargo_sums(targets: DataFrame, pool: DataFrame, on: list[str], target_day: str, pool_day: str, sums: dict[str, Column], low: int, high: int) -> DataFrame:
    """For each distinct (key, day) the sums over pool rows of the key with target - low <= day < target - high.

    The pool is summed by key and day first; running sums over days and their difference at the ends of the window do the
    rest, so nothing is written out for each day of a window. Keys and days without rows give 0.
    """
    keys = targets.select(*on, F.col(target_day).alias("_at")).distinct()
    daily = pool.groupBy(*on, F.col(pool_day).alias("_day")).agg(*[v.alias(k) for k, v in sums.items()])
    ends = keys.select(*on, F.explode(F.array(F.date_sub("_at", low + 1), F.date_sub("_at", high + 1))).alias("_day")).distinct()
    upto = _running(daily, ends, on, list(sums))
    first = upto.select(*on, F.date_add("_day", low + 1).alias("_at"), *[F.col(k).alias(f"_{k}") for k in sums])
    last = upto.select(*on, F.date_add("_day", high + 1).alias("_at"), *sums)
    out = keys.join(last, [*on, "_at"]).join(first, [*on, "_at"])
    return out.select(*on, F.col("_at").alias(target_day), *[(F.col(k) - F.col(f"_{k}")).alias(k) for k in sums])


def _running(daily: DataFrame, ends: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """The sums of the columns over all days up to each of the ends (key, _day)."""
    asked = ends.select(*on, "_day", F.lit(True).alias("_asked"), *[F.lit(0).cast(daily.schema[c].dataType).alias(c) for c in columns])
    axis = daily.select(*on, "_day", F.lit(False).alias("_asked"), *columns).unionByName(asked)
    upto = Window.partitionBy(*on).orderBy("_day").rangeBetween(Window.unboundedPreceding, 0)
    return axis.select(*on, "_day", "_asked", *[F.sum(c).over(upto).alias(c) for c in columns]).where("_asked").drop("_asked")


#: Rows (day and value of one key) whose order statistics one task looks up together.
MOST_TOGETHER = 400_000
#: Rows (key and day) of medians that are sent to every task.
MOST_BROADCAST = 200_000


def embargo_median(targets: DataFrame, pool: DataFrame, on: list[str], target_day: str, pool_day: str, value: str, windows: dict[str, tuple[int, int]], most: int = MOST_TOGETHER) -> DataFrame:
    """For each distinct (key, day): the exact median_<name> and n_<name> of value over each window of days.

    A window (low, high) holds the pool rows with target - low <= day < target - high; null keys, days and values are in none.
    The pool is counted by key, day and value. A key of up to `most` such rows is one group, in which a wavelet matrix over the
    values in the order of their days gives each window its count and its middle in one step for each bit of a value's rank.
    A larger key is cut into ranges of values first: running counts by day tell which range holds the middle of a window and
    how many values stand before it, and each range is such a group. A pool row and a window move once, whatever its length.
    """
    keys = once(targets.select(*on, F.col(target_day).alias("_at")).distinct())
    v = F.col(value).cast("double")
    known = lambda df: df.na.drop(subset=on) if on else df
    rows = once(known(pool.where(v.isNotNull() & F.col(pool_day).isNotNull())).groupBy(*on, F.col(pool_day).alias("_day"), v.alias("_v")).agg(F.count("*").alias("_n")))
    spans = F.explode(F.array(*[F.struct(F.lit(k).alias("_name"), F.date_sub("_at", low).alias("_from"), F.date_sub("_at", high + 1).alias("_to")) for k, (low, high) in enumerate(windows.values())])).alias("_x")
    asks = known(keys.where("_at is not null")).select(*on, "_at", spans).select(*on, "_at", "_x.*", F.lit(None).cast("bigint").alias("_k"))
    largest = rows.groupBy(*on).count().agg(F.max("count")).first()[0] or 0
    if largest <= most:
        found = _looked_up(rows, asks, on)
    else:
        found = _looked_up_in_ranges(rows, asks, on, most, largest)
    middle = lambda k: F.avg(F.when(F.col("_name") == k, (F.col("_low") + F.col("_high")) / 2))
    whole = found.groupBy(*on, "_at").agg(*[c for k, name in enumerate(windows) for c in (middle(k).alias(f"median_{name}"), F.sum(F.when(F.col("_name") == k, F.col("_n"))).alias(f"n_{name}"))])
    out = keys.join(whole, [*on, "_at"], "left").fillna(0, [f"n_{name}" for name in windows])
    if keys.count() <= MOST_BROADCAST:  # a row for each key and day: rows that are joined to it need not move
        out = F.broadcast(out)
    return out.select(*on, F.col("_at").alias(target_day), *[c for name in windows for c in (f"median_{name}", f"n_{name}")])


def _looked_up_in_ranges(rows: DataFrame, asks: DataFrame, on: list[str], most: int, largest: int) -> DataFrame:
    """What `_looked_up` gives, for keys with more than `most` rows: by ranges of values of at most that many rows."""
    ranges = 2 * -(-largest // most)
    for _ in range(6):
        edges = sorted(set(rows.approxQuantile("_v", [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
        held = _with_place(rows, edges, "_v", "_range")
        largest = held.groupBy(*on, "_range").count().agg(F.max("count")).first()[0]
        if largest <= most or len(edges) + 1 < ranges:  # what is left is a value on many days
            break
        ranges *= 2
    names = [f"_c{i}" for i in range(len(edges) + 1)]
    daily = held.groupBy(*on, "_day").agg(*[F.sum(F.when(F.col("_range") == i, F.col("_n")).otherwise(0)).alias(c) for i, c in enumerate(names)])
    ends = asks.select(*on, F.explode(F.array(F.date_sub("_from", 1), F.col("_to"))).alias("_day")).distinct()
    upto = _running(daily, ends, on, names).select(*on, "_day", F.array(*names).alias("_c"))
    met = asks.drop("_k").join(upto.select(*on, F.col("_day").alias("_to"), F.col("_c").alias("_hi")), [*on, "_to"]).join(upto.select(*on, F.date_add("_day", 1).alias("_from"), F.col("_c").alias("_lo")), [*on, "_from"])
    counts = met.select(*on, "_at", "_name", "_from", "_to", F.zip_with("_hi", "_lo", lambda x, y: x - y).alias("_c"))
    counts = counts.withColumn("_all", F.aggregate("_c", F.lit(0).cast("bigint"), lambda s, x: s + x))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("seen"), F.lit(-1).alias("at"), F.lit(0).cast("bigint").alias("before"))

    def holds(rank: Column, place: int) -> Column:
        def step(acc: Column, x: Column) -> Column:
            here = (acc["at"] < 0) & (acc["seen"] + x > rank)
            return F.struct((acc["i"] + 1).alias("i"), (acc["seen"] + x).alias("seen"), F.when(here, acc["i"]).otherwise(acc["at"]).alias("at"), F.when(here, acc["seen"]).otherwise(acc["before"]).alias("before"))

        end = F.aggregate("_c", start, step)
        return F.struct(F.lit(place).alias("_place"), end["at"].alias("_range"), (rank - end["before"]).alias("_k"))

    both = F.explode(F.array(holds(F.floor((F.col("_all") - 1) / 2), 0), holds(F.floor(F.col("_all") / 2), 1))).alias("_r")
    wanted = counts.where("_all > 0").select(*on, "_at", "_name", "_from", "_to", "_all", both).select(*on, "_at", "_name", "_from", "_to", "_r.*", "_all")
    found = _looked_up(held, wanted, [*on, "_range"], ["_place", "_all"])
    side = lambda k: F.max(F.when(F.col("_place") == k, F.col("_low")))
    return found.groupBy(*on, "_at", "_name").agg(F.max("_all").alias("_n"), side(0).alias("_low"), side(1).alias("_high"))


def _with_place(df: DataFrame, edges: list[float], value: str, name: str) -> DataFrame:
    """df with the number of the rising edges that the value reaches; among every so many of them first, then between two."""
    step = max(1, round(len(edges) ** 0.5))
    reached = lambda xs: F.size(F.filter(xs, lambda e: e <= F.col(value)))
    rough = df.withColumn("_rough", reached(F.lit(edges[::step]))) if edges else df.withColumn("_rough", F.lit(0))
    fine = reached(F.slice(F.lit(edges), (F.col("_rough") - 1) * step + 1, step)) if edges else F.lit(0)
    return rough.withColumn(name, F.when(F.col("_rough") == 0, 0).otherwise((F.col("_rough") - 1) * step + fine)).drop("_rough")


def _looked_up(rows: DataFrame, asks: DataFrame, on: list[str], more: list[str] | None = None) -> DataFrame:
    """asks (key, _at, _name, _from, _to, _k) with _n, the rows of the key in the window, and _low, _high, the values at rank _k,
    or, where that is null, the two in the middle."""
    more = more or []
    kept = [*on, "_at", "_name", *more]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asks.select(*kept).schema) + ", _n bigint, _low double, _high double"

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        plain = lambda table, c: table.column(c).combine_chunks()
        day = lambda table, c: plain(table, c).cast(pa.int32()).to_numpy()
        matrix = Wavelet(day(left, "_day"), plain(left, "_v").to_numpy(), plain(left, "_n").to_numpy())
        first, last = matrix.between(day(right, "_from"), day(right, "_to"))
        n = matrix.upto[last] - matrix.upto[first]
        k = plain(right, "_k")
        given = k.is_valid().to_numpy(zero_copy_only=False)
        rank = k.fill_null(0).to_numpy()
        low = matrix.value(first, last, np.where(given, rank, (n - 1) // 2))
        high = matrix.value(first, last, np.where(given, rank, n // 2))
        out = right.select(kept)
        for name, column in (("_n", n), ("_low", low), ("_high", high)):
            column = pa.array(column, mask=(n == 0) & (name != "_n"))
            out = out.append_column(name, column)
        return out

    shipped(rows.sparkSession)
    # own names on one side, as both may come from the same table
    held = rows.select(*[F.col(k).alias(f"_of_{k}") for k in on], "_day", "_v", "_n").groupBy(*[f"_of_{k}" for k in on])
    return held.cogroup(asks.select(*kept, "_from", "_to", "_k").groupBy(*on)).applyInArrow(run, fields)


class Wavelet:
    """Counted values in the order of their days, with all bits of their ranks: the value of any rank among the rows of any
    stretch of days takes one look-up for each bit, for many questions at once."""

    def __init__(self, days, values, counts):
        import numpy as np

        order = np.argsort(days, kind="stable")
        self.days, counts = days[order], counts[order].astype(np.int64)
        self.values, ranks = np.unique(values[order], return_inverse=True)
        self.upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
        self.levels = []
        for bit in range(max(0, len(self.values) - 1).bit_length() - 1, -1, -1):
            one = (ranks >> bit & 1).astype(bool)
            zeros = np.concatenate((np.zeros(1, np.int64), np.cumsum(~one)))
            weight = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.where(one, 0, counts))))
            self.levels.append((bit, zeros, weight))
            ranks, counts = (np.concatenate((x[~one], x[one])) for x in (ranks, counts))

    def between(self, first, last):
        """Places of the rows from the first to the last day, both included."""
        import numpy as np

        low = np.searchsorted(self.days, first, "left")
        return low, np.maximum(low, np.searchsorted(self.days, last, "right"))

    def value(self, low, high, k):
        """The value of rank k among the rows from low on below high; anything where there are not so many."""
        import numpy as np

        rank = np.zeros(len(low), np.int64)
        for bit, zeros, weight in self.levels:
            left = weight[high] - weight[low]
            right = k >= left
            k = np.where(right, k - left, k)
            rank |= right.astype(np.int64) << bit
            low, high = (np.where(right, zeros[-1] + x - zeros[x], zeros[x]) for x in (low, high))
        return self.values[np.minimum(rank, len(self.values) - 1)] if len(self.values) else np.zeros(len(low))


#: Days that stand for all days before.
EVER = 200_000


def rolling_median(targets: DataFrame, pool: DataFrame, on: list[str], at: str, day: str, value: str, windows: dict[str, tuple[int, int]], bare: dict[str, tuple[int, int]]) -> DataFrame:
    """(key, day, anchor_<name>, n_<name>): medians over windows of days before; an empty window falls back to all days
    before its end. Windows in `bare` have no fallback. Keys without any pool row are left out."""
    spans = {**windows, **bare, **{f"{n}_ever": (EVER, embargo) for n, (_, embargo) in windows.items()}}
    found = embargo_median(targets.join(pool.select(*on).distinct(), on, "left_semi"), pool, on, at, day, value, spans)
    anchors = [F.coalesce(f"median_{n}", f"median_{n}_ever").alias(f"anchor_{n}") for n in windows] + [F.col(f"median_{n}").alias(f"anchor_{n}") for n in bare]
    return found.select(*on, at, *anchors, *[f"n_{n}" for n in (*windows, *bare)])


def hier_median(base: DataFrame, sold: DataFrame, key: str, levels: tuple[tuple[str, ...], ...], at: str, day: str, value: str, low: int, high: int, support: int) -> DataFrame:
    """(key, price, n, level): the embargoed median of the first level with enough support; else that of the last level.

    All levels are looked up together, a cohort of any level being a key of its own; a null in a cohort matches nothing."""

    def spread(df: DataFrame, *columns: str) -> DataFrame:
        # a struct with a null is written as one without the field, so such cohorts have no name
        named = [F.when(F.expr(" and ".join(f"{c} is not null" for c in cohort)), F.to_json(F.struct(*cohort))) for cohort in levels]
        return df.select(*columns, F.posexplode(F.array(*named)).alias("_level", "_cohort"))

    # rows of equal cohorts and day have one answer, which is looked up once
    columns = sorted({c for cohort in levels for c in cohort})
    kept = once(base.select(key, at, F.to_json(F.struct(*columns, at)).alias("_all"), *columns))
    asked = once(spread(kept.select("_all", at, *columns).distinct(), "_all", at))
    asks, rows = asked.count(), kept.count()
    medians = embargo_median(asked, spread(sold, day, value), ["_level", "_cohort"], at, day, value, {"x": (low, high)}).na.drop(subset=["_cohort"])
    # null-safe: a cohort without a name has no sales, but its row stays
    on = ["_level", "_cohort", at]
    found = _dealt(asked, asks, *on).join(_dealt(medians, asks, *on), on, "left").select("_all", F.col("_level").alias("level"), F.col("median_x").alias("price"), F.coalesce("n_x", F.lit(0)).alias("n"))
    enough = F.col("n") >= support
    order = F.struct(F.when(enough, 0).otherwise(1).alias("a"), F.when(enough, F.col("level")).otherwise(-F.col("level")).alias("b"), (-F.col("n")).alias("c"))
    found = found.select("_all", F.struct(order.alias("_order"), F.struct("price", "n", "level").alias("x")).alias("_best"))
    best = once(_dealt(found, asks, "_all").groupBy("_all").agg(F.min("_best").alias("_best")))
    kept = kept.select(key, "_all")
    if best.count() <= MOST_BROADCAST:
        met = kept.join(F.broadcast(best), "_all")
    else:
        met = _dealt(kept, rows, "_all").join(_dealt(best, rows, "_all"), "_all")
    return _dealt(met, rows, key).groupBy(key).agg(F.min("_best").alias("_best")).select(key, "_best.x.*")


def _dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by its keys over a task for each MOST_TOGETHER rows, where the session's partitions are fewer."""
    tasks = -(-rows // MOST_TOGETHER)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def speed_series(calendar: DataFrame, sold: DataFrame, on: list[str], at: str, day: str, duration: str, rates: dict[str, int], window: int, half_life: float) -> DataFrame:
    """For each calendar day and key with sales in the window before it: n, weighted shares of durations up to each limit,
    median duration, effective number, first and last sale.

    A weight that halves with time is a factor of the day of sale and one of the calendar day, so that running sums over days
    give every window as a difference of two; nothing is written out for the days of a window. The rows in work are the days
    with sales and, for each key, the days of the calendar.
    """
    d, h = F.col(duration), F.lit(half_life)
    sold = once(sold.select(*on, day, duration))
    known = sold.where(F.col(day).isNotNull()).na.drop(subset=on)
    days = known.groupBy(*on, F.col(day).alias("_day")).agg(F.count("*").alias("_n"), *[F.count_if(d <= most).alias(f"_{name}") for name, most in rates.items()])
    dates = F.broadcast(calendar.agg(F.collect_set(F.col(at)).alias("_all"), F.max(at).alias("_origin")))
    # later days have the larger factor: what has left the window is small beside what is in it
    weight = F.pow(F.lit(2.0), F.datediff("_day", "_origin") / h)
    sums = ["_n", "_w1", "_w2", *[f"_{name}" for name in rates]]
    weighed = days.join(dates).select(*on, "_day", F.col("_n"), (weight * F.col("_n")).alias("_w1"), (weight * weight * F.col("_n")).alias("_w2"), *[(weight * F.col(f"_{name}")).alias(f"_{name}") for name in rates])
    grid = known.select(*on).distinct().join(dates).select(*on, F.explode("_all").alias("_at"))
    # one axis for each key: days with sales, and both ends of the window of each calendar day
    ends = grid.select(*on, "_at", F.explode(F.array(F.struct(F.date_sub("_at", window + 1).alias("_day"), F.lit(False).alias("_upper")), F.struct(F.date_sub("_at", 1).alias("_day"), F.lit(True).alias("_upper")))).alias("_x")).select(*on, "_at", "_x.*")
    axis = weighed.withColumn("_sold", F.col("_day")).unionByName(ends, allowMissingColumns=True)
    order = Window.partitionBy(*on).orderBy(F.unix_date("_day"))
    upto = order.rangeBetween(Window.unboundedPreceding, 0)
    # the days after, backwards: a frame that grows is summed up once, one that shrinks anew for each row
    later = Window.partitionBy(*on).orderBy(F.unix_date("_day").desc()).rangeBetween(Window.unboundedPreceding, -1)
    run = axis.select(*on, "_at", "_upper", *[F.sum(c).over(upto).alias(c) for c in sums], F.max("_sold").over(upto).alias("_last"), F.min("_sold").over(later).alias("_first")).where("_at is not null")
    upper = F.col("_upper")
    apart = lambda c: F.sum(F.when(upper, F.col(c)).otherwise(-F.col(c)))
    # a window that holds a sale holds the last one before its end and the first one after its beginning
    found = run.groupBy(*on, "_at").agg(*[apart(c).alias(c) for c in sums], F.max(F.when(upper, F.col("_last"))).alias("last_sold"), F.max(F.when(~upper, F.col("_first"))).alias("first_sold")).where("_n > 0")
    medians = embargo_median(grid, sold, on, "_at", day, duration, {"x": (window, 0)}).select(*on, "_at", F.col("median_x").alias("median_days"))
    out = found.join(medians, [*on, "_at"])
    return out.select(*on, F.col("_at").alias(at), F.col("_n").alias("n"), *[(F.col(f"_{name}") / F.col("_w1")).alias(name) for name in rates], (F.col("_w1") * F.col("_w1") / F.col("_w2")).alias("n_eff"), "first_sold", "last_sold", "median_days")


def prior_stats(rows: DataFrame, asked: DataFrame, part: str, kind: str, day: str, at: str, alpha: float, kinds: int) -> DataFrame:
    """asked (part, kind, at) with what the rows (part, kind, day) of the days before show: n_before, share in the part and in
    all (smoothed by alpha), rarity, place, and entropy and diversity of the part.

    Running counts have a row for each day on which one changes: of a kind in a part, of a part, of a kind and of all. A row
    that is asked for takes the last one before its day, so work grows with the changes and with what is asked. The entropy of
    a part is kept up by the change of (n + alpha) ln(n + alpha) of the one kind that changes. Kinds of a part are those asked.
    """
    counts = rows.groupBy(part, kind, day).agg(F.count("*").alias("n"))

    def running(table: DataFrame, keys: list[str], column: str = "n") -> DataFrame:
        daily = table.groupBy(*keys, day).agg(F.sum(column).alias("_x"))
        order = Window.partitionBy(*keys).orderBy(day) if keys else Window.partitionBy(F.lit(0)).orderBy(day)  # one row a day
        return daily.select(*keys, day, F.sum("_x").over(order).alias("_upto"))

    def before(frame: DataFrame, table: DataFrame, keys: list[str], name: str, column: str = "n") -> DataFrame:
        ends = cells.select(*keys, at).distinct()  # not from the frame, whose plan would be in there twice
        found = asof_join(ends, running(table, keys, column).withColumnRenamed("_upto", name), keys, at, day, strict=True).select(*keys, at, F.coalesce(name, F.lit(0)).alias(name))
        return frame.join(found, [*keys, at])

    cells = asked.select(part, kind, at).distinct()
    sizes = cells.select(part, kind).distinct().groupBy(part).agg(F.count("*").alias("_k"))
    upto = F.sum("n").over(Window.partitionBy(part, kind).orderBy(day))
    weigh = lambda n: (n + alpha) * F.ln(n + alpha)
    changes = counts.join(cells.select(part, kind).distinct(), [part, kind], "left_semi").select(part, kind, day, "n", upto.alias("_upto")).withColumn("_change", weigh(F.col("_upto")) - weigh(F.col("_upto") - F.col("n")))
    out = before(cells, counts, [part, kind], "n_before")
    out = before(out, counts, [part], "_part")
    out = before(out, changes, [part], "_heat", "_change")
    out = before(out, counts, [kind], "_kind")
    out = before(out, counts, [], "_all").join(sizes, part)
    whole = F.col("_part") + alpha * F.col("_k")
    share = (F.col("n_before") + alpha) / whole
    entropy = F.ln(whole) - (F.col("_heat") + F.col("_k") * alpha * F.ln(F.lit(alpha))) / whole
    places = F.dense_rank().over(Window.partitionBy(part, at).orderBy(F.desc("n_before"))).cast("bigint")
    return out.select(part, kind, at, "n_before", share.alias("share"), ((F.col("_kind") + alpha) / (F.col("_all") + alpha * kinds)).alias("global_share"), (-F.ln(F.greatest(share, F.lit(1e-12)))).alias("rarity"), places.alias("place"), entropy.alias("entropy"), F.exp(entropy).alias("diversity"))


def active_count(points: DataFrame, intervals: DataFrame, group: list[str], at: str, start: str, end: str, days: int = STRETCH) -> DataFrame:
    """points with n_active: how many intervals [start, end] of the group hold the point.

    Running sums within stretches of time, plus the sum of all stretches before; no pairs.
    """
    asked = points.select(*group, F.col(at).alias("_t")).distinct()
    events = (
        intervals.select(*group, F.col(start).alias("_t"), F.lit(0).alias("_side"), F.lit(1).alias("_d"))
        .unionByName(intervals.select(*group, F.col(end).alias("_t"), F.lit(2).alias("_side"), F.lit(-1).alias("_d")))
        .groupBy(*group, "_t", "_side").agg(F.sum("_d").alias("_d"))
        .unionByName(asked.select(*group, "_t", F.lit(1).alias("_side"), F.lit(0).cast("bigint").alias("_d")))
    ).withColumn("_part", _stretch(F.col("_t"), days))
    order = Window.partitionBy(*group, "_part").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = events.groupBy(*group, "_part").agg(F.sum("_d").alias("_d")).select(*group, "_part", F.coalesce(F.sum("_d").over(earlier), F.lit(0)).alias("_before"))
    within = events.withColumn("_within", F.sum("_d").over(order)).where("_side = 1")
    counted = within.join(before, [*group, "_part"]).select(*group, F.col("_t").alias(at), (F.col("_within") + F.col("_before")).alias("n_active"))
    return points.join(counted, [*group, at])


def trailing_strict(df: DataFrame, on: list[str], time: str, value: str, days: int) -> DataFrame:
    """df with count, mean and maximum of value over the `days` days before each row's time, the time itself excluded.

    Time is cut into stretches of that length; a row is seen in its own stretch and in the next one, so a key with many rows
    (or no key at all) is spread over tasks, and each row moves twice.
    """
    own = _stretch(F.col(time), days)
    seen = df.select("*", own.alias("_own"), F.explode(F.array_distinct(F.array(own, own + 1))).alias("_part"))
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    order = Window.partitionBy(*on, "_part").orderBy(micros).rangeBetween(-days * DAY, -1)
    out = seen.select("*", F.count(value).over(order).alias("n_before"), F.avg(value).over(order).alias("mean_before"), F.max(value).over(order).alias("max_before"))
    return out.where(F.col("_own").eqNullSafe(F.col("_part"))).drop("_own", "_part")


def latest_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def dimension_fallback(df: DataFrame, primary: DataFrame, secondary: DataFrame, key: str, second_key: str, value: str, default: Column) -> DataFrame:
    """df with value from the primary map, else the secondary one, else the default, and `matched` saying which."""
    first = primary.select(key, F.col(value).alias("_a"))
    second = secondary.select(second_key, F.col(value).alias("_b"))
    joined = df.join(first, key, "left").join(second, second_key, "left")
    how = F.when(F.col("_a").isNotNull(), "primary").when(F.col("_b").isNotNull(), "secondary").otherwise("default")
    return joined.select(*df.columns, F.coalesce("_a", "_b", default).alias(value), how.alias("matched"))


def wide_join(base: DataFrame, key: list[str], surfaces: dict[str, DataFrame]) -> DataFrame:
    """base with the columns of every surface, prefixed by its name."""
    for prefix, surface in surfaces.items():
        base = base.join(surface.select(*key, *[F.col(c).alias(f"{prefix}__{c}") for c in surface.columns if c not in key]), key, "left")
    return base


def null_safe_diff(a: DataFrame, b: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Keys whose columns differ, or that one side lacks; nulls are equal to nulls."""
    left = a.select(*key, F.struct(*columns).alias("_a"))
    right = b.select(*key, F.struct(*columns).alias("_b"))
    return left.join(right, key, "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*key, F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").otherwise("differs").alias("state"))


def map_alias(df: DataFrame, column: str, aliases: DataFrame, default: str) -> DataFrame:
    """df with `meaning`: what the table (alias, meaning) says of the column, the default where it says nothing."""
    known = aliases.select(F.col("alias").alias("_alias"), F.col("meaning").alias("_meaning"))
    return df.join(known, df[column] == known["_alias"], "left").withColumn("meaning", F.coalesce("_meaning", F.lit(default))).drop("_alias", "_meaning")


def band_points(df: DataFrame, names: dict[str, str], bands: DataFrame, most: int = 100_000) -> DataFrame:
    """df with `points`: the sum of what a long table (name, value, points) gives for each named column, 0 where it has
    nothing. The table becomes one row of maps, sent to all tasks, so that rows stay where they are; a table of more than
    `most` rows raises."""
    held = bands.where(F.col("name").isin(*names))
    if held.count() > most:
        raise ValueError(f"more than {most} bands")
    pairs = F.map_from_entries(F.collect_list(F.when(F.col("value").isNotNull(), F.struct(F.concat_ws("=", "name", "value").alias("k"), F.col("points").alias("p")))))
    one = held.agg(pairs.alias("_map"))
    total = F.lit(0).cast("bigint")
    for name, column in names.items():
        total = total + F.coalesce(F.try_element_at("_map", F.concat_ws("=", F.lit(name), F.col(column))), F.lit(0))
    return df.join(F.broadcast(one)).withColumn("points", total).drop("_map")
