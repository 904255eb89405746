"""Mixing sources to target weights with pivotal dependent rounding.

Every source has a target number of words. Its documents should be taken target / size times on average; the whole part of
that is taken by each document, the fractional part is a probability. Pivotal rounding pairs two documents and moves
probability from one to the other at random until one of the two is 0 or 1, so the expected number of copies of each document
and the number of copies of a source are kept. Documents of like size form classes; the number of copies of a class is a whole one, chosen
so that the words of the source come out. The blocks of a class are rounded side by side; each leaves at most one fractional
document, and these residuals meet level by level, in a tree, until one is left, which is integral then. All of it is Spark columns: a block is an array, rounded by a fold.

Draws are hashes of a seed, the block and the place in it, so reruns agree. A null text has size 0; documents of size 0 have
the whole copies of their source, which take no words. Null sources are one source, the last. Ids may be of any type and repeat; every row is an item of its own and is put
in a block by a hash of its id and of its number among equal rows. Extra columns are ignored by `mix` and kept by
`mixed_documents`. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import checkpointed

WEIGHTS = (1, 2, 3)
#: Most copies of a document, and so of a source.
MOST = 3
BLOCK = 96
SEED = 20
#: Sources up to which their table is sent to all tasks; beyond, it is joined by key.
SMALL = 20_000
CLOSE = 1e-7


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def numbered_sources(per: DataFrame) -> DataFrame:
    """per with `number`, the place of each source by code point (null last): places within ranges of sources, plus what the
    ranges before have. Only the counts of the ranges meet in one task."""
    ranged = per.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = checkpointed(ranged.withColumn("at", F.monotonically_increasing_id()))
    placed = placed.select("*", F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("within"))
    counts = placed.groupBy("range").agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(counts.select("range", before.alias("before")), "range").withColumn("number", F.col("before") + F.col("within")).drop("at", "range", "within", "before")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, rounds: int = 1000) -> DataFrame:
    """(source, source_size, n_docs, target): shares by weight of all words, capped at `most` times the source's size.

    Each round shares what the capped sources leave by weight; that level only rises, until no further source is above.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights)).cast("int") + 1).cast("bigint")
    rows = checkpointed(numbered_sources(per).withColumn("weight", weight).withColumn("cap", most * F.col("source_size")))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    for _ in range(rounds):
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        n, taken, share = rows.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not share:
            break
        capped, level = n, (total - (taken or 0)) / share
    else:
        raise RuntimeError(f"the targets did not settle in {rounds} rounds")
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level))
    return rows.select("source", "source_size", "n_docs", target.alias("target"))


def _draw(*parts: Column) -> Column:
    """A number from 0 to 1 that depends on the parts alone."""
    scale = 1 << 52
    return F.pmod(F.xxhash64(*parts), F.lit(scale)) / F.lit(float(scale))


def _round_block(items: Column, level: int, block: list[Column], kind: str) -> Column:
    """Fold over (size, id, j, p): struct(own: the fractional item so far, done: array of decided items with `up`).

    own is null while nothing is carried.
    """
    fields = f"size:bigint,id:{kind},j:bigint"
    start = F.expr(f"named_struct('own', cast(null as struct<{fields},p:double>), 'n', 0, 'done', cast(array() as array<struct<{fields},up:int>>))")

    def entry(x: Column, up: int) -> Column:
        return F.struct(x["size"].alias("size"), x["id"].alias("id"), x["j"].alias("j"), F.lit(up).alias("up"))

    def carried(x: Column, p: Column) -> Column:
        return F.struct(x["size"].alias("size"), x["id"].alias("id"), x["j"].alias("j"), p.alias("p"))

    def step(acc: Column, x: Column) -> Column:
        own, n = acc["own"], acc["n"] + 1
        total = own["p"] + x["p"]
        u = _draw(F.lit(SEED + level), *block, n)
        low, first_ends = total < 1, F.when(total < 1, u * total < x["p"]).otherwise(u * (2 - total) < 1 - x["p"])
        rest = F.when(low, total).otherwise(total - 1)
        ended = F.when(first_ends, F.when(low, entry(own, 0)).otherwise(entry(own, 1))).otherwise(F.when(low, entry(x, 0)).otherwise(entry(x, 1)))
        goes_on = F.when(first_ends, carried(x, rest)).otherwise(carried(own, rest))
        both = F.struct(goes_on.alias("own"), n.alias("n"), F.array_append(acc["done"], ended).alias("done"))
        return F.when(own.isNull(), F.struct(carried(x, x["p"]).alias("own"), n.alias("n"), acc["done"].alias("done"))).otherwise(both)

    return F.aggregate(items, start, step)


def _class_quotas(items: DataFrame) -> DataFrame:
    """(_source, _like, n, p): for each class of sizes the probability that makes its number of copies a whole one.

    From the largest documents down, a class gets its expected number plus what the larger ones missed in words, rounded
    at random. So the last miss is one small document, and each document's expectation is kept.
    """
    per = items.groupBy("source", "like").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.max("p").alias("p"))
    lists = per.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("like", "n", "words", "p")), asc=False).alias("classes"))
    start = F.expr("named_struct('miss', 0D, 'out', cast(array() as array<struct<like:int,n:bigint,p:double>>))")

    def step(acc: Column, x: Column) -> Column:
        mean = x["words"] / x["n"]
        wanted = x["n"] * x["p"] + acc["miss"] / mean
        whole = F.greatest(F.lit(0), F.least(x["n"], F.floor(wanted + _draw(F.lit(SEED - 1), F.col("source"), x["like"]))))
        return F.struct(((wanted - whole) * mean).alias("miss"), F.array_append(acc["out"], F.struct(x["like"].alias("like"), x["n"].alias("n"), (whole / x["n"]).alias("p"))).alias("out"))

    folded = lists.select("source", F.explode(F.aggregate("classes", start, step)["out"]).alias("x"))
    return folded.select(F.col("source").alias("_source"), F.col("x.like").alias("_like"), "x.n", "x.p")


def mix(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(id, size, source, source_size, target, copies) of every row; copies times size is what the mix takes of it."""
    sizes = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source}`").alias("source"), size_of(F.col(f"`{text}`")).alias("size"))
    kind = sizes.schema["id"].dataType.simpleString()
    # equal rows are numbered, which tells every row apart
    sizes = checkpointed(sizes.groupBy("id", "source", "size").agg(F.count("*").alias("times")).select("id", "source", "size", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))).alias("j")))
    targets = checkpointed(source_targets(sizes, weights, most))
    if targets.count() <= SMALL:
        targets = F.broadcast(targets)
    rows = sizes.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(rate + CLOSE).cast("int")).withColumn("p", F.greatest(F.lit(0.0), rate - F.floor(rate + CLOSE)))
    kept = ["source", "source_size", "target", "whole"]
    fractional = (F.col("p") > CLOSE) & (F.col("size") > 0)
    plain = rows.where(~fractional).select("id", "size", *kept, F.lit(0).alias("up"))
    # documents within an eighth of an octave of size share blocks
    items = rows.where(fractional).withColumn("like", F.floor(F.log2("size") * 8).cast("int"))
    quotas = checkpointed(_class_quotas(items))
    if quotas.count() <= SMALL:
        quotas = F.broadcast(quotas)
    items = items.drop("p").join(quotas, F.col("source").eqNullSafe(F.col("_source")) & (F.col("like") == F.col("_like")))
    certain = (F.col("p") < CLOSE) | (F.col("p") > 1 - CLOSE)
    done = [plain, items.where(certain).select("id", "size", *kept, F.round("p").cast("int").alias("up"))]
    items = items.where(~certain).withColumn("salt", F.pmod(F.xxhash64("id", "j", F.lit(SEED)), F.ceil(F.col("n") / BLOCK)).cast("bigint")).drop("_source", "_like", "n")
    level = 0
    while True:
        group = [*kept, "like", "salt"]
        blocks = items.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("size", "id", "j", "p"))).alias("items"))
        folded = checkpointed(blocks.select(*group, _round_block(F.col("items"), level, [F.col("source"), F.col("like"), F.col("salt")], kind).alias("out")).select(*group, "out.own", "out.done"))
        done.append(folded.select(*kept, F.explode("done").alias("x")).select("x.id", "x.size", *kept, "x.up"))
        residual = folded.where("own is not null").select("own.id", "own.j", "own.size", *kept, "own.p", "like", "salt")
        done.append(residual.where(certain).select("id", "size", *kept, F.round("p").cast("int").alias("up")))
        residual = residual.where(~certain)
        level += 1
        widest = residual.groupBy("source", "like").count().agg(F.max("count")).first()[0] or 0
        if widest <= 1:
            done.append(residual.select("id", "size", *kept, (_draw(F.lit(SEED + level), F.col("source"), F.col("id"), F.col("j")) < F.col("p")).cast("int").alias("up")))
            break
        # the residuals of BLOCK blocks meet in one at the next level
        items = residual.withColumn("salt", F.pmod(F.col("salt"), F.lit(-(-widest // BLOCK))))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("id", "size", "source", "source_size", "target", (F.col("whole") + F.col("up")).alias("copies"))


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """docs with `copies`, without the rows that the mix takes no copy of; a column `copies` of docs gives way.

    Rows are told apart by a hash of all their columns, so rows that share an id have copies of their own; rows that are
    equal in all columns share out theirs. id_col is not needed to tell rows apart.
    """
    own = docs.drop("copies")
    inside = {c: f"_own_{i}" for i, c in enumerate(own.columns)}
    plain = own.select(*[F.col(f"`{c}`").alias(n) for c, n in inside.items()])
    hashed = [F.to_json(n) if isinstance(own.schema[c].dataType, MapType) else F.col(n) for c, n in inside.items()]
    keyed = plain.select("*", *[F.xxhash64(F.lit(k), *hashed).alias(n) for k, n in ((1, "_h"), (2, "_h2"))])
    taken = mix(keyed.select(F.struct("_h", "_h2").alias("_key"), F.col(inside[text]).alias("_text"), F.col(inside[source]).alias("_source_of")), "_text", "_source_of", "_key").where("copies > 0")
    taken = taken.groupBy("id", "copies").agg(F.count("*").alias("times")).groupBy("id").agg(F.collect_list(F.struct("copies", "times")).alias("_share"))
    met = keyed.join(taken.select("id._h", "id._h2", "_share"), ["_h", "_h2"])
    # one of equal rows stands for all of them, and is written out as often as the mix takes it
    rows = met.dropDuplicates(["_h", "_h2"]).select(*inside.values(), F.explode("_share").alias("_x")).select(*inside.values(), F.col("_x.copies").alias("_copies"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_x.times"))).alias("_again"))
    return rows.select(*[F.col(n).alias(c) for c, n in inside.items()], F.col("_copies").alias("copies"))
