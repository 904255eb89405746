"""SimHash near-duplicates by anchor-point covering.

A document's 64-bit fingerprint is the bitwise majority of the XXH64 values of its word shingles. Two fingerprints that
differ in at most three bits agree in one of their 32-bit halves up to one bit. On 31 bits of a half the Hamming(31, 26)
code is a perfect covering code of radius one, so its 2**26 code words are the anchors: each distinct fingerprint has one
home anchor at distance at most 1, and is replicated to every anchor within covering radius plus threshold (1 + 1 = 2),
which are one or sixteen anchors. Pairs meet at the home anchor of either side; each anchor then compares full 64-bit
fingerprints, so the links are exact for thresholds up to three. A home that holds many fingerprints is split again by
the bytes of the other half (one of the four bytes agrees when three bits differ at most).

Null texts count as empty; a text without words has fingerprint zero and links like any other. Rows with equal
fingerprints are one node of the graph; rows with a null id take part and their component is the smallest non-null id
(null if there is none). Extra columns are ignored by `near_duplicate_groups` and kept by `keep_one`.

A few differing bits mean nearly equal texts only: at a Jaccard similarity of 0.8 about ten of 64 bits differ, beyond any
covering code of usable size. Where a `similarity` is asked for, fingerprints are linked as above and, besides, documents
that share a band of minimum hashes are compared by the exact Jaccard similarity of their shingle sets. Documents with equal
sets are one node. Small bands compare all members at once. In large ones each member first meets two leaders, which joins
most copies; the members of bands that still hold several groups are then joined by the prefixes of their shingle sets
(rarest shingles first, with length and position filters), which finds every link between the groups and none of the pairs
inside a group. So the size of a band decides how its links are found, never which ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, mapped, text_batches

SEED = 42
MAX_BITS = 3
#: Above this many fingerprints an anchor is split by the bytes of the other half.
HOT_ANCHOR = 64
#: Bands of minimum hashes and hashes of a band: at similarity 0.8 a band agrees with chance 0.26, one of 20 with 0.998.
BANDS = 20
BAND_ROWS = 6
#: Up to this many members a band compares all of them at once.
SMALL_BAND = 16
#: Pieces into which the members of a band are dealt when they meet its leaders.
PIECES = 16


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each run of `shingle` words (all words if there are fewer), repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)), np.uint64, n)


def fingerprint_of(hashes: np.ndarray, chunk: int = 1 << 16) -> int:
    """Bits that are set in over half of the hashes; zero for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), chunk):
        part = hashes[at : at + chunk].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def bands_of(hashes: np.ndarray, chunk: int = 1 << 13) -> list[int]:
    """A signed 64-bit value for each band: its minimum hashes over the set of shingles, mixed; none for no shingles."""
    if not len(hashes):
        return []
    rng = np.random.default_rng(SEED)
    odd, add = (rng.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), chunk):
        part = hashes[at : at + chunk]
        for i in range(len(odd)):
            least[i] = min(least[i], (part * odd[i] + add[i]).min())
    rows = [xxhash.xxh64_intdigest(row.tobytes(), SEED) for row in least.reshape(BANDS, BAND_ROWS)]
    return np.array(rows, np.uint64).view(np.int64).tolist()


def with_fingerprint(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(id, fp): the signed 64-bit fingerprint of every row's whole text."""

    def run(batches):
        for part in text_batches(batches):
            fps = [fingerprint_of(shingle_hashes(t, shingle)) for t in part.column(1).to_pylist()]
            signed = np.array(fps, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(signed)], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), run, f"id {kind}, fp bigint")


def text_key(text: str) -> list:
    """Two hashes of a text column, 128 bits together, under the names h and h2; rows are told apart by id and these."""
    return [F.xxhash64(F.lit(1), F.col(text)).alias("h"), F.xxhash64(F.lit(2), F.col(text)).alias("h2")]


def with_bands(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 5) -> DataFrame:
    """(id, h, h2, fp, s, s2, bands): of every row's whole text the key, the fingerprint, 128 bits that tell its set of
    shingles, and the band values."""

    def run(batches):
        for part in text_batches(batches):
            fps, keys, bands = [], [], []
            for t in part.column(3).to_pylist():
                hashes = shingle_hashes(t, shingle)
                fps.append(fingerprint_of(hashes))
                own = np.unique(hashes)
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                bands.append(bands_of(own))
            signed = np.array(fps, np.uint64).view(np.int64)
            halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            columns = [pa.array(signed), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns], names=["id", "h", "h2", "fp", "s", "s2", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(F.col(id_col).alias("id"), *text_key(text), F.col(text).alias("text")), run, f"id {kind}, h bigint, h2 bigint, fp bigint, s bigint, s2 bigint, bands array<bigint>")


def shingle_sets(docs: DataFrame, text: str = "text", shingle: int = 5) -> DataFrame:
    """(s, s2, grams): the set of shingle hashes of each row and the bits that tell it."""

    def run(batches):
        for part in text_batches(batches, 64):
            own = [np.unique(shingle_hashes(t, shingle)) for t in part.column(0).to_pylist()]
            halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in own), np.int64).reshape(-1, 2)
            grams = pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), grams], names=["s", "s2", "grams"])

    return mapped(docs.select(F.col(text).alias("text")), run, "s bigint, s2 bigint, grams array<bigint>")


def band_members(nodes: DataFrame) -> DataFrame:
    """(node, k, v, piece, n): the nodes of each band that has several, dealt out in pieces, and how many it has."""
    placed = nodes.select("node", F.posexplode("bands").alias("k", "v")).withColumn("piece", F.pmod(F.xxhash64("node", "k"), F.lit(PIECES)).cast("int"))
    size = placed.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1").select("k", "v", "n", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias("piece"))
    return placed.join(size, ["k", "v", "piece"])


def band_pairs(shared: DataFrame) -> DataFrame:
    """(a, b, piece, central): pairs of members that share a band; b is a leader of the band, or any member of a small one.

    The number of pairs grows with the number of nodes, not with its square: a band gives SMALL_BAND or two pairs a member.
    """
    pieces = F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias("piece")
    central = shared.groupBy("node").agg(F.sum("n").alias("central"))
    # the most central member leads a band; a second leader is chosen by a hash, so it differs between bands
    ranked = shared.join(central, "node").where(F.col("n") > SMALL_BAND)
    lead = ranked.groupBy("k", "v").agg(F.max(F.struct("central", "node"))["node"].alias("one"), F.max(F.struct(F.xxhash64("node", "k").alias("h"), "node"))["node"].alias("two"))
    leaders = lead.select("k", "v", F.explode(F.array_distinct(F.array("one", "two"))).alias("b")).join(central.withColumnRenamed("node", "b"), "b").select("k", "v", "b", "central", pieces)
    large = shared.where(F.col("n") > SMALL_BAND).join(leaders, ["k", "v", "piece"]).where("node != b").select(F.col("node").alias("a"), "b", "piece", "central")
    small = shared.where(F.col("n") <= SMALL_BAND).select("k", "v", "node")
    every = small.join(small.withColumnRenamed("node", "b"), ["k", "v"]).where("node < b").select(F.col("node").alias("a"), "b", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("central"))
    # a pair from large and small bands is compared once
    return large.unionByName(every).groupBy("a", "b").agg(F.max("piece").alias("piece"), F.max("central").alias("central"))


def led_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the similar ones among the pairs of `band_pairs`, without those that a first round shows to be in one group."""
    # each node meets the most central of its leaders first; pairs that this leaves in one group need no comparison
    best = pairs.groupBy("a").agg(F.max(F.struct("central", "b", "piece")).alias("x")).select("a", "x.b", "x.piece")
    led = checkpointed(verified(best, sets, similarity))
    ends = [led.select(F.col("a").alias(end), F.col("b").alias(f"{end}_root")) for end in ("a", "b")]
    rest = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left")
    rest = rest.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b", "piece")
    return led.unionByName(verified(checkpointed(rest), sets, similarity)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (node, grams) have this Jaccard similarity; b is dealt out by piece."""
    dealt = pairs.select(F.col("b").alias("node"), "piece").distinct().join(sets, "node").select(F.col("node").alias("b"), "piece", F.col("grams").alias("y"))
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
    common = F.size(F.array_intersect("x", "y"))
    return left.join(dealt, ["b", "piece"]).where(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b")


def unsettled(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root): the members of large bands that hold several groups; roots (node, root) names the groups of linked nodes."""
    large = shared.where(F.col("n") > SMALL_BAND).select("k", "v", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = large.groupBy("k", "v").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("k", "v")
    return large.join(several, ["k", "v"], "left_semi").select("node", "root").distinct()


def prefix_pairs(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, piece): pairs of members (node, root) of different roots that can have this Jaccard similarity.

    With shingles in one order, the rarest first, two similar sets share one of the first n - need + 1 shingles of either,
    where need is the overlap that the longer set asks for (and, for the shorter one, that a set of its own size would).
    """
    grams = checkpointed(members.join(sets, "node").select("node", "root", F.size("grams").alias("n"), F.explode("grams").alias("g")))
    often = grams.groupBy("g").agg(F.count("*").alias("df"), (F.min("root") != F.max("root")).alias("mixed"))
    order = Window.partitionBy("node").orderBy("df", "g")

    def reach(share: float):
        return F.col("n") - F.ceil(share * F.col("n") - 1e-9) + 1

    both = 2 * similarity / (1 + similarity)
    heads = grams.join(often, "g").withColumn("at", F.row_number().over(order)).where(F.col("mixed") & (F.col("at") <= reach(similarity)))
    heads = checkpointed(heads.select("g", "node", "root", "n", "at", (F.col("at") <= reach(both)).alias("short")))
    # of a shingle's groups the one with most members meets the others only, never itself
    main = heads.groupBy("g", "root").count().groupBy("g").agg(F.max(F.struct("count", "root"))["root"].alias("main"))
    heads = checkpointed(heads.join(main, "g").withColumn("aside", F.col("root") != F.col("main")).drop("main"))
    x = heads.where("short").select("g", *[F.col(c).alias(f"x_{c}") for c in ("node", "root", "n", "at", "aside")])
    y = heads.select("g", *[F.col(c).alias(f"y_{c}") for c in ("node", "root", "n", "at", "aside")])
    need = F.ceil(both / 2 * (F.col("x_n") + F.col("y_n")) - 1e-9)
    left = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at")) + 1
    fits = (F.col("x_root") != F.col("y_root")) & (F.col("x_n") <= F.col("y_n")) & (F.col("x_n") >= similarity * F.col("y_n") - 1e-9) & (left >= need)
    met = x.where("x_aside").join(y, "g").where(fits).unionByName(x.where("not x_aside").join(y.where("y_aside"), "g").where(fits))
    pairs = met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
    return pairs.withColumn("piece", F.pmod(F.xxhash64("a"), F.lit(PIECES)).cast("int"))


def _syndrome(word):
    """Hamming(31) syndrome of the low 31 bits: the position (1..31) whose flip gives a code word, 0 for a code word."""
    masks = [sum(1 << (p - 1) for p in range(1, 32) if p >> bit & 1) for bit in range(5)]
    parts = [F.shiftleft(F.bit_count(word.bitwiseAND(F.lit(m))) % 2, bit) for bit, m in enumerate(masks)]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out.cast("int")


def _flip(word, position):
    """word with the bit of this position (1..31) flipped; position 0 flips nothing."""
    bit = F.when(position == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), position - 1))
    return word.bitwiseXOR(bit)


def _anchors(fps: DataFrame) -> DataFrame:
    """(fp, half, word, rest, home): the two 32-bit halves; home is the anchor nearest to the half's 31 low bits."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    halves = F.array(
        F.struct(F.lit(0).alias("half"), low.alias("word"), high.alias("rest")),
        F.struct(F.lit(1).alias("half"), high.alias("word"), low.alias("rest")),
    )
    out = fps.select("fp", F.explode(halves).alias("x")).select("fp", "x.half", (F.col("x.word").bitwiseAND(F.lit(0x7FFFFFFF))).alias("word"), "x.rest")
    out = out.withColumn("p", _syndrome(F.col("word")))
    return out.withColumn("home", _flip(F.col("word"), F.col("p")))


def linked_pairs(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): distinct fingerprints, a < b, that differ in at most max_bits bits; each anchor compares what meets there."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("two halves with one bit each cover at most three differing bits")
    placed = _anchors(fps)
    hot = placed.groupBy("half", "home").count().where(F.col("count") > HOT_ANCHOR).select("half", F.col("home").alias("anchor"), F.lit(True).alias("hot"))
    # flipping positions i and i ^ p of the word leads to an anchor at distance two (one where either is 0)
    reach = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: _flip(_flip(F.col("word"), i), i.bitwiseXOR(F.col("p")))))
    homes = placed.select(F.col("fp").alias("a"), "half", F.col("home").alias("anchor"), "rest")
    copies = placed.select(F.col("fp").alias("b"), "half", "rest", F.explode(reach).alias("anchor"))

    def split(rows: DataFrame) -> DataFrame:
        """A byte of the other half as a further key where the anchor is hot; byte number 4 stands for no split."""
        rest = F.col("rest")
        cut = F.array(*[F.struct(F.lit(k).alias("k"), F.shiftright(rest, 8 * k).bitwiseAND(F.lit(255)).alias("v")) for k in range(4)])
        whole = F.array(F.struct(F.lit(4).alias("k"), F.lit(0).cast("bigint").alias("v")))
        marked = rows.join(hot, ["half", "anchor"], "left")
        return marked.select(*[c for c in rows.columns if c != "rest"], F.explode(F.when(F.col("hot"), cut).otherwise(whole)).alias("z")).select("*", "z.k", "z.v").drop("z")

    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    met = split(homes).join(split(copies), ["half", "anchor", "k", "v"]).where((F.col("a") != F.col("b")) & near)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _both_ways(edges: DataFrame) -> DataFrame:
    """(u, v): each edge as seen from both of its ends."""
    ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return edges.select(F.explode(ends).alias("x")).select("x.u", "x.v")


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (distinct, u > v) are stars around their smallest nodes: a node with a smaller neighbour has no other one."""
    seen = _both_ways(edges).groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return not seen.agg(F.max((F.col("m") < F.col("u")) & (F.col("n") > 1)).alias("x")).first()["x"]


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from every node of the pairs (a, b), by alternating star contraction.

    The driver keeps a record of every task for as long as the session lasts, so a round has few stages: no union, one
    `distinct`, and one test of the edges themselves, which also spares the round that would change nothing.
    """
    edges = checkpointed(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    for _ in range(rounds):
        if _settled(edges):
            break
        both = _both_ways(edges)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours are hung on the least one
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours and the node itself are hung on the least one
        hung = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = hung.select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        edges = checkpointed(small)
    else:
        raise RuntimeError(f"the components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("u"), F.col("v")).distinct()
    return edges.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicate_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, component): for each row the fingerprint and the smallest id linked to it, directly or through others."""
    rows = checkpointed(with_fingerprint(docs, text, id_col, shingle))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(linked_pairs(nodes.select("fp"), max_bits))
    grouped = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    labels = grouped.groupBy("root").agg(F.min("least").alias("component"))
    named = grouped.join(labels, "root").select("fp", "component")
    return rows.join(named, "fp").select("id", "fp", "component")


def similar_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 5, max_bits: int = MAX_BITS, similarity: float = 0.8) -> DataFrame:
    """(id, h, h2, root): for each row its key and the number of its group.

    Rows are linked by fingerprints at max_bits, and by shingle sets of this Jaccard similarity.
    """
    rows = checkpointed(with_bands(docs, text, id_col, shingle))
    first = F.min(F.struct(F.col("id").isNull(), "id", "h", "h2"))
    nodes = rows.groupBy("s", "s2").agg(first.alias("first"), F.first("bands").alias("bands"))
    # the numbers are fixed by the checkpoint
    nodes = checkpointed(nodes.select("s", "s2", "first.id", "first.h", "first.h2", "bands", F.monotonically_increasing_id().alias("node")))
    # a set may have several fingerprints, as repeats count in these
    marks = checkpointed(rows.select("s", "s2", "fp").distinct().join(nodes.select("s", "s2", "node"), ["s", "s2"]).select("fp", "node"))
    owner = marks.groupBy("fp").agg(F.min("node").alias("owner"))
    near = linked_pairs(owner.select("fp"), max_bits)
    near = near.join(owner.select(F.col("fp").alias("a"), F.col("owner").alias("x")), "a").join(owner.select(F.col("fp").alias("b"), F.col("owner").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    links = near.unionByName(marks.join(owner, "fp").select(F.col("node").alias("a"), F.col("owner").alias("b"))).where("a != b")
    shared = checkpointed(band_members(nodes))
    pairs = checkpointed(band_pairs(shared))
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = nodes.join(wanted, "node", "left_semi").select(F.coalesce("id", F.lit(0).cast(nodes.schema["id"].dataType)).alias("_id"), F.col("id").isNull().alias("_none"), "h", "h2", "node")
    keyed = docs.select(F.coalesce(F.col(id_col), F.lit(0).cast(nodes.schema["id"].dataType)).alias("_id"), F.col(id_col).isNull().alias("_none"), *text_key(text), F.col(text).alias("text"))
    sets = shingle_sets(keyed.join(wanted, ["_id", "_none", "h", "h2"], "left_semi"), "text", shingle).dropDuplicates(["s", "s2"])
    sets = checkpointed(sets.join(nodes.select("s", "s2", "node"), ["s", "s2"]).select("node", "grams"))
    roots = checkpointed(components(links.unionByName(led_pairs(pairs, sets, similarity))))
    members = checkpointed(unsettled(shared, roots))
    if not members.isEmpty():
        found = verified(checkpointed(prefix_pairs(members, sets, similarity)), sets, similarity)
        # links between groups join their roots
        named = [members.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")) for end in ("a", "b")]
        joined = checkpointed(found.join(named[0], "a").join(named[1], "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).unionByName(roots.toDF("a", "b")))
        roots = components(joined)
    grouped = nodes.select("s", "s2", "node").join(roots, "node", "left").select("s", "s2", F.coalesce("root", "node").alias("root"))
    return rows.join(grouped, ["s", "s2"]).select("id", "h", "h2", "root")


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 5, max_bits: int = MAX_BITS, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each near-duplicate group: the one with the smallest id (of repeated rows, one stays)."""
    groups = similar_groups(docs, text, id_col, shingle, max_bits, similarity)
    # rows are told apart by id and text; a row without an id stays only where its group has no other
    kept = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "h2")).alias("x")).select("x.id", "x.h", "x.h2")
    kind = docs.schema[id_col].dataType
    # the keys of the null-safe join also serve to drop repeated rows, so the texts move once
    names = ["_kept_key", "_kept_none", "_kept_h", "_kept_h2"]

    def keys(c, h, h2) -> list:
        return [x.alias(n) for x, n in zip((F.coalesce(c, F.lit(0).cast(kind)), c.isNull(), h, h2), names, strict=True)]

    inside = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inside.items()])
    met = own.select("*", *keys(F.col(inside[id_col]), *text_key(inside[text]))).join(kept.select(*keys(F.col("id"), F.col("h"), F.col("h2"))), names, "left_semi")
    return met.dropDuplicates(names).select(*[F.col(n).alias(c) for c, n in inside.items()])
