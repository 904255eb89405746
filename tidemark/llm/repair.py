"""Repair of the structure of conversations by a run-length dynamic programme.

A conversation is right if its roles read `(system? (user assistant)+)?` by their initials and no row is blank, repeats an
earlier row or is cut off. Rows may be kept, given another role or deleted, and empty ones inserted, each at a price; the
cheapest edits win, the ASCII-least initials among equals.

Every row is one of nine symbols (what must be deleted; else the initial of the role, with or without the fault of being cut
off). A symbol is a transition in the min-plus algebra over four states (nothing yet, after system, user, assistant), which
also holds the insertions before it. Equal neighbours are one run, and a run of n rows is the product of the binary powers of
its transition, which are computed once. The products run over the rows in both ways: backwards for what the rest costs, then
forwards for the choices.

Rows are dealt by ranges of (conversation, turn, role, text), so that a conversation of any length is spread over tasks:

1. each range gives the product of each conversation that it holds a part of;
2. a conversation that several ranges share (two at most for each range) gets the costs behind each part from the products of
   the parts after it, and then, part by part, the state that its choices end in;
3. each range writes the edits of its rows.

`repair` returns the edits in order, `summary` counts and digests. Rows are taken by turn (nulls first), then role and text,
since nothing else tells rows of one turn apart; equal rows of one turn are held as one with a number. A null role or text is
one space. Null conversation ids are one conversation. A role of any other initial can only be changed or deleted. Extra
columns are ignored. Empty tables give empty tables.

A task holds the rows of one conversation within one range (`RANGE_CHARS` characters, or one text), the driver one product for
each end of a range. The digest of a conversation is sequential by nature: one task streams its rows, holding the audit only.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Tables, checkpointed, mapped, partitions, text_batches

RANGE_CHARS = 32_000_000
KEEP, CHANGE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
BLANK = r"\A[\x09-\x0D\x20]*\z"
ENDED = r"[.!?][\x09-\x0D\x20]*\z"
LEGAL = ("su", "ua", "au")
#: The state after a state when a user or assistant row follows; the order of states is: nothing, system, user, assistant.
NEXT = (2, 2, 3, 2)
NONE = 1 << 60
#: What it costs to end in each state.
LAST = np.array([0, 2 * INSERT, INSERT, 0])
INITIALS = "sua"


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): rows damaged by the checksum of `conv:turn`, for trials of the repair."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat_ws(":", word(conv), word(turn)).cast("binary")), F.lit(20))
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), word(role).alias("role"), word(text).alias("text"), kind.alias("kind")).where("kind <> 0")
    text_ = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text_.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def as_rows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies) of rows as they are."""
    filled = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), filled(role).alias("role"), filled(text).alias("text"), F.lit(1).alias("copies"))


class Repair:
    """The ordered rows of all conversations, with what the passes over them need."""

    def __init__(self, rows: DataFrame, range_chars: int = RANGE_CHARS):
        self.tables = Tables(rows.sparkSession)
        one = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").cast("bigint").alias("copies"))
        one = self.tables.write(one.withColumn("same", F.unhex(F.sha2(F.concat_ws("\n", "role", "text"), 256))))
        # the earliest turn of each role and text; digests move, not texts
        earliest = one.groupBy("conv", "same").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
        kept = one.join(earliest.select(F.col("conv").alias("conv_"), F.col("same").alias("same_"), F.col("first.turn").alias("first")), F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("same") == F.col("same_")))
        blank, earlier = F.col("text").rlike(BLANK), ~F.col("turn").eqNullSafe(F.col("first"))
        initial = F.substring("role", 1, 1)
        place = F.when(initial == "s", 1).when(initial == "u", 3).when(initial == "a", 5).otherwise(7)
        symbol = F.when(blank | earlier, 0).otherwise(place + F.when(F.col("text").rlike(ENDED), 0).otherwise(1))
        kept = kept.select("conv", "turn", "role", "text", "copies", blank.alias("blank"), initial.alias("initial"), symbol.alias("symbol"))
        chars = one.agg(F.sum(F.length("text"))).first()[0] or 0
        order = ["conv", "turn", "role", "text"]
        ranges = max(partitions(rows), -(-chars // range_chars))
        self.rows = checkpointed(kept.repartitionByRange(ranges, *order).sortWithinPartitions(*order))
        self.tables.drop(one)
        self.kind = rows.schema["conv"].dataType
        self.parts = self._parts()

    def _parts(self) -> DataFrame:
        """(conv, part, edge, product, n_illegal, first, last): each conversation in each range."""
        kind = to_arrow_type(self.kind)

        def run(batches):
            at, held = TaskContext.get().partitionId(), []

            def written(parts, edge):
                columns = list(zip(*parts, strict=True))
                kinds = [kind, pa.list_(pa.int64()), pa.int64(), pa.string(), pa.string()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                return pa.RecordBatch.from_arrays([*arrays, pa.array([at] * len(parts), pa.int32()), pa.array(edge)], names=["conv", "product", "n_illegal", "first", "last", "part", "edge"])

            first = True
            for conv, rows in conversations(batches):
                product = np.where(np.eye(4, dtype=bool), 0, NONE)
                for symbol, n in runs((r[2], r[3]) for r in rows):
                    product = times(product, power(symbol, n))
                initials = [r[1] for r in rows]
                illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)) + sum(r[3] - 1 for r in rows)
                held.append((conv, product.ravel().tolist(), illegal, initials[0], initials[-1]))
                if len(held) > 1000:
                    yield written(held[:-1], [first] + [False] * (len(held) - 2))
                    held, first = held[-1:], False
            if held:
                edge = [False] * len(held)
                edge[0], edge[-1] = edge[0] or first, True
                yield written(held, edge)

        fields = f"conv {self.kind.simpleString()}, product array<bigint>, n_illegal bigint, first string, last string, part int, edge boolean"
        return self.tables.write(mapped(self.rows.select("conv", "initial", "symbol", "copies"), run, fields))

    def shared(self) -> tuple[dict, list]:
        """By range and conversation, for those that several ranges share: the costs behind the part, the state in front of it,
        and whether it is the last; and the conversations that have an illegal step between two ranges.

        Only the two ends of a range can belong to such a conversation, so this is a few numbers for each range."""
        parts: dict = {}
        for r in self.parts.where("edge").select("conv", "part", "product", "first", "last").toLocalIterator():
            parts.setdefault(r["conv"], []).append(r)
        parts = {c: sorted(rs, key=lambda r: r["part"]) for c, rs in parts.items() if len(rs) > 1}
        behind, illegal = {}, []
        for conv, rs in parts.items():
            costs = LAST
            for k in range(len(rs) - 1, -1, -1):
                behind[rs[k]["part"], conv] = costs.tolist()
                costs = apply(np.array(rs[k]["product"]).reshape(4, 4), costs)
                if k and rs[k - 1]["last"] + rs[k]["first"] not in LEGAL:
                    illegal.append(conv)
        if not parts:
            return {}, []
        kind = to_arrow_type(self.kind)

        def ends(batches):
            at = TaskContext.get().partitionId()
            for conv, rows in conversations(batches):
                if (costs := behind.get((at, conv))) is not None:
                    symbols = [(r[1], r[2]) for r in rows]
                    out = [chosen(symbols, np.array(costs), s)[1] for s in range(4)]
                    yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([at], pa.int32()), pa.array([out], pa.list_(pa.int32()))], names=["conv", "part", "ends"])

        found = mapped(self.rows.select("conv", "symbol", "copies"), ends, f"conv {self.kind.simpleString()}, part int, ends array<int>")
        after = {(r["part"], r["conv"]): r["ends"] for r in found.toLocalIterator()}
        out = {}
        for conv, rs in parts.items():
            state = 0
            for k, r in enumerate(rs):
                key = r["part"], conv
                out[key] = behind[key], state, k == len(rs) - 1
                state = after[key][state]
        return out, illegal

    def edits(self, shared: dict) -> DataFrame:
        """(conv, place, edit, role, text, cost): every edit in the order of `place`; deleted rows have no text."""
        kind = to_arrow_type(self.kind)
        schema = pa.schema([("conv", kind), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), ("cost", pa.int64())])

        def run(batches):
            at, place, out, held = TaskContext.get().partitionId(), 0, [], 0
            for conv, rows in conversations(batches):
                costs, state, last = shared.get((at, conv), (LAST, 0, True))
                letters, end = chosen([(r[3], r[4]) for r in rows], np.asarray(costs), state)
                if last:
                    letters.append("I" * int(LAST[end] // INSERT))
                at_row, left = iter(rows), 0
                for step in letters:
                    for edit in step:
                        role, text, cost = None, None, {"D": DELETE, "I": INSERT, "K": KEEP, "R": CHANGE}[edit]
                        if edit != "I" and not left:
                            row = next(at_row)
                            left = row[4]
                        if edit == "I":
                            role, text, state = ("user", "assistant")[NEXT[state] - 2], "", NEXT[state]
                        elif edit == "K":
                            role, text, state = row[1], row[2], 1 + INITIALS.index(row[1][0])
                        elif edit == "R":
                            role, text, state = ("user", "assistant")[NEXT[state] - 2], row[2], NEXT[state]
                        if edit in "KR":
                            cost += CUT_OFF * (1 - row[3] % 2) if row[3] else 0
                        left -= edit != "I"
                        out.append((conv, at << 40 | place, edit, role, text, cost))
                        place, held = place + 1, held + len(text or "") + 50
                        if held > 4_000_000:
                            yield packed(out)
                            out, held = [], 0
            if out:
                yield packed(out)

        def packed(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        return mapped(self.rows.select("conv", "role", "text", "symbol", "copies"), run, f"conv {self.kind.simpleString()}, place bigint, edit string, role string, text string, cost bigint")


def conversations(batches):
    """(conversation, its rows) of rows that stand in order."""
    conv, rows = None, []
    for batch in text_batches(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[0] != conv:
                yield conv, rows
                rows = []
            conv = row[0]
            rows.append(row)
    if rows:
        yield conv, rows


def runs(symbols):
    """Equal neighbours as (symbol, n); a row that stands n times is a repetition from the second on."""
    last, n = None, 0
    for symbol, copies in symbols:
        for s, k in ((symbol, 1), (0, copies - 1)):
            if k and s == last:
                n += k
            elif k:
                if n:
                    yield last, n
                last, n = s, k
    if n:
        yield last, n


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), NONE)


def apply(a: np.ndarray, costs: np.ndarray) -> np.ndarray:
    return np.minimum((a + costs).min(axis=1), NONE)


def row_edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(initial, price, next state) of the edits of a row, in the order of their initials."""
    out = [("D", DELETE, state)]
    if symbol:
        kind, extra = (symbol - 1) // 2, CUT_OFF * (1 - symbol % 2)
        if kind == 0 and state == 0 or kind in (1, 2) and NEXT[state] == kind + 1:
            out.append(("K", KEEP + extra, kind + 1))
        out.append(("R", CHANGE + extra, NEXT[state]))
    return out


@lru_cache(maxsize=None)
def power_of_two(symbol: int, k: int) -> np.ndarray:
    """The transition of 2^k rows of a symbol, insertions before each row included."""
    if k:
        half = power_of_two(symbol, k - 1)
        return times(half, half)
    inserted = np.where(np.eye(4, dtype=bool), 0, NONE)
    edited = np.full((4, 4), NONE)
    for s in range(4):
        inserted[s, NEXT[s]] = INSERT
        for _, price, to in row_edits(symbol, s):
            edited[s, to] = min(edited[s, to], price)
    return times(times(inserted, inserted), edited)


def power(symbol: int, n: int) -> np.ndarray:
    out = None
    for k in range(n.bit_length()):
        if n >> k & 1:
            out = power_of_two(symbol, k) if out is None else times(out, power_of_two(symbol, k))
    return out


def costs_within(symbol: int, n: int, behind: np.ndarray) -> np.ndarray:
    """The costs from each row of a run on, the last row first: n + 1 rows, `behind` before all; by doubling."""
    out, k = behind[None], 0
    while len(out) <= n:
        more = np.minimum((power_of_two(symbol, k)[None] + out[:, None, :]).min(axis=2), NONE)
        out, k = np.concatenate((out, more)), k + 1
    return out[: n + 1]


@lru_cache(maxsize=100_000)
def step(symbol: int, state: int, before: tuple[int, ...], after: tuple[int, ...]) -> tuple[str, int]:
    """The edits of one row from a state: its insertions and what is done to it; and the state behind it."""
    letters, rest = "", before[state]
    while True:
        for edit, price, to in row_edits(symbol, state):
            if edit != "D" and before[NEXT[state]] + INSERT == rest:
                break
            if price + after[to] == rest:
                return letters + edit, to
        letters, state = letters + "I", NEXT[state]
        rest = before[state]


def chosen(rows: list[tuple[int, int]], behind: np.ndarray, state: int) -> tuple[list[str], int]:
    """The least cheapest edits of rows (symbol, copies), as a list of the letters of each row, and the state they end in."""
    stretches, costs = list(runs(rows)), [behind]
    for symbol, n in reversed(stretches):
        costs.append(apply(power(symbol, n), costs[-1]))
    letters: list[str] = []
    for k, (symbol, n) in enumerate(stretches):
        within = costs_within(symbol, n, costs[len(stretches) - 1 - k])
        table = list(map(tuple, within.tolist()))
        for j in range(n, 0, -1):
            low = min(table[j - 1])
            done, state = step(symbol, state, tuple(x - low for x in table[j]), tuple(x - low for x in table[j - 1]))
            letters.append(done)
    return letters, state


def repair(rows: DataFrame) -> DataFrame:
    """The edits of all conversations (see `Repair.edits`) of rows (conv, turn, role, text, copies)."""
    found = Repair(rows)
    return found.edits(found.shared()[0])


def digests(edits: DataFrame) -> DataFrame:
    """(conv, audit, cost, repaired_sha256): the initials of the edits and the digest of what is left, a row at a time."""
    field = edits.schema["conv"].dataType
    kind = to_arrow_type(field)

    def run(batches):
        conv, digest, letters, cost, some, begun = None, hashlib.sha256(), [], 0, False, False

        def packed():
            return pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array(["".join(letters)]), pa.array([cost], pa.int64()), pa.array([digest.hexdigest()])], names=["conv", "audit", "cost", "repaired_sha256"])

        for batch in text_batches(batches):
            for key, edit, role, text, price in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if begun and key != conv:
                    yield packed()
                    digest, letters, cost, some = hashlib.sha256(), [], 0, False
                conv, begun = key, True
                letters.append(edit)
                cost += price
                if edit != "D":
                    digest.update(f"{chr(10) if some else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                    some = True
        if begun:
            yield packed()

    ordered = edits.repartition("conv").sortWithinPartitions("conv", "place").select("conv", "edit", "role", "text", "cost")
    return mapped(ordered, run, f"conv {field.simpleString()}, audit string, cost bigint, repaired_sha256 string")


def summary(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for every conversation of convs (conv)."""
    found = Repair(rows)
    shared, illegal = found.shared()
    whole = lambda c: F.sum(c).cast("bigint")
    copies, blank, again = F.col("copies"), F.col("blank"), F.col("symbol") == 0
    turns = found.rows.groupBy("conv", "turn").agg(
        whole(F.when(blank, copies).otherwise(0)).alias("blank"),
        whole(F.when(blank, 0).when(again, copies).otherwise(copies - 1)).alias("duplicate"),
        whole(F.when(~again & (F.col("symbol") % 2 == 0), 1).otherwise(0)).alias("truncated"),
    )
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint")
    counts = turns.groupBy("conv").agg(gaps.alias("gaps"), *[whole(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    steps = found.parts.select("conv", F.col("n_illegal").alias("illegal"))
    between = rows.sparkSession.createDataFrame([(c, 1) for c in illegal], steps.schema) if illegal else steps.limit(0)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    parts = [convs.select("conv").distinct(), counts, steps, between, digests(found.edits(shared))]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    empty = F.lit(hashlib.sha256().hexdigest())
    return every.groupBy("conv").agg(*[F.coalesce(whole(c), F.lit(0)).alias(c) for c in names], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), empty).alias("repaired_sha256"))
