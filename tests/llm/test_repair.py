"""Conversation repair against plain search over all edits, in one range and in many."""

import hashlib
import random
import re
import zlib
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import repair
from tidemark.llm.queries import op11_conversation_repair

SPACE = " \t\n\v\f\r"
AFTER = {"": "u", "s": "u", "u": "a", "a": "u"}


def plain_repair(rows):
    """rows: (turn, role, text) in order. The cheapest edits by a search over (row, state) with whole strings."""
    faults, seen, cut = [], set(), []
    for _, role, text in rows:
        body = text.rstrip(SPACE)
        fault = "blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    best = {"": (0, "", ())}

    def inserted(found):
        for _ in range(2):
            for s, (c, a, r) in list(found.items()):
                t = AFTER[s]
                new = c + 3, a + "I", (*r, ("user" if t == "u" else "assistant") + ":")
                if t not in found or new[:2] < found[t][:2]:
                    found[t] = new
        return found

    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}

        def take(state, cost, letters, out, new=new):
            if state not in new or (cost, letters) < new[state][:2]:
                new[state] = cost, letters, out

        for s, (c, a, r) in inserted(dict(best)).items():
            take(s, c + 4, a + "D", r)
            if fault not in ("blank", "duplicate"):
                more, t = 3 * (fault == "truncated"), AFTER[s]
                if role[:1] == t or role[:1] == "s" and s == "":
                    take(role[:1], c + more, a + "K", (*r, f"{role}:{text}"))
                take(t, c + 3 + more, a + "R", (*r, f"{'user' if t == 'u' else 'assistant'}:{text}"))
        best = new
    cost, audit, out = min(v for s, v in inserted(best).items() if s in ("", "a"))
    turns = [t for t, *_ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")}, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest(),
    }


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        word = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else word(role), {1: "", 2: re.sub("[.!?]", "", word(text))}.get(kind, word(text))
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def by_conv(rows):
    key = lambda r: (r[0] is not None, r[0] or 0)
    return {c[1] if c[0] else None: in_order([r[1:] for r in rs]) for c, rs in groupby(sorted(rows, key=key), key)}


def summaries(spark, rows, kind="conv bigint", **how):
    frame = spark.createDataFrame(rows, f"{kind}, turn bigint, role string, text string")
    if how:
        real = repair.Repair.__init__.__defaults__
        repair.Repair.__init__.__defaults__ = (how["range_chars"],)
    try:
        out = repair.summary(repair.as_rows(frame, "conv"), frame.select("conv")).collect()
    finally:
        if how:
            repair.Repair.__init__.__defaults__ = real
    return {r["conv"]: {k: v for k, v in r.asDict().items() if k != "conv"} for r in out}


def made(rnd, conv, n, few=False):
    texts = ["", " \t", "One.", "Two", "Three! ", "four\n", "Five?", "six…", "Seven.\n"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", ""]
    return [(conv, rnd.choice([None, *range(n)]) if few else k, rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.4 else f"Text {rnd.random()}{rnd.choice('.!? ')}") for k in range(n)]


def test_binary_powers_are_repeated_products():
    for symbol in range(9):
        whole = repair.power_of_two(symbol, 0)
        for n in range(1, 12):
            assert (repair.power(symbol, n) == whole).all()
            behind = np.array([0, 6, 3, 0])
            assert (repair.costs_within(symbol, n, behind)[n] == repair.apply(whole, behind)).all()
            whole = repair.times(whole, repair.power_of_two(symbol, 0))


def test_random_conversations(spark):
    rnd = random.Random(1)
    rows = [r for c in range(150) for r in made(rnd, c, rnd.randrange(1, 12), few=c % 3 == 0)]
    rows += [(None, 0, "user", "Hi."), (None, 1, None, None), (None, None, "system", "Sys.")]
    rows += rows[:40]  # repeated rows
    want = {c: plain_repair([(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rs]) for c, rs in ((c, in_order([(t, r or "" if r is not None else " ", x if x is not None else " ") for t, r, x in rs])) for c, rs in group(rows).items())}
    assert summaries(spark, rows) == want


def group(rows):
    out = {}
    for conv, *rest in rows:
        out.setdefault(conv, []).append(rest)
    return out


@pytest.mark.parametrize("range_chars", [300, 5000])
def test_conversations_over_many_ranges(spark, range_chars):
    rnd = random.Random(2)
    rows = made(rnd, 7, 900) + made(rnd, 3, 5) + made(rnd, 9, 250) + [(11, k, "user", "Same.") for k in range(300)]
    rows += [(12, 5, "assistant", "Again.")] * 400
    want = {c: plain_repair(in_order([tuple(r) for r in rs])) for c, rs in group(rows).items()}
    assert summaries(spark, rows, range_chars=range_chars) == want


def test_edits_hold_the_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "More."), (1, 2, "assistant", " "), (1, 3, "assistant", "Yes.")]
    frame = spark.createDataFrame(rows, "conv bigint, turn bigint, role string, text string")
    got = repair.repair(repair.as_rows(frame, "conv")).orderBy("place").collect()
    assert [(r["edit"], r["role"], r["text"], r["cost"]) for r in got] == [("K", "user", "Hi.", 0), ("I", "assistant", "", 3), ("K", "user", "More.", 0), ("D", None, None, 4), ("K", "assistant", "Yes.", 0)]
    other = spark.createDataFrame([(1, 0, "tool", "Hi"), (1, 1, "user", "Ok.")], "conv bigint, turn bigint, role string, text string")
    got = repair.repair(repair.as_rows(other, "conv")).orderBy("place").collect()
    assert [(r["edit"], r["role"], r["text"], r["cost"]) for r in got] == [("D", None, None, 4), ("K", "user", "Ok.", 0), ("I", "assistant", "", 3)]


def test_query_against_plain_search(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    damaged = by_conv(plain_damage(rows))
    got = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in op11_conversation_repair(spark, sf).collect()}
    assert got == {c: plain_repair(damaged.get(c, [])) for c in {r[0] for r in rows}}


def test_extra_columns_and_empty_tables(spark):
    kind = "conv_id string, turn bigint, role string, text string, copies int, symbol int, place int"
    frame = spark.createDataFrame([("x", 1, "user", "Hi." * 300_000, 3, 4, 5)], kind)
    for rows in (repair.as_rows(frame), repair.damaged(frame)):
        assert [r["audit"] for r in repair.summary(rows, frame.select(F.col("conv_id").alias("conv"))).collect()] == ["KI"]
        assert repair.summary(rows.limit(0), frame.limit(0).select(F.col("conv_id").alias("conv"))).count() == 0
    lone = repair.summary(repair.as_rows(frame.limit(0)), frame.select(F.col("conv_id").alias("conv"))).first()
    assert (lone["cost"], lone["audit"], lone["repaired_sha256"]) == (0, "", hashlib.sha256().hexdigest())
