"""Decisions, comparisons, stamps and text flags on rows made by hand, nulls and ties included."""

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import verdicts

NOW = datetime(2024, 5, 1, 12)


def test_decide(spark):
    rows = [
        (1, 404, "sold", 10.0, 20.0, NOW, 30.0, None, ("removed", 30.0, "db_fallback", None, "http_404")),
        (2, 200, "removed", 10.0, None, None, None, "gone", ("removed", 0.0, "none", None, "gone")),
        (3, 200, "sold", 10.0, 20.0, NOW, 30.0, "", ("sold", 20.0, "adapter_sold_price", NOW, "adapter_sold")),
        (4, 200, "sold", 10.0, 0.0, NOW, 30.0, None, ("sold", 10.0, "adapter_price_as_sold_price", NOW, "adapter_sold")),
        (5, 200, "sold", 0.0, None, NOW, 30.0, None, ("sold", 30.0, "db_fallback", NOW, "adapter_sold")),
        (6, 200, "sold", 0.0, None, NOW, -1.0, None, ("sold", 0.0, "adapter_price_as_sold_price", NOW, "adapter_sold")),
        (7, 200, "sold", 10.0, 20.0, None, 30.0, None, ("live", 10.0, "adapter", None, "adapter_live")),
        (8, None, None, None, None, None, 30.0, "  ", ("live", 30.0, "db_fallback", None, "adapter_live")),
        (9, None, None, None, None, None, None, None, ("live", 0.0, "none", None, "adapter_live")),
        (10, None, "removed", None, None, None, None, None, ("removed", 0.0, "none", None, "http_0")),
    ]
    df = spark.createDataFrame([r[:-1] for r in rows], "id int, http int, status string, price double, sold_price double, sold_at timestamp_ntz, last_price double, evidence string")
    got = {r["id"]: (r["verdict"], r["verdict_price"], r["price_source"], r["sold_date"], r["reason"]) for r in verdicts.decide(df).collect()}
    assert got == {r[0]: r[-1] for r in rows}
    assert verdicts.decide(df.limit(0)).count() == 0


def test_compare(spark):
    rows = [
        ("live", False, "live", True, False, (False, False, None, None, None)),
        ("live", False, "inactive", True, True, (False, True, None, True, "inactive_flag_mismatch")),
        ("live", None, "live", True, True, (False, False, None, True, "inactive_flag_mismatch")),
        ("live", False, "live", False, True, (False, False, None, None, None)),
        ("live", False, "live", True, None, (False, False, None, None, None)),
        ("live", False, "sold", True, True, (True, False, "sold", None, "status_mismatch main=live detected=sold")),
        ("sold", True, "live", True, False, (True, True, "live", False, "status_mismatch main=sold detected=live; inactive_flag_mismatch; look")),
        ("live", True, "blocked", True, False, (False, False, None, None, None)),
        ("live", True, None, None, None, (False, False, None, None, None)),
        (None, None, "removed", None, None, (True, False, "removed", None, "status_mismatch main= detected=removed")),
    ]
    df = spark.createDataFrame([(i, *r[:-1]) for i, r in enumerate(rows)], "id int, main_status string, main_inactive boolean, detected string, flag_seen boolean, detected_inactive boolean")
    got = {r["id"]: tuple(r)[-5:] for r in verdicts.compare(df, {"sold": "look"}).collect()}
    assert got == {i: r[-1] for i, r in enumerate(rows)}


def test_a_second_stamp_changes_nothing(spark):
    df = spark.createDataFrame([(1, 1.0, 5, "x", "v0", "{}"), (2, 0.2, None, None, None, None), (3, 0.7, 5, "x", "v0", "{}"), (4, None, 1, "y", "v0", None)], "id int, score double, severity int, why string, version string, raw string")
    rules = {1.0: {"severity": 0, "why": "new"}, 0.2: {"severity": 3}}
    once = verdicts.stamp(df, "score", rules, "r1", "version", cleared=("raw",))
    assert sorted(map(tuple, once.collect())) == [(1, 1.0, 0, "new", "r1", None), (2, 0.2, 3, None, "r1", None), (3, 0.7, 5, "x", "v0", "{}"), (4, None, 1, "y", "v0", None)]
    assert sorted(map(tuple, verdicts.stamp(once, "score", rules, "r1", "version", cleared=("raw",)).collect())) == sorted(map(tuple, once.collect()))


def test_marks_and_their_evidence(spark):
    listings = spark.createDataFrame([(1, "m1", None, "t", None, "kept"), (2, "m2", "old", None, "d", "kept")], "id int, model string, spam string, title string, description string, extra string")
    marks = spark.createDataFrame([(1, NOW, "a", "first"), (1, NOW, "b", "later"), (7, NOW, "a", "unknown")], "id int, at timestamp_ntz, source string, reason string")
    after, evidence = verdicts.mark(listings, marks, ["id"], "low")
    assert sorted((r["id"], r["spam"], r["extra"]) for r in after.collect()) == [(1, "low", "kept"), (2, "old", "kept")]
    (row,) = evidence.collect()
    assert row["evidence"] == '{"type":"spam_low","at":"2024-05-01T12:00:00","source":"b","reason":"later","id":1,"title":"t","description":"","old_spam":null,"new_spam":"low","old_model":"m1"}'
    features = spark.createDataFrame([(1, "older", None, None, None, None), (1, None, None, None, None, None), (2, None, None, "r", None, None)], "id int, fix_old string, fix_new string, fix_reason string, fix_evidence string, fix_at timestamp_ntz")
    fixed = sorted(tuple("" if v is None else str(v) for v in r[:4]) for r in verdicts.attach_fix(features, evidence, ["id"], "spam_low").collect())
    assert fixed == [("1", "m1", "m1", "spam_low"), ("1", "older", "m1", "spam_low"), ("2", "", "", "r")]


def test_phrases_are_whole_words_in_any_case(spark):
    texts = {"ØNSKER  Å\nKJØPE en": True, "jeg ønsker å kjøpe": True, "kjøpesenter": False, "WTB!": True, "newtb": False, "": False, "want to\tbuy": True, "wanted to buy": False, None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0]: r[1] for r in df.select("t", C.has_phrase(F.col("t"), C.BUYER_PHRASES)).collect()} == texts


def test_consistent_texts(spark):
    rows = [("Model-X 13 for sale", None, "model x 13", True), (None, "a MODEL  X-13", "Model X 13", True), ("WTB model x 13", "", "model x 13", False), ("other", "thing", "model x 13", False), ("any", "thing", None, False), ("any", "thing", "--", False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, title string, text string, model string, want boolean")
    got = df.select("want", verdicts.consistent(F.col("title"), F.col("text"), F.col("model"), C.BUYER_PHRASES).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_keyword_flags_are_three_valued(spark):
    rows = [("a", "Back is CRACKED", 5), ("a", "fine", 1), ("b", "back cracked", 4), ("c", None, 9), ("d", "cracked lens", None), ("e", "screen line", 7), ("e", None, 8)]
    df = spark.createDataFrame(rows, "k string, text string, level int")
    got = {r["k"]: (r["back_glass"], r["camera_lens"], r["display_fault"]) for r in verdicts.keyword_flags(df, ["k"], "text", "level", C.DAMAGE_WORDS, 5).collect()}
    assert got == {"a": (True, False, False), "b": (False, False, False), "c": (None, None, None), "d": (None, None, None), "e": (False, False, True)} | {"e": (False, False, True)}
