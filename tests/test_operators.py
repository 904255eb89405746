"""Operators that raise, and edges that the queries over the tables do not reach."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, certify, graph, merge, vectors
from tidemark.sources.ingest import html_fields

NOW = datetime(2024, 1, 30)


@pytest.fixture(scope="module")
def registry(spark):
    rows = [("fresh", "CERTIFIED", NOW - timedelta(hours=3)), ("old", "CERTIFIED", NOW - timedelta(hours=30)), ("failed", "FAILED", NOW), ("undated", "CERTIFIED", None)]
    return spark.createDataFrame(rows, "entrypoint string, status string, certified_at timestamp_ntz")


def test_only_certified_surfaces_are_read(spark, registry):
    surface, day = spark.range(3), timedelta(hours=24)
    assert certify.require_certified(registry, surface, "entrypoint", "fresh", NOW, day).count() == 3
    for name in ("old", "failed", "undated", "unknown"):
        with pytest.raises(certify.NotCertified):
            certify.require_certified(registry, surface, "entrypoint", name, NOW, day)
    changed = spark.createDataFrame([("fresh",)], "entrypoint string")
    with pytest.raises(certify.NotCertified, match="drifted"):
        certify.require_certified(registry, surface, "entrypoint", "fresh", NOW, day, changed)
    certify.require_all(registry, changed, "entrypoint", NOW, day)
    with pytest.raises(certify.NotCertified, match="1 expired, 1 not_certified|1 expired"):
        certify.require_all(registry, registry.where("entrypoint in ('old', 'fresh')"), "entrypoint", NOW, day)


def test_drift_policies(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "day int, hash string")
    now = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "day int, hash string")
    with pytest.raises(certify.NotCertified, match="2 of the newest 3"):
        certify.apply_drift_policy(base, now, "day", "hash", "fail", 3)
    kept = {r["day"]: (r["drifted"], r["hash"]) for r in certify.apply_drift_policy(base, now, "day", "hash", "allow", 3).collect()}
    assert kept == {2: (False, "b"), 3: (True, "c"), 4: (True, None)}
    taken = {r["day"]: r["hash"] for r in certify.apply_drift_policy(base, now, "day", "hash", "rebaseline", 3).collect()}
    assert taken == {2: "b", 3: "x", 4: "d"}
    with pytest.raises(ValueError):
        certify.apply_drift_policy(base, now, "day", "hash", "perhaps", 3)


def test_schema_contract_and_its_hash(spark):
    rows = spark.createDataFrame([(1, None)], "a bigint, b string")
    found = {r["name"]: (r["ok"], r["nulls"]) for r in certify.check_schema(rows, [("a", "bigint", False), ("b", "string", False), ("c", "int", True)]).collect()}
    assert found == {"a": (True, 0), "b": (False, 1), "c": (False, None)}
    one, two = (rows.select(certify.contract_hash([("a", "bigint", n)]).alias("h")).first()["h"] for n in (True, False))
    assert one != two


def test_gate_counts_unknown_times_as_inside(spark):
    t0 = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, t0, t0 + timedelta(hours=24), 5), (2, t0, t0 + timedelta(hours=25), 5), (3, t0, None, 5)], "id int, t0 timestamp_ntz, done timestamp_ntz, v int")
    assert {r["id"]: r["v"] for r in certify.sla_gate(rows, ["v"], "done", "t0").collect()} == {1: 5, 2: None, 3: 5}
    assert [r["id"] for r in certify.sla_leaks(rows, ["v"], "done", "t0").collect()] == [2]


def test_walk_ends_or_raises(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "a int, b int")
    roots = spark.createDataFrame([(1,)], "node int")
    assert sorted(r["node"] for r in graph.closure(edges, roots).collect()) == [1, 2, 3]
    with pytest.raises(RuntimeError):
        graph.closure(edges, roots, rounds=1)


def test_walk_along_chain_cycle_and_star(spark):
    chain = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert graph.closure(chain, spark.createDataFrame([(0,)], "node bigint")).count() == 201
    ring = spark.range(9).selectExpr("id as a", "(id + 1) % 9 as b").unionByName(spark.createDataFrame([(None, 7), (3, None)], "a bigint, b bigint"))
    assert sorted(r["node"] for r in graph.closure(ring, spark.createDataFrame([(7,), (7,), (None,)], "node bigint")).collect()) == list(range(9))
    star = spark.range(100_000).selectExpr("-1L as a", "id as b").unionByName(spark.range(5).selectExpr("id as a", "-1L as b"))
    assert graph.closure(star, spark.createDataFrame([(4,), (200_000,)], "node bigint")).count() == 100_002


def test_embargoed_medians_against_plain(spark):
    """Ties, empty windows, keys without sales, nulls and any cut of the values into ranges."""
    rng = np.random.default_rng(3)
    start = date(2024, 1, 1)
    pool = [(["a", "b"][rng.integers(2)], start + timedelta(days=int(rng.integers(60))), float(rng.integers(1, 30))) for _ in range(800)]
    targets = [(k, start + timedelta(days=d)) for k in ("a", "b", "c") for d in range(-3, 75, 5)] + [(None, start), ("a", None)]
    pool += [(None, start, 1.0), ("a", None, 2.0), ("b", start, None)]
    sold, asked = spark.createDataFrame(pool, "k string, day date, v double"), spark.createDataFrame(targets, "k string, at date")
    pool = [x for x in pool if None not in x]
    for most in (10**6, 200, 60, 5):
        got = {(r["k"], r["at"]): r for r in asof.embargo_median(asked, sold, ["k"], "at", "day", "v", {"x": (14, 2), "y": (30, 0)}, most).collect()}
        assert got.pop((None, start))["n_x"] == 0 and got.pop(("a", None))["median_y"] is None
        assert len(got) == len(targets) - 2
        for k, at in targets[:-2]:
            for name, (low, high) in {"x": (14, 2), "y": (30, 0)}.items():
                own = [v for key, day, v in pool if key == k and at - timedelta(days=low) <= day < at - timedelta(days=high)]
                assert got[k, at][f"n_{name}"] == len(own)
                assert got[k, at][f"median_{name}"] == (pytest.approx(float(np.median(own))) if own else None)


def test_wavelet_looks_up_any_rank():
    rng = np.random.default_rng(7)
    for size, kinds in ((1, 1), (50, 1), (300, 7), (300, 300), (0, 1)):
        days, values, counts = rng.integers(0, 40, size), rng.integers(0, kinds, size) / 3, rng.integers(1, 4, size)
        matrix = asof.Wavelet(days, values, counts)
        first = rng.integers(-5, 45, 200)
        last = first + rng.integers(-3, 30, 200)
        low, high = matrix.between(first, last)
        for k in range(200):
            own = sorted(np.repeat(values, counts)[(np.repeat(days, counts) >= first[k]) & (np.repeat(days, counts) <= last[k])])
            assert matrix.upto[high[k]] - matrix.upto[low[k]] == len(own)
            if own:
                rank = rng.integers(len(own))
                assert matrix.value(low[k : k + 1], high[k : k + 1], np.array([rank]))[0] == own[rank]


def test_rows_in_work_grow_with_pool_and_targets(spark):
    """A longer window moves no more rows."""
    pool = spark.range(20_000).selectExpr("cast(id % 2 as int) as k", "date_add(date'2020-01-01', cast(id % 700 as int)) as day", "cast(id % 997 as double) as v")
    asked = spark.range(700).selectExpr("cast(id % 2 as int) as k", "date_add(date'2020-01-01', cast(id as int)) as at")
    for low in (3, 600):
        plan = asof.embargo_median(asked, pool, ["k"], "at", "day", "v", {"x": (low, 0)})._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_asof_across_stretches(spark):
    """The last row of a key is found however long ago it was, ties by id, nulls apart; stretches change nothing."""
    rng = np.random.default_rng(4)
    t = lambda h: datetime(2020, 1, 1) + timedelta(hours=int(h))
    left = [(i, ["a", "b", None, "z"][rng.integers(4)], t(rng.integers(0, 9000))) for i in range(300)]
    right = [(["a", "b", None][rng.integers(3)], t(rng.integers(0, 300) * 30), i) for i in range(60)]
    l, r = spark.createDataFrame(left, "i int, k string, t timestamp_ntz"), spark.createDataFrame(right, "k string, s timestamp_ntz, v int")
    for strict in (False, True):
        want = {}
        for i, k, at in left:
            own = [(s, v) for key, s, v in right if key is not None and key == k and (s < at if strict else s <= at)]
            want[i] = max(own)[1] if own else None
        for days in (1, 32, 4000):
            got = {x["i"]: x["v"] for x in asof.asof_join(l, r, ["k"], "t", "s", tie=["v"], strict=strict, days=days).collect()}
            assert got == want


def test_history_plan(spark):
    fields = "id int, status string, price double, reliable boolean, bidding boolean, main_price double, was_inactive boolean, inactive boolean, last_price double, has_baseline boolean"
    rows = [
        (1, "sold", 9.0, True, False, 5.0, False, False, 8.0, True),
        (2, "removed", 9.0, False, False, 5.0, False, False, 8.0, True),
        (3, "live", 9.0, True, False, 5.0, False, True, 8.0, False),
        (4, "live", 9.0, True, True, 5.0, False, True, None, True),
        (5, "live", 8.0, True, False, 5.0, False, None, 8.0, True),
    ]
    got = {}
    for r in merge.history_plan(spark.createDataFrame(rows, fields), ["id"]).collect():
        got.setdefault(r["id"], []).append((r["kind"], r["price"], r["reason"]))
    assert got == {1: [("event", 9.0, "terminal_sold")], 2: [("event", 8.0, "terminal_removed")], 3: [("baseline", 9.0, "daily_baseline_missing"), ("event", 9.0, "price_changed")], 4: [("event", 5.0, "inactive_flip")]}


def test_sweep_dry_run_and_prototype_limit(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "live", 1), (2, "live", 2), (3, "live", 9)], "k int, status string, seen int")
    after, log = merge.sweep(rows, "k", "status", "seen", F.lit(5), 1, dry_run=True)
    assert {r["status"] for r in after.collect()} == {"live"} and log.first().asDict() == {"due": 2, "swept": 1, "oldest": 1, "newest": 1, "dry_run": True}
    after, _ = merge.sweep(rows, "k", "status", "seen", F.lit(5), 1)
    assert {r["k"]: r["status"] for r in after.collect()} == {1: "stale", 2: "live", 3: "live"}
    vecs = spark.createDataFrame([(1, [3.0, 4.0], 1), (2, [0.0, 0.0], 1), (3, [1.0, 0.0], 2)], "id int, v array<float>, label int")
    got = {r["id"]: (r["nearest"], round(r["margin"], 6)) for r in vectors.prototype_similarity(vecs, "id", "v", "label").collect()}
    assert got == {1: (1, 0.4), 3: (2, 0.4)}
    monkeypatch.setattr(vectors, "MOST_PROTOTYPES", 1)
    with pytest.raises(ValueError):
        vectors.prototype_similarity(vecs, "id", "v", "label")


def test_hash_tree_names_the_day_and_the_range(spark):
    rows = [(d, k) for d in (1, 2) for k in range(0, 5000, 7)]
    tree = lambda rs: certify.leaf_hashes(spark.createDataFrame(rs, "d int, k bigint"), ["d"], "k", 100)
    base, moved = tree(rows), tree([r for r in rows if r != (2, 700)] + [(2, None)])
    found = certify.drifted_ranges(base, moved, ["d"]).collect()
    assert [(r["d"], r["part"]) for r in found] == [(2, 7)]
    roots = lambda leaves, levels: {r["d"]: r["hash"] for r in certify.root_hashes(leaves, ["d"], levels, 10).collect()}
    for levels in (1, 2, 3):
        one, two = roots(base, levels), roots(moved, levels)
        assert one[1] == two[1] and one[2] != two[2]


def test_plans_hash_by_what_they_compute(spark, sf):
    orders = lambda: spark.read.parquet(f"{sf}/orders.parquet")
    one = orders().select((F.col("o_totalprice") * 2).alias("a"), "o_orderkey").where("a > 5").select(F.col("a").alias("twice"), "o_orderkey")
    two = orders().select((F.col("o_totalprice") * 2).alias("b"), "o_orderkey").where("b > 5").select(F.col("b").alias("twice"), "o_orderkey")
    assert certify.plan_hash(one) == certify.plan_hash(two)
    others = [two.withColumnRenamed("twice", "doubled"), orders().select((F.col("o_totalprice") * 3).alias("twice"), "o_orderkey"), two.where("twice < 9")]
    assert len({certify.plan_hash(df) for df in [one, *others]}) == 4
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_tax")
    assert certify.plan_hash(lines) != certify.plan_hash(spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").select("l_tax")) or sf.endswith("sf0.01")


def test_time_hidden_in_views_and_subqueries_is_found(spark, sf):
    spark.read.parquet(f"{sf}/orders.parquet").createOrReplaceTempView("_o")
    spark.sql("create or replace temporary view _v as select *, current_date() as today from _o")
    spark.sql("create or replace temporary view _w as select o_orderkey from _v where o_orderdate < today")
    assert certify.plan_tokens(spark.table("_w")) == ["CurrentDate"]
    assert certify.plan_tokens(spark.sql("select * from _o where o_orderdate < (select max(now()) from _o)")) == ["Now"]
    assert certify.plan_tokens(spark.table("_o").withColumn("r", F.rand())) == ["Rand"]
    assert certify.require_fixed(spark.table("_o")).columns
    with pytest.raises(certify.NotCertified, match="CurrentDate"):
        certify.require_fixed(spark.table("_w"))


def test_prior_stats_of_the_days_asked_for(spark):
    rng = np.random.default_rng(9)
    start = date(2024, 1, 1)
    rows = [("pq"[rng.integers(2)], "abc"[rng.integers(3)], start + timedelta(days=int(rng.integers(40)))) for _ in range(300)]
    asked = [("p", k, start + timedelta(days=d)) for k in "ab" for d in (0, 7, 60)] + [("q", "z", start + timedelta(days=9))]
    out = asof.prior_stats(spark.createDataFrame(rows, "part string, kind string, day date"), spark.createDataFrame(asked, "part string, kind string, at date"), "part", "kind", "day", "at", 0.5, 3)
    got = {(r["part"], r["kind"], r["at"]): r for r in out.collect()}
    assert set(got) == set(asked)
    for part, kind, at in asked:
        r = got[part, kind, at]
        count = lambda p=None, k=None, at=at: sum((p in (None, x)) and (k in (None, y)) and d < at for x, y, d in rows)
        kinds = sorted({k for p, k, _ in asked if p == part})
        whole = count(part) + 0.5 * len(kinds)
        assert r["n_before"] == count(part, kind) and r["share"] == pytest.approx((count(part, kind) + 0.5) / whole)
        assert r["global_share"] == pytest.approx((count(None, kind) + 0.5) / (count() + 1.5))
        assert r["place"] == 1 + len({count(part, k) for k in kinds if count(part, k) > count(part, kind)})


def test_merge_of_sources_rule_by_rule(spark):
    kind = "k int, status string, price double, seen int, source string"
    old = [(1, "live", 5.0, 10, "own"), (2, "live", 5.0, 10, "other"), (3, "sold", 5.0, 10, "own"), (4, "live", 5.0, 10, "other"), (5, "live", 5.0, 10, "own"), (6, "removed", 5.0, 10, "own"), (7, "live", 5.0, 10, None)]
    new = [(1, "live", 7.0, 5, "own"), (2, "removed", 7.0, 20, "own"), (3, "removed", 7.0, 20, "own"), (4, "sold", 9.0, 20, "own"), (5, "removed", 7.0, 20, "own"), (6, "live", 7.0, 20, "own"), (8, "live", None, 1, "own")]
    got = {r["k"]: tuple(r)[1:] for r in merge.merge_sourced(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind), ["k"], "own", "sold", "removed").collect()}
    assert got == {
        1: ("live", 7.0, 10, "own"), 2: ("live", 5.0, 10, "other"), 3: ("sold", 5.0, 10, "own"), 4: ("sold", 9.0, 20, "other"),
        5: ("removed", 5.0, 20, "own"), 6: ("removed", 5.0, 20, "own"), 7: ("live", 5.0, 10, None), 8: ("live", None, 1, "own"),
    }


def test_linked_data_is_json(spark):
    ld = lambda *parts: "".join(f'<script type="application/ld+json">{p}</script>' for p in parts)
    pages = [
        (1, ld('{"name": "Short", "offers": {"name": "a much longer nested name"}}', '[{"name": "The longest name"}, {"description": "D"}, 7]') + "<title>t</title>"),
        (2, ld('{"name": "cut') + "<title> T </title>"), (3, ld('{"name": 12345}', "null", "[]") + "<h1>x</h1>"), (4, None), (5, ld('{"name": "a \\"quoted\\" one"}')),
    ]
    got = {r["k"]: (r["title"], r["title_source"], r["description"]) for r in html_fields(spark.createDataFrame(pages, "k int, html string"), "k", "html").collect()}
    assert got == {1: ("The longest name", "jsonld", "D"), 2: ("T", "title", None), 3: ("12345", "jsonld", None), 4: (None, None, None), 5: ('a "quoted" one', "jsonld", None)}
