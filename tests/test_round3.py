"""What the findings of round 3 were about: ties, the order of sums, and plans whose tasks grow with the tables."""

import datetime
import re

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.llm import fingerprint
from tidemark.operators import asof, factors, modeling
from tidemark.plans import anchoring, encoding, merging, roles
from tidemark.streaming import logs


def tables(tmp_path, sf, **own):
    """The tables of sf, some of them made by SQL over `t`, the table itself."""
    for t in "region nation customer supplier part orders lineitem events conversations".split():
        made = own.get(t, "SELECT * FROM t")
        duckdb.execute(f"COPY (WITH t AS (SELECT * FROM read_parquet('{sf}/{t}.parquet')) {made}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet, ROW_GROUP_SIZE 2048)")
    return str(tmp_path)


def sql(name, folder, threads=1):
    duck = duckdb.connect()
    duck.execute(f"SET threads = {threads}")
    for t in "region nation customer supplier part orders lineitem events conversations".split():
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    return names, sorted(found.fetchall(), key=str)


def rows(df, names):
    return sorted(map(tuple, df.select(*names).collect()), key=str)


def test_of_texts_of_one_length_the_first_is_stored(spark, sf, tmp_path):
    folder = tables(tmp_path, sf, conversations="SELECT * REPLACE (left(text, 3) AS text) FROM t")
    names, want = sql("touch_unchanged", folder)
    assert {r[names.index("action")] for r in want} >= {"touched", "replaced"}
    assert rows(merging.touch_unchanged(spark, folder), names) == want


def test_bands_do_not_depend_on_the_split_of_the_file(spark, sf, tmp_path):
    folder = tables(tmp_path, sf, lineitem="SELECT * FROM t ORDER BY hash(l_orderkey, l_partkey, l_shipdate)")
    names, want = sql("woe_bands", folder)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        assert rows(encoding.woe_bands(spark, folder), names) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def scans(df, of):
    return len(re.findall(rf"Scan parquet [^\n]*?{of}", df._jdf.queryExecution().executedPlan().toString()))


def test_scores_and_folds_read_stored_rows(spark, sf):
    rows = encoding.outcomes(spark, sf)
    assert scans(rows, "l_orderkey") == 1
    assert scans(modeling.out_of_fold(rows, "listing_id", ["price", "n_images"], "y"), "l_orderkey") == 0


@pytest.mark.parametrize("most", [10, 100])
def test_listings_are_dealt_over_more_tasks_the_more_rows_there_are(spark, sf, monkeypatch, most):
    want = roles.listings(spark, sf)
    monkeypatch.setattr(roles, "ROWS_OF_TASK", most)
    got = roles.listings(spark, sf)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert "o_orderkey#" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and f"], {-(-lines // most)}" in plan
    assert rows(got, want.columns) == rows(want, want.columns)


def test_weights_of_terms_move_no_term(spark):
    docs = spark.createDataFrame([(1, "one two two"), (2, "two three"), (3, None)], "doc_id bigint, text string")
    known = factors.vocabulary(docs, "text", 2, 10)
    got = factors.weights(docs, "doc_id", "text", known)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"]: (r["places"], r["weights"]) for r in got.collect()} == {1: ([0], [1.0]), 2: ([0], [1.0]), 3: ([], [])}


def test_only_texts_with_a_rival_move_to_be_compared(spark):
    docs = spark.createDataFrame([(k, f"text number {k}") for k in range(2000)] + [(2000, "Text  number 7"), (2001, "text number 9"), (2002, None), (2003, "")], "doc_id long, text string")
    known = fingerprint.with_digest(docs).select("fingerprint")
    assert sorted(r["form"] for r in fingerprint.shared_forms(docs, known).collect()) == ["", "", *["text number 7"] * 2, *["text number 9"] * 2]
    found = {r["id"]: (r["group_id"], r["group_size"]) for r in fingerprint.compare_with_next(docs).collect()}
    assert [found[k] for k in (7, 2000, 9, 2001, 2002, 2003, 8)] == [(7, 2), (7, 2), (9, 2), (9, 2), (2002, 2), (2002, 2), (8, 1)]
    assert fingerprint.clashes(docs, known).count() == 0


def test_events_of_a_key_wait_as_one_value_a_batch(spark, tmp_path):
    schema, at = "listing_id long, event_id long, observed_at timestamp, inactive boolean", datetime.datetime(2024, 1, 1)
    events = [(k % 3, k, at + datetime.timedelta(minutes=k), k % 7 < 3) for k in range(300)]
    feed, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(feed)
    got = logs.drained(logs.change_log(spark.readStream.schema(schema).parquet(feed), "2 hours"), rocks=True, folder=out)
    want, was = [], {}
    for key, event, when, flag in events:
        if when <= at + datetime.timedelta(minutes=299) - datetime.timedelta(hours=2) and flag != was.get(key, False):
            want.append((key, event, flag))
        was[key] = flag
    assert sorted(map(tuple, got.collect())) == sorted(want)
    # what the watermark has not passed: three keys, one value each
    assert spark.read.format("statestore").option("stateVarName", "waiting").load(f"{out}/state").count() == 3


@pytest.mark.parametrize("name", ["reliability_gated_ptv", "relative_price"])
def test_customers_are_joined_only_where_one_stands_twice(spark, sf, tmp_path, name):
    assert scans(entry.queries()[name](spark, sf), "c_custkey") == 0
    folder = tables(tmp_path, sf, customer="SELECT * FROM t UNION ALL SELECT * FROM t WHERE c_custkey % 50 = 1")
    names, want = sql(name, folder)
    got = entry.queries()[name](spark, folder)
    assert scans(got, "c_custkey") == 1
    assert rows(got, names) == want


@pytest.mark.parametrize("most", [0, 200_000])
def test_fallbacks_are_dealt_over_more_tasks_the_more_listings(spark, sf, tmp_path, monkeypatch, most):
    monkeypatch.setattr(asof, "MOST_TOGETHER", 60)
    monkeypatch.setattr(asof, "MOST_BROADCAST", most)
    folder = tables(tmp_path, sf, customer="SELECT * REPLACE (nullif(c_mktsegment, 'BUILDING') AS c_mktsegment) FROM t WHERE c_custkey % 9 <> 1", orders="SELECT * FROM t WHERE o_orderkey < 1500")
    names, want = sql("hier_anchor_fallback", folder)
    got = anchoring.hier_anchor_fallback(spark, folder)
    assert rows(got, names) == want
    assert re.search(r"Exchange hashpartitioning\(listing_id[^)]*, 25\), REPARTITION_BY_NUM", got._jdf.queryExecution().executedPlan().toString())
