"""What the findings of round 4 were about."""

import duckdb

import __spark_entry__ as entry
from tidemark.operators import certify

ODD = [None, "", "now", "NOW", "know", "snow now", "nownow", "now_", "_now", "nownow now", "now\n", "\nnow", "now1 now", "1now", "know\u0000now", "é now", "énow", "nowé", "\U0001f600now\U0001f600", "İnow", "nowİ", "LİCENSE", "Know", "noKw now", "passworK", "apache-LICENSE.now,version", "password password", "pass word", "versions version", "x" * 5000 + " version", "now " * 3000]


def test_tokens_of_odd_texts(spark, tmp_path):
    duckdb.execute(f"COPY (SELECT unnest(range({len(ODD)})) AS doc_id, unnest($1::VARCHAR[]) AS text) TO '{tmp_path}/documents.parquet' (FORMAT parquet)", [ODD])
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    want = sorted(duck.execute(entry.oracle_sql()["time_token_scan"]).fetchall())
    assert len(want) > 15
    assert sorted(map(tuple, entry.queries()["time_token_scan"](spark, str(tmp_path)).select("doc_id", "tokens").collect())) == want


def test_a_text_is_searched_once_for_a_token(spark, sf):
    plan = entry.queries()["time_token_scan"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("RLIKE("), plan.count("lower(")) == (5, 1)


def test_tokens_are_words_and_not_patterns(spark):
    texts = spark.createDataFrame([(1, "c++ (a.b)"), (2, "axb"), (3, "A.B")], "id long, text string")
    assert sorted(map(tuple, certify.tokens_found(texts, "id", "text", ["a.b", "C++"]).collect())) == [(1, "a.b,C++"), (3, "a.b")]
