"""The stages keep what they should: columns, clean documents, one of each group, and the words of the mix."""

import pytest

import corpus_pipeline
from tidemark.llm import decontam, mixing


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first, mixed = docs, None
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf).cache()
        ids, kept = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in (before, docs)]
        assert kept <= ids
        if name != "mixing":
            assert docs.columns == first.columns
        if name == "line_dedup":
            assert kept == ids
        if name == "near_dedup":
            assert docs.select("text").distinct().count() == docs.count()
        if name == "decontamination":
            marks = decontam.contamination(before, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated")
            assert kept == ids - {r["doc_id"] for r in marks.collect()}
        if name == "mixing":
            mixed = {r["doc_id"]: r["copies"] for r in docs.collect()}
            want = {r["id"]: r["copies"] for r in mixing.mix(before).collect() if r["copies"]}
            assert mixed == want
    assert mixed
    assert {r["doc_id"]: r["copies"] for r in corpus_pipeline.run(spark, sf).collect()} == mixed


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _own_1 string, _h bigint, _kept_h int, _spans string, _bad_h int, copies int, score double"
LONG = " ".join(f"w{k}" for k in range(150_000))
ODD = [
    (1, "", "en", "a", 0),
    (None, None, None, None, None),
    (None, "alpha beta gamma delta epsilon zeta", "en", None, 34),
    (None, "alpha beta gamma delta epsilon zeta", "en", None, 34),
    (None, "another text that has no number of its own", "en", "b", 42),
    (3, LONG, "en", "a", len(LONG)),
    (3, "one id and two texts, neither like the other", "en", "a", 44),
    (4, LONG + " and a little more", "en", "b", len(LONG) + 18),
]


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_on_odd_rows(spark, sf, rows):
    """Nulls, empty and very long texts, repeated rows and ids, an empty table and clashing names go through every stage."""
    docs = spark.createDataFrame([(*r, "x", 1, 2, "y", 3, 4, 0.5) for r in rows], SCHEMA)
    texts = [r[1] for r in rows]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        left = out.collect()
        if name == "mixing":
            assert out.columns == [c for c in docs.columns if c != "copies"] + ["copies"]
            assert all(r["copies"] > 0 for r in left)
            continue
        assert out.columns == docs.columns
        if name in ("toxicity", "decontamination"):
            assert sorted(str(r["text"])[:60] for r in left) == sorted(str(t)[:60] for t in texts)
        if name == "line_dedup" and rows:
            # rows without an id come first and equal rows are one document
            assert len(left) == len(rows)
            by = {(r["doc_id"], r["n_chars"]): r["text"] for r in left}
            assert by[3, len(LONG)] == LONG and by[4, 17] == "and a little more" and sum(r["text"] == ODD[2][1] for r in left) == 2
        if name == "near_dedup" and rows:
            assert sorted((r["doc_id"] or 0, (r["text"] or "")[:5]) for r in left) == [(0, "alpha"), (0, "anoth"), (1, ""), (3, "one i"), (3, LONG[:5])]
