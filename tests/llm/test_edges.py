"""Nulls, empty and repeated rows, empty tables and clashing columns: every operator gives its defined result."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, decontam, fingerprint, langid, linededup, mixing, pii, quality, simhash, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, fp string, spans string, size int, n int, _uid string"
LONG = "\n".join(" ".join(f"word{i}x{k}" for k in range(30)) for i in range(40))
ROWS = [
    (1, "", "en", "a", 0),
    (2, None, None, None, None),
    (None, "alpha beta gamma", "en", "b", 16),
    (3, LONG, "en", "a", len(LONG)),
    (4, LONG, "en", None, len(LONG)),
    (5, "alpha beta gamma", None, "b", 16),
    (5, "alpha beta gamma", None, "b", 16),
    (6, "!!! 123 ...\u0001\u0002", "de", "b", 11),
]


@pytest.fixture(params=["rows", "empty"])
def docs(spark, request):
    return spark.createDataFrame([(*r, 7, "x", "y", 1, 2, "z") for r in ROWS] if request.param == "rows" else [], SCHEMA)


def rows_of(df):
    return df.collect()


def test_simhash(docs):
    n = docs.count()
    out = rows_of(simhash.near_duplicate_groups(docs))
    assert len(out) == n
    if n:
        by = {r["id"]: r["component"] for r in out}
        assert by[4] == 3 and by[None] == by[5] == 5 and by[1] == by[2] == 1
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == (4 if n else 0)


def test_line_dedup(docs):
    out = linededup.drop_repeats(docs, report="what went")
    assert out.columns == [*docs.columns, "what went"] and out.count() == docs.count()
    got = {r["doc_id"]: r["text"] for r in rows_of(out)}
    if got:
        assert got[None] == "alpha beta gamma" and got[5] == "" and got[2] is None and got[1] == ""
        assert got[3] == LONG and got[4] == "" and got[6] == ROWS[-1][1]
        assert {r["doc_id"]: r["n_chars"] for r in rows_of(out)}[4] == 0


def test_passages_inside_lines(spark):
    words = [f"p{k}" for k in range(60)]
    texts = {1: "a b " + " ".join(words) + " c", 2: "one long line " + " ".join(words) + " goes on", 3: "x\n" + " ".join(words[:30]) + "\n" + " ".join(words[30:]) + "\ny", 4: " ".join(words[:49])}
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in rows_of(linededup.drop_repeats(rows))}
    assert got == {1: texts[1], 2: "one long line goes on", 3: "x\ny", 4: texts[4]}


def test_repeated_lines(spark):
    texts = ["a b c\n\nx", " a  b c \nk\na b c", "a b c d\na b", "x\nk"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    clean = lambda **k: [r["text"] for r in sorted(rows_of(linededup.drop_repeats(rows, **k)))]
    assert clean() == [texts[0], " k", texts[2], texts[3]]
    assert clean(line_words=1) == [texts[0], " k", texts[2], ""] and clean(line_words=None) == texts


def test_line_dedup_of_long_texts(spark):
    """A text of millions of bytes, with one word that fills pieces of its own, is hashed like any other."""
    rng, most = __import__("random").Random(4), linededup.PIECE
    base = [f"w{rng.randrange(1 << 40)}" for _ in range(60)]
    long = " ".join(f"v{rng.randrange(1 << 40)}" for _ in range(150_000))
    texts = [" ".join(base), "y" * (most + 5) + " " + " ".join(base) + " " + long, "\n".join([long, "z" * 3 * most, "tail end here"]), "tail end here"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in rows_of(linededup.drop_repeats(rows))}
    assert got == {0: texts[0], 1: "y" * (most + 5) + " " + long, 2: "z" * 3 * most + "\ntail end here", 3: ""}


def test_mixing(docs):
    out = rows_of(mixing.mix(docs))
    assert len(out) == docs.count() and all(0 <= r["copies"] <= 3 for r in out)


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, "Alpha, BETA gamma"), (2, None), (3, "")], "item_id bigint, text string")
    out = rows_of(decontam.contamination(docs, items))
    assert len(out) == docs.count()
    assert all(r["contaminated"] == (r["n_words"] == 3 and r["n_hit"] == 3) for r in out)
    blocks = rows_of(decontam.contamination(docs.where("doc_id = 3"), items.unionByName(items.select(F.col("item_id") + 9, F.lit("word1x1 word1x2")).toDF(*items.columns)), block_words=1))
    assert [r["n_hit"] for r in blocks] in ([], [2])
    assert rows_of(decontam.contamination(docs, items.limit(0))) is not None


def test_decontamination_of_repeated_rows(spark, docs):
    """Blocks of items change nothing, repeated rows included; an item without an id counts for hit words."""
    items = spark.createDataFrame([(1, "Alpha, BETA gamma"), (2, "word1x1 word1x2"), (None, "word2x5 word2x6")], "item_id bigint, text string")
    twice = docs.unionByName(docs.where("doc_id is null"))
    one, many = (sorted(map(str, rows_of(decontam.contamination(twice, items, **k)))) for k in ({}, {"block_words": 1}))
    assert one == many and len(many) == twice.count()
    if many:
        assert {r["n_hit"] for r in rows_of(decontam.contamination(docs.where("doc_id = 3"), items))} == {4}


def test_rows_without_or_with_equal_ids(spark):
    """Each row is judged by its own text."""
    texts = [(i, " ".join(f"{name}{k}" for k in range(40))) for i, name in ((None, "a"), (None, "b"), (None, "b"), (None, "c"), (7, "c"), (8, "d"), (8, "e"))]
    rows = spark.createDataFrame(texts, "doc_id bigint, text string")
    left = sorted((r["doc_id"] or 0, r["text"].split()[0]) for r in rows_of(simhash.keep_one(rows)))
    assert left == [(0, "a0"), (0, "b0"), (7, "c0"), (8, "d0"), (8, "e0")]
    items = spark.createDataFrame([(1, texts[0][1]), (2, texts[5][1])], "item_id bigint, text string")
    left = sorted((r["doc_id"] or 0, r["text"].split()[0]) for r in rows_of(decontam.drop_contaminated(rows, items)))
    assert left == [(0, "b0"), (0, "b0"), (0, "c0"), (7, "c0"), (8, "e0")]


def test_fingerprint(docs):
    n = docs.count()
    assert len(rows_of(fingerprint.compare_with_next(docs))) == n
    assert len(rows_of(fingerprint.compare_with_next(docs, range_chars=100))) == n
    groups = {r["id"]: (r["group_id"], r["group_size"]) for r in rows_of(fingerprint.exact_groups(docs))}
    if n:
        assert groups[4] == (3, 2) and groups[5] == (5, 3) and groups[2] == (1, 2)


def test_langid(docs):
    out = {r["id"]: r for r in rows_of(langid.predict(docs, langid.train(docs)))}
    if out:
        assert out[1]["lang_pred"] == out[2]["lang_pred"] == out[6]["lang_pred"] == "und" and out[3]["lang_pred"] == "en"


@pytest.mark.parametrize("labelled", [[], [(1, 0), (3, 1), (None, 1), (5, None)]])
def test_classifiers(spark, docs, labelled):
    labels = spark.createDataFrame([(i, y, y) for i, y in labelled], "doc_id bigint, toxic int, quality int")
    index = toxicity.train(docs, labels)
    assert len(rows_of(toxicity.score(docs, index))) == docs.count()
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    scores = rows_of(quality.score(docs, quality.train(docs, labels)))
    assert len(scores) == docs.count() and all(0 <= r["score"] <= 1 for r in scores)


def test_pii(docs):
    out = rows_of(pii.find_spans(docs))
    assert len(out) == docs.count() and all(r["base"] == [] for r in out)


def test_chat(spark):
    said = [(1, 0, "system", "be <s>[kind]</s>\\l"), (1, 1, "user", None), (1, 2, "assistant", "x " * 2000), (1, 2, "assistant", "x " * 2000), (1, None, None, "]\n["), (None, 0, "assistant", ""), (2, 0, "system", "alone")]
    windows = chat.format_windows(spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string"))
    out = {r["conv"]: r for r in chat.read_back(windows).collect()}
    assert out[1]["n_turns"] == 5 and out[1]["loss_chars"] == 8000 and out[None]["loss_chars"] == 0 and out[2]["n_turns"] == 1
    assert not chat.read_back(chat.format_windows(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))).collect()


def test_very_long_texts(spark):
    """A text of more than a megabyte is handled whole by every operator."""
    body = " ".join(f"w{k * 7919 % 100_003}" for k in range(200_000))
    tail = "write to someone@example.org now"
    rows = spark.createDataFrame([(1, f"{body} {tail}", "en", "a"), (2, "short text here", "en", "a")], "doc_id bigint, text string, lang string, source string")
    assert [r["base"] for r in pii.find_spans(rows).orderBy("id").collect()][0][0]["start"] == len(body) + len(" write to ")
    assert {r["lang_pred"] for r in langid.predict(rows, langid.train(rows)).collect()} == {"en"}
    assert {r["n_chars"] for r in fingerprint.compare_with_next(rows).collect()} == {len(body) + 1 + len(tail), 15}
    assert len({r["fp"] for r in simhash.near_duplicate_groups(rows).collect()}) == 2
    items = spark.createDataFrame([(1, " ".join(body.split()[-400:]))], "item_id bigint, text string")
    found = {r["doc_id"]: r for r in decontam.contamination(rows, items).collect()}
    assert found[1]["longest"] == 400 and found[1]["n_words"] == 200_006 and not found[2]["n_hit"]
    assert {r["size"] for r in mixing.mix(rows).collect()} == {200_004, 3}
    scores = quality.score(rows, quality.train(rows, spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")))
    assert all(0 <= r["score"] <= 1 for r in scores.collect())
    turns = rows.select(F.lit(1).cast("bigint").alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("assistant").alias("role"), "text")
    assert chat.read_back(chat.format_windows(turns)).first()["loss_chars"] == len(body) + 1 + len(tail) + 15
