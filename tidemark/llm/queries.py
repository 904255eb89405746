"""The registered queries of this package and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, fingerprint, langid, linededup, mixing, pii, quality, repair, simhash, tokencount, toxicity, whitening
from .common import fold_of, table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that says control strings, formatted in windows and read back from them."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.format_windows(turns.unionByName(extra))).withColumnRenamed("conv", "conv_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter(F.col("base.kind"), lambda kind: kind == F.lit(k))).cast("bigint").alias(f"n_{k}") for k in pii.BASE]  # noqa: B023 (called at once)
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents outside the fold held out."""
    docs = table(spark, sf_dir, "documents")
    trees = langid.train(docs.where(fold_of("doc_id", 5) != 0))
    out = langid.predict(docs, trees)
    return out.select(F.col("id").alias("doc_id"), F.coalesce(fold_of("id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact digests of every document, of its edited text, and their likeness."""
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines and passages that stand earlier, and the numbers of the words that go."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.drop_repeats(docs, report="removed")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the target weights of their sources."""
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbatim overlap of every document with the benchmark."""
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("matches")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the fold held out."""
    docs = table(spark, sf_dir, "documents")
    index = toxicity.train(docs, table(spark, sf_dir, "labels").where(fold_of("doc_id", 5) != 0))
    out = toxicity.score(docs, index)
    held_out = F.coalesce(fold_of("id", 5) == 0, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels outside the fold held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels").where(fold_of("doc_id", 4) != 2))
    out = quality.score(docs, model)
    held_out = F.coalesce(fold_of("id", 4) == 2, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    out = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"), shingle=3)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired at the least price."""
    turns = table(spark, sf_dir, "conversations")
    return repair.summary(repair.damaged(turns), turns.select(F.col("conv_id").alias("conv"))).withColumnRenamed("conv", "conv_id")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding in the sixteen leading components of all of them, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_token_counts(spark: SparkSession, sf_dir: str, file: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """Tokens of every document, and how many code points of its normalised text fit the limit."""
    import public_tokenizers

    found = tokencount.count_prefixes(table(spark, sf_dir, "documents"), public_tokenizers.path(file))
    tokens = tokencount.total(F.col("counts"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"), tokencount.fitting(F.col("counts"), limit).alias("fit_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_chat_formatting, op2_pii, op3_langid, op4_fingerprint, op5_line_dedup, op6_mixing, op7_decontamination, op8_toxicity, op9_quality, op10_simhash, op11_conversation_repair, op12_embedding_whitening, op13_token_counts)}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _plus(x: str, price: str, letters: str) -> str:
    return f"{{'c': ({x}).c + {price}, 'a': ({x}).a || '{letters}'}}"


FAR = "{'c': 1000000, 'a': ''}"

ORACLE_SQL: dict[str, str] = {
    # a row at a time: the cheapest edits so far for each state that the roles can be in (nothing, system, user, assistant)
    "op11_conversation_repair": rf"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: [CAST(ord(c) AS BIGINT), 256, 256, 256, 256, 256, 256, 256, 256]))),
  lambda c, x: CASE WHEN x < 256 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END)) % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM k, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS x(copy) WHERE kind <> 0),
o AS (SELECT *, left(role, 1) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
  NOT regexp_matches(text, '[^	-
 ]') AS blank, NOT regexp_matches(text, '[.!?][	-
 ]*\z') AS cut FROM d),
f AS (SELECT *, blank OR seen AS gone, CASE WHEN cut THEN 3 ELSE 0 END AS t FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen FROM o)),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE seen AND NOT blank) AS duplicate, count(*) FILTER (WHERE cut AND NOT gone) AS truncated,
  count(*) FILTER (WHERE before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM f) GROUP BY 1),
w AS (SELECT conv_id, CAST(0 AS BIGINT) AS pos, [{{'c': 0, 'a': ''}}, {FAR}, {FAR}, {FAR}] AS v FROM s UNION ALL
  SELECT conv_id, pos, [{_plus("e[1]", "4", "D")}, list_min([{_plus("e[2]", "4", "D")}, CASE WHEN i = 's' AND NOT gone THEN {_plus("e[1]", "t", "K")} ELSE {FAR} END]),
   list_min([{_plus("e[3]", "4", "D")}, CASE WHEN gone THEN {FAR} ELSE {_plus("u", "3 + t", "R")} END, CASE WHEN i = 'u' AND NOT gone THEN {_plus("u", "t", "K")} ELSE {FAR} END]),
   list_min([{_plus("e[4]", "4", "D")}, CASE WHEN gone THEN {FAR} ELSE {_plus("e[3]", "3 + t", "R")} END, CASE WHEN i = 'a' AND NOT gone THEN {_plus("e[3]", "t", "K")} ELSE {FAR} END])]
  FROM (SELECT *, list_min([e[1], e[2], e[4]]) AS u FROM (SELECT f.*, [v[1], v[2], list_min([v[3], {_plus("v[1]", "3", "I")}, {_plus("v[2]", "3", "I")}, {_plus("v[4]", "3", "I")}]), list_min([v[4], {_plus("v[3]", "3", "I")}, {_plus("v[1]", "6", "II")}, {_plus("v[2]", "6", "II")}])] AS e
   FROM w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.pos = w.pos + 1))),
b AS (SELECT w.conv_id, list_min([v[1], v[4], {_plus("v[3]", "3", "I")}, {_plus("v[2]", "6", "II")}]) AS x FROM w JOIN s ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.pos = s.n),
p AS (SELECT conv_id, CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS pos, '' AS last, CAST(NULL AS VARCHAR) AS said FROM b UNION ALL
  SELECT p.conv_id, j + 1, p.pos + CASE WHEN e = 'I' THEN 0 ELSE 1 END, CASE WHEN e = 'D' THEN last WHEN e = 'K' THEN f.i ELSE nxt END,
   CASE WHEN e = 'D' THEN said ELSE coalesce(said || chr(10), '') || CASE WHEN e = 'K' THEN f.role WHEN nxt = 'u' THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE f.text END END
  FROM (SELECT p.*, substr(x.a, p.j + 1, 1) AS e, CASE WHEN last = 'u' THEN 'a' ELSE 'u' END AS nxt FROM p JOIN b ON p.conv_id IS NOT DISTINCT FROM b.conv_id WHERE p.j < length(x.a)) p LEFT JOIN f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.pos = p.pos + 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(x.c, 0) AS BIGINT) AS cost, coalesce(x.a, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON c.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN b ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN p ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND p.j = length(x.a)""",
    # budget 512, history 96, four tokens for each turn; windows follow one another, so they are counted turn by turn
    "op1_chat_formatting": r"""WITH RECURSIVE t AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM t),
s AS (SELECT conv_id, role, text, row_number() OVER w AS pos, CAST(sum(len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\x09-\x0D\x20]')) + 4) OVER w AS BIGINT) AS upto,
  len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\x09-\x0D\x20]')) + 4 AS tokens,
  11 + length(role) + length(text) + len(regexp_extract_all(role, '[\\<\[\]]')) + len(regexp_extract_all(text, '[\\<\[\]]')) AS chars
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
c AS (SELECT conv_id, CASE WHEN role = 'system' THEN 1 ELSE 0 END AS n_system, CASE WHEN role = 'system' THEN chars ELSE 0 END AS system_chars, greatest(1, 512 - 96 - CASE WHEN role = 'system' THEN upto ELSE 0 END) AS room FROM s WHERE pos = 1),
o AS (SELECT s.*, s.upto - tokens AS since, n_system, room FROM s JOIN c ON s.conv_id IS NOT DISTINCT FROM c.conv_id WHERE pos > n_system),
w AS (SELECT conv_id, pos, since AS base, 0 AS win FROM o WHERE pos = n_system + 1
  UNION ALL SELECT o.conv_id, o.pos, CASE WHEN o.upto - w.base > o.room THEN o.since ELSE w.base END, CASE WHEN o.upto - w.base > o.room THEN w.win + 1 ELSE w.win END FROM w JOIN o ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND o.pos = w.pos + 1),
f AS (SELECT conv_id, win, min(pos) AS first, min(base) AS base FROM w GROUP BY 1, 2),
h AS (SELECT f.conv_id, CAST(sum(o.chars) AS BIGINT) AS chars FROM f JOIN o ON o.conv_id IS NOT DISTINCT FROM f.conv_id AND win > 0 AND o.pos < f.first AND o.pos >= f.first - 25 AND f.base - o.since <= 96 GROUP BY 1),
n AS (SELECT conv_id, count(*) AS n_windows FROM f GROUP BY 1),
a AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS chars FROM s GROUP BY 1)
SELECT a.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, CAST(a.chars + (coalesce(n_windows, 1) - 1) * system_chars + coalesce(h.chars, 0) AS BIGINT) AS formatted_chars, coalesce(n_windows, 1) AS n_windows
FROM a JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN n ON a.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN h ON a.conv_id IS NOT DISTINCT FROM h.conv_id""",
    # every run of words of the length of a window is looked up; matches of an item on one diagonal without a gap are one
    "op7_decontamination": rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT item_id, p AS ip, ws[p:p + least(13, len(ws)) - 1] AS g FROM b, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS x(p) WHERE len(ws) > 0),
n AS (SELECT DISTINCT len(g) AS n FROM bw),
m AS (SELECT doc_id, p, len(g) AS n, item_id, ip FROM (SELECT doc_id, p, ws[p:p + n - 1] AS g FROM d, n, unnest(range(1, len(ws) - n + 2)) AS x(p)) JOIN bw USING (g)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM m)) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1),
l AS (SELECT doc_id, max(k) AS longest FROM (SELECT doc_id, max(p) - min(p) + n AS k FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, p - ip ORDER BY p) AS island FROM m) GROUP BY doc_id, item_id, p - ip, island, n) GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated, coalesce(longest, 0) AS longest
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN l USING (doc_id)""",
}
