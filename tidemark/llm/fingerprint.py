"""Canonical exact digests of documents.

The canonical form of a text is its NFKC normalisation, case-folded, with every run of white space replaced by one space
and none at the ends. The fingerprint is the 128-bit xxhash of the canonical UTF-8 bytes. Groups are formed by that hash;
inside a bucket the canonical bytes are compared, so that two different texts never share a group even if their hashes met.

A null text counts as empty; all empty texts share one fingerprint. Repeated rows share fingerprints and groups. Null ids
come last in a descending order of ids.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, checkpointed, mapped, text_batches

#: Raw text of one range of ids, in characters, when documents are put next to their neighbours.
RANGE_CHARS = 8 << 20
#: Most ranges; a larger corpus has larger ones, which are sorted on disk and read as a stream.
MOST_RANGES = 20_000
#: Slots that fingerprints are dealt to where it is marked which of them several rows share.
SLOTS = 1 << 24


def canonical(text: str | None) -> str:
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return " ".join(unicodedata.normalize("NFKC", text.casefold()).split() if not text.isascii() else text.lower().split())


def hashed(form: str) -> str:
    return xxhash.xxh3_128_hexdigest(form.encode("utf-8", "surrogatepass"))


def digest(text: str | None) -> str:
    return hashed(canonical(text))


def with_digest(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, fingerprint) of every row's whole text."""

    def run(batches):
        for part in text_batches(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([digest(t) for t in part.column(1).to_pylist()])], names=["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), run, f"id {kind}, fingerprint string")


def _slot() -> Column:
    return F.pmod(F.xxhash64("fingerprint"), F.lit(SLOTS)).cast("int")


def shared_slots(rows: DataFrame) -> DataFrame:
    """(_word, _bits): a bit for each slot of the fingerprints that several rows have; a row for 64 slots, SLOTS / 64 rows at most."""
    shared = rows.groupBy("fingerprint").count().where("count > 1").select(_slot().alias("_slot"))
    return shared.groupBy(F.shiftright("_slot", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, _slot & 63))").alias("_bits"))


def shared_forms(docs: DataFrame, rows: DataFrame, text: str = "text", hash_of=hashed) -> DataFrame:
    """(fingerprint, form) of the docs whose slot a fingerprint of several rows (fingerprint) has; the others have no rival."""

    def run(batches):
        for part in text_batches(batches):
            forms = [canonical(t) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([hash_of(f) for f in forms], pa.string()), pa.array(forms, pa.string())], names=["fingerprint", "form"])

    forms = mapped(docs.select(F.col(text).alias("text")), run, "fingerprint string, form string").withColumn("_slot", _slot())
    met = forms.join(F.broadcast(shared_slots(rows)), F.shiftright("_slot", 6) == F.col("_word"))
    return met.where(F.getbit("_bits", F.col("_slot").bitwiseAND(63)) == 1).select("fingerprint", "form")


def clashes(docs: DataFrame, rows: DataFrame, text: str = "text", hash_of=hashed) -> DataFrame:
    """(fingerprint): buckets that hold different canonical bytes; rows (fingerprint) are the fingerprints of all docs.

    Only the texts of a bucket of several rows move, and those of each task that are equal move once, so a huge group of
    copies moves as a few rows.
    """
    forms = shared_forms(docs, rows, text, hash_of).distinct()
    return checkpointed(forms.groupBy("fingerprint").count().where("count > 1").select("fingerprint"))


def with_groups(rows: DataFrame, clash: DataFrame) -> DataFrame:
    """rows (id, fingerprint, part, ...) with group_id, the smallest id of the same text, and group_size, without part.

    part is another hash of the form, which tells the texts of a clashing bucket apart.
    """
    marked = rows.join(clash.withColumn("_split", F.lit(True)), "fingerprint", "left").withColumn("part", F.when(F.col("_split"), F.col("part")).otherwise(0)).drop("_split")
    groups = marked.groupBy("fingerprint", "part").agg(F.min("id").alias("group_id"), F.count("*").alias("group_size"))
    return marked.join(groups, ["fingerprint", "part"]).drop("part")


def exact_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", hash_of=hashed) -> DataFrame:
    """(id, fingerprint, group_id, group_size) of every row: its group is the rows with the same canonical bytes."""

    def run(batches):
        for part in text_batches(batches):
            forms = [canonical(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([hash_of(f) for f in forms], pa.string()), pa.array([_part(f) for f in forms], pa.int64())], names=["id", "fingerprint", "part"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = checkpointed(mapped(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), run, f"id {kind}, fingerprint string, part bigint"))
    return with_groups(rows, clashes(docs, rows, text, hash_of)).select("id", "fingerprint", "group_id", "group_size")


def _part(form: str) -> int:
    return xxhash.xxh64_intdigest(form.encode("utf-8", "surrogatepass"), 1) - (1 << 63)


def edited_text(text: str, other: str) -> str:
    """text with its last half replaced by as many leading characters of other (or all of them)."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _compared(key, own: str, nxt: str) -> tuple:
    edited = edited_text(own, nxt)
    forms = [canonical(t) for t in (own, edited, nxt)]
    marks = [hashed(f) for f in forms]
    same = [float(marks[0] == marks[i] and forms[0] == forms[i]) for i in (1, 2)]
    return key, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), *marks[:2], *same, _part(forms[0])


def compare_with_next(docs: DataFrame, text: str = "text", id_col: str = "doc_id", range_chars: int = RANGE_CHARS) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, group_id, group_size) of every row.

    The next row is the one that follows in descending order of ids (then by text; null ids last); the first follows the
    last. Likeness is 1 where two texts fall into the same bucket and their canonical bytes are equal, else 0. The group
    is the rows with the same canonical bytes, named by its smallest id.

    The text moves once, into ranges of ids of bounded size, and neighbours meet inside them. Only the two ends of each
    range are matched across ranges. Texts of a bucket of several rows move once more, to be compared.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    order = [F.col("id").desc_nulls_last(), F.col("text")]
    ranged = rows.repartitionByRange(max(1, min(MOST_RANGES, -(-total // range_chars))), order[0]).sortWithinPartitions(*order)
    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part bigint"
    names = [f.split(" ")[0] for f in fields.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def within(batches):
        at, first, last, id_kind = TaskContext.get().partitionId(), None, None, None
        for part in text_batches(batches):
            id_kind, out = part.schema.field(0).type, []
            for key, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if last is None:
                    first = own
                else:
                    out.append((*_compared(*last, own), None, None, None))
                last = key, own
            yield batch(out, id_kind)
        if last is not None:
            yield batch([(last[0], *[None] * 7, at, first, last[1])], id_kind)

    def batch(out: list[tuple], id_kind) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [()] * 11
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [id_kind, *kinds, pa.int32(), pa.string(), pa.string()], strict=True)], names=[*names, "at", "head", "tail"])

    def across(batches):
        for part in text_batches(batches):
            out = [_compared(*r) for r in zip(*(c.to_pylist() for c in part.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [part.schema.field(0).type, *kinds], strict=True)], names=names)

    met = Tables(docs.sparkSession).write(mapped(ranged, within, f"{fields}, at int, head string, tail string"))
    ends = met.where("at is not null")
    follows = ends.select("at", F.coalesce(F.lead("at").over(Window.orderBy("at")), F.min("at").over(Window.partitionBy())).alias("to"))
    heads = ends.select(F.col("at").alias("to"), "head")
    pairs = ends.select("at", "id", "tail").join(follows, "at").join(heads, "to").select("id", F.col("tail").alias("own"), F.col("head").alias("nxt"))
    rows = met.where("at is null").select(*names).unionByName(mapped(pairs, across, fields))
    return with_groups(rows, clashes(docs, rows, text)).select(*names[:-1], "group_id", "group_size")
