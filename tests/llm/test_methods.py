"""The methods inside the operators against plain Python: code lengths, labelers, rules, matches, roundings, digests."""

import hashlib
import math
import random
import re
import time
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import decontam, fingerprint, langid, mixing, pii, quality
from tidemark.llm.common import fold_of
from tidemark.llm.queries import QUERIES


# language: prediction by partial matching


def plain_code_length(counts, text):
    """Bits of a text under counts of four-byte runs: method C, from three bytes of context down to a uniform code."""
    tables = []
    for k in range(4):
        table = defaultdict(Counter)
        for gram, n in counts.items():
            table[gram[3 - k : 3]][gram[3]] += n
        tables.append(table)
    data, bits = b"\n\n\n" + text.lower().encode(), 0.0
    for i in range(3, len(data)):
        for k in (3, 2, 1, 0):
            own = tables[k].get(data[i - k : i])
            if not own:
                continue
            total = sum(own.values()) + len(own)
            if data[i] in own:
                bits -= math.log2(own[data[i]] / total)
                break
            bits -= math.log2(len(own) / total)
        else:
            bits += 8
    return bits


def test_code_lengths():
    texts = {"a": ["the cat sat", "the dog", "Straße über"], "b": ["el gato come", "日本語 テキスト", "perro"], "c": ["Привет мир"]}
    counts, arrays = {}, {}
    for lang, own in texts.items():
        grams = Counter(bytes(d[i : i + 4]) for t in own for d in [b"\n\n\n" + t.lower().encode()] for i in range(len(d) - 3))
        counts[lang] = grams
        keys = sorted(int.from_bytes(g, "big") for g in grams)
        arrays[lang] = np.array(keys, np.int64), np.array([grams[k.to_bytes(4, "big")] for k in keys], np.int64)
    trees = langid.ContextTrees(sorted(texts), arrays).numbered()
    for text in ["the gato", "日本 cat", "xyz\x01\x7f ÿ", "Привет, the cat", "a", "q" * 50, "the cat sat " * 40]:
        want = [plain_code_length(counts[k], text) for k in sorted(texts)]
        assert trees.code_lengths(text) == pytest.approx(want, rel=1e-5)
        assert trees.code_lengths(text, piece=3) == pytest.approx(want, rel=1e-5)


def test_training_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    trees = langid.train(docs, max_rows=1 << 30, max_chars=1 << 60).numbered()
    rows = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    counts = defaultdict(Counter)
    for r in rows:
        if r["lang"] is not None and r["text"] is not None:
            d = b"\n\n\n" + r["text"].lower().encode()
            counts[r["lang"]].update(d[i : i + 4] for i in range(len(d) - 3))
    assert trees.langs == sorted(counts)
    for r in [x for x in rows if x["text"]][:20]:
        assert trees.code_lengths(r["text"][:400]) == pytest.approx([plain_code_length(counts[k], r["text"][:400]) for k in trees.langs], rel=1e-5)


def test_look_up_by_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 32, 50_000))
    asked = np.concatenate([keys, rng.integers(0, 1 << 32, 50_000)])
    place = {k: i for i, k in enumerate(keys.tolist())}
    assert langid.Numbered(keys).of(asked).tolist() == [place.get(k, -1) for k in asked.tolist()]


# personal data


def test_many_matches(spark):
    """Tens of thousands of matches in one text: time in proportion, every place right."""
    mails = [f"user{i}@host{i % 7}.example" for i in range(60_000)]
    text = " x ".join(mails)
    docs = spark.createDataFrame([(1, text), (2, "call +49 30 1234567 now" * 3)], "doc_id bigint, text string")
    began = time.time()
    got = {r["id"]: r["base"] for r in pii.find_spans(docs).collect()}
    assert time.time() - began < 60
    want = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert [(s["start"], s["end"]) for s in got[1]] == want and len(got[2]) == 3


def test_contexts_of_matches(spark):
    """Text before and after each match, across the chunks of the fold."""
    rng = random.Random(3)
    text = "".join(rng.choice(["é", "", " ", "abc ", "\n", "longer words in between "]) + f"{rng.randrange(256)}.{i % 256}.1.{rng.randrange(99)}" + rng.choice([" ", ",", "é", " und "]) for i in range(900))
    docs = spark.createDataFrame([(text,)], "text string")
    found = docs.select(F.explode(pii._found(F.col("text"), "ip")).alias("x")).select("x.*").collect()
    want = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)]
    assert [(r["start"], r["end"]) for r in found] == want
    for r in found:
        assert (r["text"], r["before"], r["after"]) == (text[r["start"] : r["end"]], text[max(0, r["start"] - 24) : r["start"]], text[r["end"] : r["end"] + 1])


def plain_reliabilities(rows, rounds=pii.ROUNDS):
    """Expectation-maximisation row by row: rates of votes by labeler and class, shares of classes by kind."""
    post = [min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for _, v in rows]
    for _ in range(rounds):
        share = {}
        for kind in {k for k, _ in rows}:
            own = [p for (k, _), p in zip(rows, post) if k == kind]
            share[kind] = (1 + sum(own)) / (2 + len(own))
        rate = {}
        for i in range(len(pii.LABELERS)):
            for y in (0, 1):
                mass = [p if y else 1 - p for p in post]
                for v in (-1, 0, 1):
                    rate[i, v, y] = (1 + sum(m for (_, votes), m in zip(rows, mass) if votes[i] == v)) / (3 + sum(mass))
        fresh = []
        for kind, votes in rows:
            yes, no = share[kind], 1 - share[kind]
            for i, v in enumerate(votes):
                yes, no = yes * rate[i, v, 1], no * rate[i, v, 0]
            fresh.append(yes / (yes + no))
        post = fresh
    return post


def test_reliabilities_and_classifier():
    rng = random.Random(8)
    rows = []
    for _ in range(300):
        true, kind = rng.random() < 0.4, rng.choice(["email", "card", "secret"])
        rows.append((kind, tuple((1 if true else -1) if rng.random() < good else rng.choice([-1, 0, 1]) for good in (0.9, 0.6, 0.3, 0.1))))
    patterns = Counter(rows)
    soft = pii.fit_reliabilities(dict(patterns))
    assert [soft[r] for r in rows] == pytest.approx(plain_reliabilities(rows), abs=1e-6)
    weights = pii.train_classifier(dict(patterns), soft)
    # at the optimum the pull of the data is that of the penalty, for every weight
    mass = {p: math.log1p(n) for p, n in patterns.items()}
    for name in weights:
        pull = 0.0
        for (kind, votes), m in mass.items():
            own = {f"kind:{kind}": 1} | dict(zip(pii.LABELERS, votes))
            z = sum(weights.get(f, 0.0) * v for f, v in own.items()) if not isinstance(next(iter(weights)), tuple) else sum(weights.get((f, v), 0.0) for f, v in own.items())
            if own.get(name[0]) == name[1]:
                pull += m * (soft[kind, votes] - 1 / (1 + math.exp(-z))) / sum(mass.values())
        assert pull == pytest.approx(0.0005 * weights[name], abs=2e-3)


def test_added_spans_follow_the_classifier(spark, sf):
    """Every candidate that the trained classifier gives half or more is added, and no other."""
    found = pii.candidates(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = {r["id"]: r["spans"] for r in found.collect()}
    patterns = Counter((s["kind"], tuple(s[v] for v in pii.LABELERS)) for spans in rows.values() for s in spans)
    weights = pii.train_classifier(dict(patterns), pii.fit_reliabilities(dict(patterns)))
    got = {r["id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find_spans(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    for key, spans in rows.items():
        want = []
        for s in spans:
            z = weights.get((f"kind:{s['kind']}", 1), 0.0) + sum(weights.get((v, s[v]), 0.0) for v in pii.LABELERS)
            if s["ok"] and s["kind"] in pii.BASE or z >= 0:
                want.append((s["kind"], s["start"], s["end"]))
        assert got[key] == want


# digests


def plain_digest(text):
    form = " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())
    return xxhash.xxh3_128_hexdigest(form.encode()), form


def test_edited_texts_and_groups(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    order = sorted(docs, reverse=True)
    got = {r["doc_id"]: r for r in QUERIES["op4_fingerprint"](spark, sf).collect()}
    members = defaultdict(list)
    for i in docs:
        members[plain_digest(docs[i])].append(i)
    for i, nxt in zip(order, order[1:] + order[:1]):
        own, half = docs[i], len(docs[i]) // 2
        edited = own[: len(own) - half] + docs[nxt][:half]
        r, marks = got[i], [plain_digest(t) for t in (own, edited, docs[nxt])]
        assert (r["fingerprint"], r["edited_fingerprint"], r["edited_sha256"]) == (marks[0][0], marks[1][0], hashlib.sha256(edited.encode()).hexdigest())
        assert (r["near_edited"], r["near_next"]) == (float(marks[0] == marks[1]), float(marks[0] == marks[2]))
        assert (r["group_id"], r["group_size"]) == (min(members[marks[0]]), len(members[marks[0]]))


def test_groups_of_clashing_hashes(spark):
    """Texts whose hashes meet are told apart by their bytes."""
    rows = spark.createDataFrame([(1, "ab"), (2, " AB "), (3, "cd"), (4, "CD"), (5, "efghi"), (None, "ab")], "doc_id bigint, text string")
    got = {r["id"]: (r["group_id"], r["group_size"]) for r in fingerprint.exact_groups(rows, hash_of=lambda form: "same" if len(form) < 4 else "long").collect()}
    assert got == {1: (1, 3), 2: (1, 3), None: (1, 3), 3: (3, 2), 4: (3, 2), 5: (5, 1)}


# quality


def test_rules_compiled_to_columns(spark):
    """Scores are those of the rules evaluated row by row in Python on plain statistics."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet").where(fold_of("doc_id", 4) != 2))
    got = {r["id"]: r["score"] for r in quality.score(docs, model).collect()}
    stats = {r["doc_id"]: r["stats"].asDict() for r in quality.with_statistics(docs).collect()}
    assert model.rules and len(set(got.values())) > 1
    for r in pq.read_table(f"{sf}/documents.parquet").to_pylist():
        text = r["text"] or ""
        own = stats[r["doc_id"]]
        words = [w for w in re.split(r"[ \t\n\r]+", text) if w]
        plain = {"chars": math.log1p(len(text)), "words": math.log1p(len(words)), "distinct": len(set(words)) / len(words) if words else 0.0}
        plain["digits"] = len(re.findall("[0-9]", text)) / len(text) if text else 0.0
        plain["distinct_lines"] = len(set(text.split("\n"))) / len(text.split("\n"))
        assert {k: own[k] for k in plain} == pytest.approx(plain)
        z = model.intercept
        for rule, weight in model.rules:
            if all(own[model.names[i]] <= v if op == "<=" else own[model.names[i]] > v for i, op, v in rule):
                z += weight
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-z)))


# decontamination


def longest_by_force(words, item, width=13):
    """(length, place, place in the item) of the longest verbatim match that has a window of the item; the first of equals."""
    need, best = min(width, len(item)), (0, 0, 0)
    for a in range(len(words)):
        for b in range(len(item)):
            n = 0
            while a + n < len(words) and b + n < len(item) and words[a + n] == item[b + n]:
                n += 1
            if n >= need and n > best[0]:
                best = (n, a, b)
    return best


@pytest.mark.parametrize("block_words", [1 << 20, 1])
def test_longest_matches(spark, block_words):
    rng = random.Random(2)
    items = {k: [f"t{rng.randrange(40)}" for _ in range(n)] for k, n in enumerate((60, 20, 13, 5, 40))}
    items[5] = items[0][10:40]
    docs = {}
    for i in range(12):
        words = [f"t{rng.randrange(40)}" for _ in range(30)]
        for k in rng.sample(sorted(items), 2):
            a = rng.randrange(max(1, len(items[k]) - 20))
            words += items[k][a : a + rng.randrange(4, 45)] + [f"x{i}"]
        docs[i] = words
    docs[12] = docs[3]
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()] + [(3, " ".join(docs[3])), (None, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id bigint, text string")
    got = decontam.contamination(rows, bench, block_words=block_words).collect()
    assert len(got) == len(docs) + 2
    for r in got:
        words = docs.get(r["doc_id"], [])
        want = {str(k): m for k, w in items.items() if (m := longest_by_force(words, w))[0]}
        assert {m["item"]: (m["length"], m["at"], m["item_at"]) for m in r["matches"]} == want
        assert r["longest"] == max([m[0] for m in want.values()], default=0) and r["n_items"] == len(want)


# mixing


def test_mix_of_repeated_and_odd_ids(spark):
    """Rows that share an id, equal rows and rows without an id each have copies; the stage takes what the mix takes."""
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", f"id{i}"]), " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["s", "t", None, "u"]), rng.randrange(3)) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string, copies int")
    out = mixing.mix(docs).collect()
    assert Counter((r["id"], r["source"], r["size"]) for r in out) == Counter((i, s, len(t.split())) for i, t, s, _ in rows)
    taken, targets = Counter(), {}
    for r in out:
        taken[r["source"]] += r["size"] * r["copies"]
        targets[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= max(60, 0.01 * t) for s, t in targets.items())
    staged = mixing.mixed_documents(docs)
    assert staged.columns == ["doc_id", "text", "source", "copies"]
    kept = Counter()
    for r in staged.collect():
        kept[r["source"]] += len(r["text"].split()) * r["copies"]
    assert all(abs(kept[s] - t) <= max(60, 0.01 * t) for s, t in targets.items())


def test_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 0, "d": 400, "e": 1}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    weight = dict(zip(["a", "b", "c", "d", "e", None], [1, 2, 3, 1, 2, 3]))
    level = next(v for v in np.linspace(0, 2000, 2_000_001) if sum(min(3 * n, weight[s] * v) for s, n in sizes.items()) >= sum(sizes.values()))
    assert got == pytest.approx({s: min(3 * n, weight[s] * level) for s, n in sizes.items()}, abs=0.01)
