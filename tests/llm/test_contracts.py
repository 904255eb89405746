"""Each contract query against a plain Python version over the whole small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
import xxhash

from tidemark.llm import simhash
from tidemark.llm.queries import QUERIES


@pytest.fixture(scope="module")
def docs(sf):
    return {r["doc_id"]: r for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}


def run(spark, sf, name):
    return [r.asDict(recursive=True) for r in QUERIES[name](spark, sf).collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chat(spark, sf):
    convs = defaultdict(list)
    for r in pq.read_table(f"{sf}/conversations.parquet").to_pylist():
        convs[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    said = "</s>[INST] ok [/INST]"
    convs[-1] = [(0, "user", said), (1, "assistant", said)]
    got = {r["conv_id"]: r for r in run(spark, sf, "op1_chat_formatting")}
    assert got.keys() == convs.keys()
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        want = (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns)), len(loss), sha(loss))
        assert tuple(got[conv][k] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == want
        assert got[conv]["formatted_chars"] > sum(len(t) for _, _, t in turns)


def base_spans(text):
    out = {k: [] for k in ("email", "ip", "card", "phone")}
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out["email"].append(m.span())
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        digits = [int(c) for c in d[::-1]]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(digits)) % 10 == 0:
            out["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out["phone"].append(m.span())
    return out


def test_pii(spark, sf, docs):
    got = {r["doc_id"]: r for r in run(spark, sf, "op2_pii")}
    assert got.keys() == docs.keys()
    for i, d in docs.items():
        want = base_spans(d["text"] or "")
        assert [got[i][f"n_{k}"] for k in want] == [len(v) for v in want.values()]
        base = [f"{k}:{a}:{b}" for k, v in want.items() for a, b in v]
        assert got[i]["base_sha256"] == sha(",".join(base))
        assert set(base) <= set(got[i]["spans"].split(",")) if base else True


def test_langid(spark, sf, docs):
    got = {r["doc_id"]: r for r in run(spark, sf, "op3_langid")}
    assert got.keys() == docs.keys()
    held = [i for i in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    assert sum(got[i]["lang_pred"] == docs[i]["lang"] for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_fingerprint(spark, sf, docs):
    got = {r["doc_id"]: r for r in run(spark, sf, "op4_fingerprint")}
    order = sorted(docs, reverse=True)
    for i, nxt in zip(order, order[1:] + order[:1], strict=True):
        text, other = docs[i]["text"] or "", docs[nxt]["text"] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(text), sha(edited))
        assert got[i]["near_next"] == float(got[i]["fingerprint"] == got[nxt]["fingerprint"])
    by = defaultdict(set)
    for i, d in docs.items():
        by[d["text"]].add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in by.values())


def test_mixing(spark, sf, docs):
    got = {r["doc_id"]: r for r in run(spark, sf, "op6_mixing")}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for i, d in docs.items()}
    total = defaultdict(int)
    for i, d in docs.items():
        total[d["source"]] += size[i]
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    target, free, left = {}, set(total), float(sum(total.values()))
    while True:
        each = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * each > 3 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= target[s]
        free -= over
    target |= {s: weight[s] * each for s in free}
    taken = defaultdict(int)
    for i, d in docs.items():
        r = got[i]
        assert (r["size"], r["source_size"]) == (size[i], total[d["source"]])
        assert r["target"] == pytest.approx(target[d["source"]])
        assert r["taken"] <= 3 * size[i] and (not size[i] or r["taken"] % size[i] == 0)
        taken[d["source"]] += r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(0.1 * t, max(size[i] for i, d in docs.items() if d["source"] == s))
    assert got == {r["doc_id"]: r for r in run(spark, sf, "op6_mixing")}


def test_decontamination(spark, sf, docs):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))

    windows = defaultdict(set)
    for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist():
        w = words(r["text"])
        for i in range(max(1, len(w) - 12)) if w else ():
            windows[tuple(w[i : i + 13])].add(str(r["item_id"]))
    lengths = {len(w) for w in windows}
    got = {r["doc_id"]: r for r in run(spark, sf, "op7_decontamination")}
    assert got.keys() == docs.keys()
    for i, d in docs.items():
        w, hit, items = words(d["text"]), set(), set()
        for n in lengths:
            for at in range(len(w) - n + 1):
                if own := windows.get(tuple(w[at : at + n])):
                    hit |= set(range(at, at + n))
                    items |= own
        want = (len(w), len(hit), len(items), sha(",".join(sorted(items))), len(hit) > 0 and 20 * len(hit) >= len(w))
        assert tuple(got[i][k] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == want


@pytest.mark.parametrize(("name", "label", "folds", "out"), [("op8_toxicity", "toxic", 5, 0), ("op9_quality", "quality", 4, 2)])
def test_scores(spark, name, label, folds, out):
    sf = "/root/testdata/sf0.01"  # the smallest tables have too few labels
    docs = {r["doc_id"]: r for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    got = {r["doc_id"]: r for r in run(spark, sf, name)}
    assert got.keys() == docs.keys()
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(i).encode()) % folds == out) for i, r in got.items())
    known = [(r[label], got[r["doc_id"]]["score"]) for r in pq.read_table(f"{sf}/labels.parquet").to_pylist() if r["doc_id"] in got]
    mean = {y: [s for v, s in known if v == y] for y in (0, 1)}
    assert sum(mean[1]) / len(mean[1]) > sum(mean[0]) / len(mean[0])


def test_simhash(spark, sf, docs):
    fps = {}
    for i, d in docs.items():
        w = (d["text"] or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r["doc_id"]: r for r in run(spark, sf, "op10_simhash")}
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{fps[i]:016x}", root(i)) for i in ids}


def test_near_duplicates(spark, sf, docs):
    """One document stays of each group that similarities of 0.8 or more link, as brute force finds it."""
    sets = {}
    for i, d in docs.items():
        w = (d["text"] or "").encode().lower().split()
        sets[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    kept = simhash.keep_one(spark.read.parquet(f"{sf}/documents.parquet"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in ids if root(i) == i]


def test_large_near_duplicate_group(spark):
    """Variants of one text, similar to it but less so to each other, are one group; other texts stay."""
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join(base)]
    for i in range(60):
        w = list(base)
        for k in (i * 7 + 11, i * 5 + 200, i * 3 + 90, i + 310):
            w[k % 400] = f"x{i}"
        texts.append(" ".join(w))
    texts += [" ".join(f"other{i}n{k}" for k in range(50)) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [0, *range(61, 101)]


def repeats_by_force(texts, window=50, line_words=3):
    """(words left, words removed) of each text, in order: windows and lines that stand earlier go."""
    seen, out = set(), []
    for text in texts:
        gone, at = set(), 0
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            gone |= set(range(i, i + window)) if key in seen else set()
            seen.add(key)
        for line in text.split("\n"):
            own = tuple(re.findall(r"[^\x20\x09-\x0D]+", line))
            if len(own) >= line_words:
                gone |= set(range(at, at + len(own))) if ("line", own) in seen else set()
                seen.add(("line", own))
            at += len(own)
        out.append(([w for k, w in enumerate(words) if k not in gone], sorted(gone)))
    return out


def test_line_dedup(spark, sf, docs):
    """Lines of three words and runs of fifty words that stand earlier are deleted, and nothing else."""
    ids = sorted(docs)
    want = dict(zip(ids, repeats_by_force([docs[i]["text"] or "" for i in ids]), strict=True))
    got = {}
    for r in run(spark, sf, "op5_line_dedup"):
        spans = [tuple(map(int, x.split("-"))) for x in r["removed"].split(",") if x]
        got[r["doc_id"]] = ((r["text"] or "").split(), [k for a, b in spans for k in range(a, b + 1)])
    assert got == want and any(gone for _, gone in want.values())
