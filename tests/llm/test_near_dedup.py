"""Near-duplicate groups against brute force, on families whose bands hold far more members than are compared at once."""

import numpy as np
import pytest

from tidemark.llm import simhash


def kept_by_force(texts, similarity=0.8, bits=3):
    hashes = [simhash.shingle_hashes(t, 5) for t in texts]
    fps, sets = [simhash.fingerprint_of(h) for h in hashes], [set(h.tolist()) for h in hashes]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common >= similarity * (len(sets[a]) + len(sets[b]) - common):
                links.append((b, a))
            if links[-1:] == [(b, a)] or (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [i for i in range(len(texts)) if find(i) == i], links


def words(rng, n):
    return [f"w{k}" for k in rng.integers(0, 1 << 30, n)]


def shared_body(rng):
    """Pairs of similar texts around one body that makes all of them share bands without being similar."""
    body, texts = words(rng, 180), []
    for _ in range(120):
        own = words(rng, 26)
        texts += [" ".join(body + own), " ".join(body + own[:16] + words(rng, 12))]
    return texts


def chain(rng):
    """Each text is similar to the next one only, so leaders are similar to few."""
    now, texts = words(rng, 200), []
    for i in range(150):
        texts.append(" ".join(now))
        at = (i * 37) % 180
        now = now[:at] + words(rng, 9) + now[at + 9 :]
    return texts


def variants(rng):
    """A large family of edits of one text, and outsiders that are similar to single members of it only."""
    base, texts = words(rng, 150), []
    for _ in range(200):
        w = list(base)
        for k in rng.integers(0, 150, 3):
            w[k] = f"x{rng.integers(1 << 30)}"
        texts.append(" ".join(w))
    for k in range(0, 200, 20):
        w = texts[k].split()
        texts.append(" ".join(w[:140] + words(rng, 12)))
    return texts


@pytest.mark.parametrize("family", [shared_body, chain, variants])
def test_large_bands(spark, family):
    rng = np.random.default_rng(5)
    texts = family(rng)
    want, _ = kept_by_force(texts)
    order = rng.permutation(len(texts)).tolist()
    docs = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == want


def test_links_across_groups_are_found_by_prefixes(spark):
    """Every similar pair of different groups is among the pairs that the prefixes give; pairs of one group are not."""
    rng = np.random.default_rng(6)
    texts = shared_body(rng)[:120] + chain(rng)[:60]
    _, links = kept_by_force(texts)
    sets = spark.createDataFrame([(i, np.unique(simhash.shingle_hashes(t, 5)).view(np.int64).tolist()) for i, t in enumerate(texts)], "node bigint, grams array<bigint>")
    members = spark.createDataFrame([(i, i // 2 if i % 3 else i) for i in range(len(texts))], "node bigint, root bigint")
    root = {r["node"]: r["root"] for r in members.collect()}
    got = {(r["a"], r["b"]) for r in simhash.prefix_pairs(members, sets, 0.8).collect()}
    assert {p for p in links if root[p[0]] != root[p[1]]} <= got
    assert all(root[a] != root[b] for a, b in got) and len(got) < len(texts) ** 2 / 8


def test_one_fingerprint_with_several_sets(spark):
    """Texts that share a fingerprint keep the links of all their shingle sets."""
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    docs = spark.createDataFrame([(1, a), (2, a + " " + a), (3, a + " end"), (4, b), (5, b.upper()), (6, None), (7, "")], "doc_id bigint, text string")
    texts = [r["text"] or "" for r in docs.orderBy("doc_id").collect()]
    want = [i + 1 for i in kept_by_force(texts)[0]]
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == want


def test_recall_of_links(spark):
    """On the sf0.01 tables at least 0.99 of the pairs at similarity 0.8 end in one group."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    ids = sorted(texts)
    _, links = kept_by_force([texts[i] for i in ids])
    root = {r["id"]: r["root"] for r in simhash.similar_groups(docs).collect()}
    met = [root[ids[a]] == root[ids[b]] for a, b in links]
    assert met and sum(met) >= 0.99 * len(met)
