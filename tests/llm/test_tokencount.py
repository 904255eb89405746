"""Token counts against the library itself, on whole texts and on prefixes."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import tokencount
from tidemark.llm.queries import op13_token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n", "  a", "a ", " a\t\nb ", "x" * 5000 + " don't're 'r", "'r", "a'r 're", "ÀÉ é" * 50, "İi", "\xa0a\x85b", "a\x1cb", "<|endoftext|>", " <|endoftext|> ", "<|EndOfText|>", "<|endoftext|><|startoftext|>x", "é é Ǆǅ", "½²x٣中文字🙂‍", "_a_1__2"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return tokencount.counter_of(PATH)


def size(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ODD)
def test_every_prefix(library, counter, text):
    normal = library.normalizer.normalize_str(text)
    if "<|" not in text:
        assert counter.counts(text).tolist() == [size(library, normal[:k]) for k in range(len(normal) + 1)]
    assert counter.counts(text)[-1] == size(library, text)


def test_random_texts_and_prefixes(library, counter):
    rnd = random.Random(5)
    letters = [*"abcdeIiİß'’sStTreREvellLmd  \t\n!?<|>0129٣é́ẞ中🙂ǅΣς\x85\x1cÀñ_²", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "'re", "'ll", "aaaaaaaa", "the ", "ation"]
    for _ in range(3000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(30)))
        assert counter.counts(text)[-1] == size(library, text), text
        if "<|" not in text:
            normal = library.normalizer.normalize_str(text)
            k = rnd.randrange(len(normal) + 1)
            assert counter.counts(text)[k] == size(library, normal[:k]), normal[:k]


@pytest.mark.parametrize("text", ["é" * 30 + "x", "à" * 48 + "!", "ab " + "éa" * 20 + " ends", "ü" * 25 + "'s", "ö" * 49 + " ß"])
def test_words_of_many_letters_of_two_bytes(library, text):
    counter = tokencount.PrefixCounter(PATH)  # one that has seen none of these
    normal = library.normalizer.normalize_str(text)
    assert counter.counts(text).tolist() == [size(library, normal[:k]) for k in range(len(normal) + 1)]


def test_border_rule_is_what_the_merges_do(counter):
    rnd = random.Random(6)
    inner, every = list(counter.inner.values()), [*counter.inner.values(), *counter.closing.values()]
    for _ in range(5000):
        a, b = rnd.choice(inner), rnd.choice(every)
        one, two = counter.spelled[a], counter.spelled[b]
        assert counter.fits(a, b) == (counter.merged(counter.symbols(one) + counter.symbols(two)) == [one, two])


def test_forgetting_changes_nothing(counter, monkeypatch):
    texts = [f"some words {k} and sömeother{k}words" for k in range(50)]
    want = [counter.counts(t).tolist() for t in texts]
    monkeypatch.setattr(tokencount, "MOST_WORDS", 5)
    monkeypatch.setattr(tokencount, "MOST_PAIRS", 5)
    assert [counter.counts(t).tolist() for t in texts] == want


def test_query_against_the_library(spark, sf, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op13_token_counts(spark, sf, limit=200).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), size(library, text), size(library, text) > 200)
        normal = library.normalizer.normalize_str(text)
        fit = r["fit_chars"]
        assert size(library, normal[:fit]) <= 200 and all(size(library, normal[:k]) > 200 for k in range(fit + 1, min(len(normal), fit + 40) + 1))


def test_odd_rows(spark, library):
    rows = [(None, "a b", 1), (1, None, 2), (1, "twice", 3), (1, "twice", 3), (2, "word " * 200_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, counts int")
    found = tokencount.count_prefixes(docs, PATH)
    got = found.select("id", "n_bytes", tokencount.total(F.col("counts")).alias("n"), tokencount.tokens_of(F.col("counts"), F.lit(3)).alias("three"), tokencount.fitting(F.col("counts"), 1).alias("fit")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 3, 2, 2, 2), (1, 0, 0, 0, 0), (1, 5, size(library, "twice"), size(library, "twi"), 5), (1, 5, size(library, "twice"), size(library, "twi"), 5), (2, 1_000_000, 200_000, size(library, "wor"), 5)], key=str)
    assert tokencount.count_prefixes(docs.limit(0), PATH).count() == 0
