"""Exact token counts of every prefix of a text, by dynamic programming over its words.

The tokenizer (a `tokenizers` file with byte-level byte-pair merges and word ends) cuts a normalised text into words and
merges each on its own. Within a word a sequence of tokens is what the merges give exactly if every two neighbours are what
the merges give for the two of them alone. So the encoding of a prefix is its last token behind the encoding of a shorter
prefix, and `last[i]`, the one token that ends at i and agrees with `last[i - its length]`, gives the count `count[i - its
length] + 1`. A prefix that ends inside a word ends with a token that carries the word end, found the same way. The counts of
a word are kept, since words repeat; those of a text are the words' counts plus the tokens in front of each word.

`count_prefixes` stores the count of every prefix: element k of `counts` is the number of tokens that the library gives for
the first k code points of the normalised text (element 0: 0). `fitting` and `tokens_of` read truncations and budgets off it
without encoding anything again. Special strings in a text are one token each, as is the library's default; they stay as they
are in the normalised text, and a prefix that ends within one is ordinary text.

A null text is empty: no bytes, no tokens, counts [0]. Empty texts and texts of white space have no tokens. Very long texts
and words take time in proportion to their length. Repeated rows stay, each with its counts; a null id stays null. Extra
columns are ignored, whatever their names. Empty tables give empty tables. A worker keeps at most twice `MOST_WORDS`
stretches of `LONG_WORD` bytes between texts, the words of one text, and one batch of texts at a time.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, text_batches

MOST_WORDS = 300_000
MOST_PAIRS = 500_000
#: Bytes of the longest stretch without white space whose counts are kept (they fit a byte each).
LONG_WORD = 96
#: Characters of texts whose counts are sent on together.
BATCH_CHARS = 2_000_000
#: Texts in which this module finds the words itself; in others the library does. Their letters have no other normal form.
PLAIN = re.compile(r"[\t-\r -~¡-±´-¸º»¿-ɏ‐-‧€]*+")
#: The pattern of the words of this tokenizer, and what finds the same words in plain texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")


class PrefixCounter:
    """Counts of all prefixes under one tokenizer file."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model = described["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("unk_token") or model.get("ignore_merges"):
            raise ValueError("a file with plain byte-pair merges is needed")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.end = model.get("end_of_word_suffix") or ""
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.vocab = model["vocab"]
        self.longest = max(len(t) - (len(self.end) if self.end and t.endswith(self.end) else 0) for t in self.vocab)
        self.special = {t["content"] for t in described["added_tokens"]}
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        pieces = described["pre_tokenizer"]["pretokenizers"]
        pattern = next(p["pattern"]["Regex"] for p in pieces if p["type"] == "Split")
        import regex

        self.words, self.plain = regex.compile(pattern), pattern == PATTERN
        self.bytes = _byte_letters()
        self.parts: dict[str, tuple[str, str]] = {}
        self.made: dict[str, int] = {}
        for k, (left, right) in enumerate(self.ranks):
            self.parts.setdefault(left + right, (left, right))
            self.made.setdefault(left + right, k)
        # tokens that the merges make of their own symbols, by what they spell: within a word, and where it ends
        whole = [t for t in self.vocab if self.merged(self.symbols(t)) == [t]]
        closing = [t for t in whole if self.end and t.endswith(self.end)]
        self.inner = {t: self.vocab[t] for t in whole if not (self.end and t.endswith(self.end))}
        self.closing = {t.removesuffix(self.end): self.vocab[t] for t in closing} if self.end else self.inner
        self.both = {t: (self.inner.get(t, -1), self.closing.get(t, -1)) for t in {**self.inner, **self.closing}}
        self.letters = {c: "".join(map(self.bytes.__getitem__, chr(c).encode())) for c in range(0x250)}
        self.spelled = {k: t for t, k in self.vocab.items()}
        self.agree: dict[int, bool] = {}
        self.forget()
        self.turn(keep=False)

    def forget(self) -> None:
        """Begin anew with beginnings of words: their last token, its count and the counts of all of their own beginnings."""
        self.nodes: dict[str, tuple[int, int, bytes]] = {}

    def turn(self, keep: bool = True) -> None:
        """Begin anew with stretches without white space by number, each number with the place, length and last count of its
        counts in the pool. The stretches so far are still at hand until the next turn."""
        self.former, self.old_pool, self.old_places = (self.known, self.pool, self.places) if keep else ({}, bytearray(), array("q"))
        self.known: dict[str, int] = {}
        self.pool = bytearray()
        self.places, self.lengths, self.lasts = array("q"), array("q"), array("q")

    def merged(self, symbols: list[str]) -> list[str]:
        """The merges applied one at a time, the one of least rank first."""
        symbols = list(symbols)
        while len(symbols) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 60), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def symbols(self, token: str) -> list[str]:
        body = token[: -len(self.end)] if self.end and token.endswith(self.end) else token
        return [*body[:-1], token[len(body) - 1 :]]

    def fits(self, a: int, b: int) -> bool:
        """The merges leave the border between two whole tokens alone.

        Seen backwards in time: whichever of the two at the border was merged last is taken apart again, and a merge across the
        border must not exist with a rank below those of the merges undone so far."""
        if len(self.agree) >= MOST_PAIRS:
            self.agree.clear()
        left, right, limit, out = self.spelled[a], self.spelled[b], 1 << 60, True
        while True:
            rank = self.ranks.get((left, right))
            if rank is not None and rank < limit:
                out = False
                break
            made_left, made_right = self.made.get(left, -1), self.made.get(right, -1)
            if made_left < 0 and made_right < 0:
                break
            if made_left > made_right:  # of equal merges the one on the left comes first
                limit, left = made_left, self.parts[left][1]
            else:
                limit, right = made_right + 1, self.parts[right][0]
        self.agree[a << 32 | b] = out
        return out

    def of_symbols(self, word: str) -> np.ndarray:
        """Counts for each prefix of a word of byte letters, each prefix taken as a word that ends there."""
        n, most = len(word), self.longest
        inner, closing, agree, fits = self.inner.get, self.closing.get, self.agree.get, self.fits
        last, count, ended = [0] * (n + 1), [0] * (n + 1), []
        for i in range(1, n + 1):
            low = max(0, i - most)
            for start in range(i - 1, low - 1, -1):
                token = inner(word[start:i])
                if token is not None and (not start or ((ok := agree(last[start] << 32 | token)) or ok is None and fits(last[start], token))):
                    last[i], count[i] = token, count[start] + 1
                    break
            else:
                raise ValueError(f"no tokens for {word[:i]!r}")
            for start in range(i - 1, low - 1, -1):
                token = closing(word[start:i])
                if token is not None and (not start or ((ok := agree(last[start] << 32 | token)) or ok is None and fits(last[start], token))):
                    ended.append(count[start] + 1)
                    break
            else:
                raise ValueError(f"no tokens for {word[:i]!r}")
        return np.array(ended, np.int32)

    def of_short(self, word: str) -> bytes:
        """The same for a short word; what is known of its beginnings is used again."""
        nodes = self.nodes
        if (node := nodes.get(word)) is not None:
            return node[2]
        n, most = len(word), self.longest
        k = n - 1
        while k and (node := nodes.get(word[:k])) is None:
            k -= 1
        ended = node[2] if k else b""
        both, agree, fits = self.both.get, self.agree.get, self.fits
        for i in range(k + 1, n + 1):
            last, count, close = -1, 0, 0
            for start in range(i - 1, max(0, i - most) - 1, -1):
                tokens = both(word[start:i])
                if tokens is None:
                    continue
                within, ending = tokens
                if start:
                    before, seen, _ = nodes[word[:start]]
                    before <<= 32
                    if last < 0 and within >= 0 and ((ok := agree(before | within)) or ok is None and fits(before >> 32, within)):
                        last, count = within, seen + 1
                    if not close and ending >= 0 and ((ok := agree(before | ending)) or ok is None and fits(before >> 32, ending)):
                        close = seen + 1
                else:
                    if last < 0 and within >= 0:
                        last, count = within, 1
                    if not close and ending >= 0:
                        close = 1
                if close and last >= 0:
                    break
            else:
                raise ValueError(f"no tokens for {word[:i]!r}")
            ended += bytes((close,))
            nodes[word[:i]] = last, count, ended
        return ended

    def of_word(self, word: str) -> bytes | np.ndarray:
        """Counts for each code point prefix of a word of the normalised text."""
        if word[0] in "'<" and self.words.findall(word[:-1]) not in ([], [word[:-1]]):  # its beginnings fall apart
            parts = [self.of_parts(word, k) for k in range(1, len(word) + 1)]
            return bytes(parts) if len(word) <= LONG_WORD else np.array(parts, np.int32)
        if word.isascii() and word.isprintable():
            return self.of_short(word) if len(word) <= LONG_WORD else self.of_symbols(word)
        if len(word) <= LONG_WORD // 4:
            letters = word.translate(self.letters) if max(word) < "ɐ" else "".join(map(self.bytes.__getitem__, word.encode()))
            ended, out, k = self.of_short(letters), bytearray(), -1
            for c in word:
                k += 1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4
                out.append(ended[k])
            return bytes(out)
        letters = "".join(map(self.bytes.__getitem__, word.encode()))
        return self.of_symbols(letters)[np.cumsum([len(c.encode()) for c in word]) - 1]

    def of_parts(self, word: str, k: int) -> int:
        parts = self.words.findall(word[:k])
        if parts == [word[:k]]:
            return int(self.of_symbols("".join(map(self.bytes.__getitem__, word[:k].encode())))[-1])
        return sum(int(self.of_word(p)[-1]) for p in parts)

    def of_stretch(self, stretch: str) -> bytes | np.ndarray | list[int]:
        """Counts for each prefix of a stretch of a plain text without white space."""
        words = PLAIN_WORDS.findall(stretch)
        if len(words) == 1:
            return self.of_word(stretch)
        out: list[int] = []
        for word in words:
            base = out[-1] if out else 0
            out += [base + x for x in map(int, self.of_word(word))]
        return out

    def keep(self, stretch: str) -> int:
        """The number of a short stretch, its counts and once more the last of them put into the pool; what was known
        before the pool was last begun anew is taken from there."""
        if (old := self.former.get(stretch)) is not None:
            counts = self.old_pool[self.old_places[old] : self.old_places[old] + len(stretch)]
        else:
            found = self.of_stretch(stretch)
            counts = found if isinstance(found, bytes) else bytes(list(found))  # of an array `bytes` would take the memory
        k, total = len(self.known), counts[-1] if counts else 0
        self.places.append(len(self.pool))
        self.lengths.append(len(stretch) + 1)
        self.lasts.append(total)
        self.pool += counts
        self.pool.append(total)
        self.known[stretch] = k
        return k

    def of_plain(self, text: str) -> np.ndarray:
        """Counts of all prefixes of the normal form of a plain text, the empty one first."""
        stretches = text.lower().split()
        if text[:1].isspace():
            stretches.insert(0, "")
        if text[-1:].isspace():
            stretches.append("")
        if not stretches:
            return np.zeros(1, np.int32)
        if max(map(len, stretches)) > LONG_WORD // 2:  # of two bytes each at most; such stretches are not kept
            parts = [np.array([*(x := self.of_stretch(w)), x[-1] if len(x) else 0], np.int32) for w in stretches]
            lengths, lasts = np.array([len(p) for p in parts]), np.array([p[-1] for p in parts])
            out = np.concatenate(parts)
        else:
            if len(self.known) > MOST_WORDS:  # a text may add its own to these
                self.turn()
            if len(self.nodes) > 2 * MOST_WORDS:
                self.forget()
            get, keep = self.known.get, self.keep
            ids = np.array([k if (k := get(w)) is not None else keep(w) for w in stretches])
            places, lengths, lasts = (np.frombuffer(x, np.int64)[ids] for x in (self.places, self.lengths, self.lasts))
            at = np.repeat((places - (np.cumsum(lengths) - lengths)).astype(np.int32), lengths)
            at += np.arange(len(at), dtype=np.int32)
            out = np.frombuffer(self.pool, np.uint8)[at].astype(np.int32)
        out += np.repeat((np.cumsum(lasts) - lasts).astype(np.int32), lengths)
        return np.concatenate((np.zeros(1, np.int32), out[:-1]))

    def ordinary(self, text: str) -> np.ndarray:
        """Counts of all prefixes of a normalised text without special strings, the empty one first."""
        if self.plain and PLAIN.fullmatch(text):
            return self.of_plain(text)
        out = np.zeros(len(text) + 1, np.int32)
        if len(self.nodes) > 2 * MOST_WORDS:
            self.forget()
        total = at = 0
        for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text):
            out[at + 1 : a + 1] = total  # between words the count stays
            word = self.of_word(text[a:b])
            out[a + 1 : b + 1] = np.frombuffer(word, np.uint8) if isinstance(word, bytes) else word
            out[a + 1 : b + 1] += total
            total, at = int(out[b]), b
        out[at + 1 :] = total
        return out

    def normal(self, text: str) -> str:
        """The normal form; of a plain text only its case and white space, which `of_plain` sees to, are left."""
        return text if self.plain and PLAIN.fullmatch(text) and "İ" not in text else self.library.normalizer.normalize_str(text)

    def counts(self, text: str) -> np.ndarray:
        """Counts of all prefixes of the normalised text."""
        if self.special_pattern is None or not self.special_pattern.search(text):
            return self.ordinary(self.normal(text))
        out, base, at = [np.zeros(1, np.int32)], 0, 0
        for match in self.special_pattern.finditer(text):
            before = self.normal(text[at : match.start()])
            # within the special string a prefix is ordinary text
            seen, length = self.ordinary(before + match[0][:-1].lower()), len(match[0]) - 1
            out.append(seen[1:] + base)
            base += int(seen[len(seen) - 1 - length]) + 1
            out.append(np.array([base], np.int32))
            at = match.end()
        out.append(self.ordinary(self.normal(text[at:]))[1:] + base)
        return np.concatenate(out)


@lru_cache(maxsize=2)
def counter_of(path: str) -> PrefixCounter:
    """One counter for each worker and file: what it knows of words serves all its tasks."""
    return PrefixCounter(path)


def _byte_letters() -> list[str]:
    """Byte-level vocabularies write each byte as one printable letter: itself where it has a glyph, else the next one from 256 on."""
    shown = [b for a, z in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(a), ord(z) + 1)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _counting(path: str, id_type: pa.DataType):
    def run(batches):
        counter = counter_of(path)
        schema = pa.schema([("id", id_type), ("n_bytes", pa.int64()), ("counts", pa.list_(pa.int32()))])

        def packed(ids: list, sizes: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(sizes, pa.int64()), lists], schema=schema)

        for batch in text_batches(batches):
            ids, sizes, found, held = [], [], [], 0
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids.append(key.as_py())
                sizes.append(len(text) if text.isascii() else len(text.encode()))
                found.append(counter.counts(text))
                held += len(found[-1])
                if held >= BATCH_CHARS:
                    yield packed(ids, sizes, found)
                    ids, sizes, found, held = [], [], [], 0
            if ids:
                yield packed(ids, sizes, found)

    return run


def count_prefixes(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, counts): the UTF-8 bytes of each text and the tokens of each prefix of its normalised form.

    `path` is the tokenizer file, which every executor has at that place."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType
    return mapped(rows, _counting(path, to_arrow_type(kind)), f"id {kind.simpleString()}, n_bytes bigint, counts array<int>")


def total(counts: Column) -> Column:
    """Tokens of the whole text."""
    return F.element_at(counts, -1).cast("bigint")


def fitting(counts: Column, budget: int) -> Column:
    """Code points of the longest prefix of the normalised text that has at most `budget` tokens."""
    return F.when(total(counts) <= budget, F.size(counts) - 1).otherwise(F.array_max(F.transform(counts, lambda n, k: F.when(n <= budget, k)))).cast("bigint")


def tokens_of(counts: Column, chars: Column) -> Column:
    """Tokens of the first `chars` code points of the normalised text."""
    return F.get(counts, F.least(F.greatest(chars, F.lit(0)), F.size(counts) - 1)).cast("bigint")
