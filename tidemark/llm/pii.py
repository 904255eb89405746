"""Personal data by weak supervision.

Patterns propose candidate spans. Labelers vote on each one (for, against, or no vote): the pattern's own check, a gazetteer
of key words to its left, its neighbouring characters, and its make-up. The corpus is reduced to counts of vote patterns, a
table whose size depends on the kinds and labelers only. Expectation-maximisation estimates from it how reliable each labeler
is and how likely each pattern is personal data; a logistic regression on the votes is trained on these soft labels and
compiled to a Spark column. Spans that pass a base rule always stay; other candidates are added where the classifier gives
half or more.

Positions are code points, the end is exclusive. Kinds are email, ip, card, phone and secret, in this order. Matches are
leftmost and do not overlap within a kind. Null texts count as empty and have no spans; repeated rows are handled alike;
extra columns are ignored. An empty table trains nothing and gives an empty result.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: A test that a text must pass to be searched, and the pattern, of each kind. Possessive repeats and the
#: looks behind only keep the search linear; they match the same places as the plain forms.
KINDS = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "secret": ("", r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16,}+"),
}
BASE = ("email", "ip", "card", "phone")
#: Words that stand in front of personal data, in English, German, French and Spanish.
GAZETTEER = {
    "email": ("email", "e-mail", "mail", "contact", "write", "kontakt", "schreiben", "courriel", "contacter", "correo", "contacto", "escribir"),
    "ip": ("ip", "host", "address", "server", "client", "adresse", "rechner", "serveur", "hôte", "direccion", "dirección", "servidor"),
    "card": ("card", "visa", "mastercard", "credit", "account", "iban", "karte", "kreditkarte", "konto", "carte", "compte", "tarjeta", "cuenta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "handy", "anruf", "téléphone", "portable", "appel", "teléfono", "telefono", "móvil", "llamar"),
    "secret": ("password", "passwd", "token", "secret", "key", "credential", "passwort", "kennwort", "schlüssel", "geheim", "clé", "jeton", "motdepasse", "contraseña", "clave", "secreto"),
}
LABELERS = ("check", "gazetteer", "edges", "make")
CONTEXT = 24
#: Matches that one fold handles.
CHUNK = 256
ROUNDS = 60
SPAN = "struct<kind:string,start:int,end:int,text:string,before:string,after:string>"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _found(text: Column, kind: str) -> Column:
    """Array of SPAN for the matches of one kind, in order.

    A fold that appends copies what it has so far, so it runs over chunks of CHUNK matches, whose places come from sums.
    """
    need, pattern = KINDS[kind]
    empty = f"cast(array() as array<{SPAN}>)"

    def step(acc: Column, piece: Column) -> Column:
        match = F.substring_index(piece, "\u0002", 1)
        after = F.substring(piece, F.length(match) + 2, F.length(piece))
        span = F.struct(F.lit(kind).alias("kind"), acc["at"].alias("start"), (acc["at"] + F.length(match)).alias("end"), match.alias("text"), acc["before"].alias("before"), F.left(after, F.lit(1)).alias("after"))
        before = F.right(F.concat(acc["before"], F.right(match, F.lit(CONTEXT)), F.right(after, F.lit(CONTEXT))), F.lit(CONTEXT))
        return F.struct((acc["at"] + F.length(piece) - 1).alias("at"), before.alias("before"), F.array_append(acc["out"], span).alias("out"))

    def in_chunks(first: Column, rest: Column, chunks: Column, sums: Column) -> Column:
        def within(chunk: Column, i: Column) -> Column:
            # the pieces of a full chunk have more than CONTEXT characters together
            last = F.slice(rest, F.greatest(F.lit(1), i * CHUNK - CONTEXT), F.least(i * CHUNK, F.lit(CONTEXT + 1)))
            before = F.when(i == 0, F.right(first, F.lit(CONTEXT))).otherwise(F.right(F.translate(F.array_join(last, ""), "\u0002", ""), F.lit(CONTEXT)))
            return F.aggregate(chunk, F.struct(F.get(sums, i).alias("at"), before.alias("before"), F.expr(empty).alias("out")), step)["out"]

        return F.flatten(F.transform(chunks, within))

    def start_of(first: Column, chunks: Column) -> Column:
        """Where each chunk starts; every piece is a match, a mark and the text up to the next match."""
        chars = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, piece: n + F.length(piece) - 1))
        start = F.struct(F.length(first).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(chars, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]

    def split_up(pieces: Column) -> Column:
        first = F.element_at(pieces, 1)
        numbers = lambda rest: F.sequence(F.lit(0), F.floor((F.size(rest) - 1) / CHUNK).cast("int"))
        found = _let(F.slice(pieces, 2, F.size(pieces)), lambda rest: _let(F.transform(numbers(rest), lambda i: F.slice(rest, i * CHUNK + 1, CHUNK)), lambda chunks: _let(start_of(first, chunks), lambda sums: in_chunks(first, rest, chunks, sums))))
        return F.when(F.size(pieces) > 1, found)

    found = _let(F.split(F.regexp_replace(text, f"({pattern})", "\u0001$1\u0002"), "\u0001"), split_up)
    none = F.expr(empty)
    likely = F.contains(text, F.lit(need)) if need else F.lit(True)
    return F.coalesce(F.when(likely & text.rlike("[0-9]") if kind != "email" else likely, found), none)


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        x = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def passes(kind: Column, text: Column) -> Column:
    """Whether a match passes the check of its kind."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    n = F.length(digits)
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return (
        F.when(kind == "ip", text.rlike(rf"^{part}\.{part}\.{part}\.{part}$"))
        .when(kind == "card", F.when((n >= 16) & (n <= 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", (n >= 8) & (n <= 15))
        .when(kind == "secret", text.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"))
        .otherwise(True)
    )


def candidates(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, spans): every candidate of every row's whole text, with its votes (1, 0 for none, -1)."""
    # the two marks of the search must not occur in the text; no pattern matches either character
    clean = F.translate(F.coalesce(F.col(text), F.lit("")), "\u0001\u0002", "\u0003\u0003")
    rows = docs.select(F.col(id_col).alias("id"), clean.alias("text"))
    found = rows.select("id", F.concat(*[_found(F.col("text"), k) for k in KINDS]).alias("spans"))

    def votes(x: Column) -> Column:
        kind, before, after = x["kind"], F.lower(x["before"]), x["after"]
        digits = F.length(F.regexp_replace(x["text"], "[^0-9]", ""))
        # digit runs of other lengths are no cards at all
        words = F.lit(None).cast("boolean")
        for k, names in GAZETTEER.items():
            words = F.when(kind == k, before.rlike(rf"(?:^|[^\p{{L}}])(?:{'|'.join(names)})[^\p{{L}}]{{0,6}}$")).otherwise(words)
        edge = F.right(x["before"], F.lit(1))
        return F.struct(
            *[x[f].alias(f) for f in ("kind", "start", "end")],
            passes(kind, x["text"]).alias("ok"),
            F.when(passes(kind, x["text"]), 1).otherwise(-1).alias("check"),
            F.when(words, 1).otherwise(0).alias("gazetteer"),
            F.when(edge.rlike(r"[\p{L}\p{N}]") | after.rlike(r"[\p{L}\p{N}]"), -1).when(edge.rlike(r"[=:\"']"), 1).otherwise(0).alias("edges"),
            F.when(digits >= 8, 1).when(digits < 4, -1).otherwise(0).alias("make"),
        )

    kept = F.filter("spans", lambda x: (x["kind"] != "card") | F.length(F.regexp_replace(x["text"], "[^0-9]", "")).between(12, 24))
    return found.select("id", F.transform(kept, votes).alias("spans"))


def fit_reliabilities(patterns: dict[tuple[str, tuple[int, ...]], int], rounds: int = ROUNDS) -> dict[tuple[str, tuple[int, ...]], float]:
    """Expectation-maximisation over counts of (kind, votes): the probability of each pattern to be personal data.

    The labelers' rates are shared by all kinds, the share of personal data is each kind's own. It starts from majorities.
    """
    total = {k: sum(n for (kind, _), n in patterns.items() if kind == k) for k, _ in patterns}
    post = {p: min(0.95, max(0.05, 0.5 + 0.2 * sum(p[1]))) for p in patterns}
    for _ in range(rounds):
        share = {k: (1 + sum(n * post[p] for p, n in patterns.items() if p[0] == k)) / (2 + total[k]) for k in total}
        rate = {}
        for i, v, y in product(range(len(LABELERS)), (-1, 0, 1), (0, 1)):
            side = [(p, n * (post[p] if y else 1 - post[p])) for p, n in patterns.items()]
            rate[i, v, y] = (1 + sum(n for p, n in side if p[1][i] == v)) / (3 + sum(n for _, n in side))
        for p in patterns:
            odds = math.log(share[p[0]] / (1 - share[p[0]]))
            odds += sum(math.log(rate[i, v, 1] / rate[i, v, 0]) for i, v in enumerate(p[1]))
            post[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post


def train_classifier(patterns: dict[tuple[str, tuple[int, ...]], int], soft: dict[tuple[str, tuple[int, ...]], float], steps: int = 400) -> dict[tuple[str, int], float]:
    """Weights of a logistic regression on kind and votes, by gradient ascent on the soft labels over all counts."""
    weights: dict[tuple[str, int], float] = {}
    features = {p: [(f"kind:{p[0]}", 1), *[(name, v) for name, v in zip(LABELERS, p[1], strict=True)]] for p in patterns}
    # a pattern counts with the logarithm of its rows, so rare ones are learned as well
    mass = {p: math.log1p(n) for p, n in patterns.items()}
    scale = sum(mass.values()) or 1.0
    for _ in range(steps):
        slope: dict[tuple[str, int], float] = {}
        for p, own in features.items():
            z = sum(weights.get(f, 0.0) for f in own)
            gap = mass[p] * (soft[p] - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) / scale
            for f in own:
                slope[f] = slope.get(f, 0.0) + gap
        for f, g in slope.items():
            weights[f] = weights.get(f, 0.0) + 4.0 * (g - 0.0005 * weights.get(f, 0.0))
    return weights


def find_spans(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, base, spans): arrays of (kind, start, end), by kind in its order, then start; spans has base and what is added."""
    found = checkpointed(candidates(docs, text, id_col))
    counts = found.select(F.explode("spans").alias("x")).groupBy("x.kind", *[F.col(f"x.{v}").alias(v) for v in LABELERS]).count()
    patterns = {(r["kind"], tuple(r[v] for v in LABELERS)): r["count"] for r in counts.collect()}
    weights = train_classifier(patterns, fit_reliabilities(patterns))

    def chosen(x: Column) -> Column:
        z = F.lit(0.0)
        for (name, value), w in sorted(weights.items()):
            test = x["kind"] == name[5:] if name.startswith("kind:") else x[name] == value
            z = z + F.when(test, F.lit(w)).otherwise(0.0)
        return z >= 0

    base = F.filter("spans", lambda x: x["ok"] & x["kind"].isin(*BASE))
    every = F.filter("spans", lambda x: (x["ok"] & x["kind"].isin(*BASE)) | chosen(x))

    def short(xs: Column) -> Column:
        return F.transform(xs, lambda x: F.struct(*[x[f].alias(f) for f in ("kind", "start", "end")]))

    return found.select("id", short(base).alias("base"), short(every).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
