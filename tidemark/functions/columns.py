"""Column functions: bands, normal forms, guards and small rule sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucketize(value: Column, steps: list[tuple[float, float]], default: Column | None = None) -> Column:
    """The label of the first threshold, from the highest down, that value reaches; else `default` (value itself)."""
    out = F
    for low, label in sorted(steps, reverse=True):
        out = out.when(value >= low, F.lit(label))
    return out.otherwise(value if default is None else default)


def half_open_bins(value: Column, edges: list[float], low: float, high: float) -> Column:
    """Number of the bin [edge, next edge) that holds value; null outside [low, high] or below the first edge."""
    out = F.when(value.isNull() | (value < low) | (value > high) | (value < edges[0]), F.lit(None))
    for i in range(len(edges) - 1, -1, -1):
        out = out.when(value >= edges[i], F.lit(i))
    return out


def first_match(text: Column, rules: list[tuple[str, str]], default: str, missing: str) -> Column:
    """The label of the first substring rule that holds; the order of the rules matters."""
    out = F.when(text.isNull() | (F.trim(text) == ""), F.lit(missing))
    for needle, label in rules:
        out = out.when(F.contains(F.lower(text), F.lit(needle)), F.lit(label))
    return out.otherwise(F.lit(default))


def norm_text(text: Column) -> Column:
    """Lower case, one space for each run of white space, null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), F.lit(""))


def norm_alnum(text: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(text), "[^a-z0-9]+", ""), F.lit(""))


def norm_postal(code: Column) -> Column:
    """The digits of a code where there are exactly four; null otherwise."""
    digits = F.regexp_replace(code, "[^0-9]", "")
    return F.when(F.length(digits) == 4, digits)


def pad_postal(code: Column) -> Column:
    """The digits of a code padded or cut to four; nothing is rejected."""
    return F.lpad(F.regexp_replace(code, "[^0-9]", ""), 4, "0")


def clamp(value: Column, low: float, high: float) -> Column:
    """value within [low, high]; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def clamped_log_ratio(price: Column, base: Column, low: float, high: float) -> Column:
    """ln((price + 1) / base), clamped; null unless price is at least 0 and base over 0."""
    return F.when((price >= 0) & (base > 0), clamp(F.ln((price + 1) / base), low, high))


def one_hot(value: Column, vocabulary: list[str], prefix: str) -> list[Column]:
    """0/1 columns for each word, for other values and for null."""
    known = value.isin(*vocabulary)
    flags = [F.coalesce((value == v).cast("int"), F.lit(0)).alias(f"{prefix}_{v.lower().replace(' ', '_')}") for v in vocabulary]
    return [*flags, F.coalesce((~known).cast("int"), F.lit(0)).alias(f"{prefix}_other"), value.isNull().cast("int").alias(f"{prefix}_missing")]


def guarded_ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def integer_in(text: Column, pattern: str = r"([0-9]+)") -> Column:
    """The first integer in a text, null if there is none or it does not fit."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int")


def json_number(doc: Column, path: str) -> Column:
    """A nested value where it is written in digits only."""
    raw = F.get_json_object(doc, path)
    return F.when(raw.rlike("^[0-9]+$"), raw.try_cast("bigint"))


def in_range(value: Column, low: float, high: float) -> Column:
    """value where it lies in [low, high], else null."""
    return F.when(value.between(low, high), value)


def hinge(value: Column, knot: float) -> tuple[Column, Column]:
    """(value <= knot as 0/1, how far value is below the knot)."""
    return F.coalesce((value <= knot).cast("int"), F.lit(0)), F.greatest(F.lit(0.0), knot - value)


def penalty_product(factors: list[Column], low: float, high: float) -> Column:
    """Product of clamped factors; a null factor is 1."""
    return reduce(lambda a, b: a * b, [F.coalesce(clamp(f, low, high), F.lit(1.0)) for f in factors])


def half_life_weight(age_days: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), age_days / half_life)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days between two dates or the days of two times."""
    return F.datediff(later, earlier)


def missing_flags(names: list[str]) -> list[Column]:
    """<name>__missing as 0/1 for each column."""
    return [F.col(n).isNull().cast("int").alias(f"{n}__missing") for n in names]


def interactions(names: list[str]) -> list[Column]:
    """The product of every two of the columns, as <a>_x_<b>."""
    return [(F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for i, a in enumerate(names) for b in names[i + 1 :]]


def underprice_score(ratio: Column, knots: list[float]) -> Column:
    """How far a price ratio lies below each knot, added up; null counts as not below."""
    return reduce(lambda a, b: a + b, [F.coalesce(hinge(ratio, k)[1], F.lit(0.0)) for k in knots])


def canonical_key(name: Column) -> Column:
    """Lower case, no parentheses, spaces as underscores."""
    return F.replace(F.translate(F.lower(F.trim(name)), "()", ""), F.lit(" "), F.lit("_"))


def evidence_kept(items: Column, length: Column, least: float) -> Column:
    """The items (confidence, start, end, ...) with enough confidence whose span lies inside a text of this length."""
    return F.filter(items, lambda x: (x["confidence"] >= least) & (x["start"] >= 0) & (x["start"] < x["end"]) & (x["end"] <= length))


def feature_block(name: Column, rules: list[tuple[str, str, str]], default: str) -> Column:
    """The block of the first rule (kind, text, block) that a feature name meets; kinds: is, starts, ends, has."""
    tests = {"is": lambda t: name == t, "starts": name.startswith, "ends": name.endswith, "has": name.contains}
    out = F
    for kind, text, block in rules:
        out = out.when(tests[kind](text), F.lit(block))
    return out.otherwise(F.lit(default))


def allowed_columns(names: list[str], banned: list[str], kept: tuple[str, ...] = ()) -> list[str]:
    """Names without any of the banned parts, in any case; those that begin with a kept prefix always stay."""
    return [n for n in names if n.lower().startswith(kept) or not any(b in n.lower() for b in banned)] if kept else [n for n in names if not any(b in n.lower() for b in banned)]


def shaped_weight(age_days: Column, half_life: float, hours: Column, slow: float, very_slow: float, boundary: float, width: float, guard: float) -> Column:
    """Recency weight, raised for slow outcomes, near the boundary of 504 hours, and for very fast ones."""
    tail = F.when(hours > 168, slow).otherwise(1.0) * F.when(hours > 504, very_slow).otherwise(1.0)
    bump = 1 + boundary * F.exp(-F.pow(F.abs(hours - 504) / width, 2))
    return half_life_weight(age_days, half_life) * tail * bump * F.when(hours < 240, 1 + guard * boundary).otherwise(1.0)


def parse_payload(df: DataFrame, payload: str, sold: str, gone: str) -> DataFrame:
    """df with canonical, valid_price, flag_seen and inactive from a column of JSON payloads.

    Status stands under `status` or `state`, the price under `price` or `current_price`. Without a status a row with a price
    is live, and one without is unknown.
    """

    def first(*keys: str) -> Column:
        return F.coalesce(*[F.get_json_object(payload, f"$.{k}") for k in keys])

    status, price, flag = first("status", "state"), first("price", "current_price").try_cast("bigint"), first("is_inactive")
    canonical = F.when(status == sold, "sold").when((status == gone) | (flag == "true"), "inactive").when(status.isNull(), F.when(price > 0, "live").otherwise("unknown")).otherwise("live")
    return df.withColumns({"canonical": canonical, "valid_price": F.when(price > 0, price), "flag_seen": flag.isNotNull(), "inactive": F.coalesce(flag == "true", F.lit(False))})


def json_set(json: Column, key: str, value: Column) -> Column:
    """A JSON object of whole numbers with a key set, in place if it is there, else at the end."""
    held = F.from_json(json, "map<string,bigint>")
    there = F.transform(F.map_entries(held), lambda e: F.struct(e["key"].alias("key"), F.when(e["key"] == key, value).otherwise(e["value"]).alias("value")))
    return F.to_json(F.map_from_entries(F.when(F.map_contains_key(held, key), there).otherwise(F.concat(there, F.array(F.struct(F.lit(key).alias("key"), value.alias("value")))))))


def json_has(json: Column, key: str) -> Column:
    """Whether a JSON object has a key, whatever its value; null for what is no object."""
    return F.array_contains(F.json_object_keys(json), key)


def json_append(json: Column, value: Column) -> Column:
    """A JSON list of whole numbers with one more; a null list begins one."""
    return F.to_json(F.array_append(F.coalesce(F.from_json(json, "array<bigint>"), F.expr("cast(array() as array<bigint>)")), value))


def json_each(json: Column) -> Column:
    """The (key, value) pairs of a JSON object, values as text."""
    return F.map_entries(F.from_json(json, "map<string,string>"))


#: Phrases of listings that ask to buy or swap, and of listings that sell several things as one.
BUYER_PHRASES = ["skal kjøpe", "ønsker å kjøpe", "kjøpes", "wtb", "looking to buy", "want to buy", "byttes i", "bytter til", "oppgraderer til"]
BUNDLE_PHRASES = ["pakkepris", "selges samlet", "kun samlet", "begge", "2 iphoner", "to telefoner", "selger begge", "samlet pris", "both phone", "both phones", "as a package"]

#: Words of damage summaries by kind of damage; a summary must have a word of each list.
DAMAGE_WORDS = {
    "display_fault": [["lcd", "oled", "stripe", "vertical line", "horizontal line", "screen line"]],
    "back_glass": [["back"], ["crack", "shatter"]],
    "front_glass": [["front"], ["crack", "shatter"]],
    "camera_lens": [["camera", "lens"], ["broken", "missing", "crack"]],
}


def has_phrase(text: Column, phrases: list[str]) -> Column:
    """Whether a text has one of the phrases as whole words, in any case and with any white space between the words."""
    spaced = "|".join(r"\s+".join(p.split()) for p in phrases)
    return text.rlike(rf"(?iuU)(?<![\p{{L}}\p{{N}}_])(?:{spaced})(?![\p{{L}}\p{{N}}_])")


def has_words(text: Column, lists: list[list[str]]) -> Column:
    """Whether a text has, anywhere and in any case, a word of every list."""
    lower = F.lower(text)
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [lower.contains(w) for w in words]) for words in lists])


def letters_and_digits(text: Column) -> Column:
    """Lower case; runs of anything but a-z and 0-9 become one space; no space at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
