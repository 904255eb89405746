"""Chat formatting in budgeted windows.

A turn is written as `<s>[role]` line feed, text, `</s>` line feed. Inside roles and texts the characters that can begin or
end a control string are escaped (backslash, `<`, `[`, `]` as backslash and a letter), which can be undone. Running sums of
turn tokens cut a conversation into windows along turns: a new one starts where the next turn would exceed what the budget
leaves beside the system turn and the history. Each window repeats the leading system turn, then as many of the turns before
it as fit the history budget, then its own turns. The loss mask holds the texts of the window's own assistant turns, in code
points, so a repeated target is never counted twice.

Turns are ordered by turn number (null first), then role and text, so repeated turns all stay. A null role or text counts as
empty; a null conversation id is one conversation. A turn longer than the budget has a window of its own. Tokens are runs of
ASCII word characters and single other characters, plus four for each turn. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 512
HISTORY = 96
TURN_TOKENS = 4
TOKEN = r"[A-Za-z0-9_]++|[^A-Za-z0-9_\x09-\x0D\x20]"
#: What stands for each escaped character. The backslash comes first when escaping and last when undoing.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\k"), ("]", "\\j"))
END = "</s>\n"


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)) + TURN_TOKENS


def format_windows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv, window, formatted, loss_spans, n_system, n_history, n_own): one row for each window of each conversation."""
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", tokens(F.col("text")).cast("bigint"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("upto", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    head = F.concat(F.lit("<s>["), escape(F.col("role")), F.lit("]\n"))
    body = escape(F.col("text"))
    rows = rows.select("conv", F.struct("at", F.col("upto"), (F.col("upto") - F.col("tokens")).alias("since"), (F.col("role") == "assistant").alias("target"), F.length(head).alias("head"), F.length(body).alias("body"), F.concat(head, body, F.lit(END)).alias("shown"), (F.col("role") == "system").alias("system")).alias("x"))
    whole = rows.groupBy("conv").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    n_system = F.when(F.element_at("xs", 1)["system"], 1).otherwise(0)
    whole = whole.withColumn("n_system", n_system).withColumn("room", F.greatest(F.lit(1).cast("bigint"), budget - history - F.when(F.col("n_system") == 1, F.element_at("xs", 1)["upto"]).otherwise(0)))

    # the fold keeps the first turn of each window and the running sum in front of it
    start = F.expr("named_struct('starts', cast(array() as array<int>), 'base', 0L)")

    def step(acc: Column, x: Column) -> Column:
        opens = (F.size(acc["starts"]) == 0) | (x["upto"] - acc["base"] > F.col("room"))
        return F.struct(F.when(opens, F.array_append(acc["starts"], x["at"])).otherwise(acc["starts"]).alias("starts"), F.when(opens, x["since"]).otherwise(acc["base"]).alias("base"))

    own = F.slice("xs", F.col("n_system") + 1, F.size("xs"))
    whole = whole.withColumn("starts", F.aggregate(own, start, step)["starts"])
    # a conversation of a system turn alone has one window
    whole = whole.withColumn("starts", F.when(F.size("starts") == 0, F.array(F.lit(2))).otherwise(F.col("starts")))
    cut = whole.select("conv", "xs", "n_system", "starts", F.posexplode("starts").alias("window", "first"))
    last = F.coalesce(F.get("starts", F.col("window") + 1), F.size("xs") + 1)
    # a turn has TURN_TOKENS at least, so history never reaches back further than this
    back = F.greatest(F.col("n_system") + 1, F.col("first") - (history // TURN_TOKENS + 1))
    before = F.slice("xs", back, F.greatest(F.lit(0), F.col("first") - back))
    base = F.get("xs", F.col("first") - 1)["since"]
    cut = cut.withColumn("system", F.slice("xs", 1, F.col("n_system"))).withColumn("history", F.when(F.col("window") == 0, F.slice("xs", 1, 0)).otherwise(F.filter(before, lambda x: base - x["since"] <= history)))
    cut = cut.withColumn("own", F.slice("xs", F.col("first"), F.greatest(F.lit(0), last - F.col("first")))).select("conv", "window", "n_system", "system", "history", "own")

    def shown(xs: str) -> Column:
        return F.array_join(F.transform(xs, lambda x: x["shown"]), "")

    def width(xs: str) -> Column:
        return F.aggregate(xs, F.lit(0), lambda a, x: a + x["head"] + x["body"] + len(END))

    first = F.struct((width("system") + width("history")).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def span(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["head"]
        return F.struct((at + x["body"] + len(END)).alias("at"), F.when(x["target"], F.array_append(acc["spans"], F.struct(at.alias("start"), (at + x["body"]).alias("end")))).otherwise(acc["spans"]).alias("spans"))

    return cut.select("conv", "window", F.concat(shown("system"), shown("history"), shown("own")).alias("formatted"), F.aggregate("own", first, span)["spans"].alias("loss_spans"), "n_system", F.size("history").alias("n_history"), F.size("own").alias("n_own"))


def read_back(windows: DataFrame) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows) from formatted windows alone.

    A repeated system turn or history is read in the window that has it first only.
    """
    pieces = F.split("formatted", END)
    skipped = F.when(F.col("window") == 0, 0).otherwise(F.col("n_system") + F.col("n_history"))
    turns = F.slice(pieces, skipped + 1, F.size(pieces) - 1 - skipped)

    texts = F.transform(turns, _turn_read)
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    rows = windows.select("conv", F.struct("window", F.array_join(texts, "").alias("turns"), F.array_join(loss, "").alias("loss"), F.size(turns).alias("n"), F.length("formatted").alias("chars")).alias("x"))
    whole = rows.groupBy("conv").agg(F.sort_array(F.collect_list("x")).alias("xs"), F.sum("x.n").cast("bigint").alias("n_turns"), F.sum("x.chars").cast("bigint").alias("formatted_chars"), F.count("*").alias("n_windows"))
    joined = whole.select("*", F.array_join(F.transform("xs", lambda x: x["turns"]), "").alias("turns"), F.array_join(F.transform("xs", lambda x: x["loss"]), "").alias("loss"))
    return joined.select("conv", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_windows")


def _turn_read(shown: Column) -> Column:
    """`role` line feed `text` line feed of a formatted turn."""
    head = F.substring_index(shown, "]\n", 1)
    role = unescape(F.substring(head, F.lit(5), F.length(head)))
    text = unescape(F.substring(shown, F.length(head) + 3, F.length(shown)))
    return F.concat(role, F.lit("\n"), text, F.lit("\n"))
