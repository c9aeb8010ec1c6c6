"""Chat formatting with built-in functions only: template, reversible escapes, budgeted windows, loss spans.

Turns of a conversation are ordered by (turn, role, text) and rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside
texts and roles a backslash is doubled and ``<|`` becomes ``<\\|``, so no text can hold a control string; roles also write
a line end as ``\\n``. Windows are turn-aligned: prefix sums of turn tokens tell where the running span would pass the
budget. A leading system turn opens every window, up to ``history`` tokens of turns before the span are repeated, and
repeated turns are outside the loss, as are all but assistant turns. A turn above the budget stands alone, whole.

Null text and role are empty; null ids form a conversation; repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY = 512, 64


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\\|])", "$1")


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    # Escapes are pairs that start with a backslash; splitting at doubled ones leaves only \n and \| to replace.
    return F.array_join(
        F.transform(F.split(c, r"\\\\"), lambda s: F.replace(F.replace(s, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))), "\\"
    )


def token_count(c: Column) -> Column:
    """Tokens of a text for the budget: runs of letters and digits, and single marks."""
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}]++|[^\s\p{L}\p{N}]"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Rows (conv_id, window, formatted, n_context, tokens, loss_spans) from turns(conv_id, turn, role, text).

    ``n_context`` turns at the window's start are repeated; ``loss_spans`` are (start, length) in code points, from 0.
    One shuffle, by conversation.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    t = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"), role.alias("role"), text.alias("text"), head.alias("head"), escape(text).alias("body"),
            (token_count(text) + 4).alias("tokens"),
        ).alias("t"),
    )
    conv = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    has_system = (F.size("t") > 1) & (F.col("t")[0]["role"] == "system")
    conv = conv.withColumn("sys", F.when(has_system, 1).otherwise(0)).withColumn("sys_tokens", F.when(has_system, F.col("t")[0]["tokens"]).otherwise(0))
    # Prefix sums, then the first turn of each span: a span closes before the turn whose prefix passes start + room.
    zero = F.array(F.lit(0).cast("long"))
    prefix = F.aggregate("t", zero, lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x["tokens"]))
    conv = conv.withColumn("p", prefix).withColumn("n", F.size("t"))
    room = F.greatest(F.lit(budget) - F.col("sys_tokens"), F.lit(1))
    first = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).cast("long").alias("base"), room.cast("long").alias("room"))

    def step(acc, i):
        # The first window holds the system turn itself, so its room is the whole budget.
        limit = F.when(F.size(acc["starts"]) == 1, F.lit(budget).cast("long")).otherwise(acc["room"])
        passes = (F.element_at(F.col("p"), i + 2) - acc["base"] > limit) & (i > F.element_at(acc["starts"], -1)) & ((i > F.col("sys")) | (F.col("sys") == 0))
        return F.struct(
            F.when(passes, F.array_append(acc["starts"], i)).otherwise(acc["starts"]).alias("starts"),
            F.when(passes, F.element_at(F.col("p"), i + 1)).otherwise(acc["base"]).alias("base"),
            acc["room"].alias("room"),
        )

    starts = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), first, step, lambda acc: acc["starts"])
    conv = conv.withColumn("starts", starts)
    conv = conv.select("conv_id", "t", "p", "n", "sys", F.posexplode("starts").alias("window", "s"), F.col("starts"))
    e = F.coalesce(F.get("starts", F.col("window") + 1), F.col("n"))
    conv = conv.withColumn("e", e)
    # Repeated history: the longest run of turns ending before the span within ``history`` tokens, not the system turn.
    fits = F.filter(
        F.sequence(F.lit(0), F.col("s")),
        lambda j: (j >= F.col("sys")) & (F.element_at(F.col("p"), F.col("s") + 1) - F.element_at(F.col("p"), j + 1) <= history),
    )
    conv = conv.withColumn("h", F.when(F.col("window") == 0, F.col("s")).otherwise(F.least(F.coalesce(F.array_min(fits), F.col("s")), F.col("s"))))
    lead = F.when((F.col("window") > 0) & (F.col("sys") == 1), F.slice("t", 1, 1)).otherwise(F.slice("t", 1, 0))
    used = F.concat(lead, F.slice("t", F.col("h") + 1, F.col("e") - F.col("h")))
    conv = conv.withColumn("used", used).withColumn("n_context", F.size(lead) + F.col("s") - F.col("h"))
    spans = F.aggregate(
        F.col("used"),
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans")),
        lambda acc, x: F.struct(
            (acc["i"] + 1).alias("i"),
            (acc["at"] + F.length(x["head"]) + F.length(x["body"]) + len(END) + 1).alias("at"),
            F.when(
                (acc["i"] >= F.col("n_context")) & (x["role"] == "assistant"),
                F.array_append(acc["spans"], F.struct((acc["at"] + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length"))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    formatted = F.array_join(F.transform("used", lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))), "")
    tokens = F.aggregate("used", F.lit(0).cast("long"), lambda acc, x: acc + x["tokens"])
    return conv.select("conv_id", "window", formatted.alias("formatted"), "n_context", tokens.alias("tokens"), spans.alias("loss_spans"))


def parsed(formatted: Column) -> Column:
    """Turns (role, text) read back from formatted text."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda s: s != "")
    cut = len(END) + 1
    return F.transform(
        pieces,
        lambda s: F.struct(
            unescape_role(F.substring_index(s, "\n", 1)).alias("role"),
            unescape(F.substring(s, F.length(F.substring_index(s, "\n", 1)) + 2, F.length(s) - F.length(F.substring_index(s, "\n", 1)) - 1 - cut)).alias("text"),
        ),
    )


def digest(w: DataFrame) -> DataFrame:
    """Per conversation: turns and loss text read back from its windows. The window rows are still dealt by conversation."""
    turns = F.slice(parsed(F.col("formatted")), F.col("n_context") + 1, F.size(parsed(F.col("formatted"))))
    loss = F.array_join(F.transform("loss_spans", lambda x: unescape(F.substring(F.col("formatted"), x["start"] + 1, x["length"]))), "")
    read = w.select("conv_id", "window", turns.alias("turns"), loss.alias("loss"), F.length("formatted").alias("chars"))
    read = read.withColumn("said", F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""))
    g = read.groupBy("conv_id").agg(
        F.sum(F.size("turns")).cast("long").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "said", "loss"))).alias("w"),
        F.sum("chars").cast("long").alias("formatted_chars"), F.count("*").alias("n_windows"),
    )
    loss_text = F.array_join(F.col("w.loss"), "")
    return g.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.col("w.said"), ""), 256).alias("turns_sha256"), F.length(loss_text).cast("long").alias("loss_chars"),
        F.sha2(loss_text, 256).alias("loss_sha256"), "formatted_chars", "n_windows",
    )
