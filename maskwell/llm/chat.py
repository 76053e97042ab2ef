"""Chat formatting in budgeted windows, native.

Turns of a conversation, in turn order, are cut into windows of at most ``budget`` tokens
(words) by prefix sums: a window is the conversation's leading system turn, if any, then up
to ``history`` tokens of whole turns repeated from before, then new turns. A single turn that is
over the budget has a window of its own and stays whole. Loss covers the new assistant turns; repeated ones are
masked, so each assistant text is under the loss once.

Template: ``<|role|>text</s>``. Control strings inside texts are escaped reversibly: ``~`` is
``~0``; a ``<`` or ``[`` that would begin a control string is ``~1`` or ``~2``; in roles ``|`` is ``~3``.

Null texts and roles are empty. Null turns sort first, ties by role, then text. Repeated rows
are turns of their own. A null conv_id is one conversation. Very long turns stay whole. Other columns are
not read, whatever their names. Empty tables give no rows. A
conversation is one output digest, so it must fit one row (below 2 GB of text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUDGET, HISTORY = 1024, 256
LOSS_ROLE = "assistant"
END = "</s>"


def escape(text: Column) -> Column:
    """Escape what could be read as a control string."""
    out = F.replace(text, F.lit("~"), F.lit("~0"))
    out = F.regexp_replace(out, r"<(?=/?s>|<?/?SYS>|\|)", "~1")
    return F.regexp_replace(out, r"\[(?=/?INST\])", "~2")


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("~2"), F.lit("[")), F.lit("~1"), F.lit("<"))
    return F.replace(out, F.lit("~0"), F.lit("~"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("|"), F.lit("~3"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("~3"), F.lit("|")))


def windows(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, n_new, n_repeated, formatted, loss: array of struct(start, length) in code points of formatted.

    ``rows``: conv_id, turn, role, text."""
    turn = rows.select(
        "conv_id",
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    conv = turn.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    made = F.transform("t", lambda t: F.concat(F.lit("<|"), _escape_role(t["role"]), F.lit("|>"), escape(t["text"]), F.lit(END)))
    tokens = F.transform("t", lambda t: F.size(F.split(F.trim(t["text"]), r"\s+")).cast("long") + 2)
    conv = conv.select("conv_id", made.alias("made"), tokens.alias("n"), F.transform("t", lambda t: t["role"] == LOSS_ROLE).alias("target"), F.transform("t", lambda t: F.length(_escape_role(t["role"]))).alias("head"), (F.element_at("t", 1)["role"] == "system").alias("system"))
    # prefix sums: tokens of the turns before each turn, and of all
    sums = F.aggregate("n", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    conv = conv.withColumn("p", sums).withColumn("sys", F.when(F.col("system"), F.element_at("n", 1)).otherwise(F.lit(0)).cast("long"))
    start = F.struct(F.lit(0).alias("start"), F.lit(0).alias("hist"))

    def advance(acc: Column, i: Column) -> Column:
        last = F.element_at(acc, -1)
        # the system turn counts once: inside the span if it begins with it, else before it
        used = F.col("p")[i + 1] - F.col("p")[last["hist"]] + F.when(last["hist"] > 0, F.col("sys")).otherwise(0)
        full = (used > budget) & (i > last["start"])
        # history: whole turns just before i, as many as fit both limits, never the system turn twice
        before = F.size(F.filter("p", lambda x: F.col("p")[i] - x > F.least(F.lit(history).cast("long"), F.greatest(F.lit(0).cast("long"), F.lit(budget) - F.col("sys") - F.col("n")[i]))))
        hist = F.least(i, F.greatest(before, F.when(F.col("system"), F.lit(1)).otherwise(F.lit(0))))
        return F.when(full, F.concat(acc, F.array(F.struct(i.alias("start"), hist.cast("int").alias("hist"))))).otherwise(acc)

    cuts = F.aggregate(F.sequence(F.lit(0), F.size("n") - 1), F.array(start), advance)
    conv = conv.withColumn("cuts", cuts)

    def window(c: Column, k: Column) -> Column:
        stop = F.coalesce(F.get("cuts", k + 1)["start"], F.size("n"))
        lead = F.when(F.col("system") & (c["hist"] > 0), F.slice("made", 1, 1)).otherwise(F.array().cast("array<string>"))
        own = lambda x: F.slice(x, c["start"] + 1, stop - c["start"])
        return F.struct(F.concat(lead, F.slice("made", c["hist"] + 1, stop - c["hist"])).alias("parts"), own("target").alias("target"), own("head").alias("head"), (stop - c["start"]).alias("n_new"))

    row = conv.select("conv_id", F.posexplode(F.transform("cuts", window)).alias("window", "w")).select("conv_id", "window", "w.*")
    row = row.withColumn("n_repeated", F.size("parts") - F.col("n_new"))
    sizes = F.transform("parts", lambda x: F.length(x))
    ends = F.aggregate(sizes, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    row = row.withColumn("ends", ends)
    spans = F.transform(F.sequence(F.lit(0), F.col("n_new") - 1), lambda i: F.struct((F.col("ends")[F.col("n_repeated") + i] + F.col("head")[i] + 4).alias("start"), (F.col("ends")[F.col("n_repeated") + i + 1] - F.col("ends")[F.col("n_repeated") + i] - F.col("head")[i] - 4 - len(END)).alias("length"), F.col("target")[i].alias("target")))
    loss = F.transform(F.filter(spans, lambda s: s["target"]), lambda s: F.struct(s["start"], s["length"]))
    return row.select("conv_id", "window", "n_new", "n_repeated", F.array_join("parts", "").alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the windows."""
    parts = F.split("formatted", "</s>", -1)
    new = F.slice(parts, F.col("n_repeated") + 1, F.size(parts) - 1 - F.col("n_repeated"))
    turns = F.transform(new, lambda x: F.concat(_unescape_role(F.substring_index(F.substr(x, F.lit(3)), "|>", 1)), F.lit("\n"), unescape(F.substr(x, F.instr(x, F.lit("|>")) + 2)), F.lit("\n")))
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["length"]))), "")
    one = formatted.select("conv_id", F.struct("window", F.size(turns).alias("n"), F.array_join(turns, "").alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("chars")).alias("w"))
    conv = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    said = F.array_join("w.loss", "")
    return conv.select(
        "conv_id",
        F.aggregate("w.n", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_turns"),
        F.sha2(F.array_join("w.turns", ""), 256).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"),
        F.sha2(said, 256).alias("loss_sha256"),
        F.aggregate("w.chars", F.lit(0).cast("long"), lambda a, x: a + x).alias("formatted_chars"),
    )
