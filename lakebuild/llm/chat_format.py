r"""Chat formatting into budgeted windows, in DataFrame functions only.

A turn costs its words plus one. Prefix sums of the costs cut a conversation into
turn-aligned spans: with a stride of budget - history - system turn, turns that lie
whole in the same stride cell form a span, and a turn that crosses a cell's border is
a span of its own. A window is the system turn (the first turn, if its role is
``system``), then the turns that lie whole within ``history`` tokens before the span,
then the span. Repeats are masked: the loss covers the texts of the span's assistant
turns only, so over all windows each assistant text carries loss once. Only a single
turn longer than the stride can exceed the budget; texts are never cut.

Template: ``<|turn|>role<|text|>text<|end|>`` per turn. Inside roles and texts, ``\``
is doubled and a ``\`` is put after the first character of every control string (those
of the template and those in ``CONTROLS``); ``unescape`` undoes exactly that.

Defined results: a null text or role is empty; turns are ordered by turn, role and
text, nulls first; repeated rows are turns of their own; a null conversation id is one
conversation; an empty table gives no windows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakebuild.llm.common import word_count

BUDGET, HISTORY = 1024, 256
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Control strings of common chat templates.
CONTROLS = [TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
            "<|im_start|>", "<|im_end|>", "<|endoftext|>"]


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescape(text: Column) -> Column:
    for c in CONTROLS:
        text = F.replace(text, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, n_tokens, n_repeat, formatted, loss): ``loss`` holds the (start, length) in code
    points of the formatted text that carry loss; ``n_repeat`` turns at the front are repeats."""
    src = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    src = src.withColumn("cost", word_count(F.col("text")) + 1)
    conv = Window.partitionBy("conv_id")
    order = conv.orderBy("turn", "role", "text")
    placed = src.withColumn("no", F.row_number().over(order)) \
        .withColumn("first", (F.col("no") == 1) & (F.col("role") == "system")) \
        .withColumn("one", F.struct(F.col("no"), "role", "text", "cost")) \
        .withColumn("system", F.max(F.when(F.col("first"), F.col("one"))).over(conv)) \
        .withColumn("weight", F.when(F.col("first"), 0).otherwise(F.col("cost"))) \
        .withColumn("end", F.sum("weight").over(conv.orderBy("no"))) \
        .withColumn("start", F.col("end") - F.col("weight")) \
        .withColumn("stride", F.greatest(F.lit(1), budget - history - F.coalesce("system.cost", F.lit(0)))) \
        .withColumn("cell", F.expr("start div stride")) \
        .withColumn("crosses", (F.col("end") > (F.col("cell") + 1) * F.col("stride")) & (F.col("start") > F.col("cell") * F.col("stride"))) \
        .withColumn("before", F.collect_list(F.when(~F.col("first"), F.col("one"))).over(
            conv.orderBy("start").rangeBetween(-history, -1)))
    spans = placed.groupBy("conv_id", "cell", "crosses").agg(
        F.sort_array(F.collect_list("one")).alias("new"), F.min_by("before", "no").alias("before"),
        F.any_value("system").alias("system"))
    again = F.col("system").isNotNull() & (F.col("new")[0]["no"] > 1)
    repeats = F.concat(F.when(again, F.array("system")).otherwise(F.array().cast(spans.schema["new"].dataType)),
                       F.sort_array("before"))
    spans = spans.withColumn("window", F.row_number().over(conv.orderBy("cell", "crosses")) - 1) \
        .withColumn("repeats", repeats).withColumn("turns", F.concat("repeats", "new")) \
        .withColumn("n_repeat", F.size("repeats")).withColumn("fresh", F.col("new")[0]["no"])

    def add(state: Column, t: Column) -> Column:
        head = F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT))
        body = escape(t["text"])
        learn = (t["role"] == "assistant") & (t["no"] >= state["fresh"])
        span = F.array(F.struct((F.length(state["text"]) + F.length(head)).alias("start"), F.length(body).alias("length")))
        return F.struct(F.concat(state["text"], head, body, F.lit(END)).alias("text"),
                        F.when(learn, F.concat(state["loss"], span)).otherwise(state["loss"]).alias("loss"),
                        state["fresh"].alias("fresh"))

    start = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"),
                     F.col("fresh").alias("fresh"))
    total = F.aggregate(F.transform("turns", lambda t: t["cost"]), F.lit(0).cast("long"), lambda a, x: a + x)
    return spans.withColumn("made", F.aggregate("turns", start, add)).select(
        "conv_id", "window", total.alias("n_tokens"), "n_repeat", F.col("made.text").alias("formatted"),
        F.col("made.loss").alias("loss"))


def read_back(made: DataFrame) -> DataFrame:
    """Per window, from its formatted text and mask alone: the new turns as ``role\\ntext\\n`` and the text under the loss."""
    parts = F.slice(F.split("formatted", r"<\|turn\|>"), F.col("n_repeat") + 2, F.lit(1 << 30))
    turn = F.transform(parts, lambda p: F.concat(
        unescape(F.substring_index(p, TEXT, 1)), F.lit("\n"),
        unescape(F.substr(p, F.instr(p, TEXT) + len(TEXT),
                          F.length(p) - F.instr(p, TEXT) - len(TEXT) + 1 - len(END))), F.lit("\n")))
    loss = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return made.select("conv_id", "window", F.size(parts).alias("n_turns"), F.concat_ws("", turn).alias("turns"),
                       F.concat_ws("", loss).alias("learned"), F.length("formatted").alias("chars"))


def digests(made: DataFrame) -> DataFrame:
    """One row per conversation, read back from its windows."""
    rows = F.sort_array(F.collect_list(F.struct("window", "turns", "learned")))
    got = read_back(made).groupBy("conv_id").agg(
        F.sum("n_turns").cast("long").alias("n_turns"), rows.alias("w"),
        F.sum(F.length("learned")).cast("long").alias("loss_chars"), F.sum("chars").cast("long").alias("formatted_chars"))
    return got.select("conv_id", "n_turns", F.sha2(F.concat_ws("", F.col("w.turns")), 256).alias("turns_sha256"), "loss_chars",
                      F.sha2(F.concat_ws("", F.col("w.learned")), 256).alias("loss_sha256"), "formatted_chars")
