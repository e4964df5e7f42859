"""Chat formatting by multi-party perspective rotation.

A conversation is rendered once for each of its participants: that speaker's turns as
the assistant's, all others as named users, and system turns as they are. The mask
lists the spans of the rendered text, in characters, that the participant wrote, the
end mark included; a trainer learns from these alone.

A conversation of any length goes in parts of at most PART_TURNS turns, so that no task
gathers a whole one; parts put one after another give the dialogue, and spans count from
the dialogue's start. Turns are numbered within runs of PART_TURNS turn numbers, each of
which is sorted by one task, a row at a time; sizes of parts alone are added up over a
whole conversation.

Begin and end marks in what was said are written with a backslash after the ``<``, and
line ends in a speaker's name as spaces, so no text opens or closes a turn.

Defined cases: rows with a null conversation take no part; a null turn counts as turn
0, a null speaker is ``unknown``, a null text is empty; of equal turns, the order is by
speaker and then by text, and repeated rows stay. A conversation of system turns alone
has no participant and no row. An empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_TURNS = 512
SYSTEM = "system"
BEGIN, END = "<|im_start|>", "<|im_end|>"


def harmless(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|(im_start|im_end)\|>", r"<\\|$1|>")


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, part, participant, n_turns, text, mask (``start-end`` pairs with commas between), by built-in functions alone."""
    speaker = F.regexp_replace(harmless(F.coalesce(F.col(f"`{role_col}`"), F.lit("unknown"))), r"[\r\n]", " ")
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), F.coalesce(F.col(f"`{turn_col}`").cast("long"), F.lit(0)).alias("turn"), speaker.alias("speaker"), harmless(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("text")).where("conv_id IS NOT NULL")
    run = Window.partitionBy("conv_id", "run").orderBy("turn", "speaker", "text")
    placed = rows.withColumn("run", F.floor(F.col("turn") / part_turns)).withColumn("place", F.floor((F.row_number().over(run) - 1) / part_turns))
    shared = ["conv_id", "run", "place"]
    parts = placed.groupBy(*shared).agg(F.array_sort(F.collect_list(F.struct("turn", "speaker", "text"))).alias("turns"))

    # where each part starts in each participant's rendering: all turns as others see them, less what "assistant" saves
    other = F.when(F.col("speaker") == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), F.col("speaker")))
    size = F.length("text") + F.length(other) + len(BEGIN) + len(END) + 2
    said = placed.groupBy(*shared, "speaker").agg(F.sum(size).alias("size"), F.count("*").alias("n"))
    speakers = said.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("participant")).distinct()
    grid = said.groupBy(*shared).agg(F.sum("size").alias("size")).join(speakers, "conv_id").join(said.select(*shared, F.col("speaker").alias("participant"), "n"), [*shared, "participant"], "left")
    own = F.coalesce("n", F.lit(0)) * (F.length(F.concat(F.lit("user name="), F.col("participant"))) - len("assistant"))
    before = Window.partitionBy("conv_id", "participant").orderBy("run", "place")
    starts = grid.select(*shared, "participant", (F.row_number().over(before) - 1).cast("long").alias("part"), (F.sum(F.col("size") - own).over(before) - F.col("size") + own).cast("long").alias("start"))

    me = F.col("participant")
    head = lambda t: F.concat(F.lit(BEGIN), F.when(t["speaker"] == me, "assistant").when(t["speaker"] == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), t["speaker"])), F.lit("\n"))
    body = lambda t: F.concat(t["text"], F.lit(END))
    cut = F.transform("turns", lambda t: F.struct(head(t).alias("head"), body(t).alias("body"), (t["speaker"] == me).alias("mine")))
    shown = parts.join(starts, shared).withColumn("cut", cut)
    first = F.struct(F.col("start").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(s, c):
        a = s["at"] + F.length(c["head"])
        b = a + F.length(c["body"])
        return F.struct((b + 1).alias("at"), F.when(c["mine"], F.array_append(s["spans"], F.concat_ws("-", a.cast("string"), b.cast("string")))).otherwise(s["spans"]).alias("spans"))

    text = F.array_join(F.transform("cut", lambda c: F.concat(c["head"], c["body"], F.lit("\n"))), "")
    mask = F.array_join(F.aggregate("cut", first, step, lambda s: s["spans"]), ",")
    return shown.select("conv_id", "part", "participant", F.size("turns").cast("long").alias("n_turns"), text.alias("text"), mask.alias("mask"))
