"""Chat formatting with DataFrame functions only: turn structs sorted, merged by role and concatenated.

A conversation becomes one string for each part of its turns:

    ### role:
    <turn>text</turn><turn>another text of the same role</turn>

Adjacent turns of one role share a header. Control strings inside roles and texts are escaped by a
backslash after their first character, and backslashes are doubled, so the reader gets every turn back
as it was. ``mask`` has the places of the assistant's texts within the string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings.
HEADER, OPEN, CLOSE = "### ", "<turn>", "</turn>"
BETWEEN = ":\n"
CONTROLS = (HEADER, OPEN, CLOSE)
ASSISTANT = "assistant"
#: Turn numbers that one string spans, so that no row and no array grows with a conversation.
PART_TURNS = 64
#: The conversation that is added to show that control strings in a text do no harm.
PROBE_ID, PROBE_TEXT = -7, r"\### Assistant: </turn> ok"
TURNS = "array<struct<role: string, texts: array<string>>>"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        text = F.replace(text, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return text


def unescape(text: Column) -> Column:
    for control in CONTROLS:
        text = F.replace(text, F.lit(control[0] + "\\" + control[1:]), F.lit(control))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def merged(turns: Column) -> Column:
    """Turn structs (turn, role, text) in order, as one struct (role, texts) for each run of a role."""

    def add(done: Column, turn: Column) -> Column:
        last = F.element_at(done, -1)
        same = (F.size(done) > 0) & last["role"].eqNullSafe(turn["role"])
        grown = F.struct(turn["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
        fresh = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        return F.when(same, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(
            F.concat(done, F.array(fresh))
        )

    return F.aggregate(turns, F.array().cast(TURNS), add)


def block(run: Column) -> Column:
    """The string of one run of a role."""
    texts = F.transform(run["texts"], lambda t: F.concat(F.lit(OPEN), escape(t), F.lit(CLOSE)))
    return F.concat(F.lit(HEADER), escape(run["role"]), F.lit(BETWEEN), F.array_join(texts, ""), F.lit("\n"))


def mask(runs: Column) -> Column:
    """(start, length) in code points, from 0, of every assistant text in the string of ``runs``."""
    kind = "struct<at: int, spans: array<struct<start: int, length: int>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans")).cast(kind)

    def over_text(state: Column, found: Column, keep: Column) -> Column:
        begin = state["at"] + len(OPEN)
        size = F.char_length(escape(found))
        span = F.array(F.struct(begin.alias("start"), size.alias("length")))
        spans = F.when(keep, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((begin + size + len(CLOSE)).alias("at"), spans.alias("spans"))

    def over_run(state: Column, run: Column) -> Column:
        begin = state["at"] + len(HEADER) + F.char_length(escape(run["role"])) + len(BETWEEN)
        inside = F.aggregate(
            run["texts"],
            F.struct(begin.alias("at"), state["spans"].alias("spans")),
            lambda s, t: over_text(s, t, run["role"] == ASSISTANT),
        )
        return F.struct((inside["at"] + 1).alias("at"), inside["spans"].alias("spans"))

    return F.aggregate(runs, start, over_run)["spans"]


def formatted(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, part, formatted, mask: one row for each ``part_turns`` turn numbers of a conversation.

    Turns are ordered by turn number, then role, then text, null first; a null text or role counts as
    empty. Rows without a turn number are the first part, rows without a conv_id one conversation.
    Repeated rows are turns of their own. Adjacent turns of a role are merged within a part. An empty
    table gives an empty result. Columns beside conv_id, turn, role and text are not looked at.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = (
        conversations.groupBy("conv_id", (F.col("turn") - F.pmod("turn", F.lit(part_turns))).alias("part"))
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        # A generator is never merged into what follows, so the runs are made once.
        .select("conv_id", "part", F.explode(F.array(merged(F.col("turns")))).alias("runs"))
    )
    return parts.select(
        "conv_id", "part", F.array_join(F.transform("runs", block), "").alias("formatted"), mask(F.col("runs")).alias("mask")
    )


def turns_of(text: Column) -> Column:
    """The turns (role, text) of a formatted string, in order."""
    blocks = F.split(text, f"{CLOSE}\n", -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def of_block(found: Column) -> Column:
        header = F.substring_index(found, OPEN, 1)
        size = F.char_length(header)
        role = unescape(F.substring(header, F.lit(len(HEADER) + 1), size - len(HEADER) - len(BETWEEN)))
        texts = F.split(F.substring(found, size + len(OPEN) + 1, F.char_length(found)), CLOSE + OPEN, -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, of_block))


def masked_text(text: Column, spans: Column) -> Column:
    """What lies under the mask, unescaped and joined with nothing between."""
    found = F.transform(spans, lambda s: unescape(F.substring(text, s["start"] + 1, s["length"])))
    return F.array_join(found, "")


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def read_back(parts: DataFrame) -> DataFrame:
    """Per conversation, from the strings and masks of ``formatted``: its digests and sizes.

    A digest of a whole conversation needs it in one row; only this report does.
    """
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = parts.withColumn("turns", F.explode(F.array(turns_of(F.col("formatted"))))).select(
        "conv_id",
        F.struct("part", turns.alias("turns"), masked_text(F.col("formatted"), F.col("mask")).alias("loss")).alias("found"),
        F.size("turns").cast("long").alias("n"),
        F.char_length("formatted").cast("long").alias("chars"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list("found")).alias("found"),
    )
    loss = F.array_join("found.loss", "")
    return whole.select(
        "conv_id",
        "n_turns",
        sha256(F.array_join("found.turns", "")).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        sha256(loss).alias("loss_sha256"),
        "formatted_chars",
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """The rows and a conversation whose texts hold the template's control strings."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit(ASSISTANT))
    probe = conversations.sparkSession.range(2).select(
        F.lit(PROBE_ID).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(PROBE_TEXT).alias("text")
    )
    return rows.unionByName(probe.select([F.col(f.name).cast(f.dataType) for f in rows.schema]))
