"""Chat formatting: each participant's perspective of a dialogue.

For every participant of a conversation the dialogue is rendered with that
speaker as the assistant and the others as named users; system turns stay
system turns and take no perspective. The mask marks the text of the
assistant's turns, with the tag that ends them, as what is trained on.

Turns are ordered by number, then speaker, then text, and ranked. A perspective
is one rendering of the whole dialogue, which comes in parts of ``PART_TURNS``
turns: ``start`` is where a part begins in the rendering, masks are offsets in
the rendering, and the parts put together in order are it (``whole``). So a
dialogue of any length takes many rows and tasks.

Ranks of ordinary conversations come from a window. A conversation of
``HOT_TURNS`` turns and more is spread by ranges of its order instead, and its
ranks are a range's offset plus the place in the range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.llm.tables import materialize, maybe_broadcast

PART_TURNS, HOT_TURNS = 64, 4096
#: Hot conversations (an id each, fewer than all turns over HOT_TURNS) that may be sent to every task; more are joined by a shuffle.
BROADCAST_HOT = 500_000
#: Parts whose lengths are added up in one group before the groups are.
GROUP_PARTS = 1024
BEGIN, END = "<|im_start|>", "<|im_end|>"


def shown(speaker: Column) -> Column:
    """A speaker's name on one line and without tags; different names stay different."""
    for sign in "%\r\n<|>":
        speaker = F.replace(speaker, F.lit(sign), F.lit(f"%{ord(sign):02X}"))
    return speaker


def _ranked(own: DataFrame) -> DataFrame:
    """``own`` with ``rank``, the place of each turn in its conversation, from 0."""
    order = ["turn", "speaker", "said"]
    hot = materialize(own.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_TURNS).select("conv_id"), "hot-conversations")
    if hot.isEmpty():
        return _windowed(own, order)
    hot = maybe_broadcast(hot, BROADCAST_HOT)
    # equal rows may be exchanged for one another, so any number can part them
    spread = own.join(hot, "conv_id", "left_semi").withColumn("tie", F.monotonically_increasing_id())
    keys = ["conv_id", *order, "tie"]
    placed = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie").withColumn("place", F.monotonically_increasing_id())
    # computed once: another run of the plan may draw other ranges
    placed = materialize(placed, "placed-turns").withColumn("range", F.shiftright("place", 33))
    ranges = placed.groupBy("conv_id", "range").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = materialize(ranges.select("conv_id", "range", (before - F.col("first")).alias("shift")), "ranges")  # hot conversations and range bounds at most
    ranked = placed.join(maybe_broadcast(ranges, BROADCAST_HOT), ["conv_id", "range"]).withColumn("rank", F.col("place") + F.col("shift"))
    return _windowed(own.join(hot, "conv_id", "left_anti"), order).unionByName(ranked.select(*own.columns, "rank"))


def _windowed(own: DataFrame, order: list[str]) -> DataFrame:
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).cast("long") - 1)


def perspectives(turns: DataFrame, part_turns: int = PART_TURNS, system: str = "system") -> DataFrame:
    """conv_id, perspective, part, n_turns, start (characters of the rendering before this part), rendered, mask (array of start and stop in characters of the whole rendering, in order), n_masked.

    ``turns`` has conv_id, turn, role (the speaker) and text. Rows without
    conv_id, turn or role are no turns; a null text is empty; repeated rows are
    turns of their own. A conversation of system turns only has no
    perspective. In texts ``<|`` becomes ``< |``, and names are escaped, so no
    tag can be forged. Other columns are not read.
    """
    text = F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))
    own = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("speaker"), text.alias("said")).where("conv_id is not null and turn is not null and speaker is not null")
    ranked = _ranked(own).withColumns({"part": F.floor(F.col("rank") / part_turns).cast("long"), "name": F.when(F.col("speaker") == system, "system").otherwise(F.concat(F.lit("user name="), shown(F.col("speaker"))))})
    row = F.struct("rank", "speaker", "name", "said")
    parts = ranked.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(row)).alias("turns"))  # part_turns turns at most
    lengths = _starts(ranked, system)
    out = parts.join(lengths, ["conv_id", "part"])
    head = f"concat('{BEGIN}', if(t.speaker = perspective, 'assistant', t.name), '\\n')"
    out = out.withColumn("pieces", F.expr(f"transform(turns, t -> named_struct('head', {head}, 'body', concat(t.said, '{END}'), 'own', t.speaker = perspective))"))
    mask = """aggregate(pieces, named_struct('at', start, 'spans', cast(array() as array<struct<start: bigint, stop: bigint>>)), (a, p) -> named_struct(
        'at', a.at + length(p.head) + length(p.body) + 1,
        'spans', if(p.own, array_append(a.spans, named_struct('start', a.at + length(p.head), 'stop', a.at + length(p.head) + length(p.body))), a.spans)), a -> a.spans)"""
    rendered = F.expr("concat(array_join(transform(pieces, p -> concat(p.head, p.body)), '\\n'), '\\n')")
    out = out.select("conv_id", "perspective", "part", F.size("turns").cast("long").alias("n_turns"), "start", rendered.alias("rendered"), F.expr(mask).alias("mask"))
    return out.withColumn("n_masked", F.expr("aggregate(mask, 0L, (n, s) -> n + s.stop - s.start)"))


def _starts(ranked: DataFrame, system: str) -> DataFrame:
    """(conv_id, perspective, part, start) of each participant and part of the conversation, from lengths alone."""
    length = F.lit(len(BEGIN) + len(END) + 2) + F.length("name") + F.length("said")
    turns = ranked.select("conv_id", "part", "speaker", length.cast("long").alias("length"), (F.lit(len("assistant")) - F.length("name")).cast("long").alias("change"))
    # what a speaker's own turns change in the length of a part
    said = materialize(turns.groupBy("conv_id", "part", "speaker").agg(F.sum("length").alias("length"), F.sum("change").alias("change")), "part-lengths")
    parts = said.groupBy("conv_id", "part").agg(F.sum("length").alias("length"))
    who = said.where(F.col("speaker") != system).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    changes = said.select("conv_id", "part", F.col("speaker").alias("perspective"), "change")
    every = parts.join(who, "conv_id").join(changes, ["conv_id", "part", "perspective"], "left")
    every = every.select("conv_id", "perspective", "part", (F.col("length") + F.coalesce("change", F.lit(0))).alias("length"), F.floor(F.col("part") / GROUP_PARTS).alias("group"))
    upto = lambda *by: Window.partitionBy("conv_id", "perspective", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = every.groupBy("conv_id", "perspective", "group").agg(F.sum("length").alias("length"))
    groups = groups.select("conv_id", "perspective", "group", F.coalesce(F.sum("length").over(upto("group")), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("length").over(upto("group", "part")), F.lit(0))
    return every.withColumn("inside", inside).join(groups, ["conv_id", "perspective", "group"]).select("conv_id", "perspective", "part", (F.col("before") + F.col("inside")).alias("start"))


def whole(parts: DataFrame) -> DataFrame:
    """One rendering a participant, for dialogues that fit a row: conv_id, perspective, n_turns, rendered, mask, n_masked."""
    row = F.struct("part", "rendered", "mask")
    every = parts.groupBy("conv_id", "perspective").agg(F.sum("n_turns").alias("n_turns"), F.array_sort(F.collect_list(row)).alias("parts"), F.sum("n_masked").alias("n_masked"))
    return every.select("conv_id", "perspective", "n_turns", F.array_join(F.transform("parts", lambda p: p["rendered"]), "").alias("rendered"), F.flatten(F.transform("parts", lambda p: p["mask"])).alias("mask"), "n_masked")
