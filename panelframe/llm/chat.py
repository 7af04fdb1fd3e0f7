"""Operator 3: chat formatting by rotating the perspective over all participants.

For every participant of a conversation its dialogue is rendered with that speaker
as assistant and the others as named users; system messages stay system messages. The
result has a row for each message of each rendering: the segment, where it starts and
ends in the rendering, and the span to learn from (the assistant's text and its end
mark), empty elsewhere. Offsets are running sums in two levels, over `block` turns and
then over blocks, so that a conversation of any length spreads over tasks.

Order is by turn (null first), speaker, text. A null role is the speaker `unknown`, a null
text is empty, null conv_ids are one conversation. Repeated rows are repeated messages. A conversation
of system messages alone has no rendering. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelframe.llm.shared import narrow

END = "<|end|>\n"
SYSTEM = "system"


def _segment() -> tuple[Column, Column]:
    mine = F.col("speaker") == F.col("perspective")
    head = F.when(F.col("speaker") == SYSTEM, F.lit("<|system|>\n")).when(mine, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user:"), F.col("speaker"), F.lit("|>\n")))
    return head, F.concat(head, F.col("text"), F.lit(END))


def rotate(df: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", block: int = 256) -> DataFrame:
    """conv_id, perspective, turn, speaker, segment, seg_start, seg_end, mask_start, mask_end (in code points)."""
    m = narrow(df, conv_id=conv, turn=turn, speaker=speaker, text=text).select("conv_id", "turn", F.coalesce(F.col("speaker").cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    who = m.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    head, segment = _segment()
    out = m.join(who, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of").withColumns({"head": F.char_length(head), "segment": segment, "size": F.char_length(segment).cast("long"), "block": F.floor(F.coalesce(F.col("turn"), F.lit(0)) / block)})
    inside = Window.partitionBy("conv_id", "perspective", "block").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    sums = out.groupBy("conv_id", "perspective", "block").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    out = out.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = out.join(base, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
    start = F.col("base") + F.col("within")
    mine = (F.col("speaker") == F.col("perspective")) & (F.col("speaker") != SYSTEM)
    end = start + F.col("size")
    return out.select("conv_id", "perspective", "turn", "speaker", "segment", start.alias("seg_start"), end.alias("seg_end"), F.when(mine, start + F.col("head")).otherwise(end).alias("mask_start"), end.alias("mask_end"))
