"""Chat formatting: every conversation from the perspective of each of its participants.

For each participant a dialogue is rendered with that speaker as assistant and all others as
users under their names; turns of ``context`` roles, such as system, stay what they are in
every perspective and are nobody's. The mask marks what the assistant says: its text and the
end mark after it, not the header.

The result has a row per (conversation, perspective, turn), with the segment's text and its
place in the whole rendering, so no conversation is ever gathered into one row; ``transcript``
joins the segments of dialogues that are known to be short. Places are running sums over
blocks of 256 turn numbers first and over the blocks' totals then, so a very long
conversation is spread over many tasks. Everything is DataFrame functions.

Defined results
* null ``conv_id`` or ``role``: the row is no turn of any dialogue and is left out.
* null text is empty. A null turn comes first.
* repeated rows (same conversation, turn, role and text) are one turn; other ties are in the
  order of role, then text.
* a conversation of context turns alone has no participant and gives no row.
* control marks inside a text are rendered with a blank after ``<``, so they cannot close a segment.
* a speaker's name is the role with white space and the signs of marks (``<``, ``>``, ``|``, ``~``)
  as ``_``; of speakers whose names become equal, all but the first in order get ``~2``, ``~3`` and
  so on. Context roles stand in headers themselves, so they are names of your choice.
* the order inside a block of turn numbers is worked out in one task: rows of one conversation
  and 256 numbers, or without a number, for each perspective.
* extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
BLOCK = 256
#: Signs that no name holds.
NO_NAME = r"[\t\n\x0B\f\r <>|~]"


def _safe(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("< |im_start|>")), F.lit(CLOSE), F.lit("< |im_end|>"))


def rotate(turns: DataFrame, context: tuple[str, ...] = ("system",)) -> DataFrame:
    """conv_id, perspective, position, turn, speaker, role, name, segment, start, length, mask_start, mask_length."""
    said = (
        turns.where(F.col("conv_id").isNotNull() & F.col("role").isNotNull())
        .select("conv_id", "turn", F.col("role").alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
        .distinct()
    )
    speaks = ~F.col("speaker").isin(*context)
    people = said.where(speaks).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    plain = F.regexp_replace("perspective", NO_NAME, "_")
    alike = Window.partitionBy("conv_id", "_plain").orderBy("perspective")
    named = people.withColumn("_plain", plain).withColumn("_k", F.row_number().over(alike))
    named = named.select(
        "conv_id",
        F.col("perspective").alias("speaker"),
        F.when(F.col("_k") == 1, F.col("_plain")).otherwise(F.concat("_plain", F.lit("~"), F.col("_k").cast("string"))).alias("_name"),
    )
    views = said.join(named, ["conv_id", "speaker"], "left").join(people, "conv_id")
    mine = F.col("speaker") == F.col("perspective")
    role = F.when(~speaks, F.col("speaker")).when(mine, "assistant").otherwise("user")
    name = F.when(speaks & ~mine, F.col("_name"))
    head = F.concat(F.lit(OPEN), F.col("role"), F.when(F.col("name").isNotNull(), F.concat(F.lit(" name="), F.col("name"))).otherwise(""), F.lit("\n"))
    body = F.concat(_safe(F.col("text")), F.lit(CLOSE))
    views = (
        views.withColumn("role", role)
        .withColumn("name", name)
        .withColumn("_head", head)
        .withColumn("segment", F.concat("_head", body, F.lit("\n")))
        .withColumn("length", F.char_length("segment").cast("long"))
        .withColumn("_block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    )
    dialogue = Window.partitionBy("conv_id", "perspective")
    blocks = views.groupBy("conv_id", "perspective", "_block").agg(F.sum("length").alias("_l"), F.count("*").alias("_n"))
    before = dialogue.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "conv_id",
        "perspective",
        "_block",
        F.coalesce(F.sum("_l").over(before), F.lit(0)).alias("_l0"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
    )
    inside = Window.partitionBy("conv_id", "perspective", "_block").orderBy("turn", "speaker", "text")
    here = inside.rowsBetween(Window.unboundedPreceding, -1)
    views = views.withColumn("_l1", F.coalesce(F.sum("length").over(here), F.lit(0))).withColumn("_n1", F.row_number().over(inside) - 1)
    views = views.join(blocks, ["conv_id", "perspective", "_block"])
    start = F.col("_l0") + F.col("_l1")
    trained = F.col("role") == "assistant"
    return views.withColumn("start", start).select(
        "conv_id",
        "perspective",
        (F.col("_n0") + F.col("_n1")).alias("position"),
        "turn",
        "speaker",
        "role",
        "name",
        "segment",
        "start",
        "length",
        F.when(mine & speaks & trained, F.col("start") + F.char_length("_head")).alias("mask_start"),
        F.when(mine & speaks & trained, F.col("length") - F.char_length("_head") - 1).otherwise(F.lit(0)).cast("long").alias("mask_length"),
    )


def transcript(rotated: DataFrame) -> DataFrame:
    """Whole renderings, for dialogues known to fit a row."""
    parts = F.array_sort(F.collect_list(F.struct("position", "segment")))
    return rotated.groupBy("conv_id", "perspective").agg(F.array_join(F.transform(parts, lambda p: p["segment"]), "").alias("text"))


SQL = r"""
WITH said AS (SELECT DISTINCT conv_id, turn, role AS speaker, coalesce(text, '') AS text FROM conversations
              WHERE conv_id IS NOT NULL AND role IS NOT NULL),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
plain AS (SELECT *, regexp_replace(perspective, '[\t\n\x0B\f\r <>|~]', '_', 'g') AS c FROM people),
named AS (SELECT conv_id, perspective AS speaker, c || CASE WHEN k > 1 THEN '~' || k ELSE '' END AS nm
          FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, c ORDER BY perspective) AS k FROM plain)),
v AS (SELECT s.*, p.perspective,
             CASE WHEN s.speaker = 'system' THEN s.speaker WHEN s.speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
             CASE WHEN s.speaker <> 'system' AND s.speaker <> perspective THEN nm END AS name
      FROM said s JOIN people p ON s.conv_id = p.conv_id LEFT JOIN named n ON n.conv_id = s.conv_id AND n.speaker = s.speaker),
h AS (SELECT *, '<|im_start|>' || role || CASE WHEN name IS NOT NULL THEN ' name=' || name ELSE '' END || chr(10) AS head FROM v),
g AS (SELECT *, head || replace(replace(text, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10) AS segment FROM h),
l AS (SELECT *, length(segment) AS length,
             coalesce(sum(length(segment)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
             row_number() OVER w - 1 AS position
      FROM g WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text))
SELECT conv_id, perspective, position, turn, speaker, role, name, segment, start, length,
       CASE WHEN speaker = perspective THEN start + length(head) END AS mask_start,
       CASE WHEN speaker = perspective THEN length - length(head) - 1 ELSE 0 END AS mask_length
FROM l
"""

TRANSCRIPT_SQL = f"""
WITH rotated AS ({SQL})
SELECT conv_id, perspective, string_agg(segment, '' ORDER BY position) AS text FROM rotated GROUP BY conv_id, perspective
"""
