"""Chat formatting: multi-party perspective rotation, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered once with that
speaker as assistant and the others as named users; loss masks cover what the
assistant says and the mark that ends it.  System messages are shown
to everyone and have no perspective.

Dialogues are rendered in parts of ``PART`` turns, so that a conversation of any
length is never one group; one of up to ``PART`` turns is a single row.  Parts know
where they begin in the whole dialogue, and masks count characters of the whole.

Defined results: null speakers are named "unknown"; null text is empty; null turns come first, in
a part of their own; messages of one turn are ordered by speaker, then text; rows that repeat
exactly are one message; a conversation with system messages only gives no rows;
rows with a null conversation id are one conversation; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

PART = 128
SYSTEM = "system"


def render_perspectives(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", part: int = PART) -> DataFrame:
    """conv, perspective, part, n_turns, char_start, rendered, masks (array of start, end; end exclusive)."""
    rows = messages.select(messages[conv_col].alias("conv"), messages[turn_col].alias("turn"), F.coalesce(messages[speaker_col], F.lit("unknown")).alias("speaker"), F.coalesce(messages[text_col], F.lit("")).alias("said")).distinct()
    people = rows.where(F.col("speaker") != SYSTEM).select(F.col("conv").alias("of"), F.col("speaker").alias("perspective")).distinct()
    seen = rows.join(people, F.col("conv").eqNullSafe(F.col("of"))).drop("of")

    own = F.col("speaker") == F.col("perspective")
    head = F.when(F.col("speaker") == SYSTEM, F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), F.regexp_replace("speaker", r"[|<>\n]", "_"), F.lit("|>\n")))
    body = F.concat("said", F.lit("<|end|>"))
    message = F.struct("turn", "speaker", "said", own.alias("own"), F.length(head).alias("lead"), F.length(body).alias("span"), F.concat(head, body, F.lit("\n")).alias("piece"))
    at = F.coalesce(F.floor(F.col("turn") / part), F.lit(-1 << 60))
    parts = seen.groupBy("conv", "perspective", at.alias("at")).agg(F.array_sort(F.collect_list(message), _in_order).alias("m"))
    parts = parts.select("conv", "perspective", "at", F.size("m").alias("n_turns"), F.array_join(F.transform("m", lambda x: x["piece"]), "").alias("rendered"), F.transform("m", lambda x: F.struct(x["own"].alias("own"), x["lead"].alias("lead"), x["span"].alias("span"))).alias("m"))

    dialogue = Window.partitionBy("conv", "perspective").orderBy("at")
    parts = parts.withColumn("part", F.row_number().over(dialogue) - 1).withColumn("char_start", F.sum(F.length("rendered").cast("long")).over(dialogue) - F.length("rendered"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    zero = F.struct(F.col("char_start").alias("at"), none.alias("spans"))

    def step(acc, x):
        begin = acc["at"] + x["lead"]
        span = F.struct(begin.alias("start"), (begin + x["span"]).alias("end"))
        return F.struct((begin + x["span"] + 1).alias("at"), F.when(x["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    masks = F.aggregate("m", zero, step, lambda a: a["spans"])
    return parts.select(F.col("conv").alias(conv_col), "perspective", "part", "n_turns", "char_start", "rendered", masks.alias("masks"))


def _in_order(a, b):
    """Null turns first, then turn, speaker, text."""
    less, same = F.lit(-1), F.lit(0)
    turn = F.when(a["turn"].eqNullSafe(b["turn"]), same).when(a["turn"].isNull(), less).when(b["turn"].isNull(), F.lit(1)).when(a["turn"] < b["turn"], less).otherwise(F.lit(1))
    rest = F.when(a["speaker"] != b["speaker"], F.when(a["speaker"] < b["speaker"], less).otherwise(F.lit(1))).when(a["said"] < b["said"], less).when(a["said"] == b["said"], same).otherwise(F.lit(1))
    return F.when(turn != 0, turn).otherwise(rest)


#: DuckDB SQL for the registered query.
ORACLE = """
WITH rows AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS said FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM rows WHERE speaker <> 'system'),
seen AS (
  SELECT r.conv_id, p.perspective, r.turn, r.speaker, r.said, r.speaker = p.perspective AS own,
    CASE WHEN r.speaker = 'system' THEN '<|system|>' || chr(10) WHEN r.speaker = p.perspective THEN '<|assistant|>' || chr(10)
      ELSE '<|user name=' || regexp_replace(r.speaker, '[|<>\\n]', '_', 'g') || '|>' || chr(10) END AS head,
    r.said || '<|end|>' AS body, coalesce(CAST(floor(r.turn / 128.0) AS BIGINT), -1152921504606846976) AS blk
  FROM rows r JOIN people p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, length(head) + length(body) + 1 AS n,
    sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, said ROWS UNBOUNDED PRECEDING) AS upto FROM seen),
parts AS (
  SELECT conv_id, perspective, blk, count(*) AS n_turns, min(upto - n) AS char_start,
    string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, speaker, said) AS rendered,
    coalesce(string_agg(CASE WHEN own THEN CAST(CAST(upto - 1 - length(body) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(upto - 1 AS BIGINT) AS VARCHAR) END, ',' ORDER BY turn NULLS FIRST, speaker, said), '') AS masks
  FROM placed GROUP BY ALL)
SELECT conv_id, perspective, CAST(row_number() OVER (PARTITION BY conv_id, perspective ORDER BY blk) - 1 AS INTEGER) AS part,
  CAST(n_turns AS INTEGER) AS n_turns, CAST(char_start AS BIGINT) AS char_start, rendered, masks FROM parts
"""
