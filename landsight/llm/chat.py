"""Multi-party chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant, all other speakers
as users with their names, and system messages as they are. The mask is the spans of the rendered text to train on: the
speaker's own messages and their end marks. A rendering is cut into parts of so many turn numbers, which joined in
order are the whole of it, so one endless conversation is many rows and many tasks and never one of either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM, UNKNOWN = "system", "unknown"
TURNS_PER_PART = 64


def escaped(text: Column) -> Column:
    """Marks inside a message are made harmless: "<|" becomes "<\\|", and so one more backslash for those that have some: ``unescaped`` takes it back."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    """What ``escaped`` was made of."""
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text",
           system: str = SYSTEM, turns_per_part: int | None = TURNS_PER_PART) -> DataFrame:
    """(conv, perspective, part, text, masks, n_messages): one row for each conversation, participant and part.

    turns_per_part bounds a row: how many turn numbers a part has. None puts each rendering in one row (part 0), whatever
    its length. masks: "start:end" in code points of the part's text, comma-joined, end exclusive. Messages go by turn; those of the
    same turn by speaker and text. Repeated rows are one message. A null text is empty, a null speaker is "unknown", a
    null turn comes before all others in a part of its own (null), null conversations are one. A conversation of system
    messages alone has no participant and no row. Other columns are ignored.
    """
    said = turns.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{speaker_col}`").cast("string"), F.lit(UNKNOWN)).alias("who"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("said")).distinct()
    people = said.where(F.col("who") != system).select("conv", F.col("who").alias("perspective")).distinct()
    part = (F.floor(F.col("turn") / turns_per_part) if turns_per_part else F.lit(0)).cast("bigint").alias("part")
    parts = said.groupBy("conv", part).agg(F.sort_array(F.collect_list(F.struct("turn", "who", "said"))).alias("messages"))
    both = parts.join(people.withColumnRenamed("conv", "__conv"), F.col("conv").eqNullSafe(F.col("__conv")))

    def rendered(m: Column) -> Column:
        own = m["who"] == F.col("perspective")
        head = F.when(m["who"] == system, F.lit(f"{START}system\n")).when(own, F.lit(f"{START}assistant\n"))
        head = head.otherwise(F.concat(F.lit(f"{START}user name="), escaped(m["who"]), F.lit("\n")))
        return F.struct(head.alias("head"), F.concat(escaped(m["said"]), F.lit(END)).alias("body"), own.alias("own"))

    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + F.length(s["head"])
        end = begin + F.length(s["body"])
        span = F.concat_ws(":", begin.cast("string"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(s["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    rows = both.withColumn("segments", F.transform("messages", rendered))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    masks = F.array_join(F.aggregate("segments", zero, step, lambda a: a["spans"]), ",")
    text = F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), "")
    return rows.select(F.col("conv").alias(conv_col), "perspective", "part", text.alias("text"), masks.alias("masks"), F.size("messages").cast("bigint").alias("n_messages"))


def oracle_sql(turns_per_part: int = TURNS_PER_PART) -> str:
    """The same over a table named conversations, in the SQL of DuckDB."""
    escape = lambda x: f"regexp_replace({x}, '<(\\\\*)\\|', '<\\\\\\1|', 'g')"
    return f"""
WITH said AS (SELECT DISTINCT conv_id, turn, coalesce(role, '{UNKNOWN}') AS who, coalesce(text, '') AS said FROM conversations),
people AS (SELECT DISTINCT conv_id, who AS perspective FROM said WHERE who <> '{SYSTEM}'),
segments AS (
  SELECT s.conv_id, p.perspective, CAST(floor(s.turn / {turns_per_part}) AS BIGINT) AS part, s.turn, s.who, s.said, s.who = p.perspective AS own,
    CASE WHEN s.who = '{SYSTEM}' THEN '{START}system' WHEN s.who = p.perspective THEN '{START}assistant'
         ELSE '{START}user name=' || {escape('s.who')} END || chr(10) AS head,
    {escape('s.said')} || '{END}' AS body
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, who, said
    ROWS UNBOUNDED PRECEDING) - length(body) - 1 AS start FROM segments)
SELECT conv_id, perspective, part, string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, who, said) AS text,
  coalesce(string_agg(CASE WHEN own THEN CAST(start AS BIGINT) || ':' || CAST(start + length(body) AS BIGINT) END, ',' ORDER BY turn NULLS FIRST, who, said), '') AS masks,
  count(*) AS n_messages
FROM placed GROUP BY conv_id, perspective, part"""
