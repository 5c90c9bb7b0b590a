"""Chat formatting: multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant: the speaker's turns carry the loss, the others' turns
appear as named users, system turns stay as they are. With the ``chatml``-like
markup below, a turn is

    <|im_start|>assistant\\n<text><|im_end|>\\n
    <|im_start|>user name=<speaker>\\n<text><|im_end|>\\n
    <|im_start|>system\\n<text><|im_end|>\\n

and the loss mask covers the assistant's text and its ``<|im_end|>``. Markup
inside a turn's text is broken up (a zero-width joiner after ``<``), so that no
text can pose as a turn; names are cut down to letters, marks, digits, ``_`` and ``-``. A
participant is a role as it stands: where the names of several roles of a conversation come
out alike, all but the first role's get ``#2``, ``#3`` and so on, in order of the roles.

Shape: a rendering is cut into parts of at most ``PART_TURNS`` turns, so that a
conversation of any length never has to fit one row or one task: parts join, in
order, to the whole rendering, and each part's spans count from its own start. Turns
are numbered over range partitions, so neither a long conversation nor many turns of one number meet in a task. Only turns and names are shuffled: a turn
is rendered once per perspective, after it has met the conversation's list of
participants.

Defined cases: a null text is an empty turn, a very long one stays whole; a null role is a speaker named
``unknown`` (and not the same as a role of that name); a null turn number comes first; equal turn numbers are ordered by
role and text; repeated rows are repeated turns; conversations with system turns
only have no participants and give no rows; a null conv_id is a conversation of
its own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parallax.llm.components import places
from parallax.session import scratch_path

PART_TURNS = 64
SYSTEM = "system"
UNKNOWN = "unknown"
START, END = "<|im_start|>", "<|im_end|>"


def speaker_name(role: Column) -> Column:
    """The speaker's name as markup may hold it."""
    name = F.regexp_replace(F.coalesce(role, F.lit(UNKNOWN)), r"[^\p{L}\p{M}\p{N}_-]+", "_")
    return F.when(name == "", F.lit(UNKNOWN)).otherwise(name)


def safe_text(text: Column) -> Column:
    """The text, null as empty, with no turn markup in it."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\|im_(?:start|end)\|>)", "<‍$1")


def ranked_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """(conv_id, place, speaker, text): turns numbered from 0 in their conversation, speakers by their names in it."""
    spark = turns.sparkSession
    t = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"),
                     F.col(text_col).alias("text"))
    placed = places(t, "conv_id", "turn", "role", "text").withColumn("name", speaker_name(F.col("role")))
    # roles whose name another role of the conversation has too; written, so that a join with few is a broadcast
    roles = t.select("conv_id", "role").distinct().withColumn("name", speaker_name(F.col("role")))
    alike = roles.withColumn("k", F.row_number().over(W.partitionBy("conv_id", "name").orderBy(F.asc_nulls_first("role")))).filter("k > 1")
    path = scratch_path(spark, "chat-names")
    alike.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.concat("name", F.lit("#"), "k").alias("alias")).write.parquet(path)
    alias = spark.read.parquet(path)
    return (placed.join(alias, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("role").eqNullSafe(F.col("_r")), "left")
            .select("conv_id", F.col("_at").alias("place"), F.coalesce("alias", "name").alias("speaker"), safe_text(F.col("text")).alias("text")))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, assistant, part, n_parts, n_turns, text, mask): one row per perspective and part.

    ``mask`` lists the [start, end) spans of the part's text, in characters, that carry the loss;
    ``n_turns`` is the part's number of turns."""
    placed = ranked_turns(turns, conv_col, turn_col, role_col, text_col).withColumn("part", F.floor(F.col("place") / part_turns).cast("int"))
    parts = placed.groupBy("conv_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("place", "speaker", "text"))).alias("turns"))  # at most part_turns turns
    people = (placed.filter(F.col("speaker") != SYSTEM).groupBy("conv_id", "speaker").agg(F.max("place").alias("p"))
              .select(F.col("conv_id").alias("_c"), F.col("speaker").alias("assistant")))
    last = placed.groupBy("conv_id").agg((F.max("part") + 1).alias("n_parts")).withColumnRenamed("conv_id", "_l")
    both = parts.join(people, parts["conv_id"].eqNullSafe(F.col("_c"))).join(last, F.col("conv_id").eqNullSafe(F.col("_l")))
    own = lambda t: t["speaker"] == F.col("assistant")
    head = lambda t: (F.when(own(t), F.lit(f"{START}assistant\n"))
                      .when(t["speaker"] == SYSTEM, F.lit(f"{START}system\n"))
                      .otherwise(F.concat(F.lit(f"{START}user name="), t["speaker"], F.lit("\n"))))
    both = both.withColumn("pieces", F.transform("turns", lambda t: F.struct(
        own(t).alias("own"), F.length(head(t)).alias("h"), (F.length(t["text"]) + len(END)).alias("n"),
        F.concat(head(t), t["text"], F.lit(f"{END}\n")).alias("s"))))
    # running start of each piece, then the spans of the assistant's own
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("spans"))
    step = lambda acc, p: F.struct(
        (acc["at"] + p["h"] + p["n"] + 1).alias("at"),
        F.when(p["own"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["h"]).alias("start"), (acc["at"] + p["h"] + p["n"]).alias("end")))))
        .otherwise(acc["spans"]).alias("spans"))
    return both.select("conv_id", "assistant", "part", "n_parts", F.size("turns").alias("n_turns"),
                       F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("text"),
                       F.aggregate("pieces", start, step, lambda acc: acc["spans"]).alias("mask"))


# The same rendering in DuckDB SQL, for the query's columns.
ORACLE = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place,
                  role, regexp_replace(coalesce(role, '{UNKNOWN}'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_-]+', '_', 'g') AS s0,
                  regexp_replace(coalesce(text, ''), '<(\\|im_(?:start|end)\\|>)', '<' || chr(8205) || '\\1', 'g') AS text FROM conversations),
s AS (SELECT conv_id, place, role, CASE WHEN s0 = '' THEN '{UNKNOWN}' ELSE s0 END AS name, text FROM t),
a AS (SELECT conv_id, role, name, row_number() OVER (PARTITION BY conv_id, name ORDER BY role NULLS FIRST) AS k FROM (SELECT DISTINCT conv_id, role, name FROM s)),
p AS (SELECT s.conv_id, place, place // {PART_TURNS} AS part, CASE WHEN k > 1 THEN a.name || '#' || k ELSE a.name END AS speaker, text
      FROM s JOIN a ON s.conv_id IS NOT DISTINCT FROM a.conv_id AND s.role IS NOT DISTINCT FROM a.role),
w AS (SELECT DISTINCT conv_id, speaker AS assistant FROM p WHERE speaker <> '{SYSTEM}'),
n AS (SELECT conv_id, max(part) + 1 AS n_parts FROM p GROUP BY conv_id),
r AS (SELECT p.conv_id, assistant, part, place, speaker = assistant AS own,
             CASE WHEN speaker = assistant THEN '{START}assistant' || chr(10) WHEN speaker = '{SYSTEM}' THEN '{START}system' || chr(10)
                  ELSE '{START}user name=' || speaker || chr(10) END AS h, p.text || '{END}' AS b
      FROM p JOIN w ON p.conv_id IS NOT DISTINCT FROM w.conv_id),
o AS (SELECT *, sum(length(h) + length(b) + 1) OVER (PARTITION BY conv_id, assistant, part ORDER BY place) - length(b) - 1 AS body FROM r),
g AS (SELECT conv_id, assistant, part, count(*) AS n_turns, string_agg(h || b || chr(10), '' ORDER BY place) AS text,
             coalesce(string_agg(CASE WHEN own THEN body::BIGINT || '-' || (body + length(b))::BIGINT END, ',' ORDER BY place), '') AS mask
      FROM o GROUP BY conv_id, assistant, part)
SELECT g.conv_id, assistant, part, n_parts, n_turns, text, mask FROM g JOIN n ON g.conv_id IS NOT DISTINCT FROM n.conv_id
"""


def mask_text(mask: Column) -> Column:
    """The spans as ``start-end,start-end``."""
    return F.array_join(F.transform(mask, lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
