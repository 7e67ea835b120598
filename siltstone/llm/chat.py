"""Multi-party dialogues rendered from every participant's perspective, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm._blocks import quoted, written
from siltstone.operators.places import placed

#: Turns that one rendered part holds at most; longer dialogues go on in further parts.
PART_TURNS = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: The role that is nobody's perspective, and how own and other turns are headed.
SYSTEM, ASSISTANT, NAMED = "system", "assistant", "user name="
#: Turns of a block that one task sorts at most, and the block of turns without a number.
MOST_IN_BLOCK, UNNUMBERED = 64 * PART_TURNS, -(1 << 60)


def harmless(text: Column) -> Column:
    """A text whose own markers can't open or close a message."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("< |im_"))


def speaker(role: Column) -> Column:
    """The name of a speaker, on one line; ``unknown`` for null."""
    return F.regexp_replace(harmless(F.coalesce(role, F.lit("unknown"))), "[\\x00-\\x1F]+", " ")


def numbered(turns: DataFrame) -> DataFrame:
    """The turns (conv, block, turn, who, body) with ``at``, their place from 1 within their block.

    Blocks hold PART_TURNS turn numbers. Those of very many turns, where numbers repeat or
    are missing, are cut into ranges; all others are sorted each in one task.
    """
    order = ("turn", "who", "body")
    sizes = turns.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("_n"))
    large = written(sizes.filter(F.col("_n") > MOST_IN_BLOCK).select(F.col("conv").alias("_c"), F.col("block").alias("_b")))
    at = F.row_number().over(Window.partitionBy("conv", "block").orderBy(*order)).cast("long")
    if large.isEmpty():
        return turns.withColumn("at", at)
    of_large = F.col("conv").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))
    key = F.concat(F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")), F.lit("/"), F.col("block").cast("string"))
    cut = placed(turns.join(large, of_large, "left_semi").withColumn("_tree", key), "_tree", order, "_n").withColumn("at", F.col("at") + 1)
    return turns.join(large, of_large, "left_anti").withColumn("at", at).unionByName(cut.drop("_tree", "_n"))


def rotate_perspectives(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every dialogue once for each participant, with that speaker as assistant.

    Returns rows (conv_col, perspective, part, start_char, n_turns, rendered,
    target_spans array<struct<start, end>>). Turns go by turn number, then speaker and
    text; the perspective's turns become ``assistant`` messages, ``system`` turns stay,
    all others become ``user`` messages with the speaker's name. ``target_spans`` are
    the characters, within ``rendered``, that training on this perspective learns: the
    texts of its own turns with the mark that ends them. The parts of a dialogue joined
    in order are its whole text, ``start_char`` being a part's place in it; a dialogue
    has a part for each PART_TURNS turn numbers, and more only where numbers repeat.

    Texts are put into parts in one shuffle by part, and rendered there: no task has to
    hold more of a dialogue than parts. A part's number and start follow from lengths
    alone, which are added up by perspective.

    Null texts are empty, null speakers are ``unknown``; rows with no conversation are
    one dialogue, rows without turn number come first. Repeated rows are repeated turns.
    A dialogue of system turns alone has no participant and so no row; an empty table
    has none. Other columns are ignored, whatever their names.
    """
    turns = df.select(F.col(quoted(conv_col)).alias("conv"), F.col(quoted(turn_col)).cast("long").alias("turn"), speaker(F.col(quoted(role_col))).alias("who"), harmless(F.col(quoted(text_col))).alias("body"))
    turns = numbered(turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / PART_TURNS), F.lit(UNNUMBERED))))
    turns = turns.withColumn("piece", F.floor((F.col("at") - 1) / PART_TURNS))
    parts = turns.groupBy("conv", "block", "piece").agg(F.sort_array(F.collect_list(F.struct("at", "who", "body"))).alias("said"))
    starts = part_starts(parts)
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")) & (F.col("piece") == F.col("p"))
    both = parts.join(starts, same)

    def head(s: Column) -> Column:
        own = F.when(s["who"] == F.col("perspective"), F.lit(ASSISTANT)).when(s["who"] == SYSTEM, F.lit(SYSTEM))
        return F.concat(F.lit(OPEN), F.coalesce(own, F.concat(F.lit(NAMED), s["who"])), F.lit("\n"))

    both = both.withColumn("said", F.transform("said", lambda s: F.struct(head(s).alias("head"), F.concat(s["body"], F.lit(CLOSE)).alias("body"), (s["who"] == F.col("perspective")).alias("own"))))
    both = both.withColumn("rendered", F.array_join(F.transform("said", lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), ""))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + F.length(s["head"])
        end = begin + F.length(s["body"])
        span = F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct((end + 1).cast("long").alias("at"), F.when(s["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("said", start, step)["spans"]
    return both.select(F.col("conv").alias(conv_col), "perspective", "part", "start_char", F.size("said").alias("n_turns"), "rendered", spans.alias("target_spans"))


def part_starts(parts: DataFrame) -> DataFrame:
    """(c, b, p, perspective, part, start_char) of each part (conv, block, piece) from each perspective, out of lengths.

    A part is as long as with all speakers named, and shorter for a speaker by the turns
    that become the assistant's.
    """
    named = len(OPEN) + len(NAMED) + 1 + len(CLOSE) + 1
    full = F.aggregate("said", F.lit(0).cast("long"), lambda n, s: n + F.length(s["body"]) + F.length(s["who"]) + named - F.when(s["who"] == SYSTEM, len(NAMED)).otherwise(0))
    speakers = F.transform("said", lambda s: F.struct(s["who"].alias("who")))
    sizes = parts.select("conv", "block", "piece", full.alias("full"), speakers.alias("said"))
    each = sizes.select("conv", "block", "piece", F.explode("said.who").alias("who")).filter(F.col("who") != SYSTEM)
    own = each.groupBy("conv", "block", "piece", "who").agg(F.sum(F.length("who") + len(NAMED) - len(ASSISTANT)).alias("less"))
    people = own.select(F.col("conv").alias("c"), F.col("who").alias("perspective")).distinct()
    rows = sizes.select("conv", "block", "piece", "full").join(people, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    own = own.select(F.col("conv").alias("c"), F.col("block").alias("b"), F.col("piece").alias("p"), F.col("who").alias("w"), "less")
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")) & (F.col("piece") == F.col("p")) & (F.col("perspective") == F.col("w"))
    rows = rows.join(own, same, "left").select("conv", "block", "piece", "perspective", (F.col("full") - F.coalesce("less", F.lit(0))).alias("n"))
    order = Window.partitionBy("conv", "perspective").orderBy("block", "piece")
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("part", F.row_number().over(order) - 1).withColumn("start_char", F.coalesce(before, F.lit(0)))
    return rows.select(F.col("conv").alias("c"), F.col("block").alias("b"), F.col("piece").alias("p"), "perspective", "part", "start_char")


def op2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations from all perspectives, with masks as text."""
    out = rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    masks = F.array_join(F.transform("target_spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    learnt = F.aggregate("target_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("conv_id", "perspective", "part", "start_char", "n_turns", "rendered", masks.alias("target_mask"), learnt.alias("n_target_chars"))


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, regexp_replace(replace(coalesce(role, 'unknown'), '<|im_', '< |im_'), '[\x00-\x1F]+', ' ', 'g') AS who, replace(coalesce(text, ''), '<|im_', '< |im_') AS body, floor(turn / 256) AS block FROM conversations
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, block ORDER BY turn NULLS FIRST, who, body) AS nth FROM t
), p AS (SELECT DISTINCT conv_id AS c, who AS perspective FROM t WHERE who <> 'system'
), m AS (
  SELECT conv_id, block, floor((nth - 1) / 256) AS piece, nth, perspective, who = perspective AS own,
    '<|im_start|>' || CASE WHEN who = perspective THEN 'assistant' WHEN who = 'system' THEN 'system' ELSE 'user name=' || who END || chr(10) AS head, body || '<|im_end|>' AS body
  FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.c
), o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, block, piece ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS s FROM m
), g AS (
  SELECT conv_id, perspective, block, piece, count(*)::INT AS n_turns, string_agg(head || body || chr(10), '' ORDER BY nth) AS rendered,
    coalesce(string_agg(s::BIGINT || '-' || (s + length(body))::BIGINT, ',' ORDER BY nth) FILTER (own), '') AS target_mask, coalesce(sum(length(body)) FILTER (own), 0)::BIGINT AS n_target_chars
  FROM o GROUP BY ALL
)
SELECT conv_id, perspective, (row_number() OVER w - 1)::INT AS part, coalesce(sum(length(rendered)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_char, n_turns, rendered, target_mask, n_target_chars
FROM g WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY block NULLS FIRST, piece)
"""
