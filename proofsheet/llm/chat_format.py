"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant,
the others as named users and system turns as they are. Masks mark what the assistant says.

A rendering comes in pieces of at most PIECE_TURNS turns, in order: chunks of as many turn numbers, and pieces of a chunk
whose numbers repeat or are null. So a conversation of any length is never gathered in one place; where a piece begins
comes from sums of lengths alone. Starts and spans count code points from the start of the whole rendering.

Defined cases: a null conversation is one like others; a null role is the speaker ``unknown``; a null text is empty; rows
equal in conversation, turn, role and text count once; several texts under one turn number are ordered by role and the
text's hash, null turns come first; a very long text is in one piece; a conversation of system turns only has no
participant and gives no row; an empty table gives no rows; only the four columns named are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import skew_join

PIECE_TURNS = 64
END = "<|end|>"
CONVERSATION = ["conv_key", "conv_none"]
PIECE = [*CONVERSATION, "perspective", "chunk", "piece"]


def rotate(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, perspective, chunk, piece, start, rendered, mask_spans, n_turns, n_assistant_turns."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("said")).distinct()
    chunk = F.coalesce(F.floor(F.col("turn") / PIECE_TURNS), F.lit(-1)).cast("long")
    t = t.withColumns({"conv_key": F.coalesce("conv_id", F.lit(0)), "conv_none": F.col("conv_id").isNull(), "hash": F.md5(F.col("said").cast("binary")), "chunk": chunk})
    number = F.row_number().over(Window.partitionBy(*CONVERSATION, "chunk").orderBy("turn", "speaker", "hash"))
    t = t.withColumn("piece", F.floor((number - 1) / PIECE_TURNS).cast("long"))
    # Each conversation's participants, met by its turns; those of a very long conversation stay where they are.
    people = t.groupBy(*CONVERSATION).agg(F.collect_set(F.when(F.col("speaker") != "system", F.col("speaker"))).alias("people"), F.count("*").alias("n"))
    both = skew_join(t, people, CONVERSATION, "n").withColumn("perspective", F.explode("people")).drop("people")
    own = F.col("speaker") == F.col("perspective")
    head = F.when(F.col("speaker") == "system", "<|system|>\n").when(own, "<|assistant|>\n").otherwise(F.concat(F.lit("<|user name="), "speaker", F.lit("|>\n")))
    both = both.withColumns({"head": head, "own": own})
    size = F.length("head") + F.length("said") + len(END) + 1
    before = Window.partitionBy(*CONVERSATION, "perspective").orderBy("chunk", "piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = both.groupBy(*PIECE).agg(F.sum(size).alias("size")).withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))

    row = F.struct("turn", "speaker", "hash", "said", "head", "own")
    pieces = both.groupBy(*PIECE).agg(F.array_sort(F.collect_list(row)).alias("rows")).join(starts.drop("size"), PIECE)
    body = lambda r: F.concat(r["head"], r["said"], F.lit(END + "\n"))
    pieces = pieces.withColumn("rendered", F.array_join(F.transform("rows", body), ""))
    state = F.struct(F.col("start").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(s, r):
        a = s["at"] + F.length(r["head"])
        b = a + F.length(r["said"]) + len(END)
        span = F.array(F.concat_ws(":", a.cast("string"), b.cast("string")))
        return F.struct((b + 1).cast("long").alias("at"), F.when(r["own"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    pieces = pieces.withColumn("spans", F.aggregate("rows", state, step, lambda s: s["spans"]))
    conversation = F.when(~F.col("conv_none"), F.col("conv_key")).alias("conv_id")
    return pieces.select(conversation, "perspective", "chunk", "piece", "start", "rendered", F.array_join("spans", ",").alias("mask_spans"), F.size("rows").cast("long").alias("n_turns"), F.size("spans").cast("long").alias("n_assistant_turns"))


def op8_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


_ORDER = "turn NULLS FIRST, speaker, md5(said)"
ORACLE = f"""
WITH d AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS said,
             CAST(coalesce(floor(turn / {PIECE_TURNS}.0), -1) AS BIGINT) AS chunk FROM conversations),
t AS (SELECT *, CAST((row_number() OVER (PARTITION BY conv_id, chunk ORDER BY {_ORDER}) - 1) // {PIECE_TURNS} AS BIGINT) AS piece FROM d),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (SELECT t.*, perspective, speaker = perspective AS own,
        CASE WHEN speaker = 'system' THEN '<|system|>' WHEN speaker = perspective THEN '<|assistant|>' ELSE '<|user name=' || speaker || '|>' END || chr(10) AS head
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, length(head) + length(said) + {len(END) + 1} AS n, sum(length(head) + length(said) + {len(END) + 1}) OVER
        (PARTITION BY conv_id, perspective ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS upto FROM r)
SELECT conv_id, perspective, chunk, piece, CAST(min(upto - n) AS BIGINT) AS start,
  string_agg(head || said || '{END}' || chr(10), '' ORDER BY {_ORDER}) AS rendered,
  coalesce(string_agg(CAST(CAST(upto - n + length(head) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(upto - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY {_ORDER}) FILTER (own), '') AS mask_spans,
  count(*) AS n_turns, count(*) FILTER (own) AS n_assistant_turns
FROM o GROUP BY conv_id, perspective, chunk, piece
"""
