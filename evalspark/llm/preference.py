"""Operator 1 [native]: preference formatting of chosen and rejected conversations.

For each pair the longest common prefix of turns is rendered once, as the prompt; what follows
it is rendered for either side as a completion, in which only the assistant's words and end
marks carry loss.

The result has one row for each rendered turn (a segment) with its offsets in its part, so that
no conversation, however long, is one value or one task's work: parts are read by ordering
segments.  Offsets are prefix sums over blocks of turns, then within them.

Turn numbers give positions, the same for both sides.  Defined results: rows with a NULL pair
belong to no pair and are left out; a NULL turn number stands after all others; NULL roles and
texts are empty; rows that repeat a turn number are ordered by role and text, and the prompt
ends before the first turn number at which any row differs; a pair with one side only, or
without a common first turn, has no prompt; equal sides have empty completions; other columns
play no part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.llm.common import table

#: Turn numbers in one block of the prefix sums.
BLOCK_TURNS = 1024
LAST = (1 << 63) - 1


def _turns(rows: DataFrame) -> DataFrame:
    return rows.where("pair_id IS NOT NULL").select(
        "pair_id", F.coalesce("turn", F.lit(LAST)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))


def prompt_ends(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair_id, cut): the first turn number at which the sides differ; NULL if none does.  Sides
    are compared by counts and sums of 128-bit hashes of their rows, so no text is moved."""
    hashes = [F.xxhash64("role", "text"), F.xxhash64("text", F.lit(1), "role")]
    rows = None
    for sign, side in ((1, chosen), (-1, rejected)):
        part = side.select("pair_id", "turn", F.lit(sign).alias("n"), *[
            (F.lit(sign) * h.cast("decimal(20,0)")).cast("decimal(21,0)").alias(f"h{i}") for i, h in enumerate(hashes)])
        rows = part if rows is None else rows.unionByName(part)
    turns = rows.groupBy("pair_id", "turn").agg(*[F.sum(c).alias(c) for c in ("n", "h0", "h1")])
    differs = (F.col("n") != 0) | (F.col("h0") != 0) | (F.col("h1") != 0)
    return turns.groupBy("pair_id").agg(F.min(F.when(differs, F.col("turn"))).alias("cut"))


def preference_segments(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Segments of pairs given as two tables (pair_id, turn, role, text): pair_id, part (prompt,
    chosen or rejected), turn, rendered, start_char and end_char in the part, and loss_start
    (from where the segment carries loss; NULL: nowhere)."""
    chosen, rejected = _turns(chosen), _turns(rejected)
    cuts = prompt_ends(chosen, rejected)
    after = F.coalesce(F.col("turn") >= F.col("cut"), F.lit(False))
    ours = chosen.join(cuts, "pair_id").withColumn("part", F.when(after, "chosen").otherwise("prompt"))
    theirs = rejected.join(cuts, "pair_id").where(after).withColumn("part", F.lit("rejected"))
    head = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))
    rows = ours.unionByName(theirs).select(
        "pair_id", "part", "turn", "role", F.concat(head, "text", F.lit("<|end|>\n")).alias("rendered"),
        F.when((F.col("part") != "prompt") & (F.col("role") == "assistant"), F.length(head)).alias("head"),
        F.floor(F.col("turn") / BLOCK_TURNS).alias("block"))
    rows = rows.withColumn("size", F.length("rendered").cast("long"))
    before = Window.partitionBy("pair_id", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("pair_id", "part", "block").orderBy("turn", "role", "rendered").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("pair_id", "part", "block").agg(F.sum("size").alias("size"))
    blocks = blocks.select("pair_id", "part", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(blocks, ["pair_id", "part", "block"])
    start = F.col("base") + F.col("inner")
    return rows.select("pair_id", "part", "turn", "rendered", start.alias("start_char"),
                       (start + F.col("size")).alias("end_char"), (start + F.col("head")).alias("loss_start"))


def pairs_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference pairs from plain conversations: chosen is the conversation, rejected has the
    text of its last assistant turn replaced by that of its first (by nothing, if it has one)."""
    rows = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    ends = rows.where("role = 'assistant'").groupBy("pair_id").agg(
        F.max("turn").alias("last"), F.min("turn").alias("first"), F.min_by("text", F.struct("turn", "text")).alias("reply"))
    swap = (F.col("role") == "assistant") & (F.col("turn") == F.col("last"))
    reply = F.when(F.col("first") < F.col("last"), F.col("reply")).otherwise("")
    rejected = rows.join(ends, "pair_id", "left").withColumn("text", F.when(swap, reply).otherwise(F.col("text")))
    return rows, rejected.select("pair_id", "turn", "role", "text")


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_segments(*pairs_of(table(spark, sf_dir, "conversations")))


QUERIES = {"op1_preference_format": op1_preference_format}
ORACLE = {"op1_preference_format": f"""
    WITH ends AS (SELECT conv_id, max(turn) AS l, min(turn) AS f FROM conversations WHERE role = 'assistant' GROUP BY 1),
         firsts AS (SELECT c.conv_id, min(c.text) AS reply FROM conversations c JOIN ends e
                    ON c.conv_id = e.conv_id AND c.turn = e.f AND c.role = 'assistant' GROUP BY 1),
         chosen AS (SELECT conv_id AS pair_id, coalesce(turn, {LAST}) AS turn, coalesce(role, '') AS role,
                           coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
         rejected AS (SELECT c.conv_id AS pair_id, coalesce(c.turn, {LAST}) AS turn, coalesce(role, '') AS role,
                             coalesce(CASE WHEN role = 'assistant' AND c.turn = e.l
                                      THEN CASE WHEN e.f < e.l THEN reply ELSE '' END ELSE text END, '') AS text
                      FROM conversations c LEFT JOIN ends e USING (conv_id) LEFT JOIN firsts USING (conv_id)
                      WHERE conv_id IS NOT NULL),
         a AS (SELECT *, row_number() OVER (PARTITION BY pair_id, turn ORDER BY role, text) AS k FROM chosen),
         b AS (SELECT *, row_number() OVER (PARTITION BY pair_id, turn ORDER BY role, text) AS k FROM rejected),
         cuts AS (SELECT pair_id, min(CASE WHEN a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text
                                      THEN turn END) AS cut
                  FROM a FULL JOIN b USING (pair_id, turn, k) GROUP BY 1),
         parts AS (SELECT a.*, CASE WHEN turn >= cut THEN 'chosen' ELSE 'prompt' END AS part FROM a JOIN cuts USING (pair_id)
                   UNION ALL SELECT b.*, 'rejected' FROM b JOIN cuts USING (pair_id) WHERE turn >= cut),
         shown AS (SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered FROM parts),
         placed AS (SELECT *, CAST(sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY turn, role, rendered
                                ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_char
                    FROM shown)
    SELECT pair_id, part, turn, rendered, end_char - length(rendered) AS start_char, end_char,
           CASE WHEN part <> 'prompt' AND role = 'assistant' THEN end_char - length(rendered) + length(role) + 5 END AS loss_start
    FROM placed"""}
