"""Multi-party chat formatting: every participant's view of a dialogue.

For each speaker the dialogue is rendered with that speaker as the assistant and all others as named users;
system turns stay system turns in every view and are no participant. A rendered dialogue is the concatenation
of its turns' segments, so the result has a row for each turn of each view, with the segment, its place in the
dialogue and the span of its content: ``loss`` is 1 where the view's speaker talks, which is what is trained on.

Rows do not gather by conversation, whose length has no bound, but by ``CHUNK`` turn numbers: places are running sums
within these, and over their totals. (Turns of one number, and those without a number, are one group.) The join that multiplies turns by participants can be
split where a conversation is hot. Only DataFrame functions are used.

Names are percent-encoded, so that no two speakers become one. A mark within a text gets a backslash after its ``<``,
and one more where it has some already: taking one off each gives the text back.

Defined cases: a null role is a speaker without a name (and a null perspective), apart from all named ones; a null text
is empty; turns are ordered by number (null
first), then role and text; repeated rows are turns of their own; a null conversation id is a conversation; a
conversation of system turns alone has no view; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table

CHUNK = 64
SYSTEM = "system"


def segments(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, speaker, role, segment, head (characters before the content), size."""
    turns = conversations.select(
        "conv_id", "turn", F.col("role").alias("speaker"),
        F.regexp_replace(F.coalesce("text", F.lit("")), r"<(\\*)\|", r"<$1\\|").alias("content"),
    )
    system = F.coalesce(F.col("speaker") == SYSTEM, F.lit(False))
    views = turns.where(~system).select(F.col("conv_id").alias("conv_"), F.col("speaker").alias("perspective")).distinct()
    role = F.when(system, SYSTEM).when(F.col("speaker").eqNullSafe(F.col("perspective")), "assistant").otherwise("user")
    encoded = F.replace(F.replace(F.replace(F.url_encode("speaker"), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    name = F.when((F.col("role") == "user") & F.col("speaker").isNotNull(), F.concat(F.lit(" name="), encoded)).otherwise("")
    head = F.concat(F.lit("<|"), "role", name, F.lit("|>\n"))
    return (
        turns.join(views, turns.conv_id.eqNullSafe(views.conv_))
        .withColumn("role", role)
        .withColumn("opening", head)
        .select(
            "conv_id", "perspective", "turn", "speaker", "role",
            F.concat("opening", "content", F.lit("\n<|end|>\n")).alias("segment"),
            F.length("opening").alias("head"),
            F.length("content").alias("size"),
        )
    )


def rotate(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, perspective, position, turn, speaker, role, segment, content_start, content_end, loss."""
    rows = segments(conversations).withColumn("chunk", F.coalesce(F.floor(F.col("turn") / chunk), F.lit(-(1 << 62))))
    within = Window.partitionBy("conv_id", "perspective", "chunk").orderBy("turn", "speaker", "segment").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "perspective", "chunk").agg(F.sum(F.length("segment")).alias("chars"), F.count(F.lit(1)).alias("n"))
    bases = totals.select(
        F.col("conv_id").alias("c_"), F.col("perspective").alias("p_"), F.col("chunk").alias("k_"),
        F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("chars_before"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"),
    )
    placed = rows.select(
        "*", F.coalesce(F.sum(F.length("segment")).over(within), F.lit(0)).alias("chars_within"), F.count(F.lit(1)).over(within).alias("n_within")
    )
    joined = placed.join(bases, placed.conv_id.eqNullSafe(bases.c_) & placed.perspective.eqNullSafe(bases.p_) & (placed.chunk == bases.k_))
    start = F.col("chars_before") + F.col("chars_within") + F.col("head")
    return joined.select(
        "conv_id", "perspective", (F.col("n_before") + F.col("n_within")).alias("position"), "turn", "speaker", "role", "segment",
        start.alias("content_start"), (start + F.col("size")).alias("content_end"), (F.col("role") == "assistant").cast("int").alias("loss"),
    )


def dialogues(rotated: DataFrame, turns: int = CHUNK) -> DataFrame:
    """conv_id, perspective, part, text, starts, ends: the rendered dialogues, in parts of at most ``turns`` turns (a
    dialogue has no bound), with the spans of each part that are trained on, counted from its begin."""
    part = F.floor(F.col("position") / turns).alias("part")
    row = F.struct("position", "segment", "content_start", "content_end", "loss")
    parts = rotated.groupBy("conv_id", "perspective", part).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    first = F.col("rows")[0]
    begin = first["content_start"] - F.locate("\n", first["segment"])  # a head ends with the first line break
    trained = F.filter("rows", lambda x: x.loss == 1)
    return parts.select(
        "conv_id", "perspective", "part", F.array_join(F.transform("rows", lambda x: x.segment), "").alias("text"),
        F.transform(trained, lambda x: x.content_start - begin).alias("starts"), F.transform(trained, lambda x: x.content_end - begin).alias("ends"),
    )


def op7_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(read_table(spark, sf_dir, "conversations"))


QUERIES = {"op7_perspectives": op7_perspectives}

ORACLE_SQL = {
    "op7_perspectives": r"""
WITH turns AS (
  SELECT conv_id, turn, role AS speaker, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\1\\|', 'g') AS content FROM conversations
), views AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker IS DISTINCT FROM 'system'),
roles AS (
  SELECT t.*, v.perspective,
         CASE WHEN speaker IS NOT DISTINCT FROM 'system' THEN 'system' WHEN speaker IS NOT DISTINCT FROM perspective THEN 'assistant' ELSE 'user' END AS role
  FROM turns t JOIN views v ON t.conv_id IS NOT DISTINCT FROM v.conv_id
), heads AS (
  SELECT *, '<|' || role || CASE WHEN role = 'user' AND speaker IS NOT NULL THEN ' name=' || url_encode(speaker) ELSE '' END || '|>' || chr(10) AS opening
  FROM roles
), segs AS (SELECT *, opening || content || chr(10) || '<|end|>' || chr(10) AS segment FROM heads),
placed AS (
  SELECT *, row_number() OVER w - 1 AS position,
         coalesce(sum(length(segment)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chars
  FROM segs WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker NULLS FIRST, segment)
)
SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, turn, speaker, role, segment,
       CAST(chars + length(opening) AS BIGINT) AS content_start,
       CAST(chars + length(opening) + length(content) AS BIGINT) AS content_end,
       CAST(role = 'assistant' AS INTEGER) AS loss
FROM placed
"""
}
