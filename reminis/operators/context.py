"""Search results as text: context blocks, reports, and what is put before a prompt."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reminis.functions import formats as fm
from reminis.functions import text as tx
from reminis.sources.tables import timestamp

#: The tools that the hints name.
SEARCH_TOOL, STORE_TOOL = "memory_search", "memory_store"
CONTEXT_FACTS = 8


def label(session_label: str = "source_session_label", session_id: str = "source_session_id") -> Column:
    return F.coalesce(F.col(session_label), F.col(session_id))


def lines(found: DataFrame, as_of: datetime) -> DataFrame:
    """query_id, rank, line of search results."""
    age = fm.age_label(fm.age_in_days(F.col("created_at"), timestamp(as_of)))
    line = F.concat(fm.tier(F.col("final_score")), F.lit(" ["), label(), F.lit("] "), age, F.lit(': "'), F.col("content"), F.lit('"'))
    return found.select("query_id", "rank", line.alias("line"))


def in_order(found: DataFrame, value: str, by: str = "rank") -> DataFrame:
    """query_id and the values of its few results, an array in their order."""
    pairs = F.array_sort(F.collect_list(F.struct(by, value)))
    return found.groupBy("query_id").agg(F.transform(pairs, lambda x: x[value]).alias("values"))


def blocks(queries: DataFrame, found: DataFrame, as_of: datetime, tag: str = tx.TAG) -> DataFrame:
    """query_id, block: the context of each query; without results the hints alone."""
    # The headings and hints of the block.
    hints = "## Memory tools available\n- `{}` — {}\n- `{}` — store a new fact for future sessions"
    more = hints.format(SEARCH_TOOL, "search for specific subtopics not covered above", STORE_TOOL)
    none = hints.format(SEARCH_TOOL, "look up relevant context from memory", STORE_TOOL)
    own = in_order(lines(found, as_of), "line")
    full = F.concat(F.lit(f"[{tag}]\n\n## Remembered facts\n"), F.array_join("values", "\n"), F.lit("\n\n" + more))
    rows = queries.select("query_id").join(own, "query_id", "left")
    return rows.select("query_id", F.when(F.col("values").isNotNull(), full).otherwise(F.lit(f"[{tag}]\n{none}")).alias("block"))


def injections(context: DataFrame, tag: str = tx.TAG, orientation: str | None = None) -> DataFrame:
    """query_id, block as it is put before a prompt, after the orientation text where it is the first time."""
    wrapped = F.concat(F.lit(f"[{tag}]\n"), F.col("block"), F.lit(f"\n[/{tag}]"))
    if orientation:
        wrapped = F.when(F.col("block") == "", F.lit(orientation)).otherwise(F.concat(F.lit(orientation + "\n\n"), wrapped))
    return context.select("query_id", wrapped.alias("block"))


def reports(queries: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, report: the answer of the search tool."""
    tags = F.when(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0, F.concat(F.lit(" ["), F.array_join("tags", ", "), F.lit("]"))).otherwise("")
    entry = F.concat(
        F.lit("- ["), label(), F.lit("]"), tags, F.lit(" "), fm.iso(F.col("created_at")), F.lit(':\n  "'), F.substring("content", 1, 200), F.lit('"\n')
    )
    own = in_order(found.select("query_id", "rank", entry.alias("entry")), "entry")
    full = F.concat(F.lit("Search results from memory:\n\n"), F.array_join("values", "\n"))
    rows = queries.select("query_id").join(own, "query_id", "left")
    return rows.select("query_id", F.when(F.col("values").isNotNull(), full).otherwise("No relevant memory found for this query.").alias("report"))


def memory_context(found: DataFrame, keep: int = CONTEXT_FACTS) -> DataFrame:
    """The first results under the names of a context."""
    return found.where(F.col("rank") <= keep).select("query_id", "rank", "fact_id", label().alias("session_label"), "created_at", F.col("final_score").alias("score"))


def tool_results(found: DataFrame, as_of: datetime) -> DataFrame:
    age = fm.rounded_tenth(fm.age_in_days(F.col("created_at"), timestamp(as_of)))
    return found.select("query_id", "rank", "fact_id", F.col("final_score").alias("score"), age.alias("age_in_days"), label().alias("session_label"))


def last_user_messages(turns: DataFrame, tag: str = tx.TAG) -> DataFrame:
    """conv_id, turn, message: each conversation's last user message that is not empty without its blocks."""
    said = turns.where(F.col("role") == "user").select("conv_id", "turn", tx.strip_blocks(F.col("text"), tag).alias("message")).where("message != ''")
    last = F.max_by(F.struct("turn", "message"), F.struct("turn", "message")).alias("last")
    return said.groupBy("conv_id").agg(last).select("conv_id", "last.turn", "last.message")


def resolved_queries(prompts: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, query, source_step: the last user message, else what the prompt's envelope holds, else the prompt."""
    rows = prompts.join(last_user_messages(turns), "conv_id", "left")
    inner = tx.strip_envelope(F.col("prompt"))
    step = F.when(F.col("message").isNotNull(), "message").when(inner.isNotNull(), "envelope").otherwise("prompt")
    return rows.select("conv_id", F.coalesce("message", inner, "prompt").alias("query"), step.alias("source_step"))
