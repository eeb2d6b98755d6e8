"""Long-term memory: search, upsert and eviction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import collapse_ws, distinct_tokens, memory_id, phrase

MONTH_MS = 30 * 86_400_000


def search(memories: DataFrame, queries: DataFrame, now_ms: int, k: int = 4) -> DataFrame:
    """``query_id, id, score, pos``: 3 for the phrase, 0.6 for each shared token, up to 1 for recency; without either no hit."""
    m = memories.select("id", F.col("updated_at"), phrase("text").alias("_t"), distinct_tokens("text").alias("_tt"))
    q = queries.select("query_id", phrase("text").alias("_q"), distinct_tokens("text").alias("_qt")).filter(F.size("_qt") > 0)
    rows = m.crossJoin(q)  # stated queries against the memories of one log, which eviction bounds
    overlap = F.size(F.array_intersect("_qt", "_tt"))
    hit = (F.col("_q") != "") & F.col("_t").contains(F.col("_q"))
    recent = F.greatest(F.lit(0.0), (F.col("updated_at") - F.lit(now_ms - MONTH_MS)) / F.lit(float(MONTH_MS)))
    scored = rows.filter(hit | (overlap > 0)).select(
        "query_id", "id", (F.when(hit, 3.0).otherwise(0.0) + 0.6 * overlap + recent).alias("score")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= k)


def upsert(memories: DataFrame, statements: DataFrame, now_ms: int) -> DataFrame:
    """``id, text, created_at, updated_at, last_accessed_at`` after statements ``(pos, text)``.

    A statement with a memory's normalised text replaces its text and times; others are new. Of equal statements of a
    batch the last text counts. Blank statements are skipped.
    """
    new = (
        statements.select("pos", "text", phrase("text").alias("norm"))
        .filter(F.col("norm") != "")
        .groupBy("norm")
        .agg(F.max_by("text", "pos").alias("new_text"))
    )
    old = memories.withColumn("norm", phrase("text"))
    both = old.join(new, "norm", "full_outer")
    now = F.lit(now_ms).cast("bigint")
    touched = F.col("new_text").isNotNull()
    return both.select(
        F.coalesce("id", memory_id("new_text")).alias("id"),
        F.coalesce("new_text", "text").alias("text"),
        F.coalesce("created_at", now).alias("created_at"),
        F.when(touched, now).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(touched, now).otherwise(F.col("last_accessed_at")).alias("last_accessed_at"),
    )


def evict(memories: DataFrame, most: int = 150) -> DataFrame:
    """The ``most`` memories that were updated or read last."""
    return memories.orderBy(F.greatest("updated_at", "last_accessed_at").desc(), "id").limit(most)


def touch(memories: DataFrame, hits: DataFrame, now_ms: int) -> DataFrame:
    """Memories with the time of access of those that were hit."""
    named = hits.select("id").distinct().withColumn("_hit", F.lit(True))
    at = F.when(F.col("_hit"), F.lit(now_ms).cast("bigint")).otherwise(F.col("last_accessed_at"))
    return memories.join(named, "id", "left").withColumn("last_accessed_at", at).drop("_hit")


def context(hits: DataFrame, memories: DataFrame) -> DataFrame:
    """``query_id, memory``: the texts of the memories that were hit, a line each, the best first."""
    rows = hits.select("query_id", "id", "pos").join(memories.select("id", "text"), "id")
    ordered = F.sort_array(F.collect_list(F.struct("pos", F.concat(F.lit("- "), collapse_ws(F.coalesce("text", F.lit("")))).alias("line"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("memory"))
