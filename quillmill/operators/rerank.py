"""Reordering of candidates: off, by given scores, or by overlap and phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import distinct_tokens, join_holes, phrase


def _final(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("final_score", 9).desc(), "pos")
    return rows.filter(F.col("pos") <= k).withColumn("final_pos", F.row_number().over(order))


def off(candidates: DataFrame, k: int = 8) -> DataFrame:
    """The first ``k``; all scores are the retrieval score."""
    same = {c: F.col("score") for c in ("retrieval_score", "rerank_score", "final_score")}
    return _final(candidates.withColumns(same), k)


def remote(candidates: DataFrame, scores: DataFrame, k: int = 8) -> DataFrame:
    """With outside scores ``(query_id, idx, seq, score)`` by position from 0; missing ones count 0, of repeated ones the last."""
    last = scores.groupBy("query_id", "idx").agg(F.max_by("score", "seq").alias("rerank_score"))
    rows = candidates.withColumn("idx", F.col("pos") - 1).join(last, ["query_id", "idx"], "left")
    rows = rows.withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0))).withColumn("retrieval_score", F.col("score"))
    return _final(rows.withColumn("final_score", F.col("rerank_score") + 0.05 * F.col("score")), k)


def heuristic(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, k: int = 8) -> DataFrame:
    """0.4 retrieval score + 0.15 for each shared token + 1.5 for the phrase + 1 for it in the headings + 0.6 vector + 0.05 keyword score."""
    asked = queries.select("query_id", phrase("text").alias("_q"), distinct_tokens("text").alias("_qt"))
    # the texts join raw: only those of candidates are taken apart
    texts = chunks.select(F.col("id").alias("chunk_id"), F.col("searchable_text").alias("_text"), F.col("heading_path").alias("_path"))
    rows = candidates.filter(F.col("pos") <= k).join(texts, "chunk_id").join(asked, "query_id")
    rows = rows.withColumns(
        {"_t": phrase("_text"), "_h": phrase(join_holes("_path", " ")), "_tt": distinct_tokens("_text")}
    ).drop("_text", "_path")
    overlap = F.size(F.array_intersect("_qt", "_tt"))
    asked_any = F.col("_q") != ""
    score = (
        0.4 * F.col("score")
        + 0.15 * overlap
        + F.when(asked_any & F.col("_t").contains(F.col("_q")), 1.5).otherwise(0.0)
        + F.when(asked_any & F.col("_h").contains(F.col("_q")), 1.0).otherwise(0.0)
        + F.when(F.col("vector_score") > 0, 0.6 * F.col("vector_score")).otherwise(0.0)
        + F.when(F.col("keyword_score") > 0, 0.05 * F.col("keyword_score")).otherwise(0.0)
    )
    rows = rows.withColumns({"retrieval_score": F.col("score"), "rerank_score": score, "final_score": score}).drop("_q", "_qt", "_t", "_h", "_tt")
    return _final(rows, k)
