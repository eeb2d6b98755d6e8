"""The inverted index, its statistics and the file manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import tokens


def postings(chunks: DataFrame, text: str = "searchable_text") -> DataFrame:
    """``token, chunk_id, tf``: flat, folded map-side."""
    words = chunks.select(F.col("id").alias("chunk_id"), F.explode(tokens(text)).alias("token"))
    return words.groupBy("token", "chunk_id").agg(F.count("*").alias("tf"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("token").agg(F.count("*").alias("df"))


def kb_stats(notes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Numbers of target files (empty ones too) and chunks."""
    return notes.agg(F.count("*").alias("file_count")).crossJoin(chunks.agg(F.count("*").alias("chunk_count")))


def vector_stats(vectors: DataFrame) -> DataFrame:
    return vectors.agg(
        F.count("*").alias("vector_count"), F.max(F.size("vector")).alias("dimension"), (F.count("*") > 0).alias("ready")
    )


def manifest(chunks: DataFrame) -> DataFrame:
    """``file_path, chunk_ids``: each file's chunk ids by serial."""
    ids = F.sort_array(F.collect_list(F.struct("serial", "id")))
    return chunks.groupBy("file_path").agg(F.transform(ids, lambda x: x["id"]).alias("chunk_ids"))


def canonical(chunks: DataFrame) -> DataFrame:
    """Chunks in their canonical order: by path, then serial, then id."""
    return chunks.orderBy("file_path", "serial", "id")
