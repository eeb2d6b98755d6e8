"""Incremental maintenance: what changed, and the tables after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import content_hash, is_markdown, trim_ws


def changed_paths(events: DataFrame) -> DataFrame:
    """Distinct Markdown paths of events ``(kind, path, old_path)``; a rename touches both paths."""
    both = events.select(F.explode(F.array("old_path", "path")).alias("path")).select(trim_ws("path").alias("path"))
    return both.filter((F.col("path") != "") & is_markdown("path")).distinct()


def plan(paths: DataFrame, files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``path, action``: ``delete`` for files that are gone, ``skip`` for an unchanged hash, else ``index``.

    ``files`` are the present ``(path, content_hash)``, ``manifest`` the indexed ones.
    """
    now = files.select("path", F.col("content_hash").alias("_now"), F.lit(True).alias("_here"))
    was = manifest.select("path", F.col("content_hash").alias("_was"))
    rows = paths.join(now, "path", "left").join(was, "path", "left")
    action = F.when(F.col("_here").isNull(), "delete").when(F.col("_now") == F.col("_was"), "skip").otherwise("index")
    return rows.select("path", action.alias("action"))


def apply(old: DataFrame, new: DataFrame, actions: DataFrame, path: str = "file_path") -> DataFrame:
    """A table keyed by file after a plan: rows of deleted and re-indexed files go, new ones come."""
    gone = actions.filter(F.col("action").isin("delete", "index")).select(F.col("path").alias(path))
    coming = actions.filter("action = 'index'").select(F.col("path").alias(path))
    return old.join(gone, path, "left_anti").unionByName(new.join(coming, path, "left_semi"))


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id", order: str | None = None) -> DataFrame:
    """The last write wins: rows of ``new`` replace those of their key, and of several with one key that with the largest ``order`` counts."""
    if order is not None:
        last = F.max_by(F.struct(*new.columns), F.struct(F.col(order), F.struct(*(c for c in new.columns if c not in (key, order)))))
        new = new.groupBy(F.col(key).alias("_key")).agg(last.alias("_row")).select("_row.*")
    else:
        new = new.dropDuplicates([key])
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def vector_plan(chunks: DataFrame, vectors: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """``chunk_id, action``: ``embed`` for chunks without a vector or whose text changed since, ``remove`` for vectors without a chunk.

    ``chunks`` has ``id`` and ``searchable_text``; ``hashes`` is ``(chunk_id, content_hash)`` of what was embedded, where it's known. Ids compare without white
    space at their ends. Chunks that need nothing give no row.
    """
    have = chunks.groupBy(trim_ws("id").alias("chunk_id")).agg(F.max("searchable_text").alias("_text"))
    know = vectors.select(trim_ws("chunk_id").alias("chunk_id")).filter(F.col("chunk_id") != "").distinct().withColumn("_vector", F.lit(True))
    both = have.withColumn("_chunk", F.lit(True)).join(know, "chunk_id", "full_outer")
    if hashes is not None:
        both = both.join(hashes.select("chunk_id", F.col("content_hash").alias("_was")), "chunk_id", "left")
        stale = F.coalesce(F.col("_was") != content_hash("_text"), F.lit(True))
    else:
        stale = F.lit(False)
    action = F.when(F.col("_chunk").isNull(), "remove").when(F.col("_vector").isNull() | stale, "embed")
    return both.select("chunk_id", action.alias("action")).filter(F.col("action").isNotNull())


def sync_vectors(chunks: DataFrame, vectors: DataFrame, actions: DataFrame, embed) -> DataFrame:
    """``vectors`` after a :func:`vector_plan`; ``embed`` makes ``(chunk_id, vector)`` of chunks, and only of those to be embedded."""
    todo = actions.filter("action = 'embed'").select("chunk_id")
    new = embed(chunks.withColumn("id", trim_ws("id")).join(todo, F.col("id") == F.col("chunk_id"), "left_semi").dropDuplicates(["id"]))
    kept = vectors.withColumn("chunk_id", trim_ws("chunk_id")).join(actions.select("chunk_id"), "chunk_id", "left_anti")
    return kept.select("chunk_id", "vector").unionByName(new.select("chunk_id", "vector"))


def without(rows: DataFrame, removed: DataFrame, key: str = "chunk_id") -> DataFrame:
    return rows.join(removed.select(key), key, "left_anti")
