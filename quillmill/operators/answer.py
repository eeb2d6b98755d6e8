"""Cited sources, the context block, the prompt and the answer without a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import excerpt, join_holes


def only(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """The chunks that are hit; the hits, a few of each stated question, are what travels."""
    return chunks.join(hits.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_semi")


def _with_chunks(reranked: DataFrame, chunks: DataFrame) -> DataFrame:
    cols = (F.col("id").alias("chunk_id"), "file_path", "heading_path", "primary_heading", "text")
    return reranked.join(chunks.select(*cols), "chunk_id")


def sources(reranked: DataFrame, chunks: DataFrame, limit: int = 5) -> DataFrame:
    """``query_id, n, file_path, heading, display_link, excerpt``: the first of each file and heading, in order.

    A null heading and an empty one are two; both link to the file.
    """
    rows = _with_chunks(reranked, chunks)
    has = F.coalesce(F.col("primary_heading") != "", F.lit(False))
    link = F.when(has, F.format_string("[[%s#%s]]", "file_path", "primary_heading")).otherwise(F.format_string("[[%s]]", "file_path"))
    key = Window.partitionBy("query_id", "file_path", "primary_heading").orderBy("final_pos")
    firsts = rows.withColumn("_rn", F.row_number().over(key)).filter("_rn = 1")
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("final_pos"))
    return (
        firsts.select("query_id", n.alias("n"), "file_path", F.col("primary_heading").alias("heading"), link.alias("display_link"), excerpt("text", 180).alias("excerpt"))
        .filter(F.col("n") <= limit)
    )


def _joined(rows: DataFrame, line, sep: str, name: str) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct(F.col("n"), line.alias("line"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), sep).alias(name))


def context(reranked: DataFrame, chunks: DataFrame, k: int = 8) -> DataFrame:
    """``query_id, context``: numbered, with file, headings, channels and text."""
    rows = _with_chunks(reranked, chunks).filter(F.col("final_pos") <= k).withColumn("n", F.col("final_pos"))
    path = F.when(F.size("heading_path") > 0, join_holes("heading_path", " > ")).otherwise("(no heading)")
    line = F.concat_ws(
        "\n", F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.col("file_path")), F.concat(F.lit("Heading: "), path),
        F.concat(F.lit("Found by: "), F.array_join("channels", " + ")), F.lit("```"), F.col("text"), F.lit("```"),
    )
    return _joined(rows, line, "\n\n", "context")


def prompt(queries: DataFrame, context_rows: DataFrame, scope: str = "the whole vault") -> DataFrame:
    """``query_id, system, user``: the two messages for a chat model; queries without context get none.

    ``queries`` is ``(query_id, text)``; where it has them, ``asked`` (the question before it was rewritten), ``conversation`` and ``memory`` of
    each query go in, too.
    """
    system = "You answer questions about a collection of notes. Use only the context, cite the numbers of what you use, and say so if it does not suffice."
    has = queries.columns
    part = {c: F.coalesce(F.col(c), F.lit("")) if c in has else F.lit("") for c in ("conversation", "memory")}
    asked = F.col("asked") if "asked" in has else F.col("text")
    user = F.concat_ws(
        "\n", F.lit(f"Scope: {scope}"), F.lit("Conversation:"), part["conversation"], F.lit("Memory:"), part["memory"],
        F.concat(F.lit("Question: "), asked), F.when(asked != F.col("text"), F.concat(F.lit("Searched for: "), F.col("text"))), F.lit("Context:"), F.col("context"),
    )
    return queries.join(context_rows, "query_id").select("query_id", F.lit(system).alias("system"), user.alias("user"))


def fallback(queries: DataFrame, reranked: DataFrame, chunks: DataFrame, mode: str) -> DataFrame:
    """``query_id, answer``: the question, what was searched for, and an excerpt of every candidate, or a sentence that nothing was found."""
    rows = _with_chunks(reranked, chunks).withColumn("n", F.col("final_pos"))
    heading = F.when(F.col("primary_heading") != "", F.concat(F.lit(" # "), F.col("primary_heading"))).otherwise(F.lit(""))
    line = F.concat(F.col("n").cast("string"), F.lit(". "), F.col("file_path"), heading, F.lit(": "), excerpt(F.coalesce("text", F.lit("")), 220))
    found = _joined(rows, line, "\n", "_found")
    asked = F.col("asked") if "asked" in queries.columns else F.col("text")
    head = F.concat_ws(
        "\n", F.concat(F.lit("Question: "), asked), F.when(asked != F.col("text"), F.concat(F.lit("Searched for: "), F.col("text"))),
        F.when(F.col("_found").isNotNull(), F.lit(f"Most relevant passages ({mode}):")), F.coalesce("_found", F.lit("Nothing relevant was found.")),
    )
    return queries.join(found, "query_id", "left").select("query_id", head.alias("answer"))


def rerank_document(chunks: DataFrame) -> DataFrame:
    """``chunk_id, document``: what an outside reranker reads of a chunk."""
    return chunks.select(F.col("id").alias("chunk_id"), F.concat_ws("\n", "file_path", join_holes("heading_path", " > "), "text").alias("document"))
