"""Batched retrieval: keyword, vector and fused search of ``(query_id, text)`` rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.config import RRF_K
from quillmill.functions.text import distinct_tokens, join_holes, phrase
from quillmill.functions.vectors import dot, unit

_BY = "query_id"


def ranked(hits: DataFrame, score: str, k: int, tie: str = "chunk_id") -> DataFrame:
    """The ``k`` best of each query, with their ``pos`` from 1; ties go to the smaller id.

    Scores that agree to nine decimals are ties, as sums differ behind these with the order of their parts.
    """
    order = Window.partitionBy(_BY).orderBy(F.round(score, 9).desc(), F.col(tie))
    return hits.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= k)


# Stated queries are counted; up to so many are broadcast.
MANY_QUERIES = 10_000


def _few(queries: DataFrame) -> bool:
    return queries.limit(MANY_QUERIES + 1).count() <= MANY_QUERIES


def keyword(queries: DataFrame, posts: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, chunk_id, score, n_matched, matched_tokens, pos``: TF-IDF with bonuses for the phrase, the headings and coverage.

    The queries' tokens meet the postings, so only theirs are aggregated. The phrase and heading bonuses are at most 5 together: a text is
    read only where the score without them comes within 5 of the query's ``k``-th best. Blank queries give no rows.
    """
    words = queries.select(_BY, F.explode(distinct_tokens("text")).alias("token"))
    wanted = words.select("token").distinct()
    small = _few(queries)
    mine = posts.join(F.broadcast(wanted) if small else wanted, "token", "left_semi")
    df = mine.groupBy("token").agg(F.count("*").alias("df"))
    n = chunks.agg(F.count("*").alias("n"))
    idf = F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1
    weights = words.join(df.crossJoin(F.broadcast(n)).select("token", idf.alias("idf")), "token")
    base = (
        mine.join(F.broadcast(weights) if small else weights, "token")
        .groupBy(_BY, "chunk_id")
        .agg(
            (F.sum(F.col("tf") * F.col("idf")) + 0.3 * F.count("*")).alias("base"), F.count("*").alias("n_matched"),
            F.sort_array(F.collect_set("token")).alias("matched_tokens"),
        )
    )
    best = ranked(base.select(_BY, "chunk_id", "base"), "base", k).groupBy(_BY).agg(F.min("base").alias("_least"), F.max("pos").alias("_n"))
    near = base.join(best, _BY).filter((F.col("_n") < k) | (F.col("base") >= F.col("_least") - 5.000001)).drop("_least", "_n")
    asked = queries.select(_BY, phrase("text").alias("_q"))
    texts = chunks.select(F.col("id").alias("chunk_id"), "searchable_text", "heading_path")
    scored = near.join(texts, "chunk_id").join(asked, _BY)
    score = (
        F.col("base")
        + F.when(phrase("searchable_text").contains(F.col("_q")), 3.0).otherwise(0.0)
        + F.when(phrase(join_holes("heading_path", " ")).contains(F.col("_q")), 2.0).otherwise(0.0)
    )
    return ranked(scored.select(_BY, "chunk_id", score.alias("score"), "n_matched", "matched_tokens"), "score", k)


def vector(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, chunk_id, score, pos``: exact cosine of ``(query_id, vector)`` against ``(chunk_id, vector)`` of length one.

    The queries, counted first, go to every partition of the vectors, and the best ``k`` of each partition meet. Queries without length give no rows,
    negative similarities stay; vectors of another size than a query's are compared over the shorter one.
    """
    asked = queries.select(_BY, unit(F.col("vector")).alias("_q")).filter(F.col("_q").isNotNull())
    pairs = vectors.join(F.broadcast(asked) if _few(asked) else asked)  # every stated query meets every vector
    scored = pairs.select(_BY, "chunk_id", dot(F.col("_q"), F.col("vector")).alias("score"))
    return ranked(scored, "score", k)


def fused(kw: DataFrame, vec: DataFrame, k: int = 12) -> DataFrame:
    """Reciprocal-rank fusion, a full outer join of the two ranked lists.

    ``query_id, chunk_id, score, keyword_score, vector_score, channels, pos``; the channels in the order keyword, vector.
    """

    def share(pos: Column) -> Column:
        return F.coalesce(1.0 / (RRF_K + pos), F.lit(0.0))

    a = kw.select(_BY, "chunk_id", F.col("score").alias("keyword_score"), F.col("pos").alias("_kp"))
    b = vec.select(_BY, "chunk_id", F.col("score").alias("vector_score"), F.col("pos").alias("_vp"))
    both = a.join(b, [_BY, "chunk_id"], "full_outer")
    channels = F.array_compact(F.array(F.when(F.col("_kp").isNotNull(), "keyword"), F.when(F.col("_vp").isNotNull(), "vector")))
    out = both.select(
        _BY, "chunk_id", (share(F.col("_kp")) + share(F.col("_vp"))).alias("score"), "keyword_score", "vector_score", channels.alias("channels")
    )
    return ranked(out, "score", k)


def as_candidates(hits: DataFrame, channel: str) -> DataFrame:
    """Keyword or vector hits in the shape of fused ones."""
    other = {"keyword": "vector", "vector": "keyword"}[channel]
    return hits.select(
        _BY, "chunk_id", "score", F.col("score").alias(f"{channel}_score"), F.lit(None).cast("double").alias(f"{other}_score"),
        F.array(F.lit(channel)).alias("channels"), "pos",
    )


def retrieve(mode: str, kw: DataFrame, vec: DataFrame, k: int = 12) -> DataFrame:
    """The candidates of a retrieval mode."""
    return fused(kw, vec, k) if mode == "hybrid" else as_candidates(kw if mode == "keyword" else vec, mode)
