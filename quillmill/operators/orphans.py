"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import trim_ws


def month_of(ts: Column) -> Column:
    """``yyyy-MM`` of a timestamp, ``unknown`` for null."""
    return F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit("unknown"))


def millis_to_ntz(ms: Column) -> Column:
    """Epoch milliseconds as a timestamp without zone (UTC), whatever the session's zone."""
    day = F.floor(ms / F.lit(86_400_000)).cast("int")
    rest = (ms - day.cast("bigint") * F.lit(86_400_000)).cast("decimal(18,6)") / F.lit(1000).cast("decimal(5,0)")
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(
        day, F.lit(0), F.lit(0), rest.cast("decimal(18,6)")
    )


def orphan_references(
    children: dict[str, DataFrame],
    parents: DataFrame,
    tombstones: DataFrame,
) -> DataFrame:
    """Orphan references of all child tables, one row per table, period and key.

    ``children``: for each table name a frame ``(key, at)``; ``parents``:
    ``(key, loaded_at)``; ``tombstones``: ``(key, removed_at)``. Keys compare
    without white space at their ends. Result: ``ref_table, period, key, kind,
    n_refs``, where ``kind`` is the first that applies of ``deleted`` (removed,
    and not loaded after the last removal), ``missing`` (no parent row) and
    ``late`` (a reference of the period is earlier than the first load). ``n_refs`` counts
    the key's references in that table and period.

    Parents, tombstones and references lie in one long table, grouped first by
    key, tag and period: a key that holds a third of all rows is folded map-side
    to a handful. The second grouping, by key, sees at most one row for each table and
    period of the key. Null and blank keys are no references; a null time has
    the period ``unknown`` and is never late; a removal without time counts as
    after every load. Empty tables give no rows of their kind.
    """
    null_ts = F.lit(None).cast("timestamp_ntz")

    def tagged(df: DataFrame, tag: str, ref=None, period=None, first=None, last=None, gone=None, n=0) -> DataFrame:
        return df.select(
            trim_ws("key").alias("key"),
            F.lit(tag).alias("tag"),
            (period if period is not None else F.lit("")).alias("period"),
            (null_ts if ref is None else ref).alias("ref_at"),
            (null_ts if first is None else first).alias("loaded_first"),
            (null_ts if last is None else last).alias("loaded_last"),
            (null_ts if gone is None else gone).alias("removed"),
            F.lit(n).cast("bigint").alias("n"),
            F.lit(tag == "").alias("is_parent"),
            F.lit(tag == "-").alias("is_removal"),
            (gone.isNull() if gone is not None else F.lit(False)).alias("removed_undated"),
        )

    at = F.col("at").cast("timestamp_ntz")
    loaded, removed = F.col("loaded_at").cast("timestamp_ntz"), F.col("removed_at").cast("timestamp_ntz")
    long = tagged(parents, "", first=loaded, last=loaded).unionByName(tagged(tombstones, "-", gone=removed))
    for table, df in children.items():
        long = long.unionByName(tagged(df, table, ref=at, period=month_of(at), n=1))

    folded = (
        long.filter(F.col("key") != "")
        .groupBy("key", "tag", "period")
        .agg(
            F.min("ref_at").alias("ref_at"),
            F.min("loaded_first").alias("loaded_first"),
            F.max("loaded_last").alias("loaded_last"),
            F.max("removed").alias("removed"),
            F.sum("n").alias("n"),
            F.max("is_parent").alias("is_parent"),
            F.max("is_removal").alias("is_removal"),
            F.max("removed_undated").alias("removed_undated"),
        )
    )
    of_key = Window.partitionBy("key")
    facts = folded.select(
        "key",
        "tag",
        "period",
        "ref_at",
        "n",
        F.max("is_parent").over(of_key).alias("has_parent"),
        F.max("is_removal").over(of_key).alias("has_removal"),
        F.max("removed_undated").over(of_key).alias("undated"),
        F.min("loaded_first").over(of_key).alias("first"),
        F.max("loaded_last").over(of_key).alias("last"),
        F.max("removed").over(of_key).alias("gone"),
    ).filter(~F.col("tag").isin("", "-"))
    back = F.coalesce(F.col("last") > F.col("gone"), F.lit(False)) & ~F.col("undated")
    kind = (
        F.when(F.col("has_removal") & ~back, "deleted")
        .when(~F.col("has_parent"), "missing")
        .when((F.col("period") != "unknown") & (F.col("ref_at") < F.col("first")), "late")
    )
    return facts.select(
        F.col("tag").alias("ref_table"), "period", "key", kind.alias("kind"), F.col("n").alias("n_refs")
    ).filter(F.col("kind").isNotNull())


def vault_orphans(
    chunks: DataFrame, file_records: DataFrame, chunk_vectors: DataFrame, sync_results: DataFrame
) -> DataFrame:
    """:func:`orphan_references` over the tables of a note vault."""
    return orphan_references(
        {
            "file_records": file_records.select(
                F.explode("chunk_ids").alias("key"), millis_to_ntz(F.col("indexed_at").cast("bigint")).alias("at")
            ),
            "chunk_vectors": chunk_vectors.select(F.col("chunk_id").alias("key"), F.col("embedded_at").alias("at")),
        },
        chunks.select(F.col("id").alias("key"), "loaded_at"),
        sync_results.select(F.explode("removed_chunk_ids").alias("key"), F.col("synced_at").alias("removed_at")),
    ).withColumnRenamed("key", "chunk_id")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts of orphan keys and references per table, period and kind."""
    return orphans.groupBy("ref_table", "period", "kind").agg(
        F.count("*").alias("n_keys"), F.sum("n_refs").alias("n_refs")
    )
