"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import trim_ws
from quillmill.llm.bpe import TOKENIZER_DIR, count_tokens
from quillmill.runtime import stage

# Up to so many targets, counted first, are broadcast to the records.
BROADCAST_TARGETS = 100_000
# Each refinement splits the boundary bucket by so many further bits of the hash.
BITS, LEVELS = 12, 3


def source_name(col) -> F.Column:
    return F.lower(trim_ws(col))


def sized_documents(docs: DataFrame, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """``doc_id, source, n_tokens, spot``: each record's size and its place, a hash of 36 bits.

    The texts are encoded once; the narrow result is staged, since the mix reads it several times.
    """
    counted = count_tokens(docs.select("doc_id", "source", "text"), ["doc_id", "source"], tokenizer_dir=tokenizer_dir)
    spot = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - BITS * LEVELS)
    return stage(
        counted.select("doc_id", source_name(F.coalesce("source", F.lit(""))).alias("source"), "n_tokens", spot.alias("spot")),
        "mix",
    )


def budgets(sized: DataFrame, targets: DataFrame, mix_tokens: int | None = None) -> DataFrame:
    """One row for each source of the targets: what it has, what it must give, and how often it's repeated.

    ``source, target_share, max_repeats, available, n_docs, budget, whole, rest``: ``whole`` repeats of every record, and ``rest``
    tokens from one more of some. The mix is the largest in which every source at hand can reach
    its share with its repeats, or ``mix_tokens``, where a source that can't reach its share gives all it may.
    Sources that are missing, or hold no token, give nothing; the shares of the others are scaled up. Targets
    of one name add up; null shares and repeats count as 0.
    """
    want = (
        targets.groupBy(source_name("source").alias("source"))
        .agg(
            F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"),
            F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"),
        )
        .filter(F.col("source").isNotNull())
    )
    have = sized.groupBy("source").agg(
        F.sum("n_tokens").cast("double").alias("available"), F.count("*").alias("n_docs")
    )
    rows = want.join(have, "source", "left").fillna({"available": 0.0, "n_docs": 0})
    usable = (F.col("available") > 0) & (F.col("max_repeats") > 0) & (F.col("target_share") > 0)
    all_rows = Window.partitionBy(F.lit(0))  # as many rows as targets
    rows = rows.withColumn("share", F.when(usable, F.col("target_share")).otherwise(0.0))
    rows = rows.withColumn("share", F.try_divide("share", F.sum("share").over(all_rows)))
    most = F.col("available") * F.col("max_repeats")
    total = F.lit(float(mix_tokens)) if mix_tokens is not None else F.min(F.when(usable, most / F.col("share"))).over(all_rows)
    rows = rows.withColumn("budget", F.when(usable, F.least(F.col("share") * total, most)).otherwise(0.0))
    whole = F.when(usable, F.least(F.floor(F.col("budget") / F.col("available") + 1e-9), F.col("max_repeats")))
    rows = rows.withColumn("whole", F.coalesce(whole, F.lit(0)).cast("int"))
    rest = F.greatest(F.col("budget") - F.col("whole") * F.col("available"), F.lit(0.0))
    return rows.withColumn("rest", F.when(F.col("whole") < F.col("max_repeats"), rest).otherwise(0.0)).drop("share")


def _plan(sized: DataFrame, targets: DataFrame, mix_tokens: int | None) -> DataFrame:
    """The budgets, staged, as they are read several times; a row a target, broadcast if these are as few as they are meant to be."""
    plan = stage(budgets(sized, targets, mix_tokens), "plan")
    return F.broadcast(plan) if plan.limit(BROADCAST_TARGETS + 1).count() <= BROADCAST_TARGETS else plan


def thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``source, cut``: records of a source with ``spot < cut`` add up to about its ``rest``.

    A histogram of tokens by source and hash bucket finds the bucket in which the rest runs out; only that bucket is
    split further, by the next bits of the hash. The records of the last boundary bucket are taken if at least half of them fits.
    """
    at = plan.filter(F.col("rest") > 0).select("source", "rest", F.lit(0).cast("bigint").alias("prefix"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        bucket = F.shiftright("spot", shift)
        inside = sized.join(at, "source").filter(F.shiftright(bucket, BITS) == F.col("prefix"))
        hist = inside.groupBy("source", "rest", bucket.alias("prefix")).agg(F.sum("n_tokens").alias("n"))
        so_far = F.sum("n").over(Window.partitionBy("source").orderBy("prefix"))
        hist = hist.withColumn("upto", so_far).withColumn("before", F.col("upto") - F.col("n"))
        at = hist.filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("upto"))).select(
            "source", (F.col("rest") - F.col("before")).alias("rest"), "prefix", "n"
        )
        at = stage(at.drop("n") if level < LEVELS - 1 else at, "boundary")
        if level < LEVELS - 1 and at.limit(BROADCAST_TARGETS + 1).count() <= BROADCAST_TARGETS:
            at = F.broadcast(at)
    return at.select("source", (F.col("prefix") + (F.col("rest") * 2 >= F.col("n")).cast("bigint")).alias("cut"))


def mix(sized: DataFrame, targets: DataFrame, mix_tokens: int | None = None) -> DataFrame:
    """``doc_id, source, n_tokens, repeats``: the records of the mix, each ``repeats`` times.

    No sort and no sample by chance: a record's hash against its source's threshold decides, so the same record
    comes in or stays out at every run, and a larger budget only adds records.
    """
    return _mixed(sized, _plan(sized, targets, mix_tokens))


def _mixed(sized: DataFrame, plan: DataFrame) -> DataFrame:
    cuts = stage(plan.select("source", "whole").join(thresholds(sized, plan), "source", "left"), "cuts")
    cuts = F.broadcast(cuts) if cuts.limit(BROADCAST_TARGETS + 1).count() <= BROADCAST_TARGETS else cuts
    more = F.coalesce(F.col("spot") < F.col("cut"), F.lit(False)).cast("int")
    return (
        sized.join(cuts, "source")
        .select("doc_id", "source", "n_tokens", (F.col("whole") + more).alias("repeats"))
        .filter(F.col("repeats") > 0)
    )


def shares(sized: DataFrame, targets: DataFrame, mix_tokens: int | None = None) -> DataFrame:
    """For each source of the targets its target and actual share of all tokens of the mix, and its repeats."""
    plan = _plan(sized, targets, mix_tokens)
    taken = (
        _mixed(sized, plan)
        .groupBy("source")
        .agg(
            F.sum(F.col("n_tokens") * F.col("repeats")).alias("mix_tokens"),
            F.count("*").alias("mix_docs"),
            F.max("repeats").alias("most_repeats"),
        )
    )
    rows = plan.join(taken, "source", "left").fillna(0, ["mix_tokens", "mix_docs", "most_repeats"])
    everything = F.sum("mix_tokens").over(Window.partitionBy(F.lit(0)))
    return rows.select(
        "source",
        "target_share",
        F.coalesce(F.try_divide("mix_tokens", everything), F.lit(0.0)).alias("actual_share"),
        F.col("mix_tokens").cast("bigint").alias("mix_tokens"),
        "mix_docs",
        F.col("n_docs").alias("available_docs"),
        F.col("available").cast("bigint").alias("available_tokens"),
        F.col("whole").alias("least_repeats"),
        "most_repeats",
        "max_repeats",
    )
