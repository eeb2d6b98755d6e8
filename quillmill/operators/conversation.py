"""The message log: trimming with a pinned greeting, the last turns as context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import collapse_ws


def trim(messages: DataFrame, most: int = 60) -> DataFrame:
    """The last ``most`` messages of each ``conv_id``; a first assistant message that fell out replaces the oldest of them."""
    of_conv = Window.partitionBy("conv_id")
    back = F.row_number().over(of_conv.orderBy(F.col("seq").desc(), F.col("msg_id").desc()))
    first = F.min(F.when(F.col("role") == "assistant", F.struct("seq", "msg_id"))).over(of_conv)
    rows = messages.withColumns({"_back": back, "_first": first})
    is_first = F.coalesce(F.struct("seq", "msg_id") == F.col("_first"), F.lit(False))
    pinned = F.max((is_first & (F.col("_back") > most)).cast("int")).over(of_conv) == 1
    rows = rows.withColumn("_pinned", pinned)
    keep = ((F.col("_back") <= most) & ~(F.col("_pinned") & (F.col("_back") == most))) | (F.col("_pinned") & is_first)
    return rows.filter(keep).drop("_back", "_first", "_pinned")


def last_turns(messages: DataFrame, n: int = 6) -> DataFrame:
    """``conv_id, context``: the last ``n`` messages, a line each with its role."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("seq").desc(), F.col("msg_id").desc()))
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), collapse_ws(F.coalesce("text", F.lit(""))))
    rows = messages.withColumn("_back", back).filter(F.col("_back") <= n)
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("o"), line.alias("line"))))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("context"))


def append(messages: DataFrame, new: DataFrame, most: int = 60) -> DataFrame:
    return trim(messages.unionByName(new), most)
