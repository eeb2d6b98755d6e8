"""Notes to sections to overlapping chunks, all in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import WS, join_holes, trim_ws

# Fixed value: a heading line.
HEADING = r"^\s{0,3}(#{1,6})\s+(.*?)\s*$"


def sections(notes: DataFrame) -> DataFrame:
    """``path, section_no, heading_path, text`` of notes ``(path, content)``.

    A heading of level L cuts the path to L - 1 and sets slot L; skipped levels leave holes (null). Text before the first heading
    has an empty path, blank sections are dropped. Code fences get no special treatment. Null content gives no section.
    """
    lines = notes.filter(F.col("content").isNotNull()).select(
        "path", F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "line")
    )
    level = F.length(F.regexp_extract("line", HEADING, 1))
    title = trim_ws(F.regexp_replace(F.regexp_extract("line", HEADING, 2), r"\s*#+\s*$", ""))
    lines = lines.select("path", "line_no", "line", level.alias("level"), F.when(level > 0, title).alias("title"))
    upto = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.sum((F.col("level") > 0).cast("int")).over(upto)
    last_at = [F.max(F.when(F.col("level") == k, F.col("line_no"))).over(upto) for k in range(1, 7)]
    last_title = [F.last(F.when(F.col("level") == k, F.col("title")), ignorenulls=True).over(upto) for k in range(1, 7)]
    current = F.last(F.when(F.col("level") > 0, F.col("level")), ignorenulls=True).over(upto)
    cols = [c.alias(f"at{i}") for i, c in enumerate(last_at)] + [c.alias(f"title{i}") for i, c in enumerate(last_title)]
    rows = lines.select("path", "line_no", "line", "level", number.alias("section_no"), current.alias("current"), *cols)
    slots = []
    for k in range(6):
        shallower = F.greatest(F.lit(-1), F.lit(-1), *(F.coalesce(F.col(f"at{j}"), F.lit(-1)) for j in range(k)))
        slots.append(F.when(F.col(f"at{k}") > shallower, F.col(f"title{k}")))
    path = F.slice(F.array(*slots), F.lit(1), F.coalesce("current", F.lit(0)))
    body = F.sort_array(F.collect_list(F.when(F.col("level") == 0, F.struct("line_no", "line"))))
    grouped = rows.groupBy("path", "section_no").agg(
        F.min_by(path, "line_no").alias("heading_path"), trim_ws(F.array_join(F.transform(body, lambda x: x["line"]), "\n")).alias("text")
    )
    return grouped.filter(F.col("text") != "")


def windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters, each ``max(1, size - overlap)`` further, trimmed; blank ones dropped."""
    step = max(1, size - overlap)
    last = F.ceil(F.greatest(F.lit(0), F.length(text) - size) / step).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: trim_ws(F.substring(text, i * step + 1, F.lit(size))))
    return F.filter(cut, lambda x: x != "")


def pack(text: Column, size: int, overlap: int) -> Column:
    """Chunk texts of a section: paragraphs packed up to ``size``, the overlap's tail before the next.

    A paragraph longer than ``size`` closes the chunk and is cut into windows, without overlap in or out.
    """
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), trim_ws), lambda x: x != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def flush(acc: Column) -> Column:
        return F.when(acc["cur"] != "", F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])

    def tail(cur: Column) -> Column:
        return trim_ws(F.right(cur, F.lit(overlap))) if overlap > 0 else F.lit("")

    def merge(acc: Column, p: Column) -> Column:
        joined = F.when(acc["cur"] == "", p).otherwise(F.concat(acc["cur"], F.lit("\n\n"), p))
        lead = tail(acc["cur"])
        following = F.when(lead == "", p).otherwise(F.concat(lead, F.lit("\n\n"), p))
        return (
            F.when(
                F.length(p) > size,
                F.struct(F.concat(flush(acc), windows(p, size, overlap)).alias("done"), F.lit("").alias("cur")),
            )
            .when(F.length(joined) <= size, F.struct(acc["done"].alias("done"), joined.alias("cur")))
            .otherwise(F.struct(flush(acc).alias("done"), following.alias("cur")))
        )

    packed = F.aggregate(paragraphs, empty, merge, flush)
    return F.when(F.length(text) <= size, F.array(text)).otherwise(packed)


def chunks(notes: DataFrame, size: int = 600, overlap: int = 120) -> DataFrame:
    """The retrieval units of notes ``(path, content)``; ids are ``path::heading::serial`` with a space at the end.

    ``serial`` counts within the file from 0. ``searchable_text`` is base name, heading path and text, a line each.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    base = F.regexp_replace(name, r"(?i)\.md$", "")
    cut = sections(notes).select("path", "section_no", "heading_path", F.posexplode(pack(F.col("text"), size, overlap)).alias("pos", "text"))
    order = Window.partitionBy("path").orderBy("section_no", "pos")
    heading = F.element_at("heading_path", -1)
    primary = F.when(F.size("heading_path") > 0, heading)
    rows = cut.withColumn("serial", (F.row_number().over(order) - 1).cast("int")).withColumn("primary_heading", primary)
    search = trim_ws(F.array_join(F.concat(F.array(base), F.col("heading_path"), F.array("text")), "\n", ""))
    key = F.concat_ws("::", "path", F.coalesce("primary_heading", F.lit("__root__")), F.concat(F.col("serial").cast("string"), F.lit(" ")))
    return rows.select(
        key.alias("id"), F.col("path").alias("file_path"), name.alias("file_name"), "heading_path", "primary_heading", "text",
        search.alias("searchable_text"), "serial",
    )


__all__ = ["WS", "chunks", "join_holes", "pack", "sections", "windows"]
