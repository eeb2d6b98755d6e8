"""Splitting oversized texts at natural boundaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import strip_chars, trim_ws

# The characters taken off a text's ends before it is measured.
EDGE = r" \t\r\n\u00A0\u3000"
# Where a piece may end, the strongest boundary first: blank line, line end, sentence
# end, clause end, word end. As look-behinds, so that the boundary lies inside the limit.
BOUNDARIES = (
    r"\n[ \t\r]{0,8}\n",
    r"\n",
    r"[.!?…][\"'”’»)\]]{0,3}\s|[。！？][”’」』）]{0,2}",
    r"[,;:]\s|[，；：、]",
    r"\s",
)
DEFAULT_SIZE, DEFAULT_OVERLAP = 600, 120
_PIECES = "array<struct<piece:int,start:int,end:int,text:string>>"
_BLOCK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once: a lambda's free expressions are evaluated for each element otherwise."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def piece_pattern(least: Column, most: Column) -> Column:
    """A regex that consumes ``least`` to ``most`` characters up to the best boundary.

    Bounded greedy quantifiers, one alternative for each kind of boundary: the rest of the text where it
    fits; else the strongest boundary, at its last place within the limit; without any, the limit itself.
    Boundaries stronger than the end of a clause only count in the second half, so that an early
    blank line leaves no scrap.
    """
    half = F.greatest(least, (most / 2).cast("int"))
    parts = [F.lit(r"\G(?s:.{1,"), most, F.lit(r"}\z")]
    for i, boundary in enumerate(BOUNDARIES):
        parts += [F.lit("|.{"), half if i < 3 else least, F.lit(","), most, F.lit("}(?<=" + boundary + ")")]
    return F.concat(*parts, F.lit("|.{1,"), most, F.lit("})"))


def _prefix_sums(lens: Column) -> Column:
    """Running sums of an array, in blocks, so that a text of many pieces stays cheap."""

    def with_blocks(blocks: Column) -> Column:
        return F.transform(
            lens,
            lambda _, i: F.get(blocks, (i / _BLOCK).cast("int"))
            + F.aggregate(
                F.slice(lens, (i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK + 1), F.lit(0), lambda a, x: a + x
            ),
        )

    sums = F.transform(
        F.sequence(F.lit(0), ((F.size(lens) - 1) / _BLOCK).cast("int")),
        lambda b: F.aggregate(F.slice(lens, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), lambda a, x: a + x),
    )
    before = F.aggregate(
        sums, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, F.lit(-1)) + x))
    )
    return _let(before, with_blocks)


def split_text(text: Column, size: Column, overlap: Column) -> Column:
    """Pieces of a text: ``array<struct<piece int, start int, end int, text string>>``.

    ``start`` and ``end`` are code point offsets into the stripped text, ``end`` exclusive. No piece is longer
    than ``size``, consecutive pieces share exactly ``overlap`` characters, and the pieces without their
    overlaps add up to the stripped text. A text that fits is one piece. A size under 1
    counts as 1, the overlap is cut to ``size - 1`` and to 0 from below. Null text gives an
    empty array, a text without anything but white space one empty piece.
    """
    size = F.greatest(size.cast("int"), F.lit(1))
    overlap = F.least(F.greatest(overlap.cast("int"), F.lit(0)), size - 1)
    step = size - overlap
    least = F.greatest((step / 4).cast("int"), F.lit(1))

    def assemble(body: Column, cores: Column) -> Column:
        # so many cores before a piece surely hold the overlap: each has `least` characters, the head `overlap`
        back = F.ceil(overlap / least).cast("int")

        def one(core: Column, i: Column, ends: Column) -> Column:
            first = F.greatest(i - back, F.lit(0))
            lead = F.array_join(F.slice(cores, first + 1, i - first), "")
            end = F.get(ends, i)
            lead = F.when((i > 0) & (overlap > 0), F.substring(lead, F.length(lead) - overlap + 1, overlap)).otherwise("")
            return F.struct(
                i.alias("piece"),
                (end - F.length(core) - F.length(lead)).alias("start"),
                end.alias("end"),
                F.concat(lead, core).alias("text"),
            )

        return _let(
            F.transform(cores, F.length),
            lambda lens: _let(_prefix_sums(lens), lambda ends: F.transform(cores, lambda c, i: one(c, i, ends))),
        )

    def cut(body: Column) -> Column:
        def after_head(head: Column) -> Column:
            rest = F.substring(body, F.length(head) + 1, F.length(body))
            cores = F.concat(F.array(head), F.regexp_extract_all(rest, piece_pattern(least, step), F.lit(0)))
            return _let(cores, lambda c: assemble(body, c))

        return _let(F.regexp_substr(body, piece_pattern(F.greatest(overlap, least), size)), after_head)

    def pieces(body: Column) -> Column:
        whole = F.struct(
            F.lit(0).alias("piece"), F.lit(0).alias("start"), F.length(body).alias("end"), body.alias("text")
        )
        return F.when(F.length(body) > size, cut(body)).otherwise(F.array(whole))

    return F.when(text.isNull(), F.array().cast(_PIECES)).otherwise(_let(strip_chars(text, EDGE), pieces))


def sized(rows: DataFrame, settings: DataFrame) -> DataFrame:
    """``rows`` with the ``limit_size`` and ``limit_overlap`` of their ``file_path``'s folder.

    ``settings`` is ``(folder, chunk_size, chunk_overlap)``, a fixed table of a row for each top folder. Nulls
    in it, folders without a row and files at the root take 600 and 120; of repeated folders the
    largest size and its overlap count.
    """
    folder = F.when(F.col("file_path").contains("/"), F.split_part(F.col("file_path"), F.lit("/"), F.lit(1)))
    one = settings.groupBy(F.col("folder").alias("_folder")).agg(
        F.max(F.struct(F.col("chunk_size").alias("s"), F.col("chunk_overlap").alias("o"))).alias("_limit")
    )
    return (
        rows.withColumn("_at", folder)
        .join(one, F.col("_at") == F.col("_folder"), "left")
        .withColumn("limit_size", F.coalesce(F.col("_limit.s").cast("int"), F.lit(DEFAULT_SIZE)))
        .withColumn("limit_overlap", F.coalesce(F.col("_limit.o").cast("int"), F.lit(DEFAULT_OVERLAP)))
        .drop("_at", "_folder", "_limit")
    )


def split_chunks(chunks: DataFrame, settings: DataFrame) -> DataFrame:
    """All chunks as pieces: ``chunk_id, heading_path, n_pieces, piece, start, end, text``.

    Map-only but for the lookup of the folder's limits in the (small) settings. Repeated rows give
    repeated pieces. Chunks with null text give no row.
    """
    rows = sized(chunks.select("id", "file_path", "heading_path", "text"), settings)
    cut = rows.select(
        trim_ws("id").alias("chunk_id"),
        "heading_path",
        split_text(F.col("text"), F.col("limit_size"), F.col("limit_overlap")).alias("_pieces"),
    )
    return cut.select("chunk_id", "heading_path", F.size("_pieces").alias("n_pieces"), F.inline("_pieces"))
