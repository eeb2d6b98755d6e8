"""Column builders for text: white space, phrases, tokens, excerpts, hashes.

Everything here is made of built-in expressions; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space, as a regex class body.
WS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
# One word token of Latin script; the range of Han characters.
LATIN_TOKEN = r"[a-z0-9_./-]+"
HAN = r"\u4E00-\u9FFF"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_chars(col: Column | str, chars: str) -> Column:
    """``col`` without the characters of the regex class body at its ends.

    The look-behind and the possessive runs keep the match linear even where a
    text has long runs of white space inside.
    """
    return F.regexp_replace(_c(col), rf"^[{chars}]++|(?<![{chars}])[{chars}]++$", "")


def trim_ws(col: Column | str) -> Column:
    """Trim every kind of white space (Spark's ``trim`` only takes U+0020)."""
    return strip_chars(col, WS)


def phrase(col: Column | str) -> Column:
    """Lower case, white space collapsed and trimmed, for phrase matching."""
    return trim_ws(F.regexp_replace(F.lower(_c(col)), rf"[{WS}]+", " "))


def collapse_ws(col: Column | str) -> Column:
    """White space collapsed to one space and trimmed, case kept."""
    return trim_ws(F.regexp_replace(_c(col), rf"[{WS}]+", " "))


def tokens(col: Column | str) -> Column:
    """Retrieval tokens: Latin words, then the characters and bigrams of Han runs.

    Null and empty text give an empty array; repeats are kept.
    """
    low = F.lower(F.coalesce(_c(col), F.lit("")))
    latin = F.regexp_extract_all(low, F.lit(LATIN_TOKEN), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(f"[{HAN}]+"), F.lit(0))

    def of_run(run: Column) -> Column:
        chars = F.split(run, "")
        size = F.length(run)
        pairs = F.transform(
            F.when(size > 1, F.sequence(F.lit(1), size - 1)).otherwise(F.array().cast("array<int>")),
            lambda i: F.substring(run, i, F.lit(2)),
        )
        return F.concat(F.filter(chars, lambda c: c != ""), pairs)

    return F.concat(latin, F.flatten(F.transform(runs, of_run)))


def distinct_tokens(col: Column | str) -> Column:
    return F.array_distinct(tokens(col))


def excerpt(col: Column | str, limit: int) -> Column:
    """White space collapsed, cut after ``limit`` characters, with an ellipsis if cut."""
    flat = collapse_ws(col)
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)


def join_holes(arr: Column | str, sep: str) -> Column:
    """Join an array; null elements count as empty strings."""
    return F.array_join(_c(arr), sep, "")


def let(value: Column, body) -> Column:
    """Bind a value once; a lambda's free expressions are evaluated anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fnv(col: Column) -> Column:
    """FNV-1a of 32 bits over the UTF-16 units, as a bigint."""

    units = F.transform(
        F.regexp_extract_all(F.hex(F.encode(col, "UTF-16BE")), F.lit(".{4}"), F.lit(0)),
        lambda unit: F.conv(unit, 16, 10).cast("bigint"),
    )
    # Offset basis and prime of FNV-1a, 32 bits.
    return F.aggregate(
        units,
        F.lit(2166136261).cast("bigint"),
        lambda acc, u: (acc.bitwiseXOR(u) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(4294967295).cast("bigint")),
    )


def utf16_length(col: Column | str) -> Column:
    return (F.octet_length(F.encode(_c(col), "UTF-16BE")) / 2).cast("int")


def content_hash(col: Column | str) -> Column:
    """``<length>:<hex>`` over UTF-16 units, the parity form of the change hash."""
    col = _c(col)
    return F.concat(utf16_length(col).cast("string"), F.lit(":"), F.lower(F.hex(_fnv(col))))


def memory_id(col: Column | str) -> Column:
    return F.concat(F.lit("mem_"), F.lower(F.hex(_fnv(phrase(col)))))


def is_markdown(col: Column | str) -> Column:
    return F.lower(_c(col)).endswith(".md")


def in_folder(path: Column | str, folder: str) -> Column:
    """Whether the path lies below ``folder``; an empty folder holds no file."""
    folder = folder.strip().strip("/")
    return _c(path).startswith(folder + "/") if folder else F.lit(False)
