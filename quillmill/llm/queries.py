"""Every registered query of the subpackage, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.text import trim_ws
from quillmill.llm import bpe, knn, langid, mix, neardup, pairs, residue, split
from quillmill.runtime import read_table, stage


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split.split_chunks(read_table(spark, d, "chunks"), read_table(spark, d, "index_settings"))
    return pieces.filter((F.col("n_pieces") > 1) & (F.col("piece") == 0)).select("chunk_id").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    pieces = split.split_chunks(read_table(spark, d, "chunks"), read_table(spark, d, "index_settings"))
    return pieces.filter(F.col("n_pieces") > 1).dropDuplicates(["chunk_id", "piece", "text"])


def labelled(spark: SparkSession, d: str) -> list[DataFrame]:
    """``key, label, text`` of both tables of texts."""
    chunks = read_table(spark, d, "chunks").select(trim_ws("id").alias("key"), F.col("lang").alias("label"), "text")
    chat = read_table(spark, d, "chat_messages").select(
        F.col("msg_id").cast("string").alias("key"), F.col("lang").alias("label"), "text"
    )
    return [chunks, chat]


def _of_records(spark: SparkSession, d: str, operator) -> DataFrame:
    chunks, chat = labelled(spark, d)
    model = langid.fit([chunks, chat])
    return operator(chunks, model).select(F.lit("chunks").alias("rec_table"), "*").unionByName(
        operator(chat, model).select(F.lit("chat_messages").alias("rec_table"), "*")
    ).withColumnRenamed("key", "rec_key")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _of_records(spark, d, lambda rows, m: langid.mislabelled(langid.languages(rows, m))).distinct()


def p2_languages(spark: SparkSession, d: str) -> DataFrame:
    rows = _of_records(spark, d, langid.languages)
    return rows.select("rec_table", "rec_key", "label", "lang", F.round("confidence", 6).alias("confidence"), "langs")


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    return _of_records(spark, d, langid.segments)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    model = langid.fit(labelled(spark, d)[1:])
    found = stage(pairs.question_answer_pairs(read_table(spark, d, "chat_messages")), "pairs")
    return pairs.defects(found, pairs.fit(found, model)).distinct()


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.question_answer_pairs(read_table(spark, d, "chat_messages"))


def _near(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    return neardup.NearDuplicates(read_table(spark, d, "chunks").select(trim_ws("id").alias("key"), "text"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).key_pairs().select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).groups().select(
        F.col("key").alias("chunk_id"), F.col("group").alias("group_id"), "n_copies", "n_links"
    )


def _units(spark: SparkSession, d: str) -> DataFrame:
    return knn.unit_rows(knn.usable_vectors(read_table(spark, d, "chunk_vectors"), "chunk_id", "vector", "embedded_at", 64))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = knn.mutual_pairs(_units(spark, d), 5, 0.92)
    return found.select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p5_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar of about every hundredth vector (those whose key's MD5 begins low), against all; exact."""
    units = _units(spark, d)
    return knn.nearest(units.filter(F.substring(F.md5("key"), 1, 3) < "029"), units, 5, relax=1.0).select(
        F.col("key").alias("chunk_id"), F.col("neighbour").alias("neighbour_id"), "rank", F.round("similarity", 4).alias("similarity")
    )


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(read_table(spark, d, "documents"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.shares(mix.sized_documents(read_table(spark, d, "documents")), read_table(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(mix.sized_documents(read_table(spark, d, "documents")), read_table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residues(read_table(spark, d, "documents"))


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_residue(read_table(spark, d, "documents")).select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_found": p2_found,
    "p2_languages": p2_languages,
    "p2_segments": p2_segments,
    "p3_found": p3_found,
    "p3_pairs": p3_pairs,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_nearest": p5_nearest,
    "p7_ids": p7_ids,
    "p8_shares": p8_shares,
    "p8_mix": p8_mix,
    "p9_found": p9_found,
    "p9_kept": p9_kept,
}

_WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_KEY = f"regexp_replace(%s, '^{_WS}|{_WS}$', '', 'g')"

_UNITS = f"""
WITH r AS (SELECT {_KEY % 'chunk_id'} AS k, vector, embedded_at FROM chunk_vectors),
l AS (SELECT k, first(vector ORDER BY embedded_at DESC NULLS LAST) AS v FROM r WHERE k <> '' GROUP BY k),
u AS (SELECT k, v::DOUBLE[64] AS v FROM l WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = 64
  AND len(list_filter(v, lambda x: x <> 0)) > 0)"""

SQL = {
    "p5_found": _UNITS + """,
s AS (SELECT a.k AS a, b.k AS b, array_cosine_similarity(a.v, b.v) AS s FROM u a JOIN u b ON a.k <> b.k),
t AS (SELECT a, b, s FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT x.a AS chunk_a, x.b AS chunk_b FROM t x JOIN t y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b AND x.s >= 0.92""",
    "p5_nearest": _UNITS + """,
s AS (SELECT a.k AS a, b.k AS b, array_cosine_similarity(a.v, b.v) AS s FROM u a JOIN u b ON a.k <> b.k WHERE substr(md5(a.k), 1, 3) < '029')
SELECT a AS chunk_id, b AS neighbour_id, row_number() OVER (PARTITION BY a ORDER BY s DESC, b)::INT AS rank, round(s, 4) AS similarity
FROM s QUALIFY rank <= 5""",
    "p4_found": f"""
WITH t AS (SELECT DISTINCT {_KEY % 'id'} AS k, regexp_extract_all(regexp_replace(lower(text), '([\\x{{4E00}}-\\x{{9FFF}}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+') AS w FROM chunks),
g AS (SELECT DISTINCT k, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM t WHERE len(w) >= 40),
n AS (SELECT k, count(*) AS n FROM g GROUP BY k),
o AS (SELECT a.k AS a, b.k AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.k < b.k GROUP BY ALL)
SELECT a AS chunk_a, b AS chunk_b FROM o JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE o >= 0.5 * (x.n + y.n - o)""",
    "p1_found": f"""
SELECT DISTINCT {_KEY % 'id'} AS chunk_id
FROM chunks LEFT JOIN index_settings s
  ON position('/' IN file_path) > 0 AND s.folder = split_part(file_path, '/', 1)
WHERE length(regexp_replace(text, '^[ \\t\\r\\n\\x{{00A0}}\\x{{3000}}]+|[ \\t\\r\\n\\x{{00A0}}\\x{{3000}}]+$', '', 'g'))
  > coalesce(s.chunk_size, 600)""",
    "p3_pairs": """
WITH m AS (
  SELECT DISTINCT ON (conv_id, seq, msg_id) conv_id, seq, msg_id, lower(trim(role)) AS role, text FROM chat_messages
  WHERE lower(trim(role)) IN ('user', 'assistant')
), n AS (
  SELECT *, lead(msg_id) OVER w AS aid, lead(role) OVER w AS arole, lead(text) OVER w AS answer
  FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY seq, msg_id)
)
SELECT msg_id AS question_id, aid AS answer_id, text AS question, answer FROM n WHERE role = 'user' AND arole = 'assistant'""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
