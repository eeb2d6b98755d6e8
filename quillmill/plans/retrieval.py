"""Queries of the retrieval engine, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.functions.vectors import norm, unit
from quillmill.operators import answer, chunking, conversation, index, memory, pipeline, rerank, search, sync
from quillmill.plans.integrity import WS_RE2
from quillmill.runtime import read_table
from quillmill.streaming import changes

# The stated questions of the search queries; vectors are those of the named documents of the embeddings table.
QUESTIONS = (
    (1, "battery drained overnight", 3),
    (2, "seed ledger", 17),
    (3, "the path along the northern wall", 42),
    (4, "Erntetabelle", 101),
    (5, "旧账本 作坊", 250),
)
NOW_MS = 1_767_225_600_000
_RE = WS_RE2[:-1]


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([q[:2] for q in QUESTIONS], "query_id int, text string")


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    """The chunks, a row for each id (ids without white space at their ends)."""
    rows = read_table(spark, d, "chunks").withColumn("id", T.trim_ws("id"))
    return rows.dropDuplicates(["id"])


def message_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "chat_messages").withColumn("role", F.lower(T.trim_ws("role")))
    return rows.filter(F.col("role").isin("user", "assistant")).dropDuplicates(["msg_id"]).select("conv_id", "seq", "msg_id", "role", "text")


def memory_rows(spark: SparkSession, d: str) -> DataFrame:
    """User messages as memories."""
    rows = read_table(spark, d, "chat_messages").filter(F.lower(T.trim_ws("role")) == "user").dropDuplicates(["msg_id"])
    at = F.coalesce(F.col("created_at").cast("bigint"), F.lit(0).cast("bigint"))
    return rows.select(
        F.col("msg_id").cast("string").alias("id"), "text", at.alias("created_at"), at.alias("updated_at"), at.alias("last_accessed_at")
    )


def embedding_rows(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("chunk_id"), unit(F.col("embedding")).alias("vector")
    ).filter(F.col("vector").isNotNull())


def question_vectors(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.createDataFrame([(q[0], str(q[2])) for q in QUESTIONS], "query_id int, chunk_id string")
    return embedding_rows(spark, d).join(ids, "chunk_id").select("query_id", "vector")


def _posts(spark, d):
    return index.postings(chunk_rows(spark, d))


def _keyword(spark, d):
    return search.keyword(questions(spark), _posts(spark, d), chunk_rows(spark, d), 10)


def _vector(spark, d):
    return search.vector(question_vectors(spark, d), embedding_rows(spark, d), 10)


def _texts(spark, d):
    """Documents as chunks of their own id, so that both searches speak of the same things."""
    docs = read_table(spark, d, "documents").filter(F.col("text").isNotNull())
    holes = F.array().cast("array<string>")
    return docs.select(
        F.col("doc_id").cast("string").alias("id"), F.col("path").alias("file_path"), holes.alias("heading_path"),
        F.lit(None).cast("string").alias("primary_heading"), "text", F.col("text").alias("searchable_text"),
    )


def _fused(spark, d):
    texts = _texts(spark, d)
    kw = search.keyword(questions(spark), index.postings(texts), texts, 10)
    return search.fused(kw, _vector(spark, d), 12)


def _reranked(spark, d):
    return rerank.heuristic(_fused(spark, d), questions(spark), _texts(spark, d), 8)


def _chunk_reranked(spark, d):
    """Keyword hits over the chunks, which have headings, reranked."""
    hits = search.as_candidates(_keyword(spark, d), "keyword")
    return rerank.heuristic(hits, questions(spark), chunk_rows(spark, d), 8)


def _prepared_answers(spark, d):
    """The whole way of the questions over the chunks, without a model: keyword mode, the answers are the fallbacks."""
    made = pipeline.prepare(questions(spark), pipeline.Index(chunk_rows(spark, d), _posts(spark, d)))
    return pipeline.answers(made, None).select("query_id", "answer")


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search with reranking and cited sources."""
    return answer.sources(_reranked(spark, d), _texts(spark, d))


def notes(spark, d):
    return read_table(spark, d, "documents").filter(F.col("text").isNotNull()).select("path", F.col("text").alias("content")).dropDuplicates(["path"])


def events_as_changes(spark, d):
    """Sync results as an event log: every affected file was modified."""
    rows = read_table(spark, d, "sync_results").select(F.explode("affected_files").alias("path"))
    return rows.select(F.lit("modify").alias("kind"), "path", F.lit(None).cast("string").alias("old_path"))


def present_files(spark, d):
    rows = read_table(spark, d, "file_records").select(F.col("file_path").alias("path"), "content_hash", F.col("indexed_at").cast("bigint").alias("at"))
    return rows


def _sync_plan(spark, d):
    files = present_files(spark, d)
    now = files.groupBy("path").agg(F.max(F.struct("at", "content_hash")).alias("x")).select("path", F.col("x.content_hash").alias("content_hash"))
    was = files.groupBy("path").agg(F.min(F.struct("at", "content_hash")).alias("x")).select("path", F.col("x.content_hash").alias("content_hash"))
    return sync.plan(sync.changed_paths(events_as_changes(spark, d)), now, was)


def _flushes(spark, d):
    """The events as changes of a note for each user, flushed after quiet gaps."""
    rows = read_table(spark, d, "events").select(
        F.lit("modify").alias("kind"), F.concat(F.lit("u"), F.col("user_id"), F.lit(".md")).alias("path"), F.lit(None).cast("string").alias("old_path"),
        F.col("ts").cast("timestamp").alias("at"),
    )
    at = F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us")
    return changes.quiet_flushes(rows).select(*at, F.array_join("paths", " ").alias("paths"))


QUERIES = {
    "e3_quiet_flushes": _flushes,
    "f1_folder_scope": lambda s, d: chunk_rows(s, d).filter(T.in_folder("file_path", "Projects")).select("id", "file_path"),
    "f2_markdown_paths": lambda s, d: chunk_rows(s, d).filter(T.is_markdown("file_path")).select("file_path").distinct(),
    "f5_usable_embeddings": lambda s, d: embedding_rows(s, d).agg(F.count("*").alias("n"), F.round(F.sum(norm(F.col("vector"))), 4).alias("norms")),
    "c2_trimmed_text": lambda s, d: chunk_rows(s, d).select("id", T.trim_ws("text").alias("trimmed")),
    "c3_phrase": lambda s, d: chunk_rows(s, d).select("id", T.phrase("text").alias("phrase")),
    "c8_excerpts": lambda s, d: chunk_rows(s, d).select("id", T.excerpt("text", 180).alias("excerpt")),
    "c9_heading_lines": lambda s, d: chunk_rows(s, d).select("id", T.join_holes("heading_path", " > ").alias("headings")),
    "u3_windows": lambda s, d: read_table(s, d, "documents").select("doc_id", F.posexplode(chunking.windows(F.col("text"), 600, 120)).alias("pos", "window")),
    "u6_tokens": lambda s, d: chunk_rows(s, d).select(F.explode(T.tokens("searchable_text")).alias("token")).groupBy("token").agg(F.count("*").alias("n")),
    "a1_postings": lambda s, d: _posts(s, d),
    "a3_document_frequency": lambda s, d: index.document_frequency(_posts(s, d)),
    "a9_kb_stats": lambda s, d: index.kb_stats(chunk_rows(s, d).select("file_path").distinct(), chunk_rows(s, d)),
    "a10_vector_stats": lambda s, d: index.vector_stats(embedding_rows(s, d)),
    "a12_file_manifest": lambda s, d: index.manifest(chunk_rows(s, d)).select("file_path", F.array_join("chunk_ids", "\n").alias("chunk_ids")),
    "a13_content_hash": lambda s, d: chunk_rows(s, d).select("id", T.content_hash("text").alias("content_hash")),
    "r1_keyword_search": lambda s, d: _keyword(s, d).select("query_id", "chunk_id", _r("score"), "n_matched", F.array_join("matched_tokens", " ").alias("matched_tokens"), "pos"),
    "r2_vector_search": lambda s, d: _vector(s, d).select("query_id", "chunk_id", _r("score"), "pos"),
    "r3_hybrid_search": lambda s, d: _fused(s, d).select("query_id", "chunk_id", _r("score"), _r("keyword_score"), _r("vector_score"), F.array_join("channels", "+").alias("channels"), "pos"),
    "r5_rerank_off": lambda s, d: rerank.off(_fused(s, d)).select("query_id", "chunk_id", _r("final_score"), "final_pos"),
    "r7_heuristic_rerank": lambda s, d: _reranked(s, d).select("query_id", "chunk_id", _r("final_score"), "final_pos"),
    "r12_answer_sources": flagship,
    "r7_chunk_rerank": lambda s, d: _chunk_reranked(s, d).select("query_id", "chunk_id", _r("final_score"), "final_pos"),
    "r12_chunk_sources": lambda s, d: answer.sources(_chunk_reranked(s, d), chunk_rows(s, d)),
    "r15_prepared_answers": lambda s, d: _prepared_answers(s, d),
    "r19_vector_sync_plan": lambda s, d: sync.vector_plan(read_table(s, d, "chunks"), read_table(s, d, "chunk_vectors")),
    "r9_last_turns": lambda s, d: conversation.last_turns(message_rows(s, d)),
    "r25_trimmed_log": lambda s, d: conversation.trim(message_rows(s, d), 20).select("conv_id", "seq", "msg_id", "role"),
    "r21_memory_search": lambda s, d: memory.search(memory_rows(s, d), questions(s), NOW_MS, 4).select("query_id", "id", _r("score"), "pos"),
    "r24_memory_evict": lambda s, d: memory.evict(memory_rows(s, d), 150).select("id"),
    "x1_changed_paths": lambda s, d: sync.changed_paths(events_as_changes(s, d)),
    "j5_sync_plan": _sync_plan,
    "j7_removed_chunks": lambda s, d: sync.without(
        chunk_rows(s, d).select(F.col("id").alias("chunk_id")),
        read_table(s, d, "sync_results").select(F.explode("removed_chunk_ids").alias("x")).select(T.trim_ws("x").alias("chunk_id")),
    ),
    "u1_sections": lambda s, d: chunking.sections(notes(s, d)).select("path", "section_no", F.array_join("heading_path", "/", "").alias("headings"), "text"),
    "u5_chunks": lambda s, d: chunking.chunks(notes(s, d)).select("id", "file_path", "serial", "text"),
    "r10_context": lambda s, d: answer.context(_reranked(s, d), _texts(s, d)),
    "r11_prompt": lambda s, d: answer.prompt(questions(s), answer.context(_reranked(s, d), _texts(s, d))),
    "r14_fallback_answer": lambda s, d: answer.fallback(questions(s), _reranked(s, d), _texts(s, d), "hybrid"),
    "r23_memory_upsert": lambda s, d: memory.upsert(
        memory_rows(s, d), message_rows(s, d).filter("role = 'assistant'").select(F.col("msg_id").alias("pos"), "text"), NOW_MS
    ).select("text", "created_at", "updated_at"),
}

# ---- SQL -----------------------------------------------------------------------------------------------------------------


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS_RE2}|{WS_RE2}$', '', 'g')"


def _phrase(x: str) -> str:
    return _trim(f"regexp_replace(lower({x}), '{WS_RE2}', ' ', 'g')")


def _collapse(x: str) -> str:
    return _trim(f"regexp_replace({x}, '{WS_RE2}', ' ', 'g')")


def _excerpt(x: str, n: int) -> str:
    flat = _collapse(x)
    return f"CASE WHEN length({flat}) > {n} THEN substr({flat}, 1, {n}) || '…' ELSE {flat} END"


def _tokens(x: str) -> str:
    runs = rf"regexp_extract_all(lower({x}), '[\x{{4E00}}-\x{{9FFF}}]+')"
    return (
        f"list_concat(regexp_extract_all(lower({x}), '[a-z0-9_./-]+'), flatten(list_transform({runs}, lambda r: "
        "list_concat(string_split(r, ''), list_transform(range(1, length(r)), lambda i: substr(r, i, 2))))))"
    )


_CH = f"ch AS (SELECT DISTINCT ON ({_trim('id')}) * REPLACE ({_trim('id')} AS id) FROM chunks)"
_Q = "q(query_id, text, vid) AS (VALUES " + ", ".join(f"({i}, '{t}', {v})" for i, t, v in QUESTIONS) + ")"
_MSG = f"""m AS (SELECT DISTINCT ON (msg_id) conv_id, seq, msg_id, lower({_trim('role')}) AS role, text FROM chat_messages
  WHERE lower({_trim('role')}) IN ('user', 'assistant'))"""
_MEM = f"""mem AS (SELECT DISTINCT ON (msg_id) msg_id::VARCHAR AS id, text, coalesce(created_at::BIGINT, 0) AS created_at, coalesce(created_at::BIGINT, 0) AS updated_at
  FROM chat_messages WHERE lower({_trim('role')}) = 'user')"""
_EMB = """e AS (SELECT vec_id::VARCHAR AS chunk_id, list_transform(embedding, lambda x: x::DOUBLE / n) AS vector FROM (
  SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings) WHERE n > 0)"""
_DOC = "tx AS (SELECT doc_id::VARCHAR AS id, path AS file_path, []::VARCHAR[] AS heading_path, text, text AS searchable_text FROM documents WHERE text IS NOT NULL)"


def _kw(rows: str) -> str:
    return f"""
p AS (SELECT id AS chunk_id, token, count(*) AS tf FROM (SELECT id, unnest({_tokens('searchable_text')}) AS token FROM {rows}) GROUP BY ALL),
w AS (SELECT DISTINCT query_id, token FROM (SELECT query_id, unnest({_tokens('text')}) AS token FROM q)),
df AS (SELECT token, count(*) AS df FROM p GROUP BY token),
b AS (SELECT query_id, chunk_id, string_agg(token, ' ' ORDER BY token) AS matched_tokens, sum(tf * (ln(((SELECT count(*) FROM {rows}) + 1.0) / (df + 1.0)) + 1)) AS base, count(*) AS n_matched
  FROM p JOIN w USING (token) JOIN df USING (token) GROUP BY ALL),
s AS (SELECT query_id, chunk_id, n_matched, matched_tokens, base + CASE WHEN contains({_phrase('c.searchable_text')}, {_phrase('q.text')}) THEN 3 ELSE 0 END
    + CASE WHEN contains({_phrase("coalesce(list_reduce(list_transform(c.heading_path, lambda h: coalesce(h, '')), lambda a, h: a || ' ' || h, ''), '')")}, {_phrase('q.text')}) THEN 2 ELSE 0 END
    + 0.3 * n_matched AS score
  FROM b JOIN {rows} c ON c.id = chunk_id JOIN q USING (query_id)),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS pos FROM s) WHERE pos <= 10)"""


_VEC = """
v AS (SELECT q.query_id, e.chunk_id, list_dot_product(a.vector, e.vector) AS score FROM q JOIN e a ON a.chunk_id = q.vid::VARCHAR CROSS JOIN e),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS pos FROM v) WHERE pos <= 10)"""
_HYBRID = f"""WITH {_Q}, {_DOC}, {_EMB}, {_kw('tx')}, {_VEC},
h0 AS (SELECT coalesce(kw.query_id, vec.query_id) AS query_id, coalesce(kw.chunk_id, vec.chunk_id) AS chunk_id,
    coalesce(1.0::DOUBLE / (60 + kw.pos), 0) + coalesce(1.0::DOUBLE / (60 + vec.pos), 0) AS score, kw.score AS keyword_score, vec.score AS vector_score,
    concat_ws('+', CASE WHEN kw.pos IS NOT NULL THEN 'keyword' END, CASE WHEN vec.pos IS NOT NULL THEN 'vector' END) AS channels
  FROM kw FULL OUTER JOIN vec ON kw.query_id = vec.query_id AND kw.chunk_id = vec.chunk_id),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS pos FROM h0) WHERE pos <= 12)"""
_RERANK = f"""{_HYBRID},
r0 AS (SELECT h.*, 0.4 * h.score + 0.15 * len(list_intersect(list_distinct({_tokens('q.text')}), list_distinct({_tokens('tx.searchable_text')})))
    + CASE WHEN contains({_phrase('tx.searchable_text')}, {_phrase('q.text')}) THEN 1.5 ELSE 0 END
    + CASE WHEN vector_score > 0 THEN 0.6 * vector_score ELSE 0 END + CASE WHEN keyword_score > 0 THEN 0.05 * keyword_score ELSE 0 END AS final_score
  FROM h JOIN tx ON tx.id = h.chunk_id JOIN q USING (query_id) WHERE h.pos <= 8),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, pos) AS final_pos FROM r0)"""

_CHUNK_RERANK = f"""WITH {_Q}, {_CH}, {_kw('ch')},
r0 AS (SELECT kw.*, 0.4 * score + 0.05 * score + 0.15 * len(list_intersect(list_distinct({_tokens('q.text')}), list_distinct({_tokens('ch.searchable_text')})))
    + CASE WHEN contains({_phrase('ch.searchable_text')}, {_phrase('q.text')}) THEN 1.5 ELSE 0 END
    + CASE WHEN contains({_phrase("coalesce(list_reduce(list_transform(ch.heading_path, lambda h: coalesce(h, '')), lambda a, h: a || ' ' || h, ''), '')")}, {_phrase('q.text')}) THEN 1 ELSE 0 END AS final_score
  FROM kw JOIN ch ON ch.id = kw.chunk_id JOIN q USING (query_id) WHERE kw.pos <= 8),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, pos) AS final_pos FROM r0)"""
_CONTEXT = f"""{_RERANK},
cx AS (SELECT query_id, string_agg('[' || final_pos || '] ' || file_path || chr(10) || 'Heading: (no heading)' || chr(10) || 'Found by: ' || replace(channels, '+', ' + ')
    || chr(10) || '```' || chr(10) || tx.text || chr(10) || '```', chr(10) || chr(10) ORDER BY final_pos) AS context
  FROM r JOIN tx ON tx.id = r.chunk_id GROUP BY query_id)"""
_UNITS16 = """flatten(list_transform(regexp_extract_all(text, '(?s).'), lambda c: CASE WHEN unicode(c) < 65536 THEN [unicode(c)::BIGINT]
  ELSE [55296 + ((unicode(c)::BIGINT - 65536) // 1024), 56320 + ((unicode(c)::BIGINT - 65536) % 1024)] END))"""


def _fallback(rows: str, texts: str, mode: str, heading: str) -> str:
    return f"""{rows},
f AS (SELECT query_id, string_agg(final_pos || '. ' || file_path || {heading} || ': ' || {_excerpt("coalesce(x.text, '')", 220)}, chr(10) ORDER BY final_pos) AS f
  FROM r JOIN {texts} x ON x.id = r.chunk_id GROUP BY query_id)
SELECT query_id, 'Question: ' || text || chr(10) || coalesce('Most relevant passages ({mode}):' || chr(10) || f, 'Nothing relevant was found.') AS answer
FROM q LEFT JOIN f USING (query_id)"""


SQL = {
    "a13_content_hash": f"""WITH {_CH}, n AS (SELECT id, text, {_UNITS16} AS u FROM ch)
SELECT id, CASE WHEN text IS NOT NULL THEN len(u) || ':' || printf('%x', list_reduce(u, lambda a, x: (xor(a, x) * 16777619) % 4294967296, 2166136261::BIGINT)) END AS content_hash FROM n""",
    "r10_context": f"{_CONTEXT} SELECT query_id, context FROM cx",
    "r11_prompt": f"""{_CONTEXT} SELECT query_id, 'You answer questions about a collection of notes. Use only the context, cite the numbers of what you use, and say so if it does not suffice.' AS system,
  'Scope: the whole vault' || chr(10) || 'Conversation:' || chr(10) || chr(10) || 'Memory:' || chr(10) || chr(10) || 'Question: ' || text || chr(10) || 'Context:' || chr(10) || context AS "user"
FROM q JOIN cx USING (query_id)""",
    "r14_fallback_answer": _fallback(_RERANK, "tx", "hybrid", "''"),
    "r15_prepared_answers": _fallback(_CHUNK_RERANK, "ch", "keyword", "CASE WHEN primary_heading <> '' THEN ' # ' || primary_heading ELSE '' END"),
    "r7_chunk_rerank": f"{_CHUNK_RERANK} SELECT query_id, chunk_id, round(final_score, 6) AS final_score, final_pos::INT AS final_pos FROM r",
    "r12_chunk_sources": f"""{_CHUNK_RERANK},
f AS (SELECT r.query_id, r.final_pos, file_path, primary_heading, ch.text, row_number() OVER (PARTITION BY r.query_id, file_path, primary_heading ORDER BY final_pos) AS rn
  FROM r JOIN ch ON ch.id = r.chunk_id),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_pos) AS n FROM f WHERE rn = 1)
SELECT query_id, n::INT AS n, file_path, primary_heading AS heading,
  CASE WHEN primary_heading <> '' THEN '[[' || file_path || '#' || primary_heading || ']]' ELSE '[[' || file_path || ']]' END AS display_link, {_excerpt('text', 180)} AS excerpt FROM g WHERE n <= 5""",
    "r19_vector_sync_plan": f"""WITH c AS (SELECT DISTINCT {_trim('id')} AS id FROM chunks), v AS (SELECT DISTINCT {_trim('chunk_id')} AS id FROM chunk_vectors WHERE {_trim('chunk_id')} <> '')
SELECT coalesce(c.id, v.id) AS chunk_id, CASE WHEN c.id IS NULL THEN 'remove' ELSE 'embed' END AS action FROM c FULL OUTER JOIN v ON c.id = v.id WHERE c.id IS NULL OR v.id IS NULL""",
    "r23_memory_upsert": f"""WITH {_MEM}, {_MSG}, s AS (SELECT msg_id AS pos, text, {_phrase('text')} AS norm FROM m WHERE role = 'assistant'),
n AS (SELECT norm, arg_max(text, pos) AS nt FROM s WHERE norm <> '' GROUP BY norm), o AS (SELECT *, {_phrase('text')} AS norm FROM mem)
SELECT coalesce(nt, text) AS text, coalesce(created_at, {NOW_MS}) AS created_at, CASE WHEN nt IS NOT NULL THEN {NOW_MS} ELSE updated_at END AS updated_at
FROM o FULL OUTER JOIN n ON o.norm = n.norm""",
    "e3_quiet_flushes": """WITH g AS (SELECT ts, user_id, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) <= INTERVAL 15 SECONDS THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL),
s AS (SELECT *, sum(fresh) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS w FROM g)
SELECT epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 15000000 AS end_us, array_to_string(list_sort(list_distinct(list('u' || user_id || '.md'))), ' ') AS paths FROM s GROUP BY w""",
    "f1_folder_scope": f"WITH {_CH} SELECT id, file_path FROM ch WHERE starts_with(file_path, 'Projects/')",
    "f2_markdown_paths": "SELECT DISTINCT file_path FROM chunks WHERE lower(file_path) LIKE '%.md'",
    "f5_usable_embeddings": f"WITH {_EMB} SELECT count(*) AS n, round(sum(sqrt(list_dot_product(vector, vector))), 4) AS norms FROM e",
    "c2_trimmed_text": f"WITH {_CH} SELECT id, {_trim('text')} AS trimmed FROM ch",
    "c3_phrase": f"WITH {_CH} SELECT id, {_phrase('text')} AS phrase FROM ch",
    "c8_excerpts": f"WITH {_CH} SELECT id, {_excerpt('text', 180)} AS excerpt FROM ch",
    "c9_heading_lines": f"WITH {_CH} SELECT id, array_to_string(list_transform(heading_path, lambda h: coalesce(h, '')), ' > ') AS headings FROM ch",
    "u3_windows": f"""
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, w AS "window" FROM (
  SELECT doc_id, i, {_trim('substr(text, (i * 480 + 1)::INT, 600)')} AS w
  FROM (SELECT doc_id, text, unnest(range(0, ceil(greatest(0, length(text) - 600) / 480.0)::BIGINT + 1)) AS i FROM documents WHERE text IS NOT NULL)
) WHERE w <> ''""",
    "u6_tokens": f"WITH {_CH} SELECT token, count(*) AS n FROM (SELECT unnest({_tokens('searchable_text')}) AS token FROM ch) GROUP BY token",
    "a1_postings": f"WITH {_CH} SELECT token, id AS chunk_id, count(*) AS tf FROM (SELECT id, unnest({_tokens('searchable_text')}) AS token FROM ch) GROUP BY ALL",
    "a3_document_frequency": f"WITH {_CH} SELECT token, count(DISTINCT id) AS df FROM (SELECT id, unnest({_tokens('searchable_text')}) AS token FROM ch) GROUP BY token",
    "a9_kb_stats": f"SELECT count(DISTINCT file_path) AS file_count, count(DISTINCT {_trim('id')}) AS chunk_count FROM chunks",
    "a10_vector_stats": f"WITH {_EMB} SELECT count(*) AS vector_count, max(len(vector))::INT AS dimension, count(*) > 0 AS ready FROM e",
    "a12_file_manifest": f"WITH {_CH} SELECT file_path, string_agg(id, chr(10) ORDER BY serial, id) AS chunk_ids FROM ch GROUP BY file_path",
    "r1_keyword_search": f"WITH {_Q}, {_CH}, {_kw('ch')} SELECT query_id, chunk_id, round(score, 6) AS score, n_matched, matched_tokens, pos::INT AS pos FROM kw",
    "r2_vector_search": f"WITH {_Q}, {_EMB}, {_VEC} SELECT query_id, chunk_id, round(score, 6) AS score, pos::INT AS pos FROM vec",
    "r3_hybrid_search": f"{_HYBRID} SELECT query_id, chunk_id, round(score, 6) AS score, round(keyword_score, 6) AS keyword_score, round(vector_score, 6) AS vector_score, channels, pos::INT AS pos FROM h",
    "r5_rerank_off": f"{_HYBRID} SELECT query_id, chunk_id, round(score, 6) AS final_score, pos::INT AS final_pos FROM h WHERE pos <= 8",
    "r7_heuristic_rerank": f"{_RERANK} SELECT query_id, chunk_id, round(final_score, 6) AS final_score, final_pos::INT AS final_pos FROM r",
    "r12_answer_sources": f"""{_RERANK},
f AS (SELECT r.query_id, r.final_pos, file_path, tx.text, row_number() OVER (PARTITION BY r.query_id, file_path ORDER BY final_pos) AS rn FROM r JOIN tx ON tx.id = r.chunk_id),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_pos) AS n FROM f WHERE rn = 1)
SELECT query_id, n::INT AS n, file_path, NULL::VARCHAR AS heading, '[[' || file_path || ']]' AS display_link, {_excerpt('text', 180)} AS excerpt FROM g WHERE n <= 5""",
    "r9_last_turns": f"""WITH {_MSG}, b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq DESC, msg_id DESC) AS rn FROM m)
SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || {_collapse("coalesce(text, '')")}, chr(10) ORDER BY rn DESC) AS context
FROM b WHERE rn <= 6 GROUP BY conv_id""",
    "r25_trimmed_log": f"""WITH {_MSG}, b AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq DESC, msg_id DESC) AS rn,
    CASE WHEN role = 'assistant' THEN row_number() OVER (PARTITION BY conv_id, role ORDER BY seq, msg_id) END AS an FROM m
), p AS (SELECT *, bool_or(coalesce(an = 1, false) AND rn > 20) OVER (PARTITION BY conv_id) AS pinned FROM b)
SELECT conv_id, seq, msg_id, role FROM p WHERE (rn <= 20 AND NOT (pinned AND rn = 20)) OR (pinned AND coalesce(an = 1, false))""",
    "r21_memory_search": f"""WITH {_Q}, {_MEM}, x AS (
  SELECT query_id, mem.id, updated_at, contains({_phrase('mem.text')}, {_phrase('q.text')}) AS hit,
    len(list_intersect(list_distinct({_tokens('q.text')}), list_distinct({_tokens('mem.text')}))) AS overlap FROM q CROSS JOIN mem WHERE mem.text IS NOT NULL
), y AS (SELECT query_id, id, CASE WHEN hit THEN 3 ELSE 0 END + 0.6 * overlap + greatest(0, (updated_at - ({NOW_MS} - {memory.MONTH_MS})) / {memory.MONTH_MS}.0) AS score FROM x WHERE hit OR overlap > 0),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos FROM y)
SELECT query_id, id, round(score, 6) AS score, pos::INT AS pos FROM z WHERE pos <= 4""",
    "r24_memory_evict": f"WITH {_MEM} SELECT id FROM mem ORDER BY updated_at DESC, id LIMIT 150",
    "x1_changed_paths": f"SELECT DISTINCT p AS path FROM (SELECT {_trim('unnest(affected_files)')} AS p FROM sync_results) WHERE lower(p) LIKE '%.md'",
    "j5_sync_plan": f"""WITH c AS (SELECT DISTINCT p AS path FROM (SELECT {_trim('unnest(affected_files)')} AS p FROM sync_results) WHERE lower(p) LIKE '%.md'),
k AS (SELECT file_path AS path, content_hash, row_number() OVER (PARTITION BY file_path ORDER BY indexed_at DESC NULLS LAST, content_hash DESC NULLS LAST) AS newest,
  row_number() OVER (PARTITION BY file_path ORDER BY indexed_at NULLS FIRST, content_hash NULLS FIRST) AS oldest FROM file_records)
SELECT c.path, CASE WHEN n.path IS NULL THEN 'delete' WHEN n.content_hash = o.content_hash THEN 'skip' ELSE 'index' END AS action
FROM c LEFT JOIN k n ON n.path = c.path AND n.newest = 1 LEFT JOIN k o ON o.path = c.path AND o.oldest = 1""",
    "j7_removed_chunks": f"""SELECT DISTINCT {_trim('id')} AS chunk_id FROM chunks WHERE {_trim('id')} NOT IN
  (SELECT {_trim('x')} FROM (SELECT unnest(removed_chunk_ids) AS x FROM sync_results) WHERE x IS NOT NULL)""",
}
