"""A question's whole way: mode, rewriting, retrieval, reranking, sources, prompt, answer; for batches of questions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.config import Settings
from quillmill.operators import answer, conversation, memory, rerank, search
from quillmill.sources import models


@dataclass
class Index:
    """What a question is asked against: ``chunks``, their ``postings`` and, if there are any, ``vectors``."""

    chunks: DataFrame
    postings: DataFrame
    vectors: DataFrame | None = None

    def ready(self, mode: str) -> dict:
        """What can be answered: whether there are chunks, and vectors where the mode wants them."""
        has_chunks = bool(self.chunks.limit(1).count())
        has_vectors = self.vectors is not None and bool(self.vectors.limit(1).count())
        return {"keyword": has_chunks, "vector": has_vectors, "ready": has_chunks and (mode == "keyword" or has_vectors)}


@dataclass
class Prepared:
    """The parts of the way up to the model; every frame has a ``query_id``."""

    questions: DataFrame
    candidates: DataFrame
    reranked: DataFrame
    sources: DataFrame
    prompts: DataFrame
    fallbacks: DataFrame
    mode: str


def rewritten(questions: DataFrame, chat: models.Chat | None, settings: Settings) -> DataFrame:
    """``questions`` with ``asked``, the original text, and ``text``, rewritten by a model from ``conversation``; without one the same."""
    base = questions.withColumn("asked", F.col("text"))
    if chat is None or not settings.enable_query_rewrite:
        return base
    scope = settings.scope_description()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts, talks = b.column(1).to_pylist(), b.column(2).to_pylist()
            new = [models.rewrite(chat, t or "", c or "", scope)[0] for t, c in zip(texts, talks, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string())], ["query_id", "text"])

    types = base.schema["query_id"].dataType.simpleString()
    new = base.select("query_id", "text", "conversation").mapInArrow(run, f"query_id {types}, text string")
    return base.drop("text").join(new, "query_id")


def embedded(questions: DataFrame, embedder: models.Embedder) -> DataFrame:
    """``query_id, vector`` of the questions."""
    rows = questions.select(F.col("query_id").cast("string").alias("id"), F.col("text").alias("searchable_text"))
    vectors = models.embed_chunks(rows, embedder)
    return vectors.select(F.col("chunk_id").cast(questions.schema["query_id"].dataType).alias("query_id"), "vector")


def remote_scores(candidates: DataFrame, questions: DataFrame, chunks: DataFrame, reranker: models.Reranker, k: int) -> DataFrame:
    """``query_id, idx, seq, score, failed`` by an outside reranker, one call a question; ``idx`` from 0 in the candidates' order.

    A question whose call fails, or gives no score, gets one row that says so.
    """
    docs = answer.rerank_document(answer.only(chunks, candidates))
    rows = candidates.filter(F.col("pos") <= k).join(docs, "chunk_id").join(questions.select("query_id", F.col("text").alias("_q")), "query_id")
    # at most k documents of a question
    lists = rows.groupBy("query_id", "_q").agg(F.sort_array(F.collect_list(F.struct("pos", "document"))).alias("docs"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = []
            for i, (query, docs) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                try:
                    got = reranker.rerank(query, [d["document"] for d in docs])
                except Exception:  # noqa: BLE001
                    got = []
                out += [(i, int(r["idx"]), seq, float(r["score"]), False) for seq, r in enumerate(got)] or [(i, 0, 0, 0.0, True)]
            at, *cols = zip(*out, strict=True)
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                ["query_id", "idx", "seq", "score", "failed"],
            )

    types = candidates.schema["query_id"].dataType.simpleString()
    return lists.select("query_id", "_q", "docs").mapInArrow(run, f"query_id {types}, idx int, seq int, score double, failed boolean")


def reranked(candidates: DataFrame, questions: DataFrame, chunks: DataFrame, settings: Settings, reranker: models.Reranker | None = None) -> DataFrame:
    """Off, by the reranker, or by the heuristic; the heuristic also where the reranker fails."""
    k = settings.rerank_top_k
    if not settings.enable_rerank:
        return rerank.off(candidates, k)
    if reranker is None:
        return rerank.heuristic(candidates, questions, chunks, k)
    scores = remote_scores(candidates, questions, chunks, reranker, k)
    failed = scores.filter("failed").select("query_id")
    scored = rerank.remote(candidates.join(failed, "query_id", "left_anti"), scores.filter("not failed").drop("failed"), k)
    own = rerank.heuristic(candidates.join(failed, "query_id", "left_semi"), questions, chunks, k)
    return scored.drop("idx").unionByName(own)


def prepare(
    questions: DataFrame,
    index: Index,
    settings: Settings | None = None,
    embedder: models.Embedder | None = None,
    chat: models.Chat | None = None,
    reranker: models.Reranker | None = None,
    messages: DataFrame | None = None,
    memories: DataFrame | None = None,
    now_ms: int = 0,
) -> Prepared:
    """Everything up to the model's answer for questions ``(query_id, text)``, with ``conv_id`` where they belong to conversations.

    The mode is the settings', or keyword where there are no vectors or nothing to embed the questions with. Each question has its own conversation and
    memories in its prompt. Questions without candidates have no prompt, and a fallback that says that nothing was found.
    """
    settings = settings or Settings()
    mode = settings.effective_mode(index.vectors is not None and embedder is not None)
    if messages is not None and "conv_id" in questions.columns:
        questions = questions.join(conversation.last_turns(messages).withColumnRenamed("context", "conversation"), "conv_id", "left")
    else:
        questions = questions.withColumn("conversation", F.lit(""))
    questions = rewritten(questions.fillna("", ["conversation"]), chat, settings)
    kw = search.keyword(questions, index.postings, index.chunks, settings.keyword_search_top_k) if mode != "vector" else None
    vec = search.vector(embedded(questions, embedder), index.vectors, settings.vector_search_top_k) if mode != "keyword" else None
    found = search.retrieve(mode, kw, vec, settings.hybrid_search_top_k)
    best = reranked(found, questions, index.chunks, settings, reranker)
    remembered = None
    if memories is not None and settings.enable_long_term_memory:
        remembered = memory.context(memory.search(memories, questions, now_ms, settings.memory_top_k), memories)
        questions = questions.join(remembered, "query_id", "left").fillna("", ["memory"])
    else:
        questions = questions.withColumn("memory", F.lit(""))
    context = answer.context(best, index.chunks, settings.context_top_k)
    return Prepared(
        questions,
        found,
        best,
        answer.sources(best, index.chunks, settings.answer_source_limit),
        answer.prompt(questions, context, scope=settings.scope_description()),
        answer.fallback(questions, best, index.chunks, mode),
        mode,
    )


def answers(prepared: Prepared, chat: models.Chat | None, settings: Settings | None = None) -> DataFrame:
    """``query_id, answer, by_model``: the model's answer, or the fallback without candidates, without a model, or where it fails."""
    settings = settings or Settings()
    temperature = settings.generation_temperature
    rows = prepared.fallbacks.join(prepared.prompts, "query_id", "left").select("query_id", "answer", "system", "user")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            fallbacks, systems, users = (b.column(i).to_pylist() for i in (1, 2, 3))
            said = [models.generate(chat if s else None, s, u, temperature, "") for s, u in zip(systems, users, strict=True)]
            texts = [t or f for t, f in zip(said, fallbacks, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(texts, pa.string()), pa.array([bool(t) for t in said])], ["query_id", "answer", "by_model"]
            )

    types = rows.schema["query_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"query_id {types}, answer string, by_model boolean")


def turn(
    questions: DataFrame, messages: DataFrame, prepared: Prepared, given: DataFrame, memories: DataFrame, chat: models.Chat | None, now_ms: int, settings: Settings | None = None
) -> tuple[DataFrame, DataFrame]:
    """The conversation log and the memories after a turn of questions ``(query_id, conv_id, text)`` with their answers.

    The log gets each question and answer behind the conversation's last message and is trimmed; what a model takes from the turn is upserted
    into the memories, which are touched where they were used, and evicted.
    """
    settings = settings or Settings()
    last = messages.groupBy("conv_id").agg(F.max("seq").alias("_seq"), F.max("msg_id").alias("_msg"))
    top = messages.agg(F.coalesce(F.max("msg_id"), F.lit(0)).alias("_top"))
    asked = questions.select("query_id", "conv_id", "text").join(given, "query_id").join(last, "conv_id", "left").crossJoin(F.broadcast(top))
    seq, number = F.coalesce("_seq", F.lit(-1)), F.col("_top") + 2 * F.col("query_id")
    pair = F.array(
        F.struct((seq + 1).alias("seq"), (number - 1).alias("msg_id"), F.lit("user").alias("role"), F.col("text").alias("text")),
        F.struct((seq + 2).alias("seq"), number.alias("msg_id"), F.lit("assistant").alias("role"), F.col("answer").alias("text")),
    )
    new = asked.select("conv_id", F.inline(pair))
    kinds = {f.name: f.dataType for f in messages.schema}
    log = conversation.append(messages, new.select(*(F.col(c).cast(kinds[c]).alias(c) for c in messages.columns)), settings.max_conversation_messages)
    used = memory.search(memories, prepared.questions, now_ms, settings.memory_top_k)
    kept = memory.touch(memories, used, now_ms)
    statements = models.extract_memories(asked.select("query_id", "text", "answer"), chat)
    return log, memory.evict(memory.upsert(kept, statements, now_ms), settings.memory_max_items)
