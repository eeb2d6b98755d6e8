"""Model calls behind small interfaces, with deterministic defaults that need no network."""

from __future__ import annotations

import json
import math
import urllib.request
import zlib
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.config import EMBED_BATCH


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Chat(Protocol):
    def chat(self, messages: list[dict], temperature: float, as_json: bool = False) -> str: ...


class Reranker(Protocol):
    def rerank(self, query: str, documents: list[str]) -> list[dict]: ...


def join_url(base: str, path: str) -> str:
    return f"{base.rstrip('/')}/{path.lstrip('/')}"


def post_json(url: str, body: dict, timeout: float = 60.0) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
        return json.loads(answer.read())


class HashEmbedder:
    """Deterministic vectors from hashed words; for tests and for running without a model."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % self.dim] += 1.0 if h & 0x10000 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


class HttpEmbedder:
    def __init__(self, base_url: str, model: str):
        self.base_url, self.model = base_url, model

    def embed(self, texts: list[str]) -> list[list[float]]:
        vectors = post_json(join_url(self.base_url, "/api/embed"), {"model": self.model, "input": texts}).get("embeddings") or []
        if not vectors:
            raise ValueError("the embedding service gave no vectors")
        return vectors


class HttpChat:
    def __init__(self, base_url: str, model: str):
        self.base_url, self.model = base_url, model

    def chat(self, messages: list[dict], temperature: float, as_json: bool = False) -> str:
        body = {"model": self.model, "messages": messages, "stream": False, "options": {"temperature": temperature}}
        if as_json:
            body["format"] = "json"
        return post_json(join_url(self.base_url, "/api/chat"), body)["message"]["content"]

    def stream(self, messages: list[dict], temperature: float) -> Iterator[str]:
        """Pieces of an answer as they come, a JSON document a line."""
        body = {"model": self.model, "messages": messages, "stream": True, "options": {"temperature": temperature}}
        request = urllib.request.Request(join_url(self.base_url, "/api/chat"), json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request) as answer:  # noqa: S310
            yield from pieces(answer)


def pieces(chunks) -> Iterator[str]:
    """Contents of newline-delimited JSON that arrives in chunks of any size; the last line may lack its end."""
    rest = b""
    for chunk in chunks:
        rest += chunk
        *lines, rest = rest.split(b"\n")
        for line in lines:
            yield from _piece(line)
    yield from _piece(rest)


def _piece(line: bytes) -> Iterator[str]:
    if line.strip():
        text = (json.loads(line).get("message") or {}).get("content")
        if text:
            yield text


class HttpReranker:
    def __init__(self, base_url: str, model: str):
        self.url = base_url if base_url.rstrip("/").endswith("/v1/rerank") else join_url(base_url, "/v1/rerank")
        self.model = model

    def rerank(self, query: str, documents: list[str]) -> list[dict]:
        results = post_json(self.url, {"model": self.model, "query": query, "documents": documents}).get("results") or []
        return [{"idx": r["index"], "score": r.get("relevance_score", r.get("score", 0.0))} for r in results]


def embed_chunks(chunks: DataFrame, embedder: Embedder, batch: int = EMBED_BATCH) -> DataFrame:
    """``chunk_id, vector`` of chunks by their searchable text, in calls of ``batch`` texts; an error fails the job."""

    def run(frames: Iterator) -> Iterator:
        import pyarrow as pa

        for b in frames:
            ids, texts = b.column(0), b.column(1).to_pylist()
            vectors: list[list[float] | None] = []
            for i in range(0, len(texts), batch):
                part = [t or "" for t in texts[i : i + batch]]
                got = embedder.embed(part)
                vectors += [got[j] if j < len(got) else None for j in range(len(part))]
            yield pa.RecordBatch.from_arrays([ids, pa.array(vectors, pa.list_(pa.float64()))], ["chunk_id", "vector"])

    rows = chunks.select(F.col("id").alias("chunk_id"), "searchable_text").mapInArrow(run, "chunk_id string, vector array<double>")
    return rows.filter(F.col("vector").isNotNull())


def rewritten_query(raw: str | None, original: str) -> tuple[str, bool]:
    """The query of a model's JSON reply, and whether it changed; anything malformed or blank gives the original."""
    try:
        text = json.loads(raw or "")["rewritten_query"].strip()
    except (ValueError, KeyError, TypeError, AttributeError):
        return original, False
    return (text, text != original) if text else (original, False)


def memory_statements(raw: str | None) -> list[str]:
    """The statements of a model's JSON reply: strings only, trimmed, not blank."""
    try:
        items = json.loads(raw or "")["memories"]
    except (ValueError, KeyError, TypeError):
        return []
    return [x.strip() for x in items if isinstance(x, str) and x.strip()] if isinstance(items, list) else []


def rewrite(chat: Chat | None, question: str, conversation: str, scope: str) -> tuple[str, bool]:
    """A query rewritten by a model; without one, or on any error, the original."""
    if chat is None:
        return question, False
    system = 'Rewrite the question as a self-contained search query. Reply as JSON: {"rewritten_query": "..."}'
    user = f"Scope: {scope}\nConversation:\n{conversation}\nQuestion: {question}"
    try:
        return rewritten_query(chat.chat([{"role": "system", "content": system}, {"role": "user", "content": user}], 0.0, True), question)
    except Exception:  # noqa: BLE001
        return question, False


def generate(chat: Chat | None, system: str, user: str, temperature: float, fallback: str) -> str:
    """A model's answer, or the fallback if there is no model, it fails or says nothing."""
    try:
        text = chat.chat([{"role": "system", "content": system}, {"role": "user", "content": user}], temperature) if chat else ""
    except Exception:  # noqa: BLE001
        text = ""
    return text.strip() or fallback


def extract_memories(turns: DataFrame, chat: Chat | None) -> DataFrame:
    """``pos, text``: what a model finds worth keeping in turns ``(query_id, text, answer)``; without one, or on an error, nothing."""

    def run(frames: Iterator) -> Iterator:
        import pyarrow as pa

        system = 'List lasting facts about the user from this turn. Reply as JSON: {"memories": ["..."]}'
        for b in frames:
            at, found = [], []
            for i, (question, said) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                try:
                    user = f"User: {question}\nAssistant: {said}"
                    raw = chat.chat([{"role": "system", "content": system}, {"role": "user", "content": user}], 0.0, True) if chat else ""
                except Exception:  # noqa: BLE001
                    raw = ""
                for x in memory_statements(raw):
                    at.append(i)
                    found.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(found, pa.string())], ["pos", "text"])

    kind = turns.schema["query_id"].dataType.simpleString()
    return turns.select("query_id", "text", "answer").mapInArrow(run, f"pos {kind}, text string")
