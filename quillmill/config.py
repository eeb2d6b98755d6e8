"""Settings of the engine: defaults, tolerant parsing, signature."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, fields, replace

# Fixed value: the constant of reciprocal-rank fusion, and texts per embedding call.
RRF_K, EMBED_BATCH = 60, 16
MODES, SCOPES = ("keyword", "vector", "hybrid"), ("wholeVault", "specificFolder")


@dataclass(frozen=True)
class Settings:
    """All parameters with their defaults; see :meth:`load` for validation."""

    knowledge_scope_mode: str = "wholeVault"
    knowledge_folder: str = ""
    chunk_size: int = 600
    chunk_overlap: int = 120
    keyword_search_top_k: int = 10
    vector_search_top_k: int = 10
    hybrid_search_top_k: int = 12
    rerank_top_k: int = 8
    context_top_k: int = 8
    answer_source_limit: int = 5
    generation_temperature: float = 0.2
    default_retrieval_mode: str = "hybrid"
    enable_query_rewrite: bool = True
    enable_vector_retrieval: bool = True
    enable_rerank: bool = True
    llm_base_url: str = "http://127.0.0.1:11434"
    chat_model: str = "gemma3:4b"
    embedding_model: str = "embeddinggemma"
    rerank_base_url: str = ""
    rerank_model: str = ""
    enable_long_term_memory: bool = True
    memory_top_k: int = 4
    memory_max_items: int = 150
    max_conversation_messages: int = 60
    enable_auto_index_sync: bool = True
    auto_index_debounce_ms: int = 15_000
    auto_index_max_wait_ms: int = 120_000
    auto_index_file_threshold: int = 8

    @staticmethod
    def load(saved: dict | None = None) -> Settings:
        """Defaults overlaid with saved values; values that don't parse fall back to the default."""
        base, known = Settings(), {f.name: f for f in fields(Settings)}
        out = {}
        for key, value in (saved or {}).items():
            if key not in known:
                continue
            default = getattr(base, key)
            if isinstance(default, bool):
                out[key] = bool(value)
            elif isinstance(default, int):
                out[key] = non_negative_int(value, default) if key == "chunk_overlap" else positive_int(value, default)
            elif isinstance(default, float):
                out[key] = temperature(value, default)
            else:
                out[key] = str(value).strip() or default
        if out.get("knowledge_scope_mode", SCOPES[0]) not in SCOPES:
            out["knowledge_scope_mode"] = base.knowledge_scope_mode
        if out.get("default_retrieval_mode", "hybrid") not in MODES:
            out["default_retrieval_mode"] = base.default_retrieval_mode
        if "knowledge_folder" in out:
            out["knowledge_folder"] = normal_folder(out["knowledge_folder"])
        return replace(base, **out)

    def save(self) -> dict:
        return asdict(self)

    def signature(self) -> str:
        """What an index depends on: scope, folder, sizes."""
        keys = ("knowledge_scope_mode", "knowledge_folder", "chunk_size", "chunk_overlap")
        return json.dumps({k: getattr(self, k) for k in keys}, separators=(",", ":"))

    def effective_mode(self, has_vectors: bool) -> str:
        """Keyword stays keyword; without vectors everything becomes keyword."""
        if self.default_retrieval_mode == "keyword" or not self.enable_vector_retrieval or not has_vectors:
            return "keyword"
        return self.default_retrieval_mode

    def scope_description(self) -> str:
        if self.knowledge_scope_mode == "wholeVault":
            return "the whole vault"
        return f"folder {self.knowledge_folder}" if self.knowledge_folder else "no folder chosen"


def _leading_int(value) -> int | None:
    m = re.match(r"\s*([+-]?\d+)", str(value))
    return int(m[1]) if m else None


def positive_int(value, default: int) -> int:
    n = _leading_int(value)
    return n if n is not None and n > 0 else default


def non_negative_int(value, default: int) -> int:
    n = _leading_int(value)
    return n if n is not None and n >= 0 else default


def temperature(value, default: float) -> float:
    m = re.match(r"\s*([+-]?(?:\d+\.?\d*|\.\d+))", str(value))
    return float(m[1]) if m and float(m[1]) >= 0 else default


def normal_folder(path: str) -> str:
    return re.sub(r"/+", "/", path.strip().replace("\\", "/")).strip("/")
