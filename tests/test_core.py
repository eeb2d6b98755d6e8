import random
from datetime import datetime

from pyspark.sql import functions as F

from quillmill.config import Settings
from quillmill.functions import text as T
from quillmill.functions.vectors import dot, unit
from quillmill.operators import chunking, conversation, memory, orphans, rerank, search, sync


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col(F.col("x"))).first()[0]


def test_tokens(spark):
    assert one(spark, T.tokens, "RAG-Engine v2.0 a_b/c") == ["rag-engine", "v2.0", "a_b/c"]
    assert one(spark, T.tokens, "We are.") == ["we", "are."]
    assert one(spark, T.tokens, "Éaille") == ["aille"]
    assert one(spark, T.tokens, "x 中文字 y 一") == ["x", "y", "中", "文", "字", "中文", "文字", "一"]
    assert one(spark, T.tokens, "") == [] and one(spark, T.tokens, None) == [] and one(spark, T.tokens, "!?") == []


def test_white_space(spark):
    assert one(spark, T.trim_ws, "\t  a 　 b﻿\n") == "a 　 b"
    assert one(spark, T.trim_ws, "​a​") == "​a​"
    assert one(spark, T.phrase, " A \n B ") == "a b"
    assert one(spark, lambda c: T.excerpt(c, 3), "ab  cd") == "ab …"
    assert one(spark, lambda c: T.excerpt(c, 5), "ab  cd") == "ab cd"


def fnv(s):
    h = 2166136261
    raw = s.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i : i + 2], "big")) * 16777619) & 0xFFFFFFFF
    return f"{len(raw) // 2}:{h:x}"


def test_content_hash(spark):
    for s in ("", "abc", "中文", "a😀b"):
        assert one(spark, T.content_hash, s) == fnv(s)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0]), ([0.0], [1.0]), ([], [1.0])], "a array<double>, b array<double>")
    rows = df.select(unit(F.col("a")).alias("u"), dot(F.col("a"), F.col("b")).alias("d")).collect()
    assert rows[0].u == [0.6, 0.8] and rows[0].d == 3.0
    assert rows[1].u is None and rows[2].u is None and rows[2].d == 0.0


def model_sections(content):
    import re

    path, buffer, out = [], [], []

    def flush():
        text = "\n".join(buffer).strip()
        if text:
            out.append((list(path), text))
        buffer.clear()

    for line in re.split(r"\r?\n", content):
        m = re.match(r"^\s{0,3}(#{1,6})\s+(.*?)\s*$", line)
        if m:
            flush()
            level = len(m[1])
            path = (path + [None] * 6)[: level - 1] + [re.sub(r"\s*#+\s*$", "", m[2]).strip()]
        else:
            buffer.append(line)
    flush()
    return out


def test_sections(spark):
    rnd = random.Random(5)
    parts = ["# A", "## B ##", "### C", "text", "more text", "", "#tag", "    # no", "   ## D", "#### E"]
    notes = [(f"n{i}.md", "\n".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 12)))) for i in range(60)]
    notes += [("null.md", None), ("empty.md", ""), ("cr.md", "# X\r\na\r\nb")]
    got = {}
    for r in chunking.sections(spark.createDataFrame(notes, "path string, content string")).orderBy("path", "section_no").collect():
        got.setdefault(r.path, []).append((r.heading_path, r.text))
    for path, content in notes:
        assert got.get(path, []) == ([] if content is None else model_sections(content)), content


def model_pack(text, size, overlap):
    import re

    if len(text) <= size:
        return [text]
    out, cur = [], ""
    for p in (p.strip() for p in re.split(r"\n\s*\n", text)):
        if not p:
            continue
        if len(p) > size:
            if cur:
                out.append(cur)
            cur, step, i = "", max(1, size - overlap), 0
            while True:
                if p[i : i + size].strip():
                    out.append(p[i : i + size].strip())
                if i + size >= len(p):
                    break
                i += step
        elif len(cur + "\n\n" + p if cur else p) <= size:
            cur = cur + "\n\n" + p if cur else p
        else:
            out.append(cur)
            lead = cur[-overlap:].strip() if overlap > 0 else ""
            cur = lead + "\n\n" + p if lead else p
    return out + ([cur] if cur else [])


def test_pack(spark):
    rnd = random.Random(3)
    for size, overlap in ((20, 5), (12, 0), (10, 12)):
        texts = ["\n\n".join("ab c"[: rnd.randrange(1, 5)] * rnd.randrange(1, 9) for _ in range(rnd.randrange(1, 6))).strip() for _ in range(60)]
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        for r in df.select("t", chunking.pack(F.col("t"), size, overlap).alias("p")).collect():
            assert r.p == model_pack(r.t, size, overlap), (r.t, size, overlap)


def test_chunk_ids(spark):
    notes = spark.createDataFrame([("A/x.md", "top\n# H\nbody\n### Deep\nmore")], "path string, content string")
    rows = chunking.chunks(notes).orderBy("serial").collect()
    assert [r.id for r in rows] == ["A/x.md::__root__::0 ", "A/x.md::H::1 ", "A/x.md::Deep::2 "]
    assert rows[2].heading_path == ["H", None, "Deep"] and rows[2].searchable_text == "x\nH\n\nDeep\nmore"


def test_fusion_and_rerank(spark):
    kw = spark.createDataFrame([(1, "a", 3.0, 1), (1, "b", 2.0, 2)], "query_id int, chunk_id string, score double, pos int")
    vec = spark.createDataFrame([(1, "b", 0.9, 1), (1, "c", 0.5, 2)], "query_id int, chunk_id string, score double, pos int")
    rows = search.fused(kw, vec, 12).orderBy("pos").collect()
    assert [r.chunk_id for r in rows] == ["b", "a", "c"] and rows[0].channels == ["keyword", "vector"]
    assert abs(rows[0].score - (1 / 62 + 1 / 61)) < 1e-12
    assert [r.final_pos for r in rerank.off(search.fused(kw, vec), 2).collect()] == [1, 2]
    scores = spark.createDataFrame([(1, 2, 0, 5.0), (1, 0, 1, 1.0), (1, 0, 2, 2.0)], "query_id int, idx int, seq int, score double")
    first = rerank.remote(search.fused(kw, vec), scores).orderBy("final_pos").first()
    assert first.chunk_id == "c" and abs(first.final_score - (5 + 0.05 * first.score)) < 1e-12
    assert search.fused(kw.limit(0), vec.limit(0)).count() == 0


def test_trim_log_pins_the_greeting(spark):
    rows = [(1, i, i, "assistant" if i % 2 == 0 else "user", str(i)) for i in range(7)] + [(2, 0, 50, "user", None)]
    df = spark.createDataFrame(rows, "conv_id int, seq int, msg_id int, role string, text string")
    got = sorted(r.seq for r in conversation.trim(df, 3).filter("conv_id = 1").collect())
    assert got == [0, 5, 6]
    assert conversation.last_turns(df, 2).filter("conv_id = 2").first().context == "User: "


def test_memory(spark):
    kind = "id string, text string, created_at long, updated_at long, last_accessed_at long"
    day = 86_400_000
    now = 100 * day
    df = spark.createDataFrame([("m1", "Likes Tea", now, now, now), ("m2", "old tea note", 0, 0, 0)], kind)
    q = spark.createDataFrame([(1, "likes tea"), (2, "")], "query_id int, text string")
    rows = memory.search(df, q, now).orderBy("pos").collect()
    assert [(r.id, round(r.score, 6)) for r in rows] == [("m1", 3 + 1.2 + 1), ("m2", 0.6)]
    new = spark.createDataFrame([(1, "likes  TEA"), (2, "has a dog"), (3, "Has a Dog"), (4, " ")], "pos int, text string")
    after = {r.id: r for r in memory.upsert(df, new, now + 1).collect()}
    assert len(after) == 3 and after["m1"].text == "likes  TEA" and after["m1"].created_at == now
    assert [r.text for k, r in after.items() if k.startswith("mem_")] == ["Has a Dog"]
    assert [r.id for r in memory.evict(df, 1).collect()] == ["m1"]


def test_sync_equals_rebuild(spark):
    old = spark.createDataFrame([("a.md", "a0"), ("b.md", "b0"), ("c.md", "c0")], "file_path string, id string")
    new = spark.createDataFrame([("a.md", "a1"), ("c.md", "c0"), ("d.md", "d0")], "file_path string, id string")
    events = spark.createDataFrame(
        [("modify", "a.md", None), ("delete", "b.md", None), ("rename", "d.md", "x.md"), ("modify", "c.md", None), ("modify", "t.txt", None)],
        "kind string, path string, old_path string",
    )
    files = spark.createDataFrame([("a.md", "2"), ("c.md", "1"), ("d.md", "1")], "path string, content_hash string")
    was = spark.createDataFrame([("a.md", "1"), ("b.md", "1"), ("c.md", "1")], "path string, content_hash string")
    plan = sync.plan(sync.changed_paths(events), files, was)
    assert {r.path: r.action for r in plan.collect()} == {"a.md": "index", "b.md": "delete", "c.md": "skip", "d.md": "index", "x.md": "delete"}
    got = sorted(r.id for r in sync.apply(old, new, plan).collect())
    assert got == sorted(r.id for r in new.collect())


def test_settings():
    s = Settings.load({"chunk_size": "12abc", "chunk_overlap": -1, "default_retrieval_mode": "x", "knowledge_folder": "/a//b/", "other": 1})
    assert (s.chunk_size, s.chunk_overlap, s.default_retrieval_mode, s.knowledge_folder) == (12, 120, "hybrid", "a/b")
    assert s.effective_mode(False) == "keyword" and s.effective_mode(True) == "hybrid"
    assert Settings().signature() != s.signature()


def test_orphans(spark):
    t = [datetime(2025, m, 1) for m in range(1, 10)]
    parents = spark.createDataFrame([("a ", t[2]), ("a", t[4]), ("b", t[0]), ("late", t[5]), (None, t[0])], "key string, loaded_at timestamp_ntz")
    gone = spark.createDataFrame([("b ", t[3]), ("a", t[3]), ("z", None), (None, t[0])], "key string, removed_at timestamp_ntz")
    refs = spark.createDataFrame(
        [("a", t[3]), ("b", t[3]), ("b", t[3]), ("x", None), ("late ", t[1]), ("late", None), ("z", t[0]), (" ", t[0]), (None, t[0])],
        "key string, at timestamp_ntz",
    )
    rows = orphans.orphan_references({"refs": refs}, parents, gone).collect()
    got = sorted((r.key, r.period, r.kind, r.n_refs) for r in rows)
    assert got == [("b", "2025-04", "deleted", 2), ("late", "2025-02", "late", 1), ("x", "unknown", "missing", 1), ("z", "2025-01", "deleted", 1)]
    assert orphans.orphan_references({"refs": refs.limit(0)}, parents, gone).count() == 0


def test_orphans_hot_key(spark):
    hot = spark.range(20000).select(F.lit("hot").alias("key"), F.lit(datetime(2025, 1, 1)).cast("timestamp_ntz").alias("at"))
    none = spark.createDataFrame([], "key string, loaded_at timestamp_ntz")
    gone = spark.createDataFrame([], "key string, removed_at timestamp_ntz")
    rows = orphans.orphan_references({"refs": hot}, none, gone).collect()
    assert [(r.key, r.kind, r.n_refs) for r in rows] == [("hot", "missing", 20000)]


def test_entry_queries_without_the_optional_subpackage():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"r12_answer_sources", "p6_found"} <= names and set(entry.oracle_sql()) <= names


# ---- the composed way of a question


def _fakes():
    """Models for tests; classes of a function travel to the workers by value."""

    class _Broken:
        def chat(self, messages, temperature, as_json=False):
            raise OSError("down")

        def rerank(self, query, documents):
            raise OSError("down")

    class _Echo:
        def chat(self, messages, temperature, as_json=False):
            if not as_json:
                return "said: " + str("Context:" in messages[1]["content"])
            return '{"rewritten_query": "lamp oil", "memories": ["Likes lamps", " "]}'

        def rerank(self, query, documents):
            return [{"idx": i, "score": float("lamp" in d)} for i, d in enumerate(documents)]

    return _Echo(), _Broken()


def _vault(spark):
    from quillmill.operators import index
    from quillmill.operators.pipeline import Index
    from quillmill.sources.models import HashEmbedder, embed_chunks

    rows = [
        ("a::1", "a.md", ["Lamps", None], "Lamps", "the lamp needs oil", "a\nLamps\nthe lamp needs oil", 0), ("b::1", "b.md", [], None, "a map of the garden", "b\na map of the garden", 0),
        ("b::2", "b.md", [""], "", "the garden wall", "b\nthe garden wall", 1), ("c::1", "c.md", None, None, None, None, 0),
    ]
    chunks = spark.createDataFrame(rows, "id string, file_path string, heading_path array<string>, primary_heading string, text string, searchable_text string, serial int")
    return Index(chunks, index.postings(chunks), embed_chunks(chunks.filter("text is not null"), HashEmbedder()))


def test_prepare_and_answer(spark):
    from quillmill.config import Settings
    from quillmill.operators import pipeline
    from quillmill.sources.models import HashEmbedder

    vault = _vault(spark)
    echo, broken = _fakes()
    asked = spark.createDataFrame([(1, 7, "the garden"), (2, 8, "zzz"), (3, 7, "")], "query_id int, conv_id int, text string")
    talk = spark.createDataFrame([(7, 1, 1, "user", "hello there"), (7, 2, 2, "assistant", "hi")], "conv_id int, seq int, msg_id int, role string, text string")
    notes = spark.createDataFrame([("m", "garden  plans", 0, 0, 0)], "id string, text string, created_at long, updated_at long, last_accessed_at long")
    made = pipeline.prepare(asked, pipeline.Index(vault.chunks, vault.postings), messages=talk, memories=notes)
    assert made.mode == "keyword"
    got = {r.query_id: r for r in made.candidates.filter("pos = 1").collect()}
    assert set(got) == {1} and got[1].chunk_id.startswith("b") and made.sources.filter("query_id = 1").count() == 3
    user = made.prompts.first().user
    assert "User: hello there" in user and "- garden plans" in user and "Question: the garden" in user
    for chat, by in ((echo, True), (broken, False), (None, False)):
        out = {r.query_id: r for r in pipeline.answers(made, chat).collect()}
        assert out[1].by_model is by and not out[2].by_model and "Nothing relevant" in out[2].answer
        assert ("said: True" if by else "b.md") in out[1].answer
    log, kept = pipeline.turn(asked.filter("query_id = 1"), talk, made, pipeline.answers(made, echo).filter("query_id = 1"), notes, echo, 99)
    assert [(r.seq, r.role) for r in log.orderBy("seq").collect()] == [(1, "user"), (2, "assistant"), (3, "user"), (4, "assistant")]
    assert {r.text: r.last_accessed_at for r in kept.collect()} == {"garden  plans": 99, "Likes lamps": 99}
    # rewriting, vectors and an outside reranker; where the last fails, the heuristic
    hybrid = pipeline.prepare(asked, vault, embedder=HashEmbedder(), chat=echo, reranker=echo)
    assert hybrid.mode == "hybrid" and hybrid.reranked.filter("query_id = 1 and final_pos = 1").first().chunk_id == "a::1"
    assert "Searched for: lamp oil" in hybrid.prompts.filter("query_id = 1").first().user
    down = pipeline.prepare(asked, vault, embedder=HashEmbedder(), reranker=broken)
    own = pipeline.prepare(asked, vault, embedder=HashEmbedder())
    assert {(r.query_id, r.chunk_id, r.final_pos) for r in down.reranked.collect()} == {(r.query_id, r.chunk_id, r.final_pos) for r in own.reranked.collect()}
    empty = pipeline.Index(vault.chunks.limit(0), vault.postings.limit(0))
    assert not empty.ready("keyword")["ready"] and vault.ready("hybrid")["ready"]
    assert pipeline.answers(pipeline.prepare(asked, empty, settings=Settings(enable_rerank=False)), None).count() == 3


def test_null_and_empty_headings_are_two_sources(spark):
    from quillmill.operators import answer

    vault = _vault(spark)
    ranked = spark.createDataFrame([(1, "b::1", 1), (1, "b::2", 2), (1, "a::1", 3)], "query_id int, chunk_id string, final_pos int")
    assert [r.display_link for r in answer.sources(ranked, vault.chunks).orderBy("n").collect()] == ["[[b.md]]", "[[b.md]]", "[[a.md#Lamps]]"]


def test_vector_sync_and_upsert(spark):
    from quillmill.operators import sync
    from quillmill.sources.models import HashEmbedder, embed_chunks

    vault = _vault(spark)
    had = spark.createDataFrame([(" b::1", [1.0]), ("gone", [2.0]), (None, [3.0])], "chunk_id string, vector array<double>")
    plan = sync.vector_plan(vault.chunks, had)
    assert {(r.chunk_id, r.action) for r in plan.collect()} == {("a::1", "embed"), ("b::2", "embed"), ("c::1", "embed"), ("gone", "remove")}
    after = sync.sync_vectors(vault.chunks, had.filter("chunk_id is not null"), plan, lambda c: embed_chunks(c, HashEmbedder()))
    assert {r.chunk_id: len(r.vector) for r in after.collect()} == {"b::1": 1, "a::1": 64, "b::2": 64, "c::1": 64}
    new = spark.createDataFrame([("x", 1, "old"), ("x", 2, "new"), ("y", 1, None)], "chunk_id string, at int, v string")
    old = spark.createDataFrame([("x", 0, "was"), ("z", 0, "kept")], "chunk_id string, at int, v string")
    assert {(r.chunk_id, r.v) for r in sync.upsert(old, new, order="at").collect()} == {("x", "new"), ("y", None), ("z", "kept")}
