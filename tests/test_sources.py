from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillmill.config import Settings
from quillmill.operators import chunking, index
from quillmill.sources import models
from quillmill.sources.notes import Snapshot, read_notes
from quillmill.streaming import changes


def test_notes_and_snapshot(spark, tmp_path):
    root = tmp_path / "vault"
    (root / "A b").mkdir(parents=True)
    (root / "A b" / "x+1.MD").write_text("# H\nbody", encoding="utf-8")
    (root / "top.md").write_text("top", encoding="utf-8")
    (root / "no.txt").write_text("no", encoding="utf-8")
    notes = read_notes(spark, str(root))
    assert {r.path: r.content for r in notes.collect()} == {"A b/x+1.MD": "# H\nbody", "top.md": "top"}
    scoped = Settings.load({"knowledge_scope_mode": "specificFolder", "knowledge_folder": "A b/"})
    assert [r.path for r in read_notes(spark, str(root), scoped).collect()] == ["A b/x+1.MD"]
    assert read_notes(spark, str(root), Settings.load({"knowledge_scope_mode": "specificFolder"})).count() == 0

    chunks = chunking.chunks(notes)
    store = Snapshot(spark, str(tmp_path / "state"))
    assert store.load(Settings()) is None
    tables = {"chunks": chunks, "postings": index.postings(chunks), "embeddings": models.embed_chunks(chunks, models.HashEmbedder(8))}
    assert store.save(tables, Settings()) == 1 and store.save(tables, Settings()) == 2
    assert set(store.load(Settings())) == {"chunks", "postings", "embeddings"}
    assert store.load(Settings())["chunks"].count() == 2
    assert set(store.load(Settings.load({"embedding_model": "other"}))) == {"chunks", "postings"}
    assert store.load(Settings.load({"chunk_size": 5})) is None
    (tmp_path / "state" / "manifest.json").write_text("{", encoding="utf-8")
    (tmp_path / "state" / ".manifest.json.crc").unlink(missing_ok=True)
    assert store.manifest() is None


def test_model_replies():
    assert models.rewritten_query('{"rewritten_query": " b "}', "a") == ("b", True)
    for raw in (None, "", "x", "[]", '{"rewritten_query": 1}', '{"rewritten_query": " "}'):
        assert models.rewritten_query(raw, "a") == ("a", False)
    assert models.memory_statements('{"memories": [" x ", 1, "", null]}') == ["x"]
    assert models.memory_statements('{"memories": 3}') == [] and models.memory_statements("no") == []
    assert list(models.pieces([b'{"message":{"content":"a"}}\n{"mess', b'age":{"content":"b"}}', b"\n\n"])) == ["a", "b"]
    assert models.join_url("http://a/", "/b") == "http://a/b"
    assert models.HttpReranker("http://a/v1/rerank", "m").url == "http://a/v1/rerank"

    class Broken:
        def chat(self, *_):
            raise OSError

    assert models.generate(Broken(), "s", "u", 0.2, "fallback") == "fallback"
    assert models.rewrite(Broken(), "q", "", "") == ("q", False) and models.rewrite(None, "q", "", "") == ("q", False)


def test_flush_triggers(spark):
    s = Settings()
    assert changes.flushes([(0, "a"), (15_000, "b"), (30_001, "c")], s) == [(30_000, ["a", "b"]), (45_001, ["c"])]
    steady = [(i * 10_000, "a") for i in range(14)]
    assert [t for t, _ in changes.flushes(steady, s)] == [120_000, 145_000]
    burst = [(i, f"f{i % 8}") for i in range(8)]
    assert changes.flushes(burst, s) == [(7, [f"f{i}" for i in range(8)])]
    start = datetime(2025, 1, 1)
    rows = [("s", "modify", "a.md", None, start), ("s", "rename", "b.md", "c.md", start + timedelta(seconds=5)), ("s", "modify", "x.txt", None, start), ("s", "modify", "d.md", None, start + timedelta(seconds=60))]
    df = spark.createDataFrame(rows, "scheduler string, kind string, path string, old_path string, at timestamp")
    got = changes.flush_groups(df).orderBy("flush_ms").collect()
    assert [sorted(r.paths) for r in got] == [["a.md", "b.md", "c.md"], ["d.md"]]
    assert sorted(r.paths for r in changes.quiet_flushes(df).collect()) == [["a.md", "b.md", "c.md"], ["d.md"]]


def test_stream_hands_over_paths(spark, tmp_path):
    src = str(tmp_path / "events")
    kind = "kind string, path string, old_path string, at timestamp"
    rows = [("modify", "a.md", None, datetime(2025, 1, 1)), ("modify", "a.md", None, datetime(2025, 1, 1)), ("rename", "b.md", "c.md", datetime(2025, 1, 1))]
    spark.createDataFrame(rows, kind).write.parquet(src)
    seen: list[str] = []
    query = changes.maintain(
        spark.readStream.schema(kind).parquet(src), lambda paths, _: seen.extend(r.path for r in paths.collect()), str(tmp_path / "cp"), once=True
    )
    query.awaitTermination(60)
    assert sorted(seen) == ["a.md", "b.md", "c.md"]
    assert changes.paths_of(spark.createDataFrame(rows, kind).filter(F.lit(False))).count() == 0


def test_staging_wants_a_shared_folder_on_a_cluster(spark, tmp_path):
    from types import SimpleNamespace

    from quillmill import runtime

    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: folder), sparkContext=SimpleNamespace(master=master))

    assert runtime.shared_dir(session("yarn", "hdfs:///x/")) == "hdfs:///x"
    with pytest.raises(RuntimeError):
        runtime.shared_dir(session("spark://host:7077", None))
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "a int, part int")
    staged = runtime.stage(rows, "test", partition_by="part")
    assert staged.filter("part = 1").count() == 2 and staged.columns == ["a", "part"]
    runtime.unstage(staged)
