"""Index maintenance from a stream of file changes.

Events are ``(kind, path, old_path, at)``. Flushes come after a quiet gap, after the longest wait since the first
pending event, or as soon as enough distinct files are pending.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.config import Settings
from quillmill.functions.text import is_markdown, trim_ws


def paths_of(events: DataFrame) -> DataFrame:
    """``path, at``: the Markdown paths that events touch; a rename touches two."""
    both = events.select("at", F.explode(F.array("path", "old_path")).alias("path")).withColumn("path", trim_ws("path"))
    return both.filter((F.col("path") != "") & is_markdown("path"))


def quiet_flushes(events: DataFrame, settings: Settings | None = None, late: str = "10 minutes") -> DataFrame:
    """``start, end, paths``: the changes between quiet gaps, by event time; runs as a batch or a stream.

    A gap equal to the debounce time still belongs to the same flush.
    """
    settings = settings or Settings()
    rows = paths_of(events)
    if rows.isStreaming:
        rows = rows.withWatermark("at", late)
    gap = F.session_window("at", f"{settings.auto_index_debounce_ms} milliseconds")
    return rows.groupBy(gap.alias("w")).agg(F.sort_array(F.collect_set("path")).alias("paths")).select("w.start", "w.end", "paths")


def flushes(pending: list[tuple[int, str]], settings: Settings | None = None) -> list[tuple[int, list[str]]]:
    """``(time, paths)`` of the flushes of events ``(ms, path)`` in order: count, gap and longest wait.

    The three triggers of one scheduler's pending set, whose size the count trigger bounds.
    """
    s = settings or Settings()
    out: list[tuple[int, list[str]]] = []
    held: dict[str, None] = {}
    first = last = 0

    def due() -> int:
        return min(last + s.auto_index_debounce_ms, first + s.auto_index_max_wait_ms)

    for at, path in pending:
        if held and at > due():
            out.append((due(), list(held)))
            held = {}
        if not held:
            first = at
        held[path], last = None, at
        if len(held) >= s.auto_index_file_threshold:
            out.append((at, list(held)))
            held = {}
    if held:
        out.append((due(), list(held)))
    return out


def flush_groups(events: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``scheduler, flush_ms, paths`` of all three triggers, for events with a ``scheduler`` key and ``at``.

    Each scheduler's events are one ordered sequence by nature, so they are handled in order, scheduler by scheduler.
    """
    s = settings or Settings()

    def run(table):
        import pyarrow as pa

        rows = sorted(zip(table.column("ms").to_pylist(), table.column("path").to_pylist(), strict=True))
        found = flushes(rows, s)
        key = table.column("scheduler")[0].as_py()
        return pa.table(
            {"scheduler": [key] * len(found), "flush_ms": [t for t, _ in found], "paths": [p for _, p in found]},
            schema=pa.schema([("scheduler", pa.string()), ("flush_ms", pa.int64()), ("paths", pa.list_(pa.string()))]),
        )

    both = events.select("scheduler", F.unix_millis(F.col("at").cast("timestamp")).alias("ms"), F.explode(F.array("path", "old_path")).alias("path"))
    rows = both.withColumn("path", trim_ws("path")).filter((F.col("path") != "") & is_markdown("path"))
    return rows.groupBy("scheduler").applyInArrow(run, "scheduler string, flush_ms bigint, paths array<string>")


def maintain(events: DataFrame, apply_paths: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> Iterator:
    """Start a query that hands each micro-batch's distinct paths to ``apply_paths``; one batch runs at a time."""

    def flush(batch: DataFrame, batch_id: int) -> None:
        apply_paths(paths_of(batch).select("path").distinct(), batch_id)

    writer = events.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
