"""The most similar vectors of vectors: vantage-point trees in shards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import trim_ws
from quillmill.runtime import ship, stage, unstage

# The shards' vantage points are fitted on a sample of about so many vectors at most, picked by a hash; every vector is indexed.
SAMPLE_VECTORS = 262_144
# Vectors of a shard that are aimed at, and at most; a cell with more is dealt out to several shards.
SHARD_AIM, SHARD_MOST = 4_000, 12_000
# Queries of a shard that are aimed at: the vectors of a shard with more are copied, and the queries dealt out to the copies.
SHARD_QUERIES = 50_000
# Vantage points are broadcast: at most so many vectors.
MOST_CELLS = 65_536
LEAF = 128
# How far the triangle inequality is relaxed: 1 prunes only what can't hold a result, less prunes more.
RELAX = 0.3
# Sampled vectors against which a query's reach is bounded from above.
PROBES = 2_048
# Up to so many keys, counted first, are broadcast.
BROADCAST_KEYS = 200_000
# Similarities of 32-bit vectors are taken as equal within this.
EPSILON = 1e-6


def _small(df: DataFrame, most: int) -> DataFrame:
    """A staged table, to be broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def usable_vectors(
    vectors: DataFrame, key: str, vector: str, at: str, dim: int, most_broadcast: int = BROADCAST_KEYS
) -> DataFrame:
    """``key, vector`` with one vector for each key: that of its latest row, if it has ``dim`` elements (see :func:`unit_rows`).

    Keys compare without white space at their ends; null and blank ones are left out. A null time is the earliest; of rows with the same time the vector with the largest hash counts. Repeated rows may
    come out repeatedly. The vectors themselves aren't shuffled: keys with several rows are found on times and hashes.
    """
    time = F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(1 << 63)))
    rows = vectors.select(
        trim_ws(key).alias("key"), time.alias("_at"), F.col(vector).cast("array<double>").alias("vector")
    ).filter(F.col("key") != "")
    state = F.struct("_at", "_h")
    hashed = rows.withColumn("_h", F.xxhash64("vector"))
    ranges = hashed.groupBy("key").agg(F.max(state).alias("_last"), F.min(state).alias("_first"))
    several = stage(ranges.filter("_last <> _first").select("key", "_last"), "several")
    known = hashed.join(_small(several, most_broadcast), "key", "left")
    mine = F.col("_last").isNull() | (F.col("_last") == state)
    return known.filter(mine & (F.size("vector") == dim)).select("key", "vector")


def unit_rows(vectors: DataFrame) -> DataFrame:
    """``key, unit, mark``: vectors of one size at length one, as 32-bit floats in bytes, and a hash of these.

    Vectors with null, NaN or infinite elements, and such of zeros, give no row.
    """
    ship(vectors.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)  # a null is a NaN here
            largest = np.abs(x).max(axis=1)
            good = np.flatnonzero(np.isfinite(largest) & (largest > 0))
            x = x[good] / largest[good, None]  # no square is lost or too large
            x = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)
            offsets = pa.array(np.arange(len(good) + 1, dtype=np.int32) * (x.shape[1] * 4))
            unit = pa.Array.from_buffers(pa.binary(), len(good), [None, offsets.buffers()[1], pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(good)), unit], ["key", "unit"])

    rows = vectors.select("key", "vector").mapInArrow(run, "key string, unit binary")
    return rows.withColumn("mark", F.xxhash64("unit"))


def _matrix(column):
    import numpy as np

    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.float32).reshape(len(column), -1)


def _chord(sims):
    """Distances of unit vectors from their similarities."""
    import numpy as np

    return np.sqrt(np.maximum(0, 2 - 2 * sims))


@dataclass
class Cells:
    """Vantage points of the cells, over how many shards each is dealt, and how many copies each shard has for its queries."""

    points: object
    deals: object
    copies: object

    def rows_at_once(self) -> int:
        return max(16, min(2048, (1 << 22) // len(self.points)))

    def visits(self, x, reach, relax: float):
        """(own cell of each row, rows, cells): which cells rows must visit within their ``reach``.

        A result in another cell is beyond the middle plane between the two vantage points. By the triangle inequality that plane is at least
        ``(d_cell - d_own) / 2`` away, which rules out most cells; for the others its exact distance is taken.
        """
        import numpy as np

        sims = x @ self.points.T
        d = _chord(sims)
        own = sims.argmax(axis=1)
        at = np.arange(len(x))
        slack = (reach * relax + EPSILON)[:, None]
        q, cell = np.nonzero(d - d[at, own][:, None] <= 2 * slack)
        apart = _chord(np.einsum("ij,ij->i", self.points[own[q]], self.points[cell]))
        plane = (sims[q, own[q]] - sims[q, cell]) / np.maximum(apart, 1e-6)
        keep = (plane <= slack[q, 0]) | (cell == own[q])
        return own, q[keep], cell[keep]


def picked(units: DataFrame, n: int, most: int):
    """About ``most`` unit vectors, by a hash threshold on the key, as a matrix; all of them if there are no more."""
    import numpy as np

    of = 1 << 40
    share = F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(of)) < F.lit(int(of * min(1.0, most / max(1, n))))
    rows = units.filter(share).select("unit", F.xxhash64("key").alias("h")).toArrow()
    if not rows.num_rows:
        return np.zeros((0, 1), np.float32)
    # repeated rows once: they'd count as neighbours otherwise
    once = np.unique(rows.column("h").to_numpy(), return_index=True)[1]
    return _matrix(rows.column("unit").combine_chunks())[once]


def fit_cells(sample, n: int, n_queries: int, reach: float, relax: float, seed: int = 11) -> Cells:
    """Cells from a sample of the ``n`` vectors, one for ``SHARD_AIM`` of them.

    Vantage points start at sampled vectors, so they are dense where the vectors are, and move to the middle of what is nearest to them where
    that is cheap. How cells are dealt and copied follows from the sample, too; it changes the plan, not the result.
    """
    import numpy as np

    if not len(sample):
        return Cells(np.zeros((1, sample.shape[1]), np.float32), np.ones(1, np.int64), np.ones(1, np.int64))
    rng = np.random.default_rng(seed)
    count = int(min(max(1, round(n / SHARD_AIM)), MOST_CELLS, max(1, len(sample) // 4)))
    points = sample[rng.choice(len(sample), count, replace=False)].astype(np.float32)
    for _ in range(8 if count * len(sample) <= 1 << 27 else 0):
        near = np.concatenate([(sample[i : i + 4096] @ points.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(points)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        points = np.where(norms > 1e-6, sums / np.maximum(norms, 1e-6), points).astype(np.float32)
    cells = Cells(points, np.ones(count, np.int64), np.ones(count, np.int64))
    held, asked = np.zeros(count), np.zeros(count)
    step = cells.rows_at_once()
    for i in range(0, len(sample), step):
        part = sample[i : i + step]
        own, _, cell = cells.visits(part, np.full(len(part), reach, np.float32), relax)
        held += np.bincount(own, minlength=count)
        asked += np.bincount(cell, minlength=count)
    cells.deals = np.maximum(1, np.ceil(held / len(sample) * n / SHARD_MOST)).astype(np.int64)
    cells.copies = np.maximum(1, np.ceil(asked / len(sample) * n_queries / SHARD_QUERIES)).astype(np.int64)
    return cells


class VantageTree:
    """A vantage-point tree over the rows of a matrix of unit vectors, searched by many queries at once."""

    def __init__(self, x, leaf: int = LEAF, seed: int = 3):
        import numpy as np

        self.np, self.x, self.leaf, self.rng = np, x, leaf, np.random.default_rng(seed)
        self.root = self._build(np.arange(len(x)))

    def _build(self, rows):
        np = self.np
        if len(rows) <= self.leaf:
            return rows
        # of a few candidates the point from which distances differ most
        tries = self.rng.choice(rows, min(8, len(rows)), replace=False)
        probe = self.x[rows[:: max(1, len(rows) // 256)]]
        point = self.x[tries[np.argmax((probe @ self.x[tries].T).std(axis=0))]]
        d = _chord(self.x[rows] @ point)
        mid = float(np.median(d))
        inner = d <= mid
        if inner.all() or not inner.any():
            return rows  # all at one distance: repeated vectors
        return point, mid, self._build(rows[inner]), self._build(rows[~inner])

    def search(self, queries, own, k: int, reach, relax: float):
        """(queries, rows) of the ``k`` nearest rows within each query's ``reach``, but its own row, with all ties of the last."""
        np = self.np
        self.q, self.own, self.k, self.relax = queries, own, k, relax
        self.least = (1 - reach * reach / 2).astype(np.float32)
        self.sims = np.full((len(queries), k), -2.0, np.float32)
        self.reach = reach.astype(np.float32)
        self.found = []
        self._visit(self.root, np.arange(len(queries)))
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, rows, sims = (np.concatenate(x) for x in zip(*self.found, strict=True))
        keep = sims >= self.sims[q].min(axis=1) - EPSILON
        return q[keep], rows[keep]

    def _visit(self, node, qs):
        if not len(qs):
            return
        if not isinstance(node, tuple):
            self._leaf(node, qs)
            return
        point, mid, inner, outer = node
        d = _chord(self.q[qs] @ point)
        near = d <= mid
        self._visit(inner, qs[near])
        self._visit(outer, qs[~near])
        # the other side, unless the triangle inequality, relaxed, rules it out
        slack = self.reach[qs] * self.relax + EPSILON
        self._visit(outer, qs[near & (mid - d <= slack)])
        self._visit(inner, qs[~near & (d - mid <= slack)])

    def _leaf(self, rows, qs):
        np = self.np
        s = self.q[qs] @ self.x[rows].T
        s[self.own[qs][:, None] == rows[None, :]] = -3
        worst = np.maximum(self.sims[qs].min(axis=1), self.least[qs]) - np.float32(EPSILON)
        good = s >= worst[:, None]
        some = np.flatnonzero(good.any(axis=1))
        if not len(some):
            return
        good, s, q = good[some], s[some], qs[some]
        i, j = np.nonzero(good)
        self.found.append((q[i], rows[j], s[i, j]))
        both = np.concatenate([self.sims[q], np.where(good, s, np.float32(-2))], axis=1)
        self.sims[q] = -np.partition(-both, self.k - 1, axis=1)[:, : self.k]
        self.reach[q] = np.minimum(self.reach[q], _chord(self.sims[q].min(axis=1)))


def _with_limits(units: DataFrame, k: int, most_broadcast: int) -> tuple[DataFrame, int]:
    """``units`` with ``is_data``, and their number; of more than ``k + 1`` equal vectors those with the smallest keys are data.

    No other can be a result. Counted on hashes; only the largest key that is kept of each such group meets the rows.
    """
    counts = stage(units.groupBy("mark").agg(F.count("*").alias("n")), "marks")
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    many = counts.filter(F.col("n") > k + 1).select("mark")
    if not many.limit(1).count():
        return units.withColumn("is_data", F.lit(True)), n
    copies = units.select("mark", "key").join(_small(many, most_broadcast), "mark", "left_semi").distinct()
    place = F.row_number().over(Window.partitionBy("mark").orderBy("key"))
    last = copies.withColumn("_rn", place).filter(F.col("_rn") <= k + 1).groupBy("mark").agg(F.max("key").alias("_last"))
    known = units.join(_small(stage(last, "limits"), most_broadcast), "mark", "left")
    return known.withColumn("is_data", F.col("_last").isNull() | (F.col("key") <= F.col("_last"))).drop("_last"), n


def nearest(
    queries: DataFrame,
    units: DataFrame,
    k: int,
    min_similarity: float | None = None,
    relax: float = RELAX,
    most_broadcast: int = BROADCAST_KEYS,
) -> DataFrame:
    """``key, neighbour, similarity, rank``: the ``k`` most similar vectors of each query, but itself.

    ``queries`` and ``units`` are frames of :func:`unit_rows`, or one and the same. Every vector is indexed, in the shard of its nearest vantage
    point. A query goes to every shard that the triangle inequality doesn't rule out within ``relax`` times its reach, and there down a vantage-point tree
    with the same pruning. The reach is that of ``min_similarity``, or the distance of the query's ``k + 1``-th nearest sampled vector, which bounds
    that of its ``k``-th nearest of all from above: with ``relax=1`` the result is exact. Every query gets ``k`` results at least
    as near as its reach that the relaxed search meets; a query whose visits miss them is searched again with ``relax=1``. Ties go to the
    smaller key. Repeated rows count once. Empty inputs give an empty result.
    """
    import numpy as np

    spark = units.sparkSession
    same = queries is units
    data, n = _with_limits(units, k, most_broadcast)
    if not n:
        return spark.createDataFrame([], "key string, neighbour string, similarity double, rank int")
    n_queries = n if same else queries.count()
    wanted = max(20_000, min(SAMPLE_VECTORS, 8 * n // SHARD_AIM))
    sample = picked(data.filter("is_data"), n, wanted)
    probes = sample[:PROBES] if min_similarity is None else None
    usual = float((2 - 2 * min_similarity) ** 0.5) if min_similarity is not None else 1.0
    if probes is not None and len(probes) > k:
        sims = probes[:256] @ probes.T
        usual = float(_chord(-np.partition(-sims, k, axis=1)[:, k]).mean())
    cells = fit_cells(sample, n, n_queries, usual, relax)

    cols = ["key", "unit", "mark"]
    if same:
        both = data.select(*cols, "is_data", F.lit(True).alias("is_query"))
    else:
        both = data.filter("is_data").select(*cols, "is_data", F.lit(False).alias("is_query"))
        both = both.unionByName(queries.select(*cols, F.lit(False).alias("is_data"), F.lit(True).alias("is_query")))
    hits = _searched(spark, both, cells, probes, k, min_similarity, relax)
    best = Window.partitionBy("key").orderBy(F.col("similarity").desc(), "neighbour")
    top = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    if min_similarity is not None or relax >= 1:
        return top
    # what a relaxed search left short of k, searched once more without relaxing
    top = stage(top, "nearest")
    full = top.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= min(k, max(0, n - 1))).select("key")
    short = stage(queries.select(*cols).join(full, "key", "left_anti"), "short")
    if not short.limit(1).count():
        unstage(short)
        return top
    again = data.filter("is_data").select(*cols, "is_data", F.lit(False).alias("is_query"))
    again = again.unionByName(short.select(*cols, F.lit(False).alias("is_data"), F.lit(True).alias("is_query")))
    more = _searched(spark, again, cells, probes, k, None, 1.0)
    more = more.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return top.join(short.select("key").distinct(), "key", "left_anti").unionByName(more)


def _searched(spark, both: DataFrame, cells: Cells, probes, k: int, min_similarity: float | None, relax: float) -> DataFrame:
    """``key, neighbour, similarity``: each query's ``k`` nearest, with ties, of every shard it visits."""
    shared = spark.sparkContext.broadcast((cells, probes))  # at most MOST_CELLS and PROBES vectors
    radius = 2.0 if min_similarity is None else float((2 - 2 * min_similarity) ** 0.5)

    def reach_of(x):
        import numpy as np

        out = np.full(len(x), radius, np.float32)
        near = shared.value[1]
        if near is None or len(near) <= k:
            return out
        sims = x @ near.T
        return np.minimum(out, _chord(-np.partition(-sims, k, axis=1)[:, k]).astype(np.float32) + np.float32(EPSILON))

    def route(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        c = shared.value[0]
        first = np.concatenate([[0], np.cumsum(c.deals * c.copies)])
        step = c.rows_at_once()
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                x = _matrix(part.column(1))
                mark = part.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
                is_data = part.column(3).to_numpy(zero_copy_only=False).astype(bool)
                is_query = part.column(4).to_numpy(zero_copy_only=False).astype(bool)
                own, q, cell = c.visits(x, reach_of(x), relax)
                asked = is_query[q]
                q, cell = q[asked], cell[asked]

                def spread(rows, reps, start, stride):
                    """Each row so often, at places that go up by its stride."""
                    turn = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                    return np.repeat(rows, reps), np.repeat(start, reps) + turn * np.repeat(stride, reps)

                mine = np.flatnonzero(is_data)
                home = own[mine]
                deal = (mark[mine] % c.deals[home].astype(np.uint64)).astype(np.int64)
                one = np.ones(len(mine), np.int64)
                d_rows, d_shards = spread(mine, c.copies[home], first[home] + deal * c.copies[home], one)
                copy = ((mark[q] >> np.uint64(32)) % c.copies[cell].astype(np.uint64)).astype(np.int64)
                q_rows, q_shards = spread(q, c.deals[cell], first[cell] + copy, c.copies[cell])
                # a row that is both in one shard travels once
                code = np.concatenate([d_rows, q_rows]) * first[-1] + np.concatenate([d_shards, q_shards])
                code, inverse = np.unique(code, return_inverse=True)
                flag = np.zeros(len(code), np.int8)
                flag[inverse[: len(d_rows)]] |= 1
                flag[inverse[len(d_rows) :]] |= 2
                take = pa.array(code // first[-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((code % first[-1]).astype(np.int32)),
                        part.column(0).take(take),
                        part.column(1).take(take),
                        pa.array(flag),
                    ],
                    ["shard", "key", "unit", "flag"],
                )

    def search(table):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("key", pa.string()), ("neighbour", pa.string()), ("similarity", pa.float64())])
        flag = table.column("flag").to_numpy()
        keys = np.array(table.column("key").to_pylist(), object)
        rows, asks = np.flatnonzero(flag & 1), np.flatnonzero(flag & 2)
        if not len(rows) or not len(asks):
            return schema.empty_table()
        # repeated rows once
        rows = rows[np.unique(keys[rows], return_index=True)[1]]
        asks = asks[np.unique(keys[asks], return_index=True)[1]]
        x = _matrix(table.column("unit").combine_chunks())
        place = {key: i for i, key in enumerate(keys[rows])}
        own = np.array([place.get(key, -1) for key in keys[asks]])
        tree = VantageTree(x[rows])
        q, j = tree.search(x[asks], own, k, reach_of(x[asks]), relax)
        a, b = x[asks[q]].astype(np.float64), x[rows[j]].astype(np.float64)
        sims = np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
        return pa.table([pa.array(keys[asks[q]], pa.string()), pa.array(keys[rows[j]], pa.string()), pa.array(sims)], schema=schema)

    routed = both.mapInArrow(route, "shard int, key string, unit binary, flag byte")
    found = routed.groupBy("shard").applyInArrow(search, "key string, neighbour string, similarity double")
    return found.filter(F.col("similarity") >= min_similarity) if min_similarity is not None else found


def mutual_pairs(units: DataFrame, k: int, min_similarity: float, relax: float = RELAX) -> DataFrame:
    """``a, b`` (``a < b``): keys each among the ``k`` most similar of the other, at least ``min_similarity`` alike."""
    found = nearest(units, units, k, min_similarity, relax)
    pair = found.select(F.least("key", "neighbour").alias("a"), F.greatest("key", "neighbour").alias("b"))
    return pair.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n = 2").select("a", "b")
