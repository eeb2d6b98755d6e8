"""Near-duplicate records: a similarity join on word n-grams by vertical partitioning."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.runtime import ship, stage, unstage

WORDS, SIMILARITY, LEAST_WORDS = 3, 0.5, 40
# The frequency sketch that orders the n-grams has about a bucket for four n-grams of the collection, within these powers of two; it is
# broadcast, one byte for each bucket.
SKETCH_BITS = (16, 24)
# Records of up to so many n-grams are joined whole, larger ones cut into 6 fragments of the hash space, those of more than
# four times as many into 24, and so on. Each has a bitmap of so many bits. The tiers are the small records, the next size, and the others.
SMALL, BITMAP = 128, 256
TIERS = 3
# The heads are joined in so many fragments of the global order, one after the other.
HEAD_FRAGMENTS = 3
# The postings of an n-gram with more than so many are copied, and the probing rows dealt out to the copies.
HOT = 20_000
# Up to so many ids are broadcast to pick rows; beyond, the rows are shuffled.
BROADCAST_IDS = 200_000
# Fragments of the global order in which a surviving pair's overlap is completed.
FRAGMENTS = 4
# Copies up to so many are given pair by pair, unless told otherwise; of larger groups each copy is linked to the first.
EXPANDED = 50
# A posting's size (20 bits), place (20 bits) and cell (20 bits) share a number with two flags.
_BITS = 20
_WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
REMEMBERED = 500_000


def _mixed(x):
    """A finaliser of 64 bits, so that sums of words' hashes spread."""
    import numpy as np

    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingled(rows: DataFrame, words: int = WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """``key, id, check, n, grams``: the ``n`` hashed n-grams of each record, sorted and distinct; ``id, check`` hash the whole set.

    Words are the runs of letters and digits of the lower-cased text, a Han character is a word of its own. Null texts and those
    of fewer than ``least_words`` words (or than one n-gram has) give no row.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        memory: dict[str, int] = {}
        get, find, digest = memory.get, _WORD.findall, xxhash.xxh64_intdigest
        weights = _mixed(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                if len(memory) > REMEMBERED:
                    memory.clear()
                ids: list[int] = []
                lens = []
                for t in part.column(1).to_pylist():
                    found = find(t.lower()) if t else ()
                    if len(found) < max(least_words, words):
                        lens.append(0)
                        continue
                    for w in found:
                        h = get(w)
                        if h is None:
                            h = memory[w] = digest(w)
                        ids.append(h)
                    lens.append(len(found))
                n = np.array(lens)
                keep = np.flatnonzero(n)
                if not len(keep):
                    continue
                flat = np.array(ids, np.uint64)
                owner = np.repeat(np.arange(len(keep)), n[keep])
                grams = np.zeros(len(flat) - words + 1, np.uint64)
                for i in range(words):
                    grams += _mixed(flat[i : len(flat) - words + 1 + i] + np.uint64(i)) * weights[i]
                grams = _mixed(grams)
                inside = owner[: len(grams)] == owner[words - 1 :]
                g, o = grams[inside], owner[: len(grams)][inside]
                order = np.lexsort((g, o))
                g, o = g[order], o[order]
                new = np.ones(len(g), bool)
                new[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
                g, o = g[new], o[new]
                starts = np.searchsorted(o, np.arange(len(keep)))
                with np.errstate(over="ignore"):
                    whole = _mixed(np.add.reduceat(_mixed(g ^ np.uint64(0x9E3779B97F4A7C15)), starts))
                    check = _mixed(np.bitwise_xor.reduceat(_mixed(g + np.uint64(0x632BE59BD9B4E019)), starts))
                offsets = pa.array(np.append(starts, len(g)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(keep)),
                        pa.array(whole.view(np.int64)),
                        pa.array(check.view(np.int64)),
                        pa.array(np.diff(np.append(starts, len(g))).astype(np.int32)),
                        pa.ListArray.from_arrays(offsets, pa.array(g.view(np.int64))),
                    ],
                    ["key", "id", "check", "n", "grams"],
                )

    return rows.select("key", "text").mapInArrow(run, "key string, id bigint, check bigint, n int, grams array<bigint>")


class Sketch:
    """The global order of the n-grams: by the count of their bucket, on a logarithmic scale of 256 steps, then by hash."""

    def __init__(self, ranks, bits: int):
        self.ranks, self.bits = ranks, bits

    def rank(self, grams):
        import numpy as np

        return self.ranks[(grams >> np.uint64(64 - self.bits)).astype(np.int64)]

    def cuts(self, parts: int, share: float = 1.0) -> list[int]:
        """Ranks at which the rarer ``share`` of all occurrences falls into ``parts`` of about equal weight."""
        import numpy as np

        weight = np.bincount(self.ranks, weights=2.0 ** (self.ranks / 8.0) - 1, minlength=256).cumsum()
        return [int(np.searchsorted(weight, weight[-1] * share * i / parts)) for i in range(1, parts)]


def frequency_sketch(texts: DataFrame, bits: int | None = None) -> Sketch:
    """Counts of all n-grams of ``(n, grams)`` by hash bucket."""
    import math

    import numpy as np

    if bits is None:
        total = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        bits = max(SKETCH_BITS[0], min(SKETCH_BITS[1], math.ceil(math.log2(max(4, total) / 4))))
    bucket = F.shiftrightunsigned("gram", 64 - bits).cast("int")
    counted = texts.select(F.explode("grams").alias("gram")).groupBy(bucket.alias("b")).agg(F.count("*").alias("n"))
    # a level of each bucket comes to the driver, at most 2^24 of them
    level = F.least(F.lit(255), F.round(8 * F.log2(F.col("n") + 1))).cast("short")
    counts = counted.select("b", level.alias("level")).toArrow()
    ranks = np.zeros(1 << bits, np.uint8)
    ranks[counts.column("b").to_numpy()] = counts.column("level").to_numpy().astype(np.uint8)
    return Sketch(ranks, bits)


def _classes(tier: int, longest: int) -> list[tuple[int, int, int]]:
    """(over, up to, fragments) of a tier's size classes."""
    out, parts = [(0, SMALL, 1)], 6
    while out[-1][1] < max(longest, 4 * SMALL):
        out.append((out[-1][1], out[-1][1] * 4, parts))
        parts *= 4
    return (out[:1], out[1:2], out[2:])[tier]


def _size(side: str):
    return F.col(f"{side}.info").bitwiseAND(F.lit((1 << _BITS) - 1))


def _place(side: str):
    return F.shiftright(f"{side}.info", _BITS).bitwiseAND(F.lit((1 << _BITS) - 1))


def _cell(side: str):
    return F.shiftright(f"{side}.info", 2 * _BITS).bitwiseAND(F.lit((1 << _BITS) - 1))


def _flag(side: str, i: int):
    return F.shiftright(f"{side}.info", 3 * _BITS + i).bitwiseAND(F.lit(1)) == 1


def postings(texts: DataFrame, sketch: Sketch, t: float, tier: int, hot: int = HOT) -> DataFrame:
    """``gram, id, info, fragment, b0, b1...``: the head of each record, or of each of its cells, rare n-grams first.

    The head is long enough for the record as the larger of a pair: a similar pair shares an n-gram in it. The bitmap holds the
    parity of the n-grams by hash, from which a join row bounds a pair's overlap. Large records are cut into cells of the hash space: the overlaps
    of a pair in the cells sum to the pair's, so in one cell at least the similarity is reached, and each cell is
    a record of its own here. A record belongs to its size class (flag 0), and to the class below if a smaller partner may lie there.
    ``fragment`` is the part of the global order an n-gram lies in. N-grams that occur once can't join and are left out. Those with more than ``hot``
    postings have copies of these under salted names; flag 1 marks the copy with which a record probes.
    """
    cuts = sketch.cuts(HEAD_FRAGMENTS, t)  # a head holds the rarer part of its record
    shared = texts.sparkSession.sparkContext.broadcast(sketch)
    bits = BITMAP
    words = [f"b{i}" for i in range(bits // 64)]

    def heads_of(ids, lists, order_of, level: int, upto: int, parts: int):
        import numpy as np
        import pyarrow as pa

        whole = lists.value_lengths().to_numpy().astype(np.int64)
        g = lists.flatten().to_numpy().view(np.uint64)
        o = np.repeat(np.arange(len(whole)), whole) * parts + ((g >> np.uint64(8)) % np.uint64(parts)).astype(np.int64)
        rank = order_of.rank(g)
        order = np.lexsort((g, rank, o))
        g, o, rank = g[order], o[order], rank[order]
        n = np.bincount(o, minlength=len(whole) * parts)
        bit = ((g >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)
        parity = np.bincount(o * bits + bit, minlength=len(n) * bits).reshape(len(n), bits) & 1
        maps = np.packbits(parity.astype(np.uint8), axis=1).view(np.int64)
        pos = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
        head = n - np.ceil(n * t - 1e-9).astype(np.int64) + 1
        keep = np.flatnonzero((pos < head[o]) & (rank > 8))  # rank 8: one occurrence
        estimate = 2.0 ** (rank[keep] / 8.0) - 1
        salts = np.maximum(1, np.ceil(estimate / hot)).astype(np.int64)
        salt = np.zeros(len(keep), np.int64)
        if (salts > 1).any():
            salt = np.arange(salts.sum()) - np.repeat(np.cumsum(salts) - salts, salts)
            keep, salts = np.repeat(keep, salts), np.repeat(salts, salts)
        at = o[keep]
        row = at // parts
        mine = ids.to_numpy().view(np.uint64)[row]
        probes = salt == (_mixed(mine) % salts.astype(np.uint64)).astype(np.int64)
        info = (
            n[at] | (pos[keep] << _BITS) | ((at % parts) << (2 * _BITS))
            | ((whole[row] <= upto).astype(np.int64) << (3 * _BITS)) | (probes.astype(np.int64) << (3 * _BITS + 1))
        )
        name = g[keep] ^ np.uint64(level) ^ np.where(salt > 0, _mixed(salt.astype(np.uint64)), np.uint64(0))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(name.view(np.int64)),
                ids.take(pa.array(row)),
                pa.array(info),
                *(pa.array(maps[at, i]) for i in range(len(words))),
                pa.array(np.searchsorted(cuts, rank[keep], side="left").astype(np.int32)),
            ],
            ["gram", "id", "info", *words, "fragment"],
        )

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        order_of = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sizes = part.column(1).value_lengths().to_numpy()
                for level, (over, upto, parts) in enumerate(_classes(tier, int(sizes.max()))):
                    mine = np.flatnonzero((sizes > over) & (sizes * t <= upto))
                    for i in range(0, len(mine), max(1, 1024 // parts)):
                        rows = part.take(pa.array(mine[i : i + max(1, 1024 // parts)]))
                        yield heads_of(rows.column(0), rows.column(1), order_of, level, upto, parts)

    size = F.col("n")
    fits = (size * t <= SMALL, (size > SMALL) & (size * t <= 4 * SMALL), size > 4 * SMALL)[tier]
    return texts.filter(fits).select("id", "grams").mapInArrow(
        run, "gram bigint, id bigint, info bigint, " + ", ".join(f"{w} bigint" for w in words) + ", fragment int"
    )


def candidates(texts: DataFrame, sketch: Sketch, t: float, tier: int, hot: int = HOT) -> DataFrame:
    """``a, b`` (``a < b``): pairs whose partial overlaps, and whose sizes, places and bitmaps, allow the similarity.

    Vertical partitioning: the heads are joined fragment by fragment of the global order, each gives the partial overlaps of its
    pairs, and these are summed for each pair. Of the smaller of a pair only the shorter head counts that it needs. No pair that reaches the
    similarity is left out: each test bounds the overlap from above.
    """
    staged = stage(postings(texts, sketch, t, tier, hot), "heads", "zstd", "fragment")
    partial = [stage(_joined(staged, t, fragment), "partial") for fragment in range(HEAD_FRAGMENTS)]
    unstage(staged)
    summed = reduce(DataFrame.unionByName, partial).groupBy("a", "b", "cell").agg(F.sum("shared").alias("shared"), F.max("least").alias("least"))
    return summed.filter(F.col("shared") >= F.col("least")).select("a", "b")


def _joined(staged: DataFrame, t: float, fragment: int) -> DataFrame:
    """``a, b, cell, shared, least``: partial overlaps of the heads in one fragment, and how many the sum must be at least.

    Common n-grams outside the two heads lie behind the end of that head which ends first in the global order, so there are no more
    of them than the rest of that record.
    """
    heads = staged.filter(F.col("fragment") == fragment).drop("fragment")
    # both sides get the same filters (no row has a null), so that they share one exchange
    heads = heads.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in heads.columns]))
    heads = heads.repartition("gram")

    def short_head(n):
        return n - F.ceil(n * (2 * t / (1 + t)) - 1e-9) + 1

    # a filter on a generated column stays above the exchange, a plain one would make two of it
    own = heads.alias("h")
    probing = _flag("h", 1) & (_place("h") < short_head(_size("h")))
    left = own.select("h.*", F.explode_outer(F.array(probing)).alias("_short")).filter("_short")
    s, x = left.alias("s"), heads.alias("x")
    n_s, n_x = _size("s"), _size("x")
    need = (n_s + n_x) * (t / (1 + t)) - 1e-9
    differ = F.lit(0)
    for i in range(BITMAP // 64):
        differ = differ + F.bit_count(F.col(f"s.b{i}").bitwiseXOR(F.col(f"x.b{i}")))
    rows = s.join(
        x,
        (F.col("s.gram") == F.col("x.gram"))
        & (n_s <= n_x)
        & (n_s >= n_x * t)
        & (n_s - _place("s") >= need)
        & (n_x - _place("x") >= need)
        & ((n_s < n_x) | (F.col("s.id") < F.col("x.id")))
        & (F.col("s.id") != F.col("x.id"))
        & (_flag("s", 0) | _flag("x", 0))
        & (n_s + n_x - differ >= 2 * need),
    )
    rest = F.greatest(n_s - short_head(n_s), F.ceil(n_x * t - 1e-9) - 1)
    return (
        rows.select(
            F.least("s.id", "x.id").alias("a"), F.greatest("s.id", "x.id").alias("b"), _cell("x").cast("int").alias("cell"),
            F.greatest(F.lit(1), F.ceil(need) - rest).cast("int").alias("least"),
        )
        .groupBy("a", "b", "cell")
        .agg(F.count("*").cast("int").alias("shared"), F.max("least").alias("least"))
    )


def _pick(rows: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """A semi or anti join: by broadcast where the ids are few, counted first, else by shuffle."""
    return rows.join(F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids, on, how)


def fragment_overlaps(pairs: DataFrame, texts: DataFrame, sketch: Sketch, t: float) -> DataFrame:
    """``a, b, similarity`` of the pairs that reach ``t``.

    The global order is cut into fragments of about equal weight; the overlap of a pair is counted in each
    fragment on its own, and the counts are summed.
    """
    pivots = sketch.cuts(FRAGMENTS)
    shared = texts.sparkSession.sparkContext.broadcast((sketch, pivots))

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        counts, at = shared.value
        for batch in batches:
            lists = batch.column(1)
            n = lists.value_lengths().to_numpy().astype(np.int64)
            g = lists.flatten().to_numpy()
            frag = np.searchsorted(np.array(at), counts.rank(g.view(np.uint64)), side="left")
            o = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((frag, o))
            g, cell = g[order], (o * FRAGMENTS + frag)[order]
            sizes = np.bincount(cell, minlength=len(n) * FRAGMENTS)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            owner = np.repeat(np.arange(len(n)), FRAGMENTS)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(owner)),
                    pa.array(n[owner].astype(np.int32)),
                    pa.array(np.tile(np.arange(FRAGMENTS), len(n)).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(g)),
                ],
                ["id", "n", "fragment", "part"],
            )

    named = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    parts = (
        _pick(texts, named, "id", "left_semi")
        .select("id", "grams")
        .mapInArrow(cut, "id bigint, n int, fragment int, part array<bigint>")
    )
    a = parts.select(F.col("id").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("part").alias("part_a"))
    b = parts.select(F.col("id").alias("b"), F.col("n").alias("n_b"), "fragment", F.col("part").alias("part_b"))
    counted = pairs.join(a, "a").join(b, ["b", "fragment"])
    partial = F.size(F.array_intersect("part_a", "part_b"))
    summed = counted.groupBy("a", "b", "n_a", "n_b").agg(F.sum(partial).alias("overlap"))
    similarity = F.col("overlap") / (F.col("n_a") + F.col("n_b") - F.col("overlap"))
    return summed.select("a", "b", similarity.alias("similarity")).filter(F.col("similarity") >= t)


class NearDuplicates:
    """The similar pairs of a collection ``(key, text)``.

    Records with the same set of n-grams are one text, represented by its smallest key; the join is on texts. ``copies`` is
    ``id, key, first, n_copies``, a row for each key (repeated rows count once); ``pairs`` is ``a, b, similarity`` on text ids.
    """

    def __init__(self, rows: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS, hot: int = HOT):
        self.similarity = similarity
        ship(rows.sparkSession)
        grams = stage(shingled(rows, words, least_words).withColumn("row", F.monotonically_increasing_id()), "grams")
        keys = grams.groupBy("id", "check", "key").agg(F.min("row").alias("row"))
        firsts = keys.groupBy("id", "check").agg(F.min("key").alias("first"), F.count("*").alias("n_copies"), F.min("row").alias("_row"))
        self.copies = keys.join(firsts, ["id", "check"]).select("id", "key", "first", "n_copies")
        # one row for each text; the other rows are the few to name
        others = grams.select("id", "check", "row").join(firsts.select("id", "check", "_row"), ["id", "check"])
        spare = stage(others.filter("row <> _row").select("row"), "spare")
        self.texts = _pick(grams.select("row", "id", "n", "grams"), spare, "row", "left_anti").select("id", "n", "grams")
        sketch = frequency_sketch(self.texts)
        # one after the other, so that the shuffle files of those before are gone by then
        found = [candidates(self.texts, sketch, similarity, tier, hot) for tier in range(TIERS)]
        every = stage(reduce(DataFrame.unionByName, found).distinct(), "candidates")
        self.pairs = stage(fragment_overlaps(every, self.texts, sketch, similarity), "similar")
        unstage(every)

    def key_pairs(self, expanded: int | None = EXPANDED) -> DataFrame:
        """``a, b`` (``a < b``): pairs of keys, between similar texts and between copies.

        Of texts with up to ``expanded`` copies every copy is given; beyond, the first key stands for them and each copy is
        linked to it, so that no link between different texts is lost. With None every pair of every group is given, which grows with the square
        of the largest group.
        """
        few = F.col("n_copies") <= expanded if expanded is not None else F.lit(True)
        speak = self.copies.filter(few | (F.col("key") == F.col("first")))
        left = speak.select(F.col("id").alias("a"), F.col("key").alias("key_a"))
        right = speak.select(F.col("id").alias("b"), F.col("key").alias("key_b"))
        between = self.pairs.select("a", "b").join(left, "a").join(right, "b").select("key_a", "key_b")
        many = self.copies.filter(F.col("n_copies") > 1)
        small = many.filter(few)
        within = small.select("id", F.col("key").alias("key_a")).join(
            small.select("id", F.col("key").alias("key_b")), "id"
        ).select("key_a", "key_b")
        star = many.filter(~few).select(F.col("first").alias("key_a"), F.col("key").alias("key_b"))
        every = between.unionByName(within).unionByName(star).filter(F.col("key_a") != F.col("key_b"))
        return every.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).distinct()

    def groups(self) -> DataFrame:
        """``key, group, n_copies, n_links``: each key's group (its smallest first key), the copies of its text and the number of similar texts.

        Groups are the connected components of the similar pairs, found by passing on the smallest label along links, and from label to label, until
        none changes; each round is staged.
        """
        edges = self.pairs.select("a", "b").unionByName(self.pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        links = edges.groupBy("a").agg(F.count("*").alias("n_links")).withColumnRenamed("a", "id")
        labels = stage(links.select("id", F.col("id").alias("label")), "labels")
        while True:
            heard = edges.join(labels, edges["b"] == labels["id"]).select(F.col("a").alias("id"), "label")
            lowest = labels.unionByName(heard).groupBy("id").agg(F.min("label").alias("label"))
            jump = labels.select(F.col("id").alias("label"), F.col("label").alias("_next"))
            new = stage(
                lowest.join(jump, "label", "left").select("id", F.least("label", F.coalesce("_next", "label")).alias("label")),
                "labels",
            )
            changed = new.join(labels.withColumnRenamed("label", "_old"), "id").filter("label <> _old").limit(1).count()
            labels = new
            if not changed:
                break
        rows = self.copies.join(labels, "id", "left").join(links, "id", "left")
        # text ids are hashes: name each group by its smallest key
        label = F.coalesce("label", "id")
        names = rows.groupBy(label.alias("_label")).agg(F.min("first").alias("group"))
        return rows.withColumn("_label", label).join(names, "_label").select(
            "key", "group", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")
        )
