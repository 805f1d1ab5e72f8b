"""MinHash near-dedup with bottom-k sketches from one hash function.

A document is its set of distinct word shingles, held as 64-bit hashes. Documents with equal sets are one node.
A node's sketch is the K smallest hashes of its set. Inverted lists (hash -> nodes whose sketch retains it) give
candidates. The K smallest hashes of a pair's union are a sample of the union; those of them that both sets hold are in
both sketches. So two nodes of the wanted similarity share ``shared_at_least`` values of their sketches but for a chance
of ``CHANCE`` (sketches that hold whole sets share their part for certain). Then they share several of the rarest values of
both; only the rarest are listed, and common shingles drop out whatever their number.

Nodes of short lists meet in pairs, counted over the lists. Long lists with the same smallest node, the pivot, form
one group. The group's nodes first meet the pivot, and what is linked becomes one component. Then the sketches of
nodes of different components are compared, in blocks of about BLOCK nodes of like set size that any number of tasks may
share. Large components have blocks of their own; no two blocks of one component are compared, nor blocks whose set sizes
are too far apart. Only pairs that share enough leave the task; where these are many, the blocks' full sets are compared
in the task instead, and only links that connect components leave it. All other candidates pass the estimate from the
union's sketch and then the exact similarity of the full sets, which are computed again from the texts of the nodes
concerned. These are found by a Bloom filter sized by their number, so that texts aren't shuffled, or beyond its largest
size by a join. Hot keys of all joins (pivots, hubs, common values, repeated texts) are dealt over tasks.

A text without words is linked with nothing. A null text is one without words. A null id is never the smallest
unless a component has no other; rows with equal ids are told apart by their texts alone. An empty table gives an
empty result; other columns are ignored. No list, bucket or component has a cap. Similarities lie above 0 and up to 1.
"""

from __future__ import annotations

import math
import uuid
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, hot_keys, lean, scratch, stage, tuned
from .components import components
from .fingerprints import _mix

#: Retained hashes, similarity, nodes of a short list, nodes of a block.
K, SIMILARITY, SHORT, BLOCK = 48, 0.8, 6, 256
#: Rows with full sets that a task takes of a node in any case.
FULL_ROWS = 32
#: Chance to miss a pair of exactly the wanted similarity.
CHANCE = 1e-6
#: Pairs for each member beyond which a pair of blocks is compared by full sets where it is.
DENSE = 2
SLICE_ROWS = 500
#: Bits of a Bloom filter for each id, bits that an id sets, and words of 64 bits beyond which a join stands in (32 MB).
BLOOM_ROOM, BLOOM_BITS, BLOOM_WORDS = 16, 4, 1 << 22


def exactly(similarity: float) -> Fraction:
    """The similarity as the fraction that is meant."""
    if not 0 < similarity <= 1:
        raise ValueError("a similarity lies above 0 and up to 1")
    return Fraction(similarity).limit_denominator(10**6)


def shared_at_least(similarity: float) -> int:
    """Of K values drawn from a pair's union, how many both sets hold at least, but for a chance of CHANCE."""
    t, chance = float(similarity), 0.0
    for c in range(K + 1):
        chance += math.comb(K, c) * t**c * (1 - t) ** (K - c)
        if chance > CHANCE:
            return c
    return K


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 63-bit hashes of each text's shingles of ``width`` words (fewer words: all as one)."""
    lowered = pc.ascii_lower(pc.fill_null(texts, ""))
    cut = pc.ascii_split_whitespace(lowered)
    n = np.diff(cut.offsets.to_numpy())
    coded = cut.flatten().dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).astype(object)
    if not len(words):
        return [np.zeros(0, np.int64)] * len(n)
    codes, real = coded.indices.to_numpy(), np.array(words != "", bool)
    ids = _mix(pd.util.hash_array(words, categorize=False) + np.uint64(1))
    kept = real[codes]
    doc = np.repeat(np.arange(len(n)), n)[kept]
    h = ids[codes[kept]]
    n = np.bincount(doc, minlength=len(n))
    out = []
    for a, b in zip((np.cumsum(n) - n).tolist(), np.cumsum(n).tolist(), strict=True):
        own, size = h[a:b], min(width, b - a)
        if not size:
            out.append(np.zeros(0, np.int64))
            continue
        code = own[: len(own) - size + 1].copy()
        for k in range(1, size):
            code = _mix(code * np.uint64(0x9E3779B97F4A7C15) + own[k : len(code) + k])
        out.append(np.unique(_mix(code + np.uint64(size)) >> np.uint64(1)).view(np.int64))
    return out


def _key(s: np.ndarray) -> bytes:
    """128-bit hash of a set."""
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sketched(docs: DataFrame, width: int) -> DataFrame:
    @lean
    def run(batches):
        for b in batches:
            for a in range(0, len(b), SLICE_ROWS):
                sets = shingle_sets(b.column(1).slice(a, SLICE_ROWS), width)
                sketch = [s[:K] for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sketch])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sketch) if sketch else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, SLICE_ROWS), pa.array([_key(s) for s in sets]), pa.array([len(s) for s in sets], pa.int64()), lists], ["doc_id", "set_key", "n_shingles", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, set_key binary, n_shingles long, sketch array<long>")


def _bloom_cells(key, words: int) -> list:
    return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(words * 64)) for k in range(BLOOM_BITS)]


def _bloom(ids: DataFrame, words: int) -> np.ndarray:
    """The filter of the one column."""
    cells = ids.select(F.explode(F.array(*_bloom_cells(F.col(ids.columns[0]), words))).alias("cell"))
    filled = cells.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("cell").cast("int").bitwiseAND(F.lit(63)))).alias("bits"))
    out, found = np.zeros(words, np.uint64), filled.toArrow()
    out[found["word"].to_numpy().astype(np.int64)] = found["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return out


class _Sets:
    """Full sets of the nodes (node, set_key, id), as a table bucketed by set_key: joins with it move the other side only.

    The table lasts as long as the ``with`` block does.
    """

    def __init__(self, docs: DataFrame, chosen: DataFrame, width: int):
        self.spark, self.chosen, self.name = docs.sparkSession, chosen.select("node", "set_key"), f"sets_{uuid.uuid4().hex}"
        self.docs, self.ids, self.width = docs, chosen.select("id"), width

    def __enter__(self) -> _Sets:
        own = self._found().groupBy("set_key").agg(F.first("set").alias("set")).join(self.chosen.select("set_key"), "set_key", "left_semi")
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        try:
            own.write.bucketBy(n, "set_key").sortBy("set_key").saveAsTable(self.name)
        except BaseException:
            self.__exit__()
            raise
        self.table = self.spark.table(self.name)
        return self

    def __exit__(self, *_) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _found(self) -> DataFrame:
        """(set_key, set) of the texts whose id is chosen, and of some others."""
        words, width = 1 << max(10, (self.ids.count() * BLOOM_ROOM // 64).bit_length()), self.width
        bits = self.spark.sparkContext.broadcast(_bloom(self.ids, words)) if words <= BLOOM_WORDS else None

        @lean
        def run(batches):
            for b in batches:
                texts = b.column(0)
                if bits:
                    cells = np.stack([b.column(i + 1).to_numpy() for i in range(BLOOM_BITS)]).astype(np.uint64)
                    hit = (bits.value[(cells >> np.uint64(6)).astype(np.int64)] >> (cells & np.uint64(63)) & np.uint64(1)).all(0)
                    texts = texts.filter(pa.array(hit))
                for a in range(0, len(texts), SLICE_ROWS):
                    sets = shingle_sets(texts.slice(a, SLICE_ROWS), width)
                    yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["set_key", "set"])

        if bits:
            texts = self.docs.select("text", *_bloom_cells(F.col("doc_id"), words)).toDF("text", *(f"c{i}" for i in range(BLOOM_BITS)))
        else:
            texts = self.docs.join(self.ids.distinct(), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")
        return texts.mapInArrow(run, "set_key binary, set binary")

    def joined(self, rows: DataFrame, node: str, hot: DataFrame | None) -> DataFrame:
        """The rows, which have ``key_`` of the node, with ``set_`` of it."""
        key = f"key_{node}"
        sets = self.table.select(F.col("set_key").alias(key), F.col("set").alias(f"set_{node}"))
        if hot is None:
            return rows.join(sets, key)
        few = hot.join(self.chosen.select(F.col("node").alias(node), F.col("set_key").alias(key)), node).select(key, "parts")
        named = F.broadcast(few.select(key))  # bounded, see hot_keys
        cold = rows.join(named, key, "left_anti").join(sets, key)  # by the buckets
        return cold.unionByName(dealt_join(rows.join(named, key, "left_semi"), sets.join(named, key, "left_semi"), [key], few))

    def keyed(self, rows: DataFrame, node: str, hot: DataFrame | None) -> DataFrame:
        return dealt_join(rows, self.chosen.select(F.col("node").alias(node), F.col("set_key").alias(f"key_{node}")), [node], hot)


def _least_shared(size, similarity: float):
    """Sketch values that a set of a size shares with that of any partner, at least."""
    t = exactly(similarity)
    part = F.ceil((size * t.numerator) / t.denominator - 1e-9)
    whole = size <= K * t.numerator // t.denominator  # then every partner's sketch is its whole set too
    return F.when(whole, part).otherwise(F.least(part, F.lit(shared_at_least(similarity)))).cast("int")


def _lists(nodes: DataFrame, similarity: float) -> DataFrame:
    """(value, node, need): each node's rarest retained values that other nodes retain too.

    A node's sketch of s values shares c or more with any partner's, so partners share ``need`` <= c of the
    s - c + need rarest values of both: of the values shared, ``need`` come before the last c - need of a sketch.
    Sets so small that no other set is similar have no rows.
    """
    t = exactly(similarity)
    rows = nodes.filter(F.col("n_shingles") * (t.denominator - t.numerator) >= t.numerator).select("node", "n_shingles", F.explode("sketch").alias("value"))
    often = stage(rows.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1"), "values")
    hot = hot_keys(often, often.agg(F.sum("n")).first()[0] or 0)
    found = dealt_join(rows, often, ["value"], hot).groupBy("node", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("values"))
    s = F.least(F.col("n_shingles"), F.lit(K)).cast("int")
    least = _least_shared(F.col("n_shingles"), similarity)
    need = F.least(least, F.greatest(F.lit(2), F.least(F.lit(3), F.floor(s / 10) + 1))).cast("int")
    lonely = s - F.size("values")
    kept = F.slice("values", 1, F.greatest(F.lit(0), s - least + need - lonely))
    kept = found.select("node", need.alias("need"), kept.alias("values")).filter(F.size("values") >= F.col("need"))
    return kept.select("node", "need", F.explode("values.value").alias("value"))


def _verified(pairs: DataFrame, sets: _Sets, similarity: float) -> DataFrame:
    """The pairs (a, b) that are similar: by the estimate from their union's sketch, then exactly."""
    t, tail = exactly(similarity), shared_at_least(similarity)

    @lean
    def run(batches):
        for b in batches:
            rows = []
            for x, y, raw_x, raw_y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                s, r = np.frombuffer(raw_x.as_buffer(), np.int64), np.frombuffer(raw_y.as_buffer(), np.int64)
                if min(len(s), len(r)) * t.denominator < t.numerator * max(len(s), len(r)):
                    continue
                union = np.union1d(s[:K], r[:K])[:K]
                both = int((np.isin(union, s[:K], True) & np.isin(union, r[:K], True)).sum())
                if both < (tail if len(union) == K else len(union) * t):
                    continue
                shared = len(np.intersect1d(s, r, True))
                if t.denominator * shared >= t.numerator * (len(s) + len(r) - shared):
                    rows.append((x, y))
            cols = list(zip(*rows, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    total = pairs.count()
    hot = {c: hot_keys(pairs.groupBy(c).agg(F.count("*").alias("n")), total, FULL_ROWS) for c in "ab"}
    keyed = sets.keyed(sets.keyed(pairs, "a", hot["a"]), "b", hot["b"])
    both = sets.joined(sets.joined(keyed, "a", hot["a"]), "b", hot["b"])
    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _short_pairs(lists: DataFrame) -> DataFrame:
    """(a, b) that share ``need`` values or more; the lists are of SHORT nodes at most."""
    other = lists.select("value", F.col("node").alias("b"), F.col("need").alias("need_b"))
    met = lists.select("value", F.col("node").alias("a"), F.col("need").alias("need_a")).join(other, "value").filter("a < b")
    return met.groupBy("a", "b").agg(F.count("*").alias("n"), F.first(F.least("need_a", "need_b")).alias("need")).filter("n >= need").select("a", "b")


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Values that each left and each right set share: a product of the incidence matrices of the common values."""
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    if left is right:  # values of one set alone add to its own count only
        found, n = np.unique(np.concatenate(left), return_counts=True)
        common = found[n > 1]
    out = np.zeros((len(left), len(right)), np.float32)

    def incidence(sets: list[np.ndarray], values: np.ndarray) -> np.ndarray:
        m = np.zeros((len(sets), len(values)), np.float32)
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(values, flat), len(values) - 1)
        hit = values[at] == flat
        m[row[hit], at[hit]] = 1
        return m

    for a in range(0, len(common), 2048):
        values = common[a : a + 2048]
        first = incidence(left, values)
        out += first @ (first if left is right else incidence(right, values)).T
    return out


def _runs(batches, keys: int, last: int):
    """Rows, as tuples, of each run of equal first ``keys`` columns; column ``last`` becomes arrays of long."""
    rows: list = []
    for b in batches:
        plain, values = [b.column(k).to_pylist() for k in range(last)], b.column(last)
        for n, r in enumerate(zip(*plain, strict=True)):
            if rows and rows[0][:keys] != r[:keys]:
                yield rows
                rows = []
            own = values[n]
            rows.append((*r, np.frombuffer(own.as_buffer(), np.int64) if pa.types.is_binary(values.type) else own.values.to_numpy()))
    if rows:
        yield rows


def _spanning(pairs) -> list[tuple[int, int, int, int]]:
    """Those of the pairs (component, component, a, b) that connect what was apart."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    out = []
    for p in pairs:
        x, y = find(p[0]), find(p[1])
        if x != y:
            root[x] = y
            out.append(p)
    return out


def _blocked(members: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Members (pivot, node, component, size) of groups of several components with their ``block``, and the pairs (i, j) of
    blocks to compare.

    A group that is a block's worth is one block. In a larger one a block's nodes have a size class, and one component if
    that is large. Sizes of similar sets differ by one class at most.
    """
    groups = members.groupBy("pivot").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    total = members.count()
    own = dealt_join(members, groups.select("pivot", F.col("n").alias("all")), ["pivot"], hot_keys(groups.select("pivot", "n"), total, FULL_ROWS))
    cls = F.floor(F.log("size") / math.log(1 / similarity) + 1e-9).cast("int") if similarity < 1 else F.col("size").cast("int")
    own = stage(own.withColumn("cls", F.when(F.col("all") > BLOCK, cls).otherwise(0)), "grouped")
    large = own.filter(F.col("all") > BLOCK).groupBy("pivot", "cls", "component").agg(F.count("*").alias("n")).filter(F.col("n") >= BLOCK)
    pool_of = dealt_join(own, large.select("pivot", "cls", "component", F.col("component").alias("pool")), ["pivot", "cls", "component"], hot_keys(large, total, FULL_ROWS), "left")
    pooled = stage(pool_of.withColumn("pool", F.coalesce("pool", F.lit(-1))), "pooled")
    pools = pooled.groupBy("pivot", "cls", "pool").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    number = F.xxhash64("pivot", "cls", "pool", "sub").alias("block")  # blocks of equal number would be compared as one
    hot = hot_keys(pools.select("pivot", "cls", "pool", "n"), total, FULL_ROWS)
    placed = dealt_join(pooled, pools.drop("n"), ["pivot", "cls", "pool"], hot).withColumn("sub", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select("node", "component", number)
    blocks = stage(pools.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("pivot", "cls", "pool", number), "blocks")
    other = blocks.select("pivot", "cls", F.col("pool").alias("pool_j"), F.col("block").alias("j"))
    near = blocks.select("pivot", F.explode(F.array("cls", F.col("cls") + 1)).alias("cls"), F.col("cls").alias("own"), "pool", F.col("block").alias("i"))
    pairs = near.join(other, ["pivot", "cls"]).filter("(own < cls or i <= j) and (pool <> pool_j or pool < 0)")
    return placed, pairs.select("i", "j").distinct()


def _met(placed: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (i, j, block, node, component, ...) of the members of both blocks of each pair, those of a pair one after the other."""
    sides = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.join(sides, "block").select("i", "j", "block", "node", "component", *columns).repartition(n, "i", "j").sortWithinPartitions("i", "j")


def _sides(rows: list):
    i, j = rows[0][:2]
    left = [r for r in rows if r[2] == i]
    return left, left if i == j else [r for r in rows if r[2] == j]


def _candidates(placed: DataFrame, pairs: DataFrame, about: DataFrame, similarity: float) -> DataFrame:
    """(i, j, a, b) of different components whose sketches share enough; a null pair stands for a dense one of blocks."""
    t = exactly(similarity)

    @lean
    def run(batches):
        for rows in _runs(batches, 2, 7):
            left, right = _sides(rows)
            if not left or not right:
                continue
            counts = _shared_counts(*([r[7] for r in side] for side in ((left, right) if left is not right else (left,) * 2)))
            node, comp, size, least = (([np.array([r[k] for r in side]) for side in (left, right)]) for k in (3, 4, 5, 6))
            ok = counts >= np.maximum(least[0][:, None], least[1][None, :])
            ok &= comp[0][:, None] != comp[1][None, :]
            ok &= np.minimum(size[0][:, None], size[1][None, :]) * t.denominator >= t.numerator * np.maximum(size[0][:, None], size[1][None, :])
            if left is right:
                ok &= node[0][:, None] < node[1][None, :]
            x, y = np.nonzero(ok)
            a, b = node[0][x], node[1][y]
            found = [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))]
            if len(x) > DENSE * len(rows):
                found = [pa.array([None], pa.int64())] * 2
            n = len(found[0])
            yield pa.RecordBatch.from_arrays([*(pa.array([rows[0][k]] * n, pa.int64()) for k in (0, 1)), *found], ["i", "j", "a", "b"])

    return _met(placed.join(about, "node"), pairs, ["size", "least", "sketch"]).mapInArrow(run, "i long, j long, a long, b long")


def _dense_links(placed: DataFrame, dense: DataFrame, sets: _Sets, similarity: float) -> DataFrame:
    """(a, b) that are similar and connect components, of the dense pairs of blocks, by full sets."""
    t = exactly(similarity)

    @lean
    def run(batches):
        for rows in _runs(batches, 2, 5):
            left, right = _sides(rows)
            first, second = [r[5] for r in left], [r[5] for r in right]
            counts = _shared_counts(first, first if left is right else second).astype(np.int64)
            size = np.array([len(x) for x in first])[:, None] + np.array([len(x) for x in second])[None, :]
            x, y = np.nonzero(t.denominator * counts >= t.numerator * (size - counts))
            found = _spanning((left[m][4], right[n][4], left[m][3], right[n][3]) for m, n in zip(x.tolist(), y.tolist(), strict=True) if left[m][4] != right[n][4])
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (2, 3)], ["a", "b"])

    blocks = dense.select(F.explode(F.array("i", "j")).alias("block")).distinct()
    of = placed.join(blocks, "block", "left_semi").withColumnRenamed("node", "a")
    full = sets.joined(sets.keyed(of, "a", None), "a", None).withColumnRenamed("a", "node")
    return _met(full, dense, ["set_a"]).mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Edges (u, v) enough to connect all nodes that chains of similar pairs connect; a written table."""
    with scratch(), tuned(docs.sparkSession):
        listed = stage(_lists(nodes, similarity), "lists")
        sizes = stage(listed.groupBy("value").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).filter("n > 1"), "list-sizes")
        hot = hot_keys(sizes.select("value", "n"), listed.count())
        listed = stage(dealt_join(listed, sizes, ["value"], hot), "sized-lists")
        short = stage(_short_pairs(listed.filter(F.col("n") <= SHORT)), "short-pairs")
        groups = stage(listed.filter(F.col("n") > SHORT).groupBy("pivot", "node").agg(F.count("*").alias("shared")), "groups")
        star = groups.filter((F.col("shared") >= min(3, shared_at_least(similarity))) & (F.col("pivot") != F.col("node"))).select(F.col("pivot").alias("a"), F.col("node").alias("b"))
        tested = stage(star.union(short), "tested")
        with _Sets(docs, _chosen(nodes, tested.select(F.col("a").alias("node")).union(tested.select("b"))), width) as sets:
            first = stage(_verified(tested, sets, similarity).select(F.col("a").alias("u"), F.col("b").alias("v")), "first-edges")
        parts = components(first, rounds=2).groupBy("node").agg(F.min("component").alias("component"))
        about = nodes.select("node", _least_shared(F.col("n_shingles"), similarity).alias("least"), "sketch", F.col("n_shingles").alias("size"))
        members = groups.select("pivot", "node").join(parts, "node", "left").join(nodes.select("node", F.col("n_shingles").alias("size")), "node")
        placed, pairs = _blocked(stage(members.withColumn("component", F.coalesce("component", "node")), "members"), similarity)
        placed, pairs = stage(placed, "placed"), stage(pairs, "block-pairs")
        found = stage(_candidates(placed, pairs, about, similarity), "candidates")
        sparse = stage(found.filter("a is not null").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "sparse")
        dense = found.filter("a is null").select("i", "j")
        in_dense = placed.join(dense.select(F.explode(F.array("i", "j")).alias("block")).distinct(), "block", "left_semi").select("node")
        with _Sets(docs, _chosen(nodes, sparse.select(F.col("a").alias("node")).union(sparse.select("b")).union(in_dense)), width) as sets:
            more = _verified(sparse, sets, similarity).union(_dense_links(placed, dense, sets, similarity))
            return stage(first.union(more.select(F.col("a").alias("u"), F.col("b").alias("v"))), "all-edges", keep=True)


def _chosen(nodes: DataFrame, named: DataFrame) -> DataFrame:
    return stage(nodes.join(named.distinct(), "node", "left_semi").select("node", "set_key", F.col("sample").alias("id")), "chosen")


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept of each row."""
    with scratch(), tuned(docs.sparkSession):
        rows = stage(_sketched(docs, width), "sketches")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n_shingles", "sketch")).alias("x")
        sets = rows.filter("n_shingles > 0").groupBy("set_key").agg(first, F.count("*").alias("n"))
        nodes = stage(sets.select("set_key", F.monotonically_increasing_id().alias("node"), F.col("x.doc_id").alias("sample"), "x.n_shingles", "x.sketch", "n"), "nodes")
        found = components(links(nodes, docs, width, similarity))
        grouped = stage(nodes.select("node", "set_key", "sample", "n").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "grouped")
        own = grouped.groupBy("component").agg(F.min(F.struct(F.col("sample").isNull().alias("none"), "sample"))["sample"].alias("component_id"), F.count("*").alias("n"))
        hot = hot_keys(own.select("component", "n"), grouped.count())
        by_set = stage(dealt_join(grouped.select("component", "set_key"), own.drop("n"), ["component"], hot).select("set_key", "component_id"), "by-set")
        total = grouped.agg(F.sum("n")).first()[0] or 0
        plain = rows.select("doc_id", "n_shingles", "set_key")
        joined = dealt_join(plain.filter("n_shingles > 0"), by_set, ["set_key"], hot_keys(grouped.select("set_key", "n"), total)).select("doc_id", "n_shingles", "component_id")
        alone = plain.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return stage(joined.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))), "near-duplicates", keep=True)


def keep_one(docs: DataFrame, width: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without near copies: of each component the one with the smallest id stays.

    Rows that share an id are one document here, and stay or go together. Rows without an id are documents of their own,
    told apart by a row number that is written before it is used; one stays only if its component has no id. Of rows
    without an id and of the same text, with words or without, at most one stays.
    """
    unnamed = docs.filter(F.col("doc_id").isNull()).dropDuplicates(["text"])
    unnamed = stage(unnamed.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "unnamed", keep=True)
    own = docs.filter(F.col("doc_id").isNotNull())
    key = lambda is_null, i, row: F.struct(F.lit(is_null).alias("unnamed"), i.cast("long").alias("id"), row.cast("long").alias("row")).alias("doc_id")
    both = own.select(key(False, F.col("doc_id"), F.lit(0)), "text").union(unnamed.select(key(True, F.lit(0), F.col("row")), F.col("doc.text")))
    with scratch():
        kept = stage(near_duplicates(both, width, similarity).filter("kept").select("doc_id.*").distinct(), "kept", keep=True)
    named = own.join(kept.filter("not unnamed").select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select(*docs.columns)
    return named.unionByName(unnamed.join(kept.filter("unnamed").select("row"), "row", "left_semi").select("doc.*"))
