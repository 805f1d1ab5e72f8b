"""Order and placement: solidity order, numbering, greedy packing into blocks, offsets and deltas.

Global numbering and running sums never put all rows into one task: rows are range-partitioned, numbered within
their partition, and shifted by the totals of the partitions before, of which there is one row each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import sort_extension
from ..plans.staging import stage


def solidity_key(path: str = "path", kind: str = "kind") -> list[Column]:
    """Directories, files, links; within them by extension, then by path."""
    rank = F.when(F.col(kind) == 1, 0).when(F.col(kind) == 0, 1).otherwise(2)
    return [rank, sort_extension(path), F.col(path)]


def _dealt(rows: DataFrame, order: list[Column]) -> tuple[DataFrame, list[str]]:
    names = [f"_k{i}" for i in range(len(order))]
    keyed = rows.select("*", *(c.alias(n) for c, n in zip(order, names, strict=True)))
    dealt = keyed.repartitionByRange(*names).withColumn("_part", F.spark_partition_id())
    return stage(dealt, "ordered"), names


def _before(parts: DataFrame, value: str) -> DataFrame:
    """Exclusive running sum over the partitions: a row for each."""
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("_part", F.coalesce(F.sum(value).over(w), F.lit(0)).alias("_base"))


def global_rank(rows: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """``name``: place of each row in the order, from ``start``."""
    dealt, keys = _dealt(rows, order)
    base = _before(dealt.groupBy("_part").agg(F.count("*").alias("n")), "n")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    return dealt.withColumn(name, rank).join(base, "_part").withColumn(name, (F.col(name) + F.col("_base") + start).cast("long")).drop("_part", "_base", *keys)


def global_running_sum(rows: DataFrame, order: list[Column], value: str, name: str, start: int = 0) -> DataFrame:
    """``name``: sum of ``value`` over the rows before, plus ``start``."""
    dealt, keys = _dealt(rows, order)
    base = _before(dealt.groupBy("_part").agg(F.sum(value).alias("n")), "n")
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn(name, own).join(base, "_part").withColumn(name, (F.col(name) + F.col("_base") + start).cast("long")).drop("_part", "_base", *keys)


def solidity_order(entries: DataFrame, path: str = "path", kind: str = "kind") -> DataFrame:
    """``entry_idx`` in solidity order."""
    return global_rank(entries, solidity_key(path, kind), "entry_idx")


def greedy_blocks(lengths: np.ndarray, block_size: int) -> np.ndarray:
    """Block of each chunk: a block is cut once it has ``block_size`` bytes or more, after the chunk that gets it there."""
    ends = np.cumsum(lengths)
    out, start, block, base = np.zeros(len(lengths), np.int64), 0, 0, 0
    while start < len(lengths):
        stop = min(len(lengths), int(np.searchsorted(ends, base + block_size)) + 1)
        out[start:stop] = block
        base, start, block = int(ends[stop - 1]), stop, block + 1
    return out


def entry_states(lengths: np.ndarray, block_size: int) -> pd.DataFrame:
    """What a run of chunks does to an open block, for every way to enter it.

    The block that is open on entry is cut at some chunk ``j`` of the first ``block_size`` bytes; all else follows
    from j. A row per j: bytes up to and with it, blocks cut in all, and bytes left open at the end.
    """
    ends = np.cumsum(lengths)
    n = len(lengths)
    after = np.searchsorted(ends, ends + block_size)  # the cut that follows a cut at j
    cut, left = np.ones(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for j in range(n - 1, -1, -1):
        k = after[j]
        cut[j], left[j] = (1 + cut[k], left[k]) if k < n else (1, ends[-1] - ends[j])
    first = int(np.searchsorted(ends, block_size)) + 1
    return pd.DataFrame({"reach": ends[:first], "cuts": cut[:n][:first], "left": left[:n][:first]})


def follow(states: pd.DataFrame, after: pd.DataFrame, block_size: int) -> pd.DataFrame:
    """The states of two runs, one after the other, as those of one run; both have the columns of ``entry_states`` and ``total``.

    There are no more of them than chunks that end in the first ``block_size`` bytes.
    """
    total = int(states["total"].iloc[0])
    reach, cuts, left = (after[k].to_numpy() for k in ("reach", "cuts", "left"))
    at = np.searchsorted(reach, block_size - states["left"].to_numpy())
    known = np.minimum(at, len(after) - 1)
    ends = at < len(after)
    first = pd.DataFrame({
        "reach": states["reach"], "cuts": states["cuts"] + np.where(ends, cuts[known], 0),
        "left": np.where(ends, left[known], states["left"] + int(after["total"].iloc[0])),
    })
    later = pd.DataFrame({"reach": reach + total, "cuts": cuts, "left": left})[: len(after) if total < block_size else 0]
    both = pd.concat([first, later], ignore_index=True)
    wanted = np.append(True, both["reach"].to_numpy()[:-1] < block_size)  # up to the first that fills a block
    return both[wanted].assign(total=total + int(after["total"].iloc[0]))


def _next(state: tuple[int, int], states: pd.DataFrame, block_size: int) -> tuple[int, int]:
    """(block, bytes in it) after a run that begins at such a state."""
    block, filled = state
    j = int(np.searchsorted(states["reach"].to_numpy(), block_size - filled))
    if j < len(states):
        return block + int(states["cuts"].iloc[j]), int(states["left"].iloc[j])
    return block, filled + int(states["total"].iloc[0])


#: Ranges whose states one task puts together, so that the driver sees one of so many.
TOGETHER = 512


def pack_blocks(chunks: DataFrame, block_size: int) -> DataFrame:
    """``block_idx`` of each (chunk_idx, len), as the sequential greedy fold gives it, in parallel passes.

    Each range of chunks is reduced to its ``entry_states``, and TOGETHER ranges at a time to those of one run. The driver
    threads the state of the open block through the runs, one search each; the runs' tasks thread it through their
    ranges; the last pass cuts every range from its own state. Only lengths are in it.
    """
    spark = chunks.sparkSession
    dealt, _ = _dealt(chunks.select("chunk_idx", "len"), [F.col("chunk_idx")])
    dealt = dealt.select("_part", "chunk_idx", "len")
    shape = "_part int, reach long, cuts long, left long, total long"

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf.sort_values("chunk_idx")["len"].to_numpy()
        return entry_states(lengths, block_size).assign(_part=pdf["_part"].iloc[0], total=int(lengths.sum()))[["_part", "reach", "cuts", "left", "total"]]

    def runs(pdf: pd.DataFrame) -> pd.DataFrame:
        found = None
        for _, g in pdf.sort_values(["_part", "reach"]).groupby("_part"):
            found = g.drop(columns="_part") if found is None else follow(found, g, block_size)
        return found.assign(_part=pdf["_part"].iloc[0] // TOGETHER)[["_part", "reach", "cuts", "left", "total"]]

    each = stage(dealt.groupBy("_part").applyInPandas(states, shape), "states")
    run = F.floor(F.col("_part") / TOGETHER).cast("int")
    found = each.groupBy(run).applyInPandas(runs, shape).toPandas()  # a run has states of its first block alone
    state, entry = (0, 0), {}
    for part, g in found.sort_values(["_part", "reach"]).groupby("_part"):
        entry[int(part)] = state
        state = _next(state, g, block_size)
    if not entry:
        return spark.createDataFrame([], "chunk_idx long, len long, block_idx long")

    def thread(pdf: pd.DataFrame) -> pd.DataFrame:
        now, out = entry[int(pdf["_part"].iloc[0]) // TOGETHER], []
        for part, g in pdf.sort_values(["_part", "reach"]).groupby("_part"):
            out.append((int(part), *now))
            now = _next(now, g, block_size)
        return pd.DataFrame(out, columns=["_part", "block", "filled"])

    def assign(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, (block, filled) = left.sort_values("chunk_idx"), right[["block", "filled"]].iloc[0]
        own = greedy_blocks(np.concatenate([[filled], left["len"].to_numpy()]), block_size)[1:]
        return pd.DataFrame({"chunk_idx": left["chunk_idx"], "len": left["len"], "block_idx": own + block})

    begun = each.groupBy(run).applyInPandas(thread, "_part int, block long, filled long")
    return dealt.groupBy("_part").cogroup(begun.groupBy("_part")).applyInPandas(assign, "chunk_idx long, len long, block_idx long")


def block_table(packed: DataFrame) -> DataFrame:
    """Per block: first_chunk, n_chunks, raw_len."""
    return packed.groupBy("block_idx").agg(F.min("chunk_idx").alias("first_chunk"), F.count("*").alias("n_chunks"), F.sum("len").alias("raw_len"))


def chunk_offsets(packed: DataFrame) -> DataFrame:
    """``offset_in_block`` of each chunk: lengths of the chunks of its block before it."""
    w = Window.partitionBy("block_idx").orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, -1)
    return packed.withColumn("offset_in_block", F.coalesce(F.sum("len").over(w), F.lit(0)))


def block_offsets(blocks: DataFrame, start: int = 16) -> DataFrame:
    """``offset`` of each block in the file."""
    return global_running_sum(blocks, [F.col("block_idx")], "comp_len", "offset", start)


def chunk_to_block(blocks: DataFrame) -> DataFrame:
    """(chunk_idx, block_idx) of every chunk that a block claims; an equi-joinable form of the range."""
    claimed = F.sequence("first_chunk", F.col("first_chunk") + F.col("n_chunks") - 1)
    return blocks.filter("n_chunks > 0").select("block_idx", F.explode(claimed).alias("chunk_idx"))


def ref_deltas(chunks: Column) -> Column:
    """Differences of an array of chunk indices, the first from 0."""
    return F.transform(chunks, lambda x, i: x - F.when(i == 0, F.lit(0)).otherwise(F.get(chunks, i - 1)))


def lag_deltas(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Difference of ``value`` from the row before in ``order``; the first from 0."""
    dealt, keys = _dealt(rows, [F.col(order)])
    last = dealt.groupBy("_part").agg(F.max_by(value, keys[0]).alias("_last"))
    before = last.select("_part", F.lag("_last", 1, 0).over(Window.orderBy("_part")).alias("_base"))  # a row for each range
    own = F.lag(value).over(Window.partitionBy("_part").orderBy(*keys))
    return dealt.withColumn("_own", own).join(before, "_part").withColumn(name, F.col(value) - F.coalesce("_own", "_base")).drop("_part", "_own", "_base", *keys)


def resolve_refs(entries: DataFrame, chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """A row per chunk reference: entry_idx, pos, chunk_idx, block_idx, offset_in_block, len."""
    refs = entries.select("entry_idx", F.posexplode("chunks").alias("pos", "chunk_idx"))
    placed = chunk_offsets(chunks.join(chunk_to_block(blocks), "chunk_idx"))
    return refs.join(placed, "chunk_idx").select("entry_idx", "pos", "chunk_idx", "block_idx", "offset_in_block", "len")


def needed_blocks(selected: DataFrame, blocks: DataFrame) -> DataFrame:
    """The blocks that hold a chunk of the selected entries; no other block is read."""
    chunk = selected.select(F.explode("chunks").alias("chunk_idx")).distinct()
    wanted = chunk_to_block(blocks).join(chunk, "chunk_idx", "left_semi").select("block_idx").distinct()
    return blocks.join(wanted, "block_idx", "left_semi")
