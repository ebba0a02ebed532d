"""Exact similarity of crowds of sets, block against block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import stored

#: Sets of a block of a crowd whose members are held against each other.
BLOCK_SETS = 512
#: Features that one slice of the matrix product takes.
SLICE = 4096


def dealt_blocks(rows: DataFrame, block_sets: int = BLOCK_SETS) -> DataFrame:
    """``cluster, n, own, block, other``: each member of a crowd with every block that its own meets."""
    nodes = rows.select(F.col("sig").alias("cluster"), "n", F.col("root").alias("own")).distinct()
    sizes = nodes.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block_sets).alias("blocks"))
    placed = nodes.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("n"), F.col("blocks")))
    return placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))


def sieved_blocks(rows: DataFrame, marks: DataFrame, num: int, den: int, block_sets: int = BLOCK_SETS) -> DataFrame:
    """Stored rows of ``rows(sig, n, root)`` whose set may have a similar one in another component of its crowd.

    ``marks(fp, n, bits)`` holds sizes and parity bits: sets whose bits differ in more places than similar
    sets can are told apart without them. Blocks meet as in ``linked_blocks``; a row leaves at most once
    per block.
    """
    marks = marks.select("fp", F.col("n").alias("size"), "bits")
    full = dealt_blocks(rows, block_sets).join(marks, F.col("n") == F.col("fp")).select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp", "own", "size", "bits")

    def sieve(rows: pd.DataFrame) -> pd.DataFrame:
        bits, own, size = rows["bits"].to_numpy(), rows["own"].to_numpy(), rows["size"].to_numpy().astype(np.int64)
        words, kept = np.array([len(x) for x in bits]), np.zeros(len(rows), dtype=bool)
        for length in np.unique(words).tolist():
            shorter = np.flatnonzero(words == length)
            at = np.flatnonzero((words >= length) & (size * num <= size[shorter].max() * den))
            folded = np.stack([np.bitwise_xor.reduce(np.asarray(bits[x]).reshape(-1, length), axis=0) for x in at])
            shared = np.zeros((len(at), len(at)), dtype=np.float32)
            for low in range(0, length, SLICE // 64):
                dense = np.unpackbits(np.ascontiguousarray(folded[:, low : low + SLICE // 64]).view(np.uint8), axis=1).astype(np.float32)
                shared += dense @ dense.T
            ones, sizes = np.diag(shared), size[at]
            differ = ones[:, None] + ones[None, :] - 2 * shared
            both = sizes[:, None] + sizes[None, :]
            near = (differ * (den + num) <= both * (den - num)) & (np.minimum(sizes[:, None], sizes) * den >= np.maximum(sizes[:, None], sizes) * num)
            kept[at] |= (near & (own[at][:, None] != own[at][None, :])).any(axis=1)
        return rows.loc[kept, ["cluster", "fp", "own"]].set_axis(["sig", "n", "root"], axis=1)

    return stored(stored(full.groupBy("cluster", "i", "j").applyInPandas(sieve, "sig bigint, n bigint, root bigint")).distinct())


def linked_blocks(rows: DataFrame, sets: DataFrame, num: int, den: int, block_sets: int = BLOCK_SETS) -> DataFrame:
    """Stored links ``src, dst`` between different components of ``rows(sig, n, root)``: pairs with ``den * shared >= num * union``.

    ``sets(fp, items)`` holds the members' distinct features. A crowd's sets fall into blocks of about
    ``block_sets``; each pair of blocks is one group, whose overlaps are a matrix product, and only
    links that join components leave it. A set is copied once per block of its crowd, never once per
    other set.
    """
    dealt = dealt_blocks(rows, block_sets)
    full = dealt.join(sets, F.col("n") == F.col("fp")).select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp", "own", "items")

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        items = rows["items"].to_numpy()
        sizes = np.array([len(x) for x in items], dtype=np.int64)
        if not sizes.sum():
            return pd.DataFrame([], columns=["src", "dst"], dtype="int64")
        _, codes = np.unique(np.concatenate(items), return_inverse=True)
        at = np.repeat(np.arange(len(items)), sizes)
        # only features of several sets matter; a slice of memory is (sets x SLICE) floats
        often = np.flatnonzero(np.bincount(codes) > 1)
        where = np.full(codes.max() + 1, -1)
        where[often] = np.arange(len(often))
        column = where[codes]
        shared = np.zeros((len(items), len(items)), dtype=np.float32)
        for low in range(0, len(often), SLICE):
            part = (column >= low) & (column < low + SLICE)
            dense = np.zeros((len(items), SLICE), dtype=np.float32)
            dense[at[part], column[part] - low] = 1
            shared += dense @ dense.T
        own = rows["own"].to_numpy()
        near = (sizes[:, None] > 0) & (shared * den >= (sizes[:, None] + sizes[None, :] - shared) * num)
        fps, parent, out = rows["fp"].to_numpy(), {}, []

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            x, y = root(own[a]), root(own[b])
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((fps[a], fps[b]))
        return pd.DataFrame(out, columns=["src", "dst"], dtype="int64")

    return stored(full.groupBy("cluster", "i", "j").applyInPandas(link, "src bigint, dst bigint"))
