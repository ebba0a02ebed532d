"""Ranked lexical search of a set of items against all documents, by dense blocked matrix products.

Items form blocks of a bounded number of terms. For each block, documents are counted against its
vocabulary (terms of items only), and document tiles of impacts are multiplied with tiles of item weights
over the compact vocabulary of some hundred items: float64 products of integers, cut so that no partial sum
reaches 2^53, added as 64-bit integers. Each task keeps its best k per item over its tiles;
a last shuffle merges those. All documents are read whole; none is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.common import LOWER, UPPER, forget, lower_ascii, stored
from barwright.llm.hashing import Substrings, text_steps

#: Separators: ASCII that is neither letter nor digit.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Item terms (with repeats) of a block, on average: what the driver and each worker hold of the items.
BLOCK_TERMS = 200_000


@dataclass(frozen=True)
class Sizes:
    """Items, documents and terms of a tile; item tiles that a task makes once; bytes of text of a step."""

    items: int = 256
    docs: int = 1024
    terms: int = 2048
    held: int = 4
    step_bytes: int = 1 << 21


SIZES = Sizes()
#: Scale of an impact, and a bound of it: ``SCALE * tf div (1000 * tf + 12 * m)`` is at most a thousandth of it.
SCALE = 1_000_000_000
#: Largest sum of an item's weights in one product: times an impact it stays below 2^53.
MAX_WEIGHTS = (1 << 53) // (SCALE // 1000) - 1
#: Salts of the first merge of the tasks' best rows.
SALTS = 64


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Bytes that belong to terms, and each byte's lower case."""
    inside = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
    lower = np.arange(256, dtype=np.uint8)
    lower[[ord(c) for c in UPPER]] = [ord(c) for c in LOWER]
    return inside, lower


INSIDE, LOWERED = _byte_tables()


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all terms of a step's bytes, and the text of each."""
    inside = INSIDE[data]
    fresh, last = inside.copy(), inside.copy()
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    fresh[1:] &= ~inside[:-1]
    fresh[edges] = inside[edges]
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(fresh)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, side="right") - 1


@dataclass
class Block:
    """Items of a block in compressed rows: of item ``i`` the terms ``term[at[i]:at[i + 1]]`` (numbers in the vocabulary) and how often it has them."""

    items: pa.Array
    at: np.ndarray
    term: np.ndarray
    often: np.ndarray
    vocabulary: list[str]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of the vocabulary and the term of each."""
        raw = [t.encode() for t in self.vocabulary]
        ends = np.cumsum([len(r) for r in raw])
        found = Substrings(np.frombuffer(b"".join(raw), dtype=np.uint8)).of(np.r_[0, ends[:-1]], ends) if raw else np.empty(0, dtype=np.uint64)
        order = np.argsort(found)
        return found[order], order


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id, _term, _often``: rows of one identifier are one item; items without a term have no row."""
    terms = F.explode(F.filter(F.split(lower_ascii(F.col(text_col)), SEPARATORS, -1), lambda t: t != ""))
    return items.select(F.col(id_col).alias("_id"), terms.alias("_term")).groupBy("_id", "_term").agg(F.count(F.lit(1)).alias("_often"))


def _block(rows: DataFrame) -> Block:
    """A block's rows of ``item_terms``, some ``BLOCK_TERMS`` at most, to the driver."""
    got = rows.select("_id", "_term", "_often").toArrow()
    ids, terms = got.column("_id").combine_chunks().dictionary_encode(null_encoding="encode"), got.column("_term").combine_chunks().dictionary_encode()
    item = ids.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(item, kind="stable")
    at = np.r_[0, np.cumsum(np.bincount(item, minlength=len(ids.dictionary)))]
    return Block(ids.dictionary, at, terms.indices.to_numpy(zero_copy_only=False)[order], got.column("_often").to_numpy()[order], terms.dictionary.to_pylist())


def count_terms(docs: DataFrame, block: Block, id_col: str, text_col: str, sizes: Sizes = SIZES) -> DataFrame:
    """``doc, n, terms, tf``: per document row its number of terms and how often it has those of the block's vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(block.hashes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, numbers = shared.value
        size = max(1, len(hashes))
        for batch in batches:
            for low, high, data, offsets in text_steps(batch.column(1), sizes.step_bytes):
                start, end, text = term_spans(data, offsets)
                n = np.bincount(text, minlength=high - low)
                found = Substrings(LOWERED[data]).of(start, end)
                at = np.minimum(np.searchsorted(hashes, found), size - 1)
                hit = hashes[at] == found if len(hashes) else np.zeros(len(found), dtype=bool)
                cells, tf = np.unique(text[hit] * size + numbers[at[hit]], return_counts=True)
                cuts = np.r_[0, np.cumsum(np.bincount(cells // size, minlength=high - low))].astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(values.astype(kind))) for values, kind in ((cells % size, np.int32), (tf, np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(n.astype(np.int64)), *lists], ["doc", "n", "terms", "tf"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")).mapInArrow(count, "doc bigint, n bigint, terms array<int>, tf array<bigint>")


class Tiles:
    """Dense weight tiles of a block's items; those of the first ``sizes.held`` item tiles are made once a task."""

    def __init__(self, block: Block, weights: np.ndarray, sizes: Sizes = SIZES):
        self.block, self.weights, self.sizes = block, weights, sizes
        self.held: dict[int, list] = {}

    def of(self, first: int) -> Iterator[tuple[np.ndarray, np.ndarray]] | list:
        if first >= self.sizes.held * self.sizes.items:
            return self.made(first)
        if first not in self.held:
            self.held[first] = list(self.made(first))
        return self.held[first]

    def made(self, first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For the items from ``first`` on: terms, and a matrix of terms by items whose columns sum to ``MAX_WEIGHTS`` at most."""
        b = self.block
        last = min(first + self.sizes.items, len(b.items))
        low, high = b.at[first], b.at[last]
        terms, row = np.unique(b.term[low:high], return_inverse=True)
        column = np.repeat(np.arange(last - first), np.diff(b.at[first : last + 1]))
        value = self.weights[b.term[low:high]] * b.often[low:high]
        parts = np.ones(len(terms), dtype=np.int64)  # a term of more weight than a product may hold comes in parts
        np.maximum.at(parts, row, -(-value // MAX_WEIGHTS))
        base = np.cumsum(parts) - parts
        each = parts[row]
        within = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        value, share = np.repeat(value, each), np.repeat(each, each)
        rows, columns, values = np.repeat(base[row], each) + within, np.repeat(column, each), value // share + (within < value % share)
        names = np.repeat(terms, parts)
        at = 0
        while at < len(names):
            top = min(at + self.sizes.terms, len(names))
            tile = (rows >= at) & (rows < top)
            dense = np.zeros((top - at, last - first), dtype=np.int64)
            dense[rows[tile] - at, columns[tile]] = values[tile]
            fits = int(np.searchsorted(np.cumsum(dense, axis=0).max(axis=1), MAX_WEIGHTS, side="right"))
            yield names[at : at + fits], dense[:fits].astype(np.float64)
            at += fits


class Best:
    """The k best documents of each item so far; equal scores by ascending document, null last."""

    def __init__(self, k: int):
        self.k = k
        self.item, self.score, self.doc, self.known = (np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int64, bool))

    def floor(self, items: int) -> np.ndarray:
        """The score that an item's candidates need: its k-th best, or 1."""
        out = np.ones(items, dtype=np.int64)
        full, count = np.unique(self.item, return_counts=True)
        least = np.full(items, np.iinfo(np.int64).max)
        np.minimum.at(least, self.item, self.score)
        out[full[count >= self.k]] = least[full[count >= self.k]]
        return out

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        item, score, doc, known = (np.concatenate(p) for p in ((self.item, item), (self.score, score), (self.doc, doc), (self.known, known)))
        order = np.lexsort((doc, ~known, -score, item))
        item = item[order]
        first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.empty(0, dtype=np.int64)
        place = np.arange(len(item)) - np.repeat(first, np.diff(np.r_[first, len(item)]))
        order = order[place < self.k]
        self.item, self.score, self.doc, self.known = item[place < self.k], score[order], doc[order], known[order]


def score_tiles(counted: DataFrame, block: Block, weights: np.ndarray, documents: int, terms: int, k: int, sizes: Sizes = SIZES) -> DataFrame:
    """``item, doc, score``: the k best documents of each item in each task. ``item`` is a place in ``block.items``."""
    shared, items = counted.sparkSession.sparkContext.broadcast((block, weights)), len(block.items)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, best = Tiles(*shared.value, sizes), [Best(k) for _ in range(0, items, sizes.items)]
        place = np.full(len(tiles.weights), -1, dtype=np.int64)
        for batch in batches:
            doc, n, cuts = batch.column(0), batch.column(1).to_numpy(), batch.column(2).offsets.to_numpy()
            term, tf = batch.column(2).values.to_numpy(), batch.column(3).values.to_numpy()
            m = 75 + (25 * n * documents) // max(1, terms)
            known, doc = doc.is_valid().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy()
            for low in range(0, len(n), sizes.docs):
                high = min(low + sizes.docs, len(n))
                a, b = cuts[low], cuts[high]
                row = np.repeat(np.arange(high - low), np.diff(cuts[low : high + 1]))
                own, often = term[a:b], tf[a:b]
                impact = (SCALE * often) // (1000 * often + 12 * m[low:high][row])
                for number, top in enumerate(best):
                    total = None
                    for names, dense in tiles.of(number * sizes.items):
                        # a term in parts has several places: the last is found here, the others are copies
                        place[names] = np.arange(len(names))
                        at = place[own]
                        hit = at >= 0
                        left = np.zeros((high - low, len(names)))
                        left[row[hit], at[hit]] = impact[hit]
                        if (place[names] != np.arange(len(names))).any():
                            left = left[:, place[names]]
                        place[names] = -1
                        part = (left @ dense).astype(np.int64)
                        total = part if total is None else total + part
                    if total is not None:
                        d, i = np.nonzero(total >= top.floor(total.shape[1]))
                        if len(d):
                            top.add(i, total[d, i], doc[low + d], known[low + d])
        for number, top in enumerate(best):
            if len(top.item):
                columns = [pa.array(top.item + number * sizes.items), pa.array(top.doc, mask=~top.known), pa.array(top.score)]
                yield pa.RecordBatch.from_arrays(columns, ["item", "doc", "score"])

    return counted.where(F.size("terms") > 0).mapInArrow(score, "item bigint, doc bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 20, item_id: str = "item_id", doc_id: str = "doc_id", text_col: str = "text", block_terms: int = BLOCK_TERMS, sizes: Sizes = SIZES) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents of a score above 0, equal scores by ascending ``doc_id``.

    Terms are runs of ASCII letters, digits and all other characters beyond ASCII, A-Z lower-cased. A
    null text has none. Item rows of one identifier (null is one) are one item, with the terms of them all;
    document rows of one identifier are documents of their own, and their order among equal scores is
    arbitrary. Document identifiers are integers; a null one comes last among equal scores. Terms
    are told apart by 64-bit hashes.

    Blocks of items run one after another, each over all documents. The driver holds one block: some
    ``block_terms`` terms, or one item's distinct ones.
    """
    wanted = stored(item_terms(items, item_id, text_col))
    size = wanted.agg(F.coalesce(F.sum("_often"), F.lit(0))).first()[0]
    count = max(1, -(-size // block_terms))
    found = None
    for number in range(count):
        block = _block(wanted.where(F.pmod(F.xxhash64("_id"), F.lit(count)) == number) if count > 1 else wanted)
        counted = stored(count_terms(docs, block, doc_id, text_col, sizes))
        documents, terms = counted.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = counted.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()  # of the block's vocabulary, each once
        held = np.zeros(len(block.vocabulary), dtype=np.int64)
        held[df.column("t").to_numpy()] = df.column("count").to_numpy()
        weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * held + 1))).astype(np.int64)
        best = score_tiles(counted, block, weights, documents, terms, k, sizes)
        names = docs.sparkSession.createDataFrame(pa.table({"item": pa.array(np.arange(len(block.items))), "_id": block.items}))
        rows = stored(best.join(F.broadcast(names), "item").select("_id", "doc", "score"))
        forget(counted)
        found = rows if found is None else found.union(rows)
    forget(wanted)
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)))
    first = salted.withColumn("_r", F.row_number().over(Window.partitionBy("_id", "_salt").orderBy(*order))).where(F.col("_r") <= k)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("_id").orderBy(*order))).where(F.col("rank") <= k)
    return last.select(F.col("_id").alias(item_id), "rank", F.col("doc").alias(doc_id), "score")
