"""Exact duplicate removal with Patricia tries that own the texts of one length and content hash.

Texts are compared after each run of ``[\\x20\\x09-\\x0D]`` became one space; a null text counts as
empty. Every map task folds its own copies in a trie first, so a text with a third of all rows
crosses the shuffle at most once per map task. The shuffle deals texts by (byte length, content
hash); each reducer inserts the full byte strings, whose terminals hold the smallest identifier and
the number of rows. A trie over its memory bound spills whole subtrees as rows; the closing
aggregate merges what was spilled with what was not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import SPACE, stored, within_broadcast

#: Bytes of labels (and overhead) that one task's trie may hold before it spills subtrees.
TRIE_BYTES = 64 << 20
NODE_BYTES = 400
BATCH_BYTES = 4 << 20

_OWNERS = "n_bytes int, text_sha256 string, low bigint, copies bigint"


class _Node:
    __slots__ = ("label", "kids", "low", "copies")

    def __init__(self, label: bytes):
        self.label, self.kids, self.low, self.copies = label, {}, None, 0


class PatriciaTrie:
    """Compressed radix trie over byte strings; terminals keep the smallest identifier and a count."""

    def __init__(self, max_bytes: int = TRIE_BYTES):
        self.root, self.max_bytes, self.sizes = _Node(b""), max_bytes, {}

    def insert(self, text: bytes, low: int | None, copies: int) -> None:
        node, at, end, grown = self.root, 0, len(text), 0
        while at < end:
            kid = node.kids.get(text[at])
            if kid is None:
                kid = node.kids[text[at]] = _Node(text[at:])
                grown += end - at + NODE_BYTES
                node = kid
                break
            if text.startswith(kid.label, at):
                node, at = kid, at + len(kid.label)
                continue
            shared = _common(kid.label, text, at)
            middle = node.kids[text[at]] = _Node(kid.label[:shared])
            kid.label = kid.label[shared:]
            middle.kids[kid.label[0]] = kid
            grown += NODE_BYTES
            node, at = middle, at + shared
        if not node.copies:
            node.low = low
        elif low is not None and (node.low is None or low < node.low):
            node.low = low
        node.copies += copies
        if end:
            self.sizes[text[0]] = self.sizes.get(text[0], 0) + grown

    def overfull(self) -> bool:
        return sum(self.sizes.values()) > self.max_bytes

    def spill(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Detach the largest subtrees below the root until half of the bound is free."""
        while sum(self.sizes.values()) > self.max_bytes // 2:
            first = max(self.sizes, key=self.sizes.get)
            del self.sizes[first]
            yield from self._terminals(self.root.kids.pop(first))

    def drain(self) -> Iterator[tuple[bytes, int | None, int]]:
        self.sizes = {}
        root, self.root = self.root, _Node(b"")
        yield from self._terminals(root)

    @staticmethod
    def _terminals(top: _Node) -> Iterator[tuple[bytes, int | None, int]]:
        stack = [(top, b"")]
        while stack:
            node, before = stack.pop()
            text = before + node.label
            if node.copies:
                yield text, node.low, node.copies
            stack.extend((kid, text) for kid in node.kids.values())


def _common(label: bytes, text: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``text[at:]``, known to be at least one byte."""
    low, high = 1, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low


def _fold(batches: Iterator[pa.RecordBatch], max_bytes: int, keys: bool) -> Iterator[pa.RecordBatch]:
    """Fold rows into tries, one for each (length, hash); yield terminals as texts or as owner keys."""
    trie = PatriciaTrie(max_bytes)

    def out(found) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for text, low, copies in found:
            rows.append((len(text), hashlib.sha256(text).hexdigest() if keys else None, text, low, copies))
            held += 0 if keys else len(text)
            if held > BATCH_BYTES or len(rows) >= 10_000:
                yield pack(rows)
                rows, held = [], 0
        if rows:
            yield pack(rows)

    def pack(rows) -> pa.RecordBatch:
        n, sha, text, low, copies = zip(*rows, strict=True)
        lead = {"n_bytes": pa.array(n, pa.int32())}
        body = {"text_sha256": pa.array(sha, pa.string())} if keys else {"text": pa.array(text, pa.binary()).cast(pa.string())}
        return pa.RecordBatch.from_pydict(lead | body | {"low": pa.array(low, pa.int64()), "copies": pa.array(copies, pa.int64())})

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for text, low, copies in zip(texts, batch.column("low").to_pylist(), batch.column("copies").to_pylist(), strict=True):
            trie.insert(text.as_py(), low, copies)
            if trie.overfull():
                yield from out(trie.spill())
    yield from out(trie.drain())


def normalised(text: str | F.Column) -> F.Column:
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), f"[{SPACE}]+", " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``id_col, keep_id, group_size, kept, text_sha256``.

    ``keep_id`` is the smallest identifier among rows of equal normalised text. Null texts equal
    empty ones. A null identifier never wins over another; a group of null identifiers only keeps
    them all (``keep_id`` null, ``kept`` true). Rows that repeat both identifier and text count each
    in ``group_size`` and share ``kept``. Other columns are not read, whatever their names; no rows
    in, no rows out.
    """
    own = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("text"))
    folded = own.select("text", F.col("id").cast("bigint").alias("low"), F.lit(1).cast("bigint").alias("copies")).mapInArrow(
        lambda batches: _fold(batches, max_trie_bytes, False), "n_bytes int, text string, low bigint, copies bigint"
    )
    owners = (
        folded.repartition(F.col("n_bytes"), F.xxhash64("text"))
        .mapInArrow(lambda batches: _fold(batches, max_trie_bytes, True), _OWNERS)
        .groupBy("n_bytes", "text_sha256")
        .agg(F.min("low").alias("keep_id"), F.sum("copies").alias("group_size"))
    )
    # only groups of several rows meet their rows again; stored, so that the join's sides are plain exchanges, which split at a hot text
    several = within_broadcast(stored(owners.where("group_size > 1")))
    keyed = own.select("id", F.octet_length("text").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))
    keep = F.when(F.col("group_size").isNull(), F.col("id").cast("bigint")).otherwise(F.col("keep_id"))
    met = keyed.join(several, ["n_bytes", "text_sha256"], "left").withColumn("keep_id", keep)
    return met.select(F.col("id").alias(id_col), "keep_id", F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without exact copies: of equal texts only the smallest identifier stays."""
    gone = within_broadcast(stored(exact_duplicates(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias("_gone")).distinct()))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
