"""Benchmark items inside documents: size-partitioned MinHash containment search, in SQL functions only.

Items fall into partitions by their number of shingles (and by shingle length, for items of fewer words
than a shingle). An item's sketch is its bottom-m MinHash values, with m one more than the shingles it
may miss at the wanted containment: of the m smallest, at least one stands in every document that
contains the item, so the search misses none. Each partition has the largest rank of its own sketches
as its bound, and a document offers a partition only the shingles within it: short items, whose sketches
reach any rank, do not widen the search for long ones. Candidates are verified by exact shingle
containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import NON_WORD, lower_ascii, stored, within_broadcast

SHINGLE = 5
CONTAINMENT = 0.8
#: Upper bounds of the shingle counts of the size partitions; larger items share the last one.
SIZE_BOUNDS = (8, 16, 32, 64, 128, 256, 512, 1024)
#: Item shingles (some 40 bytes each) up to which their side of a join is broadcast.
MAX_BROADCAST_SHINGLES = 500_000
#: A shingle is in its item's sketch if so few come before it that the item cannot miss them all.
IN_SKETCH = "place <= n - need + 1"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words of letters, digits and characters beyond ASCII."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), f"[{NON_WORD}]+"), lambda w: w != "")


def _shingles(words: str, k: int) -> Column:
    """64-bit hashes of every run of ``k`` words, in order; ``words`` names a column, as lambdas evaluate expressions again and again."""
    words = F.col(words)
    if k == 1:
        return F.transform(words, lambda w: F.xxhash64(w))
    return F.when(
        F.size(words) >= k,
        F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(*(F.get(words, i + (j - 1)) for j in range(k)))),
    ).otherwise(F.array().cast("array<bigint>"))


def _rank(shingle: Column) -> Column:
    """The one random order of shingles that sketches are cut from: their hash with the sign bit off."""
    return shingle.bitwiseAND(F.lit((1 << 63) - 1))


def _offered(shingles: str, part: int, top: int) -> Column:
    """What a document offers a size partition: its shingles of no larger rank than any of the partition's sketches."""
    return F.transform(F.filter(shingles, lambda x: _rank(x) <= F.lit(top)), lambda x: F.struct(F.lit(part).alias("part"), x.alias("shingle")))


def item_shingles(items: DataFrame, id_col: str, text_col: str, k: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """One row per item and distinct shingle: ``item, k, n, need, shingle, rank, place, part``.

    ``k`` falls to the number of words for items with fewer; ``need`` is the least number of shared
    shingles; ``place`` numbers the shingles by rank from 1; ``part`` is the size partition. Items
    without words have no rows. Rows that repeat an identifier are one item, all their shingles together.
    """
    words = items.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    chosen = F.lit(None).cast("array<bigint>")
    for size in range(k, 0, -1):
        chosen = F.when(F.col("k") == size, F.array_distinct(_shingles("w", size))).otherwise(chosen)
    sets = words.withColumn("k", F.least(F.size("w"), F.lit(k))).select("item", "k", chosen.alias("s"))
    merged = sets.groupBy("item", "k").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("s")).withColumn("n", F.size("s"))
    part = F.lit(len(SIZE_BOUNDS))
    for i, bound in reversed([*enumerate(SIZE_BOUNDS)]):
        part = F.when(F.col("n") <= bound, i).otherwise(part)
    ordered = F.array_sort(F.transform("s", lambda x: F.struct(_rank(x).alias("rank"), x.alias("shingle"))))
    return merged.select("item", "k", "n", F.ceil(F.col("n") * F.lit(containment) - 1e-9).cast("int").alias("need"), part.alias("part"), F.posexplode(ordered).alias("p", "o")).select(
        "item", "k", "n", "need", "part", (F.col("p") + 1).alias("place"), "o.rank", "o.shingle"
    )


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """Pairs ``id_col, item_id, n_item, n_shared, containment`` of documents that hold an item.

    Every document with at least ``containment`` of an item's distinct shingles is found, wherever
    they stand. Null texts are empty; null identifiers of documents are kept as null; repeated document
    rows of one identifier count as one document, their shingles together. Empty tables give no pairs.
    """
    table = stored(item_shingles(items, item_id, item_text, k, containment))
    # at most k rows per size partition: the ones in use, each with its sketches' largest rank and its shingle count
    used = sorted(table.groupBy("k", "part").agg(F.max(F.when(F.expr(IN_SKETCH), F.col("rank"))).alias("top"), F.count(F.lit(1)).alias("n")).collect())
    lengths = {size: sum(r["n"] for r in used if r["k"] == size) for size in sorted({r["k"] for r in used})}
    read = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    found = None
    for size, n in lengths.items():
        hashes = read.select("doc", words_of(F.col("text")).alias("w")).select("doc", _shingles("w", size).alias("s"))
        offers = F.concat(*(_offered("s", r["part"], r["top"]) for r in used if r["k"] == size))
        low = hashes.select("doc", F.explode(offers).alias("o")).select("doc", "o.part", "o.shingle")
        sketch = table.where(IN_SKETCH).where(F.col("k") == size).select("part", "shingle", "item")
        own = low.join(_small(sketch, n), ["part", "shingle"]).select("doc", "item")
        found = own if found is None else found.union(own)
    if found is None:
        found = read.select("doc").limit(0).crossJoin(table.select("item").limit(0))
    candidates = stored(found.distinct())
    chosen = within_broadcast(stored(candidates.select(F.col("doc").alias("_doc")).distinct()))
    verified = read.join(chosen, F.col("doc").eqNullSafe(F.col("_doc")), "left_semi")
    shared = None
    for size, n in lengths.items():
        sets = verified.select("doc", words_of(F.col("text")).alias("w")).select("doc", F.explode(F.array_distinct(_shingles("w", size))).alias("shingle"))
        own = sets.join(_small(table.where(F.col("k") == size).select("shingle", "item", "n", "need"), n), "shingle")
        shared = own if shared is None else shared.union(own)
    if shared is None:
        shared = candidates.selectExpr("doc", "item", "0L shingle", "0 n", "0 need")
    pairs = candidates.select(F.col("doc").alias("_doc"), F.col("item").alias("_item"))
    counted = (
        shared.groupBy("doc", "item", "n", "need").agg(F.countDistinct("shingle").alias("n_shared")).where("n_shared >= need")
        .join(pairs, F.col("doc").eqNullSafe(F.col("_doc")) & F.col("item").eqNullSafe(F.col("_item")), "left_semi")
    )
    return counted.select(F.col("doc").alias(id_col), F.col("item").alias("item_id"), F.col("n").alias("n_item"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment"))


def _small(side: DataFrame, rows: int) -> DataFrame:
    """``side`` marked for broadcast while its checked row count allows it; else Spark shuffles both sides."""
    return F.broadcast(side) if rows <= MAX_BROADCAST_SHINGLES else side


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without those that hold a benchmark item; rows of a null identifier stay unless one of them does."""
    gone = contained_items(docs, items, id_col, text_col, **options).select(F.col(id_col).alias("_gone")).distinct()
    gone = within_broadcast(stored(gone))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]), "left_anti")
