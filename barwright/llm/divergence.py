"""Source divergence audit: how the terms of each source differ from those of its language and of its other sources.

Tasks count terms with Arrow's own kernels (lower-casing, splitting, dictionaries, hash group-by) and give one
row per source and term; Spark merges those rows by language and term. Shards of terms then come as columns to a
task each, which computes all divergences of its terms in exact integers; sums over shards are plain aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.common import forget, stored

#: Separators: ASCII that is no letter.
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of its language that a term needs.
LEAST_DOCS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
#: Bytes of text that one step of a task works on; a longer single text is a step of its own.
STEP_BYTES = 1 << 22
#: Rows of partial counts that a task gathers before it folds them, and beyond which it gives them on.
FOLD_ROWS, GIVE_ROWS = 400_000, 300_000
#: Kept rows (language, source, term) of a shard, on average.
SHARD_ROWS = 200_000
#: Cells of one dense piece of a shard: terms times sources.
CELLS = 1 << 19

_KEYS = ["lang", "source", "term"]


def _folded(tables: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(tables)
    out = whole.group_by(_KEYS, use_threads=False).aggregate([("count", "sum"), ("docs", "sum")])
    return out.select([*_KEYS, "count_sum", "docs_sum"]).rename_columns([*_KEYS, "count", "docs"])


def _counted(batch: pa.RecordBatch) -> pa.Table:
    """Counts of one step: rows ``lang, source, term, count, docs``."""
    words = pc.split_pattern_regex(pc.ascii_lower(batch.column(2)), SEPARATORS)
    coded = pc.list_flatten(words).dictionary_encode()
    each = pa.table({"doc": pc.list_parent_indices(words).cast(pa.int32()), "code": coded.indices})
    blank = pc.index(coded.dictionary, "").as_py()
    if blank >= 0:
        each = each.filter(pc.not_equal(each.column("code"), blank))
    per_doc = each.group_by(["doc", "code"], use_threads=False).aggregate([([], "count_all")])
    found = pa.table({"lang": pc.take(batch.column(0).dictionary_encode(), per_doc.column("doc")), "source": pc.take(batch.column(1).dictionary_encode(), per_doc.column("doc")), "code": per_doc.column("code"), "n": per_doc.column("count_all")})
    sums = found.group_by(["lang", "source", "code"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
    text = lambda name: sums.column(name).cast(pa.string())
    return pa.table({"lang": text("lang"), "source": text("source"), "term": pc.take(coded.dictionary, sums.column("code")), "count": sums.column("n_sum"), "docs": sums.column("n_count")})


def partial_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, count, docs`` of the columns ``lang, source, text``, folded within each task as far as memory goes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                before = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, before + STEP_BYTES, side="right")))
                held.append(_counted(batch.slice(at, end - at)))
                at = end
                if sum(t.num_rows for t in held) > FOLD_ROWS:
                    held = [_folded(held)]
                    if held[0].num_rows > GIVE_ROWS:
                        yield from held.pop().to_batches()
        if held:
            yield from _folded(held).to_batches()

    return docs.mapInArrow(count, "lang string, source string, term string, count bigint, docs bigint")


def scaled_share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """``1 + floor(SCALE * (count + 1) / total)`` without a product that could overflow: nine decimal places one after another."""
    whole, rest = np.divmod(count + 1, total)
    for _ in range(9):
        digit, rest = np.divmod(rest * 10, total)
        whole = whole * 10 + digit
    return whole + 1


def _divergences(key: tuple, rows: pa.Table, groups: pa.Table) -> pa.Table:
    return shard_divergences(key[0].as_py(), rows, groups)


def shard_divergences(lang: str, rows: pa.Table, groups: pa.Table, piece: int = CELLS) -> pa.Table:
    """A shard's pair sums (``other`` set) and best terms (``term`` set) of each source of a language."""
    names = groups.column("source").combine_chunks()
    order = pc.sort_indices(names)
    names, n, lang_n, v = names.take(order), groups.column("n").to_numpy()[order.to_numpy()], groups.column("lang_n")[0].as_py(), groups.column("v")[0].as_py()
    s = len(names)
    sums = np.zeros((s, s), dtype=np.int64)
    out = []
    coded = rows.column("term").combine_chunks().dictionary_encode()
    term, source = coded.indices.to_numpy(zero_copy_only=False), pc.index_in(rows.column("source").combine_chunks(), names).to_numpy(zero_copy_only=False)
    by_term = np.argsort(term, kind="stable")
    term, source, count, lang_count = term[by_term], source[by_term], rows.column("count").to_numpy()[by_term], rows.column("lang_count").to_numpy()[by_term]
    # pairs: dense pieces of terms by sources, absent ones with a count of 0
    step = max(1, piece // max(1, s))
    for low in range(0, len(coded.dictionary), step):
        a, b = np.searchsorted(term, [low, low + step])
        cells = np.zeros((min(step, len(coded.dictionary) - low), s), dtype=np.int64)
        cells[term[a:b] - low, source[a:b]] = count[a:b]
        p = scaled_share(cells, n + v)
        for other in range(s):
            q = p[:, other : other + 1]
            sums[:, other] += ((p - q) * (p - q) // q).sum(axis=0)
    mine, other = np.divmod(np.flatnonzero(~np.eye(s, dtype=bool)), s)
    none = lambda kind, k: pa.nulls(k, kind)
    out.append(pa.table({"source": names.take(pa.array(mine)), "other": names.take(pa.array(other)), "term": none(pa.string(), len(mine)), "value": sums[mine, other]}))
    # terms: only those that a source has, against the whole language
    if len(term):
        p, q = scaled_share(count, (n + v)[source]), scaled_share(lang_count, lang_n + v)
        more = np.flatnonzero(p > q)
        p, q = p[more], q[more]
        words = coded.dictionary.take(pa.array(term[more]))
        out.append(pa.table({"source": names.take(pa.array(source[more])), "other": none(pa.string(), len(more)), "term": words, "value": (p - q) * (p - q) // q}))
    whole = pa.concat_tables(out)
    return whole.append_column("lang", pa.array([lang] * whole.num_rows, pa.string()))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: divergences of each source's terms.

    Terms are runs of letters (ASCII, and all characters beyond it), A-Z lower-cased; a language keeps
    those in at least ``least_docs`` of its documents. A term's share is ``p = 1 + floor(1e9 * (count + 1) / (N + V))``, of N
    occurrences of the V kept terms, and its divergence ``floor((p - q)^2 / q)``. Part ``pair`` has for each other source of the language
    the sum over all kept terms, part ``term`` the ``top`` terms of most divergence from the language among those more frequent here.

    Null languages, sources and texts are empty ones; repeated rows each count. A source without terms has its pairs;
    no documents, no rows. Sources times sources are the result, so a language's sources should be no more than that bears.
    """
    own = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    # dealt by language and term, so that both the merge and the language's totals need no further shuffle
    merged = partial_counts(own).repartition("lang", "term").groupBy(*_KEYS).agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    of_lang = Window.partitionBy("lang", "term")
    whole = merged.withColumns({"lang_count": F.sum("count").over(of_lang), "lang_docs": F.sum("docs").over(of_lang)})
    kept = stored(whole.where(F.col("lang_docs") >= least_docs).select(*_KEYS, "count", "lang_count"))

    totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    sizes = kept.groupBy("lang", "term").agg(F.max("lang_count").alias("c")).groupBy("lang").agg(F.sum("c").alias("lang_n"), F.count(F.lit(1)).alias("v"))
    groups = own.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0)
    groups = stored(groups.select("lang", "source", "n", "lang_n", "v"))

    shards = max(1, -(-kept.count() // SHARD_ROWS))
    left = kept.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int")).groupBy("lang", "shard")
    right = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).groupBy("lang", "shard")
    parts = stored(left.cogroup(right).applyInArrow(_divergences, "source string, other string, term string, value bigint, lang string"))

    pairs = parts.where("other is not null").groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    terms = parts.where("term is not null").select("lang", "source", F.col("term").alias("item"), "value", F.lit("term").alias("part"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    ranked = pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))
    forget(kept)
    forget(groups)
    return ranked.select("lang", "source", "part", "item", "value", "rank")
