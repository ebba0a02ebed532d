"""Shared helpers: table access, lineage cutting and distributed components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII upper-to-lower pair used with ``translate``: nothing outside A-Z changes.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space of the text contracts, as a character-class body.
SPACE = r"\x20\x09-\x0D"
#: Separators of the word contracts (ASCII that is neither letter nor digit), for lower-cased text.
NON_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees: ``spark.checkpoint.dir``. Where that is unset, a local one, on a local master only (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(spark, "_own_shared_dir", None) or "file://" + tempfile.mkdtemp(prefix="barwright-")
        spark._own_shared_dir = found
    return found


#: Bytes of texts that an Arrow batch holds where ``stored`` is asked for small ones.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def stored(df: DataFrame, partitions: int | None = None, small_batches: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage durably.

    The files outlive lost executors and are removed when the driver ends (or by ``forget``).
    With ``small_batches``, Python functions in ``df`` take some ``BATCH_BYTES`` at a time; the session's setting stays.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH)
    if small_batches:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    finally:
        if small_batches:
            spark.conf.set(_BATCH, before)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def forget(df: DataFrame) -> None:
    """Remove what ``stored`` wrote for ``df``, once nothing reads it any more."""
    if path := getattr(df, "_stored_path", None):
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone at exit
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of ``edges(src, dst)`` as ``(node, root)``; root is the smallest node.

    Alternating large-star and small-star rounds: every step is a map-side combined aggregate and an
    equi-join on a node, so a hub's edges are split by skew-join handling, and nothing reaches the
    driver but one flag a round. Self-loops and repeated or null edges are ignored.
    """
    current = stored(
        edges.where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    for _ in range(max_rounds):
        if _settled(current):
            break
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .where("u > v")
            .distinct()
        )
        following = stored(small)
        forget(current)
        current = following
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _settled(edges: DataFrame) -> bool:
    """Whether every node is either a root or has one edge, to a root."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    each = ends.groupBy("e.n").agg(F.sum("e.up").alias("up"), F.sum("e.down").alias("down"))
    return not each.agg(F.max(((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).cast("int"))).first()[0]


def lower_ascii(text):
    return F.translate(text, UPPER, LOWER)


#: Elements that ``scan`` folds at a time: each step of a fold copies its state, so what it gathers must stay short.
SCAN_RUN = 256


def bound(value: Column, f) -> Column:
    """``f(value)`` with ``value`` evaluated once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def scan(rows: Column, zero: Column, following, emitted, empty: Column) -> Column:
    """What a left-to-right pass over an array emits, in time linear in its length, natively.

    From the state ``s`` (first ``zero``), an element ``x`` emits the array ``emitted(s, x)`` and leaves
    ``following(s, x)``. ``empty`` is an empty array of the emitted type.
    """

    def states(chunks: Column) -> Column:
        return F.aggregate(chunks, F.array(zero), lambda a, c: F.concat(a, F.array(F.aggregate(c, F.element_at(a, -1), following))))

    def run(start: Column, chunk: Column) -> Column:
        step = lambda a, x: F.struct(following(a["s"], x).alias("s"), F.concat(a["out"], emitted(a["s"], x)).alias("out"))
        return F.aggregate(chunk, F.struct(start.alias("s"), empty.alias("out")), step, lambda a: a["out"])

    def whole(r: Column) -> Column:
        last = F.floor((F.size(r) - 1) / SCAN_RUN).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(r, c * SCAN_RUN + 1, F.lit(SCAN_RUN)))
        return bound(chunks, lambda cs: bound(states(cs), lambda ss: F.flatten(F.transform(cs, lambda c, i: run(F.get(ss, i), c)))))

    return bound(rows, lambda r: F.when(F.size(r) > 0, whole(r)).otherwise(empty))


def found_spans(text, regex):
    """All leftmost, non-overlapping matches of ``regex`` as ``array<struct<start,end,text>>`` in code points, natively.

    ``regex`` may be a string or a column and must not match the empty string.
    """
    regex = F.lit(regex) if isinstance(regex, str) else regex
    gaps, hits = F.split(text, regex, -1), F.regexp_extract_all(text, regex, F.lit(0))
    pairs = bound(hits, lambda h: F.zip_with(F.slice(gaps, F.lit(1), F.size(h)), h, lambda g, t: F.struct(F.length(g).alias("gap"), F.length(t).alias("size"), t.alias("text"))))
    return scan(
        pairs, F.lit(0),
        lambda at, x: at + x["gap"] + x["size"],
        lambda at, x: F.array(F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), x["text"].alias("text"))),
        F.array().cast("array<struct<start:int,end:int,text:string>>"),
    )


#: Rows of (say) two longs that may be broadcast: some 50 MB as a hash table.
MAX_BROADCAST_ROWS = 1_000_000


def within_broadcast(side: DataFrame, bound: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``side`` marked for broadcast if its row count, checked here, is within ``bound``; else as it is, for a shuffle join."""
    return F.broadcast(side) if side.limit(bound + 1).count() <= bound else side


def follow_hot(hot: DataFrame, links: DataFrame, verify, pivots: int = 1, last=None) -> DataFrame:
    """``links(src, dst)`` with those that only the crowded signatures ``hot(sig, node)`` show.

    ``verify`` turns distinct ``pairs(a, b)`` into links. Pivot rounds hold every node of a signature
    against one of them, in an order of its own each round; signatures whose nodes are in one
    component need no more. The last round pairs nodes across a signature's remaining components, or
    leaves that to ``last(rows)`` of ``sig, n, root``, which gives the links.
    """
    done = None
    for turn in range(pivots + 1):
        roots = components(links)
        rows = hot.join(roots, hot["node"] == roots["node"], "left").select("sig", hot["node"].alias("n"), F.coalesce("root", hot["node"]).alias("root"))
        rows = stored(rows)
        several = rows.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("sig")
        rows = stored(rows.join(several, "sig", "left_semi"))
        if not rows.take(1):
            break
        if turn == pivots and last is not None:
            return stored(links.union(last(rows)))
        if turn < pivots:
            chosen = rows.groupBy("sig").agg(F.min_by(F.struct("n", "root"), F.xxhash64("root", "n", F.lit(turn))).alias("p"))
            pairs = rows.join(chosen, "sig").where("root <> p.root").select(F.least("n", "p.n").alias("a"), F.greatest("n", "p.n").alias("b"))
        else:
            other = rows.select("sig", F.col("n").alias("n2"), F.col("root").alias("root2"))
            pairs = rows.join(other, "sig").where("root < root2").select(F.least("n", "n2").alias("a"), F.greatest("n", "n2").alias("b"))
        pairs = pairs.distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = stored(pairs)
        done = pairs if done is None else done.union(pairs)
        links = stored(links.union(verify(pairs)))
    return links
