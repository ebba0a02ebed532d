"""Windows and recurrences over long keys without one task per key.

Bounded frames run over row blocks with halos: rows of a key are numbered without sorting the whole key in one
task (time chunks are numbered within, and a prefix sum over the small table of chunk counts gives their
offsets), and blocks of equal row counts carry the last rows of the block before.

Unbounded ones (running aggregates, exponential means) run over (key, time chunk): each chunk comes to a
summary, a prefix over the small table of summaries gives what is carried into a chunk, and one join brings it
back to the chunk's rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, at least; a halo of more rows makes blocks of four halos.
BLOCK_ROWS = 20_000
#: Largest exponent of a weight within a unit of rows: far from overflow, and precise to 1e-13.
EXPONENT = 300.0


def index_rows(df: DataFrame, by: list[str], order: list[str], name: str = "_ix", chunk: str = "day") -> DataFrame:
    """Number the rows of each key from 0 by ``order``, whose first column is a time; ties beyond ``order`` are arbitrary.

    This reads ``df`` twice. Chains of operators should therefore number their rows once, keep the
    column ``_ix`` through all steps and drop it at the end: see ``indexed``.
    """
    rows = df.withColumn("_ix_chunk", F.date_trunc(chunk, F.col(order[0]).cast("timestamp")))
    inside = Window.partitionBy(*by, "_ix_chunk").orderBy(*order)
    across = Window.partitionBy(*by).orderBy(F.col("_ix_chunk").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*by, "_ix_chunk").agg(F.count(F.lit(1)).alias("_ix_n")).withColumn("_ix_from", F.coalesce(F.sum("_ix_n").over(across), F.lit(0))).drop("_ix_n")
    side = counts.select(*(F.col(c).alias(f"_ix_k{i}") for i, c in enumerate([*by, "_ix_chunk"])), "_ix_from")
    same = F.lit(True)
    for i, c in enumerate([*by, "_ix_chunk"]):
        same = same & F.col(c).eqNullSafe(F.col(f"_ix_k{i}"))
    numbered = rows.withColumn("_ix_r", F.row_number().over(inside))
    return numbered.join(side, same).withColumn(name, F.col("_ix_from") + F.col("_ix_r") - 1).drop("_ix_chunk", "_ix_r", "_ix_from", *(f"_ix_k{i}" for i in range(len(by) + 1)))


def blocks(df: DataFrame, index: str = "_ix", size: int = BLOCK_ROWS, before: int = 0, after: int = 0) -> DataFrame:
    """Copies of rows for each block that needs them: adds ``_ix_block`` and ``_ix_own`` (false for halo rows)."""
    if max(before, after) > size:
        raise ValueError("a halo must fit into one block")
    at = F.floor(F.col(index) / size)
    inside = F.col(index) % size
    spots = F.array(
        F.struct(at.alias("b"), F.lit(True).alias("own")),
        F.when(inside >= size - before, F.struct((at + 1).alias("b"), F.lit(False).alias("own"))) if before else F.lit(None).cast("struct<b:bigint,own:boolean>"),
        F.when((inside < after) & (at > 0), F.struct((at - 1).alias("b"), F.lit(False).alias("own"))) if after else F.lit(None).cast("struct<b:bigint,own:boolean>"),
    )
    dealt = df.withColumn("_ix_s", F.explode(F.filter(spots, lambda s: s.isNotNull())))
    return dealt.withColumns({"_ix_block": F.col("_ix_s.b"), "_ix_own": F.col("_ix_s.own")}).drop("_ix_s")


def indexed(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` with its rows numbered in ``_ix``, unless an operator before has done so."""
    return df if "_ix" in df.columns else index_rows(df, by, order)


#: A step adds columns to dealt rows, given the window over (key, block) by row number.
Step = Callable[[DataFrame, Window], DataFrame]


def in_blocks(df: DataFrame, steps: list[Step], by: list[str], order: list[str], before: int = 0, after: int = 0, size: int | None = None) -> DataFrame:
    """Apply ``steps`` one after another to the same blocks: one exchange and one sort for them all.

    ``before`` and ``after`` are the rows that the steps reach in sum. A step must treat a block's
    edge as the series' end only if its frame would pass it, which the halo prevents.
    """
    size = size or max(BLOCK_ROWS, 4 * max(before, after))
    dealt = blocks(indexed(df, by, order), "_ix", size, before, after)
    w = Window.partitionBy(*by, "_ix_block").orderBy("_ix")
    for step in steps:
        dealt = step(dealt, w)
    return dealt.where("_ix_own").drop("_ix_block", "_ix_own", *([] if "_ix" in df.columns else ["_ix"]))


def columns_step(columns: dict[str, Callable[[Window], Column]]) -> Step:
    return lambda rows, w: rows.withColumns({n: f(w) for n, f in columns.items()})


def over_blocks(df: DataFrame, columns: dict[str, Callable[[Window], Column]], by: list[str], order: list[str], before: int = 0, after: int = 0, size: int | None = None) -> DataFrame:
    """Add window columns whose frames reach at most ``before`` rows back and ``after`` rows ahead."""
    return in_blocks(df, [columns_step(columns)], by, order, before, after, size)


def chunk_key(by: list[str], order: list[str], chunk: str | int = "day") -> Column:
    """A struct of the key and the chunk: a unit of time, or so many numbers where the first column of ``order`` is one.

    It is never null itself, so that joins on it are plain ones, and null keys are equal.
    """
    at = F.floor(F.col(order[0]) / chunk) if isinstance(chunk, int) else F.date_trunc(chunk, F.col(order[0]).cast("timestamp"))
    return F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by)), at.alias("at"))


def chunked(df: DataFrame, by: list[str], order: list[str], chunk: str | int = "day") -> DataFrame:
    """``df`` with ``_ck``, the ``chunk_key`` of its rows, unless an operator before has added it.

    Chains of operators that keep it deal their rows once, as all work over its values; it is dropped at the end.
    """
    return df if "_ck" in df.columns else df.withColumn("_ck", chunk_key(by, order, chunk))


def chunk_table(totals: DataFrame, by: list[str]) -> DataFrame:
    """Summaries by ``_ck`` with the key and the time as columns of their own, so that all windows over them share one exchange."""
    return totals.withColumns({**{f"_k{i}": F.col(f"_ck.k{i}") for i in range(len(by))}, "_at": F.col("_ck.at")})


def over_chunks(by: list[str], *more: str, falling: bool = False):
    """Window over the chunks of a key in time order, or the reverse of it, on a ``chunk_table``."""
    at = F.col("_at").desc_nulls_last() if falling else F.col("_at").asc_nulls_first()
    return Window.partitionBy(*(f"_k{i}" for i in range(len(by)))).orderBy(at, *more)


def decayed(rows: DataFrame, sums: dict[str, tuple[Column, str, float]], keys: list[str], order: list) -> DataFrame:
    """Adds ``{name: (part, count, rate)}``: the sum of ``part`` so far, each weighted by ``exp(-rate * (count here - count there))``; ``count`` does not fall.

    Rows fall into segments within which no weight overflows. Of the segments before, only the last
    one is seen: what lies beyond it has faded by exp(-EXPONENT).
    """
    whole = Window.partitionBy(*keys).orderBy(*order)
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    steps: list[dict[str, Column]] = [{}, {}, {}, {}, {}]
    for i, (name, (part, count, rate)) in enumerate(sums.items()):
        length = max(1, int(EXPONENT / rate))
        at = F.floor(F.col(count) / length)
        here = F.exp((F.col(count) - at * length) * rate)
        own = Window.partitionBy(*keys, f"_dg{i}").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        steps[0] |= {f"_dg{i}": at, f"_dp{i}": F.coalesce(part, F.lit(0.0)) * here, f"_dw{i}": here}
        steps[1][f"_do{i}"] = F.sum(f"_dp{i}").over(own) / F.col(f"_dw{i}")
        steps[2][f"_de{i}"] = F.when(F.lead(f"_dg{i}").over(whole) != F.col(f"_dg{i}"), F.struct(F.col(f"_do{i}").alias("y"), F.col(count).alias("n")))
        steps[3][f"_db{i}"] = F.last(f"_de{i}", ignorenulls=True).over(before)
        steps[4][name] = F.col(f"_do{i}") + F.coalesce(F.col(f"_db{i}.y") * F.exp((F.col(f"_db{i}.n") - F.col(count)) * rate), F.lit(0.0))
    for step in steps:
        rows = rows.withColumns(step)
    return rows.drop(*(f"_d{k}{i}" for k in "gpwoeb" for i in range(len(sums))))


#: What a mean is taken of: a column, or a function of this row and the row before (structs of the columns in ``back``, the latter null in a key's first row).
Averaged = str | Column | Callable[[Column, Column], Column]


def ewm(df: DataFrame, columns: dict[str, tuple[Averaged, float]], by: list[str], order: list[str], seed: str = "first", seed_rows: int = 1, back: tuple[str, ...] = (), chunk: str = "day", run: int | None = None) -> DataFrame:
    """Add exponential means ``y = alpha x + (1 - alpha) y_before`` as ``{name: (x, alpha)}``.

    ``seed="first"`` starts at the first value, ``"sma"`` at the mean of the first ``seed_rows`` values
    (null before). A row without ``x`` is skipped: it shows the mean so far. ``x`` may compare a row with the one before it, see
    ``Averaged``. The first column of ``order`` is a time.

    Rows of (key, time chunk) fall into units of ``run`` rows at most. A unit turns the mean before it into
    the mean behind it by an affine map, ``decay * y + own``; a prefix composes those maps over the table of units. So the
    result is exact for gaps of any length, and a task needs one chunk of a key.
    """
    by, order = [*by], [*order]
    if lasting := {n: x for n, (x, alpha) in columns.items() if alpha >= 1}:
        df = running(df, {n: ("last", x) for n, x in lasting.items()}, by, order, chunk=chunk)
    items = [(n, x, a, -math.log(1 - a)) for n, (x, a) in columns.items() if a < 1]
    if not items:
        return df
    kept = [c for c in df.columns if c not in columns or c in lasting]
    rows = df
    if seed != "first" and seed_rows > 1:
        if any(callable(x) and not isinstance(x, Column) for _, x, _, _ in items):
            raise ValueError("a mean of several first rows needs plain columns")
        rows, items = _seeded(rows, items, seed_rows, by, order, chunk)
    w = Window.partitionBy("_ck").orderBy(*order)
    now = F.struct(*back) if back else None
    made = chunked(rows, by, order, chunk).withColumns({"_er": F.row_number().over(w)} | ({"_ew": F.lag(now).over(w)} if back else {}))
    compared = [callable(x) and not isinstance(x, Column) for _, x, _, _ in items]
    run = run or max(1, int(EXPONENT / max(rate for *_, rate in items)))
    values = {"_es": F.floor((F.col("_er") - 1) / run).cast("int")}
    for i, (_, x, _, _) in enumerate(items):  # what a chunk's first row is compared with is not in the chunk: see below
        values[f"_ex{i}"] = F.when(F.col("_er") > 1, x(now, F.col("_ew")).cast("double")) if compared[i] else (F.col(x) if isinstance(x, str) else x).cast("double")
    upto = Window.partitionBy("_ck", "_es").orderBy("_er").rowsBetween(Window.unboundedPreceding, 0)
    made = made.withColumns(values).withColumns({f"_en{i}": F.count(f"_ex{i}").over(upto) for i in range(len(items))})
    local = {}
    for i, (_, _, alpha, rate) in enumerate(items):
        place = F.col(f"_en{i}") * rate
        local[f"_eo{i}"] = F.coalesce(F.sum(alpha * F.col(f"_ex{i}") * F.exp(place)).over(upto), F.lit(0.0)) * F.exp(-place)
        local[f"_ef{i}"] = F.first(f"_ex{i}", ignorenulls=True).over(upto)
    made = made.withColumns(local)

    # units, then what is carried into each
    last = F.col("_er")
    totals = [F.max_by(F.struct(*(F.col(f"_e{k}{i}") for i in range(len(items)) for k in "nof")), last).alias("u")]
    if back:
        totals += [F.min_by(now, last).alias("top"), F.max_by(now, last).alias("end")]
    units = chunk_table(made.groupBy("_ck", "_es").agg(*totals), by)
    over = over_chunks(by, "_es")
    so_far, before = over.rowsBetween(Window.unboundedPreceding, 0), over.rowsBetween(Window.unboundedPreceding, -1)
    keys, place = [f"_k{i}" for i in range(len(by))], [F.col("_at").asc_nulls_first(), F.col("_es")]
    if back:
        units = units.withColumn("was", F.lag("end").over(over))
    steps: list[dict[str, Column]] = [{}, {}, {}, {}, {}]
    for i, (_, x, alpha, rate) in enumerate(items):
        n, own, first, v = (*(F.col(f"u._e{k}{i}") for k in "nof"), F.col(f"v{i}"))
        steps[0][f"v{i}"] = F.when(F.col("_es") == 0, x(F.col("top"), F.col("was")).cast("double")) if compared[i] else F.lit(None).cast("double")
        steps[1] |= {f"b{i}": own + F.coalesce(alpha * v * F.exp(-n * rate), F.lit(0.0)), f"c{i}": n + v.isNotNull().cast("long"), f"f{i}": F.coalesce(v, first)}
        steps[2] |= {f"n{i}": F.sum(f"c{i}").over(so_far), f"f{i}": F.first(f"f{i}", ignorenulls=True).over(before)}
        steps[3] |= {f"n{i}": F.lag(f"n{i}").over(over), f"d{i}": F.lag(f"d{i}").over(over)}
        y = F.when(F.col(f"n{i}") > 0, F.col(f"d{i}") + F.col(f"f{i}") * F.exp(-F.col(f"n{i}") * rate))  # the first value of all has the full weight
        steps[4][f"y{i}"] = F.when(v.isNull(), y).otherwise(F.coalesce(alpha * v + (1 - alpha) * y, v))
    for step in steps[:3]:
        units = units.withColumns(step)
    units = decayed(units, {f"d{i}": (F.col(f"b{i}"), f"n{i}", rate) for i, (*_, rate) in enumerate(items)}, keys, place)
    for step in steps[3:]:
        units = units.withColumns(step)
    side = units.groupBy("_ck").agg(F.array_sort(F.collect_list(F.struct("_es", *steps[4]))).alias("_ec")).withColumnRenamed("_ck", "_cs")
    met = made.join(side, F.col("_ck") == F.col("_cs"))
    done = {}
    for i, (name, _, _, rate) in enumerate(items):
        before_unit = F.get("_ec", F.col("_es"))[f"y{i}"]
        done[name] = F.col(f"_eo{i}") + F.coalesce(before_unit, F.col(f"_ef{i}")) * F.exp(-F.col(f"_en{i}") * rate)
    return met.select(*(F.col(f"`{c}`") for c in kept), *(c.alias(n) for n, c in done.items()))


def _seeded(rows: DataFrame, items: list, seed_rows: int, by: list[str], order: list[str], chunk: str) -> tuple[DataFrame, list]:
    """The columns of ``items`` with null for values before the ``seed_rows``-th one, which becomes the mean of them all."""
    given = rows.withColumns({f"_sx{i}": (F.col(x) if isinstance(x, str) else x).cast("double") for i, (_, x, _, _) in enumerate(items)})
    sums = {f"_s{k}{i}": (kind, f"_sx{i}") for i in range(len(items)) for k, kind in (("n", "count"), ("s", "sum"))}
    seen = running(given, sums, by, order, chunk=chunk)
    out = []
    for i, (name, _, alpha, rate) in enumerate(items):
        n = F.col(f"_sn{i}")
        out.append((name, F.when(n > seed_rows, F.col(f"_sx{i}")).when((n == seed_rows) & F.col(f"_sx{i}").isNotNull(), F.col(f"_ss{i}") / seed_rows), alpha, rate))
    return seen, out


#: Running aggregates: over the rows of a window, and over the totals of chunks.
RUNNING = {"last": lambda c: F.last(c, ignorenulls=True), "max": F.max, "min": F.min, "sum": F.sum, "count": F.count}


def carried(rows: DataFrame, totals: list[Column], across: list[dict[str, Callable]], by: list[str]) -> DataFrame:
    """``rows`` (see ``chunked``) with prefixes over their chunks.

    ``totals`` are aggregates of a chunk; each entry of ``across`` adds columns to the table of chunks, given
    the window of a key's chunks in time order. Those of the last entry come back to the rows.
    """
    side = chunk_table(rows.groupBy("_ck").agg(*totals), by)
    for made in across:
        side = side.withColumns({n: f(over_chunks(by)) for n, f in made.items()})
    side = side.select(F.col("_ck").alias("_cs"), *across[-1])
    return rows.join(side, F.col("_ck") == F.col("_cs")).drop("_cs")


def earlier(w):
    """Frame of the chunks before this one in the window's order."""
    return w.rowsBetween(Window.unboundedPreceding, -1)


def running(df: DataFrame, columns: dict[str, tuple[str, str | Column]], by: list[str], order: list[str], ahead: bool = False, chunk: str | int = "day") -> DataFrame:
    """Add ``{name: (kind, x)}``: what the key's rows so far come to, this one included, or with ``ahead`` those from here on.

    Kinds: ``last`` (value that is not null, ``ahead`` the next one), ``max``, ``min``, ``sum``,
    ``count``. Windows are over (key, time chunk); what earlier chunks come to is a prefix over the
    table of chunk totals, so no task needs a whole key. The first column of ``order`` is a time, or a number and ``chunk`` too.
    ``ahead`` goes through the rows backwards: frames that end with a chunk would be gone through again for every row.
    """
    by = [*by]
    rows = chunked(df, by, order, chunk)
    rows = rows.withColumns({f"_rx{i}": F.col(x) if isinstance(x, str) else x for i, (_, x) in enumerate(columns.values())})
    place = F.struct(*order)
    totals, inside, across, both = [], {}, {}, {}
    here = Window.partitionBy("_ck").orderBy(*(F.col(c).desc() if ahead else c for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    chunks = earlier(over_chunks(by, falling=ahead))
    for i, (name, (kind, _)) in enumerate(columns.items()):
        x, total, before, now = f"_rx{i}", f"_rt{i}", f"_rb{i}", f"_rn{i}"
        if kind == "last":
            edge = F.min_by if ahead else F.max_by
            totals.append(edge(x, F.when(F.col(x).isNotNull(), place)).alias(total))
            inside[now], across[before] = RUNNING["last"](x).over(here), (lambda w, total=total: RUNNING["last"](total).over(chunks))
            both[name] = F.coalesce(now, before)
        else:
            totals.append(RUNNING[kind](x).alias(total))
            fold = F.sum if kind == "count" else RUNNING[kind]
            inside[now], across[before] = RUNNING[kind](x).over(here), (lambda w, fold=fold, total=total: fold(total).over(chunks))
            join = {"max": F.greatest, "min": F.least}.get(kind)
            both[name] = join(now, before) if join else F.coalesce(F.col(now) + F.col(before), F.col(now), F.col(before))
    done = carried(rows.withColumns(inside), totals, [across], by).withColumns(both)
    return done.select(*(c for c in df.columns if c not in columns), *columns)
