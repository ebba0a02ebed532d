"""Scaling, classification, regimes and set features on Spark ML and SQL."""

from __future__ import annotations

import json
import math
import re
from fractions import Fraction
from itertools import combinations
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwright.functions.scalar import both, either, gt, lt, negate, protected_div, protected_inv, protected_log, protected_sqrt, safe_ratio
from barwright.operators import selection
from barwright.operators.asof import new_rows
from barwright.operators.clean import sanitize
from barwright.operators.resample import numbered, shuffled_place
from barwright.operators.scan import over_blocks


def scale_stats(df: DataFrame, cols: list[str], kind: str) -> DataFrame:
    """``column, center, width`` to scale with: ``standard`` (sample), ``minmax`` or ``robust`` (median and quartiles)."""
    made = []
    for c in cols:
        if kind == "standard":
            made += [F.avg(c).alias(f"{c}__c"), F.stddev_samp(c).alias(f"{c}__w")]
        elif kind == "minmax":
            made += [F.min(c).cast("double").alias(f"{c}__c"), (F.max(c) - F.min(c)).cast("double").alias(f"{c}__w")]
        else:
            made += [F.col(f"{c}__m").alias(f"{c}__c"), (F.col(f"{c}__h") - F.col(f"{c}__l")).alias(f"{c}__w")]
    row = selection.quantiles(df, {f"{c}__{n}": (c, q) for c in cols for n, q in (("l", 0.25), ("m", 0.5), ("h", 0.75))}, []).select(*made) if kind == "robust" else df.agg(*made)
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}__c").alias("center"), F.col(f"{c}__w").alias("width")) for c in cols))).alias("s")).select("s.*")


def scale(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with ``cols`` scaled by stored ``stats``; a width of 0 counts as 1."""
    known = stats.groupBy().pivot("column", cols).agg(F.first(F.struct("center", "width")))
    met = df.crossJoin(F.broadcast(known.toDF(*(f"_{c}" for c in cols))))
    width = lambda c: F.when(F.col(f"_{c}.width") == 0, 1.0).otherwise(F.col(f"_{c}.width"))
    return met.withColumns({c: (F.col(c) - F.col(f"_{c}.center")) / width(c) for c in cols}).drop(*(f"_{c}" for c in cols))


def _vector(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df.fillna(0.0, features))


def classify(train: DataFrame, calibrate: DataFrame, score: DataFrame, features: list[str], label: str = "label", trees: int = 30, depth: int = 6, seed: int = 42) -> DataFrame:
    """``score`` with ``probability``, an array over classes: random forest, isotonic per class on ``calibrate``, renormalised."""
    model = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed).fit(_vector(train, features))
    raw = lambda d: model.transform(_vector(d, features)).withColumn("_p", vector_to_array("probability")).drop("features", "rawPrediction", "probability", "prediction")
    held, out = raw(calibrate), raw(score)
    names = []
    for k in range(model.numClasses):
        iso = IsotonicRegression(featuresCol="_f", labelCol="_y", predictionCol=f"_c{k}").fit(VectorAssembler(inputCols=["_s"], outputCol="_f").transform(held.select(F.get("_p", F.lit(k)).alias("_s"), (F.col(label) == k).cast("double").alias("_y"))))
        out = iso.transform(VectorAssembler(inputCols=["_s"], outputCol="_f").transform(out.withColumn("_s", F.get("_p", F.lit(k))))).drop("_s", "_f")
        names.append(f"_c{k}")
    total = sum(F.col(c) for c in names)
    share = F.array(*(F.when(total > 0, F.col(c) / total).otherwise(F.get("_p", F.lit(i))) for i, c in enumerate(names)))
    return out.withColumn("probability", share).drop("_p", *names)


def meta_model(train: DataFrame, score: DataFrame, features: list[str], label: str = "label", seed: int = 42) -> DataFrame:
    """``score`` with ``probability`` of label 1 from boosted trees on the pooled rows."""
    model = GBTClassifier(labelCol=label, featuresCol="features", maxIter=15, maxDepth=4, seed=seed).fit(_vector(train, features))
    return model.transform(_vector(score, features)).withColumn("probability", F.get(vector_to_array("probability"), F.lit(1))).drop("features", "rawPrediction", "prediction")


def regimes(df: DataFrame, features: list[str], k: int = 4, seed: int = 42) -> DataFrame:
    """``df`` with ``regime`` and ``posterior`` of a Gaussian mixture on standardised features."""
    steps = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True), GaussianMixture(featuresCol="scaled", k=k, seed=seed, predictionCol="regime", probabilityCol="posterior")])
    ready = _vector(df, features)
    return steps.fit(ready).transform(ready).withColumn("posterior", vector_to_array("posterior")).drop("features", "scaled")


def transitions(df: DataFrame, regime: str, by: list[str], order: list[str]) -> DataFrame:
    """``src, dst, p``: shares of moves between consecutive rows' regimes."""
    led = over_blocks(df, {"_n": lambda w: F.lead(regime).over(w)}, by, order, after=1)
    moves = led.where("_n is not null").groupBy(F.col(regime).alias("src"), F.col("_n").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    total = moves.groupBy("src").agg(F.sum("n").alias("_t"))
    return moves.join(total, "src").select("src", "dst", (F.col("n") / F.col("_t")).alias("p"))


def next_regime(posteriors: DataFrame, moves: DataFrame, key: list[str], posterior: str = "posterior") -> DataFrame:
    """``key, dst, p``: posterior times the transition matrix."""
    long = posteriors.select(*key, F.posexplode(posterior).alias("src", "w"))
    return long.join(moves, "src").groupBy(*key, "dst").agg(F.sum(F.col("w") * F.col("p")).alias("p"))


def anomaly(df: DataFrame, column: str, k: int = 3, sigmas: float = 3.0) -> DataFrame:
    """``df`` with ``error`` (squared distance from the first ``k`` principal axes of standardised vectors) and ``anomalous``."""
    from pyspark.ml.functions import array_to_vector

    ready = df.withColumn("features", array_to_vector(F.col(column)))
    model = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True), PCA(k=k, inputCol="scaled", outputCol="axes")]).fit(ready)
    made = model.transform(ready).withColumns({"_s": vector_to_array("scaled"), "_a": vector_to_array("axes")})
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)
    error = made.withColumn("error", square(F.col("_s")) - square(F.col("_a"))).drop("features", "scaled", "axes", "_s", "_a")
    limit = error.agg((F.avg("error") + sigmas * F.stddev_samp("error")).alias("_limit"))
    return error.crossJoin(F.broadcast(limit)).withColumn("anomalous", F.col("error") > F.col("_limit")).drop("_limit")


def conformal(calibration: DataFrame, scored: DataFrame, probs: str, label: str, alpha: float = 0.1) -> DataFrame:
    """``scored`` with ``set_size``: classes until their sorted probabilities reach the calibrated cumulative quantile."""
    top = lambda c: F.sort_array(c, asc=False)
    upto = F.aggregate(F.filter(probs, lambda p: p >= F.get(probs, F.col(label))), F.lit(0.0), lambda s, p: s + p)
    q = selection.quantiles(calibration.select(upto.alias("_u")), {"_q": ("_u", 1 - alpha)}, [])
    met = scored.crossJoin(F.broadcast(q))
    size = F.aggregate(
        top(F.col(probs)), F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")),
        lambda s, p: F.when(s["sum"] >= F.col("_q"), s).otherwise(F.struct((s["sum"] + p).alias("sum"), (s["n"] + 1).alias("n"))), lambda s: s["n"],
    )
    return met.withColumn("set_size", size).drop("_q")


#: Sets that have at most so many subsets to share with a similar one are counted by these, longer ones met in pairs.
MAX_SUBSETS = 4_000


def _least_shared(n: int, m: int, share: Fraction) -> int:
    """Items that sets of ``n`` and ``m`` have in common at least where their Jaccard similarity reaches ``share``."""
    return max(1, math.ceil(share * (n + m) / (1 + share)))


def _subset_tables(share: Fraction) -> tuple[int, list, list]:
    """Longest counted size, places ``(n, j, keep)`` of subsets of ``j`` out of ``n``, and weights ``(n, m, j, c)``.

    Over the sets of ``m`` that hold each subset of ``j``, the weights sum up to how many share ``t`` items or more
    (inclusion and exclusion): ``sum over j >= t of (-1)^(j - t) * C(j - 1, t - 1)``.
    """
    least = lambda n: max(1, math.ceil(share * n))
    longest = 1
    while longest < 20 and sum(math.comb(longest + 1, j) for j in range(least(longest + 1), longest + 2)) <= MAX_SUBSETS:
        longest += 1
    sizes = range(1, longest + 1)
    places = [(n, j, [*keep]) for n in sizes for j in range(least(n), n + 1) for keep in combinations(range(n), j)]
    weights = [(n, m, j, (-1) ** (j - t) * math.comb(j - 1, t - 1)) for n in sizes for m in sizes for t in [_least_shared(n, m, share)] for j in range(t, min(n, m) + 1)]
    return longest, places, weights


def niche_share(sets: DataFrame, key: str, items: str, fitness: str, threshold: float = 0.7) -> DataFrame:
    """``key, niche, shared_fitness``: fitness over the number of sets (itself included) of Jaccard similarity at least ``threshold``.

    Equal sets fold first. Similar sets share a subset that lacks few items of either, so each set counts the sets
    that hold its subsets, and no two sets meet: the work grows with the sets. Sets with more than ``MAX_SUBSETS``
    such subsets meet others in their rarest items instead: similar ones share one of the first
    ``n - ceil(threshold * n) + 1`` each, and are compared at the first they share. Empty sets have a niche of one.
    """
    spark, share = sets.sparkSession, Fraction(str(threshold))
    if not 0 < share <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    longest, places, weights = _subset_tables(share)
    rows = sets.select(key, F.array_sort(F.array_distinct(F.array_compact(items))).alias("_s"), fitness)
    folded = rows.where(F.size("_s") > 0).groupBy("_s").agg(F.count(F.lit(1)).alias("_w"))
    places = F.broadcast(spark.createDataFrame(places, "_n int, _j int, _keep array<int>"))
    weights = F.broadcast(spark.createDataFrame(weights, "_n int, _m int, _j int, _c long"))
    parts = folded.withColumn("_n", F.size("_s")).join(places, "_n").select("_s", "_w", "_n", "_j", F.transform("_keep", lambda i: F.get("_s", i)).alias("_p"))
    held = parts.groupBy("_p", F.col("_n").alias("_m")).agg(F.sum("_w").alias("_h"))
    counted = parts.drop("_w").join(held, "_p").join(weights, ["_n", "_m", "_j"]).groupBy("_s").agg(F.sum(F.col("_c") * F.col("_h")).alias("niche"))
    met = _met_in_rare(folded, share, longest)
    niche = counted.unionByName(met).groupBy("_s").agg(F.sum("niche").alias("niche"))
    return rows.join(niche, "_s", "left").select(key, F.coalesce("niche", F.lit(1)).cast("long").alias("niche"), (F.col(fitness) / F.coalesce("niche", F.lit(1))).alias("shared_fitness"))


def _met_in_rare(folded: DataFrame, share: Fraction, longest: int) -> DataFrame:
    """``_s, niche`` over pairs of similar sets of which at least one has more than ``longest`` items."""
    up, down = share.numerator, share.denominator
    folded = folded.where(F.size("_s") * down >= up * (longest + 1))  # shorter ones are not similar to any such set
    long = folded.select("_s", "_w", F.explode("_s").alias("_e"))
    rare = long.groupBy("_e").agg(F.count(F.lit(1)).alias("_f"))
    ranked = long.join(rare, "_e").groupBy("_s", "_w").agg(F.sort_array(F.collect_list(F.struct("_f", "_e"))).alias("_r"))
    first = (F.floor(F.size("_s") - F.ceil(F.size("_s") * up / down - 1e-9)) + 1).cast("int")
    left = ranked.select("_s", "_w", F.slice(F.transform("_r", lambda x: x["_e"]), F.lit(1), first).alias("_p"))
    left = left.select("*", F.explode("_p").alias("_e"))
    right = left.toDF("_s2", "_w2", "_p2", "_e")
    n, m = F.size("_s"), F.size("_s2")
    shared = F.size(F.array_intersect("_s", "_s2"))
    near = (F.greatest(n, m) > longest) & (F.least(n, m) * down >= up * F.greatest(n, m)) & (F.get(F.array_intersect("_p", "_p2"), F.lit(0)) == F.col("_e"))
    alike = left.join(right, "_e").where(near & (shared * down >= up * (n + m - shared)))
    return alike.groupBy("_s").agg(F.sum("_w2").alias("niche"))


def multi_hot(df: DataFrame, items: str, names: list) -> DataFrame:
    """Adds one 0/1 column ``has_{name}`` per listed item."""
    return df.withColumns({f"has_{n}": F.array_contains(items, n).cast("int") for n in names})


def sentiment(headlines: DataFrame, lexicon: DataFrame, batch: list[str], order: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``batch, n, mean_score, momentum``: mean lexicon weight of words per batch and its change from the batch before.

    ``lexicon`` has ``word, weight``; headlines without a known word score 0.
    """
    words = headlines.select(*batch, key, F.explode(F.split(F.lower(text), r"[^a-z']+")).alias("word")).where("word <> ''")
    scores = words.join(lexicon, "word").groupBy(*batch, key).agg(F.avg("weight").alias("s"))
    every = headlines.select(*batch, key).join(scores, [*batch, key], "left")
    made = every.groupBy(*batch).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("s", F.lit(0.0))).alias("mean_score"))
    return made.withColumn("momentum", F.col("mean_score") - F.lag("mean_score").over(Window.orderBy(*order)))


#: Functions a formula may call, by name.
FORMULA_FUNCTIONS = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: protected_div(a, b, 1e-3, True),
    "sqrt": protected_sqrt, "log": protected_log, "inv": protected_inv, "abs": F.abs, "neg": lambda a: -a, "max": F.greatest, "min": F.least,
    "gt": gt, "lt": lt, "and": both, "or": either, "not": negate,
}
_TOKEN = re.compile(r"\s*([A-Za-z_][A-Za-z_0-9]*|-?[0-9]+(?:\.[0-9]+)?|[(),])")


def compile_formula(text: str, columns: list[str]) -> tuple[Column, int]:
    """A prefix formula such as ``mul(close, log(volume))`` as a column, and its number of names; only listed names are allowed."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        found = _TOKEN.match(text, at)
        if not found:
            raise ValueError(f"unreadable formula at {at}: {text}")
        tokens.append(found[1])
        at = found.end()
    names = 0

    def term(i: int) -> tuple[Column, int]:
        nonlocal names
        if i >= len(tokens):
            raise ValueError(f"formula ends early: {text}")
        t = tokens[i]
        names += 1
        if i + 1 < len(tokens) and tokens[i + 1] == "(":
            if t not in FORMULA_FUNCTIONS:
                raise ValueError(f"unknown function {t}")
            args, i = [], i + 2
            while tokens[i] != ")":
                arg, i = term(i)
                args.append(arg)
                if tokens[i] == ",":
                    i += 1
            return FORMULA_FUNCTIONS[t](*args), i + 1
        if t in columns:
            return F.col(t).cast("double"), i + 1
        return F.lit(float(t)), i + 1

    column, end = term(0)
    if end != len(tokens):
        raise ValueError(f"formula goes on after its end: {text}")
    return column, names


def formula_features(df: DataFrame, formulas: list[str] | str, close: str = "close", longest: int = 15, most_like: float = 0.9) -> DataFrame:
    """``df`` with one column ``f_{number}`` per formula that is short enough, has a value, and does not follow the close.

    ``formulas`` may be a JSON list's path. One aggregate vets them all.
    """
    if isinstance(formulas, str):
        formulas = json.loads(Path(formulas).read_text())
    made = {}
    for i, text in enumerate(formulas):
        column, size = compile_formula(text, df.columns)
        if size <= longest:
            made[f"f_{i}"] = column
    if not made:
        return df
    wide = sanitize(df.withColumns(made), [*made])
    facts = wide.agg(*(F.struct(F.count(c).alias("n"), F.abs(safe_ratio(F.covar_pop(c, close), F.when(F.stddev_pop(c) * F.stddev_pop(close) > 1e-12, F.stddev_pop(c) * F.stddev_pop(close)))).alias("r")).alias(c) for c in made)).first()
    bad = [c for c in made if facts[c]["n"] == 0 or (facts[c]["r"] or 0) > most_like]
    return wide.drop(*bad)


def new_formulas(candidates: DataFrame, known: DataFrame) -> DataFrame:
    return new_rows(candidates, known, ["formula"])


def text_complexity(df: DataFrame, column: str) -> DataFrame:
    """Adds ``complexity`` and ``penalty``: length, bracket depth and deflated size of a formula text; quadratic above 0.7."""
    @F.pandas_udf(T.DoubleType())
    def compressed(texts: pd.Series) -> pd.Series:
        import zlib

        return texts.map(lambda t: min(1.0, len(zlib.compress(t.encode())) / len(t.encode())) if t else 0.0)

    depth = F.aggregate(
        F.split(F.coalesce(column, F.lit("")), ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")),
        lambda s, ch: F.struct((s["now"] + F.when(ch == "(", 1).when(ch == ")", -1).otherwise(0)).alias("now"), F.greatest(s["top"], s["now"] + F.when(ch == "(", 1).otherwise(0)).alias("top")), lambda s: s["top"],
    )
    size = F.least(F.lit(1.0), F.length(column) / 500)
    made = df.withColumn("complexity", 0.4 * size + 0.3 * F.least(F.lit(1.0), depth / 10) + 0.3 * compressed(F.coalesce(column, F.lit(""))))
    return made.withColumn("penalty", F.when(F.col("complexity") > 0.7, (F.col("complexity") - 0.7) * (F.col("complexity") - 0.7)).otherwise(0.0))


def treatment_effect(df: DataFrame, treatment: str, outcome: str, confounders: list[str], by: list[str], order: list[str], placebos: int = 99, seed: int = 42) -> DataFrame:
    """One row ``effect, placebo_mean, p_value``: least-squares weight of the treatment, against treatments permuted within each key.

    All placebos are one job: each replicate looks treatments up at other places of its key, and the normal equations are sums per replicate.
    """
    names = [treatment, *confounders]
    base = df.dropna(subset=[*names, outcome]).select(*dict.fromkeys([*by, *order, *names, outcome]))
    middle = base.agg(*(F.avg(c).alias(c) for c in [*names, outcome])).first()
    centred = lambda c: F.col(c).cast("double") - F.lit(middle[c])
    placed = numbered(base, by, order).select(F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by))).alias("_k"), "_i", "_n", *(centred(c).alias(f"_x{i}") for i, c in enumerate(names)), centred(outcome).alias("_y"))
    given = placed.select(F.col("_k").alias("_kg"), F.col("_i").alias("_j"), F.col("_x0").alias("_fake"))
    # a permuted treatment is a look-up of the place that the replicate's permutation names, no sort of a copy
    copies = placed.drop("_x0").withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(placebos - 1))))
    there = shuffled_place(F.col("_i"), F.col("_n"), F.lit(seed) + F.col("_rep"), F.col("_k"))
    matched = copies.withColumn("_there", there).join(given, (F.col("_k") == F.col("_kg")) & (F.col("_there") == F.col("_j")))
    rest = [*(f"_x{i}" for i in range(1, len(names))), "_y"]
    both = matched.select("_rep", F.col("_fake").alias("_x0"), *rest).union(placed.select(F.lit(-1).alias("_rep"), "_x0", *rest))
    cells = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = both.groupBy("_rep").agg(
        *(F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"s{i}_{j}") for i, j in cells), *(F.sum(F.col(f"_x{i}") * F.col("_y")).alias(f"y{i}") for i in range(len(names)))
    ).collect()

    def weight(row) -> float:
        gram = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))])
        scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
        found = np.linalg.lstsq(gram / np.outer(scale, scale), np.array([row[f"y{i}"] for i in range(len(names))]) / scale, rcond=None)[0]
        return float(found[0] / scale[0])

    weights = {r["_rep"]: weight(r) for r in sums}
    effect = weights.pop(-1)
    beyond = sum(abs(f) >= abs(effect) for f in weights.values())
    return df.sparkSession.createDataFrame([(effect, sum(weights.values()) / len(weights), (beyond + 1) / (placebos + 1))], "effect double, placebo_mean double, p_value double")
