"""Co-trained quality classifier: a text view and a metadata view teach each other.

The text view sees proportions measured on whole texts and which words they hold, hashed into sparse
slots, the metadata view hashed categories of the other columns. Both start from labelled rows; in each round, each view's calibrated and confident
labels of all unlabelled documents join the other's training rows. The final probabilities are Platt
calibrated on held-out labels and combined as independent evidence. Scoring is a narrow map: no
document crosses a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import forget, stored
from barwright.llm.text_view import LEXICAL_BITS, N_DENSE, measure, measured, word_slots  # noqa: F401

#: At most about so many labelled rows are used, chosen by a hash of their identifier.
MAX_LABELLED = 100_000
#: At most about so many pseudo-labelled rows teach the other view in a round, chosen by hash of all that are confident: what a fit takes does not grow with the corpus.
MAX_PSEUDO = 50_000
ROUNDS = 2
#: Calibrated probability from which a pseudo-label is passed on to the other view.
CONFIDENT = 0.97
PSEUDO_WEIGHT = 0.5
META_SIZE = 128
REGULAR = 1e-3
#: Proportions are so many times larger in the text view's vectors, next to words at unit length.
DENSE_SCALE = 10.0
KEEP_FROM = 0.5


def text_features(text: Column | str) -> Column:
    """``struct<f: array<float>, w: array<int>>``: a whole text's proportions and the slots of its words."""

    def run(texts: pa.Array) -> pa.Array:
        steps = [*measured(texts)]
        dense = np.concatenate([np.empty((0, N_DENSE), dtype=np.float32), *(d for d, _, _ in steps)])
        slots, counts = np.concatenate([np.empty(0, dtype=np.int32), *(s for _, s, _ in steps)]), np.concatenate([np.empty(0, dtype=np.int64), *(c for _, _, c in steps)])
        f = pa.ListArray.from_arrays(pa.array(np.arange(len(dense) + 1, dtype=np.int32) * N_DENSE), pa.array(dense.ravel()))
        w = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(slots))
        return pa.StructArray.from_arrays([f, w], ["f", "w"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "f array<float>, w array<int>")(text)


def meta_slots(columns: list[str], size: int = META_SIZE) -> Column:
    """Hashed slots of the metadata: one per column (numbers by power of two) and one for them all."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    each = [F.xxhash64(F.lit(i), v) for i, v in enumerate(values)]
    return F.transform(F.array(*each, F.xxhash64(F.lit("all"), *values)), lambda h: F.pmod(h, F.lit(size)).cast("int"))


def _meta_columns(docs: DataFrame, columns: list[str]) -> list[Column]:
    kinds = dict(docs.dtypes)
    return [(F.floor(F.log2(F.greatest(F.col(c), F.lit(0)) + 1)) if kinds[c] in ("int", "bigint", "double", "float", "smallint") else F.col(c)).alias(f"_m{i}") for i, c in enumerate(columns)]


@dataclass
class View:
    """A fitted view: raw log odds are linear in its features, calibrated ones linear in those."""

    weights: list[float]
    intercept: float
    slope: float = 1.0
    shift: float = 0.0

    def _linear(self):
        dense, lexical, base = DENSE_SCALE * np.array(self.weights[:N_DENSE]), np.array(self.weights[N_DENSE:]), self.intercept

        def raw(proportions: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
            of = np.repeat(np.arange(len(counts)), counts)
            words = np.bincount(of, weights=lexical[slots], minlength=len(counts))
            return base + proportions.astype(np.float64) @ dense + words / np.sqrt(np.maximum(counts, 1))

        return raw

    def of_text(self, text: Column | str) -> Column:
        """Calibrated log odds of whole texts; their features stay within the task."""
        raw = self._linear()

        def run(texts: pa.Array) -> pa.Array:
            return pa.array(np.concatenate([np.empty(0), *(raw(*step) for step in measured(texts))]))

        run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, "double")(text) * self.slope + self.shift

    def of_features(self, f: Column | str = "f", w: Column | str = "w") -> Column:
        """Calibrated log odds from the features of ``text_features``."""
        raw = self._linear()

        def run(f: pa.Array, w: pa.Array) -> pa.Array:
            counts = np.diff(w.offsets.to_numpy())
            return pa.array(raw(f.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_DENSE), w.flatten().to_numpy(zero_copy_only=False), counts))

        run.__annotations__ = {"f": pa.Array, "w": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, "double")(f, w) * self.slope + self.shift

    def of_slots(self, slots: Column | str = "slots") -> Column:
        """Calibrated log odds from slots; a slot that occurs twice counts once."""
        table = F.array(*map(F.lit, self.weights))
        return F.aggregate(F.array_distinct(slots), F.lit(self.intercept), lambda s, i: s + F.get(table, i)) * self.slope + self.shift


def _slot_vectors() -> CountVectorizerModel:
    return CountVectorizerModel.from_vocabulary([str(i) for i in range(1 << LEXICAL_BITS)], inputCol="_slots", outputCol="_lexical").setBinary(True).setMinTF(0.0)


def _text_vectors(rows: DataFrame, words: CountVectorizerModel) -> DataFrame:
    """``rows`` with ``features``: proportions, then a sparse vector of the slots."""
    made = words.transform(rows.withColumns({"_dense": array_to_vector(F.transform("f", lambda x: x * DENSE_SCALE)), "_slots": F.col("w").cast("array<string>")}))
    unit = Normalizer(inputCol="_lexical", outputCol="_unit").transform(made)
    return VectorAssembler(inputCols=["_dense", "_unit"], outputCol="features").transform(unit).drop("_dense", "_slots", "_lexical", "_unit")


def _meta_vectors(rows: DataFrame) -> DataFrame:
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(META_SIZE - 1)), lambda i: F.array_contains("slots", i).cast("double"))
    return rows.withColumn("features", array_to_vector(one_hot))


def _fit(rows: DataFrame, steps: int = 25) -> tuple[list[float], float]:
    """Weights and intercept. Features are not standardised, as that would make rare words heavy."""
    model = LogisticRegression(maxIter=steps, regParam=REGULAR, tol=1e-5, weightCol="weight", standardization=False).fit(rows.select("features", F.col("label").cast("double").alias("label"), "weight"))
    return [float(w) for w in model.coefficients.toArray()], float(model.intercept)


def _odds(p: float) -> float:
    return math.log(p / (1 - p))


@dataclass
class CoTrained:
    """Fitted views; ``score`` adds columns to any documents without a shuffle.

    ``given`` counts each round's confident pseudo-labels by the view that learns from them.
    """

    text: View | None
    meta: View | None
    prior: float
    meta_cols: list[str]
    given: list[dict[str, int]] = field(default_factory=list)

    def score(self, docs: DataFrame, text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
        """``docs`` with ``text_score, meta_score, quality_score`` (0 to 1) and ``accepted``.

        Columns of these names are replaced. Without a fitted model (a class without labels) the
        scores are null and every row is accepted. Null texts are scored as empty ones.
        """
        kept = [c for c in docs.columns if c not in ("text_score", "meta_score", "quality_score", "accepted")]
        if self.text is None or self.meta is None:
            none = F.lit(None).cast("double")
            return docs.select(*kept, none.alias("text_score"), none.alias("meta_score"), none.alias("quality_score"), F.lit(True).alias("accepted"))
        # the given columns travel in one struct, so that no name of theirs can clash
        own = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row")
        slots = meta_slots([f"_m{i}" for i in range(len(self.meta_cols))])
        seen = docs.select(own, *_meta_columns(docs, self.meta_cols), self.text.of_text(F.col(f"`{text_col}`")).alias("_t"))
        logits = seen.select("_row", "_t", self.meta.of_slots(slots).alias("_m"))
        chance = lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
        score = chance(F.col("_t") + F.col("_m") - F.lit(_odds(self.prior)))
        return logits.select("_row.*", chance(F.col("_t")).alias("text_score"), chance(F.col("_m")).alias("meta_score"), score.alias("quality_score"), (score >= keep_from).alias("accepted"))


def co_train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta_cols: tuple[str, ...] = ("lang", "source", "n_chars"), rounds: int = ROUNDS, max_labelled: int = MAX_LABELLED, confident: float = CONFIDENT, max_pseudo: int = MAX_PSEUDO) -> CoTrained:
    """Fit both views on ``labels(id_col, label_col in 0/1)`` and all of ``docs``.

    Null identifiers or labels are no labels; several labels of a document count by their majority
    (a tie is a 1). Repeated document rows each count. Labels without a document are ignored. Where
    either class has no labelled document, the model is empty and accepts everything.

    Every unlabelled document is a candidate in each round; of those from whose log odds a view is
    ``confident``, the other view learns from some ``max_pseudo``.
    """
    meta_cols = [c for c in meta_cols if c in docs.columns]
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    slots = meta_slots([f"_m{i}" for i in range(len(meta_cols))])
    seen = docs.select(F.col(id_col).alias("_id"), *_meta_columns(docs, meta_cols), text_features(F.col(text_col)).alias("seen"))
    rows = stored(seen.select("_id", "seen.f", "seen.w", slots.alias("slots")).join(marks, "_id", "left").withColumn("draw", F.pmod(F.xxhash64("_id"), F.lit(1_000_000))), small_batches=True)
    n, good = rows.where("label is not null").agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < good < n:
        forget(rows)
        return CoTrained(None, None, 0.5, meta_cols)
    columns = ["f", "w", "slots", "label", "weight"]
    chosen = stored(rows.where(f"label is not null and draw < {int(1e6 * min(1.0, max_labelled / n))}").withColumn("weight", F.lit(1.0)))
    held, own, other = chosen.where("draw % 4 = 0"), chosen.where("draw % 4 <> 0"), rows.where("label is null")
    if held.select("label").distinct().count() < 2 or own.select("label").distinct().count() < 2:
        held, own = chosen, chosen  # a handful of labels: nothing can be held out
    own = own.select(*columns)
    to_text = to_meta = own
    given: list[dict[str, int]] = []

    def pseudo(logit: Column) -> tuple[DataFrame, int]:
        marked = other.select("f", "w", "slots", "draw", logit.alias("_l")).where(F.abs("_l") >= _odds(confident))
        count = marked.count()
        taught = marked.where(F.col("draw") < int(1e6 * min(1.0, max_pseudo / max(1, count))))
        return taught.select("f", "w", "slots", (F.col("_l") > 0).cast("int").alias("label"), F.lit(PSEUDO_WEIGHT).alias("weight")), count

    words = _slot_vectors()
    for turn in range(rounds + 1):
        text, meta = View(*_fit(_text_vectors(to_text, words))), View(*_fit(_meta_vectors(to_meta)))
        for view, logit in ((text, text.of_features()), (meta, meta.of_slots())):
            (slope,), view.shift = _fit(held.withColumn("features", array_to_vector(F.array(logit))), steps=10)
            view.slope = slope
        if turn < rounds:
            (for_meta, n_meta), (for_text, n_text) = pseudo(text.of_features()), pseudo(meta.of_slots())
            given.append({"meta": n_meta, "text": n_text})
            to_meta, to_text = own.union(for_meta), own.union(for_text)
    forget(chosen)
    forget(rows)
    prior = min(0.999, max(0.001, good / n))
    return CoTrained(text, meta, prior, meta_cols, given)


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Fit on ``labels`` and score all of ``docs``: see ``co_train`` and ``CoTrained.score``."""
    return co_train(docs, labels, **options).score(docs, options.get("text_col", "text"))
