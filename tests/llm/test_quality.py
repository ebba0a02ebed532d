"""Co-training: scores against a brute-force formula, and what the exchange of labels is worth."""

import math
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barwright.llm import common, quality

GOOD, BAD = [f"w{1000 + 2 * i}" for i in range(120)], [f"w{1001 + 2 * i}" for i in range(120)]


@pytest.fixture(scope="module")
def complementary(spark):
    """Each view alone tells the classes apart, but the few labels show little of either: many words and many sources."""
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        good = i % 2
        words = rng.choices(GOOD if good else BAD, k=6) + [f"filler{rng.randint(0, 50)}" for _ in range(6)]
        rows.append((i, " ".join(words), f"{'trusted' if good else 'spam'}{rng.randint(0, 9)}", good))
    every = spark.createDataFrame(rows, "doc_id long, text string, source string, quality int").repartition(2).cache()
    yield every.drop("quality"), every.select("doc_id", "quality")
    every.unpersist()


def right(scored, truth, column):
    got = scored.join(truth, "doc_id").select(F.avg(((F.col(column) >= 0.5) == (F.col("quality") == 1)).cast("double"))).first()
    return got[0]


def test_exchange_helps_over_none(complementary):
    docs, truth = complementary
    shown = truth.where("doc_id < 60")
    alone, both = (quality.co_train(docs, shown, rounds=r, confident=0.7) for r in (0, 2))
    assert alone.given == [] and len(both.given) == 2 and all(g["text"] > 100 and g["meta"] > 100 for g in both.given)
    before, after = right(alone.score(docs), truth, "text_score"), right(both.score(docs), truth, "text_score")
    assert before < 0.97 < after


def test_scores_match_the_formula(complementary):
    docs, truth = complementary
    model = quality.co_train(docs, truth.where("doc_id < 200"), rounds=0)
    got = {r.doc_id: r for r in model.score(docs).where("doc_id % 50 = 0").collect()}
    slots = {r.doc_id: r.s for r in docs.select("doc_id", *quality._meta_columns(docs, model.meta_cols), "text").select("doc_id", quality.meta_slots([f"_m{i}" for i in range(len(model.meta_cols))]).alias("s")).collect()}
    chance = lambda x: 1 / (1 + math.exp(-x))
    for r in got.values():
        raw = r.text.encode()
        words, counts = quality.word_slots(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
        w = model.text.weights
        logit = model.text.intercept + sum(quality.DENSE_SCALE * a * b for a, b in zip(quality.measure(r.text), w, strict=False)) + sum(w[quality.N_DENSE + s] for s in words) / math.sqrt(counts[0])
        logit = logit * model.text.slope + model.text.shift
        meta = (model.meta.intercept + sum(model.meta.weights[s] for s in set(slots[r.doc_id]))) * model.meta.slope + model.meta.shift
        assert r.text_score == pytest.approx(chance(logit), rel=1e-5) and r.meta_score == pytest.approx(chance(meta), rel=1e-9)
        assert r.quality_score == pytest.approx(chance(logit + meta - math.log(model.prior / (1 - model.prior))), rel=1e-5) and r.accepted == (r.quality_score >= 0.5)


def test_a_bound_on_pseudo_labels_leaves_the_counts_whole(complementary):
    docs, truth = complementary
    few = quality.co_train(docs, truth.where("doc_id < 300"), rounds=1, confident=0.6, max_pseudo=50)
    assert few.given[0]["meta"] > 500 and few.text is not None


def test_empty_table_very_long_and_repeated_texts(spark):
    rows = [(1, "word " * 300_000, "a"), (1, "word " * 300_000, "a"), (2, None, None), (3, "", "b"), (4, "other words!", "b"), (None, "x", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0), (4, 0), (4, 1), (None, 1), (9, None)], "doc_id long, quality int")
    model = quality.co_train(docs, labels, rounds=1)
    assert model.score(docs).count() == 6 and model.score(docs).where("quality_score is null").count() == 0
    assert model.score(docs.where("false")).count() == 0
    assert quality.classify(docs.where("false"), labels).count() == 0


def test_text_view_loads_no_spark_ml():
    """Each Python worker holds what the module of its function imports."""
    code = "import sys, barwright.llm.text_view; sys.exit('pyspark.ml' in sys.modules or 'pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2]).returncode == 0


def test_small_batches_are_small_and_leave_the_session_alone(spark):
    texts = spark.range(40).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")

    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    whole, small = (max(r.n for r in common.stored(texts.coalesce(1).mapInArrow(size, "n long"), small_batches=s).collect()) for s in (False, True))
    assert small < 8 << 20 < whole
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
