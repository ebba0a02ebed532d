"""Ranked lexical search against brute force: ties, parts of weights, blocks, tiles, nulls."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from barwright.llm import lexical_search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k=20):
    bags = [(i, terms_of(t)) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    merged = {}
    for i, t in items:
        merged.setdefault(i, []).extend(terms_of(t))
    out = []
    for item, wanted in merged.items():
        scores = []
        for doc, bag in bags:
            tf, m = Counter(bag), 75 + (25 * len(bag) * n_docs) // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in wanted if tf[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


def found(spark, docs, items, **options):
    return sorted((tuple(r) for r in lexical_search.search(*frames(spark, docs, items), **options).select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)] + ["Äpfel", "MIXED", "x1", "中文"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(150)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)]  # forty equal texts: ties beyond k
    docs += [(2000, None), (2001, ""), (2002, "!!! ..."), (None, docs[7][1])]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(30)] + [(90, docs[7][1]), (91, "nowhere"), (92, None), (90, "w1 w1"), (None, "w2 w3")]
    return docs, items


def test_matches_brute_force(spark, corpus):
    assert found(spark, *corpus) == brute(*corpus)


def test_blocks_and_small_tiles_change_nothing(spark, corpus):
    sizes = lexical_search.Sizes(items=4, docs=7, terms=5, held=1, step_bytes=64)
    assert found(spark, *corpus, k=3, block_terms=100, sizes=sizes) == brute(*corpus, k=3)


def test_weights_beyond_a_product_come_in_parts(corpus, monkeypatch):
    monkeypatch.setattr(lexical_search, "MAX_WEIGHTS", 100)
    import pyarrow as pa

    block = lexical_search.Block(pa.array([1, 2]), np.array([0, 2, 3]), np.array([0, 1, 1]), np.array([3, 1, 7]), ["a", "b"])
    tiles = list(lexical_search.Tiles(block, np.array([90, 333])).of(0))
    assert all((dense.sum(axis=0) <= 100).all() for _, dense in tiles)
    total = np.zeros((2, 2), dtype=np.int64)
    for names, dense in tiles:
        np.add.at(total, names, dense.astype(np.int64))
    assert total.tolist() == [[270, 0], [333, 2331]]


def test_scores_of_one_block(spark, corpus):
    import pyarrow as pa

    docs, items = corpus
    counted = lexical_search.count_terms(frames(spark, docs, items)[0], lexical_search.Block(pa.array([5]), np.array([0, 1]), np.array([0]), np.array([4]), ["w1"]), "doc_id", "text")
    n, total = sum(bool(terms_of(t)) for _, t in docs), sum(len(terms_of(t)) for _, t in docs)
    weight = math.floor(1000 * math.log((2 * n + 2) / (2 * sum("w1" in terms_of(t) for _, t in docs) + 1)))
    block = lexical_search.Block(pa.array([5]), np.array([0, 1]), np.array([0]), np.array([4]), ["w1"])
    got = {r.score for r in lexical_search.score_tiles(counted, block, np.array([weight]), n, total, 500).collect()}
    assert got == {r[3] for r in brute(docs, [(5, "w1 w1 w1 w1")], 500)}


def test_very_long_text_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "alpha " * 200_000 + "omega", "x", 3), (2, "omega beta", "y", 4)], "doc_id long, text string, score string, rank int")
    items = spark.createDataFrame([(1, "Omega", "z")], "item_id long, text string, doc_id string")
    assert [(r.item_id, r.rank, r.doc_id) for r in lexical_search.search(docs, items).orderBy("rank").collect()] == [(1, 1, 2), (1, 2, 1)]
    assert lexical_search.search(docs.where("false"), items).count() == 0
    assert lexical_search.search(docs, items.where("false")).count() == 0
