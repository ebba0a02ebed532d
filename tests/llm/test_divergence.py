"""Source divergence audit against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from barwright.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=3, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held = Counter(t for x, _, ts in docs if x == lang for t in set(ts))
        kept = {t for t, n in held.items() if n >= least}
        of = defaultdict(Counter)
        for x, source, ts in docs:
            if x == lang:
                of[source].update(t for t in ts if t in kept)
        whole = sum(of.values(), Counter())

        def share(count, kept=kept):
            total = sum(count.values()) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // total for t in kept}

        p, base = {s: share(c) for s, c in of.items()}, share(whole)
        for s in of:
            pairs = sorted(((-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in of if o != s))
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, o) in enumerate(pairs)]
            terms = sorted((-((p[s][t] - base[t]) ** 2 // base[t]), t.encode()) for t in kept if of[s][t] and p[s][t] > base[t])[:top]
            out += [(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(terms)]
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    return sorted(tuple(r) for r in divergence.audit(df, **options).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = [f"{a}{b}" for a in "abcdEFGé" for b in "xyz中"] + ["lone"]
    made = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None]), " ".join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(120)]
    return [*made, ("fr", "only", "one two"), ("fr", "none", None), ("xx", "a", "3 4 !"), ("xx", "b", ""), *[("en", "copy", "same same text9again")] * 5]


def test_matches_brute_force(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_small_steps_and_shards_change_nothing(spark, rows, monkeypatch):
    for name, value in (("STEP_BYTES", 50), ("FOLD_ROWS", 20), ("GIVE_ROWS", 30), ("SHARD_ROWS", 10)):
        # used in the driver or in a nested function, so workers see them
        monkeypatch.setattr(divergence, name, value)
    assert found(spark, rows, top=4) == brute(rows, top=4)


def test_shares_are_exact_beyond_64_bits():
    counts = [0, 5, 10**12, 9 * 10**16]
    total = 9 * 10**16 + 10**12 + 9
    assert divergence.scaled_share(np.array(counts), total).tolist() == [1 + 10**9 * (c + 1) // total for c in counts]


def test_nulls_empty_tables_long_texts_and_other_columns(spark):
    df = spark.createDataFrame([("en", "a", "word " * 300_000, 1), ("en", "b", "word other", 2), ("en", "b", "word", 3)], "lang string, source string, text string, count int")
    got = sorted(tuple(r) for r in divergence.audit(df).collect())
    assert got == brute([("en", "a", "word " * 300_000), ("en", "b", "word other"), ("en", "b", "word")])
    assert divergence.audit(df.where("false")).count() == 0
    assert divergence.audit(df.withColumn("text", df.text.substr(0, 0))).where("part = 'pair' and value = 0").count() == 2


def test_pieces_of_a_shard_change_nothing():
    import pyarrow as pa

    groups = pa.table({"source": ["b", "a", "c"], "n": [5, 3, 0], "lang_n": [8] * 3, "v": [3] * 3})
    rows = pa.table({"source": ["a", "b", "b", "a"], "term": ["x", "x", "y", "z"], "count": [2, 1, 4, 1], "lang_count": [3, 3, 4, 1]})
    listed = lambda t: sorted(t.to_pylist(), key=str)
    whole = divergence.shard_divergences("en", rows, groups)
    assert listed(divergence.shard_divergences("en", rows, groups, 1)) == listed(whole) and whole.num_rows == 6 + len([r for r in whole.to_pylist() if r["term"]])
