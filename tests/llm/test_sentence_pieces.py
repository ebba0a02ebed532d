"""SentencePiece encoding and decoding against the library."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barwright.llm import common, registry, sentence_pieces

SMALL = "/root/testdata/sf0.001"
PARTS = ["a", "b", "th", "e", " ", "  ", "\n", "1", "é", "中", "文", "\U0001f642", "▁", "the", "ing", "tion", " an", "\x00", "͸", "aaaa", "    ", "==", "--", "</s>", "<0x41>", "  ", "é"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.model_path())


@pytest.fixture(scope="module")
def model():
    return sentence_pieces.piece_model(sentence_pieces.model_path())


def test_random_texts_encode_as_the_library(model, library):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    got = model.encode_texts(pa.array(texts))
    assert [x.tolist() for x in got] == library.encode(texts)


def test_long_words_runs_and_blanks(model, library):
    rng = random.Random(4)
    texts = ["a" * 7001, " " * 5003 + "x", "ab" * 3000, "the" * 2000, "".join(rng.choice("abcdefghijklmnop") for _ in range(9000)), "\n" * 3000, "x" * (sentence_pieces.LONG_WORD + 1), "word " * 30_000]
    assert [x.tolist() for x in model.encode_texts(pa.array(texts))] == library.encode(texts)


def test_memory_may_be_dropped_at_any_time(model, library, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "MEMORY_WORDS", 5)
    texts = ["one two three four", "five six seven eight nine ten", "one two three"]
    for _ in range(2):
        assert [model.encode_texts(pa.array([t]))[0].tolist() for t in texts] == library.encode(texts)


def test_any_ids_decode_as_the_library(model, library):
    rng = random.Random(5)
    pool = [*range(0, 300), *range(31_900, 32_000), 259, 28705]
    lists = [[rng.choice(pool) for _ in range(rng.randint(0, 12))] for _ in range(3000)]
    assert [model.decode_ids(np.array(x, dtype=np.int32)) for x in lists] == [library.decode(x) for x in lists]


def test_an_unknown_id_raises(model):
    with pytest.raises(ValueError, match="vocabulary"):
        model.decode_ids(np.array([32_000]))


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):  # noqa: B017  no model at all
        sentence_pieces.PieceModel(str(tmp_path / "none.model"))


def test_null_empty_repeated_rows_and_empty_table(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, " a"), (None, " a")], "doc_id long, text string")
    done = rows.select("doc_id", sentence_pieces.encode("text").alias("ids")).withColumn("back", sentence_pieces.decode("ids"))
    got = sorted(((r.doc_id, r.ids, r.back) for r in done.collect()), key=str)
    assert got == sorted([(1, [1, 2], ""), (2, [1, 2], ""), (2, [1, 2], ""), (3, [1, 28705, 264, 2], " a"), (None, [1, 28705, 264, 2], " a")], key=str)
    assert rows.where("false").select(sentence_pieces.encode("text")).count() == 0
    assert rows.limit(1).select(sentence_pieces.decode(F.lit(None).cast("array<int>")).alias("t")).first().t is None
    plain = rows.where("doc_id = 3").select(sentence_pieces.encode("text", begin=False, end=False).alias("ids")).first().ids
    assert plain == [28705, 264]


def test_query_matches_the_library_on_whole_texts(spark, library):
    import hashlib

    got = {r.doc_id: r for r in registry.op12_sentence_pieces(spark, SMALL).collect()}
    texts = {r.doc_id: r.text or "" for r in common.table(spark, SMALL, "documents").collect()}
    assert set(got) == set(texts)
    for doc, text in texts.items():
        ids = library.encode(text, add_bos=True, add_eos=True)
        want = (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert (got[doc].n_tokens, got[doc].ids_sha256, got[doc].decoded_sha256) == want
