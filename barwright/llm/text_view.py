"""What the quality classifier's text view sees of a text: proportions and hashed words.

A module of its own, so that Python workers load no Spark ML for it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from barwright.llm.hashing import Substrings, U, text_steps
from barwright.llm.lexical_search import LOWERED, term_spans

#: Bytes counted for each proportion of the text view.
BYTE_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".,;:?",
    "shout": b"!",
    "bar": b"|",
    "symbol": b"#$%&*@^~=+<>{}[]\\_",
    "line": b"\n",
}
#: Slots of hashed words, as a power of two; a document has those of its distinct words, each of a weight of 1 by the root of their number.
LEXICAL_BITS = 14
N_DENSE = len(BYTE_CLASSES) + 8
#: Bytes of text that one step of a task works on; a longer single text is a step of its own.
STEP_BYTES = 1 << 19


def measure(text: str) -> list[float]:
    """Proportions of one whole text, each within a small range; an empty text has zeros."""
    raw = text.encode()
    if not raw:
        return [0.0] * N_DENSE
    size, words, lines = len(raw), text.split(), text.split("\n")
    n = max(1, len(words))
    shares = [1 - len(raw.translate(None, c)) / size for c in BYTE_CLASSES.values()]
    return [
        *shares,
        *(math.sqrt(s) for s in shares[3:6]),
        math.log1p(len(words)) / 10,
        len(set(words)) / n,
        min(2.0, len(text) / n / 10),
        1 - len(set(lines)) / len(lines),
        1 - len(raw.translate(None, bytes(range(128)))) / size,
    ]


def word_slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct slots of the words of each text of a step, in a row, and how many each has."""
    start, end, text = term_spans(data, offsets)
    slot = (Substrings(LOWERED[data]).of(start, end) >> U(64 - LEXICAL_BITS)).astype(np.int64)
    found = np.unique((text.astype(np.int64) << LEXICAL_BITS) | slot)
    return (found & ((1 << LEXICAL_BITS) - 1)).astype(np.int32), np.bincount(found >> LEXICAL_BITS, minlength=len(offsets) - 1)


def measured(texts: pa.Array):
    """Steps of an array of texts: proportions (rows by measure), slots and their counts."""
    for low, high, data, offsets in text_steps(texts, STEP_BYTES):
        yield np.array([measure(t or "") for t in texts.slice(low, high - low).to_pylist()], dtype=np.float32), *word_slots(data, offsets)
