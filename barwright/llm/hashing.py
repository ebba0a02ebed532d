"""Vectorised 64-bit hashes of substrings, shared by the operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Invertible 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of the hash's base and of its inverse, up to the longest step seen."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                steps = np.full(n, base, dtype=U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


class Substrings:
    """Hashes of any substrings of one sequence of bytes or code points, from its prefix sums."""

    def __init__(self, values: np.ndarray):
        up, self.down = _POWERS.get(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=U)
        np.cumsum((values.astype(U) + U(1)) * up[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U))


def text_steps(texts: pa.Array, step_bytes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of an array of texts: first row, end row, their bytes and offsets (nulls are empty).

    A slice has at most ``step_bytes``, or is one longer text.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.empty(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + step_bytes, side="right")) - 1)
        end = min(end, len(texts))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64), pa.int64())
