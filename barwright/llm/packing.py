"""Tokenised best-two-fit packing of documents into fixed-length training sequences.

Tokens are produced in Arrow batches by the tokenizer whose file is a parameter, special tokens in a
text included as plain ``tokenizers`` reads them. Packing deals the
pieces over shards of a bounded number of rows; every shard is packed on its own, so a corpus of any
size loses at most one part-filled sequence per shard.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import stored
from barwright.llm.hashing import Substrings

SEQUENCE = 2048
END_ID = 0
SHARD_ROWS = 50_000
#: Words whose ids a Python worker remembers (some 40 bytes each) before it starts afresh.
CACHE_WORDS = 300_000
#: Characters that one step of a task works on; a longer single text is a step of its own.
STEP_CHARS = 1 << 18
#: Longer words, and texts with characters that are not in ``character_classes``, take the tokenizer itself.
MAX_WORD = 256
OTHER, LETTER, NUMBER, BLANK, UNKNOWN = range(5)
#: Blocks of code points whose classes are taken from ``unicodedata``; all others are unknown.
BLOCKS = ((0, 0x530), (0x1E00, 0x2070), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4))

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of every code point below 0x10000, and of all others in the last place."""
    table = np.full((1 << 16) + 1, UNKNOWN, dtype=np.uint8)
    for low, high in BLOCKS:
        for i in range(low, high):
            kind = unicodedata.category(chr(i))
            blank = kind[0] == "Z" or i in (9, 10, 11, 12, 13, 0x85)
            table[i] = UNKNOWN if kind == "Cn" else BLANK if blank else LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else OTHER
    return table


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others, in order, for the characters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in shown)}


def word_starts(chars: np.ndarray, classes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Whether a pre-token of the byte-level tokenizer starts at each character; ``begins`` are the texts' own starts.

    Words are runs of one class, with one space before them if there is one; of blanks before a word,
    the last stands alone or, a space, joins it; the seven contractions of an apostrophe are words.
    """
    n = len(chars)
    first = np.zeros(n + 1, dtype=bool)
    first[begins] = True
    start = first[:n].copy()
    start[1:] |= classes[1:] != classes[:-1]
    after = np.flatnonzero(start[1:] & (classes[:-1] == BLANK) & ~first[1:n]) + 1
    start[after - 1] = True
    start[after[chars[after - 1] == 32]] = False
    marks = np.flatnonzero(start[:-1] & (chars[:-1] == 39))
    marks = marks[(classes[marks + 1] == LETTER) & ~first[marks + 1]]
    one = chars[marks + 1]
    two = np.where(first[marks + 2], 0, chars[np.minimum(marks + 2, n - 1)])
    two[marks + 2 >= n] = 0
    pair = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
    taken = np.where(np.isin(one, [115, 116, 109, 100]), 1, np.where(pair, 2, 0))
    marks, taken = marks[taken > 0], taken[taken > 0]
    start[marks + 1] = False
    ends = marks + 1 + taken
    start[ends[ends < n]] = True
    return start


class WordTokenizer:
    """Byte-level BPE works within pre-tokens: each distinct one of a step is looked up once, and encoded once if it is new."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.empty(0, dtype=np.uint64)
        self.offsets, self.lengths = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.pool = np.empty(0, dtype="<u4")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Little-endian unsigned 32-bit ids of each text, without special tokens around it."""
        out: list = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        plain = sorted({*range(len(texts))} - {*whole})
        joined = "".join([texts[i] for i in plain])
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        bounds = np.cumsum([0, *(len(texts[i]) for i in plain)])
        classes = character_classes()[np.minimum(chars, 1 << 16)]
        if len(chars):
            start = np.flatnonzero(word_starts(chars, classes, bounds[:-1]))
            end = np.r_[start[1:], len(chars)]
            odd = np.r_[np.flatnonzero(classes == UNKNOWN), start[end - start > MAX_WORD]]
            ids, cuts = self._of_words(joined, chars, start, end, np.searchsorted(start, bounds))
        else:
            odd, ids, cuts = np.empty(0, dtype=np.int64), np.empty(0, dtype="<u4"), np.zeros(len(bounds), dtype=np.int64)
        strange = {*np.unique(np.searchsorted(bounds, odd, side="right") - 1).tolist()}
        for at, i in enumerate(plain):
            if at in strange:
                whole.append(i)
            else:
                out[i] = ids[cuts[at] : cuts[at + 1]]
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, dtype="<u4")
        return out

    def _of_words(self, joined: str, chars: np.ndarray, start: np.ndarray, end: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where those of the words ``edges`` begin."""
        found, where, which = np.unique(Substrings(chars).of(start, end), return_index=True, return_inverse=True)
        if len(self.hashes) + len(found) > CACHE_WORDS:
            self._forget()
        at = np.searchsorted(self.hashes, found)
        known = np.zeros(len(found), dtype=bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == found
        new = np.flatnonzero(~known)
        if len(new):
            low, high = start[where[new]], end[where[new]]
            width = np.r_[0, np.cumsum(1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000))]  # in bytes
            cuts = np.r_[0, np.cumsum(width[high] - width[low])].tolist()
            words = "".join([joined[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)])
            words, tokens = words.encode(errors="surrogatepass").decode("latin-1").translate(byte_alphabet()), self.tokenizer.model.tokenize
            ids = [[t.id for t in tokens(words[a:b])] for a, b in zip(cuts, cuts[1:], strict=False)]
            sizes = np.array([len(x) for x in ids], dtype=np.int64)
            self.hashes = np.insert(self.hashes, at[new], found[new])
            self.offsets = np.insert(self.offsets, at[new], len(self.pool) + np.cumsum(sizes) - sizes)
            self.lengths = np.insert(self.lengths, at[new], sizes)
            self.pool = np.concatenate([self.pool, np.fromiter((i for x in ids for i in x), dtype="<u4", count=int(sizes.sum()))])
            at = np.searchsorted(self.hashes, found)
        sizes = self.lengths[at][which]
        ends = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.offsets[at][which] - (ends - sizes), sizes) + np.arange(ends[-1])]
        return ids, np.r_[0, ends][edges]


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenise and cut: one row per piece, ``doc_id, piece, start, length, ids_crc32`` (and ``ids`` if asked).

    A document is its text's ids and then ``end_id``; only longer ones than ``sequence`` are cut, into
    full pieces after a first one that takes the remainder. Null text is empty. Every row is a document of its own.
    """
    end = np.array([end_id], dtype="<u4")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(keys):
                chunk, size = [], 0
                while at + len(chunk) < len(keys) and size < STEP_CHARS:
                    chunk.append(texts[at + len(chunk)].as_py() or "")
                    size += len(chunk[-1])
                rows = []
                for key, ids in zip(keys[at : at + len(chunk)], tokenizer.encode(chunk), strict=True):
                    ids = np.concatenate([ids, end])
                    n = len(ids)
                    first = n % sequence or min(n, sequence)
                    for i, start in enumerate([0, *range(first, n, sequence)]):
                        part = ids[start : start + (sequence if i else first)]
                        rows.append((key, i, start, len(part), zlib.crc32(part), *([part.tolist()] if with_ids else [])))
                at += len(chunk)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())], strict=False)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, _PIECES + (", ids array<int>" if with_ids else ""))


def best_two_fit(lengths: list[int], capacity: int = SEQUENCE) -> list[list[int]]:
    """Bins of indices into ``lengths``, each of total at most ``capacity``.

    A bin is filled greedily with the largest document that fits its gap. While a gap is left, its
    smallest document goes back if two unpacked ones fill the expanded gap more tightly.
    """
    pool: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in range(len(lengths) - 1, -1, -1):
        pool[lengths[i]].append(i)
    there = sum(1 << n for n in range(capacity + 1) if pool[n])  # bit n: a document of length n is unpacked
    mirror = sum(1 << (capacity - n) for n in range(capacity + 1) if pool[n])

    def take(n: int) -> int:
        nonlocal there, mirror
        i = pool[n].pop()
        if not pool[n]:
            there ^= 1 << n
            mirror ^= 1 << (capacity - n)
        return i

    def give(i: int) -> None:
        nonlocal there, mirror
        n = lengths[i]
        if not pool[n]:
            there ^= 1 << n
            mirror ^= 1 << (capacity - n)
        pool[n].append(i)

    def pair(total: int) -> int | None:
        """The larger of two unpacked lengths with this sum."""
        both = there & (mirror >> (capacity - total))
        while both:
            n = both.bit_length() - 1
            if 2 * n != total or len(pool[n]) > 1:
                return n
            both ^= 1 << n
        return None

    bins = []
    while there:
        own, gap = [], capacity
        while gap and (fits := there & ((2 << gap) - 1)):
            n = fits.bit_length() - 1
            own.append(take(n))
            gap -= n
        while gap and len(own) > 1:
            least = lengths[own[-1]]
            found = next(((t, n) for t in range(least + gap, least, -1) if (n := pair(t)) is not None), None)
            if found is None:
                break
            back = own.pop()
            own += [take(found[1]), take(found[0] - found[1])]
            give(back)
            gap -= found[0] - least
            own.sort(key=lambda i: -lengths[i])
        bins.append(own)
    return bins


def pack(pieces: DataFrame, sequence: int = SEQUENCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: gapless from 0 within each sequence.

    ``pieces`` needs ``doc_id, piece, start, length, ids_crc32``; it is written to the shared folder
    first, as its row count sets the number of shards. Repeated rows are packed each.
    """
    held = stored(pieces)
    shards = max(1, -(-held.count() // shard_rows))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        lengths = rows["length"].tolist()
        bins, offsets = [0] * len(lengths), [0] * len(lengths)
        for number, own in enumerate(best_two_fit(lengths, sequence)):
            at = 0
            for i in own:
                bins[i], offsets[i] = (int(key[0]) << 32) + number, at
                at += lengths[i]
        return rows.drop(columns="shard").assign(sequence_id=bins, offset=offsets)

    dealt = held.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(one, f"{_PIECES}, sequence_id bigint, offset bigint")


def packed_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Tokenise, cut and pack ``docs``: one row per piece (see ``cut`` and ``pack``); no rows in, none out."""
    return pack(cut(docs, path or tokenizer_path(), id_col, text_col, sequence, end_id), sequence)


def materialise(packed: DataFrame, pieces_with_ids: DataFrame, sequence: int = SEQUENCE, pad_id: int = END_ID) -> DataFrame:
    """Training rows: ``sequence_id, ids`` of exactly ``sequence`` ids, padded at the end, from ``cut(..., with_ids=True)``."""
    rows = packed.join(pieces_with_ids.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    whole = rows.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    return whole.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(sequence) - F.size("ids"))).alias("ids"))
