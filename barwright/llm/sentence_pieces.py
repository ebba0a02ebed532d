"""SentencePiece BPE encoding and decoding in Arrow batches, by vectorised merge rounds.

A model's file is a parameter. Texts become one flat array of symbols, cut into words where no piece of
the vocabulary holds the two neighbouring characters side by side, so that no merge can cross. Of all new words of a step, each
round takes every word's best pair (a segmented minimum over pair ranks), merges all its
occurrences from the left at once, and closes the gaps; words without a pair left drop out.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from barwright.llm.hashing import Substrings, text_steps

#: Bytes of text that one step of a task works on; a longer single text is a step of its own.
STEP_BYTES = 1 << 19
#: Words whose ids a Python worker remembers before it starts afresh.
MEMORY_WORDS = 200_000
#: Longer words are merged one pair at a time, in n log n, as rounds over them could be as many as their ranks.
LONG_WORD = 2048
BLANK = "▁"
#: No pair.
NONE = np.int32(2**31 - 1)
#: What a model must encode as the library does before it is used: blanks, unknown characters, byte pieces, markers as text.
PROBES = ["", " ", "  a  b ", "one two\n\tthree", "▁x", "<s>a</s><0x41><unk>", "1234 \U0001f642͸\x00 é", "naïve 中文 " + " " * 40 + "end" + " " * 17]


class PieceModel:
    """Tables of a byte-fallback BPE model with identity normalisation and a dummy prefix; others raise ValueError."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = library.vocab_size()
        self.begin, self.end, self.unknown = library.bos_id(), library.eos_id(), library.unk_id()
        pieces = [library.id_to_piece(i) for i in range(self.size)]
        special = [library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i) for i in range(self.size)]
        normal = {p: i for i, p in enumerate(pieces) if not special[i]}
        self.bytes_from = next((i for i in range(self.size) if library.is_byte(i)), None)
        if self.bytes_from is None or any(not library.is_byte(self.bytes_from + b) for b in range(256)):
            raise ValueError("the model has no byte pieces")

        # characters: a dense class for the pairs that occur inside pieces, and a symbol
        inside = sorted({c for p in normal for c in p})
        self.symbol_of = np.full(0x110000, -1, dtype=np.int32)
        self.class_of = np.zeros(0x110000, dtype=np.int32)
        for i, c in enumerate(inside):
            self.class_of[ord(c)] = i + 1
            self.symbol_of[ord(c)] = normal.get(c, -1)
        self.joined = np.zeros((len(inside) + 1, len(inside) + 1), dtype=bool)
        for p in normal:
            at = self.class_of[[ord(c) for c in p]]
            self.joined[at[:-1], at[1:]] = True

        # pairs: equal scores share a rank, so that the leftmost of them is first
        scores = np.array([library.get_score(i) for i in range(self.size)])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        pairs = sorted((normal[p[:i]] * self.size + normal[p[i:]], m) for p, m in normal.items() for i in range(1, len(p)) if p[:i] in normal and p[i:] in normal)
        self.slots = 64 - max(4, (4 * len(pairs)).bit_length())
        size = 1 << (64 - self.slots)
        self.pair_keys = np.full(size, -1, dtype=np.int64)
        self.pair_rank, self.pair_into = np.full(size, NONE, dtype=np.int32), np.zeros(size, dtype=np.int32)
        wanted = self._slot(np.array([k for k, _ in pairs], dtype=np.int64)).tolist()
        for (key, into), at in zip(pairs, wanted, strict=True):
            while self.pair_keys[at] >= 0:
                at = (at + 1) % size
            self.pair_keys[at], self.pair_rank[at], self.pair_into[at] = key, rank[into], into

        # decoding: what each id stands for; blanks are spaces
        self.is_control = np.array([library.is_control(i) for i in range(self.size)])
        self.is_byte = np.array([library.is_byte(i) for i in range(self.size)])
        self.opens = np.array([p.startswith(BLANK) and not special[i] for i, p in enumerate(pieces)])
        shown = [b"" if self.is_control[i] else " ⁇ ".encode() if i == self.unknown else bytes([i - self.bytes_from]) if self.is_byte[i] else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.shown_size = np.array([len(s) for s in shown], dtype=np.int64)
        self.shown_at = np.cumsum(self.shown_size) - self.shown_size
        self.shown = np.frombuffer(b"".join(shown), dtype=np.uint8)

        self._forget()
        if any(self.encode_texts(pa.array([t]))[0].tolist() != library.encode(t) for t in PROBES):
            raise ValueError("only byte-fallback BPE models with identity normalisation and a dummy prefix are read")

    # merging ----------------------------------------------------------------------------------------

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.slots)).astype(np.int64)

    def ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or ``NONE``) and merged symbol of pairs of symbols, from a table with open addressing."""
        keys = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.size + right, -2)
        slot = self._slot(keys)
        found = self.pair_keys[slot]
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.pair_keys)
            found[open_] = self.pair_keys[slot[open_]]
            open_ = open_[(found[open_] != keys[open_]) & (found[open_] >= 0)]
        return np.where(found == keys, self.pair_rank[slot], NONE), self.pair_into[slot]

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols of many words and the word each belongs to, words in order."""
        done_symbols, done_word = [symbols[:0]], [word[:0]]
        long = np.bincount(word)[word] > LONG_WORD if len(word) else np.zeros(0, dtype=bool)
        if long.any():
            self._one_by_one(symbols[long], word[long], done_symbols, done_word)
            symbols, word = symbols[~long], word[~long]
        rank, into = np.full(len(symbols), NONE, dtype=np.int32), np.zeros(len(symbols), dtype=np.int32)
        self._rank_at(np.arange(len(symbols)), symbols, word, rank, into)
        while len(symbols):
            begins = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[begins, len(symbols)])
            least = np.minimum.reduceat(rank, begins)
            # words without a pair are done
            live = np.repeat(least < NONE, sizes)
            best = np.repeat(least, sizes)
            if not live.all():
                done_symbols.append(symbols[~live])
                done_word.append(word[~live])
                symbols, word, rank, into, best = symbols[live], word[live], rank[live], into[live], best[live]
                if not len(symbols):
                    break
            # of overlapping occurrences every other one, from the left
            hit = rank == best
            at = np.arange(len(hit))
            first = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], at, 0))
            chosen = np.flatnonzero(hit & ((at - first) % 2 == 0))
            before, before_word = symbols, word
            keep = np.ones(len(symbols), dtype=bool)
            keep[chosen + 1] = False
            symbols = symbols.copy()
            symbols[chosen] = into[chosen]
            # a merged symbol makes pairs with both neighbours; the right one as it was counts, too, if it has just been merged itself
            twice = chosen[:-1][(np.diff(chosen) == 2) & (word[chosen[1:]] == word[chosen[:-1]])]
            odd = [word[twice[self.ranked(symbols[twice], before[twice + 2])[0] <= best[twice]]]]
            symbols, word, rank, into, best = symbols[keep], word[keep], rank[keep], into[keep], best[keep]
            here = chosen - np.arange(len(chosen))
            changed = np.zeros(len(symbols), dtype=bool)
            changed[here] = True
            changed[here[here > 0] - 1] = True
            fresh = np.flatnonzero(changed)
            self._rank_at(fresh, symbols, word, rank, into)
            odd = np.unique(np.concatenate([*odd, word[fresh[(rank[fresh] <= best[fresh])]]]))
            # a fresh pair as good as the one just merged, or better, would have come first: such words start again, pair by pair
            if len(odd):
                apart = np.isin(before_word, odd)
                self._one_by_one(before[apart], before_word[apart], done_symbols, done_word)
                stay = ~np.isin(word, odd)
                symbols, word, rank, into = symbols[stay], word[stay], rank[stay], into[stay]
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _rank_at(self, at: np.ndarray, symbols: np.ndarray, word: np.ndarray, rank: np.ndarray, into: np.ndarray) -> None:
        """Sets rank and merged symbol of the pairs that start at ``at``."""
        nxt = np.minimum(at + 1, len(symbols) - 1)
        inside = (nxt > at) & (word[nxt] == word[at])
        rank[at] = NONE
        rank[at[inside]], into[at[inside]] = self.ranked(symbols[at[inside]], symbols[nxt[inside]])

    def _one_by_one(self, symbols: np.ndarray, word: np.ndarray, out_symbols: list, out_word: list) -> None:
        """Merges of a few words by a queue of pairs, the best and then leftmost first."""
        edges = np.flatnonzero(np.r_[True, word[1:] != word[:-1], True])
        for a, b in zip(edges, edges[1:], strict=False):
            own = symbols[a:b].tolist()
            n = len(own)
            nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
            ranks, intos = self.ranked(symbols[a : b - 1], symbols[a + 1 : b])
            queue = [(r, i, own[i], own[i + 1], m) for i, (r, m) in enumerate(zip(ranks.tolist(), intos.tolist(), strict=True)) if r < NONE]
            heapq.heapify(queue)
            while queue:
                _, i, x, y, m = heapq.heappop(queue)
                j = nxt[i]
                if own[i] != x or j < 0 or own[j] != y:
                    continue
                own[i], own[j] = m, -2
                nxt[i] = nxt[j]
                if nxt[j] >= 0:
                    prv[nxt[j]] = i
                for p, q in ((prv[i], i), (i, nxt[i])):
                    if p >= 0 and q >= 0:
                        rank, into = self._pair(own[p], own[q])
                        if rank < NONE:
                            heapq.heappush(queue, (rank, p, own[p], own[q], into))
            left = [s for s in own if s != -2]
            out_symbols.append(np.array(left, dtype=np.int32))
            out_word.append(np.full(len(left), word[a], dtype=word.dtype))

    def _pair(self, left: int, right: int) -> tuple[int, int]:
        rank, into = self.ranked(np.array([left]), np.array([right]))
        return int(rank[0]), int(into[0])

    # texts ------------------------------------------------------------------------------------------

    def _forget(self) -> None:
        self.hashes = np.empty(0, dtype=np.uint64)
        self.offsets, self.lengths = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.pool = np.empty(0, dtype=np.int32)

    def _learn(self, chars: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words ``chars[low:high]`` in a row, and how many each has."""
        sizes = high - low
        flat = chars[np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
        word = np.repeat(np.arange(len(low)), sizes)
        symbols = self.symbol_of[flat]
        strange = symbols < 0  # no piece: by its UTF-8 bytes, a word of its own or not
        symbols = np.where(strange, -flat.astype(np.int64) - 3, symbols)
        symbols, word = self.merge(symbols.astype(np.int32), word)
        if (odd := symbols < 0).any():
            raw = [list(chr(-int(s) - 3).encode("utf-8", "surrogatepass")) for s in symbols[odd]]
            count = np.ones(len(symbols), dtype=np.int64)
            count[odd] = [len(r) for r in raw]
            word, wide = np.repeat(word, count), np.repeat(odd, count)
            symbols = np.repeat(symbols, count)
            symbols[wide] = [self.bytes_from + b for r in raw for b in r]
        return symbols, np.bincount(word, minlength=len(low))

    def encode_texts(self, texts: pa.Array, begin: bool = False, end: bool = False) -> list[np.ndarray]:
        """Ids of each text; a null is an empty text."""
        out: list[np.ndarray] = []
        before, after = [self.begin] * begin, [self.end] * end
        for _, _, data, offsets in text_steps(texts, STEP_BYTES):
            letters = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]
            chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype="<u4")
            some = np.flatnonzero(np.diff(letters) > 0)
            chars = np.insert(np.where(chars == 32, np.uint32(ord(BLANK)), chars), letters[some], ord(BLANK))
            bounds = letters + np.r_[0, np.cumsum(np.diff(letters) > 0)]
            ids, edges = self._of_words(chars, bounds)
            out += [np.concatenate([before, ids[a:b], after]).astype(np.int32) for a, b in zip(edges, edges[1:], strict=False)]
        return out

    def _of_words(self, chars: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a step in a row, and where those of each text begin."""
        if not len(chars):
            return np.empty(0, dtype=np.int32), np.zeros(len(bounds), dtype=np.int64)
        kinds = self.class_of[chars]
        fresh = np.r_[True, ~self.joined[kinds[:-1], kinds[1:]]]
        fresh[bounds[bounds < len(chars)]] = True
        start = np.flatnonzero(fresh)
        stop = np.r_[start[1:], len(chars)]
        found, where, which = np.unique(Substrings(chars).of(start, stop), return_index=True, return_inverse=True)
        if len(self.hashes) + len(found) > MEMORY_WORDS:
            self._forget()
        at = np.searchsorted(self.hashes, found)
        known = np.zeros(len(found), dtype=bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == found
        new = np.flatnonzero(~known)
        if len(new):
            ids, sizes = self._learn(chars, start[where[new]], stop[where[new]])
            self.hashes = np.insert(self.hashes, at[new], found[new])
            self.offsets = np.insert(self.offsets, at[new], len(self.pool) + np.cumsum(sizes) - sizes)
            self.lengths = np.insert(self.lengths, at[new], sizes)
            self.pool = np.concatenate([self.pool, ids.astype(np.int32)])
            at = np.searchsorted(self.hashes, found)
        sizes = self.lengths[at][which]
        ends = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.offsets[at][which] - (ends - sizes), sizes) + np.arange(ends[-1])]
        return ids, np.r_[0, ends][np.searchsorted(start, bounds)]

    def decode_ids(self, ids: np.ndarray) -> str:
        """Text of one list of ids. Control ids show nothing, the first blank is the dummy prefix, a byte that is not UTF-8, by itself or with its neighbours, becomes U+FFFD."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is not in the vocabulary")
        hidden = np.flatnonzero(self.is_control[ids])
        runs = [r for r in (ids[a + 1 : b] for a, b in zip([-1, *hidden], [*hidden, len(ids)], strict=True)) if len(r)]
        return "".join(self._shown(run, opening=not i) for i, run in enumerate(runs))

    def _shown(self, ids: np.ndarray, opening: bool) -> str:
        sizes = self.shown_size[ids]
        ends = np.cumsum(sizes)
        raw = self.shown[np.repeat(self.shown_at[ids] - (ends - sizes), sizes) + np.arange(ends[-1])]
        if opening and self.opens[ids[0]]:
            raw = raw[1:]
        raw = raw.tobytes()
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return raw.decode(errors="each_byte")


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    import codecs

    codecs.register_error("each_byte", _each_byte)
    return PieceModel(path)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(text: Column | str, path: str | None = None, begin: bool = True, end: bool = True) -> Column:
    """``array<int>`` of the piece ids of a whole text, as the sentencepiece library gives them without sampling.

    Null is an empty text, which has no ids but those of begin and end. Equal texts have equal ids. A
    worker remembers at most ``MEMORY_WORDS`` words, told apart by 64-bit hashes, and works on
    ``STEP_BYTES`` of text, or one longer text, at a time.
    """
    path = path or model_path()

    def ids(texts: pa.Array) -> pa.Array:
        rows = piece_model(path).encode_texts(texts, begin, end)
        offsets = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.empty(0, dtype=np.int32)))

    ids.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(ids, "array<int>")(text)


def decode(ids: Column | str, path: str | None = None) -> Column:
    """Text of an ``array<int>`` of piece ids, as the library's ``decode`` gives it; null for null."""
    path = path or model_path()

    def texts(lists: pa.Array) -> pa.Array:
        model = piece_model(path)
        flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        return pa.array([model.decode_ids(flat[a:b]) if ok else None for a, b, ok in zip(offsets, offsets[1:], lists.is_valid().to_pylist(), strict=False)], pa.string())

    texts.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(texts, "string")(ids)


def id_bytes(ids: Column | str) -> Column:
    """An ``array<int>`` as binary: its numbers as little-endian unsigned 32-bit integers."""

    def raw(lists: pa.Array) -> pa.Array:
        flat, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
        return pa.array([flat[a:b].tobytes() if ok else None for a, b, ok in zip(offsets, offsets[1:], lists.is_valid().to_pylist(), strict=False)], pa.binary())

    raw.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(raw, "binary")(ids)
