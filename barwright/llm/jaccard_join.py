"""Exact Jaccard self-join of documents' word shingles by PartEnum signatures.

Sets fall into size bands such that two sets within the threshold stand in one band or in adjacent
ones; a set takes part in its band's instance and the next one's. In an instance, sets differ in at
most ``d`` elements if they are similar enough. The feature domain is cut into first-level partitions and each
of these into three second-level ones; every subset of two of the three is a signature: its content. A
difference spoils two of a partition's three subsets at most, a second one the last, so that with some
half as many partitions as differences, a few subsets at least stay equal.

A signature that many sets share is *hot*. Similar sets have a least number of signatures in common, of
which at most their hot ones are not seen as cold pairs; pairs that share fewer are dropped unverified. Sets
whose hot signatures could hide a partner altogether meet again by their rarest shingles among such sets:
each set's first shingles by rarity are as many as leave too few for a partner without any of them. What
is still hot there is a crowd of near copies: they are held against pivots first, and only sets that are
still in different components of a hot shingle are paired. Equal sets count once throughout. Before sets
are moved, pairs and crowds go through a sieve of parity bits, some thirtieth of a set: two sets differ in at
least as many elements as their bits do. Similarity is verified on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.blocks import linked_blocks, sieved_blocks
from barwright.llm.common import components, follow_hot, forget, stored, within_broadcast
from barwright.llm.hashing import Substrings, U, mix, signed, text_steps

#: Distinct sets that may share a signature before it is hot.
MAX_COLD = 16
#: Bytes of text that one step of a task works on; a longer single text is a step of its own.
STEP_BYTES = 1 << 18
#: Rows of a document's own (identifier, size, fingerprint) travel with the signatures, marked in ``slack``.
OWN_ROW = -2_000_000_000
#: Second-level subsets of a first-level partition: any two of its three.
SUBSETS = ((0, 1), (0, 2), (1, 2))
SIGNED = "sig bigint, fp bigint, slack int"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True

def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; ``offsets`` delimit the texts in ``data``.

    Words are runs without ASCII white space, A-Z lower-cased. A text with fewer than ``k`` words has
    one shingle of them all, one without words none.
    """
    n = len(data)
    texts = len(offsets) - 1
    if n == 0:
        return [np.empty(0, dtype=U)] * texts
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = Substrings(_LOWER[data]).of(starts, ends)
    bounds = np.searchsorted(starts, offsets)
    factors = [U(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(k)]
    out = []
    whole = np.zeros(max(0, len(hashes) - k + 1), dtype=U)
    for j in range(k):
        whole += hashes[j : j + len(whole)] * factors[j]
    whole = mix(whole)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        elif b > a:
            own = hashes[a:b] * np.array(factors[: b - a], dtype=U)
            out.append(mix(np.array([np.add.reduce(own)], dtype=U) + U(b - a)))
        else:
            out.append(np.empty(0, dtype=U))
    return out


class PartEnum:
    """Size bands, Hamming bounds and signatures for a threshold of ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.tops = num, den, [1 * den // num]
        self.known: dict[int, tuple[int, int]] = {}

    def band(self, size: int) -> int:
        """Number of the band that holds ``size`` (from 0); a band's top is the largest size similar to its bottom."""
        while self.tops[-1] < size:
            self.tops.append((self.tops[-1] + 1) * self.den // self.num)
        return int(np.searchsorted(self.tops, size))

    def differences(self, instance: int) -> int:
        """Most elements in which similar sets of the instance (this band and the one before) can differ."""
        while len(self.tops) <= instance:
            self.tops.append((self.tops[-1] + 1) * self.den // self.num)
        return 2 * self.tops[instance] * (self.den - self.num) // (self.den + self.num)

    def shape(self, instance: int) -> tuple[int, int]:
        """First-level partitions of an instance, and the most subsets that its differences can spoil.

        At least three stay, more for larger sets: what may go unused while they are hot.
        """
        d = self.differences(instance)
        parts, spare = 1, max(2, d // 10 + 1)
        while len(SUBSETS) * parts - (lost := 2 * min(d, parts) + max(0, d - parts)) < 1 + spare:
            parts += 1
        return parts, lost

    def _shapes(self, instances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, at = np.unique(instances, return_inverse=True)
        for i in known.tolist():
            if i not in self.known:
                self.known[i] = self.shape(i)
        table = np.array([self.known[i] for i in known.tolist()], dtype=np.int64).reshape(-1, 2)
        return table[at, 0], table[at, 1]

    def signatures(self, items: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For both instances of each of the non-empty sets that ``bounds`` delimit: set numbers, signatures and slacks.

        A slack tells how many of a set's signatures may go unused (less than 0: even all are too few).
        Non-empty subsets have a signature each; empty ones only where all are too few.
        """
        sizes = np.diff(bounds)
        self.band(int(sizes.max()))
        bands = np.searchsorted(self.tops, sizes)
        for instance in (bands, bands + 1):
            parts, lost = self._shapes(instance)
            cells = 3 * parts
            first = np.cumsum(cells) - cells
            own = mix(items * np.repeat((2 * instance + 3).astype(U), sizes))
            cell = ((own >> U(32)) * np.repeat(cells.astype(U), sizes) >> U(32)).astype(np.int64) + np.repeat(first, sizes)
            sums = np.zeros(int(cells.sum()), dtype=U)
            np.add.at(sums, cell, mix(own ^ U(0x5851F42D4C957F2D)))
            filled = (np.bincount(cell, minlength=len(sums)) > 0).reshape(-1, 3)
            sums = sums.reshape(-1, 3)
            content = np.stack([sums[:, i] + sums[:, j] for i, j in SUBSETS], axis=1).ravel()
            there = np.stack([filled[:, i] | filled[:, j] for i, j in SUBSETS], axis=1).ravel()
            of = np.repeat(np.arange(len(sizes)), cells)
            slack = np.bincount(of[there], minlength=len(sizes)) - lost - 1
            kept = np.flatnonzero(there | (slack < 0)[of])
            of, place = of[kept], (kept - first[of[kept]]).astype(U)
            yield of, self._stamp(content[kept], place, instance[of].astype(U)), slack[of]

    @staticmethod
    def _stamp(sums: np.ndarray, place: np.ndarray, instance: np.ndarray) -> np.ndarray:
        return mix(sums + mix(place * U(0x9FB21C651E98DF25) + instance + U(1))) & ~U(255) | instance & U(255)


def _fingerprints(items: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit marks of the sets that ``bounds`` delimit, 0 for empty ones."""
    out, sizes = np.zeros(len(bounds) - 1, dtype=U), np.diff(bounds)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = mix(np.add.reduceat(mix(items), bounds[:-1][full]) + sizes[full].astype(U))
    return out.astype(np.int64)


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.empty(0, dtype=U), *sets]), np.cumsum([0, *map(len, sets)])


def _signature_rows(k: int, num: int, den: int):
    """Signatures of each distinct set of a partition, ``sig, fp, slack``, and each document's own row ``id, fp, OWN_ROW + n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme, seen = PartEnum(num, den), set()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for begin, end, data, offsets in text_steps(batch.column(1), STEP_BYTES):
                sets = shingle_sets(data, offsets, k)
                marks = _fingerprints(*_flat(sets))
                sigs, fps = [ids[begin:end].astype(np.int64).view(U)], [marks]
                slacks = [np.array([OWN_ROW + len(x) for x in sets], dtype=np.int32)]
                new = []
                for at, fp in enumerate(marks.tolist()):
                    if len(sets[at]) and fp not in seen:
                        new.append(at)
                        if len(seen) < 1 << 17:  # copies beyond it are folded behind the shuffle
                            seen.add(fp)
                if new:
                    for of, found, slack in scheme.signatures(*_flat([sets[at] for at in new])):
                        sigs.append(found)
                        fps.append(marks[np.array(new)][of])
                        slacks.append(slack.astype(np.int32))
                yield pa.RecordBatch.from_arrays([signed(np.concatenate(sigs)), pa.array(np.concatenate(fps)), pa.array(np.concatenate(slacks))], ["sig", "fp", "slack"])

    return run


def _groups(max_cold: int):
    """From rows sorted by (sig, fp): pairs of sets that share a cold signature, and the rows of hot ones.

    Emits ``a, b, sig, slack``: a pair (with the greater slack) where ``b`` is set, else set ``a``'s row of the
    hot ``sig``; documents' own rows pass through. A
    signature is hot if more than ``max_cold`` sets share it, or several with one of too few
    signatures. Holds one batch and the sets of one cold signature.
    """
    def pack(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        if found:
            lone = np.concatenate([np.full(len(a), b is None) for a, b, _, _ in found])
            columns = [np.concatenate([(x[0] if x[1] is None else x[1]) if i == 1 else x[i] for x in found]) for i in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(c, mask=lone) if i == 1 else pa.array(c) for i, c in enumerate(columns)], ["a", "b", "sig", "slack"])

    def whole_runs(sig, fp, slack) -> list[tuple]:
        out = []
        start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        count = np.diff(np.r_[start, len(sig)])
        hot = (count > max_cold) | ((np.minimum.reduceat(slack, start) < 0) & (count > 1))
        rows = np.flatnonzero(np.repeat(hot, count))
        if len(rows):
            out.append((fp[rows], None, sig[rows], slack[rows]))
        cold = (count > 1) & ~hot
        for size in np.unique(count[cold]).tolist():
            at = start[cold & (count == size)]
            for x in range(size):
                for y in range(x + 1, size):
                    out.append((fp[at + x], fp[at + y], sig[at], np.maximum(slack[at + x], slack[at + y])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last signature's rows so far
        spent = None  # that signature and its last set, once it is known to be hot and its rows went out
        for batch in batches:
            sig, fp, slack = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            out = []
            if len(own := np.flatnonzero(slack < OWN_ROW // 2)):
                out.append((fp[own], None, sig[own], slack[own]))
                rest = np.flatnonzero(slack >= OWN_ROW // 2)
                sig, fp, slack = sig[rest], fp[rest], slack[rest]
            if spent is not None and len(sig):
                same = int(np.searchsorted(sig, spent[0], side="right"))
                if same:
                    fresh = np.flatnonzero(fp[:same] != np.r_[spent[1], fp[: same - 1]])
                    out.append((fp[fresh], None, sig[fresh], slack[fresh]))
                    spent = (spent[0], fp[same - 1])
                    sig, fp, slack = sig[same:], fp[same:], slack[same:]
                if len(sig):
                    spent = None
            if len(sig):
                if held is not None:
                    sig, fp, slack = (np.concatenate(x) for x in zip(held, (sig, fp, slack), strict=True))
                keep = np.r_[True, (sig[1:] != sig[:-1]) | (fp[1:] != fp[:-1])]
                sig, fp, slack = sig[keep], fp[keep], slack[keep]
                last = int(np.searchsorted(sig, sig[-1], side="left"))
                if last:
                    out += whole_runs(sig[:last], fp[:last], slack[:last])
                held = (sig[last:], fp[last:], slack[last:])
                if len(held[0]) > max_cold:
                    out.append((held[1], None, held[0], held[2]))
                    spent, held = (held[0][-1], held[1][-1]), None
            yield from pack(out)
        if held is not None:
            yield from pack(whole_runs(*held))

    return run


def parity_bits(items: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the sets that ``bounds`` delimit, words of bits that tell whether an odd number of elements fall on them, and where each set's words begin.

    A set has a power of two of 64-bit words, at least two bits an element; the halves of a longer one,
    xor-ed, are what the set has in half as many.
    """
    sizes = np.diff(bounds)
    words = 1 << np.ceil(np.log2(np.maximum(sizes, 32) / 32)).astype(np.int64)
    first = np.cumsum(words) - words
    word = ((items >> U(6)).astype(np.int64) & np.repeat(words - 1, sizes)) + np.repeat(first, sizes)
    out = np.zeros(int(words.sum()), dtype=U)
    np.bitwise_xor.at(out, word, U(1) << (items & U(63)))
    return out, np.r_[first, len(out)]


def _sets(k: int, bits: bool = False):
    """Sets of texts that have the wanted fingerprint: ``fp, items``; with ``bits``, their parity bits instead: ``fp, n, bits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_steps(batch.column(1), STEP_BYTES):
                wanted = batch.column(0).slice(at, end - at).to_pylist()
                sets = shingle_sets(data, offsets, k)
                found = [(fp, x) for fp, mark, x in zip(wanted, _fingerprints(*_flat(sets)).tolist(), sets, strict=True) if len(x) and mark == fp]
                if found and bits:
                    words, ends = parity_bits(*_flat([x for _, x in found]))
                    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), signed(words))
                    yield pa.RecordBatch.from_arrays([pa.array([fp for fp, _ in found], pa.int64()), pa.array([len(x) for _, x in found], pa.int32()), lists], ["fp", "n", "bits"])
                elif found:
                    ends = np.cumsum([0, *(len(x) for _, x in found)]).astype(np.int32)
                    items = pa.ListArray.from_arrays(pa.array(ends), signed(np.concatenate([x for _, x in found])))
                    yield pa.RecordBatch.from_arrays([pa.array([fp for fp, _ in found], pa.int64()), items], ["fp", "items"])

    return run


def _verified(pairs: DataFrame, profile: DataFrame, read: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``pairs(a, b)`` of fingerprints that are similar enough, as a stored table ``src, dst``."""
    owners = profile.where("fp is not null").groupBy("fp").agg(F.min("id").alias("owner"), F.first("n").alias("n"))
    near = (
        pairs.join(owners.select(F.col("fp").alias("a"), F.col("n").alias("na")), "a").join(owners.select(F.col("fp").alias("b"), F.col("n").alias("nb")), "b")
        .where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    )
    near = stored(near)
    of = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(owners, "fp").select("fp", "owner")
    marks = stored(_bits(read, of(near), k))
    sided = near.join(marks.select(F.col("fp").alias("a"), F.col("bits").alias("xa")), "a").join(marks.select(F.col("fp").alias("b"), F.col("bits").alias("xb")), "b")
    close = stored(sided.where(_apart("xa", "xb") * (den + num) <= (F.col("na") + F.col("nb")) * (den - num)).select("a", "b", "na", "nb"))
    forget(near)
    forget(marks)
    sets = stored(_items(read, of(close), k))
    both = close.join(sets.select(F.col("fp").alias("a"), F.col("items").alias("ia")), "a").join(sets.select(F.col("fp").alias("b"), F.col("items").alias("ib")), "b")
    shared = F.size(F.array_intersect("ia", "ib"))
    links = stored(both.withColumn("s", shared).where(F.col("s") * den >= (F.col("na") + F.col("nb") - F.col("s")) * num).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    forget(close)
    forget(sets)
    return links


def _apart(x: str, y: str):
    """In how many parity bits two sets differ, in as many words as the shorter has; sets differ in as many elements at least."""
    fewer = F.least(F.size(x), F.size(y))

    def folded(c: str):
        parts = F.transform(F.sequence(F.lit(0), (F.size(c) / fewer).cast("int") - 1), lambda i: F.slice(c, i * fewer + 1, fewer))
        return F.when(F.size(c) == fewer, F.col(c)).otherwise(F.aggregate(parts, F.array_repeat(F.lit(0).cast("bigint"), fewer), lambda a, p: F.zip_with(a, p, lambda u, v: u.bitwiseXOR(v))))

    return F.aggregate(F.zip_with(folded(x), folded(y), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda a, n: a + n)


def _grouped(signed: DataFrame, max_cold: int) -> DataFrame:
    return stored(signed.repartition("sig").sortWithinPartitions("sig", "fp").mapInArrow(_groups(max_cold), "a bigint, b bigint, sig bigint, slack int"))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, max_cold: int = MAX_COLD) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_shingles, component_id``.

    Two documents link when their sets of ``k``-word shingles have ``den * shared >= num * union``;
    ``component_id`` is the smallest identifier that links reach. Null or blank texts have no shingles
    and link with nothing. Rows of a null identifier stay alone (``component_id`` null) and link
    nothing; rows that repeat an identifier are documents that happen to share it. Only the two named
    columns are read; no rows in, no rows out. Sets are told apart by 64-bit hashes.
    """
    read = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    usable = read.where("id is not null")
    groups = _grouped(usable.mapInArrow(_signature_rows(k, num, den), SIGNED), max_cold)
    profile = groups.where(f"slack < {OWN_ROW // 2}").select(F.col("sig").alias("id"), (F.col("slack") - OWN_ROW).cast("bigint").alias("n"), F.when(F.col("slack") > OWN_ROW, F.col("a")).alias("fp"))
    instance = F.col("sig").bitwiseAND(F.lit(255)).alias("instance")
    hot = groups.where(f"b is null and slack >= {OWN_ROW // 2}").groupBy(F.col("a").alias("fp"), instance).agg(F.min("slack").alias("slack"), F.count(F.lit(1)).alias("hot"))
    hot = stored(hot)
    links = _verified(_enough(groups, hot, instance), profile, usable, k, num, den)
    crowded = stored(hot.where("hot > slack").select("fp").distinct())
    if crowded.take(1):
        prefixes = _rarest(crowded, profile, usable, k, num, den)
        holders = prefixes.groupBy("sig").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
        shared = stored(prefixes.join(holders, "sig"))
        few = shared.where(f"holders <= {max_cold}")
        pairs = few.select("sig", F.col("node").alias("a")).join(few.select("sig", F.col("node").alias("b")), "sig").where("a < b").select("a", "b").distinct()
        links = stored(links.union(_verified(stored(pairs), profile, usable, k, num, den)))
        still = shared.where(f"holders > {max_cold}").select("sig", "node")
        if still.take(1):
            links = follow_hot(still, links, lambda found: _verified(found, profile, usable, k, num, den), last=lambda rows: _in_blocks(rows, profile, usable, k, num, den))
    roots = components(links)
    labelled = profile.where("fp is not null").join(roots, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("id").alias("component_id"))
    of_set = labelled.groupBy("fp").agg(F.first("root").alias("root")).join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    joined = profile.join(of_set, F.col("fp") == F.col("_fp"), "left").select("id", "n", F.coalesce("component_id", "id").alias("component_id"))
    lone = read.where("id is null").mapInArrow(_sizes(k), "id bigint, n bigint").select("id", "n", F.lit(None).cast("bigint").alias("component_id"))
    return joined.unionByName(lone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _rarest(chosen: DataFrame, profile: DataFrame, read: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Stored ``sig, node``: of each chosen set the rarest shingles, one more than a similar set can lack."""
    owners = chosen.join(profile.where("fp is not null").groupBy("fp").agg(F.min("id").alias("owner")), "fp")
    items = stored(_items(read, owners, k).select("fp", F.size("items").alias("n"), F.explode("items").alias("item")))
    common = items.groupBy("item").agg(F.count(F.lit(1)).alias("sets"))
    rank = F.row_number().over(Window.partitionBy("fp").orderBy("sets", "item"))
    first = items.join(common, "item").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.floor((F.col("n") * num + den - 1) / den) + 1)
    return stored(first.select(F.col("item").alias("sig"), F.col("fp").alias("node")))


def _in_blocks(rows: DataFrame, profile: DataFrame, read: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links ``src, dst`` between different components of ``rows(sig, n, root)``, found block against block: of all bits, then of the sets left."""
    owners = profile.where("fp is not null").groupBy("fp").agg(F.min("id").alias("owner"))
    of = lambda rows: rows.select(F.col("n").alias("fp")).distinct().join(owners, "fp")
    left = sieved_blocks(rows, _bits(read, of(rows), k), num, den)
    return linked_blocks(left, _items(read, of(left), k), num, den)


def _wanted(read: DataFrame, owners: DataFrame) -> DataFrame:
    return read.join(within_broadcast(stored(owners)), F.col("id") == F.col("owner")).select("fp", "text")


def _items(read: DataFrame, owners: DataFrame, k: int) -> DataFrame:
    """Sets ``fp, items`` of ``owners(fp, owner)``, each once."""
    return _wanted(read, owners).mapInArrow(_sets(k), "fp bigint, items array<bigint>").dropDuplicates(["fp"])


def _bits(read: DataFrame, owners: DataFrame, k: int) -> DataFrame:
    """Sizes and parity bits ``fp, n, bits`` of the sets of ``owners(fp, owner)``, each once."""
    return _wanted(read, owners).mapInArrow(_sets(k, bits=True), "fp bigint, n int, bits array<bigint>").dropDuplicates(["fp"])


def _sizes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(x) for _, _, data, offsets in text_steps(batch.column(1), STEP_BYTES) for x in shingle_sets(data, offsets, k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["id", "n"])

    return run


def _enough(groups: DataFrame, hot: DataFrame, instance) -> DataFrame:
    """Stored ``a, b`` of pairs that share enough cold signatures in some instance to be similar.

    Similar sets have at least ``slack + 1`` signatures in common, all cold but for their hot ones.
    """
    counted = groups.where("b is not null").groupBy("a", "b", instance).agg(F.count(F.lit(1)).alias("shared"), F.max("slack").alias("slack"))
    side = lambda c: hot.select(F.col("fp").alias(c), "instance", F.col("hot").alias(f"hot_{c}"))
    met = counted.join(side("a"), ["a", "instance"], "left").join(side("b"), ["b", "instance"], "left")
    unseen = F.greatest(F.coalesce("hot_a", F.lit(0)), F.coalesce("hot_b", F.lit(0)))
    return stored(met.where(F.col("shared") > F.col("slack") - unseen).select("a", "b").distinct())


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document per component: the one with the smallest identifier."""
    found = similar_components(docs, id_col, text_col, **options)
    gone = within_broadcast(stored(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
