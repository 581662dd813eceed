"""Best-fit packing of token sequences by a configuration linear program.

A document is its token ids and a closing id 0; one that is longer than the capacity is cut into pieces of the
capacity and a rest. The lengths' histogram (at most ``capacity`` rows) is all that reaches the driver. There
multiplicative weights with knapsack pricing solve the covering program over bin configurations to a stated gap
between the fractional bins and the dual bound; the fractional weights are rounded to whole bins of pieces that are
left, and the program is solved again for the rest, until a round places less than a tenth of it. Those last pieces
are put best fit, by decreasing length, into remaining space or new bins. The plan is a bounded table of slots;
pieces take their slots by their rank among equal lengths, computed without gathering a length in one task.

Defined results: null or empty text is the lone closing id; repeated rows are packed one by one; a null doc_id
is kept; extra columns are ignored; an empty table gives an empty plan.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import emptied, materialize

CAPACITY = 2048
MARK = "\x01"
GAP = 0.2
"""The fractional solution of each round needs at most so much more bins than its dual bound, as a share."""
RATE, SLACK = 0.5, 0.05
"""Learning rate of the weights, and how far below its best a table of the knapsack still prices configurations."""
CACHE_UNITS = 1_000_000
CHUNK_CHARS = 1_000_000
RANK_ROWS = 50_000
"""Rows of one length that a task ranks at most, on average."""

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts as bytes (little-endian uint32). No token of the vocabulary reaches over white space, so
    the parts between spaces and line feeds are encoded once each and kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        if resize := getattr(self.lib.model, "_resize_cache", None):
            resize(0)  # the cache here keeps whole units, so the library's own would only cost
        self.cache: dict[str, bytes] = {"": b""}
        (self.mark,) = self.lib.encode(MARK, add_special_tokens=False).ids

    def forget(self) -> None:
        self.cache = {"": b""}

    def encode(self, texts: list[str]) -> list[bytes]:
        # A-Z are lower-cased by the tokenizer anyway; texts that may hold a special token are left as they are.
        texts = [t if "<|" in t else t.encode().lower().decode() for t in texts]
        units = [t.replace("\n", " ").split(" ") for t in texts]
        get, found, missing = self.cache.get, [], set()
        for u in units:
            ids = list(map(get, u))
            holes = [k for k, x in enumerate(ids) if x is None]
            missing.update([u[k] for k in holes])
            found.append((ids, holes))
        if missing:
            if len(self.cache) + len(missing) > CACHE_UNITS:
                self.forget()
            self._learn(missing)
            for u, (ids, holes) in zip(units, found, strict=True):
                for k in holes:
                    ids[k] = self.cache[u[k]]
        return [b"".join(ids) for ids, _ in found]

    def _learn(self, missing: set[str]) -> None:
        # A comma or stop behind letters is a token of its own, so such a unit is its word and that sign.
        cut, new = [], set()
        for u in missing:
            word = u[:-1]
            if u[-1] in ",." and word.isalpha() and (word.isascii() or (max(word) < "\u0250" and word.lower().isalpha())):
                cut.append(u)
                new.add(word)
            else:
                new.add(u)
        new.update(",.")
        odd = {u for u in new if MARK in u or "<|" in u}
        self._encode_joined(list(new.difference(odd).difference(self.cache)))
        for u in odd:
            self.cache[u] = array("I", self.lib.encode(u, add_special_tokens=False).ids).tobytes()
        for u in cut:
            self.cache[u] = self.cache[u[:-1]] + self.cache[u[-1]]

    def _encode_joined(self, units: list[str]) -> None:
        """Many units in one text, between marks: each call has a price of its own. The mark's token ends every unit's."""
        for k in range(0, len(units), 4096):
            part = units[k : k + 4096]
            ids = np.array(self.lib.encode_batch_fast([f" {MARK} ".join([*part, ""])], add_special_tokens=False)[0].ids, "<u4")
            ends = np.nonzero(ids == self.mark)[0]
            assert len(ends) == len(part), "a unit holds the mark"
            raw, at = ids.tobytes(), 0
            for u, end in zip(part, (4 * ends).tolist(), strict=True):
                self.cache[u] = raw[at:end]
                at = end + 4


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc, step = encoder(tokenizer), 4 * capacity

        def rows(keys: list, texts: list[str]) -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], []]
            for key, ids in zip(keys, enc.encode(texts), strict=True):
                ids += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for column, v in zip(out, (key, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

        for b in batches:
            keys, texts, size = [], [], 0
            for key, t in zip(b.column(0), b.column(1), strict=True):
                keys.append(key.as_py())
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size > CHUNK_CHARS:
                    yield rows(keys, texts)
                    keys, texts, size = [], [], 0
            if keys:
                yield rows(keys, texts)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return emptied(run(batches), encoder(tokenizer).forget)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _knapsack(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack: the best worth of each capacity; lengths ascend."""
    best = np.zeros(capacity + 1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        best[c] = max(best[c - 1], (best[c - lengths[: upto[c]]] + worth[: upto[c]]).max())
    return best


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, gap: float = GAP) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """({((length's index, how often), ...): bins}, dual bound) of the covering program; lengths ascend.

    Prices start at the volume bound's (length over capacity) and fall with exp(-rate * coverage). Each step adds the
    configuration that the knapsack finds dearest, so often that the scarcest of its lengths is covered once more; a
    table of the knapsack serves until the dearest configuration at the prices of then is worth less than 1 - SLACK of
    its best. Any prices give a dual bound: their total over the pieces, divided by the dearest configuration. Ends when
    the bins, scaled so that every length is covered, are within ``gap`` of the best dual bound; as the rate falls with
    the root of the coverage, they get there whatever the gap is."""
    volume, n = lengths / capacity, counts.astype(float)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    cover, bins, total, bound = np.zeros(len(lengths)), {}, 0.0, 0.0
    while True:
        low = cover.min()
        if low > 0 and total <= (1 + gap) * bound * low:
            return {config: x / low for config, x in bins.items()}, bound
        rate = RATE / np.sqrt(1 + (total / bound if bound else 0))
        price = volume * np.exp(-rate * (cover - low))
        best = _knapsack(lengths, price, capacity)
        bound = max(bound, float(n @ price) / best[capacity])
        fresh = True
        while True:
            taken: dict[int, int] = {}
            at = capacity
            while k := upto[at]:
                # Ties go to the larger length, as the small ones fit in later.
                j = k - 1 - int((price[:k] + best[at - lengths[:k]])[::-1].argmax())
                taken[j] = taken.get(j, 0) + 1
                at -= int(lengths[j])
            which, often = np.fromiter(taken, np.int64), np.fromiter(taken.values(), float)
            if not fresh and price[which] @ often < (1 - SLACK) * best[capacity]:
                break
            fresh = False
            step = (n[which] / often).min()
            config = tuple(sorted(taken.items()))
            bins[config] = bins.get(config, 0.0) + step
            total += step
            cover[which] += step * often / n[which]
            price[which] = volume[which] * np.exp(-rate * (cover[which] - low))


def rounded(bins: dict[tuple[tuple[int, int], ...], float], counts: np.ndarray) -> tuple[list[tuple[tuple[tuple[int, int], ...], int]], np.ndarray]:
    """Whole bins of the configurations, largest first, and the counts left: each is rounded so that the running sums
    are (their parts carry over to the next), and no length is taken more often than it is left."""
    left, out, before = counts.copy(), [], 0.0
    for config, x in sorted(bins.items(), key=lambda c: (-c[1], c[0])):
        times = min(int(before + x) - int(before), *(int(left[j]) // often for j, often in config))
        before += x
        if times:
            out.append((config, times))
            for j, often in config:
                left[j] -= times * often
    return out, left


def configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int, gap: float = GAP) -> tuple[list[tuple[tuple[int, ...], int]], float]:
    """((lengths in a bin, number of such bins), ...) by rounds of the program and its rounding, and the dual bound of
    the first round, which no packing can beat."""
    left, found, least = counts.copy(), [], None
    while left.any():
        open_ = np.nonzero(left)[0]
        bins, bound = fractional(lengths[open_], left[open_], capacity, gap)
        least = bound if least is None else least
        whole, rest = rounded(bins, left[open_])
        found += [(tuple(int(lengths[open_[j]]) for j, often in config for _ in range(often)), times) for config, times in whole]
        placed = left[open_].sum() - rest.sum()
        last = 10 * placed < left.sum()
        left[open_] = rest
        if last:
            break
    return found, least or 0.0


def plan(histogram: dict[int, int], capacity: int = CAPACITY, gap: float = GAP) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a bin, number of such bins), covering the histogram exactly."""
    if not histogram:
        return []
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[int(x)] for x in lengths])
    bins: dict[int, list] = {}  # free space -> [[lengths, bins], ...]
    left = dict(histogram)
    for config, times in configurations(lengths, counts, capacity, gap)[0]:
        bins.setdefault(capacity - sum(config), []).append([config, times])
        for x in config:
            left[x] -= times
    spaces = sorted(bins)

    def put(space: int, config: tuple, times: int) -> None:
        if space not in bins:
            bisect.insort(spaces, space)
            bins[space] = []
        bins[space].append([config, times])

    for x in sorted(left, reverse=True):
        n = left[x]
        while n:
            k = bisect.bisect_left(spaces, x)
            if k == len(spaces):
                each = capacity // x
                if n >= each:
                    put(capacity - each * x, (x,) * each, n // each)
                    n %= each
                if n:
                    put(capacity - n * x, (x,) * n, 1)
                break
            space = spaces[k]
            config, times = bins[space].pop()
            if not bins[space]:
                del bins[space], spaces[k]
            m = min(times, n)
            if times > m:
                put(space, config, times - m)
            put(space - x, (*config, x), m)
            n -= m
    return [(tuple(c), t) for group in bins.values() for c, t in group]


def slots(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of its intervals, the first sequence of each, and the offset there."""
    out: dict[int, list] = {}
    first = 0
    for config, times in bins:
        offset = 0
        for x in config:
            rows = out.setdefault(x, [0])
            rows.append((rows[0], first, offset))
            rows[0] += times
            offset += x
        first += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*rows[1:], strict=True)) for x, rows in out.items()}


def pack(parts: DataFrame, capacity: int = CAPACITY, gap: float = GAP) -> DataFrame:
    """parts (of ``pieces``, materialized) with sequence_id and offset."""
    histogram = {int(r["length"]): int(r["n"]) for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(plan(histogram, capacity, gap))
    share = max(1, -(-sum(histogram.values()) // RANK_ROWS))
    keyed = parts.withColumn("__b", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(share)).cast("int"))
    before = keyed.groupBy("length", "__b").agg(F.count("*").alias("__n"))
    w = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "__b", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    own = Window.partitionBy("length", "__b").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = keyed.withColumn("__rank", F.row_number().over(own) - 1).join(before, ["length", "__b"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("__rank") + F.col("__before")).cast("long").alias("__rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (np.asarray(b.column(i)) for i in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                rows = np.nonzero(length == x)[0]
                starts, firsts, offsets = table[int(x)]
                k = np.searchsorted(starts, rank[rows], side="right") - 1
                sequence[rows], offset[rows] = firsts[k] + rank[rows] - starts[k], offsets[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, gap: float = GAP) -> DataFrame:
    return pack(materialize(pieces(docs, tokenizer, capacity), "pieces"), capacity, gap)
