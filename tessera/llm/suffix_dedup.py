"""Removal of repeated byte strings with suffix arrays built by two-stage sorting.

A byte goes if a string of SPAN bytes that covers it starts anywhere else too. Anchors (see ``anchors``) find the
places that can repeat: each string of SPAN bytes (a window) belongs to the anchor with its least hash, the leftmost
of equal ones, so equal windows belong to equal anchors at the same offset. An anchor's context is what its windows
cover. Contexts that occur twice as a whole repeat as they are; each class of the others is taken once and its
windows, split by which half of the context they reach into, meet the windows of the contexts with the same anchor
and half in one suffix array:

- suffixes smaller than their successor are sorted directly (to SPAN bytes),
- the rest is induced by scanning the buckets of first bytes upwards,
- neighbours with a common prefix of SPAN bytes are equal windows.

Groups of contexts beyond UNIT are halved again by what their windows share, until they are small or hold one
window each, whose equality the key then decides. No group is gathered beyond that.

Defined results: null text is empty; texts shorter than SPAN lose nothing; rows with equal text are copies of
each other; ids play no part, so null or repeated ids are kept as they are; extra columns are ignored (``digest``)
or kept (``clean``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.anchors import GRAM, anchor_positions, anchors_of, neighbours
from tessera.llm.common import discard, emptied, materialize, shuffle_partitions
from tessera.llm.groups import runs

SPAN = 200
REACH = SPAN - GRAM
HALF = REACH // 2
UNIT = 8192
"""Contexts of a group that one task takes."""
WINDOWS = 60_000
"""Windows sorted at a time."""
CHUNK = 1 << 18


# The suffix array


def sort_suffixes(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted positions in the order of their suffixes' first ``depth`` bytes (at least), by two-stage sorting.

    ``text`` ends with at least depth + 1 zero bytes after the last wanted position."""
    n = len(text)
    change = np.nonzero(text[1:] != text[:-1])[0]
    k = np.searchsorted(change, np.arange(n))
    smaller = np.ones(n, bool)  # type B: smaller than the successor; the last suffix counts as such
    inside = k < len(change)
    at = change[k[inside]]
    smaller[inside] = text[at] < text[at + 1]
    # Positions needed to induce the wanted ones: from each up to the next of type B.
    following = np.where(smaller, np.arange(n), n)
    following = np.minimum.accumulate(following[::-1])[::-1]
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, wanted, 1)
    np.add.at(mark, following[wanted] + 1, -1)
    need = np.cumsum(mark[:n]) > 0
    # First stage: direct sorting.
    b = np.nonzero(need & smaller)[0]
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(depth, np.uint8)]), depth)[b]
    b = b[np.argsort(rows.view(f"S{depth}").ravel(), kind="stable")]
    # Second stage: buckets upwards; in each, first what is larger than its successor, by the successor's rank.
    rank = np.full(n + 1, -1, np.int64)
    a = np.nonzero(need & ~smaller)[0]
    a = a[np.argsort(text[a], kind="stable")]
    first_a, first_b, done = text[a], text[b], 0
    for c in np.unique(np.concatenate([first_a, first_b])):
        own = a[slice(*np.searchsorted(first_a, [c, int(c) + 1]))]
        below = own[text[own + 1] < c]
        level = below[np.argsort(rank[below + 1], kind="stable")]
        run = own[text[own + 1] == c]
        while True:
            rank[level] = np.arange(done, done + len(level))
            done += len(level)
            if not len(run):
                break
            ready = (rank[run + 1] >= 0) & (~smaller[run + 1])
            level, run = run[ready], run[~ready]
            if not len(level):
                break
            level = level[np.argsort(rank[level + 1], kind="stable")]
        tail = b[slice(*np.searchsorted(first_b, [c, int(c) + 1]))]
        rank[tail] = np.arange(done, done + len(tail))
        done += len(tail)
    return wanted[np.argsort(rank[wanted], kind="stable")]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix, at most ``depth``, of each suffix in ``order`` with the one before it (0 for the first)."""
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, depth)
    out = np.zeros(len(order), np.int64)
    for k in range(1, len(order), WINDOWS):
        differ = view[order[k : k + WINDOWS]] != view[order[k - 1 : k - 1 + len(order[k : k + WINDOWS])]]
        out[k : k + WINDOWS] = np.where(differ.any(1), differ.argmax(1), depth)
    return out


def repeated_windows(contexts: list[bytes], first: np.ndarray, last: np.ndarray, place: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """For each context the starts (in it) of windows that occur elsewhere.

    Context i is considered for window starts first[i]..last[i]; its byte 0 lies at place[i], a number that no two
    different bytes of the corpus share; weight[i] above 1 says that the whole context occurs so often."""
    size = np.array([len(c) for c in contexts])
    begin = np.cumsum(size) - size
    text = np.concatenate([np.frombuffer(b"".join(contexts), np.uint8), np.zeros(SPAN + 1, np.uint8)])
    count = last - first + 1
    owner = np.repeat(np.arange(len(contexts)), count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    wanted = begin[owner] + within
    order = sort_suffixes(text, wanted, SPAN)
    same = common_prefixes(text, order, SPAN) >= SPAN
    kind = np.cumsum(~same)
    back = np.empty(len(text), np.int64)
    back[wanted] = np.arange(len(wanted))
    who = back[order]
    where = place[owner[who]] + within[who].astype(np.uint64)
    by = np.lexsort((where, kind))
    new_place = np.ones(len(by), np.int64)
    new_place[1:] = (kind[by][1:] != kind[by][:-1]) | (where[by][1:] != where[by][:-1])
    places = np.zeros(kind.max() + 1, np.int64)
    np.add.at(places, kind[by], new_place)
    np.maximum.at(places, kind, np.where(weight[owner[who]] > 1, 2, 0))
    hit = np.zeros(len(wanted), bool)
    hit[who] = places[kind] > 1
    ends = np.cumsum(count)
    return [within[e - c : e][hit[e - c : e]] for c, e in zip(count.tolist(), ends.tolist(), strict=True)]


# Anchors, contexts and units


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a text column in a row, and where each text starts and ends (null: empty)."""
    texts = [t.as_buffer() if t.is_valid else b"" for t in column.cast(pa.binary())]
    size = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(size)
    return np.frombuffer(b"".join(texts), np.uint8), end - size, end


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK bytes."""
    at, size = 0, 0
    for i, t in enumerate(column):
        size += len(t.as_buffer()) if t.is_valid else 0
        if size >= CHUNK:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(column):
        yield at, len(column)


def anchor_rows(docs: DataFrame) -> DataFrame:
    """akey, ckey, halves, tid, spot of each anchor with windows: hashes of its gram, of its context, of the two halves
    (32 bits each, 0: no window reaches there), the text's hash, and the place with how far before the anchor the
    windows start (position * 65536 + nearest * 256 + farthest). Wants tid and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, short = xxhash.xxh3_64_intdigest, lambda b: (xxhash.xxh3_64_intdigest(b) & 0xFFFFFFFF) or 1
        for b in batches:
            tids = np.asarray(b.column(0))
            for i, j in _slices(b.column(1)):
                data, start, end = _raw(b.column(1).slice(i, j - i))
                at, h = anchor_positions(data, start, end, SPAN) if len(data) <= 4 * CHUNK else _long(data, start, end)
                if not len(at):
                    continue
                d = np.searchsorted(end, at, side="right")
                before, after = neighbours(at, h, SPAN - GRAM)
                first = np.maximum(np.maximum(start[d], at - REACH), before + 1)
                last = np.minimum(np.minimum(at, end[d] - SPAN), after - REACH - 1)
                use = np.nonzero(first <= last)[0]
                at, h, d, first, last = at[use], h[use], d[use], first[use], last[use]
                whole, p = memoryview(data), at.tolist()
                # With the anchor's offset: in a run of one byte, one stretch can be the context of many anchors.
                ckey = [digest(whole[x : y + SPAN], q - x) for q, x, y in zip(p, first.tolist(), last.tolist(), strict=True)]
                near, far = at - last, at - first
                half = [((short(whole[q - HALF : q + GRAM]) if f >= HALF else 0) << 32) | (short(whole[q : q + SPAN - HALF + 1]) if n < HALF else 0) for q, n, f in zip(p, near.tolist(), far.tolist(), strict=True)]
                spot = (at - start[d]) * 65536 + near * 256 + far
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(np.array(ckey, np.uint64).view(np.int64)), pa.array(np.array(half, np.uint64).view(np.int64)), pa.array(tids[i + d]), pa.array(spot)],
                    ["akey", "ckey", "halves", "tid", "spot"],
                )

    return docs.select("tid", "text").mapInArrow(lambda batches: emptied(run(batches)), "akey long, ckey long, halves long, tid long, spot long")


def _long(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of a chunk with a very long text, text by text in segments."""
    found = [(p + s, h) for s, e in zip(start, end, strict=True) for p, h in [anchors_of(data[s:e], SPAN)]]
    return np.concatenate([p for p, _ in found]), np.concatenate([h for _, h in found])


def _contexts(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """A row for each context and half: gkey, ctx, rel (where the anchor is in ctx), near and far (the half's windows
    start so many bytes before the anchor), tid, place (of ctx in the text), cn. refs has per (tid, rep) the list
    ``at`` of (akey, halves, spot, cn, left, right)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for tid, text, at in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                for x in at:
                    p, nearest, farthest, halves = x["spot"] >> 16, x["spot"] >> 8 & 255, x["spot"] & 255, x["halves"] & 0xFFFFFFFFFFFFFFFF
                    # Windows start at p - l: l from HALF on reach the left half, the others the right one.
                    for ok, side, key, near, far in ((x["left"], 0, halves >> 32, HALF, REACH), (x["right"], 1, halves & 0xFFFFFFFF, 0, HALF - 1)):
                        lo, hi = p - min(far, farthest), p - max(near, nearest)
                        if ok and key and lo <= hi:
                            g = xxhash.xxh3_64_intdigest(f"{x['akey']},{side},{key}")
                            for c, v in zip(out, (g - (1 << 63), data[lo : hi + SPAN], p - lo, near, far, tid, lo, x["cn"]), strict=True):
                                c.append(v)
                    if len(out[0]) >= 4096:
                        yield _unit_batch(out)
                        out = [[] for _ in range(8)]
            yield _unit_batch(out)

    joined = docs.select("tid", "text", "doc_id").join(refs, (docs["tid"] == refs["tid"]) & docs["doc_id"].eqNullSafe(refs["rep"])).select(docs["tid"], "text", "at")
    return joined.mapInArrow(run, "gkey long, ctx binary, rel int, near int, far int, tid long, place int, cn long")


def _unit_batch(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["gkey", "ctx", "rel", "near", "far", "tid", "place", "cn"])


def _refine(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units in groups up to UNIT, spans (tid, start, stop) found on the way): larger groups are halved by what
    their windows have in common; windows of a group that is down to one start are equal."""
    spans = units.select("tid", F.col("place").alias("start"), F.col("place").alias("stop")).limit(0)
    done = None
    first = F.greatest(F.lit(0), F.col("rel") - F.col("far"))
    last = F.least(F.octet_length("ctx") - SPAN, F.col("rel") - F.col("near"))
    while True:
        sizes = units.groupBy("gkey").agg(F.count("*").alias("__n"))
        hot = materialize(sizes.where(F.col("__n") > UNIT).select("gkey"), "hot-groups")
        if hot.isEmpty():
            return (units if done is None else done.unionByName(units)), spans
        small = units.join(hot, "gkey", "left_anti")
        done = small if done is None else done.unionByName(small)
        large = units.join(hot, "gkey", "left_semi")
        # One start left: equal windows. Two different places, or one that stands for several, are a repeat.
        single = large.where("near = far").select("gkey", "tid", "cn", (F.col("place") + F.col("rel") - F.col("near")).alias("start"))
        where = single.groupBy("gkey").agg(F.min(F.struct("tid", "start")).alias("__a"), F.max(F.struct("tid", "start")).alias("__z"), F.max("cn").alias("__c"))
        found = single.join(where.where("__a <> __z OR __c > 1").select("gkey"), "gkey", "left_semi")
        spans = spans.unionByName(found.select("tid", "start", (F.col("start") + SPAN).alias("stop")))
        mid = F.floor((F.col("near") + F.col("far")) / 2).cast("int")
        parts = F.array(F.struct(F.col("near").alias("near"), mid.alias("far")), F.struct((mid + 1).alias("near"), F.col("far").alias("far")))
        halved = large.where("near < far").withColumn("__p", F.explode(parts)).withColumns({"near": F.col("__p.near"), "far": F.col("__p.far")}).where(first <= last)
        shared = F.expr(f"substring(ctx, rel - near + 1, {SPAN} - far + near)")
        units = halved.withColumn("gkey", F.xxhash64("gkey", "near", "far", shared)).drop("__p")
        alone = units.groupBy("gkey").agg(F.count("*").alias("__n")).where("__n > 1").select("gkey")
        units = materialize(units.join(alone, "gkey", "left_semi"), "units")


def _array_spans(units: DataFrame) -> DataFrame:
    """Spans (tid, start, stop) of windows that occur elsewhere, from suffix arrays of whole groups."""
    spark = units.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, windows = [], 0
        for g in runs(batches, 1):
            if len(g) < 2:
                continue
            mine = len(g) * (HALF + 1)
            if held and windows + mine > WINDOWS:
                yield _spans(held)
                held, windows = [], 0
            held.append(g)
            windows += mine
        if held:
            yield _spans(held)

    dealt = units.select("gkey", "ctx", "rel", "near", "far", "tid", "place", "cn").repartition(shuffle_partitions(spark), "gkey").sortWithinPartitions("gkey")
    return dealt.mapInArrow(lambda batches: emptied(run(batches)), "tid long, start int, stop int")


def _spans(tables: list[pa.Table]) -> pa.RecordBatch:
    t = pa.concat_tables(tables)
    contexts, tid, place, cn = t["ctx"].to_pylist(), t["tid"].to_numpy(), t["place"].to_numpy(), t["cn"].to_numpy()
    rel, near, far = (t[c].to_numpy().astype(np.int64) for c in ("rel", "near", "far"))
    last_start = np.array([len(c) for c in contexts]) - SPAN
    code = np.unique(tid, return_inverse=True)[1].astype(np.uint64) * np.uint64(1 << 40) + place.astype(np.uint64)
    out_tid, out_start, out_stop = [], [], []
    # A large group goes by slices of window starts: equal windows lie at equal distance from their anchor.
    step = REACH + 1 if len(contexts) * (HALF + 1) <= WINDOWS or len(tables) > 1 else max(1, WINDOWS // len(contexts))
    for k in range(int(near.min()), int(far.max()) + 1, step):
        first = np.maximum(0, rel - np.minimum(far, k + step - 1))
        last = np.minimum(last_start, rel - np.maximum(near, k))
        use = np.nonzero(first <= last)[0]
        if len(use) < 2:
            continue
        found = repeated_windows([contexts[i] for i in use], first[use], last[use], code[use], cn[use])
        for i, starts in zip(use.tolist(), found, strict=True):
            if len(starts) and cn[i] == 1:
                cut = np.nonzero(np.diff(starts) > 1)[0]
                for a, z in zip(starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.concatenate([cut, [len(starts) - 1]])].tolist(), strict=True):
                    out_tid.append(tid[i])
                    out_start.append(place[i] + a)
                    out_stop.append(place[i] + z + SPAN)
    return pa.RecordBatch.from_arrays([pa.array(out_tid, pa.int64()), pa.array(out_start, pa.int32()), pa.array(out_stop, pa.int32())], ["tid", "start", "stop"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """tid and spans (array of start, stop; not merged) of the texts that have any. docs: tid, doc_id, text."""
    every = materialize(anchor_rows(docs), "anchors")
    twice = materialize(every.groupBy("akey").agg(F.count("*").alias("__n")).where("__n > 1").select("akey"), "repeated-anchors")
    # Both sides come from files and the result goes to one, so the adaptive skew join can split a hot anchor's rows.
    met = materialize(every.join(twice.hint("merge"), "akey"), "met-anchors")
    discard(every, twice)
    kinds = met.groupBy("akey", "ckey", "halves").agg(F.count("*").alias("cn"), F.min(F.struct("tid", "spot")).alias("at"))
    kinds = materialize(kinds, "contexts")
    # Contexts that occur as a whole twice or more are repeats from end to end.
    whole = met.join(kinds.where("cn > 1").select("akey", "ckey"), ["akey", "ckey"], "left_semi").select("tid", "spot").distinct()
    place, near, far = (F.expr(x) for x in ("shiftright(spot, 16)", "shiftright(spot, 8) & 255", "spot & 255"))
    whole = whole.select("tid", (place - far).cast("int").alias("start"), (place - near + SPAN).cast("int").alias("stop"))
    # The others: only those whose half is shared by another context of the same anchor.
    left, right = F.shiftrightunsigned("halves", 32).alias("__h"), F.expr("halves & 4294967295L").alias("__h")
    both = kinds.select("akey", left, F.lit(0).alias("__side"), "cn").union(kinds.select("akey", right, F.lit(1), "cn")).where("__h <> 0")
    shared = both.groupBy("akey", "__h", "__side").agg(F.count("*").alias("__n"), F.min("cn").alias("__least")).where("__n > 1 AND __least = 1")
    sided = lambda side, name: shared.where(F.col("__side") == side).select("akey", F.col("__h").alias(f"__{name}"), F.lit(True).alias(name))
    picked = kinds.withColumns({"__left": left, "__right": right}).join(sided(0, "left"), ["akey", "__left"], "left").join(sided(1, "right"), ["akey", "__right"], "left")
    picked = picked.where("left OR right").select("akey", "halves", "cn", "at.tid", "at.spot", F.coalesce("left", F.lit(False)).alias("left"), F.coalesce("right", F.lit(False)).alias("right"))
    refs = picked.groupBy("tid").agg(F.collect_list(F.struct("akey", "halves", "spot", "cn", "left", "right")).alias("at"))
    rep = docs.groupBy("tid").agg(F.min("doc_id").alias("rep"))
    units, early = _refine(materialize(_contexts(docs, refs.join(rep, "tid")), "units"))
    found = whole.unionByName(_array_spans(units)).unionByName(early)
    return materialize(found.groupBy("tid").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "spans")


def _with_tid(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.coalesce(F.col("text"), F.lit(""))).withColumn("tid", F.xxhash64("text"))


def cut(data: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """What is left, bytes removed, and number of maximal runs removed."""
    kept, at, removed, runs = [], 0, 0, 0
    last = -1
    for s in sorted((x["start"], min(x["stop"], len(data))) for x in spans or ()):
        start, stop = s
        if stop <= last:
            continue
        if start > last:
            kept.append(data[at:start])
            runs += 1
        removed += stop - max(start, last)
        at = last = stop
    kept.append(data[at:])
    return b"".join(kept), removed, runs


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    own = _with_tid(docs.select(F.col("doc_id").cast("long"), "text"))
    spans = repeated_spans(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, at in zip(b.column(1), b.column(2), strict=True):
                data = text.as_buffer().to_pybytes()
                left, removed, runs = cut(data, at.as_py())
                rows.append((len(data), removed, runs, hashlib.sha256(left).hexdigest()))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 3 + (pa.string(),), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return own.join(spans, "tid", "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def clean(docs: DataFrame) -> DataFrame:
    """docs with each text reduced to what is kept. A character that a cut splits is dropped with its rest; null stays null."""
    own = docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("tid", F.xxhash64("text"))
    spans = repeated_spans(own.select("tid", "doc_id", "text"))
    kept = own.join(spans, "tid", "left").select("__row", "text", "spans")

    @F.pandas_udf("string")
    def left(text, spans):  # noqa: ANN001
        return text.combine(spans, lambda t, s: t if s is None else cut(t.encode(), [dict(x.asDict() if hasattr(x, "asDict") else x) for x in s])[0].decode("utf-8", "ignore"))

    out = kept.withColumn("__kept", F.when(F.col("spans").isNull(), F.col("text")).otherwise(left("text", "spans")))
    return out.select(*(F.when(F.col("__row.text").isNotNull(), F.col("__kept")).alias("text") if c == "text" else F.col(f"__row.{c}") for c in docs.columns))
