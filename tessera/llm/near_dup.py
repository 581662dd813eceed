"""MinHash near-duplicates by a multi-index Hamming join.

A set of word shingles gets a signature of SYMBOLS min-hashes. Two sets of similarity s differ in a binomial
number of symbols; the threshold ERRORS is chosen so that a pair at the least similarity exceeds it with a
chance under 1e-7. Signatures are split into CHUNKS pieces; by pigeonhole, two signatures within ERRORS agree
in one piece but for at most ERRORS // CHUNKS symbols, and the pieces with that many symbols left out are the
keys of the index. Every pair within the threshold therefore meets under a key.

Equal sets (by 128-bit hashes) are one node, named by its smallest doc_id. Under a key no pairs are emitted but a
spanning forest of the pairs within ERRORS whose sizes allow the similarity; the forests' components (candidate
groups) bring the whole texts together, and links are confirmed on full sets. Keys and groups beyond a unit are dealt
to tasks (see ``groups``), so that none is gathered.

Defined results: A-Z are lower-cased, words are [^\\x20\\x09-\\x0D]+; a text with fewer words than a shingle is
one shingle; null, empty and wordless text has none and is linked with nothing; a null doc_id is linked with
nothing (null component, kept); repeated rows are copies; different texts under one doc_id are one node where that id
is the smallest of their sets; extra columns are ignored. ``keep_one`` keeps one row of each component and wordless
rows all, whatever their ids.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import groups
from tessera.llm.common import WS, discard, emptied, materialize, shuffle_partitions
from tessera.llm.components import connected_components
from tessera.llm.shingles import forget, mix, shingle_set

SYMBOLS, ERRORS, CHUNKS = 64, 27, 14
"""At a similarity of 0.85, 64 symbols differ in 9.6 on average (deviation 2.9): more than 27 has a chance of 3.5e-8."""
ROUND_KEYS = 8
"""Repeated keys a node that are dealt out in a round."""
_FACTORS = np.random.default_rng(64).integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def parameters(percent: int) -> tuple[int, int, int]:
    """Symbols, errors and chunks for a least similarity of ``percent``: six deviations above the mean distance."""
    if percent == 85:
        return SYMBOLS, ERRORS, CHUNKS
    p = 1 - percent / 100
    errors = min(SYMBOLS, int(np.ceil(SYMBOLS * p + 6 * np.sqrt(SYMBOLS * p * (1 - p)))))
    return SYMBOLS, errors, errors // 2 + 1


def signature(s: np.ndarray) -> np.ndarray:
    """Min-hashes of a non-empty set, 16 bits of each."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 512):
        np.minimum(low, (s[k : k + 512, None] * _FACTORS).min(0), out=low)
    return (mix(low) >> np.uint64(48)).astype(np.uint16)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, tid (the text's hash), n_shingles, skey (16 bytes that stand for the set) and sig of each row; the last
    two are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keys, sigs = [], [], []
            for t in b.column(2):
                s = shingle_set(t.as_py())
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "tid", "n_shingles", "skey", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tid"), "text").mapInArrow(lambda batches: emptied(run(batches), forget), "doc_id long, tid long, n_shingles long, skey binary, sig binary")


def index_keys(sig: np.ndarray, errors: int, chunks: int) -> np.ndarray:
    """All keys of each signature (rows): chunks with errors // chunks symbols left out."""
    edges = np.linspace(0, sig.shape[1], chunks + 1).round().astype(int)
    wide, out = sig.astype(np.uint64) + np.uint64(1), []
    for c in range(chunks):
        places = range(edges[c], edges[c + 1])
        for gone in itertools.combinations(places, min(errors // chunks, len(places) - 1)):
            total = np.full(len(sig), hash((c, gone)) & 0xFFFFFFFF, np.uint64)
            for x in places:
                if x not in gone:
                    total = mix(total * np.uint64(0x9E3779B97F4A7C15) + wide[:, x])
            out.append(total)
    return np.stack(out, 1).view(np.int64)


def _keys(nodes: DataFrame, errors: int, chunks: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 4096):
                part = b.slice(at, 4096)
                if len(part):
                    sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(len(part), -1)
                    keys = index_keys(sig, errors, chunks)
                    ids = np.repeat(np.asarray(part.column(0)), keys.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["key", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key long, node long")


def alike(sig: np.ndarray, n: np.ndarray, s: np.ndarray, m: np.ndarray, errors: int, percent: int) -> np.ndarray:
    """Whether signatures are within ``errors`` and the sets' sizes n and m allow a similarity of ``percent``."""
    return ((sig != s).sum(-1) <= errors) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def forest(sig: np.ndarray, n: np.ndarray, errors: int, percent: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the rows that are ``alike``."""
    left, edges = np.arange(len(sig)), []
    while len(left) > 1:
        ready, left = [left[0]], left[1:]
        while ready and len(left):
            f = ready.pop()
            near = alike(sig[left], n[left], sig[f], n[f], errors, percent)
            found = left[near]
            if len(found):
                edges += [(int(f), int(x)) for x in found]
                ready += found.tolist()
                left = left[~near]
    return edges


def _repeated(keys: DataFrame) -> DataFrame:
    """The rows (key, node) whose key another row has: a scan in the keys' order that holds one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None  # the last key, and its row as long as it stands alone
        for b in batches:
            if not len(b):
                continue
            key = np.asarray(b.column(0))
            same = key[1:] == key[:-1]
            twice = np.concatenate([[last is not None and key[0] == last], same])
            if held is not None and twice[0]:
                yield held
            twice[:-1] |= same
            held = None if twice[-1] else b.slice(len(b) - 1)
            last = key[-1]
            if twice.any():
                yield b.take(pa.array(np.nonzero(twice)[0]))

    dealt = keys.repartition(shuffle_partitions(keys.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "key long, node long")


def candidate_groups(nodes: DataFrame, errors: int, chunks: int, percent: int) -> DataFrame:
    """node, component of the nodes (node, sig, n) that have another one alike."""
    spark = nodes.sparkSession
    met = materialize(_repeated(_keys(nodes, errors, chunks)), "keys")
    hot = materialize(met.groupBy("key").agg(F.count("*").alias("__n")).where(F.col("__n") > groups.UNIT).select("key"), "hot-keys")
    signed = lambda df: df.join(nodes.select("node", "sig", "n"), "node")
    rows = met if hot.isEmpty() else met.join(hot, "key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        carry = None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                if not len(b):
                    continue
                b = pa.Table.from_batches([b])
                carry = b if carry is None else pa.concat_tables([carry, b])
            if carry is None:
                continue
            carry = carry.combine_chunks()
            key = carry["key"].to_numpy()
            change = np.nonzero(key[1:] != key[:-1])[0] + 1
            whole = len(key) if b is None else (int(change[-1]) if len(change) else 0)
            if not whole:
                continue
            bounds = np.concatenate([[0], change[change < whole], [whole]])
            node, n = carry["node"].to_numpy()[:whole], carry["n"].to_numpy()[:whole]
            sig = np.frombuffer(b"".join(carry["sig"].slice(0, whole).to_pylist()), np.uint16).reshape(whole, -1)
            size = np.diff(bounds)
            two = bounds[:-1][size == 2]
            two = two[alike(sig[two], n[two], sig[two + 1], n[two + 1], errors, percent)]
            pairs = set(zip(node[two].tolist(), node[two + 1].tolist(), strict=True))
            for i, j in zip(bounds[:-1][size > 2].tolist(), bounds[1:][size > 2].tolist(), strict=True):
                pairs.update((int(node[i + x]), int(node[i + y])) for x, y in forest(sig[i:j], n[i:j], errors, percent))
            new = {(min(p), max(p)) for p in pairs} - seen
            if new:
                a, c = zip(*new, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])
            seen = new if len(seen) > 500_000 else seen | new
            carry = carry.slice(whole)

    def alike_of(some: DataFrame) -> DataFrame:
        dealt = signed(some).select("key", "node", "sig", "n").repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key")
        return dealt.mapInArrow(run, "a long, b long")

    # A signature goes along with each of its keys; where most keys repeat, a round takes some of the keys and its shuffle
    # files go before the next one.
    rounds = -(-met.count() // (ROUND_KEYS * max(nodes.count(), 1)))
    if rounds < 2:
        edges = alike_of(rows)
    else:
        parts = [materialize(alike_of(rows.where(F.pmod("key", F.lit(rounds)) == r)), "alike") for r in range(rounds)]
        edges = functools.reduce(DataFrame.unionByName, parts)
    if not hot.isEmpty():

        def of_unit(t: pa.Table) -> list[tuple]:
            node, n = t["node"].to_numpy(), t["n"].to_numpy()
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(len(t), -1)
            return [(int(node[x]), int(node[y])) for x, y in forest(sig, n, errors, percent)]

        many = signed(met.join(hot, "key", "left_semi")).select(F.col("key").alias("group"), "node", F.lit(200).alias("weight"), "sig", "n")
        edges = edges.unionByName(groups.linked(materialize(many, "hot-key-rows"), of_unit))
    out = connected_components(edges)
    discard(met, hot)
    return out


def _partners(n: np.ndarray, shared: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes n can reach ``percent`` with a set of any of the (sorted) sizes, if only ``shared`` of their
    elements are elsewhere. The similarity rises with the partner's size up to ``shared`` and falls from there."""
    out = np.zeros(len(n), bool)
    for at in (np.searchsorted(sizes, shared, "right") - 1, np.searchsorted(sizes, shared)):
        m = sizes[np.clip(at, 0, len(sizes) - 1)]
        both = np.minimum(shared, m)
        out |= (at >= 0) & (at < len(sizes)) & (100 * both >= percent * (n + m - both))
    return out


def links(sets: list[np.ndarray], percent: int, known: list | None = None, asked: list[bool] | None = None) -> list[tuple[int, int]]:
    """Pairs that join the components in which 100 * intersection >= percent * union. Sets of one known class are not
    compared, nor are two of which none is ``asked`` (all are, if it is None).

    Sets that share too little with all others go first. The rest meet by an inverted index over the shingles that a
    partner must share (the rarest n - ceil(percent * n / 100) + 1 of a set)."""
    n, first = len(sets), {}
    label = np.array([i if c is None else first.setdefault(c, i) for i, c in enumerate(known or [None] * n)])
    asks = np.ones(n, bool) if asked is None else np.array(asked, bool)
    sizes = np.array([len(s) for s in sets])
    unique, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner, live = np.repeat(np.arange(n), sizes), np.ones(n, bool)
    while True:
        df = np.bincount(ids, minlength=len(unique))
        useful = np.where(asks[owner], df[ids] > 1, np.bincount(ids[asks[owner]], minlength=len(unique))[ids] > 0)
        shared = np.bincount(owner[useful], minlength=n)
        still = live & _partners(sizes, shared, np.sort(sizes[live]), percent)
        few = 16 * (live.sum() - still.sum()) <= live.sum()  # not worth another look
        live, keep = still, still[owner]
        ids, owner = ids[keep], owner[keep]
        if few or not live.any():
            break
    found: list[tuple[int, int]] = []
    rank = np.empty(len(unique), np.int64)
    rank[np.argsort(np.bincount(ids, minlength=len(unique)), kind="stable")] = np.arange(len(unique))
    ids = rank[ids]
    ids = ids[np.lexsort((ids, owner))]
    ends = np.cumsum(np.where(live, sizes, 0))
    starts = ends - np.where(live, sizes, 0)
    rare = np.arange(len(ids)) - starts[owner] < (sizes - -(-percent * sizes // 100) + 1)[owner]
    post = owner[rare][np.argsort(ids[rare], kind="stable")]
    at = np.concatenate([[0], np.cumsum(np.bincount(ids[rare], minlength=len(unique)))])
    own, met = np.zeros(len(unique), bool), np.zeros(n, bool)
    for i in np.nonzero(live & asks)[0].tolist():
        mine = ids[starts[i] : ends[i]]
        places = mine[rare[starts[i] : ends[i]]]
        met[:] = False
        for k, m in zip(at[places].tolist(), at[places + 1].tolist(), strict=True):
            if m - k > 1:
                met[post[k:m]] = True
        met &= (label != label[i]) & ~(asks & (np.arange(n) < i))
        met &= 100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])
        others = np.nonzero(met)[0]
        own[mine] = True
        for some in np.split(others, range(256, len(others), 256)):
            if not len(some):
                continue
            both = np.add.reduceat(own[np.concatenate([ids[starts[j] : ends[j]] for j in some.tolist()])], np.cumsum(sizes[some]) - sizes[some], dtype=np.int64)
            for j in some[100 * both >= percent * (sizes[i] + sizes[some] - both)].tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    found.append((i, j))
        own[mine] = False
    return found


def confirmed(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between nodes whose full sets reach the similarity. nodes: node, skey."""
    grouped = candidates.join(nodes.select("node", "skey"), "node").select(F.col("component").alias("group"), "node", "skey")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(grouped, "node")

    def of_unit(t: pa.Table) -> list[tuple]:
        sets, own, known, asked, seen = [], [], [], [], {}
        for node, skey, text, class_, asks in zip(t["node"].to_pylist(), t["skey"].to_pylist(), t["text"], t["class"].to_pylist(), t["asked"].to_pylist(), strict=True):
            if (node, skey) in seen:
                asked[seen[node, skey]] |= asks
                continue
            s = shingle_set(text.as_py())
            # Of rows that share the id with the set's row, another text's is not meant.
            if xxhash.xxh3_128_digest(s.tobytes()) == skey:
                seen[node, skey] = len(sets)
                sets.append(s)
                own.append(node)
                known.append(class_)
                asked.append(asks)
        return [(own[i], own[j]) for i, j in links(sets, percent, known, asked)] if len(sets) > 1 else []

    rows = texts.select("group", "node", F.octet_length("text").alias("weight"), "skey", "text")
    return groups.linked(materialize(rows, "candidate-texts"), of_unit, 2 * groups.UNIT, forget)


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row."""
    return _marked(docs, describe(docs), percent).drop("tid")


def keep_one(docs: DataFrame, percent: int, judged_by: DataFrame | None = None) -> DataFrame:
    """One row of each component of docs, and all rows without words. ``judged_by`` (doc_id, text) has the texts that
    decide; a document whose id it lacks or repeats is judged by its own.

    Rows whose doc_id is null or stands for several texts are told apart by number, a hash below all other ids."""
    text_hash = F.xxhash64("text")
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("__d")).agg(F.count("*").alias("__n"), (F.min(text_hash) != F.max(text_hash)).alias("__several"))
    odd = materialize(ids.where("__n > 1 OR __d IS NULL").select("__d", F.coalesce("__several", F.lit(True)).alias("__several")), "repeated-ids")
    rows = docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("__id"), "text")
    plain = odd.isEmpty()
    if not plain:
        number = F.lit(-(1 << 62)) - F.abs(F.xxhash64("__id", "text") % (1 << 61))
        rows = rows.join(odd, F.col("__id").eqNullSafe(F.col("__d")), "left").withColumn("__id", F.when(F.col("__id").isNull() | F.col("__several"), number).otherwise(F.col("__id")))
    own = rows.select(F.col("__id").alias("doc_id"), "text")
    if judged_by is None:
        marks = _marked(own, describe(own), percent)
    else:
        # Signatures of all texts that may decide are taken where those lie; only they, not the texts, meet the ids.
        theirs = judged_by.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        once = theirs.groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n = 1").select("doc_id")
        ids = own.select("doc_id").distinct().join(once.withColumn("__known", F.lit(True)), "doc_id", "left")
        ids = materialize(ids.select("doc_id", F.coalesce("__known", F.lit(False)).alias("__known")), "judged-ids")
        texts, signatures = theirs, describe(theirs).join(ids.where("__known").hint("merge"), "doc_id", "left_semi")
        unknown = ids.where("NOT __known").select("doc_id")
        if not unknown.isEmpty():
            others = own.join(unknown, "doc_id", "left_semi")
            texts, signatures = texts.unionByName(others), signatures.unionByName(describe(others))
        marks = _marked(texts, signatures, percent)
    stay = materialize(marks.where("kept").select(F.col("doc_id").alias("__stay")).distinct(), "staying")
    kept = rows.join(stay.hint("merge"), F.col("__id") == F.col("__stay"), "left_semi")  # one plan at every size
    if plain:
        return kept.select("__row.*")
    again = F.col("__several").isNotNull() & F.coalesce(F.col("text").rlike(f"[^{WS}]"), F.lit(False))
    return kept.where(~again).unionByName(kept.where(again).dropDuplicates(["__id"])).select("__row.*")


def _marked(docs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """doc_id, tid, n_shingles, component_id, kept of each row of signatures; docs has their texts (and maybe others)."""
    _, errors, chunks = parameters(percent)
    own = materialize(signatures, "signatures")
    sets = own.where("skey IS NOT NULL AND doc_id IS NOT NULL").groupBy("skey").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"))
    nodes = materialize(sets, "sets")
    candidates = candidate_groups(nodes, errors, chunks, percent)
    linked = connected_components(confirmed(docs, nodes, candidates, percent))
    discard(candidates)
    # A node is a doc_id, so a component's smallest node is the smallest doc_id in it.
    of_set = nodes.select("skey", "node").join(linked, "node", "left").select("skey", F.coalesce("component", "node").alias("component_id"))
    out = own.drop("sig").join(of_set, "skey", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "tid", "n_shingles", component.cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared, any_value(a.n) AS n, any_value(b.n) AS m FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT u, v FROM p WHERE 100 * shared >= 85 * (n + m - shared)),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
c AS (SELECT u, min(v) AS component_id FROM r GROUP BY u)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON s.doc_id = c.u
"""
