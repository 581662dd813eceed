"""Approximate nearest neighbours by cross-polytope hashing.

A fast pseudo-rotation (three rounds of random signs and a Hadamard transform) takes a unit vector to the nearest
signed axis; ``parts`` such axes are the bucket of one table. Queries probe several buckets of each table, best
first. How many axes and probes it takes is measured: for a bounded sample of the queries the true neighbours are
found by comparing with all vectors, and the cheapest setting whose tables collect TARGET of them is used (in the
last resort all buckets, which is exact). The candidates are ranked by the exact inner product of the original vectors.

Vectors are hashed by direction, whatever their norms; a setting that misses long vectors in other directions fails
the measurement. Equal vectors are hashed once, with the few smallest ids that a result can need. The vectors lie in
shards by their hash, once each, and every shard has tables of its own, so no bucket is gathered anywhere however
hot; each query visits every shard. The shards' number does not change what is found. Queries that the tables leave
short of neighbours are compared with all vectors of the shards.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor does a
null vec_id; vectors of different lengths are not compared; of rows that share vec_id and vector one counts, and a
query's own id is no candidate; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import materialize, shuffle_partitions

TABLES, SHARD_ROWS, SHARD_BYTES = 8, 16384, 1 << 26
"""Tables; vectors of a shard, while there are fewer shards than shuffle partitions; bytes of a shard at most."""
TARGET, SAMPLE_QUERIES, SAMPLE_VECTORS, SAMPLED_LENGTHS = 0.95, 100, 2000, 8
"""Share of the true neighbours to collect; queries and vectors that it is measured on, for each of the commonest
vector lengths (others are compared with all vectors)."""
PARTS = {1: 4096, 2: 1024, 3: 1024}
"""Axes of a bucket that are tried, with the most probes of each."""
BLOCK = 128
Setting = tuple[int, int]
"""(parts, probes)"""


def signs(dims: int, table: int, part: int) -> np.ndarray:
    return np.random.default_rng([dims, table, part]).choice(np.array([-1.0, 1.0], np.float32), (3, dims))


def rotate(x: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """Pseudo-rotation of rows whose length is a power of two."""
    n = x.shape[1]
    for row in flips:
        x = x * row
        h = 1
        while h < n:
            y = x.reshape(len(x), n // (2 * h), 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
            h *= 2
    return x / np.float32(n**1.5)


def probes(x: np.ndarray, table: int, parts: int, count: int, ordered: bool = True) -> np.ndarray:
    """The ``count`` best buckets of each row in one table (fewer if there are fewer), nearest first (or in any order)."""
    dims = 1 << max(0, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), dims), np.float32)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares of tiny or huge components stay numbers
    padded[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
    codes, costs = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1), np.float32)
    for part in range(parts):
        y = rotate(padded, signs(dims, table, part))
        both = np.concatenate([y, -y], 1)
        order = np.argsort(-both, axis=1, kind="stable")[:, :count] if count > 1 else both.argmax(1)[:, None]
        value = np.take_along_axis(both, order, 1)
        cost = (value[:, :1] - value) ** 2
        # Both ascend: the pair (i, j) has (i + 1) * (j + 1) - 1 others before it and counts only if those are fewer.
        i, j = np.indices((codes.shape[1], order.shape[1])).reshape(2, -1)
        able = (i + 1) * (j + 1) <= count
        i, j = i[able], j[able]
        codes, costs = codes[:, i] * (2 * dims) + order[:, j], costs[:, i] + cost[:, j]
        if ordered or part < parts - 1:
            best = np.argsort(costs, axis=1, kind="stable")[:, :count]
        else:
            best = np.argpartition(costs, min(count, costs.shape[1]) - 1, axis=1)[:, :count]
        codes, costs = np.take_along_axis(codes, best, 1), np.take_along_axis(costs, best, 1)
    return codes


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1).astype(np.float64)


def usable(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id, v (array of float or double), dims: the vectors that take part."""
    v = F.col(vector)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = v.isNotNull() & F.col(id_column).isNotNull() & ~F.coalesce(F.exists(v, bad), F.lit(True)) & F.exists(v, lambda x: x != 0)
    return rows.where(good).select(F.col(id_column).cast("long").alias("id"), v.alias("v")).withColumn("dims", F.size("v"))


class Index:
    """The vectors of one length in a shard: their tables, and the search in them."""

    def __init__(self, v: np.ndarray, ids: list[list[int]], setting: Setting | None):
        self.v, self.setting = v, setting
        self.reps = np.array([len(i) for i in ids], np.int64)
        self.starts = np.cumsum(self.reps) - self.reps
        self.ids = np.array([x for i in ids for x in i], np.int64)
        if setting:
            parts = setting[0]
            self.tables = [np.unique(np.concatenate([probes(v[at : at + 4096], t, parts, 1)[:, 0] for at in range(0, len(v), 4096)]), return_inverse=True) for t in range(TABLES)]

    def candidates(self, q: np.ndarray) -> np.ndarray:
        """Which vectors (columns) the tables collect for each query (rows)."""
        out = np.zeros((len(q), len(self.v)), bool)
        if not self.setting:
            return ~out
        parts, count = self.setting
        for t, (buckets, bucket_of) in enumerate(self.tables):
            wanted = probes(q, t, parts, count, ordered=False)
            place = np.minimum(np.searchsorted(buckets, wanted), len(buckets) - 1)
            open_ = np.zeros((len(q), len(buckets)), bool)
            row, probe = np.nonzero(buckets[place] == wanted)
            open_[row, place[row, probe]] = True
            out |= open_[:, bucket_of]
        return out

    def search(self, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, vector id, score) of the best k candidates of each query; ties to the smaller id."""
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for at in range(0, len(q), BLOCK):
            near = self.candidates(q[at : at + BLOCK])
            for r in range(len(near)):
                c = np.nonzero(near[r])[0]
                if not len(c):
                    continue
                # The same order of summation for each pair, so that equal vectors get equal scores wherever they are.
                s = np.einsum("ij,j->i", self.v[c], q[at + r], optimize=False)
                margin = min(len(s), k + 1)
                best = s >= np.partition(s, len(s) - margin)[len(s) - margin]
                c, s = c[best], s[best]
                n = self.reps[c]
                ids = self.ids[np.repeat(self.starts[c] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                s = np.repeat(s, n)[ids != own[at + r]]
                ids = ids[ids != own[at + r]]
                order = np.lexsort((ids, -s))[:k]
                found.append((np.full(len(order), own[at + r]), ids[order], s[order]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


FOUND = "query_id long, vec_id long, score double"


def _found(query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(shard, kind, rows) of each run of a batch."""
    for b in batches:
        shard, kind = np.asarray(b.column(0)), np.asarray(b.column(1))
        cut = np.nonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1]))[0] + 1
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(shard)], strict=True):
            if j > i:
                yield int(shard[i]), int(kind[i]), b.slice(i, j - i)


def _scan(own: DataFrame, distinct: DataFrame, k: int, settings: dict[int, Setting | None]) -> DataFrame:
    """FOUND of every query in every shard. A task reads its shard's vectors, then the queries as a stream."""
    spark, count = own.sparkSession, distinct.count()
    width = distinct.agg(F.max("dims")).first()[0]
    shards = max(1, -(-count * width * 8 // SHARD_BYTES), min(shuffle_partitions(spark), -(-count // SHARD_ROWS)))
    stored = distinct.select(F.pmod(F.xxhash64("ids"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), "ids", "v", "dims")
    asked = own.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", F.lit(None).cast("array<long>").alias("ids"), "v", "dims")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index, now = [], {}, None
        for shard, kind, rows in _runs(batches):
            if shard != now:
                held, index, now = [], {}, shard
            if kind == 0:
                held.append(rows)
                continue
            if held:
                t = pa.Table.from_batches(held)
                dims = t["dims"].to_numpy()
                for d in np.unique(dims).tolist():
                    part = t.take(pa.array(np.nonzero(dims == d)[0]))
                    index[d] = Index(matrix(part["v"]), part["ids"].to_pylist(), settings.get(d))
                held = []
            dims = np.asarray(rows.column(5))
            for d in np.unique(dims).tolist():
                if d in index:
                    part = rows.take(pa.array(np.nonzero(dims == d)[0]))
                    yield _found(*index[d].search(matrix(part.column(4)), np.asarray(part.column(2)), k))

    dealt = stored.unionByName(asked).repartitionById(shards, "shard").sortWithinPartitions("shard", "kind")
    return dealt.mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _sampled(rows: DataFrame, count: int, key: str) -> list:
    return rows.orderBy(F.xxhash64(key), key).limit(count).collect()


def tune(own: DataFrame, distinct: DataFrame, k: int, target: float = TARGET) -> dict[int, Setting | None]:
    """The cheapest setting for each vector length; None where all vectors are to be compared."""
    lengths = own.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").limit(SAMPLED_LENGTHS).collect()
    out: dict[int, Setting | None] = {}
    for d in (r["dims"] for r in lengths):
        vectors = distinct.where(F.col("dims") == d)
        asked = _sampled(own.where(F.col("dims") == d).select("id", "v"), SAMPLE_QUERIES, "id")
        q, own_ids = np.array([r["v"] for r in asked], np.float64), np.array([r["id"] for r in asked])

        def truth(batches: Iterator[pa.RecordBatch], q: np.ndarray = q, own_ids: np.ndarray = own_ids) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, len(b), 8192):
                    part = b.slice(at, 8192)
                    yield _found(*Index(matrix(part.column(1)), [i[:1] for i in part.column(0).to_pylist()], None).search(q, own_ids, k))

        # The sampled queries go to where the vectors lie; of equal vectors one counts.
        nearest = _best(vectors.select("ids", "v").mapInArrow(truth, FOUND), k).select("query_id", "vec_id").collect()
        wanted = own.sparkSession.createDataFrame([(i,) for i in {r["vec_id"] for r in nearest}], "__id long")
        there = {r["__id"]: r["v"] for r in vectors.join(F.broadcast(wanted), F.col("ids")[0] == F.col("__id")).select("__id", "v").collect()}
        row = {i: k for k, i in enumerate(own_ids.tolist())}
        pairs = [(row[r["query_id"]], there[r["vec_id"]]) for r in nearest]
        others = np.array([r["v"] for r in _sampled(vectors.select("ids", "v"), SAMPLE_VECTORS, "ids")], np.float64)
        out[d] = cheapest(q, np.array([i for i, _ in pairs], np.int64), np.array([v for _, v in pairs], np.float64), others, target) if pairs else None
    return out


def cheapest(q: np.ndarray, which: np.ndarray, near: np.ndarray, others: np.ndarray, target: float) -> Setting | None:
    """Of all settings by which the query q[which[i]] collects the share ``target`` of the neighbours near[i], the one
    that collects the fewest of the others, counting 1/64 of a comparison for each probe of a shard."""
    best: tuple[float, Setting | None] = (1.0, None)
    for parts, most in PARTS.items():
        first = np.full(len(near), most)  # the probe that meets each neighbour, over all tables
        meets = np.full((len(q), len(others)), most)
        for t in range(TABLES):
            order = probes(q, t, parts, most)
            own, theirs = probes(near, t, parts, 1)[:, 0], probes(others, t, parts, 1)[:, 0]
            for r in range(len(q)):
                by = np.argsort(order[r])
                asked = np.concatenate([np.nonzero(which == r)[0], np.arange(len(others)) + len(near)])
                code = np.concatenate([own, theirs])[asked]
                place = by[np.minimum(np.searchsorted(order[r], code, sorter=by), len(by) - 1)]
                rank = np.where(order[r][place] == code, place, most)
                n = len(asked) - len(others)
                first[asked[:n]] = np.minimum(first[asked[:n]], rank[:n])
                meets[r] = np.minimum(meets[r], rank[n:])
        count = int(np.sort(first)[max(0, int(np.ceil(target * len(first))) - 1)]) + 1
        if count <= most:
            cost = float((meets < count).mean()) + TABLES * count / 64 / SHARD_ROWS
            if cost < best[0]:
                best = (cost, (parts, count))
    return best[1]


def search(queries: DataFrame, rows: DataFrame, k: int = 20, id_column: str = "vec_id", vector: str = "embedding", setting: Setting | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: of each query the k nearest rows found (all others, if fewer). ``setting`` takes
    the place of the measured one."""
    own = usable(queries, id_column, vector).dropDuplicates(["id", "v"])
    all_ = usable(rows, id_column, vector)
    first = Window.partitionBy("v").orderBy("id")
    few = all_.dropDuplicates(["id", "v"]).withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= k + 1)
    distinct = materialize(few.groupBy("v", "dims").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    own = materialize(own, "queries")
    if own.isEmpty() or distinct.isEmpty():
        return own.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    settings = tune(own, distinct, k) if setting is None else {r["dims"]: setting for r in distinct.select("dims").distinct().limit(SAMPLED_LENGTHS).collect()}
    out = materialize(_best(_scan(own, distinct, k, settings), k), "neighbours")
    # Queries left short though there are more vectors of their length.
    counts = out.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("__n"))
    there = distinct.groupBy("dims").agg(F.sum(F.size("ids")).alias("__all"))
    short = own.join(counts, "id", "left").join(there, "dims").where(F.coalesce("__n", F.lit(0)) < F.least(F.lit(k), F.col("__all") - 1))
    short = materialize(short.select("id", "v", "dims"), "short")
    if short.isEmpty():
        return out
    return out.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(_best(_scan(short, distinct, k, {}), k))
