"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are scaled by the greatest norm and get one more coordinate that makes them unit vectors,
so that the order by inner product becomes the order by angle.  Three rounds of random sign
flips and a fast Hadamard transform rotate them; the hash is the nearest signed axis, its
``2 * dim`` values being the buckets of a table (pairs of such hashes once a table of one would have
very full buckets).  Every row is indexed in all ``TABLES`` tables.  A query probes in each table the
axes nearest to it; the candidates are scored exactly, in double precision, on the original vectors.

How many buckets a query probes is fitted: for at most ``SAMPLE`` queries (those with the least hash)
the true neighbours are found by a scan of all rows, and the least number of probes that finds
``RECALL`` of them is taken.  A query that found too few rows is searched through all buckets.

Vectors stay where they are stored: no row is written again for a table, nor a query for a probe.  The queries are
broadcast, at most ``ASKED_BYTES`` of them at a time, each with the limit of what it probes in each table.  A task takes its
rows in blocks of ``BLOCK_BYTES``, sorts the places of a block by bucket, and multiplies the rows of a bucket (of the first hash of
a pair) with the queries that reach it; what is better than the best ``k`` that the task has found for the query so far is tested
against the limit and scored.  A hot bucket is as many pieces as there are blocks.  A task gives the best ``k`` of each query
as one row, and only these are shuffled.  Of equal vectors of a block only the least ``k + 1`` ids are searched, as the others
come after them for every query.

Nulls and ties: vectors that are null, zero or hold a null or non-finite component take no part,
nor does a row without an id or of another length than most.  An id counts once in a result, with
its best score; equal scores go to the smaller id.  An empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellsign.llm.common import stored
from tellsign.session import estimated_bytes

K = 20
TABLES = 4
ROUNDS = 3
SAMPLE = 64
RECALL = 0.95
BLOCK_BYTES = 1 << 25
ASKED_BYTES = 1 << 26
QUERIES = 1024
PAIRS = 1 << 18
TASK_BYTES = 1 << 27
BUCKET_ROWS = 1000
FOUND = "query_id long, vec_id long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row (the length is a power of two), scaled to keep norms."""
    n, width = x.shape[1], 1
    while width < n:
        halves = x.reshape(len(x), -1, 2, width)
        x = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], axis=2)
        x = x.reshape(len(x), n)
        width *= 2
    return x / np.sqrt(n)


@dataclass
class CrossPolytope:
    length: int  # of the vectors
    norm: float  # greatest norm of the rows
    hashes: int  # hashes that make a bucket: 1 or 2

    @property
    def dim(self) -> int:
        return 1 << self.length.bit_length()

    @property
    def buckets(self) -> int:
        return (2 * self.dim) ** self.hashes

    def unit(self, x: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(x), self.dim))
        if query:
            out[:, :self.length] = x / np.linalg.norm(x, axis=1, keepdims=True)
        else:
            out[:, :self.length] = x / self.norm
            out[:, self.length] = np.sqrt(np.maximum(1 - (out ** 2).sum(axis=1), 0))
        return out

    def axes(self, unit: np.ndarray, table: int, number: int) -> np.ndarray:
        """Nearness of each row to all signed axes of one rotation."""
        rng = np.random.default_rng([table, number, self.dim])
        for _ in range(ROUNDS):
            unit = hadamard(unit * rng.choice([-1.0, 1.0], self.dim))
        return np.concatenate([unit, -unit], axis=1)

    def bucket(self, x: np.ndarray, table: int) -> np.ndarray:
        unit, code = self.unit(x, False), np.zeros(len(x), dtype=np.int64)
        for number in range(self.hashes):
            code = code * 2 * self.dim + self.axes(unit, table, number).argmax(axis=1)
        return code

    def gaps(self, unit: np.ndarray, table: int) -> list[np.ndarray]:
        """How far each query is from each signed axis, for each hash of a table."""
        near = [self.axes(unit, table, number) for number in range(self.hashes)]
        return [(n.max(axis=1, keepdims=True) - n) ** 2 for n in near]

    def distance(self, x: np.ndarray, table: int) -> np.ndarray:
        """For one query, how far each bucket of a table is; the nearest is probed first."""
        out = np.zeros(1)
        for gap in self.gaps(self.unit(x[None, :], True), table):
            out = (out[:, None] + gap[0][None, :]).ravel()
        return out

    def limits(self, x: np.ndarray, probes: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
        """Distance and code of the last bucket that each query probes in each table; equal distances go by code."""
        far, last = np.empty((len(x), tables)), np.empty((len(x), tables), dtype=np.int64)
        for i, t in np.ndindex(far.shape):
            away = self.distance(x[i], t)
            most = min(probes, len(away))
            far[i, t] = limit = np.partition(away, most - 1)[most - 1]
            last[i, t] = np.flatnonzero(away == limit)[most - 1 - np.count_nonzero(away < limit)]
        return far, last


def exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, summed in the order of the components."""
    total = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        total += queries[:, d] * rows[:, d]
    return total


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` best rows of each query within one block, with exact scores."""
    near = queries @ rows.T
    near[query_ids[:, None] == ids[None, :]] = -np.inf
    if near.shape[1] > k:
        kth = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
    else:
        kth = np.full(len(near), -np.inf)
    slack = 1e-9 * (1 + np.abs(near).max(where=np.isfinite(near), initial=0))
    q, r = np.nonzero((near >= np.maximum(kth - slack, -np.finfo(float).max)[:, None]))
    found = pd.DataFrame({"query_id": query_ids[q], "vec_id": ids[r], "score": exact(queries[q], rows[r])})
    found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).drop_duplicates(
        ["query_id", "vec_id"])
    return found.groupby("query_id", sort=False).head(k)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def valid(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the rows that take part (any length)."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        F.col("vec_id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0))


def _scan(rows: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """True neighbours, with their vectors, of a bounded number of queries."""
    shared = rows.sparkSession.sparkContext.broadcast((query_ids, queries))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield best(*shared.value, f["vec_id"].to_numpy(), _matrix(f["embedding"]), k).merge(f, on="vec_id")

    found = rows.mapInPandas(run, f"{FOUND}, embedding array<double>")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).toPandas()


def fit_probes(rows: DataFrame, is_query: str, index: CrossPolytope, k: int, recall: float) -> int:
    """The least number of probes in each table that finds enough of the true neighbours of a sample."""
    sample = rows.where(is_query).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    if sample.empty:
        return 1
    queries = _matrix(sample["embedding"])
    truth = _scan(rows, sample["vec_id"].to_numpy(), queries, k)
    if truth.empty:
        return 1
    at = dict(zip(sample["vec_id"], queries))
    needed = []
    for query, own in truth.groupby("query_id"):
        neighbours = _matrix(own["embedding"])
        ranks = []
        for table in range(TABLES):
            away = index.distance(at[query], table)
            place = np.empty(len(away), dtype=np.int64)
            place[np.argsort(away, kind="stable")] = np.arange(len(away))
            ranks.append(place[index.bucket(neighbours, table)])
        needed.extend(np.min(ranks, axis=0) + 1)
    return int(np.sort(needed)[max(0, int(np.ceil(recall * len(needed))) - 1)])


@dataclass
class Asked:
    """Queries of one broadcast, with what they probe."""
    ids: np.ndarray
    vectors: np.ndarray
    far: np.ndarray
    last: np.ndarray


def _exact_pairs(queries: np.ndarray, q: np.ndarray, rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    step = max(1, (1 << 20) // rows.shape[1])
    parts = [exact(queries[q[i:i + step]], rows[r[i:i + step]]) for i in range(0, len(q), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


class Best:
    """The best ``k`` rows of each query that a task has found so far."""

    def __init__(self, asked: Asked, longest: float, k: int):
        self.asked, self.k = asked, k
        self.ids = np.full((len(asked.ids), k), -1, dtype=np.int64)
        self.scores = np.full((len(asked.ids), k), -np.inf)
        #: what products may be off by
        self.slack = 1e-9 * np.linalg.norm(asked.vectors, axis=1) * longest
        self.bound = np.full(len(asked.ids), -np.inf)

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Pairs of a query (its place) and a row; a pair may come again."""
        some = np.unique(q)
        has, place = np.nonzero(self.scores[some] > -np.inf)
        q = np.concatenate([q, some[has]])
        ids = np.concatenate([ids, self.ids[some[has], place]])
        scores = np.concatenate([scores, self.scores[some[has], place]])
        order = np.lexsort((-scores, ids, q))
        q, ids, scores = q[order], ids[order], scores[order]
        new = np.ones(len(q), dtype=bool)
        new[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
        q, ids, scores = q[new], ids[new], scores[new]
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        heads = np.searchsorted(q, some)
        rank = np.arange(len(q)) - heads[np.searchsorted(some, q)]
        q, ids, scores, rank = (v[rank < self.k] for v in (q, ids, scores, rank))
        self.scores[some] = -np.inf
        self.ids[q, rank], self.scores[q, rank] = ids, scores
        self.bound[some] = self.scores[some, -1] - self.slack[some]

    def packed(self) -> Iterator[pd.DataFrame]:
        n = (self.scores > -np.inf).sum(axis=1)
        for start in range(0, len(n), QUERIES):
            own = [i for i in range(start, min(start + QUERIES, len(n))) if n[i]]
            if own:
                yield pd.DataFrame({"query_id": self.asked.ids[own], "ids": [self.ids[i, :n[i]] for i in own],
                                    "scores": [self.scores[i, :n[i]] for i in own]})


def _blocks(frames: Iterator[pd.DataFrame], length: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of blocks of rows; of equal vectors those of the least ``k + 1`` ids."""
    def block() -> tuple[np.ndarray, np.ndarray]:
        ids, x = np.concatenate([i for i, _ in parts]), np.concatenate([x for _, x in parts])
        same = np.unique(x.view(f"V{x.shape[1] * 8}").ravel(), return_inverse=True)[1].ravel()
        order = np.lexsort((ids, same))
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.diff(same[order]).astype(bool) | np.diff(ids[order]).astype(bool)
        order = order[new]
        heads = np.searchsorted(same[order], same[order])
        kept = np.sort(order[np.arange(len(order)) - heads <= k])
        return ids[kept], x[kept]

    most, parts = max(1, BLOCK_BYTES // (8 * length)), []
    for f in frames:
        for start in range(0, len(f), most):
            piece = f.iloc[start:start + most]
            parts.append((piece["vec_id"].to_numpy(), _matrix(piece["embedding"])))
            if sum(len(i) for i, _ in parts) >= most:
                yield block()
                parts = []
    if parts:
        yield block()


def _meet(best_: Best, ids: np.ndarray, x: np.ndarray, index: CrossPolytope) -> None:
    """Search a block of rows for all queries."""
    asked, width, pairs, held = best_.asked, 2 * index.dim, [], 0

    def flush() -> None:
        nonlocal pairs, held
        if pairs:
            q, r = (np.concatenate(v) for v in zip(*pairs))
            best_.add(q, ids[r], _exact_pairs(asked.vectors, q, x, r))
        pairs, held = [], 0

    tables = []
    for t in range(asked.far.shape[1]):
        code = index.bucket(x, t)
        first = code // width ** (index.hashes - 1)
        order = np.argsort(first, kind="stable")
        buckets, heads = np.unique(first[order], return_index=True)
        tables.append((code, list(zip(buckets, np.split(order, heads[1:])))))
    for start in range(0, len(asked.ids), QUERIES):
        chunk = slice(start, min(start + QUERIES, len(asked.ids)))
        unit = index.unit(asked.vectors[chunk], True)
        for t, (code, buckets) in enumerate(tables):
            gaps, far, last = index.gaps(unit, t), asked.far[chunk, t], asked.last[chunk, t]
            reached = np.ascontiguousarray((gaps[0] <= far[:, None]).T)
            for bucket, rows in buckets:
                own = np.flatnonzero(reached[bucket])
                if not len(own):
                    continue
                near = asked.vectors[start + own] @ x[rows].T
                q, r = np.nonzero(near >= best_.bound[start + own][:, None])
                q, r = own[q], rows[r]
                away = np.zeros(len(q))
                for number, gap in enumerate(gaps):
                    away = away + gap[q, code[r] // width ** (index.hashes - 1 - number) % width]
                probed = (away < far[q]) | ((away == far[q]) & (code[r] <= last[q]))
                probed &= asked.ids[start + q] != ids[r]
                if probed.any():
                    pairs.append((start + q[probed], r[probed]))
                    held += len(pairs[-1][0])
                    if held >= PAIRS:
                        flush()
        flush()


def _asked(queries: DataFrame, index: CrossPolytope, probes: int, tables: int) -> Asked:
    def limited(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                far, last = index.limits(_matrix(f["embedding"]), probes, tables)
                yield f.assign(far=list(far), last=list(last))

    # a few files hold the queries, but their limits are work for all cores
    found = queries.repartition(queries.sparkSession.sparkContext.defaultParallelism).mapInPandas(
        limited, "vec_id long, embedding array<double>, far array<double>, last array<long>").toArrow()
    flat = lambda c, n: found[c].combine_chunks().flatten().to_numpy().reshape(-1, n)
    return Asked(found["vec_id"].to_numpy(), flat("embedding", index.length), flat("far", tables), flat("last", tables))


def _search(rows: DataFrame, queries: DataFrame, index: CrossPolytope, probes: int, tables: int, k: int) -> DataFrame:
    """The best ``k`` rows of each query among those that it probes, stored."""
    groups = max(1, -(-queries.count() * index.length * 8 // ASKED_BYTES))
    context, tops = rows.sparkSession.sparkContext, []
    for group in range(groups):
        shared = context.broadcast(_asked(
            queries.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(groups)) == group), index, probes, tables))

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            best_ = Best(shared.value, index.norm, k)
            for ids, x in _blocks(frames, index.length, k):
                _meet(best_, ids, x, index)
            yield from best_.packed()

        found = rows.mapInPandas(run, "query_id long, ids array<long>, scores array<double>").repartition("query_id")
        pairs = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("pair")).select(
            "query_id", F.col("pair.ids").alias("vec_id"), F.col("pair.scores").alias("score"))
        tops.append(stored(_top(pairs, k), "nearest"))
        shared.destroy()
    if len(tops) == 1:
        return tops[0]
    return stored(_top(reduce(DataFrame.unionByName, tops).drop("rank"), k), "nearest")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: str = "vec_id % 20 = 0", k: int = K, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each query."""
    rows = valid(vectors)
    common_length = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common_length is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("embedding") == common_length["n"])
    cores, size = rows.sparkSession.sparkContext.defaultParallelism, estimated_bytes(rows)
    if size is not None:
        rows = rows.repartition(max(cores, size // TASK_BYTES))  # else a table of few files would be the work of few tasks
    rows = stored(rows, "vectors").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v))
    n, ids, longest = rows.agg(F.count(F.lit(1)), F.count_distinct("vec_id"), F.max(norm)).first()
    hashes = 1 if n <= BUCKET_ROWS * 4 << common_length["n"].bit_length() else 2
    index = CrossPolytope(common_length["n"], longest, hashes)
    probes = fit_probes(rows, is_query, index, k, recall)
    queries = stored(rows.where(is_query).distinct(), "queries")
    top = _search(rows, queries, index, probes, TABLES, k)
    enough = top.groupBy("query_id").count().where(F.col("count") >= min(k, ids - 1))
    short = queries.join(enough, queries["vec_id"] == enough["query_id"], "left_anti")
    if ids < 2 or short.isEmpty():
        return top
    rest = _search(rows, short, CrossPolytope(index.length, longest, 1), 2 * index.dim, 1, k)
    return top.join(rest.select("query_id").distinct(), "query_id", "left_anti").unionByName(rest)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
