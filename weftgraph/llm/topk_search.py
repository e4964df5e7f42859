"""Exact top-k by inner product, over vectors in the order of their lengths.

Vectors are turned by the eigenvectors of the corpus's second moments (the right
singular vectors of the corpus), so that the first coordinates hold most of every
product. A task takes its vectors in descending length. For a query q and a vector v,
|q||v| bounds the product (Cauchy-Schwarz): once it falls below the query's k-th best
score, all later vectors are out. The others get a partial product over the first
turned coordinates plus the product of the residual lengths, and those whose bound
reaches the k-th best get their exact integer product. The corpus is dealt to tasks by
ranges of the length, so whole tasks of short vectors end after their first bound.
Each block of queries is one scan, whose few rows a query are written before the next.

The k-th best scores start from the longest vectors of the whole corpus, so every
task prunes from its first block on. Queries go to the tasks in blocks of a bounded
size; each task returns at most k rows a query, and a window of those rows, equal in
number for each query, gives the result.

Defined cases: vectors that are null, empty, or hold a null or non-finite component
take no part, nor do rows without an id; a query meets only vectors of its own
dimension; a query's own row is that with its id, so copies under other ids are
candidates and repeated ids are not; ties go to the smaller id; products are exact as
long as they fit in a long. Tables of fewer than k candidates give all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bound_batches

K = 5
EVERY = 50
SCALE = 256
#: Bytes of the queries of a block: the bound of what is broadcast, and of what the driver holds.
BLOCK_BYTES = 32 << 20
#: Bytes of the tasks' matrices of second moments that are added up in one task, two at least.
ADDED_BYTES = 32 << 20
#: Longest vectors from which the first k-th best scores come.
SEED_VECTORS = 1024
#: Vectors of a task that are scored at once.
BLOCK_VECTORS = 2048
#: Partial products cover the first coordinates, up to this share of the sum of squares.
HEAD_ENERGY = 0.8


def scaled(vector: Column) -> Column:
    """floor(256 x) of every component, null if any component is null or not finite."""
    doubles = vector.cast("array<double>")
    good = (F.size(vector) > 0) & F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(good, F.transform(doubles, lambda x: F.floor(x * SCALE)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def second_moments(vectors: DataFrame, dimension: int) -> np.ndarray:
    """Sum of the outer products of all vectors. Each task sends one matrix; those of a number of tasks, as many as ADDED_BYTES hold, are added up in a task, and these few sums by the driver, one at a time."""
    together = max(2, ADDED_BYTES // (8 * dimension * dimension))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((dimension, dimension))
        for batch in batches:
            x = _matrix(batch.column(0)).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() // together], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["some", "m"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(dimension * dimension)
        for x in table.column("m"):
            total += np.frombuffer(x.as_buffer(), np.float64)
        return pa.table({"some": table.column("some")[:1], "m": pa.array([total.tobytes()], pa.binary())})

    schema = "some int, m binary"
    out = np.zeros(dimension * dimension)
    for r in vectors.select("v").mapInArrow(add, schema).groupBy("some").applyInArrow(merge, schema).toLocalIterator():
        out += np.frombuffer(r.m, np.float64)
    return out.reshape(dimension, dimension)


def rotation(moments: np.ndarray) -> tuple[np.ndarray, int]:
    """Eigenvectors by descending eigenvalue, and how many hold HEAD_ENERGY of the sum."""
    values, vectors = np.linalg.eigh(moments)
    values, vectors = values[::-1], vectors[:, ::-1]
    share = np.cumsum(np.maximum(values, 0)) / max(values.sum(), 1e-300)
    return np.ascontiguousarray(vectors), int(min(len(values), np.searchsorted(share, HEAD_ENERGY) + 1))


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), np.iinfo(np.int64).min)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def floor(self) -> np.ndarray:
        """Each query's k-th best score; the least long while it has fewer."""
        return self.score[:, -1]

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Pairs of queries and vectors, in any order."""
        if not len(query):
            return
        touched = np.unique(query)
        q = np.concatenate([np.repeat(touched, self.k), query])
        s = np.concatenate([self.score[touched].ravel(), score])
        i = np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((i, -1 - s, q))  # -1 - s is s in reverse, without overflow
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, touched)
        at = first[:, None] + np.arange(self.k)
        self.score[touched], self.id[touched] = s[at], i[at]


def dot(a: np.ndarray, b: np.ndarray, exact_in_double: bool) -> np.ndarray:
    """Row by row, as longs."""
    if exact_in_double:
        return np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64)).astype(np.int64)
    return np.einsum("ij,ij->i", a, b)


def scan(best: Best, floor: np.ndarray, q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, turn: np.ndarray, head: int) -> None:
    """Adds the vectors, in descending order of length, to the queries' best. floor: scores that a k-th best has at least."""
    qf, vf = q.astype(np.float64), v.astype(np.float64)
    q_length, v_length = np.linalg.norm(qf, axis=1), np.linalg.norm(vf, axis=1)
    order = np.lexsort((ids, -v_length))
    ids, v, vf, v_length = ids[order], v[order], vf[order], v_length[order]
    exact = bool(q_length.max(initial=0) * v_length.max(initial=0) < 2**52)
    q_turned = qf @ turn
    q_head = q_turned[:, :head]
    q_rest = np.linalg.norm(q_turned[:, head:], axis=1)
    alive = np.arange(len(q))
    for i in range(0, len(v), BLOCK_VECTORS):
        low = np.maximum(best.floor(), floor)
        # a small allowance for rounding; a tie may still win by its id
        alive = alive[q_length[alive] * v_length[i] * (1 + 1e-9) + 1e-6 >= low[alive]]
        if not len(alive):
            break
        block, turned = slice(i, i + BLOCK_VECTORS), vf[i : i + BLOCK_VECTORS] @ turn
        v_rest = np.linalg.norm(turned[:, head:], axis=1)
        for a in range(0, len(alive), 512):
            some = alive[a : a + 512]
            bound = q_head[some] @ turned[:, :head].T + q_rest[some, None] * v_rest
            slack = 1e-9 * q_length[some, None] * v_length[block] + 1e-6
            q_at, v_at = np.nonzero(bound + slack >= low[some, None])
            q_at, v_at = some[q_at], v_at + i
            other = q_ids[q_at] != ids[v_at]
            q_at, v_at = q_at[other], v_at[other]
            for c in range(0, len(q_at), 1 << 15):
                x, y = q_at[c : c + (1 << 15)], v_at[c : c + (1 << 15)]
                score = dot(q[x], v[y], exact)
                now = np.maximum(best.floor(), floor)
                good = score >= now[x]
                best.add(x[good], score[good], ids[y[good]])


def search(queries: DataFrame, vectors: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query's k largest inner products."""
    spark = vectors.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "topk")
    ready = lambda df: df.select(F.col(f"`{id_col}`").cast("long").alias("id"), scaled(F.col(f"`{vector_col}`")).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    corpus = scratch.keep(ready(vectors).withColumn("squared", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).repartitionByRange(F.desc("squared"), "id"), "corpus")
    asked = scratch.keep(ready(queries), "queries")
    told_of = []
    for dimension in sorted(r.d for r in asked.select(F.size("v").alias("d")).distinct().collect()):  # usually one
        mine = corpus.where(F.size("v") == dimension)
        turn, head = rotation(second_moments(mine, dimension))
        seeds = mine.orderBy(F.desc("squared"), "id").limit(SEED_VECTORS).select("id", "v").toArrow()  # a bounded number
        some = asked.where(F.size("v") == dimension)
        blocks = max(1, -(-some.count() * 8 * dimension // BLOCK_BYTES))
        for b in range(blocks):
            part = some.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
            if not part.num_rows:
                continue
            q_ids, q = part.column("id").to_numpy(), _matrix(part.column("v").combine_chunks()).astype(np.int64)
            best = Best(len(q), k)
            none = np.full(len(q), np.iinfo(np.int64).min)
            if seeds.num_rows:
                scan(best, none, q_ids, q, seeds.column("id").to_numpy(), _matrix(seeds.column("v").combine_chunks()).astype(np.int64), turn, head)
            told = spark.sparkContext.broadcast((q_ids, q, best.floor(), turn, head))
            one = mine.select("id", "v").mapInArrow(_scanner(told, k), "query_id long, vec_id long, score long")
            told_of.append(f"found-{dimension}-{b}")
            scratch.keep(one, told_of[-1])
            told.destroy()
    if not told_of:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = spark.read.schema("query_id long, vec_id long, score long").parquet(*[scratch.path(name) for name in told_of])
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scanner(told, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q, floor, turn, head = told.value
        best = Best(len(q), k)
        held, n = [], 0

        def settle() -> None:
            ids = np.concatenate([b.column(0).to_numpy() for b in held])
            scan(best, floor, q_ids, q, ids, np.concatenate([_matrix(b.column(1)) for b in held]).astype(np.int64), turn, head)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 8 * BLOCK_VECTORS:
                settle()
                held, n = [], 0
        if n:
            settle()
        real = best.id != np.iinfo(np.int64).max
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, k)[real.ravel()]), pa.array(best.id[real]), pa.array(best.score[real])], names=["query_id", "vec_id", "score"])

    return run


def run(vectors: DataFrame) -> DataFrame:
    """The contract's columns: queries are the rows whose vec_id is divisible by EVERY."""
    return search(vectors.where(F.col("vec_id") % EVERY == 0), vectors)
