"""Embeddings: nearest neighbours of a stated set of queries, and tails of translations.

Queries go to the tasks in blocks of a bounded size, as matrices; a task takes its vectors a batch at a time, multiplies tiles of
both, and keeps the best few of each query. So pairs never become rows, vectors are never shuffled, and what a task returns is bounded by
the block. What a block finds is written before the next one, and its broadcast goes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.sources.scratch import kept

#: Bytes of the queries that are broadcast at once, one query at least.
BLOCK_BYTES = 16 << 20
#: Queries that a task multiplies at once, with at most as many vectors.
TILE = 1024


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """-inf where a vector has no length."""
    lengths = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)
    return np.where(lengths > 0, (q @ v.T) / np.where(lengths > 0, lengths, 1), -np.inf)


def nearness(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The negative of the distance."""
    squares = (q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1) - 2 * (q @ v.T)
    return -np.sqrt(np.maximum(squares, 0))


class Best:
    """The k largest scores of each query, ties to the smaller key."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.query, self.key, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, scores: np.ndarray, keys: np.ndarray, own: np.ndarray) -> None:
        """Scores of all queries with some vectors; a query's own row isn't counted."""
        scores = np.round(scores, 6)
        q, v = np.nonzero((scores >= self.floor[:, None]) & (keys[None, :] != own[:, None]) & (scores > -np.inf))
        query, key, score = np.append(self.query, q), np.append(self.key, keys[v]), np.append(self.score, scores[q, v])
        order = np.lexsort((key, -score, query))
        query, key, score = query[order], key[order], score[order]
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        self.query, self.key, self.score = (x[place < self.k] for x in (query, key, score))
        full = place == self.k - 1
        self.floor[query[full]] = score[full]


def best(queries: DataFrame, vectors: DataFrame, scores: Callable[[np.ndarray, np.ndarray], np.ndarray], top: int) -> DataFrame:
    """q, key, score: of each query (q, own, v), at most ``top`` vectors (key, v) of its dimension a task, without the one whose key is ``own``."""
    spark, found = vectors.sparkSession, []
    for dimension in sorted(r.d for r in queries.select(F.size("v").alias("d")).distinct().collect() if r.d > 0):  # usually one
        some, rows = (df.where(F.size("v") == dimension) for df in (queries, vectors))
        blocks = max(1, -(-some.count() * 8 * dimension // BLOCK_BYTES))
        for b in range(blocks):
            block = some.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).select("q", "own", "v").toArrow()  # a bounded number
            if block.num_rows:
                told = spark.sparkContext.broadcast((block.column("q").to_numpy(), block.column("own").to_numpy(), _matrix(block.column("v").combine_chunks())))
                found.append(kept(rows.select("key", "v").mapInArrow(_scan(told, scores, top), "q long, key long, score double"), "nearest"))
                told.destroy()
    out = spark.createDataFrame([], "q long, key long, score double")
    for part in found:
        out = out.unionAll(part)
    return out


def _scan(told, scores, top: int):
    tile = TILE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, own, q = told.value
        held = [(i, Best(len(q[i : i + tile]), top)) for i in range(0, len(q), tile)]
        for batch in batches:
            for i in range(0, batch.num_rows, tile):
                part = batch.slice(i, tile)
                keys, v = part.column(0).to_numpy(), _matrix(part.column(1))
                for j, best_of in held:
                    best_of.add(scores(q[j : j + tile], v), keys, own[j : j + tile])
        for j, best_of in held:
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[j : j + tile][best_of.query]), pa.array(best_of.key), pa.array(best_of.score)], names=["q", "key", "score"])

    return run


def _complete(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key and v of the rows whose vector is there and has no null or NaN."""
    v = F.transform(vector, lambda x: x.cast("double"))
    return df.select(F.col(key).cast("long").alias("key"), v.alias("v")).where(F.col("key").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))


def nearest(queries: DataFrame, vectors: DataFrame, key: str, vector: str, top: int, least: float = -1.0) -> DataFrame:
    """q, rank, key, cosine: of a stated set of queries, in blocks, against all vectors."""
    asked = _complete(queries, key, vector).select(F.col("key").alias("q"), F.col("key").alias("own"), "v")
    w = Window.partitionBy("q").orderBy(F.desc("cosine"), key)
    scored = best(asked, _complete(vectors, key, vector), cosines, top).select("q", F.col("key").alias(key), F.col("score").alias("cosine")).where(F.col("cosine") >= least)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def tails(heads: DataFrame, relations: list[tuple[str, float]], vectors: DataFrame, key: str, vector: str, top: int) -> DataFrame:
    """For a head h and a relation r, which shifts every component: the vectors t nearest to h + r."""
    rows, w = _complete(vectors, key, vector), Window.partitionBy("h", "r").orderBy(F.desc("score"), key)
    out = None
    for r, shift in relations:
        aim = _complete(heads, key, vector).select(F.col("key").alias("q"), F.col("key").alias("own"), F.transform("v", lambda x: x + shift).alias("v"))  # noqa: B023
        told = best(aim, rows, nearness, top).select(F.col("q").alias("h"), F.lit(r).alias("r"), F.col("key").alias(key), "score")
        out = told if out is None else out.unionAll(told)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector of each label, one number a row."""
    return vectors.select(label, F.posexplode(vector).alias("k", "x")).groupBy(label, "k").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))
