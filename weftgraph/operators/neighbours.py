"""Vectors that are close to one another: exact pairs above a cosine, concept clusters, and retrieval over a second hop.

Vectors are turned to unit length and written in the order of their angle to one direction, the sum of all. By the triangle
inequality two vectors whose cosine is c or more have angles that differ by at most acos(c); so a block of vectors, which is next
to each other in that order, meets only the stretch of files around it, as a filter that reaches the scan. Within a task, products
are matrices. Equal vectors are one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.sources.scratch import kept

#: Bytes of the vectors that are broadcast at once.
BLOCK_BYTES = 16 << 20
#: Rows and columns of a product that a task holds at once.
TILE = 1024
#: Least cosine in a cluster and of a second hop, what a second hop keeps of a score, the least score of a first hop whose cluster counts, and what membership adds.
NEAR, SECOND, SURE, BONUS = 0.7, 0.8, 0.3, 0.1


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Members (key, rep), and distinct vectors of unit length (key, v, angle): nulls, and vectors of no length or with a null or non-finite component, take no part."""
    doubles = F.col(vector).cast("array<double>")
    good = (F.size(vector) > 0) & F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col(key).isNotNull() & good).select(F.col(key).alias("key"), doubles.alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.withColumn("length", length).where("length > 0").select("key", F.transform("v", lambda x: x / F.col("length")).alias("v"))
    classes = kept(rows.groupBy("v").agg(F.min("key").alias("rep")), "unit-vectors")
    members = rows.join(classes, "v").select("key", "rep")
    axes = classes.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()  # a number a coordinate
    axis = np.array([r.x for r in axes])
    scale = float(np.linalg.norm(axis)) or 1.0
    told = [float(x) / scale for x in axis]
    dot = F.aggregate(F.zip_with("v", F.array(*[F.lit(x) for x in told]), lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x) if told else F.lit(0.0)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))
    ordered = classes.select(F.col("rep").alias("key"), "v", angle.alias("angle")).repartitionByRange("angle", "key").sortWithinPartitions("angle", "key")
    return members, kept(ordered, "unit-ordered")


def _blocks(rows: DataFrame, dimension: int) -> list[tuple[float, float, Column]]:
    """Stretches of angles with at most a block's vectors each, and conditions for them; cut by approximate quantiles, which results don't depend on."""
    n = rows.count()
    blocks = max(1, -(-n * 8 * dimension // BLOCK_BYTES))
    cuts = sorted(set(rows.approxQuantile("angle", [i / blocks for i in range(1, blocks)], 0.1 / blocks))) if blocks > 1 else []
    ends = [-1.0, *cuts, 4.0]
    return [(a, b, (F.col("angle") > a) & (F.col("angle") <= b)) for a, b in zip(ends, ends[1:], strict=False)]


def close_pairs(rows: DataFrame, least: float, forest: bool = False) -> DataFrame:
    """a < b and cosine of the distinct unit vectors (key, v, angle) whose cosine is ``least`` or more; with ``forest``, of each task and block only pairs that connect what they connect (a and b alone count then)."""
    theta, spark, found = math.acos(least) + 1e-9, rows.sparkSession, []

    tile = TILE

    def scan(told):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, v = told.value
            # a task sees a vector once, so of what it has connected only the block's vectors matter later
            places, parent = {k: i for i, k in enumerate(keys.tolist())} if forest else {}, list(range(len(keys)))

            def root(x):
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            def connecting(own, x, y, at):
                take = np.zeros(len(x), bool)
                for k, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
                    q = root(b)
                    p = root(at[a]) if a in at else places.get(own[a])
                    if p is None:
                        at[a], take[k] = b, True
                    elif (p := root(p)) != q:
                        parent[max(p, q)] = min(p, q)
                        take[k] = True
                return take

            for batch in batches:
                if not batch.num_rows:
                    continue
                every, w = batch.column(0).to_numpy(), _matrix(batch.column(1))
                for i in range(0, len(every), tile):
                    own, at = every[i : i + tile], {}
                    for j in range(0, len(keys), tile):
                        cosine = w[i : i + tile] @ v[j : j + tile].T
                        x, y = np.nonzero((cosine >= least - 1e-12) & (own[:, None] < keys[j : j + tile]))
                        if forest:
                            take = connecting(own, x, y + j, at)
                            x, y = x[take], y[take]
                        if len(x):
                            yield pa.RecordBatch.from_arrays([pa.array(own[x], pa.int64()), pa.array(keys[y + j], pa.int64()), pa.array(cosine[x, y], pa.float64())], names=["a", "b", "cosine"])

        return run

    for dimension in sorted(r.d for r in rows.select(F.size("v").alias("d")).distinct().collect()):  # usually one
        same = rows.where(F.size("v") == dimension)
        for low, high, condition in _blocks(same, dimension):
            block = same.where(condition).select(F.col("key").cast("long").alias("key"), "v").toArrow()  # a bounded number
            if block.num_rows:
                told = spark.sparkContext.broadcast((block.column("key").to_numpy(), _matrix(block.column("v").combine_chunks())))
                around = same.where((F.col("angle") >= low - theta) & (F.col("angle") <= high + theta)).select(F.col("key").cast("long").alias("key"), "v")
                found.append(kept(around.mapInArrow(scan(told), "a long, b long, cosine double"), "close"))
                told.destroy()
    out = spark.createDataFrame([], "a long, b long, cosine double")
    for part in found:
        out = out.unionAll(part)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of all nodes of edges (a, b). Labels spread to neighbours and jump along labels, a table a round; the rounds grow with the logarithm of the longest path."""
    both = kept(edges.select("a", "b").unionAll(edges.select("b", "a")).where("a <> b").distinct(), "both-ways")
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        jumped = spread.join(labels.select(F.col("node").alias("new"), F.col("label").alias("jump")), "new")
        now = kept(jumped.select("node", F.least("new", "jump").alias("now"), "label"), "labels")
        labels = now.select("node", F.col("now").alias("label"))
        if now.where("now <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")


def clusters(vectors: DataFrame, key: str, vector: str, least: float = NEAR) -> DataFrame:
    """key and cluster (its least key) of all vectors whose cosine with another one is ``least`` or more, over any number of steps; lone ones have none."""
    members, rows = unit(vectors, key, vector)
    told = components(close_pairs(rows, least, forest=True)).withColumnRenamed("node", "rep")
    named = members.join(told, "rep", "left").withColumn("cluster", F.coalesce("component", "rep"))
    several = named.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
    return named.join(several, "cluster").select("key", "cluster")


def retrieve(first: DataFrame, vectors: DataFrame, key: str, vector: str, top: int, limit: int, least: float, near: float = NEAR) -> DataFrame:
    """q, key, score, rank of questions: their first hops (q, key, score), what is close to these, and a bonus for clusters.

    A first hop brings in its ``limit`` closest vectors with a cosine of ``near`` or more that aren't there yet, each with
    cosine * score * 0.8 if that is ``least`` or more; hops go from the best on. What came so and is in a cluster with a first
    hop of 0.3 or more gets 0.1 on top, at most 1. The best ``top`` stay, ties to the smaller key.
    """
    members, rows = unit(vectors, key, vector)
    wanted = first.select("key").distinct()
    own = members.join(wanted, "key", "left_semi")
    pairs = kept(close_pairs(rows, near), "close-pairs")
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine")).unionAll(rows.select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("cosine")))
    around = own.join(both.withColumnRenamed("a", "rep"), "rep").join(members.select(F.col("key").alias("other"), F.col("rep").alias("b")), "b").where("key <> other").select("key", "other", F.round("cosine", 6).alias("cosine"))
    around = kept(around, "around")
    place = Window.partitionBy("q").orderBy(F.desc("score"), "key")
    hops = first.withColumn("hop", F.row_number().over(place))
    reached = hops.join(around, "key").withColumn("second", F.col("cosine") * F.col("score") * SECOND).where(F.col("second") >= least)
    fresh = kept(reached.join(first.select("q", F.col("key").alias("other")), ["q", "other"], "left_anti").select("q", "hop", "other", "cosine", "second"), "second")
    # a vector that several hops reach belongs to the first of them that has room: hop by hop, as many rounds as a question has first hops
    taken = None
    for hop in range(1, (first.groupBy("q").count().agg(F.max("count")).first()[0] or 0) + 1):
        some = fresh.where(F.col("hop") == hop)
        if taken is not None:
            some = some.join(taken.select("q", "other"), ["q", "other"], "left_anti")
        best = Window.partitionBy("q").orderBy(F.desc("cosine"), "other")
        new = kept(some.withColumn("r", F.row_number().over(best)).where(F.col("r") <= limit).select("q", "other", "second"), "hop")
        taken = new if taken is None else taken.unionByName(new)
    if taken is None:
        return first.select("q", "key", "score", F.lit(0).alias("rank")).limit(0)
    grouped = members.join(components(pairs).withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("cluster"))
    sure = first.where(F.col("score") >= SURE).join(grouped, "key").select("q", "cluster").distinct().withColumn("_sure", F.lit(True))
    second = taken.select("q", F.col("other").alias("key"), F.col("second").alias("score")).join(grouped, "key", "left").join(sure, ["q", "cluster"], "left")
    second = second.select("q", "key", F.when(F.col("_sure"), F.least(F.lit(1.0), F.col("score") + BONUS)).otherwise(F.col("score")).alias("score"))
    every = first.select("q", "key", "score").unionByName(second)
    return every.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
