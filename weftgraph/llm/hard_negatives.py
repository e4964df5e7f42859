"""Hard negatives: of other labels' vectors, those that score just below an anchor's positives.

Candidates are written once, as Parquet rows that hold a block of vectors of one label each.
Blocks follow a Hilbert curve over the coordinates that vary most, so that a block's vectors
lie close together, and each has a zone map: the least and greatest value of every coordinate.
Tasks that write neighbouring blocks make a cell; a cell has a folder of its own and a zone
map over its blocks.

For an anchor a and a zone, interval arithmetic bounds every product: a coordinate adds at most
the greater, at least the smaller of a_d low_d and a_d high_d. Two searches use these bounds:

1. Positives: the best of the anchor's own label. The anchor's own block gives a first k-th best
   score; a zone is read if its upper bound reaches it.
2. Windows: each positive's score gives an interval of scores that its negatives must lie in. A
   zone of other labels is read if its bounds meet one of the anchor's windows, and if its upper
   bound reaches the k-th best known there.

Anchors go in batches of bounded size, next to each other on the curve, so that a batch needs few
cells: those that none of its anchors needs aren't read, and within a cell a block is scored only
with the anchors that need it. A task returns at most k rows a search and window. A batch costs a
scan of its cells, whose time is nearly all in products of its many anchors.

Defined cases: rows without an id or label take no part, nor do vectors that are null, empty, or
hold a null or non-finite component; vectors meet only those of their own dimension; rows with the
anchor's id are never its positives or negatives; of anchors that share an id, that of the least
label and vector counts; other repeated rows are listed as often as they are there, ties going to
the smaller id; a positive with a negative score has an empty window. Products are exact as long as
they fit in a long. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bound_batches
from .topk_search import Best, scaled

POSITIVES, NEGATIVES = 5, 5
#: A window, in hundredths of the positive's score.
LOW, HIGH = 80, 100
#: Vectors of a block.
BLOCK_ROWS = 1024
#: Coordinates of the curve, those of the greatest variance, and bits of each.
CURVE_DIMENSIONS, CURVE_BITS = 8, 7
#: Bytes of a batch of anchors: the bound of what is broadcast, and of what the driver holds of anchors.
BATCH_BYTES = 32 << 20
#: Anchors that meet a block at once.
TOGETHER = 512

BLOCKS = "cell int, label long, n int, low array<long>, high array<long>, ids binary, vectors binary"
NONE, FULL = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with coordinates below 2**bits, by Skilling's transform; dimensions times bits are at most 63."""
    x = points.astype(np.int64).T.copy()
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(len(x)):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(len(x)):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@dataclass
class Curve:
    """Which coordinates the curve goes through, and how they are cut into steps."""

    chosen: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def place(self, v: np.ndarray) -> np.ndarray:
        steps = 1 << CURVE_BITS
        x = (v[:, self.chosen] - self.mean) / (4 * self.spread) + 0.5
        return hilbert(np.clip(x * steps, 0, steps - 1).astype(np.int64), CURVE_BITS)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit_curve(rows: DataFrame, dimension: int) -> Curve:
    """Coordinates by variance: a task adds up its own rows, and sums of tasks are added up by coordinate."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(dimension), np.zeros(dimension)
        for batch in batches:
            x = _matrix(batch.column(0)).astype(np.float64)
            n, total, squares = n + len(x), total + x.sum(axis=0), squares + (x * x).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimension, dtype=np.int32)), pa.array(np.full(dimension, n, np.int64)), pa.array(total), pa.array(squares)], names=["i", "n", "s", "q"])

    sums = rows.select("v").mapInArrow(add, "i int, n long, s double, q double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean, variance = np.zeros(dimension), np.zeros(dimension)
    for r in sums.collect():  # a row a coordinate
        mean[r.i] = r.s / r.n
        variance[r.i] = max(r.q / r.n - mean[r.i] ** 2, 0.0)
    chosen = np.sort(np.argsort(-variance, kind="stable")[:CURVE_DIMENSIONS])
    return Curve(chosen, mean[chosen], np.sqrt(variance[chosen]) + 1e-9)


def _packed(cell: int, label: int, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    low, high = v.min(axis=0), v.max(axis=0)
    narrow = low.min() >= -(2**31) and high.max() < 2**31
    columns = [pa.array([cell], pa.int32()), pa.array([label], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([low], pa.list_(pa.int64())), pa.array([high], pa.list_(pa.int64()))]
    columns += [pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([v.astype("<i4" if narrow else "<i8").tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["cell", "label", "n", "low", "high", "ids", "vectors"])


def _unpacked(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(batch.column("ids")[row].as_buffer(), "<i8")
    raw = batch.column("vectors")[row].as_buffer()
    dimension = len(batch.column("low")[row])
    return ids, np.frombuffer(raw, "<i8" if raw.size == 8 * len(ids) * dimension else "<i4").reshape(len(ids), dimension)


def write_blocks(rows: DataFrame, path: str, dimension: int) -> None:
    """Blocks of rows (id, label, v) in the order of label and curve. One shuffle, by ranges."""
    curve = fit_curve(rows, dimension)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(curve.place(_matrix(batch.column(2))))], names=["id", "label", "v", "place"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cell, held, label = TaskContext.get().partitionId(), [], None

        def settle(all_of_it: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            ids, v = (np.concatenate(x) for x in zip(*held, strict=True))
            stop = len(ids) if all_of_it else len(ids) // BLOCK_ROWS * BLOCK_ROWS
            for i in range(0, stop, BLOCK_ROWS):
                yield _packed(cell, label, ids[i : min(i + BLOCK_ROWS, stop)], v[i : min(i + BLOCK_ROWS, stop)])
            held = [(ids[stop:], v[stop:])] if stop < len(ids) else []

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
            for some in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(labels)) + 1):
                if held and labels[some[0]] != label:
                    yield from settle(True)
                label = int(labels[some[0]])
                held.append((ids[some], v[some]))
                if sum(len(x) for x, _ in held) >= BLOCK_ROWS:
                    yield from settle(False)
        if held:
            yield from settle(True)

    placed = rows.select("id", "label", "v").mapInArrow(place, "id long, label long, v array<long>, place long")
    dealt = placed.repartitionByRange("label", "place", "id").sortWithinPartitions("label", "place", "id")
    dealt.mapInArrow(pack, BLOCKS).write.mode("overwrite").option("compression", "zstd").partitionBy("cell").parquet(path)


@dataclass
class Zones:
    """Boxes, and the least and greatest label in each."""

    low: np.ndarray
    high: np.ndarray
    label_low: np.ndarray
    label_high: np.ndarray

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest products of each row of a with the vectors of each box, a little wider than they are."""
        up, down = np.maximum(a, 0).astype(np.float64), np.minimum(a, 0).astype(np.float64)
        low, high = self.low.T.astype(np.float64), self.high.T.astype(np.float64)
        least, most = up @ low + down @ high, up @ high + down @ low
        slack = 1e-9 * (np.abs(up - down) @ np.maximum(np.abs(low), np.abs(high))) + 0.5
        return least - slack, most + slack

    def has(self, labels: np.ndarray) -> np.ndarray:
        return (self.label_low <= labels[:, None]) & (labels[:, None] <= self.label_high)

    def has_other(self, labels: np.ndarray) -> np.ndarray:
        return ~((self.label_low == labels[:, None]) & (self.label_high == labels[:, None]))


def cell_zones(blocks: DataFrame, dimension: int) -> tuple[list[int], Zones]:
    """Cells and their zones: a row a task of the writer, so their number is that of the shuffle's partitions."""
    ends = blocks.select("cell", "label", F.posexplode(F.arrays_zip("low", "high")).alias("i", "z")).groupBy("cell", "i").agg(F.min("z.low").alias("low"), F.max("z.high").alias("high"), F.min("label").alias("a"), F.max("label").alias("b"))
    told = ends.groupBy("cell").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("z")).orderBy("cell").collect()
    box = lambda k: np.array([[z[k] for z in r.z] for r in told], np.int64).reshape(len(told), dimension)
    return [r.cell for r in told], Zones(box("low"), box("high"), np.array([r.a for r in told], np.int64), np.array([r.b for r in told], np.int64))


def products(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact products of all rows of two integer matrices."""
    bound = np.abs(a).max(initial=0) * float(np.abs(v).max(initial=0)) * a.shape[1]
    if bound < 2**52:
        return (a.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ v.T.astype(np.int64)


def _best_entries(score: np.ndarray, good: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the good entries that are among a row's k greatest, with all that tie."""
    some = np.flatnonzero(good.any(axis=1))
    masked = np.where(good[some], score[some], NONE)
    if masked.shape[1] > k:
        least = np.partition(masked, -k, axis=1)[:, -k]
        row, column = np.nonzero((masked >= least[:, None]) & (masked > NONE))
    else:
        row, column = np.nonzero(masked > NONE)
    return some[row], column


def _own_block(is_anchor, k: int):
    """Blocks to their anchors: cell, id, label, v, and the k-th best score in the block."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, v = _unpacked(batch, row)
                at = np.flatnonzero(is_anchor(ids))
                for i in range(0, len(at), TOGETHER):
                    some = at[i : i + TOGETHER]
                    score = np.where(ids[some][:, None] == ids, NONE, products(v[some], v))
                    floor = np.partition(score, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(some), NONE)
                    columns = [pa.array(np.full(len(some), batch.column("cell")[row].as_py(), np.int32)), pa.array(ids[some]), pa.array(np.full(len(some), batch.column("label")[row].as_py(), np.int64)), pa.array(list(v[some].astype(np.int64)), pa.list_(pa.int64())), pa.array(floor)]
                    yield pa.RecordBatch.from_arrays(columns, names=["cell", "id", "label", "v", "floor"])

    return find


@dataclass
class Anchors:
    """A batch. low and high: by window, the scores looked for; positives have one window, from the k-th best known on."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool

    def needs(self, zones: Zones, low: np.ndarray) -> np.ndarray:
        """Which anchors need which zones, where a window's scores have to reach low."""
        least, most = zones.bounds(self.v)
        met = zones.has(self.labels) if self.same else zones.has_other(self.labels)
        hit = np.zeros(met.shape, bool)
        for j in range(low.shape[1]):
            hit |= (most >= low[:, j, None]) & (least <= self.high[:, j, None]) & (low[:, j] <= self.high[:, j])[:, None]
        return met & hit


def _scanner(told, k: int):
    """Blocks to a task's k best of each anchor and window: anchor, window, vec_id, score. anchor is the place in the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Anchors = told.value
        windows = asked.low.shape[1]
        best = Best(len(asked.ids) * windows, k)
        for batch in batches:
            for row in range(batch.num_rows):
                label = np.array([batch.column("label")[row].as_py()])
                zone = Zones(batch.column("low")[row].values.to_numpy()[None], batch.column("high")[row].values.to_numpy()[None], label, label)
                low = np.maximum(asked.low, best.floor().reshape(-1, windows))
                need = np.flatnonzero(asked.needs(zone, low)[:, 0])
                if not len(need):
                    continue
                ids, v = _unpacked(batch, row)
                for i in range(0, len(need), TOGETHER):
                    some = need[i : i + TOGETHER]
                    score = products(asked.v[some], v)
                    other = asked.ids[some][:, None] != ids
                    for j in range(windows):
                        good = other & (score >= low[some, j, None]) & (score <= asked.high[some, j, None])
                        a, b = _best_entries(score, good, k)
                        best.add(some[a] * windows + j, score[a, b], ids[b])
        found, place = np.nonzero(best.id != FULL)
        columns = [pa.array(asked.ids[found // windows]), pa.array((found % windows).astype(np.int32)), pa.array(best.id[found, place]), pa.array(best.score[found, place])]
        yield pa.RecordBatch.from_arrays(columns, names=["anchor_id", "window", "vec_id", "score"])

    return run


def _batches(anchors: DataFrame, dimension: int) -> list[Column]:
    """Conditions on (cell, id) that cut the anchors into batches of bounded size, neighbouring cells together."""
    most = max(1, BATCH_BYTES // (8 * (dimension + 2 * POSITIVES + 3)))
    out, cells, held = [], [], 0
    for r in anchors.groupBy("cell").agg(F.count("*").alias("n")).orderBy("cell").collect():  # a row a cell at most
        parts = -(-r.n // most)
        if parts > 1:
            out += [(F.col("cell") == r.cell) & (F.pmod(F.xxhash64("id"), F.lit(parts)) == p) for p in range(parts)]
            continue
        if held + r.n > most:
            out.append(F.col("cell").isin(cells))
            cells, held = [], 0
        cells.append(r.cell)
        held += r.n
    return [*out, F.col("cell").isin(cells)] if cells else out


def _searched(blocks: DataFrame, cells: list[int], zones: Zones, asked: Anchors, k: int, scratch: Scratch, name: str) -> DataFrame | None:
    """What the batch finds in the cells that it needs."""
    wanted = [c for c, need in zip(cells, asked.needs(zones, asked.low).any(axis=0).tolist(), strict=True) if need]
    if not wanted:
        return None
    told = blocks.sparkSession.sparkContext.broadcast(asked)
    found = blocks.where(F.col("cell").isin(wanted)).mapInArrow(_scanner(told, k), "anchor_id long, window int, vec_id long, score long")
    w = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    out = scratch.keep(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), name)
    told.destroy()
    return out


def mine(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, and which of the anchor's positives it is (positive_rank).

    Anchors are the rows whose id is divisible by ``every``. A negative's score is from low to high hundredths of the positive's.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "hard-negatives")
    ready = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), scaled(F.col(f"`{vector_col}`")).alias("v"))
    rows = scratch.keep(ready.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL"), "rows")
    told_of: list[DataFrame] = []
    for dimension in sorted(r.d for r in rows.select(F.size("v").alias("d")).distinct().collect()):  # usually one
        write_blocks(rows.where(F.size("v") == dimension), scratch.path(f"blocks-{dimension}"), dimension)
        blocks = spark.read.schema(BLOCKS).parquet(scratch.path(f"blocks-{dimension}")).select(*[c.split()[0] for c in BLOCKS.split(", ")])
        cells, zones = cell_zones(blocks, dimension)
        found = blocks.mapInArrow(_own_block(lambda ids: ids % every == 0, positives), "cell int, id long, label long, v array<long>, floor long")
        one = found.groupBy("id").agg(F.min(F.struct("label", "v", "cell", "floor")).alias("a")).select("id", "a.*")
        anchors = scratch.keep(one, f"anchors-{dimension}")
        for b, condition in enumerate(_batches(anchors, dimension)):
            some = anchors.where(condition).orderBy("id").toArrow()
            ids, labels, floor = (some.column(c).to_numpy() for c in ("id", "label", "floor"))
            v = _matrix(some.column("v").combine_chunks()).astype(np.int64)
            near = _searched(blocks, cells, zones, Anchors(ids, labels, v, floor[:, None], np.full((len(ids), 1), FULL), True), positives, scratch, f"near-{dimension}-{b}")
            if near is None:
                continue
            score = np.full((len(ids), positives), -1)  # of none: an empty window
            best = near.select("anchor_id", "rank", "score").toArrow()  # so many rows an anchor of the batch at most
            score[np.searchsorted(ids, best.column("anchor_id").to_numpy()), best.column("rank").to_numpy() - 1] = best.column("score").to_numpy()
            low_end, high_end = np.where(score < 0, 1, -(-low * score // 100)), np.where(score < 0, 0, high * score // 100)
            hard = _searched(blocks, cells, zones, Anchors(ids, labels, v, low_end, high_end, False), negatives, scratch, f"hard-{dimension}-{b}")
            if hard is not None:
                hard = hard.select("anchor_id", (F.col("window") + 1).alias("positive_rank"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
                told_of.append(hard.join(near.select("anchor_id", F.col("rank").alias("positive_rank"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor_id", "positive_rank"]))
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank"]
    if not told_of:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, positive_rank int")
    out = told_of[0]
    for other in told_of[1:]:
        out = out.unionByName(other)
    return out.select(*columns)


def run(vectors: DataFrame) -> DataFrame:
    """The contract's columns: where vec_id is divisible by 7, the label becomes the next of ten first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", "embedding", label.alias("label"))).drop("positive_rank")
