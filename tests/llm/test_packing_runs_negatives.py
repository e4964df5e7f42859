"""Packing, periodic runs and hard negatives against plain versions, on nulls, empty and long texts, copies, ties and odd columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import BPE, DOCS, corpus, words
from weftgraph.llm import bin_packing, hard_negatives, periodic_runs
from weftgraph.llm.wordhash import mix

CLASH = {"length": 1, "rank": "r", "task": 2, "label": 7, "start": None, "runs": "x", "piece": 3}


@pytest.fixture(scope="module")
def rows():
    return [*corpus(), (None, "no id", None, None, None), (5, "another text under an id", None, None, None), (5, "another text under an id", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({k: F.lit(v) for k, v in CLASH.items()}).repartition(5)


# 11


def best_fit_decreasing(lengths, size):
    """Bins of the plain greedy method: the longest piece left goes where the least room remains."""
    room = []
    for x in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= x]
        if fits:
            k = min(fits, key=room.__getitem__)
            room[k] -= x
        else:
            room.append(size - x)
    return len(room)


@pytest.mark.parametrize("size", [7, 64, 2048])
def test_packing_keeps_every_piece_and_leaves_no_gap(spark, docs, rows, size):
    from tokenizers import Tokenizer

    encode, want = Tokenizer.from_file(BPE), Counter()
    for i, t, *_ in rows:
        ids = np.array([*encode.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) - size * ((len(ids) - 1) // size)
        cuts = [0, *range(first, len(ids), size), len(ids)]
        cuts = sorted(set(cuts))
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    got = bin_packing.pack(docs, BPE, size).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= size
    assert len(bins) <= best_fit_decreasing([r.length for r in got], size)


def test_packing_of_nothing(spark):
    assert bin_packing.pack(spark.createDataFrame([], DOCS), BPE).collect() == []


def fullest(lengths, size):
    """By all subsets: the fullest sum with the longest piece."""
    longest = max(lengths)
    rest = list(lengths)
    rest.remove(longest)
    sums = {longest}
    for x in rest:
        sums |= {s + x for s in sums if s + x <= size}
    return max(sums)


def test_each_pattern_is_the_fullest_beside_the_longest():
    rng = random.Random(3)
    for _ in range(200):
        size = rng.choice([10, 25, 40])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(1, 14))]
        left = Counter(lengths)
        for times, found in bin_packing.Patterns(np.bincount(lengths, minlength=size + 1), size):
            for _ in range(times):
                assert max(left.elements()) in found and sum(k * n for k, n in found.items()) == fullest(list(left.elements()), size)
                left -= Counter(found)
        assert not left


def test_patterns_don_t_grow_with_documents():
    rng = np.random.default_rng(2)
    few = rng.integers(1, 2049, 20_000)
    counts = np.bincount(few, minlength=2049)
    one, many = (list(bin_packing.Patterns(counts * k, 2048)) for k in (1, 1000))
    assert len(many) < 3 * len(one) and sum(t for t, _ in many) <= 1000 * sum(t for t, _ in one)


def test_patterns_are_nearly_as_few_as_can_be():
    rng = np.random.default_rng(4)
    for lengths in (np.minimum(2048, rng.lognormal(5.5, 1.2, 50_000).astype(int) + 1), np.full(999, 683), np.full(1000, 2), np.array([2048] * 7 + [1])):
        bins = sum(t for t, _ in bin_packing.Patterns(np.bincount(lengths, minlength=2049), 2048))
        per = 2048 // int(lengths.max()) if len(set(lengths.tolist())) == 1 else 0
        assert bins <= (-(-len(lengths) // per) if per else -(-int(lengths.sum()) // 2048) + 1)


# 12


def plain_runs(w, least_length=6, power=4):
    n, out = len(w), []
    for q in range(1, n):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if size >= max(least_length, power * q) and not any(all(w[i + k] == w[i + k + p] for k in range(size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng, most=80):
    kinds = rng.choice([1, 2, 3, 5, 50])
    t = [rng.randint(1, kinds) for _ in range(rng.randint(0, most))]
    for _ in range(rng.randint(0, 3)):
        if t:
            i, p = rng.randrange(len(t)), rng.randint(1, 6)
            t[i:i] = t[i : i + p] * rng.randint(2, 8)
    return t


@pytest.mark.parametrize(("least", "power"), [(6, 4), (6, 2), (3, 3), (12, 4)])
def test_runs_are_those_of_all_stretches(least, power):
    rng, found = random.Random(1), 0
    for _ in range(300):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 6))]
        flat = np.array([x for t in texts for x in t], np.uint64)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        want = [plain_runs(t, least, power) for t in texts]
        assert periodic_runs.runs_of(mix(flat) if len(flat) else flat, bounds, least, power) == want
        found += sum(map(len, want))
    assert found > 200


def test_sets_of_positions_stay_in_order(monkeypatch):
    monkeypatch.setattr(periodic_runs, "BLOCK", 4)
    rng = random.Random(2)
    values = rng.sample(range(1000), 300)
    held, plain = periodic_runs.Positions(values[0]), [values[0]]
    for x in values[1:]:
        before, after = held.add(x)
        assert before == max((y for y in plain if y < x), default=-1) and after == min((y for y in plain if y > x), default=-1)
        plain.append(x)
        assert held.size == len(plain)
    assert list(held) == sorted(plain)


def test_a_text_that_is_one_run_and_one_of_fibonacci_words():
    n = 30_000
    assert periodic_runs.runs_of(np.full(n, 9, np.uint64), np.array([0, n])) == [[(0, n, 1)]]
    a, b = [1], [1, 2]
    while len(b) < 3000:
        a, b = b, b + a
    assert periodic_runs.runs_of(mix(np.array(b, np.uint64)), np.array([0, len(b)])) == [[]]  # no power of four


def test_periodic_runs_query(spark, rows):
    rng = random.Random(6)
    more = [(2000 + i, " ".join(f"w{x}" for x in repetitive(rng)), None, None, None) for i in range(60)]
    every = [*rows, *more]
    docs = spark.createDataFrame(every, DOCS).withColumns({k: F.lit(v) for k, v in CLASH.items()}).repartition(4)
    want = Counter()
    changed = 0
    for i, t, *_ in every:
        w = words(t)
        h, n = (1 if i is None else zlib.crc32(str(i).encode())), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            changed += 1
        runs = plain_runs(w) if n < 500 else next(iter(periodic_runs.runs_of(mix(np.array([hash(x) & (2**63 - 1) for x in w], np.uint64)), np.array([0, n]))))
        top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        told = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        want[i, len(runs), *top, 1000 * top[1] // top[2] if runs else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()] += 1
    got = periodic_runs.run(docs)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == want and changed > 3
    assert periodic_runs.run(docs.limit(0)).collect() == []


def test_runs_of_texts_as_they_are(spark):
    docs = spark.createDataFrame([(1, "go go go go go go now a b a b a b a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic_runs.detect(docs).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 6, 1), (7, 8, 2)] and got[1].collapsed == "go now a b" and got[2].runs == [] and got[2].collapsed == ""


# 13


def plain_negatives(rows, positives=5, negatives=5, low=80, high=100, every=100):
    good = [(i, y, [int(np.floor(256 * float(x))) for x in v]) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    first = {}
    for i, y, v in good:
        if i % every == 0:
            first[i] = min(first.get(i, (y, v)), (y, v))
    out = Counter()
    for a, (label, av) in first.items():
        scored = [(-sum(p * q for p, q in zip(av, v, strict=True)), i, y) for i, y, v in good if i != a and len(v) == len(av)]
        for s, p in sorted((s, i) for s, i, y in scored if y == label)[:positives]:
            fits = sorted((n, i) for n, i, y in scored if y != label and low * -s <= 100 * -n <= high * -s)[:negatives]
            out.update((a, p, k + 1, i, -s, -n) for k, (n, i) in enumerate(fits))
    return out


def vectors(seed, n, dimension=6, copies=True):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dimension))
    rows = []
    for i in range(n):
        v = (centres[i % 7] + rng.normal(scale=0.3, size=dimension)).tolist()
        rows.append((i, v, int(rng.integers(0, 4))))
    if copies:
        rows += [(n + k, rows[3][1], k % 3) for k in range(n // 3)]  # a hot vector under several labels
        rows += [(5000, None, 1), (5100, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (5200, [float("nan")] * dimension, 1), (5300, [float("inf")] * dimension, 2), (5400, [0.5] * dimension, None), (None, [0.5] * dimension, 1), (5500, [], 1)]
        rows += [(100, rows[7][1], 3), rows[11], rows[11], (5600, [0.1, 0.2], 1), (5601, [0.3, 0.2], 1), (5602, [0.3, 0.19], 2), (5700, [0.0] * dimension, 2), (5800, [-x for x in rows[0][1]], rows[0][2])]
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize(("block", "together", "batch"), [(1024, 512, 1 << 25), (8, 3, 1000)])
def test_negatives_are_those_of_all_products(spark, monkeypatch, block, together, batch):
    for name, value in (("BLOCK_ROWS", block), ("TOGETHER", together), ("BATCH_BYTES", batch)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(5, 420)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({k: F.lit("x") for k in ("cell", "id", "v", "place", "low")}).repartition(4)
    got = hard_negatives.mine(df, every=20)
    assert Counter((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got.collect()) == plain_negatives(rows, every=20)
    moved = [(i, v, y if y is None or i is None or i % 7 else (y + 1) % 10) for i, v, y in rows]
    told = hard_negatives.run(df)
    assert told.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(tuple(r) for r in told.collect()) == plain_negatives(moved)


def test_negatives_of_nothing(spark):
    assert hard_negatives.run(spark.createDataFrame([], SCHEMA)).collect() == []
    alone = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [2.0, 1.0], 2)], SCHEMA)
    assert hard_negatives.run(alone).collect() == []  # no positive


def test_the_curve_goes_from_neighbour_to_neighbour():
    for dimensions, bits in ((2, 4), (3, 3), (4, 2)):
        steps = 1 << bits
        points = np.stack(np.meshgrid(*[np.arange(steps)] * dimensions, indexing="ij"), axis=-1).reshape(-1, dimensions)
        key = hard_negatives.hilbert(points, bits)
        assert sorted(key.tolist()) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_zones_bound_all_products_and_leave_blocks_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(8)
    v = (rng.normal(size=(40, 4))[rng.integers(0, 40, 4000)] * 1000 + rng.normal(size=(4000, 4)) * 20).astype(np.int64)
    rows = spark.createDataFrame([(i, i % 3, x) for i, x in enumerate(v.tolist())], "id long, label long, v array<long>")
    hard_negatives.write_blocks(rows.repartition(4), str(tmp_path / "blocks"), 4)
    blocks = spark.read.schema(hard_negatives.BLOCKS).parquet(str(tmp_path / "blocks"))
    assert blocks.agg(F.sum("n")).first()[0] == 4000
    cells, zones = hard_negatives.cell_zones(blocks, 4)
    least, most = zones.bounds(v[:50])
    for r in blocks.collect():
        ids = np.frombuffer(r.ids, "<i8")
        held = np.frombuffer(r.vectors, "<i4").reshape(len(ids), 4)
        assert (held == v[ids]).all() and set(ids % 3) == {r.label} and (held.min(axis=0) == r.low).all() and (held.max(axis=0) == r.high).all()
        score = v[:50] @ held.T
        c = cells.index(r.cell)
        assert (least[:, c, None] <= score).all() and (score <= most[:, c, None]).all()
    everything = v @ v[:50].T
    floor = np.sort(everything, axis=0)[-6]
    asked = hard_negatives.Anchors(np.arange(50), np.arange(50) % 3, v[:50], floor[:, None], np.full((50, 1), hard_negatives.FULL), True)
    told = blocks.collect()
    label = np.array([r.label for r in told])
    of_blocks = hard_negatives.Zones(np.array([r.low for r in told]), np.array([r.high for r in told]), label, label)
    needs = asked.needs(of_blocks, asked.low)
    assert needs.mean() < 0.15 < (label == asked.labels[:, None]).mean()  # fewer than half of the blocks of the anchor's label
    for k, r in enumerate(told):
        ids = np.frombuffer(r.ids, "<i8")
        assert not ((everything[ids, :50].T >= floor[:, None]) & (asked.labels[:, None] == r.label))[~needs[:, k]].any()


def test_products_beyond_doubles_are_exact():
    a, b = np.array([[2**30, 1]]), np.array([[2**31 + 1, 3], [1, -7]])
    assert hard_negatives.products(a, b).tolist() == [[2**30 * (2**31 + 1) + 3, 2**30 - 7]]
