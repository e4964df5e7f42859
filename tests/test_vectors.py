"""Nearest vectors against all pairs."""

import numpy as np
import pytest

from weftgraph.operators import vectors as V


@pytest.mark.parametrize("size", [16 << 20, 3 * 8 * 4])
def test_nearest_and_tails_are_those_of_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(V, "BLOCK_BYTES", size)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(60)]
    rows += [(100 + i, rows[5][1]) for i in range(8)] + [(200, None), (201, [None, 1.0, 1.0, 1.0]), (202, [float("nan")] * 4), (203, [0.0] * 4), (204, []), (205, [1.0, 2.0]), (None, rows[0][1])]
    good = {i: np.array(v) for i, v in rows if i is not None and v and all(x is not None and not np.isnan(x) for x in v)}
    df = spark.createDataFrame(rows, "id long, e array<double>").repartition(3)
    asked = df.where("id % 10 = 0 OR id IN (203, 205)")
    want = set()
    for q, a in good.items():
        if q % 10 == 0 or q in (203, 205):
            s = sorted((-round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), 6), i) for i, b in good.items() if i != q and len(b) == len(a) and np.linalg.norm(a) * np.linalg.norm(b))[:4]
            want |= {(q, k + 1, i, -c) for k, (c, i) in enumerate(s)}
    assert {(r.q, r["rank"], r.id, r.cosine) for r in V.nearest(asked, df, "id", "e", 4).collect()} == want
    want = set()
    for q, a in good.items():
        if q % 10 == 0 or q in (203, 205):
            for name, x in (("up", 0.5), ("down", -0.5)):
                s = sorted((round(float(np.linalg.norm(a + x - b)), 6), i) for i, b in good.items() if i != q and len(b) == len(a))[:4]
                want |= {(q, name, k + 1, i, -c) for k, (c, i) in enumerate(s)}
    assert {(r.h, r.r, r["rank"], r.id, r.score) for r in V.tails(asked, [("up", 0.5), ("down", -0.5)], df, "id", "e", 4).collect()} == want
    assert V.nearest(asked.limit(0), df, "id", "e", 4).collect() == []


def test_a_task_multiplies_tiles_of_a_bounded_size(spark, monkeypatch):
    from types import SimpleNamespace

    import pyarrow as pa

    monkeypatch.setattr(V, "TILE", 8)
    rng, sizes = np.random.default_rng(4), []
    v = rng.normal(size=(50, 4))
    spied = lambda q, w: sizes.append(len(q) * len(w)) or V.cosines(q, w)
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(v.tolist())], names=["key", "v"])
    told = SimpleNamespace(value=(np.arange(50), np.arange(50), v))
    got = {(q, k) for part in V._scan(told, spied, 3)(iter([batch])) for q, k in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)}
    cosine = np.round(V.cosines(v, v), 6)
    assert max(sizes) <= 64 and got == {(q, k) for q in range(50) for k in sorted((k for k in range(50) if k != q), key=lambda k: (-cosine[q, k], k))[:3]}
