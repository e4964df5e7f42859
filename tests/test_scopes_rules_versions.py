"""Scopes, rule texts, versions, clusters and second hops, by hand and against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import neighbours as N
from weftgraph.operators import rule_texts as R
from weftgraph.operators import scopes as S
from weftgraph.sources import versions as V

SCOPE = "scope string, parent string, domain string, topics array<string>, min_confidence double, max_depth int, allowed array<string>, denied array<string>, seeds boolean"


def tree(spark, *rows):
    return spark.createDataFrame(rows, SCOPE)


def test_limits_only_get_narrower(spark):
    rows = tree(
        spark,
        ("a", None, "law", ["t"], 0.3, 5, ["x", "y"], ["z"], True),
        ("b", "a", "general", ["u"], 0.1, 9, [], ["w"], False),
        ("c", "b", "tax", None, 0.6, 2, ["y"], None, True),
        ("d", None, "general", [], 0.0, 1, [], [], True),
    )
    got = {r.scope: r for r in S.closed(rows).collect()}
    b, c = got["b"], got["c"]
    assert (b.domain, b.topics, b.min_confidence, b.max_depth, b.allowed, b.denied, b.seeds, b.level) == ("law", ["t", "u"], 0.3, 5, ["x", "y"], ["w", "z"], False, 1)
    assert (c.domain, c.topics, c.min_confidence, c.max_depth, c.allowed, c.denied, c.seeds, c.level) == ("tax", ["t", "u"], 0.6, 2, ["y"], ["w", "z"], False, 2)
    assert len(got) == 4 and S.closed(tree(spark).limit(0)).count() == 0
    inside = S.within(F.lit("y"), F.lit(0.6), F.col("allowed"), F.col("denied"), F.col("min_confidence"))
    assert {r.scope for r in S.closed(rows).where(inside).collect()} == {"a", "b", "c", "d"}
    assert {r.scope for r in S.closed(rows).where(S.within(F.lit("z"), F.lit(1.0), F.col("allowed"), F.col("denied"), F.col("min_confidence"))).collect()} == {"d"}


@pytest.mark.parametrize("child", [("b", "a", "general", [], 0.5, 1, ["z"], [], True), ("b", "a", "general", [], 0.5, 1, ["q"], [], True), ("b", "nobody", "general", [], 0.5, 1, [], [], True)])
def test_a_wider_child_is_an_error(spark, child):
    with pytest.raises(ValueError):
        S.closed(tree(spark, ("a", None, "law", [], 0.3, 5, ["x"], ["z"], True), child))


def test_traversal_at_a_boundary(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "x"), ("x", "y"), ("y", "z"), ("c", "a")], "src string, dst string")
    nodes = spark.createDataFrame([("a", 0.9, True), ("b", 0.8, True), ("c", 0.7, True), ("x", 0.5, False), ("y", 1.0, True)], "node_id string, confidence double, inside boolean")
    start = spark.createDataFrame([("a",)], "node_id string")
    told = lambda boundary, n=nodes: {(r.node_id, r.depth, round(r.confidence, 6)) for r in S.traverse(edges, n, start, 2, boundary).collect()}
    hard, soft = {("a", 0, 0.9), ("b", 1, 0.8), ("c", 2, 0.7)}, {("a", 0, 0.9), ("b", 1, 0.8), ("c", 2, 0.7), ("x", 1, 0.15), ("y", 2, 1.0)}
    assert told("hard") == hard and told("soft") == soft and told("adaptive") == hard
    assert told("adaptive", nodes.withColumn("inside", F.col("node_id").isin("a", "y"))) == {("a", 0, 0.9), ("b", 1, 0.24), ("c", 2, 0.21), ("x", 1, 0.15), ("y", 2, 1.0)}
    assert ("z", 3, 0.0) in {(r.node_id, r.depth, r.confidence) for r in S.traverse(edges, nodes, start, 3, "soft").collect()}
    with pytest.raises(ValueError):
        S.traverse(edges, nodes, start, 1, "firm")


@pytest.mark.parametrize(
    ("text", "want"),
    [("Rp500.000.000", 5e8), ("500 juta", 5e8), ("30 persen", 0.3), ("2,5%", 0.025), ("500.000.000", 5e8), ("Rp 3 miliar lebih", 3e9), ("tanpa angka", None), ("7 ribu", 7e3), ("...", None)],
)
def test_numbers_of_texts(text, want):
    got = R.extract_number(text)
    assert got is None if want is None else got == pytest.approx(want)


def test_conditions_and_rates():
    assert R.parse_condition("penghasilan di atas 500 juta") == (">", 5e8) and R.parse_condition("PKP lebih dari 60 juta") == (">", 6e7)
    assert R.parse_condition("harga di bawah 1.000") == ("<", 1000.0) and R.parse_condition("antara Rp50 juta dan 2 miliar") == (">", 2e9) and R.parse_condition("selalu 30%") is None
    assert R.parse_consequence("dikenakan tarif 30 persen") == 0.3 and R.parse_consequence("dikenakan pajak sebesar 2,5 %") == 0.025 and R.parse_consequence("bebas") is None


def test_rules_are_told_in_one_pass(spark, tmp_path):
    spark.createDataFrame([(1, 10.0), (2, 2000.0), (3, None), (4, 9e6)], "id int, v double").write.parquet(str(tmp_path / "t"))
    rules = [R.Rule("high", "di atas 1 ribu", "tarif 10%"), R.Rule("low", "di bawah 100"), R.Rule("never", "di atas 1 miliar", "tarif 5%")]
    got = R.evaluate(spark.read.parquet(str(tmp_path / "t")), ["id"], "v", rules)
    assert {(r.id, r.rule, r.charge) for r in got.collect()} == {(1, "low", None), (2, "high", 200.0), (4, "high", 900000.0)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "GreaterThan(v,1000.0)" in plan
    assert R.evaluate(spark.read.parquet(str(tmp_path / "t")), ["id"], "v", [R.Rule("always", "selalu")]).count() == 4


def test_a_delta_counts_once(spark, tmp_path):
    root = str(tmp_path / "graph")
    rows = [(1, "Event", "Candidate", "Inferred", 0.9, 4), (2, "Event", "Stable", "Observed", 0.3, 0), (3, "Event", "Candidate", "Observed", 0.2, 5), (4, "Event", "Stable", "Inferred", 0.9, 5)]
    schema = "comp_id int, comp_type string, lifecycle string, epistemic string, confidence double, batch_seen long"
    assert V.current(spark, root) is None
    V.start(spark.createDataFrame(rows, schema), root)
    V.start(spark.createDataFrame(rows[:1], schema), root)  # it is there already
    assert V.current(spark, root).count() == 4
    new = spark.createDataFrame([(1, "Event", "New", "Observed", 0.4, 0), (9, "Event", "Candidate", "Observed", 0.6, 0)], schema)
    fixed, wrong, members = spark.createDataFrame([(3, 0.8)], "comp_id int, confidence double"), spark.createDataFrame([(4,)], "comp_id int"), spark.createDataFrame([(2, "a")], "comp_id int, node_id string")
    args = ("one", 6, new, fixed, wrong, members)
    assert V.apply_delta(spark, root, *args)
    once = sorted(map(tuple, V.current(spark, root).collect()))
    fade = 0.3 * math.exp(-2 * 6 / 50) * (1 + 0.2 * math.log1p(1))
    want = [(1, "Event", "Stable", "Grounded", 0.9, 6), (2, "Event", "Candidate", "Observed", pytest.approx(fade), 0), (3, "Event", "Stable", "Observed", 0.8, 5), (4, "Event", "Stable", "Contradicted", pytest.approx(0.72), 5), (9, "Event", "Stable", "Observed", 0.6, 6)]
    assert once == want
    assert not V.apply_delta(spark, root, *args) and sorted(map(tuple, V.current(spark, root).collect())) == once
    assert V.manifest(spark, root)["deltas"] == ["one"]
    assert V.apply_delta(spark, root, "two", 7, new.limit(0), fixed.limit(0), wrong.limit(0), members) and V.manifest(spark, root)["deltas"] == ["one", "two"]


def test_a_lost_delta_starts_anew(spark, tmp_path, monkeypatch):
    root, schema = str(tmp_path / "graph"), "comp_id int, comp_type string, lifecycle string, epistemic string, confidence double, batch_seen long"
    V.start(spark.createDataFrame([(1, "Event", "New", "Observed", 0.5, 1)], schema), root)
    new, none = spark.createDataFrame([(2, "Event", "New", "Observed", 0.5, 1)], schema), spark.createDataFrame([], "comp_id int, confidence double, node_id string")
    with monkeypatch.context() as m:
        m.setattr(V, "_swap", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            V.apply_delta(spark, root, "d", 2, new, none, none, none)
    assert V.current(spark, root).count() == 1
    assert V.apply_delta(spark, root, "d", 2, new, none, none, none) and V.current(spark, root).count() == 2


def plain_clusters(vectors, least):
    label = {k: k for k in vectors}
    for a in vectors:
        for b in vectors:
            if a < b and cosine(vectors[a], vectors[b]) >= least:
                p, q = sorted((label[a], label[b]))
                label = {k: p if x == q else x for k, x in label.items()}
    return {k: x for k, x in label.items() if sum(y == x for y in label.values()) > 1}


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))


@pytest.mark.parametrize("block", [16 << 20, 400])
def test_clusters_and_pairs_are_those_of_all(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK_BYTES", block)
    rng = random.Random(4)
    vectors = {i: [rng.gauss(0, 1) for _ in range(5)] for i in range(70)}
    vectors |= {100 + i: [2 * x for x in vectors[3]] for i in range(20)}  # equal directions
    odd = [(900, None), (901, [0.0] * 5), (902, [1.0, None, 0.0, 0.0, 0.0]), (903, [float("nan")] * 5), (904, [])]
    df = spark.createDataFrame([*vectors.items(), *odd], "k long, v array<double>")
    got = {r.key: r.cluster for r in N.clusters(df, "k", "v", 0.85).collect()}
    assert got == plain_clusters(vectors, 0.85) and len(set(got.values())) > 2
    _, rows = N.unit(df, "k", "v")
    keys = {r.key for r in rows.collect()}
    pairs = {(r.a, r.b): r.cosine for r in N.close_pairs(rows, 0.85).collect()}
    want = {(a, b): cosine(vectors[a], vectors[b]) for a in keys for b in keys if a < b and cosine(vectors[a], vectors[b]) >= 0.85}
    assert pairs == pytest.approx(want)


def test_components_of_a_long_path(spark):
    n = 10_000
    edges = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    told = N.components(edges)
    assert told.select("component").distinct().collect()[0][0] == 0 and told.count() == n + 1


def test_second_hops_and_their_bonus(spark):
    at = lambda degrees: [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]
    vectors = {1: at(0), 2: at(20), 3: at(60), 4: at(62), 5: at(180)}
    df = spark.createDataFrame(list(vectors.items()), "k long, v array<double>")
    first = spark.createDataFrame([(7, 1, 0.9), (7, 3, 0.2)], "q long, key long, score double")
    got = {r.key: (r.score, r["rank"]) for r in N.retrieve(first, df, "k", "v", 5, 3, 0.05).collect()}
    second = round(math.cos(math.radians(20)), 6) * 0.9 * 0.8
    assert got[1] == (0.9, 1) and got[2] == (pytest.approx(second + 0.1), 2) and got[3] == (0.2, 4) and 5 not in got
    # 2 and 3 are 40 degrees apart, so all four are one cluster, and 4's bonus comes from hop 1
    assert got[4] == (pytest.approx(round(math.cos(math.radians(2)), 6) * 0.2 * 0.8 + 0.1), 3)


def test_clusters_and_close_pairs_in_tiles(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(8)
    vectors = {i: rng.normal(size=3).round(2).tolist() for i in range(70)}
    df = spark.createDataFrame(list(vectors.items()), "k long, v array<double>").repartition(3)
    monkeypatch.setattr(N, "TILE", 7)
    assert {r.key: r.cluster for r in N.clusters(df, "k", "v", 0.9).collect()} == plain_clusters(vectors, 0.9)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors.items()}
    want = {(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= 0.9}
    pairs = N.close_pairs(N.unit(df, "k", "v")[1], 0.9).collect()
    assert {(r.a, r.b) for r in pairs} == want and len(pairs) == len(want)


def test_traverse_reads_edges_and_nodes_once(spark):
    edges_read, nodes_read = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(read):
        def run(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        return run

    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string").coalesce(1).mapInArrow(counted(edges_read), "src string, dst string")
    schema = "node_id string, confidence double, inside boolean"
    nodes = spark.createDataFrame([("a", 1.0, True), ("b", 0.5, True), ("c", 0.5, False)], schema).coalesce(1).mapInArrow(counted(nodes_read), schema)
    got = S.traverse(edges, nodes, spark.createDataFrame([("a",)], "node_id string"), 2, "soft").collect()
    assert sorted((r.node_id, r.depth, round(r.confidence, 6)) for r in got) == [("a", 0, 1.0), ("b", 1, 0.5), ("c", 2, 0.15)]
    assert (edges_read.value, nodes_read.value) == (4, 3)
