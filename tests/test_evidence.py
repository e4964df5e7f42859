"""What speaks for and against conclusions, by hand."""

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import evidence as E


def test_merged_activations_keep_the_greatest(spark):
    one, two = (spark.createDataFrame(rows, "node_id string, energy double") for rows in ([("a", 0.2), ("b", 0.9)], [("a", 0.5), ("c", 0.1)]))
    assert {(r.node_id, r.energy) for r in E.merged(one, two, one.limit(0)).collect()} == {("a", 0.5), ("b", 0.9), ("c", 0.1)}


def test_coherence_of_seeds(spark):
    members = spark.createDataFrame([(1, "a", "Agent"), (1, "b", "Patient"), (2, "b", "Agent"), (2, "c", "Agent"), (3, "d", "Agent")], "comp_id int, node_id string, role string")
    seeds = spark.createDataFrame([("pair", "a"), ("pair", "b"), ("mixed", "a"), ("mixed", "b"), ("mixed", "c"), ("mixed", "nowhere"), ("one", "a"), ("lost", "a"), ("lost", "nowhere"), ("same", "b"), ("same", "c"), ("apart", "a"), ("apart", "d"), ("one", "a")], "q string, node_id string")
    got = {r.q: r.coherence for r in E.role_coherence(members, seeds).collect()}
    assert got == {"pair": 1.0, "mixed": pytest.approx(1 / 3, abs=1e-6), "one": 1.0, "lost": 0.5, "same": 0.0, "apart": 0.0}
    assert E.role_coherence(members, seeds.limit(0)).count() == 0


def test_resolutions_of_conflicts(spark):
    comps = spark.createDataFrame([(1, 0.5, 3, "Corpus", "wiki"), (2, 0.5, 3, "Corpus", "news"), (3, 0.9, 4, "Corpus", "wiki"), (4, 0.5, 3, "Corpus", "wiki"), (5, 0.9, 2, "Corpus", "wiki")], "comp_id int, confidence double, batch_seen long, origin string, source string")
    base = [("Predicate", "p"), ("Agent", "x"), ("Patient", "y")]
    rows = [(c, i, n, r) for c in (1, 2) for i, (r, n) in enumerate(base)]
    rows += [(3, 0, "p", "Predicate"), (3, 1, "z", "Agent"), (3, 2, "y", "Patient"), (3, 3, "here", "Location"), (4, 0, "q", "Predicate"), (4, 1, "there", "Location"), (5, 0, "q", "Predicate")]
    members = spark.createDataFrame(rows, "comp_id int, pos int, node_id string, role string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 4), (3, 1), (4, 5), (1, 1)], "a int, b int")
    got = {(r.a, r.b): r.resolution for r in E.resolutions(pairs, comps, members).collect()}
    assert got == {(1, 2): "Misinterpretation", (1, 3): "Superseded", (3, 4): "ScopedValidity", (3, 1): None, (4, 5): None, (1, 1): None}


@pytest.mark.parametrize(
    ("given", "want"),
    [((0.5, 0.2, 0.0, 0, False), 0.5), ((0.5, 0.8, 0.0, 0, False), 0.62), ((0.95, 1.0, 0.0, 0, False), 1.0), ((0.5, 0.0, 0.4, 0, False), 0.4), ((0.5, 0.0, 0.0, 3, False), 0.56), ((0.5, 0.0, 0.0, 50, True), 0.51), ((0.5, 0.6, 0.5, 2, True), ((0.5 + 0.09) * 0.75 + 0.04) * 0.85)],
)
def test_confidence_in_the_light_of_the_graph(spark, given, want):
    told = spark.range(1).select(E.modulated(*[F.lit(x) for x in given]).alias("c")).first().c
    assert told == pytest.approx(want)


def test_related_nodes_and_their_overlap(spark):
    members = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "b"), (2, "c"), (3, "d")], "comp_id int, node_id string")
    asked = spark.createDataFrame([("a",), ("b",), ("d",), ("none",)], "q string")
    assert {tuple(r) for r in E.related(members, asked).collect()} == {("a", "b"), ("b", "a"), ("b", "c")}
    pairs = spark.createDataFrame([("a", "b"), ("a", "d"), ("d", "none")], "a string, b string")
    assert {(r.a, r.b): r.overlap for r in E.neighbourhood_overlap(members, pairs).collect()} == {("a", "b"): pytest.approx(2 / 3, abs=1e-6), ("a", "d"): 0.0, ("d", "none"): 0.0}
