"""Similarity joins, links, senses and calibration against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import aggregates as A
from weftgraph.operators import conversation as C
from weftgraph.operators import frames as M
from weftgraph.operators import graph as R
from weftgraph.operators import pairs as P
from weftgraph.operators import senses as N


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_jaccard_pairs_are_all_pairs(spark, least):
    rng = random.Random(1)
    sets = [(g, i, sorted({rng.choice("abcdefghij") for _ in range(rng.randint(0, 7))})) for g in (1, 2) for i in range(40)]
    rows = spark.createDataFrame(sets, "g int, key int, items array<string>")
    want = {(g, i, j, round(jaccard(x, y), 9)) for g, i, x in sets for h, j, y in sets if g == h and x and y and jaccard(x, y) >= least}
    assert {(r.g, r.a, r.b, round(r.overlap, 9)) for r in P.jaccard_pairs(rows.where(F.size("items") > 0), rows.where(F.size("items") > 0), "g", least).collect()} == want


def test_messages_link_to_earlier_ones(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["ann", "bob"]), sorted({rng.choice("abcdefgh") for _ in range(rng.randint(0, 5))})) for c in (1, 2) for t in range(25)]
    want = set()
    for c, t, who, x in rows:
        for d, u, other, y in rows:
            if c == d and u < t and x and y:
                want |= {(c, t, u, "semantic_link", round(jaccard(x, y), 6))} if jaccard(x, y) > 0.3 else set()
                want |= {(c, t, u, "elaboration", round(len(x) / len(y), 6))} if set(x) < set(y) and who == other else set()
    got = C.semantic_links(spark.createDataFrame(rows, "conv_id int, turn int, role string, atoms array<string>")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len({r.link for r in got}) == 2


def test_messages_of_a_long_conversation_meet_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 8)
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["ann", "bob"]), sorted({rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))})) for t in range(60)]
    want = {(t, u, "semantic_link") for _, t, _, x in rows for _, u, _, y in rows if u < t and jaccard(x, y) > 0.3}
    want |= {(t, u, "elaboration") for _, t, who, x in rows for _, u, other, y in rows if u < t and who == other and set(x) < set(y)}
    got = C.semantic_links(spark.createDataFrame(rows, "conv_id int, turn int, role string, atoms array<string>"))
    assert sorted((r.a, r.b, r.link) for r in got.collect()) == sorted(want)
    assert got._jdf.queryExecution().toString().count("explode(") == got._jdf.queryExecution().toString().count("explode(sequence")  # words aren't dealt out


def test_sets_that_parities_rule_out_never_meet(spark):
    rng = random.Random(7)
    sets = [(0, i, sorted(rng.sample([f"w{k}" for k in range(30)], 10))) for i in range(80)]
    sets += [(0, 100 + i, sorted({*s, "more"})) for i, (_, _, s) in enumerate(sets[:5])]
    rows = spark.createDataFrame(sets, "g int, key int, items array<string>")
    want = {(i, j) for _, i, x in sets for _, j, y in sets if jaccard(x, y) >= 0.8}
    met = {(r.a, r.b) for r in P.meeting(rows, rows, "g", 0.8).collect()}
    assert want <= met and len(met) < 1.2 * len(want)
    assert {(r.a, r.b) for r in P.class_pairs(rows, rows, "g", 0.8).collect()} == want


def test_the_more_confident_of_similar_rows_stays(spark):
    rows = spark.createDataFrame([(1, "a b c d e", 0.5), (2, "a b c d e", 0.9), (3, "A B C D E f", 0.9), (4, "", 0.1), (5, "x", 0.2), (6, "x", 0.2)], "id int, text string, c double")
    words = F.filter(F.split(F.lower("text"), " "), lambda w: w != "")
    assert {r.id for r in P.deduplicated(rows, "id", words, "c", 0.8).collect()} == {2, 4, 5}
    fresh = spark.createDataFrame([(1, "a b c d e g"), (2, "q r"), (3, "")], "id int, text string")
    assert {r.id for r in P.unlike(fresh, rows.select("id", "text"), "id", words, 0.8).collect()} == {2, 3}


def test_complementary_pairs(spark):
    sets = spark.createDataFrame([("g", 1, [1, 2]), ("g", 2, [3, 4]), ("g", 3, [2, 1]), ("g", 4, [1, 2, 3])], "g string, k int, e array<int>")
    got = {(r.a, r.b): r.score for r in P.complementary(sets, "g", "k", "e", F.array(*[F.lit(i) for i in range(1, 5)]), 0.5).collect()}
    assert got == {(1, 2): 1.0, (2, 3): 1.0, (2, 4): 0.75}


def test_senses(spark):
    members = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), *[(c, "busy") for c in range(3, 8)]], "comp_id int, node_id string")
    senses = spark.createDataFrame([("x", 1, "Fragile", 0.1), ("x", 2, "Mature", 0.1), ("y", 1, "Fragile", 0.3), ("lone", 1, "Fragile", 0.1), ("lone", 2, "Fragile", 0.2), ("lone", 3, "Tentative", 0.0)], "node_id string, sense int, grounding string, coherence double")
    penalty = {r.comp_id: r.penalty for r in N.coherence_penalty(members, senses).collect()}
    assert penalty[1] == pytest.approx(0.15 * (1 - 0.5 / 3), abs=1e-6) and penalty[2] == 0.0
    told = N.evidence(members, spark.createDataFrame([(1, True), (2, False)], "comp_id int, confirms boolean"))
    assert {(r.node_id, r.confirming, r.contradicting) for r in told.collect()} == {("x", 1, 0), ("y", 1, 0), ("z", 0, 1)}
    assert {(r.node_id, r.sense) for r in N.kept(senses, members, told).collect()} == {("x", 1), ("x", 2), ("y", 1), ("lone", 2), ("lone", 3)}


def test_calibration_takes_a_thousand_steps(spark):
    rng = random.Random(4)
    seen = [(rng.choice([0.1, 0.35, 0.5, 0.8]), int(rng.random() < 0.6)) for _ in range(40)]
    a, b = 1.0, 0.0
    for _ in range(1000):
        error = [(1 / (1 + math.exp(-(a * x + b))) - y, x) for x, y in seen]
        a, b = a - 0.01 * sum(e * x for e, x in error) / 40, b - 0.01 * sum(e for e, _ in error) / 40
    rows = spark.createDataFrame(seen, "p double, y int")
    got = {r.p: r.calibrated for r in A.platt(rows, "p", "y").collect()}
    assert got == pytest.approx({x: 1 / (1 + math.exp(-(a * x + b))) for x, _ in seen}, abs=1e-6)
    few = {r.p: r.calibrated for r in A.platt(rows.limit(9), "p", "y").collect()}
    assert all(c == pytest.approx(1 / (1 + math.exp(-p)), abs=1e-6) for p, c in few.items())


def test_meanings_of_frames(spark):
    rows = spark.createDataFrame([(1, "a", "b", "c", None, None, 0.8), (2, None, "b", "c", "if", "then", 0.5), (3, "a", None, "c", None, "x", 0.5)], "id int, agent string, patient string, cause string, antecedent string, consequent string, confidence double")
    assert {tuple(r) for r in M.derived(rows, ["id"]).collect()} == {(1, "problem_solution", "c", "b", "a", 0.68), (2, "condition_consequence", "if", "then", None, 0.45)}


def test_attention(spark):
    rows = [("c1", 0, "1", "A"), ("c1", 1, "2", "B"), ("c2", 0, "2", "A"), ("c2", 1, "3", "B"), ("c3", 0, "9", "A")]
    members = spark.createDataFrame([(*r, 0.9) for r in rows], "comp_id string, pos int, node_id string, role string, confidence double")
    one = lambda *xs: spark.createDataFrame([(x, 1.0) for x in xs], "node_id string, energy double")
    got = {r.target: r.score for r in R.attention(members, one("2", "9").select("node_id"), one("1", "3")).collect()}
    energy = {r.node_id: r.energy for r in R.spread(members, one("1", "3").select(F.lit("s").alias("seed"), "node_id", "energy")).collect()}
    assert got["2"] == pytest.approx(0.4 * energy["2"] + 0.4 * 1.0 + 0.2 * 1 / 3, abs=1e-6)
    assert got["9"] == pytest.approx(0.0)
    half = R.targeted_spread(members, one("1").select(F.lit("s").alias("seed"), "node_id", "energy", F.lit(0.0).alias("grounding")), 1)
    assert {r.node_id: r.energy for r in half.collect()} == {"1": 0.5, "2": 0.25}
