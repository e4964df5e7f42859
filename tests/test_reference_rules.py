"""Tables and rules with values worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import scores as S
from weftgraph.operators import acquisition as Q
from weftgraph.operators import governance as G
from weftgraph.operators import lookup as L
from weftgraph.operators import rules as U

MEMBERS = "comp_id int, pos int, node_id string, role string, confidence double"


@pytest.fixture(scope="module")
def graph(spark):
    comps = spark.createDataFrame([(1, "Event", "a"), (2, "HiddenMeaning", "a"), (3, "Pattern", "a"), (4, "Situation", "a"), (5, "Event", "a")], "comp_id int, comp_type string, origin string")
    rows = [(1, 0, "x", "Agent", 0.9), (1, 1, "y", "Patient", 0.5), (2, 0, "x", "PatternType", 0.9), (2, 1, "z", "Problem", 0.8), (3, 0, "u", "Antecedent", 0.4), (4, 0, "v", "Agent", 0.6), (4, 1, "w", "Cause", 0.9)]
    rows += [(5, 0, "x", "Predicate", 0.9), (5, 1, "y", "Agent", 0.9), (5, 2, "q", "Patient", 0.9)]
    return comps, spark.createDataFrame(rows, MEMBERS)


def test_changes(spark):
    pairs = [("New", "New", True), ("Stable", "Candidate", False), ("Deprecated", "Candidate", True), ("New", "Stable", False)]
    for a, b, ok in pairs:
        assert spark.range(1).select(U.may_change(U.LIFECYCLE_CHANGES, F.lit(a), F.lit(b)).alias("x")).first().x is ok
    assert spark.range(1).select(U.may_change(U.EPISTEMIC_CHANGES, F.lit("Contradicted"), F.lit("Grounded")).alias("x")).first().x is True
    assert spark.range(1).select(U.may_change(U.EPISTEMIC_CHANGES, F.lit("Grounded"), F.lit("Inferred")).alias("x")).first().x is False


def test_first_states_and_trust(spark):
    cases = [("Event", "FrameCompiler", "New", "Observed"), ("Acquisition", "HumanAssertion", "Stable", "Grounded"), ("Event", "HumanAssertion", "Candidate", "Grounded"), ("Situation", "PatternMining", "New", "Observed")]
    rows = spark.createDataFrame(cases, "t string, p string, a string, b string")
    assert rows.select(*[c == w for c, w in zip(S.initial_states(F.col("t"), F.col("p")), (F.col("a"), F.col("b")), strict=True)]).distinct().collect() == [(True, True)]
    told = spark.createDataFrame([("academic",), ("rumour",), (None,)], "s string").select(L.trust(F.col("s")).alias("x")).collect()
    assert [r.x for r in told] == [0.9, 0.5, 0.5]


def test_completeness_goes_by_type(graph):
    got = {r.comp_id: (r.complete, r.bonus) for r in G.completeness(*graph).collect()}
    assert got == {1: (False, 0.025), 2: (True, 0.033333), 3: (False, 0.016667), 4: (True, 0.05), 5: (True, 0.0375)}


def test_gaps_and_strategies(spark, graph):
    comps, members = graph
    gaps = Q.atom_gaps(comps, members)
    assert {tuple(r) for r in gaps.collect()} == {(1, "MissingCause", "Cause"), (1, "MissingPurpose", "Purpose"), (2, "IncompleteHiddenMeaning", "Solution"), (5, "MissingCause", "Cause"), (5, "MissingPurpose", "Purpose")}
    more = spark.createDataFrame([(3, "LowGrounding", None), (4, "UnresolvedContradiction", None), (3, "MissingRole", "Agent")], "comp_id int, gap string, role string")
    got = {(r.comp_id, r.gap): (r.strategy, r.candidate, r.gain, r.question) for r in Q.strategies(gaps.unionAll(more), comps, members, spark.createDataFrame([(1,)], "comp_id int")).collect()}
    assert got[1, "MissingCause"] == ("PassiveRecall", "w", 0.03, None)
    assert got[1, "MissingPurpose"] == ("ReExtraction", None, 0.15, None)
    assert got[5, "MissingPurpose"] == ("AskUser", None, 0.2, Q.QUESTIONS["MissingPurpose"])
    assert got[2, "IncompleteHiddenMeaning"][0] == "AskUser"
    assert got[3, "LowGrounding"] == ("Defer", None, 0.0, None)  # shares no node, and there is one origin
    assert got[3, "MissingRole"][1] == "v"  # of three that play it once


def test_candidates_skip_a_compositions_own_nodes(spark):
    rows = [(1, 0, "a", "Cause", 0.9), (2, 0, "a", "Cause", 0.9), (3, 0, "b", "Cause", 0.6), (4, 0, "a", "Agent", 0.5), (5, 0, "c", "Agent", 0.5)]
    members = spark.createDataFrame(rows, MEMBERS)
    gaps = spark.createDataFrame([(4, "MissingCause", "Cause"), (5, "MissingCause", "Cause")], "comp_id int, gap string, role string")
    got = {r.comp_id: (r.candidate, round(r.candidate_confidence, 6)) for r in Q.candidates(gaps, members).collect()}
    assert got == {4: ("b", 0.2), 5: ("a", 0.6)}


def test_graph_context_counts_others_once(spark):
    rows = [(1, 0, "a", "Agent", 1.0), (1, 1, "b", "Patient", 1.0), (2, 0, "a", "Agent", 0.5), (2, 1, "b", "Patient", 0.5), (2, 2, "c", "Patient", 0.5), (3, 0, "d", "Agent", 0.5), (4, 0, "b", "Agent", 0.5), (4, 1, "e", "Agent", 0.4)]
    members = spark.createDataFrame(rows, MEMBERS)
    got = {(r.role): (r.n, r.weight) for r in L.graph_context(members, spark.createDataFrame([(1,)], "comp_id int")).collect()}
    assert got == {"Agent": (2, pytest.approx(1.28)), "Patient": (2, pytest.approx(1.35))}


def test_of_members_in_one_place_the_least_is_a_candidate(spark):
    for order in (1, -1):
        rows = [(1, 4, "y", "Cause", 0.9), (1, 4, "x", "Cause", 0.8), (1, 4, "x", "Cause", 0.4)][::order]
        members = spark.createDataFrame([*rows, (2, 0, "q", "Agent", 1.0)], MEMBERS).coalesce(1)
        gaps = spark.createDataFrame([(2, "MissingCause", "Cause")], "comp_id int, gap string, role string")
        assert [(r.candidate, round(r.candidate_confidence, 6)) for r in Q.candidates(gaps, members).collect()] == [("x", round(0.4 / 3, 6))]


def test_graph_context_is_the_same_with_any_hubs(spark):
    rng = random.Random(5)
    rows = [(c, k, rng.choice("aaaabbcdefghijklmnop"), rng.choice(("Agent", "Patient", "Purpose")), rng.randrange(1, 100) / 100) for c in range(60) for k in range(rng.randrange(1, 6))]
    members, asked = spark.createDataFrame(rows, MEMBERS), list(range(0, 60, 7))
    nodes = {c: {r[2] for r in rows if r[0] == c} for c in range(60)}
    want = {}
    for c in asked:
        for o, _, node, role, w in rows:
            if o == c or (nodes[o] & nodes[c] and node not in nodes[c]):
                n, total = want.get((c, role), (0, 0.0))
                want[c, role] = n + 1, total + w * (1 if o == c else 0.7)
    for hub in (0, 3, 8, 20, 4096):
        found = L.graph_context(members, spark.createDataFrame([(c,) for c in asked], "comp_id int"), hub).collect()
        assert {(r.comp_id, r.role): (r.n, r.weight) for r in found} == {k: (n, pytest.approx(w, abs=1e-4)) for k, (n, w) in want.items()}


def test_overlap_findings_by_rarest_nodes(spark):
    comps = spark.createDataFrame([(i, "t") for i in range(1, 6)], "comp_id int, comp_type string")
    sets = {1: "abc", 2: "abd", 3: "a", 4: "bcxyz", 5: "q"}
    members = spark.createDataFrame([(i, k, n, "Patient", 1.0) for i, ns in sets.items() for k, n in enumerate(ns)], MEMBERS)
    want = {(a, b, len(set(sets[a]) & set(sets[b]))) for a in sets for b in sets if a < b and 2 * len(set(sets[a]) & set(sets[b])) > min(len(sets[a]), len(sets[b]))}
    assert {(r.a, r.b, r.shared) for r in U.overlap_findings(comps, members, "Patient").collect()} == want


def test_experience(spark):
    rows = spark.createDataFrame([("n", True, 0.9), ("n", True, 0.4), ("n", False, 0.6), ("m", False, 1.0), ("m", False, 1.0)], "node string, ok boolean, s double")
    got = {r.node: r.adjustment for r in U.adjustment(rows, "node", F.col("ok"), F.col("s")).collect()}
    assert got == {"n": -0.045, "m": -0.15}


def test_members_and_gaps_are_shuffled_once(spark):
    """What fills a gap is told from a table of compositions; neither members nor gaps are joined to it."""
    comps = spark.createDataFrame([(k, "Event", "Observed" if k else "Inferred", "Corpus", 0.1) for k in range(4)], "comp_id int, comp_type string, epistemic string, origin string, confidence double")
    members = spark.createDataFrame([(k, 0, "a", "Agent", 0.9) for k in range(3)] + [(1, 1, "x", "Patient", 0.5), (1, 2, "y", "Patient", 0.7), (2, 1, "x", "Patient", 0.4), (3, 0, "z", "Agent", 0.2)], "comp_id int, pos int, node_id string, role string, confidence double")
    told = Q.strategies(Q.atom_gaps(comps, members).unionAll(Q.grounding_gaps(comps)), comps, members, comps.where("comp_id = 2").select("comp_id"))
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning(comp_id" not in plan
    got = {(r.comp_id, r.gap, r.role): (r.strategy, r.candidate) for r in told.collect()}
    assert got[0, "MissingRole", "Patient"] == got[3, "MissingRole", "Patient"] == ("PassiveRecall", "x")
    assert got[0, "LowGrounding", None] == ("ReExtraction", None)  # shares a node
    assert got[2, "MissingCause", "Cause"] == ("ReExtraction", None) and got[1, "MissingCause", "Cause"] == ("AskUser", None)
    alone = Q.strategies(Q.grounding_gaps(comps), comps, members.where("comp_id IN (0, 3)"), comps.limit(0).select("comp_id")).collect()
    assert [(r.comp_id, r.strategy) for r in alone] == [(0, "Defer")]
