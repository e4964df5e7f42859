"""Frames of sentences and contradictions of events, worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import frames as M

KNOWN = M.Knowledge()


def told(spark, sentence, known=KNOWN):
    rows = spark.createDataFrame([(1, sentence)], "id int, s string")
    found = M.frames(rows, ["id"], F.split("s", " "), known).collect()
    return found[0].asDict() if found else None


@pytest.mark.parametrize(
    "sentence, want",
    [
        ("Raja memimpin kerajaan", {"predicate": "memimpin", "voice": "active", "negative": False, "agent": "raja", "patient": "kerajaan", "confidence": 0.6}),
        ("kerajaan dipimpin oleh raja", {"predicate": "dipimpin", "voice": "passive", "agent": "raja", "patient": "kerajaan", "confidence": 0.6}),
        ("dia tidak makan karena sakit perut", None),
        ("raja tidak membaca buku karena sakit perut", {"predicate": "membaca", "negative": True, "agent": None, "patient": "buku", "cause": "sakit perut", "confidence": 0.5}),
        ("ibu memasak untuk anak", {"agent": "ibu", "patient": None, "purpose": "anak", "confidence": 0.55}),
        ("hujan turun jika awan berkumpul", {"predicate": "berkumpul", "agent": "awan", "patient": None, "antecedent": "hujan turun", "consequent": "awan berkumpul", "confidence": 0.65}),
        ("membaca membaca membaca", None),
        ("kucing ada", None),
        ("buku ini dibaca karena", {"voice": "passive", "predicate": "dibaca", "patient": "ini", "agent": None, "cause": None, "confidence": 0.45}),
    ],
)
def test_frames(spark, sentence, want):
    got = told(spark, sentence)
    assert got is None if want is None else {k: got[k] for k in want} == want


def test_what_is_taught_counts(spark):
    assert told(spark, "the cat sees mice") is None
    got = told(spark, "the cat sees mice because hungry", KNOWN.taught(common_verb=("Sees",), cause=("because",)))
    assert (got["agent"], got["patient"], got["cause"]) == ("cat", "mice", "hungry")
    with pytest.raises(ValueError):
        KNOWN.taught(colour=("red",))


def test_contradictions_are_those_of_all_pairs(spark):
    rng = random.Random(2)
    pick = lambda *xs: rng.choice(xs)
    events = [(pick("p", "q"), pick("a", "b", "c", None), pick("a", "b", None), pick(None, "x", "not x", "y"), pick(None, None, "u", "v")) for _ in range(150)]
    want: dict = {}
    denied = lambda c: c is not None and "not" in c
    for i, x in enumerate(events):
        for y in events[i + 1 :]:
            (p, a, t, c, u), (p2, a2, t2, c2, u2) = x, y
            if p != p2 or a is None or a2 is None:
                continue
            kind = None
            if a == a2 and (denied(c) != denied(c2) or (c and c2 and c != c2)):
                kind = "Polarity"
            elif t and t2 and a == t2 and t == a2:
                kind = "RoleReversal"
            elif a == a2 and u and u2 and u != u2:
                kind = "Purpose"
            if kind:
                want[p, kind] = want.get((p, kind), 0) + 1
    rows = spark.createDataFrame(events, "predicate string, agent string, patient string, cause string, purpose string")
    got = M.contradictions(rows).groupBy("predicate", "kind").agg(F.sum("pairs").alias("n")).collect()
    assert {(r.predicate, r.kind): r.n for r in got} == want and len(want) == 6


def test_sentences_without_a_marker_have_no_meaning_and_are_left_out_before_frames(spark):
    known = M.Knowledge()
    said = ["dia makan karena lapar", "jika hujan maka dia membawa payung", "dia makan nasi", "sebabnya dia makan nasi", "DIA memukul bola\tKARENA marah", "karenaa jikalauu ada itu"]
    rows = spark.createDataFrame(list(enumerate(said)), "id int, s string")
    words = F.regexp_extract_all("s", F.lit(r"[^ \t\r\n]+"), 0)
    kept = rows.where(M.marked(F.col("s"), known))
    assert {r.id for r in kept.collect()} == {0, 1, 4}
    told = lambda some: sorted(map(tuple, M.derived(M.frames(some, ["id"], words, known), ["id"]).collect()))
    assert told(kept) == told(rows) != []
