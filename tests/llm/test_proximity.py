"""Proximity matches lie within the document of their rarest term."""

import random
from itertools import product

from weftgraph.llm import decontamination
from weftgraph.llm.common import Scratch


def test_matches_at_the_first_words_and_their_spans(spark):
    rows = [(1, "b a"), (2, "a a a"), (3, "b a c"), (4, "a x b"), (5, "a x x x x b"), (6, "c d"), (7, "d y y c y d"), (8, "e"), (9, "e e"), (10, "b x x a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).sortWithinPartitions("doc_id")
    scratch = Scratch(spark, "near-first")
    decontamination.build_index(docs, scratch.path("i"))
    items = spark.createDataFrame([("ab", "a b"), ("dc", "d c"), ("ee", "e e")], "item_id string, text string")
    found = lambda slop: {(r.doc_id, r.item_id): [tuple(s) for s in r.spans] for r in decontamination.search(spark, scratch.path("i"), decontamination.phrases(items), slop).collect()}
    assert found(0) == {(9, "ee"): [(0, 2)]}
    assert found(2) == {(1, "ab"): [(0, 2)], (3, "ab"): [(0, 2)], (4, "ab"): [(0, 3)], (6, "dc"): [(0, 2)], (7, "dc"): [(0, 4)], (9, "ee"): [(0, 2)]}


def plain_near(docs, phrase, slop):
    """Per document, the union of the shortest spans around each place of the rarest term, of all ways to place the others."""
    counts = [sum(w.count(t) for w in docs.values()) for t in phrase]
    rarest, found = counts.index(min(counts)), {}
    for d, w in docs.items():
        spans = []
        for at in [k for k, x in enumerate(w) if x == phrase[rarest]]:
            ways = [[at] if i == rarest else [k for k, x in enumerate(w) if x == t and abs(k - (at + i - rarest)) <= slop] for i, t in enumerate(phrase)]
            good = [p for p in product(*ways) if max(p) - min(p) < len(phrase) + slop and all(p[i] < p[j] for i in range(len(p)) for j in range(i + 1, len(p)) if phrase[i] == phrase[j])]
            if good:
                size = min(max(p) - min(p) for p in good)
                spans.append(max((min(p), max(p) + 1) for p in good if max(p) - min(p) == size))
        if spans:
            found[d] = decontamination.merge(spans)
    return found


def test_proximity_is_that_of_all_ways(spark, monkeypatch):
    rng = random.Random(8)
    docs = {i: [rng.choice("aabbcde") for _ in range(rng.randint(1, 14))] for i in range(40)}
    items = {"p1": "c d", "p2": "e a", "p3": "b c e", "p4": "c c", "p5": "d a d"}
    scratch = Scratch(spark, "near-all")
    decontamination.build_index(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string").coalesce(1).sortWithinPartitions("doc_id"), scratch.path("i"))
    tests = decontamination.phrases(spark.createDataFrame(list(items.items()), "item_id string, text string"))
    for slop, block in ((1, 200_000), (3, 2)):
        got = {(r.doc_id, r.item_id): [tuple(x) for x in r.spans] for r in decontamination.search(spark, scratch.path("i"), tests, slop, block).collect()}
        assert got == {(d, i): spans for i, t in items.items() for d, spans in plain_near(docs, t.split(), slop).items()}
