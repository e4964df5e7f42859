"""Golden graphs with values worked out by hand from the formulas."""

import math

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import scores as S
from weftgraph.operators import conversation as C
from weftgraph.operators import governance as G
from weftgraph.operators import graph as R
from weftgraph.operators import lookup as L
from weftgraph.operators import pairs as P
from weftgraph.operators import temporal as T
from weftgraph.operators import text as X


@pytest.fixture(scope="module")
def path(spark):
    rows = [("c1", 0, "1", "Agent"), ("c1", 1, "2", "Patient"), ("c2", 0, "2", "Agent"), ("c2", 1, "3", "Patient"), ("c3", 0, "3", "Agent"), ("c3", 1, "4", "Patient")]
    return spark.createDataFrame([(*r, 0.9) for r in rows], "comp_id string, pos int, node_id string, role string, confidence double")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def spread(spark, path, *seeds):
    return R.spread(path, spark.createDataFrame([(s, s, 1.0) for s in seeds], "seed string, node_id string, energy double"))


def test_spread(spark, path):
    got = {r.node_id: r.energy for r in spread(spark, path, "1").collect()}
    assert got == pytest.approx({"1": 1.1015625, "2": 0.69921875, "3": 0.1640625, "4": 0.015625})
    got = {r.node_id: r.energy for r in spread(spark, path, "2").collect()}
    assert got == pytest.approx({"1": 0.6953125, "2": 1.203125, "3": 0.703125, "4": 0.1640625})




def test_similarity(spark, path):
    pairs = spark.createDataFrame([("1", "2"), ("1", "1")], "a string, b string")
    got = {(r.a, r.b): r.similarity for r in R.similarity(path, spread(spark, path, "1", "2"), pairs).collect()}
    assert got == pytest.approx({("1", "2"): 0.635064, ("1", "1"): 1.0})


def test_bridges(spark, path):
    got = {r.comp_id: r.score for r in R.bridges(path, spread(spark, path, "1", "4"), "1", "4").collect()}
    assert got == pytest.approx({"c2": 0.263951, "c1": 0.308162, "c3": 0.308162}, abs=1) and set(got) == {"c1", "c2", "c3"}
    assert got["c1"] == got["c3"]


def test_typed_spread(spark):
    edges = spark.createDataFrame([("A", "B", "CATEGORICAL", 0.9), ("B", "C", "CAUSAL", 0.8)], "src string, dst string, relation string, confidence double")
    seeds = spark.createDataFrame([("A", 0.5)], "node_id string, energy double")
    got = {r.node_id: r.energy for r in R.typed_spread(edges, seeds).collect()}
    assert got == pytest.approx({"A": 0.5, "B": 0.81, "C": 0.2268})


def test_message_pass(spark):
    edges = spark.createDataFrame([("x", "t", "CATEGORICAL", 0.9), ("y", "t", "DIFFERENTIAL", 0.5)], "src string, dst string, relation string, confidence double")
    vectors = spark.createDataFrame([("t", [0.0, 1.0]), ("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "node_id string, embedding array<double>")
    got = {r.node_id: r.embedding for r in R.message_pass(edges, vectors).collect()}
    mean = [0.9 / 1.3, -0.4 / 1.3]  # 1.0 * 0.9 and -0.8 * 0.5
    want = [0.5 * mean[0], 0.5 + 0.5 * mean[1]]
    assert got["t"] == pytest.approx([w / math.hypot(*want) for w in want])
    assert got["x"] == pytest.approx([1.0, 0.0])


def test_reach_and_beam(spark):
    edges = spark.createDataFrame([("a", "b", "CATEGORICAL", 1.0), ("b", "c", "CATEGORICAL", 1.0), ("c", "a", "CATEGORICAL", 1.0), ("a", "d", "CAUSAL", 0.5)], "src string, dst string, relation string, confidence double")
    seeds = spark.createDataFrame([("a",)], "node_id string")
    assert {(r.node_id, r.hops) for r in R.reach(edges, seeds, 3).collect()} == {("a", 0), ("b", 1), ("d", 1), ("c", 2)}
    assert R.beam(edges, seeds).collect()[0].path == "a>b>c"


def test_scores(spark):
    assert one(spark, S.decay_factor(F.lit(10), F.lit(3))) == pytest.approx(0.8561722260)
    assert one(spark, S.decay_factor(F.lit(0), F.lit(2))) == pytest.approx(1.2197224577)
    entries = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    assert one(spark, S.weighted_jaccard(entries({"a": 1.0, "b": 2.0, "c": 1.0}), entries({"a": 3.0, "b": 2.0, "d": 4.0}))) == pytest.approx(0.3)
    assert one(spark, S.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>"))) == 1.0
    assert one(spark, S.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0.0
    assert one(spark, S.complementarity(F.array(F.lit(1)), F.array(F.lit(2)), F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)))) == 0.5
    assert one(spark, F.to_json(F.struct(S.fitted(F.array(F.lit(3.0), F.lit(4.0)), 3).alias("v")))) == '{"v":[0.6,0.8,0.0]}'
    assert one(spark, S.logistic(F.lit(1e9))) == 1.0
    heads = {("Stable", "Grounded", 0.9): "", ("Stable", "Grounded", 0.8): "Tampaknya, ", ("Candidate", "Inferred", 0.9): "Berdasarkan analisis, ", ("New", "Observed", 0.1): "Berdasarkan observasi, ", ("Deprecated", "Hypothesis", 0.5): "Kemungkinan besar, "}
    heads |= {("Quarantine", "Contradicted", 0.5): "Meskipun ada kontradiksi, ", ("Quarantine", "Inferred", 0.5): "Perlu ditinjau kembali, ", ("Deprecated", "Grounded", 0.9): "Sebelumnya diyakini, ", ("New", "Inferred", 0.9): "Kemungkinan, "}
    for (a, b, c), head in heads.items():
        assert one(spark, S.qualified(F.lit("x"), F.lit(a), F.lit(b), F.lit(c))) == head + "x"
    assert [one(spark, S.tnorm(k, F.lit(0.7), F.lit(0.7))) for k in ("product", "lukasiewicz", "godel")] == pytest.approx([0.49, 0.4, 0.7])


def test_deductions_are_of_neighbours_alone(spark):
    schema = "chain int, pos int, src string, dst string, relation string, weight double"
    rows = [(1, 0, "A", "B", "CAUSAL", 0.7), (1, 1, "B", "C", "CAUSAL", 0.7), (2, 0, "A", "B", "CAUSAL", 0.7), (2, 1, "X", "Y", "CAUSAL", 0.7), (2, 2, "B", "C", "CAUSAL", 0.7)]
    got = P.deductions(spark.createDataFrame(rows, schema), "chain", ["pos"]).collect()
    assert [(r.chain, r.source, r.target, r.product, r.lukasiewicz, r.godel) for r in got] == [(1, "A", "C", 0.49, 0.4, 0.7)]


def test_temporal_overlaps_come_once(spark):
    spans = spark.createDataFrame([(1, 0.0, 100.0), (2, 90.0, 5000.0), (3, 5100.0, 5200.0), (4, 0.0, 9.0), (5, 9.0, 9.0)], "k int, first double, last double")
    for tolerance, want in ((0, {(1, 2), (1, 4), (1, 5), (4, 5)}), (60, {(1, 2), (1, 4), (1, 5), (4, 5), (2, 3), (2, 4), (2, 5)})):
        got = [(r.a, r.b) for r in T.overlaps(spans.where("k <> 3"), spans, "k", tolerance, 60).collect()]
        both = want | {(b, a) for a, b in want}
        assert sorted(got) == sorted((a, b) for a, b in both if a != 3)
        counts = {r.k: r.n for r in T.overlap_counts(spans, "k", tolerance).collect()}
        assert counts == {k: sum(a == k for a, _ in both) for k in range(1, 6)}


def test_associates_are_the_best_of_all(spark):
    import random

    rng = random.Random(5)
    sets = {i: sorted({rng.choice("aabbbcdefgh") for _ in range(rng.randint(0, 5))}) for i in range(60)}
    rows = spark.createDataFrame(list(sets.items()), "id int, k array<string>")
    want = set()
    for a in sets:
        found = sorted((-len(set(sets[a]) & set(sets[b])), b) for b in sets if b != a and set(sets[a]) & set(sets[b]))[:3]
        want |= {(a, b, -n, i + 1) for i, (n, b) in enumerate(found)}
    assert {(r.a, r.b, r.n, r["rank"]) for r in P.autoassociate(rows, "id", "k", 3).collect()} == want


def test_retrieval_is_exact_with_few_words_tried(spark):
    import random

    rng = random.Random(6)
    words = lambda n: [rng.choice("abcdefghijkl") * rng.choice([1, 1, 1, 2]) for _ in range(n)]
    docs = [(i, words(rng.randint(1, 9)), rng.randint(0, 9) / 10) for i in range(80)]
    asked = [(q, words(rng.randint(1, 8))) for q in range(15)] + [(99, ["zz"])]
    rows = spark.createDataFrame(docs, "id int, w array<string>, c double")
    want = set()
    for q, w in asked:
        scored = sorted((-(len(set(w) & set(d)) / len(set(w)) * c), -c, i) for i, d, c in docs if set(w) & set(d))[:3]
        want |= {(q, k + 1, i, round(-s, 6)) for k, (s, _, i) in enumerate(scored)}
    for first in (1, 4):
        got = P.keyword_retrieve(rows, "id", F.col("w"), F.col("c"), spark.createDataFrame(asked, "q int, words array<string>"), 3, first)
        assert {(r.q, r["rank"], r.id, r.score) for r in got.collect()} == want


def test_running_sums_go_on_over_ranges(spark):
    rows = spark.createDataFrame([(c, 0) for c in range(50) for _ in range(c % 3 + 1)], "conv_id int, turn int")
    got = {r.conv_id: r.kept for r in C.newest_messages(rows, 20).collect()}
    left, want = 20, {}
    for c in range(49, -1, -1):
        want[c] = min(left, c % 3 + 1)
        left -= want[c]
    assert got == want


def test_structure_search_drops_unknown_roles(spark, path):
    comps = spark.createDataFrame([("c1", 0.5), ("c2", 0.4), ("c3", 0.3)], "comp_id string, confidence double")
    assert {r.comp_id for r in L.by_structure(comps, path, ["agent", "patient", "nonsense"]).collect()} == {"c1", "c2", "c3"}
    assert L.by_structure(comps, path, ["nonsense"]).collect() == []


def test_isolated(spark, path):
    lone = path.unionByName(spark.createDataFrame([("c9", 0, "77", "Agent", 0.5)], path.schema))
    comps = lone.select("comp_id").distinct()
    assert [r.comp_id for r in G.isolated(comps, lone).collect()] == ["c9"]


def test_topic_shift_skips_messages_without_words(spark):
    rows = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, []), (1, 2, ["a"]), (1, 3, ["c"])], "conv_id int, turn int, atoms array<string>")
    got = {r.turn: (r.overlap, r.shift) for r in C.topic_shifts(rows).collect()}
    assert got == {2: (0.5, False), 3: (0.0, True)}


def test_words_and_numbers(spark):
    assert one(spark, X.reduplicated(F.lit("kira-kira"))) == "kira"
    assert one(spark, X.reduplicated(F.lit("kira-kari"))) is None
    assert [one(spark, X.number(F.lit(t))) for t in ("about 3.5 k of it", "12%", "none")] == [3500.0, 0.12, None]


def test_reach_reads_the_edges_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")], "src string, dst string").coalesce(1).mapInArrow(counted, "src string, dst string")
    got = R.reach(edges, spark.createDataFrame([("a",)], "node_id string"), 3).collect()
    assert sorted((r.node_id, r.hops) for r in got) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)] and read.value == 5


def test_isolated_reads_the_members_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [("c1", "a"), ("c1", "b"), ("c2", "b"), ("c3", "d"), ("c3", "d"), ("c3", "e"), ("c4", "f"), ("c4", "b")]
    members = spark.createDataFrame(rows, "comp_id string, node_id string").coalesce(1).mapInArrow(counted, "comp_id string, node_id string")
    sizes = spark.createDataFrame([("c1", 2), ("c2", 1), ("c3", 2), ("c4", 2), ("c5", 0)], "comp_id string, size long")
    assert sorted(r.comp_id for r in G.isolated_of(sizes, members).collect()) == ["c3", "c5"] and read.value == 8
    assert sorted(r.comp_id for r in G.isolated(sizes.select("comp_id"), members).collect()) == ["c3", "c5"]


def test_spreading_goes_by_blocks_and_leaves_what_was_told_alone(spark, path):
    import os

    from weftgraph.sources.scratch import shared_folder

    folder, blocks = shared_folder(spark).removeprefix("file:"), []
    seeds = spark.createDataFrame([(f"{n}-{k}", str(n), 1.0) for n in range(1, 5) for k in range(R.LANES // 4 + 1)], "seed string, node_id string, energy double")
    before = set(os.listdir(folder))

    def told(energies, names):
        blocks.append(names.count())
        return R.listed(energies, names).where("node_id = '1'")

    got = {r.seed: r.energy for r in R.spread(path, seeds, told=told).collect()}
    assert blocks == [R.LANES, 4] and {name.split("-")[0] for name in set(os.listdir(folder)) - before} == {"activations"}
    want = {"1": 1.1015625, "2": 0.6953125, "3": 0.1640625, "4": 0.015625}
    assert len(got) == R.LANES + 4 and all(got[s] == pytest.approx(want[s[0]]) for s in got)


def test_similarity_by_blocks_of_pairs(spark, path):
    pairs = spark.createDataFrame([("1", "2"), ("2", "3"), ("3", "4"), ("1", "1")], "a string, b string")
    seeds = spark.createDataFrame([(s, s, 1.0) for s in "1234"], "seed string, node_id string, energy double")
    want = {(r.a, r.b): r.similarity for r in R.similarity(path, R.spread(path, seeds), pairs).collect()}
    assert {(r.a, r.b): r.similarity for r in R.blended(path, seeds, pairs).collect()} == pytest.approx(want) and len(want) == 4


def test_a_small_graph_is_spread_without_shuffled_energies(spark, path, monkeypatch):
    """A block's energies come out of one task in all hops; the same as over several shards."""
    double = path.unionByName(path.where("node_id = '3'").withColumn("pos", F.lit(9)))  # two roles in a composition
    seeds = spark.createDataFrame([(s, s, 1.0) for s in "1234"] + [("none", "none", 1.0)], "seed string, node_id string, energy double")
    plans = []

    def told(energies, names):
        plans.append(energies._jdf.queryExecution().executedPlan().toString())
        return R.listed(energies, names)

    rows = lambda df: {tuple(r) for r in df.collect()}
    got = rows(R.spread(double, seeds, told=told))
    sums, most = R.spread(double, seeds, told=R.totals), R.spread(double, seeds, told=lambda e, n: R.strongest(e, n, 1))
    assert len(plans) == 1 and "Exchange" not in plans[0]
    monkeypatch.setattr(R, "WHOLE", 0)
    assert got == rows(R.spread(double, seeds)) and len(got) == 17
    assert rows(sums) == {(s, len(e), sum(e), max(e)) for s in {r[0] for r in got} for e in [[r[2] for r in got if r[0] == s]]}
    assert {(r.seed, r.energy) for r in most.collect()} >= {(s, max(r[2] for r in got if r[0] == s)) for s in {r[0] for r in got}}


def test_long_spans_are_not_dealt_to_buckets(spark, monkeypatch):
    """Spans stay where they are, and each is one row however long it is; batches of pairs and blocks of asked spans may be small."""
    import random

    rng = random.Random(8)
    rows = [(i, a, a + rng.choice([0.0, 1.0, 30.0, 1e9])) for i in range(60) for a in [float(rng.randrange(100))]]
    spans = spark.createDataFrame(rows, "k int, first double, last double")
    want = sorted((i, j) for i, a, b in rows for j, c, d in rows if i % 3 == 0 and i != j and a - 2 <= d + 2 and c - 2 <= b + 2)
    for asked, pairs in ((T.ASKED, T.PAIRS), (7, 5)):
        monkeypatch.setattr(T, "ASKED", asked)
        monkeypatch.setattr(T, "PAIRS", pairs)
        got = T.overlaps(spans.where("k % 3 = 0"), spans, "k", 2)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Generate" not in plan
        assert sorted((r.a, r.b) for r in got.collect()) == want
