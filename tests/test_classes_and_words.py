"""Survivors, counts by complement, stems, senses in context and schemas, by hand and against plain loops."""

import inspect
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import contexts as C
from weftgraph.operators import convergence as V
from weftgraph.operators import frames as M
from weftgraph.operators import graph as R
from weftgraph.operators import morphology as W
from weftgraph.operators import pairs as P
from weftgraph.operators.rules import substitutable, substitutable_pairs
from weftgraph.plans import rule_queries


def greedy(order, pairs):
    stay = []
    for x in order:
        if not any((y, x) in pairs or (x, y) in pairs for y in stay):
            stay.append(x)
    return set(stay)


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(15)], list(combinations(range(8), 2)), [(0, 5), (1, 5), (5, 9), (9, 10), (2, 3)], []])
def test_survivors_are_those_of_the_loop(spark, edges):
    nodes = set(range(20))
    rivals = spark.createDataFrame(edges, "a int, b int")
    gone = [r.node for r in P.rivals_gone(rivals, 9).collect()]
    assert nodes - set(gone) == greedy(sorted(nodes), set(edges)) and len(gone) == len(set(gone))


def test_survivors_of_random_graphs_and_a_bound_on_rounds(spark):
    rng = random.Random(2)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(120)}
    gone = {r.node for r in P.rivals_gone(spark.createDataFrame(sorted(edges), "a int, b int")).collect()}
    assert set(range(60)) - gone == greedy(range(60), edges)
    chain = spark.createDataFrame([(i, i + 1) for i in range(7)], "a int, b int")
    assert len(P.rivals_gone(chain, 4).collect()) == 4
    with pytest.raises(RuntimeError):
        P.rivals_gone(chain, 2)


def test_a_row_like_one_that_goes_stays(spark):
    a, b, c = (" ".join(f"w{i}" for i in range(k, k + 20)) for k in (0, 2, 4))  # a like b, b like c, a unlike c
    rows = spark.createDataFrame([(1, a, 0.9), (2, b, 0.8), (3, c, 0.7), *[(10 + i, a, 0.1) for i in range(500)], (4, "long " * 17 + "one", 0.5), (7, "long " * 17 + "two three four", 0.4), (5, "", 0.3), (6, "  ", 0.2)], "id int, text string, c double")
    words = F.filter(F.split("text", " "), lambda w: w != "")
    assert {r.id for r in P.deduplicated(rows, "id", words, "c", 0.8).collect()} == {1, 3, 4, 5, 6, 7}
    signature = F.trim(F.lower(F.substring("text", 1, 80)))
    assert {r.id for r in P.deduplicated(rows, "id", words, "c", 0.8, signature).collect()} == {1, 3, 4, 5}


def test_equal_sets_meet_as_one(spark):
    many = spark.range(200_000).select(F.col("id").cast("int").alias("id"), F.lit("ok thanks").alias("text"), F.lit(0.5).alias("c"))
    assert [r.id for r in P.deduplicated(many, "id", F.split("text", " "), "c", 0.8).collect()] == [0]
    assert P.unlike(many, many.limit(3), "id", F.split("text", " "), 0.8).count() == 0
    rows = spark.createDataFrame([(1, k, i) for k, s in enumerate(["abc", "abc", "ab", "xyz", "xy", "abc"]) for i in s], "g int, k int, i string")
    want = {(a, b) for a, b in combinations(range(6), 2) if len(set(s := ["abc", "abc", "ab", "xyz", "xy", "abc"][a]) & set(["abc", "abc", "ab", "xyz", "xy", "abc"][b])) * 2 > min(len(s), len(["abc", "abc", "ab", "xyz", "xy", "abc"][b]))}
    got = [(r.a, r.b) for r in P.over_half(rows, "g", "k", "i").collect()]
    assert set(got) == want and len(got) == len(want)


def test_contradictions_are_counted_as_listed(spark):
    rng = random.Random(5)
    pick = lambda *xs: rng.choice(xs)
    rows = [(pick("p", "q"), pick("a", "b", "c", None), pick("a", "b", None), pick("rain", "not rain", "sun", None), pick("u", "v", None)) for _ in range(220)]
    events = spark.createDataFrame(rows, "predicate string, agent string, patient string, cause string, purpose string")
    listed = {(r.predicate, r.kind): r.n for r in M.contradictions(events).groupBy("predicate", "kind").agg(F.sum("pairs").alias("n")).collect()}
    assert {(r.predicate, r.kind): r.pairs for r in M.contradiction_counts(events).collect()} == listed and len(listed) == 6


def graph(seed, n):
    rng = random.Random(seed)
    kinds = ("Pattern", "HiddenMeaning", "Situation", "Event")
    comps = [(i, rng.choice(kinds), rng.choice([0.1, 0.5, 0.9]), rng.choice(["Stable", "New", "Deprecated"])) for i in range(n)]
    roles = ("Problem", "Solution", "Predicate", "Agent")
    members = []
    for i, *_ in comps:
        pos = 0
        for role in roles:
            for _ in range(rng.choice([0, 1, 1, 1, 2])):
                members.append((i, pos, rng.choice("uvwxyz"), role))
                pos += 1
    return comps, members


@pytest.mark.parametrize("seed", [1, 2])
def test_convergence_is_that_of_all_pairs(spark, seed):
    comps, members = graph(seed, 90)
    nodes, roles = {}, {}
    for i, _, node, role in members:
        nodes.setdefault(i, set()).add(node)
        roles.setdefault(i, set()).add(role)
    good = [(i, t) for i, t, c, life in comps if c >= 0.3 and life != "Deprecated" and i in nodes]
    links, close = {}, {}
    for (a, t), (b, u) in combinations(good, 2):
        if t != u:
            continue
        key = (t, *sorted((",".join(sorted(roles[a])), ",".join(sorted(roles[b])))))
        shared = len(nodes[a] & nodes[b])
        if shared > 2:
            if key[1] == key[2]:
                close[key] = close.get(key, 0) + 1
            continue
        score = 0.6 * len(roles[a] & roles[b]) / len(roles[a] | roles[b]) + 0.4 * shared / len(nodes[a] | nodes[b])
        if score >= 0.6 - 1e-9:
            links.setdefault(key, []).append((a, b))
    c = spark.createDataFrame(comps, "comp_id int, comp_type string, confidence double, lifecycle string")
    m = spark.createDataFrame(members, "comp_id int, pos int, node_id string, role string")
    got = V.convergence(c, m).collect()
    assert {(r.comp_type, r.roles_a, r.roles_b): (r.links, r.too_close) for r in got} == {k: (len(links.get(k, [])), close.get(k, 0)) for k in links.keys() | close.keys()}
    assert all((r.a, r.b) in links[r.comp_type, r.roles_a, r.roles_b] for r in got if r.links and r.b is not None)
    assert any(r.roles_a != r.roles_b for r in got)


@pytest.mark.parametrize("seed", [3, 4])
def test_mismatches_are_those_of_all_pairs(spark, seed):
    comps, members = graph(seed, 120)
    of = {}
    for i, _, node, role in members:
        of.setdefault(i, []).append((role, node))
    first = lambda i, role: next((n for r, n in of[i] if r == role), None)
    want = {}
    for (a, t, *_), (b, u, *_) in combinations([c for c in comps if c[0] in of], 2):
        ra, rb = ({r for r, _ in of[x]} for x in (a, b))
        if t != u or t == "Event" or ra != rb:
            continue
        if t == "HiddenMeaning":
            bad = first(a, "Problem") is not None and first(a, "Problem") == first(b, "Problem") and None not in (first(a, "Solution"), first(b, "Solution")) and first(a, "Solution") != first(b, "Solution")
        else:
            bad = any(r != "Predicate" and n != first(b, r) for r, n in of[a])
        key = t, ",".join(sorted(ra))
        pairs, n = want.get(key, (0, 0))
        want[key] = pairs + 1, n + bad
    c = spark.createDataFrame(comps, "comp_id int, comp_type string, confidence double, lifecycle string")
    m = spark.createDataFrame(members, "comp_id int, pos int, node_id string, role string")
    assert {(r.comp_type, r.roles): (r.pairs, r.mismatches) for r in V.equivalence_mismatches(c, m).where("pairs > 0").collect()} == want


def test_overlap_of_roles_and_nodes(spark):
    m = spark.createDataFrame([(1, "x", "A"), (1, "y", "B"), (2, "x", "A"), (2, "y", "C"), (2, "z", "B")], "comp_id int, node_id string, role string")
    got = V.role_aware(m, spark.createDataFrame([(1, 2), (1, 9), (8, 9)], "a int, b int")).collect()
    assert {(r.a, r.b): r.similarity for r in got} == {(1, 2): 0.25, (1, 9): 0.0, (8, 9): 1.0}


GOLDEN = {
    "mengambil": "ambil", "menggambar": "gambar", "menghitung": "hitung", "menyapu": "sapu", "membuat": "buat", "mencari": "cari", "mendengar": "dengar", "melihat": "lihat", "berjalan": "jalan", "berlari": "lari", "dilihat": "lihat",
    "dibuat": "buat", "terlihat": "lihat", "jualan": "jual", "beri": None, "kata-kata": "kata", "buku-buku": "buku", "makan": None, "minum": None, "raja": None, "di": None, "ke": None, "ada": None, "Membuat": "buat", "berjalan-jalan": "jal",
}


def test_stems_of_known_words(spark):
    got = {r.word: r for r in W.stems(spark.createDataFrame([(w,) for w in GOLDEN], "word string"), "word").collect()}
    assert {w: got[w].root if w in got else None for w in GOLDEN if w != "berjalan-jalan"} == {w: r for w, r in GOLDEN.items() if w != "berjalan-jalan"}
    assert (got["membuat"].prefix, got["membuat"].archimorpheme, got["membuat"].suffix) == ("mem", "meN", None)
    assert got["jualan"].suffix == "an" and W.Morphology().forms("meN") == ["meng", "meny", "mem", "men", "me"]
    taught = W.Morphology().taught(roots=("walk",), suffixes=("ing",), allomorphs=(("im", "in", ""), ("ny", "N", "s")))
    more = {r.word: (r.root, r.archimorpheme) for r in W.stems(spark.createDataFrame([("walking",), ("impossible",), ("nyapu",)], "word string"), "word", taught).collect()}
    assert more == {"walking": ("walk", None), "impossible": ("possible", "in"), "nyapu": ("sapu", "N")}


def test_senses_in_context(spark):
    members = spark.createDataFrame([(1, "river"), (1, "water"), (2, "money"), (2, "loan"), (3, "water"), (3, "boat")], "comp_id int, node_id string")
    senses = spark.createDataFrame([("bank", "bank1", "noun", ["water", "boat"]), ("bank", "bank2", "noun", ["money", "loan"]), ("bisa", "venom", "noun", ["snake"]), ("bisa", "able", "verb", ["can"]), ("one", "one1", "noun", ["x"]), ("odd", "odd1", "noun", ["moon", "star"]), ("odd", "odd2", "noun", ["sun", "sea"])], "word string, sense string, pos string, labels array<string>")
    asked = spark.createDataFrame([(1, "bank", ["river"]), (2, "bank", ["loan"]), (3, "bank", []), (4, "bisa", ["tidak", "dia"]), (5, "bisa", ["ini"]), (6, "one", []), (7, "odd", ["Sun", "river"]), (8, "bank", ["river"])], "id int, word string, context array<string>")
    got = {r.id: r for r in C.disambiguate(asked, senses, members).collect()}
    act = {r.node_id: r.energy for r in R.spread(members, spark.createDataFrame([("s", "river", 1.0)], "seed string, node_id string, energy double")).collect()}
    want = act["water"] + act.get("boat", 0)
    assert got[1].sense == "bank1" and got[1].score == pytest.approx(want) and got[1].confidence == pytest.approx(1.0)
    assert got[2].sense == "bank2" and got[3].sense is None and got[3].confidence == 0.0
    assert (got[4].sense, got[4].confidence) == ("able", 0.9) and (got[5].sense, got[5].confidence) == ("venom", 0.9) and (got[6].sense, got[6].confidence) == ("one1", 1.0)
    assert got[7].sense == "odd2" and got[7].score == pytest.approx(0.5 / 3) and (got[8].sense, got[8].score) == (got[1].sense, got[1].score)


def test_schemas_bind_roles(spark):
    rows = spark.createDataFrame([(1, "ini adalah makanan"), (2, "dia punya buku di rumah"), (3, "ada orang"), (4, "tak satu pun")], "id int, s string").withColumn("t", F.split("s", " "))
    got = {(r.id, r.schema, r.role, r.value, r.trigger) for r in C.schema_bindings(rows, ["id"], "t").collect()}
    assert got == {(1, "schema_copula", "Subject", "ini", 1), (1, "schema_copula", "Complement", "makanan", 1), (1, "schema_equative", "Subject", "ini", 1), (1, "schema_equative", "Complement", "makanan", 1),
                   (2, "schema_possessive", "Possessor", "dia", 1), (2, "schema_possessive", "Possession", "buku", 1), (2, "schema_locative", "Location", "rumah", 3), (3, "schema_existential", "Patient", "orang", 0)}
    wanted = (C.Schema("noun", "X", (("N", C.NOUN), ("A", C.ACTIVE)), 1, pattern="rum"),)
    active = rows.withColumn("a", F.expr("array(named_struct('label', 'di', 'energy', 0.9D), named_struct('label', 'rumah', 'energy', 0.8D), named_struct('label', 'kota', 'energy', 0.5D))"))
    assert {(r.role, r.value) for r in C.schema_bindings(active, ["id"], "t", wanted, active="a").collect()} == {("N", "buku"), ("A", "kota")}


def test_messages_in_blocks_are_plain_means(spark):
    rng = random.Random(7)
    vectors = {i: [rng.uniform(-1, 1) for _ in range(70)] for i in range(6)}
    edges = [(0, 5, "CAUSAL", 0.5), (1, 5, "DIFFERENTIAL", 1.0), (2, 4, "UNKNOWN", 0.4), (9, 3, "CAUSAL", 1.0)]
    got = {r.node_id: r.embedding for r in R.message_pass(spark.createDataFrame(edges, "src int, dst int, relation string, confidence double"), spark.createDataFrame(list(vectors.items()), "node_id int, embedding array<double>")).collect()}
    w0, w1 = 0.35, -0.8
    mixed = [0.5 * x + 0.5 * (w0 * a + w1 * b) / (abs(w0) + abs(w1)) for x, a, b in zip(vectors[5], vectors[0], vectors[1], strict=True)]
    length = sum(x * x for x in mixed) ** 0.5
    assert got[5] == pytest.approx([x / length for x in mixed]) and got[3] == pytest.approx(vectors[3]) and len(got) == 6


def test_substitutes_of_asked_words(spark):
    rows = spark.createDataFrame([(1, 0, i, t) for i, t in enumerate("a x b x a y c z".split())], "k int, sent int, pos int, token string")
    got = {(r.a, r.b, r.shared) for r in substitutable(rows, "k", spark.createDataFrame([("b",)], "token string")).collect()}
    assert got == {("b", "a", 1)}


def test_substitutes_among_all_frequent_words(spark):
    rng = random.Random(3)
    sents = [[rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6))] for _ in range(60)]
    rows = spark.createDataFrame([(1, s, i, t) for s, ts in enumerate(sents) for i, t in enumerate(ts)], "k int, sent int, pos int, token string")
    least = 20
    often = {t for t in "abcdefgh" if sum(ts.count(t) for ts in sents) >= least}
    after = {t: {y for ts in sents for x, y in zip(ts, ts[1:]) if x == t} for t in often}
    want = {(a, b, len(after[a] & after[b])) for a in often for b in often if a < b and 2 * len(after[a] & after[b]) > min(len(after[a]), len(after[b]))}
    assert want and {(r.a, r.b, r.shared) for r in substitutable_pairs(rows, "k", least).collect()} == want
    assert "substitutable_pairs" in inspect.getsource(rule_queries.substitutable)  # all pairs, no list of asked words


def test_stems_are_plain_columns_worked_out_once(spark):
    plan = W.stems(spark.createDataFrame([("berjalan-jalan",)], "word string"), "word")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and len(plan) < 200_000


def test_sets_meet_on_twos_without_a_table_of_them(spark, monkeypatch):
    from weftgraph.sources.scratch import kept

    rng, written = random.Random(11), {}

    def spied(df, name):
        out = kept(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(V, "kept", spied)
    sets = [(g, 100 * g + i, sorted(rng.sample("abcdefghijkl", 5)), "R") for g in (1, 2) for i in range(20)]
    rows = spark.createDataFrame(sets, "g int, comp_id int, nodes array<string>, roles string")
    got = V.sharing_pairs(rows, "g", F.col("n"), twos=True).collect()
    want = {(g, i, j, len(set(x) & set(y))) for g, i, x, _ in sets for h, j, y, _ in sets if g == h and i < j and len(set(x) & set(y)) > 1}
    assert {(r.g, r.a, r.b, r.shared) for r in got} == want and len(got) == len(want)
    assert written["first-nodes"] == len(sets)


def test_sets_are_built_once_for_classes_and_their_members(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = spark.createDataFrame([(1, k, i) for k in range(6) for i in range(k // 2, k // 2 + 3)], "g int, k int, i int")
    spied = rows.mapInPandas(counted, rows.schema)
    got = {(r.a, r.b) for r in P.over_half(spied, "g", "k", "i").collect()}
    sets = [set(range(k // 2, k // 2 + 3)) for k in range(6)]
    assert got == {(a, b) for a, b in combinations(range(6), 2) if 2 * len(sets[a] & sets[b]) > 3}
    assert read.value == 18


def test_pairs_with_shared_followers_are_counted_in_tasks(spark, monkeypatch):
    """Blocks of sets meet all sets where these are: no pair and no item is shuffled."""
    rng = random.Random(11)
    sets = {f"t{k:02}": sorted(rng.sample("abcdefghijkl", rng.randrange(1, 9))) for k in range(40)}
    df = spark.createDataFrame(list(sets.items()), "token string, items array<string>").repartition(3)
    asked = [t for t in sets if int(t[1:]) % 7 == 0]
    over = lambda a, b: 2 * len(set(sets[a]) & set(sets[b])) > min(len(sets[a]), len(sets[b]))
    row = lambda a, b: (a, b, len(set(sets[a]) & set(sets[b])), min(len(sets[a]), len(sets[b])))
    for items, counted in ((1 << 22, 1 << 22), (40, 30)):
        monkeypatch.setattr(P, "ITEMS", items)
        monkeypatch.setattr(P, "COUNTED", counted)
        got = P.counted_over_half(df)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in got.collect()) == sorted(row(a, b) for a in sets for b in sets if a < b and over(a, b))
        got = P.counted_over_half(df, df.where(F.col("token").isin(asked)))
        assert sorted(tuple(r) for r in got.collect()) == sorted(row(a, b) for a in asked for b in sets if a != b and over(a, b))
