"""The pipeline against its stages done plainly, and its behaviour on odd tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import DOCS, corpus, plain_dedup, plain_leaks, plain_sets, words
from weftgraph.llm import language_id

corpus_pipeline = pytest.importorskip("corpus_pipeline")
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = corpus(23, 80)
    long = [t for _, t, *_ in rows if t and len(t.split()) > 30]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, " ".join(long[0].split()[2:20])), (1, " ".join(long[4].split()[5:16])), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_is_its_stages_done_plainly(spark, folder):
    docs, bench = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    text = {r.doc_id: r.text for r in docs.collect()}
    told = {r.doc_id: r for r in language_id.run(docs).collect()}
    text = {i: t for i, t in text.items() if told[i].lang_pred != "und" and told[i].score > 0}
    assert all(any(c.isalpha() for c in t or "") for t in text.values())
    text = {i: text[i] for i in plain_near(text.items())}
    left = {}
    first = {}
    for i, t in text.items():
        w = words(t)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    for i, t in text.items():
        w = words(t)
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        kept = t if not gone else " ".join(x for p, x in enumerate(w) if p not in gone)
        if kept or not gone:
            left[i] = kept
    assert {r[0] for r in plain_dedup(list(text.items())) if r[2]}  # the stage has work to do
    leaks = {r[0] for r in plain_leaks(left.items(), [(r.item_id, r.text) for r in bench.collect()]) if r[5]}
    assert leaks
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in left.items() if i not in leaks}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: r.decoded_sha256 for r in got} == want and len(got) == len(want)


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == NAMES


def test_pipeline_of_nothing(spark, folder, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).collect() == []


def test_odd_rows_pass_through(spark, folder, tmp_path):
    path, rows = str(tmp_path), corpus(31, 30)
    long = next(t for _, t, *_ in rows if t and len(t.split()) > 30)
    other = " ".join(reversed(long.split()))
    rows += [(None, "a text without an id", "en", "s", 1), (500, " ".join(sorted(long.split())), "en", "s", 1), (500, other, "de", "t", 2), (500, other, "de", "t", 2), (501, "word " * 30000, None, None, None)]
    clashing = {"h": 1, "keys": "k", "component_id": 2, "contaminated": True, "_row": 0, "n": None}
    docs = spark.createDataFrame(rows, DOCS).withColumns({k: F.lit(v) for k, v in clashing.items()}).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    kept = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, path)
        assert kept.columns == docs.columns
    told = kept.collect()
    ids = [r.doc_id for r in told]
    assert None not in ids and ids.count(500) == 2 and len(ids) == len(set(ids)) + 1 and {500, 501} <= set(ids) and all(r.m == {"a": 1} for r in told)
    again = sorted((r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, path).collect())
    assert again == sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in told)


def test_texts_that_share_an_id_stay_or_go_by_themselves(spark, folder):
    rng = random.Random(9)
    text = lambda k: " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 6))) for _ in range(k))
    rows, unique, near = [], set(), set()
    for i in range(40):
        first, own = text(80), text(60)
        copy = first.split()
        copy[40] = "changed"
        rows += [(i, first, "en", "s", 1), (1000 + i, " ".join(copy), "en", "s", 1), (1000 + i, own, "en", "s", 1), (1000 + i, own, "de", "s", 1)]
        unique |= {(i, first), (1000 + i, own)}
        near.add((1000 + i, " ".join(copy)))
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS).repartition(4), folder).collect()
    told = [(r.doc_id, r.text) for r in got]
    assert set(told) == unique and len(told) == len(unique) and not near & set(told)
    leak = spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 0").first().text
    two = spark.createDataFrame([(7, f"{text(5)} {leak} {text(5)}", "en", "s", 1), (7, text(50), "en", "s", 1)], DOCS)
    assert [r.text for r in corpus_pipeline.drop_leaks(spark, two, folder).collect()] == [two.collect()[1].text]
    passage = text(30)
    three = spark.createDataFrame([(8, passage, "en", "s", 1), (8, f"{text(20)} {passage}", "en", "s", 1)], DOCS)
    left = sorted(len(r.text.split()) for r in corpus_pipeline.drop_repeated_passages(spark, three, folder).collect())
    assert left in ([20, 30], [50])  # the passage stays in the text that has the id's place


def test_numbers_of_texts_leave_ids_alone(spark):
    for ids in ((1, 2), (2**63 - 1, 5), (-(2**63), 5)):
        docs = spark.createDataFrame([(i, t, "en", "s", 1) for i in ids for t in ("a", "b", "b", None)] + [(3, "c", "en", "s", 1), (None, "d", "en", "s", 1)], DOCS)
        got = corpus_pipeline.by_text(docs).collect()
        keys = {}
        for r in got:
            keys.setdefault(r[corpus_pipeline.KEY], set()).add((r.doc_id, r.text))
        assert len(got) == 9 and len(keys) == 7 and all(len(k) == 1 for k in keys.values())
        assert {3, *ids} <= set(keys) and all(next(iter(keys[i]))[0] == i for i in (3, *ids))
    with pytest.raises(ValueError, match="room"):
        corpus_pipeline.by_text(spark.createDataFrame([(i, t, "en", "s", 1) for i in (2**63 - 1, -(2**63)) for t in ("a", "b")], DOCS))


def test_run_reads_each_stage_from_its_table(spark, folder):
    plan = corpus_pipeline.run(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Relation") == 1  # the last stage over what the one before it wrote


def plain_near(rows, n=5, percent=80):
    """The least id of each component, by plain sets."""
    sets = plain_sets(rows, n)
    least = {i: i for i, _ in sets}
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((least[i], least[j]))
                least = {k: p if c == q else c for k, c in least.items()}
    return {i for i, c in least.items() if i == c}


def test_near_copies_go_by_five_words_and_four_fifths(spark, folder):
    rows = corpus(23, 80)
    long = [t for _, t, *_ in rows if t and len(t.split()) > 50]
    tail = " ".join(f"tail{k}" for k in range(len(long[0].split()) * 17 // 100))
    changed = long[1].split()[:50]
    changed[25] = "changed"
    rows += [(1000, f"{long[0]} {tail}", "en", "s", 1), (1001, " ".join(long[1].split()[:50]), "en", "s", 1), (1002, " ".join(changed), "en", "s", 1)]
    texts = [(i, t) for i, t, *_ in rows]
    want = plain_near(texts)
    assert not {1000, 1002} & want and {1000, 1002} <= plain_near(texts, 3, 90)  # between the two limits
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), folder)
    assert {r.doc_id for r in got.collect()} == want


def test_texts_of_no_learned_language_go(spark, folder):
    rng = random.Random(5)

    def language(letters):
        stock = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(60)]
        return lambda k: " ".join(rng.choice(stock) for _ in range(k))

    one, two, other = language("aeioulmnrst"), language("abdegkouvwz"), language("йцукенгшвапрол")
    rows = [(i, text(k), lang, "s", 1) for i, (text, lang, k) in enumerate((t, x, k) for k in (1, 3, 10, 40, 160) for t, x in ((one, "aa"), (two, "bb")) for _ in range(100))]
    clean = [(2000 + i, t(k), None, "s", 1) for i, (t, k) in enumerate((t, k) for k in (1, 2, 10, 80) for t in (one, two))]
    junk = [other(40), other(160), "qxzj jqpc xxcy hjqf pcyx " * 12, "fjqh " * 60]
    docs = spark.createDataFrame([*rows, *clean, *[(3000 + i, t, None, "s", 1) for i, t in enumerate(junk)], (4000, "12 34", "aa", "s", 1)], DOCS).repartition(3)
    got = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, folder).collect()}
    assert got == {i for i, *_ in [*rows, *clean]}


def test_limits_need_texts(spark):
    docs = spark.createDataFrame([(i, "ab cd ef", "aa", "s", 1) for i in range(20)], DOCS)
    _, prototypes = language_id.profiles(docs)
    assert not language_id.limits(docs, prototypes).any()
    assert not language_id.limits(docs, prototypes[:0]).any()
