"""Language ID done plainly: one letter, n-gram and text at a time; samples of training texts, and ties."""

import inspect
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import language_id

SCHEMA = "doc_id long, text string, lang string"


def plain_vector(text):
    """The sum of the vectors of a text's n-grams that have a letter."""
    shown = [c if c.isalpha() else " " for c in f" {text} ".lower()]
    kept = [c for i, c in enumerate(shown) if c != " " or i == 0 or shown[i - 1] != " "]
    letter = {c: language_id.letter_vectors(np.array([ord(c)]), language_id.DIMENSION)[0].astype(float) for c in set(kept)}
    total = np.zeros(language_id.DIMENSION)
    for a, b, c in zip(kept, kept[1:], kept[2:], strict=False):
        if {a, b, c} != {" "}:
            total += np.roll(letter[a], 2) * np.roll(letter[b], 1) * letter[c]
    return total


def plain_unit(x):
    length = np.sqrt((x * x).sum())
    return x / length if length else x


def plain_learn(rows):
    sums = {}
    for i, text, lang in rows:
        if i is not None and text is not None and lang is not None and zlib.crc32(str(i).encode()) % 5:
            sums[lang] = sums.get(lang, 0) + plain_unit(plain_vector(text))
    languages = sorted(sums)
    prototypes = [plain_unit(sums[lang]) for lang in languages]
    if len(languages) > 1:
        mean = sum(prototypes) / len(prototypes)
        prototypes = [p - mean for p in prototypes]
    return languages, [plain_unit(p) for p in prototypes]


def plain_predict(text, languages, prototypes):
    vector = plain_vector(text or "")
    if not languages or not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    cosines = [float(plain_unit(vector) @ p) for p in prototypes]
    best = max(range(len(languages)), key=lambda k: cosines[k])
    return languages[best], min(max(cosines[best], 0.0), 1.0)


def texts(seed=1, n=120):
    rng = random.Random(seed)
    stock = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(40)] for lang, letters in (("aa", "abcdeé"), ("bb", "cdefgh ß"), ("cc", "日本語テキ"))}
    rows = []
    for i in range(n):
        lang = rng.choice(list(stock))
        rows.append((i, ", ".join(rng.choice(stock[lang]) for _ in range(rng.randint(1, 25))) + rng.choice(["", ".", " 12!"]), lang if rng.random() < 0.9 else None))
    return [*rows, (500, None, "aa"), (501, "", "bb"), (502, "12 34", "cc"), (None, "abc abc", "aa"), (503, "a", None), (3, "repeated id", "bb")]


def test_prototypes_shift_and_prediction_are_the_plain_ones(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"k": F.lit(1), "x": F.lit("x"), "v": F.lit(0.5)}).repartition(4)
    languages, prototypes = language_id.learn(docs)
    names, plain = plain_learn(rows)
    assert languages == names == ["aa", "bb", "cc"]
    assert np.abs(prototypes - np.array(plain)).max() < 1e-5
    assert np.abs(sum(p * np.linalg.norm(q) for p, q in zip(prototypes, prototypes, strict=True))).max() < 1.0  # the shift leaves nothing that all share
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.held_out, r.lang_pred, r.score) for r in language_id.run(docs).collect())
    want = sorted(((i if i is not None else -1), None if i is None else zlib.crc32(str(i).encode()) % 5 == 0, *plain_predict(t, names, plain)) for i, t, _ in rows)
    assert [(g[0], g[1], g[2]) for g in got] == [(w[0], w[1], w[2]) for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-5)


def test_a_sample_of_training_texts_is_chosen_by_id(spark):
    rows = texts(2, 400)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    eligible = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(language_id.fold_of("doc_id") != 0)
    n = {r.lang: r["count"] for r in eligible.groupBy("lang").count().collect()}
    place = {r.doc_id: r.p for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)).alias("p")).collect()}
    most = 40
    some = [(i, t, lang) for i, t, lang in rows if i is not None and lang is not None and place[i] < min(1.0, most / n[lang]) * 1_000_000]
    languages, prototypes = language_id.learn(docs, most=most)
    names, plain = plain_learn(some)
    assert languages == names and np.abs(prototypes - np.array(plain)).max() < 1e-5
    taken = [lang for i, t, lang in some if t is not None and zlib.crc32(str(i).encode()) % 5]
    assert all(0 < taken.count(lang) < n[lang] and taken.count(lang) < 2 * most for lang in n)


def test_all_training_texts_count_whatever_their_number(spark):
    n = 12_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('abc def ', repeat('gh ', int(id % 5))) AS text", "'kk' AS lang")
    rows = [i for i in range(n) if zlib.crc32(str(i).encode()) % 5]
    assert language_id._training_texts(docs, "doc_id", "text", "lang", inspect.signature(language_id.profiles).parameters["most"].default).count() == len(rows)
    assert inspect.signature(language_id.limits).parameters["most"].default is None


def test_tied_languages_give_the_first(spark):
    same = [(i, f"abc def {i % 7 * 'gh '}") for i in range(1, 60)]
    rows = [*[(i, t, "mm") for i, t in same], *[(1000 + i, t, "kk") for i, t in same], *[(2000 + i, "xyz uvw", "zz") for i in range(20)]]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 and zlib.crc32(str(r[0] % 1000).encode()) % 5 and zlib.crc32(str(r[0] % 1000 + 1000).encode()) % 5]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.lang_pred for r in language_id.run(docs).where("doc_id < 2000").collect()}
    assert got == {"kk"} and {r.lang_pred for r in language_id.run(docs).where("doc_id >= 2000").collect()} == {"zz"}
    two = language_id.run(docs.where("lang <> 'zz'")).collect()
    assert {(r.lang_pred, r.score) for r in two} == {("kk", 0.0)}  # nothing tells them apart
