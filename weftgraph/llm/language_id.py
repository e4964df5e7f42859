"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point alone.
The vector of an n-gram binds its letters: the k-th letter's vector is permuted
(rotated) by n-1-k places, and the vectors are multiplied element by element. A
text's vector bundles, that is adds up, those of its n-grams; a language's
prototype bundles the texts of that language, each scaled to unit length. The
prediction is the language whose prototype has the largest cosine with the text,
and that cosine, or 0 if it is negative, is the score. A prototype is shifted by
the mean of all of them first, so that what languages share doesn't count.

Shifted prototypes sum to zero, so some cosine is above 0 for nearly every text: they
tell languages apart, and can't tell that a text is in none. For that, ``predict`` takes
``known``: a text whose cosines with the prototypes as they were before the shift are
all below a limit is ``und``. Noise falls and likeness grows with a text's number of
n-grams, so ``limits`` fits a limit for each power of two of them on the training texts.

Texts are lower-cased; runs of characters that aren't letters count as one space,
and a text has a space on either side. Adding up is by counts: a batch's distinct
n-grams are bound once, and a matrix product bundles them for all its texts.

Defined cases: null text, and text without a letter, is ``und`` with score 0.
Ties go to the language that sorts first. Rows with a null id are predicted like
others but never learned from. Without any labelled row, all is ``und``. Texts
count whole, whatever their length: n-grams are bound and added in blocks, so a text
needs a few numbers for each of its characters and no vector for each of its n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .wordhash import chunks, mix

DIMENSION = 512
NGRAM = 3
FOLDS = 5
#: The share of training texts of about one length that count as outliers, how many texts it takes to fit a limit, and the part of the others' least likeness that is enough: new texts can be less like than any seen.
OUTLIERS, LEAST_TEXTS, ENOUGH = 0.001, 50, 0.8
#: Numbers of n-grams by power of two; steps that cosines are counted in.
LENGTHS, STEPS = 48, 1000
#: Bytes of text that are counted at once.
CHUNK = 1 << 19
#: Distinct n-grams whose vectors are held at once.
BOUND_AT_ONCE = 1 << 14

_letters: dict[str, np.ndarray] = {}


def _classes() -> np.ndarray:
    """By code point: whether it is a letter."""
    if "is" not in _letters:
        _letters["is"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters["is"]


def letter_vectors(points: np.ndarray, dimension: int) -> np.ndarray:
    """A row of +1 and -1 for each code point; the space, 0x20, included."""
    out = np.empty((len(points), dimension), np.int8)
    with np.errstate(over="ignore"):
        for i in range(0, len(points), 1024):
            seeds = points[i : i + 1024].astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, dimension + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            out[i : i + 1024] = (mix(mix(seeds)) >> np.uint64(63)).astype(np.int8) * 2 - 1
    return out


def text_vectors(texts: list[str], dimension: int = DIMENSION, n: int = NGRAM) -> np.ndarray:
    """The bundled n-gram vectors of texts, one row each; rows without letters are 0."""
    return counted_vectors(texts, dimension, n)[0]


def counted_vectors(texts: list[str], dimension: int = DIMENSION, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of ``text_vectors``, and how many n-grams each text has."""
    is_letter = _classes()
    # every text has a space on either side; the first one marks where its row starts
    points = np.frombuffer("".join([f" {t} " for t in texts]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t.lower()) + 2 for t in texts), np.int64, len(texts))
    begins = np.zeros(len(points), bool)
    begins[np.cumsum(lengths) - lengths] = True
    letter = is_letter[points]
    kept = letter | begins
    kept[1:] |= letter[:-1]  # of characters that aren't letters, the first of a run
    row = np.cumsum(begins)[kept] - 1
    points, begins, letter = np.where(letter, points, 32)[kept], begins[kept], letter[kept]
    out = np.zeros((len(texts), dimension), np.float32)
    if not letter.any() or len(points) < n:
        return out, np.zeros(len(texts), np.int64)
    alphabet, codes = _compact(points)
    size = len(alphabet)
    grams = np.zeros(len(codes) - n + 1, np.int64)
    for k in range(n):
        grams = grams * size + codes[k : len(codes) - n + 1 + k]
    inner = np.zeros(len(grams), bool)  # n-grams with a letter, within one row
    for k in range(n):
        inner |= letter[k : len(letter) - n + 1 + k]
    for k in range(1, n):
        inner &= ~begins[k : len(begins) - n + 1 + k]
    grams, of = grams[inner], row[: len(inner)][inner]
    if size**n <= 1 << 22:
        seen = np.zeros(size**n, bool)
        seen[grams] = True
        distinct = np.flatnonzero(seen)
        place = np.zeros(size**n, np.int32)
        place[distinct] = np.arange(len(distinct))
        grams = place[grams]
    else:
        distinct, grams = np.unique(grams, return_inverse=True)
    letters = letter_vectors(alphabet, dimension)
    for first_gram in range(0, len(distinct), BOUND_AT_ONCE):
        vectors = bound(distinct[first_gram : first_gram + BOUND_AT_ONCE], letters, size, n)
        some, owner = (grams, of) if len(distinct) <= BOUND_AT_ONCE else _block(grams, of, first_gram)
        step = max(1, (1 << 22) // len(vectors))  # rows whose counts are held at once
        bounds = np.searchsorted(owner, np.arange(0, len(texts) + step, step))
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            first = i * step
            rows = min(step, len(texts) - first)
            if rows > 0 and b > a:
                counts = np.bincount((owner[a:b] - first) * len(vectors) + some[a:b], minlength=rows * len(vectors)).reshape(rows, len(vectors))
                out[first : first + rows] += counts.astype(np.float32) @ vectors
    return out, np.bincount(of, minlength=len(texts))


def bound(grams: np.ndarray, letters: np.ndarray, size: int, n: int) -> np.ndarray:
    """The vectors of n-grams, given as numbers of n digits: their letters' vectors, turned by place and multiplied."""
    vectors, rest = np.ones((len(grams), letters.shape[1]), np.int8), grams
    for k in range(n - 1, -1, -1):
        vectors *= np.roll(letters, n - 1 - k, axis=1)[rest % size]
        rest = rest // size
    return vectors.astype(np.float32)


def _block(grams: np.ndarray, of: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a block and their rows, in the order of rows."""
    at = np.flatnonzero((grams >= first) & (grams < first + BOUND_AT_ONCE))
    return grams[at] - first, of[at]


def _compact(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct code points in ascending order, and for each point its place among them."""
    seen = np.zeros(int(points.max()) + 1, bool)
    seen[points] = True
    alphabet = np.flatnonzero(seen)
    place = np.zeros(len(seen), np.int64)
    place[alphabet] = np.arange(len(alphabet))
    return alphabet, place[points]


def unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(length > 0, length, 1)


def fold_of(id_col: str) -> F.Column:
    return F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(FOLDS))


def _cleaned(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _training_texts(docs: DataFrame, id_col: str, text_col: str, label_col: str, most: int | None) -> DataFrame | None:
    """text and lang of the rows to learn from; None without any. With ``most``, about so many of a language, chosen by a hash of the id; otherwise all."""
    labelled = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").alias("lang")).where("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(fold_of("id") != 0)
    if most is None:
        return None if labelled.isEmpty() else labelled.select("text", "lang")
    rates = {r.lang: min(1.0, most / r["n"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not rates:
        return None
    rate = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])[F.col("lang")]
    return labelled.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < rate * 1_000_000).select("text", "lang")


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", most: int | None = None, dimension: int = DIMENSION, n: int = NGRAM) -> tuple[list[str], np.ndarray]:
    """Languages in ascending order, and their prototypes before the shift. Each task bundles its own rows; what reaches the driver has the size of the prototypes."""
    bound_batches(docs.sparkSession)
    chosen = _training_texts(docs, id_col, text_col, label_col, most)
    if chosen is None:
        return [], np.zeros((0, dimension), np.float32)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                vectors, langs = unit(text_vectors(_cleaned(part.column(0)), dimension, n)), np.array(part.column(1).to_pylist(), object)
                for lang in set(langs.tolist()):
                    sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0, dtype=np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], names=["lang", "parts"])

    parts = chosen.mapInArrow(bundle, "lang string, parts array<double>")
    sums = parts.select("lang", F.posexplode("parts").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v"))
    rows = sorted((r.lang, [p.x for p in r.v]) for r in sums.collect())  # languages x dimension numbers
    return [lang for lang, _ in rows], unit(np.array([v for _, v in rows], np.float64))


def shifted(prototypes: np.ndarray) -> np.ndarray:
    if len(prototypes) > 1:
        prototypes = prototypes - prototypes.mean(axis=0)
    return unit(prototypes).astype(np.float32)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", most: int | None = None, dimension: int = DIMENSION, n: int = NGRAM) -> tuple[list[str], np.ndarray]:
    """Languages in ascending order, and their prototypes."""
    languages, prototypes = profiles(docs, id_col, text_col, label_col, most, dimension, n)
    return languages, shifted(prototypes)


def _length(grams: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(grams, 1)).astype(np.int64), LENGTHS - 1)


def _likeness(vectors: np.ndarray, prototypes: np.ndarray) -> np.ndarray:
    """Each text's largest cosine with a prototype before the shift, in whole steps."""
    return np.floor(np.clip((unit(vectors) @ prototypes.T).max(axis=1), 0, 1) * STEPS).astype(np.int64)


def limits(docs: DataFrame, prototypes: np.ndarray, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", most: int | None = None, n: int = NGRAM) -> np.ndarray:
    """By power of two of the number of n-grams: the likeness, in steps, that is enough: ENOUGH of what all but the OUTLIERS of the training texts reach.

    Lengths of too few texts have the limit of the next shorter one; without any, 0, which nothing is below.
    """
    bound_batches(docs.sparkSession)
    out = np.zeros(LENGTHS, np.int64)
    chosen = _training_texts(docs, id_col, text_col, label_col, most) if len(prototypes) else None
    if chosen is None:
        return out
    model = docs.sparkSession.sparkContext.broadcast(prototypes.astype(np.float32))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((LENGTHS, STEPS + 1), np.int64)
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                vectors, grams = counted_vectors(_cleaned(part.column(0)), model.value.shape[1], n)
                some = grams > 0
                np.add.at(total, (_length(grams[some]), _likeness(vectors[some], model.value)), 1)
        length, step = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(step), pa.array(total[length, step])], names=["length", "step", "n"])

    counts = np.zeros((LENGTHS, STEPS + 1), np.int64)
    for r in chosen.mapInArrow(count, "length long, step long, n long").groupBy("length", "step").agg(F.sum("n").alias("n")).collect():  # at most LENGTHS x STEPS rows
        counts[r.length, r.step] = r.n
    for k, row in enumerate(counts):
        texts = int(row.sum())
        if texts >= LEAST_TEXTS:
            out[k] = int(ENOUGH * np.searchsorted(np.cumsum(row), int(OUTLIERS * texts), side="right"))
        elif k:
            out[k] = out[k - 1]
    return out


def predict(docs: DataFrame, languages: list[str], prototypes: np.ndarray, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score"), known: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """docs with a prediction and its score. With ``known``, the prototypes before the shift and their limits, texts below the limit are ``und``."""
    bound_batches(docs.sparkSession)
    dimension = prototypes.shape[1]
    if known is not None:
        known = known[0].astype(np.float32), known[1]
    model = docs.sparkSession.sparkContext.broadcast((languages, prototypes, known))

    @F.pandas_udf("lang string, score double")
    def identify(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        languages, prototypes, known = model.value
        names_ = np.array([*languages, "und"], object)
        for texts in parts:
            lang, score = [], []
            column = pa.array(texts, pa.string(), from_pandas=True)
            for part in chunks(pa.RecordBatch.from_arrays([column], names=["text"]), "text", CHUNK):
                vectors, grams = counted_vectors(_cleaned(part.column(0)), dimension)
                none = ~vectors.any(axis=1)
                if not languages:
                    none[:] = True
                elif known is not None and len(none):
                    none |= _likeness(vectors, known[0]) < known[1][_length(grams)]
                cosines = unit(vectors) @ prototypes.T if languages else np.zeros((len(none), 1))
                best = np.where(none, len(languages), cosines.argmax(axis=1))
                lang.append(names_[best])
                score.append(np.where(none, 0.0, np.clip(cosines.max(axis=1), 0, 1)))
            yield pd.DataFrame({"lang": np.concatenate(lang) if lang else [], "score": np.concatenate(score).astype(float) if score else []})

    told = docs.drop(*names).withColumn("_told", identify(F.col(f"`{text_col}`")))
    return told.select("*", F.col("_told.lang").alias(names[0]), F.col("_told.score").alias(names[1])).drop("_told")


def run(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    languages, prototypes = learn(docs)
    told = predict(docs.select("doc_id", "text"), languages, prototypes)
    return told.select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))
