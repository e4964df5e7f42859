"""Roots of words by affixes: prefixes with their assimilation, suffixes, doubled words, and known roots. Column expressions over distinct words."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that are roots already.
ROOTS = tuple(
    (
        "makan minum tahu kerja lari jalan tulis baca dengar lihat ambil beri buat cari duduk hidup ikan pulang sampai taruh tinggal tukar pukul main pilih bayar jual beli datang pergi masuk keluar naik turun buka tutup pakai lepas "
        "suka benci cinta sayang harus boleh bisa kata ada ialah adalah punya mahu hendak perlu mesti orang rumah air api tanah mata tangan kaki kepala hati badan raja rakyat negara kerajaan hukum adat "
        "mental modal sosial formal normal original total vital real ideal local kriminal"
    ).split()
)
#: Prefixes and suffixes, in the order in which they are tried.
PREFIXES = ("memper", "diper", "meng", "meny", "mem", "men", "ber", "di", "ter", "per", "pe", "ke", "se", "me")
SUFFIXES = ("kan", "an", "lah", "kah", "tah", "pun", "i")
#: Forms that a prefix takes before certain sounds: the form, and the prefix that it stands for.
ALLOMORPHS = (("meng", "meN"), ("meny", "meN"), ("mem", "meN"), ("men", "meN"), ("me", "meN"), ("peng", "peN"), ("peny", "peN"), ("pem", "peN"), ("pen", "peN"), ("pe", "peN"))
#: Letters that come back when a prefix goes: always, or before a letter that follows.
RESTORED = (("meny", "", "s"), ("pe", "s", "s"))


@dataclass(frozen=True)
class Morphology:
    roots: tuple[str, ...] = ROOTS
    prefixes: tuple[str, ...] = PREFIXES
    suffixes: tuple[str, ...] = SUFFIXES
    allomorphs: tuple[tuple[str, str], ...] = ALLOMORPHS
    restored: tuple[tuple[str, str, str], ...] = RESTORED

    def taught(self, *, roots: tuple[str, ...] = (), suffixes: tuple[str, ...] = (), allomorphs: tuple[tuple[str, str, str], ...] = ()) -> Morphology:
        """With more roots, suffixes, and forms of prefixes (form, prefix, letter that comes back); longer ones are tried first."""
        longest = lambda old, new: tuple(sorted({*old, *new}, key=lambda x: (-len(x), old.index(x) if x in old else -1, x)))
        return replace(
            self,
            roots=(*self.roots, *(r.lower() for r in roots if r.lower() not in self.roots)),
            suffixes=longest(self.suffixes, suffixes) if suffixes else self.suffixes,
            prefixes=longest(self.prefixes, [form for form, _, _ in allomorphs]) if allomorphs else self.prefixes,
            allomorphs=(*self.allomorphs, *((form, prefix) for form, prefix, _ in allomorphs)),
            restored=(*self.restored, *((form, "", letter) for form, _, letter in allomorphs if letter)),
        )

    def forms(self, prefix: str) -> list[str]:
        """All forms of a prefix."""
        return [form for form, of in self.allomorphs if of == prefix]


def _affix(word: Column, affixes: tuple[str, ...], fits) -> Column:
    """The first affix that the word has, with two bytes or more beside it; null if none."""
    found, size = F.lit(None).cast("string"), F.octet_length(word)
    for a in reversed(affixes):
        found = F.when(fits(word, F.lit(a)) & (size > len(a.encode()) + 1), a).otherwise(found)
    return found


def without_suffix(rows: DataFrame, word: str, known: Morphology, affix: str, rest: str) -> DataFrame:
    """rows with the suffix of a column and what it leaves, nulls if there is none."""
    found = rows.withColumn(affix, _affix(F.col(word), known.suffixes, F.endswith))
    return found.withColumn(rest, F.substr(word, F.lit(1), F.length(word) - F.length(affix)))


def without_prefix(rows: DataFrame, word: str, known: Morphology, affix: str, rest: str) -> DataFrame:
    """rows with the prefix of a column and what it leaves, with letters that come back."""
    found = rows.withColumn(affix, _affix(F.col(word), known.prefixes, F.startswith))
    found = found.withColumn(rest, F.substr(word, F.length(affix) + 1, F.length(word)))
    back = F.lit("")
    for form, before, letter in reversed(known.restored):
        back = F.when((F.col(affix) == form) & F.startswith(rest, F.lit(before)), letter).otherwise(back)
    return found.withColumn(rest, F.concat(back, F.col(rest)))


def _ways(rows: DataFrame, word: str, known: Morphology, name: str) -> DataFrame:
    """rows with columns of a name and s, p: suffix or prefix off; sp, ps: then the other one as well; each with its rest. A step is a column, so that it is worked out once."""
    rows = without_prefix(without_suffix(rows, word, known, f"{name}s", f"{name}s_rest"), word, known, f"{name}p", f"{name}p_rest")
    return without_suffix(without_prefix(rows, f"{name}s_rest", known, f"{name}sp", f"{name}sp_rest"), f"{name}p_rest", known, f"{name}ps", f"{name}ps_rest")


def stems(words: DataFrame, word: str, known: Morphology = Morphology()) -> DataFrame:  # noqa: B008
    """word, root, prefix, suffix and archimorpheme of every word (give distinct ones) that has another root.

    A known root has none. A doubled word's root is its half, or its second half if the first one's stem is that. Otherwise
    suffix and prefix are taken off in either order; a candidate that is a known root wins, then the shortest of two bytes or
    more, the earlier of equals.
    """
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # words are few bytes and much work, which adaptive execution would put into one task
    rows = words.select(word, F.lower(word).alias("w")).where(~F.col("w").isin(*known.roots)).repartition(parts)
    halves = F.instr("w", "-") > 1
    rows = rows.withColumns({"left": F.when(halves, F.substring_index("w", "-", 1)), "right": F.when(halves, F.substr("w", F.instr("w", "-") + 1, F.length("w")))})
    rows = _ways(_ways(rows, "w", known, "w_"), "left", known, "l_")
    simple = F.coalesce("l_sp_rest", "l_s_rest", "l_p_rest", "left")
    rows = rows.withColumn("double", F.when(F.col("left") == F.col("right"), F.col("left")).when((F.octet_length("left") > F.octet_length("right")) & (simple == F.col("right")), F.col("right")))

    # a candidate's place among those that count: known roots, then by length, the earlier of equals
    ways = (("w_s", None, "w_s"), ("w_sp", "w_sp", "w_s"), ("w_p", "w_p", None), ("w_ps", "w_p", "w_ps"))
    for i, (way, _, _) in enumerate(ways):
        root = F.col(f"{way}_rest")
        size = F.octet_length(root)
        counts = root.isNotNull() & (root != "") & (root != F.col("w"))
        rows = rows.withColumn(f"place{i}", F.when(counts & root.isin(*known.roots), F.lit(i)).when(counts & (size >= 2), size * len(ways) + i))
    rows = rows.withColumn("place", F.least(*[f"place{i}" for i in range(len(ways))]))

    def of(column) -> Column:
        told = F.lit(None).cast("string")
        for i, way in enumerate(ways):
            told = F.when(F.col("place") == F.col(f"place{i}"), column(*way)).otherwise(told)
        return F.when(F.col("double").isNull(), told)

    some = lambda c: F.lit(None).cast("string") if c is None else F.col(c)
    told = rows.select(word, F.coalesce("double", of(lambda way, p, s: F.col(f"{way}_rest"))).alias("root"), of(lambda way, p, s: some(p)).alias("prefix"), of(lambda way, p, s: some(s)).alias("suffix"))
    forms = F.create_map(*[F.lit(x) for pair in known.allomorphs for x in pair])
    # as one row of an array, as Spark would take a filter on plain columns down through all steps, each worked out again
    one = told.select(word, F.inline(F.array(F.struct("root", "prefix", "suffix"))))
    return one.where("root IS NOT NULL").select(word, "root", "prefix", "suffix", F.when(F.col("prefix").isNotNull(), F.element_at(forms, F.col("prefix"))).alias("archimorpheme"))
