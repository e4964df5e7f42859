"""Semantic frames of sentences by rules: voice, polarity, predicate, and roles by adjacency and markers. Built-in functions alone, a row a sentence."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.sources.scratch import kept


@dataclass(frozen=True)
class Knowledge:
    """Words that mark something, and prefixes of verbs. The defaults are fixed values; ``taught`` adds others."""

    negation: tuple[str, ...] = ("tidak", "bukan", "belum", "jangan", "tak", "nggak", "enggak", "ga", "gak")
    cause: tuple[str, ...] = ("karena", "sebab")
    purpose: tuple[str, ...] = ("untuk", "supaya", "agar")
    condition: tuple[str, ...] = ("jika", "apabila", "kalau", "bila", "jikalau", "bilamana")
    verb_prefix: tuple[str, ...] = ("me", "ber", "di", "ter", "memper", "diper")
    common_verb: tuple[str, ...] = ("ada", "ialah", "adalah", "punya", "mahu", "hendak", "boleh", "perlu", "harus", "mesti")

    def taught(self, **words: tuple[str, ...]) -> Knowledge:
        known = {f.name for f in fields(self)}
        if unknown := set(words) - known:
            raise ValueError(f"no such markers: {sorted(unknown)}")
        return replace(self, **{k: (*getattr(self, k), *(w.lower() for w in ws if w.lower() not in getattr(self, k))) for k, ws in words.items()})


#: The agent of a passive sentence follows this word.
BY = "oleh"
#: What a frame starts from, and what a role or a negation adds.
BASE, AGENT, PATIENT, OTHER, NEGATED = 0.30, 0.15, 0.15, 0.10, -0.05
ROLES = ("agent", "patient", "cause", "purpose", "antecedent", "consequent")


def verb_like(word: Column, known: Knowledge) -> Column:
    """Of a lower-cased word: a verb's prefix and two bytes more at least, or a common verb."""
    prefixed = [word.startswith(p) & (F.octet_length(word) > len(p) + 1) for p in known.verb_prefix]
    found = word.isin(*known.common_verb)
    for p in prefixed:
        found = found | p
    return found


def passive(word: Column) -> Column:
    """Of a lower-cased word: "di" before a consonant, or before a vowel of four bytes or more; neither "dia" nor words of up to three bytes."""
    n = F.octet_length(word)
    vowel = F.substring(word, 3, 1).isin("a", "e", "i", "o", "u")
    return word.startswith("di") & (n > 3) & ~(word.startswith("dia") & (n <= 4)) & (~vowel | (n >= 6))


def _first(words: str, fits) -> Column:
    """The place, from 1, of the first word that fits; 0 if none does."""
    return F.array_position(F.transform(words, fits), F.lit(True)).cast("int")


def frames(sentences: DataFrame, key: list[str], tokens: Column, known: Knowledge) -> DataFrame:
    """key, predicate, voice, negative, the ROLES and confidence of each sentence that has a frame.

    A sentence has three words or more, not all the same, and a verb. In the active voice the agent stands before the predicate and
    the patient after it, unless these are markers; in the passive, the patient is the last word before it that neither negates nor
    is a verb, and the agent follows "oleh". A cause, a purpose and a consequent are all words after the first marker that has any;
    an antecedent is all before a condition's.
    """
    rows = sentences.select(*key, tokens.alias("t")).withColumn("l", F.transform("t", F.lower)).where((F.size("t") >= 3) & F.exists("t", lambda x: x != F.col("t")[0]) & F.exists("l", lambda x: verb_like(x, known)))
    rows = rows.withColumn("voice", F.when(F.exists("l", passive), "passive").otherwise("active")).withColumn("negative", F.exists("l", lambda x: x.isin(*known.negation)))
    prefixed = lambda p: _first("l", lambda x: x.startswith(p) & (F.octet_length(x) > 2))
    me = prefixed("me")
    rows = rows.withColumn("at", F.when(F.col("voice") == "passive", prefixed("di")).when(me > 0, me).otherwise(_first("l", lambda x: verb_like(x, known)))).where("at > 0")
    rows = rows.withColumn("at", F.array_position("t", F.get("t", F.col("at") - 1)).cast("int"))  # of equal words, the first
    word = lambda i: F.get("l", i - 1)
    plain = lambda w: F.when(~w.isin(*known.negation, *known.cause, *known.purpose, *known.condition), w)
    before = F.filter(F.slice("l", 1, F.greatest(F.lit(0), F.col("at") - 1)), lambda x: ~x.isin(*known.negation) & ~verb_like(x, known))
    by = F.array_position("l", F.lit(BY)).cast("int")
    is_passive = F.col("voice") == "passive"
    rest = lambda i: F.when((i > 0) & (i < F.size("l")), F.array_join(F.slice("l", F.greatest(F.lit(1), i + 1), F.size("l")), " "))
    after = lambda words: rest(F.array_position(F.transform(F.slice("l", 1, F.greatest(F.lit(0), F.size("l") - 1)), lambda x: x.isin(*words)), F.lit(True)).cast("int"))
    condition = _first("l", lambda x: x.isin(*known.condition))
    told = rows.select(
        *key,
        F.get("l", F.col("at") - 1).alias("predicate"),
        "voice",
        "negative",
        F.when(is_passive, F.when(by > 0, word(by + 1))).otherwise(plain(word(F.col("at") - 1))).alias("agent"),
        F.when(is_passive, F.get(before, F.size(before) - 1)).otherwise(plain(word(F.col("at") + 1))).alias("patient"),
        after(known.cause).alias("cause"),
        after(known.purpose).alias("purpose"),
        F.when(condition > 1, F.array_join(F.slice("l", 1, F.greatest(F.lit(0), condition - 1)), " ")).alias("antecedent"),
        rest(condition).alias("consequent"),
    )
    has = lambda c, x: F.when(F.col(c).isNotNull(), x).otherwise(0.0)
    total = F.lit(BASE) + has("agent", AGENT) + has("patient", PATIENT) + has("cause", OTHER) + has("purpose", OTHER) + has("antecedent", OTHER) + has("consequent", OTHER) + F.when(F.col("negative"), NEGATED).otherwise(0.0)
    return told.withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6))


def marked(sentence: Column, known: Knowledge) -> Column:
    """Whether a sentence has a cause's or a condition's marker among its words, which blanks, tabs and line ends part: frames of others have no derived() meaning."""
    return F.lower(sentence).rlike(rf"(?:^|[ \t\r\n])(?:{'|'.join(re.escape(w) for w in (*known.cause, *known.condition))})(?:[ \t\r\n]|$)")


#: A cause whose words hold one of these denies.
DENIALS = ("tidak", "bukan", "tak", "jangan", "not", "no", "never", "don't", "doesn't", "didn't")


def contradictions(events: DataFrame) -> DataFrame:
    """Kinds of event (predicate, agent, patient, cause, purpose), by ids a and b, that contradict each other, the first rule that applies, and how many pairs of events that makes.

    Two events of one predicate contradict each other if the same agent has a denied and another cause, or two different causes
    (polarity); if each one's agent is the other's patient (role reversal); or if the same agent has two purposes (purpose). Equal
    events are one kind, and kinds meet by predicate and agent, or by predicate and both ends, so that nothing else meets. Events
    of one kind contradict each other only if they have one node as agent and patient.
    """
    parts = ("predicate", "agent", "patient", "cause", "purpose")
    kinds = events.where("predicate IS NOT NULL AND agent IS NOT NULL").groupBy(*parts).agg(F.count("*").alias("n"))
    kinds = kinds.withColumn("id", F.xxhash64(*parts, *[F.col(c).isNull() for c in parts])).withColumn("denied", F.coalesce(F.exists(F.array(*[F.lit(d) for d in DENIALS]), lambda d: F.contains(F.lower("cause"), d)), F.lit(False)))
    side = lambda s: kinds.select("predicate", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "agent", "patient", "cause", "purpose", "denied")])
    one, two = side("a"), side("b")
    polarity = (F.col("denied_a") != F.col("denied_b")) | F.coalesce(F.col("cause_a") != F.col("cause_b"), F.lit(False))
    purpose = F.coalesce(F.col("purpose_a") != F.col("purpose_b"), F.lit(False))
    reversal = F.coalesce((F.col("agent_a") == F.col("patient_b")) & (F.col("patient_a") == F.col("agent_b")), F.lit(False))
    told = F.when(polarity, "Polarity").when(reversal, "RoleReversal").when(purpose, "Purpose")
    # of kinds with neither cause nor purpose, no two of one agent contradict each other but by reversal, which comes below
    same = one.where("cause_a IS NOT NULL OR purpose_a IS NOT NULL").join(two.withColumn("agent_a", F.col("agent_b")), ["predicate", "agent_a"]).where("id_a <> id_b").withColumn("kind", told)
    turned = one.where("patient_a IS NOT NULL AND agent_a <> patient_a").join(two.withColumns({"agent_a": F.col("patient_b"), "patient_a": F.col("agent_b")}), ["predicate", "agent_a", "patient_a"]).withColumn("kind", F.lit("RoleReversal"))
    ends = ["predicate", F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "kind", (F.col("n_a") * F.col("n_b")).alias("pairs")]
    own = kinds.where("agent = patient AND n > 1").select("predicate", F.col("id").alias("a"), F.col("id").alias("b"), F.lit("RoleReversal").alias("kind"), F.floor(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    return same.where("kind IS NOT NULL").select(*ends).unionByName(turned.select(*ends)).distinct().unionByName(own)


def contradiction_counts(events: DataFrame) -> DataFrame:
    """predicate, kind and pairs: how many pairs of events contradict each other, by the first rule of contradictions() that applies.

    No pair is made. Of the events of one predicate and agent, pairs that are no polarity conflict have equal causes, or one
    or no cause of which none denies: their number follows from the counts by cause, over all events, over those of each
    purpose, and over those whose agent is their patient as well. What is left of all pairs is polarity; reversals of two
    different nodes are a product of two counts.
    """
    rows = events.where("predicate IS NOT NULL AND agent IS NOT NULL")
    denied = F.coalesce(F.exists(F.array(*[F.lit(d) for d in DENIALS]), lambda d: F.contains(F.lower("cause"), d)), F.lit(False))
    kinds = kept(rows.groupBy("predicate", "agent", "patient", "cause", "purpose").agg(F.count("*").alias("n")), "kinds").withColumn("own", F.coalesce(F.col("agent") == F.col("patient"), F.lit(False))).withColumn("denied", denied)
    two = lambda n: n * (n - 1) / 2

    def peaceful(some: DataFrame, name: str, *by: str) -> DataFrame:
        """Pairs of each group that are no polarity conflict."""
        n = some.groupBy("predicate", "agent", *by, "cause", "denied").agg(F.sum("n").alias("n"))
        none = F.coalesce(F.sum(F.when(F.col("cause").isNull(), F.col("n"))), F.lit(0))
        mild = F.coalesce(F.sum(F.when(F.col("cause").isNotNull() & ~F.col("denied"), F.col("n"))), F.lit(0))
        same = F.coalesce(F.sum(F.when(F.col("cause").isNotNull(), two(F.col("n")))), F.lit(0))
        return n.groupBy("predicate", "agent", *by).agg((two(none) + none * mild + same).alias(name), two(F.sum("n")).alias("every"))

    with_purpose = kinds.where("purpose IS NOT NULL")
    alike = lambda some, name: peaceful(some, name, "purpose").groupBy("predicate", "agent").agg(F.sum(name).alias(name))
    keys, told = ["predicate", "agent"], peaceful(kinds, "calm")
    parts = [peaceful(kinds.where("own"), "own_calm"), peaceful(with_purpose, "aimed"), alike(with_purpose, "aimed_alike"), peaceful(with_purpose.where("own"), "own_aimed"), alike(with_purpose.where("own"), "own_aimed_alike")]
    for part in parts:
        told = told.join(part.drop("every"), keys, "left")
    of = lambda c: F.coalesce(c, F.lit(0))
    ends = kinds.where("patient IS NOT NULL AND agent <> patient").groupBy("predicate", "agent", "patient").agg(F.sum("n").alias("n"))
    back = ends.select("predicate", F.col("patient").alias("agent"), F.col("agent").alias("patient"), F.col("n").alias("m"))
    turned = ends.where("agent < patient").join(back, ["predicate", "agent", "patient"]).select("predicate", F.lit("RoleReversal").alias("kind"), (F.col("n") * F.col("m")).alias("pairs"))
    kinds_of = [("Polarity", F.col("every") - F.col("calm")), ("RoleReversal", of("own_calm")), ("Purpose", of("aimed") - of("aimed_alike") - of("own_aimed") + of("own_aimed_alike"))]
    same = told.select("predicate", F.inline(F.array(*[F.struct(F.lit(kind).alias("kind"), pairs.cast("long").alias("pairs")) for kind, pairs in kinds_of])))
    return same.unionByName(turned).groupBy("predicate", "kind").agg(F.sum("pairs").alias("pairs")).where("pairs > 0")


#: What a meaning keeps of its event's confidence, by rule.
KEPT = {"problem_solution": 0.85, "condition_consequence": 0.90}


def derived(events: DataFrame, key: list[str]) -> DataFrame:
    """Hidden meanings of frames: a cause is a problem that the patient solves; an antecedent implies its consequent. key, rule, given, then_, agent, confidence."""
    rules = [
        ("problem_solution", F.col("cause").isNotNull() & F.col("agent").isNotNull() & F.col("patient").isNotNull(), "cause", "patient"),
        ("condition_consequence", F.col("antecedent").isNotNull() & F.col("consequent").isNotNull(), "antecedent", "consequent"),
    ]
    found = [F.when(fits, F.struct(F.lit(name).alias("rule"), F.col(given).alias("given"), F.col(then).alias("then_"), "agent", F.round(F.lit(KEPT[name]) * F.col("confidence") + 1e-9, 6).alias("confidence"))) for name, fits, given, then in rules]
    return events.select(*key, F.inline(F.array_compact(F.array(*found))))
