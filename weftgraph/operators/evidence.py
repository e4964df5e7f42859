"""What speaks for and against conclusions: merged activations, coherence of seeds, resolutions of conflicts, and confidence in the light of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged(*activations: DataFrame) -> DataFrame:
    """node_id and energy: the greatest that any of the activations (node_id, energy) gives a node."""
    every = activations[0].select("node_id", "energy")
    for other in activations[1:]:
        every = every.unionAll(other.select("node_id", "energy"))
    return every.groupBy("node_id").agg(F.max("energy").alias("energy"))


def role_coherence(members: DataFrame, seeds: DataFrame) -> DataFrame:
    """q and coherence of sets of seeds (q, node_id): of the pairs of seeds that have compositions at all, the share that meet in one under different roles; 1 for fewer than two seeds, 0.5 for fewer than two with compositions.

    Seeds meet within compositions, so pairs that never do aren't made.
    """
    asked = seeds.select("q", "node_id").distinct()
    roles = asked.join(members.select("comp_id", "node_id", "role").distinct(), "node_id")
    n = asked.groupBy("q").agg(F.count("*").alias("n"))
    placed = roles.groupBy("q").agg(F.count_distinct("node_id").alias("k"))
    one, two = (roles.select("q", "comp_id", F.col("node_id").alias(c), F.col("role").alias(f"role_{c}")) for c in ("a", "b"))
    met = one.join(two, ["q", "comp_id"]).where("a < b AND role_a <> role_b").select("q", "a", "b").distinct().groupBy("q").agg(F.count("*").alias("met"))
    told = n.join(placed, "q", "left").join(met, "q", "left")
    k = F.coalesce("k", F.lit(0))
    return told.select("q", F.round(F.when(F.col("n") < 2, 1.0).when(k < 2, 0.5).otherwise(F.coalesce("met", F.lit(0)) / (k * (k - 1) / 2)), 6).alias("coherence"))


def resolutions(pairs: DataFrame, comps: DataFrame, members: DataFrame, scoped: tuple[str, ...] = ("Location", "Time")) -> DataFrame:
    """a, b and resolution of pairs of contradicting compositions, of which b opposes a; null where nothing resolves them.

    Misinterpretation: predicate, agent and patient are the same, the provenance (origin, source) isn't. Scoped validity: both have
    a ``scoped`` role, filled differently. Superseded: b has more confidence, is as new and has as many members, or more.
    Fillers are the first members of a role.
    """
    roles = ("Predicate", "Agent", "Patient", *scoped)
    ends = pairs.select(F.col("a").alias("comp_id")).unionAll(pairs.select("b")).distinct()
    some = members.join(ends, "comp_id", "left_semi")
    first = some.groupBy("comp_id").agg(F.count("*").alias("size"), *[F.min_by(F.when(F.col("role") == r, F.col("node_id")), F.when(F.col("role") == r, F.struct("pos", "node_id"))).alias(r) for r in roles])
    facts = comps.join(ends, "comp_id", "left_semi").select("comp_id", "confidence", "batch_seen", "origin", "source").join(first, "comp_id", "left")
    side = lambda s: facts.select(*[F.col(c).alias(s if c == "comp_id" else f"{s}_{c}") for c in facts.columns])
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    same = lambda c: F.coalesce(F.col(f"a_{c}") == F.col(f"b_{c}"), F.lit(False))
    apart = lambda c: F.coalesce(F.col(f"a_{c}") != F.col(f"b_{c}"), F.lit(False))
    voice = same("Predicate") & same("Agent") & same("Patient") & (apart("origin") | apart("source"))
    elsewhere = F.lit(False)
    for role in scoped:
        elsewhere = elsewhere | apart(role)
    size = lambda s: F.coalesce(f"{s}_size", F.lit(0))
    newer = (F.col("b_confidence") > F.col("a_confidence")) & (F.col("b_batch_seen") >= F.col("a_batch_seen")) & (size("b") >= size("a"))
    return both.select("a", "b", F.when(voice, "Misinterpretation").when(elsewhere, "ScopedValidity").when(newer, "Superseded").alias("resolution"))


#: From which activation a predicate counts, and what it adds; from which ambiguity it takes off, and how much; what an equal predicate adds, and the most; what a contradiction keeps.
ACTIVE, ACTIVE_PART, AMBIGUOUS, AMBIGUOUS_PART, EQUAL, MOST_EQUAL, CONTRADICTED = 0.5, 0.15, 0.3, 0.5, 0.02, 0.10, 0.85


def modulated(confidence: Column, energy: Column, ambiguity: Column, equal: Column, contradicted: Column) -> Column:
    """A derivation's confidence in the light of the graph: active predicates and equal ones add, ambiguity and contradictions take off, in this order."""
    one = F.when(energy > ACTIVE, F.least(F.lit(1.0), confidence + energy * ACTIVE_PART)).otherwise(confidence)
    two = F.when(ambiguity > AMBIGUOUS, one * (1 - ambiguity * AMBIGUOUS_PART)).otherwise(one)
    three = F.when(equal > 0, F.least(F.lit(1.0), two + F.least(F.lit(MOST_EQUAL), equal * EQUAL))).otherwise(two)
    return F.when(contradicted, three * CONTRADICTED).otherwise(three)


def related(members: DataFrame, asked: DataFrame) -> DataFrame:
    """q and node_id: the other nodes that share a composition with an asked node (q), each once."""
    own = members.select("comp_id", "node_id").distinct()
    mine = own.join(asked.select(F.col("q").alias("node_id")).distinct(), "node_id", "left_semi").select(F.col("node_id").alias("q"), "comp_id")
    return mine.join(own, "comp_id").where("q <> node_id").select("q", "node_id").distinct()


def neighbourhood_overlap(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b and overlap of pairs of nodes: the Jaccard overlap of what each is related to and itself. Shared ones are counted by a join; nodes without a composition have only themselves."""
    ends = pairs.select(F.col("a").alias("q")).unionAll(pairs.select("b")).distinct()
    around = related(members, ends).unionAll(ends.select("q", F.col("q").alias("node_id")))
    n = around.groupBy("q").agg(F.count("*").alias("n"))
    side = lambda c: n.select(F.col("q").alias(c), F.col("n").alias(f"n_{c}"))
    shared = pairs.join(around.withColumnRenamed("q", "a"), "a").join(around.withColumnRenamed("q", "b"), ["b", "node_id"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    told = pairs.join(side("a"), "a").join(side("b"), "b").join(shared, ["a", "b"], "left")
    both = F.coalesce("shared", F.lit(0))
    return told.select("a", "b", F.round(both / (F.col("n_a") + F.col("n_b") - both), 6).alias("overlap"))
