"""Gaps in what a graph knows, and how to fill each one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.sources.scratch import kept

#: Roles that an Event should have, and the kind of gap if it doesn't.
EVENT_ROLES = {"Agent": "MissingRole", "Patient": "MissingRole", "Cause": "MissingCause", "Purpose": "MissingPurpose"}
#: Questions to a user by kind of gap.
QUESTIONS = {
    "UnresolvedContradiction": "Ada kontradiksi dalam pengetahuan yang belum terselesaikan. Manakah yang benar?",
    "IncompleteHiddenMeaning": "Makna tersembunyi ini belum lengkap. Apa yang kurang?",
    "MissingCause": "Apa penyebab kejadian ini?",
    "MissingPurpose": "Apa tujuan dari tindakan ini?",
    "SparseGraph": "Informasi tentang topik ini masih sedikit. Bisa ceritakan lebih banyak?",
    "LowGrounding": "Informasi ini belum terverifikasi. Bisakah mengonfirmasi?",
}
#: Names of roles in questions; others are lower-cased.
ROLE_LABELS = {"Agent": "pelaku", "Patient": "objek", "Cause": "penyebab", "Purpose": "tujuan", "Location": "lokasi", "Subject": "subjek", "Complement": "pelengkap", "Possessor": "pemilik", "Possession": "milikan"}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def atom_gaps(comps: DataFrame, members: DataFrame) -> DataFrame:
    """comp_id, gap, role: for an Event every expected role that no member plays; for a HiddenMeaning without a Problem or a Solution, the first of these that it lacks. Other types have no such gaps."""
    held = members.groupBy("comp_id").agg(F.collect_set("role").alias("roles"))
    rows = comps.join(held, "comp_id", "left").select("comp_id", "comp_type", F.coalesce("roles", F.array()).alias("roles"))
    event = F.array_except(F.array(*[F.lit(r) for r in EVENT_ROLES]), F.col("roles"))
    hidden = F.slice(F.array_except(F.array(F.lit("Problem"), F.lit("Solution")), F.col("roles")), 1, 1)
    lacking = rows.select("comp_id", "comp_type", F.explode(F.when(F.col("comp_type") == "Event", event).when(F.col("comp_type") == "HiddenMeaning", hidden)).alias("role"))
    kind = F.when(F.col("comp_type") == "Event", _map(EVENT_ROLES)[F.col("role")]).otherwise("IncompleteHiddenMeaning")
    return lacking.select("comp_id", kind.alias("gap"), "role")


def grounding_gaps(comps: DataFrame) -> DataFrame:
    kind = F.when((F.col("epistemic") == "Inferred") & (F.col("confidence") < 0.5), "LowGrounding").when(F.col("epistemic") == "Contradicted", "UnresolvedContradiction")
    return comps.select("comp_id", kind.alias("gap"), F.lit(None).cast("string").alias("role")).where("gap IS NOT NULL")


def _folded(members: DataFrame, gaps: DataFrame, **flags: DataFrame) -> DataFrame:
    """comp_id, m (its members in order), g (its gaps), and which of the other tables have it: one shuffle of them all."""
    every = members.where("comp_id IS NOT NULL").select("comp_id", F.struct("pos", "node_id", "role", "confidence").alias("m"))
    every = every.unionByName(gaps.select("comp_id", F.struct("gap", "role").alias("g")) if "gap" in gaps.columns else gaps.select("comp_id", F.struct(F.lit("").alias("gap"), "role").alias("g")), allowMissingColumns=True)
    for name, rows in flags.items():
        every = every.unionByName(rows.where("comp_id IS NOT NULL").select("comp_id", F.lit(True).alias(name)), allowMissingColumns=True)
    return kept(every.groupBy("comp_id").agg(F.array_sort(F.collect_list("m")).alias("m"), F.collect_list("g").alias("g"), *[F.max(name).alias(name) for name in flags]), "gaps")


def _recalled(folded: DataFrame) -> DataFrame:
    """The gaps of _folded(), a row each, with the candidate for their role (b: candidate, n, c).

    Of several nodes in a role, a composition's first by place, then id, then confidence counts.
    A composition looks at no more than its number of nodes plus one of a role's nodes in their order, so
    each role has a list of so many, which is broadcast, and no two compositions meet.
    """
    by_role = F.array_sort(F.transform("m", lambda x: F.struct(*[x[c].alias(c) for c in ("role", "pos", "node_id", "confidence")])))
    first = F.filter("r", lambda x, i: (i == 0) | ~x["role"].eqNullSafe(F.get("r", i - 1)["role"]))
    plays = folded.select(by_role.alias("r")).select(F.inline(first)).groupBy("role", F.col("node_id").alias("candidate")).agg(F.count("*").alias("n"), F.avg("confidence").alias("c"))
    nodes = F.array_compact(F.array_distinct(F.transform("m", lambda x: x["node_id"])))
    most = folded.agg(F.max(F.size(nodes))).first()[0] or 0  # one number: how long a role's list has to be
    order = Window.partitionBy("role").orderBy(F.desc("n"), "candidate")
    places = plays.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most + 1)
    lists = places.groupBy("role").agg(F.array_sort(F.collect_list(F.struct("place", "candidate", "n", "c"))).alias("tried"))
    rows = folded.withColumn("g", F.explode("g")).select("*", "g.gap", "g.role").drop("g").join(F.broadcast(lists), "role", "left")
    best = F.get(F.filter("tried", lambda x: ~F.array_contains("nodes", x["candidate"])), 0)
    return rows.withColumn("nodes", nodes).withColumn("b", best).drop("nodes", "tried")


def _candidate() -> tuple[Column, Column]:
    return F.col("b.candidate").alias("candidate"), (F.col("b.c") * F.col("b.n") / F.greatest(F.lit(3), F.col("b.n"))).alias("candidate_confidence")


def candidates(gaps: DataFrame, members: DataFrame) -> DataFrame:
    """comp_id, role, candidate, candidate_confidence: the node that plays the role in most other compositions and isn't in this one; ties go to the smaller id."""
    return _recalled(_folded(members, gaps.where("role IS NOT NULL"))).where("b IS NOT NULL").select("comp_id", "role", *_candidate()).distinct()


def evidence(comps: DataFrame, members: DataFrame, of: DataFrame) -> DataFrame:
    """Of compositions (comp_id), those that share a node with another one, or that are not of the only origin there is. Nodes are looked at only where there is one origin, or a composition that isn't known."""
    one = comps.agg(F.min("origin").alias("one"), F.max("origin").alias("two")).first()
    asked = kept(of.where("comp_id IS NOT NULL").distinct(), "asked")
    told = asked.join(comps, "comp_id", "left_semi") if one.one != one.two else asked.limit(0)
    rest = asked.join(comps, "comp_id", "left_anti") if one.one != one.two else asked
    if rest.isEmpty():
        return told
    shared = members.groupBy("node_id").agg(F.min("comp_id").alias("a"), F.max("comp_id").alias("b")).where("a <> b")
    return told.unionAll(members.join(rest, "comp_id", "left_semi").join(shared, "node_id", "left_semi").select("comp_id").distinct())


def strategies(gaps: DataFrame, comps: DataFrame, members: DataFrame, with_text: DataFrame) -> DataFrame:
    """How to fill each gap (comp_id, gap, role), what confidence that may add, and what to ask a user.

    A missing role is recalled if the graph has a candidate. Otherwise, as for contradictions and hidden meanings, a composition
    with a source text (``with_text``: comp_id) is read again, and one without is asked about. Weak grounding is read again if
    there is other evidence, and put off if not, as a sparse graph is. Members and gaps are shuffled once.
    """
    weak = gaps.where("gap = 'LowGrounding'").select("comp_id")
    rows = _recalled(_folded(members, gaps, has_text=with_text, has_evidence=evidence(comps, members, weak))).select("*", *_candidate())
    missing = F.col("gap").isin("MissingRole", "MissingCause", "MissingPurpose")
    again = F.when(F.col("has_text"), "ReExtraction").otherwise("AskUser")
    way = F.when(missing & F.col("candidate").isNotNull(), "PassiveRecall").when(F.col("gap") == "SparseGraph", "Defer").when(F.col("gap") == "LowGrounding", F.when(F.col("has_evidence"), "ReExtraction").otherwise("Defer")).otherwise(again)
    context = F.array_join(F.transform(F.filter("m", lambda x: x["role"] != F.col("role")), lambda x: x["node_id"]), " ")
    role = F.coalesce(_map(ROLE_LABELS)[F.col("role")], F.lower("role"))
    asked = F.when(context == "", F.concat(F.lit("Siapa/apa yang berperan sebagai "), role, F.lit(" di sini?"))).otherwise(F.concat(F.lit("Dalam '"), context, F.lit("', siapa/apa yang berperan sebagai "), role, F.lit("?")))
    told = rows.withColumn("strategy", way)
    gain = F.when(F.col("strategy") == "PassiveRecall", F.col("candidate_confidence") * 0.1).when(F.col("strategy") == "ReExtraction", 0.15).when(F.col("strategy") == "AskUser", 0.2).otherwise(0.0)
    question = F.when(F.col("strategy") == "AskUser", F.when(F.col("gap") == "MissingRole", asked).otherwise(_map(QUESTIONS)[F.col("gap")]))
    recalled = F.when(F.col("strategy") == "PassiveRecall", F.col("candidate"))
    return told.select("comp_id", "gap", "role", "strategy", recalled.alias("candidate"), F.round(gain + 1e-9, 6).alias("gain"), question.alias("question"))
