"""Lookups, predicates and ranked searches over compositions and their members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.sources.scratch import kept

#: Compositions of a node from which it is a hub, whose compositions are summed by the hubs that they have. Results don't depend on it.
HUB = 4096

#: Role names that a search may ask for, with the names that stand for them.
ROLE_NAMES = {"agent": "Agent", "patient": "Patient", "instrument": "Instrument", "purpose": "Purpose", "cause": "Cause", "location": "Location", "time": "Time", "tool": "Instrument", "goal": "Purpose"}

#: Trust by kind of source; any other kind counts as unknown.
TRUST = {"user_input": 1.0, "web_search": 0.7, "academic": 0.9, "official_doc": 0.95, "wiki": 0.75, "social_media": 0.3, "unknown": 0.5}


def by_concept(comps: DataFrame, members: DataFrame, concept: str) -> DataFrame:
    """Compositions with a member of that label (1.0), or whose label holds it or is held by it (0.6 of the member's confidence); best member, raised for stable and grounded ones, at most 1."""
    label, wanted = F.lower("node_id"), F.lit(concept.lower())
    hit = F.when(label == wanted, F.lit(1.0)).when(F.contains(label, wanted) | F.contains(wanted, label), 0.6 * F.col("confidence"))
    best = members.select("comp_id", hit.alias("hit")).where("hit IS NOT NULL").groupBy("comp_id").agg(F.max("hit").alias("hit"))
    raised = F.col("hit") * F.when(F.col("lifecycle") == "Stable", 1.2).otherwise(1.0) * F.when(F.col("epistemic") == "Grounded", 1.1).otherwise(1.0)
    return comps.join(best, "comp_id").select("comp_id", F.round(F.least(F.lit(1.0), raised), 6).alias("score"))


def by_structure(comps: DataFrame, members: DataFrame, roles: list[str]) -> DataFrame:
    """Compositions that hold all the roles (relational division); unknown names are dropped, and none known gives no row."""
    wanted = sorted({ROLE_NAMES[r.lower()] for r in roles if r.lower() in ROLE_NAMES})
    held = members.where(F.col("role").isin(wanted)).groupBy("comp_id").agg(F.count_distinct("role").alias("n")).where(F.col("n") == len(wanted))
    return comps.join(held, "comp_id", "left_semi").select("comp_id", "confidence")


def neighborhood(comps: DataFrame, members: DataFrame, labels: list[str]) -> DataFrame:
    """Compositions that touch any of the labels."""
    return comps.join(members.where(F.col("node_id").isin(labels)), "comp_id", "left_semi")


def weak_frames(comps: DataFrame, members: DataFrame, expected: tuple[str, ...] = ("Agent", "Patient", "Cause"), below: float = 0.5) -> DataFrame:
    """Events of little confidence that lack an expected role, with the roles that they lack."""
    roles = members.groupBy("comp_id").agg(F.collect_set("role").alias("roles"))
    lacking = F.array_except(F.array(*[F.lit(r) for r in expected]), F.coalesce("roles", F.array()))
    events = comps.where((F.col("comp_type") == "Event") & (F.col("confidence") < below))
    return events.join(roles, "comp_id", "left").withColumn("missing", F.array_join(lacking, ",")).where("missing <> ''").select("comp_id", "missing")


def first_with_role(members: DataFrame, role: str) -> DataFrame:
    """The first member that plays a role, by position and then by node."""
    return members.where(F.col("role") == role).groupBy("comp_id").agg(F.min(F.struct("pos", "node_id", "confidence")).alias("m"), F.count("*").alias("n")).select("comp_id", "m.node_id", "m.confidence", "n")


def recently_contradicted(batch: str | Column, batches: str | Column, current: int, last: int) -> Column:
    """Whether any contradiction lies within the last batches."""
    return F.exists(batches, lambda b: b > current - last)


def sense_classes(senses: DataFrame) -> DataFrame:
    """node_id, layer, is_utterance to the classes of a node: primitive (layer 0 alone), bridge (an utterance, or two layers), derived (a layer above 0)."""
    return senses.groupBy("node_id").agg(
        (F.max("layer") == 0).alias("is_primitive"),
        (F.max("is_utterance") | (F.count_distinct("layer") >= 2)).alias("is_bridge"),
        (F.max("layer") >= 1).alias("is_derived"),
        F.max("is_utterance").alias("is_utterance_level"),
    )


def weak_rules(uses: DataFrame, gap_over: float = 0.3, repair_under: float = 0.5) -> DataFrame:
    """rule, gap, repaired to the rules that often leave gaps and are seldom repaired."""
    rates = uses.groupBy("rule").agg(F.avg(F.col("gap").cast("double")).alias("gap_rate"), F.avg(F.when(F.col("gap"), F.col("repaired").cast("double"))).alias("repair_rate"))
    return rates.where((F.col("gap_rate") > gap_over) & (F.coalesce("repair_rate", F.lit(0.0)) < repair_under)).select("rule", F.round("gap_rate", 6).alias("gap_rate"), F.round("repair_rate", 6).alias("repair_rate"))


def neighbors(edges: DataFrame, relation: str | None = None, out: bool = True) -> DataFrame:
    """Neighbours of every node along edges, or against them, with their number and mean confidence."""
    some = edges if relation is None else edges.where(F.col("relation") == relation)
    return some.groupBy(F.col("src" if out else "dst").alias("node_id")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that touch none of the nodes (node_id)."""
    keys = gone.select("node_id").distinct()
    return edges.join(keys.withColumnRenamed("node_id", "src"), "src", "left_anti").join(keys.withColumnRenamed("node_id", "dst"), "dst", "left_anti")


def in_scope(domain: Column, confidence: Column, source: Column, domains: list[str], least: float, denied: list[str]) -> Column:
    return domain.isin(domains) & (confidence >= least) & ~source.isin(denied)


def scoped_confidence(confidence: Column, inside: Column, mode: str = "soft", coverage: Column | None = None) -> Column:
    """Outside the scope: nothing if hard, three tenths if soft; adaptive is soft where at least half is covered and hard elsewhere."""
    soft, hard = F.when(inside, confidence).otherwise(0.3 * confidence), F.when(inside, confidence)
    return {"soft": soft, "hard": hard}.get(mode) if mode != "adaptive" else F.when(coverage >= 0.5, soft).otherwise(hard)


def violations(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows, for each rule (name to a condition in SQL) that fails or can't be decided: the rows' columns and ``rule``. Each row is read once."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(condition), F.lit(False)), F.lit(name)) for name, condition in rules.items()]))
    return rows.withColumn("rule", F.explode(failed))


def injectable(lifecycle: Column, epistemic: Column, confidence: Column, least: float = 0.2) -> Column:
    return lifecycle.isin("Candidate", "Stable") & (epistemic != "Contradicted") & (confidence >= least)


def trust(source: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in TRUST.items() for x in pair])[source], F.lit(TRUST["unknown"]))


def role_candidates(members: DataFrame, role: str) -> DataFrame:
    """For a composition that lacks the role: the most frequent filler elsewhere, its mean confidence scaled by n / max(3, n); ties to the smaller id."""
    fillers = members.where(F.col("role") == role).groupBy("node_id").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"))
    score = F.col("c") * F.col("n") / F.greatest(F.lit(3), F.col("n"))
    return fillers.orderBy(F.desc("n"), "node_id").limit(1).select("node_id", "n", F.round(score, 6).alias("score"))


def recent(comps: DataFrame, limit: int) -> DataFrame:
    return comps.orderBy(F.desc("created_at"), F.desc("comp_id")).limit(limit)


def recent_fillers(comps: DataFrame, members: DataFrame, limit: int = 10) -> DataFrame:
    """Of the newest compositions, the Agent, else the Patient, that stands first."""
    newest = recent(comps, limit).select("comp_id", "created_at")
    rank = F.when(F.col("role") == "Agent", 0).when(F.col("role") == "Patient", 1)
    w = Window.partitionBy("comp_id").orderBy("rank", "pos")
    first = newest.join(members, "comp_id").withColumn("rank", rank).where("rank IS NOT NULL").withColumn("k", F.row_number().over(w)).where("k = 1")
    return first.select("comp_id", "node_id", F.when(F.col("rank") == 0, 0.6).otherwise(0.5).alias("score"))


def graph_context(members: DataFrame, asked: DataFrame, hub: int = HUB) -> DataFrame:
    """For the compositions asked about (comp_id): by role, their own members at full confidence, and those of every other one that shares a node with them, at 0.7, but for shared nodes.

    Nodes of more than ``hub`` compositions are hubs. Compositions of equal hubs are one class, and what a class sums to is told
    once to all asked about that have one of its hubs. Of the other compositions, none of the asked one's hubs in them, sums by
    node and class are added up; those that share several nodes counted several times, and are taken off again, so pairs of
    compositions are made only for nodes that aren't hubs and travel as two ids. What shared nodes give is taken off by node,
    as every composition that holds one counts.
    """
    names, own = asked.select("comp_id").distinct(), members.join(asked.select("comp_id").distinct(), "comp_id", "left_semi")
    source = kept(members.select("node_id", "comp_id").distinct(), "memberships")
    hubs = kept(source.groupBy("node_id").agg(F.count("*").alias("k")).where(F.col("k") > hub).select("node_id"), "hubs")
    # the class of a composition: its hubs in ascending order
    classes = source.join(hubs, "node_id").groupBy("comp_id").agg(F.array_sort(F.collect_list("node_id")).alias("hubs"))
    none = F.array().cast(classes.schema["hubs"].dataType)
    profile = members.groupBy("comp_id", "role").agg(F.count("*").alias("n"), F.sum("confidence").alias("w"))
    classed = kept(profile.join(classes, "comp_id", "left").withColumn("hubs", F.coalesce("hubs", none)), "profiles")
    sums = classed.where(F.size("hubs") > 0).groupBy("hubs", "role").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    asking = kept(names.join(classes, "comp_id", "left").withColumn("hubs", F.coalesce("hubs", none)), "asking")
    kinds = lambda rows, name: rows.select(F.col("hubs").alias(name)).distinct().withColumn("hub", F.explode(name))
    meet = kinds(asking, "ours").join(kinds(sums, "hubs"), "hub").select("ours", "hubs").distinct()
    by_class = meet.join(sums, "hubs").groupBy("ours", "role").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    by_hubs = asking.join(by_class.withColumnRenamed("ours", "hubs"), "hubs").select("comp_id", "role", "n", (0.7 * F.col("w")).alias("w"))
    rare = source.join(hubs, "node_id", "left_anti")
    ours = rare.join(asking, "comp_id").select("node_id", F.col("comp_id").alias("asked"), F.col("hubs").alias("ours"))
    theirs = rare.join(ours.select("node_id").distinct(), "node_id", "left_semi")
    apart = ~F.arrays_overlap("ours", "hubs")
    at_node = theirs.join(classed, "comp_id").groupBy("node_id", "hubs", "role").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    by_nodes = ours.join(at_node, "node_id").where(apart).groupBy(F.col("asked").alias("comp_id"), "role").agg(F.sum("n").alias("n"), (0.7 * F.sum("w")).alias("w"))
    often = ours.select("node_id", "asked").join(theirs, "node_id").groupBy("asked", "comp_id").agg(F.count("*").alias("k")).where("k > 1")
    again = often.join(asking.select(F.col("comp_id").alias("asked"), F.col("hubs").alias("ours")), "asked").join(classed, "comp_id").where(apart)
    again = again.select(F.col("asked").alias("comp_id"), "role", (F.col("n") * (1 - F.col("k"))).alias("n"), (0.7 * F.col("w") * (1 - F.col("k"))).alias("w"))
    total = by_hubs.unionAll(by_nodes).unionAll(again)
    # others' members that are its own nodes: all that such a node plays anywhere but in the composition itself, whose own profile the sums hold too
    plays = members.groupBy("node_id", "role").agg(F.count("*").alias("n"), F.sum("confidence").alias("w"))
    shared = own.select("comp_id", "node_id").distinct().join(plays, "node_id").select("comp_id", "role", (-F.col("n")).alias("n"), (-0.7 * F.col("w")).alias("w"))
    first = own.select("comp_id", "role", F.lit(1).cast("long").alias("n"), F.col("confidence").alias("w"))
    return total.unionAll(shared).unionAll(first).groupBy("comp_id", "role").agg(F.sum("n").alias("n"), F.round(F.sum("w"), 4).alias("weight")).where("n > 0")
