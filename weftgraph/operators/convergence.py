"""Compositions that may mean the same, and those of one structure that say different things: counts of pairs by classes, without making the pairs.

Compositions of one type and one set of roles form a class. What two compositions' roles have in common is then one number a pair
of classes, and most pairs are told from the sizes of classes alone; only pairs that share rare nodes are looked at one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.scores import jaccard, role_weighted
from weftgraph.sources.scratch import kept

#: Least similarity, most nodes that a converging pair shares, least confidence of its compositions, and the part of roles in the similarity.
LEAST_OVERLAP, MOST_SHARED, LEAST_CONFIDENCE, ROLE_PART = 0.6, 2, 0.3, 0.6


def structures(comps: DataFrame, members: DataFrame) -> DataFrame:
    """comp_type, roles (in order, joined by commas), comp_id and nodes (in order) of every composition that has members."""
    sets = members.groupBy("comp_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.array_sort(F.collect_set("node_id")).alias("nodes"))
    return comps.select("comp_id", "comp_type").join(sets, "comp_id")


def sharing_pairs(sets: DataFrame, group: str, prefix: Column, twos: bool = False) -> DataFrame:
    """group, a < b and shared of the pairs of sets (group, comp_id, nodes) that have a node in common among the ``prefix`` first nodes of each, the rarest first; prefix is a column of n, the set's size. With ``twos``, that have two: sets then meet on pairs of nodes, which hardly any share by chance."""
    flat = sets.select(group, "comp_id", F.explode("nodes").alias("i"), F.size("nodes").alias("n"))
    often = flat.groupBy(group, "i").agg(F.count("*").alias("d"))
    ordered = flat.join(often, [group, "i"]).groupBy(group, "comp_id", "n").agg(F.array_sort(F.collect_list(F.struct("d", "i"))).alias("o"))
    nodes = F.transform(F.slice("o", 1, F.greatest(F.lit(0), prefix.cast("int"))), lambda x: x["i"])
    first = kept(ordered.select(group, "comp_id", nodes.alias("p")), "first-nodes")
    if twos:
        first = first.select(group, "comp_id", "p", F.posexplode("p").alias("k", "i"))
        first = first.select("comp_id", group, "i", F.explode(F.slice("p", F.col("k") + 2, F.greatest(F.lit(0), F.size("p") - F.col("k") - 1))).alias("j"))
    else:
        first = first.select("comp_id", group, F.explode("p").alias("i"))
    first = first.select("comp_id", F.xxhash64(group, "i", *(["j"] if twos else [])).alias("h"))  # a number sorts fast; what only hashes alike is told apart below
    met = first.withColumnRenamed("comp_id", "a").join(first.withColumnRenamed("comp_id", "b").hint("merge"), "h").where("a < b").select("a", "b").distinct()
    side = lambda c: sets.select(F.col(group).alias(f"group_{c}"), F.col("comp_id").alias(c), F.col("nodes").alias(f"n{c}"), F.col("roles").alias(f"roles_{c}"))
    told = met.join(side("a"), "a").join(side("b"), "b").where("group_a = group_b").withColumnRenamed("group_a", group).drop("group_b").where(F.arrays_overlap("na", "nb"))
    return told.withColumn("shared", F.size(F.array_intersect("na", "nb")))


def convergence(comps: DataFrame, members: DataFrame) -> DataFrame:
    """comp_type, roles_a <= roles_b, links, too_close, a, b: by pairs of classes, how many pairs of compositions converge.

    Two compositions of one type converge if they share at most MOST_SHARED nodes and 0.6 of the overlap of their roles and 0.4 of
    that of their nodes reach LEAST_OVERLAP. Those of one class always reach it, so theirs are all pairs but the too close ones;
    these share a node beyond the MOST_SHARED most frequent of each. Others need so much in common that they share one of their
    rarest nodes. a and b are the least composition of a class and the least that converges with it; of other pairs, the least.
    """
    good = comps.where((F.col("confidence") >= LEAST_CONFIDENCE) & (F.col("lifecycle") != "Deprecated"))
    sets = kept(structures(good, members), "structures")
    classes = sets.groupBy("comp_type", "roles").agg(F.count("*").alias("n"), F.min("comp_id").alias("a"))
    close = kept(sharing_pairs(sets, "comp_type", F.col("n") - MOST_SHARED + 1, twos=True).where((F.col("shared") > MOST_SHARED) & (F.col("roles_a") == F.col("roles_b"))).select("comp_type", F.col("roles_a").alias("roles"), "a", "b"), "close")
    n_close = close.groupBy("comp_type", "roles").agg(F.count("*").alias("too_close"))
    keys = ["comp_type", "roles"]
    ruled_out = close.join(classes.select(*keys, "a"), [*keys, "a"]).select(*keys, F.col("b").alias("comp_id"))
    other = sets.join(classes.select(*keys, "a"), keys).where("comp_id > a").join(ruled_out, [*keys, "comp_id"], "left_anti").groupBy(*keys).agg(F.min("comp_id").alias("b"))
    same = classes.join(n_close, keys, "left").join(other, keys, "left").withColumn("too_close", F.coalesce("too_close", F.lit(0).cast("long")))
    links = (F.col("n") * (F.col("n") - 1) / 2).cast("long") - F.col("too_close")
    told = same.select("comp_type", F.col("roles").alias("roles_a"), F.col("roles").alias("roles_b"), links.alias("links"), "too_close", F.when(F.col("b").isNotNull(), F.col("a")).alias("a"), "b")

    role_overlap = jaccard(F.split("roles_a", ","), F.split("roles_b", ","))
    one, two = (classes.select("comp_type", F.col("roles").alias(f"roles_{c}")) for c in ("a", "b"))
    nearest = one.join(two, "comp_type").where("roles_a < roles_b").agg(F.max(role_overlap)).first()[0]  # role sets are few
    if nearest is None:
        return told.where("links > 0 OR too_close > 0")
    need = (LEAST_OVERLAP - ROLE_PART * nearest) / (1 - ROLE_PART)  # of the overlap of nodes, by any two classes
    n = F.col("n")
    small = sets.where(F.size("nodes") * need <= MOST_SHARED + 1e-9)  # shared nodes are at most MOST_SHARED of all that the larger one has
    met = sharing_pairs(small, "comp_type", n - F.ceil(n * need - 1e-9) + 1).where((F.col("roles_a") != F.col("roles_b")) & (F.col("shared") <= MOST_SHARED))
    score = role_weighted(role_overlap, F.col("shared") / F.size(F.array_union("na", "nb")))
    fits = met.where(score + 1e-9 >= LEAST_OVERLAP)
    low, high = F.least("roles_a", "roles_b"), F.greatest("roles_a", "roles_b")
    pair = F.min(F.struct("a", "b"))
    apart = fits.groupBy("comp_type", low.alias("roles_a"), high.alias("roles_b")).agg(F.count("*").alias("links"), F.lit(0).cast("long").alias("too_close"), pair.alias("p")).select("comp_type", "roles_a", "roles_b", "links", "too_close", "p.a", "p.b")
    return told.where("links > 0 OR too_close > 0").unionByName(apart)


def equivalence_mismatches(comps: DataFrame, members: DataFrame) -> DataFrame:
    """comp_type, roles, pairs, mismatches: how many pairs of one class of compositions, but events, fill their roles differently.

    Hidden meanings do if they have one problem and two solutions, by the first member of each role. Others do if a member of the
    earlier composition (by id) isn't the later one's first member of its role; predicates don't count. So the earlier one must have
    one node a role, and these must be the later one's first ones: such pairs are counted by groups of equal fillers and taken off.
    """
    first = members.groupBy("comp_id", "role").agg(F.min_by("node_id", F.struct("pos", "node_id")).alias("node"), F.count_distinct("node_id").alias("k"))
    filled = first.where("role <> 'Predicate'")
    fillers = filled.groupBy("comp_id").agg(F.array_sort(F.collect_list(F.struct("role", "node"))).alias("fillers"), (F.max("k") == 1).alias("single"))
    of = lambda r: F.max(F.when(F.col("role") == r, F.col("node")))
    meanings = first.groupBy("comp_id").agg(of("Problem").alias("problem"), of("Solution").alias("solution"))
    rows = structures(comps.where("comp_type <> 'Event'"), members).join(fillers, "comp_id", "left").join(meanings, "comp_id", "left").withColumns({"fillers": F.coalesce("fillers", F.array().cast("array<struct<role:string,node:string>>")), "single": F.coalesce("single", F.lit(True))})
    rows = kept(rows.select("comp_type", "roles", "comp_id", "fillers", "single", "problem", "solution"), "fillers")
    keys, two = ["comp_type", "roles"], lambda n: (n * (n - 1) / 2).cast("long")
    classes = rows.groupBy(*keys).agg(two(F.count("*")).alias("pairs"))
    plain = rows.where("comp_type <> 'HiddenMeaning'")
    groups = plain.groupBy(*keys, "fillers").agg(F.count("*").alias("n"), F.count_if("single").alias("s"))
    alike = groups.where("s = n").select(*keys, two(F.col("n")).alias("equal"))
    mixed = plain.join(groups.where("s > 0 AND s < n").select(*keys, "fillers"), [*keys, "fillers"])
    later = Window.partitionBy(*keys, "fillers").orderBy(F.desc("comp_id"))
    some = mixed.withColumn("after", F.row_number().over(later) - 1).where("single").select(*keys, F.col("after").cast("long").alias("equal"))
    equal = alike.unionByName(some).groupBy(*keys).agg(F.sum("equal").alias("equal"))
    hidden = rows.where("comp_type = 'HiddenMeaning' AND problem IS NOT NULL AND solution IS NOT NULL")
    by_solution = hidden.groupBy(*keys, "problem", "solution").agg(F.count("*").alias("n"))
    apart = by_solution.groupBy(*keys, "problem").agg((two(F.sum("n")) - F.sum(two(F.col("n")))).alias("apart")).groupBy(*keys).agg(F.sum("apart").alias("apart"))
    told = classes.join(equal, keys, "left").join(apart, keys, "left")
    mismatches = F.when(F.col("comp_type") == "HiddenMeaning", F.coalesce("apart", F.lit(0))).otherwise(F.col("pairs") - F.coalesce("equal", F.lit(0)))
    return told.select(*keys, "pairs", mismatches.cast("long").alias("mismatches"))


def role_aware(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b and similarity of pairs of compositions: the overlap of their sets of (role, node), counted by joins; 1 for two without members."""
    own = members.select("comp_id", "role", "node_id").distinct()
    n = own.groupBy("comp_id").agg(F.count("*").alias("n"))
    side = lambda c: n.select(F.col("comp_id").alias(c), F.col("n").alias(f"n_{c}"))
    both = pairs.join(own.withColumnRenamed("comp_id", "a"), "a").join(own.withColumnRenamed("comp_id", "b"), ["b", "role", "node_id"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    of = lambda c: F.coalesce(c, F.lit(0))
    told = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").join(both, ["a", "b"], "left")
    return told.select("a", "b", F.round(F.coalesce(F.try_divide(of("shared"), of("n_a") + of("n_b") - of("shared")), F.lit(1.0)), 6).alias("similarity"))
