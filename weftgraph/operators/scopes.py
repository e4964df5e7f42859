"""Scopes in a tree, whose limits only get narrower downwards, and traversals that stay within one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.sources.scratch import kept

#: What a soft boundary leaves of a confidence outside, and from which share of nodes inside an adaptive one is hard.
SOFT, ADAPTIVE = 0.3, 0.5

LIMITS = ("domain", "topics", "min_confidence", "max_depth", "allowed", "denied", "seeds")


def closed(scopes: DataFrame, most_levels: int = 64) -> DataFrame:
    """scope, parent, level and the limits of every scope (scope, parent, and LIMITS) with those of all above it.

    Denied sources and topics are united; sources allowed are the scope's own, else its parent's; confidence takes the greatest
    minimum, depth the least maximum; seeds count only if they do all the way up; the domain ``general`` means the parent's.
    A scope that allows what one above it denies, or what its parent doesn't allow, is an error, as is one whose parent isn't
    there. A level of the tree is one join; nothing but an offender's name reaches the driver.
    """
    lists = ("topics", "allowed", "denied")
    rows = kept(scopes.select("scope", "parent", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) if c in lists else F.col(c) for c in LIMITS]), "scopes")
    done = kept(rows.where("parent IS NULL").withColumn("level", F.lit(0)), "scopes-0")
    last, found = done, done.count()
    for level in range(1, most_levels + 1):
        up = last.select(F.col("scope").alias("parent"), *[F.col(c).alias(f"up_{c}") for c in LIMITS])
        joined = rows.join(up, "parent")
        wider = F.size(F.array_intersect("allowed", "up_denied")) > 0
        wider = wider | ((F.size("up_allowed") > 0) & (F.size(F.array_except("allowed", "up_allowed")) > 0))
        union = lambda c: F.array_sort(F.array_union(c, f"up_{c}"))
        limits = {
            "domain": F.when(F.col("domain") != "general", F.col("domain")).otherwise(F.col("up_domain")),
            "topics": union("topics"),
            "min_confidence": F.greatest("min_confidence", "up_min_confidence"),
            "max_depth": F.least("max_depth", "up_max_depth"),
            "allowed": F.when(F.size("allowed") > 0, F.array_sort(F.array_distinct("allowed"))).otherwise(F.col("up_allowed")),
            "denied": union("denied"),
            "seeds": F.col("seeds") & F.col("up_seeds"),
        }
        told = kept(joined.select("scope", "parent", *[c.alias(name) for name, c in limits.items()], F.lit(level).alias("level"), wider.alias("_wider")), f"scopes-{level}")
        bad = told.where("_wider").select("scope").first()
        if bad:
            raise ValueError(f"scope {bad.scope} allows sources that a scope above it doesn't")
        last = told.drop("_wider")
        n = last.count()
        if not n:
            break
        done, found = done.unionByName(last), found + n
    if found != rows.count():
        raise ValueError("some scopes have no root above them")
    return done


def within(source: Column, confidence: Column, allowed: Column, denied: Column, least: Column) -> Column:
    """Whether a row's source and confidence fit a scope's limits."""
    return (confidence >= least) & ~F.array_contains(denied, source) & ((F.size(allowed) == 0) | F.array_contains(allowed, source))


def traverse(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int, boundary: str) -> DataFrame:
    """seed, node_id, depth, confidence and inside of the nodes (node_id, confidence, inside) that steps along edges (src, dst) reach from seeds (node_id).

    A hard boundary leaves nodes outside out, and what only they lead to; a soft one keeps them with SOFT of their confidence; an
    adaptive one is hard where ADAPTIVE of all nodes or more are inside. Nodes that the table doesn't have have no confidence and
    are outside.
    """
    if boundary not in ("hard", "soft", "adaptive"):
        raise ValueError(f"no such boundary: {boundary}")
    if boundary == "adaptive":
        share = nodes.agg(F.avg(F.col("inside").cast("double")).alias("s")).first().s
        boundary = "hard" if (share or 0.0) >= ADAPTIVE else "soft"
    steps = kept(edges.select("src", "dst"), "steps")  # read by every hop; what is reached twice becomes one below
    known = kept(nodes.select("node_id", "confidence", "inside"), "known")

    def seen(front: DataFrame) -> DataFrame:
        told = front.join(known, "node_id", "left").withColumns({"confidence": F.coalesce("confidence", F.lit(0.0)), "inside": F.coalesce("inside", F.lit(False))})
        return told.where("inside") if boundary == "hard" else told.withColumn("confidence", F.when(F.col("inside"), F.col("confidence")).otherwise(F.col("confidence") * SOFT))

    columns = ("seed", "node_id", "depth", "confidence", "inside")
    front = seen(seeds.select(F.col("node_id").alias("seed"), "node_id", F.lit(0).alias("depth")).distinct()).select(*columns)
    found = front
    for d in range(1, depth + 1):
        new = front.join(steps, front.node_id == steps.src).select("seed", F.col("dst").alias("node_id"), F.lit(d).alias("depth")).distinct()
        front = kept(seen(new.join(found.select("seed", "node_id"), ["seed", "node_id"], "left_anti")).select(*columns), "scoped")
        found = found.unionByName(front)
    return found
