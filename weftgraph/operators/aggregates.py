"""Counts, rates and scores by group."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import scores as S


def summary(comps: DataFrame) -> DataFrame:
    """Count and mean confidence by lifecycle, by epistemic state, and of all."""
    sets = comps.groupingSets([["lifecycle"], ["epistemic"], []], "lifecycle", "epistemic")
    return sets.agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


def connectivity(members: DataFrame) -> DataFrame:
    """node_id, compositions, and a tenth of their number, at most 1."""
    n = members.groupBy("node_id").agg(F.count_distinct("comp_id").alias("n"))
    return n.select("node_id", "n", F.least(F.lit(1.0), F.col("n") / 10.0).alias("connectivity"))


def node_index(members: DataFrame) -> DataFrame:
    """How many compositions a node is in, and the first and last of them."""
    return members.groupBy("node_id").agg(F.count_distinct("comp_id").alias("n"), F.min("comp_id").alias("first_comp"), F.max("comp_id").alias("last_comp"))


def role_properties(members: DataFrame) -> DataFrame:
    return members.groupBy("comp_id", "role").agg(F.round(F.sum("confidence"), 6).alias("weight"))


def role_entropy(members: DataFrame) -> DataFrame:
    return members.groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("node_id").alias("nodes"), F.round(F.avg("confidence"), 6).alias("confidence"))


def seed_scores(comps: DataFrame, members: DataFrame) -> DataFrame:
    """Trust, risk, value, goal and identity of a composition, their blend, and the confidence anchored to it.

    The weight of the blend is twice the mean distance of the scores from one half, at most 0.4.
    """
    n = F.size("contradictions")
    parts = members.groupBy("comp_id").agg(F.avg("confidence").alias("value"), F.count_if(F.col("role") == "Purpose").alias("purposes"), F.count_if(F.col("role") == "Agent").alias("agents"))
    scored = comps.join(parts, "comp_id").select(
        "comp_id", "confidence", F.lit(0.45).alias("trust"),
        F.when(F.col("epistemic") == "Contradicted", 0.8).otherwise(F.least(F.lit(1.0), 0.2 + 0.1 * n)).alias("risk"),
        "value", F.least(F.lit(0.9), 0.2 + 0.15 * F.col("purposes")).alias("goal"), F.least(F.lit(0.8), 0.2 + 0.1 * F.col("agents")).alias("identity"),
    )
    five = [F.col(c) for c in ("trust", "risk", "value", "goal", "identity")]
    overall = 0.3 * F.col("trust") + 0.2 * (1 - F.col("risk")) + 0.2 * F.col("value") + 0.15 * F.col("goal") + 0.15 * F.col("identity")
    away = sum((F.abs(c - 0.5) for c in five[1:]), F.abs(five[0] - 0.5)) / 5
    mean = sum(five[1:], five[0]) / 5
    weight = F.least(F.lit(0.4), 2 * away)
    return scored.select("comp_id", "value", overall.alias("overall"), (F.col("confidence") * (1 - weight) + mean * weight).alias("anchored"))


def ema(rows: DataFrame, key: str, order: list[str], value: str, alpha: float, start: float) -> DataFrame:
    """Exponential moving average at the end of each key's rows, by its closed form: no fold, so partial sums combine."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    aged = rows.withColumn("age", F.row_number().over(w) - 1)
    terms = F.sum(alpha * F.pow(F.lit(1 - alpha), F.col("age")) * F.col(value))
    return aged.groupBy(key).agg(F.round(terms + start * F.pow(F.lit(1 - alpha), F.count("*")), 6).alias("ema"))


def calibration_bins(rows: DataFrame, confidence: str, outcome: str, bins: int = 10) -> DataFrame:
    """bin, n, mean confidence and accuracy; the last bin is open to the right."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(confidence) * bins)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("conf"), F.avg(F.col(outcome).cast("double")).alias("acc"))


def calibration_error(rows: DataFrame, confidence: str, outcome: str, bins: int = 10) -> DataFrame:
    one = calibration_bins(rows, confidence, outcome, bins)
    return one.agg(F.round(F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n"), 6).alias("ece"), F.sum("n").alias("n"))


def calibrated(bins: DataFrame, smooth: float = 50.0, dead: float = 0.05) -> DataFrame:
    """A bin's correction: the gap between accuracy and confidence, trusted by n / smooth, none within the dead band."""
    gap = F.col("acc") - F.col("conf")
    fix = F.when(F.abs(gap) < dead, 0.0).otherwise(gap * F.least(F.lit(1.0), F.col("n") / smooth))
    return bins.select("bin", "n", F.round(fix, 6).alias("correction"))


def edge_assessment(rows: DataFrame, key: str, confidence: str, won: str) -> DataFrame:
    """Expected value of a path by its win rate and the mean confidences of wins and losses: pass, caution or reject."""
    one = rows.groupBy(key).agg(F.avg(F.col(won).cast("double")).alias("wr"), F.coalesce(F.avg(F.when(F.col(won), F.col(confidence))), F.lit(0.0)).alias("up"), F.coalesce(F.avg(F.when(~F.col(won), F.col(confidence))), F.lit(0.0)).alias("down"))
    value = F.round(F.least(F.col("wr") * F.col("up") - (1 - F.col("wr")) * F.col("down"), 2 * F.col("wr") - 1), 6)
    return one.select(key, value.alias("ev"), F.when(value > 0.05, "pass").when(value > -0.05, "caution").otherwise("reject").alias("verdict"))


def step_confidence(step: Column, confidence: Column) -> tuple[Column, Column]:
    """Weighted confidence and weight of a reasoning step, counted from 1."""
    weight = F.when(step == 1, 0.10).when(step == 2, 0.15).when(step.isin(3, 4), 0.20).when(step == 5, 0.35).otherwise(0.05)
    return weight * confidence, weight


def origin_trust(comps: DataFrame, trust: Column) -> DataFrame:
    return comps.groupBy("origin").agg(F.count("*").alias("n"), F.round(F.avg(trust * F.col("confidence")), 6).alias("trusted"))


def learned_markers(rows: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """Patterns seen at least so often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def topology_currents(edges: DataFrame) -> DataFrame:
    """Sum of confidence over a node's edges in both directions."""
    both = edges.select(F.col("src").alias("node_id"), "confidence").unionAll(edges.select(F.col("dst").alias("node_id"), "confidence"))
    return both.groupBy("node_id").agg(F.round(F.sum("confidence"), 4).alias("current"))


#: Steps of the fit, their rate, and how many observations it takes.
STEPS, RATE, LEAST_SEEN = 1000, 0.01, 10


def platt(seen: DataFrame, raw: str, right: str, digits: int = 4) -> DataFrame:
    """For each raw confidence, rounded so that there are at most 10 ** digits of 0 to 1: how often it was seen and was right, and sigmoid(a * raw + b), fitted by gradient descent; a = 1 and b = 0 with too few.

    Observations are counted by Spark; the fit takes its thousand steps over the counts.
    """
    counts = seen.groupBy(F.round(raw, digits).alias(raw)).agg(F.count("*").alias("n"), F.sum(right).cast("long").alias(right))
    rows = counts.orderBy(raw).collect()  # at most 10 ** digits rows
    x, n, y = (np.array([r[c] for r in rows], np.float64) for c in (raw, "n", right))
    a, b = 1.0, 0.0
    if n.sum() >= LEAST_SEEN:
        for _ in range(STEPS):
            error = n / (1 + np.exp(-np.clip(a * x + b, -500, 500))) - y
            a, b = a - RATE * (error * x).sum() / n.sum(), b - RATE * error.sum() / n.sum()
    return counts.select("*", F.round(S.logistic(a * F.col(raw) + b), 6).alias("calibrated"))
