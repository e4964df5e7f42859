"""Senses of nodes: evidence from compositions, coherence, and which fragile ones go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weight of a composition's lack of coherence, and below what a sense counts as barely connected and as incoherent.
PENALTY, CONNECTED, COHERENT = 0.15, 0.1, 0.2


def coherence_penalty(members: DataFrame, senses: DataFrame) -> DataFrame:
    """comp_id, penalty: 0.15 of what the mean coherence over all senses (node_id, coherence) of all its members lacks of 1; 0 without senses. Senses are added up by node before members meet them."""
    by_node = senses.groupBy("node_id").agg(F.sum("coherence").alias("s"), F.count("coherence").alias("k"))
    sums = members.join(by_node, "node_id", "left").groupBy("comp_id").agg(F.sum("s").alias("s"), F.sum("k").alias("k"))
    return sums.select("comp_id", F.round(F.coalesce((1 - F.try_divide("s", "k")) * PENALTY, F.lit(0.0)) + 1e-9, 6).alias("penalty"))


def evidence(members: DataFrame, told: DataFrame) -> DataFrame:
    """node_id, confirming, contradicting: how many compositions that were told of (comp_id, confirms) a node is in, by what they say of its senses."""
    once = members.select("comp_id", "node_id").distinct().join(told, "comp_id")
    return once.groupBy("node_id").agg(F.count_if("confirms").alias("confirming"), F.count_if(~F.col("confirms")).alias("contradicting"))


def kept(senses: DataFrame, members: DataFrame, evidence: DataFrame) -> DataFrame:
    """Senses (node_id, sense, grounding, coherence) but those that are fragile, barely connected, without confirming evidence and incoherent."""
    degree = members.groupBy("node_id").agg(F.least(F.lit(1.0), F.count_distinct("comp_id") / 10.0).alias("connectivity"))
    rows = senses.join(degree, "node_id", "left").join(evidence.select("node_id", "confirming"), "node_id", "left")
    gone = (F.col("grounding") == "Fragile") & (F.coalesce("connectivity", F.lit(0.0)) < CONNECTED) & (F.coalesce("confirming", F.lit(0)) == 0) & (F.col("coherence") < COHERENT)
    return rows.where(~gone).select(*senses.columns)
