"""Messages of conversations: shifts of topic, links, sessions and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.scores import jaccard
from weftgraph.operators.temporal import running_sum
from weftgraph.sources.scratch import kept

#: About how many messages of a conversation are compared with as many others in one group, and words of 64 bits that tell parities of their words.
BLOCK, WORDS = 64, 4


def topic_shifts(messages: DataFrame, key: str = "conv_id", order: str = "turn", atoms: str = "atoms") -> DataFrame:
    """Each message with words against the one before: overlap, magnitude, and whether less than half is shared."""
    w = Window.partitionBy(key).orderBy(order)
    rows = messages.where(F.size(atoms) > 0).withColumn("before", F.lag(atoms).over(w)).where("before IS NOT NULL")
    overlap = F.round(jaccard(F.col(atoms), F.col("before")), 3)
    return rows.select(key, order, overlap.alias("overlap"), F.round(1 - overlap, 3).alias("magnitude"), (overlap < 0.5).alias("shift"))


def _parity(items: str, k: int) -> Column:
    """Of an array of distinct items dealt to 64 * WORDS bits: the k-th 64 of them, set where an odd number of items is dealt."""
    bit = lambda x: F.when(F.pmod(F.shiftright(F.xxhash64(x), 6), F.lit(WORDS)) == k, F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(x).bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long"))
    return F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(bit(x)))


def semantic_links(messages: DataFrame, least: float = 0.3) -> DataFrame:
    """Links from a message to an earlier one of its conversation: conv_id, a, b, link, weight.

    A semantic link if more than ``least`` of both messages' words is shared; an elaboration if all of its words are among the
    other's more, and both have one role. A conversation's messages are dealt to blocks of about BLOCK, and each pair of blocks
    is a group of its own, so a message is sent once a block, not once a pair. Sizes and parities of words
    rule most pairs out before their words are compared.
    """
    atoms = messages.select("conv_id", "turn", "role", F.array_distinct("atoms").alias("atoms")).where(F.size("atoms") > 0)
    flat = atoms.select("conv_id", "turn", "role", "atoms", F.size("atoms").alias("n"), *[_parity("atoms", k).alias(f"p{k}") for k in range(WORDS)])
    sets = kept(flat, "messages")
    blocks = sets.groupBy("conv_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = sets.join(blocks, "conv_id").withColumn("block", F.pmod(F.xxhash64("turn"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("blocks", "other")
    dealt = dealt.repartition("conv_id", "low", "high")
    one, two = (dealt.select("conv_id", "low", "high", *[F.col(c).alias(f"{c}_{s}") for c in ("turn", "role", "atoms", "n", "block", *[f"p{k}" for k in range(WORDS)])]) for s in ("a", "b"))
    odd = F.bit_count(F.col("p0_a").bitwiseXOR(F.col("p0_b")))
    for k in range(1, WORDS):
        odd = odd + F.bit_count(F.col(f"p{k}_a").bitwiseXOR(F.col(f"p{k}_b")))
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    near = (small >= large * least) & (odd * (1 + least) <= (small + large) * (1 - least) + 1e-6)
    within = (F.col("n_a") < F.col("n_b")) & (F.col("role_a") == F.col("role_b")) & (odd <= F.col("n_b") - F.col("n_a"))
    here = (F.least("block_a", "block_b") == F.col("low")) & (F.greatest("block_a", "block_b") == F.col("high"))
    met = one.join(two, ["conv_id", "low", "high"]).where((F.col("turn_b") < F.col("turn_a")) & here & (near | within))
    shared = met.withColumn("shared", F.size(F.array_intersect("atoms_a", "atoms_b"))).drop("atoms_a", "atoms_b")
    overlap = F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))
    inside = (F.col("shared") == F.col("n_a")) & (F.col("n_a") < F.col("n_b")) & (F.col("role_a") == F.col("role_b"))
    link = lambda fits, name, weight: F.when(fits, F.struct(F.lit(name).alias("link"), F.round(weight, 6).alias("weight")))
    links = F.array_compact(F.array(link(overlap > least, "semantic_link", overlap), link(inside, "elaboration", F.col("n_a") / F.col("n_b"))))
    return shared.select("conv_id", F.col("turn_a").alias("a"), F.col("turn_b").alias("b"), F.inline(links))


def topics(messages: DataFrame, top: int = 10) -> DataFrame:
    """A conversation's words by how many of its messages hold them; ties in the order of the alphabet."""
    n = messages.select("conv_id", F.explode("atoms").alias("topic")).groupBy("conv_id", "topic").agg(F.count("*").alias("n"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("n"), "topic")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def newest_messages(messages: DataFrame, keep: int) -> DataFrame:
    """How many messages of each conversation stay when the oldest conversations' first messages go until ``keep`` are left.

    Counts by conversation and their running sum, the newest first, decide; messages themselves aren't sorted.
    """
    n = messages.groupBy("conv_id").agg(F.count("*").alias("n"))
    summed = running_sum(n, [F.desc("conv_id")], "n")
    return summed.select("conv_id", F.greatest(F.lit(0), F.least("n", F.lit(keep) - (F.col("running") - F.col("n")))).alias("kept"))


def sessions(rows: DataFrame, key: str, time: str, gap_seconds: int) -> DataFrame:
    """Runs of a key's rows with no gap longer than so many seconds: start, end and number."""
    w = Window.partitionBy(key).orderBy(time)
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    new = (seconds - F.lag(seconds).over(w) > gap_seconds) | F.lag(seconds).over(w).isNull()
    numbered = rows.withColumn("new", new.cast("int")).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.count("*").alias("n"))
