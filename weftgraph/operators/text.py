"""Positional statistics of tokens, keywords, and frames of sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that say nothing by themselves.
STOPWORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


def bucket(pos: Column, n: Column) -> Column:
    """0 for the first token, -1 for the last of more than three, the place for up to three, 1 in between."""
    return F.when(n <= 3, pos).when(pos == 0, 0).when(pos == n - 1, -1).otherwise(1)


def position_counts(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """token, bucket, n over all sentences: one pass with the sentence's length, then a sum that combines in each task."""
    n = F.max("pos").over(Window.partitionBy(key, "sent")) + 1
    return tokens.withColumn("bucket", bucket(F.col("pos"), n)).groupBy("token", "bucket").agg(F.count("*").alias("n"))


def token_entropy(counts: DataFrame, least: int = 5) -> DataFrame:
    """Entropy of a token's places over four buckets, as a share of the most: low ones anchor a sentence."""
    total = counts.groupBy("token").agg(F.sum("n").alias("total"), F.count("*").alias("buckets")).where(F.col("total") >= least)
    p = F.col("n") / F.col("total")
    return counts.join(total, "token").groupBy("token").agg(F.first("total").alias("n"), F.first("buckets").alias("buckets"), F.round(F.abs(F.sum(-p * F.log2(p))) / 2, 6).alias("entropy"))


def connector_rate(tokens: DataFrame, key: str = "doc_id", least: int = 3) -> DataFrame:
    """Tokens between a sentence's first and third word: counts, and each one's share of its followers' dominant."""
    w = Window.partitionBy(key, "sent").orderBy("pos")
    mid = tokens.where("pos <= 2").withColumn("before", F.lag("token").over(w)).withColumn("after", F.lead("token").over(w)).where("pos = 1 AND before IS NOT NULL AND after IS NOT NULL")
    n = mid.groupBy("before", "token").agg(F.count("*").alias("n"))
    total = n.groupBy("before").agg(F.sum("n").alias("total"), F.max(F.struct("n", "token")).alias("top")).where(F.col("total") >= least)
    return total.select("before", "total", F.col("top.token").alias("connector"), F.round(F.col("top.n") / F.col("total"), 6).alias("share")).where("share >= 0.5")


def modifier_rate(tokens: DataFrame, key: str = "doc_id", least: int = 5) -> DataFrame:
    """Share of a token's uses among the three before a sentence's last word."""
    n = F.max("pos").over(Window.partitionBy(key, "sent")) + 1
    near = F.col("pos").between(F.col("n") - 4, F.col("n") - 2)
    rates = tokens.withColumn("n", n).groupBy("token").agg(F.count("*").alias("uses"), F.count_if(near).alias("near"))
    return rates.where(F.col("uses") >= least).select("token", "uses", F.round(F.col("near") / F.col("uses"), 6).alias("rate"))


def keywords(words: Column, least: int = 3) -> Column:
    """Distinct words of some length that aren't stopwords."""
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*STOPWORDS)))


def document_keywords(tokens: DataFrame, top: int, key: str = "doc_id") -> DataFrame:
    """A document's most frequent keywords, ties in the order of the alphabet."""
    n = tokens.where(~F.col("token").isin(*STOPWORDS) & (F.length("token") >= 3)).groupBy(key, "token").agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "token")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def reduplicated(word: Column) -> Column:
    """The half of a word of two equal halves with a hyphen between, else null."""
    half = F.regexp_extract(word, r"^([a-z]+)-\1$", 1)
    return F.when(half != "", half)


def number(text: Column) -> Column:
    """The first number of a text; a percent sign after it divides by 100, k and m multiply."""
    value = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)\s*(%|k\b|m\b)?", 1)
    unit = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)\s*(%|k\b|m\b)?", 2)
    return F.when(value != "", value.cast("double") * F.when(unit == "%", 0.01).when(unit == "k", 1e3).when(unit == "m", 1e6).otherwise(1.0))
