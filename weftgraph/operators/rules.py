"""Rules over rows and their neighbours, evidence, and small renderings."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.pairs import counted_over_half, over_half
from weftgraph.sources.scratch import kept

#: Lifecycle and epistemic states that each state may change to.
LIFECYCLE_CHANGES = {"New": ("New", "Candidate", "Deprecated"), "Candidate": ("Candidate", "Stable", "Deprecated"), "Stable": ("Stable", "Deprecated"), "Deprecated": ("Deprecated", "Candidate")}
EPISTEMIC_CHANGES = {"Observed": ("Observed", "Inferred", "Grounded", "Contradicted"), "Inferred": ("Inferred", "Grounded", "Contradicted"), "Grounded": ("Grounded", "Contradicted"), "Contradicted": ("Contradicted", "Grounded")}


def hidden_conflicts(hidden: DataFrame, events: DataFrame) -> DataFrame:
    """Hidden meanings (comp_id, source, negated) against the events that they point to (source, negated)."""
    both = hidden.join(events.withColumnRenamed("negated", "event_negated"), "source", "left")
    kind = F.when(F.col("event_negated").isNull(), "Unlinked").when(F.col("negated") != F.col("event_negated"), "Negation").otherwise("None")
    return both.select("comp_id", "source", kind.alias("conflict"))


def compute(op: Column, a: Column, b: Column) -> Column:
    return F.when(op == "ADD", a + b).when(op == "SUBTRACT", a - b).when(op == "MULTIPLY", a * b).when((op == "DIVIDE") & (b != 0), a / b).when(op == "PERIMETER", 2 * (a + b)).when(op == "SQUARE_AREA", a * a)


def may_change(changes: dict[str, tuple[str, ...]], state: Column, to: Column) -> Column:
    allowed = F.create_map(*[x for s, t in changes.items() for x in (F.lit(s), F.array(*[F.lit(v) for v in t]).cast("array<string>"))])
    return F.coalesce(F.array_contains(allowed[state], to), F.lit(False))


def errors(checks: dict[str, Column]) -> Column:
    """Names of the failed checks, with commas between."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()])), ",")


def sense_status(confirm: Column, contra: Column) -> Column:
    return F.when(contra * 2 > confirm, "Fragile").when(confirm >= 8, "Mature").when(confirm >= 5, "Grounded").when(confirm >= 3, "Tentative").otherwise("Fragile")


def net_evidence(rows: DataFrame, keys: list[str], strength: str, confirms: str) -> DataFrame:
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col(strength))), F.lit(0.0))
    return rows.groupBy(*keys).agg(F.round(0.4 * part(F.col(confirms)) - 0.6 * part(~F.col(confirms)) + 1e-9, 5).alias("net"))


def softmax(rows: DataFrame, key: str, score: Column) -> DataFrame:
    w = Window.partitionBy(key)
    e = rows.withColumn("_s", score).withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(w)))
    return e.withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_s", "_e")


def sparse_cosine(rows: DataFrame, pairs: DataFrame, key: str, item: str, weight: str) -> DataFrame:
    """For pairs (a, b) of keys that share an item."""
    length = rows.groupBy(key).agg(F.sqrt(F.sum(F.col(weight) * F.col(weight))).alias("l"))
    one, two = (rows.select(F.col(key).alias(c), item, F.col(weight).alias(f"w{c}")) for c in ("a", "b"))
    dots = pairs.join(one, "a").join(two, ["b", item]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    told = dots.join(length.withColumnsRenamed({key: "a", "l": "la"}), "a").join(length.withColumnsRenamed({key: "b", "l": "lb"}), "b")
    return told.select("a", "b", F.round(F.col("dot") / (F.col("la") * F.col("lb")), 6).alias("cosine"))


def eligibility(rows: DataFrame, key: str, trace: str, weight: Column, signal: float, decay: float = 0.9) -> DataFrame:
    """Weights moved by a signal in proportion to each row's share of its key's trace, within 0 and 1, and then decayed."""
    share = F.col(trace) / F.sum(trace).over(Window.partitionBy(key))
    return rows.withColumn("weight", F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight + signal * share)) * decay)


def reasoning_path(comps: DataFrame, members: DataFrame, activations: DataFrame, least: float = 0.05, top: int = 20) -> DataFrame:
    """Compositions by the energy of their most active member and their state."""
    best = members.join(activations.where(F.col("energy") >= least), "node_id").groupBy("comp_id").agg(F.max("energy").alias("top"))
    state = F.when(F.col("lifecycle") == "Stable", 0.1).when(F.col("lifecycle") == "Candidate", 0.05).otherwise(0.0) + F.when(F.col("epistemic") == "Grounded", 0.1).otherwise(0.0)
    scored = comps.join(best, "comp_id").select("comp_id", F.round(F.col("top") + state + 0.2 * F.col("confidence") + 1e-7, 4).alias("score"))
    return scored.orderBy(F.desc("score"), "comp_id").limit(top)


def rarity(rows: DataFrame, key: str, items: str) -> DataFrame:
    """How many keys have an item, and the logarithm of its inverse share."""
    flat = rows.select(key, F.explode(items).alias("word")).distinct()
    total = flat.agg(F.count_distinct(key).alias("total"))
    return flat.groupBy("word").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).select("word", "df", F.round(F.ln(F.col("total") / F.col("df")), 6).alias("idf"))  # one row is broadcast


def followers(sentences: DataFrame, words: str) -> DataFrame:
    """x, y, n: how often a word and the next one, null after the last, stand in sentences (arrays in order). One pass over the sentences."""
    rows = sentences.select(F.col(words).alias("x"), F.slice(words, F.lit(2), F.size(words)).alias("y")).where(F.size("x") > 0)
    return kept(rows.select(F.inline(F.arrays_zip("x", "y"))).groupBy("x", "y").agg(F.count("*").alias("n")), "followers")


def npmi(sentences: DataFrame, words: str, least: int) -> DataFrame:
    """Normalised pointwise mutual information of words (an array in order) next to each other in a sentence; all of it follows from followers()."""
    counted = followers(sentences, words)
    pairs = counted.where("y IS NOT NULL")
    total = pairs.agg(F.sum("n").cast("double").alias("total"))
    one = counted.groupBy(F.col("x").alias("token")).agg(F.sum("n").alias("c"))
    often = pairs.where(F.col("n") >= least).join(one.withColumnsRenamed({"token": "x", "c": "cx"}), "x").join(one.withColumnsRenamed({"token": "y", "c": "cy"}), "y").crossJoin(F.broadcast(total))
    score = F.ln(F.col("n") * F.col("total") / (F.col("cx") * F.col("cy").cast("double"))) / -F.ln(F.col("n") / F.col("total"))
    return often.select("x", "y", "n", F.round(score, 6).alias("npmi"))


def _in_sentences(tokens: DataFrame, key: str) -> DataFrame:
    """words: the tokens of each sentence in order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "token")))
    return tokens.groupBy(key, "sent").agg(F.transform(ordered, lambda t: t["token"]).alias("words"))


def substitutable(tokens: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """substitutable_of() of tokens (key, sent, pos, token)."""
    return substitutable_of(followers(_in_sentences(tokens, key), "words"), asked)


def substitutable_of(counted: DataFrame, asked: DataFrame) -> DataFrame:
    """For asked tokens (token): every other token b with which one shares over half of the fewer of their followers (followers())."""
    sets = kept(counted.where("y IS NOT NULL").groupBy(F.col("x").alias("token")).agg(F.collect_list("y").alias("items")), "sets")
    return _rated(counted_over_half(sets, kept(sets.join(asked.select("token").distinct(), "token", "left_semi"), "asked")))


def substitutable_pairs(tokens: DataFrame, key: str, least: int) -> DataFrame:
    """substitutable_pairs_of() of tokens (key, sent, pos, token)."""
    return substitutable_pairs_of(followers(_in_sentences(tokens, key), "words"), least)


def substitutable_pairs_of(counted: DataFrame, least: int) -> DataFrame:
    """Pairs of frequent tokens that share over half of the fewer of their followers (followers())."""
    often = counted.groupBy("x").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("x")
    rows = counted.where("y IS NOT NULL").join(often, "x", "left_semi")
    return _rated(counted_over_half(kept(rows.groupBy(F.col("x").alias("token")).agg(F.collect_list("y").alias("items")), "sets")))


def _rated(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b", "shared", F.round(F.col("shared") / F.col("fewer"), 6).alias("rate"))


def markup_kind(text: Column) -> Column:
    low = F.lower(text)
    has = lambda s: F.contains(low, F.lit(s))
    return F.when(has("<script"), "javascript").when(has("<style"), "css").when(has("<html") | has("<p>"), "html").otherwise("text")


def degrees(edges: DataFrame) -> DataFrame:
    """By the first letter of a node's name: nodes, ends of edges, and the most at one node."""
    ends = edges.select(F.col("src").alias("node_id")).unionAll(edges.select("dst"))
    return ends.groupBy("node_id").agg(F.count("*").alias("d")).groupBy(F.substring("node_id", 1, 1).alias("kind")).agg(F.count("*").alias("nodes"), F.sum("d").alias("ends"), F.max("d").alias("most"))


def hashed(tokens: DataFrame, key: str, size: int) -> DataFrame:
    """Signed hashing of a key's tokens by MD5 into a vector of unit length, one number a row."""
    h = F.conv(F.substring(F.md5(F.col("token").cast("binary")), 1, 8), 16, 10).cast("long")
    sign = F.when(F.conv(F.substring(F.md5(F.col("token").cast("binary")), 9, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    sums = tokens.select(key, (h % size).alias("bucket"), sign.alias("s")).groupBy(key, "bucket").agg(F.sum("s").cast("double").alias("x"))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))
    return sums.withColumn("x", F.coalesce(F.try_divide(F.col("x"), length), F.lit(0.0)))


def code_elements(files: DataFrame) -> DataFrame:
    """path, kind, name, parent, line of the classes, functions and imports of Python sources (path, text); a source that doesn't parse gives none."""

    def walk(node: ast.AST, parent: str) -> Iterator[tuple[str, str, str, int]]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                yield "class" if isinstance(child, ast.ClassDef) else "function", child.name, parent, child.lineno
                yield from walk(child, child.name)
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                yield from (("import", a.name, parent, child.lineno) for a in child.names)
            else:
                yield from walk(child, parent)

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, text in zip(part["path"], part["text"], strict=True):
                try:
                    out += [(path, *e) for e in walk(ast.parse(text or ""), "")]
                except (SyntaxError, ValueError):
                    continue
            yield pd.DataFrame(out, columns=["path", "kind", "name", "parent", "line"])

    return files.select("path", "text").mapInPandas(parse, "path string, kind string, name string, parent string, line int")


def incident(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch a node (node_id), outgoing and incoming ones, one row for each end that is asked about."""
    out = edges.join(nodes, edges.src == nodes.node_id).select("node_id", F.lit("out").alias("way"), "src", "dst", "relation")
    back = edges.join(nodes, edges.dst == nodes.node_id).select("node_id", F.lit("in").alias("way"), "src", "dst", "relation")
    return out.unionAll(back)


def by_priority(rows: DataFrame, state: str, order: tuple[str, ...], confidence: str, key: str, cap: int) -> DataFrame:
    """The first ``cap`` rows by the state's place in the order, then by confidence; the cap is the feature."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(state))
    return rows.where(place > 0).orderBy(place, F.desc(confidence), key).limit(cap)


def role_sets(comps: DataFrame, members: DataFrame) -> DataFrame:
    """Classes of compositions of one type and one set of roles, how many they hold, and how many pairs that makes; pairs themselves aren't listed."""
    roles = members.groupBy("comp_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))
    n = comps.join(roles, "comp_id").groupBy("comp_type", "roles").agg(F.count("*").alias("n"), F.min("comp_id").alias("least"))
    return n.withColumn("pairs", F.floor(F.col("n") * (F.col("n") - 1) / 2))


def overlap_findings(comps: DataFrame, members: DataFrame, role: str) -> DataFrame:
    """Pairs of one type that share more than half of the smaller one's nodes of a role."""
    rows = members.where(F.col("role") == role).join(comps.select("comp_id", "comp_type"), "comp_id")
    return over_half(rows, "comp_type", "comp_id", "node_id").select("comp_type", "a", "b", "shared")


def seed_cooccurrence(members: DataFrame, seeds: list[str]) -> DataFrame:
    """For each node, the mean number a of compositions that it shares with a seed, as a / (a + 2)."""
    marked = members.where(F.col("node_id").isin(seeds)).select("comp_id", F.col("node_id").alias("seed")).distinct()
    n = members.select("comp_id", "node_id").distinct().join(marked, "comp_id").where("node_id <> seed").groupBy("node_id").agg((F.count("*") / len(seeds)).alias("a"))
    return n.select("node_id", F.round(F.col("a") / (F.col("a") + 2), 6).alias("score"))


def scope_report(rows: DataFrame, by: str, inside: Column) -> DataFrame:
    """Rows in and out of scope, and the share inside."""
    n = rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(inside).alias("inside"))
    return n.withColumn("coverage", F.round(F.col("inside") / F.col("n"), 6))


#: The most that what failed takes off and what helped adds, and the least similarity that counts.
FAILURE, SUCCESS, SIMILAR = 0.15, 0.05, 0.5


def adjustment(rows: DataFrame, key: str, helped: Column, similarity: Column, least: float = SIMILAR) -> DataFrame:
    """0.05 of the similarity of every episode that helped less 0.15 of each that failed, of those similar enough, within -0.15 and 0.05."""
    counts = F.when(similarity < least, 0.0).when(helped, SUCCESS * similarity).otherwise(-FAILURE * similarity)
    return rows.groupBy(key).agg(F.round(F.greatest(F.lit(-FAILURE), F.least(F.lit(SUCCESS), F.sum(counts))), 6).alias("adjustment"))


def active(rows: DataFrame, last: str, limit_seconds: float) -> DataFrame:
    """Rows seen less than so many seconds before the last one of all."""
    now = rows.agg(F.max(last).alias("_now"))
    return rows.crossJoin(F.broadcast(now)).where(F.col("_now") - F.col(last) < limit_seconds).drop("_now")  # one row is broadcast
