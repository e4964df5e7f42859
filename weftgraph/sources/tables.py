"""The graph's tables, derived from a folder of relational, text and event tables.

An order is a composition; its members play roles in it: the customer is its Agent,
parts are Patients, suppliers are Instruments, the priority is its Purpose. Sentences
of documents are compositions of their words, and events are observations of labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def share(column: str | Column) -> Column:
    """A number's last three digits before the point, as thousandths: a confidence that any engine computes alike."""
    column = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.floor(column).cast("long"), F.lit(1000)).cast("double") / F.lit(1000.0)


def compositions(spark: SparkSession, folder: str) -> DataFrame:
    """comp_id, comp_type, lifecycle, epistemic, origin, source, confidence, batch_seen, contradictions (batches)."""
    orders = table(spark, folder, "orders")
    key = F.col("o_orderkey")
    pick = lambda by, *names: F.element_at(F.array(*[F.lit(n) for n in names]), (by % len(names) + 1).cast("int"))
    return orders.select(
        key.alias("comp_id"),
        pick(key, "Event", "Event", "Situation", "Pattern", "HiddenMeaning").alias("comp_type"),
        F.when(F.col("o_orderstatus") == "F", "Stable").when(F.col("o_orderstatus") == "O", "Candidate").otherwise("New").alias("lifecycle"),
        pick(F.floor(key / 5), "Observed", "Inferred", "Grounded", "Contradicted").alias("epistemic"),
        pick(F.col("o_custkey"), "Corpus", "UserInput", "Bootstrap").alias("origin"),
        pick(F.col("o_custkey"), "user_input", "web_search", "academic", "official_doc", "wiki", "social_media", "unknown", "rumour").alias("source"),
        share("o_totalprice").alias("confidence"),
        (key % 20).alias("batch_seen"),
        F.when(key % 7 == 0, F.array(key % 20, (key + 3) % 20)).otherwise(F.array().cast("array<long>")).alias("contradictions"),
        F.col("o_orderdate").alias("created_at"),
    )


def members(spark: SparkSession, folder: str) -> DataFrame:
    """comp_id, pos, node_id, role, confidence. Orders and their lines are read once each; nothing is joined."""
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    row = lambda pos, node, role, conf: F.struct(pos.cast("int").alias("pos"), node.alias("node_id"), F.lit(role).alias("role"), conf.cast("double").alias("confidence"))
    heads = F.array(row(F.lit(0), F.concat(F.lit("c"), F.col("o_custkey").cast("string")), "Agent", F.lit(0.9)), row(F.lit(1), F.col("o_orderpriority"), "Purpose", F.lit(0.6)))
    at = F.col("l_linenumber") * 2
    tails = F.array(row(at, F.concat(F.lit("p"), F.col("l_partkey").cast("string")), "Patient", 1 - F.col("l_discount")), row(at + 1, F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), "Instrument", 1 - F.col("l_tax")))
    head = orders.select(F.col("o_orderkey").alias("comp_id"), F.inline(heads))
    tail = lines.select(F.col("l_orderkey").alias("comp_id"), F.inline(tails))
    return head.unionByName(tail)


def typed_members(spark: SparkSession, folder: str) -> DataFrame:
    """members() with roles that fit the composition's type, which its id tells."""
    kind, role = F.col("comp_id") % 5, F.col("role")
    third, second = F.col("comp_id") % 3 == 0, F.col("comp_id") % 2 == 0
    named = (
        F.when((kind <= 1) & (role == "Purpose") & second, "Predicate").when((kind <= 1) & (role == "Instrument") & third, "Cause")
        .when((kind >= 3) & (role == "Agent"), "PatternType").when((kind == 3) & (role == "Patient"), "Antecedent").when((kind == 3) & (role == "Instrument") & second, "Consequent")
        .when((kind == 4) & (role == "Purpose") & ~third, "Problem").when((kind == 4) & (role == "Patient") & second, "Solution").otherwise(role)
    )
    return members(spark, folder).withColumn("role", named)


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """src, dst, relation, confidence: customers and suppliers to nations to regions, parts to suppliers, customers to parts."""
    customer, supplier, nation, lines, orders = (table(spark, folder, n) for n in ("customer", "supplier", "nation", "lineitem", "orders"))
    name = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
    up = [
        customer.select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"), F.lit("CATEGORICAL").alias("relation"), share(F.abs("c_acctbal")).alias("confidence")),
        supplier.select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"), F.lit("CATEGORICAL").alias("relation"), share(F.abs("s_acctbal")).alias("confidence")),
        nation.select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"), F.lit("CATEGORICAL").alias("relation"), F.lit(0.9).alias("confidence")),
        lines.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).select(name("p", "l_partkey").alias("src"), name("s", "l_suppkey").alias("dst"), F.lit("FUNCTIONAL").alias("relation"), F.least(F.lit(1.0), F.col("n") / 4.0).alias("confidence")),
    ]
    bought = lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy("o_custkey", "l_partkey").agg(F.count("*").alias("n"))
    up.append(bought.select(name("c", "o_custkey").alias("src"), name("p", "l_partkey").alias("dst"), F.when(F.col("n") > 1, "DIFFERENTIAL").otherwise("CAUSAL").alias("relation"), F.least(F.lit(1.0), F.col("n") / 2.0).alias("confidence")))
    out = up[0]
    for other in up[1:]:
        out = out.unionByName(other)
    return out


def sentences(spark: SparkSession, folder: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """key, sent, words: the lower-cased ASCII words of each sentence, in order."""
    text = table(spark, folder, name).select(key, F.lower("text").alias("text"))
    split = text.select(key, F.posexplode(F.split("text", "[.?!]")).alias("sent", "sentence"))
    return split.select(key, "sent", F.regexp_extract_all("sentence", F.lit("[a-z]+"), 0).alias("words"))


def tokens(spark: SparkSession, folder: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """key, sent, pos, token: lower-cased ASCII words of each sentence, from 0 on."""
    return sentences(spark, folder, name, key).select(key, "sent", F.posexplode("words").alias("pos", "token"))


def words(text: str | Column) -> Column:
    """The lower-cased ASCII words of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0)


#: The same tables in SQL, for checks by another engine.
SQL = {
    "comps": """comps AS (SELECT o_orderkey AS comp_id, ['Event', 'Event', 'Situation', 'Pattern', 'HiddenMeaning'][o_orderkey % 5 + 1] AS comp_type,
        CASE o_orderstatus WHEN 'F' THEN 'Stable' WHEN 'O' THEN 'Candidate' ELSE 'New' END AS lifecycle,
        ['Observed', 'Inferred', 'Grounded', 'Contradicted'][(o_orderkey // 5) % 4 + 1] AS epistemic, ['Corpus', 'UserInput', 'Bootstrap'][o_custkey % 3 + 1] AS origin,
        ['user_input', 'web_search', 'academic', 'official_doc', 'wiki', 'social_media', 'unknown', 'rumour'][o_custkey % 8 + 1] AS source,
        (floor(o_totalprice)::BIGINT % 1000) / 1000.0::DOUBLE AS confidence, o_orderkey % 20 AS batch_seen,
        CASE WHEN o_orderkey % 7 = 0 THEN [o_orderkey % 20, (o_orderkey + 3) % 20] ELSE [] END AS contradictions, o_orderdate AS created_at FROM orders)""",
    "members": """members AS (SELECT o_orderkey AS comp_id, 0 AS pos, 'c' || o_custkey AS node_id, 'Agent' AS role, 0.9::DOUBLE AS confidence FROM orders
        UNION ALL SELECT o_orderkey, 1, o_orderpriority, 'Purpose', 0.6::DOUBLE FROM orders
        UNION ALL SELECT l_orderkey, l_linenumber * 2, 'p' || l_partkey, 'Patient', 1 - l_discount FROM lineitem
        UNION ALL SELECT l_orderkey, l_linenumber * 2 + 1, 's' || l_suppkey, 'Instrument', 1 - l_tax FROM lineitem)""",
    "typed_members": """typed_members AS (SELECT comp_id, pos, node_id, CASE WHEN comp_id % 5 IN (0, 1) AND role = 'Purpose' AND comp_id % 2 = 0 THEN 'Predicate' WHEN comp_id % 5 IN (0, 1) AND role = 'Instrument' AND comp_id % 3 = 0 THEN 'Cause'
        WHEN comp_id % 5 IN (3, 4) AND role = 'Agent' THEN 'PatternType' WHEN comp_id % 5 = 3 AND role = 'Patient' THEN 'Antecedent' WHEN comp_id % 5 = 3 AND role = 'Instrument' AND comp_id % 2 = 0 THEN 'Consequent'
        WHEN comp_id % 5 = 4 AND role = 'Purpose' AND comp_id % 3 <> 0 THEN 'Problem' WHEN comp_id % 5 = 4 AND role = 'Patient' AND comp_id % 2 = 0 THEN 'Solution' ELSE role END AS role, confidence FROM members)""",
    "edges": """edges AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'CATEGORICAL' AS relation, (floor(abs(c_acctbal))::BIGINT % 1000) / 1000.0::DOUBLE AS confidence FROM customer
        UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'CATEGORICAL', (floor(abs(s_acctbal))::BIGINT % 1000) / 1000.0::DOUBLE FROM supplier
        UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'CATEGORICAL', 0.9::DOUBLE FROM nation
        UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, 'FUNCTIONAL', least(1.0::DOUBLE, count(*) / 4.0::DOUBLE) FROM lineitem GROUP BY l_partkey, l_suppkey
        UNION ALL SELECT 'c' || o_custkey, 'p' || l_partkey, CASE WHEN count(*) > 1 THEN 'DIFFERENTIAL' ELSE 'CAUSAL' END, least(1.0::DOUBLE, count(*) / 2.0::DOUBLE) FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey)""",
    "sentences": """sentences AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS sent, unnest(s) AS sentence FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[.?!]') AS s FROM documents))""",
    "tokens": """tokens AS (SELECT doc_id, sent, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS token FROM (SELECT doc_id, sent, regexp_extract_all(sentence, '[a-z]+') AS w FROM sentences))""",
    "messages": """messages AS (SELECT conv_id, turn, role, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS atoms FROM conversations)""",
}


def with_sql(*names: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in names)
