"""Queries over compositions, members and typed edges, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import scores as S
from weftgraph.operators import acquisition as Q
from weftgraph.operators import aggregates as A
from weftgraph.operators import governance as G
from weftgraph.operators import graph as R
from weftgraph.operators import lookup as L
from weftgraph.operators import pairs as P
from weftgraph.operators import senses as N
from weftgraph.sources import store as Z
from weftgraph.sources.scratch import kept
from weftgraph.sources.tables import compositions, edges, members, sentences, share, table, typed_members, with_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


CM = with_sql("comps", "members")
SEEDS = """n AS (SELECT comp_id, avg(confidence) AS value, count(*) FILTER (WHERE role = 'Purpose') AS purposes, count(*) FILTER (WHERE role = 'Agent') AS agents FROM members GROUP BY comp_id),
    s AS (SELECT c.comp_id, c.confidence, 0.45::DOUBLE AS trust, CASE WHEN epistemic = 'Contradicted' THEN 0.8::DOUBLE ELSE least(1.0::DOUBLE, 0.2 + 0.1::DOUBLE * len(contradictions)) END AS risk,
      value, least(0.9::DOUBLE, 0.2 + 0.15::DOUBLE * purposes) AS goal, least(0.8::DOUBLE, 0.2 + 0.1::DOUBLE * agents) AS identity FROM comps c JOIN n USING (comp_id)),
    seeds AS (SELECT *, 0.3::DOUBLE * trust + 0.2::DOUBLE * (1 - risk) + 0.2::DOUBLE * value + 0.15::DOUBLE * goal + 0.15::DOUBLE * identity AS overall,
      least(0.4::DOUBLE, 2 * (abs(trust - 0.5) + abs(risk - 0.5) + abs(value - 0.5) + abs(goal - 0.5) + abs(identity - 0.5)) / 5) AS weight, (trust + risk + value + goal + identity) / 5 AS mean FROM s)"""


@query(f"""{CM} SELECT c.comp_id, round(least(1.0, hit * CASE lifecycle WHEN 'Stable' THEN 1.2 ELSE 1.0 END * CASE epistemic WHEN 'Grounded' THEN 1.1 ELSE 1.0 END), 6)::DOUBLE AS score FROM comps c JOIN
    (SELECT comp_id, max(CASE WHEN lower(node_id) = 'p17' THEN 1.0::DOUBLE WHEN contains(lower(node_id), 'p17') OR contains('p17', lower(node_id)) THEN 0.6::DOUBLE * confidence END) AS hit FROM members GROUP BY comp_id) m USING (comp_id) WHERE hit IS NOT NULL""")
def concept_search(spark: SparkSession, d: str) -> DataFrame:
    return L.by_concept(compositions(spark, d), members(spark, d), "p17")


@query(f"{CM} SELECT comp_id, confidence FROM comps WHERE comp_id IN (SELECT comp_id FROM members WHERE role IN ('Agent', 'Instrument', 'Purpose') GROUP BY comp_id HAVING count(DISTINCT role) = 3)")
def structure_search(spark, d):
    return L.by_structure(compositions(spark, d), members(spark, d), ["agent", "tool", "goal", "unheard-of"])


@query(f"{CM} SELECT comp_id, lifecycle, confidence FROM comps WHERE comp_id IN (SELECT comp_id FROM members WHERE node_id IN ('s1', 's2', 'p3'))")
def neighborhood(spark, d):
    return L.neighborhood(compositions(spark, d), members(spark, d), ["s1", "s2", "p3"]).select("comp_id", "lifecycle", "confidence")


@query(f"""{CM}, r AS (SELECT comp_id, list(DISTINCT role) AS roles FROM members GROUP BY comp_id)
    SELECT comp_id, array_to_string(list_filter(['Agent', 'Patient', 'Cause'], lambda x: NOT list_contains(coalesce(roles, []), x)), ',') AS missing FROM comps LEFT JOIN r USING (comp_id) WHERE comp_type = 'Event' AND confidence < 0.5""")
def weak_frames(spark, d):
    return L.weak_frames(compositions(spark, d), members(spark, d))


@query(f"{CM} SELECT comp_id, m.n AS node_id, round(m.c, 6) AS confidence, n FROM (SELECT comp_id, min({{'p': pos, 'n': node_id, 'c': confidence}}) AS m, count(*) AS n FROM members WHERE role = 'Patient' GROUP BY comp_id)")
def first_patient(spark, d):
    return L.first_with_role(members(spark, d), "Patient").withColumn("confidence", F.round("confidence", 6))


@query(f"{CM} SELECT comp_id, len(list_filter(contradictions, lambda b: b > 14)) > 0 AS contradicted FROM comps")
def recent_contradictions(spark, d):
    return compositions(spark, d).select("comp_id", L.recently_contradicted("batch_seen", "contradictions", 19, 5).alias("contradicted"))


@query("""SELECT 'p' || l_partkey AS node_id, max(l_linenumber % 3) = 0 AS is_primitive, bool_or(l_linestatus = 'O' AND l_quantity > 45) OR count(DISTINCT l_linenumber % 3) >= 2 AS is_bridge,
    max(l_linenumber % 3) >= 1 AS is_derived, bool_or(l_linestatus = 'O' AND l_quantity > 45) AS is_utterance_level FROM lineitem GROUP BY l_partkey""")
def sense_classes(spark, d):
    senses = table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey")).alias("node_id"), (F.col("l_linenumber") % 3).alias("layer"), ((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 45)).alias("is_utterance"))
    return L.sense_classes(senses)


@query("""SELECT rule, round(g, 6) AS gap_rate, round(r, 6) AS repair_rate FROM (SELECT 'r' || l_suppkey AS rule, avg((l_discount > 0.06)::INT::DOUBLE) AS g, avg(CASE WHEN l_discount > 0.06 THEN (l_tax < 0.04)::INT::DOUBLE END) AS r FROM lineitem GROUP BY l_suppkey) WHERE g > 0.3 AND coalesce(r, 0) < 0.5""")
def weak_rules(spark, d):
    return L.weak_rules(table(spark, d, "lineitem").select(F.concat(F.lit("r"), F.col("l_suppkey")).alias("rule"), (F.col("l_discount") > 0.06).alias("gap"), (F.col("l_tax") < 0.04).alias("repaired")))


@query(f"{with_sql('edges')} SELECT src AS node_id, count(*) AS n, round(avg(confidence), 6) AS confidence FROM edges WHERE relation = 'FUNCTIONAL' GROUP BY src")
def typed_neighbors(spark, d):
    return L.neighbors(edges(spark, d), "FUNCTIONAL")


@query(f"{with_sql('edges')} SELECT src, dst, relation FROM edges WHERE src NOT IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal < 0) AND dst NOT IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal < 0)")
def removed_nodes(spark, d):
    gone = table(spark, d, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("node_id"))
    return L.without_nodes(edges(spark, d), gone).select("src", "dst", "relation")


@query(f"""{CM} SELECT comp_id, round(CASE WHEN comp_type IN ('Event', 'Pattern') AND confidence >= 0.3 AND origin NOT IN ('Bootstrap') THEN confidence ELSE 0.3::DOUBLE * confidence END, 6) AS scoped FROM comps""")
def scoped_confidence(spark, d):
    inside = L.in_scope(F.col("comp_type"), F.col("confidence"), F.col("origin"), ["Event", "Pattern"], 0.3, ["Bootstrap"])
    return compositions(spark, d).select("comp_id", F.round(L.scoped_confidence(F.col("confidence"), inside), 6).alias("scoped"))


@query("""SELECT l_orderkey, l_linenumber, rule FROM (SELECT *, unnest(['small', 'cheap', 'taxed']) AS rule FROM lineitem) WHERE (rule = 'small' AND NOT l_quantity < 48) OR (rule = 'cheap' AND NOT l_extendedprice < 90000) OR (rule = 'taxed' AND NOT l_tax > 0)""")
def rule_violations(spark, d):
    rules = {"small": "l_quantity < 48", "cheap": "l_extendedprice < 90000", "taxed": "l_tax > 0"}
    return L.violations(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax"), rules).select("l_orderkey", "l_linenumber", "rule")


@query(f"{CM} SELECT comp_id, lifecycle IN ('Candidate', 'Stable') AND epistemic <> 'Contradicted' AND confidence >= 0.2 AS injectable FROM comps")
def injectable(spark, d):
    return compositions(spark, d).select("comp_id", L.injectable(F.col("lifecycle"), F.col("epistemic"), F.col("confidence")).alias("injectable"))


@query(f"{CM}, f AS (SELECT node_id, count(*) AS n, avg(confidence) AS c FROM members WHERE role = 'Instrument' GROUP BY node_id) SELECT node_id, n, round(c * n / greatest(3, n), 6) AS score FROM f ORDER BY n DESC, node_id LIMIT 1")
def role_candidate(spark, d):
    return L.role_candidates(members(spark, d), "Instrument")


@query(f"{CM} SELECT comp_id, lifecycle FROM comps ORDER BY created_at DESC, comp_id DESC LIMIT 50")
def recent_compositions(spark, d):
    return L.recent(compositions(spark, d), 50).select("comp_id", "lifecycle")


@query(f"""{CM}, r AS (SELECT comp_id FROM comps ORDER BY created_at DESC, comp_id DESC LIMIT 10), k AS (SELECT m.*, CASE role WHEN 'Agent' THEN 0 ELSE 1 END AS rank FROM members m JOIN r USING (comp_id) WHERE role IN ('Agent', 'Patient'))
    SELECT comp_id, node_id, CASE rank WHEN 0 THEN 0.6 ELSE 0.5 END::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY comp_id ORDER BY rank, pos) AS i FROM k) WHERE i = 1""")
def ambiguous_fillers(spark, d):
    return L.recent_fillers(compositions(spark, d), members(spark, d))


@query(f"""{CM}, asked AS (SELECT comp_id FROM comps WHERE comp_id % 100 = 0), own AS (SELECT m.* FROM members m JOIN asked USING (comp_id)), pair AS (SELECT DISTINCT own.comp_id AS asked, m.comp_id FROM own JOIN members m USING (node_id) WHERE own.comp_id <> m.comp_id),
    lent AS (SELECT asked AS comp_id, m.role, 0.7::DOUBLE * m.confidence AS w FROM pair JOIN members m USING (comp_id) WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.comp_id = pair.asked AND own.node_id = m.node_id) UNION ALL SELECT comp_id, role, confidence FROM own)
    SELECT comp_id, role, count(*) AS n, round(sum(w), 4) AS weight FROM lent GROUP BY comp_id, role""")
def graph_context(spark, d):
    return L.graph_context(members(spark, d), compositions(spark, d).where("comp_id % 100 = 0"))


@query(f"{CM} SELECT lifecycle, epistemic, count(*) AS n, round(avg(confidence), 6) AS confidence FROM comps GROUP BY GROUPING SETS ((lifecycle), (epistemic), ())")
def graph_summary(spark, d):
    return A.summary(compositions(spark, d))


@query(f"{CM} SELECT node_id, count(DISTINCT comp_id) AS n, least(1.0, count(DISTINCT comp_id) / 10.0)::DOUBLE AS connectivity FROM members GROUP BY node_id")
def connectivity(spark, d):
    return A.connectivity(members(spark, d))


@query(f"{CM} SELECT node_id, count(DISTINCT comp_id) AS n, min(comp_id) AS first_comp, max(comp_id) AS last_comp FROM members GROUP BY node_id")
def node_index(spark, d):
    return A.node_index(members(spark, d))


@query(f"{CM} SELECT comp_id, role, round(sum(confidence), 6) AS weight FROM members GROUP BY comp_id, role")
def sense_properties(spark, d):
    return A.role_properties(members(spark, d))


@query(f"{CM}, {SEEDS} SELECT comp_id, round(value + 1e-9, 6) AS value, round(overall + 1e-9, 6) AS overall, round(confidence * (1 - weight) + mean * weight + 1e-9, 6) AS anchored FROM seeds")
def seed_scores(spark, d):
    scored = A.seed_scores(compositions(spark, d), members(spark, d))
    return scored.select("comp_id", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("value", "overall", "anchored")])


@query(f"""{CM}, t AS (SELECT * FROM (VALUES ('user_input', 1.0::DOUBLE), ('web_search', 0.7), ('academic', 0.9), ('official_doc', 0.95), ('wiki', 0.75), ('social_media', 0.3), ('unknown', 0.5)) AS v(source, trust))
    SELECT source AS origin, count(*) AS n, round(avg(coalesce(trust, 0.5) * confidence), 6) AS trusted FROM comps LEFT JOIN t USING (source) GROUP BY source""")
def origin_breakdown(spark, d):
    comps = compositions(spark, d).withColumn("origin", F.col("source"))
    return A.origin_trust(comps, L.trust(F.col("origin")))


@query("SELECT l_returnflag, l_shipmode, n FROM (SELECT l_returnflag, 's' || l_suppkey AS l_shipmode, count(*) AS n FROM lineitem GROUP BY 1, 2) WHERE n >= 5")
def learned_markers(spark, d):
    return A.learned_markers(table(spark, d, "lineitem").select("l_returnflag", F.concat(F.lit("s"), F.col("l_suppkey")).alias("l_shipmode")), ["l_returnflag", "l_shipmode"])


@query("""SELECT user_id, round(sum(0.3::DOUBLE * pow(0.7::DOUBLE, age) * value) + 0.5 * pow(0.7::DOUBLE, count(*)), 6) AS ema FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS age FROM events) GROUP BY user_id""")
def belief_average(spark, d):
    return A.ema(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 0.3, 0.5)


LABELLED = "l AS (SELECT doc_id, (doc_id * 37 % 100) / 100.0::DOUBLE AS p, quality FROM labels JOIN documents USING (doc_id))"
BINS = f"{LABELLED}, b AS (SELECT least(9, floor(p * 10))::INT AS bin, count(*) AS n, avg(p) AS conf, avg(quality::DOUBLE) AS acc FROM l GROUP BY 1)"


def _labelled(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", (F.pmod(F.col("doc_id") * 37, F.lit(100)) / 100.0).alias("p"), "quality")


@query(f"WITH {BINS} SELECT round(sum(n * abs(conf - acc)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM b")
def calibration_error(spark, d):
    return A.calibration_error(_labelled(spark, d), "p", "quality")


@query(f"WITH {BINS} SELECT bin, n, round(CASE WHEN abs(acc - conf) < 0.05 THEN 0.0 ELSE (acc - conf) * least(1.0, n / 50.0::DOUBLE) END, 6)::DOUBLE AS correction FROM b")
def calibration_buckets(spark, d):
    return A.calibrated(A.calibration_bins(_labelled(spark, d), "p", "quality"))


@query("""SELECT l_suppkey, ev, CASE WHEN ev > 0.05 THEN 'pass' WHEN ev > -0.05 THEN 'caution' ELSE 'reject' END AS verdict FROM (SELECT l_suppkey, round(least(wr * up - (1 - wr) * down, 2 * wr - 1), 6) AS ev FROM
    (SELECT l_suppkey, avg((l_returnflag = 'N')::INT::DOUBLE) AS wr, coalesce(avg(1 - l_discount) FILTER (WHERE l_returnflag = 'N'), 0) AS up, coalesce(avg(1 - l_discount) FILTER (WHERE l_returnflag <> 'N'), 0) AS down FROM lineitem GROUP BY l_suppkey))""")
def edge_assessment(spark, d):
    return A.edge_assessment(table(spark, d, "lineitem").select("l_suppkey", (1 - F.col("l_discount")).alias("c"), (F.col("l_returnflag") == "N").alias("won")), "l_suppkey", "c", "won")


@query("""SELECT l_orderkey, round(sum(w * (1 - l_discount)) / sum(w), 6) AS confidence FROM (SELECT *, CASE l_linenumber WHEN 1 THEN 0.10 WHEN 2 THEN 0.15 WHEN 3 THEN 0.20 WHEN 4 THEN 0.20 WHEN 5 THEN 0.35 ELSE 0.05 END::DOUBLE AS w FROM lineitem) GROUP BY l_orderkey""")
def chain_confidence(spark, d):
    value, weight = A.step_confidence(F.col("l_linenumber"), 1 - F.col("l_discount"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(value) / F.sum(weight), 6).alias("confidence"))


@query(f"{with_sql('edges')} SELECT node_id, round(sum(confidence), 4) AS current FROM (SELECT src AS node_id, confidence FROM edges UNION ALL SELECT dst, confidence FROM edges) GROUP BY node_id")
def topology_currents(spark, d):
    return A.topology_currents(edges(spark, d))


@query(f"{CM}, m AS (SELECT DISTINCT comp_id, node_id FROM members WHERE role = 'Instrument') SELECT x.node_id AS a, y.node_id AS b, count(*) AS n FROM m x JOIN m y ON x.comp_id = y.comp_id AND x.node_id < y.node_id GROUP BY 1, 2 HAVING count(*) >= 2")
def node_cooccurrence(spark, d):
    return P.cooccurrence(members(spark, d), "Instrument")


TRADE = """trade AS (SELECT l_returnflag AS predicate, c_nationkey AS agent, s_nationkey AS patient, avg(1 - l_discount) AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)"""


def _trade(spark, d):
    lines, orders, customer, supplier = (table(spark, d, n) for n in ("lineitem", "orders", "customer", "supplier"))
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.col("l_returnflag").alias("predicate"), F.col("c_nationkey").alias("agent"), F.col("s_nationkey").alias("patient")).agg(F.avg(1 - F.col("l_discount")).alias("confidence"))


@query(f"WITH {TRADE} SELECT x.predicate, x.agent AS a, x.patient AS b, round((x.confidence + y.confidence) / 2 * 0.9 + 1e-9, 6)::DOUBLE AS confidence FROM trade x JOIN trade y ON x.predicate = y.predicate AND x.agent = y.patient AND x.patient = y.agent WHERE x.agent < x.patient")
def role_reversals(spark, d):
    return P.role_reversals(_trade(spark, d))


@query("""WITH n AS (SELECT o_custkey AS agent, o_orderpriority AS purpose, count(*) AS n FROM orders GROUP BY 1, 2) SELECT agent, x.purpose AS x, x.n AS n_x, y.purpose AS y, y.n AS n_y FROM n x JOIN n y USING (agent) WHERE x.purpose < y.purpose""")
def purpose_conflicts(spark, d):
    return P.filler_conflicts(table(spark, d, "orders").select(F.col("o_custkey").alias("agent"), F.col("o_orderpriority").alias("purpose")), "agent", "purpose")


@query("""WITH n AS (SELECT p_brand, p_type AS node, list_distinct(string_split(any_value(p_type), ' ')) AS w FROM part GROUP BY 1, 2)
    SELECT p_brand, a, b, round(o, 6) AS overlap FROM (SELECT x.p_brand, x.node AS a, y.node AS b, len(list_intersect(x.w, y.w))::DOUBLE / len(list_distinct(list_concat(x.w, y.w))) AS o FROM n x JOIN n y ON x.p_brand = y.p_brand AND x.node < y.node) WHERE o < 0.3""")
def definition_conflicts(spark, d):
    return P.definition_conflicts(table(spark, d, "part").select("p_brand", F.col("p_type").alias("node")), "p_brand", "node", F.array_distinct(F.split("node", " ")), 0.3)


TYPED = "typed AS (SELECT 'n' || c_nationkey AS src, 's' || l_suppkey AS dst, CASE WHEN l_returnflag = 'R' THEN 'DIFFERENTIAL' ELSE 'CAUSAL' END AS relation, 1 - l_discount AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"


@query(f"""WITH {TYPED}, b AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, avg(confidence) FILTER (WHERE relation = 'CAUSAL') AS c, avg(confidence) FILTER (WHERE relation = 'DIFFERENTIAL') AS d FROM typed GROUP BY 1, 2)
    SELECT a, b, round((c + d) / 2 + 1e-9, 6) AS confidence FROM b WHERE c IS NOT NULL AND d IS NOT NULL""")
def relation_conflicts(spark, d):
    lines, orders, customer = (table(spark, d, n) for n in ("lineitem", "orders", "customer"))
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    typed = rows.select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst"), F.when(F.col("l_returnflag") == "R", "DIFFERENTIAL").otherwise("CAUSAL").alias("relation"), (1 - F.col("l_discount")).alias("confidence"))
    return P.relation_conflicts(typed)


@query(f"{with_sql('edges')}, k AS (SELECT 'p' || p_partkey AS k FROM part WHERE p_size > 25 UNION SELECT 's' || s_suppkey FROM supplier WHERE s_nationkey < 12) SELECT src, dst, confidence FROM edges WHERE src IN (SELECT k FROM k) AND dst IN (SELECT k FROM k)")
def induced_subgraph(spark, d):
    nodes = table(spark, d, "part").where("p_size > 25").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("node_id")).unionAll(table(spark, d, "supplier").where("s_nationkey < 12").select(F.concat(F.lit("s"), F.col("s_suppkey"))))
    return P.induced(edges(spark, d), nodes).select("src", "dst", "confidence")


CHAIN = """chain AS (SELECT user_id, ts, event_id, event_type AS src, lead(event_type) OVER w AS dst, CASE WHEN event_id % 3 = 0 THEN 'CAUSAL' ELSE 'CATEGORICAL' END AS relation, (event_id % 100) / 100.0::DOUBLE AS weight FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query(f"""WITH {CHAIN}, p AS (SELECT *, lead(src) OVER w AS s2, lead(dst) OVER w AS d2, lead(relation) OVER w AS r2, lead(weight) OVER w AS w2 FROM chain WHERE dst IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, ts, event_id, src AS source, d2 AS target, relation, round(CASE WHEN weight <= 0 OR w2 <= 0 THEN 0.0 ELSE weight * w2 END, 6)::DOUBLE AS product, round(CASE WHEN weight <= 0 OR w2 <= 0 THEN 0.0 ELSE greatest(0.0, weight + w2 - 1) END, 6)::DOUBLE AS lukasiewicz,
      round(CASE WHEN weight <= 0 OR w2 <= 0 THEN 0.0 ELSE least(weight, w2) END, 6)::DOUBLE AS godel FROM p WHERE s2 = dst AND r2 = relation""")
def adjacent_deductions(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    chain = table(spark, d, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"), F.when(F.col("event_id") % 3 == 0, "CAUSAL").otherwise("CATEGORICAL").alias("relation"), ((F.col("event_id") % 100) / 100.0).alias("weight")).where("dst IS NOT NULL")
    return P.deductions(chain, "user_id", ["ts", "event_id"])


@query("""WITH s AS (SELECT o_custkey AS c, list(DISTINCT l_suppkey) AS i, o_orderpriority AS g FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, o_orderpriority),
    p AS (SELECT c, x.g AS a, y.g AS b, len(list_intersect(x.i, y.i))::DOUBLE / len(list_distinct(list_concat(x.i, y.i))) AS o FROM s x JOIN s y USING (c) WHERE x.g < y.g)
    SELECT c, a, b, round(o, 6) AS overlap FROM p WHERE o >= 0.05""")
def structural_jaccard(spark, d):
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    sets = orders.join(lines, orders.o_orderkey == lines.l_orderkey).groupBy(F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("g")).agg(F.collect_set("l_suppkey").alias("i"))
    return P.set_overlaps(sets, "c", "g", "i", 0.05)


@query("""WITH m AS (SELECT l_suppkey AS s, l_returnflag AS f, l_linenumber AS k, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2, 3), u AS (SELECT DISTINCT s, k FROM m WHERE f IN ('A', 'R')),
    j AS (SELECT u.s, u.k, coalesce(a.n, 0) AS x, coalesce(r.n, 0) AS y FROM u LEFT JOIN m a ON a.s = u.s AND a.k = u.k AND a.f = 'A' LEFT JOIN m r ON r.s = u.s AND r.k = u.k AND r.f = 'R')
    SELECT s, round(sum(least(x, y)) / sum(greatest(x, y)), 6) AS similarity FROM j GROUP BY s""")
def weighted_jaccard(spark, d):
    n = table(spark, d, "lineitem").where("l_returnflag IN ('A', 'R')").groupBy(F.col("l_suppkey").alias("s"), "l_returnflag", "l_linenumber").agg(F.count("*").cast("double").alias("n"))
    side = lambda f: F.map_from_entries(F.collect_list(F.when(F.col("l_returnflag") == f, F.struct("l_linenumber", "n"))))
    return n.groupBy("s").agg(side("A").alias("a"), side("R").alias("r")).select("s", F.round(S.weighted_jaccard(F.col("a"), F.col("r")), 6).alias("similarity"))


@query("""SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND (l_partkey, l_suppkey) NOT IN (SELECT (l_partkey, l_suppkey) FROM lineitem WHERE l_returnflag = 'A')""")
def novel_candidates(spark, d):
    rows = table(spark, d, "lineitem")
    pick = lambda f: rows.where(F.col("l_returnflag") == f).select("l_partkey", "l_suppkey").distinct()
    return P.novel(pick("R"), pick("A"), ["l_partkey", "l_suppkey"])


@query(f"""{CM}, {SEEDS} SELECT c.comp_id, (19 - batch_seen >= 3 AND c.confidence >= 0.55 AND sound >= 2 AND NOT len(list_filter(contradictions, lambda b: b > 16)) > 0 AND overall >= 0.3) AS to_stable,
    (epistemic = 'Inferred' AND c.confidence >= 0.7 AND NOT len(list_filter(contradictions, lambda b: b > 14)) > 0 AND overall >= 0.5 AND sources > 1) AS to_grounded, (len(contradictions) = 0 AND sound >= 1 AND c.confidence >= 0.4) AS to_inferred
    FROM comps c JOIN (SELECT comp_id, count(*) FILTER (WHERE confidence >= 0.5) AS sound, count(DISTINCT role) AS sources FROM members GROUP BY comp_id) USING (comp_id) JOIN seeds USING (comp_id)""")
def promotions(spark, d):
    comps, rows = compositions(spark, d), members(spark, d)
    return G.promotions(comps, rows, A.seed_scores(comps, rows), 19)


@query(f"""{CM}, f AS (SELECT *, exp(-2.0::DOUBLE * (19 - batch_seen) / 50.0::DOUBLE) * (1 + 0.2::DOUBLE * ln(1 + n)) AS factor FROM comps JOIN (SELECT comp_id, count(*) AS n FROM members GROUP BY comp_id) USING (comp_id)),
    g AS (SELECT *, greatest(0.0, least(1.0, confidence * factor)) AS now, lifecycle IN ('New', 'Deprecated') AS still FROM f)
    SELECT comp_id, round(factor, 6) AS factor, CASE WHEN still THEN lifecycle WHEN now < 0.1 THEN 'Deprecated' WHEN now < 0.4 THEN CASE lifecycle WHEN 'Stable' THEN 'Candidate' WHEN 'Candidate' THEN 'Quarantine' ELSE lifecycle END ELSE lifecycle END AS state,
      round(CASE WHEN still THEN confidence ELSE now END, 6) AS decayed FROM g""")
def decay_applied(spark, d):
    return G.decay(compositions(spark, d), members(spark, d), 19)


PROVENANCE = ("FrameCompiler", "ExtractionRepair", "EnrichmentFeedback", "HiddenMeaningRule", "PatternMining", "Abductive", "AcquisitionRecall", "AcquisitionSelfStudy", "AcquisitionUserAnswer", "HumanAssertion", "Corpus")
KINDS = ("Event", "HiddenMeaning", "Pattern", "Hypothesis", "Acquisition", "Situation")


@query(f"""WITH k AS (SELECT o_orderkey AS comp_id, {list(KINDS)}[o_custkey % 6 + 1] AS t, {list(PROVENANCE)}[o_orderkey % 11 + 1] AS p FROM orders)
    SELECT comp_id, CASE WHEN p = 'HumanAssertion' THEN CASE t WHEN 'Acquisition' THEN 'Stable' ELSE 'Candidate' END WHEN t = 'Event' AND p IN ('ExtractionRepair', 'EnrichmentFeedback') THEN 'Candidate' WHEN t = 'HiddenMeaning' AND p IN ('HiddenMeaningRule', 'EnrichmentFeedback') THEN 'Candidate'
        WHEN t = 'Pattern' AND p = 'PatternMining' THEN 'Candidate' WHEN t = 'Hypothesis' AND p = 'Abductive' THEN 'Quarantine' WHEN t = 'Acquisition' AND p = 'AcquisitionRecall' THEN 'Stable' WHEN t = 'Acquisition' AND p = 'AcquisitionSelfStudy' THEN 'Quarantine'
        WHEN t = 'Acquisition' AND p = 'AcquisitionUserAnswer' THEN 'Candidate' ELSE 'New' END AS first_lifecycle,
      CASE WHEN p = 'HumanAssertion' THEN 'Grounded' WHEN t = 'HiddenMeaning' AND p IN ('HiddenMeaningRule', 'EnrichmentFeedback') THEN 'Inferred' WHEN t = 'Pattern' AND p = 'PatternMining' THEN 'Inferred' WHEN t = 'Hypothesis' AND p = 'Abductive' THEN 'Hypothesis'
        WHEN t = 'Acquisition' AND p = 'AcquisitionRecall' THEN 'Grounded' WHEN t = 'Acquisition' AND p = 'AcquisitionSelfStudy' THEN 'Inferred' ELSE 'Observed' END AS first_epistemic FROM k""")
def initial_states(spark, d):
    pick = lambda by, names: F.element_at(F.array(*[F.lit(n) for n in names]), (by % len(names) + 1).cast("int"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("comp_id"), pick(F.col("o_custkey"), KINDS).alias("comp_type"), pick(F.col("o_orderkey"), PROVENANCE).alias("provenance"))
    return G.first_states(rows)


@query(f"{CM} SELECT comp_id, CASE WHEN batch_seen > 5 AND len(contradictions) <= 2 THEN 'Inferred' WHEN batch_seen > 10 THEN 'Deprecated' ELSE epistemic END AS resolved FROM comps WHERE len(contradictions) > 0")
def contradiction_resolutions(spark, d):
    return G.resolutions(compositions(spark, d))


TM = with_sql("comps", "members", "typed_members")
GAPS = """gaps AS (SELECT comp_id, CASE role WHEN 'Cause' THEN 'MissingCause' WHEN 'Purpose' THEN 'MissingPurpose' ELSE 'MissingRole' END AS gap, role FROM (SELECT comp_id, unnest(['Agent', 'Patient', 'Cause', 'Purpose']) AS role FROM comps WHERE comp_type = 'Event') e WHERE NOT EXISTS (SELECT 1 FROM typed_members m WHERE m.comp_id = e.comp_id AND m.role = e.role)
    UNION ALL SELECT comp_id, 'IncompleteHiddenMeaning', CASE WHEN p THEN 'Solution' ELSE 'Problem' END FROM (SELECT comp_id, bool_or(role = 'Problem') AS p, bool_or(role = 'Solution') AS s FROM typed_members WHERE comp_id IN (SELECT comp_id FROM comps WHERE comp_type = 'HiddenMeaning') GROUP BY comp_id) WHERE NOT (p AND s))"""


@query(f"{TM}, {GAPS} SELECT * FROM gaps")
def role_gaps(spark, d):
    return Q.atom_gaps(compositions(spark, d), typed_members(spark, d))


@query(f"""{with_sql('sentences', 'tokens')}, shared AS (SELECT token FROM tokens GROUP BY token HAVING count(DISTINCT (doc_id, sent)) > 1)
    SELECT DISTINCT doc_id || ':' || sent AS comp_id FROM tokens t WHERE NOT EXISTS (SELECT 1 FROM tokens x JOIN shared USING (token) WHERE x.doc_id = t.doc_id AND x.sent = t.sent)""")
def isolated_compositions(spark, d):
    """Of sentences as compositions of their words; orders always share a priority with others."""
    sets = kept(sentences(spark, d).where("size(words) > 0").select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("sent").cast("string")).alias("comp_id"), F.array_distinct("words").alias("words")), "sentences")
    return G.isolated_of(sets.select("comp_id", F.size("words").alias("size")), sets.select("comp_id", F.explode("words").alias("node_id")))


@query(f"{CM} SELECT comp_id, CASE WHEN epistemic = 'Contradicted' THEN 'UnresolvedContradiction' ELSE 'LowGrounding' END AS gap FROM comps WHERE epistemic = 'Contradicted' OR (epistemic = 'Inferred' AND confidence < 0.5)")
def grounding_gaps(spark, d):
    return Q.grounding_gaps(compositions(spark, d)).drop("role")


@query(f"""{CM} SELECT batch_seen, count(*) FILTER (WHERE epistemic = 'Contradicted') AS contradicted, CASE WHEN count(*) FILTER (WHERE epistemic = 'Contradicted') >= 3 THEN 'Reflective' WHEN count(*) FILTER (WHERE epistemic = 'Contradicted') > 0 OR avg(confidence) < 0.5 THEN 'Analytical' ELSE 'Reactive' END AS mode FROM comps GROUP BY batch_seen""")
def cognitive_mode(spark, d):
    return G.cognitive_mode(compositions(spark, d), "batch_seen")


@query(f"""{CM} SELECT comp_id, min(node_id) FILTER (WHERE role = 'Agent') AS agent, min(node_id) FILTER (WHERE role = 'Purpose') AS goal, round(0.8::DOUBLE * avg(confidence), 6) AS confidence FROM members GROUP BY comp_id""")
def implied_goals(spark, d):
    return G.problem_solutions(members(spark, d))


def _spread_sql(seeds: str) -> str:
    parts, now = [f"plays AS (SELECT DISTINCT node_id, comp_id FROM members), a0 AS ({seeds})"], "a0"
    for hop in range(3):
        nxt = f"a{hop + 1}"
        parts.append(f"""s{hop} AS (SELECT seed, t.node_id, sum(e) AS e FROM (SELECT seed, node_id AS frm, energy * {0.5 ** (hop + 1)}::DOUBLE AS e FROM {now}) x JOIN plays f ON f.node_id = frm JOIN members t ON t.comp_id = f.comp_id AND t.node_id <> frm WHERE e >= 0.01 GROUP BY seed, t.node_id),
            {nxt} AS (SELECT coalesce(a.seed, s.seed) AS seed, coalesce(a.node_id, s.node_id) AS node_id, coalesce(energy, 0) + coalesce(e, 0) * CASE WHEN energy IS NOT NULL THEN 0.5 ELSE 1.0 END::DOUBLE AS energy FROM {now} a FULL JOIN s{hop} s ON a.seed = s.seed AND a.node_id = s.node_id)""")
        now = nxt
    return ",\n".join(parts) + f", act AS (SELECT * FROM {now} WHERE energy >= 0.01)"


PARTS = "SELECT 'p' || p_partkey AS seed, 'p' || p_partkey AS node_id, 1.0::DOUBLE AS energy FROM part WHERE p_partkey % 100 = 0"


def _activations(spark, d, rows, *of: str, told=R.listed):
    """From every hundredth part, or those named: what ``told`` makes of the energies of a block of seeds."""
    seeds = table(spark, d, "part").where("p_partkey % 100 = 0").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("seed"))
    seeds = seeds.where(F.col("seed").isin(*of)) if of else seeds
    return R.spread(rows, seeds.select("seed", F.col("seed").alias("node_id"), F.lit(1.0).alias("energy")), told=told)


@query(f"{CM}, {_spread_sql(PARTS)} SELECT seed, count(*) AS n, round(sum(energy), 4) AS total, round(max(energy), 6) AS top FROM act GROUP BY seed")
def spread_activation(spark, d):
    return _activations(spark, d, members(spark, d), told=R.totals).select("seed", "n", F.round("total", 4).alias("total"), F.round("top", 6).alias("top"))


@query(f"""{CM}, {_spread_sql(PARTS)}, len AS (SELECT seed, sqrt(sum(energy * energy)) AS l FROM act GROUP BY seed), pr AS (SELECT DISTINCT seed AS a, 'p' || ((substr(seed, 2)::BIGINT + 100)) AS b FROM len WHERE 'p' || ((substr(seed, 2)::BIGINT + 100)) IN (SELECT seed FROM len)),
    c AS (SELECT node_id, list(DISTINCT comp_id) AS cs FROM members GROUP BY node_id), dots AS (SELECT a, b, sum(x.energy * y.energy) AS dot FROM pr JOIN act x ON x.seed = a JOIN act y ON y.seed = b AND y.node_id = x.node_id GROUP BY a, b)
    SELECT pr.a, pr.b, round(0.6::DOUBLE * CASE WHEN len(list_distinct(list_concat(coalesce(ca.cs, []), coalesce(cb.cs, [])))) = 0 THEN 0 ELSE len(list_intersect(coalesce(ca.cs, []), coalesce(cb.cs, [])))::DOUBLE / len(list_distinct(list_concat(coalesce(ca.cs, []), coalesce(cb.cs, [])))) END + 0.4::DOUBLE * coalesce(dot / (la.l * lb.l), 0), 6) AS similarity
    FROM pr LEFT JOIN c ca ON ca.node_id = pr.a LEFT JOIN c cb ON cb.node_id = pr.b LEFT JOIN dots ON dots.a = pr.a AND dots.b = pr.b JOIN len la ON la.seed = pr.a JOIN len lb ON lb.seed = pr.b""")
def similarity_blend(spark, d):
    rows = members(spark, d)
    seeds = table(spark, d, "part").where("p_partkey % 100 = 0").select("p_partkey")
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    pairs = seeds.join(seeds.select((F.col("p_partkey") - 100).alias("p_partkey")), "p_partkey").select(name(F.col("p_partkey")).alias("a"), name(F.col("p_partkey") + 100).alias("b"))
    return R.blended(rows, seeds.select(name(F.col("p_partkey")).alias("seed"), name(F.col("p_partkey")).alias("node_id"), F.lit(1.0).alias("energy")), pairs)


@query(f"""{CM}, {_spread_sql(PARTS)}, e AS (SELECT comp_id, max(energy) FILTER (WHERE seed = 'p100') AS x, max(energy) FILTER (WHERE seed = 'p200') AS y FROM members JOIN act USING (node_id) WHERE seed IN ('p100', 'p200') GROUP BY comp_id)
    SELECT comp_id, round(2 * x * y / (x + y), 6) AS score FROM e WHERE x IS NOT NULL AND y IS NOT NULL""")
def bridging_compositions(spark, d):
    rows = members(spark, d)
    return R.bridges(rows, _activations(spark, d, rows, "p100", "p200"), "p100", "p200")


GROUNDED = "SELECT 'p' || p_partkey AS seed, 'p' || p_partkey AS node_id, 0.5::DOUBLE + 0.5::DOUBLE * (p_partkey // 100 % 5) / 4 AS energy FROM part WHERE p_partkey % 100 = 0"


@query(f"{CM}, {_spread_sql(GROUNDED)} SELECT seed, count(*) AS n, round(sum(energy), 4) AS total FROM act GROUP BY seed")
def targeted_spread(spark, d):
    seeds = table(spark, d, "part").where("p_partkey % 100 = 0").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("seed"), (F.floor(F.col("p_partkey") / 100) % 5 / 4).alias("grounding"))
    act = R.targeted_spread(members(spark, d), seeds.select("seed", F.col("seed").alias("node_id"), F.lit(1.0).alias("energy"), "grounding"), told=R.totals)
    return act.select("seed", "n", F.round("total", 4).alias("total"))


CONTEXT = PARTS + " UNION ALL SELECT 'context', 's' || s_suppkey, 1.0::DOUBLE FROM supplier WHERE s_suppkey IN (1, 2, 3)"


@query(f"""{CM}, {_spread_sql(CONTEXT)}, c AS (SELECT node_id, energy FROM act WHERE seed = 'context'), o AS (SELECT seed, count(*) AS n, count(c.energy) AS common FROM act LEFT JOIN c USING (node_id) WHERE seed <> 'context' GROUP BY seed),
    m AS (SELECT DISTINCT comp_id, node_id FROM members), k AS (SELECT x.node_id, count(*) / 3.0::DOUBLE AS a FROM m x JOIN m y ON x.comp_id = y.comp_id AND y.node_id IN ('s1', 's2', 's3') GROUP BY 1)
    SELECT seed AS target, round(0.4::DOUBLE * coalesce(c.energy, 0) + 0.4::DOUBLE * common / (n + (SELECT count(*) FROM c) - common) + 0.2::DOUBLE * coalesce(a / (a + 2), 0), 6) AS score FROM o LEFT JOIN c ON c.node_id = seed LEFT JOIN k ON k.node_id = seed""")
def attention_scores(spark, d):
    targets = table(spark, d, "part").where("p_partkey % 100 = 0").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("node_id"))
    context = table(spark, d, "supplier").where("s_suppkey IN (1, 2, 3)").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("node_id"), F.lit(1.0).alias("energy"))
    return R.attention(members(spark, d), targets, context)


SENSES = """senses AS (SELECT 'p' || l_partkey AS node_id, l_linenumber AS sense, ['Fragile', 'Tentative', 'Grounded', 'Mature'][l_orderkey % 4 + 1] AS grounding, (floor(l_extendedprice)::BIGINT % 1000) / 1000.0::DOUBLE AS coherence FROM lineitem WHERE l_returnflag = 'R')"""


def _senses(spark, d):
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    grounding = F.element_at(F.array(*[F.lit(g) for g in ("Fragile", "Tentative", "Grounded", "Mature")]), (F.col("l_orderkey") % 4 + 1).cast("int"))
    return lines.select(F.concat(F.lit("p"), F.col("l_partkey")).alias("node_id"), F.col("l_linenumber").alias("sense"), grounding.alias("grounding"), share("l_extendedprice").alias("coherence"))


@query(f"{CM}, {SENSES} SELECT comp_id, round(coalesce(0.15::DOUBLE * (1 - sum(coherence) / nullif(count(coherence), 0)), 0) + 1e-9, 6) AS penalty FROM members LEFT JOIN senses USING (node_id) GROUP BY comp_id")
def coherence_penalty(spark, d):
    return N.coherence_penalty(members(spark, d), _senses(spark, d))


TOLD = "told AS (SELECT comp_id, epistemic <> 'Contradicted' AS confirms FROM comps WHERE epistemic = 'Contradicted' OR lifecycle = 'Stable')"


def _told(spark, d):
    comps = compositions(spark, d)
    return comps.where("epistemic = 'Contradicted' OR lifecycle = 'Stable'").select("comp_id", (F.col("epistemic") != "Contradicted").alias("confirms"))


@query(f"{CM}, {TOLD} SELECT node_id, count(*) FILTER (WHERE confirms) AS confirming, count(*) FILTER (WHERE NOT confirms) AS contradicting FROM (SELECT DISTINCT comp_id, node_id FROM members) JOIN told USING (comp_id) GROUP BY node_id")
def sense_evidence(spark, d):
    return N.evidence(members(spark, d), _told(spark, d))


@query(f"""{CM}, {SENSES}, {TOLD}, g AS (SELECT node_id, least(1.0, count(DISTINCT comp_id) / 10.0) AS c FROM members GROUP BY 1), e AS (SELECT node_id, count(*) AS k FROM members JOIN told USING (comp_id) WHERE confirms GROUP BY 1)
    SELECT node_id, sense, grounding, coherence FROM senses LEFT JOIN g USING (node_id) LEFT JOIN e USING (node_id) WHERE NOT (grounding = 'Fragile' AND coalesce(c, 0) < 0.1 AND coalesce(k, 0) = 0 AND coherence < 0.2)""")
def kept_senses(spark, d):
    rows = members(spark, d)
    return N.kept(_senses(spark, d), rows, N.evidence(rows, _told(spark, d)))


@query(f"{CM} SELECT comp_id, pos, node_id, role, round(confidence, 6) AS confidence FROM members")
def snapshot_round_trip(spark, d):
    return Z.members_of_snapshot(Z.snapshot_rows(members(spark, d))).withColumn("confidence", F.round("confidence", 6))


@query("""WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, CASE WHEN l_partkey % 3 = 0 THEN -0.8::DOUBLE ELSE 0.6::DOUBLE END AS w FROM lineitem), v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS k FROM v),
    m AS (SELECT dst, k, sum(w * x) / sum(abs(w)) AS m FROM e JOIN u ON vec_id = src GROUP BY dst, k), b AS (SELECT vec_id, k, m IS NOT NULL AS told, CASE WHEN m IS NULL THEN x ELSE 0.5::DOUBLE * x + 0.5::DOUBLE * m END AS x FROM u LEFT JOIN m USING (k) WHERE m.dst = vec_id OR m.dst IS NULL UNION ALL SELECT vec_id, k, false, x FROM u WHERE vec_id NOT IN (SELECT dst FROM m)),
    n AS (SELECT vec_id, CASE WHEN bool_or(told) THEN sqrt(sum(x * x)) ELSE 1 END AS l FROM b GROUP BY 1) SELECT vec_id, round(max(x / l), 6) AS top, round(sum(x / l), 5) AS total FROM b JOIN n USING (vec_id) GROUP BY vec_id""")
def message_passing(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    typed = lines.select("src", "dst", F.when(F.col("src") % 3 == 0, "DIFFERENTIAL").otherwise("FUNCTIONAL").alias("relation"), F.lit(1.0).alias("confidence"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    new = R.message_pass(typed, vectors)
    return new.select(F.col("node_id").alias("vec_id"), F.round(F.array_max("embedding"), 6).alias("top"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("""WITH s AS (SELECT l_partkey AS part, l_suppkey AS s, list(DISTINCT l_linenumber) AS e FROM lineitem GROUP BY 1, 2), p AS (SELECT x.part, x.s AS a, y.s AS b, len(list_distinct(list_concat(x.e, y.e))) AS u, len(list_intersect(x.e, y.e)) AS i FROM s x JOIN s y ON x.part = y.part AND x.s < y.s)
    SELECT part, a, b, round(u / 7.0::DOUBLE * (1 - i::DOUBLE / u), 6) AS score FROM p WHERE u / 7.0::DOUBLE * (1 - i::DOUBLE / u) >= 0.4""")
def hybrid_pairs(spark, d):
    sets = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("s")).agg(F.collect_set("l_linenumber").alias("e"))
    return P.complementary(sets, "part", "s", "e", F.array(*[F.lit(k) for k in range(1, 8)]), 0.4)


DECAY = "CASE relation WHEN 'CATEGORICAL' THEN 0.9 WHEN 'CAUSAL' THEN 0.7 WHEN 'FUNCTIONAL' THEN 0.6 ELSE 0.5 END::DOUBLE"


@query(f"""{with_sql('edges')}, r AS (SELECT src, dst, {DECAY} * confidence AS w FROM edges), a0 AS (SELECT 'c' || c_custkey AS node_id, 0.5::DOUBLE AS energy FROM customer WHERE c_custkey % 50 = 0),
    a1 AS (SELECT coalesce(a.node_id, b.node_id) AS node_id, least(1.0, coalesce(energy, 0) + coalesce(x, 0)) AS energy FROM a0 a FULL JOIN (SELECT dst AS node_id, sum(energy * w) AS x FROM a0 JOIN r ON node_id = src GROUP BY dst) b ON a.node_id = b.node_id),
    a2 AS (SELECT coalesce(a.node_id, b.node_id) AS node_id, least(1.0, coalesce(energy, 0) + coalesce(x, 0)) AS energy FROM a1 a FULL JOIN (SELECT dst AS node_id, sum(energy * w) AS x FROM a1 JOIN r ON node_id = src GROUP BY dst) b ON a.node_id = b.node_id)
    SELECT node_id, round(energy, 6) AS energy FROM a2""")
def typed_spread(spark, d):
    seeds = table(spark, d, "customer").where("c_custkey % 50 = 0").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node_id"), F.lit(0.5).alias("energy"))
    return R.typed_spread(edges(spark, d), seeds).select("node_id", F.round("energy", 6).alias("energy"))


@query(f"""{with_sql('edges')}, st AS (SELECT DISTINCT src, dst FROM edges), h0 AS (SELECT 'c' || c_custkey AS seed, 'c' || c_custkey AS node_id, 0 AS hops FROM customer WHERE c_custkey % 50 = 0),
    h1 AS (SELECT DISTINCT seed, dst AS node_id, 1 AS hops FROM h0 JOIN st ON node_id = src), h2 AS (SELECT DISTINCT seed, dst AS node_id, 2 AS hops FROM h1 JOIN st ON node_id = src)
    SELECT seed, node_id, min(hops) AS hops FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY seed, node_id""")
def bounded_reach(spark, d):
    seeds = table(spark, d, "customer").where("c_custkey % 50 = 0").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node_id"))
    return R.reach(edges(spark, d), seeds, 2)


def _beam_sql() -> str:
    hop = lambda i, front: f"b{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, path) AS k FROM (SELECT seed, dst AS end_, list_append(path, dst) AS path, score * w AS score FROM {front} JOIN rated ON src = end_ WHERE NOT list_contains(path, dst))) WHERE k <= 3)"
    return f"""{with_sql('edges')}, rated AS (SELECT src, dst, {DECAY} * confidence AS w FROM edges WHERE {DECAY} * confidence >= 0.1), b0 AS (SELECT 'c' || c_custkey AS seed, 'c' || c_custkey AS end_, ['c' || c_custkey] AS path, 1.0::DOUBLE AS score FROM customer WHERE c_custkey % 50 = 0),
    {hop(1, "b0")}, {hop(2, "b1")}, {hop(3, "b2")}, every AS (SELECT seed, path, score FROM b1 UNION ALL SELECT seed, path, score FROM b2 UNION ALL SELECT seed, path, score FROM b3)
    SELECT seed, array_to_string(path, '>') AS path, round(score + 1e-9, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY len(path) DESC, score DESC, path) AS k FROM every) WHERE k = 1"""


@query(_beam_sql())
def beam_traverse(spark, d):
    seeds = table(spark, d, "customer").where("c_custkey % 50 = 0").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node_id"))
    return R.beam(edges(spark, d), seeds)
