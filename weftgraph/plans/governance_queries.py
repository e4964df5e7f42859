"""Queries over scopes, rule texts, versions and clusters, each with the SQL that checks it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import evidence as E
from weftgraph.operators import neighbours as N
from weftgraph.operators import rule_texts as R
from weftgraph.operators import scopes as S
from weftgraph.operators import vectors as W
from weftgraph.plans.graph_queries import CM, TM, _activations, _spread_sql
from weftgraph.plans.text_queries import FRAMES, _frames
from weftgraph.sources import versions as V
from weftgraph.sources.scratch import kept, shared_folder
from weftgraph.sources.tables import compositions, edges, members, share, table, typed_members, with_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


SCOPES = """d AS (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*), c_mktsegment) AS r FROM customer GROUP BY 1, 2),
    l0 AS (SELECT 'r' || r_regionkey AS scope, NULL::VARCHAR AS parent, CASE WHEN r_regionkey = 0 THEN 'general' ELSE r_name END AS domain, [r_name] AS topics, 0.05::DOUBLE AS min_confidence, 3 AS max_depth, []::VARCHAR[] AS denied FROM region),
    l1 AS (SELECT 'n' || n_nationkey AS scope, scope AS parent, domain, list_sort(list_distinct(list_concat([n_name], topics))) AS topics, greatest(0.01::DOUBLE * n_nationkey, min_confidence) AS min_confidence, least(2, max_depth) AS max_depth, [c_mktsegment] AS denied FROM nation JOIN l0 ON scope = 'r' || n_regionkey JOIN d ON c_nationkey = n_nationkey AND r = 1),
    l2 AS (SELECT 'c' || c_custkey AS scope, scope AS parent, domain, topics, greatest((floor(abs(c_acctbal))::BIGINT % 1000) / 1000.0::DOUBLE, min_confidence) AS min_confidence, least(c_custkey % 4, max_depth) AS max_depth, denied FROM customer JOIN l1 ON scope = 'n' || c_nationkey)"""


def _scopes(spark, d):
    """Customers within nations within regions; a nation denies its rarest segment."""
    from pyspark.sql import Window

    none, name = F.array().cast("array<string>"), lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    customer, nation, region = (table(spark, d, n) for n in ("customer", "nation", "region"))
    n = customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    rare = n.withColumn("r", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("n", "c_mktsegment"))).where("r = 1").select("c_nationkey", "c_mktsegment")

    def limits(domain, topics, least, depth, denied):
        return [domain.alias("domain"), topics.alias("topics"), least.cast("double").alias("min_confidence"), depth.cast("int").alias("max_depth"), none.alias("allowed"), denied.alias("denied"), F.lit(True).alias("seeds")]

    top = region.select(name("r", "r_regionkey").alias("scope"), F.lit(None).cast("string").alias("parent"), *limits(F.when(F.col("r_regionkey") == 0, "general").otherwise(F.col("r_name")), F.array("r_name"), F.lit(0.05), F.lit(3), none))
    middle = nation.join(rare, nation.n_nationkey == rare.c_nationkey).select(name("n", "n_nationkey").alias("scope"), name("r", "n_regionkey").alias("parent"), *limits(F.lit("general"), F.array("n_name"), 0.01 * F.col("n_nationkey"), F.lit(2), F.array("c_mktsegment")))
    low = customer.select(name("c", "c_custkey").alias("scope"), name("n", "c_nationkey").alias("parent"), *limits(F.lit("general"), none, share(F.abs("c_acctbal")), F.col("c_custkey") % 4, none))
    return top.unionByName(middle).unionByName(low)


@query(f"""WITH {SCOPES}, e AS (SELECT *, 0 AS level FROM l0 UNION ALL SELECT *, 1 FROM l1 UNION ALL SELECT *, 2 FROM l2) SELECT scope, parent, level, domain, array_to_string(topics, ',') AS topics, round(min_confidence, 6) AS min_confidence, max_depth::INT AS max_depth, array_to_string(denied, ',') AS denied FROM e""")
def closed_scopes(spark: SparkSession, d: str) -> DataFrame:
    told = S.closed(_scopes(spark, d))
    return told.select("scope", "parent", "level", "domain", F.array_join("topics", ",").alias("topics"), F.round("min_confidence", 6).alias("min_confidence"), "max_depth", F.array_join("denied", ",").alias("denied"))


@query(f"""WITH {SCOPES}, o AS (SELECT o_orderkey, o_custkey, c_mktsegment, (floor(o_totalprice)::BIGINT % 1000) / 1000.0::DOUBLE AS c FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT parent AS scope, count(*) AS n, count(*) FILTER (WHERE c >= min_confidence AND NOT list_contains(denied, c_mktsegment)) AS inside FROM o JOIN l2 ON scope = 'c' || o_custkey GROUP BY 1""")
def orders_in_scope(spark, d):
    """Orders that the scope of their customer takes, by nation."""
    scopes = S.closed(_scopes(spark, d)).withColumnRenamed("scope", "own")
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("own"), "c_mktsegment", share("o_totalprice").alias("c"))
    inside = S.within(F.col("c_mktsegment"), F.col("c"), F.col("allowed"), F.col("denied"), F.col("min_confidence"))
    return rows.join(scopes, "own").groupBy(F.col("parent").alias("scope")).agg(F.count("*").alias("n"), F.count_if(inside).alias("inside"))


def _traverse_sql(hard: bool) -> str:
    keep = "WHERE inside" if hard else ""
    see = lambda i, front: f"f{i} AS (SELECT seed, node_id, {i} AS depth, CASE WHEN inside THEN confidence ELSE 0.3::DOUBLE * confidence END AS confidence, inside FROM ({front}) JOIN nodes USING (node_id) {keep})"
    grow = lambda i, seen: f"SELECT DISTINCT seed, dst AS node_id FROM f{i - 1} JOIN edges ON src = node_id WHERE (seed, dst) NOT IN (SELECT (seed, node_id) FROM ({seen}))"
    return f"""{with_sql("edges")}, nodes AS (SELECT node_id, avg(c) AS confidence, avg(c) >= 0.4 AS inside FROM (SELECT src AS node_id, confidence AS c FROM edges UNION ALL SELECT dst, confidence FROM edges) GROUP BY 1),
        {see(0, "SELECT 'c' || c_custkey AS seed, 'c' || c_custkey AS node_id FROM customer WHERE c_custkey % 50 = 0")}, {see(1, grow(1, "SELECT seed, node_id FROM f0"))}, {see(2, grow(2, "SELECT seed, node_id FROM f0 UNION ALL SELECT seed, node_id FROM f1"))}
        SELECT seed, node_id, depth, round(confidence, 6) AS confidence, inside FROM (SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2)"""


def _traverse(spark, d, boundary):
    e = kept(edges(spark, d).select("src", "dst", "confidence"), "edges")  # read for the nodes and for the steps
    ends = e.select(F.col("src").alias("node_id"), "confidence").unionAll(e.select("dst", "confidence"))
    nodes = ends.groupBy("node_id").agg(F.avg("confidence").alias("confidence")).withColumn("inside", F.col("confidence") >= 0.4)
    seeds = table(spark, d, "customer").where("c_custkey % 50 = 0").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node_id"))
    return S.traverse(e, nodes, seeds, 2, boundary).withColumn("confidence", F.round("confidence", 6))


@query(_traverse_sql(True))
def scoped_traverse_hard(spark, d):
    return _traverse(spark, d, "hard")


@query(_traverse_sql(False))
def scoped_traverse_soft(spark, d):
    return _traverse(spark, d, "soft")


RULES = [
    R.Rule("luxury", "penghasilan di atas 90 ribu", "dikenakan tarif 30 persen"),
    R.Rule("small", "jika harga di bawah 1.000", "tarif 2,5%"),
    R.Rule("amount", "mulai Rp50 juta atau 80 ribu", "dikenakan pajak sebesar 5 %"),
]


@query("""SELECT l_orderkey, l_linenumber, rule, l_extendedprice AS value, rate, round(l_extendedprice * rate, 4) AS charge FROM lineitem JOIN (VALUES ('luxury', 90000.0::DOUBLE, true, 0.3::DOUBLE), ('small', 1000.0, false, 0.025), ('amount', 50000000.0, true, 0.05)) AS r(rule, t, above, rate)
    ON (above AND l_extendedprice > t) OR (NOT above AND l_extendedprice < t)""")
def rule_texts(spark, d):
    return R.evaluate(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_extendedprice", RULES)


DELTA = """base AS (SELECT comp_id, comp_type, lifecycle, epistemic, confidence, batch_seen FROM comps WHERE comp_id % 3 <> 0), fresh AS (SELECT comp_id, comp_type, lifecycle, epistemic, greatest(confidence, 0.3) AS confidence FROM comps WHERE comp_id % 3 = 0 OR comp_id % 7 = 0),
    m AS (SELECT comp_id, CASE WHEN f.comp_id IS NOT NULL AND (b.comp_id IS NULL OR f.confidence >= b.confidence) THEN f.confidence ELSE b.confidence END AS confidence, coalesce(b.comp_type, f.comp_type) AS comp_type, coalesce(b.lifecycle, f.lifecycle) AS lifecycle, coalesce(b.epistemic, f.epistemic) AS epistemic,
      CASE WHEN f.comp_id IS NOT NULL THEN 20 ELSE b.batch_seen END AS batch_seen, f.comp_id IS NOT NULL AS touched FROM base b FULL JOIN fresh f USING (comp_id)),
    n AS (SELECT comp_id, count(*) AS size FROM members GROUP BY 1), c AS (SELECT m.*, coalesce(size, 0) AS size, comp_id % 11 = 0 AS fixed, comp_id % 13 = 0 AS wrong FROM m LEFT JOIN n USING (comp_id)),
    d AS (SELECT *, CASE WHEN fixed THEN 0.9::DOUBLE ELSE confidence END * CASE WHEN wrong THEN 0.8::DOUBLE ELSE 1 END AS c2, CASE WHEN wrong THEN 'Contradicted' WHEN fixed THEN 'Observed' ELSE epistemic END AS e2, touched OR fixed OR wrong AS seen FROM c),
    f AS (SELECT *, greatest(0.0, least(1.0, c2 * exp(-2.0 * (20 - batch_seen) / 50.0) * (1 + 0.2 * ln(1 + size)))) AS faded FROM d),
    g AS (SELECT *, CASE WHEN seen OR lifecycle IN ('New', 'Deprecated') THEN c2 ELSE faded END AS c3, CASE WHEN seen OR lifecycle IN ('New', 'Deprecated') THEN lifecycle WHEN faded < 0.1 THEN 'Deprecated' WHEN faded < 0.4 THEN CASE lifecycle WHEN 'Stable' THEN 'Candidate' WHEN 'Candidate' THEN 'Quarantine' ELSE lifecycle END ELSE lifecycle END AS l3 FROM f),
    h AS (SELECT *, CASE WHEN e2 <> 'Contradicted' AND l3 = 'Candidate' AND c3 >= 0.55 THEN 'Stable' ELSE l3 END AS l4 FROM g)"""


@query(f"{CM}, {DELTA} SELECT comp_id, comp_type, l4 AS lifecycle, CASE WHEN e2 = 'Inferred' AND l4 = 'Stable' AND c3 >= 0.7 THEN 'Grounded' ELSE e2 END AS epistemic, round(c3, 6) AS confidence, batch_seen FROM h")
def governed_delta(spark, d):
    """Two thirds of the orders are there; the others, some again, corrections and contradictions come in a delta, which is sent twice."""
    comps, root = compositions(spark, d), f"{shared_folder(spark)}/governed-{uuid.uuid4().hex}"
    V.start(comps.where("comp_id % 3 <> 0"), root)
    fresh = comps.where("comp_id % 3 = 0 OR comp_id % 7 = 0").withColumn("confidence", F.greatest("confidence", F.lit(0.3)))
    for _ in range(2):
        V.apply_delta(spark, root, "delta-1", 20, fresh, comps.where("comp_id % 11 = 0").select("comp_id", F.lit(0.9).alias("confidence")), comps.where("comp_id % 13 = 0"), members(spark, d))
    return V.current(spark, root).withColumn("confidence", F.round("confidence", 6))


UNIT = "n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), v AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM n)"
#: Cosines of the given vectors are lower than those of sentences.
CLOSE = 0.4


@query(f"""WITH RECURSIVE {UNIT}, p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_inner_product(x.e, y.e) >= {CLOSE} - 1e-12), r AS (SELECT DISTINCT a, a AS b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a) SELECT a AS vec_id, min(b) AS cluster FROM r GROUP BY a""")
def concept_clusters(spark, d):
    return N.clusters(table(spark, d, "embeddings"), "vec_id", "embedding", CLOSE).select(F.col("key").alias("vec_id"), "cluster")


@query(f"""WITH RECURSIVE {UNIT}, s AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b, round(list_inner_product(x.e, y.e), 6) AS c FROM v x JOIN v y ON x.vec_id <> y.vec_id), p AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_inner_product(x.e, y.e) >= {CLOSE} - 1e-12),
    r AS (SELECT DISTINCT a, a AS b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a), cl AS (SELECT a AS vec_id, min(b) AS cluster FROM r GROUP BY a),
    f AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, key) AS hop FROM (SELECT a AS q, b AS key, c AS score, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM s WHERE a % 50 = 0) WHERE k <= 3),
    w AS MATERIALIZED (SELECT f.q, f.hop, s.b AS other, s.c, s.c * f.score * 0.8::DOUBLE AS second FROM f JOIN s ON s.a = f.key JOIN p ON p.a = s.a AND p.b = s.b WHERE s.c * f.score * 0.8::DOUBLE >= 0.05 AND (f.q, s.b) NOT IN (SELECT (q, key) FROM f)),
    h1 AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, other) AS k FROM w WHERE hop = 1) WHERE k <= 3),
    h2 AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, other) AS k FROM w WHERE hop = 2 AND (q, other) NOT IN (SELECT (q, other) FROM h1)) WHERE k <= 3),
    h3 AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, other) AS k FROM w WHERE hop = 3 AND (q, other) NOT IN (SELECT (q, other) FROM h1 UNION ALL SELECT (q, other) FROM h2)) WHERE k <= 3),
    t AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3), sure AS (SELECT DISTINCT q, cluster FROM f JOIN cl ON key = vec_id WHERE score >= 0.3),
    e AS (SELECT q, key, score FROM f UNION ALL SELECT t.q, other, CASE WHEN sure.q IS NOT NULL THEN least(1.0, second + 0.1) ELSE second END FROM t LEFT JOIN cl ON other = vec_id LEFT JOIN sure ON sure.q = t.q AND sure.cluster = cl.cluster)
    SELECT q, key, round(score, 6)::DOUBLE AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, key) AS rank FROM e) WHERE rank <= 6""")
def second_hop(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    first = W.nearest(v.where("vec_id % 50 = 0"), v, "vec_id", "embedding", 3).select("q", F.col("vec_id").alias("key"), F.col("cosine").alias("score"))
    told = N.retrieve(first, v, "vec_id", "embedding", 6, 3, 0.05, CLOSE)
    return told.select("q", "key", F.round("score", 6).alias("score"), "rank")


ENDS = "SELECT 'p' || p_partkey AS seed, 'p' || p_partkey AS node_id, 1.0::DOUBLE AS energy FROM part WHERE p_partkey IN (100, 200)"


@query(f"{CM}, {_spread_sql(ENDS)} SELECT node_id, round(max(energy), 6) AS energy FROM act GROUP BY node_id")
def merged_activations(spark, d):
    act = _activations(spark, d, members(spark, d), "p100", "p200")
    return E.merged(act.where("seed = 'p100'"), act.where("seed = 'p200'")).withColumn("energy", F.round("energy", 6))


@query(f"""{TM}, q AS (SELECT n_name AS q, 's' || s_suppkey AS node_id FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT n_name, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 20 = 0),
    r AS (SELECT DISTINCT q, node_id, comp_id, role FROM q JOIN typed_members USING (node_id)), k AS (SELECT q, count(DISTINCT node_id) AS k FROM r GROUP BY 1), m AS (SELECT q, count(*) AS met FROM (SELECT DISTINCT x.q, x.node_id, y.node_id FROM r x JOIN r y ON x.q = y.q AND x.comp_id = y.comp_id AND x.node_id < y.node_id AND x.role <> y.role) GROUP BY 1)
    SELECT q, round(CASE WHEN count(*) < 2 THEN 1.0 WHEN coalesce(any_value(k), 0) < 2 THEN 0.5 ELSE coalesce(any_value(met), 0) / (any_value(k) * (any_value(k) - 1) / 2.0::DOUBLE) END, 6)::DOUBLE AS coherence FROM q LEFT JOIN k USING (q) LEFT JOIN m USING (q) GROUP BY q""")
def role_coherence(spark, d):
    """Of each nation's suppliers and every twentieth of its customers."""
    nation, supplier, customer = (table(spark, d, n) for n in ("nation", "supplier", "customer"))
    seeds = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(F.col("n_name").alias("q"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node_id"))
    more = customer.where("c_custkey % 20 = 0").join(nation, customer.c_nationkey == nation.n_nationkey).select(F.col("n_name").alias("q"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"))
    return E.role_coherence(typed_members(spark, d), seeds.unionByName(more))


@query(f"""{CM}, k AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders), f AS (SELECT comp_id, count(*) AS size, min({{'p': pos, 'n': node_id}}) FILTER (WHERE role = 'Patient') AS pt, min(node_id) FILTER (WHERE role = 'Agent') AS ag, min({{'p': pos, 'n': node_id}}) FILTER (WHERE role = 'Instrument') AS i FROM members GROUP BY 1),
    c AS (SELECT comps.*, size, pt, ag, i FROM comps JOIN f USING (comp_id)) SELECT k.a, k.b, CASE WHEN coalesce(x.i.n <> y.i.n, false) THEN 'ScopedValidity' WHEN y.confidence > x.confidence AND y.batch_seen >= x.batch_seen AND y.size >= x.size THEN 'Superseded' END AS resolution
    FROM k JOIN c x ON x.comp_id = k.a JOIN c y ON y.comp_id = k.b WHERE k.b IS NOT NULL""")
def conflict_resolutions(spark, d):
    """Of each order and the same customer's next one; what differs by its first supplier holds in another place."""
    from pyspark.sql import Window

    pairs = table(spark, d, "orders").select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("b")).where("b IS NOT NULL")
    return E.resolutions(pairs, compositions(spark, d), members(spark, d), ("Instrument",))


@query(f"""{FRAMES}, n AS (SELECT doc_id, count(*) AS n, count(DISTINCT predicate) AS kinds FROM frames GROUP BY 1), p AS (SELECT doc_id, predicate, count(*) AS k, bool_or(negative) AND NOT bool_and(negative) AS torn FROM frames GROUP BY 1, 2),
    x AS (SELECT doc_id, sent, confidence AS c, k / n::DOUBLE AS energy, (kinds - 1) / n::DOUBLE AS ambiguity, k - 1 AS equal, torn FROM frames JOIN n USING (doc_id) JOIN p USING (doc_id, predicate)),
    y AS (SELECT *, CASE WHEN energy > 0.5 THEN least(1.0, c + energy * 0.15::DOUBLE) ELSE c END AS c1 FROM x), z AS (SELECT *, CASE WHEN ambiguity > 0.3 THEN c1 * (1 - ambiguity * 0.5::DOUBLE) ELSE c1 END AS c2 FROM y), w AS (SELECT *, CASE WHEN equal > 0 THEN least(1.0, c2 + least(0.1::DOUBLE, equal * 0.02::DOUBLE)) ELSE c2 END AS c3 FROM z)
    SELECT doc_id, sent, round(CASE WHEN torn THEN c3 * 0.85::DOUBLE ELSE c3 END + 1e-9, 6) AS confidence FROM w""")
def modulated_confidence(spark, d):
    """Frames in the light of their document: the share of frames with the same predicate, other predicates, and whether the predicate is denied elsewhere."""
    frames = kept(_frames(spark, d), "frames")
    n = frames.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("predicate").alias("kinds"))
    p = frames.groupBy("doc_id", "predicate").agg(F.count("*").alias("k"), (F.bool_or("negative") & ~F.bool_and("negative")).alias("torn"))
    rows = frames.join(n, "doc_id").join(p, ["doc_id", "predicate"])
    told = E.modulated(F.col("confidence"), F.col("k") / F.col("n"), (F.col("kinds") - 1) / F.col("n"), F.col("k") - 1, F.col("torn"))
    return rows.select("doc_id", "sent", F.round(told + 1e-9, 6).alias("confidence"))


RELATED = "own AS (SELECT DISTINCT comp_id, node_id FROM members), rel AS (SELECT DISTINCT x.node_id AS q, y.node_id FROM own x JOIN own y USING (comp_id) WHERE x.node_id LIKE 'p%' AND substr(x.node_id, 2)::BIGINT % 100 = 0 AND x.node_id <> y.node_id)"


def _hundredth(spark, d):
    return table(spark, d, "part").where("p_partkey % 100 = 0").select("p_partkey", F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("q"))


@query(f"{CM}, {RELATED} SELECT q, node_id FROM rel")
def related_concepts(spark, d):
    return E.related(members(spark, d), _hundredth(spark, d))


@query(f"""{CM}, {RELATED}, z AS (SELECT 'p' || p_partkey AS q FROM part WHERE p_partkey % 100 = 0), s AS (SELECT q, node_id FROM rel UNION SELECT q, q FROM z), n AS (SELECT q, count(*) AS n FROM s GROUP BY 1), k AS (SELECT x.q AS a, y.q AS b, count(*) AS k FROM s x JOIN s y ON x.node_id = y.node_id AND x.q < y.q GROUP BY 1, 2)
    SELECT x.q AS a, y.q AS b, round(coalesce(k, 0)::DOUBLE / (x.n + y.n - coalesce(k, 0)), 6) AS overlap FROM n x JOIN n y ON x.q < y.q LEFT JOIN k ON k.a = x.q AND k.b = y.q WHERE abs(substr(x.q, 2)::BIGINT - substr(y.q, 2)::BIGINT) = 100""")
def neighbourhood_overlap(spark, d):
    """Of every hundredth part and the next such one."""
    asked = _hundredth(spark, d)
    pairs = asked.join(asked.select((F.col("p_partkey") - 100).alias("p_partkey"), F.col("q").alias("other")), "p_partkey").select(F.least("q", "other").alias("a"), F.greatest("q", "other").alias("b"))
    return E.neighbourhood_overlap(members(spark, d), pairs)
