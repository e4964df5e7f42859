"""Queries over documents, conversations, events and embeddings, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import scores as S
from weftgraph.operators import aggregates as A
from weftgraph.operators import conversation as C
from weftgraph.operators import frames as M
from weftgraph.operators import pairs as P
from weftgraph.operators import temporal as T
from weftgraph.operators import text as X
from weftgraph.operators import vectors as V
from weftgraph.sources.scratch import kept
from weftgraph.sources.tables import share, table, tokens, with_sql, words

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


TOK = with_sql("sentences", "tokens")
STOP = "(" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + ")"
PLACED = f"""{TOK}, placed AS (SELECT *, max(pos) OVER (PARTITION BY doc_id, sent) + 1 AS n FROM tokens),
    counts AS (SELECT token, CASE WHEN n <= 3 THEN pos WHEN pos = 0 THEN 0 WHEN pos = n - 1 THEN -1 ELSE 1 END AS bucket, count(*) AS n FROM placed GROUP BY 1, 2)"""


@query(f"{PLACED} SELECT token, bucket, n FROM counts")
def position_counts(spark: SparkSession, d: str) -> DataFrame:
    return X.position_counts(tokens(spark, d))


@query(f"""{PLACED}, t AS (SELECT token, sum(n)::BIGINT AS total, count(*) AS buckets FROM counts GROUP BY token HAVING sum(n) >= 5)
    SELECT token, any_value(total) AS n, any_value(buckets) AS buckets, round(abs(sum(-(n / total::DOUBLE) * log2(n / total::DOUBLE))) / 2, 6) AS entropy FROM counts JOIN t USING (token) GROUP BY token""")
def token_entropy(spark, d):
    return X.token_entropy(X.position_counts(tokens(spark, d)))


@query(f"""{TOK}, m AS (SELECT a.token AS before, b.token AS token, count(*) AS n FROM tokens a JOIN tokens b ON a.doc_id = b.doc_id AND a.sent = b.sent AND a.pos = 0 AND b.pos = 1 JOIN tokens c ON c.doc_id = b.doc_id AND c.sent = b.sent AND c.pos = 2 GROUP BY 1, 2),
    t AS (SELECT before, sum(n)::BIGINT AS total, max({{'n': n, 'token': token}}) AS top FROM m GROUP BY before HAVING sum(n) >= 3) SELECT before, total, top.token AS connector, round(top.n / total::DOUBLE, 6) AS share FROM t WHERE top.n / total::DOUBLE >= 0.5""")
def connector_rate(spark, d):
    return X.connector_rate(tokens(spark, d))


@query(f"""{TOK}, placed AS (SELECT *, max(pos) OVER (PARTITION BY doc_id, sent) + 1 AS n FROM tokens) SELECT token, count(*) AS uses, round(count(*) FILTER (WHERE pos BETWEEN n - 4 AND n - 2) / count(*)::DOUBLE, 6) AS rate FROM placed GROUP BY token HAVING count(*) >= 5""")
def modifier_rate(spark, d):
    return X.modifier_rate(tokens(spark, d))


@query(f"""{TOK}, n AS (SELECT doc_id, token, count(*) AS n FROM tokens WHERE token NOT IN {STOP} AND length(token) >= 3 GROUP BY 1, 2)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token)::INT AS rank FROM n) WHERE rank <= 5""")
def document_keywords(spark, d):
    return X.document_keywords(tokens(spark, d), 5)


#: What a user teaches for these texts.
KNOWN = M.Knowledge().taught(common_verb=("is", "was", "are", "be", "est", "ist", "es", "sind"), negation=("not", "no", "ne", "nicht", "never"), cause=("because", "car", "weil", "by", "from", "par", "von"), purpose=("for", "to", "pour", "para"), condition=("if", "unless", "wenn", "si", "as"))
_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_verb = lambda x: f"(list_contains({_list(KNOWN.common_verb)}, {x}) OR " + " OR ".join(f"(starts_with({x}, '{p}') AND strlen({x}) > {len(p) + 1})" for p in KNOWN.verb_prefix) + ")"
_in = lambda x, *kinds: f"list_contains({_list([w for k in kinds for w in getattr(KNOWN, k)])}, {x})"
_at = lambda fits, words="l": f"coalesce(list_position(list_transform({words}, lambda x: {fits}), true), 0)"
_tail = lambda i: f"CASE WHEN {i} > 0 AND {i} < len(l) THEN array_to_string(l[{i} + 1:], ' ') END"
FRAMES = f"""WITH raw AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS sent, regexp_extract_all(unnest(s), '[^ \t\r\n]+') AS t FROM (SELECT doc_id, regexp_split_to_array(text, '[.?!]') AS s FROM documents)),
    r AS (SELECT *, list_transform(t, lambda x: lower(x)) AS l FROM raw WHERE len(t) >= 3 AND len(list_distinct(t)) > 1),
    v AS (SELECT *, len(list_filter(l, lambda x: starts_with(x, 'di') AND strlen(x) > 3 AND NOT (starts_with(x, 'dia') AND strlen(x) <= 4) AND (substr(x, 3, 1) NOT IN ('a', 'e', 'i', 'o', 'u') OR strlen(x) >= 6))) > 0 AS passive, len(list_filter(l, lambda x: {_in("x", "negation")})) > 0 AS negative FROM r WHERE len(list_filter(l, lambda x: {_verb("x")})) > 0),
    a AS (SELECT *, CASE WHEN passive THEN {_at("starts_with(x, 'di') AND strlen(x) > 2")} WHEN {_at("starts_with(x, 'me') AND strlen(x) > 2")} > 0 THEN {_at("starts_with(x, 'me') AND strlen(x) > 2")} ELSE {_at(_verb("x"))} END AS k FROM v),
    i AS (SELECT *, list_position(t, t[k]) AS pp, coalesce(list_position(l, 'oleh'), 0) AS by_, {_at(_in("x", "cause"), "l[1:len(l) - 1]")} AS c, {_at(_in("x", "purpose"), "l[1:len(l) - 1]")} AS p, {_at(_in("x", "condition"))} AS q FROM a WHERE k > 0),
    f AS (SELECT doc_id, sent, l[pp] AS predicate, CASE WHEN passive THEN 'passive' ELSE 'active' END AS voice, negative,
      CASE WHEN passive THEN CASE WHEN by_ > 0 THEN l[by_ + 1] END WHEN pp > 1 AND NOT {_in("l[pp - 1]", "negation", "cause", "purpose", "condition")} THEN l[pp - 1] END AS agent,
      CASE WHEN passive THEN list_filter(l[1:pp - 1], lambda x: NOT {_in("x", "negation")} AND NOT {_verb("x")})[-1] WHEN pp < len(l) AND NOT {_in("l[pp + 1]", "negation", "cause", "purpose", "condition")} THEN l[pp + 1] END AS patient,
      {_tail("c")} AS cause, {_tail("p")} AS purpose, CASE WHEN q > 1 THEN array_to_string(l[1:q - 1], ' ') END AS antecedent, {_tail("q")} AS consequent FROM i),
    frames AS (SELECT *, round(greatest(0.0, least(1.0, 0.30::DOUBLE + 0.15::DOUBLE * ((agent IS NOT NULL)::INT + (patient IS NOT NULL)::INT) + 0.10::DOUBLE * ((cause IS NOT NULL)::INT + (purpose IS NOT NULL)::INT + (antecedent IS NOT NULL)::INT + (consequent IS NOT NULL)::INT) - CASE WHEN negative THEN 0.05::DOUBLE ELSE 0 END)), 6)::DOUBLE AS confidence FROM f)"""


def _sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "[.?!]")).alias("sent", "sentence"))


def _frames(spark, d, sentences=None):
    text = _sentences(spark, d) if sentences is None else sentences
    return M.frames(text, ["doc_id", "sent"], F.regexp_extract_all("sentence", F.lit(r"[^ \t\r\n]+"), 0), KNOWN)


@query(f"{FRAMES} SELECT * FROM frames")
def sentence_frames(spark, d):
    return _frames(spark, d)


@query(f"""{FRAMES} SELECT quality, count(*) AS n, round(avg(confidence), 6) AS confidence FROM (SELECT *, CASE WHEN confidence >= 0.7 AND agent IS NOT NULL AND patient IS NOT NULL THEN 'High' WHEN confidence >= 0.45 AND (agent IS NOT NULL OR patient IS NOT NULL) THEN 'Moderate' WHEN confidence >= 0.3 THEN 'Low' ELSE 'Failed' END AS quality FROM frames) GROUP BY quality""")
def frame_quality(spark, d):
    f = _frames(spark, d)
    quality = S.frame_quality(F.col("agent").isNotNull(), F.col("patient").isNotNull(), F.col("confidence"))
    return f.groupBy(quality.alias("quality")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query(f"""{FRAMES}, e AS (SELECT *, row_number() OVER () AS id, coalesce(len(list_filter({_list([x.replace("'", "''") for x in M.DENIALS])}, lambda d: contains(lower(cause), d))) > 0, false) AS denied FROM frames WHERE agent IS NOT NULL),
    p AS (SELECT x.predicate, CASE WHEN x.agent = y.agent AND (x.denied <> y.denied OR coalesce(x.cause <> y.cause, false)) THEN 'Polarity' WHEN x.agent = y.patient AND x.patient = y.agent THEN 'RoleReversal' WHEN x.agent = y.agent AND x.purpose <> y.purpose THEN 'Purpose' END AS kind
      FROM e x JOIN e y ON x.predicate = y.predicate AND x.id < y.id AND (x.agent = y.agent OR x.agent = y.patient)) SELECT predicate, kind, count(*)::BIGINT AS pairs FROM p WHERE kind IS NOT NULL GROUP BY 1, 2""")
def contradictions(spark, d):
    return M.contradiction_counts(_frames(spark, d))


@query("""WITH q AS (SELECT item_id AS q, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark), h AS (SELECT doc_id, (n_chars % 1000) / 1000.0::DOUBLE AS c, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS t FROM documents),
    s AS (SELECT q, doc_id, any_value(c) AS c, count(*) / any_value(len(w))::DOUBLE * any_value(c) AS score FROM (SELECT q, w, unnest(w) AS t FROM q) JOIN h USING (t) GROUP BY q, doc_id)
    SELECT q, rank::INT AS rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c DESC, doc_id) AS rank FROM s) WHERE rank <= 3""")
def keyword_retrieve(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("q"), words("text").alias("words"))
    return P.keyword_retrieve(table(spark, d, "documents"), "doc_id", words("text"), share("n_chars"), asked, 3)


@query(f"""{TOK}, n AS (SELECT doc_id, token, count(*) AS n FROM tokens WHERE token NOT IN {STOP} AND length(token) >= 3 GROUP BY 1, 2), k AS (SELECT doc_id, token FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) AS r FROM n) WHERE r <= 5),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM k x JOIN k y USING (token) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2)
    SELECT a, b, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rank FROM p) WHERE rank <= 3""")
def autoassociate(spark, d):
    k = X.document_keywords(tokens(spark, d), 5).groupBy("doc_id").agg(F.collect_list("token").alias("keywords"))
    return P.autoassociate(k, "doc_id", "keywords", 3)


def _messages(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0)).alias("atoms"))


MSG = with_sql("messages")


@query(f"""{MSG}, l AS (SELECT *, lag(atoms) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM messages WHERE len(atoms) > 0), o AS (SELECT conv_id, turn, round(len(list_intersect(atoms, b))::DOUBLE / len(list_distinct(list_concat(atoms, b))), 3) AS overlap FROM l WHERE b IS NOT NULL)
    SELECT conv_id, turn, overlap, round(1 - overlap, 3) AS magnitude, overlap < 0.5 AS shift FROM o""")
def topic_shift(spark, d):
    return C.topic_shifts(_messages(spark, d))


@query(f"""{MSG}, p AS (SELECT x.conv_id, x.turn AS a, y.turn AS b, len(list_intersect(x.atoms, y.atoms)) AS n, len(x.atoms) AS sa, len(y.atoms) AS sb, x.role = y.role AS same FROM messages x JOIN messages y ON x.conv_id = y.conv_id AND y.turn < x.turn AND len(x.atoms) > 0 AND len(y.atoms) > 0)
    SELECT conv_id, a, b, 'semantic_link' AS link, round(n::DOUBLE / (sa + sb - n), 6) AS weight FROM p WHERE n::DOUBLE / (sa + sb - n) > 0.3 UNION ALL SELECT conv_id, a, b, 'elaboration', round(sa::DOUBLE / sb, 6) FROM p WHERE n = sa AND sa < sb AND same""")
def semantic_links(spark, d):
    return C.semantic_links(_messages(spark, d))


MESSAGES = """t AS (SELECT conv_id || ':' || turn AS id, role, text, (conv_id % 10) / 10.0::DOUBLE AS c, list_distinct(regexp_extract_all(lower(text), '[^ ]+')) AS w FROM conversations)"""
_ids = lambda rows: rows.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "role", ((F.col("conv_id") % 10) / 10.0).alias("c"), "text")
_said = lambda: F.regexp_extract_all(F.lower("text"), F.lit("[^ ]+"), 0)


@query(f"""WITH {MESSAGES} SELECT id FROM t x WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM t y WHERE y.role <> 'user' AND len(list_intersect(x.w, y.w))::DOUBLE / len(list_distinct(list_concat(x.w, y.w))) > 0.8)""")
def novel_statements(spark, d):
    rows = _ids(table(spark, d, "conversations"))
    return P.unlike(rows.where("role = 'user'"), rows.where("role <> 'user'"), "id", _said(), 0.8).select("id")


@query(f"""WITH RECURSIVE {MESSAGES}, o AS MATERIALIZED (SELECT t.*, row_number() OVER (ORDER BY c DESC, id) AS k FROM (SELECT t.*, row_number() OVER (PARTITION BY regexp_replace(lower(left(text, 80)), '^\\s+|\\s+$', '', 'g') ORDER BY c DESC, id) AS same FROM t) t WHERE same = 1),
    near AS MATERIALIZED (SELECT y.k, coalesce(list(x.k) FILTER (WHERE x.k IS NOT NULL), []) AS before FROM o y LEFT JOIN o x ON x.k < y.k AND len(x.w) > 0 AND len(list_intersect(x.w, y.w))::DOUBLE / len(list_distinct(list_concat(x.w, y.w))) > 0.8 GROUP BY y.k),
    g AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS stay UNION ALL SELECT near.k, CASE WHEN list_has_any(stay, before) THEN stay ELSE list_append(stay, near.k) END FROM g JOIN near ON near.k = g.k + 1)
    SELECT id FROM o WHERE list_contains((SELECT stay FROM g ORDER BY k DESC LIMIT 1), k)""")
def deduplicated_statements(spark, d):
    signature = F.regexp_replace(F.lower(F.substring("text", 1, 80)), r"^\s+|\s+$", "")
    return P.deduplicated(_ids(table(spark, d, "conversations")), "id", _said(), "c", 0.8, signature).select("id")


@query(f"""{FRAMES} SELECT doc_id, sent, 'problem_solution' AS rule, cause AS given, patient AS then_, agent, round(0.85::DOUBLE * confidence + 1e-9, 6) AS confidence FROM frames WHERE cause IS NOT NULL AND agent IS NOT NULL AND patient IS NOT NULL
    UNION ALL SELECT doc_id, sent, 'condition_consequence', antecedent, consequent, agent, round(0.90::DOUBLE * confidence + 1e-9, 6) FROM frames WHERE antecedent IS NOT NULL AND consequent IS NOT NULL""")
def derived_meanings(spark, d):
    said = _sentences(spark, d)
    return M.derived(_frames(spark, d, said.where(M.marked(F.col("sentence"), KNOWN))), ["doc_id", "sent"])


@query(f"""{MSG}, n AS (SELECT conv_id, topic, count(*) AS n FROM (SELECT conv_id, unnest(atoms) AS topic FROM messages) GROUP BY 1, 2) SELECT conv_id, topic, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, topic) AS rank FROM n) WHERE rank <= 10""")
def recent_topics(spark, d):
    return C.topics(_messages(spark, d))


@query("""WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT conv_id, greatest(0, least(n, 300 - (sum(n) OVER (ORDER BY conv_id DESC) - n)))::BIGINT AS kept FROM n""")
def pruned_messages(spark, d):
    return C.newest_messages(table(spark, d, "conversations"), 300)


@query("""WITH g AS (SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 > 86400, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)
    SELECT user_id, session, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM s GROUP BY 1, 2""")
def event_sessions(spark, d):
    return C.sessions(table(spark, d, "events"), "user_id", "ts", 86400)


@query("SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS access_count FROM events GROUP BY 1, 2")
def observations(spark, d):
    return T.observations(table(spark, d, "events"), ["user_id", "event_type"], "ts")


SESSIONS = """g AS (SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 > 86400, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g),
    spans AS (SELECT user_id, event_type || ':' || user_id || ':' || session AS label, min(epoch_us(ts) / 1e6) AS first, max(epoch_us(ts) / 1e6) AS last FROM s GROUP BY event_type, user_id, session)"""


def _spans(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts")
    s = table(spark, d, "events").withColumn("s", T.seconds("ts")).withColumn("new", F.coalesce(F.col("s") - F.lag("s").over(w) > 86400, F.lit(True)).cast("int")).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("event_type", "user_id", "session").agg(F.min("s").alias("first"), F.max("s").alias("last")).select("user_id", F.concat_ws(":", "event_type", F.col("user_id").cast("string"), F.col("session").cast("string")).alias("label"), "first", "last")


@query(f"WITH {SESSIONS} SELECT x.label AS a, y.label AS b FROM spans x JOIN spans y ON x.user_id % 100 = 0 AND x.label <> y.label AND x.first - 60 <= y.last + 60 AND y.first - 60 <= x.last + 60")
def temporal_overlap(spark, d):
    spans = kept(_spans(spark, d), "spans")
    return T.overlaps(spans.where("user_id % 100 = 0"), spans, "label", 60)


@query(f"WITH {SESSIONS}, p AS (SELECT x.label, count(*) AS n FROM spans x JOIN spans y ON x.label <> y.label AND x.first - 60 <= y.last + 60 AND y.first - 60 <= x.last + 60 GROUP BY 1) SELECT label, coalesce(n, 0) AS n FROM spans LEFT JOIN p USING (label)")
def temporal_overlap_counts(spark, d):
    return T.overlap_counts(_spans(spark, d), "label", 60)


@query("""WITH o AS (SELECT 'u' || user_id || event_type AS label, min(epoch_us(ts)) / 1e6 AS first, max(epoch_us(ts)) / 1e6 AS last, count(*) AS n FROM events GROUP BY 1), e AS (SELECT max(epoch_us(ts)) / 1e6 AS now FROM events)
    SELECT label, round(n / greatest(1.0, (now - first) / 3600) * CASE WHEN now - last <= 86400 THEN 2.0 ELSE 0.5 END, 6)::DOUBLE AS rate FROM o, e ORDER BY rate DESC, label LIMIT 50""")
def rising_labels(spark, d):
    rows = table(spark, d, "events")
    spans = rows.groupBy(F.concat(F.lit("u"), F.col("user_id"), F.col("event_type")).alias("label")).agg(F.min(T.seconds("ts")).alias("first"), F.max(T.seconds("ts")).alias("last"), F.count("*").alias("access_count"))
    return T.rising(spans, 24, 50)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events), t AS (SELECT user_id, event_type AS state FROM r WHERE k = 1)
    SELECT user_id, any_value(state) AS state, round(CASE WHEN count(*) < 3 THEN 0.5 ELSE count(*) FILTER (WHERE event_type = state) / count(*)::DOUBLE END, 6) AS stability FROM r JOIN t USING (user_id) WHERE k <= 10 GROUP BY user_id""")
def state_stability(spark, d):
    return T.stability(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("SELECT user_id, ts, event_id, count(*) OVER w AS n, (sum(round(value * 100)::BIGINT) OVER w)::BIGINT AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 49 PRECEDING)")
def event_window(spark, d):
    return T.running(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value")


VEC = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"


@query(f"""WITH {VEC}, n AS (SELECT *, sqrt(list_inner_product(e, e)) AS n FROM v), s AS (SELECT q.vec_id AS q, v.vec_id, round(list_inner_product(q.e, v.e) / (q.n * v.n), 6) AS cosine FROM n q JOIN n v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
    SELECT q, vec_id, cosine, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def cosine_topk(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return V.nearest(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding", 5)


@query(f"""WITH {VEC}, h AS (SELECT vec_id AS h, r, list_transform(e, lambda x: x + s) AS aim FROM v, (VALUES ('up', 0.1::DOUBLE), ('down', -0.1::DOUBLE)) AS m(r, s) WHERE vec_id % 100 = 0), s AS (SELECT h, r, vec_id, round(-list_distance(aim, e), 6) AS score FROM h JOIN v ON h <> vec_id)
    SELECT h, r, vec_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY h, r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def predict_tail(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return V.tails(v.where("vec_id % 100 = 0"), [("up", 0.1), ("down", -0.1)], v, "vec_id", "e", 5)


@query(f"WITH {VEC} SELECT label, k::INT AS k, round(avg(x), 6) AS mean FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS k FROM v) GROUP BY 1, 2")
def label_centroids(spark, d):
    return V.centroids(table(spark, d, "embeddings"), "label", "embedding")


@query(f"""WITH {VEC}, c AS (SELECT vec_id, list_transform(e[1:32], lambda x: x) AS e FROM v), n AS (SELECT *, sqrt(list_inner_product(e, e)) AS n FROM c) SELECT vec_id, round(e[1] / n, 6) AS head, round(list_sum(list_transform(e, lambda x: x / n)), 6) AS total FROM n""")
def projected_embeddings(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", S.fitted(F.col("embedding"), 32).alias("e"))
    return v.select("vec_id", F.round(F.col("e")[0], 6).alias("head"), F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("""WITH RECURSIVE x AS MATERIALIZED (SELECT (doc_id * 37 % 100) / 100.0::DOUBLE AS p, count(*) AS n, sum(quality) AS good FROM labels JOIN documents USING (doc_id) GROUP BY 1), g AS (SELECT 0 AS k, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b
    UNION ALL SELECT k + 1, a - 0.01::DOUBLE * da, b - 0.01::DOUBLE * db FROM (SELECT k, a, b, sum(e * p) / sum(n) AS da, sum(e) / sum(n) AS db FROM (SELECT k, a, b, p, n, n / (1 + exp(-(a * p + b))) - good AS e FROM g, x WHERE k < 1000) GROUP BY k, a, b))
    SELECT p, n, good::BIGINT AS good, round(1 / (1 + exp(-(a * p + b))), 6) AS calibrated FROM x, g WHERE k = 1000""")
def calibrated_confidence(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    seen = table(spark, d, "labels").join(docs, "doc_id").select((F.pmod(F.col("doc_id") * 37, F.lit(100)) / 100.0).alias("p"), F.col("quality").alias("good"))
    return A.platt(seen, "p", "good")
