"""Queries over stored graphs, logs and streams, each with the SQL that checks it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import text as X
from weftgraph.sources import store as Z
from weftgraph.sources.scratch import shared_folder
from weftgraph.sources.tables import edges, members, share, table, with_sql
from weftgraph.streaming import beliefs as B

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _new(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"{with_sql('members', 'edges')} SELECT 'edge' AS kind, src AS a, dst AS b, relation AS role, round(confidence, 6) AS confidence FROM edges UNION ALL SELECT 'member', comp_id::VARCHAR, node_id, role, round(confidence, 6) FROM members")
def stored_graph(spark: SparkSession, d: str) -> DataFrame:
    """A graph's tables, saved and loaded."""
    path = _new(spark, "graph")
    Z.save_graph({"members": members(spark, d), "edges": edges(spark, d)}, path)
    back = Z.load_graph(spark, path, ("members", "edges"))
    conf = F.round("confidence", 6).alias("confidence")
    told = back["edges"].select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("relation").alias("role"), conf)
    return told.unionByName(back["members"].select(F.lit("member").alias("kind"), F.col("comp_id").cast("string").alias("a"), F.col("node_id").alias("b"), "role", conf))


@query("SELECT event_id AS seq, user_id, event_type, value FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events)")
def replayed_events(spark, d):
    """A log of all events as lines of JSON; those behind half of it are read again."""
    path, rows = _new(spark, "events"), table(spark, d, "events").select(F.col("event_id").alias("seq"), "user_id", "event_type", "value")
    Z.write_events(rows, path)
    return Z.read_events(spark, path, "seq long, user_id long, event_type string, value double", rows.agg(F.max("seq")).first()[0] // 2)


@query("WITH n AS (SELECT l_partkey AS p_partkey, max(l_extendedprice) AS price FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT p_partkey, price FROM n UNION ALL SELECT p_partkey, p_retailprice FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM n)")
def upserted_prices(spark, d):
    new = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_extendedprice").alias("price"))
    return Z.upserted(table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("price")), new, "p_partkey")


@query("""WITH k AS (SELECT doc_id, lang, sha256(concat_ws(chr(31), text, lang)) AS cache_key FROM documents) SELECT doc_id, cache_key FROM k WHERE cache_key NOT IN (SELECT cache_key FROM k WHERE lang = 'en')""")
def cache_misses(spark, d):
    """Texts that a cache of all English ones doesn't have, by the hash of text and language."""
    rows = table(spark, d, "documents").select("doc_id", "text", "lang")
    empty = spark.createDataFrame([], "cache_key string")
    cache = Z.missing_from_cache(rows.where("lang = 'en'"), empty, ["text", "lang"]).select("cache_key")
    return Z.missing_from_cache(rows, cache, ["text", "lang"]).select("doc_id", "cache_key")


@query("""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z]+) (is|can) ([A-Za-z]+)')) AS s FROM documents) SELECT doc_id, lower(split_part(s, ' ', 1)) AS subject, lower(split_part(s, ' ', 2)) AS relation, lower(split_part(s, ' ', 3)) AS object, count(*) AS n FROM s GROUP BY ALL""")
def plain_statements(spark, d):
    told = Z.statements(table(spark, d, "documents").select("doc_id", "text"), "text")
    return told.groupBy("doc_id", "subject", "relation", "object").agg(F.count("*").alias("n"))


@query(r"""WITH m AS (SELECT doc_id, regexp_extract(text, '([0-9]+(?:\.[0-9]+)?)\s*(%|k\b|m\b)?', 1) AS v, regexp_extract(text, '([0-9]+(?:\.[0-9]+)?)\s*(%|k\b|m\b)?', 2) AS u FROM documents) SELECT doc_id, round(v::DOUBLE * CASE u WHEN '%' THEN 0.01::DOUBLE WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 ELSE 1 END, 6) AS number FROM m WHERE v <> ''""")
def first_numbers(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(X.number(F.col("text")), 6).alias("number")).where("number IS NOT NULL")


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The table of events as a stream of its files; the pattern names it whether it is a file or a folder."""
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")


@query("""WITH o AS (SELECT event_type AS key, (floor(value)::BIGINT % 1000) / 1000.0::DOUBLE AS x, ts FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, x DESC) - 1 AS age FROM o) SELECT key, round(sum(0.1::DOUBLE * pow(0.9::DOUBLE, age) * x) + 0.5 * pow(0.9::DOUBLE, count(*)), 6) AS belief, count(*) AS seen FROM r GROUP BY key""")
def streamed_beliefs(spark, d):
    """Beliefs about event types after a stream of all events, read as far as it goes; state is two numbers a type."""
    rows, path = _event_stream(spark, d), _new(spark, "beliefs")
    rows = rows.select("event_type", "ts", share("value").alias("x"))
    told = B.beliefs(rows, "event_type", "x", "ts", ttl_seconds=10**9, delay="3650 days")
    stream = told.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{path}/state").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/rows/batch={n}"))
    stream.start().awaitTermination()
    last = spark.read.parquet(f"{path}/rows").groupBy("key").agg(F.max_by(F.struct("belief", "seen"), "seen").alias("r"))
    return last.select("key", F.round("r.belief", 6).alias("belief"), "r.seen")


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def streamed_windows(spark, d):
    """Hourly counts of a stream of events that its watermark has closed."""
    path = _new(spark, "windows")
    told = B.windowed(_event_stream(spark, d), "event_type", "ts")
    told.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{path}/state").format("parquet").start(f"{path}/rows").awaitTermination()
    return spark.read.schema(told.schema).parquet(f"{path}/rows")
