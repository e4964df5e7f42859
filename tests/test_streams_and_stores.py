"""Streams over folders of files, and tables written and read back."""

import datetime

from pyspark.sql import functions as F

from weftgraph.sources import store
from weftgraph.streaming import beliefs as B

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def stream(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).parquet(str(folder))


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


def test_beliefs_follow_observations_in_order(spark, tmp_path):
    rows = [("a", 1.0, T0), ("a", 0.0, T0 + datetime.timedelta(seconds=1)), ("b", 0.6, T0)]
    got = {r.key: r for r in drain(B.beliefs(stream(spark, tmp_path / "in", rows, "k string, v double, ts timestamp"), "k", "v", "ts"), "beliefs", "update")}
    assert abs(got["a"].belief - (0.5 + 0.05) * 0.9) < 1e-9 and got["a"].seen == 2 and got["a"].anomaly
    assert abs(got["b"].belief - 0.51) < 1e-9 and not got["b"].anomaly


def test_beliefs_follow_the_order_of_time_over_all_arrow_batches(spark, tmp_path):
    rows = [("a", i % 7 / 7, T0 + datetime.timedelta(seconds=i)) for i in range(40)]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        got = drain(B.beliefs(stream(spark, tmp_path / "in", rows[::-1], "k string, v double, ts timestamp"), "k", "v", "ts"), "ordered", "update")
    finally:
        spark.conf.set(name, before)
    want = 0.5
    for _, x, _ in rows:
        want += 0.1 * (x - want)
    assert [(r.seen, round(r.belief, 9)) for r in got] == [(40, round(want, 9))]


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    at = lambda s: T0 + datetime.timedelta(seconds=s)
    rows = [("a", at(0)), ("a", at(200)), ("a", at(900)), ("z", at(90_000))]
    df = B.sessions(stream(spark, tmp_path / "in", rows, "k string, ts timestamp"), "k", "ts")
    assert sorted((r.k, r.n) for r in drain(df, "sessions", "append")) == [("a", 1), ("a", 2)]


def test_windowed_counts(spark, tmp_path):
    rows = [("a", T0), ("a", T0 + datetime.timedelta(minutes=59)), ("a", T0 + datetime.timedelta(hours=30))]
    df = B.windowed(stream(spark, tmp_path / "in", rows, "k string, ts timestamp"), "k", "ts")
    assert [(r.k, r.n) for r in drain(df, "windowed", "append")] == [("a", 2)]


def test_graph_and_snapshot_round_trip(spark, tmp_path):
    members = spark.createDataFrame([("c1", 0, "a", "Agent", 0.5), ("c1", 1, "b", "Patient", 0.25)], "comp_id string, pos int, node_id string, role string, confidence double")
    store.save_graph({"members": members}, str(tmp_path / "g"))
    back = store.load_graph(spark, str(tmp_path / "g"), ("members",))["members"]
    assert sorted(back.collect()) == sorted(members.collect())
    again = store.members_of_snapshot(store.snapshot_rows(members)).select(*members.columns)
    assert sorted(again.collect()) == sorted(members.collect())


def test_migration(spark):
    old = spark.createDataFrame([(1, "x", ["Agent", "Patient"]), (2, "y", None)], "id int, label string, senses array<string>")
    got = sorted((r.comp_id, r.pos, r.node_id, r.role) for r in store.migrated(old).collect())
    assert got == [("comp_1", 0, "x", "Agent"), ("comp_1", 1, "x", "Patient"), ("comp_2", 0, "y", "Agent")]


def test_event_log(spark, tmp_path):
    events = spark.createDataFrame([(1, "a"), (2, "b")], "seq long, kind string")
    store.write_events(events, str(tmp_path / "log"))
    assert [r.kind for r in store.read_events(spark, str(tmp_path / "log"), "seq long, kind string", after=1).collect()] == ["b"]


def test_upsert_cache_and_statements(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, x string")
    assert sorted((r.id, r.x) for r in store.upserted(old, new, "id").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    cache = store.missing_from_cache(old, spark.createDataFrame([], "cache_key string"), ["x"]).where("id = 1").select("cache_key")
    assert [r.id for r in store.missing_from_cache(old, cache, ["x"]).collect()] == [2]
    said = store.statements(spark.createDataFrame([("Sky is blue. A bird can fly",)], "t string"), "t").select("subject", "relation", "object")
    assert sorted(map(tuple, said.collect())) == [("bird", "can", "fly"), ("sky", "is", "blue")]


def test_text_folder(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "b.md").write_text("no")
    rows = store.text_files(spark, str(tmp_path), ("py",)).collect()
    assert [r.text.strip() for r in rows] == ["x = 1"]
    assert store.newest_bundle(spark, str(tmp_path), "*.py").where(F.col("value") == "x = 1").count() == 1
