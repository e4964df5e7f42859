"""Graphs, event logs and text folders as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("nodes", "compositions", "members", "edges")


def save_graph(tables: dict[str, DataFrame], path: str) -> None:
    """Each table under its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def snapshot_rows(members: DataFrame) -> DataFrame:
    """comp_id and its members as one line of JSON, in the order of their positions."""
    return members.groupBy("comp_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("pos", "node_id", "role", "confidence")))).alias("json"))


def members_of_snapshot(rows: DataFrame) -> DataFrame:
    """The members of snapshot lines."""
    schema = "array<struct<pos:int,node_id:string,role:string,confidence:double>>"
    return rows.select("comp_id", F.inline(F.from_json("json", schema)))


def migrated(legacy: DataFrame) -> DataFrame:
    """Members of older rows (id, label, senses) in today's columns; newer ones pass through. Columns that an old row lacks are null."""
    if "comp_id" in legacy.columns:
        return legacy
    senses = legacy.select(F.concat(F.lit("comp_"), F.col("id").cast("string")).alias("comp_id"), F.posexplode_outer("senses").alias("pos", "sense"), F.col("label").alias("node_id"))
    return senses.select("comp_id", F.coalesce("pos", F.lit(0)).alias("pos"), "node_id", F.coalesce("sense", F.lit("Agent")).alias("role"), F.lit(0.5).alias("confidence"))


def write_events(events: DataFrame, path: str) -> None:
    """One JSON object a line."""
    events.write.mode("overwrite").json(path)


def read_events(spark: SparkSession, path: str, schema: str, after: int | None = None, seq: str = "seq") -> DataFrame:
    rows = spark.read.schema(schema).json(path)
    return rows if after is None else rows.where(F.col(seq) > after)


def newest_bundle(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The rows of the newest file of a folder, by modification time and then by name."""
    rows = spark.read.option("pathGlobFilter", pattern).text(path).select("value", "_metadata.file_path", "_metadata.file_modification_time")
    newest = rows.groupBy().agg(F.max(F.struct("file_modification_time", "file_path")).alias("m")).select("m.*")
    return rows.join(F.broadcast(newest), ["file_modification_time", "file_path"]).select("value")  # one row is broadcast


def text_files(spark: SparkSession, path: str, extensions: tuple[str, ...]) -> DataFrame:
    """path and text of files with one of the extensions, in all folders below."""
    pattern = "*.{" + ",".join(extensions) + "}"
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path).select("_metadata.file_path", F.col("value").alias("text"))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows, and old ones whose key isn't among them."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def missing_from_cache(rows: DataFrame, cache: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without an entry under the hash of some columns, with that hash."""
    keyed = rows.withColumn("cache_key", F.sha2(F.concat_ws("\x1f", *columns), 256))
    return keyed.join(cache.select("cache_key"), "cache_key", "left_anti")


def statements(text: DataFrame, column: str) -> DataFrame:
    """subject, relation, object of every "X is Y" and "X can Y" in a text."""
    found = F.expr(rf"transform(regexp_extract_all({column}, '([A-Za-z]+) (is|can) ([A-Za-z]+)', 0), s -> split(s, ' '))")
    rows = text.withColumn("_s", F.explode(found))
    return rows.withColumns({"subject": F.lower(F.col("_s")[0]), "relation": F.lower(F.col("_s")[1]), "object": F.lower(F.col("_s")[2])}).drop("_s")
