"""Governed graphs in versions: a delta goes through ordered phases into a new version, which a manifest then names.

A version is a folder of its own; the manifest, one small file, is written beside and renamed, so a reader sees the old version or
the new one, whole. A delta has a name, and the version that it made is told in the manifest: applying it again does nothing, and
one that was lost on the way starts anew from the version that the manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.scores import decay_factor, decayed

#: Least confidence of a stable and of a grounded composition, and the confidence a contradiction leaves.
TO_STABLE, TO_GROUNDED, CONTRADICTED = 0.55, 0.7, 0.8

COLUMNS = ("comp_id", "comp_type", "lifecycle", "epistemic", "confidence", "batch_seen")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, root: str) -> dict:
    """The version that counts, and the deltas that are in it, in order."""
    _, path, fs = _fs(spark, f"{root}/manifest.json")
    if not fs.exists(path):
        return {"version": None, "deltas": []}
    return json.loads(spark.read.text(f"{root}/manifest.json", wholetext=True).first()[0])


def _swap(spark: SparkSession, root: str, new: dict) -> None:
    jvm, path, fs = _fs(spark, f"{root}/manifest.json")
    beside = jvm.org.apache.hadoop.fs.Path(f"{root}/manifest-{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    renames = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    renames[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    context.rename(beside, path, renames)  # replaces the old one in one step


def current(spark: SparkSession, root: str) -> DataFrame | None:
    version = manifest(spark, root)["version"]
    return spark.read.parquet(f"{root}/{version}") if version else None


def start(comps: DataFrame, root: str) -> None:
    """The first version; an existing graph stays."""
    spark = comps.sparkSession
    if manifest(spark, root)["version"] is None:
        name = f"v-{uuid.uuid4().hex}"
        comps.select(*COLUMNS).write.parquet(f"{root}/{name}")
        _swap(spark, root, {"version": name, "deltas": []})


def apply_delta(spark: SparkSession, root: str, name: str, batch: int, new: DataFrame, corrections: DataFrame, contradicted: DataFrame, members: DataFrame) -> bool:
    """Takes a delta into a new version; False if it is in already. Phases, in order:

    1. rows of ``new`` (COLUMNS) are merged in: of one id, that of the greater confidence stays, seen in this batch;
    2. corrections (comp_id, confidence) say what a confidence is, and make its composition observed;
    3. compositions in ``contradicted`` (comp_id) become so and keep 0.8 of their confidence;
    4. all that this delta doesn't touch decay by the batches since they were seen and their members, with what that does to states;
    5. candidates of 0.55 or more become stable, inferred stable ones of 0.7 or more grounded; contradicted ones aren't promoted.
    """
    told = manifest(spark, root)
    if name in told["deltas"]:
        return False
    old = spark.read.parquet(f"{root}/{told['version']}").withColumn("_new", F.lit(False))
    fresh = new.select(*COLUMNS).withColumns({"batch_seen": F.lit(batch).cast("long"), "_new": F.lit(True)})
    row = F.struct(*[c for c in COLUMNS if c != "comp_id"])
    merged = old.unionByName(fresh).groupBy("comp_id").agg(F.max_by(row, F.struct("confidence", "_new")).alias("r"), F.max("_new").alias("_touched")).select("comp_id", "r.*", "_touched")
    merged = merged.withColumn("batch_seen", F.when(F.col("_touched"), F.lit(batch).cast("long")).otherwise(F.col("batch_seen")))
    right = corrections.groupBy("comp_id").agg(F.max("confidence").alias("_right"))
    wrong = contradicted.select("comp_id").distinct().withColumn("_wrong", F.lit(True))
    size = members.groupBy("comp_id").agg(F.count("*").alias("_size"))
    rows = merged.join(right, "comp_id", "left").join(wrong, "comp_id", "left").join(size, "comp_id", "left")
    rows = rows.withColumns({"confidence": F.coalesce("_right", "confidence"), "epistemic": F.when(F.col("_right").isNotNull(), "Observed").otherwise(F.col("epistemic"))})
    rows = rows.withColumns({"confidence": F.when(F.col("_wrong"), F.col("confidence") * CONTRADICTED).otherwise(F.col("confidence")), "epistemic": F.when(F.col("_wrong"), "Contradicted").otherwise(F.col("epistemic"))})
    touched = F.col("_touched") | F.col("_right").isNotNull() | F.coalesce("_wrong", F.lit(False))
    state, confidence = decayed(F.col("lifecycle"), F.col("confidence"), decay_factor(F.lit(batch) - F.col("batch_seen"), F.coalesce("_size", F.lit(0))))
    rows = rows.withColumns({"lifecycle": F.when(touched, F.col("lifecycle")).otherwise(state), "confidence": F.when(touched, F.col("confidence")).otherwise(confidence)})
    sound = F.col("epistemic") != "Contradicted"
    rows = rows.withColumn("lifecycle", F.when(sound & (F.col("lifecycle") == "Candidate") & (F.col("confidence") >= TO_STABLE), "Stable").otherwise(F.col("lifecycle")))
    rows = rows.withColumn("epistemic", F.when((F.col("epistemic") == "Inferred") & (F.col("lifecycle") == "Stable") & (F.col("confidence") >= TO_GROUNDED), "Grounded").otherwise(F.col("epistemic")))
    version = f"v-{uuid.uuid4().hex}"
    rows.select(*COLUMNS).write.parquet(f"{root}/{version}")
    _swap(spark, root, {"version": version, "deltas": [*told["deltas"], name]})
    return True
