"""Rules that have no SQL."""

from pyspark.sql import functions as F

from weftgraph.operators import rules as U


def test_code_elements(spark):
    files = spark.createDataFrame([("a.py", "import os\nclass A:\n    def f(self):\n        from x import y\n"), ("b.py", "def ("), ("c.py", None)], "path string, text string")
    got = {(r.path, r.kind, r.name, r.parent, r.line) for r in U.code_elements(files).collect()}
    assert got == {("a.py", "import", "os", "", 1), ("a.py", "class", "A", "", 2), ("a.py", "function", "f", "A", 3), ("a.py", "import", "y", "f", 4)}


def test_changes_and_arithmetic(spark):
    row = spark.range(1).select(
        U.may_change(U.LIFECYCLE_CHANGES, F.lit("New"), F.lit("Stable")).alias("a"), U.may_change(U.LIFECYCLE_CHANGES, F.lit("Candidate"), F.lit("Stable")).alias("b"), U.may_change(U.LIFECYCLE_CHANGES, F.lit("Deprecated"), F.lit("New")).alias("c"),
        U.compute(F.lit("DIVIDE"), F.lit(1.0), F.lit(0.0)).alias("d"), U.compute(F.lit("PERIMETER"), F.lit(2.0), F.lit(3.0)).alias("e"), U.errors({"x": F.lit(True), "y": F.lit(False)}).alias("f"),
    ).first()
    assert tuple(row) == (False, True, False, None, 10.0, "x")


def test_hashed_vectors_are_of_unit_length(spark):
    tokens = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "c")], "doc_id int, token string")
    got = U.hashed(tokens, "doc_id", 16).groupBy("doc_id").agg(F.sum(F.col("x") * F.col("x")).alias("l")).collect()
    assert all(abs(r.l - 1) < 1e-9 for r in got) and len(got) == 2


def test_npmi_reads_the_sentences_once(spark):
    import math

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    said = [["a", "b", "c"], ["a", "b"], ["a"], [], ["b", "a"]]
    sentences = spark.createDataFrame([(s,) for s in said], "words array<string>").coalesce(1).mapInArrow(counted, "words array<string>")
    got = {(r.x, r.y): (r.n, r.npmi) for r in U.npmi(sentences, "words", 1).collect()}
    score = lambda n, x, y: round(math.log(n * 4 / (x * y)) / -math.log(n / 4), 6)
    assert got == {("a", "b"): (2, score(2, 4, 3)), ("b", "c"): (1, score(1, 3, 1)), ("b", "a"): (1, score(1, 3, 4))} and read.value == 5
