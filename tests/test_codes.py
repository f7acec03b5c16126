"""The index of random-projection codes against exact search."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidentia.operators import codes, vectors

SCHEMA = "chunk_id long, embedding array<double>, label string"


def table(spark, matrix, labels=("a",)):
    rows = {"chunk_id": np.arange(len(matrix)), "embedding": pa.array(list(matrix)), "label": pa.array([labels[i % len(labels)] for i in range(len(matrix))], pa.string())}
    return spark.createDataFrame(pa.table(rows))


def drawn(kind, n, dimensions, seed=3):
    rng = np.random.default_rng(seed)
    if kind == "even":
        return rng.normal(size=(n, dimensions))
    return rng.normal(size=(200, dimensions))[rng.integers(0, 200, n)] + 0.3 * rng.normal(size=(n, dimensions))


def asked(rows, every):
    return rows.filter(F.col("chunk_id") % every == 0).withColumnRenamed("chunk_id", "query_id")


def pairs(hits):
    return {(r.query_id, r.chunk_id) for r in hits.collect()}


@pytest.mark.parametrize("kind", ["even", "clusters"])
def test_recall_at_a_hundred_thousand(spark, tmp_path, kind):
    matrix = drawn(kind, 100_000, 48)
    table(spark, matrix).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    index = codes.build(rows, f"{tmp_path}/index", 48)
    questions = asked(rows, 1000)
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    want = {(q, int(c)) for q in range(0, len(matrix), 1000) for c in np.argsort(-(unit @ unit[q]), kind="stable")[:10]}
    assert len(pairs(codes.search(index, questions, 10)) & want) >= 0.9 * len(want)
    scored = codes.candidates(index, questions, 10).count()
    assert scored < 0.1 * 100 * len(matrix)  # vectors read and scored for a question
    plan = codes._histogram(index, codes._asked(index, questions))._jdf.queryExecution().toString()
    assert "struct<code:binary>" in plan  # the first scan reads codes alone


def test_scores_ties_and_filters_are_exact_where_all_are_candidates(spark, tmp_path):
    matrix = np.concatenate((drawn("even", 60, 16), drawn("even", 60, 16)[:20]))  # repeated rows
    rows = table(spark, matrix, ("a", "b", None))
    odd = [(900, None, "a"), (901, [0.0] * 16, "a"), (902, [float("nan")] * 16, "a"), (903, [1.0], "a"), (904, [None] * 16, "a"), (905, [1e200] * 16, None), (906, [1e-200] * 16, "b")]
    rows = rows.union(spark.createDataFrame(odd, SCHEMA)).withColumn("code", F.lit("x")).withColumn("cell", F.lit("y"))
    index = codes.build(rows, f"{tmp_path}/index", 16, by=("label",), recall=1.0)
    usual = rows.filter("chunk_id < 900")
    got = {(r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in codes.search(index, asked(usual, 1), 3).collect() if r.chunk_id < 900}
    filled = usual.withColumn("label", F.coalesce("label", F.lit("none")))
    want = {(r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in vectors.cosine_search(filled, asked(filled, 1), 3, by=["label"]).collect()}
    assert len({g for g in got if g[1] == 1} & want) == 80 and len(got & want) >= 0.9 * len(want)
    assert codes.opened(spark, f"{tmp_path}/index") == index
    assert codes.search(index, asked(rows.filter("chunk_id BETWEEN 900 AND 904"), 1), 3).count() == 0
    with pytest.raises(ValueError, match="at most 10"):
        codes.search(index, asked(rows, 1), 11)


def test_empty_index_and_no_question(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    rows = table(spark, drawn("even", 30, 8))
    assert codes.search(codes.build(none, f"{tmp_path}/none", 8), asked(rows, 1), 3).count() == 0
    assert codes.search(codes.build(rows, f"{tmp_path}/some", 8), asked(none, 1), 3).count() == 0


def test_distance_in_spark_equals_that_of_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 256, (50, 32), dtype=np.uint8) for _ in range(2))
    rows = spark.createDataFrame([(i, x.tobytes(), y.tobytes()) for i, (x, y) in enumerate(zip(a, b, strict=True))], "id long, code binary, own binary")
    got = {r.id: r.distance for r in codes._distance(rows, 256).collect()}
    assert got == {i: int(np.bitwise_count(a[i] ^ b[i]).sum()) for i in range(50)}


def test_candidates_arent_broadcast(spark, tmp_path):
    """They are many times the codes by whose size Spark judges them."""
    rows = table(spark, drawn("even", 500, 16))
    index = codes.build(rows, f"{tmp_path}/index", 16, cells=4)
    plan = codes.search(index, asked(rows, 20))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [cell" in plan and "BroadcastHashJoin [cell" not in plan
