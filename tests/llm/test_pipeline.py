import random

import corpus_pipeline
from evidentia.llm import packing

from .cases import SCHEMA, odd_rows


def rows():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    texts = [" ".join(" ".join(word() for _ in range(9)).capitalize() + "." for _ in range(9)) for _ in range(6)]
    texts.append(texts[0] + " One more.")
    return [(100 + i, t, "en", "s", len(t), "k", "v", "w", 1, 2) for i, t in enumerate(texts)]


def stages(spark, docs, folder):
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, None).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept.append(docs)
    return kept


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(rows() + odd_rows(), SCHEMA)
    out = stages(spark, docs, tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "suffix_dedup", "secret_scans", "packing"]
    assert all(o.columns == docs.columns for o in out[:-1])
    assert {r.doc_id for r in out[0].collect()} >= {100, 101, 102, 103, 104, 105, 106, 12, 13}
    ids = [r.doc_id for r in out[1].collect()]
    assert {100, 101, 102, 103, 104, 105, 12} <= set(ids) and 106 not in ids and 13 not in ids
    assert out[2].count() == out[3].count() == len(ids)
    pieces = out[4].collect()
    assert {r.doc_id for r in pieces} == set(ids) and all(r.length <= 2048 for r in pieces)


def test_empty_documents(spark, tmp_path):
    out = stages(spark, spark.createDataFrame([], SCHEMA), tmp_path)
    assert all(o.count() == 0 for o in out)


def test_run_equals_the_stages_by_hand(spark, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA)
    (tmp_path / "sf").mkdir()
    docs.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    got = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path / "sf")).collect()}
    last = stages(spark, docs, tmp_path)[3]
    want = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in packing.digest(packing.pack(last)).collect()}
    assert got == want and got
