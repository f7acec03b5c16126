"""Exact medians, summaries as they are specified, strict line JSON, audit packs as JSON, page lists read back."""

import json
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from evidentia.operators import evaluate, median, pages, vectors
from evidentia.schemas import PAGE
from evidentia.sources import tables

CASE = "query_id string, status string, page_hit boolean, number_recall double, proxy boolean, seconds double"


def test_medians_equal_sorting(spark, monkeypatch):
    rng = random.Random(4)
    kinds = {
        "ties": [rng.choice((1.0, 2.0, 2.0, 5.5)) for _ in range(400)], "one": [7.25], "two": [1.0, 2.0], "spread": [rng.choice((-1, 1)) * 10.0 ** rng.uniform(-300, 300) for _ in range(301)],
        "edge": [-1.7e308, 1.7e308, 0.0, 5e-324], "same": [3.0] * 50, "close": [1.0 + i * 2**-52 for i in range(99)], "inf": [-math.inf, 1.0, 2.0, 3.0, math.inf], None: [4.0, 6.0, 9.0],
    }
    rows = [(k, v) for k, own in kinds.items() for v in own] + [("one", None), ("ties", math.nan), ("none", None), ("none", math.nan)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "kind string, v double")
    for bins in (1024, 4):
        monkeypatch.setattr(median, "BINS", bins)
        got = {r.kind: (r.n, r.median) for r in median.exact_median(frame, F.col("v"), ["kind"]).collect()}
        assert got == {k: (len(own), statistics.median(own)) for k, own in kinds.items()} | {"none": (0, None)}
    whole = [v for k, own in kinds.items() if k not in ("spread", "edge", "inf") for v in own]
    one = median.exact_median(frame.filter("kind is null or kind not in ('spread', 'edge', 'inf')"), F.col("v")).first()
    assert (one.n, one.median) == (len(whole), statistics.median(whole))
    assert median.exact_median(frame.limit(0), F.col("v")).first().asDict() == {"n": 0, "median": None}


def test_median_of_a_million_different_values(spark):
    frame = spark.range(1_000_001).select(((F.col("id") * 7919) % 1_000_003).cast("double").alias("v"))
    want = frame.select(F.median("v")).first()[0]
    assert median.exact_median(frame, F.sqrt("v")).first().median == math.sqrt(want)


def test_summary_counts_completed_cases_alone(spark):
    rows = [("a", "answered", True, 1.0, True, 1.0), ("b", "answered", True, 0.5, False, 4.0), ("c", "refused", False, None, False, 2.5), ("d", "error", True, 1.0, True, 99.0), ("e", "evidence_only", False, None, None, None)]
    cases = spark.createDataFrame(rows, CASE)
    assert evaluate.answer_summary(cases).first().asDict() == {
        "cases": 5, "completed": 4, "answered": 2, "refused": 1, "errors": 1, "page_hit_rate": 0.5, "full_recall_rate": 0.5, "mean_number_recall": 0.75, "proxy_rate": 0.25, "failures": 4,
        "mean_seconds": 2.5, "median_seconds": 2.5, "max_seconds": 4.0,
    }
    assert sorted(r.query_id for r in evaluate.failures(cases).collect()) == ["b", "c", "d", "e"]
    none = evaluate.answer_summary(cases.filter("status = 'error'")).first()
    assert (none.cases, none.completed, none.page_hit_rate, none.full_recall_rate, none.median_seconds) == (1, 0, 0.0, 0.0, None)
    assert evaluate.answer_summary(cases.limit(0)).first().cases == 0


def test_missed_questions(spark):
    ranks = spark.createDataFrame([("a", "m", 5), ("b", "m", 6), ("c", "m", None)], "query_id string, method string, first_rank int")
    assert sorted(r.query_id for r in evaluate.missed(ranks).collect()) == ["b", "c"]


def test_lines_that_are_no_chunks_are_named(spark, tmp_path):
    good = json.dumps({"chunk_id": "a", "document_id": "d", "chunk_index": 0, "text": "t"})
    for bad, what in (("{broken", "broken"), ("[1, 2]", ""), ('{"chunk_id": "b", "chunk_index": "no number"}', "no number"), ("{}", "{}"), ('{"text": "without an id"}', "without an id")):
        path = tmp_path / f"{abs(hash(bad))}_chunks.jsonl"
        path.write_text(f"{good}\n\n{bad}\n", encoding="utf-8")
        with pytest.raises(ValueError, match="chunks") as e:
            tables.read_chunks(spark, str(path))
        assert what in str(e.value)
    rows, rejects = tables.json_lines(spark, PAGE, str(tmp_path / "*"))
    assert rows.count() + rejects.count() >= 10
    assert {r.file.rsplit("/", 1)[-1] for r in rejects.collect()} <= {p.name for p in tmp_path.iterdir()}
    (tmp_path / "good.jsonl").write_text(good + "\n", encoding="utf-8")
    assert tables.read_chunks(spark, str(tmp_path / "good.jsonl")).count() == 1


def test_packs_and_page_lists_come_back(spark):
    rows = [("d", i, None if i == 2 else i, "License", f"text {i}", 6, ["short_page"] if i == 3 else []) for i in range(1, 5)]
    parsed = spark.createDataFrame(rows, "document_id string, pdf_page int, printed_page int, chapter string, text string, char_count int, quality_flags array<string>")
    chosen = spark.createDataFrame([("d", c, i) for i, c in enumerate(pages.AUDITED, 1)], "document_id string, category string, pdf_page int")
    packs = pages.audit_pack_json(chosen, parsed)
    back = packs.select(F.from_json("pack", pages.PACK).alias("p")).select("p.document_id", F.explode("p.samples").alias("s")).select("document_id", "s.*")
    assert sorted((r.pdf_page, r.category, r.printed_page, tuple(r.quality_flags), r.text) for r in back.collect()) == [(i, pages.AUDITED[i - 1], r[2], tuple(r[6]), r[4]) for i, r in enumerate(rows, 1)]
    with pytest.raises(ValueError, match="body_text"):
        pages.audit_pack_json(chosen.filter("category <> 'body_text'"), parsed)
    hits = spark.createDataFrame([("[1, 2]",), ("[]",), (None,), ("broken",)], "pdf_pages_json string")
    assert [r.pdf_pages for r in vectors.with_pages(hits).collect()] == [[1, 2], [], [], []]
