import hashlib
import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.config import AnswerConfig, Lexicon, RetrievalConfig, settings
from evidentia.functions import text as X
from evidentia.operators import answer, blocks, chunking, drivers, evaluate, fusion, lexical, vectors
from evidentia.schemas import CHUNK
from evidentia.sources import tables
from evidentia.streaming.index import follow

CHINESE = Lexicon()
CHUNKS = [("A", "2024年营业收入为100亿元，同比增长12.5%", "000001"), ("B", "公司治理与内部控制的一般说明", "000001"), ("C", "营业收入构成，营业收入合计", "000002"), ("D", "", "000002"), ("E", None, "000002")]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id string, text string, code string")


def ask(spark, text, code="000001"):
    return spark.createDataFrame([("q", text, code)], "query_id string, query string, code string")


def test_bm25_equals_the_formula(spark, chunks):
    got = {r.chunk_id: r.score for r in lexical.bm25(chunks, ask(spark, "营业收入是多少？")).collect()}
    grams = lambda t: [run[i : i + n] for run in [c for c in "".join(x if "一" <= x <= "鿿" else " " for x in t).split()] for n in range(1, 5) for i in range(len(run) - n + 1)]
    import re

    tokens = {i: re.findall("[a-z]+|[0-9]+(?:\\.[0-9]+)?%?", (t or "").lower()) + grams(t or "") for i, t, _ in CHUNKS if t is not None}
    tokens["E"] = []
    known = {i: Counter(t) for i, t in tokens.items()}
    sizes = [len(t) for i, t in tokens.items() if i != "E"]
    mean = sum(sizes) / len(sizes)
    for i, score in got.items():
        n, want = len(tokens), 0.0
        for t, qf in Counter(grams("营业收入是多少")).items():
            df, tf = sum(t in c for c in known.values()), known[i][t]
            if tf:
                want += qf * math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tokens[i]) / mean))
        assert math.isclose(score, want, rel_tol=0.05)
    assert set(got) == {"A", "C"} or set(got) >= {"A", "C"}


def test_bm25_filter_changes_the_statistics(spark, chunks):
    hits = lexical.bm25(chunks, ask(spark, "营业收入"), by=["code"]).collect()
    assert [h.chunk_id for h in hits] == ["A"]
    assert lexical.bm25(chunks, ask(spark, "营业收入", "999999"), by=["code"]).count() == 0
    with pytest.raises(ValueError):
        lexical.bm25(chunks, ask(spark, "x"), k=0)


def test_hash_vectors_and_search(spark):
    assert np.allclose(vectors.hash_vector("同一 文本", 64), vectors.hash_vector("同一文本", 64)) and math.isclose(np.linalg.norm(vectors.hash_vector("文本", 64)), 1.0)
    rows = vectors.hashed_embedding(spark.createDataFrame([("a", "营业收入增长"), ("b", "员工人数"), ("c", None)], "chunk_id string, text string"), 64)
    asked = rows.filter("chunk_id = 'a'").select(F.lit("q").alias("query_id"), "embedding")
    assert [(r.chunk_id, round(r.score, 6)) for r in vectors.cosine_search(rows, asked, 1).collect()] == [("a", 1.0)]


def test_upsert_replaces_one_document(spark):
    old = spark.createDataFrame([("a", [1.0]), ("a", [2.0]), ("b", [3.0])], "document_id string, embedding array<double>")
    new = spark.createDataFrame([("a", [9.0])], old.schema)
    assert {r.document_id: r.vectors for r in vectors.index_report(vectors.upsert(old, new)).collect()} == {"a": 1, "b": 1}


def test_rrf(spark):
    v = spark.createDataFrame([("q", 1, "A", 0.9), ("q", 2, "B", 0.8)], "query_id string, rank int, chunk_id string, score double")
    w = spark.createDataFrame([("q", 1, "A", 7.0)], v.schema)
    got = fusion.rrf(v, w, 60, 1.0, 1.0).orderBy("rank").collect()
    assert [(r.chunk_id, r.vector_rank, r.bm25_rank) for r in got] == [("A", 1, 1), ("B", 2, None)] and got[0].rrf_score == round(2 / 61, 8)


def rerank(spark, query, texts):
    chunks = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, text string")
    hits = spark.createDataFrame([("q", i + 1, str(i), 0.1) for i in range(len(texts))], "query_id string, rank int, chunk_id string, rrf_score double")
    return fusion.rerank(hits, spark.createDataFrame([("q", query)], "query_id string, query string"), chunks, lexicon=CHINESE).orderBy("rank").collect()


def test_rerank_prefers_metric_and_number(spark):
    got = rerank(spark, "营业收入是多少？", ["公司介绍", "营业收入为12,345元"])
    assert [r.chunk_id for r in got] == ["1", "0"] and got[0].pre_rerank_rank == 2 and got[0].numeric_score == 1.0


def test_rerank_prefers_the_proposal(spark):
    got = rerank(spark, "2024年拟分红多少？", ["2023年度利润分配方案已实施完毕，现金红利1元", "2024年度利润分配预案，拟派现金红利2元"])
    assert got[0].chunk_id == "1" and got[1].intent_alignment_score == -1.0


def test_expand(spark):
    got = fusion.features(spark.createDataFrame([("q", "2024年归母净利润和拟分红")], "query_id string, query string"), CHINESE).first().expanded
    assert got == "2024年归母净利润和拟分红 归属于上市公司股东的净利润 现金红利利润分配 归属于上市公司股东 2024年度利润分配预案".replace("2024年度", "2024年度")


def test_citations_quotes_units(spark):
    hits = spark.createDataFrame([("q", 1, "A", 0.18, "甲" * 50 + "营业收入" + "乙" * 200, "d", [2, 3]), ("q", 2, "B", 0.05, "短文", "d", [1])], "query_id string, rank int, chunk_id string, score double, text string, document_id string, pdf_pages array<int>")
    questions = spark.createDataFrame([("q", "营业收入多少")], "query_id string, query string")
    units = spark.createDataFrame([("d", 3, "千元")], "document_id string, pdf_page int, unit_context string")
    got = answer.citations(hits, questions, AnswerConfig(max_quote_chars=120), CHINESE, units).collect()
    assert len(got) == 1 and got[0].unit_context == "千元" and len(got[0].quote) <= 122 and "营业收入" in got[0].quote
    cited = answer.citations(hits, questions, AnswerConfig(relative_score=0.0), CHINESE)
    text = answer.evidence_answers(cited, CHINESE).first().answer
    assert "[证据1]" in text and "[证据2] 短文" in text
    assert "问题：营业收入多少" in answer.prompts(cited, questions, CHINESE).first().prompt


def test_gates_and_the_pipeline(spark):
    questions = spark.createDataFrame([("advice", "现在应该买吗"), ("none", "没有证据的问题"), ("low", "离题的问题"), ("fine", "营业收入")], "query_id string, query string")

    def search(open_):
        assert open_.filter("query_id = 'advice'").count() == 0
        return spark.createDataFrame([("low", 1, "A", 0.2, "无关", 0.01), ("fine", 1, "B", 0.5, "营业收入为1元", 0.9)], "query_id string, rank int, chunk_id string, score double, text string, term_coverage double")

    got = {r.query_id: (r.status, r.refusal_reason) for r in answer.answer(questions, search, None, lexicon=CHINESE).collect()}
    assert got == {"advice": ("refused", "out_of_scope"), "none": ("refused", "no_retrieval_results"), "low": ("refused", "low_evidence_relevance"), "fine": ("evidence_only", None)}
    generate = lambda prompts: prompts.select("query_id", F.lit("收入[证据1]").alias("answer"))
    assert {r.query_id: r.status for r in answer.answer(questions, search, None, lexicon=CHINESE, generate=generate).collect()}["fine"] == "answered"


def test_checked_answers(spark):
    rows = spark.createDataFrame([("a", "有[证据1]", [1]), ("b", "有[证据9]", [1]), ("c", "没有", [1]), ("d", "证据不足，无法回答", [1])], "query_id string, answer string, valid_ids array<int>")
    assert {r.query_id: (r.status, r.problem) for r in answer.checked(rows, CHINESE).collect()} == {"a": ("answered", None), "b": ("error", "unknown_citation"), "c": ("error", "no_citation"), "d": ("refused", "generator_evidence_insufficient")}


def test_metrics(spark):
    hits = spark.createDataFrame([("q", "m", 1, [8, 9]), ("q", "m", 2, [10, 11]), ("r", "m", 1, [5])], "query_id string, method string, rank int, pdf_pages array<int>")
    gold = spark.createDataFrame([("q", [11]), ("r", [20]), ("s", [])], "query_id string, gold_pages array<int>")
    ranks = evaluate.first_ranks(hits, gold)
    assert {r.query_id: r.first_rank for r in ranks.collect()} == {"q": 2, "r": None}
    table = evaluate.metrics(ranks)
    assert table.first().asDict() == {"method": "m", "questions": 2, "recall_at_3": 0.5, "recall_at_5": 0.5, "mrr": 0.25}
    assert evaluate.accepted(table).first().accepted is False and evaluate.lift(table, "m").first().lift == 0.0


def test_answer_metrics(spark):
    rows = [("Q1", "answered", "收入63,441.00元", "为63441元", [1], [1], 1.0), ("Q2", "answered", "7.89%", "7.89%", [1], [2], 3.0), ("Q3", "error", "文字", "", [1], [1], 9.0), ("Q4", "answered", "文字（甲）", "答：文字甲。", [1], [1], 2.0)]
    cases = evaluate.answer_cases(spark.createDataFrame(rows, "query_id string, status string, reference_answer string, answer string, gold_pages array<int>, cited_pages array<int>, seconds double"))
    got = {r.query_id: (r.number_recall, r.page_hit, r.proxy) for r in cases.collect()}
    assert got == {"Q1": (1.0, True, True), "Q2": (1.0, False, False), "Q3": (None, True, False), "Q4": (None, True, True)}
    summary = evaluate.answer_summary(cases).first()
    assert (summary.cases, summary.errors, summary.median_seconds, summary.max_seconds) == (4, 1, 2.0, 3.0)


def test_pending(spark):
    questions = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    done = spark.createDataFrame([("a", None), ("b", "timeout")], "query_id string, error string")
    assert [r.query_id for r in evaluate.pending(questions, done).orderBy("query_id").collect()] == ["b", "c"]
    assert evaluate.pending(questions, done, ["a"]).count() == 3


def test_metadata_filters(spark):
    rows = spark.createDataFrame([("a", "000001", 2024), ("b", "000002", 2023)], "company string, stock_code string, report_year int")
    assert lexical.matching(rows, stock_code="000001", report_year=2024).count() == 1 and lexical.matching(rows, company="a", report_year=2023).count() == 0
    assert lexical.matching(rows, stock_code="").count() == 0 and lexical.matching(rows, stock_code="", blank_is_none=True).count() == 2
    label = lambda *ids: evaluate.document_label(spark.createDataFrame([(i,) for i in ids], "document_id string")).first()[0]
    assert label("d", "d") == "d" and label("d", "e") == "multi_document"


def test_manifest_and_results_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "manifest")
    for status in ("pending", "parsed"):
        tables.write_manifest(spark.createDataFrame([("000333", status)], "document_id string, parse_status string"), path)
    assert tables.read_csv(spark, path, ("document_id",)).collect()[0].parse_status == "parsed" and len(list(tmp_path.iterdir())) == 1
    for i in ("a", "b"):
        tables.append_results(spark.createDataFrame([(i,)], "query_id string"), str(tmp_path / "results"))
    assert spark.read.parquet(str(tmp_path / "results")).count() == 2


def test_results_of_a_repeated_batch(spark, tmp_path):
    path = str(tmp_path / "results")
    write = lambda batch, *rows: tables.write_results(spark.createDataFrame(rows, "query_id string, status string, error string"), path, batch)
    read = lambda: {r.query_id: r.status for r in tables.read_results(spark, path).collect()}
    write(1, ("a", "answered", None), ("b", "error", "timeout"))
    write(1, ("a", "answered", None), ("b", "error", "timeout"))
    assert spark.read.parquet(path).count() == 2
    questions = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    assert {r.query_id for r in evaluate.pending(questions, tables.read_results(spark, path)).collect()} == {"b", "c"}
    write(2, ("b", "answered", None), ("c", "refused", None))
    write(1, ("a", "answered", None))  # a run cut short left a part of its batch; the rest stands
    assert read() == {"a": "answered", "b": "answered", "c": "refused"}
    with pytest.raises(ValueError):
        tables.write_results(questions.withColumn("batch", F.lit(1)), path, 3)


def test_errors_of_a_generator_are_its_questions(spark, tmp_path):
    def load():
        with open(tmp_path / "loads", "a") as f:
            f.write("x")

        def model(prompt):
            with open(tmp_path / "calls", "a") as f:
                f.write("x")
            if "raise" in prompt:
                raise TimeoutError("no reply")
            return None if "nothing" in prompt else "收入[证据1]"

        return model

    generate = answer.model_generator(f"stub-{tmp_path}", load, partitions=3)
    rows = spark.createDataFrame([(1, "fine"), (2, "raise"), (3, "nothing"), (4, None)], "query_id long, prompt string")
    got = {r.query_id: (r.answer, r.error) for r in generate(rows).collect()}
    assert got == {1: ("收入[证据1]", None), 2: (None, "TimeoutError: no reply"), 3: (None, "TypeError: the answer is NoneType, not text"), 4: (None, "ValueError: no prompt")}
    assert generate(rows.limit(0)).count() == 0
    (tmp_path / "calls").unlink()
    questions = spark.createDataFrame([(1, "fine"), (2, "raise 营业收入"), (3, "nothing"), (5, "lost")], "query_id long, query string")
    hits = spark.createDataFrame([(i, 1, "B", 0.5, "营业收入为1元", 0.9) for i in (1, 2, 3, 5)], "query_id long, rank int, chunk_id string, score double, text string, term_coverage double")
    some = lambda prompts: generate(prompts.filter("query_id < 5"))
    out = answer.answer(questions, lambda q: hits, None, lexicon=CHINESE, generate=some)
    assert {r.query_id: (r.status, r.refusal_reason) for r in out.collect()} == {
        1: ("answered", None), 2: ("error", "generator: TimeoutError: no reply"), 3: ("error", "generator: TypeError: the answer is NoneType, not text"), 5: ("error", "generator: no answer"),
    }
    assert out.count() == 4 and (tmp_path / "calls").read_text() == "xxx"  # each question is asked once

    def broken():
        raise OSError("no model")

    with pytest.raises(Exception, match="no model"):
        answer.model_generator(f"broken-{tmp_path}", broken)(rows).collect()


def test_hybrid(spark, chunks):
    questions = ask(spark, "营业收入是多少？")
    got = fusion.hybrid(chunks, questions, lambda q, k, by: lexical.token_cosine(chunks, q, k), RetrievalConfig(top_k=1), CHINESE).collect()
    assert [r.chunk_id for r in got] == ["A"]
    assert fusion.hybrid(chunks.limit(0), questions, lambda q, k, by: lexical.token_cosine(chunks.limit(0), q, k), lexicon=CHINESE).count() == 0


def test_full_width_forms_match(spark):
    rows = spark.createDataFrame([("a", "ＲＥＶＥＮＵＥ of １２.５％"), ("b", "revenues"), ("c", None)], "chunk_id string, text string")
    got = {r.chunk_id: r.terms for r in lexical.index(rows).collect()}
    assert got == {"a": ["revenue", "of", "12.5%"], "b": ["revenues"], "c": []}
    assert [r.chunk_id for r in lexical.bm25(rows, ask(spark, "Ｒevenue")).collect()] == ["a"]
    for text in ("abc １２3 中文字 x", "ﬁn 2.5% 研发投入"):
        native = spark.createDataFrame([(text,)], "t string").select(X.tokens(X.nfkc()(F.col("t")))).first()[0]
        assert lexical.tokens_of(text) == native


def test_blank_questions_are_errors(spark, chunks):
    for query in ("", "  ", None):
        with pytest.raises(ValueError):
            lexical.bm25(chunks, ask(spark, query))


def test_blocks_of_questions_and_slices_change_nothing(spark, monkeypatch):
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choice("ab") for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = spark.createDataFrame([(i, text(12), rng.choice("xy"), [float(rng.randrange(3)) for _ in range(3)]) for i in range(300)], "chunk_id long, text string, lang string, embedding array<double>")
    asked = spark.createDataFrame([(i, text(5), rng.choice("xyz"), [1.0, float(i % 3), 2.0]) for i in range(20)], "query_id long, query string, lang string, embedding array<double>")
    runs = [lambda: lexical.bm25(rows, asked, 7), lambda: lexical.bm25(rows, asked, 7, by=["lang"]), lambda: lexical.token_cosine(rows, asked, 7, ["lang"]), lambda: vectors.cosine_search(rows, asked, 7), lambda: vectors.cosine_search(rows, asked, 7, ["lang"])]
    key = lambda r: (r.query_id, r.rank, r.chunk_id, round(r.score, 9))
    whole = [sorted(map(key, run().collect())) for run in runs]
    monkeypatch.setattr(blocks, "BLOCK", 17)
    monkeypatch.setattr(blocks, "SLICE", 40)
    assert [sorted(map(key, run().collect())) for run in runs] == whole
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for q in asked.collect():
        near = sorted((-math.floor(dot(q.embedding, r.embedding) / math.sqrt(dot(q.embedding, q.embedding) * dot(r.embedding, r.embedding)) * 1e9 + 0.5), r.chunk_id) for r in rows.collect() if any(r.embedding))
        assert [c for a, _, c, _ in [(k[0], k[1], k[2], k[3]) for k in whole[3]] if a == q.query_id] == [i for _, i in near[:7]]


def test_hashed_vectors_of_a_batch(spark):
    texts = ["abc abd", "", "研发投入", "x"]
    for text, row in zip(texts, vectors.hash_vectors(texts, 32), strict=True):
        want = np.zeros(32)
        plain = text.replace(" ", "")
        for n in (1, 2, 3):
            for i in range(len(plain) - n + 1):
                value = int.from_bytes(hashlib.blake2b(plain[i : i + n].encode(), digest_size=8).digest(), "big")
                want[value % 32] += 1 if value % 2 else -1
        assert np.allclose(row, want / (np.linalg.norm(want) or 1))


def report_pages(spark, n=3):
    rows = [("d", i, f"Page {i} has a few words. " * 30, "unknown" if i == 1 else "Licensed under", "Firm", "000001", 2024, None if i == 1 else i + 10) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "document_id string, pdf_page int, text string, chapter string, company string, stock_code string, report_year int, printed_page int")


def test_chunks_carry_their_document(spark):
    rows = report_pages(spark)
    for strategy, made in (("baseline", chunking.fixed_chunks(rows)), ("structured", chunking.structured_chunks(rows))):
        out = chunking.described(made, rows, strategy)
        assert out.columns == [c.split()[0] for c in CHUNK.split(", ")]
        for r in out.collect():
            assert (r.company, r.stock_code, r.report_year, r.source_url, r.strategy) == ("Firm", "000001", 2024, None, chunking.STRATEGIES[strategy])
            assert (r.pdf_page_start, r.pdf_page_end) == (r.pdf_pages[0], r.pdf_pages[-1]) and r.printed_pages == [p + 10 for p in r.pdf_pages if p > 1]
        one = vectors.metadata(out).first()
        assert len(vectors.metadata(out).columns) == 14 and json.loads(one.pdf_pages_json) == list(range(one.pdf_page_start, one.pdf_page_end + 1))
    hits = lexical.described(lexical.bm25(out, ask(spark, "words")), out)
    assert hits.first().company == "Firm" and set(lexical.HIT) < set(hits.columns)
    cited = answer.citations(hits, ask(spark, "words"))
    assert set(answer.METADATA) < set(cited.columns) and cited.first().report_year == 2024


def test_index_is_built_and_checked(spark, tmp_path):
    rows = report_pages(spark)
    chunks = chunking.described(chunking.fixed_chunks(rows), rows, "baseline")
    folder = str(tmp_path)
    for _ in range(2):
        report = tables.build_index(chunks, vectors.hashed_embedder(16), folder, "baseline").first()
        assert (report.document_id, report.indexed_chunks, report.total_chunks, report.dimensions) == ("d", chunks.count(), chunks.count(), 16)
    other = vectors.Embedder("hashed_ngrams_16", 8, lambda r: vectors.hashed_embedding(r, 8))
    short = vectors.Embedder("short", 9, lambda r: vectors.hashed_embedding(r, 8))
    for embedder, strategy in ((other, "baseline"), (short, "baseline"), (vectors.hashed_embedder(16), "structured"), (vectors.hashed_embedder(16), "none")):
        with pytest.raises(ValueError):
            tables.build_index(chunks, embedder, folder, strategy)
    tables.write_report(report_rows := tables.build_index(chunks, vectors.hashed_embedder(16), folder, "baseline"), f"{folder}/report")
    assert tables.read_report(spark, f"{folder}/report").first().asDict() == report_rows.first().asDict()


def test_search_of_a_stored_table(spark, tmp_path):
    texts = ["营业收入为100亿元", "公司治理与内部控制", "营业收入构成", "net revenue of the year", "cash flow", "audit committee and governance"]
    fields = "chunk_id string, document_id string, company string, stock_code string, report_year int, report_type string, strategy string, chapter string, pdf_page_start int, pdf_page_end int, pdf_pages array<int>, source_file string, source_url string, text string"
    chunks = spark.createDataFrame([(f"c{i}", ("000333", "000651")[i % 2], "co", "1", 2024, "annual", "fixed_char", None, i, i + 1, [i, i + 1], "f", "u", t) for i, t in enumerate(texts)], fields)
    embedder, folder = vectors.hashed_embedder(32), str(tmp_path)
    questions = spark.createDataFrame([("q", "营业收入"), ("r", "governance of the audit")], "query_id string, query string")
    with pytest.raises(ValueError):
        tables.search_index(questions, embedder, folder, "baseline")
    assert {r.document_id for r in tables.build_index(chunks, embedder, folder, "baseline").collect()} == {"000333", "000651"}
    vector = lambda rows: {r[0]: np.array(r.embedding) for r in vectors.hashed_embedding(rows, 32).collect()}
    have, want = vector(chunks.select("chunk_id", "text")), vector(questions.select("query_id", F.col("query").alias("text")))
    for filters in ({}, {"document_id": "000333"}, {"document_id": "333"}):
        got = tables.search_index(questions, embedder, folder, "baseline", 2, **filters).orderBy("query_id", "rank").collect()
        own = [i for i in range(6) if not filters or ("000333", "000651")[i % 2] == filters["document_id"]]
        for q, v in want.items():
            best = sorted(own, key=lambda i: (-round(float(have[f"c{i}"] @ v), 8), i))[:2]
            assert [(r.chunk_id, r.pdf_pages, r.text) for r in got if r.query_id == q] == [(f"c{i}", [i, i + 1], texts[i]) for i in best]
    plan = tables.search_index(questions, embedder, folder, "baseline", 2, document_id="000333")._jdf.queryExecution().toString()
    assert "document_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert tables.search_index(questions.limit(0), embedder, folder, "baseline").count() == 0
    for asked, other in ((spark.createDataFrame([("q", " ")], "query_id string, query string"), embedder), (questions, vectors.Embedder("hashed_ngrams_32", 8, embedder.embed))):
        with pytest.raises(ValueError):
            tables.search_index(asked, other, folder, "baseline")


def test_drivers_gate_and_check(spark):
    rows = report_pages(spark)
    manifest = lambda status, count="3": spark.createDataFrame([("d", count, status, ""), ("e", "1", "pending", "")], "document_id string, page_count string, parse_status string, notes string")
    state = lambda m: {r.document_id: (r.parse_status, r.notes) for r in m.collect()}
    raw = rows.select("document_id", "pdf_page", "text")
    assert state(drivers.parse_reports(manifest("pending"), raw)[2]) == {"d": ("parsed", "3 pages parsed"), "e": ("pending", "")}
    for bad, count in (("audited", "3"), ("pending", "4")):
        with pytest.raises(ValueError):
            drivers.parse_reports(manifest(bad, count), raw)
    chunks, fixed, after = drivers.chunk_reports(manifest("audited"), rows, "baseline")
    assert state(after)["d"] == ("baseline_chunked", f"{chunks.count()} chunks")
    _, structured, after = drivers.chunk_reports(after, rows, "structured")
    assert state(after)["d"][0] == "structured_chunked" and chunking.compared(fixed, structured).count() == 1
    with pytest.raises(ValueError):
        drivers.chunk_reports(manifest("pending"), rows, "baseline")
    with pytest.raises(ValueError):
        chunking.compared(fixed, structured.withColumn("page_count", F.lit(9).cast("long")))


def test_settings_from_a_file(tmp_path):
    (tmp_path / "c.yaml").write_text("app:\n  name: x\nretrieval:\n  top_k: 7  # first\n  b: 0.5\n\nother:\n  top_k: 1\n")
    (tmp_path / "c.json").write_text('{"retrieval": {"top_k": 7, "b": 0.5}}')
    for name in ("c.yaml", "c.json"):
        assert RetrievalConfig(**settings(str(tmp_path / name), "retrieval")) == RetrievalConfig(top_k=7, b=0.5)
    with pytest.raises(KeyError):
        settings(str(tmp_path / "c.yaml"), "absent")


def test_evaluation_round(spark):
    questions = spark.createDataFrame([(i, "5", [1]) for i in range(4)], "query_id long, reference_answer string, gold_pages array<int>")
    done = spark.createDataFrame([(0, "answered", True, 1.0, True, 1.0, None), (1, "error", False, None, False, 1.0, "timeout")], "query_id long, status string, page_hit boolean, number_recall double, proxy boolean, seconds double, error string")
    run = lambda todo: todo.filter("query_id < 3").select("query_id", F.lit("answered").alias("status"), F.lit("it is 5").alias("answer"), F.array(F.lit(1)).alias("cited_pages"), F.lit(2.0).alias("seconds"), F.when(F.col("query_id") == 2, "broken").alias("error"))
    got = {r.query_id: (r.status, r.proxy, r.error) for r in evaluate.evaluation_round(questions, done, run).collect()}
    assert got == {0: ("answered", True, None), 1: ("answered", True, None), 2: ("error", False, "broken"), 3: ("error", False, "no result")}
    with pytest.raises(ValueError):
        evaluate.single_method(None, None, 4)


def test_sources_and_the_stream(spark, tmp_path):
    from evidentia.schemas import MANIFEST_COLUMNS, QUESTION_COLUMNS

    manifest = tmp_path / "m.csv"
    manifest.write_text("﻿" + ",".join(MANIFEST_COLUMNS) + "\n" + ",".join(["000333"] + [""] * (len(MANIFEST_COLUMNS) - 1)) + "\n", encoding="utf-8")
    rows = tables.read_manifest(spark, str(manifest))
    assert tables.manifest_row(rows, "000333")["notes"] == ""
    with pytest.raises(ValueError):
        tables.manifest_row(rows, "x")
    questions = tmp_path / "q.csv"
    line = ["Q1"] + ["x"] * (len(QUESTION_COLUMNS) - 1)
    line[QUESTION_COLUMNS.index("evidence_pages")] = "3-4"
    questions.write_text(",".join(QUESTION_COLUMNS) + "\n" + ",".join(line) + "\n", encoding="utf-8")
    assert tables.read_questions(spark, str(questions)).count() == 1
    questions.write_text(",".join(QUESTION_COLUMNS) + "\n" + ",".join(line) + "\n" + ",".join(line) + "\n", encoding="utf-8")
    with pytest.raises(ValueError):
        tables.read_questions(spark, str(questions))
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(questions), ("absent",))
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.pdf").write_bytes(b"one|two")
    pages = tables.page_texts(tables.read_files(spark, str(tmp_path / "files")), lambda raw: raw.decode().split("|"))
    assert [r.text for r in pages.orderBy("pdf_page").collect()] == ["one", "two"]
    chunks = tmp_path / "c"
    chunks.mkdir()
    (chunks / "d_chunks.jsonl").write_text("\n".join(json.dumps({"chunk_id": f"d{i}", "document_id": "d", "text": "t"}) for i in range(2)), encoding="utf-8")
    assert tables.read_chunks(spark, str(chunks / "*_chunks.jsonl")).count() == 2
    tables.write_json(tables.read_chunks(spark, str(chunks)), str(tmp_path / "out"))
    assert tables.read_chunks(spark, str(tmp_path / "out")).count() == 2
    stream = spark.readStream.schema("document_id string, chunk_id string, text string").json(str(chunks))
    follow(stream, lambda b: vectors.hashed_embedding(b, 16), str(tmp_path / "index"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "index")).count() == 2


def test_registered_queries_read_whole_texts(spark, tmp_path):
    from evidentia.plans import queries

    lead = "filler words without any figure here " * 30
    spark.createDataFrame([(0, f"{lead} 1234.5 and 77 at the end"), (4, f"{lead} 1234.5 alone"), (5, "unlike")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, f"{lead} 1234.5 and 77"), (1, "no figure")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = queries.queries()
    got = {r.query_id: (r.number_recall, r.proxy) for r in found["answer_case"](spark, str(tmp_path)).collect()}
    assert got == {0: (1.0, True), 4: (0.5, False), 5: (None, False)}
    total = found["answer_summary"](spark, str(tmp_path)).first()
    assert (total.cases, total.mean_number_recall, total.proxy_rate) == (3, 0.75, 0.333333)
    assert found["quote_window"](spark, str(tmp_path)).count() == 3


def test_registered_citations_of_the_configured_size(spark):
    from evidentia.plans import queries

    rows = queries.queries()["citations"](spark, "/root/testdata/sf0.001").collect()
    assert max(len(r.quote) for r in rows) > 200 and max(r.citation_id for r in rows) > 3


def test_numbers_near_terms_equal_patterns():
    import random
    import re

    rng = random.Random(9)
    for _ in range(400):
        text = "".join(rng.choice("abc. \n") if rng.random() < 0.97 else rng.choice("0189") for _ in range(rng.randrange(0, 160)))
        terms = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(4)] + ["a8b"]
        near = lambda t: re.search(f"(?s)[0-9].{{0,19}}{re.escape(t)}", text) or re.search(f"(?s){re.escape(t)}.{{0,49}}[0-9]", text) or re.search("[0-9]", t)  # noqa: E731, B023
        want = any(len(t) >= 3 and t in text and near(t) for t in terms)
        assert fusion.near_number(text, [t for t in terms if t in text]) == bool(want)


def test_places_of_odd_candidates(spark):
    rows = [(None, ["abc"], True), ("abc 7", None, True), ("abc 7", [], True), ("abc 7", ["abc", "zz"], True), ("abc 7", ["abc"], None), ("abc" + "-" * 60 + "7", ["abc"], True)]
    frame = spark.createDataFrame(rows, "text string, terms array<string>, _numeric boolean")
    got = [(round(r.term_coverage, 3), r.numeric_score) for r in fusion.placed(frame).collect()]
    assert got == [(0.0, 0.0), (0.0, 0.0), (0.0, 0.0), (0.692, 1.0), (1.0, 0.0), (1.0, 0.0)]
