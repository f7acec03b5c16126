import dataclasses
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.config import LATIN, ChunkConfig, Lexicon, RetrievalConfig
from evidentia.functions import text as X
from evidentia.operators import chunking, ingest, pages

CHINESE = Lexicon()


def page_frame(spark, texts, document="d"):
    rows = [(document, i, t, "unknown") for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "document_id string, pdf_page int, text string, chapter string")


def test_text_functions(spark):
    row = spark.createDataFrame([(" a 　b\t c \n\n　\n d ", "11|29-31|252", "63,441,379,000.00元，7.89% -0.50", "营业收入是多少？Élan 12.5%")], "t string, e string, n string, q string")
    got = row.select(
        X.join_lines(X.lines_of(F.col("t"))).alias("lines"), X.compact_count(F.col("t")).alias("n"), X.evidence_pages(F.col("e")).alias("pages"),
        X.evidence_pages(F.lit("31-29")).alias("reversed"), X.evidence_pages(F.lit("")).alias("none"), X.numbers(F.col("n")).alias("numbers"), X.tokens(F.col("q")).alias("tokens"),
    ).first()
    assert got.lines == "a b c\nd" and got.n == 4
    assert got.pages == [11, 29, 30, 31, 252] and got.reversed is None and got.none is None
    assert got.numbers == ["63441379000", "7.89%", "-0.5"]
    assert {"营业收入", "营", "lan", "12.5%"} <= set(got.tokens) and len([t for t in got.tokens if len(t) == 4 and t != "12.5%"]) == 4


def test_nfkc(spark):
    assert spark.createDataFrame([("ＡＢ１",)], "t string").select(X.nfkc()(F.col("t"))).first()[0] == "AB1"


def test_margins_printed_pages_and_chapters(spark):
    texts = [f"年度报告全文\n{'第一节 公司简介' if i == 1 else '正文'}\n内容{i}内容\n{i + 2}" for i in range(4)]
    parsed = {r.pdf_page: r for r in pages.parse(page_frame(spark, texts).drop("chapter"), CHINESE).collect()}
    assert [parsed[i].printed_page for i in (1, 2, 3, 4)] == [2, 3, 4, 5]
    assert [parsed[i].chapter for i in (1, 2, 3, 4)] == ["unknown", "第一节 公司简介", "第一节 公司简介", "第一节 公司简介"]
    assert all("年度报告全文" not in r.text for r in parsed.values()) and parsed[1].quality_flags == ["short_page"]


def test_quality_flags(spark):
    got = pages.parse(page_frame(spark, ["", None, "x" * 60, "�" + "y" * 60]).drop("chapter")).orderBy("pdf_page").collect()
    assert [r.quality_flags for r in got] == [["empty_page"], ["empty_page"], [], ["replacement_character"]]


def test_audit_samples(spark):
    long = "管理层讨论 " + "这是一段很长的叙述文字。" * 80
    rows = [("d", 1, "封面", 2, "unknown", []), ("d", 2, "目录 第一 第二 第三 第四", 20, "unknown", []), ("d", 3, long, 900, "管理层讨论与分析", []), ("d", 4, "合并资产负债表", 700, "财务", []), ("d", 5, "", 0, "财务", ["empty_page"])]
    frame = spark.createDataFrame(rows, "document_id string, pdf_page int, text string, char_count int, chapter string, quality_flags array<string>")
    got = {r.pdf_page: r.category for r in pages.audit_samples(frame, CHINESE).collect()}
    assert got == {1: "cover", 2: "table_of_contents", 3: "body_text", 4: "financial_table", 5: "flagged_page"}
    assert pages.audit_gaps(pages.audit_samples(frame, CHINESE)).count() == 0
    assert pages.audit_gaps(pages.audit_samples(frame.filter("pdf_page <> 3"), CHINESE)).first().missing == ["body_text"]
    assert "## Page 4 (financial_table)" in pages.audit_pack(pages.audit_samples(frame, CHINESE), frame).first().markdown


def test_contiguity_and_ids(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 3)], "document_id string, pdf_page int")
    assert {r.document_id: r.contiguous for r in pages.contiguity(frame).collect()} == {"a": True, "b": False}
    assert [r.document_id for r in ingest.repeated_ids(frame, "document_id").orderBy("document_id").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        ingest.require_none(ingest.repeated_ids(frame, "document_id"), "ids repeat")


def test_unit_context(spark):
    texts = ["前言", "财务附注中报表的单位为：千元。", "后文", "财务附注中报表的单位为：元，"]
    got = [r.unit_context for r in pages.unit_context(page_frame(spark, texts), CHINESE).orderBy("pdf_page").collect()]
    assert got == [None, "财务附注报表单位为千元", "财务附注报表单位为千元", "财务附注报表单位为元"]


def brute_chunks(texts, size, overlap):
    spans, corpus = [], ""
    for page, t in enumerate(texts, 1):
        t = (t or "").strip()
        if t:
            corpus += "\n\n" if corpus else ""
            spans.append((len(corpus), len(corpus) + len(t), page))
            corpus += t
    out, start = [], 0
    while corpus:
        end = min(start + size, len(corpus))
        if corpus[start:end].strip():
            out.append((corpus[start:end].strip(), [p for a, b, p in spans if a < end and b > start]))
        if end == len(corpus):
            break
        start += size - overlap
    return out


def test_fixed_chunks_equal_brute_force(spark):
    rng = random.Random(1)
    for _ in range(6):
        texts = ["".join(rng.choice("ab \n") for _ in range(rng.randrange(0, 60))) for _ in range(rng.randrange(1, 12))]
        size = rng.randrange(3, 40)
        config = ChunkConfig(size=size, overlap=rng.randrange(0, size), target=20, most=30, structured_overlap=5, unit=10)
        got = [(r.text, r.pdf_pages) for r in chunking.fixed_chunks(page_frame(spark, texts), config).orderBy("chunk_index").collect()]
        assert got == brute_chunks(texts, config.size, config.overlap)


def test_more_chunks_than_five_digits_name(spark):
    """Ids stay unique, and those of five digits stay as they were."""
    rows = spark.createDataFrame([("d", i) for i in (7, 99_999, 100_004, 100_005)], "document_id string, chunk_index int")
    assert [r[0] for r in rows.select(chunking.chunk_name("baseline")).collect()] == ["d_baseline_00007", "d_baseline_99999", "d_baseline_100004", "d_baseline_100005"]


def test_fixed_chunks_fixture(spark):
    rows = spark.createDataFrame([("d", i, c * 90, ch) for i, c, ch in ((1, "a", "x"), (2, "b", "x"), (3, "c", "y"))], "document_id string, pdf_page int, text string, chapter string")
    got = chunking.fixed_chunks(rows, ChunkConfig(size=120, overlap=20)).orderBy("chunk_index").collect()
    assert [r.pdf_pages for r in got][:2] == [[1, 2], [2, 3]] and len(got) == 3
    assert got[0].text[-20:] == got[1].text[:20] and got[1].chapters == ["x", "y"]
    quality = chunking.fixed_quality(chunking.fixed_chunks(rows, ChunkConfig(size=120, overlap=20))).first()
    assert (quality.chunk_count, quality.cross_page, quality.cross_chapter) == (3, 2, 1)


def test_structured_chunks(spark):
    prose = "第一句话说明了情况。第二句话给出了数字！第三句话提出问题？第四句话作出回答；" * 6
    rows = spark.createDataFrame([("d", i, prose, "甲" if i < 3 else "乙") for i in (1, 2, 3)], "document_id string, pdf_page int, text string, chapter string")
    got = chunking.structured_chunks(rows, ChunkConfig(target=180, most=240, structured_overlap=40, unit=100), CHINESE).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in got] == list(range(len(got))) and all(r.char_count <= 240 for r in got)
    assert {tuple(r.pdf_pages) for r in got if r.chapter == "乙"} == {(3,)}
    assert chunking.cut_text("一。二二。三三三三三", 4, "。！？；") == ["一。", "二二。", "三三三三", "三"]
    assert chunking.cut_text("abcdef", 4, "。") == ["abcd", "ef"]


def test_chunk_ranges_hold_their_rules():
    rng = random.Random(6)
    for _ in range(300):
        lengths = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 60))]
        config = ChunkConfig(target=rng.randrange(20, 90), most=rng.randrange(90, 130), structured_overlap=rng.choice((0, 5, 19)), unit=20)
        ranges, begin, fresh = chunking.chunk_ranges(np.array(lengths), config)
        ranges += [(begin, len(lengths))] if fresh < len(lengths) else []
        joined = lambda a, b: sum(lengths[a:b]) + 2 * (b - a - 1)  # noqa: E731, B023
        assert ranges[0][0] == 0 and ranges[-1][1] == len(lengths)
        for i, (a, b) in enumerate(ranges):
            first = ranges[i - 1][1] if i else a  # the first unit that the chunk before lacks
            assert a <= first < b and all(joined(a, e) < config.target and joined(a, e + 1) <= config.most for e in range(first + 1, b))
            assert b == len(lengths) or joined(a, b) >= config.target or joined(a, b + 1) > config.most
            if i and not config.structured_overlap:
                assert a == first
            elif i:
                before = ranges[i - 1][0]
                assert a == first - 1 or a >= before and sum(lengths[a:first]) <= config.structured_overlap
                assert a == before or a == 0 or sum(lengths[a - 1 : first]) > config.structured_overlap


def test_chunks_dont_depend_on_batches(spark):
    rng = random.Random(7)
    rows = [("d", i, " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) + rng.choice(("", ".", "\n")) for _ in range(40)), "x" if i < 60 else "y") for i in range(1, 90)]
    frame = spark.createDataFrame(rows, "document_id string, pdf_page int, text string, chapter string")
    config = ChunkConfig(target=80, most=120, structured_overlap=20, unit=50)
    many = [r.text for r in chunking.structured_chunks(frame, config).orderBy("chunk_index").collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert [r.text for r in chunking.structured_chunks(frame, config).orderBy("chunk_index").collect()] == many
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_segments_cross_as_one_walk_does():
    """Chained segments give the ranges of one walk over the whole run, at every size of segment."""
    rng = random.Random(8)
    for trial in range(200):
        config = ChunkConfig(target=rng.randrange(60, 90), most=rng.randrange(120, 150), structured_overlap=rng.choice((0, 5, 12)), unit=40)
        assert chunking.segmented(config)
        lengths = np.array([rng.choice((1, 2, rng.randrange(1, 41))) for _ in range(rng.randrange(1, 400))])
        ranges, begin, fresh = chunking.chunk_ranges(lengths, config)
        want = ranges + ([(begin, len(lengths))] if fresh < len(lengths) else [])
        before, after = chunking.halo(config)
        size, got, entry, count = max(before, after, 50 + trial), [], 0, 0
        for lo in range(0, len(lengths), size):
            hi = min(lo + size, len(lengths))
            a, b = max(0, lo - before), min(len(lengths), hi + after)
            if entry is None:
                break
            found = chunking.segment_chunks(lengths[a:b], lo - a, hi - lo, lo - a + entry, config)
            got += [(a + x, a + y) for x, y in found]
            if hi < len(lengths):
                leaves, chunks = next((x, c) for p, q, x, c in chunking.crossings(lengths[a:b], lo - a, hi - lo, config) if p <= entry <= q)
                assert chunks == len(found)
                count, entry = count + chunks, None if leaves < 0 else leaves - size
        assert got == want


@pytest.mark.parametrize("overlap", [0, 12])
def test_one_chapter_is_cut_by_many_tasks(spark, monkeypatch, overlap):
    monkeypatch.setattr(chunking, "ROWS", 500)
    rng = random.Random(overlap)
    rows = [("d", i, "\n\n".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for _ in range(9)), "x") for i in range(1, 400)]
    rows += [("e", i, "kurz.", ("x", None, None, "y")[i % 4]) for i in range(12)] + [("f", 1, " ", "x"), ("f", 2, None, "x"), (None, 1, "no document", "x")]
    frame = spark.createDataFrame(rows, "document_id string, pdf_page int, text string, chapter string")
    config = ChunkConfig(target=80, most=130, structured_overlap=overlap, unit=40)
    shown = lambda: [tuple(r) for r in chunking.structured_chunks(frame, config).orderBy("document_id", "chunk_index").collect()]
    monkeypatch.setattr(chunking, "SEGMENT", 1 << 40)
    whole = shown()
    monkeypatch.setattr(chunking, "SEGMENT", 1)  # as small as the halo lets it
    assert shown() == whole and sum(r[0] == "d" for r in whole) > 300


def test_parameters():
    for bad in ({"overlap": 800}, {"target": 1200}, {"structured_overlap": 700}, {"unit": 2000}):
        with pytest.raises(ValueError):
            ChunkConfig(**bad)
    for bad in ({"candidate_pool": 4}, {"rrf_k": 0}, {"b": 2.0}, {"k1": 0}, {"vector_weight": 0.0, "bm25_weight": 0.0}):
        with pytest.raises(ValueError):
            RetrievalConfig(**bad)
    assert re.compile(LATIN.heading)


def test_registration(spark):
    manifest = spark.createDataFrame([("a", "", "parsed"), ("b", "", "audited")], "document_id string, page_count string, parse_status string")
    rows = page_frame(spark, ["公司 2024 年度报告 " + "字" * 250, "x", "y"], "a")
    keywords = spark.createDataFrame([("a", ["公司", "2024", "年度报告"])], "document_id string, keywords array<string>")
    found = ingest.inspect(rows, keywords).first()
    assert found.accepted and found.page_count == 3 and found.missing == ""
    out = {r.document_id: (r.page_count, r.parse_status) for r in ingest.registered(manifest, ingest.inspect(rows, keywords).select("document_id", "page_count")).collect()}
    assert out == {"a": ("3", "pending"), "b": ("", "audited")}


def test_slices_hold_a_bounded_size_of_text():
    import pyarrow as pa

    from evidentia.operators.blocks import slices

    texts = ["a" * 40, None, "é" * 30, "b" * 500, "", "c" * 99, "d"]
    parts = [p.column("text").to_pylist() for p in slices(pa.record_batch({"text": pa.array(texts, pa.string())}), size=100)]
    assert [t for p in parts for t in p] == texts
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 100 for p in parts) and len(parts) == 3


def test_a_report_reads_no_text_of_clean_pages(spark):
    rows = page_frame(spark, [f"Chapter {i}\nline {i} of the page" for i in range(1, 5)]).drop("chapter")
    report = pages.parse_report(pages.parse(rows))
    assert [(r.page_count, r.first_flagged_page) for r in report.collect()] == [(4, 1)]
    read = re.findall(r"ReadSchema: (\S+)", report._jdf.queryExecution().executedPlan().toString())
    assert read and not any("lines" in r or "_raw" in r or "text:" in r for r in read), read


def test_lines_of_odd_texts(spark):
    """Texts with every kind of white space and line end, against Python; plain ones take the path without patterns."""
    rng = random.Random(6)
    marks = [*X.BLANKS, "\r\n", "\n\n", "  ", "\n", " ", "a", "字", "7", "b c"]
    texts = ["", " ", "\n", "a", "plain text\nof two lines", "\r\n", "a\rb\x0bc\x0cd\x85e\u2028f\u2029g", *("".join(rng.choices(marks, k=rng.randint(1, 12))) for _ in range(400))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    got = {r.i: r for r in rows.select("i", X.lines_of(F.col("t")).alias("l"), X.lines_of(F.concat("t", F.lit("\n x"))).alias("m"), X.normalize_line(F.col("t")).alias("one")).collect()}
    one = lambda t: re.sub("[ \t\u3000]+", " ", t)
    lines = lambda t: [x for x in (p.strip(X.BLANKS) for p in re.split("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]", one(t))) if x]
    for i, t in enumerate(texts):
        assert got[i].l == lines(t) and got[i].m == [*lines(t), "x"] and got[i].one == one(t).strip(X.BLANKS), repr(t)
    assert got[len(texts)].l is None and got[len(texts)].m is None


def test_a_page_is_cut_into_lines_once(spark):
    """What a page says of itself is found inside lambdas, where Spark computes an expression again for each place that it stands in."""
    rows = page_frame(spark, ["Head\none text\n- 7 -\nfoot", "Head\nanother text\n8\nfoot", "Head\nlast\nx 9\nfoot", " \xa0\n"]).drop("chapter")
    seen = []
    true = X.lines_of
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(X, "lines_of", lambda text: seen.append(text) or true(text))
        got = pages.parse(rows).orderBy("pdf_page").collect()
    assert len(seen) == 2  # for margin lines, which are known only after all pages were read, and for all else
    assert [r.text for r in got] == ["one text\n- 7 -", "another text\n8", "last\nx 9", ""]
    assert [r.printed_page for r in got] == [7, 8, None, None] and got[3].quality_flags == ["empty_page"]
    assert [r.char_count for r in got] == [10, 12, 6, 0]


def test_printed_numbers_are_cast_where_a_pattern_matched(spark):
    rows = spark.createDataFrame([(0, ["no number", "- 0 -", "12345", "12"]), (1, ["a", "b"]), (2, []), (3, ["99999999999"]), (4, ["x", "003"])], "i int, l array<string>")
    wide = dataclasses.replace(LATIN, printed=("^(\\d+)$", "^- (.+) -$"))
    got = {r.i: (r.a, r.b) for r in rows.select("i", pages.printed_page(F.col("l")).alias("a"), pages.printed_page(F.col("l"), wide).alias("b")).collect()}
    assert got == {0: (12, 12345), 1: (None, None), 2: (None, None), 3: (None, None), 4: (3, 3)}
    plan = rows.select(pages.printed_page(F.col("l")))._jdf.queryExecution().analyzed().toString()
    assert "CASE WHEN (NOT" in plan  # a cast that fails, as of every line without a number, took most of a page's time
