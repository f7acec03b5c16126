"""The registered queries of the retrieval engine, over the tables of TESTDATA.md.

Roles: a page is a row of documents, its document the source, its page number the place by doc_id;
questions are the rows of benchmark; vectors are embeddings, with the label as their filter; turns of
conversations stand for pages where something is carried forward. The word lists are LATIN.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LATIN, AnswerConfig
from ..functions import text as X
from ..operators import answer, chunking, codes, drivers, evaluate, fusion, ingest, lexical, pages, postings, vectors
from ..operators.median import exact_median
from ..sources import tables
from ..sources.scratch import shared_folder, stored
from . import sql

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("document_id"), "text", "lang")
    return pages.numbered(docs, "document_id", "doc_id")


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.parse(page_rows(spark, sf_dir))


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source")


def question_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.col("item_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), lang.alias("lang"))


def six(column: str | Column, name: str) -> Column:
    return lexical.rounded(F.col(column) if isinstance(column, str) else column, 6).alias(name)


def csv(column: str | Column) -> Column:
    return F.array_join((F.col(column) if isinstance(column, str) else column).cast("array<string>"), ",")


def md5(column: str) -> Column:
    return F.md5(F.col(column).cast("binary"))


# pages


def compact_chars(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.compact_count(F.col("text")).alias("compact_chars"))


def normalized_text(spark, sf_dir):
    text = X.join_lines(X.lines_of(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.lines_of(F.col("text"))).alias("n_lines"), F.md5(text.cast("binary")).alias("text_md5"))


def margin_lines(spark, sf_dir):
    return pages.margin_lines(page_rows(spark, sf_dir), 0.02).select("document_id", "line", "pages", "threshold")


def margin_removed_pages(spark, sf_dir):
    rows = page_rows(spark, sf_dir)
    out = pages.without_margins(rows, pages.margin_lines(rows, 0.02))
    return out.select("doc_id", F.size("lines").alias("n_lines"), F.md5(F.array_join("lines", "\n").cast("binary")).alias("lines_md5"))


def printed_page(spark, sf_dir):
    number = pages.printed_page(X.lines_of(F.regexp_replace("text", "[a-zA-Z.,]+", "")))
    return table(spark, sf_dir, "documents").select("doc_id", number.alias("printed_page"))


def chapter_fill(spark, sf_dir):
    rows = page_rows(spark, sf_dir).withColumn("lines", X.lines_of(F.col("text")))
    return pages.chapters(rows)


def unit_context_fill(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("pdf_page"), "text")
    import dataclasses

    return pages.unit_context(turns, dataclasses.replace(LATIN, unit_pattern="the ([a-z]+)"))


def page_quality_flags(spark, sf_dir):
    return parsed(spark, sf_dir).select("doc_id", "char_count", csv("quality_flags").alias("flags"))


def flag_histogram(spark, sf_dir):
    return pages.flag_histogram(parsed(spark, sf_dir))


def parse_quality(spark, sf_dir):
    return pages.parse_report(parsed(spark, sf_dir))


def flagged_pages(spark, sf_dir):
    return pages.flagged_pages(parsed(spark, sf_dir)).select("document_id", "pdf_page", csv("quality_flags").alias("flags"), "char_count")


def audit_samples(spark, sf_dir):
    return pages.audit_samples(parsed(spark, sf_dir))


def page_contiguity(spark, sf_dir):
    return pages.contiguity(page_rows(spark, sf_dir))


def turn_contiguity(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), (F.col("turn") + 1).alias("pdf_page"))
    return pages.contiguity(turns)


# ingest


def duplicate_ids(spark, sf_dir):
    return ingest.repeated_ids(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")), "key")


def fingerprint(spark, sf_dir):
    html = F.col("html").cast("binary")
    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.length(html).alias("length"), html.alias("content"))
    return ingest.fingerprints(files).withColumnRenamed("path", "page_id")


def registration_check(spark, sf_dir):
    rows = page_rows(spark, sf_dir)
    keywords = rows.select("document_id").distinct().withColumn("keywords", F.array(F.lit("the"), F.lit("der"), F.lit("License")))
    return ingest.inspect(rows, keywords)


def registered_manifest(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit("").alias("page_count"), F.lit("parsed").alias("parse_status"))
    new = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("document_id"), (F.col("quality") + 1).alias("page_count"))
    return ingest.registered(files, new)


def lifecycle_gate(spark, sf_dir):
    states = F.array(*map(F.lit, ("pending", "parsed", "audited", "baseline_chunked", "structured_chunked")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.element_at(states, (F.col("doc_id") % 5 + 1).cast("int")).alias("status"))
    gates = [ingest.admitted(F.col("status"), s).alias(s) for s in ("parse", "audit", "fixed_chunks", "structured_chunks")]
    return rows.select("doc_id", "status", *gates, ingest.advanced(F.col("status")).alias("next_status"))


# chunks


def _chaptered(spark, sf_dir):
    rows = page_rows(spark, sf_dir).withColumn("lines", X.lines_of(F.col("text")))
    return rows.drop("lines").join(pages.chapters(rows), ["document_id", "pdf_page"])


def _reported(spark, sf_dir):
    """Pages of documents whose company, code and year are made from their names."""
    name = F.col("document_id")
    rows = _chaptered(spark, sf_dir).withColumn("printed_page", (F.col("pdf_page") + 4).cast("int"))
    return rows.withColumns({
        "company": F.upper(name), "stock_code": F.lpad(F.length(name).cast("string"), 6, "0"), "report_year": (F.length(name) + 2000).cast("int"),
        "report_type": F.lit("annual"), "source_file": F.concat(name, F.lit(".pdf")), "source_url": F.concat(F.lit("https://example.com/"), name),
    })


def _manifest(rows, status):
    return rows.select("document_id").distinct().select("document_id", F.lit("").alias("page_count"), F.lit(status).alias("parse_status"), F.lit("").alias("notes"))


def parse_driver(spark, sf_dir):
    rows = page_rows(spark, sf_dir)
    counted = rows.groupBy("document_id").agg(F.count(F.lit(1)).cast("string").alias("page_count"))
    manifest = counted.select("document_id", "page_count", F.lit("pending").alias("parse_status"), F.lit("").alias("notes"))
    return drivers.parse_reports(manifest, rows)[2]


def chunk_driver(spark, sf_dir):
    rows = _reported(spark, sf_dir)
    return drivers.chunk_reports(_manifest(rows, "audited"), rows, "baseline")[2]


def chunk_metadata(spark, sf_dir):
    rows = _reported(spark, sf_dir)
    out = vectors.metadata(chunking.described(chunking.fixed_chunks(rows), rows, "baseline"))
    return out.drop("text")


def printed_pages(spark, sf_dir):
    rows = _reported(spark, sf_dir)
    out = chunking.described(chunking.structured_chunks(rows), rows, "structured")
    return out.select("chunk_id", "strategy", "pdf_page_start", "pdf_page_end", csv("printed_pages").alias("printed_pages"), "report_year")


def index_build(spark, sf_dir):
    rows = _reported(spark, sf_dir)
    chunks = stored(chunking.described(chunking.fixed_chunks(rows), rows, "baseline"), "chunks")
    folder = f"{shared_folder(spark)}/evidentia-index-{uuid.uuid4().hex[:12]}"
    return tables.build_index(chunks, vectors.hashed_embedder(64), folder, "baseline")


def index_search_top5(spark, sf_dir):
    """The five nearest chunks of a stored table for every benchmark item, by hashed n-grams (which SQL can't express)."""
    rows = _reported(spark, sf_dir)
    chunks = stored(chunking.described(chunking.fixed_chunks(rows), rows, "baseline"), "chunks")
    folder = f"{shared_folder(spark)}/evidentia-index-{uuid.uuid4().hex[:12]}"
    tables.build_index(chunks, vectors.hashed_embedder(64), folder, "baseline")
    hits = tables.search_index(question_rows(spark, sf_dir), vectors.hashed_embedder(64), folder, "baseline")
    return hits.select("query_id", "rank", "chunk_id", "document_id", six("score", "score"), csv("pdf_pages").alias("pages"))


def fixed_chunks(spark, sf_dir):
    out = chunking.fixed_chunks(_chaptered(spark, sf_dir))
    return out.select("chunk_id", "char_count", md5("text").alias("text_md5"), csv("pdf_pages").alias("pages"), "chapter", F.size("chapters").alias("n_chapters"))


def fixed_chunk_quality(spark, sf_dir):
    return chunking.fixed_quality(chunking.fixed_chunks(_chaptered(spark, sf_dir)))


def structured_chunks(spark, sf_dir):
    out = chunking.structured_chunks(_chaptered(spark, sf_dir))
    return out.select("chunk_id", "char_count", md5("text").alias("text_md5"), csv("pdf_pages").alias("pages"), "chapter")


def structured_quality(spark, sf_dir):
    return chunking.structured_quality(chunking.structured_chunks(_chaptered(spark, sf_dir)))


def strategy_delta(spark, sf_dir):
    rows = stored(_reported(spark, sf_dir), "reported")  # both strategies read it
    _, fixed, manifest = drivers.chunk_reports(_manifest(rows, "audited"), rows, "baseline")
    _, structured, _ = drivers.chunk_reports(manifest, rows, "structured")
    return chunking.compared(fixed, structured)


# retrieval


def token_stats(spark, sf_dir):
    out = lexical.token_stats(chunk_rows(spark, sf_dir), ["lang"])
    return out.select("lang", "n_docs", "total_tokens", six("avgdl", "avgdl"))


def _hits(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", "chunk_id", six("score", "score"))


def bm25_top5(spark, sf_dir):
    return _hits(lexical.bm25(chunk_rows(spark, sf_dir), question_rows(spark, sf_dir)))


def bm25_top5_filtered(spark, sf_dir):
    return _hits(lexical.bm25(chunk_rows(spark, sf_dir), question_rows(spark, sf_dir), by=["lang"]))


def _index_hits(spark, sf_dir, by=()):
    where = f"{shared_folder(spark)}/evidentia-postings-{uuid.uuid4().hex[:12]}"
    return _hits(postings.search(spark, postings.build(chunk_rows(spark, sf_dir), where, by), question_rows(spark, sf_dir))[0])


def bm25_index_top5(spark, sf_dir):
    """As bm25_top5, from a stored index of which only the blocks that matter are read."""
    return _index_hits(spark, sf_dir)


def bm25_index_top5_filtered(spark, sf_dir):
    return _index_hits(spark, sf_dir, ("lang",))


def token_cosine_top5(spark, sf_dir):
    return _hits(lexical.token_cosine(chunk_rows(spark, sf_dir), question_rows(spark, sf_dir)))


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    return rows, rows.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")


def vector_top5(spark, sf_dir):
    return _hits(vectors.cosine_search(*_vectors(spark, sf_dir)))


def vector_top5_filtered(spark, sf_dir):
    return _hits(vectors.cosine_search(*_vectors(spark, sf_dir), by=["label"]))


def vector_index_recall(spark, sf_dir):
    """Questions, hits, and whether a stored index of codes finds nine in ten of the exact search's hits."""
    rows, asked = _vectors(spark, sf_dir)
    size = rows.select(F.max(F.size("embedding"))).first()[0]
    index = codes.build(rows, f"{shared_folder(spark)}/evidentia-codes-{uuid.uuid4().hex[:12]}", size, cells=64)
    hit = lambda hits, name: hits.select("query_id", "chunk_id", F.lit(1).alias(name))
    both = hit(codes.search(index, asked, 5), "found").join(hit(vectors.cosine_search(rows, asked, 5), "exact"), ["query_id", "chunk_id"], "full")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.agg(
        F.countDistinct(F.when(F.col("found") == 1, F.col("query_id"))).alias("questions"), total("found").alias("hits"),
        (total(F.col("found") * F.col("exact")) >= 0.9 * total("exact")).alias("recall_reached"),
    )


def hashed_embedding(spark, sf_dir):
    out = vectors.hashed_embedding(table(spark, sf_dir, "benchmark"), 768)
    return out.select("item_id", F.size("embedding").alias("dimensions"), six(vectors.norm(F.col("embedding")), "norm"), md5_of("embedding"))


def md5_of(column: str) -> Column:
    return F.md5(F.array_join(F.transform(column, lambda v: F.round(v, 9).cast("string")), ",").cast("binary")).alias("digest")


def index_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("document_id"), "vec_id", "embedding")
    new = rows.filter("document_id < '3'")
    return vectors.index_report(vectors.upsert(rows, new))


def _pool(spark, sf_dir, k=120):
    chunks, questions = chunk_rows(spark, sf_dir), question_rows(spark, sf_dir)
    asked, tokens = questions.withColumn("query", fusion.expand(F.col("query"))), lexical.index(chunks)
    fused = fusion.rrf(lexical.token_cosine(chunks, questions, k, table=tokens), lexical.bm25(chunks, asked, k, table=tokens))
    return chunks, questions, stored(fused, "fused")


def rrf(spark, sf_dir):
    _, _, fused = _pool(spark, sf_dir)
    return fused.select("query_id", "rank", "chunk_id", "vector_rank", "bm25_rank", six("rrf_score", "rrf_score"))


def expand_query(spark, sf_dir):
    out = fusion.features(question_rows(spark, sf_dir))
    return out.select("query_id", "expanded", F.size("terms").alias("n_terms"))


def rerank_features(spark, sf_dir):
    chunks, questions, fused = _pool(spark, sf_dir)
    out = fusion.rerank(fused, questions, chunks)
    names = ("term_coverage", "phrase_score", "numeric_score", "multi_metric_score", "intent_alignment_score")
    return out.select("query_id", "chunk_id", "pre_rerank_rank", *(six(n, n) for n in names))


def _hybrid(spark, sf_dir, by=None):
    chunks, questions = chunk_rows(spark, sf_dir), question_rows(spark, sf_dir)
    return chunks, questions, fusion.hybrid(chunks, questions, by=by)


def _reranked(hits):
    return hits.select("query_id", "rank", "chunk_id", "pre_rerank_rank", six("rerank_score", "rerank_score"))


def hybrid_top5(spark, sf_dir):
    return _reranked(_hybrid(spark, sf_dir)[2])


def hybrid_top5_filtered(spark, sf_dir):
    """Every question searches the chunks of its own language, in both branches."""
    return _reranked(_hybrid(spark, sf_dir, ["lang"])[2])


def hit_projection(spark, sf_dir):
    id_ = F.col("chunk_id")
    chunks = chunk_rows(spark, sf_dir)
    named = chunks.select(
        "chunk_id", F.upper("source").alias("company"), F.col("lang").alias("stock_code"), (id_ % 7 + 2000).cast("int").alias("report_year"), F.lit("unknown").alias("chapter"),
        (id_ + 1).cast("int").alias("pdf_page_start"), (id_ + 2).cast("int").alias("pdf_page_end"), F.array(id_ + 1, id_ + 2).cast("array<int>").alias("pdf_pages"),
        F.concat("source", F.lit(".pdf")).alias("source_file"), F.concat(F.lit("https://example.com/"), "source").alias("source_url"), "text",
    )
    out = lexical.described(lexical.bm25(chunks, question_rows(spark, sf_dir)), named)
    return out.withColumns({"pdf_pages": csv("pdf_pages"), "text": md5("text")})


# answers


def scope_gate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", answer.asks_advice(F.col("text")).alias("refused"))


def evidence_gate(spark, sf_dir):
    _, questions, hits = _hybrid(spark, sf_dir)
    return answer.evidence_gate(questions, hits, 0.5).select("query_id", six("max_coverage", "max_coverage"), "refusal_reason")


def _cited(spark, sf_dir):
    _, questions, hits = _hybrid(spark, sf_dir)
    return questions, answer.citations(hits, questions)


def _citations(cited):
    return cited.select("query_id", "citation_id", "chunk_id", "quote", six("retrieval_score", "retrieval_score"))


def citations(spark, sf_dir):
    return _citations(_cited(spark, sf_dir)[1])


def quote_window(spark, sf_dir):
    terms = X.salient(F.col("reference"), LATIN.ignored)
    return _asked_documents(spark, sf_dir).select("doc_id", X.quote(F.col("text"), terms, AnswerConfig().max_quote_chars).alias("quote"))


def evidence_answer(spark, sf_dir):
    _, cited = _cited(spark, sf_dir)
    return answer.evidence_answers(cited)


def _prompt(questions, cited):
    return answer.prompts(cited, questions).select("query_id", md5("prompt").alias("prompt_md5"), F.length("prompt").alias("length"))


def prompt(spark, sf_dir):
    return _prompt(*_cited(spark, sf_dir))


def _stand_in():
    """In the place of a language model: tells the prompt's length, and raises for a fifth of the lengths."""

    def model(prompt: str) -> str:
        if len(prompt) % 5 == 0:
            raise TimeoutError("no reply")
        return f"{len(prompt)} characters [E1]"

    return model


def generated_answers(spark, sf_dir):
    """Answers of a generator that fails for some questions: their errors are rows."""
    questions, cited = _cited(spark, sf_dir)
    return answer.model_generator("stand-in", _stand_in)(answer.prompts(cited, questions)).select("query_id", "answer", "error")


def citation_validate(spark, sf_dir):
    _, cited = _cited(spark, sf_dir)
    valid = cited.groupBy("query_id").agg(F.collect_set("citation_id").alias("valid_ids"))
    made = F.element_at(F.array(F.lit("yes [E1]"), F.lit("both [E1] and [E9]"), F.lit("none at all"), F.lit(f"{LATIN.insufficient.split('|')[0]}")), (F.col("query_id") % 4 + 1).cast("int"))
    return answer.checked(valid.withColumn("answer", made))


def answers(spark, sf_dir):
    """The whole pipeline, with evidence-only answers."""
    chunks, questions = chunk_rows(spark, sf_dir), question_rows(spark, sf_dir)
    out = answer.answer(questions, lambda q: fusion.hybrid(chunks, q), chunks)
    return out.select("query_id", "status", "refusal_reason", md5("answer").alias("answer_md5"))


# evaluation


def evidence_pages(spark, sf_dir):
    id_ = F.col("doc_id").cast("string")
    value = F.element_at(
        F.array(id_, F.concat(id_, F.lit("-"), (F.col("doc_id") + 2).cast("string")), F.concat(F.lit("7|"), id_, F.lit(" | 7")), F.concat((F.col("doc_id") + 3).cast("string"), F.lit("-"), id_)),
        (F.col("doc_id") % 4 + 1).cast("int"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", csv(X.evidence_pages(value)).alias("pages"))


def _gold(spark, sf_dir):
    """Gold evidence: the documents that hold a question's text. A question's longest inner word picks the candidates."""
    chunks, questions = chunk_rows(spark, sf_dir), question_rows(spark, sf_dir)
    inner = X.let(X.tokens(F.col("query")), lambda t: F.slice(t, 2, F.greatest(F.size(t) - 2, F.lit(0))))  # whole words of any text that holds the question
    longest = F.get(F.array_sort(F.transform(inner, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), F.lit(0)).t
    first = questions.select("query_id", "query", longest.alias("token"))
    tokens = chunks.select("chunk_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("token"))
    maybe = tokens.join(first, "token").join(chunks.select("chunk_id", "text"), "chunk_id").filter(F.col("text").contains(F.col("query")))
    return maybe.groupBy("query_id").agg(F.collect_set("chunk_id").alias("gold_pages"))


def _methods(spark, sf_dir):
    chunks, questions, fused = _pool(spark, sf_dir)
    branch = lambda hits, name: hits.select("query_id", F.lit(name).alias("method"), "rank", F.array("chunk_id").alias("pdf_pages"))
    vector = fused.filter("vector_rank is not null").select("query_id", F.col("vector_rank").alias("rank"), "chunk_id")
    bm = fused.filter("bm25_rank is not null").select("query_id", F.col("bm25_rank").alias("rank"), "chunk_id")
    hits = branch(vector, "vector").union(branch(bm, "bm25")).union(branch(fused, "hybrid_rrf")).union(branch(fusion.rerank(fused, questions, chunks), "hybrid_rerank"))
    return evaluate.first_ranks(hits, _gold(spark, sf_dir), methods=("vector", "bm25", "hybrid_rrf", "hybrid_rerank"))


def first_rank(spark, sf_dir):
    return _methods(spark, sf_dir)


def retrieval_misses(spark, sf_dir):
    return evaluate.missed(_methods(spark, sf_dir))


def method_compare(spark, sf_dir):
    out = evaluate.lift(evaluate.metrics(_methods(spark, sf_dir)), "vector")
    return out.select("method", "questions", *(six(c, c) for c in ("recall_at_3", "recall_at_5", "mrr", "lift")))


def acceptance(spark, sf_dir):
    return evaluate.accepted(evaluate.metrics(_methods(spark, sf_dir))).select("accepted", six("best_recall", "best_recall"))


def number_norm(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.numbers(F.col("text")), "|").alias("numbers"))


def _asked_documents(spark, sf_dir):
    """doc_id, text, reference: every document, and the whole text of the question that it is dealt by its number."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("_item"), F.col("text").alias("reference"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").crossJoin(F.broadcast(asked.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("_of"))))  # one row
    dealt = docs.withColumn("_item", F.pmod("doc_id", "_of")).join(asked, "_item", "left")
    return dealt.select("doc_id", "text", F.coalesce("reference", F.lit("")).alias("reference"))


STATES = ("answered", "refused", "error", "evidence_only")


def _cases(spark, sf_dir):
    """A question's text is the reference, a document's text the answer."""
    turn = F.col("doc_id")
    rows = _asked_documents(spark, sf_dir).select(
        turn.alias("query_id"), F.element_at(F.array(*map(F.lit, STATES)), (turn % 4 + 1).cast("int")).alias("status"),
        F.col("reference").alias("reference_answer"), F.col("text").alias("answer"),
        F.array(turn % 7).alias("gold_pages"), F.array(turn % 5, turn % 3).alias("cited_pages"), ((turn % 13) / 4.0).alias("seconds"),
    )
    return evaluate.answer_cases(rows)


def answer_case(spark, sf_dir):
    return _cases(spark, sf_dir).select("query_id", "status", "page_hit", six("number_recall", "number_recall"), "proxy")


def answer_summary(spark, sf_dir):
    out = evaluate.answer_summary(_cases(spark, sf_dir))
    rates = ("page_hit_rate", "full_recall_rate", "mean_number_recall", "proxy_rate", "mean_seconds", "median_seconds", "max_seconds")
    return out.select("cases", "completed", "answered", "refused", "errors", "failures", *(six(c, c) for c in rates))


def answer_failures(spark, sf_dir):
    return evaluate.failures(_cases(spark, sf_dir))


def event_medians(spark, sf_dir):
    """The exact median of a measure, for each kind of event."""
    out = exact_median(table(spark, sf_dir, "events"), F.col("value"), ["event_type"])
    return out.select("event_type", "n", six("median", "median"))


def single_method(spark, sf_dir):
    hits = lexical.bm25(chunk_rows(spark, sf_dir), question_rows(spark, sf_dir), 10)
    out = evaluate.single_method(hits.select("query_id", F.lit("bm25").alias("method"), "rank", F.array("chunk_id").alias("pdf_pages")), _gold(spark, sf_dir), 10)
    return out.select("method", "questions", *(six(c, c) for c in ("recall_at_3", "recall_at_5", "mrr")))


def evaluation_round(spark, sf_dir):
    """Labelled documents have been answered; the others are answered by their own text, which is an error for some."""
    turn = F.col("doc_id")
    questions = _asked_documents(spark, sf_dir).select(turn.alias("query_id"), F.col("reference").alias("reference_answer"), F.array(turn % 7).alias("gold_pages"))
    done = table(spark, sf_dir, "labels").select(
        turn.alias("query_id"), F.lit("answered").alias("status"), F.lit(True).alias("page_hit"), F.lit(1.0).alias("number_recall"), F.lit(True).alias("proxy"),
        F.lit(0.5).alias("seconds"), F.when(F.col("quality") == 0, F.lit("timeout")).alias("error"),
    )
    given = table(spark, sf_dir, "documents").filter(turn % 11 != 0).select(
        turn.alias("query_id"), F.lit("answered").alias("status"), F.col("text").alias("answer"), F.array(turn % 5, turn % 3).alias("cited_pages"),
        ((turn % 13) / 4.0).alias("seconds"), F.when(turn % 6 == 0, F.lit("refused connection")).alias("error"),
    )
    out = evaluate.evaluation_round(questions, done, lambda todo: given.join(todo.select("query_id"), "query_id", "left_semi"))
    return out.withColumn("number_recall", six("number_recall", "number_recall"))


def resume_pending(spark, sf_dir):
    questions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"))
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"), F.when(F.col("quality") == 0, F.lit("timeout")).alias("error"))
    return evaluate.pending(questions, done)


NAMES = (
    "compact_chars normalized_text margin_lines margin_removed_pages printed_page chapter_fill unit_context_fill page_quality_flags flag_histogram parse_quality parse_driver "
    "audit_samples page_contiguity turn_contiguity duplicate_ids fingerprint registration_check registered_manifest lifecycle_gate fixed_chunks fixed_chunk_quality "
    "structured_chunks structured_quality strategy_delta chunk_driver chunk_metadata printed_pages token_stats bm25_top5 bm25_top5_filtered token_cosine_top5 vector_top5 "
    "vector_top5_filtered hashed_embedding index_upsert index_build index_search_top5 rrf expand_query rerank_features hybrid_top5 hybrid_top5_filtered hit_projection scope_gate evidence_gate "
    "citations quote_window evidence_answer prompt citation_validate answers generated_answers evidence_pages first_rank method_compare single_method acceptance number_norm answer_case "
    "answer_summary answer_failures evaluation_round resume_pending retrieval_misses flagged_pages event_medians bm25_index_top5 bm25_index_top5_filtered vector_index_recall"
).split()


def queries() -> dict[str, Query]:
    return {name: globals()[name] for name in NAMES}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
