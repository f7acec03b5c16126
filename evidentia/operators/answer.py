"""Gates, citations, prompts, evidence-only answers, and the checks of generated ones."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EVIDENCE_ONLY, LATIN, RULES, AnswerConfig, Lexicon
from ..functions import text as X
from ..sources.scratch import stored
from .vectors import loaded


#: What a citation says of its chunk, besides the quote.
METADATA = ("company", "stock_code", "report_year", "chapter", "pdf_pages", "source_file", "source_url")


def asks_advice(question: Column, lexicon: Lexicon = LATIN) -> Column:
    """The scope gate: investment advice is refused before anything is searched."""
    return question.rlike("|".join(lexicon.advice))


def evidence_gate(questions: DataFrame, hits: DataFrame, least: float = 0.08) -> DataFrame:
    """query_id, max_coverage, refusal_reason of every question: null if there is evidence to answer from."""
    best = hits.groupBy("query_id").agg(F.max("term_coverage").alias("max_coverage"), F.count(F.lit(1)).alias("hits"))
    out = questions.select("query_id").join(best, "query_id", "left")
    reason = F.when(F.coalesce("hits", F.lit(0)) == 0, F.lit("no_retrieval_results")).when(F.coalesce("max_coverage", F.lit(0.0)) < least, F.lit("low_evidence_relevance"))
    return out.select("query_id", F.coalesce("max_coverage", F.lit(0.0)).alias("max_coverage"), reason.alias("refusal_reason"))


def citations(hits: DataFrame, questions: DataFrame, config: AnswerConfig | None = None, lexicon: Lexicon = LATIN, units: DataFrame | None = None) -> DataFrame:
    """query_id, citation_id, chunk_id, quote, retrieval_score, unit_context of the hits worth citing.

    hits: query_id, rank, chunk_id, score, text (and, for units, document_id and pdf_pages). The first
    hit always stays; later ones need the given share of its score. units: document_id, pdf_page,
    unit_context; a citation has that of the first of its pages that has one. Company, year, chapter,
    pages and source go with a citation, as far as the hits have them.
    """
    config = config or AnswerConfig()
    first = hits.groupBy("query_id", "chunk_id").agg(F.min_by(F.struct(*[c for c in hits.columns if c not in ("query_id", "chunk_id")]), "rank").alias("h")).select("query_id", "chunk_id", "h.*")
    by_rank = Window.partitionBy("query_id").orderBy("rank")
    best = F.first("score").over(by_rank.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lead = F.row_number().over(by_rank)
    kept = first.withColumn("_best", best).withColumn("_lead", lead)
    kept = kept.filter((F.col("_lead") == 1) | (F.col("_best") <= 0) | (F.col("score") >= F.col("_best") * config.relative_score))
    kept = kept.withColumn("citation_id", F.row_number().over(by_rank)).filter(F.col("citation_id") <= config.max_citations)
    asked = questions.select("query_id", "query", X.salient(F.col("query"), lexicon.ignored).alias("_salient"))
    out = kept.drop("query").join(asked, "query_id").withColumn("quote", X.quote(F.col("text"), F.col("_salient"), config.max_quote_chars))
    if units is None:
        out = out.withColumn("unit_context", F.lit(None).cast("string"))
    else:
        pages = out.select("query_id", "chunk_id", "document_id", F.posexplode("pdf_pages").alias("_at", "pdf_page"))
        found = pages.join(units.filter("unit_context is not null"), ["document_id", "pdf_page"]).groupBy("query_id", "chunk_id").agg(F.min_by("unit_context", "_at").alias("unit_context"))
        out = out.join(found, ["query_id", "chunk_id"], "left")
    known = [c for c in METADATA if c in out.columns]
    return out.select("query_id", "citation_id", "chunk_id", *known, "quote", F.col("score").alias("retrieval_score"), "unit_context")


def evidence_answers(cited: DataFrame, lexicon: Lexicon = LATIN) -> DataFrame:
    """query_id, answer: the quotes, numbered, without a word that isn't evidence."""
    line = F.concat(F.lit(f"[{lexicon.citation_label}"), F.col("citation_id").cast("string"), F.lit("] "), F.col("quote"))
    rows = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("citation_id", line.alias("line")))).alias("c"))
    return rows.select("query_id", F.concat_ws("\n\n", F.lit(EVIDENCE_ONLY), F.transform("c", lambda x: x.line)).alias("answer"))


def prompts(cited: DataFrame, questions: DataFrame, lexicon: Lexicon = LATIN) -> DataFrame:
    """query_id, prompt: the rules, the question, and the numbered evidence. cited may have company, report_year, pdf_pages."""
    known = lambda name, label: [F.lit(label), F.col(name).cast("string")] if name in cited.columns else []
    head = [F.lit(f"[{lexicon.citation_label}"), F.col("citation_id").cast("string"), F.lit("] "), *known("company", "公司："), *known("report_year", "；年度："), *known("pdf_pages", "；PDF页码：")]
    unit = F.when(F.col("unit_context").isNotNull(), F.concat(F.lit("单位上下文："), "unit_context", F.lit("。"))).otherwise(F.lit(""))
    block = F.concat(*head, F.lit("\n"), unit, F.lit("\n"), F.col("quote"))
    rows = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("citation_id", block.alias("block")))).alias("c")).join(questions.select("query_id", "query"), "query_id")
    return rows.select("query_id", F.concat(F.lit("\n".join(RULES) + "\n\n问题："), "query", F.lit("\n\n"), F.array_join(F.transform("c", lambda x: x.block), "\n\n"), F.lit("\n")).alias("prompt"))


def model_generator(name: str, load: Callable[[], Callable[[str], str]], partitions: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """A generator by a language model that ``load`` returns, called once in each Python worker: a function from a prompt to an answer.

    It takes query_id, prompt and returns query_id, answer, seconds, error. What the model raises, and an answer that
    isn't text, is the error of its own question, with a null answer; it stops no other question. A null prompt is an
    error without a call. What ``load`` raises stops the job, as no question could be answered. partitions: over how many
    tasks questions are dealt; by default as they come.
    """

    def generate(prompts: DataFrame) -> DataFrame:
        rows = prompts.select("query_id", "prompt")
        rows = rows if partitions is None else rows.repartition(partitions, "query_id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                model = loaded(f"generator {name}", load)
                answers, seconds, errors = [], [], []
                for prompt in batch.column("prompt").to_pylist():
                    made, error, began = None, None, time.perf_counter()
                    try:
                        if prompt is None:
                            raise ValueError("no prompt")
                        made = model(prompt)
                        if not isinstance(made, str):
                            raise TypeError(f"the answer is {type(made).__name__}, not text")
                    except Exception as problem:  # the question's own, whatever it is
                        made, error = None, f"{type(problem).__name__}: {problem}"
                    answers.append(made)
                    seconds.append(time.perf_counter() - began)
                    errors.append(error)
                columns = [batch.column("query_id"), pa.array(answers, pa.string()), pa.array(seconds, pa.float64()), pa.array(errors, pa.string())]
                yield pa.record_batch(columns, ["query_id", "answer", "seconds", "error"])

        return rows.mapInArrow(run, f"query_id {rows.schema['query_id'].dataType.simpleString()}, answer string, seconds double, error string")

    return generate


def checked(answers: DataFrame, lexicon: Lexicon = LATIN) -> DataFrame:
    """query_id, status, problem of generated answers. answers: query_id, answer, valid_ids.

    No citation and words of insufficiency: refused. No citation otherwise, or one that doesn't exist: an error.
    """
    cited = F.transform(F.regexp_extract_all("answer", F.lit(lexicon.citation), F.lit(1)), lambda v: v.try_cast("int"))
    out = answers.withColumn("cited", F.array_sort(F.array_distinct(cited)))
    none = F.size("cited") == 0
    refused = none & F.col("answer").rlike(lexicon.insufficient)
    stray = F.size(F.array_except("cited", "valid_ids")) > 0
    status = F.when(refused, F.lit("refused")).when(none | stray, F.lit("error")).otherwise(F.lit("answered"))
    problem = F.when(refused, F.lit("generator_evidence_insufficient")).when(none, F.lit("no_citation")).when(stray, F.lit("unknown_citation"))
    return out.select("query_id", status.alias("status"), problem.alias("problem"), F.array_join(F.col("cited").cast("array<string>"), ",").alias("cited"))


def answer(questions: DataFrame, search, chunks: DataFrame, config: AnswerConfig | None = None, lexicon: Lexicon = LATIN, generate=None) -> DataFrame:
    """query_id, status, answer, refusal_reason: gates, search, citations, prompt, generator, checks.

    search(questions) -> reranked hits with text; generate(prompts) -> (query_id, answer, and error if it has one)
    is the plug-in for a language model, asked once for each question. Without it, answers are evidence alone. A
    question with an error, or without an answer, has the status ``error`` and stops no other. Refused questions aren't searched.
    """
    config = config or AnswerConfig()
    scoped = questions.withColumn("_advice", asks_advice(F.col("query"), lexicon))
    open_ = scoped.filter("not _advice").drop("_advice")
    hits = stored(search(open_), "hits")  # read by the gate and by the citations
    gate = evidence_gate(open_, hits, config.least_coverage)
    passed = gate.filter("refusal_reason is null").select("query_id")
    cited = citations(hits.join(passed, "query_id", "left_semi"), open_, config, lexicon)
    text = lambda v: F.lit(v).cast("string")
    if generate is None:
        done = evidence_answers(cited, lexicon).select("query_id", F.lit("evidence_only").alias("status"), "answer", text(None).alias("refusal_reason"))
    else:
        made = generate(prompts(cited, open_, lexicon))
        made = made.select("query_id", "answer", F.col("error") if "error" in made.columns else text(None).alias("error"))
        made = stored(made, "generated")  # read by the checks, and a model may answer otherwise when asked again
        made = passed.join(made, "query_id", "left").withColumn("error", F.when(F.col("answer").isNull(), F.coalesce("error", F.lit("no answer"))).otherwise(F.col("error")))
        failed = made.filter("error is not null")
        made = made.filter("error is null").drop("error")
        valid = cited.groupBy("query_id").agg(F.collect_set("citation_id").alias("valid_ids"))
        verdict = checked(made.join(valid, "query_id"), lexicon)
        done = made.join(verdict, "query_id").select("query_id", "status", "answer", F.col("problem").alias("refusal_reason"))
        done = done.union(failed.select("query_id", F.lit("error"), text(None), F.concat(F.lit("generator: "), "error")))
    low = gate.filter("refusal_reason is not null").select("query_id", F.lit("refused").alias("status"), text(None).alias("answer"), "refusal_reason")
    out = scoped.filter("_advice").select("query_id", F.lit("refused").alias("status"), text(None).alias("answer"), F.lit("out_of_scope").alias("refusal_reason"))
    return done.union(low).union(out)
