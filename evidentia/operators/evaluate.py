"""Retrieval and answer metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .median import exact_median


def first_ranks(hits: DataFrame, gold: DataFrame, top: int = 5, methods: tuple[str, ...] | None = None) -> DataFrame:
    """query_id, method, first_rank: the first of the top hits whose pages overlap the gold pages, or null.

    hits: query_id, method, rank, pdf_pages; gold: query_id, gold_pages. Questions without gold are left out.
    methods: those to report on, by default all that the hits name.
    """
    known = gold.filter(F.size("gold_pages") > 0)
    methods = methods or tuple(r.method for r in hits.select("method").distinct().collect())  # a few names
    every = known.select("query_id", F.explode(F.array(*map(F.lit, methods)).cast("array<string>")).alias("method"))
    found = hits.filter(F.col("rank") <= top).join(known, "query_id").filter(F.arrays_overlap("pdf_pages", "gold_pages"))
    return every.join(found.groupBy("query_id", "method").agg(F.min("rank").alias("first_rank")), ["query_id", "method"], "left")


def single_method(hits: DataFrame, gold: DataFrame, top_k: int) -> DataFrame:
    """metrics of one method whose reciprocal ranks count as far as top_k, which has to be five or more."""
    if top_k < 5:
        raise ValueError("top_k >= 5 is required")
    return metrics(first_ranks(hits, gold, top_k))


def metrics(ranks: DataFrame) -> DataFrame:
    """method, questions, recall_at_3, recall_at_5, mrr."""
    hit = lambda k: F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0))
    return ranks.groupBy("method").agg(
        F.count(F.lit(1)).alias("questions"), hit(3).alias("recall_at_3"), hit(5).alias("recall_at_5"), F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))).alias("mrr")
    )


def accepted(table: DataFrame, least: float = 0.8) -> DataFrame:
    """One row: whether any method reaches the recall that is asked for."""
    return table.agg(F.coalesce(F.bool_or(F.col("recall_at_5") >= least), F.lit(False)).alias("accepted"), F.max("recall_at_5").alias("best_recall"))


def lift(table: DataFrame, base: str) -> DataFrame:
    """Recall@5 of each method less that of the base method."""
    one = table.filter(F.col("method") == base).select(F.col("recall_at_5").alias("_base"))
    return table.crossJoin(F.broadcast(one)).withColumn("lift", F.col("recall_at_5") - F.col("_base")).drop("_base")  # one row


def answer_cases(rows: DataFrame) -> DataFrame:
    """query_id, page_hit, number_recall (null without reference numbers), proxy.

    rows: query_id, status, reference_answer, answer, gold_pages, cited_pages.
    """
    out = rows.withColumn("_want", X.numbers(F.col("reference_answer"))).withColumn("_have", X.numbers(F.coalesce("answer", F.lit(""))))
    have = F.col("_have")
    recall = F.when(F.size("_want") > 0, F.size(F.filter("_want", lambda n: F.array_contains(have, n))) / F.size("_want"))
    out = out.withColumn("number_recall", recall).withColumn("page_hit", F.coalesce(F.arrays_overlap("gold_pages", "cited_pages"), F.lit(False)))
    same = F.when(F.size("_want") > 0, F.col("number_recall") == 1.0).otherwise(X.loose(F.coalesce("answer", F.lit(""))).contains(X.loose(F.col("reference_answer"))))
    return out.withColumn("proxy", (F.col("status") == "answered") & F.col("page_hit") & same).drop("_want", "_have")


def answer_summary(cases: DataFrame) -> DataFrame:
    """One row: counts by status; rates and latencies over completed cases, those without an error.

    full_recall_rate is over the completed cases with reference numbers. Rates without a case are 0, latencies null.
    """
    done = F.col("status") != "error"
    share = lambda what, of: F.count_if(of & what) / F.greatest(F.count_if(of), F.lit(1))
    counts = cases.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "answered").alias("answered"), F.count_if(F.col("status") == "refused").alias("refused"),
        F.count_if(~done).alias("errors"), share(F.col("page_hit"), done).alias("page_hit_rate"), share(F.col("number_recall") == 1.0, done & F.col("number_recall").isNotNull()).alias("full_recall_rate"),
        F.avg(F.when(done, F.col("number_recall"))).alias("mean_number_recall"), share(F.col("proxy"), done).alias("proxy_rate"),
        F.count_if(~done | ~F.coalesce("proxy", F.lit(False))).alias("failures"), F.avg(F.when(done, F.col("seconds"))).alias("mean_seconds"), F.max(F.when(done, F.col("seconds"))).alias("max_seconds"),
    )
    middle = exact_median(cases, F.when(done, F.col("seconds"))).select(F.col("median").alias("median_seconds"))
    return counts.crossJoin(F.broadcast(middle))  # one row


def failures(cases: DataFrame) -> DataFrame:
    """query_id, status of the cases that failed: with an error, or without a right answer. One row each, as they may be many."""
    return cases.filter((F.col("status") == "error") | ~F.coalesce("proxy", F.lit(False))).select("query_id", "status")


def missed(ranks: DataFrame, top: int = 5) -> DataFrame:
    """method, query_id of the questions whose pages aren't among a method's first hits."""
    return ranks.filter(F.coalesce("first_rank", F.lit(top + 1)) > top).select("method", "query_id")


def pending(questions: DataFrame, done: DataFrame, retry: list[str] | None = None) -> DataFrame:
    """Questions without a finished result: those never run, with an error, or named for a retry."""
    finished = done.filter("error is null")
    if retry:
        finished = finished.filter(~F.col("query_id").isin(*retry))
    return questions.join(finished.select("query_id"), "query_id", "left_anti")


def evaluation_round(questions: DataFrame, done: DataFrame, run, retry: list[str] | None = None) -> DataFrame:
    """query_id, status, page_hit, number_recall, proxy, seconds, error: finished cases as they are, and the pending ones after a run.

    questions: query_id, reference_answer, gold_pages; done: as this returns it; run(pending questions) ->
    query_id, status, answer, cited_pages, seconds, error. A question without a result, or with an error, is
    an error of its own and pending in the next round; it stops no other one.
    """
    columns = ("query_id", "status", "page_hit", "number_recall", "proxy", "seconds", "error")
    todo = pending(questions, done, retry)
    made = todo.join(run(todo), "query_id", "left").withColumn("error", F.when(F.col("status").isNull(), F.coalesce("error", F.lit("no result"))).otherwise(F.col("error")))
    made = made.withColumn("status", F.when(F.col("error").isNotNull(), F.lit("error")).otherwise(F.col("status")))
    fine = F.col("error").isNull()
    made = made.withColumn("answer", F.when(fine, F.col("answer"))).withColumn("cited_pages", F.when(fine, F.col("cited_pages")))
    kept = done.join(todo.select("query_id"), "query_id", "left_anti").join(questions.select("query_id"), "query_id", "left_semi")
    new = answer_cases(made).withColumn("number_recall", F.when(F.col("error").isNull(), F.col("number_recall")))
    return kept.select(*columns).unionByName(new.select(*columns))


def document_label(questions: DataFrame) -> DataFrame:
    """One row: the questions' document, or ``multi_document`` if there are several."""
    return questions.agg(F.when(F.countDistinct("document_id") == 1, F.min("document_id")).otherwise(F.lit("multi_document")).alias("document_id"))
