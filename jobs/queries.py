"""The jobs as queries: each runs twice into a folder of its own and returns its whole output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from evidentia.plans import sql
from evidentia.sources.scratch import shared_folder

from . import chunk_corpus, term_index


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def job1_chunk_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = chunk_corpus.Settings(documents=f"{sf_dir}/documents.parquet", output=folder(spark, "job1"))
    for _ in range(2):
        chunk_corpus.run(spark, settings)
    return chunk_corpus.corpus(spark, settings.output)


def job2_term_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = folder(spark, "job2")
    # a pattern: a file stream takes a folder or a pattern, and the table may be one file or a folder
    settings = term_index.Settings(documents=f"{sf_dir}/documents.parquet*", output=f"{where}/index", checkpoint=f"{where}/checkpoint")
    for _ in range(2):
        term_index.run(spark, settings)
    return term_index.terms(spark, settings.output)


def queries() -> dict:
    return {"job1_chunk_corpus": job1_chunk_corpus, "job2_term_index": job2_term_index}


def oracle_sql() -> dict[str, str]:
    pages = sql.FIXED.replace(sql.CHAPTERED, f"{sql.PARSED}, chaptered AS (SELECT * FROM parsed)")
    chunks = f"""WITH {pages}, of_pages AS (SELECT document_id, count(*) AS page_count, count(*) FILTER (len(flags) > 0) AS flagged_pages FROM parsed GROUP BY 1),
        of_chunks AS (SELECT document_id, count(*) AS chunk_count, count(*) FILTER (len(pages) > 1) AS cross_page FROM fixed GROUP BY 1)
        SELECT chunk_id, document_id, CAST(i AS INT) AS chunk_index, text, CAST(char_count AS INT) AS char_count, CAST(list_min(pages) AS INT) AS pdf_page_start, CAST(list_max(pages) AS INT) AS pdf_page_end,
            CAST(len(pages) AS INT) AS n_pages, chapter, CAST(n_chapters AS INT) AS n_chapters, substr(md5(document_id), 1, 1) AS shard, page_count, flagged_pages, chunk_count, cross_page
        FROM fixed JOIN of_pages USING (document_id) JOIN of_chunks USING (document_id)"""
    terms = f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, {sql.tokens("coalesce(text, '')")} AS t FROM documents),
        n AS (SELECT lang, count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS total_tokens FROM d GROUP BY 1)
        SELECT lang, token, count(DISTINCT doc_id) AS df, count(*) AS cf, any_value(n_docs) AS n_docs, any_value(total_tokens) AS total_tokens FROM (SELECT doc_id, lang, unnest(t) AS token FROM d) JOIN n USING (lang) GROUP BY lang, token"""
    return {"job1_chunk_corpus": chunks, "job2_term_index": terms}
