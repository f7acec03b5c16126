"""Manifest rows: registration checks, updates, states, and file fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LATIN, Lexicon
from ..functions import text as X
from ..schemas import GATES, TRANSITIONS


def fingerprints(files: DataFrame) -> DataFrame:
    """path, length and SHA-256 of binaryFile rows."""
    return files.select("path", "length", F.sha2("content", 256).alias("file_hash"))


def sampled_pages(n_pages: Column) -> Column:
    """The 0-based pages that an inspection reads: the first three, the middle, the last; those that exist."""
    wanted = F.array(F.lit(0), F.lit(1), F.lit(2), F.floor(n_pages / 2).cast("int"), (n_pages - 1).cast("int"))
    return F.array_sort(F.array_distinct(F.filter(wanted, lambda p: (p >= 0) & (p < n_pages))))


def inspect(pages: DataFrame, keywords: DataFrame, least: int = 200) -> DataFrame:
    """document_id, page_count, sample_chars, is_text, missing keywords, accepted.

    pages: document_id, pdf_page (from 1), text; keywords: document_id, keywords.
    """
    size = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("page_count"))
    sample = pages.join(size, "document_id").filter(F.array_contains(sampled_pages(F.col("page_count")), (F.col("pdf_page") - 1).cast("int")))
    text = sample.groupBy("document_id", "page_count").agg(F.array_sort(F.collect_list(F.struct("pdf_page", "text"))).alias("t"))
    out = text.withColumn("sample", F.array_join(F.transform("t", lambda x: F.coalesce(x.text, F.lit(""))), "\n")).join(keywords, "document_id")
    out = out.withColumn("sample_chars", X.compact_count(F.col("sample"))).withColumn("missing", F.filter("keywords", lambda k: ~F.contains(F.col("sample"), k)))
    out = out.withColumn("is_text", F.col("sample_chars") >= least)
    return out.select("document_id", "page_count", "sample_chars", "is_text", F.array_join("missing", ",").alias("missing"), (F.col("is_text") & (F.size("missing") == 0)).alias("accepted"))


def registered(manifest: DataFrame, accepted: DataFrame, lexicon: Lexicon = LATIN) -> DataFrame:
    """The manifest with the rows of accepted files filled in. accepted: document_id and the fields to set."""
    fields = [c for c in accepted.columns if c != "document_id"]
    new = accepted.select("document_id", *(F.col(c).cast("string").alias(f"_{c}") for c in fields), F.lit(True).alias("_new"))
    out = manifest.join(new, "document_id", "left")
    set_ = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in fields} | {"parse_status": F.when(F.col("_new"), F.lit("pending")).otherwise(F.col("parse_status"))}
    return out.withColumns(set_).select(manifest.columns)


def repeated_ids(rows: DataFrame, key: str) -> DataFrame:
    """Ids that occur more than once: empty if the table is valid."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def admitted(status: Column, stage: str) -> Column:
    """Whether a stage accepts a row in this state."""
    return status.isin(*GATES[stage])


def advanced(status: Column) -> Column:
    """The state that follows, or the same where none does."""
    return reduce(lambda rest, step: F.when(status == step[0], F.lit(step[1])).otherwise(rest), TRANSITIONS.items(), status)


def require_none(violations: DataFrame, message: str) -> None:
    """Raises if a table of violations has a row; five of them are named."""
    rows = violations.limit(5).collect()
    if rows:
        raise ValueError(f"{message}: {[r.asDict() for r in rows]}")
