"""Builds the chunk corpus that retrieval reads: raw pages to clean pages, chunks and a quality report.

Pages are the rows of a documents table, numbered within their source by doc_id. Margin lines go, chapters are carried
forward, and the pages are cut into chunks of the chosen strategy. Three tables are written under ``output``:

    pages/shard=../    clean page rows with their flags
    chunks/shard=../   chunks with their pages and chapter
    quality/           a row for each document: pages, flagged pages, chunks, chunks over page ends

``shard`` is the first hexadecimal digits of the MD5 of the document's name, so their number doesn't grow with the documents.
Every table is replaced as a whole by what the input holds, so a run that was cut short is mended by the next, and a second
run gives the same rows. Rows without a document or a number can't be placed and are counted as rejected; a number that
occurs twice in a document is an error before anything is written.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.config import ChunkConfig
from evidentia.operators import chunking, pages
from evidentia.operators.ingest import require_none

log = logging.getLogger("chunk_corpus")
PAGES = "document_id string, doc_id long, pdf_page int, printed_page int, chapter string, text string, char_count int, flags string, shard string"
CHUNKS = "chunk_id string, document_id string, chunk_index int, text string, char_count int, pdf_page_start int, pdf_page_end int, n_pages int, chapter string, n_chapters int, shard string"
QUALITY = "document_id string, page_count long, flagged_pages long, chunk_count long, cross_page long, min_chars int, max_chars int"


@dataclass(frozen=True)
class Settings:
    documents: str
    output: str
    strategy: str = "baseline"
    size: int = 800
    overlap: int = 150
    shard_digits: int = 1

    def __post_init__(self):
        if self.strategy not in chunking.STRATEGIES:
            raise ValueError(f"strategy must be one of {sorted(chunking.STRATEGIES)}")
        if not 1 <= self.shard_digits <= 3:
            raise ValueError("1 <= shard_digits <= 3 is required")


def sharded(rows: DataFrame, digits: int) -> DataFrame:
    return rows.withColumn("shard", F.substring(F.md5(F.col("document_id").cast("binary")), 1, digits))


def replace(rows: DataFrame, path: str, schema: str, by: str | None = None) -> DataFrame:
    """The rows as a table of this schema in place of what was there, and that table read back."""
    names = [c.split()[0] for c in schema.split(", ")]
    typed = rows.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")))
    writer = typed.select(*names).write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def run(spark: SparkSession, settings: Settings) -> dict[str, int]:
    """Builds clean pages, chunks and the quality report of all documents; returns the counts that it logs."""
    rows = spark.read.parquet(settings.documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("document_id"), "text")
    placed = rows.filter("doc_id IS NOT NULL AND document_id IS NOT NULL")
    counts = {"read": rows.count(), "rejected": rows.filter("doc_id IS NULL OR document_id IS NULL").count()}
    log.info("read %d rows of %s, %d of them without a document or a number", counts["read"], settings.documents, counts["rejected"])
    repeated = placed.groupBy("document_id", "doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    require_none(repeated.select("document_id", "doc_id"), "numbers repeat in a document")
    clean = pages.parse(pages.numbered(placed, "document_id", "doc_id"))
    clean = clean.withColumn("flags", F.array_join("quality_flags", ","))
    clean = replace(sharded(clean, settings.shard_digits), f"{settings.output}/pages", PAGES, "shard")
    config = ChunkConfig(size=settings.size, overlap=settings.overlap)
    made = chunking.fixed_chunks(clean, config) if settings.strategy == "baseline" else chunking.structured_chunks(clean, config)
    made = made.withColumns({"pdf_page_start": F.array_min("pdf_pages"), "pdf_page_end": F.array_max("pdf_pages"), "n_pages": F.size("pdf_pages"), "n_chapters": F.size("chapters")})
    chunks = replace(sharded(made, settings.shard_digits), f"{settings.output}/chunks", CHUNKS, "shard")
    by_pages = clean.groupBy("document_id").agg(F.count(F.lit(1)).alias("page_count"), F.count_if(F.col("flags") != "").alias("flagged_pages"))
    by_chunks = chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunk_count"), F.count_if(F.col("n_pages") > 1).alias("cross_page"), F.min("char_count").alias("min_chars"), F.max("char_count").alias("max_chars")
    )
    quality = by_pages.join(by_chunks, "document_id", "left").na.fill(0, ["chunk_count", "cross_page"])
    quality = replace(quality, f"{settings.output}/quality", QUALITY)
    total = quality.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("page_count", "flagged_pages", "chunk_count")), F.count(F.lit(1)).alias("documents")).first()
    counts |= {"documents": total.documents, "pages": total.page_count, "flagged": total.flagged_pages, "chunks": total.chunk_count}
    log.info("wrote %d pages (%d flagged) and %d chunks of %d documents to %s", total.page_count, total.flagged_pages, total.chunk_count, total.documents, settings.output)
    if counts["pages"] + counts["rejected"] != counts["read"]:
        raise ValueError(f"{counts['read']} rows were read, but {counts['pages']} pages written and {counts['rejected']} rejected")
    return counts


def corpus(spark: SparkSession, output: str) -> DataFrame:
    """Every chunk as written, with what the report says of its document."""
    quality = spark.read.schema(QUALITY).parquet(f"{output}/quality").select("document_id", "page_count", "flagged_pages", "chunk_count", "cross_page")
    return spark.read.schema(CHUNKS).parquet(f"{output}/chunks").join(quality, "document_id")


if __name__ == "__main__":
    from jobs.settings import command_line

    command_line(run, Settings, "chunk_corpus")
