"""Readers and writers of the engine's tables. Paths may be of any store that Spark reads."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators.chunking import STRATEGIES
from ..operators.ingest import repeated_ids, require_none
from ..operators.pages import contiguity
from ..operators.lexical import matching
from ..operators.vectors import Embedder, collection_name, cosine_search, embedded, index_report, with_pages
from ..schemas import CHUNK, MANIFEST_COLUMNS, PAGE, QUESTION_COLUMNS


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """All columns as strings, missing values empty, a byte order mark dropped; the named columns are required."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("emptyValue", "").option("nullValue", "\x00").csv(path)
    rows = rows.toDF(*(c.lstrip("﻿") for c in rows.columns))
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    return rows.na.fill("")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, MANIFEST_COLUMNS)


def manifest_row(manifest: DataFrame, document_id: str) -> dict[str, str]:
    """The one row of a document; an error unless there is exactly one."""
    rows = manifest.filter(F.col("document_id") == document_id).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{document_id!r} must occur once in the manifest")
    return rows[0].asDict()


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions with unique ids and readable evidence pages."""
    rows = read_csv(spark, path, QUESTION_COLUMNS)
    if rows.isEmpty():
        raise ValueError(f"{path} has no question")
    require_none(repeated_ids(rows, "question_id"), "question ids repeat")
    require_none(rows.filter(X.evidence_pages(F.col("evidence_pages")).isNull()).select("question_id"), "evidence pages can't be read")
    return rows


def json_lines(spark: SparkSession, schema: str, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): the objects of line-wise JSON, and the lines that are none of this schema, as file, at (the byte that the line's block begins at) and line.

    A line that isn't an object, has a value of another type, or lacks all columns is a reject; blank lines are nothing.
    """
    read = spark.read.schema(f"{schema}, _line string").option("columnNameOfCorruptRecord", "_line").json(list(paths))
    names = read.columns[:-1]
    whole = read.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"))
    broken = F.col("_line").isNotNull() | reduce(lambda a, b: a & b, (F.col(c).isNull() for c in names))
    rejects = whole.filter(broken).select(F.col("_file").alias("file"), F.col("_at").alias("at"), F.coalesce("_line", F.lit("{}")).alias("line"))
    return whole.filter(~broken).select(*names), rejects


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page rows; every line must be a page, and every document's pages must be 1..n."""
    rows, rejects = json_lines(spark, PAGE, path)
    require_none(rejects, "lines aren't pages")
    if rows.isEmpty():
        raise ValueError(f"{path} has no page")
    require_none(contiguity(rows).filter("not contiguous").select("document_id"), "pages aren't contiguous")
    return rows


def read_chunks(spark: SparkSession, *paths: str) -> DataFrame:
    """Chunk rows of one file, or of all that a pattern matches; every line must be a chunk with an id, and ids must be unique across them."""
    rows, rejects = json_lines(spark, CHUNK, *paths)
    require_none(rejects, "lines aren't chunks")
    require_none(rows.filter("chunk_id IS NULL OR trim(chunk_id) = ''").select("document_id", "text"), "chunks without an id")
    if rows.isEmpty():
        raise ValueError("no chunk")
    require_none(repeated_ids(rows, "chunk_id"), "chunk ids repeat")
    return rows


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def page_texts(files: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """document_id, pdf_page, text by a parser that the caller brings (no PDF library is required here)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, i, t) for p, c in zip(batch["path"], batch["content"], strict=True) for i, t in enumerate(extract(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["document_id", "pdf_page", "text"])

    return files.select("path", "content").mapInPandas(run, "document_id string, pdf_page int, text string")


def write_json(rows: DataFrame, path: str) -> None:
    """One object a line; an existing table is replaced when the new one is complete."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON document (an array of objects), which ``read_report`` reads."""
    whole = report.agg(F.to_json(F.collect_list(F.struct(*report.columns)), {"ignoreNullFields": "false", "pretty": "true"}).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)


def write_index(index: DataFrame, path: str) -> None:
    """The vector table, by document, so that a later write replaces only the documents that it holds."""
    index.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_id").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The vector table. Ids of documents are strings, also where they look like numbers."""
    found = spark.read.parquet(path).schema
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == "document_id" else f.dataType) for f in found])
    return spark.read.schema(schema).parquet(path)


def made_with(spark: SparkSession, path: str) -> Row | None:
    """embedder, dimensions of a vector table, or None if there is no such table."""
    note = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.metadata")
    if not note.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(note):
        return None
    return spark.read.schema("embedder string, dimensions int").json(f"{path}.metadata").first()


def search_index(questions: DataFrame, embedder: Embedder, folder: str, strategy: str, k: int = 5, document_id: str | None = None, **filters) -> DataFrame:
    """query_id, rank, score, and the chunk: its metadata, pages and text. The k most similar chunks of a stored table, as ``build_index`` writes it.

    questions: query_id, query. filters: as for ``matching``, where an empty code doesn't filter; document_id: reads that
    document's files alone. Only ids and vectors are scanned for the search; the rest is read for the hits. A blank query, a
    table that isn't there, or one of another embedder is an error. No question, or no chunk that agrees: no rows.
    """
    spark, path = questions.sparkSession, f"{folder}/{collection_name(strategy, embedder.name)}"
    known = made_with(spark, path)
    if known is None:
        raise ValueError(f"no vector table at {path}")
    if (known.embedder, known.dimensions) != (embedder.name, embedder.dimensions):
        raise ValueError(f"{path} was made with {known.embedder}, {known.dimensions}")
    require_none(questions.filter("query IS NULL OR trim(query) = ''").select("query_id"), "blank queries")
    table = matching(read_index(spark, path), **filters, blank_is_none=True)
    if document_id is not None:
        table = table.filter(F.col("document_id") == document_id)
    asked = embedder.embed(questions.select("query_id", F.col("query").alias("text"))).select("query_id", "embedding")
    hits = cosine_search(table.select("chunk_id", "embedding"), asked, k)
    return with_pages(hits.join(table.drop("embedding"), "chunk_id"))


def build_index(chunks: DataFrame, embedder: Embedder, folder: str, strategy: str) -> DataFrame:
    """Embeds chunks, replaces their documents in the table of this strategy and embedder, and reports on each document.

    chunks: as ``chunking.described`` makes them, of one strategy. A table of another embedder or other
    dimensions under the same name is an error, and so are vectors of other lengths and lost chunks.
    """
    spark, path = chunks.sparkSession, f"{folder}/{collection_name(strategy, embedder.name)}"
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    require_none(chunks.filter(~F.col("strategy").eqNullSafe(STRATEGIES[strategy])).select("chunk_id", "strategy"), "chunks of another strategy")
    require_none(repeated_ids(chunks, "chunk_id"), "chunk ids repeat")
    known = made_with(spark, path)
    if known is not None:
        if (known.embedder, known.dimensions) != (embedder.name, embedder.dimensions):
            raise ValueError(f"{path} was made with {known.embedder}, {known.dimensions}")
    else:
        spark.createDataFrame([(embedder.name, embedder.dimensions)], "embedder string, dimensions int").coalesce(1).write.json(f"{path}.metadata")
    write_index(embedded(chunks, embedder), path)
    table = read_index(spark, path)
    report = index_report(table.join(chunks.select("document_id").distinct(), "document_id", "left_semi"))
    require_none(report.filter((F.col("dimensions") != embedder.dimensions) | (F.col("most_dimensions") != embedder.dimensions)).select("document_id"), "vectors of other lengths")
    wanted = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    require_none(wanted.join(report, "document_id", "left").filter(~F.col("n").eqNullSafe(F.col("vectors"))).select("document_id"), "chunks were lost")
    total = table.count()
    return report.select(
        "document_id", F.lit(collection_name(strategy, embedder.name)).alias("collection"), F.lit(strategy).alias("strategy"), F.lit(embedder.name).alias("embedder"),
        "dimensions", F.col("vectors").alias("indexed_chunks"), F.lit(total).alias("total_chunks"),
    )


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)  # an array is a row for each of its objects


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Replaces a manifest folder as a whole: written beside it, then swapped in by renaming."""
    spark, staging = manifest.sparkSession, f"{path}.{uuid.uuid4().hex[:8]}"
    manifest.write.option("header", True).option("emptyValue", "").csv(staging)
    jvm = spark.sparkContext._jvm
    old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(staging)
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = jvm.org.apache.hadoop.fs.Path(f"{staging}.old")
    if fs.exists(old):
        fs.rename(old, aside)
    if not fs.rename(new, old):
        fs.rename(aside, old)
        raise OSError(f"{path} could not be replaced")
    fs.delete(aside, True)


def append_results(rows: DataFrame, path: str) -> None:
    """Finished questions, added to the results so far; ``evaluate.pending`` reads them to resume. A write that is repeated adds them again."""
    rows.write.mode("append").parquet(path)


def write_results(rows: DataFrame, path: str, batch: int) -> None:
    """Finished questions of a numbered batch. A batch that is written again replaces itself alone, so a run cut short is mended by its repetition."""
    if "batch" in rows.columns:
        raise ValueError("results have no column batch of their own")
    rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The last result of every question: that of its highest batch."""
    rows = spark.read.parquet(path)
    own = [c for c in rows.columns if c not in ("query_id", "batch")]
    return rows.groupBy("query_id").agg(F.max_by(F.struct(*own), "batch").alias("r")).select("query_id", "r.*")
