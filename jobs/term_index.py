"""Keeps the lexical index current as documents arrive: a file stream that takes only what is new.

Each micro-batch tokenises its documents once and writes, under ``output``,

    index/batch=N/    doc_id, lang, terms, counts, length: the documents of the batch
    deltas/batch=N/   lang, token, df, cf: what the batch adds to the statistics, less what the documents that it
                      replaces had added; the row without a token has the documents and their tokens

and after the stream the totals go to ``terms/as_of=N/``: the totals before, and the deltas since. A batch's folders are
overwritten when Spark repeats a batch, and a batch sees the index of earlier batches alone, so a repeated run gives the same
rows; totals are made anew where they are missing. A run without new files changes nothing. The checkpoint is the stream's own.

A document that comes again replaces the earlier one. Of rows of one batch that share a doc_id, the longest text stays, of
equals the greatest. Rows without a doc_id are counted and left out. Null text is empty, null lang is ''.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import lexical

log = logging.getLogger("term_index")
DOCUMENTS = "doc_id long, text string, lang string"
INDEX = "doc_id long, lang string, terms array<string>, counts array<int>, length long"
DELTAS = "lang string, token string, df long, cf long"


@dataclass(frozen=True)
class Settings:
    documents: str
    output: str
    checkpoint: str
    files_per_batch: int = 1000

    def __post_init__(self):
        if self.files_per_batch < 1:
            raise ValueError("files_per_batch must be positive")


def latest_of(rows: DataFrame) -> DataFrame:
    """One row of each document of a batch."""
    rows = rows.filter("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
    best = rows.groupBy("doc_id").agg(F.max(F.struct(F.length("text").alias("n"), "text", "lang")).alias("x"))
    return best.select(F.col("doc_id").alias("chunk_id"), "x.lang", "x.text")


def batches(spark: SparkSession, path: str, schema: str, column: str) -> DataFrame | None:
    """A table of folders ``column=N``, or None before the first."""
    try:
        return spark.read.schema(f"{schema}, {column} long").parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def statistics(index: DataFrame, sign: int) -> DataFrame:
    """lang, token, df, cf of some rows of the index, times a sign; with the row of each language's documents and tokens."""
    tokens = index.select("lang", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("lang", F.col("x.terms").alias("token"), F.lit(sign).cast("long").alias("df"), (F.col("x.counts") * sign).cast("long").alias("cf"))
    whole = index.select("lang", F.lit(None).cast("string").alias("token"), F.lit(sign).cast("long").alias("df"), (F.col("length") * sign).alias("cf"))
    return tokens.union(whole)


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang", "token").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def take(spark: SparkSession, rows: DataFrame, number: int, output: str) -> None:
    """Writes the index and the deltas of one batch."""
    made = lexical.tokenised(latest_of(rows), ["lang"]).select(F.col("chunk_id").alias("doc_id"), "lang", "terms", "counts", "length")
    path = f"{output}/index/batch={number}"
    made.write.mode("overwrite").parquet(path)
    new = spark.read.schema(INDEX).parquet(path)
    delta = statistics(new, 1)
    before = batches(spark, f"{output}/index", INDEX, "batch").filter(F.col("batch") < number)
    seen = before.join(new.select("doc_id"), "doc_id", "left_semi")
    last = seen.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    delta = delta.union(statistics(seen.join(last, ["doc_id", "batch"]), -1))
    delta = summed(delta).filter("df <> 0 OR cf <> 0")
    delta.write.mode("overwrite").parquet(f"{output}/deltas/batch={number}")
    log.info("batch %d: read %d rows, wrote %d documents", number, rows.count(), new.count())


def total(spark: SparkSession, output: str) -> int | None:
    """Brings the totals up to the last batch and returns its number; None if there was no batch yet."""
    deltas = batches(spark, f"{output}/deltas", DELTAS, "batch")
    number = deltas.agg(F.max("batch")).first()[0] if deltas is not None else None
    if number is None:
        return None
    older = batches(spark, f"{output}/terms", DELTAS, "as_of")
    since = older.filter(F.col("as_of") < number).agg(F.max("as_of")).first()[0] if older is not None else None
    rows = deltas.filter(F.col("batch") > (-1 if since is None else since)).drop("batch")
    if since is not None:
        rows = rows.union(older.filter(F.col("as_of") == since).drop("as_of"))
    summed(rows).filter("df > 0").write.mode("overwrite").parquet(f"{output}/terms/as_of={number}")
    return number


def run(spark: SparkSession, settings: Settings) -> dict[str, int]:
    """Indexes the documents that came since the last run and brings the totals up to date; returns the counts that it logs."""
    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", settings.files_per_batch).parquet(settings.documents)
    done: list[int] = []

    def write(rows: DataFrame, number: int) -> None:
        take(rows.sparkSession, rows, number, settings.output)
        done.append(number)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", settings.checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    number = total(spark, settings.output)
    counts = {"batches": len(done), "terms": 0, "documents": 0}
    if number is not None:
        found = terms(spark, settings.output)
        counts |= {"terms": found.count(), "documents": found.groupBy("lang").agg(F.first("n_docs").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]}
    log.info("took %d batches of %s; %d terms in %d documents with words as of batch %s in %s", counts["batches"], settings.documents, counts["terms"], counts["documents"], number, settings.output)
    return counts


def terms(spark: SparkSession, output: str) -> DataFrame:
    """lang, token, df, cf, n_docs, total_tokens as of the last batch: what BM25 needs to know of a corpus."""
    rows = batches(spark, f"{output}/terms", DELTAS, "as_of")
    last = rows.agg(F.max("as_of")).first()[0]
    rows = rows.filter(F.col("as_of") == last).drop("as_of")
    whole = rows.filter("token IS NULL").select("lang", F.col("df").alias("n_docs"), F.col("cf").alias("total_tokens"))
    return rows.filter("token IS NOT NULL").join(whole, "lang")


if __name__ == "__main__":
    from jobs.settings import command_line

    command_line(run, Settings, "term_index")
