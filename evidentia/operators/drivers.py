"""Stages of a document's life as a whole: gate, work, check, report, and the manifest's next state.

Each driver takes all documents at once and raises before anything is written if a document isn't
admitted, and before the state moves on if its pages don't add up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LATIN, ChunkConfig, Lexicon
from ..sources.scratch import stored
from . import chunking, pages
from .ingest import admitted, advanced, require_none


def gate(manifest: DataFrame, rows: DataFrame, stage: str) -> None:
    """An error for documents of the rows that the manifest lacks, or has in a state which the stage doesn't admit."""
    found = rows.select("document_id").distinct().join(manifest.select("document_id", "parse_status"), "document_id", "left")
    require_none(found.filter(~F.coalesce(admitted(F.col("parse_status"), stage), F.lit(False))), f"not admitted to {stage}")


def moved(manifest: DataFrame, report: DataFrame, note: str, state: str | None = None) -> DataFrame:
    """The manifest with the next state (or the one named) and a note for the documents of a report."""
    done = report.select("document_id", F.expr(note).alias("_note"))
    out = manifest.join(done, "document_id", "left")
    next_state = F.lit(state) if state else advanced(F.col("parse_status"))
    set_ = {"parse_status": F.when(F.col("_note").isNotNull(), next_state).otherwise(F.col("parse_status"))}
    if "notes" in manifest.columns:
        set_["notes"] = F.coalesce("_note", "notes")
    return out.withColumns(set_).select(manifest.columns)


def parse_reports(manifest: DataFrame, raw: DataFrame, lexicon: Lexicon = LATIN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, report, manifest) of the raw pages of pending documents; page counts have to be the manifest's."""
    gate(manifest, raw, "parse")
    found = stored(pages.parse(raw, lexicon), "pages")
    report = stored(pages.parse_report(found), "parse-report")
    wanted = report.join(manifest.select("document_id", F.col("page_count").try_cast("long").alias("wanted")), "document_id")
    require_none(wanted.filter(~F.col("wanted").eqNullSafe(F.col("page_count"))).select("document_id", "wanted", "page_count"), "page counts differ from the manifest")
    return found, report, moved(manifest, report, "concat(page_count, ' pages parsed')", "parsed")


def chunk_reports(manifest: DataFrame, rows: DataFrame, strategy: str, config: ChunkConfig | None = None, lexicon: Lexicon = LATIN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, report, manifest) of parsed pages; strategy: baseline or structured. The report has the pages' count, which ``chunking.compared`` compares."""
    fixed = strategy == "baseline"
    gate(manifest, rows, "fixed_chunks" if fixed else "structured_chunks")
    made = chunking.fixed_chunks(rows, config, lexicon) if fixed else chunking.structured_chunks(rows, config, lexicon)
    chunks = chunking.described(made, rows, strategy)  # of stored chunks: what is joined to them moves when it is written
    quality = chunking.fixed_quality(made) if fixed else chunking.structured_quality(made, lexicon)
    report = stored(quality.join(rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("page_count")), "document_id"), f"{strategy}-report")
    return chunks, report, moved(manifest, report, "concat(chunk_count, ' chunks')", "baseline_chunked" if fixed else "structured_chunked")
