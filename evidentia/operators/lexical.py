"""BM25 over a token table, for all questions at once.

The token table is written once, without a shuffle: one row for each chunk, with its distinct tokens
and their counts. Statistics are those of the filtered corpus: N, mean length and document frequency
are taken within ``by``, the columns that a question and a chunk have to agree on. Chunks are scored
where they lie (``blocks``); text never travels.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..sources.scratch import stored
from .blocks import best_by_terms, ranked, rounded, slices

__all__ = ["bm25", "index", "matching", "rounded", "token_cosine", "token_stats"]
WORD, RUN = re.compile(X.WORDS), re.compile(X.CJK)


def matching(chunks: DataFrame, company: str | None = None, stock_code: str | None = None, report_year: int | None = None, blank_is_none: bool = False) -> DataFrame:
    """Chunks of a company, code and year, as far as they are given; pushed down to the scan.

    With blank_is_none an empty code doesn't filter, which is how the vector branch reads it.
    """
    if blank_is_none and not stock_code:
        stock_code = None
    for column, value in (("company", company), ("stock_code", stock_code), ("report_year", report_year)):
        if value is not None:
            chunks = chunks.filter(F.col(column) == value)
    return chunks


#: What a hit says of its chunk.
HIT = ("company", "stock_code", "report_year", "chapter", "pdf_page_start", "pdf_page_end", "pdf_pages", "source_file", "source_url", "text")


def described(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, rank, chunk_id, score (to six places) and HIT: the hits with what the chunks say of themselves."""
    return hits.select("query_id", "rank", "chunk_id", rounded(F.col("score"), 6).alias("score")).join(chunks.select("chunk_id", *HIT), "chunk_id").select("query_id", "rank", "chunk_id", "score", *HIT)


def tokens_of(text: str, grams: int = 4) -> list[str]:
    """As ``functions.text.tokens`` of the NFKC form."""
    low = (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()
    out = WORD.findall(low)
    if not low.isascii():
        out += [run[i : i + n] for run in RUN.findall(low) for n in range(1, grams + 1) for i in range(len(run) - n + 1)]
    return out


def tokenised(chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """chunk_id, by, terms, counts, length and norm (of the counts) of every chunk. Null text has no tokens and no length: it counts for N, not for the mean."""
    kept = chunks.select("chunk_id", *(by or []), "text")
    schema = T.StructType([*kept.schema.fields[:-1]]).add("terms", T.ArrayType(T.StringType())).add("counts", T.ArrayType(T.IntegerType())).add("length", "long").add("norm", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                found = [Counter(tokens_of(t or "")) for t in texts]
                counts = [np.fromiter(c.values(), np.int64, len(c)) for c in found]
                new = [pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([c.astype(np.int32) for c in counts], pa.list_(pa.int32()))]
                new += [pa.array([None if t is None else int(c.sum()) for t, c in zip(texts, counts, strict=True)], pa.int64()), pa.array([float(np.sqrt((c * c).sum())) for c in counts], pa.float64())]
                yield pa.record_batch([*part.columns[:-1], *new], [*part.schema.names[:-1], "terms", "counts", "length", "norm"])

    return kept.mapInArrow(run, schema)


def index(chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What ``tokenised`` gives, written once."""
    return stored(tokenised(chunks, by), "tokens")


def token_stats(chunks: DataFrame, by: list[str] | None = None, table: DataFrame | None = None) -> DataFrame:
    """N, total and mean length of each filter group."""
    rows = index(chunks, by) if table is None else table
    return rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("length").alias("total_tokens"), F.avg("length").alias("avgdl"))


def asked_terms(questions: DataFrame, by: list[str]) -> DataFrame:
    """query_id, by, token, qf. A blank question is an error."""
    blank = questions.filter(F.coalesce(X.strip(F.col("query")), F.lit("")) == "").select("query_id").limit(5).collect()
    if blank:
        raise ValueError(f"blank questions: {[r[0] for r in blank]}")
    plain = questions.select("query_id", *by, X.nfkc()(F.col("query")).alias("query"))
    return plain.select("query_id", *by, F.explode(X.tokens(F.col("query"))).alias("token")).groupBy("query_id", *by, "token").agg(F.count(F.lit(1)).alias("qf"))


def _stats(rows: DataFrame, by: list[str], *names: str) -> dict[tuple, tuple]:
    """One row for each value of ``by``, on the driver: those are the filters' values, not data."""
    return {tuple(r[c] for c in by): tuple(r[n] for n in names) for r in rows.collect()}


def bm25(chunks: DataFrame, questions: DataFrame, k: int = 5, k1: float = 1.5, b: float = 0.75, by: list[str] | None = None, table: DataFrame | None = None) -> DataFrame:
    """query_id, rank, chunk_id, score: chunks with a positive score, best first.

    chunks: chunk_id, text and ``by``; questions: query_id, query and ``by``; table: the chunks' token table, if it is at hand.
    """
    if k <= 0 or k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("k > 0, k1 > 0 and 0 <= b <= 1 are required")
    by = by or []
    table = index(chunks, by) if table is None else table
    asked = asked_terms(questions, by)
    corpus = token_stats(chunks, by, table)
    df = table.select(*by, F.explode("terms").alias("token")).join(asked.select(*by, "token").distinct(), [*by, "token"], "left_semi")
    df = df.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("df"))
    weighted = asked.join(df, [*by, "token"])
    weighted = weighted.join(corpus, by) if by else weighted.crossJoin(F.broadcast(corpus))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = stored(weighted.select("query_id", *by, "token", (F.col("qf") * idf).alias("w")), "weights")

    def factor(count: np.ndarray, part: pa.RecordBatch, row: np.ndarray, group: tuple) -> np.ndarray:
        length = part.column("length").to_numpy(zero_copy_only=False)[row]
        return count * (k1 + 1) / (count + k1 * (1 - b + b * length / max(group[0], 1.0)))

    scored = best_by_terms(table, weights, factor, _stats(corpus, by, "avgdl"), k, by)
    return ranked(scored, "query_id", k).select("query_id", "rank", "chunk_id", "score")


def token_cosine(chunks: DataFrame, questions: DataFrame, k: int = 5, by: list[str] | None = None, table: DataFrame | None = None) -> DataFrame:
    """Cosine of token counts: the vector branch where no embedding model is at hand. Arguments as for bm25."""
    by = by or []
    table = index(chunks, by) if table is None else table
    asked = asked_terms(questions, by)
    size = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qf") * F.col("qf")).cast("double")).alias("nq"))
    weights = stored(asked.join(size, "query_id").select("query_id", *by, "token", (F.col("qf") / F.col("nq")).alias("w")), "weights")
    groups = _stats(weights.select(*by, F.lit(1).alias("one")).distinct(), by, "one")

    def factor(count: np.ndarray, part: pa.RecordBatch, row: np.ndarray, group: tuple) -> np.ndarray:
        return count / part.column("norm").to_numpy(zero_copy_only=False)[row]

    return ranked(best_by_terms(table, weights, factor, groups, k, by), "query_id", k).select("query_id", "rank", "chunk_id", "score")
