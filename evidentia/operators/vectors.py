"""Exact cosine search, hashed n-gram vectors, and the vector table.

Search scores vectors where they lie, for a block of questions of a checked size at a time (``blocks``),
within a filter (``by``) those that agree with the question on its columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .blocks import best_by_cosine, ranked


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    return X.let(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a))


def cosine_search(vectors: DataFrame, questions: DataFrame, k: int = 5, by: list[str] | None = None) -> DataFrame:
    """query_id, rank, chunk_id, score: the k most similar chunks of each question.

    vectors: chunk_id, embedding and ``by``; questions: query_id, embedding and ``by``. Vectors that
    are null, zero, not finite or of another length take no part.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    return ranked(best_by_cosine(vectors, questions, k, by or []), "query_id", k).select("query_id", "rank", "chunk_id", "score")


def gram_numbers(grams: np.ndarray) -> np.ndarray:
    """The first eight bytes of each one's BLAKE2b digest, as numbers."""
    return np.array([int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big") for g in grams], dtype=np.uint64)


def hash_vectors(texts: list[str], dimensions: int, least: int = 1, most: int = 3) -> np.ndarray:
    """Signed counts of hashed character n-grams, at unit length, a row for each text. A batch's distinct n-grams are hashed once."""
    plain = ["".join(t.split()).lower() for t in texts]
    grams, row = [], []
    for i, t in enumerate(plain):
        own = [t[j : j + n] for n in range(least, most + 1) for j in range(len(t) - n + 1)]
        grams += own
        row += [i] * len(own)
    code, distinct = pd.factorize(np.array(grams, dtype=object))
    value = gram_numbers(distinct)
    place, sign = (value % np.uint64(dimensions)).astype(np.int64), np.where(value % np.uint64(2) == 1, 1.0, -1.0)
    out = np.bincount(np.array(row, dtype=np.int64) * dimensions + place[code], weights=sign[code], minlength=len(texts) * dimensions).reshape(len(texts), dimensions) if grams else np.zeros((len(texts), dimensions))
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, length, out=out, where=length > 0)


def hash_vector(text: str, dimensions: int, least: int = 1, most: int = 3) -> np.ndarray:
    """The hashed n-gram vector of one text."""
    return hash_vectors([text], dimensions, least, most)[0]


def hashed_embedding(texts: DataFrame, dimensions: int = 768, column: str = "text") -> DataFrame:
    """Adds ``embedding``. The hash isn't among Spark's functions, so batches go through Arrow."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = [hash_vectors([t or "" for t in batch.iloc[i : i + 64]], dimensions) for i in range(0, len(batch), 64)]
            yield pd.Series([v for part in parts for v in part])

    return texts.withColumn("embedding", embed(F.col(column)))


def upsert(existing: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """All rows of the documents in ``new`` replaced, the others kept."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def index_report(index: DataFrame, key: str = "document_id") -> DataFrame:
    """Vectors and dimensions of each document."""
    return index.groupBy(key).agg(F.count(F.lit(1)).alias("vectors"), F.min(F.size("embedding")).alias("dimensions"), F.max(F.size("embedding")).alias("most_dimensions"))


def collection_name(strategy: str, embedder: str) -> str:
    """One table for each pair of strategy and embedder."""
    return f"annual_reports_{strategy}_{embedder}".replace("-", "_")


@dataclass(frozen=True)
class Embedder:
    """A plug-in: its name, its dimensions, and a function that adds ``embedding`` to rows with ``text``."""

    name: str
    dimensions: int
    embed: Callable[[DataFrame], DataFrame]


def hashed_embedder(dimensions: int = 768) -> Embedder:
    return Embedder(f"hashed_ngrams_{dimensions}", dimensions, lambda rows: hashed_embedding(rows, dimensions))


#: Models of this process by embedder: a worker loads one once, whatever tasks it runs.
_MODELS: dict[str, Callable[[list[str]], np.ndarray]] = {}


def loaded(name: str, load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable[[list[str]], np.ndarray]:
    """The worker's model of this name. A function of the module, so that tasks share the module's models and not a copy of them."""
    if name not in _MODELS:
        _MODELS[name] = load()
    return _MODELS[name]


def runs_of(sizes: np.ndarray, budget: int) -> list[np.ndarray]:
    """Places of texts of like size, in groups whose padded size (the largest times their number) fits a budget; one text at least."""
    order, out, begin = np.argsort(sizes, kind="stable"), [], 0
    for i in range(1, len(order) + 1):
        if i == len(order) or sizes[order[i]] * (i - begin + 1) > budget:
            out.append(order[begin:i])
            begin = i
    return out if len(order) else []


def model_embedder(name: str, dimensions: int, load: Callable[[], Callable[[list[str]], np.ndarray]], budget: int = 16_384, slack: float = 1e-3) -> Embedder:
    """An embedder by a model that ``load`` returns, called once in each Python worker: a function from texts to a matrix.

    Texts go to the model in groups of like length of at most ``budget`` words with padding, and whole. A matrix of another
    shape, a component that isn't finite, or a vector whose length is off 1 by more than ``slack`` stops the job with the
    embedder's name. Null text has a null embedding.
    """

    def embed(rows: DataFrame) -> DataFrame:
        schema = ", ".join(f"`{n}` {kind}" for n, kind in rows.dtypes) + ", embedding array<double>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                model = loaded(name, load)
                texts = batch.column("text").to_pylist()
                known = np.array([i for i, t in enumerate(texts) if t is not None], dtype=np.int64)
                found: list = [None] * len(texts)
                for group in runs_of(np.array([max(1, len(texts[i].split())) for i in known], dtype=np.int64), budget):
                    at = known[group]
                    made = np.asarray(model([texts[i] for i in at]), dtype=np.float64)
                    if made.shape != (len(at), dimensions):
                        raise ValueError(f"{name} gave {made.shape} for {len(at)} texts of {dimensions} dimensions")
                    if not np.isfinite(made).all() or (np.abs(np.sqrt((made * made).sum(axis=1)) - 1) > slack).any():
                        raise ValueError(f"{name} gave vectors that aren't of unit length")
                    for i, v in zip(at, made, strict=True):
                        found[i] = v
                yield pa.record_batch([*batch.columns, pa.array(found, pa.list_(pa.float64()))], [*batch.schema.names, "embedding"])

        return rows.mapInArrow(run, schema)

    return Embedder(name, dimensions, embed)


def metadata(chunks: DataFrame) -> DataFrame:
    """chunk_id, the twelve scalars that the vector table keeps of a chunk, and its text."""
    pages = F.concat(F.lit("["), F.array_join(F.col("pdf_pages").cast("array<string>"), ", "), F.lit("]")).alias("pdf_pages_json")
    return chunks.select(
        "chunk_id", "document_id", "company", "stock_code", F.col("report_year").cast("int").alias("report_year"), "report_type", "strategy",
        F.coalesce("chapter", F.lit("unknown")).alias("chapter"), "pdf_page_start", "pdf_page_end", pages, "source_file", "source_url", "text",
    )


def embedded(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """The rows of the vector table for these chunks."""
    return embedder.embed(metadata(chunks))


def with_pages(hits: DataFrame) -> DataFrame:
    """Hits of the vector table with ``pdf_pages`` read back from the list that it keeps as JSON; no list, or a broken one, is an empty one."""
    return hits.withColumn("pdf_pages", F.coalesce(F.from_json("pdf_pages_json", "array<int>"), F.array().cast("array<int>"))).drop("pdf_pages_json")
