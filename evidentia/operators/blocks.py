"""The k best chunks of every question, where questions are a stated set and chunks are any number.

Questions come to the tasks in blocks of a checked size, as weights of terms or as a matrix. A task
reads its chunks in slices, scores a slice for all questions of the block at once, and sends a
question's k best of each slice on. So chunks aren't shuffled, no pair of a question and a chunk leaves
its task unless it is among the best there, and one scan serves a whole block of questions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Scores that agree to so many places tie, so that the order of a sum doesn't decide a rank.
PLACES = 9
#: Weights (or vector components) of a block of questions, and scores of a slice, at most.
BLOCK, SLICE = 4_000_000, 500_000
#: Bytes of text that a Python worker takes from a batch at a time, about.
TEXT = 1 << 20


def slices(batch: pa.RecordBatch, column: str = "text", size: int = TEXT) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``size`` bytes of a text column, one row at least: what is made of texts grows with a slice, not with Spark's batches."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, end - at)
        at = end


def rounded(column, places: int = PLACES):
    """Half up, the same in every engine."""
    return F.floor(column * F.lit(float(10**places)) + F.lit(0.5)) / F.lit(float(10**places))


def ranked(scored: DataFrame, key: str, k: int, item: str = "chunk_id") -> DataFrame:
    """Adds rank by score, ties to the lesser id, and keeps the first k."""
    order = Window.partitionBy(key).orderBy(F.desc(rounded(F.col("score"))), item)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def firsts(scores: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(question, column) of each question's k best scores, ties to the lesser id; none under its floor, which rises."""
    grid = np.floor(scores * 10.0**PLACES + 0.5)
    if scores.shape[1] > k:
        floor[:] = np.maximum(floor, np.partition(grid, -k, axis=1)[:, -k])
    row, column = np.nonzero((grid >= floor[:, None]) & (grid > -np.inf))
    many = np.flatnonzero(np.bincount(row, minlength=len(scores)) > k)
    if len(many):  # ties
        place = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
        order = np.lexsort((place[column], -grid[row, column], row))
        row, column = row[order], column[order]
        first = np.searchsorted(row, np.arange(len(scores)))
        keep = np.arange(len(row)) - first[row] < k
        row, column = row[keep], column[keep]
    return row, column


def _scan(chunks: DataFrame, questions: pd.DataFrame, by: list[str], k: int, schema: str, prepare: Callable, score: Callable) -> DataFrame:
    """query_id, chunk_id, score. prepare(questions of one value of ``by``) -> (query ids, state); score(state, slice) -> matrix."""
    groups = {}
    for key, own in questions.groupby(by, sort=False) if by else [((), questions)]:
        groups[key if isinstance(key, tuple) else (key,)] = prepare(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors = {key: np.full(len(ids), -np.inf) for key, (ids, _) in groups.items()}
        for batch in batches:
            rows: dict[tuple, list[int]] = {}  # one pass over the rows, however many values there are
            for at, key in enumerate(zip(*(batch.column(c).to_pylist() for c in by), strict=True) if by else ()):
                if key in groups:
                    rows.setdefault(key, []).append(at)
            for key in rows if by else groups:
                query_ids, state = groups[key]
                own = batch.take(pa.array(rows[key])) if by else batch
                size = max(16, SLICE // max(1, len(query_ids)))
                for at in range(0, own.num_rows, size):
                    part = own.slice(at, size)
                    scores = score(state, part)
                    ids = part.column("chunk_id").to_numpy(zero_copy_only=False)
                    q, c = firsts(scores, ids, k, floors[key])
                    yield pa.record_batch([pc.take(query_ids, pa.array(q)), pc.take(part.column("chunk_id"), pa.array(c)), pa.array(scores[q, c])], ["query_id", "chunk_id", "score"])

    return chunks.mapInArrow(run, schema)


def _in_blocks(questions: DataFrame, size: int, scan: Callable[[pd.DataFrame], DataFrame], empty: Callable[[], DataFrame]) -> DataFrame:
    """The union of scan(block) over blocks of questions that hold ``size`` numbers together."""
    n = -(-size // BLOCK)
    found = None
    for i in range(n):
        block = questions if n == 1 else questions.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)
        one = scan(block.toPandas())
        found = one if found is None else found.union(one)
    return empty() if found is None else found


def best_by_terms(index: DataFrame, weights: DataFrame, factor: Callable[[np.ndarray, pa.RecordBatch, np.ndarray, tuple], np.ndarray], stats: dict[tuple, tuple], k: int, by: list[str]) -> DataFrame:
    """query_id, chunk_id, score: the sum of weight * factor over common terms, where it is positive.

    index: as ``lexical.index`` makes it; weights: query_id, by, token, w. factor(counts, slice, row of
    each count, stats of the value of ``by``) -> a number for each count.
    """
    ids = {f.name: f.dataType.simpleString() for f in [*index.schema.fields, *weights.schema.fields]}
    schema = f"query_id {ids['query_id']}, chunk_id {ids['chunk_id']}, score double"

    def prepare(own: pd.DataFrame):
        token, names = pd.factorize(own["token"])
        query, query_ids = pd.factorize(own["query_id"])
        order = np.argsort(token, kind="stable")
        first = np.searchsorted(token[order], np.arange(len(names) + 1))
        return pa.array(query_ids), (pa.array(names, pa.string()), query[order], own["w"].to_numpy()[order], first, len(query_ids), stats.get(tuple(own.iloc[0][c] for c in by)))

    def score(state: tuple, part: pa.RecordBatch) -> np.ndarray:
        names, query, weight, first, n, group = state
        terms = part.column("terms")
        at = pc.index_in(terms.flatten(), value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(part.num_rows), terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        known = np.flatnonzero(at >= 0)
        at, row, count = at[known], row[known], part.column("counts").flatten().to_numpy(zero_copy_only=False)[known].astype(np.float64)
        value = factor(count, part, row, group) if group is not None else np.zeros(len(count))
        order = np.argsort(at, kind="stable")
        at, row, value = at[order], row[order], value[order]
        scores = np.zeros((n, part.num_rows))
        edge = np.flatnonzero(np.diff(np.concatenate(([-1], at, [-1]))))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            t = at[lo]
            own = slice(first[t], first[t + 1])
            scores[query[own, None], row[None, lo:hi]] += weight[own, None] * value[None, lo:hi]
        scores[scores <= 0] = -np.inf
        return scores

    scan = lambda rows: _scan(index, rows, by, k, schema, prepare, score)
    return _in_blocks(weights, weights.count(), scan, lambda: index.sparkSession.createDataFrame([], schema))


def best_by_cosine(vectors: DataFrame, questions: DataFrame, k: int, by: list[str]) -> DataFrame:
    """query_id, chunk_id, score: cosines in double precision. Null, zero and non-finite vectors take no part, nor those of another length."""
    types = {f"{side}_{f.name}": f.dataType.simpleString() for side, df in (("v", vectors), ("q", questions)) for f in df.schema.fields}
    schema = f"query_id {types['q_query_id']}, chunk_id {types['v_chunk_id']}, score double"
    usable = lambda df, key: df.select(key, *by, F.col("embedding").cast("array<double>").alias("embedding")).filter(
        F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("embedding", lambda v: v != 0)
    )
    vectors, questions = usable(vectors, "chunk_id"), usable(questions, "query_id")
    widths = [r[0] for r in questions.select(F.size("embedding").alias("n")).distinct().collect()]

    def prepare(own: pd.DataFrame):
        matrix = np.array(own["embedding"].tolist(), dtype=np.float64)
        return pa.array(own["query_id"]), (matrix, np.sqrt((matrix * matrix).sum(axis=1)))

    def score(state: tuple, part: pa.RecordBatch) -> np.ndarray:
        matrix, size = state
        other = part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, matrix.shape[1])
        return (matrix @ other.T) / (size[:, None] * np.sqrt((other * other).sum(axis=1))[None])

    found = vectors.sparkSession.createDataFrame([], schema)
    for width in widths:  # one, as a rule
        asked, own = (df.filter(F.size("embedding") == width) for df in (questions, vectors))
        scan = lambda rows, own=own: _scan(own, rows, by, k, schema, prepare, score)
        one = _in_blocks(asked, asked.count() * width, scan, lambda: found)
        found = one if len(widths) == 1 else found.union(one)
    return found
