"""A stored vector index: random-projection codes are scanned, few vectors are read and scored.

``build`` writes three tables. *codes* has a row for each vector with the signs of its products with
``bits`` random directions, packed; *vectors* has the vectors themselves, partitioned by the nearest of
``cells`` pivots; *settings* has one row. The angle of two vectors is in proportion to the number of
differing bits but for chance, so a search takes as candidates the vectors whose codes are nearest, and
computes cosines in double precision for these alone. How many candidates it takes is fitted: for
``sample`` rows the exact neighbours are found, and the share of all vectors that had to be candidates
for ``recall`` of these neighbours is kept. It is a share, so candidates grow with the table.

``search`` scans the codes twice for a block of questions of a checked size: once for the number of
vectors at each distance of a question (a histogram of ``bits`` + 1 counts, so its state doesn't grow),
which gives the distance that holds the wanted share, ties included; once for the candidates within it.
Then only the cells that have candidates are read. No list of candidates passes through the driver.

With ``by`` (fixed when the index is built) neighbours agree with the question on these columns, where
null is a value. Vectors that are null, zero, not finite or of other than ``dimensions`` components
aren't indexed, and such questions have no hits. Equal vectors tie and come by id. An empty index has no
hits; other columns are ignored; ids must be unique. Recall isn't promised for questions unlike the indexed vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.scratch import stored
from .blocks import SLICE, _in_blocks, best_by_cosine, ranked

#: Candidates of a question for each neighbour that it asks for, at least.
ROOM = 8
#: Files of a cell, at most: a hot cell isn't one task's work.
SALT = 8


@dataclass(frozen=True)
class Index:
    path: str
    by: tuple[str, ...]
    dimensions: int
    bits: int
    seed: int
    k: int
    share: float

    def codes(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/codes")

    def vectors(self, spark: SparkSession) -> DataFrame:
        kind = self.codes(spark).schema["chunk_id"].dataType.simpleString()
        return spark.read.schema(f"chunk_id {kind}, embedding array<double>, cell int").parquet(f"{self.path}/vectors")  # an empty table has no file


def usable(rows: DataFrame, key: str, by: tuple[str, ...], dimensions: int) -> DataFrame:
    """key, by, embedding of the vectors that can be compared, in double precision and over the largest component, so that no square overflows."""
    rows = rows.select(key, *by, F.col("embedding").cast("array<double>").alias("embedding")).filter(F.size("embedding") == dimensions)
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    size = F.array_max(F.transform("embedding", F.abs))
    shrunk = X.let(size, lambda most: F.transform("embedding", lambda v: v / most))
    return rows.filter(finite & F.exists("embedding", lambda v: v != 0)).withColumn("embedding", shrunk)


def matrix_of(column: pa.Array, dimensions: int) -> np.ndarray:
    """Unit vectors."""
    matrix = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimensions)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def directions(dimensions: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimensions, bits))


def encoded(rows: DataFrame, dimensions: int, bits: int, seed: int, pivots: np.ndarray | None = None) -> DataFrame:
    """Adds ``code``, and ``cell`` (the nearest pivot) where there are pivots."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", code binary" + ("" if pivots is None else ", cell int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = directions(dimensions, bits, seed)
        for batch in batches:
            unit = matrix_of(batch.column("embedding"), dimensions)
            packed = np.packbits(unit @ project > 0, axis=1)
            added, names = [pa.array([row.tobytes() for row in packed], pa.binary())], ["code"]
            if pivots is not None:
                added.append(pa.array(np.argmax(unit @ pivots.T, axis=1) if len(unit) else [], pa.int32()))
                names.append("cell")
            yield pa.record_batch([*batch.columns, *added], [*batch.schema.names, *names])

    return rows.mapInArrow(run, schema)


def build(vectors: DataFrame, path: str, dimensions: int, by: tuple[str, ...] = (), k: int = 10, recall: float = 0.97, bits: int = 256, cells: int = 256, sample: int = 256, seed: int = 7) -> Index:
    """Writes the index of chunk_id, embedding and ``by`` under ``path``, for searches of ``k`` neighbours at most.

    Pivots and the sample for the fit are the rows of the least id hashes, ``cells`` and ``sample`` of them.
    """
    if bits <= 0 or bits % 64:
        raise ValueError("bits must be a positive multiple of 64")
    spark, rows = vectors.sparkSession, usable(vectors, "chunk_id", by, dimensions)
    first = lambda n: rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(n)
    chosen = first(cells).select("embedding").toArrow().column("embedding").combine_chunks()
    pivots = matrix_of(chosen, dimensions) if len(chosen) else np.zeros((1, dimensions))
    placed = encoded(rows, dimensions, bits, seed, pivots).repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(SALT)))
    placed.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    placed = spark.read.schema(placed.schema).parquet(f"{path}/vectors")
    placed.select("chunk_id", *by, "code", "cell").write.mode("overwrite").parquet(f"{path}/codes")
    index = Index(path, tuple(by), dimensions, bits, seed, k, 1.0)
    asked = first(sample).withColumnRenamed("chunk_id", "query_id")
    share = _share(index, rows, asked, recall)
    columns = "by array<string>, dimensions int, bits int, seed long, k int, share double"
    spark.createDataFrame([(list(by), dimensions, bits, seed, k, share)], columns).coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> Index:
    """The index that was written under a path."""
    row = spark.read.parquet(f"{path}/settings").first()
    return Index(path, tuple(row.by), row.dimensions, row.bits, row.seed, row.k, row.share)


def _share(index: Index, rows: DataFrame, asked: DataFrame, recall: float) -> float:
    """The share of a question's possible hits that holds ``recall`` of the sample's exact neighbours, itself left out."""
    spark = rows.sparkSession
    plain, own = _null_safe(rows, index.by), _null_safe(asked, index.by)
    exact = best_by_cosine(plain, own, index.k + 1, list(index.by)).filter("query_id <> chunk_id")
    exact = ranked(exact, "query_id", index.k).select("query_id", "chunk_id")
    questions = _asked(index, asked)
    codes = index.codes(spark).select("chunk_id", "code")
    apart = _distance(exact.join(codes, "chunk_id").join(questions.select("query_id", F.col("code").alias("own")), "query_id"), index.bits)
    by_distance = _histogram(index, questions)
    order = Window.partitionBy("query_id").orderBy("distance").rowsBetween(Window.unboundedPreceding, 0)
    reached = by_distance.select("query_id", "distance", (F.sum("n").over(order) / F.sum("n").over(Window.partitionBy("query_id"))).alias("share"))
    row = apart.join(reached, ["query_id", "distance"]).agg(F.percentile("share", recall).alias("share")).first()  # sample x k rows
    return 1.0 if row.share is None else float(row.share)


def _null_safe(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The columns of ``by`` as JSON, so that null is a value."""
    for c in by:
        rows = rows.withColumn(c, F.to_json(F.array(c)))
    return rows


def _asked(index: Index, questions: DataFrame) -> DataFrame:
    """query_id, by, embedding, code of the questions that can have hits."""
    return encoded(usable(questions, "query_id", index.by, index.dimensions), index.dimensions, index.bits, index.seed)


def _distance(rows: DataFrame, bits: int) -> DataFrame:
    """Adds ``distance``: the bits in which ``code`` and ``own`` differ."""
    word = lambda c, i: F.conv(F.hex(F.substring(c, 8 * i + 1, 8)), 16, -10).cast("long")
    apart = sum((F.bit_count(word("code", i).bitwiseXOR(word("own", i))) for i in range(bits // 64)), F.lit(0))
    return rows.withColumn("distance", apart.cast("int"))


def _words(codes: pa.Array, bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(codes.to_pylist()), dtype=np.uint64).reshape(len(codes), bits // 64)


def _slices(index: Index, block: pd.DataFrame) -> Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, pa.RecordBatch, np.ndarray]]]:
    """For a batch of codes: (places of questions, rows, distances) of each value of ``by``, a slice of a checked size at a time."""
    by, bits = list(index.by), index.bits
    keys = list(zip(*(block[c].tolist() for c in by), strict=True)) if by else [()] * len(block)
    groups: dict[tuple, list[int]] = {}
    for place, key in enumerate(keys):
        groups.setdefault(key, []).append(place)
    own = {key: np.array(places) for key, places in groups.items()}
    words = np.frombuffer(b"".join(map(bytes, block["code"])), dtype=np.uint64).reshape(len(block), bits // 64)

    def each(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, pa.RecordBatch, np.ndarray]]:
        rows: dict[tuple, list[int]] = {}
        if by:
            for at, key in enumerate(zip(*(batch.column(c).to_pylist() for c in by), strict=True)):
                if key in own:
                    rows.setdefault(key, []).append(at)
        for key, places in own.items() if not by else ((k, own[k]) for k in rows):
            mine = batch.take(pa.array(rows[key])) if by else batch
            size = max(16, SLICE // len(places))
            for at in range(0, mine.num_rows, size):
                part = mine.slice(at, size)
                codes, apart = _words(part.column("code"), bits), np.zeros((len(places), part.num_rows), dtype=np.int64)
                for w in range(bits // 64):
                    apart += np.bitwise_count(words[places, w, None] ^ codes[None, :, w])
                yield places, part, apart

    return each


def _blocks(index: Index, questions: DataFrame, scan: Callable[[DataFrame, pd.DataFrame, str], DataFrame], tail: str) -> DataFrame:
    """The union of scan(codes, block, schema) over blocks of questions."""
    spark, by = questions.sparkSession, index.by
    asked = _null_safe(questions.drop("embedding"), by)
    codes = _null_safe(index.codes(spark), by)
    schema = f"query_id {questions.schema['query_id'].dataType.simpleString()}, {tail}"
    empty = lambda: spark.createDataFrame([], schema)
    return _in_blocks(asked, asked.count() * (index.bits + 1), lambda block: scan(codes, block, schema) if len(block) else empty(), empty)


def _histogram(index: Index, questions: DataFrame) -> DataFrame:
    """query_id, distance, n: vectors at each distance."""

    def scan(codes: DataFrame, block: pd.DataFrame, schema: str) -> DataFrame:
        each, ids, width = _slices(index, block), pa.array(block["query_id"]), index.bits + 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((len(ids), width), dtype=np.int64)
            for batch in batches:
                for places, _, apart in each(batch):
                    flat = apart + np.arange(len(places))[:, None] * width
                    counts[places] += np.bincount(flat.ravel(), minlength=len(places) * width).reshape(len(places), width)
            q, d = np.nonzero(counts)
            yield pa.record_batch([ids.take(pa.array(q)), pa.array(d, pa.int32()), pa.array(counts[q, d])], ["query_id", "distance", "n"])

        return codes.select(*index.by, "code").mapInArrow(run, schema)

    found = _blocks(index, questions, scan, "distance int, n long")
    return found.groupBy("query_id", "distance").agg(F.sum("n").alias("n"))


def candidates(index: Index, questions: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, cell of the vectors whose codes are within each question's reach."""
    asked = _asked(index, questions)
    order = Window.partitionBy("query_id").orderBy("distance").rowsBetween(Window.unboundedPreceding, 0)
    sums = _histogram(index, asked).withColumn("until", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy("query_id")))
    wanted = F.least(F.col("all"), F.greatest(F.ceil(F.col("all") * index.share), F.lit(ROOM * k)))
    reach = sums.filter(F.col("until") >= wanted).groupBy("query_id").agg(F.min("distance").alias("reach"))
    asked = asked.join(reach, "query_id")

    def scan(codes: DataFrame, block: pd.DataFrame, schema: str) -> DataFrame:
        each, ids, most = _slices(index, block), pa.array(block["query_id"]), block["reach"].to_numpy()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for places, part, apart in each(batch):
                    q, c = np.nonzero(apart <= most[places][:, None])
                    at = pa.array(c)
                    yield pa.record_batch([ids.take(pa.array(places[q])), part.column("chunk_id").take(at), part.column("cell").take(at)], ["query_id", "chunk_id", "cell"])

        return codes.select("chunk_id", *index.by, "cell", "code").mapInArrow(run, schema)

    kind = index.codes(questions.sparkSession).schema["chunk_id"].dataType.simpleString()
    return _blocks(index, asked, scan, f"chunk_id {kind}, cell int")


def search(index: Index, questions: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, chunk_id, score: the k most similar vectors found for each question (query_id, embedding and ``by``)."""
    if not 0 < k <= index.k:
        raise ValueError(f"k must be positive and at most {index.k}, for which the index was fitted")
    spark, found = questions.sparkSession, candidates(index, questions, k)
    cells = [r.cell for r in found.select("cell").distinct().collect()]  # as many as there are pivots, at most
    vectors = index.vectors(spark).filter(F.col("cell").isin(cells)).select("chunk_id", "cell", F.col("embedding").alias("other"))
    own = stored(usable(questions, "query_id", index.by, index.dimensions).select("query_id", "embedding"), "asked-vectors")
    # candidates are many more than the codes that they come from, by whose size Spark would take them to fit a broadcast
    pairs = found.hint("merge").join(vectors, ["cell", "chunk_id"]).join(own, "query_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    score = dot("embedding", "other") / (F.sqrt(dot("embedding", "embedding")) * F.sqrt(dot("other", "other")))
    return ranked(pairs.select("query_id", "chunk_id", score.alias("score")), "query_id", k).select("query_id", "rank", "chunk_id", "score")
