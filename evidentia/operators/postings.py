"""BM25 over a stored inverted index in blocks, of which a search reads those that can hold one of the best chunks.

Chunks lie in blocks of ``BLOCK``, of one filter group and of similar lengths. A row of ``postings`` is a token in a block: the
chunks that have it, what each adds to a score for a weight of 1, and the most that one of them adds. ``blocks`` has the most
alone, so bounds are read without postings; ``terms`` has each token's document frequency, blocks and most. Tables are dealt
by a hash of the token and sorted by it, so a search reads the asked tokens' shards and row groups.

A search takes three steps, each a join for all questions at once:

1. The blocks of a question's rarest tokens are bounded, and the first ``SEEDS`` by that bound are scored in full: the k-th
   best of them is a threshold that the answer can't fall below.
2. Tokens whose bounds together stay below the threshold can't lift a chunk over it, so blocks are sought by the other
   tokens alone. A block stays if its bounds, and the left-out tokens' bounds on the whole index, reach the threshold.
3. The blocks that stay are scored in full.

So results are those of scoring every chunk, ties included. ``k1`` and ``b`` belong to the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import lexical
from .blocks import firsts, ranked

BLOCK, SHARDS, SEEDS, READ_FIRST = 128, 16, 8, 64
#: Scores closer than this may share a rank (``blocks.PLACES``), so a bound has to fall short by more.
SLACK = 2e-9


@dataclass(frozen=True)
class Index:
    """Where an index lies, the columns that a question and a chunk have to agree on, and the type of chunk ids and of those columns."""

    path: str
    by: tuple[str, ...] = ()
    chunk_id: str = "bigint"
    kinds: tuple[str, ...] = ()

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in ("postings", "blocks"):
            return spark.read.parquet(f"{self.path}/{name}")
        held = "ids array<{0}>, adds array<double>, ".format(self.chunk_id) if name == "postings" else ""
        return spark.read.schema(", ".join([*map(" ".join, zip(self.by, self.kinds, strict=True)), f"token string, block long, {held}most double, shard int"])).parquet(f"{self.path}/{name}")


def _posted(ids: pa.Array, terms: pa.ListArray, factor: np.ndarray) -> tuple[list, list, list, np.ndarray]:
    """token, ids, adds, most of one block."""
    code = terms.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(terms)), terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    token = code.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(token, kind="stable")
    offsets = np.searchsorted(token[order], np.arange(len(code.dictionary) + 1)).astype(np.int32)
    adds = factor[order]
    most = np.maximum.reduceat(adds, offsets[:-1]) if len(adds) else np.zeros(0)
    lists = pa.array(offsets, pa.int32())
    return code.dictionary, pa.ListArray.from_arrays(lists, ids.take(pa.array(row[order]))), pa.ListArray.from_arrays(lists, pa.array(adds)), most


def build(chunks: DataFrame, path: str, by: tuple[str, ...] = (), k1: float = 1.5, b: float = 0.75) -> Index:
    """Writes the index of chunks (chunk_id, text and ``by``) under a path, in place of what was there."""
    if k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("k1 > 0 and 0 <= b <= 1 are required")
    spark, types = chunks.sparkSession, dict(chunks.dtypes)
    index = Index(path, tuple(by), types["chunk_id"], tuple(types[c] for c in by))
    table = lexical.index(chunks, list(by))
    corpus = lexical.token_stats(chunks, list(by), table)
    corpus.write.mode("overwrite").parquet(f"{path}/corpus")
    means = {tuple(r[c] for c in by): max(r["avgdl"] or 0.0, 1.0) for r in index.table(spark, "corpus").collect()}  # one row for each filter value
    kinds = dict(table.dtypes)
    parts = max(1, -(-table.count() // (64 * BLOCK)))
    dealt = table.select(*by, "chunk_id", "terms", "counts", "length").repartitionByRange(parts, *by, "length", "chunk_id").sortWithinPartitions(*by, "length", "chunk_id")

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True)) if by else [()] * batch.num_rows
            at = 0
            while at < batch.num_rows:
                end = at + 1
                while end < min(at + BLOCK, batch.num_rows) and keys[end] == keys[at]:
                    end += 1
                part = batch.slice(at, end - at)
                terms = part.column("terms")
                count = part.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                row = np.repeat(np.arange(len(terms)), terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                length = part.column("length").fill_null(0).to_numpy(zero_copy_only=False)[row]
                token, ids, adds, most = _posted(part.column("chunk_id"), terms, count * (k1 + 1) / (count + k1 * (1 - b + b * length / means[keys[at]])))
                same = [pa.array([v] * len(token), part.column(c).type) for c, v in zip(by, keys[at], strict=True)]
                yield pa.record_batch([*same, token.cast(pa.string()), pa.array([number] * len(token), pa.int64()), ids, adds, pa.array(most, pa.float64())], [*by, "token", "block", "ids", "adds", "most"])
                number, at = number + 1, end

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "token string, block long", f"ids array<{kinds['chunk_id']}>", "adds array<double>, most double"])
    posted = stored(dealt.mapInArrow(invert, schema), "inverted").withColumn("shard", F.pmod(F.xxhash64("token"), F.lit(SHARDS)).cast("int"))
    for name, rows in (("postings", posted), ("blocks", posted.drop("ids", "adds"))):
        rows.repartitionByRange("shard", "token", "block").sortWithinPartitions("shard", "token", "block").write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(f"{path}/{name}")
    terms = posted.groupBy(*by, "token").agg(F.sum(F.size("ids")).alias("df"), F.count(F.lit(1)).alias("n_blocks"), F.max("most").alias("most"))
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    return index


def _scored(pairs: DataFrame, weights: DataFrame, postings: DataFrame, by: list[str], k: int) -> DataFrame:
    """query_id, chunk_id, score: of each pair of a question and a block, the best k chunks."""
    kinds = dict(weights.dtypes) | dict(postings.dtypes)
    rows = pairs.join(weights.select("query_id", *by, "token", "w"), "query_id").join(postings.select(*by, "token", "block", "ids", "adds"), [*by, "token", "block"])
    whole = rows.groupBy("query_id", "block").agg(F.array_sort(F.collect_list(F.struct("token", "w", "ids", "adds"))).alias("x"))  # a row for each token of the question
    whole = whole.select("query_id", F.transform("x", lambda x: x.w).alias("w"), F.transform("x", lambda x: x.ids).alias("ids"), F.transform("x", lambda x: x.adds).alias("adds"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                ids, adds, w = part.column("ids"), part.column("adds").flatten(), part.column("w").flatten().to_numpy(zero_copy_only=False)
                each = adds.value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.repeat(np.arange(part.num_rows), ids.value_lengths().to_numpy(zero_copy_only=False)), each)
                code = ids.flatten().flatten().dictionary_encode()
                key, at = np.unique(row * len(code.dictionary) + code.indices.to_numpy(zero_copy_only=False), return_inverse=True)
                score = np.bincount(at, weights=np.repeat(w, each) * adds.flatten().to_numpy(zero_copy_only=False), minlength=len(key))
                of, chunk = key // max(1, len(code.dictionary)), key % max(1, len(code.dictionary))
                grid = np.full((part.num_rows, int(np.bincount(of).max()) if len(of) else 1), -np.inf)
                place = np.arange(len(of)) - np.searchsorted(of, of)
                grid[of, place] = np.where(score > 0, score, -np.inf)
                names = np.zeros(grid.shape, dtype=np.int64)
                names[of, place] = np.argsort(np.argsort(np.array(code.dictionary.to_pylist())))[chunk] if len(of) else 0
                q, c = _first_k(grid, names, k)
                back = np.zeros(grid.shape, dtype=np.int64)
                back[of, place] = chunk
                yield pa.record_batch([pc.take(part.column("query_id"), pa.array(q)), pc.take(code.dictionary, pa.array(back[q, c])), pa.array(grid[q, c])], ["query_id", "chunk_id", "score"])

    return whole.mapInArrow(add_up, f"query_id {kinds['query_id']}, chunk_id {kinds['ids'][6:-1]}, score double")


def _first_k(grid: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k best, ties to the lesser name."""
    found = [firsts(grid[i : i + 1], names[i], k, np.full(1, -np.inf)) for i in range(len(grid))] if grid.shape[1] > k else []
    if not found:
        return np.nonzero(grid > -np.inf)
    return np.concatenate([np.full(len(c), i) for i, (_, c) in enumerate(found)]), np.concatenate([c for _, c in found])


def search(spark: SparkSession, index: Index, questions: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(hits, report): query_id, rank, chunk_id, score as ``lexical.bm25`` gives them, and query_id, blocks, held, read.

    questions: query_id, query and ``by``. The report has a question's filter group's blocks, those that hold any of its tokens, and those scored.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    by = list(index.by)
    asked = lexical.asked_terms(questions, by)
    corpus, terms = index.table(spark, "corpus"), index.table(spark, "terms")
    postings, blocks = index.table(spark, "postings"), index.table(spark, "blocks")
    found = asked.join(terms, [*by, "token"])
    found = found.join(corpus, by) if by else found.crossJoin(F.broadcast(corpus))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = found.select("query_id", *by, "token", "n_blocks", (F.col("qf") * idf).alias("w"), (F.col("qf") * idf * F.col("most")).alias("bound"))
    weights = stored(weights.withColumn("shard", F.pmod(F.xxhash64("token"), F.lit(SHARDS)).cast("int")), "asked-terms")

    # blocks and postings of tokens that nobody asks for don't move; the list's real size is known, and it is that of the questions
    on = [*by, "shard", "token"]
    tokens = stored(weights.select(*on).distinct(), "asked-tokens")
    every, postings, blocks = blocks, postings.join(tokens, on, "left_semi"), blocks.join(tokens, on, "left_semi")

    # 1. seeds: a question's rarest token, and the next ones while their blocks are few
    rare = Window.partitionBy("query_id").orderBy("n_blocks", "token")
    seeding = weights.withColumn("upto", F.sum("n_blocks").over(rare.rowsBetween(Window.unboundedPreceding, 0))).withColumn("i", F.row_number().over(rare))
    near = seeding.filter((F.col("i") == 1) | (F.col("upto") <= READ_FIRST)).join(blocks.withColumnRenamed("most", "own"), on).groupBy("query_id", "block").agg(F.sum(F.col("w") * F.col("own")).alias("b"))
    first = Window.partitionBy("query_id").orderBy(F.desc("b"), "block")
    seeds = near.withColumn("i", F.row_number().over(first)).filter(F.col("i") <= SEEDS).select("query_id", "block")
    kth = ranked(_scored(seeds, weights, postings, by, k), "query_id", k).groupBy("query_id").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n"))
    floor = stored(weights.select("query_id").distinct().join(kth, "query_id", "left").select("query_id", F.when(F.col("n") == k, F.col("s") - SLACK).otherwise(0.0).alias("floor")), "floors")

    # 2. tokens that matter, and the blocks that they can lift over the threshold
    weak = Window.partitionBy("query_id").orderBy("bound", "token")
    split = weights.join(floor, "query_id").withColumn("below", F.sum("bound").over(weak.rowsBetween(Window.unboundedPreceding, 0)))
    slight = split.filter(F.col("below") < F.col("floor")).groupBy("query_id").agg(F.sum("bound").alias("rest"))
    strong = split.filter(F.col("below") >= F.col("floor"))
    lifted = strong.join(blocks.withColumnRenamed("most", "own"), on).groupBy("query_id", "block").agg(F.sum(F.col("w") * F.col("own")).alias("b"))
    kept = lifted.join(slight, "query_id", "left").join(floor, "query_id").filter(F.col("b") + F.coalesce("rest", F.lit(0.0)) >= F.col("floor"))
    kept = stored(kept.select("query_id", "block"), "kept-blocks")

    # 3. the answer
    hits = ranked(_scored(kept, weights, postings, by, k), "query_id", k).select("query_id", "rank", "chunk_id", "score")
    whole = every.groupBy(*by).agg(F.countDistinct("block").alias("blocks"))
    of = weights.select("query_id", *by).distinct()
    of = of.join(whole, by) if by else of.crossJoin(F.broadcast(whole))  # one row
    held = weights.join(blocks.drop("most"), on).groupBy("query_id").agg(F.countDistinct("block").alias("held"))
    read = kept.union(stored(seeds, "seeds")).distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("read"))
    report = of.join(held, "query_id").join(read, "query_id", "left").select("query_id", "blocks", "held", F.coalesce("read", F.lit(0)).alias("read"))
    return hits, report
