"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted to a bounded sample (``SAMPLE`` rows with the least hashes of their ids) by
k-means with a penalty on large clusters, in two levels where there are many; there is one for about
``LIST`` vectors, ``CENTROIDS`` at most (a bound of memory: 16 MB at 64 components), so they and their
neighbour graph fit in memory everywhere. Distances to centroids are judged by a scale: a vector's
distance to its closest one, or the sample's mean of that if it is more, so a vector that is a centroid
itself has a scale too. Every vector is posted to its closest centroid and, at a boundary, to others
within ``1 + CLOSURE`` times its scale, ``REPLICAS`` in all. A query reads its ``NEAREST`` lists, and all
further ones within a reach: the ratio to its scale that holds ``WANTED`` of the true neighbours of
``PROBES`` sample rows, found among the sample by brute force. It follows the spread of distances, so
recall doesn't fall where distances are alike, and the sample is sparser than the table, so it isn't too small. Centroids are found by best-first search on the graph, all vectors of a batch at once; a query
whose beam ends before its scale does is searched anew with a wider one, so nothing is cut off.
Tables of rows against centroids are made for ``CELLS`` cells at a time, and nothing that is kept refers to them, so memory
doesn't grow with the square of the centroids.

Neighbouring lists make a group of about ``GROUP`` vectors, where they meet the queries that ask for
one of them. A list over ``PART`` vectors is a group of its own, split into parts by a hash of the id,
and so are the queries of a group that over ``ASKED`` ask for; so a vector that a third of all rows
share, or that a third of all queries ask for, doesn't fill a task. Only two numbers for each centroid
reach the driver. In a group, a list's vectors and its queries are two matrices: distances are found for
all at once, those among a query's first k are taken again term by term, in double precision on the
original vectors, and a query's k best of the group go on, to be ranked by distance and then id.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part, nor do null ids. Of rows that share an id, the least vector takes part. No candidate: no row.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, tidy

SAMPLE, LIST, CENTROIDS, PART, GROUP, ASKED, LEVEL = 262_144, 24, 65_536, 4096, 16_384, 4096, 512
CLOSURE, REPLICAS, WANTED, PROBES, NEAREST, DEGREE, BEAM = 0.1, 4, 0.97, 256, 32, 24, 64
#: Cells of a table of rows against centroids, or of a beam, at most (or one row's).
CELLS = 1 << 22


def blocks(rows: int, width: int, most: int = 4096) -> Iterator[slice]:
    """Ranges of rows whose tables of this width have ``CELLS`` cells together, ``most`` rows at most."""
    step = max(1, min(most, CELLS // max(1, width)))
    return (slice(i, min(i + step, rows)) for i in range(0, rows, step))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1), 0)


def fit(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Centroids by k-means whose assignment adds a penalty for clusters that are large already."""
    rng = np.random.default_rng(7)
    different = np.unique(sample, axis=0)
    n = min(n, len(different))
    centres = different[rng.permutation(len(different))[:n]].astype(np.float32)
    del different
    size = np.full(n, len(sample) / n)
    for _ in range(rounds):
        total, count, spread = np.zeros_like(centres, dtype=np.float64), np.zeros(n), 0.0
        penalty = None
        for i in range(0, len(sample), 4096):
            part = sample[i : i + 4096]
            d = squared(part, centres)
            if penalty is None:
                spread = float(d.min(axis=1).mean())
                penalty = 0.1 * spread * (size * n / len(sample) - 1)
            own = (d + penalty).argmin(axis=1)
            np.add.at(total, own, part)
            count += np.bincount(own, minlength=n)
        filled = count > 0
        centres[filled] = (total[filled] / count[filled, None]).astype(np.float32)
        empty = np.flatnonzero(~filled)
        if len(empty):  # taken up again in large clusters
            centres[empty] = sample[rng.integers(len(sample), size=len(empty))]
        size = np.maximum(count, 1)
    return centres


def fit_levels(sample: np.ndarray, n: int) -> np.ndarray:
    """Centroids as from fit; where there are many, within the clusters of a first level."""
    if n <= LEVEL:
        return fit(sample, n)
    first = fit(sample, int(n**0.5))
    own = np.concatenate([squared(sample[i : i + 4096], first).argmin(axis=1) for i in range(0, len(sample), 4096)])
    parts = (sample[own == c] for c in range(len(first)))
    return np.concatenate([fit(part, max(1, round(n * len(part) / len(sample)))) for part in parts if len(part)])


class Graph:
    """Neighbour graph of the centroids, searched best-first for many vectors at once."""

    def __init__(self, centres: np.ndarray, sample: np.ndarray | None = None):
        self.centres = centres
        n, degree = len(centres), min(DEGREE, len(centres) - 1)
        links = []
        for part in blocks(n, n, 256):
            near = squared(centres[part], centres)
            near[np.arange(len(near)), np.arange(part.start, part.stop)] = np.inf
            links.append(np.argpartition(near, max(degree - 1, 0), axis=1)[:, :degree].astype(np.int32))  # no view, which would keep the whole order
        rng = np.random.default_rng(11)
        far = rng.integers(n, size=(n, 4))  # long links keep it connected
        ring = np.stack([(np.arange(n) + 1) % n, (np.arange(n) - 1) % n], axis=1)
        self.links = np.concatenate((np.concatenate(links), far, ring), axis=1).astype(np.int32)
        self.entry = rng.permutation(n)[: min(n, 16)]
        self.spread = 0.0
        if sample is not None and len(sample):
            some = sample[: 1 << 12]
            self.spread = float(np.sqrt(np.concatenate([squared(some[part], centres).min(axis=1) for part in blocks(len(some), n)])).mean())
        self.prune = fit_reach(self, sample) if sample is not None and len(sample) > 1 else 0.0

    def nearest(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) of each row of x, closest first, ``beam`` at most; -1 and infinity where there are fewer."""
        n = len(self.centres)
        width = n if n <= beam else beam + max(4, beam // 16) * self.links.shape[1]  # of what a step of the search holds
        found = [self._search(x[part], beam) if n > beam else self._all(x[part]) for part in blocks(len(x), width, max(1, (1 << 26) // n))]  # the last bounds the table of what was seen
        return tuple(np.concatenate(part) for part in zip(*found, strict=True)) if found else (np.zeros((0, beam), np.int32), np.zeros((0, beam)))

    def _all(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.sqrt(squared(x, self.centres))
        order = np.argsort(d, axis=1, kind="stable")
        return order.astype(np.int32), np.take_along_axis(d, order, axis=1)

    def _search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, step = len(self.centres), max(4, beam // 16)
        rows = np.arange(len(x))[:, None]
        seen = np.zeros((len(x), n), dtype=bool)
        seen[:, self.entry] = True
        ids = np.full((len(x), beam), -1)
        dist = np.full((len(x), beam), np.inf, dtype=np.float32)
        done = np.ones((len(x), beam), dtype=bool)
        first = np.broadcast_to(self.entry, (len(x), len(self.entry)))[:, :beam]
        ids[:, : first.shape[1]], done[:, : first.shape[1]] = first, False
        dist[:, : first.shape[1]] = squared(x, self.centres[first[0]])
        norm = (self.centres * self.centres).sum(1)
        own = (x * x).sum(1)
        while True:
            pending = np.where(done, np.inf, dist)
            pick = np.argpartition(pending, step - 1, axis=1)[:, :step]
            active = np.isfinite(np.take_along_axis(pending, pick, axis=1))
            if not active.any():
                break
            np.put_along_axis(done, pick, True, axis=1)
            chosen = np.where(active, np.take_along_axis(ids, pick, axis=1), -1)
            new = np.where(chosen[:, :, None] >= 0, self.links[chosen], -1).reshape(len(x), -1)
            new.sort(axis=1)
            fresh = (new >= 0) & ~seen[rows, np.maximum(new, 0)]
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            r, c = np.nonzero(fresh)
            seen[r, new[r, c]] = True
            d = np.full(new.shape, np.inf, dtype=np.float32)
            d[r, c] = np.maximum(own[r] + norm[new[r, c]] - 2 * np.einsum("ij,ij->i", x[r], self.centres[new[r, c]]), 0)
            ids, dist, done = np.concatenate((ids, new), axis=1), np.concatenate((dist, d), axis=1), np.concatenate((done, ~fresh), axis=1)
            order = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
            ids, dist, done = (np.take_along_axis(v, order, axis=1) for v in (ids, dist, done))
        order = np.argsort(dist, axis=1, kind="stable")
        ids, dist = (np.take_along_axis(v, order, axis=1) for v in (ids, dist))
        return np.where(np.isfinite(dist), ids, -1).astype(np.int32), np.sqrt(dist)

    def reach(self, closest: np.ndarray, share: float) -> np.ndarray:
        """How far from each vector its lists may be, by the distance of its closest one."""
        return (1 + share) * np.maximum(closest, self.spread)


def postings(graph: Graph, x: np.ndarray) -> list[list[int]]:
    """The lists of every vector: the closest, and boundary replicas."""
    ids, dist = (part[:, :REPLICAS] for part in graph.nearest(x, max(16, 4 * REPLICAS)))
    keep = (ids >= 0) & (dist <= graph.reach(dist[:, :1], CLOSURE))
    keep[:, 0] = True
    return [own[k].tolist() for own, k in zip(ids, keep, strict=True)]


def fit_reach(graph: Graph, sample: np.ndarray, k: int = 10) -> float:
    """The share of its scale beyond which a query need not look, by the lists of its true neighbours in the sample."""
    rows = np.random.default_rng(17).permutation(len(sample))[:PROBES]
    ratio = []
    for part in blocks(len(rows), len(sample), 16):
        own = rows[part]
        far = squared(sample[own], sample)
        far[np.arange(len(own)), own] = np.inf
        near = np.argpartition(far, min(k, len(sample) - 1) - 1, axis=1)[:, : min(k, len(sample) - 1)]
        to_centre = np.sqrt(squared(sample[own], graph.centres))
        scale = np.maximum(np.maximum(to_centre.min(axis=1), graph.spread), 1e-30)
        held = postings(graph, sample[near.ravel()])
        first = [to_centre[j // near.shape[1]][lists].min() for j, lists in enumerate(held)]
        ratio.append(np.array(first).reshape(near.shape) / scale[:, None] - 1)
    return max(0.0, float(np.quantile(np.concatenate(ratio), WANTED)))


def lists_of_query(graph: Graph, x: np.ndarray, length: np.ndarray, beam: int = BEAM) -> list[np.ndarray]:
    """The lists that each query reads: its closest ones, and all within its reach."""
    out: list[np.ndarray] = []
    for part in blocks(len(x), min(beam, len(length))):
        ids, dist = graph.nearest(x[part], beam)
        inside = (ids >= 0) & (dist <= graph.reach(dist[:, :1], graph.prune))
        inside[:, :NEAREST] = ids[:, :NEAREST] >= 0
        short = np.flatnonzero(inside[:, -1]) if beam < len(length) else np.zeros(0, np.int64)
        inside[short] = False
        out += [own[k] for own, k in zip(ids, inside, strict=True)]
        if len(short):  # the beam ended first
            for i, more in zip((part.start + short).tolist(), lists_of_query(graph, x[part][short], length, 4 * beam), strict=True):
                out[i] = more
    return out


def by_group(lists: list[np.ndarray], group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, pa.ListArray]]:
    """(query, group, lists) by the queries' places, in parts of ``CELLS`` lists (one query at least): a query's lists of each group that it asks."""
    ends, at = np.cumsum([len(own) for own in lists]), 0
    while at < len(lists):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, side="right")))
        query, c = np.repeat(np.arange(at, end), [len(own) for own in lists[at:end]]), np.concatenate(lists[at:end])
        of = group[c]
        order = np.lexsort((of, query))
        query, of, c = query[order], of[order], c[order]
        first = np.flatnonzero(np.concatenate(([True], (query[1:] != query[:-1]) | (of[1:] != of[:-1])))) if len(c) else np.zeros(0, np.int64)
        yield query[first], of[first], pa.ListArray.from_arrays(pa.array(np.append(first, len(c)), pa.int32()), pa.array(c, pa.int32()))
        at = end


def nearest_of_list(v: np.ndarray, vec_id: np.ndarray, q: np.ndarray, query_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) by their places: the k nearest vectors of each query but itself, ties to the lesser id."""
    near = squared(q, v)
    near[query_id[:, None] == vec_id[None]] = np.inf
    bound = np.full(len(q), np.finfo(np.float64).max)
    if len(v) > k:  # with room for what rounding does to squares that are taken apart
        slack = 1e-9 * ((q * q).sum(axis=1) + (v * v).sum(axis=1).max())
        bound = np.minimum(np.partition(near, k - 1, axis=1)[:, k - 1] + slack, bound)
    row, column = np.nonzero(near <= bound[:, None])
    gap = q[row] - v[column]
    score = np.sqrt(np.cumsum(gap * gap, axis=1)[:, -1])
    order, first = _first_of(row, score, vec_id[column], k)
    return row[order[first]], column[order[first]], score[order[first]]


def _first_of(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by row, score and id, and which of it are the first k of their row."""
    order = np.lexsort((ids, score, row))
    ordered = row[order]
    begin = np.searchsorted(ordered, ordered)
    return order, np.arange(len(order)) - begin < k


def nearest_of_group(vectors: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """query_id, vec_id, score: each query's k nearest among the vectors of the lists that it asks for."""
    none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not len(vectors) or not len(queries):
        return none
    width = len(vectors.column("embedding")[0])
    flat = lambda column: column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    order = np.argsort(vectors.column("list").to_numpy(), kind="stable")
    v, vec_id, of = flat(vectors.column("embedding"))[order], vectors.column("vec_id").to_numpy()[order], vectors.column("list").to_numpy()[order]
    q, query_id, lists = flat(queries.column("q")), queries.column("query_id").to_numpy(), queries.column("lists").combine_chunks()
    wanted = lists.flatten().to_numpy(zero_copy_only=False)
    asker = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy(zero_copy_only=False))
    by_list = np.argsort(wanted, kind="stable")
    wanted, asker = wanted[by_list], asker[by_list]
    found = []
    for c in np.unique(wanted).tolist():
        lo, hi = np.searchsorted(of, [c, c + 1])
        own = asker[slice(*np.searchsorted(wanted, [c, c + 1]))]
        if hi > lo:
            row, column, score = nearest_of_list(v[lo:hi], vec_id[lo:hi], q[own], query_id[own], k)
            found.append((own[row], vec_id[lo:hi][column], score))
    if not found:
        return none
    row, ids, score = (np.concatenate(x) for x in zip(*found, strict=True))
    order, _ = _first_of(row, score, ids, k)
    row, ids, score = row[order], ids[order], score[order]
    fresh = np.concatenate(([True], (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])))  # replicas stand side by side
    row, ids, score = row[fresh], ids[fresh], score[fresh]
    order, first = _first_of(row, score, ids, k)
    return pa.table({"query_id": query_id[row[order[first]]], "vec_id": ids[order[first]], "score": score[order[first]]})


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(column), width)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part, before lengths are compared."""
    e = F.col("embedding")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(e, lambda v: v != 0)
    return vectors.select("vec_id", e.cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & e.isNotNull() & fine)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query among all vectors but itself."""
    spark = vectors.sparkSession
    work = Workspace(spark, "ann")
    base = usable(vectors.select("vec_id", "embedding"))
    head = base.groupBy(F.size("embedding").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").limit(1).collect()
    if not head:
        return base.select(F.col("vec_id").cast("long").alias("query_id"), F.lit(0).alias("rank"), F.col("vec_id").cast("long").alias("vec_id"), F.lit(0.0).alias("score"))
    width, total = int(head[0]["width"]), int(head[0]["n"])
    base = base.filter(F.size("embedding") == width).withColumn("vec_id", F.col("vec_id").cast("long"))
    again = work.save(base.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("vec_id"), "again")
    if not again.isEmpty():
        one = base.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        base = base.join(again, "vec_id", "left_anti").union(one)
    n_lists = max(1, min(CENTROIDS, total // LIST))
    rows = base.select("vec_id", F.col("embedding").cast("array<float>").alias("e")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(SAMPLE, 32 * n_lists)).select("e").toArrow()
    sample = _matrix(rows.column("e").combine_chunks(), width)
    del rows
    graph = Graph(fit_levels(sample, n_lists), sample)
    del sample
    tidy()

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                lists = postings(graph, _matrix(part.column("embedding"), width))
                yield pa.record_batch([part.column("vec_id"), part.column("embedding"), pa.array(lists, pa.list_(pa.int32()))], ["vec_id", "embedding", "lists"])

    posted = base.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(post, "vec_id long, embedding array<double>, lists array<int>")
    posted = work.save(posted.select("vec_id", "embedding", F.explode("lists").alias("list")), "postings")
    length = np.zeros(len(graph.centres), dtype=np.int64)
    for r in posted.groupBy("list").count().collect():  # one row for each centroid
        length[r["list"]] = r["count"]
    hot = length > PART
    group = np.where(hot, -1 - np.arange(len(length)), np.cumsum(np.where(hot, 0, length)) // GROUP)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                for row, of, asks in by_group(lists_of_query(graph, _matrix(part.column("q"), width), length), group):
                    yield pa.record_batch([part.column("query_id").take(pa.array(row)), part.column("q").take(pa.array(row)), pa.array(of, pa.int64()), asks], ["query_id", "q", "group", "lists"])

    asked = usable(queries.select("vec_id", "embedding")).filter(F.size("embedding") == width)
    asked = asked.groupBy(F.col("vec_id").cast("long").alias("query_id")).agg(F.min("embedding").alias("q")).mapInArrow(route, "query_id long, q array<double>, group long, lists array<int>")
    asked = work.save(asked, "asked")
    asking = {r["group"]: r["count"] for r in asked.groupBy("group").count().collect()}  # one row for each group, of at most as many as centroids
    parts = [(int(c), int(g), max(1, -(-int(n) // PART)) if h else 1, max(1, -(-asking.get(int(g), 0) // ASKED))) for c, (g, n, h) in enumerate(zip(group, length, hot, strict=True))]
    dealt = spark.createDataFrame(parts, "list int, group long, v_parts long, q_parts long")
    copies = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    deal = lambda key, n: F.pmod(F.xxhash64(key), n)
    left = posted.join(F.broadcast(dealt), "list").withColumn("v_part", deal("vec_id", F.col("v_parts"))).withColumn("q_part", copies(F.col("q_parts")))
    right = asked.join(F.broadcast(dealt.select("group", "v_parts", "q_parts").distinct()), "group").withColumn("q_part", deal("query_id", F.col("q_parts"))).withColumn("v_part", copies(F.col("v_parts")))
    keys = ("group", "v_part", "q_part")
    left, right = left.select(*keys, "list", "vec_id", "embedding"), right.select(*keys, "query_id", "q", "lists")
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda v, q: nearest_of_group(v, q, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    near = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k * REPLICAS)  # hold k different ones
    best = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
