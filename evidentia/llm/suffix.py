"""Repeated passages by a hash-compared suffix sort over partitioned suffixes.

A byte goes when a string of ``size`` (200) bytes that covers it also starts anywhere else. Suffixes
are sorted where it can matter:

1. Every window of ``size`` bytes has an anchor, the least-hashed of its ``K``-byte strings (the
   leftmost of equals). Equal windows have equal anchors at equal places, so only windows whose
   anchor occurs twice or more go on. Consecutive windows with one anchor form a segment.
2. Segments with equal bytes are counted; where there are two or more, all their windows repeat.
   This is a partial aggregate, so a group of copies is one row for each map task. Bytes are told
   apart by two independent 64-bit hashes, a polynomial one and XXH3, the second being the
   verification of what the first calls equal without bringing the bytes together.
3. Of the rest, one copy of each distinct segment goes to its anchor's bucket. There the suffixes
   that start at windows with equal distance to the anchor are sorted by mergesort. Suffixes are
   compared by prefix polynomial hashes: a binary search finds their common extension, the next byte
   decides. Neighbours with a common extension of ``size`` bytes are repeats; their bytes are then
   compared, and a class with a hash collision is sorted anew by its bytes.
4. A bucket of more than ``MOST`` distinct segments (a passage in very many different surroundings)
   isn't gathered in one task. Its segments are cut to blocks of ``BLOCK`` windows, whose new anchor is
   all that the block's windows have in common; equal blocks are counted, and the rest sorted by their
   new buckets. In buckets that are still too large (the passage's edges), windows are counted by
   the same two hashes in a partial aggregate.

Then each document's repeated windows are joined to spans. The corpus is shuffled once by its anchors
(8 bytes for about every 50), the texts of documents with repeated anchors twice. Tables that grow
with the corpus are joined by sorting, whose hot keys Spark splits; none of them is broadcast. A document
is named by two 64-bit hashes of its id and text.

Null text counts as empty: 0 bytes, nothing removed. Rows with equal doc_id and text repeat each other
and have equal results; a null doc_id stays null. Other columns are kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE, MIX_A, MIX_B, TextBatch, Workspace, mix64, pieces, powers, prefix_hash

K, MOST, BLOCK = 100, 256, 16
U = np.uint64
PLACE = U((1 << 30) - 1)
_INVERSE = pow(BASE, -1, 1 << 64)


def window_hash(prefix: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of the bytes [start, start + size), wherever they stand."""
    return (prefix[start + size] - prefix[start]) * powers(len(prefix), _INVERSE)[start]


def anchor_places(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the K bytes at each position, the place of each window's anchor, and the prefix hashes.

    Windows are those of the whole array; the caller leaves out those that run over a row's end.
    """
    prefix = prefix_hash(data)
    n = len(data) - K + 1
    gram = (prefix[K:] - prefix[:n]) * powers(n, _INVERSE)
    gram ^= gram >> U(32)
    gram *= U(MIX_A)
    least = (gram & ~PLACE) | np.arange(n, dtype=U)  # the place breaks ties: the leftmost
    reach, width = size - K + 1, 1
    while width * 2 <= reach:  # minimum of 2, 4, 8 ... neighbours
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < reach:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    return gram, (least & PLACE).astype(np.int64), prefix


def segments(texts: TextBatch, size: int) -> tuple[np.ndarray, ...]:
    """For every segment of the batch: anchor hash, its row, first window and number of windows; and the prefix hashes."""
    none = np.zeros(0, dtype=np.int64)
    count = np.maximum(texts.end - texts.start - size + 1, 0)
    filled = np.flatnonzero(count)
    if not len(filled):
        return none.astype(U), none, none, none, prefix_hash(texts.data)
    gram, place, prefix = anchor_places(texts.data, size)
    valid = np.zeros(len(place) + 1, dtype=np.int8)
    np.add.at(valid, texts.start[filled], 1)
    np.add.at(valid, texts.start[filled] + count[filled], -1)
    windows = np.flatnonzero(np.cumsum(valid[:-1], dtype=np.int8))
    row = np.searchsorted(texts.end, windows, side="right")
    head = np.flatnonzero(np.concatenate(([True], (place[windows[1:]] != place[windows[:-1]]) | (row[1:] != row[:-1]))))
    length = np.diff(np.append(head, len(windows)))
    return mix64(gram[place[windows[head]]]), row[head], windows[head], length, prefix


class SuffixSort:
    """Mergesort of suffixes of one byte array by hash-compared common extensions, up to ``size`` bytes."""

    def __init__(self, data: np.ndarray, size: int):
        self.data, self.size = data, size
        self.prefix = prefix_hash(data)
        self.shift = powers(len(self.prefix), _INVERSE)

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of the suffixes at x and y, by binary search on hashes."""
        low, high = np.zeros(len(x), dtype=np.int64), np.full(len(x), self.size, dtype=np.int64)
        fx, fy, px, py = self.shift[x], self.shift[y], self.prefix[x], self.prefix[y]
        middle = high  # the whole length first: repeats end here
        while len(x):
            same = (self.prefix[x + middle] - px) * fx == (self.prefix[y + middle] - py) * fy
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
            if (low >= high).all():
                break
            middle = (low + high + 1) // 2
        return low

    def after(self, x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether the suffix at x sorts after the one at y; equal ones do where ties is set."""
        common = self.extension(x, y)
        at = np.minimum(common, self.size - 1)
        return np.where(common == self.size, ties, self.data[x + at] > self.data[y + at])

    def sort(self, start: np.ndarray, group: np.ndarray) -> np.ndarray:
        """An order of the suffixes by group (which ascends) and then bytes: all groups' runs are merged at once."""
        order = np.arange(len(start))
        head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.append(head, len(start)))
        base, most = np.repeat(head, size), np.repeat(size, size)
        offset = np.arange(len(start)) - base
        run = 1
        while run < size.max(initial=0):
            block = offset // run
            low = (block ^ 1) * run
            high = np.minimum(low + run, most)
            move = np.flatnonzero(low < most)  # others have no sibling to merge with
            lo, hi = base[move] + low[move], base[move] + high[move]
            first, x, right = lo.copy(), start[order[move]], block[move] % 2 == 1
            open_ = np.arange(len(move))
            while len(open_):
                mid = (lo[open_] + hi[open_]) // 2
                up = self.after(x[open_], start[order[mid]], right[open_])
                lo[open_] = np.where(up, mid + 1, lo[open_])
                hi[open_] = np.where(up, hi[open_], mid)
                open_ = open_[lo[open_] < hi[open_]]
            to = np.minimum(block[move], block[move] ^ 1) * run + base[move] + (offset[move] - block[move] * run) + (lo - first)
            new = order.copy()
            new[to] = order[move]
            order = new
            run *= 2
        return order

    def repeats(self, start: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Whether each suffix shares ``size`` bytes with another of its group."""
        out = np.zeros(len(start), dtype=bool)
        if len(start) < 2:
            return out
        order = self.sort(start, group)
        a, b = order[:-1], order[1:]
        near = np.flatnonzero(group[a] == group[b])
        a, b = a[near], b[near]
        same = self.extension(start[a], start[b]) == self.size
        a, b = a[same], b[same]
        real = np.zeros(len(a), dtype=bool)
        span = np.arange(self.size)
        for i in range(0, len(a), 20_000):
            x, y = start[a[i : i + 20_000]], start[b[i : i + 20_000]]
            real[i : i + 20_000] = (self.data[x[:, None] + span] == self.data[y[:, None] + span]).all(axis=1)
        out[a[real]] = out[b[real]] = True
        for g in np.unique(group[a[~real]]):  # a hash collision: this class by its bytes
            own = np.flatnonzero(group == g)
            seen: dict[bytes, list[int]] = {}
            for i in own.tolist():
                seen.setdefault(self.data[start[i] : start[i] + self.size].tobytes(), []).append(i)
            out[own] = False
            for same_bytes in seen.values():
                out[same_bytes] = len(same_bytes) > 1
        return out


#: A document's name: two hashes of its id and text, with seeds of their own.
KEY = ("key", "key2")


def _keys(doc_id: Column, text: Column) -> list[Column]:
    return [F.xxhash64(doc_id, text).alias("key"), F.xxhash64(F.lit(7), text, doc_id).alias("key2")]


def _merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the corpus: by sorting, never by broadcast."""
    return left.join(right.hint("merge"), on, how)


def _checks(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH3 of each data[start:end]."""
    raw = memoryview(np.ascontiguousarray(data))
    return np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)), dtype=U, count=len(start))


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _anchor_lists(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                texts = TextBatch(part.column("text"))
                anchor, row, _, _, _ = segments(texts, size)
                offsets = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(anchor.astype(np.int64)))
                sha = pa.array([hashlib.sha256(texts.text(i)).hexdigest() for i in range(len(texts))])
                yield pa.record_batch([*(part.column(c) for c in ("doc_id", *KEY)), pa.array(texts.end - texts.start), sha, lists], ["doc_id", *KEY, "n_bytes", "sha", "anchors"])

    return docs.select("doc_id", *KEY, "text").mapInArrow(run, "doc_id long, key long, key2 long, n_bytes long, sha string, anchors array<long>")


def _segment_rows(texts: DataFrame, size: int) -> DataFrame:
    """(a, seg, seg2, key, key2, at, n) of every segment whose anchor is in the document's list (or in that of one with its first key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                texts = TextBatch(part.column("text"))
                anchor, row, at, n, prefix = segments(texts, size)
                wanted = part.column("anchors")
                flat = wanted.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U)
                ends = np.append(0, np.cumsum(wanted.value_lengths().to_numpy(zero_copy_only=False)))
                first = np.searchsorted(row, np.arange(len(texts) + 1))
                keep = np.zeros(len(anchor), dtype=bool)
                for i in range(len(texts)):
                    own = slice(first[i], first[i + 1])
                    keep[own] = np.isin(anchor[own], flat[ends[i] : ends[i + 1]])
                anchor, row, at, n = anchor[keep], row[keep], at[keep], n[keep]
                end = at + n - 1 + size
                seg = mix64((prefix[end] - prefix[at]) * powers(len(prefix), _INVERSE)[at] + (end - at).astype(U) * U(MIX_B)) if len(at) else anchor
                keys = [part.column(c).to_numpy(zero_copy_only=False)[row].astype(np.int64) if len(row) else np.zeros(0, np.int64) for c in KEY]
                cols = [anchor.astype(np.int64), seg.astype(np.int64), _checks(texts.data, at, end).astype(np.int64), *keys, (at - texts.start[row]).astype(np.int32), n.astype(np.int32)]
                yield pa.record_batch([pa.array(c) for c in cols], ["a", "seg", "seg2", *KEY, "at", "n"])

    return texts.mapInArrow(run, "a long, seg long, seg2 long, key long, key2 long, at int, n int")


def _cut(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(a, seg, seg2, once, n_segs, bytes) of the wanted segments, cut from one text each."""
    lists = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("a", "seg", "seg2", "at", "n", "once", "n_segs")).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
                raw = text.encode()
                rows += [(c["a"], c["seg"], c["seg2"], c["once"], c["n_segs"], raw[c["at"] : c["at"] + c["n"] - 1 + size]) for c in cuts]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["a", "seg", "seg2", "once", "n_segs", "bytes"])

    whole = _merged(texts.select(*KEY, "text"), lists, list(KEY))
    return whole.select("text", "cuts").mapInArrow(run, "a long, seg long, seg2 long, once boolean, n_segs long, bytes binary")


def _sorted_buckets(cuts: DataFrame, size: int) -> DataFrame:
    """(a, seg, seg2, lo, hi): runs of windows that repeat in their bucket, by suffix sort, for segments that occur once."""

    def solve(a: np.ndarray, seg: np.ndarray, seg2: np.ndarray, once: np.ndarray, raw: list[bytes]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        length = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        begin = np.cumsum(length) - length
        n = length - size + 1
        owner = np.repeat(np.arange(len(raw)), n)
        index = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        start = begin[owner] + index
        away = anchor_places(data, size)[1][start] - start
        bucket = np.cumsum(np.concatenate(([True], a[1:] != a[:-1])))[owner]
        order = np.lexsort((away, bucket))
        group = np.cumsum(np.concatenate(([True], (np.diff(bucket[order]) != 0) | (np.diff(away[order]) != 0))))
        size_of = np.bincount(group)[group]
        order, group = order[size_of > 1], group[size_of > 1]
        flags = np.zeros(len(owner), dtype=bool)
        flags[order] = SuffixSort(data, size).repeats(start[order], group)
        rows = []
        edge = np.cumsum(n)
        for i in np.unique(owner[flags & once[owner]]).tolist():
            rows += [(int(a[i]), int(seg[i]), int(seg2[i]), lo, hi) for lo, hi in _runs(flags[edge[i] - n[i] : edge[i]])]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["a", "seg", "seg2", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            a = table.column("a").to_numpy()
            begin = 0
            while begin < len(a):  # whole buckets, of about 3,000 segments together
                end = min(begin + 3000, len(a))
                end = end if end == len(a) else int(np.searchsorted(a, a[end], side="left"))
                if end <= begin:
                    end = int(np.searchsorted(a, a[begin], side="right"))
                part = table.slice(begin, end - begin)
                yield solve(a[begin:end], part.column("seg").to_numpy(), part.column("seg2").to_numpy(), part.column("once").to_numpy(), part.column("bytes").to_pylist())
                begin = end

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            whole = pa.Table.from_batches(held)
            a = whole.column("a").to_numpy()
            cut = int(np.searchsorted(a, a[-1], side="left"))  # the last bucket may go on in the next batch
            if cut:
                yield from flush(whole.slice(0, cut))
                held = whole.slice(cut).to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held))

    return cuts.select("a", "seg", "seg2", "once", "bytes").repartition("a").sortWithinPartitions("a").mapInArrow(run, "a long, seg long, seg2 long, lo int, hi int")


def _blocks(cuts: DataFrame, size: int) -> DataFrame:
    """(a, seg, seg2, once, off, n, a2, c2, d2, bytes): the blocks of segments, with their new anchor and the hashes of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1 << 20, "bytes"):
                raw = part.column("bytes").to_pylist()
                data = np.frombuffer(b"".join(raw), dtype=np.uint8)
                length = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
                n = length - size + 1
                owner = np.repeat(np.arange(len(raw)), n)
                index = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                start = (np.cumsum(length) - length)[owner] + index
                _, place, prefix = anchor_places(data, size)
                number = (place[start] - start) // BLOCK
                head = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (number[1:] != number[:-1]))))
                count = np.diff(np.append(head, len(owner)))
                core = place[start[head]] - number[head] * BLOCK
                take = lambda name: part.column(name).to_numpy(zero_copy_only=False)[owner[head]]  # noqa: E731, B023
                a = take("a").astype(np.int64)
                a2 = mix64(window_hash(prefix, core, size - BLOCK + 1) + a.view(U) * U(MIX_A) + number[head].astype(U))
                end = start[head] + count - 1 + size
                c2 = mix64((prefix[end] - prefix[start[head]]) * powers(len(prefix), _INVERSE)[start[head]] + count.astype(U) * U(MIX_B))
                cut = [data[x:y].tobytes() for x, y in zip(start[head].tolist(), end.tolist(), strict=True)]
                d2 = _checks(data, start[head], end)
                cols = [a, take("seg"), take("seg2"), take("once"), index[head].astype(np.int32), count.astype(np.int32), a2.astype(np.int64), c2.astype(np.int64), d2.astype(np.int64)]
                yield pa.record_batch([*map(pa.array, cols), pa.array(cut, pa.binary())], ["a", "seg", "seg2", "once", "off", "n", "a2", "c2", "d2", "bytes"])

    return cuts.select("a", "seg", "seg2", "once", "bytes").mapInArrow(run, "a long, seg long, seg2 long, once boolean, off int, n int, a2 long, c2 long, d2 long, bytes binary")


def _large_buckets(cuts: DataFrame, work: Workspace, size: int) -> DataFrame:
    """(a, seg, seg2, lo, hi) as from _sorted_buckets, of the segments of large buckets, by blocks."""
    blocks = work.save(_blocks(cuts, size), "blocks")
    one = blocks.groupBy("a2", "c2", "d2").agg(F.count(F.lit(1)).alias("c"), F.first("bytes").alias("bytes"), F.first("n").alias("n"))
    one = work.save(one, "distinct-blocks")
    mixed = work.save(one.groupBy("a2").agg(F.count(F.lit(1)).alias("n_segs")).filter("n_segs > 1"), "mixed-blocks")
    rest = _merged(one, mixed, "a2").select(F.col("a2").alias("a"), F.col("c2").alias("seg"), F.col("d2").alias("seg2"), (F.col("c") == 1).alias("once"), "n_segs", "bytes")
    rest = work.save(rest, "rest-blocks")
    windows = work.save(_windows(rest.filter(F.col("n_segs") > MOST), size), "windows")
    again = work.save(windows.groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2"), "again")
    edges = _merged(windows, again, ["h1", "h2"]).filter("once").select("a", "seg", "seg2", F.col("i").alias("lo"), (F.col("i") + 1).alias("hi"))
    found = _sorted_buckets(rest.filter(F.col("n_segs") <= MOST), size).union(edges)
    found = found.union(one.filter("c > 1").select("a2", "c2", "d2", F.lit(0), "n"))
    found = work.save(found.select(F.col("a").alias("a2"), F.col("seg").alias("c2"), F.col("seg2").alias("d2"), "lo", "hi"), "found-blocks")
    back = _merged(blocks.filter("once").drop("bytes"), found, ["a2", "c2", "d2"])
    return back.select("a", "seg", "seg2", (F.col("off") + F.col("lo")).alias("lo"), (F.col("off") + F.col("hi")).alias("hi"))


def _windows(cuts: DataFrame, size: int) -> DataFrame:
    """(a, seg, seg2, once, i, h1, h2): every window of the segments of buckets that stay large, by its two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1 << 20, "bytes"):
                raw = part.column("bytes").to_pylist()
                data = np.frombuffer(b"".join(raw), dtype=np.uint8)
                length = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
                n = length - size + 1
                owner = np.repeat(np.arange(len(raw)), n)
                index = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                start = (np.cumsum(length) - length)[owner] + index
                h1 = mix64(window_hash(prefix_hash(data), start, size))
                h2 = _checks(data, start, start + size)
                take = lambda name: part.column(name).to_numpy(zero_copy_only=False)[owner]  # noqa: E731, B023
                cols = [take("a"), take("seg"), take("seg2"), take("once"), index.astype(np.int32), h1.astype(np.int64), h2.astype(np.int64)]
                yield pa.record_batch([pa.array(c) for c in cols], ["a", "seg", "seg2", "once", "i", "h1", "h2"])

    return cuts.select("a", "seg", "seg2", "once", "bytes").mapInArrow(run, "a long, seg long, seg2 long, once boolean, i int, h1 long, h2 long")


def repeated_spans(docs: DataFrame, size: int = 200) -> tuple[DataFrame, DataFrame]:
    """(doc_id, KEY, n_bytes, sha) of each document; and (KEY, text, spans) of those with repeated bytes,
    spans being sorted (start, end) in bytes that may overlap."""
    if size < 2 * K:
        raise ValueError(f"strings must have at least {2 * K} bytes")
    spark, key = docs.sparkSession, list(KEY)
    work = Workspace(spark, "suffix")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", "text", *_keys(F.col("doc_id"), F.col("text")))
    listed = work.save(_anchor_lists(docs, size), "anchors")
    each = listed.select("key", F.explode("anchors").alias("a"))  # one key will do: anchors of another document are passed over
    twice = work.save(each.groupBy("a").count().filter("count > 1").select("a"), "twice")
    lists = _merged(each, twice, "a").groupBy("key").agg(F.collect_set("a").alias("anchors"))
    lists = work.save(lists, "lists")
    texts = work.save(_merged(docs.select(*KEY, "text"), lists, "key"), "texts")
    segs = work.save(_segment_rows(texts, size), "segments")
    distinct = segs.groupBy("a", "seg", "seg2").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*KEY, "at", "n")).alias("p"))
    distinct = work.save(distinct.select("a", "seg", "seg2", "c", "p.*"), "distinct")
    mixed = work.save(distinct.groupBy("a").agg(F.count(F.lit(1)).alias("n_segs")).filter("n_segs > 1"), "mixed")
    wanted = _merged(distinct, mixed, "a").select(*KEY, "a", "seg", "seg2", "at", "n", (F.col("c") == 1).alias("once"), "n_segs")
    one_text = texts.dropDuplicates(key)
    cuts = work.save(_cut(one_text, wanted, size), "cuts")
    small = _sorted_buckets(cuts.filter(F.col("n_segs") <= MOST), size)
    many = cuts.filter(F.col("n_segs") > MOST)
    parts = small if many.isEmpty() else small.union(_large_buckets(many, work, size))
    parts = parts.groupBy("a", "seg", "seg2").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    whole = distinct.filter("c > 1").select("a", "seg", "seg2", F.array(F.struct(F.lit(0).alias("lo"), F.col("n").alias("hi"))).alias("runs"))
    repeats = work.save(parts.union(whole), "repeats")
    place = F.transform("runs", lambda r: F.struct((F.col("at") + r.lo).alias("start"), (F.col("at") + r.hi - 1 + size).alias("end")))
    spans = _merged(segs, repeats, ["a", "seg", "seg2"]).select(*KEY, F.explode(place).alias("span"))
    spans = spans.groupBy(*KEY).agg(F.array_sort(F.collect_set("span")).alias("spans"))
    found = work.save(_merged(one_text.select(*KEY, "text"), spans, key), "spans")
    return listed.drop("anchors"), found


def joined(spans: list[dict]) -> list[tuple[int, int]]:
    """Sorted spans as maximal runs."""
    out: list[list[int]] = []
    for s in spans:
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["start"], s["end"]])
    return [(a, b) for a, b in out]


def _cleaned(found: DataFrame) -> DataFrame:
    """(KEY, n_removed, n_spans, kept_sha256, kept_text) of the documents with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*KEY, "n_removed", "n_spans", "kept_sha256", "kept_text"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for key, key2, text, spans in zip(*(batch.column(c).to_pylist() for c in (*KEY, "text", "spans")), strict=True):
                raw, runs, at, kept = text.encode(), joined(spans), 0, []
                for a, b in runs:
                    kept.append(raw[at:a])
                    at = b
                rest = b"".join([*kept, raw[at:]])
                rows.append((key, key2, len(raw) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), b"".join([*(k.decode(errors="ignore").encode() for k in kept), raw[at:].decode(errors="ignore").encode()]).decode()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, types, strict=True)], names)

    return found.mapInArrow(run, "key long, key2 long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def digest(docs: DataFrame, size: int = 200) -> DataFrame:
    """The columns of the repeated passage query."""
    listed, found = repeated_spans(docs, size)
    done = _cleaned(found).drop("kept_text")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return _merged(listed, done, list(KEY), "left").select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, size: int = 200) -> DataFrame:
    """The documents without repeated bytes; of a character cut in two, the rest goes too."""
    _, found = repeated_spans(docs, size)
    done = _cleaned(found).select(F.col("key").alias("_key"), F.col("key2").alias("_key2"), F.col("kept_text").alias("_kept"))
    one, two = _keys(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = _merged(docs.withColumn("_key", one).withColumn("_key2", two), done, ["_key", "_key2"], "left").withColumn("text", F.coalesce("_kept", "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_kept").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("long"))
    return out.select(docs.columns)
