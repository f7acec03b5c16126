"""Near-duplicates: one-permutation MinHash, optimal densification, banded buckets, star edges.

A document's set is its distinct k-word shingles (the whole sequence as one if it has fewer words).
One hash of each shingle fills K bins by its leading bits; a bin's least hash is its value, and each
empty bin borrows from the first filled bin of a permutation of its own (optimal densification).
40 bands of 5 bins give the bucket keys: a pair at the threshold of 0.8 shares none with probability
(1 - 0.8**5)**40 = 1.3e-7.

1. Documents with equal sets (equal size and 128-bit digest) are one class; only its smallest id goes on.
2. In each bucket, one hub is drawn and every other member is compared with it: star-shaped edges,
   as many as there are members. Pairs whose sizes rule the threshold out are left out.
3. Edges are confirmed on the full sets of both texts, and joined to components.
4. Buckets whose members are still of two or more components go on without the hubs that all others
   have been compared with, and with sixteen times as many hubs a round, until none is left. So every
   pair of a bucket is compared unless it is connected already or can't be similar: no link is lost
   and nothing is capped, and a group of copies costs about one comparison for each member. As soon as
   the pairs left are few (AT_ONCE), one join finds all of them that can be similar, and if these are no
   more than the next round may compare, they are confirmed at once and no round is left.
5. What can't be similar is bounded by counting. A pair at the threshold shares at least
   a = percent * (n + m) / (100 + percent) shingles. Of the documents in buckets that are large after
   the first round, shingles that just one of them has are counted, u for each; one with
   n - u < a shares too few with any partner of the sizes in its bucket, and leaves it. And each is
   compared once with its bucket's reference R (the root of its most common component): a bit for each
   shingle of R that it has, and the number b of its shingles outside R. Two documents share at most
   popcount(bits & bits') + max(0, min(b - u, b' - u')), which the join tests before a pair is made (R
   itself has all bits and no shingle outside, so its own ones count in bits: b - u is below 0, and the
   popcount alone is exact). So copies with edits of their own aren't compared with all of a large group.

Shuffles: bucket keys once, the texts of bucket members once, then only pairs. Keys are spread over
bands, and joins read written tables, so that Spark can split a hot key (sort-merge skew join).

Null doc_id: the row is kept, linked with nothing, component null. Null, empty and white-space texts
have the empty set and are linked with nothing. Rows that share a doc_id are one node; each keeps a
row in the result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MIX_A, MIX_B, TextBatch, Workspace, mix64, pieces
from .components import components

BANDS, ROWS = 40, 5
BINS = BANDS * ROWS
#: Members from which a bucket counts as large: own shingles are counted then, which changes no result.
LARGE = 32
#: Pairs of members, of all buckets left, up to which one join tests them all; from then on hubs go on. Changes no result.
AT_ONCE = 1 << 25
#: Of a bucket's member: document, set size, own shingles, component, marks against the reference, shingles outside it.
LIVE = ("key", "x", "n", "u", "c", "bits", "b")
U = np.uint64


def shingle_sets(texts: TextBatch, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every row."""
    word, row = texts.word_hashes()
    n = len(texts)
    first = np.searchsorted(row, np.arange(n + 1))
    count = np.diff(first)
    width = np.minimum(count, k)  # of a row's shingles
    factor = mix64(np.arange(1, k + 1, dtype=U)) | U(1)
    total = np.zeros(len(word), dtype=U)
    for j in range(k):
        take = len(word) - j
        if take > 0:
            part = word[j:] * factor[j]
            total[:take] += np.where(width[row[:take]] > j, part, U(0))
    total = mix64(total + width[row].astype(U) * U(MIX_B)) if len(word) else total
    return [np.unique(total[first[i] : first[i] + count[i] - width[i] + 1]) if count[i] else total[:0] for i in range(n)]


def _permutations() -> np.ndarray:
    """Row b: the order in which empty bin b looks for a filled one."""
    key = mix64(np.arange(BINS * BINS, dtype=U) * U(MIX_A) + U(17)).reshape(BINS, BINS)
    return np.argsort(key, axis=1, kind="stable")


_PERMUTATIONS = _permutations()
_FACTORS = mix64(np.arange(BINS, dtype=U) + U(1001)).reshape(BANDS, ROWS) | U(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The densified one-permutation sketch of a non-empty sorted set."""
    at = ((hashes >> U(32)) * U(BINS) >> U(32)).astype(np.int64)
    head = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    sketch, filled = np.zeros(BINS, dtype=U), np.zeros(BINS, dtype=bool)
    sketch[at[head]], filled[at[head]] = hashes[head], True
    if len(head) < BINS:
        empty = np.flatnonzero(~filled)
        order = _PERMUTATIONS[empty]
        sketch[empty] = sketch[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return sketch


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """(rows, BANDS) bucket keys of (rows, BINS) sketches."""
    return mix64((sketches.reshape(len(sketches), BANDS, ROWS) * _FACTORS).sum(axis=2, dtype=U) + np.arange(BANDS, dtype=U) * U(MIX_B))


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size), d1 and d2 (digest of the set), bands (bucket keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                sets = shingle_sets(TextBatch(part.column("text"), lower=True), k)
                sketch = np.zeros((len(sets), BINS), dtype=U)
                d1, d2 = np.zeros(len(sets), dtype=U), np.zeros(len(sets), dtype=U)
                for i, s in enumerate(sets):
                    if len(s):
                        sketch[i] = signature(s)
                        d1[i], d2[i] = mix64(s).sum(dtype=U), mix64(s ^ U(MIX_A)).sum(dtype=U)
                keys = pa.array(band_keys(sketch).astype(np.int64).ravel())
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), keys)
                size = pa.array(np.array([len(s) for s in sets], dtype=np.int64))
                yield pa.record_batch([part.column("doc_id"), size, pa.array(d1.astype(np.int64)), pa.array(d2.astype(np.int64)), bands], ["doc_id", "n", "d1", "d2", "bands"])

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, bands array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose texts' full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1 << 20, "text_u", "text_v"):
                left = shingle_sets(TextBatch(part.column("text_u"), lower=True), k)
                right = shingle_sets(TextBatch(part.column("text_v"), lower=True), k)
                keep = []
                for a, b in zip(left, right, strict=True):
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(common > 0 and 100 * common >= percent * (len(a) + len(b) - common))
                mask = pa.array(np.array(keep, dtype=bool))
                yield pa.record_batch([part.column("u").filter(mask), part.column("v").filter(mask)], ["u", "v"])

    both = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u")), "u")
    both = both.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")), "v")
    return both.select("u", "v", "text_u", "text_v").mapInArrow(run, "u long, v long")


def _own_shingles(texts: DataFrame, k: int) -> DataFrame:
    """(x, u): how many of its shingles each of these documents shares with no other of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                sets = shingle_sets(TextBatch(part.column("text"), lower=True), k)
                ids = np.repeat(part.column("doc_id").to_numpy(zero_copy_only=False), [len(s) for s in sets])
                yield pa.record_batch([pa.array(ids), pa.array(np.concatenate(sets).astype(np.int64))], ["x", "h"])

    each = texts.select("doc_id", "text").mapInArrow(run, "x long, h long")
    single = each.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("x")).filter("c = 1")
    return single.groupBy("x").agg(F.count(F.lit(1)).alias("u"))


def _marks(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(x, r, bits, b): for each pair of x and its reference r, which of r's shingles x has, and how many others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1 << 20, "text_x", "text_r"):
                own = shingle_sets(TextBatch(part.column("text_x"), lower=True), k)
                reference = shingle_sets(TextBatch(part.column("text_r"), lower=True), k)
                bits, outside = [], []
                for x, r in zip(own, reference, strict=True):
                    has = np.isin(r, x, assume_unique=True)
                    flags = np.packbits(np.append(has, np.zeros(-len(has) % 64, dtype=bool)), bitorder="little")
                    bits.append(flags.view(np.int64))
                    outside.append(len(x) - int(has.sum()))
                yield pa.record_batch([part.column("x"), part.column("r"), pa.array(bits, pa.list_(pa.int64())), pa.array(outside, pa.int64())], ["x", "r", "bits", "b"])

    both = pairs.join(texts.select(F.col("doc_id").alias("x"), F.col("text").alias("text_x")), "x")
    both = both.join(texts.select(F.col("doc_id").alias("r"), F.col("text").alias("text_r")), "r")
    return both.select("x", "r", "text_x", "text_r").mapInArrow(run, "x long, r long, bits array<long>, b long")


def _mixed(rest: DataFrame) -> DataFrame:
    """(key, size, least, r): members, least set size and most common component of each bucket of two or more components."""
    parts = rest.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least"))
    keys = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("m").alias("size"), F.min("least").alias("least"), F.max_by("c", F.struct("m", "c")).alias("r"))
    return keys.filter("parts > 1").drop("parts")


def _counted(rest: DataFrame, texts: DataFrame, work: Workspace, k: int) -> DataFrame:
    """Fills in u, bits and b for the members of large buckets; r is their bucket's reference."""
    rest = rest.withColumn("r", F.when(F.col("size") > LARGE, F.col("r")))
    pairs = work.save(rest.filter("r is not null").select("x", "r").distinct(), "marked")
    if pairs.isEmpty():
        return rest
    large = pairs.select(F.explode(F.array("x", "r")).alias("doc_id"))
    texts = work.save(texts.join(large, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "large-texts")
    whole = rest.drop("u", "bits", "b").join(_own_shingles(texts, k), "x", "left").join(_marks(pairs, texts, k), ["x", "r"], "left")
    zero = F.lit(0).cast("long")
    return whole.withColumns({"u": F.when(F.col("r").isNotNull(), F.coalesce("u", zero)).otherwise(zero), "b": F.coalesce("b", zero)})


def _able(rest: DataFrame, percent: int) -> DataFrame:
    """Without the members that no partner in their bucket can match."""
    smallest = F.greatest(F.col("least"), percent * F.col("n") / 100)
    return rest.filter((100 + percent) * (F.col("n") - F.col("u")) >= percent * (F.col("n") + smallest)).select(*LIVE)


def _pairs(live: DataFrame, hubs: DataFrame, percent: int, fits: Column | None = None) -> DataFrame:
    """(u, v): members and hubs (columns hub_*) of a bucket that are of two components and may be similar."""
    at_least = percent * (F.col("n") + F.col("hub_n"))
    fits = F.lit(True) if fits is None else fits
    fits &= (F.col("c") != F.col("hub_c")) & (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
    fits &= (100 + percent) * F.least(F.col("n") - F.col("u"), F.col("hub_n") - F.col("hub_u")) >= at_least
    both = F.aggregate(F.zip_with("bits", "hub_bits", lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0), lambda s, v: s + v)
    shared_at_most = both + F.greatest(F.lit(0), F.least(F.col("b") - F.col("u"), F.col("hub_b") - F.col("hub_u")))
    fits &= F.coalesce((100 + percent) * shared_at_most >= at_least, F.lit(True))
    star = live.join(hubs, "key").filter(fits)
    return star.select(F.least("x", "hub_x").alias("u"), F.greatest("x", "hub_x").alias("v")).distinct()


def _merge(groups: DataFrame | None, links: DataFrame, work: Workspace, step: int) -> DataFrame | None:
    """(x, c): the component so far of every document that has a link."""
    if links.isEmpty():
        return groups
    if groups is None:
        return components(links, work, f"cc{step}").select(F.col("node").alias("x"), F.col("root").alias("c"))
    of = lambda end: groups.select(F.col("x").alias(end), F.col("c").alias(f"c{end}"))
    between = links.join(of("u"), "u", "left").join(of("v"), "v", "left")
    between = work.save(between.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")), f"between{step}")
    roots = components(between, work, f"cc{step}")
    seen = links.select(F.col("u").alias("x")).union(links.select("v")).distinct()
    fresh = seen.join(groups, "x", "left_anti").select("x", F.col("x").alias("c"))
    moved = groups.select("x", "c").union(fresh).join(roots.withColumnRenamed("node", "c"), "c", "left")
    return work.save(moved.select("x", F.coalesce("root", "c").alias("c")), f"groups{step}")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    spark = docs.sparkSession
    work = Workspace(spark, "neardup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = work.save(sketches(docs, k), "sketch")
    whole = sketch.filter("doc_id is not null and n > 0")
    classes = work.save(whole.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    joined = work.save(whole.join(classes, ["n", "d1", "d2"]).select("doc_id", "n", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands")), "joined")
    members = joined.select("doc_id", "n", "rep")
    buckets = joined.filter("bands is not null").select(F.col("rep").alias("x"), "n", F.explode("bands").alias("key"))
    shared = work.save(buckets.groupBy("key").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).filter("lo < hi").select("key"), "shared")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("array<bigint>")
    live = work.save(buckets.join(shared, "key").select("key", "x", "n", zero.alias("u"), F.col("x").alias("c"), none.alias("bits"), zero.alias("b")), "live0")
    within = work.save(live.select(F.col("x").alias("doc_id")).distinct(), "within")
    texts = work.save(docs.join(within, "doc_id", "left_semi"), "texts")

    groups, step, hubs_each = None, 0, 1
    while not live.isEmpty():
        slot = F.pmod(F.xxhash64("x", "key", F.lit(step)), F.lit(hubs_each))
        order = F.struct(F.col("u") / F.col("n"), F.xxhash64("x", "key"))  # those with least of their own first
        hubs = live.groupBy("key", slot.alias("slot")).agg(F.min(F.struct(order.alias("o"), *LIVE[1:])).alias("h"))
        hubs = work.save(hubs.select("key", *(F.col(f"h.{a}").alias(f"hub_{a}") for a in LIVE[1:])), f"hubs{step}")
        pairs = work.save(_pairs(live, hubs, percent), f"pairs{step}")
        groups = _merge(groups, work.save(confirm(pairs, texts, k, percent), f"links{step}"), work, step)
        rest = live.join(hubs.select("key", F.col("hub_x").alias("x")), ["key", "x"], "left_anti")
        if groups is not None:
            rest = rest.join(groups.select("x", F.col("c").alias("g")), "x", "left").withColumn("c", F.coalesce("g", "c")).drop("g")
        rest = work.save(rest.select(*LIVE), f"rest{step}")
        keys = work.save(_mixed(rest), f"mixed{step}")
        rows, most = keys.agg(F.sum("size"), F.sum(F.col("size") * (F.col("size") - 1) / 2)).first()
        if not rows:
            break
        rest = rest.join(keys, "key")
        step, hubs_each = step + 1, hubs_each * 16
        live = work.save(_able(_counted(rest, texts, work, k) if step == 1 else rest, percent), f"live{step}")
        if most <= AT_ONCE:
            others = live.select("key", *(F.col(a).alias(f"hub_{a}") for a in LIVE[1:]))
            pairs = work.save(_pairs(live, others, percent, F.col("x") < F.col("hub_x")), f"all{step}")
            if pairs.count() <= hubs_each * rows:  # no more than the next round may compare
                groups = _merge(groups, work.save(confirm(pairs, texts, k, percent), f"links{step}"), work, step)
                break

    if groups is None:
        found = members.select("doc_id", "n", F.col("rep").alias("component_id"))
    else:
        least = work.save(groups.groupBy("c").agg(F.min("x").alias("component_id")), "least")
        named = work.save(groups.join(least, "c").select(F.col("x").alias("rep"), "component_id"), "named")
        found = members.join(named, "rep", "left").select("doc_id", "n", F.coalesce("component_id", "rep").alias("component_id"))
    alone = sketch.filter("doc_id is null or n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = found.union(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without all but the smallest id of each group; a repeated doc_id stays once, null ids stay."""
    kept = near_duplicates(docs, k, percent).filter("kept and doc_id is not null").select("doc_id")
    one = docs.join(kept, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return one.union(docs.filter("doc_id is null"))
