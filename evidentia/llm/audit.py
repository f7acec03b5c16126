"""Source divergence audit: how far the word use of each source of a language is from its other sources and from the language.

Terms are counted in batches (Arrow's dictionary of the words themselves, so no hash stands for a word) and summed by
(lang, source, term). A language keeps the terms of at least ``LEAST`` of its documents. A term's share in a group is the
integer ``1 + floor(10**9 * (count + 5) / (N + 5 V))``, so that all sums are exact.

Sums of differences over all kept terms, for every pair of a language's sources, are split. Terms in at least one of
``HEAVY`` of the groups are heavy: a dense tile of groups by terms, differences row by row. The others are light: a group
without the term has the share of count 0, so for groups a and b with the terms A and B

    sum = (V_light - |A| - |B| + |A & B|) * |a0 - b0| + F_a(b0) + F_b(a0) + sum over A & B of |a - b| - |a - b0| - |b - a0|

where F_a(x) is the sum of |a_t - x| over A, by prefix sums over a's sorted shares, and only terms that both have are met as
postings. Groups are dealt over tiles of about ``TILE`` by a hash of their source and terms over chunks, so a task holds the
postings of two tiles in one chunk, and its partial sums of pairs are added up as longs.

Nulls in text, lang and source are empty; a group whose texts hold no term takes part. Documents are rows: repeated ids are
documents of their own. No document: no row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TextBatch, Workspace, pieces

LEAST, TOP, HEAVY, TILE, ROWS = 30, 50, 4, 256, 25_000
#: Bytes of a term: A-Z, a-z, and all of characters beyond ASCII.
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
GROUP = ["lang", "source"]


def terms(batch: TextBatch) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of all texts of a batch (made with lower), in order, and the row of each."""
    inside = LETTER[batch.data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    filled = batch.end > batch.start  # terms end with their row
    start[batch.start[filled]] |= inside[batch.start[filled]]
    end[batch.end[filled] - 1] |= inside[batch.end[filled] - 1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(batch.data[inside])))
    return words.dictionary_encode(), np.searchsorted(batch.end, start, side="right")


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs: occurrences and documents of each term in each group of a slice."""
    for whole in batches:
        for batch in pieces(whole, 4 << 20, "text"):
            words, row = terms(TextBatch(batch.column("text"), lower=True))
            if not len(words):
                continue
            code, n_words = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(words.dictionary)
            in_doc, n = np.unique(row * n_words + code, return_counts=True)
            names = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], GROUP)
            distinct: dict[tuple, int] = {}
            group = np.array([distinct.setdefault((x["lang"], x["source"]), len(distinct)) for x in names.to_pylist()], dtype=np.int64)
            key, at = np.unique(group[in_doc // n_words] * n_words + in_doc % n_words, return_inverse=True)
            total = np.zeros(len(key), dtype=np.int64)
            np.add.at(total, at, n)
            of = list(distinct)
            own = [of[g] for g in (key // n_words).tolist()]
            columns = [pa.array([g[0] for g in own], pa.string()), pa.array([g[1] for g in own], pa.string()), words.dictionary.take(pa.array(key % n_words)).cast(pa.string())]
            yield pa.record_batch([*columns, pa.array(total), pa.array(np.bincount(at, minlength=len(key)).astype(np.int64))], ["lang", "source", "term", "n", "docs"])


def share(count: str, total: str, kept: str) -> F.Column:
    """1 + floor(10**9 * (count + 5) / (total + 5 * kept)), exactly."""
    return F.expr(f"1 + (cast({count} + 5 AS decimal(20,0)) * 1000000000) div cast({total} + 5 * {kept} AS decimal(20,0))")


def light_sums(p: list[np.ndarray], zero: np.ndarray) -> np.ndarray:
    """[a, b]: the sum of |share - zero[b]| over the shares of a."""
    out = np.zeros((len(p), len(zero)), dtype=np.int64)
    for a, own in enumerate(p):
        if len(own):
            own = np.sort(own)
            below = np.searchsorted(own, zero)
            upto = np.concatenate(([0], np.cumsum(own)))
            out[a] = zero * below - upto[below] + (upto[-1] - upto[below]) - zero * (len(own) - below)
    return out


def tile_sums(left: dict, right: dict, same: bool) -> np.ndarray:
    """[a, b]: what the terms of one chunk add to the sum of the groups a of one tile and b of another (or the same).

    A side holds ``zero`` (each group's share of count 0) and of its postings group, term (codes that both sides share), p, heavy.
    The light terms' part that all pairs have, V_light * |a0 - b0|, isn't in it.
    """
    za, zb = left["zero"], right["zero"]
    gap = np.abs(za[:, None] - zb[None])
    out = np.zeros(gap.shape, dtype=np.int64)
    heavy = np.unique(np.concatenate((left["term"][left["heavy"]], right["term"][right["heavy"]])))
    if len(heavy):
        dense = []
        for side in (left, right):
            tile = np.repeat(side["zero"][:, None], len(heavy), axis=1)
            h = side["heavy"]
            tile[side["group"][h], np.searchsorted(heavy, side["term"][h])] = side["p"][h]
            dense.append(tile)
        for a in range(len(za)):
            out[a] += np.abs(dense[1] - dense[0][a]).sum(axis=1)
    light = []
    for side in (left, right):
        keep = ~side["heavy"]
        order = np.argsort(side["term"][keep], kind="stable")
        light.append([side[k][keep][order] for k in ("term", "group", "p")])
    sizes = [np.bincount(g, minlength=len(z)) for (_, g, _), z in zip(light, (za, zb), strict=True)]
    split = [[p[g == a] for a in range(len(z))] for (_, g, p), z in zip(light, (za, zb), strict=True)]
    out += light_sums(split[0], zb) + light_sums(split[1], za).T - (sizes[0][:, None] + sizes[1][None]) * gap
    (ta, ga, pa_), (tb, gb, pb) = light
    lo, hi = np.searchsorted(tb, ta), np.searchsorted(tb, ta, side="right")
    for i in range(0, len(ta), 4096):  # bounds the postings met at once: a term has at most one in each group of a tile
        n = hi[i : i + 4096] - lo[i : i + 4096]
        a = np.repeat(np.arange(i, i + len(n)), n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[i : i + 4096], n)
        x, y, x0, y0 = pa_[a], pb[b], za[ga[a]], zb[gb[b]]
        np.add.at(out, (ga[a], gb[b]), np.abs(x0 - y0) - np.abs(x - y0) - np.abs(y - x0) + np.abs(x - y))
    if same:
        out = np.triu(out, 1)
    return out


def tile_pairs(postings: pa.Table, groups: pa.Table) -> pa.Table:
    """a, b, value for the pairs of groups of two tiles, of the terms of one chunk; groups: id, side, zero."""
    ids, side = groups.column("id").to_numpy(), groups.column("side").to_numpy()
    zero = groups.column("zero").to_numpy()
    words = postings.column("term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(postings) else np.zeros(0, dtype=np.int64)
    of, own = postings.column("id").to_numpy(), postings.column("side").to_numpy()
    p, heavy = postings.column("p").to_numpy(), postings.column("heavy").to_numpy(zero_copy_only=False).astype(bool)
    sides, names = [], []
    for s in (0, 1):
        name = np.sort(ids[side == s])
        mine = own == s
        sides.append({"zero": zero[side == s][np.argsort(ids[side == s])], "group": np.searchsorted(name, of[mine]), "term": words[mine], "p": p[mine], "heavy": heavy[mine]})
        names.append(name)
    same = not len(names[1])
    if same:
        sides[1], names[1] = sides[0], names[0]
    value = tile_sums(*sides, same)
    a, b = np.triu_indices(len(names[0]), 1) if same else (x.ravel() for x in np.indices(value.shape))
    return pa.table({"a": names[0][a], "b": names[1][b], "value": value[a, b]})


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: sums of differences to the language's other sources, and the terms that a source has more of."""
    spark = docs.sparkSession
    work = Workspace(spark, "audit")
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*GROUP, "text")))
    counts = docs.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    counts = work.save(counts.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    over = Window.partitionBy("lang", "term")  # a row for each source that has the term
    kept = counts.withColumns({"df": F.sum("docs").over(over), "of_lang": F.sum("n").over(over), "present": F.count(F.lit(1)).over(over)}).filter(F.col("df") >= LEAST)
    kept = work.save(kept.drop("docs", "df"), "kept")
    # every group, with its language's totals
    groups = docs.select(*GROUP).distinct().withColumn("id", F.monotonically_increasing_id())
    groups = work.save(groups, "groups")
    totals = kept.groupBy(*GROUP).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))
    langs = groups.join(totals, GROUP, "left").groupBy("lang").agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("total"), F.lit(0)).alias("lang_total"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    sizes = kept.select("lang", "term", "present").distinct().join(langs.select("lang", "n_groups"), "lang").groupBy("lang").agg(
        F.count(F.lit(1)).alias("v"), F.count_if(F.col("present") * HEAVY < F.col("n_groups")).alias("v_light"))
    tiles = F.ceil(F.col("n_groups") / TILE)
    groups = groups.join(totals.drop("rows"), GROUP, "left").join(langs, "lang").join(sizes, "lang", "left").na.fill(0, ["total", "v", "v_light"])
    groups = groups.withColumns({"n_tiles": tiles, "n_chunks": F.greatest(F.lit(1), F.ceil(F.col("rows") / (tiles * ROWS)))})
    groups = groups.withColumns({"tile": F.pmod(F.xxhash64("source"), "n_tiles"), "zero": F.when(F.col("v") > 0, share("0", "total", "v")).otherwise(0)})
    groups = work.save(groups.drop("rows"), "described")
    posted = kept.join(groups, GROUP)
    posted = work.save(posted.select(*GROUP, "id", "term", "n", share("n", "total", "v").alias("p"), share("of_lang", "lang_total", "v").alias("q"), (F.col("present") * HEAVY >= F.col("n_groups")).alias("heavy"),
                                     "tile", "n_tiles", F.pmod(F.xxhash64("term"), "n_chunks").alias("chunk")), "posted")
    top = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    by_term = posted.filter("p > q").select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    by_term = by_term.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= TOP)
    # tiles meet: (i, j) with i <= j; on the diagonal there is one side
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tiles") - 1))
    place = [F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), F.when(F.col("tile") > F.col("other"), 1).otherwise(0).alias("side")]
    left = posted.withColumn("other", other).select("lang", "chunk", *place, "id", "term", "p", "heavy")
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1))
    right = groups.filter("v > 0").withColumn("other", other).withColumn("chunk", chunks).select("lang", "chunk", *place, "id", "zero")
    keys = ("lang", "chunk", "i", "j")
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile_pairs, "a long, b long, value long")
    sums = partial.groupBy("a", "b").agg(F.sum("value").alias("value"))
    sums = work.save(sums.select(F.explode(F.array(F.struct("a", "b", "value"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "value"))).alias("x")).select("x.*"), "sums")
    ones = groups.select(*GROUP, "id", "zero", "v_light")
    others = groups.select("lang", F.col("source").alias("item"), F.col("id").alias("b"), F.col("zero").alias("zero_b"))
    pairs = ones.join(others, "lang").filter("id <> b").join(sums.withColumnRenamed("a", "id"), ["id", "b"], "left")  # a row of the result for each
    by_pair = pairs.select(*GROUP, F.lit("pair").alias("part"), "item", (F.coalesce("value", F.lit(0)) + F.col("v_light") * F.abs(F.col("zero") - F.col("zero_b"))).alias("value"))
    return by_pair.withColumn("rank", F.row_number().over(top)).union(by_term)
