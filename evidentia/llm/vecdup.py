"""Embedding near-duplicates by randomised-rotation binary codes.

Within a label, vectors whose cosine is at least ``threshold`` are linked. A vector's code is the signs of its
components after a random rotation, with its correction factor ``f``, the inner product of the unit vector and its
code. For a second vector, rotated and quantised to four bits with a fixed dither, ``<code, y> / f`` is an unbiased
estimate of the inner product, whose spread is known: ``sqrt((1 - f^2) / f^2 * (1 - s^2) / (dim - 1))`` at the inner
product s. A pair whose estimate lies ``SIGMAS`` spreads below what a link needs is dropped; every other pair is
computed again from the vectors, so no link is below the threshold.

Candidates: ``TABLES`` cross-polytope tables of ``depth`` rotations each. In each rotation a vector has ``AXES`` cells, the
signed axes that it is closest to. The hit rate of a pair at the threshold is measured for the vectors' length by a
fixed simulation, and there are as many tables as leave a pair unseen with probability 1e-6. The depth grows with the
largest label, so that a cell stays small; the tables make up for it, so recall is the same at every size.

Copies aren't expanded into pairs. Vectors of one home cell are gathered in balls no wider than half the threshold's angle, so
their members are all linked. Balls and single vectors are the units that tables, codes and pairs know. The angle between two
centres and the radii say of most pairs of units that all their members are linked or none; only the others meet member by
member, a pair of units in a task. Cells over ``PART`` are split by a hash, and parts of a table's cell meet two by two.
Links are counted by unit and added up, and edges of units are contracted to components.

Vectors that are null, zero or hold null or non-finite components link with nothing, nor do those without a label or id, or
vectors of two lengths with each other. A row without an id has no component and is kept. Rows that share an id are vectors of their own, with a
row and a count each; a component's id is the least of its rows. No row: no row. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .components import components

AXES, MISS, SIGMAS, PART, CELL, MARGIN = 3, 1e-6, 6.0, 4096, 2048, 1e-7
PAIR = "a long, b long"
UNIT = "rid long, vec_id long, unit long, embedding array<double>, leads boolean, label string, centre array<double>, radius double, weight long, cells array<long>, code binary, f double, lo double, step double, levels binary"


@cache
def rotation(dim: int, number: int) -> np.ndarray:
    """A fixed random rotation."""
    return np.linalg.qr(np.random.default_rng([dim, number]).normal(size=(dim, dim)))[0]


def axes_of(unit: np.ndarray, number: int, most: int = AXES) -> np.ndarray:
    """The signed axes closest to each row after a rotation, closest first."""
    turned = unit @ rotation(unit.shape[1], number)
    order = np.argsort(-np.abs(turned), axis=1, kind="stable")[:, :most]
    return 2 * order + (np.take_along_axis(turned, order, axis=1) > 0)


@cache
def tables(dim: int, threshold: float, depth: int) -> int:
    """How many tables leave a pair at the threshold unseen with probability MISS."""
    rng, n = np.random.default_rng([dim, 99]), 2000
    x, z = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.normal(size=(2, n, dim)))
    z = z - (z * x).sum(axis=1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold * threshold)) * z if dim > 1 else x
    a, b = axes_of(x, 1 << 20), axes_of(y, 1 << 20)
    hit = min(0.999, float((a[:, :, None] == b[:, None]).any(axis=(1, 2)).mean()))
    return max(1, math.ceil(math.log(MISS) / math.log(1 - hit**depth)))


def cells_of(unit: np.ndarray, table: int, depth: int, most: int = AXES) -> np.ndarray:
    """Row by row, the cells of a table: every choice of one of the ``most`` closest axes in each of its rotations."""
    dim = unit.shape[1]
    out = np.full((len(unit), 1), table, dtype=np.int64)
    for d in range(depth):
        own = axes_of(unit, table * depth + d + 1, most)
        out = (out[:, :, None] * (2 * dim) + own[:, None]).reshape(len(unit), -1)
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit_of(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    x, y = scaled(x), scaled(y)
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


def encode(unit: np.ndarray) -> dict[str, np.ndarray]:
    """The code of each row, its correction factor, and its four-bit levels from ``lo`` in steps of ``step``."""
    dim = unit.shape[1]
    turned = unit @ rotation(dim, 0)
    lo = turned.min(axis=1, keepdims=True)
    step = np.maximum((turned.max(axis=1, keepdims=True) - lo) / 14, 1e-300)
    dither = np.random.default_rng([dim, 7]).random(dim)
    levels = np.floor((turned - lo) / step + dither).astype(np.uint8)
    if dim % 2:
        levels = np.concatenate((levels, np.zeros((len(levels), 1), dtype=np.uint8)), axis=1)
    return {"code": np.packbits(turned > 0, axis=1), "f": np.abs(turned).sum(axis=1) / math.sqrt(dim), "lo": lo[:, 0], "step": step[:, 0], "levels": levels[:, ::2] << 4 | levels[:, 1::2]}


def estimates(data: dict, query: dict, dim: int) -> np.ndarray:
    """[i, j]: the estimated inner product of data vector i, by its code, and query vector j, by its levels."""
    signs = np.unpackbits(data["code"], axis=1)[:, :dim].astype(np.float32) * 2 - 1
    levels = np.stack((query["levels"] >> 4, query["levels"] & 15), axis=2).reshape(len(query["levels"]), -1)[:, :dim].astype(np.float32)
    inner = query["lo"] * signs.sum(axis=1, keepdims=True) + query["step"] * (signs @ levels.T)
    return inner / (math.sqrt(dim) * data["f"][:, None])


def may_link(data: dict, query: dict, dim: int, angle: float) -> np.ndarray:
    """[i, j]: whether units may hold a link, at the confidence of SIGMAS."""
    need = np.cos(np.minimum(angle + data["radius"][:, None] + query["radius"], math.pi))
    f = data["f"][:, None]
    spread = np.sqrt(np.maximum(1 - f * f, 0) / (f * f) * (1 - need * need) / max(dim - 1, 1) + (query["step"] / (2 * f)) ** 2)
    return estimates(data, query, dim) >= need - SIGMAS * spread - 1e-6


def balls(unit: np.ndarray, angle: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(members, centre, radius) in which all are linked with all; vectors of no ball are alone with radius 0."""
    free, out = np.ones(len(unit), dtype=bool), []
    for i in range(len(unit)):
        if not free[i]:
            continue
        rest = np.flatnonzero(free)
        own = rest[(unit[rest] @ unit[i] >= math.cos(angle / 2)) | (rest == i)]
        centre, radius = unit[i], 0.0
        if len(own) > 1:
            centre = unit_of(unit[own].sum(axis=0, keepdims=True))[0]
            far = np.arccos(np.clip(unit[own] @ centre, -1, 1))
            own = own[(far <= angle / 2 - MARGIN) | (own == i)]
            radius = float(np.arccos(np.clip(unit[own] @ centre, -1, 1)).max()) + MARGIN
            if len(own) == 1 or radius > angle / 2:
                own, centre, radius = np.array([i]), unit[i], 0.0
        free[own] = False
        out.append((own, centre, radius))
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def units_of(rows: pa.Table, threshold: float, depth: int) -> Iterator[pa.RecordBatch]:
    """The members of some home cells, each with its unit; a unit's first member leads and carries what the unit is."""
    angle = math.acos(threshold)
    dims = rows.column("dim").to_numpy()
    label_code = rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    _, code = np.unique(np.stack((label_code, dims, rows.column("home").to_numpy())), axis=1, return_inverse=True)
    order = np.lexsort((rows.column("rid").to_numpy(), code))
    cuts = np.flatnonzero(np.diff(code[order])) + 1
    for at in np.split(order, cuts):
        part, dim = rows.take(pa.array(at)), int(dims[at[0]])
        x = _matrix(part.column("embedding"), dim)
        unit, rid, label = unit_of(x), part.column("rid").to_numpy(), part.column("label")[0].as_py()
        n = len(at)
        cells = np.concatenate([cells_of(unit, t, depth) for t in range(tables(dim, threshold, depth))], axis=1)
        own = np.empty(n, dtype=np.int64)
        leads = np.zeros(n, dtype=bool)
        centres, radius, weight, held = [None] * n, [None] * n, [None] * n, [None] * n
        first = []
        for members, centre, r in balls(unit, angle):
            i = members[0]
            own[members], leads[i] = rid[i], True
            centres[i], radius[i], weight[i] = (x[i] if len(members) == 1 else centre), r, len(members)
            held[i] = np.unique(cells[members])
            first.append(i)
        what = encode(unit_of(np.stack([centres[i] for i in first])))
        spread = {k: [None] * n for k in what}
        for j, i in enumerate(first):
            for k in what:
                spread[k][i] = what[k][j].tobytes() if k in ("code", "levels") else float(what[k][j])
        doubles = pa.list_(pa.float64())
        columns = [part.column("rid"), part.column("vec_id"), pa.array(own), part.column("embedding").cast(doubles), pa.array(leads), pa.array([f"{label}|{dim}"] * n), pa.array(centres, doubles), pa.array(radius, pa.float64()),
                   pa.array(weight, pa.int64()), pa.array(held, pa.list_(pa.int64())), *(pa.array(spread[k], pa.binary() if k in ("code", "levels") else pa.float64()) for k in ("code", "f", "lo", "step", "levels"))]
        names = [c.split()[0] for c in UNIT.split(", ")]
        yield from pa.table(columns, names).combine_chunks().to_batches()


def side_of(rows: pa.Table) -> dict:
    """Codes of units as arrays."""
    out = {k: rows.column(k).to_numpy() for k in ("unit", "radius", "f", "lo", "step")}
    for k in ("code", "levels"):
        flat = b"".join(rows.column(k).to_pylist())
        out[k] = np.frombuffer(flat, dtype=np.uint8).reshape(len(rows), -1)
    return out


def candidates(rows: pa.Table, angle: float) -> pa.Table:
    """a, b: units of one cell that may hold a link. Split cells come as one part (side 0) or two."""
    found = []
    dims = np.array([int(x.rsplit("|", 1)[1]) for x in rows.column("label").to_pylist()])
    _, label = np.unique(np.array(rows.column("label").to_pylist(), dtype=object), return_inverse=True)
    order = np.lexsort((rows.column("unit").to_numpy(), rows.column("cell").to_numpy(), label))
    cell = rows.column("cell").to_numpy()[order]
    cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(label[order]) != 0)) + 1
    side = rows.column("side").to_numpy()
    for at in np.split(order, cuts):
        if len(at) < 2:
            continue
        dim, second = int(dims[at[0]]), at[side[at] == 1]
        left = side_of(rows.take(pa.array(at[side[at] == 0])))
        right = side_of(rows.take(pa.array(second))) if len(second) else left
        for i in range(0, len(left["unit"]), 512):
            some = {k: v[i : i + 512] for k, v in left.items()}
            r, c = np.nonzero(may_link(some, right, dim, angle))
            a, b = some["unit"][r], right["unit"][c]
            keep = a != b if len(second) else a < b
            found.append(np.stack((np.minimum(a, b)[keep], np.maximum(a, b)[keep])))
    both = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), dtype=np.int64)
    return pa.table({"a": both[0], "b": both[1]})


def decided(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """a, b, kind of pairs of units: 1 if all their members are linked, 0 if none, 2 if members have to meet."""
    angle = math.acos(threshold)
    for batch in batches:
        dims = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
        kind = np.zeros(len(dims), dtype=np.int32)
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            part = batch.take(pa.array(at))
            cos = cosine(_matrix(part.column("x"), dim), _matrix(part.column("y"), dim))
            wide = part.column("rx").to_numpy() + part.column("ry").to_numpy()
            gap = np.arccos(np.clip(cos, -1, 1))
            balls_ = np.where(gap + wide <= angle - MARGIN, 1, np.where(gap - wide > angle + MARGIN, 0, 2))
            kind[at] = np.where(wide > 0, balls_, cos >= threshold)
        yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(kind)], ["a", "b", "kind"])


def linked_members(key: tuple, left: pa.Table, right: pa.Table, threshold: float) -> pa.Table:
    """a, b, rid, n: the links of the members of unit a with those of unit b."""
    dim = len(left.column("embedding")[0])
    x, y = (scaled(_matrix(t.column("embedding"), dim)) for t in (left, right))
    square = [(v * v).sum(axis=1) for v in (x, y)]
    n, m = np.zeros(len(x), dtype=np.int64), np.zeros(len(y), dtype=np.int64)
    for i in range(0, len(x), 256):
        root = np.sqrt(square[0][i : i + 256, None] * square[1])
        cos = x[i : i + 256] @ y.T / root
        r, c = np.nonzero(np.abs(cos - threshold) < 1e-9)
        cos[r, c] = cosine(x[i + r], y[c])  # as elsewhere, to the last digit
        n[i : i + 256] += (cos >= threshold).sum(axis=1)
        m += (cos >= threshold).sum(axis=0)
    rid = np.concatenate((left.column("rid").to_numpy(), right.column("rid").to_numpy()))
    n = np.concatenate((n, m))
    rid, n = rid[n > 0], n[n > 0]
    return pa.table({"a": np.full(len(n), key[0].as_py(), dtype=np.int64), "b": np.full(len(n), key[1].as_py(), dtype=np.int64), "rid": rid, "n": n})


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, depth: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row. depth: rotations of a table, by the largest label where None."""
    spark = vectors.sparkSession
    work = Workspace(spark, "vecdup")
    e = F.col("embedding")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(e, lambda v: v != 0)
    fine = F.coalesce(fine & F.col("vec_id").isNotNull() & F.col("label").isNotNull(), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    if dict(rows.dtypes)["embedding"] != "array<float>":  # floats are doubles already, in half the room
        rows = rows.withColumn("embedding", e.cast("array<double>"))
    rows = work.save(rows.withColumn("fine", fine).withColumn("rid", F.monotonically_increasing_id()), "rows")
    base = rows.filter("fine").withColumn("dim", F.size("embedding")).drop("fine")
    if depth is None:
        head = base.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
        n, dim = (int(head[0]["n"]), int(head[0]["dim"])) if head else (1, 1)
        depth = max(1, math.ceil(math.log(max(n / CELL, 1)) / math.log(max(2 * dim / AXES, 2))))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            home = np.zeros(len(dims), dtype=np.int64)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                home[at] = cells_of(unit_of(_matrix(batch.column("embedding").take(pa.array(at)), dim)), 0, depth, 1)[:, 0]
            yield pa.record_batch([*batch.columns, pa.array(home)], [*batch.schema.names, "home"])

    at_home = base.mapInArrow(homes, ", ".join(f"{name} {kind}" for name, kind in base.dtypes) + ", home long")
    sizes = work.save(at_home.groupBy("label", "dim", "home").agg(F.count(F.lit(1)).alias("n")), "sizes")
    # home cells share groups of about PART rows; a larger one is split by a hash of the row
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = max(1, -(-int(total) // PART))
    large = sizes.filter(F.col("n") > PART).withColumn("parts", F.ceil(F.col("n") / PART)).drop("n")
    dealt = at_home.join(large, ["label", "dim", "home"], "left")
    dealt = dealt.withColumns({"deal": F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("label", "dim", "home"), F.lit(groups))).otherwise(-1 - F.pmod(F.xxhash64("label", "dim", "home"), F.lit(1 << 40))),
                               "part": F.coalesce(F.pmod(F.xxhash64("rid"), "parts"), F.lit(0))})
    members = dealt.groupBy("deal", "part").applyInArrow(lambda t: pa.Table.from_batches(units_of(t, threshold, depth)), UNIT)
    members = work.save(members, "members")
    leaders = members.filter("leads").select("unit", "label", "centre", "radius", "weight", "cells", "code", "f", "lo", "step", "levels")

    cells = work.save(leaders.select("unit", "label", F.explode("cells").alias("cell"), "radius", "code", "f", "lo", "step", "levels"), "cells")
    held = work.save(cells.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "held")
    groups = max(1, -(-int(held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // PART))
    wide = held.withColumn("parts", F.when(F.col("n") > CELL, F.ceil(F.col("n") / CELL))).drop("n")
    met = cells.join(wide, ["label", "cell"])
    small = met.filter("parts IS NULL").withColumns({"deal": F.pmod(F.xxhash64("label", "cell"), F.lit(groups)), "i": F.lit(0).cast("long"), "j": F.lit(0).cast("long"), "side": F.lit(0)})
    split = met.filter("parts IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("unit"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    split = split.select(*small.drop("deal", "i", "j", "side").columns, (-1 - F.pmod(F.xxhash64("label", "cell"), F.lit(1 << 40))).alias("deal"),
                         F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), F.when(F.col("part") > F.col("other"), 1).otherwise(0).alias("side"))
    angle = math.acos(threshold)
    pairs = small.unionByName(split).drop("parts").groupBy("deal", "i", "j").applyInArrow(lambda t: candidates(t, angle), PAIR).distinct()
    pairs = work.save(pairs, "candidates")

    one = leaders.select(F.col("unit").alias("a"), F.col("centre").alias("x"), F.col("radius").alias("rx"), F.col("weight").alias("wa"))
    two = leaders.select(F.col("unit").alias("b"), F.col("centre").alias("y"), F.col("radius").alias("ry"), F.col("weight").alias("wb"))
    judged = pairs.join(one.drop("wa"), "a").join(two.drop("wb"), "b").mapInArrow(lambda it: decided(it, threshold), PAIR + ", kind int")
    judged = work.save(judged.filter("kind > 0"), "judged")
    sure = judged.filter("kind = 1")
    counts = sure.join(two.select("b", "wb"), "b").select(F.col("a").alias("unit"), F.col("wb").alias("n")).union(sure.join(one.select("a", "wa"), "a").select(F.col("b").alias("unit"), F.col("wa").alias("n")))
    counts = counts.union(leaders.select("unit", F.col("weight") - 1)).groupBy("unit").agg(F.sum("n").alias("n"))

    unclear = judged.filter("kind = 2").drop("kind")
    left = unclear.join(members.select(F.col("unit").alias("a"), "rid", "embedding"), "a")
    right = work.again(judged).filter("kind = 2").drop("kind").join(work.again(members).select(F.col("unit").alias("b"), "rid", "embedding"), "b")
    single = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(lambda key, x, y: linked_members(key, x, y, threshold), PAIR + ", rid long, n long")
    single = work.save(single, "members-linked")
    edges = sure.select(F.col("a").alias("u"), F.col("b").alias("v")).union(single.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    labels = components(work.save(edges, "edges"), work, "units")

    own = single.groupBy("rid").agg(F.sum("n").alias("m"))
    of_unit = members.groupBy("unit").agg(F.min("vec_id").alias("low")).join(labels.withColumnRenamed("node", "unit"), "unit", "left").withColumn("root", F.coalesce("root", "unit"))
    least = of_unit.groupBy("root").agg(F.min("low").alias("component_id"))
    of_unit = of_unit.join(least, "root").join(counts, "unit").select("unit", "component_id", "n")  # roots meet units, not rows
    placed = members.select("rid", "unit").join(of_unit, "unit").join(own, "rid", "left")
    placed = placed.select("rid", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("rid", "vec_id").join(placed, "rid", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
