"""Running values along an order, for groups of any size: a prefix scan on two levels.

A group's rows lie in ranges of its order. Each range finds its own running values; one partial value for each range and key
(a count, a sum, a last value) runs along the ranges, and is joined back. The only window over a whole key has a row for each
range, not for each row, so a group of all rows is the work of many tasks. ``numbered`` makes ranges of any order by dealing
rows by range; ``running`` takes them from an order of dense whole numbers, as ``numbered`` gives. What a range's values are
found from is written once, which pins the ranges and keeps an expression from being computed twice.

Rows with a null in the key take no part. An order that ties within a key numbers its ties in any way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Places of a range, about as many rows.
SPAN = 4096


def ranged(rows: DataFrame, key: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """The rows in ranges of (key, order), with ``_range`` and ``_at``, a number that grows along each range."""
    rows = rows.dropna(subset=key)
    dealt = rows.repartitionByRange(parts, *key, *order) if parts else rows.repartitionByRange(*key, *order)
    cut = stored(dealt.sortWithinPartitions(*key, *order).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    return cut.withColumn("_range", F.shiftright("_at", 33))  # the number's upper part is the partition


def numbered(rows: DataFrame, key: list[str], order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """Adds 1, 2, ... along the order of each key. Whole rows move once; what is joined to them has a row for each range and key."""
    cut = ranged(rows, key, order, parts)
    first = cut.groupBy("_range", *key).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.select("_range", *key, (before - F.col("_first") + 1).alias("_shift"))
    out = cut.join(stored(first, "ranges"), ["_range", *key])  # by its real size, which is small, so whole rows needn't move again
    return out.select(*rows.columns, (F.col("_at") + F.col("_shift")).cast("int").alias(name))


def running(rows: DataFrame, key: list[str], order: str, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, before: dict[str, Column] | None = None, span: int = SPAN) -> DataFrame:
    """key, order, and running values along a dense whole-number order; rows hold what the values are made from.

    sums: the sum over the rows before each row (0 for the first); lasts: the last value that isn't null, the row's own
    included; before: the value of the row before, null for the first of its key.
    """
    sums, lasts, before = sums or {}, lasts or {}, before or {}
    every = sums | lasts | before
    cut = stored(rows.dropna(subset=key).select(*key, order, *(c.alias(f"_v_{n}") for n, c in every.items())), "values")
    cut = cut.withColumn("_range", F.floor(F.col(order) / span))
    inside = Window.partitionBy(*key, "_range").orderBy(order)
    upto, past = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    local = {f"_l_{n}": F.coalesce(F.sum(f"_v_{n}").over(past), F.lit(0)) for n in sums}
    local |= {f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(upto) for n in lasts}
    local |= {f"_l_{n}": F.lag(f"_v_{n}").over(inside) for n in before}
    local["_n"] = F.row_number().over(inside)
    whole = [F.coalesce(F.sum(f"_v_{n}"), F.lit(0)).alias(f"_t_{n}") for n in sums]
    whole += [F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))).alias(f"_t_{n}") for n in lasts]
    whole += [F.max_by(F.struct(f"_v_{n}"), order).alias(f"_t_{n}") for n in before]
    along = Window.partitionBy(*key).orderBy("_range")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums]
    carried += [F.last(f"_t_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in lasts]
    carried += [F.lag(f"_t_{n}").over(along)[f"_v_{n}"].alias(f"_c_{n}") for n in before]
    offsets = cut.groupBy(*key, "_range").agg(*whole).select(*key, "_range", *carried)
    offsets = stored(offsets, "offsets")
    out = cut.withColumns(local).join(offsets, [*key, "_range"])
    found = {n: F.col(f"_l_{n}") + F.col(f"_c_{n}") for n in sums}
    found |= {n: F.coalesce(f"_l_{n}", f"_c_{n}") for n in lasts}
    found |= {n: F.when(F.col("_n") > 1, F.col(f"_l_{n}")).otherwise(F.col(f"_c_{n}")) for n in before}
    return out.select(*key, order, *(c.alias(n) for n, c in found.items()))
