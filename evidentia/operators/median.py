"""Exact medians without holding the values: selection by rounds of range counts.

A group's median is the mean of the values at two ranks. For each rank a range of values is known that holds it. A round cuts
the range into ``BINS`` of equal width and counts the values in each; the bin that holds the rank, from its least to its
greatest value, is the next range. The least and the greatest fall into different bins, so every round has fewer different
values than the one before. What a round keeps is a row for each bin, rank and group, however many different values there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

BINS = 1024


def exact_median(rows: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    """by, n, median: of the values that aren't null or NaN; a group without any has n = 0 and no median. Without ``by``: one row."""
    by = by or []
    every = stored(rows.select(*by, value.cast("double").alias("_v")).withColumn("_v", F.when(~F.isnan("_v"), F.col("_v"))), "values")
    size = stored(every.groupBy(*by).agg(F.count("_v").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "sizes")
    ranks = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    state = stored(size.filter("n > 0").select(*by, F.explode(ranks).alias("_rank"), "_lo", "_hi").withColumn("_left", F.col("_rank")), "ranges")
    keys, joined = [*by, "_rank"], [F.col(f"v.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by]
    # infinite values, and widths beyond the doubles, are halved into range
    place = lambda v: F.least(F.lit(BINS - 1), F.floor((v / 4 - F.col("_lo") / 4) / (F.col("_hi") / 4 - F.col("_lo") / 4) * BINS).cast("int"))
    bin_of = F.when(F.col("_v") == F.col("_hi"), BINS - 1).when(F.col("_v") == F.col("_lo"), 0).otherwise(F.greatest(F.lit(0), F.coalesce(place(F.col("_v")), F.lit(BINS // 2))))
    while not state.filter("_lo < _hi").isEmpty():
        open_ = state.filter("_lo < _hi")
        met = every.alias("v").join(open_.alias("s"), on=[*joined, F.col("v._v").between(F.col("s._lo"), F.col("s._hi"))])
        counted = met.select(*(F.col(f"s.{c}").alias(c) for c in keys), "s._left", F.col("v._v").alias("_v"), bin_of.alias("_bin"))
        counted = counted.groupBy(*keys, "_left", "_bin").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = counted.withColumn("_before", before).filter((F.col("_left") >= F.col("_before")) & (F.col("_left") < F.col("_before") + F.col("_c")))
        held = held.select(*keys, "_lo", "_hi", (F.col("_left") - F.col("_before")).alias("_left"))
        state = stored(held.unionByName(state.filter("_lo = _hi").select(held.columns)), "ranges")
    found = state.groupBy(*by).agg((F.min("_lo") + (F.max("_lo") - F.min("_lo")) / 2).alias("median"))
    if not by:
        return size.select("n").join(F.broadcast(found), F.col("n") > 0, "left")  # one row each
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    return size.alias("a").join(found.alias("b"), on, "left").select(*(F.col(f"a.{c}").alias(c) for c in by), "n", "median")
