"""Two-level scans against plain loops: a document of nearly all rows, ties with nulls, one range and many."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import scan

ROWS = "document string, place int, n long, word string"


def plain(rows):
    out, state = [], {}
    for d, p, n, w in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1])):
        i, total, last, past = state.get(d, (0, 0, None, None))
        out.append((d, p, i + 1, total, w if w is not None else last, past))
        state[d] = (i + 1, total + (n or 0), w if w is not None else last, w)
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 3, 17, None])
def test_scans_equal_a_loop(spark, parts):
    rng = random.Random(parts)
    places = rng.sample(range(100_000), 1500)
    rows = [("hot" if rng.random() < 0.9 else rng.choice("abcd"), p, rng.choice([None, 1, 5, 10**12]), rng.choice([None, None, None, "x", "y", ""])) for p in places] + [(None, 1, 1, "z")]
    frame = spark.createDataFrame(rows, ROWS)
    number = scan.numbered(frame, ["document"], ["place"], "i", parts).select("document", "place", "i")
    values = scan.running(frame, ["document"], "place", {"total": F.col("n")}, {"last": F.col("word")}, {"past": F.col("word")}, span=100_000 // (parts or 99))
    got = values.join(number, ["document", "place"]).select("document", "place", "i", "total", "last", "past").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(plain(rows), key=repr)


def test_a_document_of_all_rows_lies_in_many_ranges(spark):
    frame = spark.range(4000).select(F.lit("one").alias("document"), F.col("id").alias("place"))
    cut = scan.ranged(frame, ["document"], ["place"], 16)
    sizes = [r[1] for r in cut.groupBy("_range").count().collect()]
    assert len(sizes) >= 14 and max(sizes) < 900
    assert scan.numbered(frame, ["document"], ["place"], "i", 16).filter("i <> place + 1").count() == 0


def test_no_rows(spark):
    frame = spark.createDataFrame([], ROWS)
    assert scan.numbered(frame, ["document"], ["place"], "i").collect() == []
    assert scan.running(frame, ["document"], "place", {"s": F.col("n")}, {"l": F.col("word")}).columns == ["document", "place", "s", "l"]
