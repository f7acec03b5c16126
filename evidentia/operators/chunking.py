"""Fixed-window and structure-aware chunks.

Fixed chunks don't build the corpus string: each page is cut by the windows that it touches, and the
pieces are grouped by (document, window). So no task holds a document, and one shuffle is enough.
Where it lies is known from the pages' lengths alone, added up by a scan over ranges of pages; texts are joined to that.

Structured chunks are found likewise, from the lengths of units; a change of chapter begins anew. A run of units of one chapter
is cut into segments. What a chunk will hold depends only on where the one before it ended, so a segment finds, for every place
where the segment before may leave it, where it will leave the next one and with how many chunks; those answers are chained
along the run's segments, and then every segment finds its own chunks. So a document that is all one chapter is the work of
many tasks, and only a few numbers of each segment come together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LATIN, ChunkConfig, Lexicon
from ..functions import text as X
from ..schemas import CHUNK
from ..sources.scratch import stored
from . import scan
from .blocks import slices
from .ingest import require_none

UNITS = "document_id string, pdf_page int, unit int, chapter string, text string, n int"

#: Fixed windows of a range.
WINDOWS = 256


def chunk_name(strategy: str) -> Column:
    """A chunk's id: its number has five digits at least, and more where a document has over 100,000 chunks (``lpad`` would cut them off)."""
    return F.concat("document_id", F.lit(f"_{strategy}_"), F.format_string("%05d", "chunk_index")).alias("chunk_id")


def fixed_chunks(pages: DataFrame, config: ChunkConfig | None = None, lexicon: Lexicon = LATIN) -> DataFrame:
    """document_id, chunk_index, chunk_id, text, char_count, pdf_pages, chapter, chapters of every window that isn't blank.

    pages: document_id, pdf_page, text, chapter. Pages are joined by blank lines; windows begin every
    size - overlap characters and end with the first that reaches the end. Pages without a document have none.
    """
    config = config or ChunkConfig()
    step = config.size - config.overlap
    rows = stored(pages.select("document_id", "pdf_page", "chapter", X.strip(F.coalesce("text", F.lit(""))).alias("text")).filter("text <> ''"), "stripped")
    lengths = rows.select("document_id", "pdf_page", F.length("text").cast("long").alias("n"))
    ends = lengths.groupBy("document_id").agg((F.sum(F.col("n") + 2) - 2).alias("total"))
    places = lengths.join(scan.running(lengths, ["document_id"], "pdf_page", sums={"a": F.col("n") + 2}), ["document_id", "pdf_page"])
    rows = rows.join(places.join(ends, "document_id"), ["document_id", "pdf_page"])
    rows = rows.withColumn("piece", F.when(F.col("a") + F.col("n") < F.col("total"), F.concat("text", F.lit("\n\n"))).otherwise(F.col("text")))
    rows = rows.withColumn("b", F.col("a") + F.length("piece"))
    last = F.greatest(F.lit(0), F.ceil((F.col("total") - config.size) / step))
    first = F.greatest(F.lit(0), F.floor((F.col("a") - config.size) / step) + 1)
    final = F.least(last, F.floor((F.col("b") - 1) / step))
    rows = rows.filter(first <= final).withColumn("k", F.explode(F.sequence(first, final)))
    low = F.greatest(F.col("k") * step, F.col("a"))
    high = F.least(F.col("k") * step + config.size, F.col("b"))
    touches = (F.col("a") < F.col("k") * step + config.size) & (F.col("a") + F.col("n") > F.col("k") * step)
    cut = rows.filter(low < high).select(
        "document_id", "k", "pdf_page", "chapter", touches.alias("in"), F.expr("piece").substr((low - F.col("a") + 1).cast("int"), (high - low).cast("int")).alias("part")
    )
    cuts = F.array_sort(F.collect_list(F.struct("pdf_page", "part", "in", "chapter")))
    # windows of a range come to one task, which numbers those that aren't blank; the ranges' counts are added up
    dealt = cut.withColumn("r", F.floor(F.col("k") / WINDOWS)).repartition("document_id", "r")
    out = dealt.groupBy("document_id", "r", "k").agg(cuts.alias("c"))
    inside = F.filter("c", lambda x: x["in"])
    named = F.array_distinct(F.filter(F.transform(inside, lambda x: x.chapter), lambda x: x != lexicon.unknown))
    out = out.select("document_id", "r", "k", X.strip(F.array_join(F.transform("c", lambda x: x.part), "")).alias("text"), F.array_distinct(F.transform(inside, lambda x: x.pdf_page)).alias("pdf_pages"), named.alias("chapters"))
    out = out.filter("text <> ''").withColumn("i", F.row_number().over(Window.partitionBy("document_id", "r").orderBy("k")))
    out = stored(out.withColumn("char_count", X.compact_count(F.col("text"))), "fixed-chunks")
    ranges = scan.running(out.groupBy("document_id", "r").agg(F.count(F.lit(1)).alias("n")), ["document_id"], "r", sums={"before": F.col("n")})
    out = out.join(stored(ranges, "ranges"), ["document_id", "r"]).withColumn("chunk_index", (F.col("before") + F.col("i") - 1).cast("int"))
    return out.select(
        "document_id", "chunk_index", chunk_name("baseline"),
        "text", "char_count", "pdf_pages", F.coalesce(F.get("chapters", F.lit(0)), F.lit(lexicon.unknown)).alias("chapter"), "chapters",
    )


def fixed_quality(chunks: DataFrame, *more: Column) -> DataFrame:
    """Counts of chunks, of those over pages and chapters, and their lengths, for each document; ``more``: further aggregates."""
    return chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.count_if(F.size("pdf_pages") > 1).alias("cross_page"),
        F.count_if(F.size("chapters") > 1).alias("cross_chapter"),
        F.min("char_count").alias("min_chars"),
        F.max("char_count").alias("max_chars"),
        F.sum("char_count").alias("sum_chars"),
        F.bround(F.avg("char_count"), 2).alias("mean_chars"),
        F.min_by("chunk_id", "chunk_index").alias("first_chunk"),
        F.max_by("chunk_id", "chunk_index").alias("last_chunk"),
        *more,
    )


def first_from(cumulated: np.ndarray, start: int, size: int, beyond: bool) -> int:
    """The least end with cumulated[end] - cumulated[start] >= size (> size if ``beyond``); the array's length if there is none."""
    return int(np.searchsorted(cumulated, cumulated[start] + size, side="right" if beyond else "left"))


def sentence_groups(lengths: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of sentences that fill ``most`` characters together; one that is longer by itself is a range of its own."""
    total, n, out, at = np.append(0, np.cumsum(lengths)), len(lengths), [], 0
    alone = np.append(np.flatnonzero(lengths > most), n)
    while at < n:
        wall = int(alone[np.searchsorted(alone, at)])
        end = at + 1 if wall == at else min(wall, first_from(total, at, most, True) - 1)
        out.append((at, end))
        at = end
    return out


def cut_text(text: str, most: int, ends: str) -> list[str]:
    """A unit's text in parts of ``most`` characters: along sentences if it has two or more, else hard."""
    parts = [s for s in map(str.strip, re.split(f"(?<=[{re.escape(ends)}])", text)) if s]
    if len(parts) > 1:
        groups = sentence_groups(np.array([len(p) for p in parts]), most)
        parts = ["".join(parts[a:b]) for a, b in groups]
    else:
        parts = [text]
    return [p[i : i + most] for p in parts for i in range(0, len(p), most)]


def line_groups(lengths: np.ndarray, ending: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of neighbouring lines that make one unit.

    A unit ends after its first line that ends a sentence and with which it has half of ``most``
    characters, or before the first line that it has no room for, whichever comes first.
    """
    total, n, out, at = np.append(0, np.cumsum(lengths)), len(lengths), [], 0
    marks = np.append(np.flatnonzero(ending), n)
    while at < n:
        enough = max(first_from(total, at, most // 2, False) - 1, at)
        full = max(first_from(total, at, most, True) - 1, at + 1)
        end = min(int(marks[np.searchsorted(marks, enough)]) + 1, full, n)
        out.append((at, end))
        at = end
    return out


def page_units(text: str, most: int, heading: re.Pattern, ends: str) -> list[str]:
    """Units of one page: a heading is one, and so are the groups of the lines between blank lines and headings."""
    lines = [line.strip() for line in text.strip().splitlines()]
    single = np.array([bool(line) and len(line) <= 80 and heading.match(line) is not None for line in lines], dtype=bool)
    inside = np.array([bool(line) for line in lines], dtype=bool) & ~single
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.astype(np.int8), [0]))))
    blocks = [(int(i), [lines[i]]) for i in np.flatnonzero(single)]
    for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        own = lines[lo:hi]
        groups = line_groups(np.array([len(x) for x in own]), np.array([x[-1] in ends for x in own]), most)
        blocks += [(lo + a, cut_text("\n".join(own[a:b]), most, ends)) for a, b in groups]
    return [u for _, units in sorted(blocks) for u in units if u.strip()]


def chunk_ranges(lengths: np.ndarray, config: ChunkConfig, overlap: int = 0) -> tuple[list[tuple[int, int]], int, int]:
    """Chunks as ranges of units, by the units' lengths alone; where the next one begins; and the first unit in no chunk yet.

    The first ``overlap`` units are known to be in the chunk before. Joined units are two characters
    apart. A chunk ends with the unit that brings it to ``target``, or before the first that would
    bring it over ``most``, but has one unit at least that the chunk before lacks. It begins with the
    last units of the chunk before, as many as ``structured_overlap`` characters hold, one at least.
    """
    total = np.append(0, np.cumsum(lengths))
    joined = total + 2 * np.arange(len(total))
    out, begin, fresh = [], 0, overlap
    while fresh < len(lengths):
        reached = first_from(joined, begin, config.target + 2, False)
        over = first_from(joined, begin, config.most + 2, True) - 1
        end = max(min(reached, over), fresh + 1)
        if end > len(lengths) or (end == len(lengths) and reached > end):
            break  # open: it may take more units
        out.append((begin, end))
        kept = int(np.searchsorted(total, total[end] - config.structured_overlap))
        begin, fresh = max(begin, min(kept, end - 1)) if config.structured_overlap else end, end
    return out, begin, fresh


PLACES = "document_id string, run long, i long, pdf_page int, unit int"
#: Units of a segment, and rows that a task works on, about.
SEGMENT, ROWS = 4096, 50_000
RUN = ["document_id", "run"]


def units(pages: DataFrame, config: ChunkConfig | None = None, lexicon: Lexicon = LATIN) -> DataFrame:
    """Units of every page with their lengths, page by page: no shuffle."""
    config, heading = config or ChunkConfig(), re.compile(lexicon.heading)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            found = [page_units(text or "", config.unit, heading, lexicon.sentence_ends) for text in part.column("text").to_pylist()]
            size = np.array([len(own) for own in found], dtype=np.int64)
            of = pa.array(np.repeat(np.arange(len(found)), size))
            number = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            texts = [u for own in found for u in own]
            columns = [*(part.column(c).take(of) for c in ("document_id", "pdf_page")), pa.array(number, pa.int32()), part.column("chapter").take(of)]
            yield pa.record_batch([*columns, pa.array(texts, pa.string()), pa.array([len(u) for u in texts], pa.int32())], ["document_id", "pdf_page", "unit", "chapter", "text", "n"])

    return pages.select("document_id", F.col("pdf_page").cast("int").alias("pdf_page"), "chapter", "text").mapInArrow(run, UNITS)


def halo(config: ChunkConfig) -> tuple[int, int]:
    """How many units a chunk may begin before, and end after, the end of the chunk before it."""
    return config.structured_overlap + 1, (config.target + 2) // 3 + 2


def segmented(config: ChunkConfig) -> bool:
    """Whether every chunk holds more than the overlap, so that the end of a chunk alone decides what follows. Else a run is one segment."""
    return 3 * config.structured_overlap <= config.target and 3 * config.structured_overlap + max(config.unit, 80) + 2 <= config.most


def next_ends(lengths: np.ndarray, config: ChunkConfig) -> tuple[np.ndarray, np.ndarray]:
    """For each place where a chunk may have ended: where the next one begins, and where it ends (beyond the last unit if it is open)."""
    n = len(lengths)
    total = np.append(0, np.cumsum(lengths))
    joined, ends = total + 2 * np.arange(n + 1), np.arange(n)
    begin = np.minimum(np.searchsorted(total, total[:-1] - config.structured_overlap), np.maximum(ends - 1, 0)) if config.structured_overlap else ends
    reached = np.searchsorted(joined, joined[begin] + config.target + 2)
    over = np.searchsorted(joined, joined[begin] + config.most + 2, side="right") - 1
    end = np.maximum(np.minimum(reached, over), ends + 1)
    return begin, np.where((end > n) | ((end == n) & (reached > n)), n + 1, end)


def crossings(lengths: np.ndarray, first: int, own: int, config: ChunkConfig) -> list[tuple[int, int, int, int]]:
    """(from, to, exit, chunks), by places from the segment's first unit: entries at from..to leave at ``exit`` after so many chunks.

    lengths: of the segment's ``own`` units, from place ``first``, and of their neighbours. An exit of -1 is the end of the run.
    """
    _, end = next_ends(lengths, config)
    n, beyond = len(lengths), first + own
    leaves, chunks = np.empty(own, dtype=np.int64), np.ones(own, dtype=np.int64)
    for p in range(own - 1, -1, -1):
        e = int(end[first + p])
        if e >= n:
            leaves[p] = -1
        elif e >= beyond:
            leaves[p] = e - first
        else:
            leaves[p] = leaves[e - first]
            chunks[p] += chunks[e - first]
    upto = min(own, halo(config)[1] + 1)
    edge = np.flatnonzero((np.diff(leaves[:upto]) != 0) | (np.diff(chunks[:upto]) != 0)) + 1
    starts, stops = np.append(0, edge), np.append(edge, upto) - 1
    return [(int(a), int(b), int(leaves[a]), int(chunks[a])) for a, b in zip(starts, stops, strict=True)]


def segment_chunks(lengths: np.ndarray, first: int, own: int, entry: int, config: ChunkConfig) -> list[tuple[int, int]]:
    """Chunks (begin, end), by places in ``lengths``, that follow an end inside the segment; entry: the first such end."""
    begin = int(next_ends(lengths[: entry + 1], config)[0][entry]) if entry else 0
    ranges, last, fresh = chunk_ranges(lengths[begin:], config, entry - begin)
    out, known = [], entry
    for a, b in ranges:
        if known >= first + own:
            return out
        out.append((begin + a, begin + b))
        known = begin + b
    if known < first + own and known < len(lengths):
        out.append((begin + last, len(lengths)))
    return out


def _segments(rows: pa.Table):
    """(document_id, run, seg, rows in order) of a task's segments."""
    document = rows.column("document_id").combine_chunks().dictionary_encode()
    key = [document.indices.to_numpy(zero_copy_only=False), *(rows.column(c).to_numpy() for c in ("run", "seg", "j"))]
    order = np.lexsort(key[::-1])
    cut = np.flatnonzero(np.any([np.diff(k[order]) != 0 for k in key[:3]], axis=0)) + 1
    for at in np.split(order, cut) if len(order) else []:
        yield document.dictionary[int(key[0][at[0]])].as_py(), int(key[1][at[0]]), int(key[2][at[0]]), at


def _crossed(rows: pa.Table, config: ChunkConfig, size: int) -> pa.Table:
    out = []
    n, j = rows.column("n").to_numpy(), rows.column("j").to_numpy()
    for document, run, seg, at in _segments(rows):
        inside = j[at] // size == seg
        if j[at[-1]] // size > seg:  # the last segment leaves to none
            out += [(document, run, seg, *c) for c in crossings(n[at], int(np.argmax(inside)), int(inside.sum()), config)]
    names = ("document_id", "run", "seg", "lo", "hi", "leaves", "chunks")
    return pa.table({c: pa.array([r[i] for r in out], pa.string() if i == 0 else pa.int64()) for i, c in enumerate(names)})


def _chained(key: tuple, rows: pa.Table, size: int) -> pa.Table:
    """document_id, run, seg, entry, first: where each segment after the first is entered, by its own places, and its first chunk's number."""
    by_seg: dict[int, list[tuple[int, int, int, int]]] = {}
    for seg, *what in zip(*(rows.column(c).to_pylist() for c in ("seg", "lo", "hi", "leaves", "chunks")), strict=True):
        by_seg.setdefault(seg, []).append(tuple(what))
    out, seg, entry, count = [], 0, 0, 0
    while seg in by_seg:
        leaves, chunks = next((x, c) for lo, hi, x, c in by_seg[seg] if lo <= entry <= hi)
        count += chunks
        if leaves < 0:
            break
        seg, entry = seg + 1, leaves - size
        out.append((seg, entry, count))
    ids = [key[0].as_py()] * len(out), [key[1].as_py()] * len(out)
    return pa.table({"document_id": pa.array(ids[0], pa.string()), "run": pa.array(ids[1], pa.int64()), **{c: pa.array([r[i] for r in out], pa.int64()) for i, c in enumerate(("seg", "entry", "first"))}})


def _placed(rows: pa.Table, config: ChunkConfig, size: int) -> pa.Table:
    """The units of each chunk of a task's segments."""
    n, j, entry, first = (rows.column(c).to_numpy() for c in ("n", "j", "entry", "first"))
    at_all, number = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for document, run, seg, at in _segments(rows):
        inside = j[at] // size == seg
        skip, own = int(np.argmax(inside)), int(inside.sum())
        for i, (a, b) in enumerate(segment_chunks(n[at], skip, own, skip + int(entry[at[0]]), config)):
            at_all.append(at[a:b])
            number.append(np.full(b - a, first[at[0]] + i, dtype=np.int64))
    at = pa.array(np.concatenate(at_all))
    return pa.table([rows.column("document_id").take(at), rows.column("run").take(at), pa.array(np.concatenate(number)), rows.column("pdf_page").take(at), rows.column("unit").take(at)], ["document_id", "run", "i", "pdf_page", "unit"])


def _places(lengths: DataFrame, config: ChunkConfig) -> DataFrame:
    """Which units each chunk has, from document_id, pdf_page, unit, chapter, n of every unit."""
    pages = lengths.groupBy("document_id", "pdf_page").agg(F.count(F.lit(1)).alias("units"), F.first("chapter").alias("chapter"))
    order = (["document_id"], "pdf_page")
    pages = pages.join(scan.running(pages, *order, before={"past": F.struct("chapter")}), ["document_id", "pdf_page"])
    turned = pages.withColumn("turn", F.when(F.col("past").isNotNull() & F.col("past.chapter").eqNullSafe(F.col("chapter")), 0).otherwise(1))
    runs = scan.running(turned, *order, sums={"run": F.col("turn"), "start": F.col("units")}, lasts={"turn": F.col("turn")})
    runs = runs.withColumn("run", F.col("run") + F.col("turn"))
    base = runs.groupBy(*RUN).agg(F.min("start").alias("base"))
    runs = runs.join(base, RUN).select("document_id", "pdf_page", "run", (F.col("start") - F.col("base")).alias("start"))
    size = max(SEGMENT, *halo(config)) if segmented(config) else 1 << 62
    rows = lengths.join(runs, ["document_id", "pdf_page"]).select(*RUN, (F.col("start") + F.col("unit")).alias("j"), "pdf_page", "unit", "n")
    before, after = halo(config)
    seg, at = F.floor(F.col("j") / size), F.col("j") % size
    near = F.array_compact(F.array(seg, F.when((at < after) & (seg > 0), seg - 1), F.when(at >= size - before, seg + 1)))
    rows = stored(rows.withColumn("seg", F.explode(near)), "segments")
    # a segment is entered from the one before; units that only precede one are no segment
    real = rows.filter(F.floor(F.col("j") / size) == F.col("seg")).select(*RUN, "seg").distinct() if segmented(config) else None
    real = stored(real, "real-segments") if real is not None else None
    rows = rows.join(real, [*RUN, "seg"], "left_semi") if real is not None else rows
    deal = F.pmod(F.xxhash64(*RUN, "seg"), F.lit(max(1, -(-rows.count() // ROWS))))
    dealt = rows.withColumn("deal", deal)
    crossed = dealt.groupBy("deal").applyInArrow(lambda t: _crossed(t, config, size), "document_id string, run long, seg long, lo long, hi long, leaves long, chunks long")
    entries = crossed.groupBy(*RUN).applyInArrow(lambda key, t: _chained(key, t, size), "document_id string, run long, seg long, entry long, first long")
    entered = dealt.filter("seg = 0").withColumns({"entry": F.lit(0).cast("long"), "first": F.lit(0).cast("long")})
    entered = entered.unionByName(dealt.filter("seg > 0").join(stored(entries, "entries"), [*RUN, "seg"]).select(entered.columns))
    return entered.groupBy("deal").applyInArrow(lambda t: _placed(t, config, size), PLACES)


def structured_chunks(pages: DataFrame, config: ChunkConfig | None = None, lexicon: Lexicon = LATIN) -> DataFrame:
    """document_id, chunk_index, chunk_id, text, char_count, pdf_pages, chapter: no chunk crosses a chapter.

    Chunks are found from the units' lengths; texts are joined to them last. Pages without a document have none.
    """
    config = config or ChunkConfig()
    cut = stored(units(pages.filter("document_id is not null"), config, lexicon), "units")
    places = stored(_places(cut.drop("text"), config), "places")
    numbers = scan.running(places.groupBy(*RUN).agg((F.max("i") + 1).alias("n")), ["document_id"], "run", sums={"before": F.col("n")})
    held = places.join(cut.drop("n"), ["document_id", "pdf_page", "unit"])
    own = held.groupBy("document_id", "run", "i").agg(F.array_sort(F.collect_list(F.struct("pdf_page", "unit", "text"))).alias("u"), F.first("chapter").alias("chapter"))
    chunks = own.join(stored(numbers, "numbers"), RUN).select(
        "document_id", (F.col("before") + F.col("i")).cast("int").alias("chunk_index"), X.strip(F.array_join(F.transform("u", lambda u: u.text), "\n\n")).alias("text"),
        F.array_distinct(F.transform("u", lambda u: u.pdf_page)).alias("pdf_pages"), "chapter",
    )
    return stored(chunks.select(
        "document_id", "chunk_index", chunk_name("structured"),
        "text", X.compact_count(F.col("text")).alias("char_count"), "pdf_pages", "chapter", F.filter(F.array("chapter"), lambda c: c != lexicon.unknown).alias("chapters"),
    ), "structured-chunks")


def structured_quality(chunks: DataFrame, lexicon: Lexicon = LATIN) -> DataFrame:
    """As fixed_quality, with the chunks that end naturally."""
    natural = F.regexp_replace("text", f"{X.BLANK}+$", "").rlike(lexicon.natural_end)
    return fixed_quality(chunks, F.count_if(natural).alias("natural_endings")).withColumn("natural_rate", F.bround(F.col("natural_endings") / F.col("chunk_count"), 4))


#: What a chunk has from its document.
FROM_DOCUMENT = ("company", "stock_code", "report_year", "report_type", "source_file", "source_url")
STRATEGIES = {"baseline": "fixed_char", "structured": "chapter_paragraph"}


def described(chunks: DataFrame, pages: DataFrame, strategy: str) -> DataFrame:
    """The chunks with strategy, page range, printed pages, and what the first page says of the document: the columns of CHUNK.

    strategy: baseline or structured. Columns that the pages lack are null.
    """
    given = lambda name: F.min_by(name, "pdf_page").alias(name) if name in pages.columns else F.first(F.lit(None).cast("int" if name == "report_year" else "string")).alias(name)
    documents = pages.groupBy("document_id").agg(*(given(c) for c in FROM_DOCUMENT))
    out = chunks.join(stored(documents, "documents"), "document_id")
    if "printed_page" in pages.columns:
        each = chunks.select("document_id", "chunk_id", F.explode("pdf_pages").alias("pdf_page"))
        known = each.join(pages.filter("printed_page is not null").select("document_id", "pdf_page", "printed_page"), ["document_id", "pdf_page"])
        printed = known.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("pdf_page", "printed_page"))).alias("_p"))
        out = out.join(printed, "chunk_id", "left").withColumn("printed_pages", F.coalesce(F.array_distinct(F.transform("_p", lambda p: p.printed_page)), F.array().cast("array<int>")))
    else:
        out = out.withColumn("printed_pages", F.array().cast("array<int>"))
    out = out.withColumns({"strategy": F.lit(STRATEGIES[strategy]), "pdf_page_start": F.array_min("pdf_pages"), "pdf_page_end": F.array_max("pdf_pages")})
    return out.select(*(c.split()[0] for c in CHUNK.split(", ")))


def compared(fixed: DataFrame, structured: DataFrame) -> DataFrame:
    """strategy_delta of two quality reports with page_count; an error where the reports' pages differ."""
    both = fixed.select("document_id", F.col("page_count").alias("f")).join(structured.select("document_id", F.col("page_count").alias("s")), "document_id")
    require_none(both.filter("not f <=> s"), "the reports are of different pages")
    return strategy_delta(fixed, structured)


def change(before, after):
    """Relative change to four places, 0 where the base is 0."""
    return F.when(before != 0, F.bround((after - before) / before, 4)).otherwise(F.lit(0.0))


def strategy_delta(fixed: DataFrame, structured: DataFrame) -> DataFrame:
    """The two quality reports of each document side by side."""
    both = fixed.alias("f").join(structured.alias("s"), "document_id")
    return both.select(
        "document_id", change(F.col("f.chunk_count"), F.col("s.chunk_count")).alias("chunk_change"), change(F.col("f.cross_page"), F.col("s.cross_page")).alias("cross_page_change"),
        (F.col("s.cross_chapter") - F.col("f.cross_chapter")).alias("cross_chapter_change"),
    )
