"""From raw page text to clean, numbered, chaptered page rows; reports and audit samples.

Pages are rows (document_id, pdf_page, text). Shuffles: one by (document, line) for margin lines, one by ranges of
(document, page) for numbers and one for what is carried forward (``scan``), so no task holds a document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LATIN, Lexicon
from ..functions import text as X
from ..sources.scratch import stored
from . import scan
from .ingest import require_none

#: Places that a document's list of margin lines is sent to.
SALT = 16


def numbered(rows: DataFrame, document: str, order: str) -> DataFrame:
    """pdf_page = 1, 2, ... of each document in the order of a column, whose values differ within a document. Rows without a document go."""
    return scan.numbered(rows, [document], [order], "pdf_page")


def edges(lines: Column) -> Column:
    """The first three lines, then the last three."""
    return F.concat(F.slice(lines, 1, 3), F.slice(lines, F.greatest(F.size(lines) - 2, F.lit(1)), 3))


def margin_lines(pages: DataFrame, ratio: float = 0.30) -> DataFrame:
    """(document_id, line, pages, threshold): short lines in the margins of many pages.

    The threshold is the half-even rounded share of the document's pages, three at least.
    """
    each = pages.select("document_id", F.explode(F.array_distinct(X.let(X.lines_of(F.col("text")), lambda lines: edges(lines)))).alias("line"))
    each = each.filter(F.length("line").between(2, 80) & ~F.col("line").rlike("^[0-9]+$"))
    counts = each.groupBy("document_id", "line").agg(F.count(F.lit(1)).alias("pages"))
    size = pages.groupBy("document_id").agg(F.greatest(F.lit(3), F.bround(F.count(F.lit(1)) * F.lit(ratio), 0).cast("long")).alias("threshold"))
    return counts.join(size, "document_id").filter("pages >= threshold")


def with_margins(pages: DataFrame, margins: DataFrame) -> DataFrame:
    """Adds ``_margins``: the document's margin lines, null if it has none.

    A document's list is short (six lines a page, each on a share of the pages), so it is sent to ``SALT`` places and
    the pages are dealt over these: a document of most pages is the work of many tasks.
    """
    lists = margins.groupBy("document_id").agg(F.collect_set("line").alias("_margins"))
    lists = lists.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salt = F.pmod(F.coalesce("pdf_page", F.lit(0)), F.lit(SALT)).cast("int")
    return pages.withColumn("_salt", salt).join(stored(lists, "margins"), ["document_id", "_salt"], "left").drop("_salt")


def outside_margins(lines: Column) -> Column:
    """The lines that aren't among ``_margins``."""
    return F.when(F.col("_margins").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains("_margins", x)))


def without_margins(pages: DataFrame, margins: DataFrame) -> DataFrame:
    """Adds ``lines``: each page's lines without the document's margin lines, wherever they stand."""
    out = with_margins(pages, margins)
    return out.withColumn("lines", X.let(X.lines_of(F.col("text")), lambda lines: outside_margins(lines))).drop("_margins")


def printed_page(lines: Column, lexicon: Lexicon = LATIN) -> Column:
    """The first positive page number in the margins."""
    # most lines match nothing, and a cast that fails costs some fifty times a pattern
    number = lambda line: F.coalesce(*(X.let(F.regexp_extract(line, p, 1), lambda m: F.when((m != "") & (m.try_cast("int") > 0), m.try_cast("int"))) for p in lexicon.printed))
    return F.get(F.filter(F.transform(edges(lines), number), lambda n: n.isNotNull()), F.lit(0))


def own_chapter(lines: Column, lexicon: Lexicon = LATIN) -> Column:
    """The first heading in a page's first twelve lines, or null."""
    heading = lambda line: (F.length(line) <= 60) & reduce(lambda a, b: a | b, (line.rlike(p) for p in lexicon.chapters))
    return F.get(F.filter(F.slice(lines, 1, 12), heading), F.lit(0))


def carried(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """document_id, pdf_page, name: the last value so far in the document, the page's own included."""
    return scan.running(rows, ["document_id"], "pdf_page", lasts={name: value})


def chapters(pages: DataFrame, lexicon: Lexicon = LATIN) -> DataFrame:
    """(document_id, pdf_page, chapter) from the pages' lines, carried forward."""
    return carried(pages, own_chapter(F.col("lines"), lexicon), "chapter").na.fill(lexicon.unknown, ["chapter"])


def quality_flags(raw: Column, clean: Column, count: Column, least: int = 50) -> Column:
    """count: the clean text's ``compact_count``."""
    blank = F.coalesce(X.strip(raw), F.lit("")) == ""
    return F.array_compact(F.array(
        F.when(blank, F.lit("empty_page")).when(count < least, F.lit("short_page")),
        F.when(clean.contains("�"), F.lit("replacement_character")),
        F.when(clean.contains("\x00"), F.lit("null_character")),
    ))


def parse(pages: DataFrame, lexicon: Lexicon = LATIN, least: int = 50) -> DataFrame:
    """Raw pages to page rows: printed_page, chapter, cleaned text, char_count, quality_flags."""
    given = [c for c in pages.columns if c not in ("document_id", "pdf_page")]
    raw = pages.withColumn("text", F.coalesce("text", F.lit("")))
    # all that a page says of itself is found in one pass (inline keeps it from being computed for each column), so only
    # the clean text is stored, and the chapters that are carried forward come from the pages' own ones. A page is cut into lines
    # once, and what is found twice has a name: nothing else keeps it from being computed again inside lambdas
    own = lambda every, lines: X.let(F.array_join(lines, "\n"), lambda text: X.let(X.compact_count(text), lambda count: F.struct(
        text.alias("_text"), own_chapter(lines, lexicon).alias("_own"), printed_page(every, lexicon).alias("printed_page"),
        count.alias("char_count"), quality_flags(F.col("text"), text, count, least).alias("quality_flags"),
    )))
    found = X.let(X.lines_of(F.col("text")), lambda every: X.let(outside_margins(every), lambda lines: own(every, lines)))
    made = with_margins(raw, margin_lines(raw)).select("document_id", "pdf_page", *given, F.inline(F.array(found)))
    clean = stored(made.drop("text").withColumnRenamed("_text", "text"), "clean-pages")
    carry = carried(clean, F.col("_own"), "chapter").na.fill(lexicon.unknown, ["chapter"])
    return clean.join(carry, ["document_id", "pdf_page"]).select("document_id", "pdf_page", *given, "chapter", "printed_page", "char_count", "quality_flags")


def parse_report(parsed: DataFrame, lexicon: Lexicon = LATIN) -> DataFrame:
    """One row for each document: counts, average length, flagged pages."""
    return parsed.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.sum("char_count").alias("total_chars"),
        F.bround(F.avg("char_count"), 2).alias("mean_chars"),
        F.count_if(F.col("printed_page").isNotNull()).alias("pages_with_printed_page"),
        F.count_if(F.col("chapter") != lexicon.unknown).alias("pages_with_chapter"),
        F.count_if(F.size("quality_flags") > 0).alias("flagged_pages"),
        F.min(F.when(F.size("quality_flags") > 0, F.col("pdf_page"))).alias("first_flagged_page"),
    )


def flagged_pages(parsed: DataFrame) -> DataFrame:
    """document_id, pdf_page, quality_flags, char_count of every flagged page: the report's list, a row each."""
    return parsed.filter(F.size("quality_flags") > 0).select("document_id", "pdf_page", "quality_flags", "char_count")


def flag_histogram(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.explode("quality_flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("pages"))


def first_matching(pages: DataFrame, predicate: Column) -> DataFrame:
    """(document_id, pdf_page) of the first page of each document for which the predicate holds."""
    return pages.filter(predicate).groupBy("document_id").agg(F.min("pdf_page").alias("pdf_page"))


def audit_samples(parsed: DataFrame, lexicon: Lexicon = LATIN, least: int = 700, most: int = 2000) -> DataFrame:
    """(document_id, category, pdf_page): cover, contents, a table, the page with the longest lines, flagged pages."""
    text = F.coalesce("text", F.lit(""))
    has_any = lambda words: reduce(lambda a, b: a | b, (text.contains(w) for w in words))
    marks = (F.length(text) - F.length(F.replace(text, F.lit(lexicon.toc_mark), F.lit("")))) / len(lexicon.toc_mark)
    cover = parsed.groupBy("document_id").agg(F.lit(1).alias("pdf_page")).select("document_id", F.lit(0).alias("p"), F.lit("cover").alias("category"), "pdf_page")
    contents = first_matching(parsed, F.regexp_replace(text, f"^{X.BLANK}+", "").startswith(lexicon.toc_start) & (marks >= 4)).select("document_id", F.lit(1).alias("p"), F.lit("table_of_contents").alias("category"), "pdf_page")
    table = first_matching(parsed, has_any(lexicon.tables)).select("document_id", F.lit(2).alias("p"), F.lit("financial_table").alias("category"), "pdf_page")
    chosen = cover.union(contents).union(table)
    lines = F.split(text, "\n")
    mean = F.aggregate(lines, F.lit(0), lambda s, x: s + F.length(x)) / F.greatest(F.size(lines), F.lit(1))
    body = parsed.filter((F.size("quality_flags") == 0) & F.col("char_count").between(least, most) & F.col("chapter").contains(lexicon.body_chapter) & ~has_any(lexicon.not_body))
    body = body.join(chosen.select("document_id", "pdf_page").distinct(), ["document_id", "pdf_page"], "left_anti")
    body = body.groupBy("document_id").agg(F.max(F.struct(mean.alias("m"), (-F.col("pdf_page")).alias("q"))).alias("b"))
    body = body.select("document_id", F.lit(3).alias("p"), F.lit("body_text").alias("category"), (-F.col("b.q")).alias("pdf_page"))
    flagged = parsed.filter(F.size("quality_flags") > 0).select("document_id", F.lit(4).alias("p"), F.lit("flagged_page").alias("category"), "pdf_page")
    every = chosen.union(body).union(flagged)
    first = every.groupBy("document_id", "pdf_page").agg(F.min_by("category", "p").alias("category"))
    return first.select("document_id", "category", "pdf_page")


def contiguity(pages: DataFrame) -> DataFrame:
    """Per document, whether its pages are exactly 1..n."""
    out = pages.groupBy("document_id").agg(F.min("pdf_page").alias("first_page"), F.max("pdf_page").alias("last_page"), F.count(F.lit(1)).alias("page_rows"), F.countDistinct("pdf_page").alias("distinct_pages"))
    return out.withColumn("contiguous", (F.col("first_page") == 1) & (F.col("last_page") == F.col("page_rows")) & (F.col("distinct_pages") == F.col("page_rows")))


def unit_context(pages: DataFrame, lexicon: Lexicon = LATIN) -> DataFrame:
    """(document_id, pdf_page, unit_context): the latest unit declaration so far, null before the first."""
    unit = F.regexp_extract("text", lexicon.unit_pattern, 1)
    return carried(pages, F.when(unit != "", F.concat(F.lit(lexicon.unit_prefix), unit)), "unit_context")


#: What a document's audit pack can't do without.
AUDITED = ("cover", "table_of_contents", "financial_table", "body_text")


def audit_gaps(samples: DataFrame) -> DataFrame:
    """(document_id, missing): documents whose samples lack a base category."""
    found = samples.groupBy("document_id").agg(F.collect_set("category").alias("c"))
    return found.withColumn("missing", F.array_except(F.array(*map(F.lit, AUDITED)), "c")).filter(F.size("missing") > 0).select("document_id", "missing")


def audit_pack(samples: DataFrame, parsed: DataFrame) -> DataFrame:
    """(document_id, markdown): the sampled pages of each document with their text, for a person to check."""
    rows = samples.join(parsed.select("document_id", "pdf_page", "chapter", "text"), ["document_id", "pdf_page"])
    part = F.concat(F.lit("## Page "), F.col("pdf_page").cast("string"), F.lit(" ("), "category", F.lit(")\n\nChapter: "), "chapter", F.lit("\n\n"), "text", F.lit("\n"))
    parts = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("pdf_page", part.alias("part")))).alias("p"))
    return parts.select("document_id", F.concat(F.lit("# "), "document_id", F.lit("\n\n"), F.array_join(F.transform("p", lambda x: x.part), "\n")).alias("markdown"))


def audit_pack_json(samples: DataFrame, parsed: DataFrame) -> DataFrame:
    """(document_id, pack): the sampled pages of each document as one JSON object. A document without a base category is an error."""
    require_none(audit_gaps(samples), "samples lack a base category")
    rows = samples.join(parsed.select("document_id", "pdf_page", "printed_page", "chapter", "char_count", "quality_flags", "text"), ["document_id", "pdf_page"])
    page = F.struct("pdf_page", "category", "printed_page", "chapter", "char_count", "quality_flags", "text")
    packs = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(page)).alias("samples"))
    return packs.select("document_id", F.to_json(F.struct("document_id", "samples"), {"ignoreNullFields": "false"}).alias("pack"))


#: What ``audit_pack_json`` writes.
PACK = "document_id string, samples array<struct<pdf_page int, category string, printed_page int, chapter string, char_count int, quality_flags array<string>, text string>>"
