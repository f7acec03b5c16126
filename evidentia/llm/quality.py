"""Line-first quality rules, with DataFrame functions alone.

Each line is judged first: punctuation (a line of several words that is long enough to be a sentence
has to end in a terminal mark or hold one, or be a wrapped line of prose), navigation (a short line of link-like parts, or one of
the fixed menu words) and boilerplate (licence, cookie, login and copyright phrases). Failing lines
are removed; a document is rejected when it has lost more than ``most_lost`` of its word characters,
or by the base rules: under 10 words, or more than 20 % of its words in repeated 5-word windows.

A line continues its neighbours where prose is wrapped: its paragraph, the lines up to the next blank
one, has a sentence mark for every ``MARK_EVERY`` characters, and it is half as long as the paragraph's
longest line or more. So text wrapped at any width loses nothing, and lists of words without marks go.

Everything is a projection on the row: no shuffle, no Python. ``let`` binds an intermediate array
once, so that a lambda doesn't evaluate it anew for each element. 5-word windows are compared by a
64-bit hash of their words.

Null text: no words, so rejected by the base rules with all counts 0. Empty and white-space texts
likewise. Rows are judged one by one, so ties and repeated rows give equal results. Other columns are
kept, except that results replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_share", "clean_text"]
# Phrases that mark a boilerplate line, and words of which menus consist.
BOILERPLATE = (
    "all rights reserved|terms of (use|service)|privacy policy|cookie(s)? (policy|settings|preferences)|we use cookies|accept (all )?cookies"
    "|licensed under the|released under the|is licensed under|enable javascript|javascript is (disabled|required)|lorem ipsum|copyright [(]c[)]|©"
    "|sign in|log in|sign up|subscribe to our|follow us on|share this|click here|read more|powered by"
)
MENU = "home|about|about us|contact|contact us|menu|search|login|log in|sign in|sign up|register|help|faq|sitemap|next|previous|prev|back|top|more|share|tweet|print|skip to content"
#: Characters of a paragraph of prose that have a sentence mark among them, and the marks.
MARK_EVERY, MARKS = 200, ".!?…:;。！？"
TERMINAL = r"[.!?…:;。！？][\"'”’»)\]*_#$%&|<>]*$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words in windows of ``width`` words that occur twice or more, the first occurrence included."""

    def covered(keys: Column) -> Column:
        """From sorted (key, place): places whose key has an equal neighbour, then the length of their union."""
        ordered = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def count(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1).k == x.k, F.lit(False)) | F.coalesce(F.get(s, i + 1).k == x.k, F.lit(False)))
            places = F.array_sort(F.transform(twice, lambda x: x.i))
            step = lambda acc, p: F.struct((acc.n + F.least(F.lit(width), p + width - acc.at)).alias("n"), (p + width).alias("at"))
            return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("at")), step, lambda acc: acc.n)

        return let(ordered, count)

    def windows(hashes: Column) -> Column:
        keys = F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - (width - 1), F.lit(0))), lambda h, i: F.xxhash64(h, *(F.get(hashes, i + j) for j in range(1, width))))
        return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(covered(k)))

    return F.coalesce(let(F.transform(words, lambda w: F.xxhash64(w)), windows), F.lit(0)).cast("long")


def line_fails(line: Column, wrapped: Column) -> Column:
    """Whether a line that has a word breaks a punctuation, navigation or boilerplate rule; a wrapped one needs no mark."""
    low = F.lower(F.trim(line))
    n_words = F.size(F.filter(F.split(low, SPACE + "+"), lambda w: w != ""))
    n_parts = F.size(F.split(low, r"\s[|»›>·•/]\s"))
    boilerplate = (F.length(low) <= 200) & low.rlike(BOILERPLATE)
    menu = low.rlike(rf"^({MENU})$") | ((n_parts >= 3) & (n_words <= 2 * n_parts) & (n_words <= 12) & ~low.rlike(TERMINAL))
    unpunctuated = (n_words >= 3) & ~low.rlike(f"[{MARKS}]") & ~wrapped
    return boilerplate | menu | unpunctuated


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def kept_lines(text: Column) -> Column:
    """The lines that pass, in order, blank ones included. A paragraph is a blank line and the lines that follow it."""
    length = lambda line: F.length(F.trim(line))

    def of(paragraph: Column) -> Column:
        prose = MARK_EVERY * (F.length(paragraph) - F.length(F.translate(paragraph, MARKS, ""))) >= F.length(paragraph)

        def passed(lines: Column) -> Column:
            known = F.struct(prose.alias("prose"), F.array_max(F.transform(lines, length)).alias("longest"))
            return let(known, lambda p: F.filter(lines, lambda line: ~(has_word(line) & line_fails(line, p.prose & (2 * length(line) >= p.longest)))))

        return let(F.split(paragraph, "\n"), passed)

    return F.flatten(F.transform(F.split(text, r"\n(?=[\x20\x09\x0B-\x0D]*(?:\n|\z))"), of))


def assess(docs: DataFrame, most_lost: float = 0.5, least_words: int = 10, most_repeated: int = 20) -> DataFrame:
    """Adds the measures, the cleaned text and the verdict of every document."""
    docs = docs.drop(*MEASURES)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), has_word)
    chars = lambda t: F.length(F.regexp_replace(t, SPACE + "+", "")).cast("long")
    two = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    out = (
        docs.withColumn("_w", two)
        .withColumn("clean_text", F.array_join(kept_lines(text), "\n"))
        .withColumn("n_words", F.col("_w.n"))
        .withColumn("word_chars", chars(text))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"))
        .withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn("n_repeat_words", F.col("_w.r"))
        .drop("_w")
    )
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    lost = F.when(F.col("word_chars") > 0, 1 - chars(F.col("clean_text")) / F.col("word_chars")).otherwise(F.lit(0.0))
    return (
        out.withColumn("base_failed", failed)
        .withColumn("lost_share", lost.cast("double"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= most_lost))
    )


def digest(assessed: DataFrame) -> DataFrame:
    """The columns of the quality query."""
    return assessed.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("lost_share", 6).alias("lost_share"))


def clean(docs: DataFrame) -> DataFrame:
    """The documents kept, with the text that their failing lines have been removed from."""
    out = assess(docs).filter("kept").withColumn("text", F.col("clean_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(docs.columns)
