"""Column functions on text. All are built-in expressions but ``nfkc``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "[\\u3400-\\u4DBF\\u4E00-\\u9FFF]+"
WORDS = "[a-z]+|[0-9]+(?:\\.[0-9]+)?%?"
#: What Python's str.isspace() holds for, as a Java character class.
BLANK = "[\\s\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
#: The same characters, for trim and translate, which take a half and an eighth of a pattern's time.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: What a text holds that has runs of spaces to normalise, and what ends lines beside \\n.
SPACED, BREAKS = ("\t", "\u3000", "  "), ("\r", "\x0b", "\x0c", "\x85", "\u2028", "\u2029")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def has_any(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether a text contains one of the parts: a search of bytes, a small part of a pattern's time."""
    return reduce(lambda a, b: a | b, (text.contains(p) for p in parts))


def nfkc():
    """An Arrow UDF for Unicode compatibility composition, which Spark has no function for."""
    @F.pandas_udf("string")
    def normalize(text: pd.Series) -> pd.Series:
        return text.str.normalize("NFKC")

    return normalize


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def normalize_line(line: Column) -> Column:
    """Runs of spaces, tabs and ideographic spaces become one space; ends are stripped."""
    return strip(one_space(line))


def one_space(text: Column) -> Column:
    """Runs of spaces, tabs and ideographic spaces as one space; single spaces, which are most, aren't touched."""
    return F.when(has_any(text, SPACED), F.regexp_replace(text, "[\\t\\u3000][ \\t\\u3000]*| [ \\t\\u3000]+", " ")).otherwise(text)


def lines_of(text: Column) -> Column:
    """Normalised lines that aren't empty. Patterns are for the texts that need them: they take most of the time."""

    def parts(whole: Column) -> Column:
        one = one_space(whole)
        return F.when(has_any(whole, BREAKS), F.split(one, "\\r\\n|[\\n\\r\\x0b\\x0c\\x85\\u2028\\u2029]")).otherwise(F.split(one, "\n"))

    return F.filter(F.transform(let(text, parts), strip), lambda x: x != "")


def join_lines(lines: Column) -> Column:
    return strip(F.regexp_replace(F.array_join(lines, "\n"), "\\n{3,}", "\n\n"))


def compact_count(text: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.translate(text, BLANKS, ""))


def tokens(text: Column, grams: int = 4) -> Column:
    """Lower-case words and numbers, and all 1- to 4-grams of each run of CJK characters. Apply nfkc() before where needed."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit(WORDS), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(CJK), F.lit(0))

    def of(run: Column) -> Column:
        each = lambda n: F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array())
        return F.flatten(F.array(*(each(n) for n in range(1, grams + 1))))

    return F.concat(words, F.flatten(F.transform(runs, of)))


def meaningful(expanded: Column) -> Column:
    """Distinct tokens of two characters or more that aren't all digits."""
    return F.array_distinct(F.filter(tokens(expanded), lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9]+$")))


def evidence_pages(value: Column) -> Column:
    """``11|29-31`` as a sorted array of pages; null where a part is no page or a reversed range."""
    parts = F.filter(F.transform(F.split(value, "\\|"), strip), lambda p: p != "")

    def one(p: Column) -> Column:
        a = F.regexp_extract(p, "^(\\d+)\\s*(?:-\\s*\\d+)?$", 1).try_cast("int")
        b = F.coalesce(F.regexp_extract(p, "^\\d+\\s*-\\s*(\\d+)$", 1).try_cast("int"), a)
        return F.when(a.isNotNull() & (b >= a), F.sequence(a, b))

    pages = F.transform(parts, one)
    return F.when((F.size(parts) > 0) & ~F.exists(pages, lambda p: p.isNull()), F.array_sort(F.array_distinct(F.flatten(pages))))


def numbers(text: Column) -> Column:
    """The numbers of a text in plain canonical form, repeats kept: no commas, no needless zeros, percent signs kept."""

    def canonical(m: Column) -> Column:
        value = F.regexp_replace(F.regexp_replace(m, ",", ""), "%$", "")
        plain = F.when(value.contains("."), F.regexp_replace(F.regexp_replace(value, "0+$", ""), "\\.$", "")).otherwise(value)
        plain = F.regexp_replace(plain, "^(-?)0+(?=\\d)", "$1")
        return F.concat(plain, F.when(m.endswith("%"), F.lit("%")).otherwise(F.lit("")))

    return F.transform(F.regexp_extract_all(text, F.lit("-?\\d[\\d,]*(?:\\.\\d+)?%?"), F.lit(0)), canonical)


def loose(text: Column) -> Column:
    """Without white space and the listed punctuation, lower case."""
    return F.lower(F.regexp_replace(text, f"(?:{BLANK}|[,，。；;：:（）()「」“”\"'])+", ""))


def salient(question: Column, ignored: tuple[str, ...]) -> Column:
    """Distinct tokens of 2 to 4 characters outside a stop list, longest first, then in code-point order."""
    found = F.filter(tokens(question), lambda t: F.length(t).between(2, 4) & ~t.isin(*ignored) & ~t.rlike("^[0-9]+$"))
    keyed = F.array_sort(F.transform(F.array_distinct(found), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.transform(keyed, lambda k: k.t)


def quote(text: Column, terms: Column, most: int) -> Column:
    """A window of the text around its longest matching term (of equals, the earliest), with ellipses where it is cut."""
    compact = strip(F.regexp_replace(F.translate(text, BLANKS, " " * len(BLANKS)), "  +", " "))

    def cut(whole: Column) -> Column:
        places = F.array_sort(F.filter(F.transform(terms, lambda t: F.struct((-F.length(t)).alias("n"), (F.instr(whole, t) - 1).alias("at"))), lambda p: p.at >= 0))
        centre = F.coalesce(F.get(places, F.lit(0)).at, F.lit(0))
        end = F.least(F.length(whole), F.greatest(F.lit(0), centre - most // 4) + most)
        start = F.greatest(F.lit(0), end - most)
        window = let(F.struct(start.alias("a"), end.alias("b")), lambda w: F.concat(
            F.when(w.a > 0, F.lit("…")).otherwise(F.lit("")), strip(F.substring(whole, w.a + 1, w.b - w.a)), F.when(w.b < F.length(whole), F.lit("…")).otherwise(F.lit(""))
        ))
        return F.when(F.length(whole) <= most, whole).otherwise(window)

    return let(compact, cut)
