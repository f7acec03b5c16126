"""Personal data, in plain and in disguised form.

Fixed patterns find e-mail addresses, IPv4 addresses, card numbers and phone numbers in the text as
it stands. Then a transducer rewrites the text: look-alike letters and digits of other scripts become
ASCII, invisible characters go, four groups of digits (spelled ones too) between ``dot`` disguises or
full stops become an address, spelled digits become digits where seven or more stand in a row or where
they touch digits or a plus, and ``(at)``/``dot`` disguises in e-mail shapes become @ and full stops.
What is rewritten counts only if a fixed pattern matches it. It keeps, for every character that it writes,
the source span that the character came from, so a match in the rewritten text maps back to a span
of the source. A mapped span is added unless it overlaps a span that was found in plain.

Only texts that could hold a kind are searched for it (an @, a plus sign, enough digits), which a
numpy pass over the batch decides; only texts with a disguise are rewritten. Nothing is shuffled.
Time is linear in the text, whatever it holds: patterns begin at the beginning of a run or at an @ and
go outwards, and a disguise has at most three white-space characters in a row.

Nulls and empty texts have no spans. Rows are judged one by one, so ties and repeated rows give equal
results; other columns are kept, except that results replace columns of their names.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TextBatch, pieces

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# The same in linear time: an address begins where its run does, and a domain or four groups leave nothing to give back.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
FOUR_GROUPS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")

# Letters of other scripts that look like an ASCII letter.
ALIKE = dict(zip("АВЕЅІЈКМНОРСТУХаеіјорсухѕԁһӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορνι", "ABESIJKMHOPCTYXaeijopcyxsdhlABEZHIKMNOPTYXaopvi", strict=True))
INVISIBLE = "­​‌‍⁠﻿"
DASHES = "‐‑‒–—−"
# The digits in words, in four languages.
SPELLED = {
    **dict(zip("zero one two three four five six seven eight nine".split(), "0123456789", strict=True)),
    **dict(zip("null eins zwei drei vier fünf sechs sieben acht neun".split(), "0123456789", strict=True)),
    **dict(zip("zéro un deux trois quatre cinq six sept huit neuf".split(), "0123456789", strict=True)),
    **dict(zip("cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "0123456789", strict=True)),
    "oh": "0",
}
_word = "|".join(sorted(SPELLED, key=len, reverse=True))
ROW_OF_DIGITS = re.compile(rf"(?i)(?<!\w)(?:(?:plus|\+)\s{{0,3}})?(?:{_word}|[0-9])(?:[\s,.-]{{1,3}}(?:{_word}|[0-9])(?!\w)){{6,}}")
ONE_DIGIT = re.compile(rf"(?i){_word}|plus|[0-9]")
# A disguise has at most three white-space characters in a row.
_open, _close = r"\s{0,3}[(\[{<]\s{0,3}", r"\s{0,3}[)\]}>]\s{0,3}"
AT = rf"(?:{_open}(?:at|@){_close}|\s{{1,3}}at\s{{1,3}}|\s{{1,3}}@\s{{0,3}}|\s{{0,3}}@\s{{1,3}}|@)"
DOT = rf"(?:{_open}(?:dot|\.){_close}|\s{{1,3}}dot\s{{1,3}}|\.)"
_dot_from_behind = rf"(?:{_close}(?:tod|\.){_open}|\s{{1,3}}tod\s{{1,3}}|\.)"
LOCAL_FROM_BEHIND = re.compile(rf"(?i)[A-Za-z0-9_%+-]++(?:{_dot_from_behind}[A-Za-z0-9_%+-]++)*+")
DOMAIN_DISGUISED = re.compile(rf"(?i)[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++")
_digit = rf"(?:{_word}|[0-9])(?!\w)"
_group = rf"(?:[0-9]++|{_digit}(?:[\s,-]{{1,3}}{_digit}){{0,2}})"
QUAD = re.compile(rf"(?i)(?<![\w.]){_group}(?:{DOT}{_group}){{3}}(?!\w)")
_item = rf"(?:(?:{_word})(?!\w)|[0-9]+(?!\w))"
_between = r"[\s,.()-]{1,3}"
MIXED = re.compile(rf"(?i)(?<!\w)(?:plus\s{{1,3}}|\+\s{{0,3}})?\(?{_item}(?:{_between}{_item})+")
MIXED_PART = re.compile(rf"(?i)plus\s{{1,3}}|\+\s{{0,3}}|{_word}|[0-9]+|[^\w+]+")
AT_PART, DOT_PART = re.compile(f"(?i){AT}"), re.compile(f"(?i){DOT}")
HINT = re.compile(r"(?i)[(\[{<]\s{0,3}(?:at|dot|@|\.)\s{0,3}[)\]}>]|\sdot\s|\s@|@\s")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _run_begin(text: str, end: int, floor: int) -> int:
    """Where the run of local-part characters that ends at ``end`` begins, not before ``floor``."""
    size = 64
    while True:
        part = text[max(floor, end - size) : end]
        n = len(part) - len(part.rstrip(LOCAL))
        if n < len(part) or end - n <= floor:
            return end - n
        size *= 8


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of EMAIL, from each @ outwards."""
    floor, at = 0, text.find("@")
    while at >= 0:
        begin = _run_begin(text, at, floor)
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        floor = domain.end() if domain else at + 1
        if domain:
            yield begin, floor
        at = text.find("@", floor)


def plain_spans(text: str, n_digits: int) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start; n_digits: ASCII digits in the text."""
    found = []
    if "@" in text:
        found += [(0, a, b) for a, b in _emails(text)]
    if n_digits >= 4 and "." in text:
        found += [(1, *m.span()) for m in FOUR_GROUPS.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    if n_digits >= 16:
        for m in CARD.finditer(text):
            if 16 <= m.end() - m.start() <= 37 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append((2, *m.span()))
    if n_digits >= 8 and "+" in text:
        found += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


@functools.lru_cache(maxsize=1 << 16)
def _ascii_of(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in DASHES:
        return "-"
    if c in ALIKE:
        return ALIKE[c]
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.digit(c))
    plain = unicodedata.normalize("NFKC", c)
    return plain if plain.isascii() else c


class Rewritten:
    """A text under rewriting: ``text``, and the source span of each of its characters."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text))
        self.end = self.start + 1

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces disjoint, ascending spans. What replaces a span stands for all of it."""
        if not edits:
            return
        out: list[str] = []
        at = 0
        kept = np.ones(len(self.text), dtype=bool)
        for a, b, new in edits:
            out += [self.text[at:a], new]
            kept[a:b] = False
            at = b
        out.append(self.text[at:])
        first, last = np.array([a for a, _, _ in edits]), np.array([b for _, b, _ in edits]) - 1
        size = np.array([len(new) for _, _, new in edits])
        place = np.searchsorted(np.flatnonzero(kept), first)  # how many kept characters stand before each edit
        place = np.repeat(place, size)
        self.start, self.end = (np.insert(x[kept], place, np.repeat(x[of], size)) for x, of in ((self.start, first), (self.end, last)))
        self.text = "".join(out)

    def source(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a]), int(self.end[b - 1])


def _in_digits(text: str) -> str:
    """A row of digits, spelled or not, as ASCII digits alone."""
    return "".join(SPELLED.get(p[0].lower(), p[0]) for p in ONE_DIGIT.finditer(text))


def _quads(text: str) -> list[tuple[int, int, str]]:
    """Edits that make addresses of four groups with dots, where they aren't addresses as they stand."""
    edits = []
    for m in QUAD.finditer(text):
        groups = [_in_digits(g) for g in DOT_PART.split(m[0])]
        if not IP.fullmatch(m[0]) and all(len(g) <= 3 and int(g) <= 255 for g in groups):
            edits.append((*m.span(), ".".join(groups)))
    return edits


def _mixed(text: str) -> list[tuple[int, int, str]]:
    """Edits that spell out digits in words beside digit groups or a plus; single digits beside them close up."""
    edits = []
    for m in MIXED.finditer(text):
        parts = [(p[0].lower(), *p.span()) for p in MIXED_PART.finditer(m[0])]
        words = [p in SPELLED for p, _, _ in parts]
        if not any(words) or not (any(p.isdigit() for p, _, _ in parts) or parts[0][0][0] in "+p"):
            continue
        for i, (p, a, b) in enumerate(parts):
            new = p
            if words[i]:
                new = SPELLED[p]
            elif p.startswith("plus"):
                new = "+"
            elif not p[0].isdigit() and p[0] != "+" and 0 < i < len(parts) - 1 and (words[i - 1] or words[i + 1]):
                single = all(words[j] or len(parts[j][0]) == 1 and parts[j][0].isdigit() for j in (i - 1, i + 1))
                new = "" if single else p if len(p) == 1 and p in " -" else " "
            if new != p:
                edits.append((m.start() + a, m.start() + b, new))
    return edits


def _ats(text: str) -> list[tuple[int, int, str]]:
    """Edits that undo at and dot disguises, from each at outwards; a local part doesn't reach over the at before it."""
    edits, behind, floor = [], None, 0
    for at in AT_PART.finditer(text):
        if at.start() < floor:
            continue
        behind = behind or text[::-1]
        local = LOCAL_FROM_BEHIND.match(behind, len(text) - at.start(), len(text) - floor)
        domain = DOMAIN_DISGUISED.match(text, at.end()) if local else None
        floor = domain.end() if domain else at.end()
        if not domain:
            continue
        lo = len(text) - local.end()
        parts = [(*at.span(), "@")] if at[0] != "@" else []
        for a, b in ((lo, at.start()), (at.end(), floor)):
            parts += [(*d.span(), ".") for d in DOT_PART.finditer(text, a, b) if d[0] != "."]
        plain_word_at = at[0].strip().lower() == "at" and not any(new == "." for *_, new in parts)
        if parts and not plain_word_at:  # "meet at example.com" is prose
            edits += sorted(parts)
    return edits


def rewrite(text: str) -> Rewritten:
    """The transducer: look-alikes, then addresses, then spelled digits, then at and dot."""
    out = Rewritten(text)
    if not text.isascii():
        out.apply([(i, i + 1, new) for i, c in enumerate(text) if ord(c) > 127 and (new := _ascii_of(c)) != c])
    out.apply(_quads(out.text))
    rows = []
    for row in ROW_OF_DIGITS.finditer(out.text):
        if not re.search(r"[A-Za-z]", row[0]):
            continue
        new = "".join("+" if p[0].lower() == "plus" else SPELLED.get(p[0].lower(), p[0]) for p in ONE_DIGIT.finditer(row[0]))
        rows.append((row.start(), row.end(), row[0], "+" * row[0].startswith("+") + new))
    out.apply([(a, b, new) for a, b, _, new in rows])
    out.apply(_mixed(out.text))
    out.apply(_ats(out.text))
    return out


_UNUSUAL = re.compile("[^\x00-\x7fÀ-ɏ¡-¬®-±´-¸º-¿]")
_SPELLED_HINT = re.compile(
    rf"(?i)(?<!\w)(?:{_word})(?:[\s,.-]{{1,3}}(?:{_word}|[0-9])(?!\w)){{3}}|(?<!\w)(?:{_word}){_between}[0-9]|(?:(?<=\+)|(?<=[0-9+][\s,.(-])|(?<=[0-9][\s,.)-][\s,.(-]))(?:{_word})(?!\w)"
)


def disguise_possible(text: str, low: str) -> bool:
    if not text.isascii() and _UNUSUAL.search(text):
        return True
    if ("dot" in low or "@" in low or "." in low) and any(h in low for h in ("(at", "[at", "{at", "<at", "( at", "[ at", "{ at", " dot ", "(dot", "[dot", "{dot", "<dot", "( dot", "[ dot", "{ dot", "{.}", "<.>", " @", "@ ", "(@", "[@", "(.)", "[.]")) and HINT.search(text):
        return True
    return any(w in low for w in _SPELLED_PAIRS) and bool(_SPELLED_HINT.search(text))


#: A row of digits in words has one of them.
_SPELLED_PAIRS = tuple(sorted(SPELLED))


def spans_of(text: str, n_digits: int, low: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Plain spans, and all spans, as (kind, start, end) by kind and start."""
    plain = plain_spans(text, n_digits)
    if not disguise_possible(text, low):
        return plain, plain
    out = rewrite(text)
    taken: dict[int, list[tuple[int, int]]] = {k: [] for k in range(len(KINDS))}
    for k, a, b in plain:
        taken[k].append((a, b))
    more = []
    for k, a, b in plain_spans(out.text, sum(c in "0123456789" for c in out.text)):
        a, b = out.source(a, b)
        own = taken[k]
        i = bisect_right(own, (a, b))
        if not (i and own[i - 1][1] > a) and not (i < len(own) and own[i][0] < b):
            more.append((k, a, b))
    return plain, sorted(plain + more)


def find(docs: DataFrame) -> DataFrame:
    """Adds ``pii_base`` and ``pii_spans``: arrays of (kind, start, end) in code points, by kind and start."""
    names = ["pii_base", "pii_spans"]
    docs = docs.drop(*names)
    span = T.StructType().add("kind", "string").add("start", "integer").add("end", "integer")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.ArrayType(span)) for n in names)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                texts = TextBatch(part.column("text"))
                seen = np.concatenate(([0], np.cumsum((texts.data >= 48) & (texts.data <= 57))))
                n_digits = (seen[texts.end] - seen[texts.start]).tolist()
                base, every = [], []
                for text, n in zip(part.column("text").to_pylist(), n_digits, strict=True):
                    one, both = spans_of(text or "", n, (text or "").lower())
                    base.append([{"kind": KINDS[k], "start": a, "end": b} for k, a, b in one])
                    every.append([{"kind": KINDS[k], "start": a, "end": b} for k, a, b in both])
                yield pa.record_batch([*part.columns, pa.array(base, arrow), pa.array(every, arrow)], [*part.schema.names, *names])

    return docs.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the personal data query: counts and digest of the plain spans, and all spans."""
    join = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter("pii_base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(join("pii_base"), 256).alias("base_sha256"), join("pii_spans").alias("spans"))
