"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

Fixed patterns: assignments of eight or more characters to a password-like name, access key ids, and
long lower-case hexadecimal runs. The test: every run of ``least`` (20) or more key characters is encoded with a
byte-level BPE vocabulary, after known digests and identifiers are left out; ordinary language needs one
token for some three characters and more, a random string one for about one and a half, so a ratio
under the limit marks it (kind ``random``). Known are UUIDs, numbers, digests by their lengths or by the name
of their algorithm before them, camel-case words, and parts between separators that are all words or numbers. Runs of letters of one case, or of
parts that are, look like words: for them only the letters of parts of four or more count, 16 of them and
eight different ones at least, under a stricter limit. A run ends at an equals sign unless that pads its
end, so a parameter's name isn't part of its value; a full stop joins parts that look random together.
What follows a ``list=``, ``v=`` or ``id=`` in an address is an identifier, and so is a part of an address's
path behind a part that is a plain word, unless that word tells of keys; parts of a path are judged one by one.

Work is linear in the text, also in one word of any length. Only words of 16 (or ``least``) or more bytes are looked at one by one; they are found by a numpy pass over the
batch. Assignments are sought in documents that have one of the names. Nothing is shuffled.

Nulls and empty texts have no spans. Rows are judged one by one, so ties and repeated rows give
equal results; other columns are kept, except that results replace columns of their names.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TextBatch, pieces

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(rb"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
NAMES = (b"passw", b"secret", b"token", b"api")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LEAST = 20
DOTTED = re.compile(rb"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_-]{4,}+(?:\.[A-Za-z0-9+/_-]{4,}+)++(?![.])")
#: What ends before the value of a parameter of an address, and names whose values aren't identifiers.
PARAMETER = re.compile(rb"://\S*[?&;]([A-Za-z0-9_.-]{1,40})=\Z")
TELLING = re.compile(rb"(?i)key|token|secret|sig|auth|pass|credential|session|hook|services|bot")
#: Where an address begins, or its path ends.
ADDRESS = re.compile(rb"://|[?#;]")
#: A digest that names its algorithm, as page integrity attributes and lock files have it.
NAMED_DIGEST = re.compile(rb"(?i:sha1-[a-z0-9+/]{26,27}|sha256-[a-z0-9+/]{42,43}|sha384-[a-z0-9+/]{62,64}|sha512-[a-z0-9+/]{85,86})={0,2}")
UUID = re.compile(rb"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
#: By how much the limit is less for runs of one case: words of any language have more characters a token.
STRICTER = 0.05
WORDLIKE = re.compile(rb"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@cache
def runs(least: int) -> re.Pattern:
    """Runs of key characters of a length or more."""
    return re.compile(rb"[A-Za-z0-9+/_-]{%d,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?" % least)


def is_digest(run: bytes) -> bool:
    """Known digests, by their lengths or names, UUIDs and numbers."""
    return bool(UUID.fullmatch(run)) or bool(NAMED_DIGEST.fullmatch(run)) or run.isdigit() or (len(run) in DIGEST_LENGTHS and re.fullmatch(rb"[0-9a-f]+|[0-9A-F]+", run) is not None)


def is_identifier(run: bytes) -> bool:
    """Parts between separators that are plain words or numbers, or camel-case words."""
    parts = [p for p in re.split(rb"[+/_=-]+", run) if p]
    if len(parts) > 1 and all(WORDLIKE.fullmatch(p) for p in parts):
        return True
    camel = re.findall(rb"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+", run)
    return b"".join(camel) == run and all(len(p) >= 4 or p.isdigit() for p in camel) and len(camel) <= len(run) // 5


def varied(run: bytes) -> bool:
    """Letters and digits, or letters of both cases inside a word: prose has neither."""
    upper = sum(65 <= c <= 90 for c in run)
    lower = sum(97 <= c <= 122 for c in run)
    return (upper + lower > 0 and any(48 <= c <= 57 for c in run)) or (upper >= 3 and lower >= 3)


def words_of(run: bytes) -> list[bytes]:
    """The letter parts of four or more of a run that looks like words, if they are enough to judge."""
    long = [p for p in re.findall(rb"[A-Za-z]+", run) if len(p) >= 4]
    letters = b"".join(long).lower()
    return long if len(letters) >= 16 and len(set(letters)) >= 8 else []


class TokenEfficiency:
    """Characters per token under the vocabulary of a tiktoken file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("efficiency", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ratio(self, run: bytes) -> float:
        return len(run) / max(1, len(self.encoding.encode_ordinary(run.decode())))


    def is_random(self, run: bytes, most_ratio: float) -> bool:
        """Whether a run that is no digest has too few characters a token; as words, if it looks like them."""
        if is_digest(run):
            return False
        if varied(run) and not is_identifier(run):
            return self.ratio(run) < most_ratio
        parts = words_of(run)
        tokens = sum(len(self.encoding.encode_ordinary(p.decode())) for p in parts)
        return bool(parts) and sum(map(len, parts)) < (most_ratio - STRICTER) * tokens

    def is_random_dotted(self, parts: list[bytes], most_ratio: float, least: int = LEAST) -> bool:
        """Whether parts that full stops join are random together: each of letters and digits, or of both cases."""
        run = b"".join(parts)
        return len(run) >= least and all(varied(p) for p in parts) and self.ratio(run) < most_ratio


_tests: dict[str, TokenEfficiency] = {}


def spans_of(text: bytes, words: list[tuple[int, int]], test: TokenEfficiency, most_ratio: float, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, by start and then kind. words: those of 16 (or ``least``) or more bytes."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    for a, b in words:
        word = text[a:b]
        if b"AKIA" in word:
            found += [(a + m.start(), 1, a + m.end()) for m in ACCESS.finditer(word) if len(m[0]) >= 16]
        if b - a >= 32:
            found += [(a + m.start(), 2, a + m.end()) for m in HEX.finditer(word) if len(m[0]) >= 32]
    base = sorted((a, b) for a, _, b in found)
    begins, ends = [a for a, _ in base], np.maximum.accumulate(np.array([b for _, b in base], dtype=np.int64)).tolist()

    def free(a: int, b: int) -> bool:
        """Whether no span of a fixed pattern overlaps."""
        i = bisect_left(begins, b)
        return not (i and ends[i - 1] > a)

    for a, b in words:
        if b - a >= least:
            found += [(a + x, 3, a + y) for x, y in random_spans(text[a:b], test, most_ratio, least) if free(a + x, a + y)]
    return sorted(found)


def judged(word: bytes, least: int) -> Iterator[tuple[int, bytes]]:
    """(start, run) of the runs of a word that may be random: whole ones, but in the path of an address part by part."""
    marks = [(m.start(), m[0] == b"://") for m in ADDRESS.finditer(word)]
    starts = [at for at, _ in marks]
    for m in runs(least).finditer(word):
        i = bisect_left(starts, m.start() + 1) - 1
        if i < 0 or not marks[i][1] or word[m.start() - 1 : m.start()] == b"=":
            yield m.start(), m[0]
            continue
        at, before = m.start(), b"/"  # the first part is the end of the host's name, or of a part with a full stop
        for j, part in enumerate(m[0].split(b"/")):
            plain = before.isalpha() and before.islower() and not TELLING.search(before)
            if len(part) >= least and not plain and (j or word[at - 1 : at] not in (b".", b":")):
                yield at, part
            at, before = at + len(part) + 1, part


def random_spans(word: bytes, test: TokenEfficiency, most_ratio: float, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, end) of the random strings of a word, in order."""
    found = []
    for begin, whole in judged(word, least):
        run = whole.strip(b"-/+_")
        at = begin + whole.index(run)
        if len(run) >= least and test.is_random(run, most_ratio):
            name = PARAMETER.search(word[max(0, at - 300) : at]) if word[at - 1 : at] == b"=" else None
            if name is None or TELLING.search(name[1]):
                found.append((at, at + len(run)))
    if b"." in word:
        begins, ends = [a for a, _ in found], [b for _, b in found]  # found are in order and apart
        for m in DOTTED.finditer(word):
            whole = m[0].strip(b"-/+_")
            i = bisect_left(begins, m.end())
            if not (i and ends[i - 1] > m.start()) and test.is_random_dotted(whole.split(b"."), most_ratio, least):
                found.append((m.start() + m[0].index(whole), m.start() + m[0].index(whole) + len(whole)))
    return sorted(found)


def scan(docs: DataFrame, ranks: str | None = None, most_ratio: float = 2.1, least: int = LEAST) -> DataFrame:
    """Adds ``secret_spans``: array of (kind, start, end) in code points, by start and then kind.

    least: the characters that a run must have to be judged; shorter ones are too few tokens to tell.
    """
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = docs.drop("secret_spans")
    span = T.StructType().add("kind", "string").add("start", "integer").add("end", "integer")
    schema = T.StructType([*docs.schema.fields, T.StructField("secret_spans", T.ArrayType(span))])
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = _tests.get(path) or _tests.setdefault(path, TokenEfficiency(path))
        for batch in batches:
            for part in pieces(batch):
                texts = TextBatch(part.column("text"))
                start, end, row = texts.words()
                long = np.flatnonzero(end - start >= min(16, least))
                first = np.searchsorted(row[long], np.arange(len(texts) + 1))
                out = []
                for i in range(len(texts)):
                    at, own = texts.start[i], long[first[i] : first[i + 1]]
                    text = texts.text(i)
                    found = spans_of(text, [(int(a), int(b)) for a, b in zip(start[own] - at, end[own] - at, strict=True)], test, most_ratio, least)
                    points = None
                    if found and not text.isascii():  # code points before each byte
                        points = np.append(0, np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)).tolist()
                    out.append([{"kind": KINDS[k], "start": points[x] if points else x, "end": points[y] if points else y} for x, k, y in found])
                yield pa.record_batch([*part.columns, pa.array(out, kind_type)], [*part.schema.names, "secret_spans"])

    return docs.mapInArrow(run, schema)


def joined(spans, kinds: tuple[str, ...] | None = None):
    """kind:start:end of the spans (of the kinds), comma-joined."""
    if kinds:
        spans = F.filter(spans, lambda s: s.kind.isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """The columns of the secret scan query."""
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    spans = F.col("secret_spans")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(spans, KINDS[:3]), 256).alias("base_sha256"), joined(spans).alias("spans"), count("random"))


def redact(scanned: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The documents with each secret replaced by the mask; overlapping spans are masked once."""
    step = lambda acc, s: F.struct(
        F.concat(acc.out, F.when(s.start >= acc.at, F.concat(F.substring("text", acc.at + 1, s.start - acc.at), F.lit(mask))).otherwise(F.lit(""))).alias("out"),
        F.greatest(acc.at, s.end).alias("at"),
    )
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate("secret_spans", start, step, lambda acc: F.concat(acc.out, F.substring("text", acc.at + 1, F.length("text"))))
    masked = F.when(F.size("secret_spans") > 0, done).otherwise(F.col("text"))
    out = scanned.withColumn("text", masked)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return out.drop("secret_spans")
