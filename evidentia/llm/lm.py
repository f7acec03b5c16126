"""Language-model scores from an Elias-Fano n-gram trie.

Model: log10 P(text) = sum over tokens w after context v of
    log10 c(v, w) / (c(v) + STRENGTH)                      if the pair was seen in training,
    log10 STRENGTH / (c(v) + STRENGTH) + log10 P1(w)       if not,
with P1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)): a bigram model that backs off to the smoothed unigram
with the weight of STRENGTH pseudo-counts. Probabilities sum to one at most. The order is two.

The model grows with the corpus, so it is never in one place: a shard holds the part of the trie for
its share of contexts, and texts come to the shards as packed token lists.

1. Counts: every training word's, partial ones by slice first. They give N, V and the frequent words,
   those with one of ``HOT`` tokens or more, which are ``HOT`` at most; these go to all tasks with their counts.
2. Pairs: a map task sorts its slice's tokens by shard, context and word, and sends one row for each
   shard: contexts, words, and the documents that have them. A frequent context is dealt over shards by
   its words, over the more the more frequent it is; its count is known everywhere, a rarer one's is the
   sum of its pairs. The shard builds its trie from the training tokens: level one has the contexts
   (Elias-Fano) with their back-off weights, monotone pointers (Elias-Fano) lead to the successors, which
   are kept relative to their context in one monotone sequence (Elias-Fano), and each has its smoothed
   probability; both are logarithms, as 8-bit codes of a book of 256 values of equal frequency. The levels
   are in an unlinked scratch file that is mapped into memory; distinct pairs are looked up by successor
   search in the context's range. What a document gets for its seen pairs, for back-off weights, and for
   frequent words after an unseen pair, is summed; rarer words of unseen pairs are sent on.
3. Words: the same for rarer words, with exact 64-bit hashes and counts, which gives the base score and
   P1 of the unseen pairs' words. Frequent words are scored where the texts are, so no word has a key of
   its own that grows with the corpus.
4. A shard answers with one row for each slice of documents, its sums packed; these are added up by
   slice and taken apart by document.

A shard covers about ``SHARD`` characters and is worked on in parts of ``PART``, so memory is bounded at
any size, and what is sent is in proportion to the text. Word identity is a 64-bit hash; pairs, and
the unseen pairs' words, have its leading 40 bits. The trie isn't kept after its shard has answered.

Training documents are those whose crc32(doc_id as text) mod 5 isn't 1; null ids train. Null text counts
as empty: one token, the end. Each row has its own text's score, also where rows share a doc_id: a document is
named by a 64-bit hash of id and text, so equal rows are one. Other columns are ignored.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_A, MIX_B, TextBatch, Workspace, mix64, pieces, powers, tidy

U = np.uint64
START, END = U(0x5354415254000001), U(0x454E440000000001)
STRENGTH = 4.0
SHARD, PART, HOT = 40_000_000, 5_000_000, 100_000
WORD_BITS, SHORT = U(40), U(24)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Each value's low ``width`` bits, one after the other, in 64-bit words (one to spare)."""
    out = np.zeros(len(values) * width // 64 + 2, dtype=U)
    if width:
        at = np.arange(len(values), dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(U)
        values = values & U((1 << width) - 1)
        np.bitwise_or.at(out, word, values << shift)
        over = shift + U(width) > U(64)
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (U(64) - shift[over]))
    return out


def get_bits(packed: np.ndarray, index: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(index), dtype=U)
    at = index * width
    word, shift = at >> 6, (at & 63).astype(U)
    high = np.where(shift > 0, packed[word + 1] << ((U(64) - shift) & U(63)), U(0))
    return (packed[word] >> shift | high) & U((1 << width) - 1)


class EliasFano:
    """A monotone sequence of unsigned integers: packed low bits, and high bits in unary."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @staticmethod
    def encode(values: np.ndarray) -> list[np.ndarray]:
        n = len(values)
        most = int(values[-1]) if n else 0
        width = max(0, (most // max(n, 1)).bit_length() - 1)
        top = (values >> U(width)).astype(np.int64)
        bits = np.zeros(((int(top[-1]) if n else 0) + n + 2 + 63) // 64 * 64, dtype=np.uint8)
        bits[top + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(U)
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high).astype(np.int64))))
        return [np.array([n, width], dtype=np.int64), pack_bits(values, width), high, ones]

    def _select(self, words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Place of the i-th set bit (from 0) of ``words``, of which ``before`` counts the bits so far."""
        word = np.searchsorted(before, i, side="right") - 1
        left, at, part = i - before[word], np.zeros(len(i), dtype=np.int64), words[word]
        for step in (32, 16, 8, 4, 2, 1):
            here = np.bitwise_count(part & U((1 << step) - 1)).astype(np.int64)
            up = left >= here
            left, at, part = left - np.where(up, here, 0), at + np.where(up, step, 0), np.where(up, part >> U(step), part)
        return word * 64 + at

    def get(self, i: np.ndarray) -> np.ndarray:
        top = self._select(self.high, self.ones, i) - i
        return top.astype(U) << U(self.width) | get_bits(self.low, i, self.width)

    def bucket(self, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of the elements whose high part is ``top``."""
        last = len(self.high) * 64 - self.n - 1
        inside = top <= U(last)
        t = np.where(inside, top, U(last)).astype(np.int64)
        flipped = ~self.high
        end = self._select(flipped, self.zeros, t) - t
        begin = np.where(t > 0, self._select(flipped, self.zeros, np.maximum(t - 1, 0)) - (t - 1), 0)
        return np.where(inside, begin, self.n), np.where(inside, end, self.n)

    def find(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Index of each x, or -1: successor search in its high part's bucket, within [lo, hi)."""
        if not self.n:
            return np.full(len(x), -1, dtype=np.int64)
        begin, end = self.bucket(x >> U(self.width))
        if lo is not None:
            begin, end = np.maximum(begin, lo), np.minimum(end, hi)
        want = x & U((1 << self.width) - 1)
        a, b, active = begin.copy(), end.copy(), np.flatnonzero(begin < end)
        while len(active):
            mid = (a[active] + b[active]) // 2
            less = get_bits(self.low, mid, self.width) < want[active]
            a[active] = np.where(less, mid + 1, a[active])
            b[active] = np.where(less, b[active], mid)
            active = active[a[active] < b[active]]
        near = np.flatnonzero(a < end)
        out = np.full(len(x), -1, dtype=np.int64)
        hit = near[get_bits(self.low, a[near], self.width) == want[near]]
        out[hit] = a[hit]
        return out


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, book): a book of up to 256 values, the means of ranges of equal frequency, and each value's nearest in it."""
    distinct = np.unique(values)
    if len(distinct) <= 256:
        book = distinct
    else:
        ordered = np.sort(values)
        edge = np.linspace(0, len(ordered), 257).astype(np.int64)
        book = np.unique(np.add.reduceat(ordered, edge[:-1]) / np.diff(edge))
    if not len(book):
        book = np.zeros(1)
    return np.searchsorted((book[1:] + book[:-1]) / 2, values).astype(np.uint8), np.append(book, np.full(256 - len(book), book[-1]))


class Trie:
    """Contexts with back-off weights, pointers, and successors with probabilities, in one mapped scratch file."""

    def __init__(self, context: np.ndarray, word: np.ndarray, log_p: np.ndarray, log_backoff: np.ndarray):
        """Distinct pairs by context and word, of 40 bits each, with the logarithms of their probabilities and of their contexts' back-off weights."""
        head = _heads(context) if len(context) else np.zeros(0, np.int64)
        place = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(context))))
        code, book = quantised(log_p)
        weight, weights = quantised(log_backoff[head])
        parts: list[np.ndarray] = []
        for values in (context[head], np.append(head, len(context)).astype(U), place.astype(U) << WORD_BITS | word):
            parts += EliasFano.encode(values)
        parts += [np.append(c, np.zeros(-len(c) % 8, np.uint8)).view(U) for c in (code, weight)] + [book, weights]
        with tempfile.TemporaryFile() as scratch:  # unlinked: nothing stays
            for p in parts:
                scratch.write(p.tobytes())
            scratch.write(b"\0")
            scratch.flush()
            self.map = mmap.mmap(scratch.fileno(), 0, access=mmap.ACCESS_READ)
        at, read = 0, []
        for p in parts:
            read.append(np.frombuffer(self.map, dtype=p.dtype, count=len(p), offset=at))
            at += p.nbytes
        level = lambda i: EliasFano(int(read[i][0]), int(read[i][1]), *read[i + 1 : i + 4])
        self.contexts, self.pointers, self.successors = level(0), level(4), level(8)
        self.code, self.weight, self.book, self.weights = read[12].view(np.uint8), read[13].view(np.uint8), read[14], read[15]

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of each pair's probability, NaN if it wasn't seen, and of its context's back-off weight, NaN if that wasn't."""
        log_p, backoff = np.full(len(context), np.nan), np.full(len(context), np.nan)
        at = self.contexts.find(context)
        known = np.flatnonzero(at >= 0)
        if len(known):
            c = at[known]
            backoff[known] = self.weights[self.weight[c]]
            found = self.successors.find(c.astype(U) << WORD_BITS | word[known], self.pointers.get(c).astype(np.int64), self.pointers.get(c + 1).astype(np.int64))
            hit = found >= 0
            log_p[known[hit]] = self.book[self.code[found[hit]]]
        return log_p, backoff


@dataclass(frozen=True)
class Frequent:
    """Counts that all tasks know: of the frequent words (by their hashes, in order, and the leading 40 bits of these), the training tokens N, words V and documents."""

    word: np.ndarray
    short: np.ndarray
    count: np.ndarray
    n: int
    v: int
    documents: int

    def of(self, short: np.ndarray) -> np.ndarray:
        """The count of each word, named by its leading bits, -1 if it isn't frequent."""
        return self._counts(self.short, short)

    def of_word(self, word: np.ndarray) -> np.ndarray:
        """The count of each word, named by its whole hash, -1 if it isn't frequent."""
        return self._counts(self.word, word)

    def _counts(self, known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.full(len(wanted), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        return np.where(known[at] == wanted, self.count[at], -1)

    def log_p1(self, count: np.ndarray) -> np.ndarray:
        return np.log10(count + 0.5) - np.log10(self.n + 0.5 * (self.v + 1))


def _counts(docs: DataFrame) -> DataFrame:
    """(h, c): how often the training texts of each slice have a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2 << 20):
                words, _ = TextBatch(part.column("text"), lower=True).word_hashes()
                distinct, count = np.unique(words, return_counts=True)
                yield pa.record_batch([pa.array(distinct.view(np.int64)), pa.array(count)], ["h", "c"])

    return docs.filter("train").select("text").mapInArrow(run, "h long, c long")


def _frequent(docs: DataFrame, work: Workspace, documents: int) -> Frequent:
    """START and END are frequent: they occur once for each document."""
    counts = work.save(_counts(docs).groupBy("h").agg(F.sum("c").alias("c")), "counts")
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = (total["n"] or 0) + documents, total["v"] + (documents > 0)
    rows = counts.filter(F.col("c") >= max(1, -(-n // HOT))).toArrow()  # HOT at most, since all add up to n
    word = np.concatenate((rows.column("h").to_numpy().view(U), np.array([START, END])))
    count = np.concatenate((rows.column("c").to_numpy(), np.full(2, documents)))
    order = np.argsort(word, kind="stable")
    work.drop(counts)
    return Frequent(word[order], word[order] >> SHORT, count[order], n, v, documents)


def tokens(texts: TextBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every token (a row's words, then its end), its row, and its context's hash."""
    words, row = texts.word_hashes()
    n = len(texts)
    out, rows = np.empty(len(words) + n, dtype=U), np.empty(len(words) + n, dtype=np.int64)
    at = np.arange(len(words)) + row
    last = np.cumsum(np.bincount(row, minlength=n)) + np.arange(n)
    out[at], rows[at] = words, row
    out[last], rows[last] = END, np.arange(n)
    before = np.empty_like(out)
    before[1:] = out[:-1]
    if n:
        before[np.append(0, last[:-1] + 1)] = START
    return out, rows, before


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> U(32)) * U(shards) >> U(32)).astype(np.int64)


def five(values: np.ndarray) -> bytes:
    """40-bit values in five bytes each."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def from_five(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel().astype(U)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of the keys begins."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


_BLOBS = lambda *names: ", ".join(f"{n} array<binary>" for n in names)
PAIR_ROWS = "shard int, piece long, keys array<long>, places binary, train binary, " + _BLOBS("contexts", "successors", "words", "uses", "docs")
WORD_ROWS = "shard int, piece long, keys array<long>, places binary, train binary, unseen boolean, sums binary, " + _BLOBS("words", "uses", "docs", "weights")


def _index(data: bytes, n_docs: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<u4" if n_docs > 65_535 else "<u2").astype(np.int64)


def _piece(keys: np.ndarray) -> int:
    """A name for a slice of documents, the same whenever the slice is read again."""
    return int(mix64(np.array([mix64(keys.view(U) + powers(len(keys))).sum(dtype=U)], dtype=U)).view(np.int64)[0])


def _sent(fine: np.ndarray, row: np.ndarray, piece: int, keys: np.ndarray, train: np.ndarray, shards: int, parts: int, cut) -> list[tuple]:
    """One row for each shard that occurs: the places of its documents in the slice, and cut(range, their
    indexes) for each of its parts. One of the rows names the documents' keys."""
    edge = np.searchsorted(fine, np.arange(shards * parts + 1))
    out = []
    for s in range(shards):
        lo, hi = edge[s * parts], edge[(s + 1) * parts]
        if lo == hi:
            continue
        own, index = np.unique(row[lo:hi], return_inverse=True)
        index = index.astype("<u4" if len(own) > 65_535 else "<u2")
        blobs = [cut(slice(edge[f], edge[f + 1]), index[edge[f] - lo : edge[f + 1] - lo].tobytes()) for f in range(s * parts, (s + 1) * parts)]
        named = None if out else keys.tolist()
        out.append((s, piece, named, own.astype("<u4").tobytes(), train[own].astype(np.uint8).tobytes(), *map(list, zip(*blobs, strict=True))))
    return out


def _record(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


_HEAD = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
_NAMES = ["shard", "piece", "keys", "places", "train"]


def _spread(frequent: Frequent, count: np.ndarray, slots: int) -> np.ndarray:
    """Over how many slots a context of this count is dealt: a power of two, one if it would fill a quarter of a slot or less."""
    share = 4.0 * slots * np.maximum(count, 0) / max(frequent.n, 1)
    return (1 << np.ceil(np.log2(np.clip(share, 1, 1 << 20))).astype(np.int64)).astype(U)


def _pair_rows(docs: DataFrame, shards: int, parts: int, frequent: Frequent) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2 << 20):
                word, row, context = tokens(TextBatch(part.column("text"), lower=True))
                spread = _spread(frequent, frequent.of(context >> SHORT), shards * parts)
                fine = shard_of(mix64(context + (word & (spread - U(1))) * U(MIX_B)), shards * parts)
                order = np.argsort(fine.astype(U) << U(44) | (context >> U(42)) << U(22) | word >> U(42))
                word, row, context, fine = word[order], row[order], context[order], fine[order]

                def cut(own: slice, index: bytes) -> tuple[bytes, ...]:
                    w, c = word[own] >> SHORT, context[own] >> SHORT  # noqa: B023
                    pair = _heads(c, w)
                    first = _heads(c[pair])
                    uses, successors = np.diff(np.append(pair, len(w))), np.diff(np.append(first, len(pair)))
                    return five(c[pair][first]), successors.astype("<u4").tobytes(), five(w[pair]), uses.astype("<u4").tobytes(), index

                keys, train = (part.column(c).to_numpy(zero_copy_only=False) for c in ("key", "train"))
                rows = _sent(fine, row, _piece(keys), keys, train, shards, parts, cut)
                yield _record(rows, [*_HEAD, *[pa.list_(pa.binary())] * 5], [*_NAMES, "contexts", "successors", "words", "uses", "docs"])

    return docs.mapInArrow(run, PAIR_ROWS)


def _by_shard(rows: DataFrame, shards: int, solve, schema: str) -> DataFrame:
    """solve(list of the shard's rows as dicts) -> record batches, once for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        held = [r for batch in batches for r in batch.to_pylist()]
        if held:
            yield from solve(held)
        del held
        tidy()

    return rows.repartitionById(shards, F.col("shard")).mapInArrow(run, schema)


def _gathered(rows: list[dict]) -> tuple[np.ndarray, list[int]]:
    """Training flags of all rows' documents, and where each row's begin."""
    train = [np.frombuffer(r.pop("train"), dtype=np.uint8) for r in rows]
    return np.concatenate(train), np.cumsum([0, *map(len, train)]).tolist()


def _part(rows: list[dict], begin: list[int], i: int, name: str) -> np.ndarray:
    """Part i of a column of all rows, decoded; it isn't kept."""
    raw = [r[name][i] for r in rows]
    for r in rows:
        r[name][i] = b""
    if name == "docs":
        return np.concatenate([_index(x, begin[j + 1] - begin[j]) + begin[j] for j, x in enumerate(raw)])
    whole = b"".join(raw)
    return from_five(whole) if name in ("contexts", "short") else np.frombuffer(whole, dtype="<u8" if name == "long" else "<u4").astype(np.int64)


def _score_pairs(rows: list[dict], frequent: Frequent) -> Iterator[pa.RecordBatch]:
    """For each slice of documents: their sums over pairs, and the rarer words of their unseen ones."""
    train, begin = _gathered(rows)
    sums, missing_docs, missing_words = np.zeros(len(train)), [], []
    for i in range(len(rows[0]["uses"])):
        context = np.repeat(_part(rows, begin, i, "contexts"), _part(rows, begin, i, "successors"))
        word = from_five(b"".join(r["words"][i] for r in rows))
        use, doc = _part(rows, begin, i, "uses"), _part(rows, begin, i, "docs")
        if not len(word):
            continue
        _, first, group = np.unique(mix64(context * U(MIX_A) + word), return_index=True, return_inverse=True)
        trained = np.add.reduceat(train[doc].astype(np.int64), np.cumsum(use) - use)
        count = np.bincount(group, weights=trained, minlength=len(first)).astype(np.int64)
        order = np.lexsort((word[first], context[first]))
        c, w, count = context[first][order], word[first][order], count[order]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        head = _heads(c)
        total = np.repeat(np.add.reduceat(count, head), np.diff(np.append(head, len(c))))
        known = frequent.of(c)
        total = np.where(known >= 0, known, total)  # a frequent context has pairs elsewhere
        backoff = np.log10(STRENGTH) - np.log10(total + STRENGTH)
        own = np.flatnonzero(count > 0)
        trie = Trie(c[own], w[own], np.log10(count[own]) - np.log10(total[own] + STRENGTH), backoff[own])
        log_p, weight = trie.find(c, w)
        seen = np.isfinite(log_p)
        weight = np.where(np.isfinite(weight), weight, np.where(known >= 0, backoff, 0.0))  # of a frequent context without a seen pair here
        frequent_word = frequent.of(w)
        each = np.where(seen, log_p, weight + np.where(frequent_word >= 0, frequent.log_p1(np.maximum(frequent_word, 0)), 0.0))
        at = np.repeat(place[group], use)
        sums += np.bincount(doc, weights=each[at], minlength=len(sums))
        sent = np.flatnonzero(~seen[at] & (frequent_word[at] < 0))
        missing_docs.append(doc[sent])
        missing_words.append(w[at[sent]])
    of = np.concatenate(missing_docs) if missing_docs else np.zeros(0, np.int64)
    word = np.concatenate(missing_words) if missing_words else np.zeros(0, U)
    order = np.argsort(of, kind="stable")
    of, word = of[order], word[order]
    edge = np.searchsorted(of, begin)
    out = []
    for j, r in enumerate(rows):
        places = np.frombuffer(r["places"], dtype="<u4")
        own = slice(edge[j], edge[j + 1])
        out.append((r["piece"], r["keys"], r["places"], sums[begin[j] : begin[j + 1]].tobytes(), places[of[own] - begin[j]].tobytes(), five(word[own])))
    yield _record(out, [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4], ["piece", "keys", "places", "seen", "docs", "words"])


PAIR_SUMS = "piece long, keys array<long>, places binary, seen binary, docs binary, words binary"


def _word_rows(docs: DataFrame, shards: int, parts: int, frequent: Frequent) -> DataFrame:
    """The documents' rarer words, by shard; and what they get for the frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2 << 20):
                word, row, _ = tokens(TextBatch(part.column("text"), lower=True))
                keys, train = (part.column(c).to_numpy(zero_copy_only=False) for c in ("key", "train"))
                piece, n = _piece(keys), len(keys)
                count = frequent.of_word(word)
                hot = count >= 0
                add = lambda of, weights=None: np.bincount(row[of], weights=None if weights is None else weights[of], minlength=n).astype(np.float64)  # noqa: B023, E731
                sums = np.stack((add(slice(None)), add(count > 0), add(hot, frequent.log_p1(np.maximum(count, 0))), np.zeros(n)))
                yield _words_sent(word[~hot], row[~hot], piece, keys, train, shards, parts, False)
                local = [(abs(piece) % shards, piece, None, np.arange(n, dtype="<u4").tobytes(), None, None, sums.tobytes(), [], [], [], [])]
                yield _record(local, _WORD_TYPES, _WORD_NAMES)

    return docs.mapInArrow(run, WORD_ROWS)


def _missing_rows(pairs: DataFrame, shards: int, parts: int) -> DataFrame:
    """The unseen pairs' words, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, docs, words in zip(*(batch.column(c).to_pylist() for c in ("piece", "docs", "words")), strict=True):
                word, row = from_five(words) << SHORT, np.frombuffer(docs, dtype="<u4").astype(np.int64)
                none = np.zeros(int(row.max(initial=-1)) + 1, dtype=np.int64)
                yield _words_sent(word, row, piece, none, none, shards, parts, True)

    return pairs.mapInArrow(run, WORD_ROWS)


def _words_sent(word: np.ndarray, row: np.ndarray, piece: int, keys: np.ndarray, train: np.ndarray, shards: int, parts: int, unseen: bool) -> pa.RecordBatch:
    """A slice's words for the shards; equal words of a document are one with a weight."""
    order = np.lexsort((row, word)) if unseen else np.argsort(word, kind="stable")  # rows ascend within a word
    word, row = word[order], row[order]
    head = _heads(word, row)
    weight = np.diff(np.append(head, len(word)))
    word, row = word[head], row[head]

    def cut(own: slice, index: bytes) -> tuple[bytes, ...]:
        one = _heads(word[own])
        uses = np.diff(np.append(one, own.stop - own.start))
        return word[own][one].astype("<u8").tobytes(), uses.astype("<u4").tobytes(), index, weight[own].astype("<u4").tobytes()

    rows = _sent(shard_of(word, shards * parts), row, piece, keys, train, shards, parts, cut)
    return _record([(*r[:2], None, *r[3:5], unseen, None, *r[5:]) for r in rows], _WORD_TYPES, _WORD_NAMES)


_WORD_TYPES = [*_HEAD, pa.bool_(), pa.binary(), *[pa.list_(pa.binary())] * 4]
_WORD_NAMES = [*_NAMES, "unseen", "sums", "words", "uses", "docs", "weights"]
WORD_SUMS = "piece long, places binary, sums binary"
#: Columns of a document's sums, as doubles.
SUMS = ("tokens", "known", "base", "model")


def _score_words(rows: list[dict], frequent: Frequent) -> Iterator[pa.RecordBatch]:
    """For each slice: its documents' SUMS over the shard's words, and over the frequent ones."""
    done, rows = [r for r in rows if r["sums"] is not None], [r for r in rows if r["sums"] is None]
    texts, pairs = [r for r in rows if not r["unseen"]], [r for r in rows if r["unseen"]]
    train, begin = _gathered(texts) if texts else (np.zeros(0, np.uint8), [0])
    other, other_begin = _gathered(pairs) if pairs else (np.zeros(0, np.uint8), [0])
    n_known, base, backed = np.zeros(len(train)), np.zeros(len(train)), np.zeros(len(other))

    def read(part: list[dict], start: list[int], i: int) -> tuple[np.ndarray, ...]:
        words = np.frombuffer(b"".join(r["words"][i] for r in part), dtype="<u8").astype(U)
        return np.repeat(words, _part(part, start, i, "uses")), _part(part, start, i, "docs"), _part(part, start, i, "weights")

    for i in range(len(rows[0]["uses"]) if rows else 0):
        distinct, count = np.zeros(0, U), np.zeros(0, np.int64)
        if texts:
            word, doc, weight = read(texts, begin, i)
            distinct, group = np.unique(word, return_inverse=True)
            count = np.bincount(group, weights=weight * train[doc], minlength=len(distinct)).astype(np.int64)
            c = count[group]
            n_known += np.bincount(doc, weights=weight * (c > 0), minlength=len(train))
            base += np.bincount(doc, weights=weight * frequent.log_p1(c), minlength=len(train))
        if pairs:
            word, doc, weight = read(pairs, other_begin, i)
            lead, want = distinct >> SHORT, word >> SHORT
            at = np.minimum(np.searchsorted(lead, want), max(len(lead) - 1, 0))
            c = np.where(lead[at] == want, count[at], 0) if len(lead) else np.zeros(len(word), np.int64)
            backed += np.bincount(doc, weights=weight * frequent.log_p1(c), minlength=len(other))
    out = [(r["piece"], r["places"], r["sums"]) for r in done]
    for part, start, sums in ((texts, begin, (0 * base, n_known, base, 0 * base)), (pairs, other_begin, (0 * backed, 0 * backed, 0 * backed, backed))):
        out += [(r["piece"], r["places"], np.stack([x[start[j] : start[j + 1]] for x in sums]).tobytes()) for j, r in enumerate(part)]
    yield _record(out, [pa.int64(), pa.binary(), pa.binary()], ["piece", "places", "sums"])


def _by_document(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(key, SUMS): the slices' sums over all shards, taken apart. A slice has one row for each shard, so a task is small."""
    none = F.lit(None)
    rows = pairs.select("piece", "keys", "places", F.col("seen").alias("sums"), F.lit(True).alias("pair"))
    rows = rows.union(words.select("piece", none.cast("array<bigint>"), "places", "sums", F.lit(False)))

    def add(table: pa.Table) -> pa.Table:
        keys, total = None, None
        rows = table.to_pylist()
        keys = next(r["keys"] for r in rows if r["keys"] is not None)
        total = np.zeros((len(SUMS), len(keys)))
        for r in rows:
            places = np.frombuffer(r["places"], dtype="<u4")
            if r["pair"]:
                total[SUMS.index("model"), places] += np.frombuffer(r["sums"])
            else:
                total[:, places] += np.frombuffer(r["sums"]).reshape(len(SUMS), len(places))
        return pa.table({"key": pa.array(keys, pa.int64())} | {n: pa.array(x if n in ("base", "model") else x.astype(np.int64)) for n, x in zip(SUMS, total, strict=True)})

    schema = "key long, " + ", ".join(f"{n} {'double' if n in ('base', 'model') else 'long'}" for n in SUMS)
    return rows.groupBy("piece").applyInArrow(add, schema)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    work = Workspace(spark, "lm")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), held.alias("held_out"))
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text")).withColumn("train", ~F.col("held_out"))
    size, trained = docs.agg(F.sum(F.length("text") + 1), F.count_if("train")).first()
    shards = int(max(1, -(-(size or 0) // SHARD)))
    parts = int(max(1, -(-(size or 0) // (shards * PART))))
    columns = docs.select("key", "train", "text")
    frequent = _frequent(columns, work, trained)
    pairs = work.save(_by_shard(_pair_rows(columns, shards, parts, frequent), shards, lambda rows: _score_pairs(rows, frequent), PAIR_SUMS), "pairs")
    missing = pairs.filter(F.length("words") > 0).select("piece", "docs", "words")
    rows = _word_rows(columns, shards, parts, frequent).union(_missing_rows(missing, shards, parts))
    words = work.save(_by_shard(rows, shards, lambda rows: _score_words(rows, frequent), WORD_SUMS), "words")
    sums = _by_document(pairs, words).groupBy("key").agg(*(F.sum(c).alias(c) for c in SUMS))
    rows = docs.select("key", "doc_id", "held_out")
    same = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    out = rows.join(same, "key").join(sums, "key")
    per = lambda c: F.expr(f"{c} div rows")
    return out.select(
        "doc_id", "held_out", per("tokens").alias("n_tokens"), per("known").alias("n_known"), F.lit(frequent.n).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("rows")).alias("base_score"), (F.col("model") / F.col("rows")).alias("score"),
    )
