"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The frequent words of the vocabulary (its entries that end a word, which training put there because
they are frequent), and any further words that the caller names, are compiled into a minimal acyclic
automaton: words share prefixes and, through the register of equivalent states, suffixes. Each
transition carries how many words sort before it, so a path adds up to the word's number, and the
number leads to its ids. The automaton is a few flat arrays in one byte string, which every worker
puts in an unlinked scratch file and maps into memory. Its size is that of the vocabulary.

Every slice's distinct words walk the automaton together; those that it lacks are merged exactly, all
unseen words of a slice at once, each round applying to every word its lowest-ranked pair, and very
long ones by a queue of pairs. A cache keeps merged words, never the automaton's. Special tokens are cut
out first. Texts of Latin letters are normalised and cut into words here; for others, whose Unicode
tables might differ, the file's own normaliser and word pattern say what the words are. No text is
encoded by the library. A worker's memory is bounded by one slice of text and 400,000 merged words.

Null text counts as empty and gives no ids. Repeated rows are encoded each; other columns are kept,
except that results replace columns of their names.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import mmap
import re
import tempfile
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import pieces
from .packing import _byte_of, library

END = "</w>"
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Characters on which Python's re and the file's patterns agree.
USUAL = re.compile("[\x00-\x1b\x20-\x7f¡-±´-¸º»¿-ɏ]*")
BYTE_OF = _byte_of()
CHAR_OF = {b: c for c, b in BYTE_OF.items()}
#: Bytes of a word from which it is merged by a queue.
LONGEST = 1000
CACHED = 400_000


class Merges:
    """The vocabulary and merge ranks of a BPE file, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_id = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.first = np.array([vocab[CHAR_OF[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([vocab[CHAR_OF[b] + END] for b in range(256)], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.none = len(pairs)
        self.pairs = {(vocab[a], vocab[b]): i for i, (a, b) in reversed(list(enumerate(pairs)))}
        self.vocab = vocab

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], self.none)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words, one after the other, and how many each has. No word may be empty."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        sym = self.first[data]
        ends = np.cumsum(size)
        sym[ends - 1] = self.last[data[ends - 1]]
        out: list[tuple[np.ndarray, np.ndarray]] = []
        word = np.repeat(np.arange(len(words)), size)
        while len(sym):
            pair = np.full(len(sym), self.none, dtype=np.int64)
            inner = np.flatnonzero(word[:-1] == word[1:])
            pair[inner] = self.ranks(sym[inner], sym[inner + 1])
            begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(pair, begin)
            of = np.cumsum(np.concatenate(([False], word[1:] != word[:-1])))
            over = least[of] == self.none
            if over.any():  # words without a pair to merge are done
                out.append((word[over], sym[over]))
                keep = ~over
                sym, word, pair, of = sym[keep], word[keep], pair[keep], of[keep]
                if not len(sym):
                    break
            hit = pair == least[of]
            at = np.flatnonzero(hit)
            run = np.cumsum(np.concatenate(([True], np.diff(at) != 1)))  # of overlapping pairs (aaa), every second one
            offset = at - at[np.searchsorted(run, run)]
            at = at[offset % 2 == 0]
            sym[at] = self.made[pair[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            sym, word = sym[keep], word[keep]
        if not out:
            return np.zeros(0, np.int64), size
        where, ids = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(where, kind="stable")
        return ids[order], np.bincount(where, minlength=len(words))


    def merge_long(self, word: bytes) -> np.ndarray:
        """ids of one long word: its pairs wait in a queue by rank and place, so time is n log n."""
        sym = self.first[np.frombuffer(word, dtype=np.uint8)]
        sym[-1] = self.last[word[-1]]
        rank = self.ranks(sym[:-1], sym[1:])
        known = np.flatnonzero(rank < self.none)
        queue = list(zip(rank[known].tolist(), known.tolist(), sym[known].tolist(), sym[known + 1].tolist(), strict=True))
        heapq.heapify(queue)
        sym = sym.tolist()
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        pairs, made, end = self.pairs, self.made, len(sym)
        while queue:
            r, a, left, right = heapq.heappop(queue)
            b = after[a]
            if sym[a] != left or b >= end or sym[b] != right:
                continue  # one of them has merged since
            sym[a], sym[b] = int(made[r]), -1
            c = after[a] = after[b]
            if c < end:
                before[c] = a
            for x, y in ((before[a], a), (a, c)):
                if x >= 0 and y < end and (rank_ := pairs.get((sym[x], sym[y]))) is not None:
                    heapq.heappush(queue, (rank_, x, sym[x], sym[y]))
        return np.array([x for x in sym if x >= 0], dtype=np.int64)


class Lexicon:
    """A minimal acyclic automaton over byte strings with ids as outputs, in one byte string."""

    FIELDS = ("key", "target", "before", "final", "offset", "ids")

    def __init__(self, data: bytes):
        scratch = tempfile.TemporaryFile()  # unlinked: gone with the process
        scratch.write(data)
        scratch.flush()
        self.map = mmap.mmap(scratch.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = np.frombuffer(self.map, dtype=np.int64, count=len(self.FIELDS))
        at = 8 * len(self.FIELDS)
        for name, n in zip(self.FIELDS, sizes, strict=True):
            setattr(self, name, np.frombuffer(self.map, dtype=np.int64, count=int(n), offset=at))
            at += 8 * int(n)

    @classmethod
    def build(cls, entries: dict[bytes, list[int]]) -> bytes:
        """Compiles sorted words by adding each to the path of the last and freezing what can't change any more."""
        register: dict[tuple, int] = {}
        states: list[tuple[bool, dict[int, int]]] = []

        def freeze(node: list) -> int:
            signature = (node[0], tuple(node[1].items()))
            if signature not in register:
                register[signature] = len(states)
                states.append((node[0], dict(node[1])))
            return register[signature]

        words = sorted(entries)
        path: list[list] = [[False, {}]]
        previous = b""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                node = path.pop()
                path[-1][1][previous[len(path) - 1]] = freeze(node)

        for word in words:
            shared = 0
            while shared < min(len(word), len(previous)) and word[shared] == previous[shared]:
                shared += 1
            close(shared)
            for _ in word[shared:]:
                path.append([False, {}])
            path[-1][0] = True
            previous = word
        close(0)
        root = freeze(path[0])
        count: list[int] = []
        for final, arcs in states:  # targets are frozen before their sources
            count.append(int(final) + sum(count[t] for t in arcs.values()))
        new = {root: 0} | {s: i for i, s in enumerate((s for s in range(len(states)) if s != root), 1)}
        key, target, before = [], [], []
        for s, (final, arcs) in enumerate(states):
            total = int(final)
            for byte, t in sorted(arcs.items()):
                key.append(new[s] << 8 | byte)
                target.append(new[t])
                before.append(total)
                total += count[t]
        final = np.zeros(len(states), dtype=np.int64)
        for s, (ends, _) in enumerate(states):
            final[new[s]] = ends
        order = np.argsort(key, kind="stable") if key else []
        ids = [entries[w] for w in words]
        fields = [np.array(x, dtype=np.int64) for x in (key, target, before)]
        fields = [f[order] if len(f) else f for f in fields]
        fields += [final, np.cumsum([0, *map(len, ids)]).astype(np.int64), np.array(list(chain.from_iterable(ids)), dtype=np.int64)]
        return np.array([len(f) for f in fields], dtype=np.int64).tobytes() + b"".join(f.tobytes() for f in fields)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word in sorted order, or -1: all words walk the automaton together."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        data = np.frombuffer(b"".join(words) or b"\0", dtype=np.uint8).astype(np.int64)
        start = np.cumsum(size) - size
        state, number = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        live, depth = np.flatnonzero(size > 0), 0
        out = np.full(len(words), -1, dtype=np.int64)
        while len(live) and len(self.key):
            key = state[live] << 8 | data[start[live] + depth]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[at] == key
            live, at = live[ok], at[ok]
            state[live] = self.target[at]
            number[live] += self.before[at]
            depth += 1
            ended = size[live] == depth
            done = live[ended]
            accepted = done[self.final[state[done]] == 1]
            out[accepted] = number[accepted]
            live = live[~ended]
        return out


@functools.lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


@functools.lru_cache(maxsize=4)
def compile_lexicon(path: str, extra: tuple[str, ...] = ()) -> bytes:
    """The vocabulary's word-ending entries, and further words, with the ids that merging gives them."""
    model, char = merges(path), _byte_of()
    words = [bytes(char[c] for c in t[: -len(END)]) for t in model.vocab if t.endswith(END) and len(t) > len(END)]
    words += [w.encode() for w in extra if w]
    words = list(dict.fromkeys(words))
    ids, size = model.merge(words)
    parts = np.split(ids, np.cumsum(size)[:-1])
    return Lexicon.build({w: p.tolist() for w, p in zip(words, parts, strict=True)})


class Encoder:
    """Encodes texts; keeps the ids of the words that it has merged, up to a bound."""

    def __init__(self, path: str, lexicon: bytes):
        self.path, self.model, self.lexicon = path, merges(path), Lexicon(lexicon)
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.model.special, key=len, reverse=True))) + ")") if self.model.special else None
        self.known_text: dict[int, str] = {}
        self.clear()

    @functools.cached_property
    def rules(self):
        """The file's normaliser and word pattern; loaded by the first text that needs them."""
        whole = library(self.path)
        return whole.normalizer, whole.pre_tokenizer

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.decoded: list[str] = []
        self.flat = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)

    def words(self, text: str) -> list[bytes]:
        """The words of a text without special tokens."""
        if USUAL.fullmatch(text):
            return [w.encode() for w in WORD.findall(text.lower())]
        normaliser, pattern = self.rules
        return [bytes(map(BYTE_OF.__getitem__, w)) for w, _ in pattern.pre_tokenize_str(normaliser.normalize_str(text))]

    def units(self, text: str) -> list[bytes | int]:
        """The words of a text, and the ids of its special tokens, in order."""
        if self.specials is None or not self.specials.search(text):
            return self.words(text)
        out: list[bytes | int] = []
        for i, part in enumerate(self.specials.split(text)):
            out += [self.model.special_id[part]] if i % 2 else self.words(part)
        return out

    def learn(self, words: list[bytes]) -> None:
        """Merges words that are neither in the automaton nor in the cache."""
        if not words:
            return
        short = [w for w in words if len(w) < LONGEST]
        flat, size = self.model.merge(short)
        for w in words:
            if len(w) >= LONGEST:
                one = self.model.merge_long(w)
                flat, size, short = np.concatenate((flat, one)), np.append(size, len(one)), [*short, w]
        end = np.cumsum(size)
        names = self.names(flat)
        self.decoded += [" ".join(names[e - n : e]) for e, n in zip(end.tolist(), size.tolist(), strict=True)]
        self.index.update(zip(short, range(len(self.index), len(self.index) + len(short)), strict=True))
        self.flat, self.size = np.concatenate((self.flat, flat)), np.concatenate((self.size, size))

    def names(self, ids: np.ndarray) -> list[str]:
        token = self.model.token
        return [token[i] for i in ids.tolist()]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """ids and decoded text of each text."""
        if len(self.index) > CACHED:
            self.clear()
        found = [self.units(t) for t in texts]
        place = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(found)))}
        words = [w for w in place if not isinstance(w, int)]
        number = self.lexicon.numbers(words)
        unseen = [w for w, n in zip(words, number.tolist(), strict=True) if n < 0]
        self.learn([w for w in unseen if w not in self.index])
        ids, offset = self.lexicon.ids, self.lexicon.offset
        begins = np.cumsum(self.size) - self.size + len(ids)  # merged words stand behind the lexicon's, special tokens last
        special = list(self.model.special_id.values())
        pool = np.concatenate((ids, self.flat, np.array(special, dtype=np.int64)))
        start, size, decoded = np.zeros(len(place), np.int64), np.ones(len(place), np.int64), [""] * len(place)
        for w, n in zip(words, number.tolist(), strict=True):
            i = place[w]
            if n >= 0:
                start[i], size[i] = offset[n], offset[n + 1] - offset[n]
                text = self.known_text.get(n)
                decoded[i] = text if text is not None else self.known_text.setdefault(n, " ".join(self.names(ids[offset[n] : offset[n + 1]])))
            else:
                m = self.index[w]
                start[i], size[i], decoded[i] = begins[m], self.size[m], self.decoded[m]
        for w, i in place.items():
            if isinstance(w, int):
                start[i], decoded[i] = len(ids) + len(self.flat) + special.index(w), self.model.token[w]
        out = []
        for units in found:
            at = np.fromiter(map(place.__getitem__, units), dtype=np.int64, count=len(units))
            out.append((pool[expand(start[at], size[at])], " ".join(map(decoded.__getitem__, at.tolist()))))
        return out


def expand(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] of them, then those of start[1], and so on."""
    total = int(size.sum())
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)


_encoders: dict[tuple[str, int], Encoder] = {}


def encode(docs: DataFrame, tokenizer: str | None = None, words: Iterable[str] = (), keep: bool = True) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256; with ``keep`` also the ids and the decoded text."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    lexicon = compile_lexicon(path, tuple(words))
    added = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]
    added += [("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), ("decoded", T.StringType(), pa.string())] * keep
    docs = docs.drop(*(n for n, _, _ in added))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t, _ in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, hash(lexicon))
        enc = _encoders.get(key) or _encoders.setdefault(key, Encoder(path, lexicon))
        for batch in batches:
            for part in pieces(batch, 4 << 20):
                rows = []
                for ids, text in enc.encode([t or "" for t in part.column("text").to_pylist()]):
                    row = (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                    rows.append((*row, ids.astype(np.int32), text) if keep else row)
                new = [pa.array(c, t) for c, (_, _, t) in zip(zip(*rows, strict=True), added, strict=True)]
                yield pa.record_batch([*part.columns, *new], [*part.schema.names, *(n for n, _, _ in added)])

    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the encoding query."""
    return encode(docs.select("doc_id", "text"), keep=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
