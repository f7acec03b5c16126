"""Packing by power-of-two decomposition.

A document of n ids becomes pieces whose lengths are the binary digits of n: floor(n / 2048) pieces
of 2048 ids, then one piece for each set bit of the rest, longest first. Every piece is a sequence of
its own, so no sequence crosses documents and none needs padding; ``bucket`` (log2 of the length)
groups equal lengths, which is what a trainer batches by. Nothing is shuffled: a task maps its
documents to pieces, and its memory is bounded by one slice of a few MB of text.

Ids are those of the byte-level BPE file. Texts without unusual characters are encoded by the same
merge table through the faster of the two libraries; all others by the file's own library.

Nulls and empty texts give one piece of the end id alone. Rows that repeat give pieces each, with
sequence ids of their own. A null doc_id stays null. Other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, offset long, bucket int"
#: Characters for which both libraries' Unicode tables agree: Latin without the separators 28 to 31.
USUAL = re.compile("[\x00-\x1b\x20-ɏ]*")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


def library(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


class ByteEncoder:
    """Encodes as tokenizers does with the file, without special tokens added."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in byte for c in token)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        for token in self.special:
            ranks.pop(token.encode(), None)
        self.fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def exact(self):
        """The file's own library; loaded by the first text that needs it."""
        return library(self.path)

    def encode(self, text: str) -> np.ndarray:
        if USUAL.fullmatch(text) and not any(s in text for s in self.special):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


_encoders: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


def lengths_of(n: int, most: int) -> list[int]:
    """The binary-length pieces of n ids: as many of ``most`` as fit, then the set bits of the rest."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str | None = None, most: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of every document's ids; ``ids`` has them as little-endian unsigned 32-bit integers."""
    if most < 1 or most & (most - 1):
        raise ValueError("the longest length must be a power of two")
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part in pieces(batch):
                rows: list[tuple] = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.append(enc.encode(text or ""), np.uint32(end_id)).astype("<u4")
                    at = 0
                    for n in lengths_of(len(ids), most):
                        rows.append((doc, at, n, ids[at : at + n].tobytes(), len(ids), 0, n.bit_length() - 1))
                        at += n
                cols = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
                names = ["doc_id", "start", "length", "ids", "doc_tokens", "offset", "bucket"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)
    return out.withColumn("sequence_id", F.monotonically_increasing_id())


def digest(pieces_df: DataFrame) -> DataFrame:
    """The columns of the packing query."""
    return pieces_df.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
