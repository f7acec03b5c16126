"""Helpers that the operators of this folder share.

Texts travel to Python as Arrow string arrays. ``TextBatch`` exposes one as a single UTF-8 byte
buffer with offsets, so that tokenising and hashing run as numpy passes over the whole batch
instead of once per row.
"""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import shared_folder

U64 = np.uint64
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Odd multiplier of the byte polynomial and the mixing constants of the 64-bit finaliser.
BASE = 0x9E3779B97F4A7C15 | 1
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Blocks of eight bytes up to which words are hashed all at once.
BLOCKS = 4
#: White space between words: space and the characters 9 to 13.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = np.asarray(x, dtype=U64).copy()
    x ^= x >> U64(30)
    x *= U64(MIX_A)
    x ^= x >> U64(27)
    x *= U64(MIX_B)
    x ^= x >> U64(31)
    return x


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=U64))
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << max(0, n - 1).bit_length())
        have = np.empty(size, dtype=U64)
        have[0] = 1
        done = 1
        while done < size:  # doubling: have[done:2 done] = have[:done] * base**done
            step = U64(pow(base, done, 1 << 64))
            have[done : 2 * done] = have[:done] * step
            done *= 2
        _powers[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[i] = sum of value(data[j]) * BASE**j over j < i, modulo 2**64."""
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_BYTE_VALUE[data] * powers(len(data)), out=out[1:])
    return out


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end]: blocks of eight bytes, each mixed into what the blocks before it gave.

    No polynomial, which would give words of a known kind one hash. Words of up to eight bytes and one length never collide.
    """
    length = end - start
    out = mix64(length.astype(U64) * U64(MIX_A) + U64(BASE))
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    block = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    live = np.flatnonzero(length <= BLOCKS * 8)
    for j in range(BLOCKS):
        live = live[length[live] > 8 * j]
        if not len(live):
            break
        value, left = block[start[live] + 8 * j].astype(U64), length[live] - 8 * j
        value &= U64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(left, 8)) * 8).astype(U64)
        out[live] = mix64((out[live] ^ value) * U64(BASE))
    for i in np.flatnonzero(length > BLOCKS * 8).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return out


class TextBatch:
    """One Arrow string array as bytes: ``data``, and ``start``/``end`` of each row; nulls are empty."""

    def __init__(self, column: pa.Array, lower: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if pa.types.is_string(column.type):
            column = column.cast(pa.large_string())
        if column.null_count:
            column = column.fill_null("")
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
        first, last = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
        self.data = data[first:last]
        self.start, self.end = (offsets[:-1] - first, offsets[1:] - first) if len(column) else (np.zeros(0, np.int64),) * 2
        if lower:
            upper = (self.data >= 65) & (self.data <= 90)
            self.data = self.data + (upper.astype(np.uint8) << 5)

    def __len__(self) -> int:
        return len(self.start)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start and end of every word of the batch, and the row that it belongs to."""
        inside = np.zeros(len(self.data) + 2, dtype=bool)
        inside[1:-1] = ~SPACES[self.data]
        edge_start = inside[1:-1] & ~inside[:-2]
        edge_end = inside[1:-1] & ~inside[2:]
        filled = self.end > self.start
        if filled.any():  # words end where their row ends
            edge_start[self.start[filled]] |= inside[1:-1][self.start[filled]]
            edge_end[self.end[filled] - 1] |= inside[1:-1][self.end[filled] - 1]
        start, end = np.flatnonzero(edge_start), np.flatnonzero(edge_end) + 1
        row = np.searchsorted(self.end, start, side="right")
        return start, end, row

    def word_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hash of every word, and its row."""
        start, end, row = self.words()
        return word_hash(self.data, start, end), row

    def text(self, row: int) -> bytes:
        return self.data[self.start[row] : self.end[row]].tobytes()


def tidy() -> None:
    """Gives free memory back to the system: Python workers are reused, and what they keep adds up beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def pieces(batch: pa.RecordBatch, most_bytes: int = 1 << 20, *columns: str):
    """The batch in slices of at most ``most_bytes`` of text (one row at least), which bounds memory."""
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns or ("text",))
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most_bytes:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(n)
    if begin < len(sizes):
        yield batch.slice(begin)
    tidy()


class Workspace:
    """Tables that one operator writes to the shared folder to cut lineage; ``drop`` removes one that is no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/evidentia-{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._held = getattr(self, "_held", [])
        self._held.append(out)
        return out

    def again(self, frame: DataFrame) -> DataFrame:
        """The same table read a second time, for a plan that meets it twice."""
        return self.spark.read.schema(frame.schema).parquet(self.paths[id(frame)])

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for frame in frames:
            path = jvm.org.apache.hadoop.fs.Path(self.paths[id(frame)])
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
