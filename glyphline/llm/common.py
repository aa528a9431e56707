"""Pieces that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# fixed values: white space and words as the operators' contracts define them
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])

CHUNK_BYTES = 3 << 20
READ_BYTES = 1 << 20  # of text that a task turns into numpy arrays at once where nothing is gained by more
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text; a null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text that is not null."""
    return F.array_remove(F.split(text, SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also if ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def hex_sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session that names none gets a folder of its own.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


# --- numpy views of Arrow text, used inside tasks ---------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(offsets: np.ndarray, limit: int = READ_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes of text, or one longer row."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finishing steps of the public splitmix64 generator)."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            up = np.uint64(pow(self.base, k, 1 << 64))
            down = np.uint64(pow(self.inverse, k, 1 << 64))
            self.up = np.concatenate([self.up, self.up * up])
            self.down = np.concatenate([self.down, self.down * down])
        return self.up[:n], self.down[:n]


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A polynomial hash of every ``values[start:end]``, equal for equal runs wherever they stand."""
    up, down = powers.to(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def find_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte range of every word, and per row the index of its first word.

    ``data`` holds the rows' bytes one after the other, ``offsets`` starts at 0. A row's end
    ends a word. ``first`` has one entry more than there are rows.
    """
    inside = is_word[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    edges = offsets[1:][offsets[1:] > 0] - 1
    after[edges] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


_BYTES = Powers(0x9E3779B97F4A7C15)
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACE_BYTES)] = False


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first, hash) of the words of some rows; see ``find_words``. For look-ups that may err: words made for it can share a hash."""
    base = offsets[0]
    own = data[base : offsets[-1]]
    start, end, first = find_words(own, offsets - base, _IS_WORD)
    return start, end, first, range_hash(own.astype(np.uint64) + np.uint64(1), start, end, _BYTES)
