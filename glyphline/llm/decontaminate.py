"""Benchmark decontamination: a broadcast set of normalised test n-grams scanned over the corpus."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import checkpoint, release, ship_package
from .common import Powers, chunks, find_words, hex_sha256, range_hash, text_of, utf8

WINDOW = 13
# windows of one broadcast block; a larger benchmark is scanned for block by block
BLOCK_WINDOWS = 1_000_000
# an item is dealt to blocks in stretches of a block's windows by this
STRETCHES = 16
_BYTES, _WORDS = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93)
_SIFT_BITS = 22

# fixed values: word bytes after lower-casing A-Z; all bytes of characters beyond ASCII belong to words
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_IS_WORD = np.ones(256, bool)
_IS_WORD[:0x30] = _IS_WORD[0x3A:0x61] = _IS_WORD[0x7B:0x80] = False


@dataclass
class Text:
    """The words of some rows: lower-cased bytes, byte ranges, hashes, and each row's first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def read(data: np.ndarray, offsets: np.ndarray) -> Text:
    base = offsets[0]
    data = _LOWER[data[base : offsets[-1]]]
    start, end, first = find_words(data, offsets - base, _IS_WORD)
    values = data.astype(np.uint64) + np.uint64(1)
    return Text(data, start, end, first, range_hash(values, start, end, _BYTES))


def windows(t: Text, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of ``width`` words inside one row."""
    n = len(t.start)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - width + 1)
    room = t.first[np.searchsorted(t.first, at, side="right")] - at
    at = at[room >= width]
    return at, range_hash(t.hashes, at, at + width, _WORDS)


class Index:
    """Windows of benchmark items: for each width sorted hashes, the words to verify, the items."""

    def __init__(self, ids: list[str], texts: list[str], width: int):
        data, offsets = utf8(pa.array(texts, pa.large_string()))
        t = read(data, offsets)
        self.widths: dict[int, tuple] = {}
        found: dict[int, dict[int, dict[bytes, set[str]]]] = {}
        count = np.diff(t.first)
        for w in sorted({min(width, int(c)) for c in count if c}):
            at, hashes = windows(t, w)
            row = np.searchsorted(t.first, at, side="right") - 1
            fits = np.minimum(count[row], width) == w  # longer items have windows of their own width only
            for i, h, r in zip(at[fits].tolist(), hashes[fits].tolist(), row[fits].tolist()):
                words = b" ".join(t.word(k) for k in range(i, i + w))
                found.setdefault(w, {}).setdefault(h, {}).setdefault(words, set()).add(ids[r])
        for w, by_hash in found.items():
            keys = np.array(sorted(by_hash), np.uint64)
            sift = np.zeros(1 << _SIFT_BITS, bool)
            sift[keys >> np.uint64(64 - _SIFT_BITS)] = True
            self.widths[w] = (keys, np.packbits(sift), [{k: sorted(v) for k, v in by_hash[int(x)].items()} for x in keys])

    def hits(self, t: Text):
        """(row, first word, width, items) of every verified occurrence."""
        for w, (keys, packed, content) in self.widths.items():
            at, hashes = windows(t, w)
            sift = np.unpackbits(packed).view(bool)
            may = sift[hashes >> np.uint64(64 - _SIFT_BITS)]
            at, hashes = at[may], hashes[may]
            place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            same = keys[place] == hashes
            at, place = at[same], place[same]
            rows = np.searchsorted(t.first, at, side="right") - 1
            for i, p, r in zip(at.tolist(), place.tolist(), rows.tolist()):
                items = content[p].get(b" ".join(t.word(k) for k in range(i, i + w)))
                if items:
                    yield r, i, w, items


def _stretches(width: int, most: int):
    """(i, t, n): items as stretches of their words with ``most`` windows each, so that no item fills a block."""

    def run(batches):
        for b in batches:
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                t = read(*utf8(pa.array([text.as_py()], pa.large_string())))
                words = [t.word(k) for k in range(len(t.start))]
                for a in range(0, max(len(words) - width + 1, min(len(words), 1)), most):
                    own = words[a : a + most + width - 1]
                    out.append((i, b" ".join(own).decode("utf-8"), max(len(own) - width + 1, 1)))
            i, t, n = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.string()), pa.array(t, pa.string()), pa.array(n, pa.int64())], ["i", "t", "n"])

    return run


def _scan(index, text_at: int, names: list[str]):
    """Add to every row the word ranges hit by this block and its items.

    The last columns hold what the blocks before have found.
    """

    def run(batches):
        ix: Index = index.value
        for b in batches:
            data, offsets = utf8(b.column(text_at))
            n_words = np.zeros(b.num_rows, np.int64)
            ranges: list[list] = [x or [] for x in b.column(b.num_columns - 2).to_pylist()]
            items: list[list] = [x or [] for x in b.column(b.num_columns - 1).to_pylist()]
            for x, y in chunks(offsets):
                t = read(data, offsets[x : y + 1])
                n_words[x:y] = np.diff(t.first)
                for r, i, w, found in ix.hits(t):
                    own = i - int(t.first[r])
                    r += x
                    last = ranges[r]
                    if last and last[-2] <= own <= last[-1]:
                        last[-1] = max(last[-1], own + w)
                    else:
                        ranges[r] = last + [own, own + w] if not last or own > last[-1] else _joined(last + [own, own + w])
                    items[r] = sorted({*items[r], *found}) if not set(found) <= set(items[r]) else items[r]
            kept = b.columns[: b.num_columns - 3]
            out = [*kept, pa.array(n_words), pa.array(ranges, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def _joined(ranges: list[int]) -> list[int]:
    """Flat [start, end, …] of the union of ranges, in order."""
    out: list[int] = []
    for a, b in sorted(zip(ranges[::2], ranges[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, hit_ranges (array of word ranges, flat) and hit_items. No shuffle of ``docs``.

    The benchmark's windows are counted first. Up to BLOCK_WINDOWS are broadcast at once; a larger one is cut into
    stretches that are dealt into blocks by hash. The corpus is scanned once for each block, what was found is
    written in between, and the block's broadcast is given up before the next is made.
    """
    spark = docs.sparkSession
    ship_package(spark)
    bench = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("i"), text_of(item_text).alias("t"))
    bench = checkpoint(bench.mapInArrow(_stretches(width, max(1, BLOCK_WINDOWS // STRETCHES)), "i string, t string, n bigint"))
    total = bench.agg(F.sum("n")).first()[0] or 0
    blocks = 1 if total <= BLOCK_WINDOWS else int(2 * total // BLOCK_WINDOWS) + 1  # half full on average
    out = docs.drop("n_words", "hit_ranges", "hit_items")
    plain = out.columns
    out = out.select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<bigint>").alias("hit_ranges"), F.array().cast("array<string>").alias("hit_items"))
    for k in range(blocks):
        rows = bench.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).select("i", "t").collect()
        index = spark.sparkContext.broadcast(Index([r[0] for r in rows], [r[1] for r in rows], width))
        found = out.mapInArrow(_scan(index, plain.index(text), out.columns), out.schema)
        if blocks > 1:
            found = checkpoint(found)
            index.destroy()
            release(out)
        out = found
    return out


def _n_hit():
    return F.aggregate(
        F.sequence(F.lit(0), F.size("hit_ranges") - 2, F.lit(2)),
        F.lit(0).cast("long"),
        lambda acc, i: acc + F.get("hit_ranges", i + 1) - F.get("hit_ranges", i),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", share: int = 20, **how) -> DataFrame:
    """(id, n_words, n_hit, n_items, items, contaminated) of every row.

    Words: A-Z lower-cased, runs of digits, letters and all characters beyond ASCII. A window is
    ``width`` consecutive words of an item, or all words of a shorter one. A document word in
    any occurrence of a window is hit; ``contaminated`` if ``share`` times the hit words reach the
    number of words. Hash hits are verified word by word.

    Null or empty texts have no words and are never contaminated; texts of any length are scanned whole; null item ids are named
    "null"; items with one id count once; an empty benchmark hits nothing. Further columns are ignored.
    """
    text = how.get("text", "text")
    found = scan(docs.select(id, text) if id != text else docs.select(id), benchmark, **how)
    found = found.withColumn("n_hit", F.when(F.size("hit_ranges") > 0, _n_hit()).otherwise(F.lit(0).cast("long")))
    return found.select(
        id,
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.array_sort("hit_items").alias("items"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, share: int = 20, **how) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns."""
    held = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    at = docs.columns.index(how.pop("text", "text"))
    found = scan(held, benchmark, text=f"c{at}", **how)
    n_hit = F.when(F.size("hit_ranges") > 0, _n_hit()).otherwise(F.lit(0).cast("long"))
    clean = found.filter(~((n_hit > 0) & (share * n_hit >= F.col("n_words"))))
    return clean.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` with the hit words cut out of the text; what parts words stays as it was."""
    ship_package(docs.sparkSession)
    held = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    at = docs.columns.index(text)
    found = scan(held, benchmark, text=f"c{at}", **how)

    def cut(batches):
        for b in batches:
            raw, offsets = utf8(b.column(at))
            out = []
            for r, ranges in enumerate(b.column(b.num_columns - 2).to_pylist()):
                if not ranges:
                    out.append(b.column(at)[r].as_py())
                    continue
                t = read(raw, offsets[r : r + 2])
                own, left, done = raw[offsets[r] : offsets[r + 1]], [], 0
                for a, z in zip(ranges[::2], ranges[1::2]):
                    left.append(own[done : t.start[a]].tobytes())
                    done = int(t.end[z - 1])
                out.append((b"".join(left) + own[done:].tobytes()).decode("utf-8"))
            cols = list(b.columns)
            cols[at] = pa.array(out, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    cleaned = found.mapInArrow(cut, found.schema)
    return cleaned.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def digest_of_items():
    return hex_sha256(F.array_join("items", ","))
