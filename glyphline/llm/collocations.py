"""Phrase collocations by stripes: every prefix keys the counts of the words that follow it.

A level is one pass over the texts. A task's stripes for prefixes of no word count words, those for prefixes of one word
count pairs, and so on; the stripes of all tasks are merged element by element. From the merged stripes come the
extensions of a phrase (the stripe's cells), its own total (a cell of the shorter prefix), and the largest count of a
longer phrase around it (the maximum of a stripe, and of the stripes that end in it).

A phrase cannot be more frequent than its parts, so a level counts only what the level before leaves possible. That is
looked up in a bitmap of fixed size, which may say yes to a rare phrase but never no to a frequent one: what it holds
decides how much is counted, not what is found.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import checkpoint, ship_package
from .common import CHUNK_BYTES, mix

MIN_COUNT = 10
LONGEST = 3
SHARE = 50  # percent of a phrase's count in one longer candidate that drop it
TOP = 2000

# fixed values: where pieces end
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_BREAK = b"\xff"  # no byte of UTF-8
_UPPER, _LOWER = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))
_TABLE = bytes.maketrans(_UPPER + b"\t" + BREAKS, _LOWER + b" " + _BREAK * len(BREAKS))

FLUSH_WORDS = 1 << 21  # words that a task counts at once
STRIPE = 4096  # cells of a stripe in one row; longer ones take more rows
MARK_BITS = 27
HOT_PARTS, SALTS = 1000, 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _phrase_hash(lang: str, parts: list[np.ndarray]) -> np.ndarray:
    """A hash of phrases of one language from those of their words."""
    g = np.full(len(parts[0]), xxhash.xxh64_intdigest(lang), np.uint64)
    for h in parts:
        g = mix(g * _STEP + h)
    return g


def _marked(marks: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = (h >> np.uint64(6)) & np.uint64(len(marks) - 1)
    return (marks[slot] >> (h & np.uint64(63))) & np.uint64(1) != 0


class _Stripes:
    """The stripes of one level over the texts added since the last flush."""

    def __init__(self, level: int, marks: np.ndarray | None):
        self.level, self.marks = level, marks
        self.held: dict[str, list[bytes]] = defaultdict(list)
        self.size: dict[str, int] = defaultdict(int)
        self.clear()

    def clear(self):
        self.words = 0
        self.parts: dict[str, list[np.ndarray]] = defaultdict(list)
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.number[_BREAK]  # 0

    def add(self, lang: str, text: bytes):
        self.held[lang].append(text)
        self.size[lang] += len(text)
        if self.size[lang] >= CHUNK_BYTES:
            self.cut(lang)

    def cut(self, lang: str):
        text = b" \xff ".join([*self.held.pop(lang), b""]).translate(_TABLE)
        self.size[lang] = 0
        found = text.replace(_BREAK, b" \xff ").split()
        self.parts[lang].append(np.fromiter(map(self.number.__getitem__, found), np.int64, len(found)))
        self.words += len(found)

    def full(self) -> bool:
        return self.words + sum(self.size.values()) // 4 >= FLUSH_WORDS

    def flush(self):
        for lang in list(self.held):
            self.cut(lang)
        known = list(self.number)
        vocabulary = pa.array([b"", *known[1:]], pa.large_binary()).cast(pa.large_string())
        hashes = None if self.marks is None else np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
        for lang, parts in self.parts.items():
            yield from self._emit(lang, np.concatenate(parts), vocabulary, hashes)
        self.clear()

    def _emit(self, lang, x, vocabulary, hashes):
        if self.level == 1:
            cells = np.bincount(x, minlength=len(vocabulary))
            cells[0] = 0
            last = np.flatnonzero(cells)
            yield from _batches(lang, None, np.zeros(len(last), np.int64), vocabulary.take(pa.array(last)), cells[last])
            return
        below = self.level - 1
        n = len(x) - below + 1
        if n < 2:
            return
        good = np.ones(n, bool)
        for m in range(below):
            good &= x[m : m + n] != 0
        at = np.flatnonzero(good)
        good[at] = _marked(self.marks, _phrase_hash(lang, [hashes[x[at + m]] for m in range(below)]))
        at = np.flatnonzero(good[:-1] & good[1:])  # both parts one word shorter are possible
        prefix = x[at]
        for m in range(1, below):
            _, prefix = np.unique(prefix << 32 | x[at + m], return_inverse=True)
        code, where, n = np.unique(prefix << 32 | x[at + below], return_index=True, return_counts=True)
        head = np.flatnonzero(np.concatenate(([True], code[1:] >> 32 != code[:-1] >> 32))) if len(code) else np.zeros(0, np.int64)
        first = at[where[head]]
        names = pc.binary_join_element_wise(*[vocabulary.take(pa.array(x[first + m])) for m in range(below)], pa.scalar(" ", pa.large_string()))
        of = np.repeat(np.arange(len(head)), np.diff(head, append=len(code)))
        yield from _batches(lang, names, of, vocabulary.take(pa.array(x[at[where] + below])), n)


def _batches(lang: str, names: pa.Array | None, of: np.ndarray, last: pa.Array, n: np.ndarray):
    """Stripes as Arrow rows: the cells ``last``, ``n`` belong to prefix number ``of``, in order."""
    if not len(of):
        return
    new = np.concatenate(([True], of[1:] != of[:-1]))
    new[::STRIPE] = True
    begin = np.append(np.flatnonzero(new), len(of))
    for a in range(0, len(begin) - 1, 50_000):
        b = min(a + 50_000, len(begin) - 1)
        lo, hi = begin[a], begin[b]
        offsets = pa.array((begin[a : b + 1] - lo).astype(np.int32))
        prefix = pa.array([""] * (b - a)) if names is None else names.take(pa.array(of[begin[a:b]])).cast(pa.string())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * (b - a)),
                prefix,
                pa.ListArray.from_arrays(offsets, last.slice(lo, hi - lo).cast(pa.string())),
                pa.ListArray.from_arrays(offsets, pa.array(n[lo:hi].astype(np.int64))),
            ],
            ["lang", "prefix", "next", "n"],
        )


def _count(level: int, marks):
    def run(batches):
        known = None if marks is None else np.frombuffer(marks.value, np.uint64)
        stripes = _Stripes(level, known)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                stripes.add(lang, text.as_buffer().to_pybytes())
                if stripes.full():
                    yield from stripes.flush()
        yield from stripes.flush()

    return run


def _bits(mark_bits: int):
    """(slot, bits): the marks of phrases (lang, phrase)."""

    def run(batches):
        for b in batches:
            h = np.empty(b.num_rows, np.uint64)
            for i, (lang, phrase) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                h[i] = _phrase_hash(lang, [np.array([xxhash.xxh64_intdigest(w)], np.uint64) for w in phrase.encode().split(b" ")])[0]
            slot = ((h >> np.uint64(6)) & np.uint64((1 << mark_bits - 6) - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array((np.uint64(1) << (h & np.uint64(63))).view(np.int64))], ["slot", "bits"])

    return run


def _marks_of(phrases: DataFrame, mark_bits: int) -> bytes:
    """A bitmap of ``2 ** mark_bits`` bits with those of all phrases set: its size is fixed, whatever their number."""
    slots = phrases.select("lang", "phrase").mapInArrow(_bits(mark_bits), "slot bigint, bits bigint")
    found = slots.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    marks = np.zeros(1 << mark_bits - 6, np.uint64)
    marks[found["slot"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return marks.tobytes()


def stripe_cells(docs: DataFrame, level: int, marks=None) -> DataFrame:
    """(lang, phrase, size, f): the merged stripes of prefixes of ``level - 1`` words, a row for every cell.

    ``docs`` has (lang, text) without nulls. Cells of one stripe go to different tasks, so no stripe is gathered.
    """
    stripes = docs.select("lang", "text").mapInArrow(_count(level, marks), "lang string, prefix string, next array<string>, n array<bigint>")
    cells = stripes.select("lang", "prefix", F.inline(F.arrays_zip("next", "n")))
    merged = cells.groupBy("lang", "prefix", "next").agg(F.sum("n").alias("f"))
    phrase = F.col("next") if level == 1 else F.concat_ws(" ", "prefix", "next")
    return merged.select("lang", phrase.alias("phrase"), F.lit(level).alias("size"), "f")


def _scored(found: DataFrame, hot: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, a, l, r, score, longer): candidates with their lowest cut and the largest count of one around them.

    A very frequent part is asked for by very many candidates: it stands once for each of ``SALTS`` numbers, which these
    draw by hash. Parts more frequent than one in ``HOT_PARTS`` words are few, whatever the data.
    """
    word = F.split("phrase", " ")
    piece = lambda a, n: F.array_join(F.slice(word, a, n), " ")
    candidates = found.filter(F.col("size") > 1)
    asks = []
    for k in range(1, longest):
        asks += [
            F.when(F.col("size") > k, F.struct(F.lit(k).alias("k"), F.lit(left).alias("left"), (piece(1, k) if left else piece(k + 1, F.col("size") - k)).alias("part")))
            for left in (True, False)
        ]
    asks = F.filter(F.array(*asks), lambda a: a.isNotNull())
    asked = candidates.select("lang", "phrase", F.explode(asks).alias("ask")).select("lang", "phrase", "ask.k", "ask.left", "ask.part")
    hot_asked = hot.select(F.col("lang").alias("hl"), F.col("phrase").alias("hp"))
    here = (F.col("lang") == F.col("hl")) & (F.col("part") == F.col("hp"))
    salt = F.when(F.col("hp").isNotNull(), F.pmod(F.xxhash64("phrase", "k", "left"), F.lit(SALTS)).cast("int")).otherwise(0)
    asked = asked.join(F.broadcast(hot_asked), here, "left").withColumn("salt", salt).drop("hl", "hp")
    is_hot = (F.col("lang") == F.col("hl")) & (F.col("phrase") == F.col("hp"))
    offered = found.join(F.broadcast(hot_asked), is_hot, "left")
    copies = F.when(F.col("hp").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    offered = offered.select(F.col("lang").alias("ol"), F.col("phrase").alias("op"), F.col("f").alias("of"), F.explode(copies).alias("os"))
    same = (F.col("lang") == F.col("ol")) & (F.col("part") == F.col("op")) & (F.col("salt") == F.col("os"))
    told = asked.join(offered, same).select("lang", "phrase", "k", "left", F.col("of").alias("f"))
    # a longer candidate contains this one: the one word longer ones suffice, as counts only fall
    around = candidates.filter(F.col("size") > 2).select("lang", F.explode(F.array(piece(1, F.col("size") - 1), piece(2, F.col("size") - 1))).alias("phrase"), "f")
    around = around.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    none = F.lit(None)
    rows = told.select("*", none.cast("long").alias("a"), none.cast("long").alias("longer"))
    rows = rows.unionByName(candidates.select("lang", "phrase", F.col("f").alias("a")), allowMissingColumns=True)
    rows = rows.unionByName(around.select("lang", "phrase", F.col("f").alias("longer")), allowMissingColumns=True)
    cut = lambda k, left: F.max(F.when((F.col("k") == k) & (F.col("left") == left), F.col("f")))
    totals = [cut(k, left).alias(f"{'l' if left else 'r'}{k}") for k in range(1, longest) for left in (True, False)]
    one = rows.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("longer").alias("longer"), *totals)
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = []
    for k in range(1, longest):
        score = F.expr(f"(a_ * a_ * 1000000BD) div (CAST(l{k} AS decimal(18,0)) * CAST(r{k} AS decimal(18,0)))")
        cuts.append(F.when(F.col(f"l{k}").isNotNull(), F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))))
    one = one.withColumn("a_", exact("a")).withColumn("cut", F.array_min(F.array(*cuts)))
    return one.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "longer")


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    min_count: int = MIN_COUNT,
    longest: int = LONGEST,
    share: int = SHARE,
    mark_bits: int = MARK_BITS,
) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): phrases of 2 to ``longest`` words with at least ``min_count`` places, scored.

    a, l, r: places of the phrase, of its first part and of the rest at its lowest-scoring cut (ties: the earlier cut);
    n: words of the language; score: ``floor(1000000 * a * a / (l * r))``, in exact arithmetic for counts under 10^15.
    A phrase is left out if a longer candidate around it has at least ``share`` percent of its places. Words are runs
    without blank or tab inside pieces, in which texts are cut at ``BREAKS``; A-Z are lower-cased.

    Whole texts of all rows are counted, once for each length; a null text is empty, a null language ``und``, as rows of
    that very name. Repeated rows count again. A text of any length is counted by the words it has; what a task holds
    follows ``FLUSH_WORDS`` or one text. An empty table gives an empty result. Further columns are ignored.
    """
    if longest < 2:
        raise ValueError("phrases have two words or more")
    spark = docs.sparkSession
    ship_package(spark)
    base = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.filter(F.col("text") != "")
    words = checkpoint(stripe_cells(base, 1))
    levels = [words.filter(F.col("f") >= min_count)]
    for level in range(2, longest + 1):
        marks = spark.sparkContext.broadcast(_marks_of(levels[-1], mark_bits))
        levels.append(checkpoint(stripe_cells(base, level, marks).filter(F.col("f") >= min_count)))
        marks.destroy()
    found = levels[0]
    for part in levels[1:]:
        found = found.unionByName(part)
    total = words.agg(F.sum("f")).first()[0] or 0
    # at most HOT_PARTS phrases of each size have more than this share of all places
    hot = found.filter((F.col("f") > total // HOT_PARTS) & (F.col("size") < longest)).select("lang", "phrase")
    scored = _scored(found, hot, longest)
    kept = scored.filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    n = words.groupBy("lang").agg(F.sum("f").alias("n")).withColumnRenamed("lang", "nl")
    return kept.join(n, F.col("lang") == F.col("nl")).select("lang", "phrase", "a", "l", "r", "n", "score")


def best(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language with their rank: by score and count descending, then by phrase."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # one language may hold most phrases: the best of each of SALTS parts first, then the best of those
    part = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    few = phrases.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)))
    return ranked.filter(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))


SQL = f"""WITH p AS (SELECT row_number() OVER () AS r, lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM (
 SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER.decode()}', '{_LOWER.decode()}') AS t FROM documents)),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, {LONGEST + 1}) AS x(k))),
f AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY ALL),
c AS MATERIALIZED (SELECT lang, phrase, k AS size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k BETWEEN 2 AND {LONGEST} AND f >= {MIN_COUNT}),
cut AS (SELECT lang, phrase, size, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
s AS (SELECT cut.lang, cut.phrase, a, size, cut.k, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score FROM cut
 JOIN f AS l ON l.lang = cut.lang AND l.phrase = lp JOIN f AS r ON r.lang = cut.lang AND r.phrase = rp),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
part AS (SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM c))),
kept AS (SELECT * FROM low WHERE NOT EXISTS (SELECT 1 FROM part WHERE part.lang = low.lang AND part.phrase = low.phrase AND 100 * part.a >= {SHARE} * low.a)),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM (
 SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept JOIN n USING (lang)) WHERE rank <= {TOP}"""
