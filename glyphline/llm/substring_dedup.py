"""Repeated passages by recompression: remove words of windows that stood earlier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import ship_package
from . import recompression as R
from .common import CHUNK_BYTES, chunks, mix, text_of, utf8

WIDTH = 20
_LOWEST = -(1 << 63)
_SYMBOL, _SHARED, _WHOLE, _COPY = range(4)  # what a row of the first exchange tells
_WINDOW, _REPEAT = range(2)  # what a row of the second exchange tells


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _firsts(keys: np.ndarray, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(where, size): for every row the row that comes first among those with its key, and how many share it."""
    by = np.argsort(keys, kind="stable") if order is None else np.lexsort((order, keys))
    k = keys[by]
    head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    size = np.diff(head, append=len(k))
    where, many = np.empty(len(k), np.int64), np.empty(len(k), np.int64)
    where[by], many[by] = np.repeat(by[head], size), np.repeat(size, size)
    return where, many


def _same(key: np.ndarray, check: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """For every row the first of those that have its digest."""
    where, _ = _firsts(key, order)
    odd = np.flatnonzero(check != check[where])
    where[odd] = odd
    return where


def _is_copy(told: np.ndarray, words: list[bytes]) -> bool:
    """Whether the words of a document were found to be those of an earlier one."""
    copies = told[told & 3 >= _WHOLE]
    if not len(copies):
        return False
    own, _ = R.digests([b" ".join(words)])
    return bool((copies & ~3 == _signed(own) & ~3).any())


def _rows(column: pa.Array, x: int, y: int) -> list[bytes]:
    return [t.as_buffer().to_pybytes() for t in column.slice(x, y - x).cast(pa.large_binary())]


def _spread_key(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Partition keys for rows that need to meet no other: spread, and the same in every run."""
    return _signed(mix(doc.view(np.uint64) ^ mix(at.astype(np.uint64))))


def _name_symbols(width: int, chunk_bytes: int):
    """Rows (key, check, doc, sub, place) of documents (doc, sub, text): place is 4 times the symbol's
    number (for whole documents, the upper bits of their digest), plus the kind of row.

    Symbols by name, whole documents by their words. What a task sees twice by itself is reported
    under a key of its own, so that a name shared by very many documents brings few rows together.
    """

    def run(batches):
        for b in batches:
            ids, subs = b.column(0).to_numpy(), b.column(1).to_numpy()
            _, offsets = utf8(b.column(2))
            for x, y in chunks(offsets, chunk_bytes):
                doc, sub = ids[x:y], subs[x:y]
                words, first, names = R.words_of(_rows(b.column(2), x, y))
                long = np.diff(first) >= width
                whole, check = R.digests([b" ".join(w) for w in words])
                by_doc = np.lexsort((sub, doc))
                nth = np.empty(len(doc), np.int64)
                nth[by_doc] = np.arange(len(doc))
                head = _same(whole, check, nth)
                copy = long & ((doc > doc[head]) | ((doc == doc[head]) & (sub > sub[head])))
                s = R.parse(names, first, width)
                number = np.arange(len(s.name)) - np.searchsorted(s.row, s.row)
                live = ~copy[s.row]
                name, row, number = s.name[live], s.row[live], number[live]
                where, many = _firsts(name)
                alone = where == np.arange(len(name))
                zero = lambda m: np.zeros(int(m.sum()), np.int64)
                twice = many > 1
                lead = long & (head == np.arange(len(doc)))
                top = _signed(whole) & ~3
                parts = [
                    (_signed(name[alone]), zero(alone), doc[row[alone]], sub[row[alone]], number[alone] * 4 + _SYMBOL),
                    (_spread_key(doc[row[twice]], number[twice]), zero(twice), doc[row[twice]], sub[row[twice]], number[twice] * 4 + _SHARED),
                    (_signed(whole[lead]), check[lead], doc[lead], sub[lead], top[lead] | _WHOLE),
                    (_spread_key(doc[copy] ^ sub[copy], zero(copy)), zero(copy), doc[copy], sub[copy], top[copy] | _COPY),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["key", "check", "doc", "sub", "place"])

    return run


def _place_windows(width: int, chunk_bytes: int):
    """Rows (key, check, doc, sub, place) of the windows that may stand twice, from documents (doc, sub, nth, text, known).

    place: number of the document among those of its id, first word, kind of row. A window that a
    task has met earlier is reported as a repeat, with ``check`` windows in a row.
    """

    def run(batches):
        for b in batches:
            ids, subs, nths = (b.column(i).to_numpy() for i in range(3))
            _, offsets = utf8(b.column(3))
            known = b.column(4)
            for x, y in chunks(offsets, chunk_bytes):
                doc, sub, nth = ids[x:y], subs[x:y], nths[x:y].astype(np.int64)
                words, first, names = R.words_of(_rows(b.column(3), x, y))
                s = R.parse(names, first, width)
                # symbols stand in order of rows: the n-th of a row is n after the row's first
                begin = np.searchsorted(s.row, np.arange(y - x + 1))
                shared, out = np.zeros(len(s.name), bool), np.zeros(y - x, bool)
                for r in range(y - x):
                    told = known[x + r]
                    if told.is_valid:
                        told = np.asarray(told.values)
                        number = told[told & 3 <= _SHARED] >> 2
                        # another text of this id may have more symbols
                        shared[begin[r] + number[number < begin[r + 1] - begin[r]]] = True
                        out[r] = _is_copy(told, words[r])
                at = R.possible(s, shared, first, width)
                row = np.searchsorted(first, at, side="right") - 1
                at, row = at[~out[row]], row[~out[row]]
                h, check = R.window_digests(words, first, at, width)
                order = np.lexsort((at, nth[row], sub[row], doc[row]))  # rows of a partition come by id, those of one id by number
                at, row, h, check = at[order], row[order], h[order], check[order]
                where = _same(h, check)
                pos = at - first[row]
                d, u, v = doc[row], nth[row], sub[row]
                lead = where == np.arange(len(at))
                # a repeated row of one document is that document, not a copy of it
                again = ~lead & ((d != d[where]) | (u != u[where]) | (v != v[where]) | (pos != pos[where]))
                place = lambda m, kind: (u[m] << 41) | (pos[m] << 1) | kind
                names_out = ["key", "check", "doc", "sub", "place"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(h[lead])), pa.array(check[lead]), pa.array(d[lead]), pa.array(v[lead]), pa.array(place(lead, _WINDOW))], names_out
                )
                i = np.flatnonzero(again)
                if len(i):
                    new = np.concatenate(([True], (row[i][1:] != row[i][:-1]) | (pos[i][1:] != pos[i][:-1] + 1)))
                    head = np.flatnonzero(new)
                    run_of = np.diff(head, append=len(i))
                    j = i[head]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_spread_key(d[j] ^ v[j], pos[j])), pa.array(run_of), pa.array(d[j]), pa.array(v[j]), pa.array(place(j, _REPEAT))], names_out
                    )

    return run


def _cut(width: int):
    """(n_words, n_removed, kept_text) of documents (doc, nth, text, known, repeats)."""

    def run(batches):
        for b in batches:
            n, gone, kept = [], [], []
            nths, known = b.column(1).to_pylist(), b.column(3)
            for r, (text, repeats) in enumerate(zip(b.column(2), b.column(4))):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                n.append(len(words))
                if known[r].is_valid and _is_copy(np.asarray(known[r].values), words):
                    gone.append(len(words))
                    kept.append("")
                    continue
                drop = np.zeros(len(words) + 1, np.int64)
                if repeats.is_valid:
                    at = np.array([(x["place"], x["run"]) for x in repeats.as_py()], np.int64)
                    at = at[at[:, 0] >> 41 == nths[r]]
                    begin = (at[:, 0] & ((1 << 41) - 1)) >> 1
                    np.add.at(drop, begin, 1)
                    np.add.at(drop, begin + at[:, 1] + width - 1, -1)
                stay = np.cumsum(drop)[:-1] == 0
                gone.append(len(words) - int(stay.sum()))
                left = words if gone[-1] == 0 else [words[i] for i in np.flatnonzero(stay)]
                kept.append(b" ".join(left).decode("utf-8"))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc", "n_words", "n_removed", "kept_text"]
            )

    return run


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, n_words, n_removed, kept_text) of every row: words covered by a window that also starts earlier are gone.

    A window is ``width`` words of one document; earlier is a smaller id, or the same document further
    ahead; windows are judged on the input. Words are runs without ASCII white space, unchanged;
    kept words are joined by one blank.

    Method (recompression): rounds of naming runs and pairs give equal stretches equal symbols inside.
    1. Names of symbols, with the words that decide them, are brought together: which stand twice?
       Whole documents are such names too: a later one with the same words is all repeat.
    2. A window that holds a symbol standing nowhere else stands nowhere else; only the rest is brought together, by
       112 bits of the BLAKE2b digest of its words, and the first place of each is found.
    3. Places that are not first are joined back and cut.
    Texts are shuffled once, by id. Rows that a task can decide by itself cross under keys of their own, so a passage in a
    third of all documents meets in one task with a row for each ``chunk_bytes`` of text at most.

    Ids are integers; null counts as the smallest. Rows of one id with different texts are documents
    in the order of a text hash; repeated rows (same id and text) are one document and get the same result. Rows
    without an id are dealt by that hash, so a table of them spreads; what is told of a document is bounded by its text.
    Null text has no words. An empty table gives an empty result. Further columns are ignored.
    """
    ship_package(docs.sparkSession)
    named = "key bigint, check bigint, doc bigint, sub bigint, place bigint"
    # documents without an id are told apart by their text alone
    sub = F.when(F.col(id).isNull(), F.xxhash64(text_of(text))).otherwise(F.lit(0).cast("long"))
    base = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(_LOWEST)).alias("doc"), sub.alias("sub"), text_of(text).alias("text"))
    own = ["doc", "sub"]
    # 1
    names = base.mapInArrow(_name_symbols(width, chunk_bytes), named).withColumn("kind", F.col("place").bitwiseAND(F.lit(3)))
    alike = W.partitionBy("key", "check", "kind")
    names = names.withColumn("n", F.count(F.lit(1)).over(alike)).withColumn("low", F.min(F.struct(*own)).over(alike))
    told = names.filter(
        F.col("kind").isin(_SHARED, _COPY) | ((F.col("kind") == _SYMBOL) & (F.col("n") > 1)) | ((F.col("kind") == _WHOLE) & (F.struct(*own) > F.col("low")))
    )
    known = told.groupBy(*own).agg(F.collect_set("place").alias("known"))
    # 2
    rows = base.withColumn("nth", (F.dense_rank().over(W.partitionBy(*own).orderBy(F.xxhash64("text"))) - 1).cast("long"))
    rows = rows.join(known, own, "left").select(*own, "nth", "text", "known")
    places = rows.mapInArrow(_place_windows(width, chunk_bytes), named).withColumn("kind", F.col("place").bitwiseAND(F.lit(1)))
    ranked = places.withColumn("rank", F.dense_rank().over(W.partitionBy("key", "check", "kind").orderBy(*own, "place")))
    repeats = ranked.filter((F.col("kind") == _REPEAT) | (F.col("rank") > 1))
    repeats = repeats.select(*own, F.struct("place", F.when(F.col("kind") == _REPEAT, F.col("check")).otherwise(1).alias("run")).alias("repeat"))
    # 3
    found = rows.join(repeats.groupBy(*own).agg(F.collect_set("repeat").alias("repeats")), own, "left")
    cut = found.select("doc", "nth", "text", "known", "repeats").mapInArrow(_cut(width), "doc bigint, n_words bigint, n_removed bigint, kept_text string")
    whose = F.when(F.col("doc") > _LOWEST, F.col("doc")).cast(docs.schema[id].dataType)
    return cut.select(whose.alias(id), "n_words", "n_removed", "kept_text")


SQL = """WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
w AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, range(20) AS r(k)),
x AS (SELECT doc_id, w[i] AS x, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
kept AS (SELECT x.doc_id, string_agg(x, ' ' ORDER BY x.i) AS t, count(*) AS n FROM x ANTI JOIN gone ON x.doc_id = gone.doc_id AND x.i = gone.i GROUP BY x.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
