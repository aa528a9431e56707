"""Quality by lines: drop lines that break a rule, then documents that lose too much with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, let, text_of, words

# Characters the base rules count as symbols
SYMBOLS = r"[#*$%&|<>]"
# a line fails if one of these holds
BOILERPLATE = (
    r"(?i)all rights reserved|copyright|©|licen[sc]ed under|released under the|privacy policy|terms of (?:use|service)"
    r"|accept (?:all )?cookies|uses? cookies|enable javascript|subscribe to|sign up for|log ?in to|click here|read more$|share (?:this|on)"
)
NAVIGATION = r"^[^|»›>\n]{1,40}(?:[|»›>][^|»›>\n]{1,40}){2,}[|»›>]?$|(?i)^(?:home|menu|next|previous|back|top|contact|about|login|search)[ .!]*$"
CROWDED = r"[#*$%&|<>!?^~=]"  # of these more than CROWD of all characters
CROWD = 0.08
STOP = r"[.!?…:;\"”»)'][\x20\x09\x0B-\x0D]*$"  # a short line without a stop at its end is a fragment
SHORT = r"^[\x20\x09\x0B-\x0D]*(?:[^\x20\x09\x0B-\x0D]+[\x20\x09\x0B-\x0D]*){0,4}$"
# the same lines, read without ever going back: a word is not split, so a line of any length takes one pass
_SHORT_ONCE = r"^[\x20\x09\x0B-\x0D]*+(?:[^\x20\x09\x0B-\x0D]++[\x20\x09\x0B-\x0D]*+){0,4}+$"
MAX_LOSS = 0.4


def repeated_words(ws: Column) -> Column:
    """Words in 3-word windows found twice or more, each word once. Windows are told apart by 64-bit hashes."""

    def of(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) >= 4, let(grams, among)).otherwise(F.lit(0))

    def among(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(ordered, covered))

    def covered(s: Column) -> Column:
        same = lambda k, j: F.coalesce(F.get(s, k)["h"] == F.get(s, j)["h"], F.lit(False))
        twice = F.filter(F.transform(s, lambda x, k: F.when(same(k, k - 1) | same(k, k + 1), x["i"])), lambda i: i.isNotNull())
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        walk = lambda acc, i: F.struct((i + 3).alias("end"), (acc["n"] + i + 3 - F.greatest(i, acc["end"])).alias("n"))
        return F.aggregate(F.sort_array(twice), zero, walk)["n"]

    return let(ws, of)


def line_fails(line: Column) -> Column:
    """Whether a line is boilerplate, navigation, crowded with marks, or a fragment without a stop. A blank line passes."""
    crowded = F.length(line) - F.length(F.regexp_replace(line, CROWDED, "")) > CROWD * F.length(line)
    fragment = ~line.rlike(STOP) & line.rlike(_SHORT_ONCE) & line.rlike(r"[^\x20\x09-\x0D]")
    return crowded | fragment | line.rlike(BOILERPLATE) | line.rlike(NAVIGATION)


def clean_lines(docs: DataFrame, text: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """``docs`` with clean_text (lines that pass), lost (share of characters in lines that fail), lines_kept.

    ``lines_kept`` is true if no more than ``max_loss`` of the text is lost. A null or empty text loses nothing. Columns of these
    names are replaced. No shuffle, no Python.
    """
    clean = F.array_join(F.filter(F.split(text_of(text), "\n", -1), lambda x: ~line_fails(x)), "\n")
    df = docs.withColumn("clean_text", clean)
    whole = F.length(text_of(text))
    df = df.withColumn("lost", F.when(whole > 0, (whole - F.length("clean_text")) / whole).otherwise(F.lit(0.0)))
    return df.withColumn("lines_kept", F.col("lost") <= max_loss)


def quality(docs: DataFrame, id: str = "doc_id", text: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row.

    Base: under 50 words, or over half of the words in 3-word windows that repeat, fails. ``kept``
    also asks that the line rules leave enough of the text (``clean_lines``).

    Null text: no words, fails. Null or repeated ids and repeated rows: rows of their own. A text or line of any length is
    read whole, in time that grows with it. An empty table gives an empty result. Further columns are ignored.
    """
    df = clean_lines(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "text", max_loss)
    t = text_of("text")
    told = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        "id",
        "lines_kept",
        F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(told, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r"))).alias("w"),
    )
    failed = (F.col("w.n") < 50) | (100 * F.col("w.r") > 50 * F.col("w.n"))
    return df.select(
        F.col("id").alias(id),
        F.col("w.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.col("w.r").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & F.col("lines_kept")).alias("kept"),
    )


def _quoted(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(3) AS x(k) GROUP BY r),
l AS (SELECT r, i, ls[i] AS l FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT r, string_split(t, chr(10)) AS ls FROM d))),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM l WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r),
-- lines that pass, with the line ends between them
ok AS (SELECT r, sum(length(l)) + count(*) - 1 AS left_over FROM l
  WHERE NOT (length(l) - length(regexp_replace(l, {_quoted(CROWDED)}, '', 'g')) > {CROWD} * length(l)
    OR (NOT regexp_matches(l, {_quoted(STOP)}) AND regexp_matches(l, {_quoted(SHORT)}) AND regexp_matches(l, '[^\\x20\\x09-\\x0D]'))
    OR regexp_matches(l, {_quoted(BOILERPLATE)}) OR regexp_matches(l, {_quoted(NAVIGATION)})) GROUP BY r),
v AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, {_quoted(SYMBOLS)}, '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, length(t) AS whole, coalesce(left_over, 0) AS left_over
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN ok USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (whole - left_over) / greatest(whole, 1) <= {MAX_LOSS} AS kept FROM v"""
