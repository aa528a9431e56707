"""Readers and writers of notation text.

Readers take lines (doc, n, line) and give measures (doc, clef, line, measure_no, text).
State that runs down a file (the section a line belongs to) is a carried value in line
order; writers give one row per line of text with the columns that order it, so that no
file has to pass through one row or one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..core import scan as S
from ..functions import scalar as N

# The words of the notation files.
TREBLE, BASS, LINE = "高音", "低音", "行"
TITLE = "简谱翻译结果"
RULE = "=" * 60
HASHES = "#" * 60
TRUTH_LINE = r"(?iU)^line\s+(\d+)\s*:"
HEADER = r"(?U)^---\s*第\s*(\d+)\s*行\s*---"
OUTPUT_HEADER = r"(?U)第\s*(\d+)\s*行|System\s+(\d+)"
BLANK = r"^\|?空([一二两三四])拍\|?$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc, n, line) of text files; a file is one notation document of a few pages."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc"), "value")
    return t.select("doc", F.posexplode(F.split("value", "\n")).alias("n", "line"))


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return N.whole_number(F.regexp_extract(text, pattern, group))


def _measures(d: DataFrame, clean=N.strip) -> DataFrame:
    """Explode ``parts``, drop blank ones, number measures inside their section in file order."""
    m = d.select("doc", "clef", "section", "n", F.posexplode("parts").alias("__i", "raw"))
    m = m.withColumn("text", clean(F.col("raw"))).filter(F.col("text") != "")
    m = S.scan(m, ["doc", "clef", "section"], ["n", "__i"], measure_no=S.row_number())
    return m.select("doc", "clef", F.col("section").alias("line"), F.col("measure_no").cast("int").alias("measure_no"), "text")


def truth_lines(lines: DataFrame) -> DataFrame:
    """Lines with their section (clef, section); lines of dropped sections have none."""
    d = lines.withColumn("t", N.strip(F.col("line")))
    t = F.col("t")
    clef = F.when(F.contains(t, F.lit(TREBLE)), "treble").when(F.contains(t, F.lit(BASS)), "bass")
    grand = F.coalesce(_number(t, r"(?U)line\s*=\s*(\d+)"), F.lit(1))
    # most lines are no heads: a look for the word is cheaper than the pattern
    numbered = F.when(F.lower(F.substring(t, 1, 4)) == "line", _number(t, TRUTH_LINE))
    chinese = F.when(F.contains(t, F.lit("第")), _number(t, HEADER))
    none = F.struct(F.lit(None).cast("string").alias("clef"), F.lit(None).cast("int").alias("section"))
    key = lambda c, v: F.struct(c.alias("clef"), v.alias("section"))
    head = (
        F.when(clef.isNotNull(), key(clef, grand))
        .when(numbered.isNotNull(), F.when(F.contains(F.lower(t), F.lit("undone")), none).otherwise(key(F.lit("solo"), numbered)))
        .when(chinese.isNotNull(), key(F.lit("solo"), chinese)))
    d = d.withColumn("__head", head)
    d = S.scan(d, ["doc"], ["n"], __sec=S.last_value("__head"))
    return d.select("doc", "n", "t", F.col("__head").isNotNull().alias("is_head"), "__sec.clef", "__sec.section")


def read_truth(lines: DataFrame) -> DataFrame:
    """Measures of a labelled file. Section heads: both clefs with ``line=N``, ``line N:`` (dropped
    when marked undone) and ``--- 第N行 ---``; counted blanks become rest measures."""
    d = truth_lines(lines).filter(~F.col("is_head") & F.col("section").isNotNull() & (F.col("t") != ""))
    word = F.regexp_extract("t", BLANK, 1)
    counts = F.create_map(*[F.lit(v) for kv in N.BLANK_COUNTS.items() for v in kv])
    plain = F.split("t", r"\|")
    parts = F.when(word != "", N.blank_measures(F.element_at(counts, F.nullif(word, F.lit(""))))).when(
        F.startswith("t", F.lit("|")), plain)
    return _measures(d.withColumn("parts", parts).filter(F.col("parts").isNotNull()), N.normalize_measure)


def truth_sections(lines: DataFrame) -> DataFrame:
    """All sections a labelled file opens, those without measures included."""
    d = truth_lines(lines).filter(F.col("is_head") & F.col("section").isNotNull())
    return d.select("doc", "clef", F.col("section").alias("line")).distinct()


def read_output(lines: DataFrame) -> DataFrame:
    """Measures of a generated file. The clef stays until the next section head; a line of
    ``=`` ends the sections, so the dump after it is ignored."""
    lines = lines.withColumn("t", N.strip(F.col("line")))
    t = F.col("t")
    may_be = F.contains(t, F.lit("第")) | F.contains(t, F.lit("System"))
    number = F.when(may_be, F.coalesce(_number(t, OUTPUT_HEADER), _number(t, OUTPUT_HEADER, 2)))
    reset = F.startswith(t, F.lit("="))
    has_bar = F.contains(t, F.lit("|"))
    # labels in the order in which they are looked for
    labels = [(TREBLE + ":", "treble"), (BASS + ":", "bass"), ("Treble:", "treble"), ("Bass:", "bass")]
    starts = F.when(F.startswith(t, F.lit(TREBLE)) | F.startswith(t, F.lit("Treble")), "treble").when(
        F.startswith(t, F.lit(BASS)) | F.startswith(t, F.lit("Bass")), "bass")
    label, rest = starts, t
    for text, clef in reversed(labels):
        hit = has_bar & F.contains(t, F.lit(text))
        label = F.when(hit, clef).otherwise(label)
        rest = F.when(hit, F.substring(t, F.instr(t, text) + len(text), F.length(t))).otherwise(rest)
    head = number.isNotNull()
    skip = F.startswith(t, F.lit("---")) & ~F.contains(t, F.lit(LINE))
    d = lines.withColumns({
        "__no": F.when(head, number).when(reset, 0),
        "__clef": F.when(head | reset, "").when(~skip, label),
        "__body": F.when(~head & ~reset & ~skip & has_bar, rest)})
    d = S.scan(d, ["doc"], ["n"], section=S.last_value("__no"), __c=S.last_value("__clef"))
    d = d.filter(F.col("__body").isNotNull() & (F.col("section") > 0))
    clef = F.coalesce(F.nullif("__c", F.lit("")), F.lit("solo"))
    return _measures(d.select("doc", "n", clef.alias("clef"), "section", F.split("__body", r"\|").alias("parts")))


def notation_lines(measures: DataFrame) -> DataFrame:
    """Text lines of a notation file: (doc, block, line, part, measure_no, text), in that order.

    Each staff line has a head and its measures, the first of a clef behind its label; after
    a rule, documents with clefs repeat all measures per clef.
    """
    part = F.when(F.col("clef") == "bass", 2).otherwise(1)
    label = F.when(F.col("measure_no") == 1, F.when(F.col("clef") == "treble", f"{TREBLE}: ").when(F.col("clef") == "bass", f"{BASS}: ")).otherwise(None)
    text = F.concat(F.lit("|"), "text", F.lit("|"))
    order = ["doc", "block", "line", "part", "measure_no", "text"]
    body = measures.select("doc", F.lit(1).alias("block"), "line", part.alias("part"), "measure_no",
                           F.concat(F.coalesce(label, F.lit("")), text).alias("text"))
    heads = measures.select("doc", "line").distinct().select(
        "doc", F.lit(1).alias("block"), "line", F.lit(0).alias("part"), F.lit(0).alias("measure_no"),
        F.format_string("--- 第%d行 ---", "line").alias("text"))
    docs = measures.groupBy("doc").agg(F.bool_or(F.col("clef") != "solo").alias("__g"))
    row = lambda block, at, t: F.struct(F.lit(block).alias("block"), F.lit(at).alias("line"), F.lit(0).alias("part"),
                                        F.lit(0).alias("measure_no"), F.lit(t).alias("text"))
    fixed = [row(0, 0, TITLE), row(0, 1, RULE), row(2, 0, RULE)]
    grand = [row(3, 0, f"{TREBLE}部分:"), row(4, 0, f"{BASS}部分:")]
    ends = docs.select("doc", F.explode(F.when(F.col("__g"), F.array(*fixed, *grand)).otherwise(F.array(*fixed))).alias("r"))
    dump = measures.filter(F.col("clef") != "solo").select(
        "doc", F.when(F.col("clef") == "bass", 4).otherwise(3).alias("block"), "line", F.lit(1).alias("part"), "measure_no", text.alias("text"))
    return body.select(*order).unionByName(heads).unionByName(ends.select("doc", "r.*")).unionByName(dump)


def concat_pages(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of a score as one document: (score, page, n, text).

    Failed pages are left out; lines before a page's first bar or ``---`` line go; section
    heads are numbered on through the score; each page opens with a banner (n < 0).
    """
    good = pages.filter(F.col("status") == "ok").select("score", "page")
    d = lines.join(good, ["score", "page"], "left_semi")
    opens = F.startswith("text", F.lit("---")) | F.startswith("text", F.lit("|"))
    first = d.filter(opens).groupBy("score", "page").agg(F.min("n").alias("__from"))
    d = d.join(first, ["score", "page"], "left").filter(F.col("__from").isNull() | (F.col("n") >= F.col("__from"))).drop("__from")
    is_head = F.regexp_like("text", F.lit(HEADER))
    d = S.scan(d, ["score"], ["page", "n"], __no=S.run_sum(is_head.cast("long")))
    text = F.when(is_head, F.format_string("--- 第%d行 ---", "__no")).otherwise(F.col("text"))
    body = d.select("score", "page", "n", text.alias("text"))
    banner = F.array(F.lit(HASHES), F.concat(F.lit("# 第 "), F.col("page").cast("string"), F.lit(" 页")), F.lit(HASHES))
    heads = good.select("score", "page", F.posexplode(banner).alias("__i", "text")).select("score", "page", (F.col("__i") - 3).alias("n"), "text")
    return body.unionByName(heads)


def write_lines(df: DataFrame, key: str, order: list[str], path: str, text: str = "text") -> None:
    """One folder of text files per document, lines in order across its files.

    Range partitioning keeps the order and lets a long document span several tasks.
    """
    laid = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    laid.select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc, n, line) of what ``write_lines`` wrote by ``doc``: lines in order across the files of a document.

    Files are read whole, one task each or several; blank lines keep their place.
    """
    t = spark.read.option("basePath", path).text(f"{path}/doc=*", wholetext=True)
    file = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    lines = F.split(F.regexp_replace("value", "\n$", ""), "\n", -1)
    t = t.select(F.col("doc").cast("string").alias("doc"), file.alias("file"), F.posexplode(lines).alias("i", "line"))
    return t.select("doc", (F.shiftleft("file", 32) + F.col("i")).alias("n"), "line")


def write_notation(measures: DataFrame, path: str) -> None:
    """Measures as notation files, a folder of files for each document; ``read_notation`` gives them back."""
    write_lines(notation_lines(measures), "doc", ["block", "line", "part", "measure_no", "text"], path)


def read_notation(spark: SparkSession, path: str) -> DataFrame:
    """The measures of files that ``write_notation`` wrote."""
    return read_output(read_documents(spark, path))
