"""Typed detection tables and page listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_PAGE = "score_id string, page int"
_STEM = "stem struct<stem_x:int,stem_dir:string,stem_tip_y:int,stem_length:double>"
_MEMBER = (
    "struct<pitch:string,x:int,y_center:int,w:int,individual_duration:double,stem_dir:string,"
    "beam_count:int,has_flag:boolean,score:double,has_dot:boolean>"
)
SCHEMAS = {
    "pages_meta": f"{_PAGE}, img_w int, img_h int, dy double, layout string, status string, err string",
    "systems": f"{_PAGE}, system int, y array<int>",
    "noteheads": f"note_id long, {_PAGE}, x int, y int, w int, h int, y_center int, score double, clef string, "
                 f"pair_idx int, {_STEM}, beam_count int, has_flag boolean, has_dot boolean",
    "rests": f"rest_id long, {_PAGE}, system int, x int, y_center int, duration double, score double, type string",
    "accidentals": f"acc_id long, {_PAGE}, system int, x int, y int, w int, h int, type string, score double",
    "barlines": f"{_PAGE}, system int, x int, score double",
    "tuplet_markers": f"{_PAGE}, pair_idx int, clef string, x int, y int, n int, score double",
    "timesigs": f"{_PAGE}, system int, x double, num int, den int, score double, source string, match_x int, match_w int",
    "anchors": f"{_PAGE}, system int, x double, bpm double",
    "keysigs": f"{_PAGE}, type string, count int, notes array<int>",
    "zones": f"{_PAGE}, x1 int, y1 int, x2 int, y2 int, score double, name string",
    "events_m": f"{_PAGE}, system int, measure_idx int, event_idx int, type string, x double, duration double, "
                f"duration_source string, count int, notes array<{_MEMBER}>",
    "measures_text": "doc string, clef string, line int, measure_no int, text string",
    "ink_runs": f"{_PAGE}, layer string, y int, x0 int, x1 int",
}


def read_detections(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A detection table with its declared schema; no inference pass over the files."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def page_number(path: Column, pattern: str = r"(\d+)\.[A-Za-z]+$") -> Column:
    """Page number in a file name, null when there is none."""
    return F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")).cast("int")


def list_pages(spark: SparkSession, glob: str) -> DataFrame:
    """Numbered page files. Only the path is read: file contents are pruned away."""
    files = spark.read.format("binaryFile").load(glob).select("path")
    return files.withColumn("page", page_number(F.col("path"))).filter(F.col("page").isNotNull())


def quarantine(df: DataFrame, failed: Column, err: str, keep: int = 500) -> tuple[DataFrame, DataFrame]:
    """(good rows, failed rows with the last ``keep`` characters of their error)."""
    bad = F.coalesce(failed, F.lit(False))
    return df.filter(~bad), df.filter(bad).withColumn(err, F.right(F.col(err), F.lit(keep)))
