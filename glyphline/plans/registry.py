"""The registry of queries and of the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# detections as the check queries see them: group k, position x in hours, value y
EV = """ev AS (SELECT event_id AS id, user_id AS k, epoch_us(ts) / 3.6e9 AS x, value AS y,
 event_type AS typ FROM events)"""
# order lines as events of a measure: the order of lines is total
LI = """li AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey
 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS pos, * FROM lineitem)"""
# text lines of the documents
LN = """ln AS (SELECT doc_id AS d, i - 1 AS n, parts[i] AS line FROM (
 SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"""


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the statement its result must equal."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def hours(col: str):
    return F.unix_micros(F.col(col).cast("timestamp")) / F.lit(3.6e9)


def ev(spark: SparkSession, sf: str, *types: str) -> DataFrame:
    t = table(spark, sf, "events")
    if types:
        t = t.filter(F.col("event_type").isin(*types))
    return t.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("k"),
        hours("ts").alias("x"),
        F.col("value").alias("y"),
        F.col("event_type").alias("typ"),
    )


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """(d, n, line): the lines of every document, numbered from 0."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("d"), "text")
    return d.select("d", F.posexplode(F.split("text", "\n")).alias("n", "line"))
