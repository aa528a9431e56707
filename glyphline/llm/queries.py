"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat_format, collocations, langid, mixing, pii, quality, substring_dedup, url_filter, zone_clusters
from .common import hex_sha256, table
from .decontaminate import contamination, digest_of_items
from .sentence_pieces import round_trip
from .simhash import near_duplicates
from .token_counts import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op1_simhash")
def op1(spark, sf):
    return near_duplicates(table(spark, sf, "documents"))


@query("op8_token_counts")
def op8(spark, sf):
    import public_tokenizers

    return token_counts(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_decontaminate")
def op10(spark, sf):
    found = contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest_of_items().alias("items_sha256"), "contaminated")


@query("op9_mixing", mixing.SQL)
def op9(spark, sf):
    mixed = mixing.mix(table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op5_pii")
def op5(spark, sf):
    return pii.report(table(spark, sf, "documents"))


@query("op3_quality", quality.SQL)
def op3(spark, sf):
    return quality.quality(table(spark, sf, "documents"))


@query("op7_substring_dedup", substring_dedup.SQL)
def op7(spark, sf):
    found = substring_dedup.remove_repeats(table(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_removed", hex_sha256(F.col("kept_text")).alias("kept_sha256"))


@query("op4_langid")
def op4(spark, sf):
    return langid.identify(table(spark, sf, "documents"))


@query("op6_chat_format", chat_format.SQL)
def op6(spark, sf):
    turns = chat_format.with_probe(table(spark, sf, "conversations"))
    return chat_format.digests(chat_format.format_chats(turns))


@query("op2_url_filter")
def op2(spark, sf):
    return url_filter.judge(table(spark, sf, "pages"))


@query("op11_zone_clusters", zone_clusters.SQL)
def op11(spark, sf):
    found = zone_clusters.cluster_vectors(table(spark, sf, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", zone_clusters.centroid_digest().alias("centroid_sha256"))


@query("op12_collocations", collocations.SQL)
def op12(spark, sf):
    found = collocations.best(collocations.collocations(table(spark, sf, "documents")))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@query("op13_sentence_pieces")
def op13(spark, sf):
    import public_tokenizers

    return round_trip(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
