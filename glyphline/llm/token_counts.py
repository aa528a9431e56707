"""Token counts through a cache keyed by content digest and tokenizer version."""

from __future__ import annotations

import hashlib
import json
import os

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from ..session import checkpoint, ship_package
from .common import shared_path, text_of

# fixed value: how byte-level tokenizers of this family cut text before merging
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_counters: dict[str, object] = {}


def version_of(data: bytes) -> str:
    """Digest of a tokenizer file: its version in the cache."""
    return hashlib.sha256(data).hexdigest()


def _byte_names() -> dict[str, int]:
    """The characters that stand for the 256 bytes in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, the other bytes in turn for the characters from 256 on.
    """
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _as_ranks(spec: dict) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """(ranks, special tokens) if merging by rank gives what the merge list gives, else None.

    That is so if the text is only cut by the pattern above and the i-th merge makes the i-th
    token after the bytes: the order of merges is then the order of their tokens' ids.
    """
    model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    odd = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    if (
        spec.get("normalizer")
        or model.get("type") != "BPE"
        or any(model.get(k) for k in odd)
        or pre.get("type") != "ByteLevel"
        or not pre.get("use_regex", True)
        or pre.get("add_prefix_space")
        or any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added)
    ):
        return None
    vocab, special = model["vocab"], {t["content"]: t["id"] for t in added}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [vocab.get(a + b, -1) for a, b in merges]
    names = _byte_names()
    if any(n not in vocab for n in names) or ids != sorted(set(ids)) or not ids or ids[0] < 0:
        return None
    ranks = {bytes(names[c] for c in t): i for t, i in vocab.items() if t not in special}
    if len(ranks) != len(names) + len(ids) or max(vocab[n] for n in names) >= ids[0]:
        return None
    return ranks, special


def _counter(name: str, data: bytes):
    """A function from texts to token counts, for a ``.json`` or a ``.model`` file."""
    if name.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(data.decode("utf-8"))
    model.no_truncation()
    model.no_padding()
    plain = lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    ranked = _as_ranks(json.loads(data))
    if ranked is None:
        return plain
    import tiktoken

    fast = tiktoken.Encoding("by-rank", pat_str=_PATTERN, mergeable_ranks=ranked[0], special_tokens=ranked[1])

    def count(texts: list[str]) -> list[int]:
        try:
            return [len(fast.encode(t, allowed_special="all")) for t in texts]
        except ValueError:  # its pattern engine gives up on some very long runs
            return plain(texts)

    return count


def _encode(name: str, version: str, file):
    def run(batches):
        if version not in _counters:
            _counters[version] = _counter(name, file.value)
        count = _counters[version]
        for b in batches:
            digest, text = b.column(0), b.column(1)
            for a in range(0, len(text), 64):
                part = text.slice(a, 64).to_pylist()
                yield pa.RecordBatch.from_arrays([digest.slice(a, 64), pa.array(count(part), pa.int64())], ["digest", "n_tokens"])

    return run


def _stored(spark, path: str, version: str) -> DataFrame:
    schema = "digest binary, n_tokens bigint, version string"
    try:
        kept = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        kept = spark.createDataFrame([], schema)
    return kept.filter(F.col("version") == version).select("digest", "n_tokens")


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, id: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    Method: the SHA-256 of the normalised content (UTF-8, null as empty) and the digest of the
    tokenizer file are the key of a cache table in folder ``cache``, partitioned by version.
    One row stands for each digest that is not stored yet; only those texts are shuffled and
    encoded, and their counts appended. Then all digests are joined to the stored counts. Without a
    ``cache`` the table is a new one in the checkpoint folder.

    Tokens are counted without special tokens added, truncation or padding; the strings of
    special tokens inside a text count as the library's default has it. A ``.json`` file whose
    merge order is its id order is encoded by rank, which gives the same tokens at three
    times the speed; every other file goes to its own library.

    Null text: 0 bytes, 0 tokens. Null or repeated ids: every row is counted for itself. An empty
    table gives an empty result. Further columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    with open(tokenizer, "rb") as f:
        data = f.read()
    version = version_of(data)
    if cache is None:
        cache = shared_path(spark, "token-counts")
    rows = docs.select(F.col(id).alias("id"), text_of(text).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    keys = checkpoint(rows.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")))
    known = _stored(spark, cache, version)
    first = keys.groupBy("digest").agg(F.min("id").alias("id"))
    missing = checkpoint(first.join(known, "digest", "left_anti")).select(F.col("digest").alias("d"), F.col("id").alias("i"))
    todo = rows.join(missing, (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("i")), "left_semi")
    counts = todo.select("digest", "text").mapInArrow(_encode(tokenizer, version, spark.sparkContext.broadcast(data)), "digest binary, n_tokens bigint")
    fresh = counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")).withColumn("version", F.lit(version))
    fresh.write.mode("append").partitionBy("version").parquet(cache)
    # writers that met may have stored a digest twice
    stored = checkpoint(_stored(spark, cache, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
    return keys.join(stored, "digest").select(
        F.col("id").alias(id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
