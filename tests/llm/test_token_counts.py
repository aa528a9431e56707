import public_tokenizers
import pytest
from tokenizers import Tokenizer

from glyphline.llm import token_counts as C

TEXTS = [
    "", None, "  a  b ", "<|endoftext|> x<|endoftext|>y  <|endoftext|>", "a\n b 　c d\x1f e\x1c\x1d f", "é ü  ''s 's don't I'LL  \t x", "a 1 .,! 2\xa0b  c \u0085",
    "\x00 \x7f ﻿ ² ½ ٣ हिन्दी 한국어 \U0001f600\U0001f44d\U0001f3fd", " " * 3000 + "x" * 3000, "\n\n\n a\r\n\r\n b", "word " * 700, "Ein Satz.", "Ein Satz.",
]


def rows(spark, texts):
    return spark.createDataFrame([(i if i % 5 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, digest string")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_equals_the_library(spark, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        model = Tokenizer.from_file(path)
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    got = sorted(map(str, map(tuple, C.token_counts(rows(spark, TEXTS), path).collect())))
    want = [(i if i % 5 else None, len((t or "").encode()), count(t or ""), count(t or "") > 512) for i, t in enumerate(TEXTS)]
    assert got == sorted(map(str, want))


def test_documents_of_the_table(spark):
    """Rank by rank as in the library, on every document."""
    from conftest import SF

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in C.token_counts(docs, path).collect()}
    assert got == {r.doc_id: len(model.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}


def test_cache_takes_only_what_is_new(spark, tmp_path):
    cache, path = str(tmp_path / "cache"), public_tokenizers.path("byte_bpe_50k.json")
    stored = lambda: spark.read.parquet(cache).count()
    first = sorted(map(str, C.token_counts(rows(spark, TEXTS), path, cache).collect()))
    distinct = len({t or "" for t in TEXTS})
    assert stored() == distinct
    assert sorted(map(str, C.token_counts(rows(spark, TEXTS), path, cache).collect())) == first and stored() == distinct
    C.token_counts(rows(spark, [*TEXTS, "something new"]), path, cache).collect()
    assert stored() == distinct + 1
    # a stored count is used as it is; another tokenizer has keys of its own
    C.token_counts(rows(spark, TEXTS[:4]), public_tokenizers.path("word_bpe_49k.json"), cache).collect()
    assert stored() == distinct + 1 + 3
    assert C.token_counts(rows(spark, TEXTS).limit(0), path, cache).collect() == []
