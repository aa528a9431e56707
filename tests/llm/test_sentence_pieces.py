import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from glyphline.llm import sentence_pieces as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["foo bar", "  ", "   ", "the ", "ing ", "é", "가", "½", "ｶﾞ", "™", "\r\n", "<x>", "<s>", "</s>", "<0x41>"]
LETTERS = list("abc  the Xyz.,\n\t é ü ﬁ① Ａ　漢字가각🙂▁​\x00\rqq foo %ff") + ODD


def field(number, kind, value):
    def varint(n):
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    body = varint(value) if kind == 0 else varint(len(value)) + value if kind == 2 else value
    return varint(number << 3 | kind) + body


def normaliser(chars=b"", prefix=1, trim=0, escape=1):
    return field(1, 2, b"own") + field(2, 2, chars) + field(3, 0, prefix) + field(4, 0, trim) + field(5, 0, escape)


def variant(own, fixed=(), fallback=True):
    """The model file with another normaliser, further fixed pieces, or without bytes for unknown characters."""
    out = []
    with open(PATH, "rb") as f:
        for number, value in S._fields(f.read()):
            if number == 1 and not fallback:
                value = field(1, 2, dict(S._fields(value))[1]) + field(2, 5, dict(S._fields(value)).get(2, b"\0" * 4)) + field(3, 0, max(1, dict(S._fields(value)).get(3, 1) % 6 or 1))
            if number in (1, 5):
                out.append(field(number, 2, value))
            elif number == 2:
                out.append(field(2, 2, value if fallback else value + field(35, 0, 0)))
    return b"".join([*out, field(3, 2, own), *(field(1, 2, field(1, 2, p.encode()) + field(2, 5, b"\0" * 4) + field(3, 0, S.USER_DEFINED)) for p in fixed)])


def models():
    chars = dict(S._fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec()))[2]
    with open(PATH, "rb") as f:
        yield "as it is", f.read()
    yield "mapped and trimmed", variant(normaliser(chars, 1, 1))
    yield "mapped", variant(normaliser(chars, 1, 0))
    yield "trimmed", variant(normaliser(b"", 1, 1))
    yield "no mark in front", variant(normaliser(b"", 0, 0))
    yield "fixed pieces", variant(normaliser(chars, 1, 1), ["foo bar", "<x>", "a b"])
    yield "fixed pieces, unmapped", variant(normaliser(b"", 1, 0), ["<x>", "qzq"])
    yield "no bytes", variant(normaliser(chars, 1, 0), fallback=False)


def texts(n, seed=1):
    rng = random.Random(seed)
    some = ["", " ", "  ", "▁", "a", " a", "a ", "\x00", "x" * 300, "ab" * 200 + "漢" * 90, " " * 200]
    return some + ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("name,data", list(models()), ids=lambda v: v if isinstance(v, str) else "")
def test_ids_spans_and_decoding_equal_the_library(name, data):
    library, model = sentencepiece.SentencePieceProcessor(model_proto=data), S.Model(data)
    every = texts(400)
    for text, (ids, begins, ends) in zip(every, model.encode_all(every)):
        ids = ids.tolist()
        assert ids == library.encode(text, add_bos=True, add_eos=True), text
        assert model.decode(ids) == library.decode(ids), text
        spans = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        raw = text.encode()
        own = list(zip(begins.tolist(), ends.tolist()))[1:-1]
        if spans != own:  # the library may count characters
            own = [(len(raw[:a].decode()), len(raw[:b].decode())) for a, b in own]
        assert spans == own, text


def test_decoding_any_ids_equals_the_library():
    library, model = sentencepiece.SentencePieceProcessor(model_file=PATH), S.Model(open(PATH, "rb").read())
    rng = random.Random(2)
    for _ in range(5000):
        ids = [rng.choice([rng.randrange(300), rng.randrange(32000), 259 + rng.randrange(5), rng.randrange(4)]) for _ in range(rng.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids), ids


def test_spans_cover_the_text_and_cut_characters_never():
    model = S.Model(open(PATH, "rb").read())
    for text in texts(200, 3):
        _, begins, ends = model.encode(text)
        raw = text.encode()
        assert b"".join(raw[a:b] for a, b in zip(begins, ends)) == raw
        for a, b in zip(begins, ends):
            raw[a:b].decode()


def test_one_by_one_and_all_at_once_merge_alike():
    model = S.Model(open(PATH, "rb").read())
    words = sorted({w for t in texts(500, 4) for w in model._parts(model.normalise(t)[0])})
    codes, many = model._merge_all(words)
    assert [c.tolist() for c in S.np.split(codes, S.np.cumsum(many)[:-1])] == [model._segment_codes(w) for w in words]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, begins int")


def test_tables(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts(60, 5))] + [(3, None), (3, "same"), (3, "same"), (9, "long " * 60_000 + "z" * 5000)]
    got = S.round_trip(frame(spark, rows), PATH).collect()

    def want(text):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        raw = (text or "").encode()
        return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), len(raw)

    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *want(t))) for i, t in rows)
    pieces = S.decode(S.encode(frame(spark, rows), PATH), PATH)
    assert pieces.columns == ["doc_id", "begins", "ends", "decoded", "ids"] or set(pieces.columns) == {"doc_id", "ids", "begins", "ends", "decoded"}
    assert sorted(r.decoded for r in pieces.collect()) == sorted(library.decode(library.encode(t or "")) for _, t in rows)


def test_empty_table(spark):
    assert S.round_trip(frame(spark, []), PATH).collect() == []
    assert S.decode(S.encode(frame(spark, []), PATH), PATH).collect() == []
