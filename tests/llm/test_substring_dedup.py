import random
import re

import numpy as np
import pytest

from glyphline.llm import common, recompression as R, substring_dedup as S


def expected(rows, width):
    """Every window of every document in order of id."""
    docs = sorted({(d, t) for d, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0))
    seen, out = set(), {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            if g in seen:
                gone |= set(range(i, i + width))
            seen.add(g)
        out[d, t] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return sorted((str(d), *out[d, t]) for d, t in rows)


def made(seed, vocab, n):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passages = [text(rng.randint(4, 40)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else text(rng.randint(0, 15)) for _ in range(rng.randint(0, 6))]
        rows.append((i * 7 % 61, rng.choice([" ", "\n", "  \t"]).join(parts)))
    rows += [(1000 + i, rows[i][1]) for i in range(5)] + [(2000, None), (2001, ""), (None, rows[3][1]), (3000, "x " * 50), (3001, "a b " * 40), (3002, "y " + "a b " * 40)]
    return rows + [rows[2], rows[2]]


def got(df, width):
    return sorted((str(r[0]), *r[1:]) for r in map(tuple, S.remove_repeats(df, width=width, chunk_bytes=700).collect()))


@pytest.mark.parametrize("seed,vocab,width", [(1, "ab", 5), (2, "abcdefgh", 6), (3, [f"w{i}" for i in range(200)], 20)])
def test_equals_every_window_tried(spark, seed, vocab, width):
    rows = made(seed, vocab, 60)
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, known string, sub int")
    assert got(df.repartition(5), width) == expected(rows, width)


def test_texts_that_share_an_id(spark):
    """They are documents of their own, in the order of their hash; neither passes for a copy with the other's words."""
    long = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, long), (5, long), (5, "v " + long + " u"), (5, "only this one here stays")], "doc_id long, text string")
    out = sorted((r.doc_id, r.n_words, r.n_removed) for r in S.remove_repeats(df).collect())
    assert out == [(1, 30, 0), (5, 5, 0), (5, 30, 30), (5, 32, 30)]


def test_equal_stretches_have_equal_symbols():
    """Where the words of an extent stand again, the symbol stands again with the same name."""
    rng = np.random.default_rng(0)
    for vocab in (2, 5, 50):
        words = common.mix(rng.integers(0, vocab, 400).astype(np.uint64) + np.uint64(1))
        words[300:360] = words[20:80]
        s = R.parse(words, np.array([0, 200, 400]), 20, thin=1)
        names = {(int(b), int(e)): int(n) for n, b, e in zip(s.name, s.begin, s.end)}
        inner = {k: v for k, v in names.items() if k[0] >= 20 and k[1] <= 80}
        for (b, e), n in inner.items():
            assert names.get((b + 280, e + 280)) == n
        assert inner or vocab == 2


def thue_morse(n):
    return [bin(i).count("1") & 1 for i in range(n)]


def test_words_and_texts_made_to_share_polynomial_hashes(spark):
    """Over any odd base a sequence of this kind and its complement have one hash modulo a power of two."""
    bits = thue_morse(2048)
    word = lambda flip: "".join("ab"[b ^ flip] for b in bits)
    around = " ".join(f"w{i}" for i in range(10)), " ".join(f"v{i}" for i in range(10))
    words = [(1, " ".join((around[0], word(0), around[1]))), (2, " ".join((around[0], word(1), around[1])))]
    text = lambda flip: " ".join(("left", "right")[b ^ flip] for b in bits)
    rows = [*words, (3, text(0)), (4, text(1))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, 20) == expected(rows, 20)


def test_many_rows_without_an_id(spark):
    rng = random.Random(4)
    rows = [(None, " ".join(rng.choice("abcdef") for _ in range(40))) for _ in range(30)]
    rows += [rows[0]] * 20 + [(5, rows[3][1]), (6, "x " + rows[7][1])]
    df = spark.createDataFrame([(*r, "z", 1, 2) for r in rows], "doc_id long, text string, doc string, nth int, place int").repartition(6)
    found = S.remove_repeats(df, width=8, chunk_bytes=300).collect()
    assert len(found) == len(rows)
    kept = {}
    for r in found:
        kept.setdefault(r.doc_id, set()).add(r.kept_text)
    assert len(kept[None]) <= 30
    seen = {tuple(t.split()[i : i + 8]) for t in (t for d, t in rows if d is None) for i in range(33)}
    for d, t in rows[-2:]:
        w = t.split()
        gone = {i + k for i in range(len(w) - 7) if tuple(w[i : i + 8]) in seen for k in range(8)}
        assert kept[d] == {" ".join(x for i, x in enumerate(w) if i not in gone)}


def test_a_very_long_text(spark):
    rng = random.Random(5)
    w = [f"w{rng.randrange(10**9)}" for _ in range(60_000)]
    rows = [(1, " ".join(w)), (2, " ".join(["q", *w[100:40_000], "z"])), (3, "x" * 1_000_000)]
    out = {r.doc_id: (r.n_words, r.n_removed) for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: (60_000, 0), 2: (39_902, 39_900), 3: (1, 0)}


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
