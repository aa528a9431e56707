import random
import re
from collections import Counter

import pytest

from glyphline.llm import collocations as C


def plain(rows, min_count, longest, share):
    """Every phrase counted, every cut and every longer candidate tried."""
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= min_count}
    out = []
    for (lang, w), a in found.items():
        inside = lambda q: any(q[i : i + len(w)] == w for i in range(len(q) - len(w) + 1))
        if any(l == lang and len(q) > len(w) and inside(q) and 100 * b >= share * a for (l, q), b in found.items()):
            continue
        score, k = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(lang, t, "x", 5, 1) for lang, t in rows], "lang string, text string, prefix string, f int, phrase int")


def some_rows(seed, n=120):
    rng = random.Random(seed)
    words = ["New", "york", "CITY", "the", "of", "ﬁn", "É", "x-y", "a\x1cb", "\x85", "漢字", "the", "the"]
    marks = [" "] * 12 + [". ", ",", "\n", "\t", "  ", "\r\n", "\x0b", "?!"]
    text = lambda: "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(0, 60)))
    rows = [(rng.choice(["en", "de", None, "und"]), text()) for _ in range(n)]
    return rows + [("en", None), ("en", ""), (None, None), ("en", "new york city " * 200), ("en", "new york city. " * 30)] + [("en", "same old row")] * 25


@pytest.mark.parametrize("seed,longest", [(1, 3), (2, 3), (3, 4), (4, 2)])
def test_equals_counting_everything(spark, seed, longest):
    rows = some_rows(seed)
    got = C.collocations(frame(spark, rows), longest=longest)
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, 10, longest, 50))


def test_best_ranks_ties_by_count_and_bytes(spark):
    rows = some_rows(5)
    want = {}
    for lang, phrase, a, *rest, score in plain(rows, 10, 3, 50):
        want.setdefault(lang, []).append((-score, -a, phrase.encode()))
    got = C.best(C.collocations(frame(spark, rows)), top=7).orderBy("lang", "rank").collect()
    for lang, own in want.items():
        assert [r.phrase.encode() for r in got if r.lang == lang] == [p for *_, p in sorted(own)[:7]]
        assert [r["rank"] for r in got if r.lang == lang] == list(range(1, min(7, len(own)) + 1))


def test_small_tasks_and_a_full_bitmap_change_nothing(spark, monkeypatch):
    rows = some_rows(6)
    monkeypatch.setattr(C, "HOT_PARTS", 20)
    got = C.collocations(frame(spark, rows).repartition(7), mark_bits=6)
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, 10, 3, 50))


def test_flushes_and_long_stripes():
    rows = [("en", f"start w{i} end".encode()) for i in range(300)] * 2
    whole = Counter()
    for size in (50, 10**6):
        stripes = C._Stripes(1, None)
        found = Counter()
        for lang, text in rows:
            stripes.add(lang, text)
            if stripes.words + sum(stripes.size.values()) // 4 >= size:
                for b in stripes.flush():
                    found.update({w: n for words, ns in zip(b.column(2).to_pylist(), b.column(3).to_pylist()) for w, n in zip(words, ns)})
        for b in stripes.flush():
            found.update({w: n for words, ns in zip(b.column(2).to_pylist(), b.column(3).to_pylist()) for w, n in zip(words, ns)})
        whole = whole or found
        assert found == whole and found["start"] == 600 and found["w7"] == 2


def test_counts_beyond_64_bits_in_products_stay_exact(spark):
    big = 3_000_000_019
    found = spark.createDataFrame([("en", "a", 1, big + 7), ("en", "b", 1, big + 11), ("en", "a b", 2, big)], "lang string, phrase string, size int, f long")
    hot = spark.createDataFrame([("en", "a")], "lang string, phrase string")
    r = C._scored(found, hot, 3).collect()[0]
    assert (r.a, r.l, r.r, r.score) == (big, big + 7, big + 11, 1000000 * big * big // ((big + 7) * (big + 11)))


def test_empty_table(spark):
    assert C.collocations(frame(spark, [])).collect() == []
