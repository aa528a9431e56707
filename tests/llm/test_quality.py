import random
import re
import time

from glyphline.llm import quality as Q

WORD = r"[^\x20\x09-\x0D]+"


def expected(text):
    t = text or ""
    w = re.findall(WORD, t)
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    rep = {i + k for i, g in enumerate(wins) if wins.count(g) > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), failed


def test_base_counts(spark):
    rng = random.Random(1)
    parts = ["a", "b", "ü", "c#", "|", "\n", " ", "\t", "a b c", " ", "."]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 150))) for _ in range(150)]
    texts += [None, "", "\n\n", "a", "a b c a b c", "x " * 300, "same line\n" * 40, " ".join(f"w{i}" for i in range(50))]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, kept int")
    for r in Q.quality(df).collect():
        assert tuple(r)[1:7] == expected(texts[r.doc_id]), texts[r.doc_id]


def test_line_rules(spark):
    good = "This is a plain sentence of some length that nobody would remove from a page."
    lines = {good: True, "Home | About | Contact | Login": False, "All rights reserved.": False, "Only three words": False, "Short, but ends.": True,
             "Wild*** words$$$ here&&& and%%% there###": False, "SHOUT!! ALL!! DAY!!": False, "": True, "a longer line without any stop at its end": True}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.clean_text for r in Q.clean_lines(df).collect()}
    for i, (t, ok) in enumerate(lines.items()):
        assert got[i] == (t if ok else ""), t
    prose = "\n".join(good.replace("plain", f"plain{i} {i * 7} q{i}").replace("nobody", f"no{i}body").replace("some", f"so{i}") for i in range(8))
    mixed = prose + "\nAll rights reserved."
    docs = spark.createDataFrame([(1, mixed), (2, "\n".join(f"Wild{i}*** words{i}$$$ here{i}&&&" for i in range(30)))], "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in Q.quality(docs).collect()}
    assert kept == {1: True, 2: False}
    clean = {r.doc_id: r.clean_text for r in Q.clean_lines(docs).collect()}
    assert clean == {1: prose, 2: ""}


def test_lines_of_one_long_word(spark):
    """A word is never split, so such lines take time in proportion to their length."""
    runs = ["字" * 200_000, "http://example.org/" + "a/" * 100_000, "x" * 1_000_000, " " * 300_000, "a " * 200_000, "|" * 200_000, "#" * 100_000]
    texts = [f"{w} one two three four five" for w in runs] + [f"{w}. One" for w in runs] + [w * 2 for w in runs]
    begun = time.time()
    got = Q.quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == len(texts) and time.time() - begun < 60
    for r in got[: len(runs)]:
        assert r.n_words == len(texts[r.doc_id].split())


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c"), (None, "a b c"), (1, None), (1, ""), (1, "x " * 60)]
    got = Q.quality(spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, lost int, id string")).collect()
    assert sorted((r.doc_id is None, r.n_words) for r in got) == [(False, 0), (False, 0), (False, 60), (True, 3), (True, 3)]


def test_empty_table(spark):
    assert Q.quality(spark.createDataFrame([], "doc_id long, text string")).collect() == []
