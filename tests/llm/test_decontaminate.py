import hashlib
import random
import re

import pytest

from glyphline.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def expected(docs, bench, width=13):
    """Every window of every item against every place of every document."""
    wins = {}
    for i, t in bench:
        w = WORD.findall(low(t))
        if w:
            k = min(width, len(w))
            for a in range(len(w) - k + 1):
                wins.setdefault(tuple(w[a : a + k]), set()).add("null" if i is None else str(i))
    sizes = {len(k) for k in wins}
    out = []
    for d, t in docs:
        w = WORD.findall(low(t))
        hit, items = set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                found = wins.get(tuple(w[a : a + k]))
                if found:
                    hit |= set(range(a, a + k))
                    items |= found
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(items), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    vocab = ["a", "B", "ü", "x1", "the", "42", "é", "Zz"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", "\n", ", ", "--"]) for _ in range(n))
    bench = [(i, text(rng.choice([0, 1, 2, 5, 13, 20, 40]))) for i in range(12)] + [(3, text(15)), (None, text(14)), (99, None)]
    docs = [(i, text(rng.randint(0, 300))) for i in range(30)] + [(31, None), (32, ""), (32, "A " * 3000), (None, bench[5][1])]
    for i in range(10):
        docs.append((40 + i, text(50) + bench[i][1].upper() + text(60)))
    return docs, bench


def rows(df):
    got = df.select("doc_id", "n_words", "n_hit", "n_items", D.digest_of_items().alias("s"), "contaminated")
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("block", [1_000_000, 60])
def test_equals_every_window_tried(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_WINDOWS", block)
    docs, bench = made(5)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_hit", "2 as hit_items")
    b = spark.createDataFrame(bench, "item_id long, text string")
    assert rows(D.contamination(d, b)) == expected(docs, bench)
    bad = {r[0] for r in expected(docs, bench) if r[-1]}
    kept = D.remove_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in expected(docs, bench) if not r[-1])
    assert bad


def test_one_block_is_held_at_a_time(spark, monkeypatch):
    """A long item is spread over blocks too, and each block's broadcast is given up before the next."""
    monkeypatch.setattr(D, "BLOCK_WINDOWS", 400)
    rng = random.Random(9)
    item = " ".join(f"w{rng.randrange(10**6)}" for _ in range(1000))
    held, sizes = [], []
    real = spark.sparkContext.broadcast

    def broadcast(value):
        made = real(value)
        if isinstance(value, D.Index):
            assert not held, "a block is held while the next is made"
            held.append(made)
            sizes.append(sum(len(keys) for keys, _, _ in value.widths.values()))
            destroy = made.destroy
            made.destroy = lambda *a: (held.remove(made), destroy(*a))
        return made

    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    words = item.split()
    docs = [(1, "start " + " ".join(words[100:160])), (2, "start " + " ".join(words[500:512])), (3, item), (4, "nothing")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (1, item), (2, "nothing else")], "item_id long, text string")
    assert rows(D.contamination(d, b)) == expected(docs, [(1, item), (1, item), (2, "nothing else")])
    assert len(sizes) >= 5 and max(sizes) <= 400 and sum(sizes) == 989


def test_spans_are_cut(spark):
    passage = "One two three four five six seven eight nine ten eleven twelve thirteen"
    d = spark.createDataFrame([(1, f"Before, {passage.upper()}! After."), (2, "Nothing here."), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([(7, passage)], "item_id long, text string")
    got = {r.doc_id: r.text for r in D.remove_spans(d, b).collect()}
    assert got == {1: "Before, ! After.", 2: "Nothing here.", 3: None}


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert rows(D.contamination(d, b)) == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert rows(D.contamination(one, b))[0][:4] == (1, 2, 0, 0)
