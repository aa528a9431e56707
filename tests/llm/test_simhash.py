import random
import re

import pytest
import xxhash

from glyphline.llm import simhash as S


def print_of(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), seed=42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(prints, most=4):
    """Smallest index reachable over pairs at ``most`` or fewer differing bits."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def made(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        w = [rng.choice(vocab) for _ in range(rng.choice([3, 30, 200]))]
        for _ in range(rng.randint(1, 5)):
            texts.append(" ".join(w) if rng.random() < 0.5 else "\n".join(w).title())
            w[rng.randrange(len(w))] = rng.choice(vocab)
    return texts + ["", "", None, " \t\n", "ONE", "one", "ü Ü É", "a " * 5000]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    texts = made(seed)
    ids = random.Random(seed).sample(range(10_000), len(texts))
    ids.sort()
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, fp string")
    got = {r.doc_id: r for r in S.near_duplicates(df.repartition(5)).collect()}
    prints = [print_of(t) for t in texts]
    want = roots(prints)
    for k, i in enumerate(ids):
        assert got[i].fingerprint == f"{prints[k]:016x}"
        assert got[i].component_id == ids[want[k]]
    kept = S.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(ids[k] for k in set(want))


@pytest.mark.parametrize("tile", [S.TILE, 16])
def test_dense_fingerprints(spark, tile):
    """Many fingerprints in one bucket, a chain of links, and pairs at exactly four and five bits."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints = {base ^ (1 << rng.randrange(30)) ^ (1 << rng.randrange(30)) for _ in range(120)}
    chain = rng.getrandbits(64)
    for k in range(0, 60, 3):
        chain ^= 0b1111 << k
        prints.add(chain)
    far = rng.getrandbits(64)
    prints |= {far, far ^ 0x8000000000001101, 0, 0b11111, 1 << 63}
    prints |= {rng.getrandbits(64) for _ in range(300)}
    order = sorted(prints)
    df = spark.createDataFrame([(S._signed(p),) for p in order], "fp long")
    pairs = S.links(df, tile=tile)
    assert pairs.count() < 20 * len(order)
    tree = {r.node: r.root for r in S.components(pairs).collect()}
    groups = {}
    for p in order:
        groups.setdefault(tree.get(S._signed(p), S._signed(p)), set()).add(p)
    want = {}
    for p, r in zip(order, roots(order)):
        want.setdefault(r, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_no_task_gathers_a_bucket_above_the_tile(spark, monkeypatch):
    """Small and large buckets; what meets by bucket key is a tile at most, and no link is lost."""
    met, spread = [], S._spread

    def counting(keys, solve, schema):
        met.append((keys.columns[0], keys.groupBy(keys.columns[0]).count().agg({"count": "max"}).first()[0]))
        return spread(keys, solve, schema)

    monkeypatch.setattr(S, "_spread", counting)
    fps = [(v << 20,) for v in range(200)] + [((0x5A5A << 40) + (1 << k),) for k in range(10)]
    got = S.components(S.links(spark.createDataFrame(fps, "fp long"), tile=16)).collect()
    assert [most for name, most in met if name == "key"] and all(most <= 16 for name, most in met if name == "key")
    assert {r.node for r in got} == {f for (f,) in fps} and len({r.root for r in got}) == 2


def test_long_path_is_one_component(spark):
    df = spark.createDataFrame([(i * 7 % 1000, (i + 1) * 7 % 1000) for i in range(400)] + [(5000, 5001), (9, 9)], "a long, b long")
    got = {r.node: r.root for r in S.components(df).collect()}
    nodes = {i * 7 % 1000 for i in range(401)}
    assert {got[n] for n in nodes} == {min(nodes)} and got[5001] == got[5000] == 5000


def test_null_ids_and_empty_table(spark):
    rows = [(None, "alpha beta gamma delta one"), (None, "quite another text stands here now"), (4, "a b c d e f"), (4, "a b c d e f"), (4, "some other words with that id too")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(S.near_duplicates(df).collect()) == 5
    kept = sorted((str(r.doc_id), r.text) for r in S.drop_near_duplicates(df).collect())
    assert kept == sorted({(str(a), b) for a, b in rows})
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(none).collect() == [] and S.drop_near_duplicates(none).collect() == []
