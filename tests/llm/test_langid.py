import zlib

import numpy as np

from conftest import SF
from glyphline.llm import langid as L


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = L.Network.fresh(["a", "b", "c"], 4, rng)
    for group in (net.inputs, net.recurrent, net.outputs):
        group[:] = [x.astype(np.float64) for x in group]
    net.bias = net.bias.astype(np.float64)
    seq = rng.integers(97, 103, (6, 5)).astype(np.uint8)
    goal = rng.integers(0, 3, 6)
    _, grads = net.gradients(seq, goal)
    for p, g in zip(net.parameters(), grads):
        where = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[where]
        p[where] = old + 1e-2
        up = net.gradients(seq, goal)[0]
        p[where] = old - 1e-2
        down = net.gradients(seq, goal)[0]
        p[where] = old
        assert abs((up - down) / 2e-2 - g[where]) < 2e-3 * max(1, abs(g[where]) * 10)


def test_every_position_is_labelled_and_pooled(spark):
    """The pooled score is that of labelling each word by itself."""
    net = L.train([("x", b"aab"), ("x", b"aba"), ("y", b"ccd"), ("y", b"dcd"), ("y", b"long" * 20)], hidden=4, steps=60)
    text = "aab ccd\n" + "c" * 60 + " aab"
    want, n = np.zeros(2), 0
    for _, seq in L.by_length([w.encode() for w in text.split()]).values():
        p = net.label(seq)
        want += p.sum(axis=(0, 1))
        n += seq.size
    p = np.exp(want / n - (want / n).max())
    df = spark.createDataFrame([(1, text), (2, None), (3, "12 34 !"), (4, ""), (5, text * 500)], "doc_id long, text string").selectExpr("*", "9 as score")
    got = {r.doc_id: r for r in L.predict(df, net).collect()}
    assert abs(got[1].score - (p / p.sum()).max()) < 1e-4 and got[1].lang_pred == net.languages[p.argmax()]
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (2, 3, 4))
    assert got[5].lang_pred == got[1].lang_pred
    assert {r.lang_pred for r in L.predict(df, None).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = L.identify(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.lang_pred in {*truth.values(), "und"}
    out = [r for r in got if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in out) >= 0.95 * len(out)
    again = L.identify(docs.repartition(3)).collect()
    assert {(r.doc_id, r.lang_pred) for r in again} == {(r.doc_id, r.lang_pred) for r in got}


def test_never_learns_from_held_out_rows(spark):
    rows = [(i, f"word{i} text", "aa" if i % 2 else "bb") for i in range(40)] + [(None, "nul id", "aa"), (7, "no lang", None), (8, None, "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    words = {w for _, w in L.sample(df)}
    for i in range(40):
        assert (f"word{i}".encode() in words) == (zlib.crc32(str(i).encode()) % 4 != 2)
    assert b"no" not in words and b"nul" in words


def test_empty_table(spark):
    assert L.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
