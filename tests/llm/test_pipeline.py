"""The stages against brute force, each on its own input, and the whole run."""

import os
import sys

sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline as P  # noqa: E402
import test_decontaminate as D  # noqa: E402
import test_mixing as M  # noqa: E402
import test_pii as I  # noqa: E402
import test_simhash as H  # noqa: E402
from conftest import SF  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def test_stages_hold_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(9001, None, "en", "s", 0), (9002, "12 34", "en", None, 5), (9003, "", None, "s", 0), (9004, "Le mot de la fin est un mot.", None, None, 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).cache()
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    names = [n for n, _ in P.STAGES]
    assert names == ["language_id", "near_dedup", "decontaminate", "pii", "mixing"]

    kept = P.identify_language(spark, docs, SF).cache()
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()}
    assert {9001, 9002, 9003} <= gone and len(gone) <= 4

    rows = sorted((r.doc_id, r.text) for r in kept.collect())
    want = {rows[i][0] for i in set(H.roots([H.print_of(t) for _, t in rows]))}
    once = P.near_dedup(spark, kept, SF).cache()
    assert once.columns == docs.columns and {r.doc_id for r in once.collect()} == want and once.count() == len(want)

    clean = P.decontaminated(spark, once, SF).cache()
    found = D.expected([(r.doc_id, r.text) for r in once.collect()], bench)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in found if not r[-1])

    safe = P.redacted(spark, clean, SF).cache()
    assert safe.columns == docs.columns and safe.count() == clean.count()
    before = {r.doc_id: r for r in clean.collect()}
    for r in safe.collect():
        assert r.n_chars == len(r.text) and I.expected(r.text)[1] == ""
        assert r.text == before[r.doc_id].text or "[" in r.text
        if not I.expected(before[r.doc_id].text)[1] and "token" not in before[r.doc_id].text:
            assert r.text == before[r.doc_id].text

    mixed = P.mixed(spark, safe, SF).collect()
    sizes = {}
    for r in safe.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    goal = M.filled(sizes, (3.0, 1.0, 2.0), 1.5, 2)
    assert {r.doc_id for r in mixed} == set(before) and all(r.text is not None for r in mixed)
    for s in sizes:
        assert abs(sum(r.taken for r in mixed if r.source == s) - goal[s]) <= 0.5


def test_columns_named_like_the_operators_own(spark):
    """Further columns of any of these names reach the end of each stage as they came, or make way for a result of that name."""
    names = ["key", "kept_key", "turn", "fp", "low", "root", "node", "id", "least", "component_id", "c0", "c1", "hit_ranges", "hit_items", "place", "h", "m", "n", "digest", "tally"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(f"own {i}"))
    docs = docs.cache()
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        own = [n for n in names if n in out.columns]
        assert own == names, (name, set(names) - set(own))
        for r in out.select(*names).distinct().collect():
            assert list(r) == [f"own {i}" for i in range(len(names))], name


def test_run_reads_the_given_tables(spark):
    got = P.run(spark, SF)
    assert {"doc_id", "source", "text", "lang", "taken", "position"} <= set(got.columns)
    assert 0 < got.count() < 200
