"""The corpus pipeline and the queries with SQL twins."""

import brute
import numpy as np
import pytest
from compare import compare, connect

import __spark_entry__ as entry
import corpus_pipeline
from vacanta.llm.batches import table
from vacanta.llm.queries import ORACLES, QUERIES
from vacanta.sources.staging import stage


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), name, QUERIES[name], ORACLES[name], sf_dir) is None


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_stages_on_the_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    quality = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    for name, function in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        out = stage(function(spark, docs, sf_dir), name)
        after = {r.doc_id for r in out.select("doc_id").collect()}
        gone = set(before) - after
        assert after <= set(before)
        if name == "language_id":
            assert all(any(c.isalpha() for c in before[i]) is False for i in gone)
        elif name == "quality":
            assert sum(quality.get(i) == 1 for i in gone) <= 0.02 * len(before)
        elif name == "near_duplicates":
            sets = {i: brute.shingles(t) for i, t in before.items()}
            links = [(a, b) for a in sets for b in sets if a < b and not sets[a].isdisjoint(sets[b]) and brute.jaccard(sets[a], sets[b]) >= 0.8]
            assert after == set(brute.unite(sets, links).values())
        elif name == "decontamination":
            judged = {i: brute.contamination(t, items) for i, t in before.items()}
            assert gone == {i for i, (n, hit, _) in judged.items() if hit and 20 * hit >= n}
        else:
            assert not gone
            for r in out.collect():
                assert len(r.ids) == 4 * r.n_tokens and r.ids_sha256 == brute.sha(bytes(r.ids)) and r.decoded_sha256 == brute.sha(before[r.doc_id])
        if name != "bpe":
            assert out.columns == docs.columns
        docs = out
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == {r.doc_id for r in docs.collect()}


def test_stages_on_awkward_and_empty_tables(spark, sf_dir, awkward, nothing):
    for docs in (awkward, nothing):
        for extra in ("score", "accepted", "component", "_text"):
            docs = docs.selectExpr("*", f"'clash' AS {extra}")
        for name, function in corpus_pipeline.STAGES:
            out = stage(function(spark, docs, sf_dir), name)
            if name != "bpe":
                assert out.columns == docs.columns
            docs = out
        rows = docs.collect()
        assert all(np.frombuffer(r.ids, "<u4").size == r.n_tokens for r in rows)
        assert len(rows) <= len(brute.AWKWARD)
