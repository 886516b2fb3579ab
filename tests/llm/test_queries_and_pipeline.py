"""The registered queries on the smallest tables, and the pipeline against plain counterparts of its stages."""

import os

import pytest
from brute import near_components, window_repeats
from check_oracles import compare, connect

import __spark_entry__ as entry
import corpus_pipeline
from shelfdate.llm.common import keep, table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.mark.parametrize("name", ["op2_window_repeats", "op3_pruned_graph", "op6_snapshot_collapse", "op8_minhash_components",
                                  "op12_accumulator_search", "op13_prefix_trie"])
def test_query_matches_sql(spark, name):
    message, same = compare(spark, connect(FOLDER), FOLDER, name)
    assert same, message


def test_every_operator_has_its_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n[2:3].isdigit()) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_pipeline_stage_by_stage(spark):
    docs = table(spark, FOLDER, "documents")
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, FOLDER))
        results[name] = docs
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(results[n].columns == columns for n, _ in corpus_pipeline.STAGES[:-1])
    known = [(r.doc_id, r.text) for r in results["language_id"].collect()]
    near = near_components(known, percent=80)
    kept = [(r.doc_id, r.text) for r in results["near_dedup"].collect()]
    assert sorted(i for i, _ in kept) == sorted(i for i, c in near.items() if i == c)
    repeats = window_repeats(kept)
    cut = {r.doc_id: r for r in results["substring_dedup"].collect()}
    assert len(cut) == len(kept)
    for i, t in kept:
        assert len(cut[i].text.encode().split()) == repeats[i, t][0] - repeats[i, t][1]
        assert cut[i].text == t or repeats[i, t][1]
        assert cut[i].n_chars == len(cut[i].text)
    mixed = results["mixing"].groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in mixed} <= set(cut) and max(r["count"] for r in mixed) <= 2
    pieces = results["packing"].collect()
    assert {p.doc_id for p in pieces} == {r["doc_id"] for r in mixed}
    assert sum(p.length for p in pieces if p.start == 0) > 0
