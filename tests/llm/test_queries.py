import os

import pytest
from compare import connect, differences

import __spark_entry__ as entry
import corpus_pipeline
from fourthtick.llm import decontamination, jaccard, language, packing
from fourthtick.llm.oracles import ORACLES
from fourthtick.llm.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_all_operators_are_registered():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert {*QUERIES, "pipeline"} <= entry.queries().keys()
    assert ORACLES.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", ORACLES)
def test_query_matches_oracle(spark, name):
    assert differences(spark, connect(SF_DIR), name, SF_DIR) == []


def test_pipeline_stage_by_stage(spark):
    """Each stage against the plain reading of its predecessor's rows."""
    from test_decontamination import brute as contaminated
    from test_jaccard import brute as components

    before = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = before.columns
    results = {}
    rows = before
    for name, function in corpus_pipeline.STAGES:
        rows = corpus_pipeline.stage(function(spark, rows, SF_DIR), f"test-{name}")
        results[name] = rows
    texts = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]

    told = results["language_id"]
    assert told.columns == columns
    assert sorted(texts(told)) == sorted(
        (i, t) for i, t in texts(before) if t and any(c.isalpha() for c in t)
    )
    single = results["ngram_jaccard_join"]
    firsts = {d for d, n, c in components(texts(told)) if d == c or not n}
    assert sorted(i for i, _ in texts(single)) == sorted(firsts)
    clean = results["benchmark_decontamination"]
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    hit = {d for d, _, n, _ in contaminated(texts(single), [(r["item_id"], r["text"]) for r in items]) if n}
    assert hit and sorted(i for i, _ in texts(clean)) == sorted(firsts - hit)
    masked = dict(texts(results["secret_scans"]))
    assert results["secret_scans"].columns == columns and masked.keys() == firsts - hit
    assert all(masked[i] == t or "[secret]" in masked[i] for i, t in texts(clean))
    packed = results["best_fit_packing"]
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == masked.keys()


@pytest.mark.parametrize(
    ("module", "name"),
    [(language, "unidentified"), (jaccard, "entries"), (decontamination, "index"), (packing, "pieces")],
)
def test_texts_are_read_in_few_rows_at_once(spark, monkeypatch, module, name):
    setting, seen, stage = "spark.sql.parquet.columnarReaderBatchSize", {}, module.stage

    def recorded(rows, to, *more):
        seen[to] = int(spark.conf.get(setting))
        return stage(rows, to, *more)

    monkeypatch.setattr(module, "stage", recorded)
    before = spark.conf.get(setting)
    step = {language: 0, jaccard: 1, decontamination: 2, packing: 4}[module]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(50)
    corpus_pipeline.STAGES[step][1](spark, docs, SF_DIR)
    assert seen[name] == 256 and spark.conf.get(setting) == before


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.count() == 0 and {"doc_id", "piece", "sequence_id"} <= set(packed.columns)
