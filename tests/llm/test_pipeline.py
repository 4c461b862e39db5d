from __future__ import annotations

import pytest

import corpus_pipeline
from panelspark.llm import decontaminate, line_dedup, ngram_join, packing
from panelspark.llm.oracle import ORACLES
from panelspark.llm.queries import QUERIES, tokenizer_path
from samples import mean_rows
from oracle_check import connection, differences

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, docs_of):
    rows = mean_rows()
    docs = docs_of(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").distinct().collect()}


def test_pipeline_is_its_operators_one_after_another(spark):
    got = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in QUERIES["op3_quality_rules"](spark, SF).collect() if r.kept}
    docs = docs.where(docs.doc_id.isin(list(kept)))
    docs = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    classes = ngram_join.class_digest(docs).collect()
    docs = docs.where(docs.doc_id.isin([r.doc_id for r in classes if r.doc_id == r.class_id]))
    bad = [r.doc_id for r in decontaminate.contamination_digest(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect() if r.contaminated]
    docs = docs.where(~docs.doc_id.isin(bad))
    want = packing.packed_pieces(docs, tokenizer_path())
    same = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(same).collect())) == sorted(map(tuple, want.select(same).collect()))
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_sql(spark, name):
    assert differences(QUERIES[name](spark, SF).toPandas(), connection(SF).execute(ORACLES[name]).fetchdf()) == ""


def test_one_row_stays_of_rows_that_repeat(docs_of):
    """Copies with a null id, rows loaded twice, and copies under ids of their own: one of each group."""
    from samples import prose

    a, b, c = prose(21, 120), prose(22, 90), prose(23, 80)
    rows = [(None, a)] * 80 + [(7, b)] * 5 + [(i, c) for i in range(20, 30)] + [(40, None)] * 3 + [(41, "")] * 2
    docs = docs_of(rows, 6)
    left = ngram_join.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in left.collect() if r.doc_id is not None) == [(7, b), (20, c), (40, None), (41, "")]
    assert left.where("doc_id is null").count() == 1


def test_packing_deals_rows_that_repeat(docs_of, monkeypatch):
    """Copies of one row go to many shards, and all are packed."""
    rows = [(1, "same words " * 20)] * 300
    got = packing.packed_pieces(docs_of(rows, 4), tokenizer_path(), 256, 40)
    assert got.count() == 300
    shards = {r.sequence_id >> 33: r["count"] for r in got.groupBy("sequence_id").count().collect()}
    assert len(shards) >= 6  # of eight
