"""Queries against their SQL, and the pipeline stage by stage against the operators run plainly."""

import pytest
from comparing import assert_same, connected
from conftest import DATA

import corpus_pipeline
from landsight.llm import decontaminate, queries

SF = DATA / "sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    assert_same(queries.queries()[name](spark, str(SF)), connected(SF), queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs_over_all_rows(spark, name):
    got = queries.queries()[name](spark, str(SF))
    table = "pages" if name.startswith("op1_") else "documents"
    n = spark.read.parquet(str(SF / f"{table}.parquet")).count()
    assert got.count() == n or name in ("op2_benchmark_decontamination", "pipeline")


def test_stages(spark):
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    kept = docs
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(SF)).cache()
        assert kept.columns == docs.columns
        seen.append(kept.count())
    assert docs.count() > seen[0] > seen[1] > seen[2] == seen[3] > 0
    assert kept.select("doc_id").distinct().count() == kept.count()
    assert decontaminate.matches(kept, spark.read.parquet(str(SF / "benchmark.parquet"))).count() == 0
    out = corpus_pipeline.run(spark, str(SF))
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert out.where("not lossless").count() == 0


def test_repeated_rows_stay_once(spark):
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    once = corpus_pipeline.keep_first_copies(spark, docs, str(SF))
    twice = corpus_pipeline.keep_first_copies(spark, docs.union(docs), str(SF))
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(r["doc_id"] for r in twice.collect())


def test_odd_documents_pass_every_stage(spark):
    rows = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c", "en", "s", 5), (3, "x " * 50_000, "en", "s", 100_000)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows, str(SF)).count() >= 0
        assert stage(spark, rows.limit(0), str(SF)).count() == 0
