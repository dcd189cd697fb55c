"""The registered queries and the pipeline on the smallest given tables."""

import os
import subprocess
import sys

import duckdb
import pytest

import corpus_pipeline
from gavelflow.llm import queries as llm
from gavelflow.llm.common import documents
from scripts.check import TABLES, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = llm.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    con.execute(llm.oracle_sql()[name])
    assert got == rows([c[0] for c in con.description], con.fetchall())


def test_one_query_per_operator():
    assert [n.split("_")[0] for n in llm.queries() if n != "pipeline"] == [f"op{i}" for i in range(1, 14)]


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = documents(spark, SF)
    before = {r.doc_id: r for r in docs.collect()}
    seen = [len(before)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), docs.schema)
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[0] > seen[1] and seen[2] > seen[3]
    left = docs.collect()
    assert all(r.n_chars == len(r.text) for r in left)
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in left}


def test_stages_take_empty_and_null_documents(spark):
    schema = documents(spark, SF).schema
    for data in ([], [(None, None, None, None, None), (1, None, "en", None, 3), (1, "", "en", "s", 0)]):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= max(len(data), 3)


def test_workers_find_the_package_from_any_folder(tmp_path):
    code = (
        "import sys; sys.path.insert(0, {root!r}); import __spark_entry__ as e\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print('ROWS', e.queries()['op7_token_files'](s, {sf!r}).count(), e.queries()['op10_simhash'](s, {sf!r}).count())")
    root = __file__.rsplit("/tests/", 1)[0]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    out = subprocess.run([sys.executable, "-c", code.format(root=root, sf=SF)], cwd=tmp_path, capture_output=True, text=True, timeout=300, env=env)
    assert "ROWS 200 200" in out.stdout, out.stderr[-3000:]
