import os

from panelloom.llm.common import discard, materialize


def test_materialized_table_keeps_schema_and_rows(spark):
    df = spark.createDataFrame([(1, [1.5], None)], "a long, b array<double>, c string")
    out = materialize(df, "t")
    assert out.dtypes == df.dtypes and [tuple(r) for r in out.collect()] == [(1, [1.5], None)]


def test_discarded_tables_are_deleted(spark):
    out = materialize(spark.range(10).toDF("a"), "t")
    path = out._written_at.removeprefix("file:")
    assert os.path.isdir(path)
    discard(out)
    assert not os.path.exists(path)
