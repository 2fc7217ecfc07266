"""Shape of the table jobs: rows are dealt over the cores before they become documents, values are computed once."""

import re

from pyspark.sql import functions as F

from lectern.operators import tables
from lectern.plans.registered import derived


def filters(df):
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in re.split(r"\n(?=[ :+-]*[A-Z])", text) if re.match(r"[ :+-]*Filter", line)]


def parts(spark, path):
    rows = [(k, f"name {k % 5}", f"Brand#{k % 3}", "LARGE", k % 50) for k in range(200)]
    made = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    made.coalesce(1).write.parquet(f"{path}/part.parquet")
    return path


def test_parts_of_one_row_group_are_documents_in_many_tasks(spark, tmp_path):
    docs = derived.table_corpus(spark, parts(spark, str(tmp_path)))
    assert docs.select(F.spark_partition_id().alias("p")).distinct().count() > 8


def test_documents_are_made_once_and_values_are_not_computed_again_by_filters(spark, tmp_path):
    parsed = tables.parsed_tables(derived.table_corpus(spark, parts(spark, str(tmp_path))))
    for kind in ("yields", "municipalities"):
        conditions = filters(tables.ROW_EXTRACTORS[kind](parsed))
        assert conditions and not any(x in c for c in conditions for x in ("lambda", "Pliego", "array_join")), kind
