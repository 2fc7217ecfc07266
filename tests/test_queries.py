"""Every registered query against its SQL on the smallest tables, and the shape of plans."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.operators import conversation, graph, tables, vectors
from lectern.plans.registered import QUERIES, SQL, derived, retrieval
from lectern.plans.registered.registry import table

SF = os.environ.get("LECTERN_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    assert name in SQL
    cur = duck.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, cur.fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_query_builds_a_cartesian_product(spark):
    for name in ("lexicon_mentions", "fuzzy_nodes", "shared_varieties", "coauthorized_varieties", "hits_with_parents"):
        text = plan(QUERIES[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_nearest_keeps_a_heap_per_task(spark):
    text = plan(vectors.nearest(table(spark, SF, "embeddings").filter("label = 3"), [1.0] * 64, 5, id_col="vec_id"))
    assert "TakeOrderedAndProject" in text and "EqualTo(label,3)" in text and "Exchange" not in text


def test_first_rows_are_cut_before_the_shuffle(spark):
    text = plan(conversation.buffered(table(spark, SF, "conversations"), 2))
    assert "WindowGroupLimit" in text
    rows_ = tables.yield_rows(tables.parsed_tables(derived.table_corpus(spark, SF)))
    assert "WindowGroupLimit" in plan(tables.load_unique(rows_, "yields"))


def test_splitting_needs_no_shuffle(spark):
    from lectern.operators import passages

    docs = table(spark, SF, "documents").select(
        F.lit("Espanya").alias("country"), F.lit("DOP_X").alias("folder"), F.col("doc_id").cast("string").alias("source_file"), F.col("text").alias("markdown")
    )
    text = plan(passages.chunk_records(passages.with_passages(passages.with_document_metadata(docs))))
    assert "Exchange" not in text and "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_metadata_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "chunks")
    retrieval.chunk_store(spark, SF).write.partitionBy("country").parquet(path)
    wanted = vectors.metadata_filter(spark.read.parquet(path).filter(F.col("country") == "Espanya"), "DOP", ["src1", "src2"])
    text = plan(wanted.select("chunk_id"))
    assert "PartitionFilters: [isnotnull(country" in text and "In(gi_name, [src1,src2])" in text and "embedding" not in text


def test_graph_rules_on_empty_edges(spark):
    edges = graph.edges_of(
        spark.range(0), F.lit("a"), F.lit("b"), "AUTHORIZES_VARIETY", graph.order_key(0, F.lit(""), F.lit(0), F.lit(0), F.lit(0))
    )
    assert graph.infer_shared(edges).count() == 0 and graph.coauthorized(edges).count() == 0 and graph.soil_in_climate(edges).count() == 0
