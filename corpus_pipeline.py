"""The corpus pipeline: toxicity, quality rules, near duplicates, packing.

Each stage is (name, function of (spark, docs, sf_dir)); it works on all rows that the stage before
kept.  All but the last return the columns of ``documents``; the last returns the packed pieces.

Every row is a document, also one without an id or with another's: rows are judged one by one, and near
copies are found among rows.  Of a group of near copies the row with the smallest id stays (without one
only if none has an id).  Empty inputs give empty outputs.  Further columns of ``documents`` travel along as they are,
whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import packing, quality, similar_texts, toxicity
from lectern.llm.common import cut_lineage, forget, residue, run_folder, table

#: No SQL: the toxicity scores and the token ids of the packing are beyond it.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score, learned from three folds of four of the labels, is below 0.3.

    They are written here, so that the larger table they come from, which has the words of all texts too, is gone for the next stages.
    """
    fold = residue("doc_id", 4)
    model, read = toxicity.learn(docs, table(spark, sf_dir, "labels"), (fold != 2) & (fold != -1), whole=True)
    kept = cut_lineage(toxicity.rows_below(read, model, 0.3), batch_rows=1024)
    forget(read)
    return kept.toDF(*docs.columns)


def apply_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and all others."""
    return quality.kept_rows(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near duplicates; rows are told apart by number, not by id."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = cut_lineage(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()))
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    classes = similar_texts.similarity_classes(rows.select(F.col("row").alias("doc_id"), text.alias("text")))
    classes = classes.select(F.col("doc_id").alias("row"), "class_id").join(rows.select("row", doc_id.alias("id")), "row")
    stay = classes.groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")).select("first.row")
    return rows.join(stay.hint("merge"), "row", "left_semi").select(*names).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of up to 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", apply_quality),
    ("near_duplicates", one_of_each_group),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{run_folder(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
