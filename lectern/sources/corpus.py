"""Reading a corpus: raw files, extracted documents, question sets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.fixed_values import KNOWLEDGE_COUNTRY
from lectern.functions import names

EXTRACTED_META = (
    "source_file string, country string, type string, name string, folder string, category string, "
    "subcategory string, extraction_method string, char_count long, page_count long, language string, markdown string"
)


def _decoded_path() -> "F.Column":
    return F.expr("try_url_decode(replace(_metadata.file_path, '+', '%2B'))")


def _part_from_end(path, n: int):
    return F.try_element_at(F.split(path, "/"), F.lit(-n))


def _binary_files(spark: SparkSession, where: str | list[str], recursive: bool = False) -> DataFrame:
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(where).select(_decoded_path().alias("path"), F.col("modificationTime").alias("modified"), "content", F.col("path").alias("_raw_path"))


def exactly(path: str) -> str:
    """A path as a pattern that only this path fits."""
    return re.sub(r"([\\*?\[\]{},])", r"\\\1", path)


def _as_designations(files: DataFrame, country: str) -> DataFrame:
    return files.select(
        F.lit(country).alias("country"), _part_from_end(F.col("path"), 2).alias("folder"),
        _part_from_end(F.col("path"), 1).alias("file"), "path", "modified", "content", "_raw_path",
    ).filter(names.is_designation("folder"))


def _as_knowledge(files: DataFrame) -> DataFrame:
    rel = F.split_part(F.col("path"), F.lit(f"/{KNOWLEDGE_COUNTRY}/"), F.lit(-1))
    return files.withColumn("c", names.categorize(rel)).select(
        F.lit(KNOWLEDGE_COUNTRY).alias("country"), F.col("c.folder").alias("folder"),
        _part_from_end(F.col("path"), 1).alias("file"), F.col("c.category").alias("category"),
        F.col("c.subcategory").alias("subcategory"), "path", "modified", "content", "_raw_path",
    )


def designation_files(spark: SparkSession, root: str, country: str) -> DataFrame:
    """PDFs directly below the designation folders of a country, with their bytes.

    Columns: country, folder, file, path, modified, content.  Content is only read when used.
    """
    return _as_designations(_binary_files(spark, f"{root}/{country}/*/"), country).drop("_raw_path")


def knowledge_files(spark: SparkSession, root: str) -> DataFrame:
    """PDFs at any depth below the knowledge root, with category, sub-category and folder."""
    return _as_knowledge(_binary_files(spark, f"{root}/{KNOWLEDGE_COUNTRY}", True)).drop("_raw_path")


def listing(spark: SparkSession, root: str, country: str) -> DataFrame:
    """The files of a country without their bytes, which are not read; _raw_path is where ``contents`` finds them."""
    if country == KNOWLEDGE_COUNTRY:
        return _as_knowledge(_binary_files(spark, f"{root}/{KNOWLEDGE_COUNTRY}", True)).drop("content")
    return _as_designations(_binary_files(spark, f"{root}/{country}/*/"), country).drop("content")


def contents(spark: SparkSession, raw_paths: list[str], country: str) -> DataFrame:
    """The named files of a country with their bytes; no other file is opened."""
    files = _binary_files(spark, [exactly(p) for p in raw_paths])
    return (_as_knowledge(files) if country == KNOWLEDGE_COUNTRY else _as_designations(files, country)).drop("_raw_path")


def extracted_documents(spark: SparkSession, root: str) -> DataFrame:
    """Metadata files joined with the text files next to them.

    An unreadable metadata file is left out; without a text file the ``markdown`` key of the
    metadata is used.
    """
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("stem", names.file_stem("path"))

    meta = (
        spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json").load(root)
        .select(_decoded_path().alias("path"), F.from_json("value", EXTRACTED_META).alias("m"),
                F.try_parse_json("value").isNotNull().alias("ok"))
        .filter("ok")
    )
    text = (
        spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.md").load(root)
        .select(_decoded_path().alias("path"), F.col("value").alias("md"))
    )
    both = keyed(meta).join(keyed(text).select("stem", "md"), "stem", "left")
    folder = F.coalesce("m.folder", _part_from_end(F.col("path"), 2))
    is_knowledge = F.col("m.type") == "knowledge"
    return both.select(
        F.coalesce("m.country", _part_from_end(F.col("path"), 3)).alias("country"),
        folder.alias("folder"),
        names.file_stem(_part_from_end(F.col("path"), 1)).alias("source_file"),
        names.gi_type(folder).alias("gi_type"),
        F.when(is_knowledge, F.coalesce("m.category", folder)).otherwise(names.gi_name(folder)).alias("gi_name"),
        F.coalesce("m.subcategory", F.lit("")).alias("subcategory"),
        F.coalesce("m.language", F.lit("unknown")).alias("language"),
        F.coalesce("md", F.when(~F.coalesce(is_knowledge, F.lit(False)), F.col("m.markdown")), F.lit("")).alias("markdown"),
    ).filter("markdown <> ''")


def question_set(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """Evaluation questions in file order, optionally the first ``limit``."""
    # one JSON array in one small file; the position in the array is the order
    raw = spark.read.format("text").option("wholetext", "true").load(path)
    items = raw.select(F.posexplode(F.from_json("value", "array<struct<question:string,ground_truth:string>>")).alias("ord", "q"))
    questions = items.select("ord", "q.question", "q.ground_truth")
    return questions.filter(F.col("ord") < limit) if limit > 0 else questions
