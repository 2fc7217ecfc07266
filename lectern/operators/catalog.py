"""What the corpus holds: discovery, extraction state and lists of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.fixed_values import SUPPORTED_COUNTRIES
from lectern.functions import names


def discover_designations(files: DataFrame) -> DataFrame:
    """Designation folders with their PDF count and first PDF.

    ``files`` has (folder, file) for every file directly below a folder.  Only counts and an
    extreme leave a task, so a folder with very many files is no problem.
    """
    pdfs = files.filter(names.is_designation("folder") & F.endswith(F.col("file"), F.lit(".pdf")))
    return pdfs.groupBy("folder").agg(
        F.count("*").alias("n_pdfs"), F.min("file").alias("first_pdf")
    ).select(
        "folder",
        names.gi_name("folder").alias("display_name"),
        names.gi_type("folder").alias("gi_type"),
        "n_pdfs", "first_pdf",
    )


def designation_pdfs(files: DataFrame, name_like: str | None = None) -> DataFrame:
    """One row per PDF of a designation folder, optionally of matching designations only."""
    pdfs = files.filter(names.is_designation("folder") & F.endswith(F.col("file"), F.lit(".pdf")))
    if name_like:
        pdfs = pdfs.filter(F.contains(F.lower(names.gi_name("folder")), F.lit(name_like.lower())))
    return pdfs


def list_designations(docs: DataFrame, country: str | None = None, gi_type: str | None = None) -> DataFrame:
    """Distinct folders as (country, folder, name, type), knowledge folders included."""
    found = docs.select("country", "folder")
    if country:
        found = found.filter(F.col("country") == country)
    found = found.distinct().select(
        "country", "folder", names.display_name("folder").alias("name"), names.gi_type("folder").alias("type")
    )
    return found.filter(F.col("type") == gi_type) if gi_type else found


def pending(sources: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Sources without finished output (what an incremental run still has to do)."""
    return sources.join(done.select(*keys).distinct(), keys, "left_anti")


def extraction_status(sources: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of rows that were extracted, skipped (output existed) or failed.

    ``sources`` may carry an ``error`` column; a non-NULL value marks a failed document.
    """
    error = F.col("error").isNotNull() if "error" in sources.columns else F.lit(False)
    flagged = sources.join(done.select(*keys).distinct().withColumn("_done", F.lit(True)), keys, "left")
    status = (
        F.when(F.col("_done"), F.lit("skipped")).when(error, F.lit("errors")).otherwise(F.lit("extracted"))
    )
    return flagged.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def language_counts(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("language").isNotNull()).groupBy("language").agg(F.count("*").alias("n"))


def collection_prefix_counts(chunks: DataFrame) -> DataFrame:
    """Rows per id prefix (the collection), split into small passages and parents."""
    prefix = F.split_part("chunk_id", F.lit("__"), F.lit(1))
    is_parent = F.col("chunk_id") == F.col("parent_id")
    return chunks.groupBy(prefix.alias("collection")).agg(
        F.count_if(~is_parent).alias("n_children"), F.count_if(is_parent).alias("n_parents")
    )


def supported_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("country").isin(*SUPPORTED_COUNTRIES))
