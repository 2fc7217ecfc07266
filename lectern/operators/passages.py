"""Parent passages and searchable records of a corpus: map-only, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.config import DEFAULT, EngineConfig
from lectern.fixed_values import METADATA_FIELDS
from lectern.functions import names, packing

DOCUMENT_FIELDS = ("folder", "source_file", "country", "gi_type", "gi_name", "subcategory", "language")
RECORD_FIELDS = ("chunk_id", *METADATA_FIELDS, "markdown")


def with_document_metadata(docs: DataFrame) -> DataFrame:
    """Fill the record metadata of (country, folder, source_file, markdown, ...) rows.

    Knowledge documents carry their category as name; designations derive type and name from
    the folder.  Absent values become the documented defaults.
    """
    have = set(docs.columns)

    def value(name: str, default: str):
        return F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)

    gi_type = F.coalesce(F.col("gi_type"), names.gi_type("folder")) if "gi_type" in have else names.gi_type("folder")
    gi_name = F.coalesce(F.col("gi_name"), names.gi_name("folder")) if "gi_name" in have else names.gi_name("folder")
    return docs.select(
        "folder", "source_file", "country",
        gi_type.alias("gi_type"), gi_name.alias("gi_name"),
        value("subcategory", "").alias("subcategory"),
        value("language", "unknown").alias("language"),
        "markdown",
    ).filter(F.coalesce(F.length("markdown"), F.lit(0)) > 0)


def with_passages(docs: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Replace ``markdown`` by the array columns ``parents`` and ``children``."""
    return (
        docs.withColumn("parents", packing.parent_passages("markdown", cfg))
        .drop("markdown")
        .withColumn("children", packing.child_passages(F.col("parents"), cfg))
    )


def parents_table(passages: DataFrame) -> DataFrame:
    return passages.select(
        "country", "folder", "source_file", F.posexplode("parents").alias("parent_index", "p")
    ).select(
        "country", "folder", F.col("source_file").alias("pdf"),
        names.parent_id(F.col("country"), F.col("folder"), F.col("source_file"), F.col("parent_index")).alias("parent_id"),
        F.col("p.section").alias("section"), F.col("p.markdown").alias("markdown"),
    )


def chunk_records(passages: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Searchable rows: the surviving children, then the parents themselves.

    Children and parents of a document are put into one array and exploded once, so the
    passages are computed once and no union of two scans is needed.
    """
    key = (F.col("country"), F.col("folder"), F.col("source_file"))
    children = F.transform(
        "children",
        lambda c, i: F.struct(
            names.chunk_id(*key, i).alias("chunk_id"),
            names.parent_id(*key, c["parent_index"]).alias("parent_id"),
            c["section"].alias("section"), c["markdown"].alias("markdown"),
        ),
    )
    parents = F.transform(
        "parents",
        lambda p, i: F.struct(
            names.parent_id(*key, i).alias("chunk_id"),
            names.parent_id(*key, i).alias("parent_id"),
            p["section"].alias("section"), p["markdown"].alias("markdown"),
        ),
    )
    parents = F.filter(parents, lambda p: F.length(p["markdown"]) >= cfg.min_chunk_chars)
    return passages.select(*DOCUMENT_FIELDS, F.explode(F.concat(children, parents)).alias("r")).select(
        F.col("r.chunk_id").alias("chunk_id"), *DOCUMENT_FIELDS,
        F.col("r.section").alias("section"), F.col("r.parent_id").alias("parent_id"),
        F.col("r.markdown").alias("markdown"),
    )


def storable(chunks: DataFrame) -> DataFrame:
    """Rows of the vector collection: vectors present, metadata without NULLs."""
    return chunks.filter(F.col("embedding").isNotNull()).select(
        "chunk_id",
        *[F.coalesce(F.col(f), F.lit("")).alias(f) for f in METADATA_FIELDS],
        F.col("markdown").alias("document"),
        "embedding",
    )
