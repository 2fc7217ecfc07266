"""Incremental ingestion as file streams: every file is processed once, restarts go on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.config import DEFAULT, EngineConfig
from lectern.operators import passages
from lectern.plans import indexing
from lectern.providers import Embedder, PageReader, embedding
from lectern.sources.store import Store

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def new_designation_files(store: Store, root: str, country: str, files_at_once: int = DEFAULT.files_at_once) -> DataFrame:
    """Stream of PDFs that appear in the designation folders of a country, at most ``files_at_once`` a batch."""
    files = (
        store.spark.readStream.format("binaryFile").schema(BINARY_FILE)
        .option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", files_at_once).load(f"{root}/{country}/*/")
    )
    parts = F.split(F.expr("try_url_decode(replace(path, '+', '%2B'))"), "/")
    return files.select(
        F.lit(country).alias("country"), F.try_element_at(parts, F.lit(-2)).alias("folder"),
        F.try_element_at(parts, F.lit(-1)).alias("file"), "path", "content",
    ).filter("folder like 'DOP\\_%' or folder like 'IGP\\_%'")


def index_new_files(
    store: Store, root: str, country: str, reader: PageReader, embedder: Embedder, cfg: EngineConfig = DEFAULT
) -> StreamingQuery:
    """Process all files that are new since the last run and stop.

    A batch that is repeated after a failure first finds which of its documents are stored, so
    nothing is stored twice.
    """
    def store_batch(batch: DataFrame, _: int) -> None:
        fresh = indexing.extracted(batch, reader, country, cfg=cfg).filter("error is null").drop("error")
        # written once: parsing and model calls are not repeated for the three tables below
        store.overwrite(fresh, f"staging/stream_{country}")
        docs = store.spark.read.parquet(store.path(f"staging/stream_{country}"))
        split = passages.with_passages(passages.with_document_metadata(docs), cfg)
        chunks = passages.chunk_records(split, cfg)
        # a batch names at most files_at_once folders: only their rows of the store are looked at
        folders = [r.folder for r in docs.select("folder").distinct().collect()]

        def stored(df: DataFrame, *keys: str) -> DataFrame:
            return df.filter((F.col("country") == country) & F.col("folder").isin(*folders)).select(*keys)

        have_docs = stored(store.documents(), *indexing.DOCUMENT_KEY)
        have_chunks, have_parents = stored(store.chunks(), "chunk_id"), stored(store.parents(), "parent_id")
        new_chunks = chunks.join(have_chunks, "chunk_id", "left_anti").withColumn("embedding", embedding("markdown", embedder, cfg))
        store.append(passages.parents_table(split).join(have_parents, "parent_id", "left_anti"), "parents")
        store.append(passages.storable(new_chunks), "chunks")
        store.remember_folders(docs)
        store.append(docs.join(have_docs, indexing.DOCUMENT_KEY, "left_anti"), "documents")

    return (
        new_designation_files(store, root, country, cfg.files_at_once).writeStream.foreachBatch(store_batch)
        .option("checkpointLocation", store.path(f"checkpoints/{country}"))
        .trigger(availableNow=True).start()
    )
