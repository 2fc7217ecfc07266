"""Token-id files: documents in ascending order, encoded and written as blocks, and read back.

Null texts count as empty and consist of the end id alone.  Rows without a document id come
first and get the smallest 64-bit id in the files.  Rows that repeat a document id are all written, ordered
by a hash of their texts.  An empty table gives no files and no rows.  Other columns of the
input are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import batches_of, cut_lineage, file_path, fresh_folder, only
from lectern.llm.encoder import encoder
from lectern.llm.id_blocks import IdFile, write_blocks

#: Stands for a null document id in the files.
NO_ID = -(1 << 63)
MANIFEST = "part long, piece long, path string, documents long, ids long, bytes long"
READ = "part long, piece long, place long, doc_id long, n_tokens long, in_file long, ids_crc32 long"


def _store(folder: str, name: str, data: bytes) -> None:
    """Under another name first, then moved: a task that is run again replaces what it wrote before."""
    import uuid

    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
    files.create_dir(root, recursive=True)
    draft = f"{root}/_{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as out:
        out.write(data)
    files.move(draft, f"{root}/{name}")


def write_id_files(
    docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", end: int = 2, ids_per_file: int = 4_000_000, percentile: float = 0.9
) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write files to ``folder``, which all machines must share.

    One range partition writes one or more files of about ``ids_per_file`` ids each, so a task
    holds one file at most.  Returns the list of files (part, piece, path, documents, ids, bytes).
    """

    def write(batches):
        part = TaskContext.get().partitionId()
        enc = encoder(file_path(tokenizer))
        docs_, sizes, chunks, held, piece = [], [], [], 0, 0

        def flush():
            ids = np.concatenate(chunks)
            numbers, lengths = np.concatenate(docs_), np.concatenate(sizes)
            name = f"ids-{part:06d}-{piece:06d}.pfor"
            data = write_blocks(numbers, lengths, ids, percentile)
            _store(folder, name, data)
            return pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (part, piece, name, len(numbers), len(ids), len(data))], names=["part", "piece", "path", "documents", "ids", "bytes"]
            )

        for batch in batches_of(batches, 256):
            ids, offsets = enc.encode(batch.column("text").to_pylist(), end)
            docs_.append(batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False))
            sizes.append(np.diff(offsets))
            chunks.append(ids)
            held += len(ids)
            if held >= ids_per_file:
                yield flush()
                docs_, sizes, chunks, held, piece = [], [], [], 0, piece + 1
        if held:
            yield flush()

    ordered = (
        only(docs, doc_id=F.col("doc_id").cast("long"), text="text")
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    return cut_lineage(ordered.mapInArrow(write, MANIFEST))


def read_id_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in the files: (part, piece, place in the file, doc_id, n_tokens, in_file, ids_crc32)."""

    def read(batches):
        for batch in batches_of(batches, 1):
            part, piece = (int(x) for x in batch.column("path")[0].as_py().rsplit("/", 1)[1][4:-5].split("-"))
            file = IdFile(batch.column("content")[0].as_py())
            before = np.concatenate([[0], np.cumsum(file.lengths)])
            data = memoryview(file.ids().astype("<u4").tobytes())
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(before, before[1:])]
            n = len(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part)), pa.array(np.full(n, piece)), pa.array(np.arange(n)), pa.array(file.documents),
                 pa.array(file.lengths), pa.array(before[:-1]), pa.array(sums, pa.int64())],
                names=["part", "piece", "place", "doc_id", "n_tokens", "in_file", "ids_crc32"],
            )

    found = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.pfor").load(folder)
    return found.select("path", "content").mapInArrow(read, READ)


def file_starts(manifest: DataFrame) -> DataFrame:
    """How many ids lie before each file: summed within a part, then over the parts, of which there are few."""
    within = Window.partitionBy("part").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("all")).withColumn("base", F.coalesce(F.sum("all").over(before), F.lit(0)))
    return manifest.join(parts.select("part", "base"), "part").select(
        "part", "piece", (F.col("base") + F.coalesce(F.sum("ids").over(within), F.lit(0))).alias("base")
    )


def id_file_rows(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end: int = 2, folder: str | None = None) -> DataFrame:
    """Write the files, read them back, and say for each document where its ids lie in the whole sequence."""
    folder = folder or fresh_folder(docs, "id-files")
    manifest = write_id_files(docs, folder, tokenizer, end)
    empty = manifest.isEmpty()
    rows = docs.sparkSession.createDataFrame([], READ) if empty else read_id_files(docs.sparkSession, folder)
    return rows.join(file_starts(manifest), ["part", "piece"]).select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), (F.col("base") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32", "part", "piece"
    )
