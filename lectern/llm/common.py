"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.lineage import cut_lineage, forget, run_folder

__all__ = ["cut_lineage", "forget", "run_folder", "fresh_folder", "table", "residue", "WORD", "only", "batches_of", "groups_in_order", "file_path", "join_hot"]

#: A word of a text: everything but space and the controls from tab to carriage return.
WORD = "[^ \t-\r]+"
#: The same for Java's regular expressions.
JAVA_WORD = r"[^\x20\x09-\x0D]+"


def residue(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null keys give -1, which no fold uses."""
    text = F.col(key).cast("string")
    return F.coalesce(F.pmod(F.crc32(text.cast("binary")), F.lit(modulus)).cast("int"), F.lit(-1))


def only(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Just the named columns, so that nothing else travels and no other name can clash."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def fresh_folder(df: DataFrame, kind: str) -> str:
    """A new folder below the shared one."""
    return f"{run_folder(df.sparkSession)}/{kind}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; also lets Python workers on this machine find the package (a cluster ships it)."""
    root, environment = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_path(name: str) -> str:
    """Where the installed vocabulary files lie; imported in the task, so each machine uses its own."""
    import public_tokenizers

    return public_tokenizers.path(name)


def batches_of(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches to at most ``rows`` rows, which bounds what a task holds at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def groups_in_order(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys together; the batches are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new), batch.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, z - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def join_hot(rows: DataFrame, facts: DataFrame, key: str, total: int, share: int = 1000) -> DataFrame:
    """Left join of ``rows`` with ``facts`` on ``key`` (nulls equal each other) that no frequent key can hold up.

    ``facts`` has each key once, with ``n``, the number of rows that have it; ``total`` is the number of
    rows.  Keys of more than ``1 / share`` of the rows number fewer than ``share``, so their facts are
    broadcast whatever the tables' size; the others have few rows each and are shuffled.
    """
    names = [c for c in facts.columns if c not in (key, "n")]
    frequent = F.col("n") * share > total
    hot = facts.filter(frequent).select(F.col(key).alias("_k"), *names, F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(hot), rows[key].eqNullSafe(hot["_k"]), "left")
    cold = facts.filter(~frequent).select(F.col(key).alias("_k"), *names)
    rest = marked.filter("_hot IS NULL").select(*rows.columns)
    rest = rest.join(cold, rest[key].eqNullSafe(cold["_k"]), "left").select(*rows.columns, *names)
    return marked.filter("_hot").select(*rows.columns, *names).unionByName(rest)
