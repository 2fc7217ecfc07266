"""Similarity join of texts on five-word shingles by chosen paths.

**Sets.**  A text is the set of hashes of its five-word windows (all its words if it has fewer); equal
sets are one node from here on, so copies cost nothing and are never paired.
**Paths.**  A run sends a node down a path of sampled coordinates of its min-hash signature: two
sets share a step with the probability of their similarity.  A bucket with few nodes is a leaf; a
fuller one is split by the next coordinate, up to ``depth`` steps.  Runs are repeated until a pair
at the threshold is missed with a probability of at most ``1 - recall``, even if all its buckets
are split to the end.
**Brute force.**  All nodes of a leaf are compared by their whole signatures; those that agree in
half of the coordinates (far below any pair at the threshold) are tied together.  A bucket that is
still full at the end is tied as it is.  Tied groups are then compared with each other's full sets,
all pairs exactly, by matrix products over blocks; of pairs only counts and a spanning forest
leave a task.  Groups larger than a block are compared block against block.

Result: a row for each input row, with the class (smallest id in the component of links) and the
number of other rows linked to it, copies included.  Rows without words or without an id have no
links; their class is their own id.  Rows that repeat an id are counted one by one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import WORD, batches_of, cut_lineage, forget, groups_in_order, only
from lectern.llm.components import components

WORDS = re.compile(WORD)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def runs_for(recall: float, threshold: float, depth: int) -> int:
    """Runs after which a pair at the threshold has met in a leaf with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


class Shingles:
    """Sets of hashed windows; word hashes are kept up to a bound."""

    def __init__(self, width: int = 5, coordinates: int = 64, most: int = 1_000_000):
        rng = np.random.default_rng(5)
        self.width, self.most = width, most
        self.places = rng.integers(1, 1 << 63, width, np.uint64) | np.uint64(1)
        self.turns = rng.integers(1, 1 << 63, coordinates, np.uint64) | np.uint64(1)
        self.hashes: dict[str, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        words = WORDS.findall(text or "")
        if len(self.hashes) > self.most:
            self.hashes.clear()
        known = self.hashes
        for w in set(words).difference(known):
            known[w] = xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        n = max(1, len(h) - self.width + 1)
        mixed = np.zeros(n, np.uint64)
        for k in range(min(self.width, len(h))):
            mixed += h[k : k + n] * self.places[k]
        mixed ^= mixed >> np.uint64(29)
        mixed *= MIX
        mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Per coordinate the smallest of the turned hashes (upper 32 bits)."""
        low = np.full(len(self.turns), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 2048):
            low = np.minimum(low, (shingles[at : at + 2048, None] * self.turns).min(axis=0))
        return (low >> np.uint64(32)).astype(np.uint32)


def paths_of(signature: np.ndarray, depth: int) -> np.ndarray:
    """Bucket numbers by run and step; a step's number depends on the run and on all steps before."""
    steps = signature.reshape(-1, depth).astype(np.uint64)
    out, path = np.empty(steps.shape, np.uint64), np.arange(len(steps), dtype=np.uint64) + np.uint64(1)
    for d in range(depth):
        path = (path ^ steps[:, d]) * MIX
        path ^= path >> np.uint64(31)
        out[:, d] = path = path * np.uint64(0x94D049BB133111EB)
    return out.astype(np.int64)


def set_rows(docs: DataFrame, width: int, runs: int, depth: int) -> DataFrame:
    """(doc_id, node, signature): the 16-byte hash of the set (null without words or id) and its signature."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        maker = Shingles(width, runs * depth)
        for batch in batches_of(batches, 1024):
            nodes: list[bytes | None] = []
            signatures: list[bytes | None] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                s = maker.of(text) if doc is not None else np.zeros(0, np.uint64)
                nodes.append(xxh3_128_digest(s.tobytes()) if len(s) else None)
                signatures.append(maker.signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(nodes, pa.binary()), pa.array(signatures, pa.binary())], names=["doc_id", "node", "signature"]
            )

    return only(docs, doc_id=F.col("doc_id").cast("long"), text="text").mapInArrow(sets, "doc_id long, node binary, signature binary")


def roots_of(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Component of each of ``n`` places by its smallest place."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, left, root[right])
        np.minimum.at(low, right, root[left])
        low = np.minimum(low, low[low])
        if (low == root).all():
            return root
        root = low


def leaves(nodes: DataFrame, depth: int, fill: int) -> tuple[DataFrame, DataFrame]:
    """(path, node) of leaves with 2 to ``fill`` nodes, and of buckets still fuller after the last step."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 4096):
            paths = [paths_of(np.frombuffer(s, np.uint32), depth) for s in batch.column("signature").to_pylist()]
            runs = len(paths[0]) if paths else 0
            flat = np.concatenate(paths) if paths else np.zeros((0, depth), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(pa.array(np.repeat(np.arange(len(paths)), runs))), *[pa.array(flat[:, d]) for d in range(depth)]],
                names=["node", *[f"p{d}" for d in range(depth)]],
            )

    left = nodes.select("node", "signature").mapInArrow(walk, "node binary, " + ", ".join(f"p{d} long" for d in range(depth)))
    found = []
    for d in range(depth):
        sizes = left.groupBy(f"p{d}").agg(F.count("*").alias("_n")).filter("_n > 1")
        shared = cut_lineage(left.join(sizes, f"p{d}"))
        found.append(shared.filter(F.col("_n") <= fill).select(F.col(f"p{d}").alias("path"), "node"))
        left = shared.filter(F.col("_n") > fill).drop("_n", *[f"p{k}" for k in range(d)])
    small = found[0]
    for f in found[1:]:
        small = small.unionByName(f)
    return small, left.select(F.col(f"p{depth - 1}").alias("path"), "node")


def tied(nodes: DataFrame, small: DataFrame, full: DataFrame, agree: float) -> DataFrame:
    """Edges (a, b) between nodes whose sets are to be compared."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_in_order(batches, ["path"]):
            node = group.column("node").to_pylist()
            s = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint32).reshape(len(node), -1)
            left, right = np.nonzero(np.triu((s[:, None, :] == s[None]).sum(axis=2) >= agree * s.shape[1], 1))
            root = roots_of(len(node), left, right)
            pairs = [(node[i], node[r]) for i, r in enumerate(root) if i != r]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*pairs)], names=["a", "b"])

    near = small.join(nodes.select("node", "signature"), "node").repartition("path").sortWithinPartitions("path").mapInArrow(compare, "a binary, b binary")
    firsts = full.groupBy("path").agg(F.min("node").alias("a"))
    return near.unionByName(full.join(firsts, "path").select("a", F.col("node").alias("b")).filter("a <> b"))


def overlaps(sets: list[np.ndarray], dense_from: int = 12) -> np.ndarray:
    """Sizes of the pairwise intersections: frequent elements by matrix products, others by their few pairs."""
    n = len(sets)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    _, columns, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((n, n), np.float32)
    order = np.lexsort((rows, columns))
    rows, columns = rows[order], columns[order]
    rare = counts[columns] < dense_from
    r, c = rows[rare], columns[rare]
    for k in range(1, dense_from):
        same = c[k:] == c[:-k]
        if not same.any():
            break
        np.add.at(out, (r[:-k][same], r[k:][same]), 1)
    out += out.T
    frequent = np.flatnonzero(counts >= dense_from)
    number = np.full(len(counts), -1)
    number[frequent] = np.arange(len(frequent))
    r, c = rows[~rare], number[columns[~rare]]
    for at in range(0, len(frequent), 2048):
        mine = (c >= at) & (c < at + 2048)
        m = np.zeros((n, min(2048, len(frequent) - at)), np.float32)
        m[r[mine], c[mine] - at] = 1
        out += m @ m.T
    return out


def linked(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per unit (group, i, j) of two blocks: each node's linked rows and the root of its links within the unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_in_order(batches, ["unit"]):
            node, block = group.column("node").to_pylist(), np.array(group.column("block").to_pylist())
            sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
            size, rows = np.array([len(s) for s in sets], np.float64), np.array(group.column("rows").to_pylist(), np.float64)
            common = overlaps(sets).astype(np.float64)
            link = common >= threshold * (size[:, None] + size[None] - common) - 1e-9
            np.fill_diagonal(link, False)
            if group.column("block")[0].as_py() != group.column("other")[0].as_py():
                link &= block[:, None] != block[None]  # pairs within a block belong to the unit of that block alone
            root = roots_of(len(node), *np.nonzero(np.triu(link)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.binary()), pa.array([node[r] for r in root], pa.binary()), pa.array((link @ rows).astype(np.int64))],
                names=["node", "root", "links"],
            )

    return run


def similarity_classes(
    docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.999, depth: int = 4, fill: int = 48, block: int = 1024
) -> DataFrame:
    """doc_id, class_id and n_links of every row of ``docs`` (doc_id, text)."""
    runs = runs_for(recall, threshold, depth)
    rows = cut_lineage(set_rows(docs, width, runs, depth))
    nodes = cut_lineage(
        rows.filter("node IS NOT NULL").groupBy("node")
        .agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"), F.first("signature").alias("signature"))
    )
    small, full = leaves(nodes, depth, fill)
    groups = components(tied(nodes, small, full, agree=0.5)).withColumnRenamed("root", "group")
    forget(small)  # the tables of all leaves and full buckets; the groups are written

    # the sets of tied nodes, from one row each; the share of tied nodes doesn't depend on the size of the table,
    # so texts and ids are always sorted by id, never sent as a whole
    wanted = cut_lineage(groups.join(nodes.drop("signature"), "node"))
    ids = wanted.select(F.col("first").alias("doc_id"), "node", "rows", "group")

    def refill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        maker = Shingles(width)
        for batch in batches_of(batches, 1024):
            sets = [maker.of(t).tobytes() for t in batch.column("text").to_pylist()]
            right = pa.array([xxh3_128_digest(s) == node for s, node in zip(sets, batch.column("node").to_pylist())])  # an id may have other texts
            out = pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("group"), batch.column("rows"), pa.array(sets, pa.binary())], names=["node", "group", "rows", "shingles"]
            )
            yield out.filter(right)

    texts = only(docs, doc_id=F.col("doc_id").cast("long"), text="text").join(ids.hint("merge"), "doc_id")
    filled = texts.select("node", "group", "rows", "text").mapInArrow(refill, "node binary, group binary, rows long, shingles binary")
    filled = cut_lineage(filled)
    sizes = groups.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = filled.dropDuplicates(["node"]).join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    units = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "node", "rows", "shingles", "block", "other", F.xxhash64("group", F.least("block", "other"), F.greatest("block", "other")).alias("unit")
    )
    found = cut_lineage(
        units.repartition("unit").sortWithinPartitions("unit").mapInArrow(linked(threshold), "node binary, root binary, links long")
    )
    forget(filled)
    classes = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    whole = nodes.drop("signature").join(links, "node", "left").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = whole.groupBy("root").agg(F.min("first").alias("class_id"))
    named = whole.join(lowest, "root").select("node", "class_id", (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return rows.select("doc_id", "node").join(named, "node", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def similarity_sql(threshold: float = 0.8) -> str:
    """The same by DuckDB: shared shingles of all pairs, then the closure of the links."""
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE c >= {threshold} * (nx.n + ny.n - c) - 1e-9
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
)
SELECT r.x AS doc_id, min(r.y) AS class_id, coalesce(any_value(k.n), 0) AS n_links
FROM r LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) k ON k.x = r.x GROUP BY r.x"""
