"""Codes of vectors: integer codebooks for the parts of a vector, entries found through a GNAT.

Components become ``floor(scale * x)``, vectors are cut into ``parts`` consecutive parts, and each part
position has a codebook that starts as that part of the ``entries`` smallest ids.  A round gives every
part its nearest entry (squared Euclidean distance, ties to the lower index) and replaces each
entry by the floor of the mean of its parts; entries without parts stay.

* Vectors stay where Spark has them.  A task reads Arrow batches, searches all parts and adds up
  sums and counts of its parts by entry; ``groupBy`` adds those of the tasks.  To the driver come at most
  ``parts * entries`` rows a round, whatever the input.
* The nearest entry is searched in a geometric near-neighbour access tree over the codebook: a node
  has split points, every other entry belongs to its nearest split point, and for each pair of a split point and
  a child the smallest and largest distance is kept.  A query that has found an entry at distance r, and
  lies at distance d from a split point, leaves out a child unless [d - r, d + r] meets the kept range.
  Kept ranges and differences are widened beyond any rounding, and only a strictly larger distance
  excludes, so no entry that ties is lost; distances are compared as integers, ties by index.
* Totals over equal labels are counted before any shuffle and joined so that a label of a third of all
  rows is no burden to one task.

Rows whose vector is null or holds null or non-finite components are left out.  So are, as nothing
comparable can be said of them, vectors of another length than the first one's (that of the smallest id), and vectors with
a component beyond the range in which distances of this length fit into 64 bits (about +-131 000 at 64
numbers).  Equal ids are rows of their own; the smallest are taken in order of (id, components), rows without
an id last.  If the length cannot be divided, cuts are at floor(k * length / parts).  Fewer vectors
than entries: fewer entries.  No vectors: no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import batches_of, cut_lineage, join_hot, only

#: Relative widening of distances before they are compared, far above any rounding of a square root.
MARGIN = 1e-9


def squares(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances, queries by points.

    Doubles hold all integers in between when the components are small; then the product is a fast one.
    """
    largest = max(int(np.abs(queries).max(initial=0)), int(np.abs(points).max(initial=0)))
    if 4 * largest * largest * max(1, queries.shape[1]) < 1 << 53:
        q, p = queries.astype(np.float64), points.astype(np.float64)
        return (np.einsum("ij,ij->i", q, q)[:, None] + np.einsum("ij,ij->i", p, p)[None] - 2 * (q @ p.T)).astype(np.int64)
    out = np.empty((len(queries), len(points)), np.int64)
    for k, point in enumerate(points):
        step = queries - point
        out[:, k] = np.einsum("ij,ij->i", step, step)
    return out


@dataclass
class Node:
    """Split points (indexes of entries), children, and distances from split points to the entries of each child."""

    splits: np.ndarray
    children: list[Node | None] = field(default_factory=list)
    low: np.ndarray | None = None
    high: np.ndarray | None = None


@dataclass
class Gnat:
    points: np.ndarray
    root: Node

    @staticmethod
    def build(points: np.ndarray, degree: int = 8, leaf: int = 12) -> Gnat:
        """Tree over integer points; of equal points only the first can be an answer."""
        _, first = np.unique(points, axis=0, return_index=True)
        return Gnat(points, Gnat._node(points, np.sort(first), degree, leaf))

    @staticmethod
    def _node(points: np.ndarray, members: np.ndarray, degree: int, leaf: int) -> Node:
        if len(members) <= leaf:
            return Node(members)
        chosen = [0]  # each next split point lies farthest from those before
        far = squares(points[members], points[members[:1]])[:, 0]
        while len(chosen) < degree:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, squares(points[members], points[members[chosen[-1:]]])[:, 0])
        splits, others = members[chosen], np.delete(members, chosen)
        distance = squares(points[others], points[splits])
        belongs = distance.argmin(axis=1)
        root = np.sqrt(distance.astype(np.float64))
        node = Node(splits, low=np.full((degree, degree), np.inf), high=np.full((degree, degree), -np.inf))
        for child in range(degree):
            mine = belongs == child
            if mine.any():
                node.low[:, child] = root[mine].min(axis=0) * (1 - MARGIN)
                node.high[:, child] = root[mine].max(axis=0) * (1 + MARGIN)
            node.children.append(Gnat._node(points, others[mine], degree, leaf) if mine.any() else None)
        return node

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest point of each query and its squared distance, ties to the lower index."""
        best = np.full(len(queries), np.iinfo(np.int64).max)
        index = np.full(len(queries), len(self.points))
        self._search(self.root, queries, np.arange(len(queries)), best, index)
        return index, best

    def _search(self, node: Node, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        distance = squares(queries[rows], self.points[node.splits])
        closest = distance.min(axis=1)
        # of equal distances the entry of the lowest index
        entry = np.where(distance == closest[:, None], node.splits[None], len(self.points)).min(axis=1)
        better = (closest < best[rows]) | ((closest == best[rows]) & (entry < index[rows]))
        best[rows[better]], index[rows[better]] = closest[better], entry[better]
        if not node.children:
            return
        root = np.sqrt(distance.astype(np.float64))
        home = distance.argmin(axis=1)
        for first in (True, False):  # everyone's nearest child first, then with the radius found there all others
            for child, below in enumerate(node.children):
                if below is None:
                    continue
                mine = np.flatnonzero((home == child) == first)
                radius = np.sqrt(best[rows[mine]].astype(np.float64))[:, None]
                slack = (root[mine] + radius) * MARGIN
                out = (root[mine] - radius > node.high[:, child] + slack) | (root[mine] + radius < node.low[:, child] - slack)
                mine = mine[~out.any(axis=1)]
                if len(mine):
                    self._search(below, queries, rows[mine], best, index)


def largest_component(length: int) -> int:
    """Components up to this keep every squared distance of whole vectors within 62 bits."""
    return math.isqrt((1 << 60) // max(1, length))


def whole_numbers(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, v) with v the integers of each usable vector."""

    def cast(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 4096):
            kept, rows = [], []
            for k, vector in enumerate(batch.column("v")):
                if vector.is_valid and vector.values.null_count == 0:
                    x = np.floor(vector.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                    if np.isfinite(x).all() and np.abs(x).max(initial=0) <= largest_component(len(x)):
                        kept.append(k)
                        rows.append(x.astype(np.int64))
            picked = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([picked.column("vec_id"), picked.column("label"), pa.array(rows, pa.list_(pa.int64()))], ["vec_id", "label", "v"])

    label = vectors.schema["label"].dataType.simpleString()
    named = only(vectors, vec_id="vec_id", label="label", v="embedding").withColumn("vec_id", F.col("vec_id").cast("long"))
    return named.mapInArrow(cast, f"vec_id long, label {label}, v array<bigint>")


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def cuts_of(length: int, parts: int) -> list[slice]:
    return [slice(k * length // parts, (k + 1) * length // parts) for k in range(parts)]


def part_sums(kept: DataFrame, books: list[np.ndarray], cuts: list[slice]) -> DataFrame:
    """(part, entry, n, total): how many parts each entry is nearest to, and their sum."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat.build(book) for book in books]
        sums, sizes = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches_of(batches, 4096):
            x = matrix(batch.column(0))
            for k, cut in enumerate(cuts):
                index, _ = trees[k].nearest(x[:, cut])
                np.add.at(sums[k], index, x[:, cut])
                sizes[k] += np.bincount(index, minlength=len(sizes[k]))
        for k in range(len(books)):
            used = np.flatnonzero(sizes[k])
            for z, component in enumerate(sums[k][used].T):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), k, np.int32)), pa.array(used.astype(np.int32)), pa.array(np.full(len(used), z, np.int32)), pa.array(sizes[k][used]), pa.array(component)],
                    ["part", "entry", "place", "n", "total"],
                )

    found = kept.select("v").mapInArrow(count, "part int, entry int, place int, n long, total long")
    return found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def train(kept: DataFrame, parts: int, entries: int, rounds: int) -> tuple[list[np.ndarray], list[slice]]:
    """Codebooks after all rounds; ``kept`` must have vectors of one length."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()
    start = np.array(first.column("v").to_pylist(), np.int64)
    cuts = cuts_of(start.shape[1], parts)
    books = [start[:, cut].copy() for cut in cuts]
    for _ in range(rounds):
        for r in part_sums(kept, books, cuts).toLocalIterator():
            books[r.part][r.entry, r.place] = int(r.total) // r.n
    return books, cuts


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place, as decimal numbers with commas between."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def code_rows(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for every usable row of (vec_id, embedding, label)."""
    if entries > 256:
        raise ValueError("a code has two hex digits a part: at most 256 entries")
    kept = cut_lineage(whole_numbers(vectors, scale))
    top = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v")).first()
    if top is None or top[0] == 0:
        return kept.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    kept = kept.filter(F.size("v") == top[0])
    books, cuts = train(kept, parts, entries, rounds)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat.build(book) for book in books]
        for batch in batches_of(batches, 4096):
            x = matrix(batch.column("v"))
            found = [tree.nearest(x[:, cut]) for tree, cut in zip(trees, cuts)]
            code = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
            error = sum(distance for _, distance in found)
            codes = pa.array([row.tobytes().hex() for row in code], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), codes, pa.array(error)], ["vec_id", "label", "code", "error"])

    label = kept.schema["label"].dataType.simpleString()
    coded = cut_lineage(kept.mapInArrow(encode, f"vec_id long, label {label}, code string, error long"))
    totals = cut_lineage(coded.groupBy("label").agg(F.count("*").alias("n"), F.try_sum("error").alias("label_error")))
    rows = totals.agg(F.sum("n")).first()[0]
    return join_hot(coded, totals, "label", rows).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The same by comparing every part with every entry; lengths must be divisible by ``parts``."""
    steps = [f"""WITH kept AS (SELECT vec_id, label, [CAST(floor({scale} * x::DOUBLE) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
          WHERE embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])),
        pieces AS (SELECT vec_id, label, k AS part, v[k * len(v) // {parts} + 1 : (k + 1) * len(v) // {parts}] AS v FROM kept, range({parts}) t(k)),
        book0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM pieces
          WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))"""]
    near = "arg_min(entry, (d, entry)) AS entry, min(d) AS d"
    distance = "CAST(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    for k in range(rounds + 1):
        steps.append(f"near{k} AS (SELECT vec_id, part, {near} FROM (SELECT p.vec_id, p.part, c.entry, {distance} AS d FROM pieces p JOIN book{k} c ON p.part = c.part) GROUP BY vec_id, part)")
        if k < rounds:
            steps.append(f"""sums{k} AS (SELECT part, entry, place, sum(x)::BIGINT AS s, count(*) AS n FROM
              (SELECT near{k}.part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM near{k} JOIN pieces USING (vec_id, part)) GROUP BY ALL),
            book{k + 1} AS (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN
              (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS v FROM sums{k} GROUP BY part, entry) m ON b.part = m.part AND b.entry = m.entry)""")
    return ",\n".join(steps) + f""",
        coded AS (SELECT vec_id, label, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
          FROM near{rounds} JOIN kept USING (vec_id) GROUP BY vec_id, label),
        hash AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS h FROM book{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded, hash"""
