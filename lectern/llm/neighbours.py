"""Approximate nearest neighbours: a neighbour graph by NN-descent and greedy search on it.

**Nodes.**  Equal vectors are one node with its smallest ids, so copies cost nothing.  Largest inner
product becomes nearest direction by one more coordinate that brings all vectors to one length.
**First graph.**  Nodes are put in the order of a random-projection code, in range partitions; a task
splits stretches of them by further random projections into small leaves and compares within these.
**Descent.**  A round joins each node's neighbours, forward and reverse, with each other: edges are
joined with the vectors of their ends, once per cell of neighbouring nodes rather than once per
edge, and pairs better than what a node has are sent to it, many in a row.  A node with very many reverse
neighbours is split into several units, none is dropped.  Rounds end when few lists change.
**Search.**  A query starts at its own node's neighbours or at entry nodes; each hop expands its
best unexpanded nodes by joins with the graph and with the vectors, until none of its best
``beam`` nodes is unexpanded.  Scores are inner products of the original vectors in double precision.

Rows without an id or whose vector is null, zero, or has a null or non-finite component take no part.
Vectors of another length than most are no neighbours of the others and also take no part.
Repeated rows are neighbours of each other.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import batches_of, cut_lineage, groups_in_order, only

LISTS = "node long, cell long, u binary, near array<long>, sims array<float>, fresh array<boolean>"
#: Candidates of many nodes in one row: (node, near, sims) flat, by the bucket of the nodes.
PACKED = "bucket long, node array<long>, near array<long>, sims array<float>"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a binary column as float32 vectors."""
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), np.float32).reshape(len(data), -1) if data else np.zeros((0, 1), np.float32)


def valid_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec, square, node) of the rows that take part."""
    x = F.transform("embedding", lambda v: v.cast("float"))
    good = F.size("x") > 0
    good &= F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("x", lambda v: v != 0)
    rows = only(vectors, vec_id=F.col("vec_id").cast("long"), x=x).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & good)

    def binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 8192):
            lists = batch.column("x").to_pylist()
            arrays = [np.array(v, np.float32) + np.float32(0) for v in lists]  # no negative zero
            squares = pa.array([float(np.dot(a.astype(np.float64), a)) for a in arrays], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([a.tobytes() for a in arrays], pa.binary()), squares], names=["vec_id", "vec", "square"]
            )

    return rows.mapInArrow(binary, "vec_id long, vec binary, square double").withColumn("node", F.xxhash64("vec"))


def vector_nodes(vectors: DataFrame, keep: int) -> DataFrame:
    """(node, vec, ids, square): one row a distinct vector with its ``keep`` smallest ids."""
    rows = valid_rows(vectors)
    first = Window.partitionBy("node").orderBy("vec_id")
    rows = rows.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= keep)
    nodes = rows.groupBy("node").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("square").alias("square"))
    nodes = cut_lineage(nodes)
    usual = nodes.groupBy(F.length("vec").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    return nodes.filter(F.length("vec") == usual.n) if usual else nodes


def _lifted(batch_vec: np.ndarray, square: np.ndarray, longest: float) -> np.ndarray:
    """All vectors at length one, ordered by inner product as before."""
    rest = np.sqrt(np.maximum(longest - square, 0)).astype(np.float32)
    return np.column_stack([batch_vec, rest]) / np.float32(np.sqrt(longest))


def with_codes(nodes: DataFrame, seeds: Iterable[int]) -> DataFrame:
    """Lifted vectors ``u`` and a random-projection code of 62 signs for each seed."""
    longest = nodes.agg(F.max("square")).first()[0] or 1.0
    seeds = list(seeds)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 8192):
            u = _lifted(_matrix(batch.column("vec")), batch.column("square").to_numpy(), longest)
            codes = []
            for s in seeds:
                planes = np.random.default_rng(s).standard_normal((u.shape[1], 62)).astype(np.float32)
                codes.append(pa.array(((u @ planes > 0).astype(np.int64) << np.arange(61, -1, -1)).sum(axis=1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([r.tobytes() for r in u.astype(np.float32)], pa.binary()), *codes],
                names=["node", "u", *[f"code{s}" for s in seeds]],
            )

    return cut_lineage(nodes.select("node", "vec", "square").mapInArrow(code, "node long, u binary, " + ", ".join(f"code{s} long" for s in seeds)))


def _best(x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest others of each row among the rows."""
    sims = x @ x.T
    np.fill_diagonal(sims, -np.inf)
    k = min(k, len(x) - 1)
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(x), 0), np.int64)
    return ids[top], np.take_along_axis(sims, top, axis=1)


def _tree(x: np.ndarray, leaf: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Row numbers split at the median of random projections until few are left."""
    todo = [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            yield rows
            continue
        a, b = x[rng.choice(rows, 2, replace=False)]
        order = rows[np.argsort(x[rows] @ (a - b), kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]


def packed(node: np.ndarray, near: np.ndarray, sims: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Candidates as one row a bucket."""
    bucket = bucket_of(node, buckets)
    order = np.argsort(bucket, kind="stable")
    heads, counts = np.unique(bucket, return_counts=True)
    cuts = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    lists = [pa.ListArray.from_arrays(cuts, pa.array(x[order])) for x in (node, near, sims.astype(np.float32))]
    return pa.RecordBatch.from_arrays([pa.array(heads), *lists], names=["bucket", "node", "near", "sims"])


def bucket_of(node: np.ndarray, buckets: int) -> np.ndarray:
    return (node & 0x7FFFFFFF) % buckets


def first_lists(coded: DataFrame, seed: int, k: int, leaf: int, stretch: int, buckets: int) -> DataFrame:
    """``PACKED`` candidates within leaves of one random-projection forest."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            ids, x = table.column("node").to_numpy(), _matrix(table.column("u"))
            found = []
            for rows in _tree(x, leaf, np.random.default_rng(seed)):
                near, sims = _best(x[rows], ids[rows], k)
                found.append((np.repeat(ids[rows], near.shape[1]), near.ravel(), sims.ravel()))
            yield packed(*(np.concatenate(c) for c in zip(*found)), buckets)

        for batch in batches_of(batches, 1024):
            held.append(batch)
            if sum(b.num_rows for b in held) >= stretch:
                yield from out()
                held = []
        if held:
            yield from out()

    ordered = coded.select("node", "u", f"code{seed}").repartitionByRange(f"code{seed}").sortWithinPartitions(f"code{seed}")
    return ordered.mapInArrow(grow, PACKED)


def best_lists(lists: DataFrame, candidates: DataFrame, k: int, buckets: int) -> DataFrame:
    """``lists`` with the k best distinct neighbours of each node among its own and the ``PACKED`` candidates; those not had before are fresh."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_in_order(batches, ["bucket"]):
            own = table.filter(pc.is_valid(table.column("own"))).sort_by("own")
            ids = own.column("own").to_numpy()
            lengths = pc.list_value_length(table.column("near")).to_numpy()
            old = np.repeat(table.column("own").is_valid().to_numpy(), lengths)
            node, near, sims = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("node", "near", "sims"))
            order = np.lexsort((~old, near, node))
            node, near, sims, old = node[order], near[order], sims[order], old[order]
            new = np.ones(len(node), bool)
            new[1:] = (node[1:] != node[:-1]) | (near[1:] != near[:-1])
            node, near, sims, old = node[new], near[new], sims[new], old[new]
            order = np.lexsort((near, -sims, node))
            node, near, sims, old = node[order], near[order], sims[order], old[order]
            at = np.searchsorted(node, ids)
            counts = np.minimum(np.searchsorted(node, ids, "right") - at, k)
            keep = np.repeat(at - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            cuts = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            made = [pa.ListArray.from_arrays(cuts, pa.array(v[keep])) for v in (near, sims.astype(np.float32), ~old)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), own.column("cell").combine_chunks(), own.column("u").combine_chunks(), *made], names=["node", "cell", "u", "near", "sims", "fresh"]
            )

    bucket = F.pmod(F.col("node").bitwiseAND(0x7FFFFFFF), F.lit(buckets))
    mine = lists.select(bucket.alias("bucket"), F.array_repeat("node", F.size("near")).alias("node"), "near", "sims", F.col("node").alias("own"), "cell", "u")
    both = mine.unionByName(candidates, allowMissingColumns=True).repartition("bucket").sortWithinPartitions("bucket")
    return cut_lineage(both.select("bucket", "node", "near", "sims", "own", "cell", "u").mapInArrow(merge, LISTS))


def _with_vectors(asked: DataFrame, nodes: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    """The vectors of the nodes that cells ask for, once a cell; the cell is called ``home``."""
    return asked.select(F.col("cell").alias("home"), "node").distinct().join(nodes.select("node", "u", *(extra or [])), "node")


def descend(lists: DataFrame, k: int, unit: int, buckets: int) -> DataFrame:
    """``PACKED`` candidates from one round of NN-descent."""
    edges = lists.select("node", "cell", F.explode(F.arrays_zip("near", "fresh")).alias("e"))
    forward = edges.select("cell", "node", F.lit(0).alias("part"), F.col("e.near").alias("other"), F.col("e.fresh").alias("fresh"))
    # further parts of a node with very many reverse neighbours are cells of their own
    reverse = edges.select(F.col("e.near").alias("node"), F.col("node").alias("other"), F.col("e.fresh").alias("fresh"))
    parts = F.ceil(F.count("*").over(Window.partitionBy("node")) / (64 * unit))
    reverse = reverse.withColumn("part", F.pmod(F.xxhash64("other"), parts).cast("int")).join(lists.select("node", "cell"), "node")
    reverse = reverse.withColumn("cell", F.when(F.col("part") == 0, F.col("cell")).otherwise(F.xxhash64("node", "part")))
    members = cut_lineage(forward.unionByName(reverse.select("cell", "node", "part", "other", "fresh")))
    floor = F.when(F.size("sims") >= k, F.array_min("sims")).otherwise(F.lit(-2.0)).cast("float").alias("floor")
    ends = _with_vectors(members.select("cell", F.col("other").alias("node")), lists, [floor])

    def local(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, x = right.column("node").to_numpy(), _matrix(right.column("u"))
        order = np.argsort(ids)
        ids, x, floor = ids[order], x[order], right.column("floor").to_numpy()[order]
        at = np.searchsorted(ids, left.column("other").to_numpy())
        owner, fresh = left.column("node").to_numpy(), left.column("fresh").to_numpy()
        order = np.argsort(owner, kind="stable")
        at, fresh, owner = at[order], fresh[order], owner[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        cuts = np.flatnonzero((owner[1:] != owner[:-1]) | (place[1:] % (2 * unit) == 0)) + 1
        found_a, found_b, found_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for members_, news in zip(np.split(at, cuts), np.split(fresh, cuts)):
            m, where = np.unique(members_, return_inverse=True)
            isnew = np.zeros(len(m), bool)
            isnew[where[news]] = True
            if not isnew.any():
                continue
            sims = x[m] @ x[m].T
            worth = (sims > floor[m][:, None]) & (isnew[:, None] | isnew[None])
            np.fill_diagonal(worth, False)
            i, j = np.nonzero(worth)
            found_a.append(m[i]), found_b.append(m[j]), found_s.append(sims[i, j])
        a, b, s = np.concatenate(found_a), np.concatenate(found_b), np.concatenate(found_s)
        _, one = np.unique(a * max(1, len(ids)) + b, return_index=True)
        a, b, s = a[one], b[one], s[one]
        order = np.lexsort((-s, a))
        a, b, s = a[order], b[order], s[order]
        _, starts, counts = np.unique(a, return_index=True, return_counts=True)
        keep = np.arange(len(a)) - np.repeat(starts, counts) < k
        return pa.Table.from_batches([packed(ids[a[keep]], ids[b[keep]], s[keep], buckets)])

    return members.groupBy("cell").cogroup(ends.groupBy("home")).applyInArrow(local, PACKED)


def neighbour_graph(
    coded: DataFrame, k: int = 48, trees: int = 3, rounds: int = 4, leaf: int = 160, stretch: int = 16_384, unit: int = 96, cell_nodes: int = 1024, change: float = 0.05
) -> DataFrame:
    """``LISTS`` of the k nearest neighbours found for every node."""
    seeds = [int(c[4:]) for c in coded.columns if c.startswith("code")][:trees]
    total = coded.count()
    buckets = max(16, total // 2048)
    candidates = first_lists(coded, seeds[0], k, leaf, stretch, buckets)
    for s in seeds[1:]:
        candidates = candidates.unionByName(first_lists(coded, s, k, leaf, stretch, buckets))
    none = [F.array().cast(t).alias(c) for c, t in (("near", "array<long>"), ("sims", "array<float>"), ("fresh", "array<boolean>"))]
    start = coded.join(in_cells(coded, f"code{seeds[0]}", cell_nodes), "node").select("node", "cell", "u", *none)
    lists = best_lists(start, candidates, k, buckets)
    for _ in range(rounds):
        lists = best_lists(lists, descend(lists, k, unit, buckets), k, buckets)
        fresh = lists.agg(F.sum(F.size(F.filter("fresh", lambda f: f)))).first()[0] or 0
        if fresh <= change * k * total:
            break
    return lists


def with_orphans(lists: DataFrame, k: int, least: int = 8, tries: int = 8) -> DataFrame:
    """(node, near) for the search: lists with those nodes added that fewer than ``least`` others list.

    Such a node is added to the lists of its nearest neighbours, ``k`` to a list at most, the nearest first.
    """
    listed = lists.select(F.explode("near").alias("node")).groupBy("node").agg(F.count("*").alias("times"))
    orphans = lists.join(listed, "node", "left").filter(F.coalesce("times", F.lit(0)) < least)
    pairs = orphans.select("node", F.posexplode(F.slice("near", 1, tries)).alias("at", "host"), "sims").select("host", "node", F.get("sims", F.col("at")).alias("sim"))
    best = Window.partitionBy("host").orderBy(F.col("sim").desc(), "node")
    added = pairs.withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= k).groupBy("host").agg(F.collect_list("node").alias("more"))
    return lists.join(added.withColumnRenamed("host", "node"), "node", "left").select(
        "node", F.array_union("near", F.coalesce("more", F.array().cast("array<long>"))).alias("near")
    )


def in_cells(rows: DataFrame, code: str, size: int, key: str = "node") -> DataFrame:
    """(key, cell): stretches of ``size`` rows in the order of a code, so that a cell holds rows near each other."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(part + (at + np.arange(batch.num_rows)) // size)], names=[key, "cell"])
            at += batch.num_rows

    ordered = rows.select(key, code).repartitionByRange(code, key).sortWithinPartitions(code, key)
    return cut_lineage(ordered.mapInArrow(number, f"{key} long, cell long"))


STATE = "query long, cell long, q binary, near array<long>, sims array<float>, done array<boolean>"


def search(queries: DataFrame, lists: DataFrame, beam: int = 160, expand: int = 160) -> DataFrame:
    """(query, near): the ``beam`` best nodes found for each of ``queries`` (query, cell, q, start).

    ``q`` is the query in the space of ``lists.u`` and ``start`` the nodes where its search begins.
    """

    def advance(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, x = right.column("node").to_numpy(), _matrix(right.column("u"))
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        out: list[tuple] = []
        for row in left.to_pylist():
            near, sims, done = row["near"], row["sims"], row["done"]
            fresh = np.array(sorted(set(row["asked"] or []) - set(near)), np.int64)
            at = np.searchsorted(ids, fresh)
            at, fresh = at[at < len(ids)], fresh[at < len(ids)]
            at, fresh = at[ids[at] == fresh], fresh[ids[at] == fresh]
            scores = x[at] @ np.frombuffer(row["q"], np.float32)
            done = [d or n in row["chosen"] for n, d in zip(near, done)]
            merged = sorted([*zip([-s for s in sims], near, done), *zip((-scores).tolist(), fresh.tolist(), [False] * len(fresh))])[:beam]
            out.append((row["query"], row["cell"], row["q"], [n for _, n, _ in merged], [-s for s, _, _ in merged], [d for *_, d in merged]))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_())]
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, kinds)], names=["query", "cell", "q", "near", "sims", "done"])

    def step(asking: DataFrame) -> DataFrame:
        asked = asking.select("cell", F.explode("asked").alias("node"))
        return cut_lineage(asking.groupBy("cell").cogroup(_with_vectors(asked, lists).groupBy("home")).applyInArrow(advance, STATE))

    none = {"near": "array<long>", "sims": "array<float>", "done": "array<boolean>", "chosen": "array<long>"}
    graph = cut_lineage(with_orphans(lists, beam // 3))
    state = step(queries.select("query", "cell", "q", F.col("start").alias("asked"), *[F.array().cast(t).alias(c) for c, t in none.items()]))
    ended = []
    while True:
        opened = F.filter(F.arrays_zip("near", "done"), lambda e: ~e["done"])
        state = state.withColumn("chosen", F.transform(F.slice(opened, 1, expand), lambda e: e["near"]))
        ended.append(state.filter(F.size("chosen") == 0).select("query", "near"))
        going = state.filter(F.size("chosen") > 0)
        if going.isEmpty():
            break
        hops = going.select("query", F.explode("chosen").alias("node")).join(graph.select("node", F.col("near").alias("next")), "node")
        asked = hops.groupBy("query").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("asked"))
        state = step(going.join(asked, "query", "left").withColumn("asked", F.coalesce("asked", F.array().cast("array<long>"))))
    out = ended[0]
    for e in ended[1:]:
        out = out.unionByName(e)
    return out


def nearest(vectors: DataFrame, wanted: Column, k: int = 20, beam: int = 160, expand: int = 160, graph_k: int = 48, trees: int = 3) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row of ``vectors`` (vec_id, embedding) that ``wanted`` picks by ``vec_id``."""
    nodes = vector_nodes(vectors, k + 1)
    if nodes.isEmpty():
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    coded = with_codes(nodes, range(trees))
    lists = neighbour_graph(coded, graph_k, trees)
    asking = cut_lineage(query_rows(vectors, wanted))
    own = asking.select("node").distinct().join(nodes.select("node", "vec"), "node")
    cells = in_cells(coded.join(own.select("node"), "node", "left_semi"), "code0", 256)

    def lift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a query has no rest coordinate; its length doesn't matter
            data = [v + b"\0\0\0\0" for v in batch.column("vec").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(data, pa.binary())], names=["query", "q"])

    lifted = own.mapInArrow(lift, "query long, q binary").join(cells.withColumnRenamed("node", "query"), "query")
    starts = lifted.join(lists.select(F.col("node").alias("query"), "near"), "query", "left").withColumn(
        "start", F.array_distinct(F.concat(F.array("query"), F.coalesce("near", F.array().cast("array<long>"))))
    )
    found = search(starts.select("query", "cell", "q", "start"), lists, max(beam, k + 1), expand)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _matrix(batch.column("vec")).astype(np.float64), _matrix(batch.column("q")).astype(np.float64)
            score = pa.array((a * b).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("query"), score, batch.column("ids")], names=["query", "score", "ids"])

    pairs = found.select("query", F.explode("near").alias("node")).join(nodes.select("node", "vec", "ids"), "node")
    pairs = pairs.join(own.select(F.col("node").alias("query"), F.col("vec").alias("q")), "query").select("query", "vec", "q", "ids")
    scored = pairs.mapInArrow(measure, "query long, score double, ids array<long>").select("query", "score", F.explode("ids").alias("vec_id"))
    order = [F.col("score").desc(), F.col("vec_id")]
    best = scored.withColumn("_k", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("_k") <= k + 1)
    rows = asking.join(best.drop("_k").withColumnRenamed("query", "node"), "node").filter("vec_id <> query_id")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("int"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query_rows(vectors: DataFrame, wanted: Column) -> DataFrame:
    """(query_id, node) of the rows that are searched for."""
    return valid_rows(vectors.filter(wanted)).select(F.col("vec_id").alias("query_id"), "node").distinct()
