"""Exact filtered nearest neighbours, parent de-duplication and hybrid re-ranking."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern.config import DEFAULT, EngineConfig
from lectern.functions import names
from lectern.functions.text import count_occurrences
from lectern.operators.lineage import cut_lineage
from lectern.operators.skew import first_per_key, first_rows_per_key


def cosine_distance(vector: Column | str, query: Sequence[float]) -> Column:
    """1 - cosine, on whole Arrow batches; a vector of length zero has distance 1.

    Only the vector column is sent to the Python worker, and its buffer is used in place.
    """
    q = np.asarray(query, dtype=np.float64)
    q_unit = q / (np.linalg.norm(q) or 1.0)

    @F.arrow_udf("double")
    def distance(batch: pa.Array) -> pa.Array:
        filled = batch.drop_null()
        flat = filled.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        if len(flat) != len(filled) * len(q_unit):
            raise ValueError(f"vectors of {len(q_unit)} components expected")
        m = flat.reshape(len(filled), len(q_unit))
        norms = np.sqrt(np.einsum("ij,ij->i", m, m))
        dots = np.einsum("ij,j->i", m, q_unit)
        cos = np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)
        out = np.full(len(batch), np.nan)
        present = batch.is_valid().to_numpy(zero_copy_only=False)
        # equal vectors tie, whatever batch they came in
        out[present] = np.round(1.0 - cos, 12) + 0.0
        return pa.array(out, mask=~present)

    return distance(F.col(vector) if isinstance(vector, str) else vector)


def metadata_filter(df: DataFrame, gi_type: str | None = None, gi_names: Sequence[str] | None = None) -> DataFrame:
    """Equality on the type, membership on the name; an absent condition filters nothing."""
    if gi_type:
        df = df.filter(F.col("gi_type") == gi_type)
    if gi_names:
        df = df.filter(F.col("gi_name") == gi_names[0] if len(gi_names) == 1 else F.col("gi_name").isin(*gi_names))
    return df


def nearest(
    df: DataFrame, query: Sequence[float], k: int, vector: str = "embedding", id_col: str = "chunk_id"
) -> DataFrame:
    """The ``k`` nearest rows: every task keeps a heap of ``k`` rows, nothing else is moved."""
    scored = df.filter(F.col(vector).isNotNull()).withColumn("distance", cosine_distance(vector, query))
    return scored.drop(vector).orderBy("distance", id_col).limit(k)


def nearest_per_collection(
    chunks: DataFrame,
    query: Sequence[float],
    k: int,
    collections: Sequence[object] | None = None,
    by: str = "country",
    vector: str = "embedding",
    id_col: str = "chunk_id",
) -> DataFrame:
    """Up to ``k`` rows of each collection, numbered in the order of ``collections`` (None: all there are, in their order).

    One scan of ids, collections and vectors keeps ``k`` rows a collection in each task; the other
    columns are fetched for the rows that are left.
    """
    if collections is not None:
        chunks = chunks.filter(F.col(by).isin(*collections)) if collections else chunks.limit(0)
    scored = chunks.filter(F.col(vector).isNotNull()).select(id_col, by, cosine_distance(vector, query).alias("distance"))
    hits = first_rows_per_key(scored, [by], ["distance", id_col], k)
    if collections is None:
        place = F.dense_rank().over(Window.orderBy(by)) - 1
    else:
        place = F.array_position(F.array(*[F.lit(c) for c in collections] or [F.lit(None)]), F.col(by)).cast("int") - 1
    hits = hits.withColumn("collection_ord", place.cast("int"))
    # at most k rows a collection
    return chunks.drop(vector).join(F.broadcast(hits.drop(by)), id_col)


class _Nearest:
    """The ``k`` nearest ids of every question in every collection, filled batch by batch."""

    def __init__(self, matrix: np.ndarray, k: np.ndarray, names: list[frozenset | None]):
        lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
        self.unit, self.k, self.names = matrix / np.where(lengths > 0, lengths, 1.0), k, names
        self.best: dict[object, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.limit: dict[object, np.ndarray] = {}

    def add(self, ids: np.ndarray, collections: list, names: list, vectors: np.ndarray) -> None:
        lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
        # equal vectors tie, whatever batch they came in
        distance = np.round(1.0 - (vectors / np.where(lengths > 0, lengths, 1.0)) @ self.unit.T, 12) + 0.0
        places: dict[object, list[int]] = {}
        for row, c in enumerate(collections):
            places.setdefault(c, []).append(row)
        for c, found in places.items():
            rows = np.array(found)
            if c not in self.best:
                self.best[c] = [(np.zeros(0), ids[:0]) for _ in self.k]
                self.limit[c] = np.full(len(self.k), np.inf)
            here, limit = distance[rows], self.limit[c]
            for q in np.flatnonzero((here <= limit).any(axis=0)):
                near = rows[here[:, q] <= limit[q]]
                if self.names[q] is not None:
                    near = near[[names[r] in self.names[q] for r in near.tolist()]]
                d, i = self.best[c][q]
                d, i = np.concatenate([d, distance[near, q]]), np.concatenate([i, ids[near]])
                order = np.lexsort((i, d))[: self.k[q]]
                self.best[c][q] = d[order], i[order]
                if len(order) == self.k[q]:
                    limit[q] = d[order[-1]]

    def rows(self) -> Iterator[tuple[int, object, object, float]]:
        for c, questions in self.best.items():
            for q, (d, i) in enumerate(questions):
                yield from ((q, c, chunk, near) for near, chunk in zip(d.tolist(), i.tolist()))


def nearest_for_each(
    chunks: DataFrame,
    questions: DataFrame,
    collections: Sequence[object] | None = None,
    by: str = "country",
    vector: str = "embedding",
    id_col: str = "chunk_id",
    name_col: str = "gi_name",
    block: int = 2048,
) -> DataFrame:
    """(question_id, ``by``, ``id_col``, distance): the nearest rows of each collection for every question.

    ``questions`` has question_id (once each), query (a vector), k, and gi_names, to which rows are
    restricted unless it is null or empty.  A matrix product a batch serves all questions of a block; each
    task keeps k rows a question and collection and only those are shuffled.  A block, which is what a task
    is sent, has about ``block`` questions, and there is one scan a block.
    """
    if collections is not None:
        chunks = chunks.filter(F.col(by).isin(*collections)) if collections else chunks.limit(0)
    have = name_col if name_col in chunks.columns else None
    scanned = chunks.filter(F.col(vector).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(by).alias("_by"), (F.col(have) if have else F.lit(None).cast("string")).alias("_name"), F.col(vector).alias("_vector")
    )
    asked = cut_lineage(questions.select("question_id", "query", F.col("k").cast("int").alias("k"), F.col("gi_names").cast("array<string>").alias("gi_names")))
    blocks = -(-asked.count() // block)
    kinds = {f.name: f.dataType.simpleString() for f in scanned.schema}
    schema = f"_q int, _by {kinds['_by']}, _id {kinds['_id']}, distance double"
    found = None
    for b in range(max(1, blocks)):
        part = asked.filter(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == b) if blocks > 1 else asked
        part = part.orderBy("question_id")
        rows = part.select("query", "k", "gi_names").toArrow().to_pylist()
        if not rows:
            continue
        shared = chunks.sparkSession.sparkContext.broadcast((np.array([r["query"] for r in rows], np.float64), np.array([r["k"] for r in rows]), [frozenset(r["gi_names"]) if r["gi_names"] else None for r in rows]))

        def search(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matrix, k, names_ = shared.value
            kept = _Nearest(matrix, k, names_)
            step = max(1, (1 << 22) // len(matrix))
            ids, sides = pa.array([], pa.string()).type, None
            for whole in batches:
                ids, sides = whole.schema.field("_id").type, whole.schema.field("_by").type
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    flat = batch.column("_vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    if len(flat) != batch.num_rows * matrix.shape[1]:
                        raise ValueError(f"vectors of {matrix.shape[1]} components expected")
                    kept.add(np.array(batch.column("_id").to_pylist()), batch.column("_by").to_pylist(), batch.column("_name").to_pylist(), flat.reshape(batch.num_rows, -1))
            out = list(kept.rows())
            if out:
                q, c, i, d = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(c, sides), pa.array(i, ids), pa.array(d, pa.float64())], ["_q", "_by", "_id", "distance"])

        numbered = part.select("question_id", "k", (F.row_number().over(Window.orderBy("question_id")) - 1).alias("_q"))  # a block of questions
        hits = scanned.mapInArrow(search, schema).join(numbered, "_q")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = scanned.limit(0).join(asked.limit(0).withColumn("distance", F.lit(0.0)), F.lit(True))
    w = Window.partitionBy("question_id", "_by").orderBy("distance", "_id")
    best = found.withColumn("_rn", F.row_number().over(w)).filter("_rn <= k")
    return best.select("question_id", F.col("_by").alias(by), F.col("_id").alias(id_col), "distance")


def _best_order(hits: DataFrame, id_col: str) -> list[str]:
    return [c for c in ("distance", "collection_ord", id_col) if c in hits.columns]


def best_per_parent(hits: DataFrame, k: int, id_col: str = "chunk_id", parent_col: str = "parent_id") -> DataFrame:
    """Closest row of each parent (or of the row itself without one), then the ``k`` closest."""
    key = F.coalesce(F.nullif(F.col(parent_col), F.lit("")), F.col(id_col))
    order = _best_order(hits, id_col)
    return first_per_key(hits, [key], order).orderBy(*order).limit(k)


def best_per_parent_of_each(hits: DataFrame, id_col: str = "chunk_id", parent_col: str = "parent_id") -> DataFrame:
    """The same for every question_id, which brings its own ``k``."""
    key = F.coalesce(F.nullif(F.col(parent_col), F.lit("")), F.col(id_col))
    order = _best_order(hits, id_col)
    best = first_per_key(hits, ["question_id", key], order)
    return best.withColumn("_rn", F.row_number().over(Window.partitionBy("question_id").orderBy(*order))).filter("_rn <= k").drop("_rn")


def with_parent_text(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Replace the text of a hit by that of its parent where there is one.

    The hits are written first: they are needed twice, and their size is then known, so the planner decides
    what is sent to whom when the parents table is scanned.
    """
    hits = cut_lineage(hits)
    ids = hits.select("parent_id").filter("parent_id <> ''").distinct()
    found = parents.join(ids, "parent_id").select(
        "parent_id", F.col("markdown").alias("_text"), F.col("section").alias("parent_section")
    )
    return (
        hits.join(found, "parent_id", "left")
        .withColumn("document", F.coalesce("_text", "document"))
        .drop("_text")
    )


def keyword_hits(text: Column, keywords: Column) -> Column:
    return F.aggregate(keywords, F.lit(0), lambda acc, k: acc + count_occurrences(text, k))


def hybrid_score(
    document: Column,
    section: Column,
    name: Column,
    distance: Column,
    keywords: Column,
    gi_names: Column,
    cfg: EngineConfig = DEFAULT,
) -> Column:
    """Weighted vector closeness and keyword share, plus a bonus when the name fits."""
    text = F.concat(F.lower(document), F.lit(" "), F.lower(section))
    share = F.least(keyword_hits(text, keywords) / F.greatest(F.size(keywords), F.lit(1)), F.lit(1.0))
    closeness = F.greatest(F.lit(0.0), 1 - F.coalesce(distance, F.lit(1.0)))
    stored = F.replace(F.lower(name), F.lit("_"), F.lit(" "))

    def fits(wanted: Column) -> Column:
        low = F.replace(F.lower(wanted), F.lit("_"), F.lit(" "))
        return F.contains(stored, low) | F.contains(low, stored)

    bonus = F.when(F.exists(gi_names, fits), F.lit(cfg.bonus_name)).otherwise(F.lit(0.0))
    return cfg.weight_vector * closeness + cfg.weight_keywords * share + bonus


def string_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def rerank(
    hits: DataFrame,
    question: str,
    top_k: int,
    gi_names: Sequence[str] = (),
    cfg: EngineConfig = DEFAULT,
    id_col: str = "chunk_id",
) -> DataFrame:
    """Re-order retrieved hits and keep ``top_k``; no more than ``top_k`` hits stay as they are.

    ``hits`` comes from :func:`best_per_parent`, so it holds a bounded number of rows.
    """
    return _ranked(hits, F.lit(question), string_array(gi_names), F.lit(top_k), [], cfg, id_col)


def rerank_each(hits: DataFrame, cfg: EngineConfig = DEFAULT, id_col: str = "chunk_id") -> DataFrame:
    """The same for every question_id, with the columns question, gi_names and top_k."""
    return _ranked(hits, F.col("question"), F.col("gi_names"), F.col("top_k"), ["question_id"], cfg, id_col)


def _ranked(hits: DataFrame, question: Column, wanted: Column, top_k: Column, within: list[str], cfg: EngineConfig, id_col: str) -> DataFrame:
    whole = Window.partitionBy(*within)
    keywords = names.query_keywords(question, wanted, cfg.stop_words, cfg.bilingual)
    order = _best_order(hits, id_col)
    scored = (
        hits.withColumn("_k", keywords)
        .withColumn(
            "score",
            hybrid_score(F.col("document"), F.col("section"), F.col("gi_name"), F.col("distance"), F.col("_k"), wanted, cfg),
        )
        .drop("_k")
        .withColumn("_pos", F.row_number().over(whole.orderBy(*order)))
        .withColumn("_n", F.count("*").over(whole.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    by_score = F.when(F.col("_n") > top_k, -F.col("score")).otherwise(F.lit(0.0))
    ranked = scored.withColumn("ref", F.row_number().over(whole.orderBy(by_score, "_pos")))
    return ranked.filter(F.col("ref") <= top_k).drop("_pos", "_n")


def citations(ranked: DataFrame) -> DataFrame:
    fields = ("gi_name", "gi_type", "section", "source_file", "country")
    return ranked.select(
        F.col("ref").cast("string").alias("ref"),
        *[F.coalesce(F.col(f), F.lit("")).alias(f) for f in fields],
    )


def context_block() -> Column:
    """``[ref] name (type) — section — file`` and the text below it."""
    def known(field: str) -> Column:
        return F.coalesce(F.col(field), F.lit("?"))

    label = F.concat(
        F.lit("["), F.col("ref").cast("string"), F.lit("] "), known("gi_name"), F.lit(" ("), known("gi_type"),
        F.lit(") — "), known("section"), F.lit(" — "), known("source_file"),
    )
    return F.concat(label, F.lit("\n"), F.col("document"))


def context_of() -> Column:
    """All blocks of a ranked result (at most ``top_k`` rows) in one text, an aggregate."""
    blocks = F.array_sort(F.collect_list(F.struct(F.col("ref"), context_block().alias("block"))))
    return F.array_join(F.transform(blocks, lambda b: b["block"]), V.CONTEXT_SEPARATOR)


def context_text(ranked: DataFrame) -> DataFrame:
    return ranked.agg(context_of().alias("context"))
