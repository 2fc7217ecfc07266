"""Finding known names in texts without comparing every name with every text.

A name is contained in a text only if each of its pieces of four bytes is.  The pieces of all names are
counted in the texts, every name is keyed by its rarest one, and only where a text holds such a piece its
surroundings, as far as a name can reach, are sent to the names of that piece and compared.  Texts
themselves stay where they are; frequent pieces are never a key unless a name has no other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern.functions.text import fold_accents
from lectern.operators.lineage import cut_lineage, let_workers_import
from lectern.operators.skew import first_per_key

#: Bytes of a piece; a shorter name is a piece of its own.
WIDTH = 4
#: Counts and keys are kept by a hash of the piece: tables of this many entries, whatever the lexicon.
BUCKETS = 1 << 20
_STEP = 1 << 22


def _hashed(pieces: np.ndarray, width: int) -> np.ndarray:
    return ((pieces * np.uint32(2654435761) + np.uint32(width)) >> np.uint32(12)).astype(np.int64)


def _pieces(data: np.ndarray, width: int) -> np.ndarray:
    """The number that each ``width`` bytes in a row make."""
    out = np.zeros(max(0, len(data) - width + 1), np.uint32)
    for k in range(width):
        out |= data[k : k + len(out)].astype(np.uint32) << np.uint32(8 * k)
    return out


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column of texts, nulls as empty ones."""
    filled = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = filled.buffers()
    at = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None and len(filled) else np.zeros(0, np.uint8)


def _positions(column: pa.Array, widths: Sequence[int], wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """For stretches of the column's bytes: (text's number, position, piece, bucket) of pieces within one text whose bucket is wanted."""
    at, data = _bytes_of(column)
    for start in range(int(at[0]), int(at[-1]), _STEP):
        for width in widths:
            pieces = _pieces(data[start : min(start + _STEP + width - 1, int(at[-1]))], width)
            buckets = _hashed(pieces, width)
            hit = np.flatnonzero(wanted[buckets])
            row = np.searchsorted(at, hit + start, side="right") - 1
            inside = hit + start + width <= at[row + 1]
            hit = hit[inside]
            yield row[inside], hit + start, pieces[hit], buckets[hit], width


def _piece_rows(names: DataFrame) -> DataFrame:
    """(name, place, width, piece, bucket) for every piece of every name."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.ones(BUCKETS, bool)
        for batch in batches:
            at, data = _bytes_of(batch.column(0))
            for width in range(1, WIDTH + 1):
                size = np.diff(at)
                chosen = np.flatnonzero(size == width if width < WIDTH else size >= width)
                for k in range(0, len(chosen), 1024):
                    part = batch.column(0).take(pa.array(chosen[k : k + 1024]))
                    first, _ = _bytes_of(part)
                    for row, where, pieces, buckets, _ in _positions(part, [width], every):
                        yield pa.RecordBatch.from_arrays(
                            [part.take(pa.array(row)), pa.array((where - first[row]).astype(np.int32)), pa.array(np.full(len(row), width, np.int32)), pa.array(pieces.astype(np.int64)), pa.array(buckets)],
                            ["name", "place", "width", "piece", "bucket"],
                        )

    return names.mapInArrow(cut, "name string, place int, width int, piece long, bucket long")


def contained_names(texts: DataFrame, ids: Sequence[str], text_col: str, lexicon: DataFrame, name_col: str, least: int = 1) -> DataFrame:
    """Distinct (*ids, name) with ``name`` a substring of ``text``; names of fewer than ``least`` characters never match.

    What the driver and every task hold are tables of ``BUCKETS`` entries.  A null or empty text or name is
    contained in nothing and contains nothing.
    """
    let_workers_import(texts.sparkSession)
    names = lexicon.select(F.col(name_col).alias("name")).filter(F.length("name") >= max(1, least)).distinct()
    pieces = cut_lineage(_piece_rows(names))
    texts = texts.select(*ids, F.col(text_col).alias("_text"))
    # at most one row for each bucket and width
    asked = pieces.select("bucket", "width").distinct().toArrow()
    widths = sorted(set(asked.column("width").to_pylist()))
    wanted = np.zeros(BUCKETS, bool)
    wanted[asked.column("bucket").to_numpy()] = True

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for *_, buckets, _ in _positions(batch.column(0), widths, wanted):
                np.add.at(total, buckets, 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    counts = texts.select("_text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    # a piece that no text has rules its name out
    rarest = pieces.join(counts, "bucket", "left").groupBy("name").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "width", "piece", "bucket")).alias("key")
    ).filter("key.n > 0")
    raw = F.col("name").cast("binary")
    keyed = cut_lineage(rarest.select(
        F.col("name").alias("_name"), F.col("key.piece").alias("_piece"), F.col("key.width").alias("_width"), "key.bucket",
        F.substring(raw, F.lit(1), F.col("key.place")).alias("_before"), F.substring(raw, F.col("key.place") + 1, F.octet_length("name")).alias("_after"),
    ))
    reach = keyed.groupBy("bucket").agg(F.max(F.octet_length("_before")).alias("left"), F.max(F.octet_length("_after")).alias("right")).toArrow()
    left, right, keys = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, bool)
    chosen = reach.column("bucket").to_numpy()
    keys[chosen] = True
    left[chosen], right[chosen] = reach.column("left").to_numpy(), reach.column("right").to_numpy()

    def surroundings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("_text")
            at, data = _bytes_of(text)
            for row, where, piece, bucket, width in _positions(text, widths, keys):
                first, last = np.maximum(where - left[bucket], at[row]), np.minimum(where + right[bucket], at[row + 1])
                seen = {
                    (r, p, data[a:w].tobytes(), data[w:z].tobytes())
                    for r, p, a, w, z in zip(row.tolist(), piece.tolist(), first.tolist(), where.tolist(), last.tolist())
                }
                if seen:
                    rows, found, before, after = zip(*seen)
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(c).take(pa.array(rows)) for c in ids], pa.array(found, pa.int64()), pa.array(np.full(len(rows), width, np.int32)), pa.array(before, pa.binary()), pa.array(after, pa.binary())],
                        [*ids, "_piece", "_width", "_text_before", "_text_after"],
                    )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields if f.name != "_text")
    found = texts.mapInArrow(surroundings, f"{fields}, _piece long, _width int, _text_before binary, _text_after binary")
    met = found.join(keyed.drop("bucket"), ["_piece", "_width"]).filter(F.endswith("_text_before", "_before") & F.startswith("_text_after", "_after"))
    return met.select(*ids, F.col("_name").alias(name_col)).distinct()


def normalized_question(c: Column) -> Column:
    return F.replace(F.replace(F.lower(c), F.lit("-"), F.lit(" ")), F.lit("_"), F.lit(" "))


def lexicon_forms(designations: DataFrame) -> DataFrame:
    """Search forms (form, gi_name) of every designation.

    The display form, the stored form and, for names joined by ``__``, each part; all in lower
    case with spaces.
    """
    stored = F.col("gi_name")
    spaced = F.replace(F.lower(stored), F.lit("_"), F.lit(" "))
    parts = F.when(F.contains(stored, F.lit("__")), F.split(F.lower(stored), "__")).otherwise(F.array().cast("array<string>"))
    forms = F.concat(
        F.array(F.lower(F.col("display_name")), spaced),
        F.transform(parts, lambda p: F.trim(F.replace(p, F.lit("_"), F.lit(" ")))),
    )
    return (
        designations.select(stored, F.explode(forms).alias("form")).filter(F.length("form") >= 4).distinct()
    )


def lexicon_mentions(questions: DataFrame, id_col: str, text_col: str, designations: DataFrame) -> DataFrame:
    """Distinct (id, gi_name) of designations named in a text without DOP / IGP before them."""
    forms = lexicon_forms(designations)
    normalized = questions.select(F.col(id_col), normalized_question(F.col(text_col)).alias("_q"))
    found = contained_names(normalized, [id_col], "_q", forms, "form", least=4)
    # the forms are distinct per name, so each text meets a name at most a few times
    return found.join(forms, "form").select(id_col, "gi_name").distinct()


def _tier(entity: Column, node: Column) -> Column:
    e, n = fold_accents(entity), fold_accents(node)
    loose = (F.contains(n, e) | F.contains(e, n)) & (F.length(node) > 2) & ~e.isin(*V.NODE_MATCH_STOP_WORDS)
    return F.when(entity == node, F.lit(1)).when(e == n, F.lit(2)).when(loose, F.lit(3))


def match_few(nodes: DataFrame, entities: list[str]) -> DataFrame:
    """Best node (name, ord) for each of a handful of entities: one scan, no join.

    Best is: same text, else same after folding accents, else containment either way; the
    earliest node decides within a step.
    """
    wanted = F.array(*[F.lit(e) for e in entities]).cast("array<string>")
    met = nodes.select("name", "ord", F.explode(wanted).alias("entity")).withColumn(
        "tier", _tier(F.col("entity"), F.col("name"))
    )
    return (
        met.filter("tier is not null")
        .groupBy("entity")
        .agg(F.min_by(F.struct("name", "tier"), F.struct("tier", "ord", "name")).alias("m"))
        .select("entity", F.col("m.name").alias("name"), F.col("m.tier").alias("tier"))
    )


def match_many(entities: DataFrame, nodes: DataFrame, entity_col: str = "entity") -> DataFrame:
    """The same for a table of entities: equi-joins for the exact steps, then containment both ways by rarest pieces."""
    wanted = cut_lineage(entities.select(F.col(entity_col).alias("entity")).distinct().withColumn("ef", fold_accents("entity")))
    known = cut_lineage(nodes.select("name", "ord").withColumn("nf", fold_accents("name")))
    by_text = wanted.join(known, F.col("entity") == F.col("name")).select("entity", "name", "ord", F.lit(1).alias("tier"))
    by_fold = wanted.join(known, F.col("ef") == F.col("nf")).select("entity", "name", "ord", F.lit(2).alias("tier"))
    exact = cut_lineage(first_per_key(by_text.unionByName(by_fold), ["entity"], ["tier", "ord", "name"]))

    rest = cut_lineage(wanted.join(exact.select("entity"), "entity", "left_anti").filter(~F.col("ef").isin(*V.NODE_MATCH_STOP_WORDS)))
    longer = known.filter(F.length("name") > 2)
    inside_node = contained_names(longer, ["name", "ord"], "nf", rest, "ef").join(rest, "ef")
    inside_entity = contained_names(rest, ["entity"], "ef", longer, "nf").join(longer, "nf")
    columns = ["entity", "name", "ord", F.lit(3).alias("tier")]
    loose = inside_node.select(*columns).unionByName(inside_entity.select(*columns))
    # group limit below the shuffle: one candidate per entity and task
    loose = first_per_key(loose, ["entity"], ["ord", "name"])
    return exact.unionByName(loose).select("entity", "name", "tier")
