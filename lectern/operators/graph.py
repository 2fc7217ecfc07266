"""Property graph: import, triples, inferred edges, neighbourhoods, text and statistics.

nodes: name, type, source, attrs MAP<STRING,STRING>, ord
edges: src, dst, predicate, source, via, attrs MAP<STRING,STRING>, ord

``ord`` is a struct that sorts nodes and edges in the order in which they came into the graph,
so "first" and "last" never depend on how rows are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern.config import DEFAULT, EngineConfig
from lectern.functions import names, packing
from lectern.functions.text import contains_any, entity_name
from lectern.operators.lineage import cut_lineage
from lectern.operators.skew import consecutive_ids, cut_lists, least_group_of_lists, next_event, pairs_sharing, products_within

ATTRS = "map<string,string>"
STAGE_TABLES, STAGE_DIRECTORY, STAGE_TRIPLES, STAGE_SHARED = 0, 10, 20, 90


def order_key(stage: int | Column, path: Column, a: Column, b: Column, c: Column) -> Column:
    stage = F.lit(stage) if isinstance(stage, int) else stage
    return F.struct(
        stage.cast("int").alias("stage"), path.cast("string").alias("path"),
        a.cast("long").alias("a"), b.cast("long").alias("b"), c.cast("long").alias("c"),
    )


def corpus_place(country_ord: Column, path: Column) -> Column:
    """A text that sorts like the corpus: countries in their given order, then folders and files part by part.

    Parts are parted by a sign below all others, so ``A`` with its files precedes ``A-B``.
    """
    return F.concat(F.lpad(F.coalesce(country_ord.cast("string"), F.lit("999")), 3, "0"), F.lit("\x01"), F.translate(path, "/", "\x01"))


def country_place(country: Column) -> Column:
    """Where a country stands in the given order; NULL for others."""
    return F.coalesce(*[F.when(country == c, F.lit(i)) for i, c in enumerate(V.SUPPORTED_COUNTRIES)])


def no_attrs() -> Column:
    return F.create_map().cast(ATTRS)


def attrs(**values: Column) -> Column:
    """Map of the non-NULL values as text."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def edges_of(df: DataFrame, src: Column, dst: Column, predicate: str | Column, ord_: Column,
             source: Column | None = None, via: Column | None = None, attrs_: Column | None = None) -> DataFrame:
    return df.select(
        src.alias("src"), dst.alias("dst"),
        (F.lit(predicate) if isinstance(predicate, str) else predicate).alias("predicate"),
        (source if source is not None else F.lit(None).cast("string")).alias("source"),
        (via if via is not None else F.lit(None).cast("string")).alias("via"),
        (attrs_ if attrs_ is not None else no_attrs()).alias("attrs"),
        ord_.alias("ord"),
    )


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


# --- import from the relational tables -------------------------------------------------------

def _distinct_first(df: DataFrame, cols: Sequence[str], stage: int) -> DataFrame:
    """SELECT DISTINCT that keeps the position of the first occurrence."""
    at = order_key(stage, corpus_place(F.col("country_ord"), F.col("path")),
                   F.col("table_ord"), F.col("row_ord"), F.col("item_ord"))
    return df.groupBy(*cols).agg(F.min(at).alias("ord"))


def from_tables(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, counted edges per predicate) of the four relations.

    Colour, zone and province edges are part of the graph but not of the count.
    """
    a = _distinct_first(
        tables["analytics"].filter("value is not null"),
        ("dop", "gi_type", "wine_type", "parameter", "value", "unit", "relation"), 0,
    )
    v = _distinct_first(tables["varieties"], ("dop", "gi_type", "variety", "color", "role"), 1)
    m = _distinct_first(tables["municipalities"], ("dop", "gi_type", "municipality", "zone", "province"), 2)
    y = _distinct_first(
        tables["yields"].filter("kg_ha is not null or hl_ha is not null"),
        ("dop", "gi_type", "wine_type", "variety", "kg_ha", "hl_ha"), 3,
    )
    w = _distinct_first(
        tables["analytics"].filter("wine_type is not null and wine_type <> 'general'"), ("dop", "gi_type", "wine_type"), 4
    )
    # a designation produces a type once, even if it is listed under two kinds
    w_edges = w.groupBy("dop", "wine_type").agg(F.min("ord").alias("ord"))

    dop, o = F.col("dop"), F.col("ord")
    param = F.concat("parameter", F.lit(" ("), "wine_type", F.lit(")"))
    color = F.concat(F.lit("color_"), "color")
    has_color = F.col("color").isNotNull() & ~F.col("color").isin("", "unknown")
    norm = F.concat(F.lit("yield_"), "dop", F.lit("_"), F.coalesce(F.nullif(F.col("variety"), F.lit("")), F.lit("general")))
    wine = F.concat(F.lit("wine_"), "wine_type")
    in_zone, in_province = m.filter("zone <> ''"), m.filter("province <> ''")
    town = F.col("municipality")

    counted = [
        edges_of(a, dop, param, "REQUIRES_PARAMETER", o,
                 attrs_=attrs(value=F.col("value"), unit=F.col("unit"), relation=F.col("relation"), wine_type=F.col("wine_type"))),
        edges_of(v, dop, F.col("variety"), "AUTHORIZES_VARIETY", o, attrs_=attrs(color=F.col("color"), role=F.col("role"))),
        edges_of(m, dop, town, "CONTAINS_MUNICIPALITY", o),
        edges_of(y, dop, norm, "REGULATES_YIELD", o,
                 attrs_=attrs(kg_ha=F.col("kg_ha"), hl_ha=F.col("hl_ha"), wine_type=F.col("wine_type"))),
        edges_of(w_edges, dop, wine, "PRODUCES_WINE_TYPE", o, attrs_=attrs(wine_type=F.col("wine_type"))),
    ]
    others = [
        edges_of(v.filter(has_color), F.col("variety"), color, "VARIETY_HAS_COLOR", o),
        edges_of(in_zone, town, F.col("zone"), "MUNICIPALITY_IN_ZONE", o),
        edges_of(in_province, town, F.col("province"), "MUNICIPALITY_IN_PROVINCE", o),
    ]

    def written(df: DataFrame, name: Column, type_: Column | str, **extra: Column) -> DataFrame:
        return df.select(
            name.alias("name"), (F.lit(type_) if isinstance(type_, str) else type_).alias("type"), o.alias("ord"),
            *[(extra[k] if k in extra else F.lit(None)).cast("string").alias(k) for k in ("color", "role", "wine_type")],
        )

    kind = F.col("gi_type")
    writes = _union([
        written(a, dop, kind), written(a, param, "Parameter"),
        written(v, dop, kind), written(v, F.col("variety"), "Variety", color=F.col("color"), role=F.col("role")),
        written(v.filter(has_color), color, "Color"),
        written(m, dop, kind), written(m, town, "Municipality"),
        written(in_zone, F.col("zone"), "Zone"), written(in_province, F.col("province"), "Province"),
        written(y, dop, kind), written(y, norm, "YieldNorm", wine_type=F.col("wine_type")),
        written(w, dop, kind), written(w, wine, "WineType"),
    ])

    def last(c: str) -> Column:
        # rows without the attribute do not write it
        return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct("ord", "type", c)))

    nodes = writes.groupBy("name").agg(
        last("type").alias("type"), *[last(c).alias(c) for c in ("color", "role", "wine_type")], F.min("ord").alias("ord")
    ).select(
        "name", "type", F.lit("tables_db").alias("source"),
        attrs(color=F.col("color"), role=F.col("role"), wine_type=F.col("wine_type")).alias("attrs"), "ord",
    )
    counts = _union(counted).groupBy("predicate").agg(F.count("*").alias("n"))
    return nodes, _union(counted + others), counts


def upsert_directory(nodes: DataFrame, folders: DataFrame) -> DataFrame:
    """Add the folders (name, type, path) as nodes; a known name takes the type of its folder.

    When several folders share a name, the first adds the node and the last sets its type.
    """
    listed = folders.groupBy("name").agg(
        F.max_by("type", "path").alias("dir_type"),
        F.min(order_key(STAGE_DIRECTORY, F.col("path"), F.lit(0), F.lit(0), F.lit(0))).alias("dir_ord"),
    )
    merged = nodes.join(listed, "name", "full_outer")
    return merged.select(
        "name", F.coalesce("dir_type", "type").alias("type"),
        F.coalesce("source", F.lit("directory")).alias("source"),
        F.coalesce("attrs", no_attrs()).alias("attrs"), F.coalesce("ord", "dir_ord").alias("ord"),
    )


# --- triples ----------------------------------------------------------------------------------

def interesting_sections(docs: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Sections whose heading or opening holds a vocabulary word and that are long enough."""
    sections = docs.select(
        "country", "folder", "source_file", F.posexplode(packing.graph_sections("markdown", cfg)).alias("section_ord", "s")
    ).select("country", "folder", "source_file", "section_ord", F.col("s.section").alias("heading"), F.col("s.markdown").alias("content"))
    opening = F.lower(F.left("content", F.lit(cfg.section_scan_chars)))
    wanted = contains_any(F.lower("heading"), V.SECTION_KEYWORDS) | contains_any(opening, V.SECTION_KEYWORDS)
    return sections.filter(wanted & (F.length("content") >= cfg.triple_min_chars))


def triple_rows(parsed: DataFrame) -> DataFrame:
    """Usable triples of (path, section_ord, label, triples) rows, names normalised."""
    t = parsed.select("path", "section_ord", "label", F.posexplode("triples").alias("triple_ord", "t"))
    given = F.map_filter(F.coalesce("t.attrs", no_attrs()), lambda _, v: v.isNotNull())
    out = t.select(
        entity_name(F.coalesce("t.subject", F.lit(""))).alias("subject"),
        F.coalesce("t.subject_type", F.lit("Entity")).alias("subject_type"),
        F.coalesce("t.predicate", F.lit("")).alias("predicate"),
        entity_name(F.coalesce("t.object", F.lit(""))).alias("object"),
        F.coalesce("t.object_type", F.lit("Entity")).alias("object_type"),
        given.alias("attrs"),
        F.concat(F.lit("llm:"), F.col("label")).alias("source"),
        order_key(STAGE_TRIPLES, F.col("path"), F.col("section_ord"), F.col("triple_ord"), F.lit(0)).alias("ord"),
    )
    return out.filter("subject <> '' and object <> '' and predicate <> ''")


def add_triples(nodes: DataFrame, edges: DataFrame, triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with the triples added; the first type of a new node stays."""
    ends = triples.select(
        F.explode(F.array(
            F.struct(F.col("subject").alias("name"), F.col("subject_type").alias("type"), F.lit(0).alias("side")),
            F.struct(F.col("object").alias("name"), F.col("object_type").alias("type"), F.lit(1).alias("side")),
        )).alias("e"), "source", "ord",
    ).select("e.name", "e.type", "source", F.col("ord").withField("c", F.col("e.side").cast("long")).alias("ord"))
    # min of a struct combines before the shuffle, so a name in very many triples is cheap
    first = ends.groupBy("name").agg(F.min(F.struct("ord", "type", "source")).alias("f"))
    new = first.select("name", "f.type", "f.source", no_attrs().alias("attrs"), "f.ord").join(
        nodes.select("name"), "name", "left_anti"
    )
    added = edges_of(
        triples, F.col("subject"), F.col("object"),
        F.coalesce(F.try_element_at("attrs", F.lit("predicate")), F.col("predicate")),
        F.col("ord"),
        source=F.coalesce(F.try_element_at("attrs", F.lit("source")), F.col("source")),
        attrs_=F.map_filter("attrs", lambda k, _: ~k.isin("predicate", "source")),
    )
    return nodes.unionByName(new), edges.unionByName(added)


def _first_edges(edges: DataFrame) -> DataFrame:
    """First position of an edge of any kind for each (src, dst)."""
    return edges.groupBy("src", "dst").agg(F.min("ord").alias("first_ord"))


def _without_earlier(candidates: DataFrame, edges: DataFrame, predicate: str) -> DataFrame:
    """Drop candidates (src, dst, ord, ...) whose direction had an edge before ``ord``.

    An edge that an earlier build inferred also counts as there, whatever its position.
    """
    inferred = edges.filter((F.col("predicate") == predicate) & (F.col("source") == "cross_inference"))
    fresh = candidates.join(inferred.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    known = fresh.join(_first_edges(edges), ["src", "dst"], "left")
    return known.filter(F.col("first_ord").isNull() | (F.col("first_ord") >= F.col("ord"))).drop("first_ord")


def coauthorized(edges: DataFrame) -> DataFrame:
    """Edges between varieties of one designation, both ways, once at least one comes from a triple.

    A pair is linked when a triple of the designation adds one of the two while the other is
    there; a pair that is only in the imported tables is not linked.
    """
    is_triple = F.col("ord.stage") == STAGE_TRIPLES
    members = (
        edges.filter("predicate = 'AUTHORIZES_VARIETY'")
        .groupBy("src", "dst")
        .agg(F.min("ord").alias("seen"), F.min(F.when(is_triple, F.col("ord"))).alias("told"))
    )
    # groups without any triple link nothing and are left out before the pairing
    active = members.filter("told is not null").select("src").distinct()
    members = members.join(active, "src", "left_semi")
    pairs = pairs_sharing(members, "src", "dst", carry=("seen", "told"))
    both = F.greatest("seen_a", "seen_b")
    at = F.least(F.when(F.col("told_a") >= both, F.col("told_a")), F.when(F.col("told_b") >= both, F.col("told_b")))
    linked = pairs.withColumn("ord", at).filter("ord is not null")
    linked = linked.groupBy("a", "b").agg(F.min(F.struct("ord", "src")).alias("f"))
    ways = linked.select(
        F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
                          F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("w"),
        F.col("f.ord").alias("ord"), F.col("f.src").alias("via"),
    ).select("w.src", "w.dst", "ord", "via")
    kept = _without_earlier(ways, edges, "COAUTHORIZED_WITH")
    return edges_of(kept, F.col("src"), F.col("dst"), "COAUTHORIZED_WITH", F.col("ord").withField("c", F.lit(2).cast("long")),
                    source=F.lit("cross_inference"), via=F.col("via"))


def soil_in_climate(edges: DataFrame) -> DataFrame:
    """Soil to climate edges of a zone, made when a municipality triple names the zone.

    Only soils and climates that are in the graph at that moment take part.
    """
    def first(predicate: str, name: str) -> DataFrame:
        return edges.filter(F.col("predicate") == predicate).groupBy(F.col("src").alias("zone"), F.col("dst").alias(name)).agg(
            F.min("ord").alias(f"{name}_ord")
        )

    calls = edges.filter(
        (F.col("predicate") == "MUNICIPALITY_IN_ZONE") & (F.col("ord.stage") == STAGE_TRIPLES)
    ).select(F.col("dst").alias("zone"), F.col("ord").alias("at"))
    called = calls.select("zone").distinct()
    soils = first("HAS_SOIL", "soil").join(called, "zone", "left_semi")
    climates = first("HAS_CLIMATE", "climate").join(called, "zone", "left_semi")
    # every soil meets every climate of its zone: that product is the result itself
    met = products_within(soils, climates, "zone").withColumn("at", F.greatest("soil_ord", "climate_ord"))
    starts = soils.select("zone", F.col("soil_ord").alias("at")).unionByName(climates.select("zone", F.col("climate_ord").alias("at")))
    when = next_event(starts, calls, "zone", "at")
    found = met.join(when, ["zone", "at"]).groupBy(F.col("soil").alias("src"), F.col("climate").alias("dst")).agg(
        F.min(F.struct(F.col("next_at").alias("ord"), F.col("zone"))).alias("f")
    ).select("src", "dst", "f.ord", F.col("f.zone").alias("via"))
    kept = _without_earlier(found, edges, "SOIL_IN_CLIMATE")
    return edges_of(kept, F.col("src"), F.col("dst"), "SOIL_IN_CLIMATE", F.col("ord").withField("c", F.lit(2).cast("long")),
                    source=F.lit("cross_inference"), via=F.col("via"))


# --- shared entities --------------------------------------------------------------------------

#: Tells for candidates (src, dst) which of them (src, dst) are edges that are not in a table.
Made = Callable[[DataFrame], DataFrame]


def _not_yet(candidates: DataFrame, edges: DataFrame, made: Made | None = None) -> DataFrame:
    """Candidates (src, dst) without an edge; only edges that leave one of their sources are moved."""
    candidates = cut_lineage(candidates)
    sources = cut_lineage(candidates.select("src").distinct())
    there = edges.select("src", "dst").join(sources, "src", "left_semi")
    return candidates.join(there.unionByName(made(candidates)) if made else there, ["src", "dst"], "left_anti")


_NOT_LISTED = "NOT (predicate <=> 'AUTHORIZES_VARIETY')"


def _varieties(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Designations (src, d), numbered by name, and varieties (dst, came, of): when each came and who lists it, as sorted numbers."""
    listed = edges.filter("predicate = 'AUTHORIZES_VARIETY'")
    designations = consecutive_ids(listed.select("src").filter("src IS NOT NULL").distinct(), ("src",), "d").select("src", F.col("d").cast("int"))
    # rows are sorted to be grouped, which a number in front of the name makes faster
    by_name = listed.join(designations, "src", "left").filter("dst IS NOT NULL").groupBy(F.xxhash64("dst").alias("_h"), "dst")
    grouped = by_name.agg(F.min("ord").alias("came"), F.sort_array(F.collect_set("d")).alias("of"))
    return designations, cut_lineage(grouped.select("dst", "came", "of"))


def _shared_pairs(edges: DataFrame, designations: DataFrame, varieties: DataFrame, block: int = 256) -> DataFrame:
    """(src, dst, variety): designations with a variety in common and no edge so far, not written."""
    # Pairs are the bulk of the work, so they are made of numbers.  The numbers grow with the
    # order of names and of first appearances, which keeps "a < b" and "came first" intact.
    met = consecutive_ids(varieties.filter("size(of) > 1"), ("came", "dst"), "v")
    # the edge names the variety that came into the graph first
    first = least_group_of_lists(cut_lists(met.select("v", F.col("dst").alias("variety"), "of"), "of", block), "v", label="variety")
    # edges between designations, in numbers: those to a variety are known from its list
    ends = designations.select(F.col("src").alias("dst"), F.col("d").alias("b"))
    others = edges.filter(_NOT_LISTED).select("src", "dst").join(ends, "dst").join(designations.withColumnRenamed("d", "a"), "src")
    known = others.select("a", "b").unionByName(varieties.join(ends, "dst").select(F.explode("of").alias("a"), "b")).distinct()
    # written, so that their size is known when all pairs are joined with them; two ints would be joined as one
    # number, whose high and low halves fall into few slots of the hash table
    known = cut_lineage(known.select(F.col("a").cast("long").alias("_a"), F.col("b").cast("long").alias("_b")))
    return (
        first.join(known, (F.col("a").cast("long") == F.col("_a")) & (F.col("b").cast("long") == F.col("_b")), "left_anti")
        .join(designations.withColumnsRenamed({"d": "a"}), "a")
        .join(designations.withColumnsRenamed({"d": "b", "src": "dst"}), "b")
        .select("src", "dst", "variety")
    )


def _shared_edges(kept: DataFrame) -> DataFrame:
    return edges_of(kept, F.col("src"), F.col("dst"), "SHARES_VARIETY_WITH",
                    order_key(STAGE_SHARED, F.col("src"), F.lit(0), F.lit(0), F.lit(0)),
                    source=F.lit("cross_inference"), attrs_=F.create_map(F.lit("variety"), "variety"))


def shares_variety(edges: DataFrame, block: int = 256) -> DataFrame:
    """One edge a -> b (a < b) for designations with a variety in common and no edge so far."""
    return _shared_edges(_shared_pairs(edges, *_varieties(edges), block))


def _listed_or_shared(designations: DataFrame, varieties: DataFrame) -> Made:
    """Which candidates are edges to a variety or of two designations that share one, found without making those edges."""
    def made(candidates: DataFrame) -> DataFrame:
        leaving = cut_lineage(candidates.join(designations.withColumnRenamed("d", "a"), "src"))
        if leaving.isEmpty():
            return candidates.limit(0).select("src", "dst")
        listed = leaving.join(varieties.select("dst", "of"), "dst").filter("array_contains(of, a)").select("src", "dst")
        pairs = leaving.join(designations.select(F.col("src").alias("dst"), F.col("d").alias("b")), "dst").filter("a < b")
        members = varieties.select(F.col("dst").alias("variety"), F.explode("of").alias("a"))
        tried = pairs.join(members, "a").join(varieties.select(F.col("dst").alias("variety"), "of"), "variety")
        return listed.unionByName(tried.filter("array_contains(of, b)").select("src", "dst"))

    return made


def _container_of(edges: DataFrame, belongs: str, predicate: str, stage: int, made: Made | None) -> DataFrame:
    inside = edges.filter(F.col("predicate") == belongs).select(F.col("src").alias("town"), F.col("dst").alias("area")).distinct()
    holds = edges.filter("predicate = 'CONTAINS_MUNICIPALITY'").select(F.col("dst").alias("town"), F.col("src").alias("dop")).distinct()
    chain = inside.join(holds, "town").select(F.col("area").alias("src"), F.col("dop").alias("dst")).distinct()
    kept = _not_yet(chain, edges, made)
    return edges_of(kept, F.col("src"), F.col("dst"), predicate,
                    order_key(stage, F.col("src"), F.lit(0), F.lit(0), F.lit(0)), source=F.lit("cross_inference"))


def zone_in_dop(edges: DataFrame, made: Made | None = None) -> DataFrame:
    return _container_of(edges, "MUNICIPALITY_IN_ZONE", "ZONE_IN_DOP", STAGE_SHARED + 1, made)


def province_contains_dop(edges: DataFrame, made: Made | None = None) -> DataFrame:
    return _container_of(edges, "MUNICIPALITY_IN_PROVINCE", "PROVINCE_CONTAINS_DOP", STAGE_SHARED + 2, made)


def infer_shared(edges: DataFrame) -> DataFrame:
    """All three shared-entity inferences; each sees the edges made by the ones before it.

    Designations that share a variety are by far the most edges, so they are not written: whoever reads the result
    makes them, and the other rules ask only for those that could be one of theirs.
    """
    designations, varieties = _varieties(edges)
    shared = _shared_edges(_shared_pairs(edges, designations, varieties))
    out, made = edges.filter(_NOT_LISTED), _listed_or_shared(designations, varieties)
    new = shared
    for rule in (zone_in_dop, province_contains_dop):
        inferred = cut_lineage(rule(out, made))
        out, new = out.unionByName(inferred), new.unionByName(inferred)
    return edges.unionByName(new)


# --- neighbourhood queries ----------------------------------------------------------------------

def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = DEFAULT.graph_hops) -> DataFrame:
    """Nodes (name, hop) within ``hops`` undirected steps of ``seeds`` (name).

    Each hop is a join of the frontier with the two directions of the edges.  Targets are made
    distinct before the shuffle, so a hub sends each neighbour once per task; the new nodes of a
    hop are written out, so that the next hop does not compute them again.
    """
    links = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    visited = seeds.select("name", F.lit(0).alias("hop")).distinct()
    frontier = visited.select("name")
    for hop in range(1, hops + 1):
        reached = links.join(frontier, F.col("a") == F.col("name"), "left_semi").select(F.col("b").alias("name")).distinct()
        fresh = cut_lineage(reached.join(visited.select("name"), "name", "left_anti"))
        visited = visited.unionByName(fresh.withColumn("hop", F.lit(hop)))
        frontier = fresh
    return visited


def induced_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends in ``kept`` (name)."""
    ids = kept.select("name")
    inside = edges.join(ids.withColumnRenamed("name", "src"), "src", "left_semi")
    return inside.join(ids.withColumnRenamed("name", "dst"), "dst", "left_semi")


def predicate_priority(predicate: Column) -> Column:
    known = F.create_map(*[x for i, p in enumerate(V.PREDICATE_ORDER) for x in (F.lit(p), F.lit(i))])
    return F.coalesce(F.try_element_at(known, predicate), F.lit(V.PREDICATE_ORDER_OTHER))


def predicate_label(predicate: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in V.PREDICATE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, predicate), predicate)


def render_lines(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, max_edges: int = DEFAULT.graph_edges) -> DataFrame:
    """Lines (line_no, line) for a prompt; no rows when there are no edges.

    Only the ``max_edges`` first edges are turned into text; the overflow line counts the rest.
    """
    wanted = edges.withColumn("predicate", F.coalesce("predicate", F.lit("RELATED_TO")))
    seeded = wanted.join(seeds.select(F.col("name").alias("src"), F.lit(True).alias("_seed")).distinct(), "src", "left")
    order = [F.when(F.col("_seed"), F.lit(0)).otherwise(F.lit(1)), predicate_priority(F.col("predicate")), "ord", "src", "dst", "predicate"]
    top = seeded.orderBy(*order).limit(max_edges)
    # at most max_edges rows from here on
    top = top.withColumn("line_no", F.row_number().over(Window.orderBy(*order)))
    types = nodes.select("name", F.coalesce("type", F.lit("Entity")).alias("t"))
    ends = top.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    types = types.join(F.broadcast(ends), "name")
    typed = top.join(F.broadcast(types.withColumnsRenamed({"name": "src", "t": "st"})), "src", "left").join(
        F.broadcast(types.withColumnsRenamed({"name": "dst", "t": "dt"})), "dst", "left"
    )
    line = F.concat(
        F.lit("- "), "src", F.lit(" ("), F.coalesce("st", F.lit("Entity")), F.lit(") "), predicate_label(F.col("predicate")),
        F.lit(" "), "dst", F.lit(" ("), F.coalesce("dt", F.lit("Entity")), F.lit(")"),
    )
    body = typed.select("line_no", line.alias("line"))
    before, after = V.GRAPH_TEXT_OVERFLOW.split("%d")
    n = F.col("n")
    frame = wanted.agg(F.count("*").alias("n")).filter("n > 0").select(
        F.explode(F.array_compact(F.array(
            F.struct(F.lit(0).alias("line_no"), F.lit(V.GRAPH_TEXT_TITLE).alias("line")),
            F.when(n > max_edges, F.struct(
                F.lit(max_edges + 1).alias("line_no"),
                F.concat(F.lit(before), (n - max_edges).cast("string"), F.lit(after)).alias("line"),
            )),
        ))).alias("x")
    ).select("x.line_no", "x.line")
    return body.unionByName(frame)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n) for node types and predicates, and the two totals."""
    by_type = nodes.groupBy(F.lit("node_type").alias("kind"), F.coalesce("type", F.lit("unknown")).alias("name")).agg(F.count("*").alias("n"))
    by_pred = edges.groupBy(F.lit("predicate").alias("kind"), F.coalesce("predicate", F.lit("RELATED_TO")).alias("name")).agg(F.count("*").alias("n"))
    both = by_type.unionByName(by_pred)
    total = F.when(F.col("kind") == "node_type", F.lit("nodes")).otherwise(F.lit("edges"))
    totals = both.groupBy(F.lit("total").alias("kind"), total.alias("name")).agg(F.sum("n").alias("n"))
    return both.unionByName(totals)


def folder_nodes(docs: DataFrame) -> DataFrame:
    """(name, type, path) of every folder of the corpus."""
    return docs.select("country", "folder").distinct().select(
        names.display_name("folder").alias("name"), names.gi_type("folder").alias("type"),
        corpus_place(country_place(F.col("country")), F.concat_ws("/", "country", "folder")).alias("path"),
    )
