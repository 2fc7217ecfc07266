"""Registered queries: the property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern.functions import replies
from lectern.operators import graph, tables
from lectern.operators.lineage import cut_lineage
from lectern.plans.registered import derived as D
from lectern.plans.registered.registry import register, table
from lectern.plans.registered.tables import ALL_TABLES, d_display, d_title
from lectern.sources.layout import spread
from lectern.plans.registered.texts import reply_column, reply_sql

# --- import of the relational tables --------------------------------------------------------------

_AT = "struct_pack(p := path, t := table_ord, r := row_ord, i := item_ord)"


def _first(cols: str, source: str, where: str = "true") -> str:
    return f"SELECT {cols}, min({_AT}) AS pos0 FROM {source} WHERE {where} GROUP BY {cols}"


_IMPORT = f"""
{ALL_TABLES},
a AS ({_first('dop, gi_type, wine_type, parameter, value, unit, relation', 'analytics', 'value IS NOT NULL')}),
v AS ({_first('dop, gi_type, variety, color, role', 'varieties')}),
m AS ({_first('dop, gi_type, municipality, zone, province', 'municipalities')}),
y AS ({_first('dop, gi_type, wine_type, variety, kg_ha, hl_ha', 'yields', 'kg_ha IS NOT NULL OR hl_ha IS NOT NULL')}),
w AS ({_first('dop, gi_type, wine_type', 'analytics', "wine_type <> 'general'")}),
edges AS (
  SELECT dop AS src, parameter || ' (' || wine_type || ')' AS dst, 'REQUIRES_PARAMETER' AS predicate, value, unit, relation, wine_type, NULL AS color, NULL AS role, NULL::DOUBLE AS kg_ha, NULL::DOUBLE AS hl_ha FROM a
  UNION ALL SELECT dop, variety, 'AUTHORIZES_VARIETY', NULL, NULL, NULL, NULL, color, role, NULL, NULL FROM v
  UNION ALL SELECT variety, 'color_' || color, 'VARIETY_HAS_COLOR', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM v WHERE color <> 'unknown'
  UNION ALL SELECT dop, municipality, 'CONTAINS_MUNICIPALITY', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM m
  UNION ALL SELECT municipality, zone, 'MUNICIPALITY_IN_ZONE', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM m WHERE zone IS NOT NULL
  UNION ALL SELECT municipality, province, 'MUNICIPALITY_IN_PROVINCE', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM m WHERE province IS NOT NULL
  UNION ALL SELECT dop, 'yield_' || dop || '_' || variety, 'REGULATES_YIELD', NULL, NULL, NULL, wine_type, NULL, NULL, kg_ha, hl_ha FROM y
  UNION ALL SELECT DISTINCT dop, 'wine_' || wine_type, 'PRODUCES_WINE_TYPE', NULL::DOUBLE, NULL, NULL, wine_type, NULL, NULL, NULL::DOUBLE, NULL::DOUBLE FROM w
), writes AS (
  SELECT dop AS name, gi_type AS type, 0 AS s, pos0, NULL AS color, NULL AS role, NULL AS wine_type FROM a
  UNION ALL SELECT parameter || ' (' || wine_type || ')', 'Parameter', 0, pos0, NULL, NULL, NULL FROM a
  UNION ALL SELECT dop, gi_type, 1, pos0, NULL, NULL, NULL FROM v UNION ALL SELECT variety, 'Variety', 1, pos0, color, role, NULL FROM v
  UNION ALL SELECT 'color_' || color, 'Color', 1, pos0, NULL, NULL, NULL FROM v WHERE color <> 'unknown'
  UNION ALL SELECT dop, gi_type, 2, pos0, NULL, NULL, NULL FROM m UNION ALL SELECT municipality, 'Municipality', 2, pos0, NULL, NULL, NULL FROM m
  UNION ALL SELECT zone, 'Zone', 2, pos0, NULL, NULL, NULL FROM m WHERE zone IS NOT NULL UNION ALL SELECT province, 'Province', 2, pos0, NULL, NULL, NULL FROM m WHERE province IS NOT NULL
  UNION ALL SELECT dop, gi_type, 3, pos0, NULL, NULL, NULL FROM y UNION ALL SELECT 'yield_' || dop || '_' || variety, 'YieldNorm', 3, pos0, NULL, NULL, wine_type FROM y
  UNION ALL SELECT dop, gi_type, 4, pos0, NULL, NULL, NULL FROM w UNION ALL SELECT 'wine_' || wine_type, 'WineType', 4, pos0, NULL, NULL, NULL FROM w
), nodes AS (
  SELECT name, arg_max(type, struct_pack(s := s, a := pos0)) AS type, arg_max(color, struct_pack(s := s, a := pos0, c := color)) FILTER (color IS NOT NULL) AS color,
         arg_max(role, struct_pack(s := s, a := pos0, c := role)) FILTER (role IS NOT NULL) AS role,
         arg_max(wine_type, struct_pack(s := s, a := pos0, c := wine_type)) FILTER (wine_type IS NOT NULL) AS wine_type
  FROM writes GROUP BY name
)"""


def imported(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return graph.from_tables(tables.build_tables(D.table_corpus(spark, sf_dir)))


def attr(name: str, cast: str | None = None):
    value = F.try_element_at("attrs", F.lit(name))
    return (value.cast(cast) if cast else value).alias(name)


@register("imported_edges", f"{_IMPORT}\nSELECT * FROM edges")
def imported_edges(spark, sf_dir):
    _, edges, _ = imported(spark, sf_dir)
    return edges.select(
        "src", "dst", "predicate", attr("value", "double"), attr("unit"), attr("relation"), attr("wine_type"), attr("color"), attr("role"),
        attr("kg_ha", "double"), attr("hl_ha", "double"),
    )


@register("imported_nodes", f"{_IMPORT}\nSELECT * FROM nodes")
def imported_nodes(spark, sf_dir):
    nodes, _, _ = imported(spark, sf_dir)
    return nodes.select("name", "type", attr("color"), attr("role"), attr("wine_type"))


@register("imported_counts", f"""{_IMPORT}
SELECT predicate, count(*) AS n FROM edges WHERE predicate NOT IN ('VARIETY_HAS_COLOR', 'MUNICIPALITY_IN_ZONE', 'MUNICIPALITY_IN_PROVINCE') GROUP BY 1""")
def imported_counts(spark, sf_dir):
    return imported(spark, sf_dir)[2]


@register("directory_upsert", f"""{_IMPORT},
folders AS (SELECT DISTINCT {d_display('folder')} AS name, CASE WHEN regexp_matches(folder, '^(DOP|IGP)_') THEN left(folder, 3) ELSE 'knowledge' END AS type,
            CASE country WHEN 'Espanya' THEN 0 WHEN 'Coneixement' THEN 1 END AS c, folder FROM table_corpus
            UNION SELECT {d_display("'DOP_' || r_name")}, 'DOP', 0, 'DOP_' || r_name FROM region
            UNION SELECT {d_display("r_name")}, 'knowledge', 1, r_name FROM region WHERE r_regionkey < 3),
listed AS (SELECT name, arg_max(type, (c, folder)) AS dir_type FROM folders GROUP BY name)
SELECT name, coalesce(dir_type, type) AS type, CASE WHEN nodes.type IS NULL THEN 'directory' ELSE 'tables_db' END AS source
FROM nodes FULL JOIN listed USING (name)""")
def directory_upsert(spark, sf_dir):
    nodes, _, _ = imported(spark, sf_dir)
    folders = graph.folder_nodes(D.table_corpus(spark, sf_dir)).unionByName(graph.folder_nodes(
        table(spark, sf_dir, "region").select(F.lit("Espanya").alias("country"), F.concat(F.lit("DOP_"), "r_name").alias("folder"))
    )).unionByName(graph.folder_nodes(
        # some names stand in both countries; the later country decides their type
        table(spark, sf_dir, "region").filter("r_regionkey < 3").select(F.lit("Coneixement").alias("country"), F.col("r_name").alias("folder"))
    ))
    return graph.upsert_directory(nodes, folders).select("name", "type", "source")


# --- triples -------------------------------------------------------------------------------------------

def reply_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = spread(table(spark, sf_dir, "events")).select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("path"), F.lit(0).alias("section_ord"),
        F.col("event_type").alias("label"), replies.parse_triples(reply_column()).alias("triples"),
    )
    return graph.triple_rows(parsed)


_TRIPLES = f"""
base AS (SELECT event_id, user_id, event_type, event_id % 6 AS k, props FROM events),
raw AS (
  SELECT event_id, 0 AS i, 'user ' || user_id AS s, 'DOP' AS st, upper(event_type) AS p, event_type AS o, 'Zone' AS ot, event_type AS l FROM base WHERE k = 0
  UNION ALL SELECT event_id, 0, 'user ' || user_id, 'Entity', 'P', 'x', 'Entity', event_type FROM base WHERE k = 1
  UNION ALL SELECT event_id, 1, event_type, 'Entity', 'Q', 'user ' || user_id, 'Entity', event_type FROM base WHERE k = 1
  UNION ALL SELECT event_id, 0, 'user ' || user_id, 'Entity', 'P', 'o', 'Entity', event_type FROM base WHERE k = 2
  UNION ALL SELECT event_id, 0, 'user ' || user_id, 'Entity', 'R', event_type, '', event_type FROM base WHERE k = 4
  UNION ALL SELECT event_id, 0, 'user ' || user_id, 'Entity', 'L', 'a', 'Entity', event_type FROM base WHERE k = 5
  UNION ALL SELECT event_id, 1, event_type, 'Entity', 'L', 'b', 'Entity', event_type FROM base WHERE k = 5
), triples AS (SELECT event_id, i, {d_title('s')} AS subject, st, p AS predicate, {d_title('o')} AS object, ot, 'llm:' || l AS source FROM raw)"""


@register("triple_edges", f"WITH {_TRIPLES} SELECT subject AS src, object AS dst, predicate, source, count(*) AS n FROM triples GROUP BY ALL")
def triple_edges(spark, sf_dir):
    triples = reply_triples(spark, sf_dir)
    no_nodes = triples.limit(0).select(
        F.col("subject").alias("name"), F.col("subject_type").alias("type"), "source", "attrs", "ord"
    )
    no_edges = graph.edges_of(triples.limit(0), F.col("subject"), F.col("object"), "NONE", F.col("ord"))
    _, edges = graph.add_triples(no_nodes, no_edges, triples)
    return edges.groupBy("src", "dst", "predicate", "source").agg(F.count("*").alias("n"))


@register("triple_nodes", f"""
WITH {_TRIPLES},
ends AS (SELECT subject AS name, st AS type, source, event_id, i, 0 AS c FROM triples UNION ALL SELECT object, ot, source, event_id, i, 1 FROM triples)
SELECT name, arg_min(type, struct_pack(e := event_id, i := i, c := c, t := type)) AS type, arg_min(source, struct_pack(e := event_id, i := i, c := c, t := type)) AS source
FROM ends WHERE name NOT IN (SELECT {d_title('event_type')} FROM events WHERE event_type = 'click') GROUP BY name
UNION ALL SELECT 'Click', 'Known', 'tables_db' FROM (SELECT 1 FROM events LIMIT 1)
""")
def triple_nodes(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    known = events.filter("event_type = 'click'").select(F.lit("Click").alias("name")).distinct().select(
        "name", F.lit("Known").alias("type"), F.lit("tables_db").alias("source"), graph.no_attrs().alias("attrs"),
        graph.order_key(0, F.lit(""), F.lit(0), F.lit(0), F.lit(0)).alias("ord"),
    )
    triples = reply_triples(spark, sf_dir)
    no_edges = graph.edges_of(known.limit(0), F.col("name"), F.col("name"), "NONE", F.col("ord"))
    nodes, _ = graph.add_triples(known, no_edges, triples)
    return nodes.select("name", "type", "source")


# --- inferred edges: parts as designations (brand) and varieties (name) ---------------------------------

def _at(stage):
    return graph.order_key(stage, F.lit(""), F.col("p_partkey"), F.lit(0), F.lit(0))


def brand_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small parts are in the tables, large ones come as triples; some varieties are linked already."""
    parts = table(spark, sf_dir, "part")
    stage = F.when(F.col("p_size") <= 25, F.lit(graph.STAGE_TABLES)).otherwise(F.lit(graph.STAGE_TRIPLES))
    listed = graph.edges_of(parts, F.col("p_brand"), F.col("p_name"), "AUTHORIZES_VARIETY", _at(stage))
    linked = graph.edges_of(
        parts.filter("p_size = 7"), F.col("p_name"), F.concat(F.lit("red "), F.split_part("p_name", F.lit(" "), F.lit(2))), "RELATED_TO",
        _at(graph.STAGE_TRIPLES),
    )
    return listed.unionByName(linked)


@register("coauthorized_varieties", """
WITH members AS (
  SELECT p_brand AS g, p_name AS v, min(struct_pack(s := CASE WHEN p_size <= 25 THEN 0 ELSE 20 END, k := p_partkey)) AS seen,
         min(struct_pack(s := 20, k := p_partkey)) FILTER (p_size > 25) AS told FROM part GROUP BY ALL
), pairs AS (
  SELECT a.g, a.v AS a, b.v AS b, least(CASE WHEN a.told >= greatest(a.seen, b.seen) THEN a.told END, CASE WHEN b.told >= greatest(a.seen, b.seen) THEN b.told END) AS t0
  FROM members a JOIN members b ON a.g = b.g AND a.v <> b.v
), linked AS (SELECT a, b, min(struct_pack(t0 := t0, g := g)) AS f FROM pairs WHERE t0 IS NOT NULL GROUP BY ALL),
known AS (SELECT p_name AS a, 'red ' || split_part(p_name, ' ', 2) AS b, min(struct_pack(s := 20, k := p_partkey)) AS first FROM part WHERE p_size = 7 GROUP BY ALL)
SELECT a AS src, b AS dst, f.g AS via, f.t0.k AS t0 FROM linked LEFT JOIN known USING (a, b) WHERE first IS NULL OR first >= f.t0
""")
def coauthorized_varieties(spark, sf_dir):
    found = graph.coauthorized(brand_edges(spark, sf_dir))
    return found.select("src", "dst", "via", F.col("ord.a").alias("t0"))


@register("soil_climate_links", """
WITH soils AS (SELECT p_brand AS z, p_type || ' ' || (p_partkey % 40) AS s, min(p_partkey) AS t0 FROM part WHERE p_size % 3 = 0 GROUP BY ALL),
climates AS (SELECT p_brand AS z, 'clima ' || (p_partkey % 50) AS c, min(p_partkey) AS t0 FROM part WHERE p_size % 3 = 1 GROUP BY ALL),
calls AS (SELECT p_brand AS z, p_partkey AS t0 FROM part WHERE p_size % 3 = 2),
met AS (SELECT s.z, s.s, c.c, min(k.t0) AS t0 FROM soils s JOIN climates c ON s.z = c.z JOIN calls k ON k.z = s.z AND k.t0 > greatest(s.t0, c.t0) GROUP BY ALL),
found AS (SELECT s, c, min(struct_pack(t0 := t0, z := z)) AS f FROM met GROUP BY ALL),
known AS (SELECT p_type || ' ' || (p_partkey % 40) AS s, 'clima ' || (p_partkey % 50) AS c, min(p_partkey) AS first FROM part WHERE p_size = 3 GROUP BY ALL)
SELECT s AS src, c AS dst, f.z AS via, f.t0 AS t0 FROM found LEFT JOIN known USING (s, c) WHERE first IS NULL OR first >= f.t0
""")
def soil_climate_links(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    soil = F.concat("p_type", F.lit(" "), (F.col("p_partkey") % 40).cast("string"))
    climate = F.concat(F.lit("clima "), (F.col("p_partkey") % 50).cast("string"))
    town = F.concat(F.lit("vila "), F.col("p_partkey").cast("string"))
    at, brand = _at(graph.STAGE_TRIPLES), F.col("p_brand")
    edges = (
        graph.edges_of(parts.filter("p_size % 3 = 0"), brand, soil, "HAS_SOIL", at)
        .unionByName(graph.edges_of(parts.filter("p_size % 3 = 1"), brand, climate, "HAS_CLIMATE", at))
        .unionByName(graph.edges_of(parts.filter("p_size % 3 = 2"), town, brand, "MUNICIPALITY_IN_ZONE", at))
        .unionByName(graph.edges_of(parts.filter("p_size = 3"), soil, climate, "SOIL_IN_CLIMATE", at))
    )
    return graph.soil_in_climate(edges).select("src", "dst", "via", F.col("ord.a").alias("t0"))


# --- a graph of the order tables: suppliers as designations, parts as varieties ----------------------------

def trade_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of suppliers, parts, nations, regions and market segments."""
    def key(n: int, *path):
        return graph.order_key(n, F.concat_ws("|", *path), F.lit(0), F.lit(0), F.lit(0))

    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    supplier, part, customer = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    part_name = F.concat(F.lit("part "), F.col("l_partkey").cast("string"))
    supplier_name = F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string"))
    # the queries walk over the edges several times: written once, as the graph store does; the many edges of sold parts
    # as numbers, from which names are made faster than they are read, and those of a part together
    sold = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").repartition("l_partkey").distinct()
    sold = cut_lineage(sold.sortWithinPartitions("l_partkey"))
    placed = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    s_name = F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string"))
    zoned = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    served = customer.select("c_nationkey", "c_mktsegment").distinct().join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    n_name, r_name, seg = F.col("n_name"), F.col("r_name"), F.col("c_mktsegment")
    next_s = F.concat(F.lit("supplier "), (F.col("s_suppkey") + 1).cast("string"))
    listed = graph.edges_of(sold, supplier_name, part_name, "AUTHORIZES_VARIETY", key(0, supplier_name, part_name))
    others = (
        graph.edges_of(placed, s_name, n_name, "CONTAINS_MUNICIPALITY", key(1, s_name))
        .unionByName(graph.edges_of(zoned, n_name, r_name, "MUNICIPALITY_IN_ZONE", key(2, n_name)))
        .unionByName(graph.edges_of(served, n_name, seg, "MUNICIPALITY_IN_PROVINCE", key(3, n_name, seg)))
        .unionByName(graph.edges_of(placed, s_name, next_s, "NEXT", key(4, s_name)))
        .unionByName(graph.edges_of(zoned, r_name, F.concat(F.lit("supplier "), F.col("n_nationkey").cast("string")), "NEAR", key(5, n_name)))
    )

    def node(df: DataFrame, name, type_: str, n: int) -> DataFrame:
        return df.select(name.alias("name"), F.lit(type_).alias("type"), F.lit("tables_db").alias("source"), graph.no_attrs().alias("attrs"), key(n, name).alias("ord"))

    nodes = (
        node(supplier, s_name, "DOP", 0)
        .unionByName(node(part, F.concat(F.lit("part "), F.col("p_partkey").cast("string")), "Variety", 1))
        .unionByName(node(nation, n_name, "Municipality", 2))
        .unionByName(node(region, r_name, "Zone", 3))
        .unionByName(node(customer.select("c_mktsegment").distinct(), seg, "Province", 4))
    )
    return nodes, listed.unionByName(cut_lineage(others))


_TRADE = """
sold AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem),
placed AS (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey),
zoned AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
served AS (SELECT DISTINCT n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey),
edges AS (
  SELECT 'supplier ' || l_suppkey AS src, 'part ' || l_partkey AS dst, 'AUTHORIZES_VARIETY' AS predicate, 0 AS stage, 'supplier ' || l_suppkey || '|part ' || l_partkey AS path FROM sold
  UNION ALL SELECT 'supplier ' || s_suppkey, n_name, 'CONTAINS_MUNICIPALITY', 1, 'supplier ' || s_suppkey FROM placed
  UNION ALL SELECT n_name, r_name, 'MUNICIPALITY_IN_ZONE', 2, n_name FROM zoned
  UNION ALL SELECT n_name, c_mktsegment, 'MUNICIPALITY_IN_PROVINCE', 3, n_name || '|' || c_mktsegment FROM served
  UNION ALL SELECT 'supplier ' || s_suppkey, 'supplier ' || (s_suppkey + 1), 'NEXT', 4, 'supplier ' || s_suppkey FROM placed
  UNION ALL SELECT r_name, 'supplier ' || n_nationkey, 'NEAR', 5, n_name FROM zoned
), nodes AS (
  SELECT 'supplier ' || s_suppkey AS name, 'DOP' AS type FROM supplier UNION ALL SELECT 'part ' || p_partkey, 'Variety' FROM part
  UNION ALL SELECT n_name, 'Municipality' FROM nation UNION ALL SELECT r_name, 'Zone' FROM region UNION ALL SELECT DISTINCT c_mktsegment, 'Province' FROM customer
)"""


@register("shared_varieties", f"""
WITH {_TRADE}
SELECT a.src, b.src AS dst, arg_min(a.dst, struct_pack(c := came, d := a.dst)) AS variety
FROM edges a JOIN edges b ON a.dst = b.dst AND a.src < b.src AND a.predicate = 'AUTHORIZES_VARIETY' AND b.predicate = 'AUTHORIZES_VARIETY'
JOIN (SELECT dst AS v, min(path) AS came FROM edges WHERE predicate = 'AUTHORIZES_VARIETY' GROUP BY 1) ON v = a.dst
WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = a.src AND e.dst = b.src) GROUP BY ALL
""")
def shared_varieties(spark, sf_dir):
    _, edges = trade_graph(spark, sf_dir)
    return graph.shares_variety(edges).select("src", "dst", attr("variety"))


def _container_sql(belongs: str) -> str:
    return f"""
WITH {_TRADE}
SELECT DISTINCT i.dst AS src, h.src AS dst FROM edges i JOIN edges h ON i.src = h.dst AND i.predicate = '{belongs}' AND h.predicate = 'CONTAINS_MUNICIPALITY'
WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = i.dst AND e.dst = h.src)"""


@register("zones_of_designations", _container_sql("MUNICIPALITY_IN_ZONE"))
def zones_of_designations(spark, sf_dir):
    return graph.zone_in_dop(trade_graph(spark, sf_dir)[1]).select("src", "dst")


@register("provinces_of_designations", _container_sql("MUNICIPALITY_IN_PROVINCE"))
def provinces_of_designations(spark, sf_dir):
    return graph.province_contains_dop(trade_graph(spark, sf_dir)[1]).select("src", "dst")


@register("inferred_totals", f"""
WITH {_TRADE},
shared AS (SELECT DISTINCT a.src, b.src AS dst FROM edges a JOIN edges b ON a.dst = b.dst AND a.src < b.src AND a.predicate = 'AUTHORIZES_VARIETY' AND b.predicate = 'AUTHORIZES_VARIETY'
  WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = a.src AND e.dst = b.src)),
zones AS (SELECT DISTINCT i.dst AS src, h.src AS dst FROM edges i JOIN edges h ON i.src = h.dst AND i.predicate = 'MUNICIPALITY_IN_ZONE' AND h.predicate = 'CONTAINS_MUNICIPALITY'
  WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = i.dst AND e.dst = h.src)),
provinces AS (SELECT DISTINCT i.dst AS src, h.src AS dst FROM edges i JOIN edges h ON i.src = h.dst AND i.predicate = 'MUNICIPALITY_IN_PROVINCE' AND h.predicate = 'CONTAINS_MUNICIPALITY'
  WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = i.dst AND e.dst = h.src))
SELECT 'SHARES_VARIETY_WITH' AS predicate, count(*) AS n FROM shared UNION ALL SELECT 'ZONE_IN_DOP', count(*) FROM zones UNION ALL SELECT 'PROVINCE_CONTAINS_DOP', count(*) FROM provinces
""")
def inferred_totals(spark, sf_dir):
    edges = graph.infer_shared(trade_graph(spark, sf_dir)[1])
    made = edges.filter(F.col("predicate").isin("SHARES_VARIETY_WITH", "ZONE_IN_DOP", "PROVINCE_CONTAINS_DOP"))
    return made.groupBy("predicate").agg(F.count("*").alias("n"))


SEED = "NATION_3"
_WALK = f"""
WITH RECURSIVE {_TRADE},
links AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
walk AS (SELECT '{SEED}' AS name, 0 AS hop UNION SELECT b, hop + 1 FROM walk JOIN links ON a = name WHERE hop < 2),
reached AS (SELECT name, min(hop) AS hop FROM walk GROUP BY name)"""


def _seeds(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("name") == SEED).select("name")


@register("two_hop_nodes", f"{_WALK} SELECT name, hop FROM reached")
def two_hop_nodes(spark, sf_dir):
    nodes, edges = trade_graph(spark, sf_dir)
    return graph.neighbourhood(edges, _seeds(nodes), 2).select("name", "hop")


@register("induced_edges", f"""{_WALK}
SELECT src, dst, predicate FROM edges WHERE src IN (SELECT name FROM reached) AND dst IN (SELECT name FROM reached)""")
def induced_edges(spark, sf_dir):
    nodes, edges = trade_graph(spark, sf_dir)
    return graph.induced_edges(edges, graph.neighbourhood(edges, _seeds(nodes), 2)).select("src", "dst", "predicate")


_LABEL = "CASE predicate " + " ".join(f"WHEN '{p}' THEN '{label.replace(chr(39), chr(39) * 2)}'" for p, label in V.PREDICATE_LABELS.items()) + " ELSE predicate END"
_PRIORITY = "CASE predicate " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(V.PREDICATE_ORDER)) + " ELSE 50 END"


@register("graph_text", f"""{_WALK},
kept AS (SELECT * FROM edges WHERE src IN (SELECT name FROM reached) AND dst IN (SELECT name FROM reached)),
top AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN src = '{SEED}' THEN 0 ELSE 1 END, {_PRIORITY}, stage, path, src, dst) AS n FROM kept)
SELECT 0 AS line_no, '## Coneixements del graf de relacions' AS line WHERE (SELECT count(*) FROM kept) > 0
UNION ALL SELECT n, '- ' || src || ' (' || coalesce(s.type, 'Entity') || ') ' || {_LABEL} || ' ' || dst || ' (' || coalesce(d.type, 'Entity') || ')'
  FROM top LEFT JOIN nodes s ON s.name = src LEFT JOIN nodes d ON d.name = dst WHERE n <= 30
UNION ALL SELECT 31, '- ... i ' || (count(*) - 30) || ' relacions més' FROM kept HAVING count(*) > 30
""")
def graph_text(spark, sf_dir):
    nodes, edges = trade_graph(spark, sf_dir)
    seeds = _seeds(nodes)
    kept = cut_lineage(graph.induced_edges(edges, graph.neighbourhood(edges, seeds, 2)))
    return graph.render_lines(kept, nodes, seeds, 30).select(F.col("line_no").cast("long").alias("line_no"), "line")


@register("graph_stats", f"""
WITH {_TRADE}
SELECT 'node_type' AS kind, type AS name, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'predicate', predicate, count(*) FROM edges GROUP BY predicate
UNION ALL SELECT 'total', 'nodes', count(*) FROM nodes UNION ALL SELECT 'total', 'edges', count(*) FROM edges
""")
def graph_stats(spark, sf_dir):
    return graph.stats(*trade_graph(spark, sf_dir))
