"""Registered queries: pipe tables, quantities and the unique-key load."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern.functions import quantities
from lectern.operators import tables
from lectern.plans.registered import derived as D
from lectern.plans.registered.registry import register, table


# --- SQL building blocks ------------------------------------------------------------------------

def d_any(x: str, words) -> str:
    if len(words) > 8:
        return f"regexp_matches({x}, '{'|'.join(words)}')"
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def d_clean_cell(x: str) -> str:
    return D.d_strip(f"trim(trim({D.d_strip(x)}, '*'), '_')")


def d_value(x: str) -> str:
    return rf"""coalesce(
      try_cast(replace(nullif(regexp_extract({x}, '\d+,\d+'), ''), ',', '.') AS DOUBLE),
      try_cast(replace(nullif(regexp_extract({x}, '(\d+\.\d{{3}})([^\d]|$)', 1), ''), '.', '') AS DOUBLE),
      try_cast(nullif(regexp_extract({x}, '\d+\.\d+'), '') AS DOUBLE),
      try_cast(nullif(regexp_extract({x}, '\d+'), '') AS DOUBLE))"""


def d_relation(x: str) -> str:
    return f"""CASE WHEN {d_any(f'lower({x})', ('mínim', 'minim', 'mín'))} THEN 'min'
      WHEN {d_any(f'lower({x})', ('màxim', 'maxim', 'máx'))} THEN 'max' END"""


def d_unit(x: str) -> str:
    low = f"lower({x})"
    area = d_any(low, ("ha", "hect"))
    return f"""CASE WHEN {d_any(low, ('%', 'vol'))} THEN '% Vol' WHEN {d_any(low, ('g/l', 'gr/l', 'gramos'))} THEN 'g/l'
      WHEN contains({low}, 'kg/ha') THEN 'kg/ha' WHEN contains({low}, 'hl/ha') THEN 'hl/ha'
      WHEN contains({low}, 'kg') THEN (CASE WHEN {area} THEN 'kg/ha' ELSE 'kg' END)
      WHEN contains({low}, 'hl') THEN (CASE WHEN {area} THEN 'hl/ha' ELSE 'hl' END)
      WHEN {d_any(low, ('g/', 'gram', 'gr.'))} THEN 'g/l' END"""


def d_parameter(x: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({x}), '{h}') THEN '{k}'" for h, k, _ in V.PARAMETERS) + " END"


def d_default_unit(x: str) -> str:
    return f"CASE {x} WHEN 'grado_alcoholico' THEN '% Vol' WHEN 'so2_total' THEN 'mg/l' ELSE 'g/l' END"


def d_wine_type(x: str) -> str:
    named = ", ".join(f"CASE WHEN {d_any(f'lower({x})', words)} THEN '{name}' END" for name, words in V.WINE_TYPES)
    return f"coalesce(nullif(array_to_string(list_filter([{named}], lambda wt: wt IS NOT NULL), '/'), ''), 'general')"


def d_title(x: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all(lower({x}), '\p{{L}}+|[^\p{{L}}]+'), lambda tr: CASE WHEN tr[1] = 'ß' THEN 'Ss' ELSE upper(tr[1]) END || tr[2:]), '')"


def d_clean_variety(x: str) -> str:
    bare = f"trim(trim(trim(trim({D.d_strip(x)}, '*'), '_'), '·'), '-')"
    return d_title(D.d_strip(rf"regexp_replace({bare}, '\s*\([^)]*\)', '', 'g')"))


def d_is_variety(x: str) -> str:
    low = f"lower({x})"
    return rf"""(len({x}) >= 2 AND NOT regexp_matches({low}, '^[\d\s.,]+$') AND NOT {d_any(low, V.VARIETY_REJECT_WORDS)}
      AND NOT regexp_matches({x}, '[≥≤<>/%]') AND len(regexp_replace({low}, '[^\p{{L}}]', '', 'g')) >= 3)"""


def d_display(folder: str) -> str:
    return f"""CASE WHEN regexp_matches({folder}, '^(DOP|IGP)_') THEN replace(replace(substr({folder}, 5), '__', ' / '), '_', ' ')
      ELSE replace({folder}, '_', ' ') END"""


_BLOCKS = rf"""
WITH {D.TABLE_CORPUS},
split_docs AS (
  SELECT country, folder, source_file,
         list_filter(list_transform(regexp_split_to_array(string_split(markdown, '{V.TABLES_SECTION_HEADER}')[2], '### Taula\s*\([^)]*\)')[2:],
                                    lambda b: {D.d_strip('b')}), lambda b: b <> '') AS bs
  FROM table_corpus
), blocks AS (
  SELECT country || '/' || folder || '/' || source_file || '.md' AS path, {d_display('folder')} AS dop,
         CASE WHEN folder LIKE 'DOP%' THEN 'DOP' WHEN folder LIKE 'IGP%' THEN 'IGP' ELSE 'unknown' END AS gi_type,
         i - 1 AS table_ord, bs[i] AS block
  FROM (SELECT *, unnest(range(1, len(bs) + 1)) AS i FROM split_docs)
)"""

_PARSED = rf"""
{_BLOCKS},
gridded AS (
  SELECT path, dop, gi_type, table_ord, list_filter(list_transform(
      list_filter(list_transform(string_split(block, chr(10)), lambda l: {D.d_strip('l')}), lambda l: starts_with(l, '|')),
      lambda l: list_filter(list_transform(string_split(l, '|'), lambda c: {d_clean_cell('c')}), lambda c: c <> '')),
      lambda r: len(list_filter(r, lambda c: NOT regexp_full_match(c, '[-:]+'))) > 0) AS g
  FROM blocks
), parsed AS (
  SELECT path, dop, gi_type, table_ord, g[1] AS cols, g[1][1:len(g[2])] AS headers,
         list_transform(g[2:], lambda r: list_transform(r[1:len(g[1])], lambda c: {d_clean_cell('c')})) AS body
  FROM gridded WHERE len(g) > 1
), kinds AS (
  SELECT *, CASE
      WHEN {" + ".join(f"contains(lower(array_to_string(cols, ' ')), '{w}')::INT" for w in V.SENSORY_WORDS)} >= 3 THEN NULL
      WHEN {d_any("lower(array_to_string(headers, ' '))", V.YIELD_COLUMN_WORDS)} THEN 'yields'
      WHEN {d_any("lower(array_to_string(headers, ' '))", V.VARIETY_COLUMN_WORDS)} THEN 'varieties'
      WHEN {d_any("lower(array_to_string(headers, ' '))", V.MUNICIPALITY_COLUMN_WORDS)} THEN 'municipalities'
      WHEN {d_any("lower(array_to_string(cols, ' '))", [h for h, _, _ in V.PARAMETERS])} THEN 'analytics' END AS kind
  FROM parsed
), trows AS (
  SELECT path, dop, gi_type, table_ord, kind, headers, i - 1 AS row_ord, body[i] AS cells,
         lower(array_to_string(body[i], ' ')) AS row_text,
         array_to_string(body[i], ' ') || ' ' || array_to_string(headers, ' ') AS all_text
  FROM (SELECT *, unnest(range(1, len(body) + 1)) AS i FROM kinds)
)"""

_ANALYTICS = f"""
analytics_items AS (
  SELECT *, unnest(range(1, len(headers) + 1)) AS h,
    coalesce(list_position(list_transform(headers, lambda x: {d_any('lower(x)', V.PARAMETER_COLUMN_WORDS)}), true), 1) AS pc,
    list_transform(headers, lambda x: {d_any('lower(x)', V.VALUE_COLUMN_WORDS)}) AS is_value
  FROM trows WHERE kind = 'analytics'
), analytics_cells AS (
  SELECT path, dop, gi_type, table_ord, row_ord, h AS item_ord, coalesce(cells[h], '') AS raw,
    CASE WHEN len(headers) = 2 OR list_contains(is_value, true)
         THEN (CASE WHEN (len(headers) = 2 AND h = 2) OR (len(headers) <> 2 AND is_value[h])
                    THEN coalesce({d_parameter("coalesce(cells[CASE WHEN len(headers) = 2 THEN 1 ELSE pc END], '')")}, {d_parameter('headers[h]')}) END)
         ELSE {d_parameter("coalesce(cells[h], '')")} END AS parameter,
    CASE WHEN len(headers) = 2 OR list_contains(is_value, true) THEN {d_wine_type('all_text')} ELSE headers[h] END AS wine_type
  FROM analytics_items
), analytics_rows AS (
  SELECT path, dop, gi_type, table_ord, row_ord, item_ord, wine_type, parameter, {d_value('raw')} AS value,
         coalesce({d_unit('raw')}, {d_default_unit('parameter')}) AS unit, coalesce({d_relation('raw')}, 'target') AS relation
  FROM analytics_cells WHERE parameter IS NOT NULL
)"""

_VARIETIES = rf"""
variety_cols AS (
  SELECT *, list_last(list_filter(range(1, len(headers) + 1), lambda j: contains(lower(headers[j]), 'blanc'))) AS white,
    list_last(list_filter(range(1, len(headers) + 1), lambda j: {d_any('lower(headers[j])', ('tint', 'negre'))})) AS red,
    list_first(list_filter(range(1, len(headers) + 1), lambda j: {d_any('lower(headers[j])', V.VARIETY_COLUMN_WORDS)})) AS single
  FROM trows WHERE kind = 'varieties'
), variety_items AS (
  SELECT path, dop, gi_type, table_ord, row_ord, 1000 * c + unnest(range(1, len(string_split(cell, ',')) + 1)) AS item_ord,
         unnest(string_split(cell, ',')) AS raw, color, 'autorizada' AS role
  FROM (SELECT *, 1 AS c, coalesce(cells[white], '') AS cell, 'blanca' AS color FROM variety_cols WHERE white IS NOT NULL AND red IS NOT NULL
        UNION ALL SELECT *, 2, coalesce(cells[red], ''), 'tinta' FROM variety_cols WHERE white IS NOT NULL AND red IS NOT NULL)
  UNION ALL
  SELECT path, dop, gi_type, table_ord, row_ord, 0, coalesce(cells[single], ''),
    CASE WHEN {d_any('row_text', ('blanca', 'blanco', 'blanc'))} THEN 'blanca' WHEN {d_any('row_text', ('tinta', 'tinto', 'negre'))} THEN 'tinta' ELSE 'unknown' END,
    CASE WHEN contains(row_text, 'principal') THEN 'principal' WHEN {d_any('row_text', ('secundar', 'complementar'))} THEN 'secundaria' ELSE 'autorizada' END
  FROM variety_cols WHERE white IS NULL OR red IS NULL
), variety_named AS (SELECT * EXCLUDE (raw), {d_clean_variety('raw')} AS variety FROM variety_items),
variety_rows AS (SELECT * FROM variety_named WHERE {d_is_variety('variety')})"""

_YIELDS = f"""
yield_cells AS (
  SELECT path, dop, gi_type, table_ord, row_ord, cells, all_text, h, {d_value("coalesce(cells[h], '')")} AS v,
    CASE WHEN contains(lower(headers[h]), 'kg/ha') OR contains(lower(coalesce(cells[h], '')), 'kg/ha') THEN 'kg'
         WHEN contains(lower(headers[h]), 'hl/ha') OR contains(lower(coalesce(cells[h], '')), 'hl/ha') THEN 'hl'
         WHEN contains(lower(headers[h]), 'kg') OR contains(lower(coalesce(cells[h], '')), 'kg') THEN 'kg' END AS u
  FROM (SELECT *, unnest(range(1, len(headers) + 1)) AS h FROM trows WHERE kind = 'yields')
), yield_sums AS (
  SELECT path, dop, gi_type, table_ord, row_ord, any_value(cells) AS cells, any_value(all_text) AS all_text,
         arg_max(v, h) FILTER (u = 'kg' AND v IS NOT NULL) AS kg_ha, arg_max(v, h) FILTER (u = 'hl' AND v IS NOT NULL) AS hl_ha
  FROM yield_cells GROUP BY ALL
), yield_rows AS (
  SELECT path, dop, gi_type, table_ord, row_ord, 0 AS item_ord, {d_wine_type('all_text')} AS wine_type,
         CASE WHEN len(coalesce(cells[1], '')) > 2 THEN cells[1] ELSE {d_wine_type('all_text')} END AS variety, kg_ha, hl_ha
  FROM yield_sums WHERE coalesce(kg_ha, 0) <> 0 OR coalesce(hl_ha, 0) <> 0
)""".replace("GROUP BY ALL\n), yield_rows", "GROUP BY path, dop, gi_type, table_ord, row_ord\n), yield_rows")

_MUNICIPALITIES = f"""
town_cols AS (
  SELECT *, coalesce(list_last(list_filter(range(1, len(headers) + 1), lambda j: contains(lower(headers[j]), 'municipi'))), 1) AS tc,
    list_last(list_filter(range(1, len(headers) + 1), lambda j: contains(lower(headers[j]), 'zona') AND NOT contains(lower(headers[j]), 'municipi'))) AS zc,
    list_last(list_filter(range(1, len(headers) + 1), lambda j: {d_any('lower(headers[j])', ('provincia', 'província'))}
        AND NOT {d_any('lower(headers[j])', ('municipi', 'zona'))})) AS pc
  FROM trows WHERE kind = 'municipalities'
), municipality_rows AS (
  SELECT path, dop, gi_type, table_ord, row_ord, 0 AS item_ord, {D.d_strip("coalesce(cells[tc], '')")} AS municipality,
         nullif({D.d_strip("coalesce(cells[zc], '')")}, '') AS zone, nullif({D.d_strip("coalesce(cells[pc], '')")}, '') AS province
  FROM town_cols WHERE len({D.d_strip("coalesce(cells[tc], '')")}) >= 2
)"""

EXTRACTS = {
    "analytics": (_ANALYTICS, "analytics_rows"), "varieties": (_VARIETIES, "variety_rows"),
    "yields": (_YIELDS, "yield_rows"), "municipalities": (_MUNICIPALITIES, "municipality_rows"),
}
COLUMNS = {
    "analytics": "dop, gi_type, wine_type, parameter, value, unit, relation",
    "varieties": "dop, gi_type, variety, color, role",
    "yields": "dop, gi_type, wine_type, variety, kg_ha, hl_ha",
    "municipalities": "dop, gi_type, municipality, zone, province",
}


def d_loaded(kind: str) -> str:
    keys = ", ".join(tables.UNIQUE_KEYS[kind])
    rows = EXTRACTS[kind][1]
    return f"""{kind} AS (
  SELECT * FROM {rows} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY path, table_ord, row_ord, item_ord) = 1
)"""


ALL_TABLES = ",\n".join([_PARSED, *[f"{EXTRACTS[k][0]}, {d_loaded(k)}" for k in EXTRACTS]])


@register("quantities", f"""
WITH raw AS (
  SELECT l_orderkey, l_linenumber, CASE l_linenumber % 7
    WHEN 0 THEN 'mín. ' || l_quantity::INT || ',' || (l_quantity::INT % 10) || ' % vol'
    WHEN 1 THEN 'Máximo: ' || (l_quantity::INT % 40) || '.' || lpad((l_partkey % 1000)::VARCHAR, 3, '0') || ' kg/ha'
    WHEN 2 THEN l_quantity::INT || ' hl por ha'
    WHEN 3 THEN (l_partkey % 13) || '.' || (l_suppkey % 10) || ' gramos'
    WHEN 4 THEN 'minim ' || (l_partkey % 300) || ' mg/l (màxim ' || l_suppkey || ')'
    WHEN 5 THEN l_returnflag || ' ' || l_linestatus
    ELSE l_quantity::INT || ' kg' END AS raw FROM lineitem
)
SELECT l_orderkey, l_linenumber, {d_value('raw')} AS value, {d_unit('raw')} AS unit, {d_relation('raw')} AS relation FROM raw
""")
def quantity_query(spark, sf_dir):
    raw = F.expr("""CASE l_linenumber % 7
    WHEN 0 THEN concat('mín. ', int(l_quantity), ',', int(l_quantity) % 10, ' % vol')
    WHEN 1 THEN concat('Máximo: ', int(l_quantity) % 40, '.', lpad(string(l_partkey % 1000), 3, '0'), ' kg/ha')
    WHEN 2 THEN concat(int(l_quantity), ' hl por ha')
    WHEN 3 THEN concat(l_partkey % 13, '.', l_suppkey % 10, ' gramos')
    WHEN 4 THEN concat('minim ', l_partkey % 300, ' mg/l (màxim ', l_suppkey, ')')
    WHEN 5 THEN concat(l_returnflag, ' ', l_linestatus)
    ELSE concat(int(l_quantity), ' kg') END""")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"))
    return lines.select(
        "l_orderkey", "l_linenumber",
        quantities.quantity_value("raw").alias("value"), quantities.quantity_unit("raw").alias("unit"),
        quantities.quantity_relation("raw").alias("relation"),
    )


@register("parameters_and_types", f"""
WITH t AS (
  SELECT p_partkey, p_name || ' ' || CASE p_size % 10 WHEN 0 THEN 'Grado Alcohólico adquirido' WHEN 1 THEN 'acidez volátil real' WHEN 2 THEN 'Acidez total'
    WHEN 3 THEN 'anhídrido sulfuroso total' WHEN 4 THEN 'sulfuroso total' WHEN 5 THEN 'azúcares residuales tinto' WHEN 6 THEN 'Azúcares Totales blanco y rosado'
    WHEN 7 THEN 'alcohol adquirido cava' WHEN 8 THEN 'vi negre dulce' ELSE p_type END AS t FROM part
)
SELECT p_partkey, {d_parameter('t')} AS parameter, {d_wine_type('t')} AS wine_type FROM t
""")
def parameters_and_types(spark, sf_dir):
    label = F.expr("""CASE p_size % 10 WHEN 0 THEN 'Grado Alcohólico adquirido' WHEN 1 THEN 'acidez volátil real' WHEN 2 THEN 'Acidez total'
    WHEN 3 THEN 'anhídrido sulfuroso total' WHEN 4 THEN 'sulfuroso total' WHEN 5 THEN 'azúcares residuales tinto' WHEN 6 THEN 'Azúcares Totales blanco y rosado'
    WHEN 7 THEN 'alcohol adquirido cava' WHEN 8 THEN 'vi negre dulce' ELSE p_type END""")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", label).alias("t"))
    return parts.select("p_partkey", quantities.parameter_key("t").alias("parameter"), quantities.wine_type("t").alias("wine_type"))


@register("variety_names", f"""
WITH t AS (
  SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN ' **' || p_name || '** (' || p_brand || ')' WHEN 1 THEN '_' || upper(p_name) || '_' WHEN 2 THEN '- xarel·lo d''or ' || p_type
    WHEN 3 THEN p_size || ',' || p_partkey WHEN 4 THEN p_name || ' tinta' ELSE '≥ ' || p_name END AS t FROM part
), v AS (SELECT p_partkey, {d_clean_variety('t')} AS variety FROM t)
SELECT p_partkey, variety, {d_is_variety('variety')} AS is_valid FROM v
""")
def variety_names(spark, sf_dir):
    raw = F.expr("""CASE p_size % 6 WHEN 0 THEN concat(' **', p_name, '** (', p_brand, ')') WHEN 1 THEN concat('_', upper(p_name), '_')
    WHEN 2 THEN concat("- xarel·lo d'or ", p_type) WHEN 3 THEN concat(p_size, ',', p_partkey) WHEN 4 THEN concat(p_name, ' tinta') ELSE concat('≥ ', p_name) END""")
    cleaned = table(spark, sf_dir, "part").select("p_partkey", quantities.clean_variety(raw).alias("variety"))
    return cleaned.select("p_partkey", "variety", quantities.is_variety("variety").alias("is_valid"))


@register("table_blocks", f"""
{_BLOCKS}
SELECT path, table_ord::BIGINT AS table_ord, len(block) AS n_chars, md5(block) AS digest FROM blocks
""")
def table_blocks(spark, sf_dir):
    docs = D.table_corpus(spark, sf_dir)
    found = docs.select(
        F.concat_ws("/", "country", "folder", F.concat("source_file", F.lit(".md"))).alias("path"),
        F.posexplode(tables.table_blocks("markdown")).alias("n", "b"),
    )
    return found.select(
        "path", F.col("n").cast("long").alias("table_ord"), F.length("b").cast("long").alias("n_chars"), F.md5("b").alias("digest")
    )


@register("parsed_tables", f"""
{_PARSED}
SELECT path, table_ord::BIGINT AS table_ord, array_to_string(headers, '|') AS headers, len(body) AS n_rows,
       array_to_string(list_transform(body, lambda r: array_to_string(r, '|')), '#') AS body, kind
FROM kinds
""")
def parsed_tables(spark, sf_dir):
    t = tables.parsed_tables(D.table_corpus(spark, sf_dir))
    return t.select(
        "path", F.col("table_ord").cast("long").alias("table_ord"), F.array_join("headers", "|").alias("headers"),
        F.size("rows").cast("long").alias("n_rows"),
        F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "#").alias("body"), "kind",
    )


@register("table_kinds", f"""
{_PARSED}
SELECT coalesce(kind, 'none') AS kind, count(*) AS n FROM kinds GROUP BY 1
""")
def table_kinds(spark, sf_dir):
    t = tables.parsed_tables(D.table_corpus(spark, sf_dir))
    return t.groupBy(F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))


def _register_kind(kind: str) -> None:
    columns = COLUMNS[kind]
    extract_sql, rows = EXTRACTS[kind]

    @register(f"{kind}_extracted", f"{_PARSED},\n{extract_sql}\nSELECT path, table_ord::BIGINT AS table_ord, row_ord::BIGINT AS row_ord, {columns} FROM {rows}")
    def extracted(spark, sf_dir):
        found = tables.ROW_EXTRACTORS[kind](tables.parsed_tables(D.table_corpus(spark, sf_dir)))
        return found.select(
            "path", F.col("table_ord").cast("long").alias("table_ord"), F.col("row_ord").cast("long").alias("row_ord"), *columns.split(", ")
        )

    @register(f"{kind}_table", f"{_PARSED},\n{extract_sql},\n{d_loaded(kind)}\nSELECT {columns} FROM {kind}")
    def loaded(spark, sf_dir):
        found = tables.ROW_EXTRACTORS[kind](tables.parsed_tables(D.table_corpus(spark, sf_dir)))
        return tables.load_unique(found, kind).select(*columns.split(", "))


for _kind in EXTRACTS:
    _register_kind(_kind)


@register("load_counts", f"{ALL_TABLES}\n" + " UNION ALL ".join(
    f"SELECT '{k}' AS table_name, (SELECT count(*) FROM {EXTRACTS[k][1]}) AS offered, (SELECT count(*) FROM {k}) AS kept" for k in EXTRACTS))
def load_counts(spark, sf_dir):
    return tables.load_counts(D.table_corpus(spark, sf_dir))
