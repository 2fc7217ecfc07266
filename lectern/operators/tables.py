"""Markdown tables to typed relations with unique keys.

All steps up to the unique-key load work on single rows; only the load shuffles, and it sends
at most one row per key and task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern.config import DEFAULT, EngineConfig
from lectern.functions import names, quantities
from lectern.functions.text import col, contains_any, let, strip
from lectern.operators.lineage import cut_lineage
from lectern.operators.skew import first_per_key

# position of a row in the corpus: decides which of several rows with one key is kept
POSITION = ("country_ord", "path", "table_ord", "row_ord", "item_ord")

UNIQUE_KEYS = {
    "analytics": ("dop", "gi_type", "wine_type", "parameter", "relation"),
    "varieties": ("dop", "variety", "color"),
    "yields": ("dop", "variety", "wine_type"),
    "municipalities": ("dop", "municipality"),
}
VALUE_COLUMNS = {
    "analytics": ("value", "unit"),
    "varieties": ("gi_type", "role"),
    "yields": ("gi_type", "kg_ha", "hl_ha"),
    "municipalities": ("gi_type", "zone", "province"),
}


def table_blocks(markdown: Column | str) -> Column:
    """Texts of the sub-sections below the first table section."""
    section = F.get(F.split(col(markdown), rf"\Q{V.TABLES_SECTION_HEADER}\E"), F.lit(1))
    prefix = rf"(?U)\Q{V.TABLES_SUBSECTION_PREFIX}\E\s*\([^)]*\)"
    cut = F.split(F.coalesce(section, F.lit("")), prefix)
    return let(
        cut,
        lambda c: F.filter(
            F.transform(F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), strip), lambda b: b != ""
        ),
    )


def parse_table(text: Column | str) -> Column:
    """Struct (headers, columns, rows) of a pipe table; NULL without a header and a data row.

    ``columns`` are the distinct header cells, ``headers`` those the first data row fills.
    Every row is an array aligned with ``columns``, NULL where the row has no such cell.  Empty
    cells are taken out before, which moves later cells to the left; a repeated header keeps
    its first place and its last value.
    """
    def cells(line: Column) -> Column:
        return F.filter(F.transform(F.split(line, r"\|"), quantities.clean_cell), lambda c: c != "")

    def is_content(row: Column) -> Column:
        return (F.size(row) > 0) & F.exists(row, lambda c: ~F.rlike(c, F.lit(r"\A[-:]+\z")))

    lines = F.filter(F.transform(F.split(strip(text), "\n"), strip), lambda s: F.startswith(s, F.lit("|")))
    grid = F.filter(F.transform(lines, cells), is_content)

    def build(g: Column) -> Column:
        header = F.get(g, F.lit(0))
        body = F.slice(g, F.lit(2), F.greatest(F.size(g) - 1, F.lit(0)))

        def aligned(columns: Column) -> Column:
            def cell_of(row: Column) -> Callable[[Column], Column]:
                def pick(name: Column) -> Column:
                    usable = F.slice(header, F.lit(1), F.least(F.size(row), F.size(header)))
                    places = F.filter(F.transform(usable, lambda h, i: F.when(h == name, i)), lambda i: i.isNotNull())
                    return F.get(row, F.try_element_at(places, F.lit(-1)))

                return pick

            def row_values(row: Column) -> Column:
                padded = F.concat(
                    F.slice(row, F.lit(1), F.least(F.size(row), F.size(columns))),
                    F.array_repeat(F.lit(None).cast("string"), F.greatest(F.size(columns) - F.size(row), F.lit(0))),
                )
                # the general lookup is only needed when a header is repeated; values, unlike
                # headers, are cleaned a second time, which takes off mixed decorations
                values = F.when(F.size(columns) == F.size(header), padded).otherwise(
                    F.transform(columns, cell_of(row))
                )
                return F.transform(values, quantities.clean_cell)

            first = F.get(body, F.lit(0))
            filled = F.array_distinct(F.slice(header, F.lit(1), F.least(F.size(first), F.size(header))))
            return F.struct(
                filled.alias("headers"), columns.alias("columns"), F.transform(body, row_values).alias("rows")
            )

        return F.when(F.size(g) > 1, let(F.array_distinct(header), aligned))

    return let(grid, build)


def classify_table(headers: Column, columns: Column) -> Column:
    """Kind of a table by its header words; NULL for sensory and unknown tables."""
    head = F.lower(F.array_join(headers, " "))

    def kind(texts: Column) -> Column:
        head, both = texts["head"], texts["both"]
        sensory = sum((F.contains(both, F.lit(w)).cast("int") for w in V.SENSORY_WORDS), F.lit(0))
        return (
            F.when(sensory >= 3, F.lit(None).cast("string"))
            .when(contains_any(head, V.YIELD_COLUMN_WORDS), F.lit("yields"))
            .when(contains_any(head, V.VARIETY_COLUMN_WORDS), F.lit("varieties"))
            .when(contains_any(head, V.MUNICIPALITY_COLUMN_WORDS), F.lit("municipalities"))
            .when(contains_any(both, [h for h, _, _ in V.PARAMETERS]), F.lit("analytics"))
        )

    both = F.concat(head, F.lit(" "), F.lower(F.array_join(columns, " ")))
    return let(F.struct(head.alias("head"), both.alias("both")), kind)


def parsed_tables(docs: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """One row per recognised table of the corpus.

    ``docs`` has (country, folder, source_file, markdown).
    """
    country_ord = F.coalesce(
        *[F.when(F.col("country") == c, F.lit(i)) for i, c in enumerate(V.SUPPORTED_COUNTRIES)]
    )
    blocks = (
        # a document without the section has no blocks; a test before would make derived documents twice
        docs.withColumn("country_ord", country_ord)
        .filter("country_ord is not null")
        .select(
            "country_ord",
            F.concat_ws("/", "country", "folder", F.concat("source_file", F.lit(".md"))).alias("path"),
            F.concat("source_file", F.lit(".md")).alias("source_file"),
            names.display_name("folder").alias("dop"),
            names.gi_type("folder", otherwise="unknown").alias("gi_type"),
            F.posexplode(table_blocks("markdown")).alias("table_ord", "block"),
        )
    )
    # generated, not projected: every block is parsed and named once, whatever is asked of the result
    once = F.filter(F.array(parse_table("block")), lambda t: t.isNotNull())
    named = F.transform(once, lambda t: t.withField("kind", classify_table(t["headers"], t["columns"])))
    parsed = blocks.withColumn("t", F.explode(named)).drop("block")
    return parsed.select(
        "country_ord", "path", "source_file", "dop", "gi_type", "table_ord",
        F.col("t.headers").alias("headers"), F.col("t.columns").alias("columns"), F.col("t.rows").alias("rows"),
        F.col("t.kind").alias("kind"),
    )


def table_rows(tables: DataFrame, kind: str) -> DataFrame:
    return tables.filter(F.col("kind") == kind).select(
        "country_ord", "path", "source_file", "dop", "gi_type", "table_ord", "headers",
        F.posexplode("rows").alias("row_ord", "cells"),
    )


def _header_index(headers: Column, test: Callable[[Column], Column], last: bool = False) -> Column:
    """0-based index of the first (or last) header that passes, NULL when none does."""
    hits = F.filter(
        F.transform(headers, lambda h, i: F.when(test(F.lower(h)), i)), lambda i: i.isNotNull()
    )
    return F.try_element_at(hits, F.lit(-1 if last else 1))


def _cell(index: Column) -> Column:
    return F.coalesce(F.get(F.col("cells"), index), F.lit(""))


def _row_text() -> Column:
    """Values of the row, joined: cells the row does not have are left out."""
    return F.lower(F.array_join(F.filter("cells", lambda c: c.isNotNull()), " "))


def _row_wine_type() -> Column:
    return quantities.wine_type(F.concat(_row_text(), F.lit(" "), F.array_join("headers", " ")))


def _exploded(rows: DataFrame, items: Column) -> DataFrame:
    """Explode an array of structs; its position becomes the last part of the row position."""
    return rows.select(
        "country_ord", "path", "table_ord", "row_ord", "dop", "gi_type", "source_file",
        F.posexplode(items).alias("item_ord", "x"),
    )


def _once(rows: DataFrame, **values: Column) -> DataFrame:
    """The values as columns; generated, so that later filters and columns do not compute them again."""
    made = rows.withColumn("_x", F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))
    return made.withColumns({k: F.col("_x")[k] for k in values}).drop("_x")


def analytics_rows(tables: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    headers = F.col("headers")
    two = F.size(headers) == 2
    param_col = F.when(two, F.lit(0)).otherwise(
        F.coalesce(_header_index(headers, lambda h: contains_any(h, V.PARAMETER_COLUMN_WORDS)), F.lit(0))
    )
    named_value_cols = F.filter(
        F.transform(headers, lambda h, i: F.when(contains_any(F.lower(h), V.VALUE_COLUMN_WORDS), i)),
        lambda i: i.isNotNull(),
    )
    value_cols = F.when(two, F.array(F.lit(1))).otherwise(named_value_cols)
    rows = (
        table_rows(tables, "analytics")
        .withColumn("pc", param_col)
        .withColumn("vcs", value_cols)
        .withColumn("row_type", _row_wine_type())
    )
    by_column = F.transform(
        F.col("vcs"),
        lambda i: F.struct(
            F.coalesce(
                quantities.parameter_key(_cell(F.col("pc"))), quantities.parameter_key(F.get(F.col("headers"), i))
            ).alias("parameter"),
            F.coalesce(F.get(F.col("cells"), i), F.lit("")).alias("raw"),
            F.col("row_type").alias("wine_type"),
        ),
    )
    by_cell = F.transform(
        headers,
        lambda h, i: F.struct(
            quantities.parameter_key(F.coalesce(F.get(F.col("cells"), i), F.lit(""))).alias("parameter"),
            F.coalesce(F.get(F.col("cells"), i), F.lit("")).alias("raw"),
            h.alias("wine_type"),
        ),
    )
    items = F.filter(
        F.when(F.size("vcs") > 0, by_column).otherwise(by_cell), lambda x: x["parameter"].isNotNull()
    )
    return (
        _exploded(rows, items)
        .withColumn("q", F.explode(F.array(quantities.quantity(F.col("x.raw"), cfg.strict_units))))
        .select(
            *POSITION, "dop", "gi_type",
            F.col("x.wine_type").alias("wine_type"), F.col("x.parameter").alias("parameter"),
            F.col("q.value").alias("value"),
            F.coalesce("q.unit", quantities.default_unit(F.col("x.parameter")), F.lit("")).alias("unit"),
            F.coalesce("q.relation", F.lit("target")).alias("relation"),
            "source_file",
        )
    )


def variety_rows(tables: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    headers = F.col("headers")
    rows = (
        table_rows(tables, "varieties")
        .withColumn("white", _header_index(headers, lambda h: F.contains(h, F.lit("blanc")), last=True))
        .withColumn("red", _header_index(headers, lambda h: contains_any(h, ("tint", "negre")), last=True))
        .withColumn("single", _header_index(headers, lambda h: contains_any(h, V.VARIETY_COLUMN_WORDS)))
        .withColumn("row_text", _row_text())
    )
    text = F.col("row_text")

    def item(name: Column, color: Column, role: Column) -> Column:
        return F.struct(quantities.clean_variety(name).alias("variety"), color.alias("color"), role.alias("role"))

    def listed(index: Column, color: str) -> Column:
        return F.transform(F.split(_cell(index), ","), lambda n: item(n, F.lit(color), F.lit("autorizada")))

    color = (
        F.when(contains_any(text, ("blanca", "blanco", "blanc")), F.lit("blanca"))
        .when(contains_any(text, ("tinta", "tinto", "negre")), F.lit("tinta"))
        .otherwise(F.lit("unknown"))
    )
    role = (
        F.when(F.contains(text, F.lit("principal")), F.lit("principal"))
        .when(contains_any(text, ("secundar", "complementar")), F.lit("secundaria"))
        .otherwise(F.lit("autorizada"))
    )
    two_columns = F.col("white").isNotNull() & F.col("red").isNotNull()
    items = F.when(
        two_columns, F.concat(listed(F.col("white"), "blanca"), listed(F.col("red"), "tinta"))
    ).otherwise(F.array(item(_cell(F.col("single")), color, role)))
    found = _exploded(rows, items).select(
        *POSITION, "dop", "gi_type", F.col("x.variety").alias("variety"),
        F.col("x.color").alias("color"), F.col("x.role").alias("role"), "source_file",
    )
    return found.filter(quantities.is_variety("variety", cfg.whole_word_rejects))


def yield_rows(tables: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    def reading(h: Column, i: Column) -> Column:
        raw = F.coalesce(F.get(F.col("cells"), i), F.lit(""))
        both = F.concat(F.lower(h), F.lit("\n"), F.lower(raw))
        unit = (
            F.when(F.contains(both, F.lit("kg/ha")), F.lit("kg"))
            .when(F.contains(both, F.lit("hl/ha")), F.lit("hl"))
            .when(F.contains(both, F.lit("kg")), F.lit("kg"))
        )
        return F.struct(quantities.quantity_value(raw).alias("v"), unit.alias("u"))

    def last_of(unit: str) -> Column:
        hits = F.filter("readings", lambda r: (r["u"] == unit) & r["v"].isNotNull())
        return F.try_element_at(hits, F.lit(-1))["v"]

    first = _cell(F.lit(0))
    read = _once(table_rows(tables, "yields"), readings=F.transform("headers", reading), wine_type=_row_wine_type())
    return (
        _once(read, kg_ha=last_of("kg"), hl_ha=last_of("hl"))
        .select(
            "country_ord", "path", "table_ord", "row_ord", F.lit(0).alias("item_ord"), "dop", "gi_type", "wine_type",
            F.when(F.length(first) > 2, first).otherwise(F.col("wine_type")).alias("variety"),
            "kg_ha", "hl_ha", "source_file",
        )
        .filter((F.coalesce("kg_ha", F.lit(0.0)) != 0) | (F.coalesce("hl_ha", F.lit(0.0)) != 0))
    )


def municipality_rows(tables: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    headers = F.col("headers")

    def has(*words: str) -> Callable[[Column], Column]:
        return lambda h: contains_any(h, words)

    def zone_not_municipality(h: Column) -> Column:
        return F.contains(h, F.lit("zona")) & ~F.contains(h, F.lit("municipi"))

    def province_only(h: Column) -> Column:
        return contains_any(h, ("provincia", "província")) & ~contains_any(h, ("municipi", "zona"))

    def optional(index: Column) -> Column:
        return F.nullif(strip(_cell(index)), F.lit(""))

    town = F.coalesce(_header_index(headers, has("municipi"), last=True), F.lit(0))
    named = _once(
        table_rows(tables, "municipalities"),
        municipality=strip(_cell(town)),
        zone=optional(_header_index(headers, zone_not_municipality, last=True)),
        province=optional(_header_index(headers, province_only, last=True)),
    )
    return (
        named.select(
            "country_ord", "path", "table_ord", "row_ord", F.lit(0).alias("item_ord"), "dop", "gi_type",
            "municipality", "zone", "province", "source_file",
        )
        .filter(F.length("municipality") >= 2)
    )


ROW_EXTRACTORS: dict[str, Callable[..., DataFrame]] = {
    "analytics": analytics_rows,
    "varieties": variety_rows,
    "yields": yield_rows,
    "municipalities": municipality_rows,
}


def load_unique(rows: DataFrame, kind: str) -> DataFrame:
    """First row per unique key, in corpus order."""
    return first_per_key(rows, UNIQUE_KEYS[kind], POSITION)


def build_tables(docs: DataFrame, cfg: EngineConfig = DEFAULT) -> dict[str, DataFrame]:
    """The four relations; documents are read and parsed once, the parsed tables are written out."""
    parsed = cut_lineage(parsed_tables(docs, cfg).filter("kind is not null"))
    return {kind: cut_lineage(load_unique(extract(parsed, cfg), kind)) for kind, extract in ROW_EXTRACTORS.items()}


def load_counts(docs: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Rows offered to each table and rows kept after the unique keys."""
    parsed = cut_lineage(parsed_tables(docs, cfg).filter("kind is not null"))
    counts = None
    for kind, extract in ROW_EXTRACTORS.items():
        # one row per key first: (offered per key), then sums; both combine before the shuffle
        per_key = extract(parsed, cfg).groupBy(*UNIQUE_KEYS[kind]).agg(F.count("*").alias("n"))
        one = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("offered"), F.count("*").alias("kept"))
        one = one.select(F.lit(kind).alias("table_name"), "offered", "kept")
        counts = one if counts is None else counts.unionByName(one)
    return counts
