"""Document corpora that Spark (and the checking SQL) derive from the given tables.

Each derivation works on single rows, so a corpus grows with its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.registered.registry import table
from lectern.sources.layout import dealt, spread

NL = "chr(10)"


# --- a corpus of the documents table ---------------------------------------------------------

def corpus(spark: SparkSession, sf_dir: str, text: str = "text") -> DataFrame:
    """country, folder, source_file, language, markdown of every document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    folder = (
        F.when(F.col("lang") == "es", F.concat(F.lit("DOP_"), "source", F.lit("__alt_"), "lang"))
        .when(F.col("lang") == "fr", F.concat(F.lit("DOP_"), "source"))
        .when(F.col("lang") == "en", F.concat(F.lit("IGP_"), "source"))
        .otherwise(F.concat(F.lit("tema_"), "source"))
    )
    return docs.select(
        "doc_id",
        F.when(F.col("lang") == "de", F.lit("Coneixement")).otherwise(F.lit("Espanya")).alias("country"),
        folder.alias("folder"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source_file"),
        F.col("lang").alias("language"),
        (F.col("text") if text == "text" else markdown_of(F.col("text"))).alias("markdown"),
    )


CORPUS = """
corpus AS (
  SELECT doc_id,
         CASE WHEN lang = 'de' THEN 'Coneixement' ELSE 'Espanya' END AS country,
         CASE lang WHEN 'es' THEN 'DOP_' || source || '__alt_es' WHEN 'fr' THEN 'DOP_' || source
                   WHEN 'en' THEN 'IGP_' || source ELSE 'tema_' || source END AS folder,
         'doc_' || doc_id AS source_file, lang AS language, text AS plain
  FROM documents
)"""


def markdown_of(text):
    """Headings every 25 lines, page markers between them, a blank line every 4 lines."""
    def line(content, i):
        n = i.cast("string")
        head = (
            F.when(i % 25 == 5, F.concat(F.lit("## Secció "), n, F.lit("\n")))
            .when(i % 25 == 15, F.concat(F.lit("### Pàgina "), n, F.lit("\n")))
            .otherwise(F.lit(""))
        )
        return F.concat(head, content, F.when(i % 4 == 3, F.lit("\n\n")).otherwise(F.lit("\n")))

    return F.array_join(F.transform(F.split(text, "\n"), line), "")


MARKDOWN = """
marked AS (
  SELECT * EXCLUDE (plain), array_to_string(list_transform(string_split(plain, chr(10)), lambda l, i:
      (CASE WHEN (i - 1) % 25 = 5 THEN '## Secció ' || (i - 1) || chr(10)
            WHEN (i - 1) % 25 = 15 THEN '### Pàgina ' || (i - 1) || chr(10) ELSE '' END)
      || l || (CASE WHEN (i - 1) % 4 = 3 THEN chr(10) || chr(10) ELSE chr(10) END)), '') AS markdown
  FROM corpus
)"""


# --- a corpus with tables, one document per part ----------------------------------------------

TABLE_DOCUMENT = """concat(
  'Pliego ', p_partkey, '{nl}', '## Taules extretes amb IA', '{nl}{nl}',
  '### Taula (pàg. 1)', '{nl}{nl}',
  '| Vino | Grado alcohólico (% vol) | Acidez total g/l |', '{nl}', '|---|:---:|---|', '{nl}',
  '| ', CASE p_size % 4 WHEN 0 THEN 'Tinto' WHEN 1 THEN 'Blanco y rosado' WHEN 2 THEN 'Cava' ELSE 'Todos' END,
  ' | mín. ', p_size, ',5 | **', p_size % 9, '.', p_size % 7, '** máx |', '{nl}',
  '| Otros | 1', p_size % 5, ' | |', '{nl}{nl}',
  '### Taula (pàg. 2)', '{nl}',
  CASE WHEN p_size % 3 = 0 THEN concat('| Variedades blancas | Variedades tintas |', '{nl}', '|---|---|', '{nl}',
         '| *', p_name, '*, ', p_type, ' (', p_brand, ') | tinta ', p_name, ', ', upper(p_type), ' negra |')
       ELSE concat('| Variedad | Uso |', '{nl}', '|:--|--:|', '{nl}',
         '| ', p_name, ' | principal, ', CASE WHEN p_size % 2 = 0 THEN 'blanca' ELSE 'tinta' END, ' |', '{nl}',
         '| ', p_size, ' | secundaria |', '{nl}', '| ', p_type, ' ', p_size % 10, 'x | complementaria |') END,
  '{nl}{nl}', '### Taula (pàg. 3)', '{nl}',
  '| Tipo de uva | Rendimiento kg/ha | hl/ha |', '{nl}', '|---|---|---|', '{nl}',
  '| ', p_type, ' | ', 5 + p_size % 6, '.', 100 * (1 + p_size % 9), ' | ', p_size, ' |', '{nl}',
  '| uva ', p_size % 12, ' | 0 |', '{nl}{nl}',
  '### Taula (pàg. 4)', '{nl}',
  '| Municipio | Zona | Provincia |', '{nl}', '|---|---|---|', '{nl}',
  '| Villa ', p_partkey, ' | Zona ', p_type, ' | Provincia ', p_size % 8, ' |', '{nl}',
  '| Pueblo ', p_size, ' | Zona ', p_size % 6, ' |', '{nl}{nl}',
  '### Taula (pàg. 5)', '{nl}', '| Aspecto | Aroma | Sabor |', '{nl}', '|---|---|---|', '{nl}', '| limpio | frutal | suave |', '{nl}')"""

TABLE_FOLDER = """CASE WHEN p_size % 5 = 0 THEN concat('IGP_', replace(p_brand, '#', '_'), '__Alta')
     WHEN p_size % 11 = 0 THEN concat('libro_', replace(p_brand, '#', '_'))
     ELSE concat('DOP_', replace(p_brand, '#', '_')) END"""


def table_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """country, folder, source_file, markdown: one document with five tables per part."""
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")).select(
        F.lit("Espanya").alias("country"),
        F.expr(TABLE_FOLDER).alias("folder"),
        F.concat(F.lit("pliego_"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("source_file"),
        F.expr(TABLE_DOCUMENT.format(nl="\\n")).alias("markdown"),
    )


TABLE_CORPUS = f"""
table_corpus AS (
  SELECT 'Espanya' AS country, {TABLE_FOLDER} AS folder,
         'pliego_' || lpad(p_partkey::VARCHAR, 12, '0') AS source_file,
         {TABLE_DOCUMENT.format(nl="' || chr(10) || '").replace("'' || ", "").replace(" || ''", "")} AS markdown
  FROM part
)"""


# --- SQL building blocks (DuckDB) ----------------------------------------------------------------

def d_strip(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13))"


def d_pieces(x: str, separator: str, v: str) -> str:
    """Stripped, non-blank pieces; ``v`` is a fresh variable name."""
    return (
        f"list_filter(list_transform(string_split({x}, {separator}), lambda {v}: {d_strip(v)}), lambda {v}: {v} <> '')"
    )


def d_pack(parts: str, separator: str, limit: int, v: str) -> str:
    """Greedy packing as a pairwise reduction over (open text, finished texts)."""
    return f"""(CASE WHEN len({parts}) = 0 THEN []::VARCHAR[] ELSE list_transform([list_reduce(
        list_transform({parts}, lambda {v}p: struct_pack(cur := {v}p, done := []::VARCHAR[])),
        lambda {v}a, {v}b: CASE WHEN len({v}a.cur) + len({separator}) + len({v}b.cur) > {limit}
            THEN struct_pack(cur := {v}b.cur, done := list_append({v}a.done, {v}a.cur))
            ELSE struct_pack(cur := {v}a.cur || {separator} || {v}b.cur, done := {v}a.done) END)],
        lambda {v}r: list_append({v}r.done, {v}r.cur))[1] END)"""


def d_split(x: str, v: str, limit: int = 3200) -> str:
    """Hierarchical splitting of a text expression."""
    paras = d_pieces(x, "chr(10) || chr(10)", f"{v}q")
    lines = d_pieces(x, "chr(10)", f"{v}q")
    sentences = d_pieces(rf"regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g')", "chr(1)", f"{v}q")
    words = rf"list_filter(regexp_split_to_array({d_strip(x)}, '\s+'), lambda {v}w: {v}w <> '')"
    return f"""(CASE WHEN len({x}) <= {limit} THEN [{x}]
        WHEN len({paras}) > 1 THEN {d_pack(paras, "(chr(10) || chr(10))", limit, v + "1")}
        WHEN len({lines}) > 1 THEN {d_pack(lines, "chr(10)", limit, v + "2")}
        WHEN len({sentences}) > 1 THEN {d_pack(sentences, "' '", limit, v + "3")}
        ELSE {d_pack(words, "' '", limit, v + "4")} END)"""
