"""Registered queries: cleaning, splitting and searchable records."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern.functions import names, packing, text
from lectern.operators import catalog, graph, passages
from lectern.plans.registered import derived as D
from lectern.plans.registered.registry import register, table
from lectern.plans.registered.tables import d_any
from lectern.sources.layout import spread

RAW_EXTRACT = """concat('BOLETÍN OFICIAL DEL ESTADO Núm. ', doc_id, '{nl}', '**==> picture [', n_chars, ' x 4] intentionally omitted <==**', '{nl}',
    replace(replace(text, '. ', concat('.', '{nl}', '- ', doc_id, ' -', '{nl}{nl}{nl}{nl}')), ', ', concat(',', '{nl}', lang, '{nl}', lang, '{nl}')),
    '{nl}', '  Página 3  ', '{nl}', '## Pagina 4', '{nl}', source, '{nl}', '**DIRECCIÓN GENERAL DE INDUSTRIAS Y CALIDAD AGROALIMENTARIA**', '{nl}', source, '{nl}', ' ', source)"""


@register("clean_markdown", rf"""
WITH raw AS (
  SELECT doc_id, {RAW_EXTRACT.replace("'{nl}{nl}{nl}{nl}'", "chr(10) || chr(10) || chr(10) || chr(10)").replace("'{nl}'", "chr(10)")
                  .replace("' -', chr(10) ||", "' -' || chr(10) ||")} AS t FROM documents
), a AS (
  SELECT doc_id, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
      '\*\*==> picture .+? intentionally omitted <==\*\*', '', 'gi'),
      '(?m)^\s*-\s*\d+\s*-\s*$', '', 'g'),
      '(?mi)^\s*(P[àa]g[eií]na|Pagina|Page|Seite|Pág\.|Página)\s+\d+\s*$', '', 'g'),
      '(?mi)^BOLET[IÍ]N OFICIAL DEL ESTADO.*$', '', 'g'),
      '**DIRECCIÓN GENERAL DE INDUSTRIAS Y CALIDAD AGROALIMENTARIA**', '') AS t FROM raw
), b AS (SELECT doc_id, string_split(t, chr(10)) AS ls FROM a),
c AS (
  SELECT doc_id, array_to_string(list_filter(ls, lambda l, i: i = 1 OR {D.d_strip('l')} = '' OR {D.d_strip('l')} <> {D.d_strip('ls[i - 1]')}), chr(10)) AS t FROM b
), d AS (SELECT doc_id, {D.d_strip(r"regexp_replace(t, chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS t FROM c)
SELECT doc_id, len(t) AS n_chars, md5(t) AS digest FROM d
""")
def clean_markdown(spark, sf_dir):
    raw = spread(table(spark, sf_dir, "documents")).select("doc_id", F.expr(RAW_EXTRACT.replace("{nl}", "\\n")).alias("raw"))
    cleaned = raw.select("doc_id", text.clean_markdown("raw").alias("t"))
    return cleaned.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


@register("repeated_lines", f"""
WITH lines AS (
  SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
), marked AS (
  SELECT doc_id, i, line, lag({D.d_strip('line')}) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM lines
)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (prev IS NULL OR {D.d_strip('line')} = '' OR {D.d_strip('line')} <> prev) AS n_kept
FROM marked GROUP BY doc_id
""")
def repeated_lines(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text", text.drop_repeated_lines("text").alias("kept"))
    return docs.select(
        "doc_id",
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.size(F.split("kept", "\n")).cast("long").alias("n_kept"),
    )


@register("token_estimates", """
SELECT source, sum(len(text) // 4)::BIGINT AS tokens, max(len(text) // 4)::BIGINT AS largest,
       count(*) FILTER (len(text) // 4 > 800) AS over_limit
FROM documents GROUP BY source
""")
def token_estimates(spark, sf_dir):
    t = text.token_estimate("text")
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.sum(t).alias("tokens"), F.max(t).cast("long").alias("largest"), F.count_if(t > 800).alias("over_limit")
    )


@register("plain_page_text", """
SELECT page_id, md5(array_to_string(list_transform(string_split(html, '<p>'), lambda t, i:
       chr(10) || chr(10) || '## Pagina ' || i || chr(10) || chr(10) || t), chr(10))) AS digest FROM pages
""")
def plain_page_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.md5(text.plain_pages(F.split("html", "<p>"))).alias("digest"))


# heading sections in SQL: lines, a running count of accepted headings, one text per count
_HEADING_LINES = rf"""
lines AS (
  SELECT country, folder, source_file, i, ls[i] AS line FROM
    (SELECT country, folder, source_file, ls, unnest(range(1, len(ls) + 1)) AS i
     FROM (SELECT *, string_split(markdown, chr(10)) AS ls FROM marked))
), flagged AS (
  SELECT *, regexp_matches(line, '^#{{2,4}}\s+\S') AND NOT regexp_matches(line, '(?i)^#{{2,4}}\s+(pagina?|pàgina?|page|página?)\s+\d+') AS is_head FROM lines
), numbered AS (
  SELECT *, sum(is_head::INT) OVER (PARTITION BY country, folder, source_file ORDER BY i) AS sec FROM flagged
), heading_sections AS (
  SELECT country, folder, source_file, sec - 1 AS sec,
         {D.d_strip("regexp_replace(min(line) FILTER (is_head), '^#+', '')")} AS section,
         {D.d_strip("string_agg(line, chr(10) ORDER BY i)")} AS markdown
  FROM numbered WHERE sec > 0 GROUP BY ALL
)"""


@register("heading_sections", f"""
WITH {D.CORPUS}, {D.MARKDOWN}, {_HEADING_LINES}
SELECT source_file, sec::BIGINT AS section_no, section, len(markdown) AS n_chars, md5(markdown) AS digest FROM heading_sections
""")
def heading_sections(spark, sf_dir):
    docs = D.corpus(spark, sf_dir, "markdown")
    found = docs.select("source_file", F.posexplode(packing.heading_sections("markdown")).alias("n", "s"))
    return found.select(
        "source_file", F.col("n").cast("long").alias("section_no"), F.col("s.section").alias("section"),
        F.length("s.markdown").cast("long").alias("n_chars"), F.md5("s.markdown").alias("digest"),
    )


@register("section_ends", f"""
WITH {D.CORPUS}, {D.MARKDOWN}, {_HEADING_LINES},
starts AS (SELECT source_file, i, lead(i) OVER (PARTITION BY source_file ORDER BY i) AS next_i FROM numbered WHERE is_head)
SELECT source_file, i::BIGINT AS first_line, (coalesce(next_i, n + 1) - i)::BIGINT AS n_lines
FROM starts JOIN (SELECT source_file, max(i) AS n FROM lines GROUP BY 1) USING (source_file)
""")
def section_ends(spark, sf_dir):
    docs = D.corpus(spark, sf_dir, "markdown")

    def starts(lines):
        accepted = F.transform(
            lines,
            lambda s, i: F.when(
                F.rlike(s, F.lit(r"^#{2,4}\s+\S")) & ~F.rlike(s, F.lit(r"(?iu)^#{2,4}\s+(?:pagina?|pàgina?|page|página?)\s+\d+")), i + 1
            ),
        )
        return F.filter(accepted, lambda i: i.isNotNull())

    lined = docs.select("source_file", F.split("markdown", "\n").alias("lines")).select(
        "source_file", F.size("lines").alias("n"), starts(F.col("lines")).alias("starts")
    )
    spans = F.transform(
        "starts",
        lambda s, i: F.struct(s.alias("first"), (F.coalesce(F.get("starts", i + 1), F.col("n") + 1) - s).alias("n")),
    )
    return lined.select("source_file", F.explode(spans).alias("x")).select(
        "source_file", F.col("x.first").cast("long").alias("first_line"), F.col("x.n").cast("long").alias("n_lines")
    )


def _paragraph_fold(x: str) -> str:
    """Overlapping paragraphs in SQL: reduction over (open text, finished texts)."""
    words = lambda t: rf"list_filter(regexp_split_to_array({D.d_strip(t)}, '\s+'), lambda w: w <> '')"
    return f"""(CASE WHEN len({x}) = 0 THEN []::VARCHAR[] ELSE list_transform([list_reduce(
      list_transform({x}, lambda pp: struct_pack(cur := pp, done := []::VARCHAR[])),
      lambda a, b: CASE WHEN (len(a.cur) + len(b.cur)) // 4 > 800
        THEN struct_pack(cur := (CASE WHEN len({words('a.cur')}) > 100 THEN array_to_string({words('a.cur')}[-100:], ' ') ELSE '' END)
                                || chr(10) || chr(10) || b.cur,
                         done := list_append(a.done, {D.d_strip('a.cur')}))
        ELSE struct_pack(cur := a.cur || chr(10) || chr(10) || b.cur, done := a.done) END)],
      lambda r: list_append(r.done, {D.d_strip('r.cur')}))[1] END)"""


@register("paragraph_passages", f"""
WITH p AS (SELECT doc_id, {D.d_pieces("replace(text, chr(10), chr(10) || chr(10))", "chr(10) || chr(10)", "q")} AS ps FROM documents),
f AS (SELECT doc_id, {_paragraph_fold('ps')} AS cs FROM p),
e AS (SELECT doc_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM f)
SELECT doc_id, (i - 1)::BIGINT AS passage_no, 'General' AS section, len(cs[i]) AS n_chars, md5(cs[i]) AS digest FROM e
""")
def paragraph_passages(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("t"))
    found = docs.select("doc_id", F.posexplode(packing.paragraph_passages("t")).alias("n", "p"))
    return found.select(
        "doc_id", F.col("n").cast("long").alias("passage_no"), F.col("p.section").alias("section"),
        F.length("p.markdown").cast("long").alias("n_chars"), F.md5("p.markdown").alias("digest"),
    )


@register("line_packing", f"""
WITH f AS (SELECT doc_id, {D.d_pack(D.d_pieces("text", "chr(10)", "q"), "chr(10)", 3200, "k")} AS cs FROM documents),
e AS (SELECT doc_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM f)
SELECT doc_id, (i - 1)::BIGINT AS passage_no, len(cs[i]) AS n_chars, md5(cs[i]) AS digest FROM e
""")
def line_packing(spark, sf_dir):
    packed = packing.pack(text.stripped_pieces("text", "\n"), "\n", 3200)
    found = spread(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(packed).alias("n", "p"))
    return found.select(
        "doc_id", F.col("n").cast("long").alias("passage_no"),
        F.length("p").cast("long").alias("n_chars"), F.md5("p").alias("digest"),
    )


@register("hierarchical_split", f"""
WITH t AS (
  -- three shapes: as it is (lines), one line (sentences), no sentence ends (words)
  SELECT doc_id, 'lines' AS shape, text AS t FROM documents
  UNION ALL SELECT doc_id, 'sentences', replace(text, chr(10), ' ') FROM documents
  UNION ALL SELECT doc_id, 'words', replace(replace(replace(replace(text, chr(10), ' '), '.', ''), '!', ''), '?', '') FROM documents
), f AS (SELECT doc_id, shape, {D.d_split('t', 's')} AS cs FROM t),
e AS (SELECT doc_id, shape, cs, unnest(range(1, len(cs) + 1)) AS i FROM f)
SELECT doc_id, shape, (i - 1)::BIGINT AS passage_no, len(cs[i]) AS n_chars, md5(cs[i]) AS digest FROM e
""")
def hierarchical_split(spark, sf_dir):
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    shapes = F.array(
        F.struct(F.lit("lines").alias("shape"), F.col("text").alias("t")),
        F.struct(F.lit("sentences").alias("shape"), flat.alias("t")),
        F.struct(F.lit("words").alias("shape"), F.translate(flat, ".!?", "").alias("t")),
    )
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.explode(shapes).alias("x")).select("doc_id", "x.*")
    found = docs.select("doc_id", "shape", F.posexplode(packing.split_text(F.col("t"))).alias("n", "p"))
    return found.select(
        "doc_id", "shape", F.col("n").cast("long").alias("passage_no"),
        F.length("p").cast("long").alias("n_chars"), F.md5("p").alias("digest"),
    )


@register("long_section_split", f"""
WITH t AS (
  SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
           CASE WHEN i % 6 = 0 THEN repeat(l || ' ', 12) ELSE l END), chr(10) || chr(10)) AS t FROM documents
), p AS (SELECT doc_id, t, {D.d_pieces('t', 'chr(10) || chr(10)', 'q')} AS ps FROM t),
f AS (
  SELECT doc_id, CASE WHEN len(t) // 4 <= 800 THEN [t] ELSE list_transform([list_reduce(
      list_concat([struct_pack(cur := '', done := []::VARCHAR[])], list_transform(ps, lambda x: struct_pack(cur := x, done := []::VARCHAR[]))),
      lambda a, b: CASE
        WHEN len(b.cur) > 3200 THEN struct_pack(cur := '', done := list_concat(list_concat(a.done, CASE WHEN a.cur <> '' THEN [a.cur] ELSE [] END), {D.d_split('b.cur', 's')}))
        WHEN a.cur = '' THEN struct_pack(cur := b.cur, done := a.done)
        WHEN len(a.cur) + 2 + len(b.cur) > 3200 THEN struct_pack(cur := b.cur, done := list_append(a.done, a.cur))
        ELSE struct_pack(cur := a.cur || chr(10) || chr(10) || b.cur, done := a.done) END)],
      lambda r: list_concat(r.done, CASE WHEN r.cur <> '' THEN [r.cur] ELSE [] END))[1] END AS cs FROM p
), e AS (SELECT doc_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM f)
SELECT doc_id, (i - 1)::BIGINT AS passage_no, len(cs[i]) AS n_chars, md5(cs[i]) AS digest FROM e
""")
def long_section_split(spark, sf_dir):
    lines = F.transform(
        F.split("text", "\n"),
        lambda s, i: F.when((i + 1) % 6 == 0, F.repeat(F.concat(s, F.lit(" ")), F.lit(12))).otherwise(s),
    )
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.array_join(lines, "\n\n").alias("t"))
    found = docs.select("doc_id", F.posexplode(packing.split_long_section(F.col("t"))).alias("n", "p"))
    return found.select(
        "doc_id", F.col("n").cast("long").alias("passage_no"),
        F.length("p").cast("long").alias("n_chars"), F.md5("p").alias("digest"),
    )


# sections of every document: headings, or overlapping paragraphs without any
_SECTIONS = f"""
WITH {D.CORPUS}, {D.MARKDOWN}, {_HEADING_LINES},
pieces AS (
  SELECT m.*, {D.d_pieces('markdown', 'chr(10) || chr(10)', 'q')} AS ps FROM marked m
  WHERE NOT EXISTS (SELECT 1 FROM heading_sections h WHERE h.source_file = m.source_file)
), folded AS (SELECT country, folder, source_file, {_paragraph_fold('ps')} AS cs FROM pieces),
sections AS (
  SELECT country, folder, source_file, sec, section, markdown FROM heading_sections
  UNION ALL
  SELECT country, folder, source_file, i - 1, 'General', cs[i] FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS i FROM folded)
)"""


@register("flat_passages", f"""
{_SECTIONS},
long_split AS (
  SELECT source_file, sec, section, CASE WHEN section = 'General' OR len(markdown) // 4 <= 800 THEN [markdown]
    ELSE list_transform([list_reduce(
      list_concat([struct_pack(cur := '', done := []::VARCHAR[])], list_transform({D.d_pieces('markdown', 'chr(10) || chr(10)', 'q')}, lambda x: struct_pack(cur := x, done := []::VARCHAR[]))),
      lambda a, b: CASE
        WHEN len(b.cur) > 3200 THEN struct_pack(cur := '', done := list_concat(list_concat(a.done, CASE WHEN a.cur <> '' THEN [a.cur] ELSE [] END), {D.d_split('b.cur', 's')}))
        WHEN a.cur = '' THEN struct_pack(cur := b.cur, done := a.done)
        WHEN len(a.cur) + 2 + len(b.cur) > 3200 THEN struct_pack(cur := b.cur, done := list_append(a.done, a.cur))
        ELSE struct_pack(cur := a.cur || chr(10) || chr(10) || b.cur, done := a.done) END)],
      lambda r: list_concat(r.done, CASE WHEN r.cur <> '' THEN [r.cur] ELSE [] END))[1] END AS cs
  FROM sections
), e AS (SELECT *, unnest(range(1, len(cs) + 1)) AS i FROM long_split)
SELECT source_file, row_number() OVER (PARTITION BY source_file ORDER BY sec, i) - 1 AS passage_no, section,
       len(cs[i]) AS n_chars, md5(cs[i]) AS digest FROM e
""")
def flat_passages(spark, sf_dir):
    docs = D.corpus(spark, sf_dir, "markdown")
    found = docs.select("source_file", F.posexplode(packing.flat_passages("markdown")).alias("n", "p"))
    return found.select(
        "source_file", F.col("n").cast("long").alias("passage_no"), F.col("p.section").alias("section"),
        F.length("p.markdown").cast("long").alias("n_chars"), F.md5("p.markdown").alias("digest"),
    )


_PARENTS = f"""
{_SECTIONS},
cut AS (
  SELECT country, folder, source_file, sec, section,
         CASE WHEN len(markdown) > 6000 THEN {D.d_pack(D.d_split('markdown', 's'), '(chr(10) || chr(10))', 6000, 'm')} ELSE [markdown] END AS cs
  FROM sections
), parents AS (
  SELECT country, folder, source_file, section, cs[i] AS markdown,
         row_number() OVER (PARTITION BY source_file ORDER BY sec, i) - 1 AS parent_index
  FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS i FROM cut)
)"""


@register("parent_passages", f"""
{_PARENTS}
SELECT country || '__' || folder || '__' || source_file || '__parent_' || parent_index AS parent_id,
       country, folder, source_file AS pdf, section, len(markdown) AS n_chars, md5(markdown) AS digest FROM parents
""")
def parent_passages(spark, sf_dir):
    p = passages.parents_table(passages.with_passages(passages.with_document_metadata(D.corpus(spark, sf_dir, "markdown"))))
    return p.select(
        "parent_id", "country", "folder", "pdf", "section",
        F.length("markdown").cast("long").alias("n_chars"), F.md5("markdown").alias("digest"),
    )


_RECORDS = f"""
{_PARENTS},
first_split AS (
  SELECT *, CASE WHEN len(markdown) <= 800 THEN [markdown] ELSE {D.d_split('markdown', 's')} END AS c1 FROM parents
), second_split AS (
  SELECT *, CASE WHEN len(markdown) <= 800 THEN c1 ELSE
       flatten(list_transform(c1, lambda c: CASE WHEN len(c) > 800 THEN {D.d_split('c', 's')} ELSE [c] END)) END AS c2 FROM first_split
), children AS (
  SELECT country, folder, source_file, section, parent_index, c2[i] AS markdown, i
  FROM (SELECT *, unnest(range(1, len(c2) + 1)) AS i FROM second_split) WHERE len(c2[i]) >= 150
), records AS (
  SELECT country || '__' || folder || '__' || source_file || '__' ||
           (row_number() OVER (PARTITION BY source_file ORDER BY parent_index, i) - 1) AS chunk_id,
         country, folder, source_file, section,
         country || '__' || folder || '__' || source_file || '__parent_' || parent_index AS parent_id, markdown FROM children
  UNION ALL
  SELECT country || '__' || folder || '__' || source_file || '__parent_' || parent_index, country, folder, source_file, section,
         country || '__' || folder || '__' || source_file || '__parent_' || parent_index, markdown
  FROM parents WHERE len(markdown) >= 150
)"""


@register("chunk_records", f"""
{_RECORDS}
SELECT chunk_id, parent_id, country, folder, source_file, section,
       CASE WHEN folder LIKE 'DOP\\_%' ESCAPE '\\' THEN 'DOP' WHEN folder LIKE 'IGP\\_%' ESCAPE '\\' THEN 'IGP' ELSE 'knowledge' END AS gi_type,
       CASE WHEN regexp_matches(folder, '^(DOP|IGP)_') THEN substr(folder, 5) ELSE folder END AS gi_name,
       '' AS subcategory, c.language, len(markdown) AS n_chars, md5(markdown) AS digest
FROM records JOIN (SELECT source_file, language FROM corpus) c USING (source_file)
""")
def chunk_records(spark, sf_dir):
    docs = passages.with_document_metadata(D.corpus(spark, sf_dir, "markdown"))
    r = passages.chunk_records(passages.with_passages(docs))
    return r.select(
        "chunk_id", "parent_id", "country", "folder", "source_file", "section", "gi_type", "gi_name", "subcategory", "language",
        F.length("markdown").cast("long").alias("n_chars"), F.md5("markdown").alias("digest"),
    )


@register("chunk_totals", f"""
{_RECORDS}
SELECT country, count(*) AS n_chunks, count(DISTINCT folder) AS n_folders FROM records GROUP BY country
""")
def chunk_totals(spark, sf_dir):
    docs = passages.with_document_metadata(D.corpus(spark, sf_dir, "markdown"))
    r = passages.chunk_records(passages.with_passages(docs)).select("country", "folder")
    # two steps: a country may hold most rows, its folders are few
    per_folder = r.groupBy("country", "folder").agg(F.count("*").alias("n"))
    return per_folder.groupBy("country").agg(F.sum("n").alias("n_chunks"), F.count("*").alias("n_folders"))


@register("collection_prefixes", f"""
{_RECORDS}
SELECT split_part(chunk_id, '__', 1) AS collection, count(*) FILTER (chunk_id <> parent_id) AS n_children,
       count(*) FILTER (chunk_id = parent_id) AS n_parents FROM records GROUP BY 1
""")
def collection_prefixes(spark, sf_dir):
    docs = passages.with_document_metadata(D.corpus(spark, sf_dir, "markdown"))
    return catalog.collection_prefix_counts(passages.chunk_records(passages.with_passages(docs)))


@register("parent_id_parts", f"""
{_PARENTS}, ids AS (
  SELECT country || '__' || folder || '__' || source_file || '__parent_' || parent_index AS parent_id FROM parents
), bits AS (SELECT parent_id, string_split(parent_id, '__') AS b FROM ids)
SELECT parent_id, CASE WHEN len(b) >= 4 THEN b[1] END AS country, CASE WHEN len(b) >= 4 THEN b[2] END AS folder, CASE WHEN len(b) >= 4 THEN b[3] END AS pdf FROM bits
""")
def parent_id_parts(spark, sf_dir):
    p = passages.parents_table(passages.with_passages(passages.with_document_metadata(D.corpus(spark, sf_dir, "markdown"))))
    return p.select("parent_id", names.parse_parent_id("parent_id").alias("k")).select("parent_id", "k.country", "k.folder", "k.pdf")


_SECTIONS = rf"""
WITH {D.CORPUS}, {D.MARKDOWN},
lines AS (
  SELECT source_file, i, ls[i] AS line FROM (SELECT source_file, ls, unnest(range(1, len(ls) + 1)) AS i
    FROM (SELECT *, string_split(markdown, chr(10)) AS ls FROM marked))
), numbered AS (
  SELECT *, sum(regexp_matches(line, '^#{{2,3}}\s+\S')::INT) OVER (PARTITION BY source_file ORDER BY i) AS sec,
         regexp_matches(line, '^#{{2,3}}\s+\S') AS is_head FROM lines
), s AS (
  SELECT source_file, sec, coalesce({D.d_strip("trim(min(line) FILTER (is_head), '#')")}, 'Document') AS heading,
         {D.d_strip("coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT is_head), '')")} AS content FROM numbered GROUP BY ALL
)"""


@register("graph_sections", f"""
{_SECTIONS}
SELECT source_file, heading, len(content) AS n_chars, md5(content) AS digest FROM s WHERE len(content) > 80
""")
def graph_sections(spark, sf_dir):
    docs = D.corpus(spark, sf_dir, "markdown")
    found = docs.select("source_file", F.explode(packing.graph_sections("markdown")).alias("s"))
    return found.select(
        "source_file", F.col("s.section").alias("heading"),
        F.length("s.markdown").cast("long").alias("n_chars"), F.md5("s.markdown").alias("digest"),
    )


@register("interesting_sections", f"""
{_SECTIONS}
SELECT source_file, heading, md5(content) AS digest FROM s
WHERE len(content) >= 100 AND ({d_any("lower(heading)", V.SECTION_KEYWORDS)} OR {d_any("lower(left(content, 500))", V.SECTION_KEYWORDS)})
""")
def interesting_sections(spark, sf_dir):
    found = graph.interesting_sections(D.corpus(spark, sf_dir, "markdown"))
    return found.select("source_file", "heading", F.md5("content").alias("digest"))


@register("document_metadata", f"""
WITH {D.CORPUS}
SELECT source_file, folder, country, CASE WHEN regexp_matches(folder, '^(DOP|IGP)_') THEN left(folder, 3) ELSE 'knowledge' END AS gi_type,
       CASE WHEN doc_id % 4 = 1 THEN 'given ' || doc_id WHEN regexp_matches(folder, '^(DOP|IGP)_') THEN substr(folder, 5) ELSE folder END AS gi_name,
       CASE WHEN doc_id % 2 = 0 THEN 'part' ELSE '' END AS subcategory, CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE language END AS language
FROM corpus WHERE plain <> ''
""")
def document_metadata(spark, sf_dir):
    n = F.col("doc_id")
    docs = D.corpus(spark, sf_dir).withColumns({
        "gi_name": F.when(n % 4 == 1, F.concat(F.lit("given "), n.cast("string"))), "subcategory": F.when(n % 2 == 0, F.lit("part")),
        "language": F.when(n % 3 != 0, F.col("language")),
    })
    return passages.with_document_metadata(docs).drop("markdown")
