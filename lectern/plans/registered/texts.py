"""Registered queries: names, keywords, language tags and model replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern.functions import language, names, replies, text
from lectern.operators import catalog, evaluation, matching
from lectern.plans import readonly_sql
from lectern.plans.registered import derived as D
from lectern.plans.registered.registry import register, table
from lectern.sources.layout import spread
from lectern.plans.registered.tables import d_any, d_display, d_title


@register("folder_names", f"""
WITH {D.CORPUS}
SELECT doc_id, CASE WHEN regexp_matches(folder, '^(DOP|IGP)_') THEN left(folder, 3) ELSE 'knowledge' END AS gi_type,
       CASE WHEN regexp_matches(folder, '^(DOP|IGP)_') THEN substr(folder, 5) ELSE folder END AS gi_name,
       {d_display('folder')} AS display_name, regexp_matches(folder, '^(DOP|IGP)_') AS is_gi,
       CASE WHEN regexp_matches(folder, '^(DOP|IGP)_') THEN left(folder, 3) ELSE 'unknown' END AS table_type
FROM corpus
""")
def folder_names(spark, sf_dir):
    docs = D.corpus(spark, sf_dir)
    return docs.select(
        "doc_id", names.folder_info("folder").alias("i"), names.gi_type("folder", otherwise="unknown").alias("table_type")
    ).select("doc_id", "i.*", "table_type")


@register("path_categories", """
WITH t AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN split_part(split_part(url, '://', 2), '/', 2) || '/'
             ELSE split_part(split_part(url, '://', 2), '/', 2) || '/' || split_part(split_part(url, '://', 2), '/', 1) || '/' END || page_id || '.pdf' AS rel FROM pages),
p AS (SELECT page_id, string_split(rel, '/')[:-2] AS d FROM t)
SELECT page_id, coalesce(d[1], 'general') AS category, coalesce(d[2], '') AS subcategory,
       CASE WHEN len(d) > 0 THEN array_to_string(d, '/') ELSE 'general' END AS folder FROM p
""")
def path_categories(spark, sf_dir):
    rest = F.split_part("url", F.lit("://"), F.lit(2))
    host, lang = F.split_part(rest, F.lit("/"), F.lit(1)), F.split_part(rest, F.lit("/"), F.lit(2))
    directory = (
        F.when(F.col("page_id") % 3 == 0, F.lit("")).when(F.col("page_id") % 3 == 1, F.concat(lang, F.lit("/")))
        .otherwise(F.concat(lang, F.lit("/"), host, F.lit("/")))
    )
    rel = F.concat(directory, F.col("page_id").cast("string"), F.lit(".pdf"))
    return table(spark, sf_dir, "pages").select("page_id", names.categorize(rel).alias("c")).select("page_id", "c.*")


_FILES = """
files AS (
  SELECT CASE lang WHEN 'es' THEN 'DOP_' || source || '__alt_es' WHEN 'fr' THEN 'DOP_' || source WHEN 'en' THEN 'IGP_' || source ELSE 'tema_' || source END AS folder,
         'doc_' || doc_id || CASE WHEN n_chars % 5 = 0 THEN '.txt' ELSE '.pdf' END AS file FROM documents
)"""


def _files(spark, sf_dir):
    docs = D.corpus(spark, sf_dir)
    n_chars = F.length("markdown")
    return docs.select("folder", F.concat("source_file", F.when(n_chars % 5 == 0, F.lit(".txt")).otherwise(F.lit(".pdf"))).alias("file"))


@register("designation_discovery", f"""
WITH {_FILES}
SELECT folder, substr(folder, 5) AS display_name, left(folder, 3) AS gi_type, count(*) AS n_pdfs, min(file) AS first_pdf
FROM files WHERE regexp_matches(folder, '^(DOP|IGP)_') AND file LIKE '%.pdf' GROUP BY folder
""")
def designation_discovery(spark, sf_dir):
    return catalog.discover_designations(_files(spark, sf_dir))


@register("designation_filter", f"""
WITH {_FILES}
SELECT folder, file FROM files WHERE regexp_matches(folder, '^(DOP|IGP)_') AND file LIKE '%.pdf' AND contains(lower(substr(folder, 5)), 'src1')
""")
def designation_filter(spark, sf_dir):
    return catalog.designation_pdfs(_files(spark, sf_dir), "SRC1")


@register("designation_list", f"""
WITH {D.CORPUS}
SELECT DISTINCT country, folder, {d_display('folder')} AS name,
       CASE WHEN regexp_matches(folder, '^(DOP|IGP)_') THEN left(folder, 3) ELSE 'knowledge' END AS type FROM corpus
""")
def designation_list(spark, sf_dir):
    return catalog.list_designations(D.corpus(spark, sf_dir))


@register("designation_list_filtered", f"""
WITH {D.CORPUS}
SELECT DISTINCT country, folder, {d_display('folder')} AS name, 'DOP' AS type FROM corpus WHERE country = 'Espanya' AND folder LIKE 'DOP%'
""")
def designation_list_filtered(spark, sf_dir):
    return catalog.list_designations(D.corpus(spark, sf_dir), "Espanya", "DOP")


@register("pending_documents", """
SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
""")
def pending_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return catalog.pending(docs, table(spark, sf_dir, "labels"), ["doc_id"])


@register("extraction_status", """
SELECT CASE WHEN l.doc_id IS NOT NULL THEN 'skipped' WHEN d.n_chars < 150 THEN 'errors' ELSE 'extracted' END AS status, count(*) AS n
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1
""")
def extraction_status(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") < 150, F.lit("too short")).alias("error"))
    return catalog.extraction_status(docs, table(spark, sf_dir, "labels"), ["doc_id"])


_LANG_SCORES = ", ".join(
    f"struct_pack(hits := len(list_filter(ws, lambda w: w IN ({', '.join(repr(w) for w in ws)}))), ord := {-i}, lang := '{lang}')"
    for i, (lang, ws) in enumerate(language.FREQUENT_WORDS.items())
)
_LANG = rf"""
tokens AS (SELECT doc_id, regexp_extract_all(lower(left(text, 500)), '\p{{L}}+') AS ws FROM documents),
best AS (SELECT doc_id, list_max([{_LANG_SCORES}]) AS b FROM tokens),
tagged AS (SELECT doc_id, CASE WHEN b.hits > 0 THEN b.lang ELSE 'unknown' END AS language FROM best)"""


@register("language_tags", f"WITH {_LANG} SELECT doc_id, language FROM tagged")
def language_tags(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", language.detect_language("text").alias("language"))


@register("language_counts", f"WITH {_LANG} SELECT language, count(*) AS n FROM tagged GROUP BY language")
def language_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(language.detect_language("text").alias("language"))
    return catalog.language_counts(docs)


@register("folded_text", """
SELECT doc_id, md5(translate(lower(text), 'èéàòíúüç', 'eeaoiuuc')) AS digest FROM documents
""")
def folded_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.fold_accents("text")).alias("digest"))


@register("entity_names", rf"""
WITH t AS (SELECT page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS t FROM pages)
SELECT page_id, trim(regexp_replace({d_title(D.d_strip('t'))}, '\s+', ' ', 'g')) AS name FROM t
""")
def entity_names(spark, sf_dir):
    heading = F.regexp_extract("html", r"<h1>(.*?)</h1>", 1)
    return table(spark, sf_dir, "pages").select("page_id", text.entity_name(heading).alias("name"))


@register("explicit_mentions", rf"""
WITH q AS (
  SELECT c_custkey, CASE c_custkey % 5
    WHEN 0 THEN 'Varietats de la DOP Vall de ' || n_name || ' i IGP Terra ' || initcap_name || '?'
    WHEN 1 THEN 'igp de la Serra d''' || initcap_name || ', molt seca. dop ' || initcap_name || '-Nord amb pluja'
    WHEN 2 THEN 'DOP ' || lower(c_mktsegment) || ' o DOP ' || initcap_name
    WHEN 3 THEN 'vi de ' || n_name
    ELSE 'DOP ' || initcap_name || ' los Alts y DOP ' || initcap_name || ' los Alts' END AS q
  FROM (SELECT *, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS initcap_name FROM customer JOIN nation ON c_nationkey = n_nationkey)
), m AS (
  SELECT c_custkey, i, string_split(trim(ms[i]), ' ') AS ws FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT c_custkey, regexp_extract_all(q, '(?:DOP|dop|IGP|igp)\s+(?:de\s+)?(?:la\s+)?(?:el\s+)?([A-ZÀ-Ü][\p{{L}}\p{{N}}_\s\-'']+?)(?:\s*[.,?"'']|\s+i\s+|\s+y\s+|\s+o\s+|\s+a\s+|\s+amb\s+|\s*$)', 1) AS ms FROM q))
), good AS (
  SELECT c_custkey, i, ws, list_transform(ws, lambda w, j: regexp_matches(w, '^\p{{Lu}}') OR (j > 1 AND lower(w) IN ('de', 'del', 'dels', 'los', 'las', 'la', 'el', 'y', 'i', 'd', 'd'''))) AS ok FROM m
), named AS (
  SELECT c_custkey, i, array_to_string(ws[1:coalesce(nullif(list_position(ok, false), 0), len(ws) + 1) - 1], '_') AS name FROM good
), firsts AS (SELECT c_custkey, name, min(i) AS i FROM named WHERE name <> '' GROUP BY ALL)
SELECT c_custkey, coalesce(string_agg(name, '|' ORDER BY f.i), '') AS names FROM q LEFT JOIN firsts f USING (c_custkey) GROUP BY c_custkey
""")
def explicit_mentions(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).withColumn("s", F.initcap(F.lower("c_mktsegment")))
    q = F.expr("""CASE c_custkey % 5
    WHEN 0 THEN concat('Varietats de la DOP Vall de ', n_name, ' i IGP Terra ', s, '?')
    WHEN 1 THEN concat("igp de la Serra d'", s, ', molt seca. dop ', s, '-Nord amb pluja')
    WHEN 2 THEN concat('DOP ', lower(c_mktsegment), ' o DOP ', s)
    WHEN 3 THEN concat('vi de ', n_name)
    ELSE concat('DOP ', s, ' los Alts y DOP ', s, ' los Alts') END""")
    return asked.select("c_custkey", F.array_join(names.explicit_mentions(q), "|").alias("names"))


# gaps and islands over word tokens: runs of capitalised words with only blanks between them
_ENTITY_RUNS = r"""
tokens AS (
  SELECT conv_id, turn, i, ts[i] AS tok FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM (
    SELECT conv_id, turn, regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+|\s+|[^\p{L}\p{N}\p{M}_\s]+') AS ts FROM conversations))
), typed AS (
  SELECT *, regexp_full_match(tok, '[A-ZÀ-Ü][a-zà-ü]+') AS is_name, regexp_full_match(tok, '\s+') AS is_blank FROM tokens
), islands AS (
  SELECT *, sum(CASE WHEN is_name OR is_blank THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS isle FROM typed
), runs AS (
  SELECT conv_id, turn, isle, min(i) AS i, trim(string_agg(tok, '' ORDER BY i), ' ' || chr(10) || chr(9) || chr(13)) AS name
  FROM islands WHERE is_name OR is_blank GROUP BY ALL HAVING bool_or(is_name)
), singles AS (SELECT conv_id, turn, i, tok AS name FROM typed WHERE is_name AND len(tok) >= 3)"""
_STOPS = ", ".join(f"'{w}'" for w in V.ENTITY_STOP_WORDS)


@register("entity_mentions", f"""
WITH {_ENTITY_RUNS},
r AS (SELECT * FROM runs WHERE len(name) > 2 AND lower(name) NOT IN ({_STOPS})),
s AS (SELECT conv_id, turn, name, min(i) AS i FROM singles WHERE lower(name) NOT IN ({_STOPS}) GROUP BY ALL),
both_kinds AS (
  SELECT conv_id, turn, name, 0 AS k, i FROM r
  UNION ALL SELECT conv_id, turn, name, 1, i FROM s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.conv_id = s.conv_id AND r.turn = s.turn AND r.name = s.name)
)
SELECT conv_id, turn, count(b.name) AS n_names, md5(coalesce(string_agg(b.name, '|' ORDER BY b.k, b.i), '')) AS digest
FROM conversations LEFT JOIN both_kinds b USING (conv_id, turn) GROUP BY conv_id, turn
""")
def entity_mentions(spark, sf_dir):
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", names.entity_mentions("text").alias("m"))
    return found.select("conv_id", "turn", F.size("m").cast("long").alias("n_names"), F.md5(F.array_join("m", "|")).alias("digest"))


def _benchmark_names(spark, sf_dir):
    """Designations named after the first two words of each benchmark text."""
    first = F.array_join(F.slice(F.split(F.regexp_replace("text", r"\s+", " "), " "), 1, 2), "_")
    return table(spark, sf_dir, "benchmark").select(
        F.when(F.col("item_id") % 4 == 0, F.concat(first, F.lit("__"), F.reverse(first))).otherwise(first).alias("gi_name")
    ).distinct().withColumn("display_name", F.replace(F.replace("gi_name", F.lit("__"), F.lit(" / ")), F.lit("_"), F.lit(" ")))


_BENCHMARK_NAMES = r"""
firsts AS (SELECT item_id, array_to_string(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ')[1:2], '_') AS f FROM benchmark),
designations AS (SELECT DISTINCT CASE WHEN item_id % 4 = 0 THEN f || '__' || reverse(f) ELSE f END AS gi_name FROM firsts)"""


@register("lexicon_mentions", f"""
WITH {_BENCHMARK_NAMES},
forms AS (
  SELECT gi_name, lower(replace(replace(gi_name, '__', ' / '), '_', ' ')) AS form FROM designations
  UNION SELECT gi_name, replace(lower(gi_name), '_', ' ') FROM designations
  UNION SELECT gi_name, trim(replace(unnest(string_split(lower(gi_name), '__')), '_', ' ')) FROM designations WHERE contains(gi_name, '__')
), texts AS (SELECT doc_id, replace(replace(lower(text), '-', ' '), '_', ' ') AS q FROM documents)
SELECT DISTINCT doc_id, gi_name FROM texts JOIN forms ON len(form) >= 4 AND contains(q, form)
""")
def lexicon_mentions(spark, sf_dir):
    return matching.lexicon_mentions(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", _benchmark_names(spark, sf_dir))


@register("fuzzy_nodes", f"""
WITH {_ENTITY_RUNS},
entities AS (SELECT DISTINCT name AS entity FROM runs WHERE len(name) > 2 AND lower(name) NOT IN ({_STOPS})),
nodes AS (SELECT lower(name) || CASE WHEN ord % 2 = 0 THEN '' ELSE ' é' END AS name, ord FROM (
    SELECT array_to_string(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ')[1:1 + (doc_id % 2)::INT], ' ') AS name, min(doc_id) AS ord FROM documents GROUP BY 1)
  UNION ALL SELECT array_to_string(string_split(text, ' ')[1:2], ' '), 1000000000 + item_id FROM benchmark),
folded AS (SELECT *, translate(lower(name), 'èéàòíúüç', 'eeaoiuuc') AS nf FROM nodes),
fe AS (SELECT *, translate(lower(entity), 'èéàòíúüç', 'eeaoiuuc') AS ef FROM entities),
tiers AS (
  SELECT entity, name, ord, CASE WHEN entity = name THEN 1 WHEN ef = nf THEN 2
      WHEN len(name) > 2 AND ef NOT IN ('es', 'en', 'de', 'el', 'la', 'los', 'del', 'dop') AND (contains(nf, ef) OR contains(ef, nf)) THEN 3 END AS tier
  FROM fe, folded
)
SELECT entity, name, tier FROM tiers WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity ORDER BY tier, ord, name) = 1
""")
def fuzzy_nodes(spark, sf_dir):
    runs = F.regexp_extract_all("text", F.lit(V.ENTITY_RUN_PATTERN), F.lit(1))
    entities = table(spark, sf_dir, "conversations").select(F.explode(runs).alias("entity")).distinct().filter(
        (F.length("entity") > 2) & ~F.lower("entity").isin(*V.ENTITY_STOP_WORDS)
    )
    docs = table(spark, sf_dir, "documents")
    words = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    named = docs.select(
        F.array_join(F.slice(words, F.lit(1), (1 + F.col("doc_id") % 2).cast("int")), " ").alias("name"), "doc_id"
    ).groupBy("name").agg(F.min("doc_id").alias("ord"))
    nodes = named.select(
        F.concat(F.lower("name"), F.when(F.col("ord") % 2 == 0, F.lit("")).otherwise(F.lit(" é"))).alias("name"), "ord"
    ).unionByName(table(spark, sf_dir, "benchmark").select(
        F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("name"), (F.lit(1000000000) + F.col("item_id")).alias("ord")
    ))
    return matching.match_many(entities, nodes)


STOP_WORDS = ("dans", "avec", "pour", "that", "with", "sich", "nicht", "para")
BILINGUAL = {"elle": "ella", "tion": "cion", "hand": "mano", "mentre": "mientras", "sch": "esc", "ication": "cacion"}


@register("query_keywords", rf"""
WITH w AS (
  SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(text, '[a-zA-Zà-üÀ-Ü]{{4,}}'), lambda x: lower(x)),
      lambda x: x NOT IN ({", ".join(f"'{s}'" for s in STOP_WORDS)}) AND NOT contains('la_tion'.replace('_', ' '), x) AND NOT contains(x, 'la tion') AND NOT contains('elleau', x) AND NOT contains(x, 'elleau')) AS ks
  FROM conversations
), e AS (SELECT conv_id, turn, list_distinct(list_concat(ks, flatten(list_transform(ks, lambda k: flatten(list_transform(
      list_filter([{", ".join(f"struct_pack(a := '{a}', b := '{b}')" for a, b in BILINGUAL.items())}], lambda p: starts_with(p.a, k) OR starts_with(k, p.a)),
      lambda p: [p.a, p.b])))))) AS ks FROM w)
SELECT conv_id, turn, len(ks) AS n_keywords, md5(array_to_string(list_sort(ks), '|')) AS digest FROM e
""".replace("'la_tion'.replace('_', ' ')", "'la tion'"))
def query_keywords(spark, sf_dir):
    ks = names.query_keywords("text", F.array(F.lit("La_tion"), F.lit("Elleau")), STOP_WORDS, BILINGUAL)
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", ks.alias("k"))
    # order by bytes in both engines
    return found.select("conv_id", "turn", F.size("k").cast("long").alias("n_keywords"), F.md5(F.array_join(F.array_sort("k"), "|")).alias("digest"))


@register("occurrences", """
SELECT doc_id, sum((len(lower(text)) - len(replace(lower(text), k, ''))) // len(k))::BIGINT AS hits
FROM documents, (SELECT unnest(['que', 'the', 'aa', 'ell']) AS k) GROUP BY doc_id
""")
def occurrences(spark, sf_dir):
    total = sum((text.count_occurrences(F.lower("text"), F.lit(k)) for k in ("que", "the", "aa", "ell")), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", total.cast("long").alias("hits"))


@register("truncated_texts", """
SELECT doc_id, len(a) AS a, len(b) AS b, md5(a || b || c) AS digest FROM (
  SELECT doc_id, CASE WHEN len(text) > 1500 THEN left(text, 1500) || '...' ELSE text END AS a, left(text, 500) AS b,
         CASE WHEN len(text) > 3000 THEN left(text, 3000) || chr(10) || chr(10) || '[... truncated ...]' ELSE text END AS c FROM documents)
""")
def truncated_texts(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select(
        "doc_id", text.truncate("text", 1500, "...").alias("a"), text.truncate("text", 500).alias("b"),
        evaluation.faithfulness_context(F.array("text")).alias("c"),
    )
    return t.select("doc_id", F.length("a").cast("long").alias("a"), F.length("b").cast("long").alias("b"), F.md5(F.concat("a", "b", "c")).alias("digest"))


@register("judge_snippets", r"""
SELECT conv_id, turn, md5('[1] ' || replace(left(text, 300), chr(10), ' ') || CASE WHEN len(text) > 300 THEN '...' ELSE '' END || chr(10)
   || '[2] ' || replace(left(role || chr(10), 300), chr(10), ' ')) AS digest FROM conversations
""")
def judge_snippets(spark, sf_dir):
    both = F.array(F.col("text"), F.concat("role", F.lit("\n")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(evaluation.numbered_snippets(both)).alias("digest"))


@register("section_filter", f"""
WITH {D.CORPUS}
SELECT doc_id, {d_any('lower(folder)', V.SECTION_KEYWORDS)} AS by_heading, {d_any('lower(left(plain, 500))', V.SECTION_KEYWORDS)} AS by_opening
FROM corpus WHERE len(plain) >= 100 AND ({d_any('lower(folder)', V.SECTION_KEYWORDS)} OR {d_any('lower(left(plain, 500))', V.SECTION_KEYWORDS)})
""")
def section_filter(spark, sf_dir):
    docs = D.corpus(spark, sf_dir)
    heading = text.contains_any(F.lower("folder"), V.SECTION_KEYWORDS)
    opening = text.contains_any(F.lower(F.left("markdown", F.lit(500))), V.SECTION_KEYWORDS)
    return docs.filter((F.length("markdown") >= 100) & (heading | opening)).select(
        "doc_id", heading.alias("by_heading"), opening.alias("by_opening")
    )


# --- statements offered to the SQL tool ----------------------------------------------------------

_STATEMENT = """CASE p_partkey % 10
    WHEN 0 THEN concat('SELECT * FROM part WHERE p_name = "', p_name, '"')
    WHEN 1 THEN concat('  select ', p_size, ' ;  ')
    WHEN 2 THEN concat('WITH a AS (SELECT ', p_size, ') SELECT * FROM a')
    WHEN 3 THEN concat('DELETE FROM ', p_name)
    WHEN 4 THEN concat('select 1; drop table ', p_name)
    WHEN 5 THEN concat('select replace(p_name, update) from ', p_type)
    WHEN 6 THEN concat('select drop_table, created from ', p_brand)
    WHEN 7 THEN ' '
    WHEN 8 THEN concat('select 1 /* Insert', p_size, 'CREATE*/')
    ELSE concat('explain select ', p_name) END"""


@register("sql_guard", rf"""
WITH s AS (SELECT p_partkey, {_STATEMENT.replace('"', '"')} AS q FROM part),
b AS (SELECT p_partkey, CASE WHEN ends_with(trim(q), ';') THEN trim(trim(q)[:-2]) ELSE trim(q) END AS q FROM s)
SELECT p_partkey, CASE WHEN q = '' THEN 'Empty query.' WHEN contains(q, ';') THEN 'Multi-statement queries ('';'') are not allowed.'
    WHEN NOT (starts_with(lower(q), 'select') OR starts_with(lower(q), 'with')) THEN 'Only SELECT queries are allowed.'
    WHEN len(hit) > 0 THEN 'Keyword(s) not allowed: ' || array_to_string(hit, ', ') || '.' END AS verdict
FROM (SELECT *, list_sort(list_intersect(regexp_split_to_array(lower(q), '[^a-z_]+'), [{", ".join(f"'{w}'" for w in V.BLOCKED_SQL_WORDS)}])) AS hit FROM b)
""")
def sql_guard(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", readonly_sql.guard(F.expr(_STATEMENT)).alias("verdict"))


# --- replies of a model ---------------------------------------------------------------------------

_REPLY = """CASE event_id % 6
    WHEN 0 THEN concat('[{"subject": "user ', user_id, '", "subject_type": "DOP", "predicate": "', upper(event_type), '", "object": "', event_type, '", "object_type": "Zone", "attrs": ', props, '}]')
    WHEN 1 THEN concat('```json', '{nl}', '[{"subject": "user ', user_id, '", "predicate": "P", "object": "x"}, {"subject": "', event_type, '", "predicate": "Q", "object": "user ', user_id, '"}]', '{nl}', '```')
    WHEN 2 THEN concat('Aquí: [{"subject": "user ', user_id, '", "predicate": "P", "object": "o", "attrs": {"a": "b",},},]')
    WHEN 3 THEN concat('no triples for ', event_type)
    WHEN 4 THEN concat('[{subject: "user ', user_id, '", predicate: "R", object: "', event_type, '", object_type: undefined}]')
    ELSE concat('first [', '{nl}', '{"subject": "user ', user_id, '", "predicate": "L", "object": "a"}', '{nl}', '{"subject": broken}', '{nl}', '{"subject": "', event_type, '", "predicate": "L", "object": "b",}', '{nl}', '] end') END"""


def reply_sql() -> str:
    return _REPLY.replace("'{nl}'", "chr(10)")


def reply_column():
    return F.expr(_REPLY.replace("{nl}", "\\n"))


@register("reply_triples", r"""
WITH base AS (SELECT event_id, user_id, event_type, props, event_id % 6 AS k FROM events),
t AS (
  SELECT event_id, 0 AS i, 'user ' || user_id AS subject, 'DOP' AS subject_type, upper(event_type) AS predicate, event_type AS object, 'Zone' AS object_type, json_extract_string(props, '$.k') AS attr FROM base WHERE k = 0
  UNION ALL SELECT event_id, 0, 'user ' || user_id, NULL, 'P', 'x', NULL, NULL FROM base WHERE k = 1
  UNION ALL SELECT event_id, 1, event_type, NULL, 'Q', 'user ' || user_id, NULL, NULL FROM base WHERE k = 1
  UNION ALL SELECT event_id, 0, 'user ' || user_id, NULL, 'P', 'o', NULL, 'b' FROM base WHERE k = 2
  UNION ALL SELECT event_id, 0, 'user ' || user_id, NULL, 'R', event_type, '', NULL FROM base WHERE k = 4
  UNION ALL SELECT event_id, 0, 'user ' || user_id, NULL, 'L', 'a', NULL, NULL FROM base WHERE k = 5
  UNION ALL SELECT event_id, 1, event_type, NULL, 'L', 'b', NULL, NULL FROM base WHERE k = 5
)
SELECT event_id, i::BIGINT AS triple_no, subject, subject_type, predicate, object, object_type, attr FROM t
""")
def reply_triples(spark, sf_dir):
    parsed = spread(table(spark, sf_dir, "events")).select("event_id", F.posexplode(replies.parse_triples(reply_column())).alias("n", "t"))
    attr = F.coalesce(F.try_element_at("t.attrs", F.lit("k")), F.try_element_at("t.attrs", F.lit("a")))
    return parsed.select(
        "event_id", F.col("n").cast("long").alias("triple_no"), "t.subject", "t.subject_type", "t.predicate", "t.object", "t.object_type", attr.alias("attr")
    )


_CLAIMS = """CASE doc_id % 4
    WHEN 0 THEN concat('```json', '{nl}', '[{"claim": "a", "verdict": "', CASE WHEN quality = 1 THEN 'SUPPORTED' ELSE 'CONTRADICTED' END, '"}, {"claim": "b", "verdict": "SUPPORTED"}, 7]', '{nl}', '```')
    WHEN 1 THEN concat('[{"verdict": "', CASE WHEN toxic = 1 THEN 'UNVERIFIABLE' ELSE 'SUPPORTED' END, '"}, {"verdict": "UNVERIFIABLE"}]')
    WHEN 2 THEN '{"verdict": "SUPPORTED"}'
    ELSE concat('not json ', doc_id) END"""
_RELEVANCE = """CASE doc_id % 4
    WHEN 0 THEN concat('[{"passage": "p", "score": ', 1 + quality, '}, {"passage": "q", "score": ', 3 - toxic, '}, {"score": "3"}]')
    WHEN 1 THEN concat('```', '{nl}', '[{"score": ', 1 + doc_id % 3, '}]', '{nl}', '```')
    WHEN 2 THEN '[]'
    ELSE '[{"score": null}]' END"""
_SCALE = """CASE doc_id % 5 WHEN 0 THEN concat('Score: ', 1 + doc_id % 3, '/5') WHEN 1 THEN concat('12 then ', 4 + quality) WHEN 2 THEN 'none 77'
    WHEN 3 THEN concat('', 1 + toxic * 4) ELSE concat('10', doc_id % 7, ' 9 ', 1 + quality) END"""

_JUDGED_SQL = rf"""
judged AS (
  SELECT doc_id, d.text AS answer, (d.n_chars % 6) AS n_contexts, CASE WHEN doc_id % 7 = 0 THEN '' ELSE d.source END AS ground_truth, quality, toxic,
         {_SCALE} AS scale_raw FROM documents d JOIN labels l USING (doc_id)
), s AS (
  SELECT doc_id, n_contexts = 0 AS skipped, ground_truth,
    CASE doc_id % 4 WHEN 0 THEN (1 + quality) / 3.0 WHEN 1 THEN (1 - toxic) / 2.0 ELSE 0.0 END AS f,
    CASE doc_id % 4 WHEN 0 THEN (quality / 2.0 + (2 - toxic) / 2.0) / 2 WHEN 1 THEN (doc_id % 3) / 2.0 ELSE 0.0 END AS c,
    coalesce((try_cast(regexp_extract(scale_raw, '(^|[^0-9])([1-5])([^0-9]|$)', 2) AS INT) - 1) / 4.0, 0.0) AS a FROM judged
), scores AS (
  SELECT doc_id, skipped, CASE WHEN NOT skipped THEN f END AS faithfulness, CASE WHEN NOT skipped THEN a END AS answer_relevancy,
         CASE WHEN NOT skipped THEN c END AS context_relevancy, CASE WHEN NOT skipped AND ground_truth <> '' THEN a END AS ground_truth_accuracy FROM s
)"""


def _judged(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return both.select(
        F.col("doc_id").cast("string").alias("question"), F.col("text").alias("answer"), (F.col("n_chars") % 6).alias("n_contexts"),
        F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.col("source")).alias("ground_truth"),
        F.expr(_CLAIMS.replace("{nl}", "\\n")).alias("faithfulness_raw"), F.expr(_RELEVANCE.replace("{nl}", "\\n")).alias("context_relevancy_raw"),
        F.expr(_SCALE).alias("answer_relevancy_raw"), F.expr(_SCALE).alias("ground_truth_raw"),
    )


@register("answer_scores", f"""
WITH {_JUDGED_SQL}
SELECT doc_id, skipped, round(faithfulness, 6) AS faithfulness, round(answer_relevancy, 6) AS answer_relevancy,
       round(context_relevancy, 6) AS context_relevancy, round(ground_truth_accuracy, 6) AS ground_truth_accuracy FROM scores
""")
def answer_scores(spark, sf_dir):
    s = evaluation.score_answers(_judged(spark, sf_dir))
    return s.select(F.col("question").cast("long").alias("doc_id"), "skipped", *[F.round(m, 6).alias(m) for m in evaluation.METRICS])


@register("metric_means", f"""
WITH {_JUDGED_SQL}
SELECT unnest(['faithfulness', 'answer_relevancy', 'context_relevancy', 'ground_truth_accuracy']) AS metric,
       unnest([round(avg(faithfulness), 3), round(avg(answer_relevancy), 3), round(avg(context_relevancy), 3), round(avg(ground_truth_accuracy), 3)]) AS mean
FROM scores
""")
def metric_means(spark, sf_dir):
    return evaluation.metric_means(evaluation.score_answers(_judged(spark, sf_dir)))


@register("scale_scores", f"""
WITH r AS (SELECT doc_id, {_SCALE} AS raw FROM labels)
SELECT doc_id, try_cast(regexp_extract(raw, '(^|[^0-9])([1-5])([^0-9]|$)', 2) AS INT) AS score FROM r
""")
def scale_scores(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", replies.scale_score(F.expr(_SCALE)).alias("score"))


@register("tool_results_json", """
SELECT s_suppkey, '{"name":"' || s_name || '","nation":' || s_nationkey || ',"type":"é"}' AS content FROM supplier
""")
def tool_results_json(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.to_json(F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.lit("é").alias("type"))).alias("content")
    )


@register("metadata_defaults", """
SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, coalesce(json_extract_string(props, '$.language'), 'unknown') AS language FROM events
""")
def metadata_defaults(spark, sf_dir):
    m = F.from_json("props", "k string, language string")
    return table(spark, sf_dir, "events").select("event_id", m.alias("m")).select(
        "event_id", F.coalesce("m.k", F.lit("")).alias("k"), F.coalesce("m.language", F.lit("unknown")).alias("language")
    )
