"""Registered queries: nearest passages, parents, re-ranking, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.config import EngineConfig
from lectern.functions import names
from lectern.operators import passages, vectors
from lectern.plans.registered import derived as D
from lectern.plans.registered.registry import register, table

QUESTION = "Quelle ouèche des DOP Src3 aune pareille que leau tionement ? with thereing schaft"
CONFIG = EngineConfig(stop_words=("with", "quelle"), bilingual={"leau": "agua", "tion": "cion", "pareil": "parejo"})
GI_NAMES = ("src3", "src11__alt_es")


def probe_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of the embedding with the lowest id: one row."""
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]


def chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector store: the document of each vector, three neighbours share a parent."""
    docs = D.corpus(spark, sf_dir).withColumnRenamed("doc_id", "vec_id").withColumnRenamed("markdown", "document")
    vecs = table(spark, sf_dir, "embeddings")
    joined = docs.join(vecs, "vec_id")
    n = F.col("vec_id")
    return joined.select(
        F.concat(F.lit("c"), F.lpad(n.cast("string"), 12, "0")).alias("chunk_id"),
        F.when(F.col("label") < 7, F.lit("Espanya")).otherwise(F.lit("Coneixement")).alias("country"),
        "folder", "source_file", names.gi_type("folder").alias("gi_type"), names.gi_name("folder").alias("gi_name"),
        F.concat(F.lit("s"), F.col("label").cast("string")).alias("section"),
        F.when(n % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("p"), F.floor(n / 3).cast("string"))).alias("parent_id"),
        "document", "embedding", "label",
    )


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second parent exists in the parents table."""
    docs = table(spark, sf_dir, "documents")
    return docs.filter((F.col("doc_id") % 6) == 0).select(
        F.concat(F.lit("p"), F.floor(F.col("doc_id") / 3).cast("string")).alias("parent_id"),
        F.col("source").alias("section"), F.concat(F.lit("PARENT "), "text").alias("markdown"),
    )


_STORE = f"""
{D.CORPUS},
store AS (
  SELECT 'c' || lpad(vec_id::VARCHAR, 12, '0') AS chunk_id, CASE WHEN label < 7 THEN 'Espanya' ELSE 'Coneixement' END AS country,
         folder, source_file, CASE WHEN regexp_matches(folder, '^(DOP|IGP)_') THEN left(folder, 3) ELSE 'knowledge' END AS gi_type,
         CASE WHEN regexp_matches(folder, '^(DOP|IGP)_') THEN substr(folder, 5) ELSE folder END AS gi_name, 's' || label AS section,
         CASE WHEN vec_id % 5 = 0 THEN '' ELSE 'p' || (vec_id // 3) END AS parent_id, plain AS document, label, vec_id,
         round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), 12) AS distance
  FROM corpus JOIN embeddings ON vec_id = doc_id
), parents AS (
  SELECT 'p' || (doc_id // 3) AS parent_id, source AS parent_section, 'PARENT ' || text AS parent_text FROM documents WHERE doc_id % 6 = 0
)"""

_HITS = f"""
{_STORE},
per_country AS (
  SELECT * FROM store WHERE country IN ('Espanya', 'Coneixement')
  QUALIFY row_number() OVER (PARTITION BY country ORDER BY distance, chunk_id) <= 40
), deduped AS (
  SELECT *, CASE country WHEN 'Espanya' THEN 0 ELSE 1 END AS co FROM per_country
  QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(parent_id, ''), chunk_id) ORDER BY distance, CASE country WHEN 'Espanya' THEN 0 ELSE 1 END, chunk_id) = 1
), cut AS (SELECT * FROM deduped ORDER BY distance, co, chunk_id LIMIT 40),
hits AS (SELECT cut.* EXCLUDE (document), coalesce(parent_text, document) AS document, parent_section FROM cut LEFT JOIN parents USING (parent_id))"""

_KEYWORDS = ["ouèche", "aune", "pareille", "leau", "tionement", "thereing", "schaft", "agua", "tion", "cion", "pareil", "parejo"]
_TEXT = "(lower(document) || ' ' || lower(section))"
_SCORE = f"""0.3 * greatest(0.0, 1 - distance)
  + 0.5 * least(({" + ".join(f"(len({_TEXT}) - len(replace({_TEXT}, '{k}', ''))) // {len(k)}" for k in _KEYWORDS)}) / {len(_KEYWORDS)}.0, 1.0)
  + CASE WHEN {" OR ".join(f"contains(replace(lower(gi_name), '_', ' '), '{n.replace('_', ' ')}') OR contains('{n.replace('_', ' ')}', replace(lower(gi_name), '_', ' '))" for n in GI_NAMES)} THEN 0.4 ELSE 0.0 END"""

_RANKED = f"""
{_HITS},
ranked AS (
  SELECT *, {_SCORE} AS score, row_number() OVER (ORDER BY round({_SCORE}, 9) DESC, distance, co, chunk_id) AS ref FROM hits
)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.nearest_per_collection(
        chunk_store(spark, sf_dir), probe_vector(spark, sf_dir), 40, ("Espanya", "Coneixement")
    )
    return vectors.with_parent_text(vectors.best_per_parent(found, 40), parents(spark, sf_dir))


def ranked(spark: SparkSession, sf_dir: str, top_k: int = 10) -> DataFrame:
    return vectors.rerank(hits(spark, sf_dir), QUESTION, top_k, GI_NAMES, CONFIG)


@register("nearest_vectors", """
SELECT vec_id, label, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), 6) + 0.0 AS distance
FROM embeddings ORDER BY round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), 12), vec_id LIMIT 20
""")
def nearest_vectors(spark, sf_dir):
    found = vectors.nearest(table(spark, sf_dir, "embeddings"), probe_vector(spark, sf_dir), 20, id_col="vec_id")
    return found.select("vec_id", "label", (F.round("distance", 6) + 0.0).alias("distance"))


@register("all_distances", """
SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), 6) + 0.0 AS distance FROM embeddings
""")
def all_distances(spark, sf_dir):
    d = vectors.cosine_distance("embedding", probe_vector(spark, sf_dir))
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.round(d, 6) + 0.0).alias("distance"))


@register("filtered_nearest", f"""
WITH {_STORE}
SELECT chunk_id, gi_name, round(distance, 6) + 0.0 AS distance FROM store WHERE gi_type = 'DOP' AND gi_name IN ('src1', 'src2', 'src3__alt_es', 'src5')
ORDER BY store.distance, chunk_id LIMIT 12
""")
def filtered_nearest(spark, sf_dir):
    wanted = vectors.metadata_filter(chunk_store(spark, sf_dir), "DOP", ["src1", "src2", "src3__alt_es", "src5"])
    found = vectors.nearest(wanted, probe_vector(spark, sf_dir), 12)
    return found.select("chunk_id", "gi_name", (F.round("distance", 6) + 0.0).alias("distance"))


@register("nearest_per_collection", f"""
WITH {_STORE}
SELECT chunk_id, label, round(distance, 6) + 0.0 AS distance FROM store QUALIFY row_number() OVER (PARTITION BY label ORDER BY store.distance, chunk_id) <= 5
""")
def nearest_per_collection(spark, sf_dir):
    found = vectors.nearest_per_collection(chunk_store(spark, sf_dir), probe_vector(spark, sf_dir), 5, by="label")
    return found.select("chunk_id", "label", (F.round("distance", 6) + 0.0).alias("distance"))


_ASKED = f"""
{_STORE},
asked AS (SELECT vec_id AS question_id, embedding::DOUBLE[] AS query, gi_name AS own, vec_id % 3 = 0 AS named FROM store JOIN embeddings USING (vec_id) WHERE vec_id % 20 = 0),
near AS (
  SELECT question_id, s.label, chunk_id, CASE WHEN named THEN 7 ELSE 4 END AS k, parent_id, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], query), 12) + 0.0 AS distance
  FROM asked, store s JOIN embeddings e USING (vec_id) WHERE NOT named OR s.gi_name IN (own, 'src1', 'src2')
  QUALIFY row_number() OVER (PARTITION BY question_id, s.label ORDER BY round(1 - list_cosine_similarity(e.embedding::DOUBLE[], query), 12), chunk_id) <= CASE WHEN named THEN 7 ELSE 4 END)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector as a question; every third of them names its own source and two more."""
    store = chunk_store(spark, sf_dir).select(F.substring("chunk_id", 2, 12).cast("long").alias("question_id"), F.col("embedding").alias("query"), "gi_name")
    named = F.col("question_id") % 3 == 0
    return store.filter("question_id % 20 = 0").select(
        "question_id", "query", F.when(named, 7).otherwise(4).alias("k"), F.when(named, F.array("gi_name", F.lit("src1"), F.lit("src2"))).alias("gi_names"),
    )


@register("nearest_for_questions", f"""
WITH {_ASKED}
SELECT question_id, label, chunk_id, round(distance, 6) + 0.0 AS distance FROM near
""")
def nearest_for_questions(spark, sf_dir):
    found = vectors.nearest_for_each(chunk_store(spark, sf_dir), asked(spark, sf_dir), by="label")
    return found.select("question_id", "label", "chunk_id", (F.round("distance", 6) + 0.0).alias("distance"))


@register("questions_best_per_parent", f"""
WITH {_ASKED},
best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY question_id, coalesce(nullif(parent_id, ''), chunk_id) ORDER BY near.distance, chunk_id) = 1)
SELECT question_id, chunk_id, round(distance, 6) + 0.0 AS distance FROM best QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY best.distance, chunk_id) <= k
""")
def questions_best_per_parent(spark, sf_dir):
    questions = asked(spark, sf_dir)
    near = vectors.nearest_for_each(chunk_store(spark, sf_dir), questions, by="label")
    hits = near.join(chunk_store(spark, sf_dir).select("chunk_id", "parent_id"), "chunk_id").join(questions.select("question_id", "k"), "question_id")
    return vectors.best_per_parent_of_each(hits).select("question_id", "chunk_id", (F.round("distance", 6) + 0.0).alias("distance"))


@register("best_per_parent", f"""
WITH {_HITS}
SELECT chunk_id, country, parent_id, round(distance, 6) + 0.0 AS distance FROM cut
""")
def best_per_parent(spark, sf_dir):
    found = vectors.nearest_per_collection(
        chunk_store(spark, sf_dir), probe_vector(spark, sf_dir), 40, ("Espanya", "Coneixement")
    )
    return vectors.best_per_parent(found, 40).select("chunk_id", "country", "parent_id", (F.round("distance", 6) + 0.0).alias("distance"))


@register("hits_with_parents", f"""
WITH {_HITS}
SELECT chunk_id, parent_id, parent_section, md5(document) AS digest FROM hits
""")
def hits_with_parents(spark, sf_dir):
    return hits(spark, sf_dir).select("chunk_id", "parent_id", "parent_section", F.md5("document").alias("digest"))


@register("parent_lookup", f"""
WITH {_STORE}
SELECT chunk_id, s.parent_id, parent_section, parent_text IS NOT NULL AS found FROM store s LEFT JOIN parents p ON s.parent_id = p.parent_id
""")
def parent_lookup(spark, sf_dir):
    known = parents(spark, sf_dir).select("parent_id", F.col("section").alias("parent_section"), F.lit(True).alias("found"))
    looked = chunk_store(spark, sf_dir).select("chunk_id", "parent_id").join(known, "parent_id", "left")
    return looked.select("chunk_id", "parent_id", "parent_section", F.coalesce("found", F.lit(False)).alias("found"))


@register("hybrid_rerank", f"""
WITH {_RANKED}
SELECT chunk_id, ref, round(score, 6) AS score FROM ranked WHERE ref <= 10
""")
def hybrid_rerank(spark, sf_dir):
    return ranked(spark, sf_dir).select("chunk_id", F.col("ref").cast("long").alias("ref"), F.round("score", 6).alias("score"))


@register("rerank_untouched", f"""
WITH {_HITS}
SELECT chunk_id, row_number() OVER (ORDER BY distance, co, chunk_id) AS ref FROM hits
""")
def rerank_untouched(spark, sf_dir):
    return ranked(spark, sf_dir, top_k=40).select("chunk_id", F.col("ref").cast("long").alias("ref"))


@register("hybrid_scores", f"""
WITH {_STORE}
SELECT chunk_id, round({_SCORE}, 6) AS score FROM store
""")
def hybrid_scores(spark, sf_dir):
    wanted = vectors.string_array(GI_NAMES)
    keywords = names.query_keywords(F.lit(QUESTION), wanted, CONFIG.stop_words, CONFIG.bilingual)
    store = chunk_store(spark, sf_dir).withColumn("k", keywords)
    score = vectors.hybrid_score(
        F.col("document"), F.col("section"), F.col("gi_name"), vectors.cosine_distance("embedding", probe_vector(spark, sf_dir)),
        F.col("k"), wanted, CONFIG,
    )
    return store.select("chunk_id", F.round(score, 6).alias("score"))


@register("retrieval_citations", f"""
WITH {_RANKED}
SELECT ref::VARCHAR AS ref, gi_name, gi_type, section, source_file, country FROM ranked WHERE ref <= 10
""")
def retrieval_citations(spark, sf_dir):
    return vectors.citations(ranked(spark, sf_dir))


@register("retrieval_context", f"""
WITH {_RANKED}
SELECT string_agg('[' || ref || '] ' || gi_name || ' (' || gi_type || ') — ' || section || ' — ' || source_file || chr(10) || document,
       chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY ref) AS context FROM ranked WHERE ref <= 10
""")
def retrieval_context(spark, sf_dir):
    return vectors.context_text(ranked(spark, sf_dir))


@register("storable_chunks", f"""
WITH {D.CORPUS}
SELECT source_file, folder, country, 'unknown' AS language, '' AS section, len(embedding) AS dim, md5(plain) AS digest
FROM corpus JOIN embeddings ON vec_id = doc_id
""")
def storable_chunks(spark, sf_dir):
    docs = D.corpus(spark, sf_dir).join(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id", "left")
    none = F.lit(None).cast("string")
    stored = passages.storable(docs.select(
        F.col("doc_id").cast("string").alias("chunk_id"), "folder", "source_file", "country", none.alias("gi_type"), none.alias("gi_name"),
        none.alias("subcategory"), F.lit("unknown").alias("language"), none.alias("section"), none.alias("parent_id"), "markdown", "embedding",
    ))
    return stored.select(
        "source_file", "folder", "country", "language", "section", F.size("embedding").cast("long").alias("dim"), F.md5("document").alias("digest")
    )


@register("vector_dimensions", "SELECT len(embedding) AS dim, count(*) AS n FROM embeddings GROUP BY 1")
def vector_dimensions(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy(F.size("embedding").cast("long").alias("dim")).agg(F.count("*").alias("n"))
