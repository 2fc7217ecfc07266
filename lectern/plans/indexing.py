"""From files to the document, passage and parent tables."""

from __future__ import annotations

from itertools import batched

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern.config import DEFAULT, EngineConfig
from lectern.functions import names
from lectern.functions.language import detect_language
from lectern.functions.text import clean_markdown, plain_pages
from lectern.operators import catalog, passages
from lectern.operators.lineage import cut_lineage
from lectern.plans import prompts
from lectern.providers import Chat, Embedder, PageReader, chat_list_column, embedded, extract_pages
from lectern.sources import corpus
from lectern.sources.layout import spread
from lectern.sources.store import Store

DOCUMENT_KEY = ["country", "folder", "source_file"]


def tables_section(pages: Column, table_pages: Column, replies: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """Markdown block with one sub-section per page whose reply is usable; empty without any."""
    def block(page: Column, i: Column) -> Column:
        reply = F.get(replies, i)
        usable = (F.length(F.get(pages, page - 1)) >= 80) & (F.length(reply) > 10)
        if cfg.table_reply_chars is not None:
            usable &= F.length(reply) < cfg.table_reply_chars
        return F.when(usable, F.concat(F.lit(f"\n\n{V.TABLES_SUBSECTION_PREFIX} (pàg. "), page.cast("string"), F.lit(")\n\n"), F.trim(reply)))

    blocks = F.filter(F.transform(table_pages, block), lambda b: b.isNotNull())
    return F.when(
        F.size(blocks) > 0, F.array_join(F.concat(F.array(F.lit(V.TABLES_SECTION_HEADER + "\n")), blocks), "\n")
    ).otherwise(F.lit(""))


def with_page_tables(extracted: DataFrame, chat: Chat, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Add cleaned tables to the rich text, one model call per page with a table.

    The calls of a document are made where its pages are, so files are read once and nothing is shuffled.
    """
    def prompt(page: Column) -> Column:
        text = F.get("pages", page - 1)
        return F.concat(F.lit(prompts.TABLE), text if cfg.table_page_chars is None else F.left(text, F.lit(cfg.table_page_chars)))

    answered = extracted.withColumn("replies", chat_list_column(F.transform("table_pages", prompt), chat))
    section = tables_section(F.col("pages"), F.col("table_pages"), F.col("replies"), cfg)
    added = F.when(F.coalesce(section, F.lit("")) != "", F.concat("markdown", F.lit("\n\n"), section)).otherwise(F.col("markdown"))
    return answered.withColumn("markdown", added).withColumn("extraction_method", F.concat("extraction_method", F.lit(" + tables"))).drop("replies")


def extracted(
    files: DataFrame, reader: PageReader, country: str, fast: bool = False, chat: Chat | None = None, cfg: EngineConfig = DEFAULT
) -> DataFrame:
    """Documents read from files (country, folder, file, path, content): cleaned and language-tagged."""
    raw = extract_pages(spread(files, cfg.input_partitions), reader, fast)
    if chat is not None and not fast:
        raw = with_page_tables(raw, chat, cfg)
    cleaned = clean_markdown(F.coalesce("markdown", plain_pages("pages")), country, cfg.strip_page_headings)
    have = set(raw.columns)
    knowledge = country == V.KNOWLEDGE_COUNTRY
    # generated once: several columns below are computed from the cleaned text
    return raw.withColumn("md", F.explode(F.array(cleaned))).select(
        "folder", names.file_stem("file").alias("source_file"),
        (F.lit("knowledge") if knowledge else names.gi_type("folder")).alias("gi_type"),
        (F.col("category") if "category" in have else names.gi_name("folder")).alias("gi_name"),
        (F.col("subcategory") if "subcategory" in have else F.lit("")).alias("subcategory"),
        detect_language("md", cfg.language_chars).alias("language"),
        "extraction_method", F.length("md").cast("long").alias("char_count"), F.size("pages").cast("long").alias("page_count"),
        F.col("md").alias("markdown"), "country", "error",
    )


def extract(
    store: Store, root: str, country: str, reader: PageReader, *, force: bool = False, dry_run: bool = False,
    name_like: str | None = None, fast: bool = False, chat: Chat | None = None, cfg: EngineConfig = DEFAULT,
) -> dict[str, int]:
    """Bring the documents of a country up to date; counts of extracted, skipped and failed files."""
    spark = store.spark
    files = corpus.listing(spark, root, country).withColumn("source_file", names.file_stem("file"))
    if name_like and country != V.KNOWLEDGE_COUNTRY:
        files = files.filter(F.contains(F.lower(names.gi_name("folder")), F.lit(name_like.lower())))
    done = store.documents().filter(F.col("country") == country).select(*DOCUMENT_KEY)
    # names only, and written: what is stored further down changes ``done``
    n_all, todo = files.count(), cut_lineage(files if force else catalog.pending(files, done, DOCUMENT_KEY))
    if dry_run:
        n = todo.count()
        return {"extracted": n, "skipped": n_all - n, "errors": 0}
    # the bytes of pending files alone, as many files at a time as the driver may name; written once, then counted and moved
    def read(files: DataFrame) -> DataFrame:
        return extracted(files, reader, country, fast, chat, cfg)

    none = corpus.knowledge_files(spark, root) if country == V.KNOWLEDGE_COUNTRY else corpus.designation_files(spark, root, country)
    store.overwrite(read(none.limit(0)), "staging/documents")
    for paths in batched((r[0] for r in todo.select("_raw_path").toLocalIterator()), cfg.files_at_once):
        read(corpus.contents(spark, list(paths), country)).write.mode("append").parquet(store.path("staging/documents"))
    staged = spark.read.parquet(store.path("staging/documents"))
    good = staged.filter("error is null").drop("error")
    if force:
        kept = store.documents().filter(F.col("country") == country).join(good.select(*DOCUMENT_KEY), DOCUMENT_KEY, "left_anti")
        store.overwrite(good.unionByName(kept), "staging/merged")
        store.replace_partitions(spark.read.parquet(store.path("staging/merged")), "documents")
    else:
        store.append(good, "documents")
    store.remember_folders(good)
    by_error = {r.bad: r.n for r in staged.groupBy(F.col("error").isNotNull().alias("bad")).agg(F.count("*").alias("n")).collect()}
    new, failed = by_error.get(False, 0), by_error.get(True, 0)
    return {"extracted": new, "skipped": n_all - new - failed, "errors": failed}


def index_documents(
    store: Store, docs: DataFrame, embedder: Embedder, fallback: Embedder | None = None, cfg: EngineConfig = DEFAULT
) -> int:
    """Replace the passages and parents of the countries in ``docs``; number of stored passages.

    Parents are written from the same passages as the vectors, and partitions are replaced as a
    whole, so the two tables always fit together.  All plans are map-only.  Passages
    are written with their vectors first and published when all have vectors of one model.
    """
    split = passages.with_passages(passages.with_document_metadata(spread(docs, cfg.input_partitions)), cfg)
    store.replace_partitions(passages.parents_table(split), "parents")
    chunks = embedded(passages.chunk_records(split, cfg), "markdown", embedder, fallback, cfg)
    store.replace_partitions(passages.storable(chunks), "chunks")
    store.drop_left_over(docs.select("country").distinct(), split.select("country").distinct())
    countries = [r.country for r in docs.select("country").distinct().collect()]  # one row a partition of the store
    return store.chunks().filter(F.col("country").isin(*countries)).count()


def build_index(
    store: Store, root: str, country: str, reader: PageReader, embedder: Embedder, *, force: bool = False, fast: bool = False,
    dry_run: bool = False, name_like: str | None = None, chat: Chat | None = None, fallback: Embedder | None = None,
    cfg: EngineConfig = DEFAULT,
) -> dict:
    """Extract, tag, split, embed and store one country (designations or the knowledge corpus)."""
    result: dict = {"ok": False}
    result["extract"] = extract(
        store, root, country, reader, force=force, dry_run=dry_run, name_like=name_like, fast=fast, chat=chat, cfg=cfg
    )
    if dry_run:
        return {**result, "languages": {}, "chunks": 0, "stored": 0, "ok": True}
    docs = store.documents().filter(F.col("country") == country)
    # one row per language code, a small fixed set
    result["languages"] = {r.language: r.n for r in catalog.language_counts(docs).collect()}
    if docs.isEmpty():
        store.delete_country(country)
        return {**result, "chunks": 0, "stored": 0}
    stored = index_documents(store, docs, embedder, fallback, cfg)
    return {**result, "chunks": stored, "stored": stored, "ok": stored > 0}
