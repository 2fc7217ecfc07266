"""Building and refreshing the property graph of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.config import DEFAULT, EngineConfig
from lectern.functions import names, replies
from lectern.operators import graph
from lectern.operators.lineage import cut_lineage
from lectern.plans import prompts
from lectern.providers import Chat, chat_column
from lectern.sources.store import TABLE_DDL, Store


def model_triples(docs: DataFrame, chat: Chat, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Triples of all interesting sections; a failed call gives none."""
    sections = graph.interesting_sections(docs, cfg)
    prompt = F.concat(F.lit(prompts.TRIPLES), F.col("content") if cfg.triple_max_chars is None else F.left("content", F.lit(cfg.triple_max_chars)))
    heading = F.col("heading") if cfg.label_chars is None else F.left("heading", F.lit(cfg.label_chars))
    asked = sections.select(
        graph.corpus_place(graph.country_place(F.col("country")), F.concat_ws("/", "country", "folder", "source_file")).alias("path"), "section_ord",
        F.concat("folder", F.lit("/"), heading).alias("label"),
        replies.parse_triples(F.coalesce(chat_column(prompt, chat), F.lit(""))).alias("triples"),
    )
    return graph.triple_rows(asked)


def with_triples(nodes: DataFrame, edges: DataFrame, triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add triples and the edges they imply on the way (co-authorised varieties, soil and climate)."""
    nodes, edges = graph.add_triples(nodes, edges, triples)
    edges = cut_lineage(edges)
    implied = graph.coauthorized(edges).unionByName(graph.soil_in_climate(edges))
    return nodes, cut_lineage(edges.unionByName(implied))


def build_graph(
    store: Store, *, force: bool = False, chat: Chat | None = None, designation: str | None = None, cfg: EngineConfig = DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges: the stored graph if it is fresh, otherwise built anew.

    With ``designation`` the stored graph is extended by the triples of that one designation.
    """
    cached = store.graph()
    docs = store.documents()
    if cached is not None and not force and designation is None and not store.graph_is_stale():
        return cached
    if cached is not None and not force and designation is not None:
        nodes, edges = cached
    else:
        nodes, edges, _ = graph.from_tables({kind: store.table(kind) for kind in TABLE_DDL})
        edges = cut_lineage(edges)
    nodes = graph.upsert_directory(nodes, graph.folder_nodes(store.folders()))
    if chat is not None:
        read = docs if designation is None else docs.filter(F.lower(names.gi_name("folder")) == designation.lower())
        nodes, edges = with_triples(nodes, edges, cut_lineage(model_triples(read, chat, cfg)))
    edges = graph.infer_shared(edges)
    # the new graph may be computed from the stored one: finish it before replacing that
    store.save_graph(cut_lineage(nodes), cut_lineage(edges))
    saved = store.graph()
    assert saved is not None
    return saved
