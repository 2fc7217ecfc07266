"""The engine's own tables: Parquet, one partition per country, replaced partition-wise."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.config import DEFAULT
from lectern.fixed_values import GRAPH_SCHEMA_VERSION, METADATA_FIELDS, SUPPORTED_COUNTRIES

DOCUMENTS_DDL = (
    "folder string, source_file string, gi_type string, gi_name string, subcategory string, language string, "
    "extraction_method string, char_count long, page_count long, markdown string, country string"
)
CHUNKS_DDL = (
    "chunk_id string, " + ", ".join(f"{f} string" for f in METADATA_FIELDS if f != "country")
    + ", document string, embedding array<float>, country string"
)
PARENTS_DDL = "folder string, pdf string, parent_id string, section string, markdown string, country string"
ORD_DDL = "struct<stage:int,path:string,a:bigint,b:bigint,c:bigint>"
NODES_DDL = f"name string, type string, source string, attrs map<string,string>, ord {ORD_DDL}"
EDGES_DDL = f"src string, dst string, predicate string, source string, via string, attrs map<string,string>, ord {ORD_DDL}"
TABLE_DDL = {
    "analytics": "dop string, gi_type string, wine_type string, parameter string, value double, unit string, relation string",
    "varieties": "dop string, gi_type string, variety string, color string, role string",
    "yields": "dop string, gi_type string, wine_type string, variety string, kg_ha double, hl_ha double",
    "municipalities": "dop string, gi_type string, municipality string, zone string, province string",
}
GRAPH_META_DDL = "schema_version int, built_at timestamp, folder string"
POSITION_DDL = "country_ord int, path string, table_ord int, row_ord int, item_ord int, source_file string"


@dataclass(frozen=True)
class Store:
    """Tables below one base path that every executor can reach."""

    spark: SparkSession
    base: str

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)

    def read(self, name: str, ddl: str) -> DataFrame:
        """A table, or an empty one of the same schema before its first write."""
        if not self.exists(name):
            return self.spark.createDataFrame([], T.StructType.fromDDL(ddl))
        return self.spark.read.schema(ddl).parquet(self.path(name))

    def replace_partitions(self, df: DataFrame, name: str, by: str = "country") -> None:
        """Replace the partitions that ``df`` has rows for; others stay."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(self.path(name))

    def append(self, df: DataFrame, name: str, by: str = "country") -> None:
        df.write.mode("append").partitionBy(by).parquet(self.path(name))

    def overwrite(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(self.path(name))

    # --- named tables ---------------------------------------------------------------------
    def documents(self) -> DataFrame:
        return self.read("documents", DOCUMENTS_DDL)

    def chunks(self) -> DataFrame:
        return self.read("chunks", CHUNKS_DDL)

    def parents(self) -> DataFrame:
        return self.read("parents", PARENTS_DDL)

    def folders(self) -> DataFrame:
        """Distinct (country, folder) of the documents, kept as a small table of its own."""
        return self.read("folders", "folder string, country string")

    def remember_folders(self, docs: DataFrame) -> None:
        new = docs.select("country", "folder").distinct().join(self.folders(), ["country", "folder"], "left_anti")
        self.append(new.coalesce(1), "folders")

    def table(self, kind: str) -> DataFrame:
        return self.read(f"tables/{kind}", f"{TABLE_DDL[kind]}, {POSITION_DDL}")

    def graph(self) -> tuple[DataFrame, DataFrame] | None:
        """Nodes and edges, or None when there are none of the current version."""
        meta = self.read("graph/meta", GRAPH_META_DDL)
        row = meta.orderBy(F.col("built_at").desc()).limit(1).collect()
        if not row or row[0].schema_version != GRAPH_SCHEMA_VERSION:
            return None
        return self.read(f"graph/{row[0].folder}/nodes", NODES_DDL), self.read(f"graph/{row[0].folder}/edges", EDGES_DDL)

    def save_graph(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Write both tables to a new folder, then name it in one appended row: readers see the old pair or the new one."""
        folder = f"v-{uuid.uuid4().hex}"
        self.overwrite(nodes, f"graph/{folder}/nodes")
        self.overwrite(edges, f"graph/{folder}/edges")
        meta = self.spark.range(1).select(
            F.lit(GRAPH_SCHEMA_VERSION).alias("schema_version"), F.current_timestamp().alias("built_at"), F.lit(folder).alias("folder")
        )
        meta.coalesce(1).write.mode("append").parquet(self.path("graph/meta"))

    def graph_is_stale(self) -> bool:
        """Whether a source table was written after the graph."""
        if not self.exists("graph/meta"):
            return True
        built = self.read("graph/meta", "schema_version int, built_at timestamp").agg(F.max("built_at")).first()[0]
        for name, ddl in [(f"tables/{k}", f"{d}, {POSITION_DDL}") for k, d in TABLE_DDL.items()] + [("documents", DOCUMENTS_DDL)]:
            if self.exists(name):
                newest = self.read(name, ddl).agg(F.max("_metadata.file_modification_time")).first()[0]
                if newest is not None and newest > built:
                    return True
        return False

    def drop_left_over(self, replaced: DataFrame, filled: DataFrame) -> None:
        """Remove the passages of countries that were replaced by nothing."""
        for row in replaced.join(filled, "country", "left_anti").collect():  # at most one row a partition
            self.delete_country(row.country)

    def delete_country(self, country: str) -> int:
        """Remove the passages and parents of a country; number of passages there were."""
        n = self.chunks().filter(F.col("country") == country).count()
        jvm = self.spark._jvm
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        for name in ("chunks", "parents"):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/country={country}")
            path.getFileSystem(conf).delete(path, True)
        return n


    def reset(self) -> int:
        """Remove the passages and parents of all collections."""
        return sum(self.delete_country(country) for country in SUPPORTED_COUNTRIES)


def vectors_have_dimension(chunks: DataFrame, dim: int = DEFAULT.embedding_dim) -> bool:
    return chunks.filter(F.size("embedding") != dim).limit(1).count() == 0
