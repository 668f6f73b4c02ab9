"""The result tables by name: their keys, and writing them.

A table is overwritten whole; rows with equal keys (nulls are equal) are reduced
to one, so that running a phase again never doubles it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta.sources.storage import save

_REGION = ["region_level", "city", "county", "township"]
#: Table -> key columns.
KEYS: dict[str, list[str]] = {
    "places": ["village_id"],
    "metadata_overview": [],
    "region_basic_stats": _REGION,
    "analysis_runs": ["run_id"],
    "active_run_ids": ["kind"],
    "char_frequency_global": ["char"],
    "char_regional_analysis": [*_REGION, "char"],
    "char_significance": [*_REGION, "char"],
    "pattern_frequency_global": ["pattern_type", "pattern"],
    "pattern_regional_analysis": [*_REGION, "pattern_type", "pattern"],
    "ngram_frequency": ["n", "position", "ngram"],
    "regional_ngram_frequency": ["city", "county", "township", "n", "position", "ngram"],
    "ngram_tendency": ["city", "county", "township", "n", "position", "ngram"],
    "ngram_significance": ["city", "county", "township", "n", "position", "ngram"],
    "structural_patterns": ["n", "pattern_type", "pattern"],
    "village_ngrams": ["village_id"],
    "regional_centroids": _REGION,
    "semantic_labels": ["char", "category", "subcategory"],
    "semantic_vtf_global": ["category"],
    "semantic_regional_analysis": [*_REGION, "category"],
    "semantic_indices": [*_REGION, "category"],
    "semantic_bigrams": ["label_1", "label_2"],
    "semantic_trigrams": ["label_1", "label_2", "label_3"],
    "semantic_pmi": ["label_1", "label_2"],
    "semantic_composition_patterns": ["label_1", "label_2"],
    "semantic_conflicts": ["sequence"],
    "village_semantic_structure": ["village_id"],
    "semantic_cooccurrence": ["first", "second"],
    "semantic_network_centrality": ["node"],
    "semantic_subcategory_vtf_global": ["category", "subcategory"],
    "semantic_subcategory_vtf_regional": [*_REGION, "category", "subcategory"],
    "village_features": ["village_id"],
    "village_spatial_features": ["village_id"],
    "village_cluster_assignments": ["village_id"],
    "spatial_clusters": ["cluster"],
    "spatial_hotspots": ["cluster"],
    "region_spatial_aggregates": ["city"],
    "spatial_tendency_integration": ["char", "cluster"],
    "cluster_assignments": ["algorithm", "region"],
    "cluster_profiles": ["algorithm", "cluster", "feature"],
    "clustering_metrics": ["algorithm", "k"],
    "region_similarity": ["region_level", "region_1", "region_2"],
    "char_embeddings": ["word"],
    "char_similarity": ["query", "id"],
    "run_snapshots": ["run_id"],
}


class Tables:
    """Result tables as Parquet folders under one root, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        if name not in KEYS:
            raise KeyError(f"no table {name}")
        return f"{self.root}/{name}"

    def write(self, name: str, df: DataFrame) -> None:
        keys = [k for k in KEYS[name] if k in df.columns]
        save(df, self.path(name), keys or None)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def install(self) -> list[str]:
        """Temporary views of the tables that exist."""
        found = []
        for name in KEYS:
            try:
                self.read(name).createOrReplaceTempView(name)
                found.append(name)
            except Exception as e:  # noqa: BLE001
                if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                    raise
        return found

    def catalogue(self) -> DataFrame:
        """table, columns, rows of all tables that exist."""
        out = self.spark.createDataFrame([], "table string, columns array<string>, rows long")
        for n in self.install():
            df = self.read(n)
            names = F.array(*[F.lit(c) for c in df.columns]).alias("columns")
            out = out.unionByName(df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), names, "rows"))
        return out

    def keep_only(self, names: list[str], dry_run: bool = True) -> list[str]:
        """Names the other tables that exist; without dry_run they are emptied."""
        others = [n for n in self.install() if n not in names]
        if not dry_run:
            for n in others:
                self.spark.createDataFrame([], self.read(n).schema).write.mode("overwrite").parquet(self.path(n))
        return others
