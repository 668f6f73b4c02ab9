"""The named read queries over result tables.

Most are one shape: a table, equality filters, lower bounds, an order and a row
limit; those are listed as data. The others are functions of (tables, **parameters).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazetta.functions import stats
from gazetta.operators import api, frequency, graph, ml, networks, regions, vectors
from gazetta.sources.storage import active_runs
from gazetta.sources.tables import Tables

_REGION = ("region_level", "city", "county", "township")


@dataclass(frozen=True)
class Listing:
    """A filtered, ordered, limited table (a limit of 0: all rows). `least` maps a parameter to the column it bounds below."""

    table: str
    equal: tuple[str, ...] = ()
    least: tuple[tuple[str, str], ...] = ()
    order: tuple[str, ...] = ()  # a leading '-' is descending
    limit: int | None = 100

    def __call__(self, tables: Tables, limit: int | None = None, **given) -> DataFrame:
        bounds = dict(self.least)
        unknown = set(given) - set(self.equal) - set(bounds)
        if unknown:
            raise TypeError(f"{self.table} has no parameters {sorted(unknown)}")
        df = api.where(tables.read(self.table), **{k: v for k, v in given.items() if k in self.equal})
        for name, column in self.least:
            if given.get(name) is not None:
                df = df.filter(F.col(column) >= given[name])
        if self.order:
            df = df.orderBy(*[F.desc(o[1:]) if o[0] == "-" else F.asc(o) for o in self.order])
        most = limit if limit is not None else self.limit
        return df.limit(most) if most else df


LISTINGS: dict[str, Listing] = {
    "run-ids/active": Listing("active_run_ids", ("kind",), order=("kind",)),
    "run-ids/available": Listing("analysis_runs", ("kind",), order=("-created_at",)),
    "run-ids/metadata": Listing("analysis_runs", ("run_id",)),
    "character/embeddings/vector": Listing("char_embeddings", ("word",)),
    "character/embeddings/list": Listing("char_embeddings", order=("word",)),
    "character/embeddings/similarities": Listing("char_similarity", ("query",), (("min_similarity", "similarity"),), ("rank",), 10),
    "character/frequency/global": Listing("char_frequency_global", (), (("min_frequency", "village_count"),), ("rank",)),
    "character/frequency/regional": Listing("char_regional_analysis", _REGION, (), ("rank_within_region", "char"), 50),
    "character/significance/by-character": Listing("char_significance", ("char", "region_level"), (("min_zscore", "z_score"),), ("-z_score",)),
    "character/significance/by-region": Listing("char_significance", (*_REGION, "significance"), (), ("-chi2", "char"), 20),
    "clustering/assignments": Listing("cluster_assignments", ("algorithm", "cluster"), (), ("cluster", "region"), None),
    "clustering/assignments/by-region": Listing("cluster_assignments", ("algorithm", "region")),
    "clustering/profiles": Listing("cluster_profiles", ("algorithm", "cluster"), (), ("cluster", "rank"), None),
    "clustering/metrics": Listing("clustering_metrics", ("algorithm",), (), ("k",), None),
    "compute/features/extract": Listing("village_features", ("village_id",), limit=None),
    "metadata/stats/overview": Listing("metadata_overview"),
    "metadata/stats/regions": Listing("region_basic_stats", _REGION, (), ("-villages",), None),
    "ngrams/frequency": Listing("ngram_frequency", ("n", "position"), (("min_frequency", "frequency"),), ("-frequency", "ngram")),
    "ngrams/patterns": Listing("structural_patterns", ("pattern", "pattern_type", "n"), (("min_frequency", "total"),), ("-total", "pattern")),
    "ngrams/tendency": Listing("ngram_tendency", ("ngram", "n", "position", "city", "county", "township"), (("min_tendency", "lift"),), ("-lift", "ngram")),
    "ngrams/significance": Listing("ngram_significance", ("ngram", "n", "position", "city", "county", "township", "is_significant"), (), ("-chi2", "ngram")),
    "patterns/frequency/global": Listing("pattern_frequency_global", ("pattern_type",), (("min_frequency", "village_count"),), ("-village_count", "pattern")),
    "patterns/frequency/regional": Listing("pattern_regional_analysis", (*_REGION, "pattern_type"), (), ("rank_within_region", "pattern"), 50),
    "patterns/tendency": Listing("pattern_regional_analysis", (*_REGION, "pattern_type", "pattern"), (("min_tendency", "lift"),), ("-lift", "pattern")),
    "patterns/structural": Listing("structural_patterns", ("pattern_type",), (("min_frequency", "total"),), ("-total", "pattern"), None),
    "regional/spatial-aggregates": Listing("region_spatial_aggregates", ("city",), (), ("-village_count",), 10_000),
    "semantic/category/list": Listing("semantic_vtf_global", (), (), ("category",), None),
    "semantic/category/vtf/global": Listing("semantic_vtf_global", ("category",), (), ("-vtf_count",), None),
    "semantic/category/vtf/regional": Listing("semantic_regional_analysis", (*_REGION, "category"), (), ("-frequency",), None),
    "semantic/category/tendency": Listing("semantic_regional_analysis", (*_REGION, "category"), (), ("-z_score",), 9),
    "semantic/composition/bigrams": Listing("semantic_bigrams", (), (("min_frequency", "frequency"),), ("-frequency",)),
    "semantic/composition/trigrams": Listing("semantic_trigrams", (), (("min_frequency", "frequency"),), ("-frequency",)),
    "semantic/composition/pmi": Listing("semantic_pmi", ("label_1", "label_2"), (("min_pmi", "pmi"),), ("-pmi",)),
    "semantic/composition/patterns": Listing("semantic_composition_patterns", ("pattern",), (("min_frequency", "frequency"),), ("-frequency",)),
    "semantic/indices": Listing("semantic_indices", (*_REGION, "category"), (("min_villages", "village_count"),), ("-normalized_index",)),
    "semantic/labels/by-character": Listing("semantic_labels", ("char",), limit=None),
    "semantic/labels/by-category": Listing("semantic_labels", ("category",), (), ("ord",)),
    "semantic/subcategory/chars": Listing("semantic_labels", ("subcategory",), (), ("ord",), None),
    "semantic/subcategory/vtf/global": Listing("semantic_subcategory_vtf_global", ("category", "subcategory"), (("min_villages", "vtf_count"),), ("-vtf_count", "subcategory"), None),
    "spatial/clusters/available-runs": Listing("analysis_runs", ("run_id",), order=("-created_at",)),
    "spatial/centroids": Listing("regional_centroids", _REGION, (), ("-villages",), None),
    "semantic/composition/conflicts": Listing("semantic_conflicts", (), (), ("-frequency", "sequence")),
    "run-ids/snapshots": Listing("run_snapshots", ("run_id",)),
    "semantic/subcategory/vtf/regional": Listing("semantic_subcategory_vtf_regional", (*_REGION, "category", "subcategory"), (("min_tendency", "tendency"),), ("-tendency",)),
    "semantic/subcategory/tendency/top": Listing("semantic_subcategory_vtf_regional", (*_REGION, "category"), (("min_villages", "vtf_count"),), ("-tendency",), 10),
    "semantic/subcategory/comparison": Listing("semantic_subcategory_vtf_regional", (*_REGION, "category"), (("min_villages", "vtf_count"),), ("subcategory",), None),
    "compute/semantic/cooccurrence": Listing("semantic_cooccurrence", ("first", "second"), (("min_frequency", "n_both"), ("min_pmi", "pmi")), ("-n_both",)),
    "spatial/hotspots": Listing("spatial_hotspots", ("cluster",), (("min_density", "mean_density"), ("min_village_count", "village_count")), ("-mean_density",), None),
    "spatial/clusters": Listing("spatial_clusters", ("cluster",), (("min_size", "size"),), ("-size",)),
    "spatial/integration": Listing("spatial_tendency_integration", ("char", "cluster"), (("min_cluster_size", "cluster_size"), ("min_spatial_coherence", "coherence")), ("-specificity",)),
    "village/ngrams": Listing("village_ngrams", ("village_id",)),
    "village/semantic-structure": Listing("village_semantic_structure", ("village_id",)),
    "village/features": Listing("village_features", ("village_id",)),
    "village/spatial-features": Listing("village_spatial_features", ("village_id",)),
}


def set_active_run(tables: Tables, kind: str, run_id: str, created_at: str) -> DataFrame:
    """Points a kind at a run and returns all pointers."""
    new = tables.spark.createDataFrame([(kind, run_id, created_at)], "kind string, run_id string, created_at string")
    try:
        old = tables.read("active_run_ids").filter(F.col("kind") != kind).collect()  # a row a kind
        new = new.unionByName(tables.spark.createDataFrame(old, new.schema)) if old else new
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    tables.write("active_run_ids", new)
    return tables.read("active_run_ids")


def significance_summary(tables: Tables, region_level: str = "city") -> DataFrame:
    t = tables.read("char_significance").filter(F.col("region_level") == region_level)
    return t.agg(F.countDistinct("char").alias("chars"), F.countDistinct("city", F.coalesce("county", F.lit("")), F.coalesce("township", F.lit(""))).alias("regions"), F.count_if(F.col("significance") != "ns").alias("significant"), F.avg(F.abs("chi2")).alias("mean_chi2"), F.max(F.abs("chi2")).alias("max_chi2"))


def tendency_by_region(tables: Tables, sort_by: str = "z_score", top_n: int = 50, **region) -> DataFrame:
    """Distinct rows of a region with their rank before the limit."""
    if sort_by not in ("z_score", "lift", "log_odds", "log_lift"):
        raise ValueError(f"no metric {sort_by}")
    t = api.where(tables.read("char_regional_analysis"), **region).distinct()
    return frequency.top_per_region(t, [], [F.desc(sort_by), F.asc("char")], top_n)


def tendency_by_char(tables: Tables, char: str, region_level: str, **region) -> DataFrame:
    """One character across regions, with the centroid of each city."""
    t = api.where(tables.read("char_regional_analysis"), char=char, region_level=region_level, **region)
    centre = tables.read("places").groupBy("city").agg(F.avg("lon").alias("centroid_lon"), F.avg("lat").alias("centroid_lat"))
    return t.join(centre, "city", "left").orderBy(F.desc("z_score"))


def character_network(tables: Tables, char: str, depth: int = 2, top_k: int = 10, max_nodes: int = 100) -> DataFrame:
    edges = tables.read("char_similarity").select(F.col("query").alias("a"), F.col("id").alias("b"), F.col("similarity").alias("weight"))
    start = tables.spark.createDataFrame([(char,)], "node string")
    return graph.expand(edges, start, depth, top_k).orderBy("depth", "node").limit(max_nodes)


def best_clustering(tables: Tables, algorithm: str = "kmeans", metric: str = "silhouette") -> DataFrame:
    order = F.asc(metric) if metric == "davies_bouldin" else F.desc(metric)
    return tables.read("clustering_metrics").filter(F.col("algorithm") == algorithm).orderBy(order, "k").limit(1)


def regional_ngrams(tables: Tables, level: str, levels: list[str], n: int, position: str = "all", top_k: int = 50, **region) -> DataFrame:
    """Counts of a wider level summed up from the narrowest, with shares of all its n-grams and the top k."""
    keys = levels[: levels.index(level) + 1]
    t = api.where(tables.read("regional_ngram_frequency"), n=n, position=position, **region)
    sums = t.groupBy(*keys, "n", "position", "ngram").agg(F.sum("frequency").alias("frequency"))
    share = 100 * F.col("frequency") / F.sum("frequency").over(Window.partitionBy(*keys))
    return frequency.top_per_region(sums.withColumn("share", share), keys, [F.desc("frequency"), F.asc("ngram")], top_k)


def region_vectors(tables: Tables, level: str, levels: list[str], **region) -> DataFrame:
    """Category vectors of the regions that have all categories."""
    keys = levels[: levels.index(level) + 1]
    t = api.where(tables.read("semantic_indices"), region_level=level, **region).withColumn("region", F.concat_ws("/", *keys))
    n = tables.read("semantic_indices").select("category").distinct().count()
    grouped = t.groupBy("region").agg(F.transform(F.array_sort(F.collect_list(F.struct("category", "normalized_index"))), lambda x: x["normalized_index"]).alias("vector"))
    return grouped.filter(F.size("vector") == n)


def compare_vectors(tables: Tables, names: list[str], level: str, levels: list[str]) -> DataFrame:
    """All measures for the pairs of two to a hundred named regions."""
    if not 2 <= len(names) <= 100:
        raise api.Rejected("two to a hundred regions")
    v = region_vectors(tables, level, levels).filter(F.col("region").isin(*names))
    a, b = v.alias("a"), v.alias("b")
    pairs = a.join(b, F.col("a.region") < F.col("b.region"))
    x, y = F.col("a.vector"), F.col("b.vector")
    return pairs.select(F.col("a.region").alias("region_1"), F.col("b.region").alias("region_2"), vectors.cosine(x, y).alias("cosine"), vectors.euclidean(x, y).alias("euclidean"), vectors.manhattan(x, y).alias("manhattan"), F.zip_with(x, y, lambda p, q: p - q).alias("difference"))


def similar_regions(tables: Tables, region: str, region_level: str, metric: str = "cosine", least: float = 0.0, top_k: int = 10) -> DataFrame:
    """The other end of each pair with the region."""
    t = tables.read("region_similarity").filter((F.col("region_level") == region_level) & ((F.col("region_1") == region) | (F.col("region_2") == region)))
    other = F.when(F.col("region_1") == region, F.col("region_2")).otherwise(F.col("region_1"))
    value = F.col(metric)
    out = t.withColumn("region", other).filter(value <= least if metric == "euclidean" and least else value >= least)
    return out.orderBy(value.asc() if metric == "euclidean" else value.desc(), "region").limit(top_k)


def region_pair(tables: Tables, a: str, b: str) -> DataFrame:
    x, y = min(a, b), max(a, b)
    return tables.read("region_similarity").filter((F.col("region_1") == x) & (F.col("region_2") == y))


def similarity_matrix(tables: Tables, names: list[str] | None = None, metric: str = "cosine") -> DataFrame:
    """Both directions and the diagonal in long form."""
    t = tables.read("region_similarity")
    if names:
        t = t.filter(F.col("region_1").isin(*names) & F.col("region_2").isin(*names))
    up = t.select("region_1", "region_2", F.col(metric).alias("value"))
    down = up.select(F.col("region_2").alias("region_1"), F.col("region_1").alias("region_2"), "value")
    every = up.select("region_1").unionByName(down.select("region_1")).distinct()
    return up.unionByName(down).unionByName(every.select("region_1", F.col("region_1").alias("region_2"), F.lit(0.0 if metric == "euclidean" else 1.0).alias("value")))


def region_list(tables: Tables, level: str, levels: list[str]) -> DataFrame:
    return tables.read("places").select(*levels[: levels.index(level) + 1]).distinct()


def label_categories(tables: Tables) -> DataFrame:
    return tables.read("semantic_labels").groupBy("category").agg(F.countDistinct("char").alias("chars"), F.countDistinct("subcategory").alias("subcategories"))


def cluster_summary(tables: Tables) -> DataFrame:
    return tables.read("spatial_clusters").agg(F.count(F.lit(1)).alias("clusters"), F.avg("size").alias("mean_size"), F.min("size").alias("least_size"), F.max("size").alias("most_size"))


def integration_summary(tables: Tables) -> DataFrame:
    return tables.read("spatial_tendency_integration").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("char").alias("chars"), F.countDistinct("cluster").alias("clusters"), F.avg("coherence").alias("mean_coherence"))


def integration_by(tables: Tables, by: str, least_size: int = 0) -> DataFrame:
    """One row a character or cluster."""
    other = "cluster" if by == "char" else "char"
    t = tables.read("spatial_tendency_integration").groupBy(by).agg(F.max("cluster_size").alias("cluster_size"), F.avg("specificity").alias("mean_specificity"), F.countDistinct(other).alias("partners"))
    return t.filter(F.col("cluster_size") >= least_size)


def ngram_statistics(tables: Tables) -> DataFrame:
    t = tables.read("ngram_frequency").filter("position = 'all'")
    s = tables.read("ngram_significance").select("n", "ngram").distinct().groupBy("n").agg(F.count(F.lit(1)).alias("significant"))
    return t.groupBy("n").agg(F.count(F.lit(1)).alias("distinct"), F.sum("frequency").alias("occurrences"), F.count_if(F.col("frequency") == 1).alias("once")).join(s, "n", "left").fillna({"significant": 0})


def village_profile(tables: Tables, village_id: str) -> DataFrame:
    """A place with its features, runs, structure, spatial features and cluster; what is missing is null."""
    return _beside(tables, tables.read("places").filter(F.col("village_id") == village_id))


def _beside(tables: Tables, out: DataFrame) -> DataFrame:
    for name, columns in (("village_ngrams", ["bigrams", "trigrams"]), ("village_semantic_structure", ["sequence", "coverage"]), ("village_spatial_features", ["nn_distance_1", "isolation_score"]), ("village_cluster_assignments", ["cluster"])):
        t = tables.read(name)
        out = out.join(t.select("village_id", *[c for c in columns if c in t.columns and c not in out.columns]), "village_id", "left")
    return out


def region_intensities(tables: Tables, level: str, levels: list[str], **region) -> DataFrame:
    """Places, mean name length and a column per category for each region."""
    keys = levels[: levels.index(level) + 1]
    here = api.where(tables.read("places"), **region).groupBy(*keys).agg(F.countDistinct("name").alias("names"), F.avg(F.length("name")).alias("avg_length"))
    names = [r[0] for r in tables.read("semantic_vtf_global").select("category").orderBy("category").collect()]  # the lexicon's categories
    wide = tables.read("semantic_indices").filter(F.col("region_level") == level).groupBy(*keys).pivot("category", names).agg(F.first("raw_intensity"))
    return regions.full_outer([here, wide], keys) if not region else here.join(wide, keys, "left")


def integration_characters(tables: Tables) -> DataFrame:
    t = tables.read("spatial_tendency_integration")
    return t.groupBy("char").agg(F.countDistinct("cluster").alias("clusters"), F.sum("n").alias("villages"))


def integration_clusters(tables: Tables) -> DataFrame:
    t = tables.read("spatial_tendency_integration")
    return t.groupBy("cluster").agg(F.max("cluster_size").alias("cluster_size"), F.countDistinct("char").alias("chars"))


def subcategory_list(tables: Tables, category: str | None = None) -> DataFrame:
    t = api.where(tables.read("semantic_labels"), category=category).filter("subcategory <> ''")
    return t.groupBy("category", "subcategory").agg(F.count(F.lit(1)).alias("chars"))


def table_statistics(tables: Tables) -> DataFrame:
    """Tables and their rows in all."""
    return tables.catalogue().agg(F.count(F.lit(1)).alias("tables"), F.sum("rows").alias("rows"))


def village_search(tables: Tables, query: str, page: int = 1, size: int = 20, order: tuple[str, ...] = ("village_id",), **equal) -> DataFrame:
    """A page of the places whose name contains the query."""
    limit, offset = api.Policy().page(page, size)
    return api.search(tables.read("places"), query, **equal).orderBy(*order).offset(offset).limit(limit)


def village_detail(tables: Tables, village: str, **equal) -> DataFrame:
    """All that is known of the places of one name."""
    return _beside(tables, api.where(tables.read("places").filter(F.col("name") == village), **equal))


def latest_runs(tables: Tables) -> DataFrame:
    """Points every kind at its latest run."""
    tables.write("active_run_ids", active_runs(tables.read("analysis_runs")))
    return tables.read("active_run_ids")


def subset_of(tables: Tables, features: str | None = None, **wanted) -> DataFrame:
    """The places that a description (api.Subset) meets, with their features if a table of them is named."""
    p = tables.read("places")
    if features:
        f = tables.read(features)
        p = p.join(f.select("village_id", *[c for c in f.columns if c not in p.columns]), "village_id")
    return api.subset(p, api.Subset(**wanted))


def subset_comparison(tables: Tables, a: dict, flags: list[str]) -> DataFrame:
    """Shares of feature flags among the places of a description against all others."""
    return regions.compare_groups(tables.read("village_features"), api.Subset(**a).condition(), flags)


def region_features(tables: Tables, level: str, levels: list[str], top: int = 10) -> DataFrame:
    """Each region's places, mean length, commonest endings, their entropy, shares of tagged
    places and the z of the numbers across regions."""
    keys = levels[: levels.index(level) + 1]
    f = tables.read("village_features").dropna(subset=keys)
    tags = [c for c in f.columns if c.startswith("sem_")]
    sums = f.groupBy(*keys).agg(F.count(F.lit(1)).alias("villages"), F.avg(F.length("name")).alias("avg_length"), *[F.avg(t).alias(f"share_{t[4:]}") for t in tags])
    n = f.filter("suffix_1 IS NOT NULL").groupBy(*keys, "suffix_1").agg(F.count(F.lit(1)).cast("double").alias("n"))
    spread = n.groupBy(*keys).agg(stats.shannon(F.collect_list("n")).alias("suffix_entropy"))  # endings of one character
    out = sums.join(regions.top_values(f, keys, "suffix_1", top), keys, "left").join(spread, keys, "left")
    return regions.feature_z(out, ["villages", "avg_length", "suffix_entropy", *[f"share_{t[4:]}" for t in tags]])


def reduced_vectors(tables: Tables, level: str, levels: list[str], components: int = 2) -> DataFrame:
    """Principal components of the regions' category vectors."""
    v = ml.standardised(ml.from_array(region_vectors(tables, level, levels), "vector"))
    return ml.projected(v, components).select("region", "pca")


def clustered_vectors(tables: Tables, level: str, levels: list[str], k: int) -> DataFrame:
    v = ml.standardised(ml.from_array(region_vectors(tables, level, levels), "vector"))
    return ml.kmeans(v, k, "scaled")[0].select("region", "cluster", "distance")


def spatially_clustered(tables: Tables, level: str, levels: list[str], k: int, weight: float = 0.5) -> DataFrame:
    """Regions clustered by their category vectors and, with a weight, by where their centre lies."""
    keys = levels[: levels.index(level) + 1]
    centre = tables.read("places").groupBy(F.concat_ws("/", *keys).alias("region")).agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    rows = region_vectors(tables, level, levels).join(centre.dropna(), "region")
    whole = rows.agg(*[g(c).alias(f"{n}_{c}") for c in ("lon", "lat") for n, g in (("mean", F.avg), ("spread", F.stddev_pop))])
    v = ml.from_array(ml_array(ml.standardised(ml.from_array(rows, "vector"))).join(F.broadcast(whole)).withColumn("both", F.concat("flat", F.array(*[weight * (F.col(c) - F.col(f"mean_{c}")) / F.coalesce(F.nullif(F.col(f"spread_{c}"), F.lit(0.0)), F.lit(1.0)) for c in ("lon", "lat")]))).drop("features", "scaled"), "both")  # a single row
    return ml.kmeans(v, k)[0].select("region", "cluster", "distance", "lon", "lat")


def ml_array(df: DataFrame, column: str = "scaled", output: str = "flat") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return df.withColumn(output, vector_to_array(column))


def network_summary(tables: Tables, least: float = 0.0) -> DataFrame:
    """Size, density, components and clustering of the network of categories that occur together."""
    e = tables.read("semantic_cooccurrence").filter(F.col("first") < F.col("second")).filter(F.col("pmi") >= least).select(F.col("first").alias("a"), F.col("second").alias("b"), F.col("pmi").alias("weight"))
    found = networks.summary(networks.collected(e))
    return tables.spark.createDataFrame([(k, float(v)) for k, v in found.items() if isinstance(v, (int, float))], "measure string, value double")


FUNCTIONS: dict[str, Callable[..., DataFrame]] = {
    "spatial/integration/available-characters": integration_characters, "spatial/integration/clusterlist": integration_clusters,
    "semantic/subcategory/list": subcategory_list, "metadata/stats/tables": lambda tables: tables.catalogue(), "statistics/database": table_statistics,
    "village/search": village_search, "village/search/detail": village_detail, "run-ids/refresh": latest_runs, "compute/subset/filter": subset_of,
    "compute/subset/compare": subset_comparison, "compute/features/aggregate": region_features, "regional/vectors/reduce": reduced_vectors,
    "regional/vectors/cluster": clustered_vectors, "compute/clustering/spatial-aware": spatially_clustered, "compute/semantic/network": network_summary,
    "run-ids/active/set": set_active_run, "character/significance/summary": significance_summary, "character/tendency/by-region": tendency_by_region,
    "character/tendency/by-char": tendency_by_char, "character/network": character_network, "clustering/metrics/best": best_clustering,
    "ngrams/regional": regional_ngrams, "regional/vectors": region_vectors, "regional/vectors/compare": compare_vectors,
    "regions/similarity/search": similar_regions, "regions/similarity/pair": region_pair, "regions/similarity/matrix": similarity_matrix,
    "regions/list": region_list, "semantic/labels/categories": label_categories, "spatial/clusters/summary": cluster_summary,
    "spatial/integration/summary": integration_summary, "spatial/integration/by": integration_by, "statistics/ngrams": ngram_statistics,
    "village/complete": village_profile, "regional/aggregates": region_intensities,
}


def ask(tables: Tables, name: str, **parameters) -> DataFrame:
    """A named query; parameters that are None don't filter."""
    if name in LISTINGS:
        return LISTINGS[name](tables, **parameters)
    return FUNCTIONS[name](tables, **parameters)
