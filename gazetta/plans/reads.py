"""The named read queries over result tables, each with its SQL.

A result table is what a registered query makes of the driver's tables, with
columns renamed or added by expressions that both engines read; the SQL
of a read query is that query's SQL with the same filters around it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazetta.operators import api, dedup, endpoints
from gazetta.sources.lexicon import LETTERS, flattened, lexicon, sql_values
from gazetta.sources.schema import PLACES_SQL, places

from .registry import ORACLES, QUERIES, query, rounded

_LEVEL = ("*", "'county' AS region_level")
_CITY = ("*", "'city' AS region_level")
#: Result table -> the query that makes it, and its columns.
_MADE: dict[str, tuple[str, tuple[str, ...]]] = {
    "char_frequency_global": ("char_freq_global", ("*",)),
    "char_regional_analysis": ("char_tendency", _LEVEL),
    "char_frequency_regional": ("char_freq_region", _LEVEL),
    "char_significance": ("char_chi2_yates", (*_LEVEL, "chi2 AS z_score")),
    "pattern_frequency_global": ("affix_freq_global", ("*", "'suffix_1' AS pattern_type")),
    "pattern_regional_analysis": ("affix_tendency", (*_CITY, "'suffix_1' AS pattern_type")),
    "ngram_frequency": ("ngram_freq_positional", ("*",)),
    "ngram_tendency": ("ngram_tendency", ("*",)),
    "ngram_significance": ("ngram_significance_flag", ("*",)),
    "structural_patterns": ("ngram_templates", ("*",)),
    "village_ngrams": ("village_ngrams", ("id AS village_id", "prefix_bigram", "suffix_bigram", "prefix_trigram", "suffix_trigram")),
    "metadata_overview": ("metadata_overview", ("*",)),
    "region_basic_stats": ("hierarchy_counts_rollup", ("*",)),
    "semantic_vtf_global": ("vtf_global", ("*",)),
    "semantic_regional_analysis": ("vtf_tendency", (*_CITY, "vtf_count AS frequency")),
    "semantic_indices": ("semantic_indices", _CITY),
    "semantic_bigrams": ("category_bigrams_pmi", ("label_1", "label_2", "frequency")),
    "semantic_trigrams": ("category_trigrams", ("*",)),
    "semantic_pmi": ("category_bigrams_pmi", ("*",)),
    "semantic_composition_patterns": ("composition_patterns", ("*",)),
    "semantic_subcategory_vtf_regional": ("subcategory_vtf", _CITY),
    "semantic_cooccurrence": ("cooccurrence_log2pmi", ("*",)),
    "village_semantic_structure": ("village_structure", ("id AS village_id", "sequence", "coverage")),
    "village_features": ("semantic_tags", ("id AS village_id", "sem_vowel", "sem_liquid", "sem_nasal", "sem_stop", "sem_fricative")),
    "village_spatial_features": ("isolation", ("id AS village_id", "nn_distance_1", "density_5km", "isolation_score", "is_isolated")),
    "region_spatial_aggregates": ("spatial_aggregates", ("*",)),
    "region_similarity": ("region_similarity", _CITY),
    "spatial_clusters": ("cluster_profile_mode", ("*",)),
    "spatial_tendency_integration": ("integration_char_cluster", ("*",)),
    "char_similarity": ("embedding_topk", ("*",)),
    "active_run_ids": ("active_run_latest", ("*",)),
}


class Made:
    """Result tables of the driver's tables, made when they are read."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        if name == "semantic_labels":
            return lexicon(self.spark, LETTERS)
        if name == "places":
            return places(self.spark, self.sf_dir)
        base, columns = _MADE[name]
        return QUERIES[base](self.spark, self.sf_dir).selectExpr(*columns)


def _table_sql(name: str) -> str:
    if name == "semantic_labels":
        return f"(WITH {sql_values(LETTERS)} SELECT * FROM lexicon)"
    if name == "places":
        return f"(WITH {PLACES_SQL} SELECT * FROM places)"
    base, columns = _MADE[name]
    return f"(SELECT {', '.join(columns)} FROM ({ORACLES[base]}) q)"


def _literal(value) -> str:
    return f"'{value}'" if isinstance(value, str) else str(value).upper() if isinstance(value, bool) else str(value)


_ALL = 0  # no limit


def _listing(name: str, endpoint: str, table: str | None = None, limit: int | None = None, **given) -> None:
    """Registers a listing with some parameters; a limit only where its order is total."""
    listing = endpoints.LISTINGS[endpoint]
    if table is not None:
        listing = endpoints.Listing(table, listing.equal, listing.least, listing.order, listing.limit)
    bounds = dict(listing.least)
    tests = [f"{bounds[k]} >= {v}" if k in bounds else f"{k} = {_literal(v)}" for k, v in given.items()]
    sql = f"SELECT * FROM {_table_sql(listing.table)} t" + (" WHERE " + " AND ".join(tests) if tests else "")
    if limit:
        sql += " ORDER BY " + ", ".join(f"{o[1:]} DESC" if o[0] == "-" else o for o in listing.order) + f" LIMIT {limit}"

    def run(spark, sf_dir):
        return listing(Made(spark, sf_dir), limit=limit or _ALL, **given)

    run.__name__, run.__doc__ = name, f"The listing {endpoint}."
    query(sql)(run)


_listing("read_char_frequency_global", "character/frequency/global", min_frequency=20)
_listing("read_char_frequency_regional", "character/frequency/regional", "char_frequency_regional", city="Brand#13")
_listing("read_char_significance_of_char", "character/significance/by-character", char="e", min_zscore=0)
_listing("read_char_significance_of_region", "character/significance/by-region", limit=15, city="Brand#21", region_level="county", significance="ns")
_listing("read_embedding_similarities", "character/embeddings/similarities", min_similarity=0.2)
_listing("read_pattern_frequency_global", "patterns/frequency/global", pattern_type="suffix_1", min_frequency=5)
_listing("read_pattern_tendency", "patterns/tendency", min_tendency=1.0)
_listing("read_ngram_frequency", "ngrams/frequency", limit=50, n=2, position="all")
_listing("read_ngram_patterns", "ngrams/patterns", n=3, min_frequency=3)
_listing("read_ngram_tendency", "ngrams/tendency", n=2, position="prefix", city="Brand#11", min_tendency=1.5)
_listing("read_ngram_significance", "ngrams/significance", n=2, is_significant=True)
_listing("read_structural_patterns", "patterns/structural", min_frequency=2)
_listing("read_village_ngrams", "village/ngrams", village_id=7)
_listing("read_metadata_overview", "metadata/stats/overview")
_listing("read_metadata_regions", "metadata/stats/regions", region_level="city")
_listing("read_category_list", "semantic/category/list")
_listing("read_vtf_global", "semantic/category/vtf/global", category="nasal")
_listing("read_vtf_regional", "semantic/category/vtf/regional", city="Brand#22")
_listing("read_category_tendency", "semantic/category/tendency", region_level="city", category="stop")
_listing("read_semantic_indices", "semantic/indices", category="liquid", min_villages=2)
_listing("read_bigrams", "semantic/composition/bigrams", min_frequency=10)
_listing("read_trigrams", "semantic/composition/trigrams", min_frequency=10)
_listing("read_pmi", "semantic/composition/pmi", label_1="stop", min_pmi=-1)
_listing("read_composition_patterns", "semantic/composition/patterns", min_frequency=2)
_listing("read_labels_by_char", "semantic/labels/by-character", char="a")
_listing("read_labels_by_category", "semantic/labels/by-category", limit=5, category="stop")
_listing("read_subcategory_chars", "semantic/subcategory/chars", limit=4, subcategory="unvoiced")
_listing("read_subcategory_vtf", "semantic/subcategory/vtf/regional", city="Brand#14")
_listing("read_subcategory_tendency", "semantic/subcategory/tendency/top", category="vowel", min_villages=3)
_listing("read_subcategory_comparison", "semantic/subcategory/comparison", city="Brand#5")
_listing("read_cooccurrence", "compute/semantic/cooccurrence", min_frequency=5, min_pmi=-5)
_listing("read_village_structure", "village/semantic-structure", village_id=11)
_listing("read_village_features", "village/features", village_id=12)
_listing("read_extracted_features", "compute/features/extract")
_listing("read_village_spatial_features", "village/spatial-features", village_id=13)
_listing("read_spatial_aggregates", "regional/spatial-aggregates", city="3")
_listing("read_spatial_clusters", "spatial/clusters", min_size=6)
_listing("read_spatial_integration", "spatial/integration", char="7", min_cluster_size=5)
_listing("read_active_runs", "run-ids/active", kind="5-LOW")


def _asked(sql: str, name: str, endpoint: str, **given) -> None:
    def run(spark, sf_dir):
        return endpoints.ask(Made(spark, sf_dir), endpoint, **given)

    run.__name__, run.__doc__ = name, f"The query {endpoint}."
    query(sql)(run)


_T, _R, _L = (_table_sql(t) for t in ("char_regional_analysis", "region_similarity", "semantic_labels"))
_asked(f"SELECT *, row_number() OVER (ORDER BY z_score DESC, char) AS position FROM {_T} t WHERE city = 'Brand#23' AND county = 'STANDARD' QUALIFY position <= 12", "read_tendency_by_region", "character/tendency/by-region", top_n=12, city="Brand#23", county="STANDARD")
_asked(f"SELECT CASE WHEN region_1 = 'Brand#3' THEN region_2 ELSE region_1 END AS region, t.* FROM {_R} t WHERE 'Brand#3' IN (region_1, region_2) AND cosine >= 0.1 ORDER BY cosine DESC, region LIMIT 30", "read_similar_regions", "regions/similarity/search", region="Brand#3", region_level="city", least=0.1, top_k=30)
_asked(f"SELECT * FROM {_R} t WHERE region_1 = 'Brand#12' AND region_2 = 'Brand#4'", "read_region_pair", "regions/similarity/pair", a="Brand#4", b="Brand#12")
_asked(f"WITH r AS (SELECT * FROM {_R} t), u AS (SELECT region_1, region_2, cosine AS value FROM r UNION ALL SELECT region_2, region_1, cosine FROM r) SELECT * FROM u UNION ALL SELECT DISTINCT region_1, region_1, 1.0 FROM u", "read_similarity_matrix", "regions/similarity/matrix")
_asked(f"SELECT DISTINCT city, county FROM {_table_sql('places')} t", "read_region_list", "regions/list", level="county", levels=["city", "county", "township"])
_asked(f"SELECT category, count(DISTINCT char) AS chars, count(DISTINCT subcategory) AS subcategories FROM {_L} t GROUP BY category", "read_label_categories", "semantic/labels/categories")
_asked(f"SELECT count(*) AS clusters, avg(size) AS mean_size, min(size) AS least_size, max(size) AS most_size FROM {_table_sql('spatial_clusters')} t", "read_cluster_summary", "spatial/clusters/summary")
_asked(f"SELECT char, max(cluster_size) AS cluster_size, avg(specificity) AS mean_specificity, count(DISTINCT cluster) AS partners FROM {_table_sql('spatial_tendency_integration')} t GROUP BY char", "read_integration_by_char", "spatial/integration/by", by="char")
_asked(f"SELECT count(*) AS rows, count(DISTINCT char) AS chars, count(DISTINCT cluster) AS clusters, avg(coherence) AS mean_coherence FROM {_table_sql('spatial_tendency_integration')} t", "read_integration_summary", "spatial/integration/summary")
_asked(f"SELECT char, count(DISTINCT cluster) AS clusters, CAST(sum(n) AS BIGINT) AS villages FROM {_table_sql('spatial_tendency_integration')} t GROUP BY char", "read_integration_characters", "spatial/integration/available-characters")
_asked(f"SELECT cluster, max(cluster_size) AS cluster_size, count(DISTINCT char) AS chars FROM {_table_sql('spatial_tendency_integration')} t GROUP BY cluster", "read_integration_clusters", "spatial/integration/clusterlist")
_asked(f"SELECT category, subcategory, count(*) AS chars FROM {_L} t GROUP BY ALL", "read_subcategory_list", "semantic/subcategory/list")
_asked(f"SELECT * FROM {_table_sql('places')} t WHERE contains(name, 'ol') AND city = 'Brand#8' ORDER BY id LIMIT 20", "read_village_search", "village/search", query="ol", city="Brand#8", order=("id",), size=20)


@query(f"WITH {PLACES_SQL} SELECT * FROM places WHERE id IN (3, 5, 8, 13, 21)")
def read_places_by_ids(spark, sf_dir):
    return api.by_ids(places(spark, sf_dir), ["v_3", 5, "8", 13, 21, 21, "none"])


@query(f"SELECT city, round(avg(abs(z_score)), 6) AS mean_abs, round(max(abs(z_score)), 6) AS max_abs, count(*) AS items FROM {_T} t WHERE support_flag GROUP BY city")
def read_extreme_regions(spark, sf_dir):
    return rounded(api.extreme_regions(Made(spark, sf_dir).read("char_regional_analysis"), ["city"], "z_score"))


@query(f"WITH {PLACES_SQL} SELECT id, city, county, name FROM places QUALIFY row_number() OVER (PARTITION BY city, county ORDER BY length(name) DESC, name, id) = 1")
def survivor_rows(spark, sf_dir):
    """The longest name of each block, as what stays of a merged group."""
    p = places(spark, sf_dir).select("id", "city", "county", "name").withColumn("root", F.struct("city", "county"))
    return dedup.survivors(p, "root", [F.length("name").desc(), F.asc("name"), F.asc("id")]).drop("root")


@query(f"WITH {PLACES_SQL}, e AS (SELECT DISTINCT city, trim(unnest(string_split(name, ' '))) AS x FROM places) SELECT city, string_agg(x, ' ' ORDER BY x) AS name FROM e WHERE x <> '' GROUP BY city")
def merged_name_parts(spark, sf_dir):
    return dedup.merged_lists(places(spark, sf_dir), "city", "name", " ")


_PAIR = (
    f"WITH {PLACES_SQL}, n AS (SELECT city, county, id, split_part(name, ' ', 1) AS name FROM places), p AS (SELECT a.id AS id_a, b.id AS id_b, a.name AS x, b.name AS y, ((a.id * 31 + b.id * 17) % 15) / 10.0::DOUBLE AS km FROM n a JOIN n b ON a.city = b.city AND a.county = b.county AND a.id < b.id AND levenshtein(a.name, b.name) <= 1), "
    "s AS (SELECT *, list_sum([least(length(x) - length(replace(x, c, '')), length(y) - length(replace(y, c, ''))) for c in list_distinct(string_split(x, ''))])::DOUBLE / greatest(length(x), length(y)) AS shared FROM p) "
)


@query(
    _PAIR + "SELECT id_a, id_b, CASE WHEN x = y AND km <= 0.5 THEN 'high' ELSE 'none' END AS merge, CASE WHEN x <> y AND km <= 0.5 THEN 'high' WHEN x <> y AND shared >= 0.8 AND km <= 1 THEN 'medium' ELSE 'none' END AS fuzzy FROM s"
)
def duplicate_severity(spark, sf_dir):
    """How surely two close names of a block are one place, by the rules that they meet and their distance."""
    p = places(spark, sf_dir).withColumn("name", F.split_part("name", F.lit(" "), F.lit(1)))
    rules = dedup.pair_rules(F.col("a.name"), F.col("b.name"))
    kinds = {"merge": dedup.merge_severity, "fuzzy": dedup.fuzzy_severity}
    facts = {f"{k}_{n}": severity(rules, F.lit(most)) for k, severity in kinds.items() for n, most in (("near", 0.5), ("far", 1.0))}
    out = dedup.block_pairs(p, ["city", "county"], F.levenshtein(F.col("a.name"), F.col("b.name"), 1) >= 0, facts=facts)
    km = ((F.col("id_a") * 31 + F.col("id_b") * 17) % 15).cast("double") / 10.0
    # severities change at these two distances only, so they are found once for names, not for each pair of places
    return out.select("id_a", "id_b", *[F.when(km <= 0.5, F.col(f"{k}_near")).when(km <= 1, F.col(f"{k}_far")).otherwise("none").alias(k) for k in kinds])


@query("SELECT category, string_agg(char, '' ORDER BY ord) AS chars FROM " + _L + " t WHERE subcategory <> 'other' GROUP BY category")
def lexicon_members(spark, sf_dir):
    """The lexicon's categories without a dropped subcategory."""
    lex = spark.createDataFrame([r for r in flattened(LETTERS) if r[3] != "other"], "ord int, char string, category string, subcategory string")
    return lex.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "char"))), lambda x: x["char"]), "").alias("chars"))
