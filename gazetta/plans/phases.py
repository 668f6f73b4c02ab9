"""The batch phases as a graph of functions over one place table.

Each phase reads places and earlier tables and writes its own; the graph gives the
order. A phase is a few declarative plans, so Spark sees each table's whole lineage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta.functions import text
from gazetta.operators import frequency, graph, ml, ngrams, regions, semantic, spatial, vectors
from gazetta.sources.lexicon import flattened, label_pairs, lexicon
from gazetta.sources.schema import Hierarchy
from gazetta.sources.storage import checksum
from gazetta.sources.tables import Tables


@dataclass
class Settings:
    """What a run depends on; the hierarchy is an argument, never a global."""

    hierarchy: Hierarchy = field(default_factory=Hierarchy)
    letters: str = text.CJK_ALL
    lexicon: dict = field(default_factory=dict)
    levels: tuple[str, ...] = ("city", "county")
    least_all: int = 20
    least_here: int = 5
    sizes: tuple[int, ...] = (2, 3)
    ngram_regional: dict[int, int] = field(default_factory=lambda: {2: 3, 3: 2})
    ngram_global: dict[int, int] = field(default_factory=lambda: {2: 5, 3: 3})
    eps_km: float = 0.5
    least_points: int = 5
    bandwidth_km: float = 5.0
    most_latitude: float | None = None  # of the points; looked up without one
    clusters: tuple[int, ...] = (2, 3, 4)
    #: Names of pairs of neighbouring categories: (name, first ones, second ones); without any, all labelled pairs have one name.
    pairs: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = ()
    #: Categories that hardly go together, and how often a sequence with both must occur not to count as odd.
    incompatible: tuple[tuple[str, str], ...] = (("water", "terrain"),)
    odd_below: int = 5

    def __post_init__(self):
        unknown = set(self.levels) - set(self.hierarchy.levels)
        if unknown:
            raise ValueError(f"levels {sorted(unknown)} aren't in the hierarchy")

    @classmethod
    def from_json(cls, config: dict) -> Settings:
        """Settings from a mapping; level numbers are places in the hierarchy."""
        config = dict(config)
        h = Hierarchy(tuple(config.pop("hierarchy"))) if "hierarchy" in config else Hierarchy()
        if "levels" in config:
            config["levels"] = tuple(h.levels[x] if isinstance(x, int) else x for x in config["levels"])
        return cls(hierarchy=h, **config)


@dataclass
class Context:
    spark: SparkSession
    tables: Tables
    settings: Settings

    def places(self) -> DataFrame:
        return self.tables.read("places")


def _chars():
    return text.character_set(F.col("name"))


def _each_level(c: Context, make: Callable[[list[str]], DataFrame]) -> DataFrame:
    """One table of all levels, the columns below a level null."""
    out = None
    for level in c.settings.levels:
        keys = c.settings.hierarchy.key(level)
        df = make(keys).withColumn("region_level", F.lit(level))
        for k in c.settings.hierarchy.levels:
            if k not in df.columns:
                df = df.withColumn(k, F.lit(None).cast("string"))
        out = df if out is None else out.unionByName(df)
    return out


def preprocess(c: Context, raw: DataFrame) -> None:
    """Clean names, a content-derived id, valid rows only."""
    cleaned = raw.withColumn("__c", text.cleaned(F.col("name"), c.settings.letters)).filter("__c.is_valid")
    named = cleaned.withColumn("raw_name", F.col("name")).withColumn("name", F.col("__c.clean_name")).drop("__c")
    h = [x for x in c.settings.hierarchy.levels if x in named.columns]
    order = [*h, "raw_name", *[x for x in ("id", "lon", "lat") if x in named.columns]]
    named = named.withColumn("village_id", F.concat(F.lit("v_"), F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(x).cast("string"), F.lit("\0")) for x in order]))))
    c.tables.write("places", named)
    c.tables.write("metadata_overview", regions.overview(c.places(), c.settings.hierarchy, _chars()))
    c.tables.write("region_basic_stats", regions.rollup(c.places(), c.settings.hierarchy, F.count(F.lit(1)).alias("villages"), F.avg(F.length("name")).alias("avg_length")))


def character_frequency(c: Context) -> None:
    p = c.places()
    c.tables.write("char_frequency_global", frequency.global_frequency(p, _chars()))
    overall = c.tables.read("char_frequency_global")

    def level(keys):
        joined = frequency.with_global(frequency.regional_frequency(p, _chars(), keys), overall)
        return frequency.tendency(joined, keys, c.settings.least_all, c.settings.least_here)

    c.tables.write("char_regional_analysis", _each_level(c, level))


def significance(c: Context) -> None:
    c.tables.write("char_significance", frequency.significance(c.tables.read("char_regional_analysis")))


def morphology(c: Context) -> None:
    p = c.places()
    kinds = [("suffix", n) for n in (1, 2, 3)] + [("prefix", n) for n in (2, 3)]
    overall, regional = None, None
    items = F.array("pattern")
    for kind, n in kinds:
        a = frequency.affix(p, kind, n)
        g = frequency.global_frequency(a, items, "pattern")

        def level(keys, a=a, g=g):
            joined = frequency.with_global(frequency.regional_frequency(a, items, keys, "pattern"), g, "pattern")
            return frequency.tendency(joined, keys, c.settings.least_all, c.settings.least_here, item="pattern")

        name = F.lit(f"{kind}_{n}")
        g_named, r_named = g.withColumn("pattern_type", name), _each_level(c, level).withColumn("pattern_type", name)
        overall = g_named if overall is None else overall.unionByName(g_named)
        regional = r_named if regional is None else regional.unionByName(r_named)
    c.tables.write("pattern_frequency_global", overall)
    c.tables.write("pattern_regional_analysis", regional)


def ngram_analysis(c: Context) -> None:
    """Counts, tendency, significance; then only what is significant and frequent stays."""
    s, p = c.settings, c.places()
    keys = [*s.hierarchy.levels]
    c.tables.write("ngram_frequency", ngrams.ngram_counts(ngrams.ngram_rows(p, s.sizes, []), []))
    overall = c.tables.read("ngram_frequency")
    regional = ngrams.ngram_counts(ngrams.ngram_rows(p, s.sizes, keys), keys)
    tested = ngrams.ngram_significance(ngrams.ngram_tendency(regional, overall))
    c.tables.write("ngram_significance", tested.filter("is_significant").filter(ngrams.at_least("regional_count", s.ngram_regional) & ngrams.at_least("global_count", s.ngram_global)))
    significant, on = c.tables.read("ngram_significance"), [*keys, "n", "position", "ngram"]
    c.tables.write("regional_ngram_frequency", ngrams.prune(significant, regional, on))
    c.tables.write("ngram_tendency", ngrams.prune(significant, ngrams.ngram_tendency(regional, overall), on))
    c.tables.write("structural_patterns", ngrams.templates(overall, {2: 100, 3: 50, 4: 30}))
    c.tables.write("village_ngrams", ngrams.place_ngrams(p).select("village_id", "bigrams", "trigrams", "prefix_bigram", "suffix_bigram", "prefix_trigram", "suffix_trigram"))


def semantics(c: Context) -> None:
    lex = lexicon(c.spark, c.settings.lexicon)
    c.tables.write("semantic_labels", lex)
    overall = semantic.term_frequency(c.tables.read("char_frequency_global"), lex, [])
    c.tables.write("semantic_vtf_global", overall)
    overall = c.tables.read("semantic_vtf_global")
    p = c.places()
    c.tables.write("semantic_regional_analysis", _each_level(c, lambda keys: semantic.term_tendency(semantic.term_frequency(frequency.regional_frequency(p, _chars(), keys), lex, keys), overall)))
    groups: dict[str, list[str]] = {}
    for _, char, category, _sub in flattened(c.settings.lexicon):
        groups.setdefault(category, []).append(char)
    scored = semantic.scores(p, groups)
    c.tables.write("semantic_indices", _each_level(c, lambda keys: semantic.indices(scored, keys, [*groups])))
    g = c.tables.read("char_frequency_global")
    sub = lex.filter("subcategory <> ''")
    members = g.join(sub.select("char", "category", "subcategory").distinct(), "char").groupBy("category", "subcategory")
    c.tables.write("semantic_subcategory_vtf_global", members.agg(F.countDistinct("char").alias("chars"), F.sum("village_count").alias("vtf_count"), (F.sum("village_count") / F.max("total_villages")).alias("share")))
    c.tables.write("semantic_subcategory_vtf_regional", _each_level(c, lambda keys: semantic.subcategory_tendency(frequency.regional_frequency(p, _chars(), keys), g, sub, keys)))


def composition(c: Context) -> None:
    labels = label_pairs(c.settings.lexicon, last=True)
    seqs = c.places().withColumn("sequence", semantic.sequence(F.col("name"), labels))
    c.tables.write("semantic_bigrams", semantic.label_ngrams(seqs, 2))
    c.tables.write("semantic_trigrams", semantic.label_ngrams(seqs, 3))
    s = c.settings
    rules = [(n, set(a), set(b)) for n, a, b in s.pairs] or [("labelled", set(s.lexicon), set(s.lexicon))]
    c.tables.write("semantic_composition_patterns", semantic.pattern_rules(c.tables.read("semantic_bigrams"), rules))
    c.tables.write("semantic_conflicts", semantic.conflicts(seqs, [*s.incompatible], s.odd_below))
    c.tables.write("semantic_pmi", semantic.bigram_pmi(c.tables.read("semantic_bigrams")))
    c.tables.write("village_semantic_structure", semantic.structures(c.places(), labels).select("village_id", "sequence", "coverage"))
    pairs = semantic.cooccurrence_measures(semantic.cooccurrence(c.places(), label_pairs(c.settings.lexicon)))
    c.tables.write("semantic_cooccurrence", pairs)
    edges = c.tables.read("semantic_cooccurrence").filter("first <> second AND pmi >= 0 AND n_both >= 5 AND is_significant").select(F.col("first").alias("a"), F.col("second").alias("b"), F.col("pmi").alias("weight"))
    ranks = graph.pagerank(edges)
    c.tables.write("semantic_network_centrality", graph.degree(edges).join(ranks, "node").join(graph.label_propagation(edges), "node"))


def features(c: Context) -> None:
    tagged = semantic.tags(frequency.morphology(c.places()), label_pairs(c.settings.lexicon))
    c.tables.write("village_features", tagged.withColumn("name_length", F.length("name")))


def space(c: Context) -> None:
    s = c.settings
    p = c.places().filter("lon IS NOT NULL AND lat IS NOT NULL").withColumn("id", F.col("village_id"))
    near = spatial.neighbour_features(p, 10, most_latitude=s.most_latitude)
    dense = spatial.density(p, (1, 5, 10), s.most_latitude)
    labels = spatial.dbscan(p, s.eps_km, s.least_points, s.most_latitude)
    joined = spatial.isolation_minmax(p.join(near, "id").join(dense, "id"))
    c.tables.write("village_spatial_features", joined)
    c.tables.write("village_cluster_assignments", labels.withColumnRenamed("id", "village_id"))
    labels = c.tables.read("village_cluster_assignments").withColumnRenamed("village_id", "id")
    c.tables.write("spatial_clusters", spatial.cluster_profiles(p, labels, [*s.hierarchy.key(s.levels[-1])]))
    centres = regions.rollup(p, s.hierarchy, F.count(F.lit(1)).alias("villages"), F.avg("lon").alias("centroid_lon"), F.avg("lat").alias("centroid_lat"))
    c.tables.write("regional_centroids", centres)
    c.tables.write("region_spatial_aggregates", spatial.regional_aggregates(c.tables.read("village_spatial_features"), ["city"]))
    c.tables.write("spatial_hotspots", spatial.hotspots(p, s.bandwidth_km, most_latitude=s.most_latitude))
    c.tables.write("spatial_tendency_integration", spatial.integration(p, labels, _chars()))


def similarity(c: Context) -> None:
    def level(keys):
        t = c.tables.read("char_regional_analysis").filter(F.col("region_level") == keys[-1]).withColumn("region", F.concat_ws("/", *keys))
        return regions.similarity(t, "region", "char", "frequency", F.col("z_score") >= 2)

    out = None
    for name in c.settings.levels:
        df = level(c.settings.hierarchy.key(name)).withColumn("region_level", F.lit(name))
        out = df if out is None else out.unionByName(df)
    c.tables.write("region_similarity", out)


def region_clusters(c: Context) -> None:
    t = c.tables.read("semantic_indices").filter(F.col("region_level") == c.settings.levels[-1])
    names = [r[0] for r in t.select("category").distinct().orderBy("category").collect()]  # the lexicon's categories
    keys = c.settings.hierarchy.key(c.settings.levels[-1])
    wide = t.withColumn("region", F.concat_ws("/", *keys)).groupBy("region").pivot("category", names).agg(F.first("normalized_index")).fillna(0.0)
    v = ml.standardised(ml.assembled(wide, names))
    ks = [k for k in c.settings.clusters if k < wide.count()]
    found = ml.kmeans_sweep(v, ks, "scaled")
    c.tables.write("clustering_metrics", c.spark.createDataFrame([{"algorithm": "kmeans", **f} for f in found]))
    labelled, _ = ml.kmeans(v, ml.best(found)["k"], "scaled")
    c.tables.write("cluster_assignments", labelled.select(F.lit("kmeans").alias("algorithm"), "region", "cluster", "distance"))
    c.tables.write("cluster_profiles", ml.distinguishing(labelled, names, "scaled").withColumn("algorithm", F.lit("kmeans")))


def embeddings(c: Context) -> None:
    p = c.places().withColumn("chars", F.array_distinct(text.characters(F.col("name"))))
    c.tables.write("char_embeddings", ml.character_embeddings(p, "chars"))
    e = c.tables.read("char_embeddings").withColumnRenamed("word", "id")
    c.tables.write("char_similarity", vectors.nearest(e, e, 50))


#: Phase -> what it needs, what it does.
PHASES: dict[str, tuple[tuple[str, ...], Callable[[Context], None]]] = {
    "character_frequency": ((), character_frequency),
    "significance": (("character_frequency",), significance),
    "morphology": ((), morphology),
    "ngrams": ((), ngram_analysis),
    "semantics": (("character_frequency",), semantics),
    "composition": ((), composition),
    "features": ((), features),
    "space": ((), space),
    "similarity": (("character_frequency",), similarity),
    "region_clusters": (("semantics",), region_clusters),
    "embeddings": ((), embeddings),
}


def chosen(wanted: str) -> list[str]:
    """Phases named in a list like 'ngrams,space' or by number like '0-2,4'."""
    names, out = [*PHASES], []
    for part in wanted.split(","):
        part = part.strip()
        if part in PHASES:
            out.append(part)
        elif "-" in part:
            a, b = part.split("-")
            out += names[int(a) : int(b) + 1]
        else:
            out.append(names[int(part)])
    return [*dict.fromkeys(out)]


def plan(wanted: list[str], done: tuple[str, ...] = ()) -> list[str]:
    """The wanted phases and what they need that isn't done, each after its needs."""
    out: list[str] = []

    def add(name: str) -> None:
        if name in out or name in done:
            return
        for need in PHASES[name][0]:
            add(need)
        out.append(name)

    for w in wanted:
        add(w)
    return out


def recorded(c: Context, run_id: str, done: list[str]) -> None:
    """A row per phase of the run, and a checksum of its character counts."""
    now = datetime.now(UTC).isoformat(timespec="seconds")
    rows = [(f"{run_id}/{name}", name, now, {"levels": ",".join(c.settings.levels)}) for name in done]
    c.tables.write("analysis_runs", c.spark.createDataFrame(rows, "run_id string, kind string, created_at string, parameters map<string,string>"))
    if "character_frequency" in done:
        c.tables.write("run_snapshots", checksum(c.tables.read("char_frequency_global"), "char", "village_count").withColumn("run_id", F.lit(run_id)))


def run(spark: SparkSession, raw: DataFrame, root: str, settings: Settings, wanted: list[str] | None = None, dry_run: bool = False, run_id: str = "run") -> list[str]:
    """Preprocesses `raw` and runs the phases into tables under `root`, which also get a record of the run."""
    order = plan(wanted or [*PHASES])
    if not dry_run:
        c = Context(spark, Tables(spark, root), settings)
        preprocess(c, raw)
        for name in order:
            PHASES[name][1](c)
        recorded(c, run_id, order)
    return order
