"""The phases end to end on a small place table, and the queries over their tables."""

import random

import pytest

from gazetta.operators import endpoints
from gazetta.plans import phases
from gazetta.sources.lexicon import LETTERS
from gazetta.sources.schema import Hierarchy
from gazetta.sources.tables import KEYS, Tables

LEVELS = ["city", "county", "township"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(1)
    parts = ["hill", "brook", "stone", "mill", "ford", "new", "old", "east"]
    rows = []
    for i in range(240):
        city = i % 3
        rows.append((i, f"c{city}", f"k{i % 6}", f"t{i % 12}", rng.choice(parts) + rng.choice(parts[city:]), 113 + city + rng.random() * 0.2, 23 + rng.random() * 0.2))
    rows.append((999, "c0", "k0", "t0", "(…)", 113.0, 23.0))
    raw = spark.createDataFrame(rows, "id long, city string, county string, township string, name string, lon double, lat double")
    settings = phases.Settings(hierarchy=Hierarchy(tuple(LEVELS)), letters="a-z", lexicon=LETTERS, least_all=5, least_here=2, eps_km=3.0, least_points=4, most_latitude=26.0, bandwidth_km=5.0)
    root = f"file://{tmp_path_factory.mktemp('tables')}"
    order = phases.run(spark, raw, root, settings)
    assert order == [*phases.PHASES]
    return Tables(spark, root)


def test_invalid_names_are_dropped(tables):
    assert tables.read("places").count() == 240
    assert tables.read("metadata_overview").first()["n_county"] == 6


def test_all_phase_tables_are_there(tables):
    made = tables.install()
    assert {"char_regional_analysis", "ngram_tendency", "semantic_indices", "spatial_clusters", "region_similarity", "cluster_assignments", "char_similarity"} <= set(made)
    assert tables.catalogue().filter("rows > 0").count() >= 25
    assert set(tables.keep_only(made)) == set()


@pytest.mark.parametrize("name", [*endpoints.LISTINGS])
def test_listings(tables, name):
    table = endpoints.LISTINGS[name].table
    assert table in KEYS
    if table != "active_run_ids":  # written by run-ids/active/set and run-ids/refresh
        assert endpoints.ask(tables, name).columns


def test_listing_parameters(tables):
    got = endpoints.ask(tables, "character/frequency/regional", region_level="city", city="c0", limit=3).collect()
    assert len(got) == 3 and {r["city"] for r in got} == {"c0"}
    with pytest.raises(TypeError):
        endpoints.ask(tables, "character/frequency/regional", nonsense=1)
    assert endpoints.ask(tables, "ngrams/frequency", n=2, position="all", min_frequency=10).filter("frequency < 10").isEmpty()


def test_functions(tables):
    ask = endpoints.ask
    assert ask(tables, "run-ids/active/set", kind="freq", run_id="r1", created_at="2024").count() == 1
    assert ask(tables, "run-ids/active/set", kind="freq", run_id="r2", created_at="2025").first()["run_id"] == "r2"
    assert ask(tables, "run-ids/active", kind="freq").count() == 1
    assert ask(tables, "character/significance/summary").first()["regions"] == 3
    assert ask(tables, "character/tendency/by-region", region_level="city", city="c1", top_n=4).count() == 4
    assert ask(tables, "character/tendency/by-char", char="o", region_level="city").filter("centroid_lon IS NULL").isEmpty()
    assert ask(tables, "character/network", char="o", depth=1, top_k=3).count() <= 4
    assert ask(tables, "clustering/metrics/best").count() == 1
    assert ask(tables, "ngrams/regional", level="city", levels=LEVELS, n=2, top_k=2).groupBy("city").count().filter("count > 2").isEmpty()
    v = ask(tables, "regional/vectors", level="city", levels=LEVELS)
    names = [r["region"] for r in v.collect()]
    assert ask(tables, "regional/vectors/compare", names=names, level="city", levels=LEVELS).count() == 3
    assert ask(tables, "regions/similarity/search", region="c0", region_level="city").count() == 2
    assert ask(tables, "regions/similarity/pair", a="c1", b="c0").count() == 1
    assert ask(tables, "regions/similarity/matrix", names=names).count() == 9
    assert ask(tables, "regions/list", level="county", levels=LEVELS).count() == 6
    assert ask(tables, "semantic/labels/categories").count() == len(LETTERS)
    for name in ("spatial/clusters/summary", "spatial/integration/summary", "statistics/ngrams"):
        assert ask(tables, name).count() >= 1
    assert ask(tables, "spatial/integration/by", by="char").columns
    one = tables.read("places").first()["village_id"]
    assert ask(tables, "village/complete", village_id=one).count() == 1
    assert ask(tables, "regional/aggregates", level="city", levels=LEVELS).count() == 3


def test_further_functions(tables):
    ask = endpoints.ask
    assert ask(tables, "run-ids/available", kind="ngrams").first()["run_id"] == "run/ngrams"
    assert ask(tables, "run-ids/snapshots", run_id="run").count() == 1
    assert ask(tables, "run-ids/refresh").count() == len(phases.PHASES)
    assert ask(tables, "semantic/subcategory/list", category="stop").count() == 2
    rows = {r["subcategory"]: r["vtf_count"] for r in ask(tables, "semantic/subcategory/vtf/global", category="vowel").collect()}
    assert set(rows) == {"open", "close"} and min(rows.values()) > 0
    assert ask(tables, "spatial/centroids", region_level="city").filter("villages = 80").count() == 3
    assert ask(tables, "semantic/composition/patterns").filter("pattern = 'labelled'").count() > 0
    assert ask(tables, "metadata/stats/tables").count() == ask(tables, "statistics/database").first()["tables"] > 30
    found = ask(tables, "village/search", query="hill", city="c0", size=5).collect()
    assert len(found) == 5 and all("hill" in r["name"] and r["city"] == "c0" for r in found)
    assert ask(tables, "village/search/detail", village=found[0]["name"]).filter("bigrams IS NOT NULL").count() >= 1
    tagged = ask(tables, "compute/subset/filter", features="village_features", starts="new", all_tags=("sem_nasal",))
    assert tagged.count() > 0 and tagged.filter("NOT startswith(name, 'new')").isEmpty()
    assert ask(tables, "compute/subset/compare", a={"starts": "new"}, flags=["sem_nasal", "sem_liquid"]).filter("feature = 'sem_nasal'").first()["share_a"] == 1.0
    f = ask(tables, "compute/features/aggregate", level="city", levels=LEVELS).collect()
    assert len(f) == 3 and all(r["villages"] == 80 and r["suffix_entropy"] > 0 and r["top_suffix_1"] for r in f)
    assert ask(tables, "regional/vectors/reduce", level="county", levels=LEVELS).count() == ask(tables, "regional/vectors", level="county", levels=LEVELS).count()
    assert ask(tables, "regional/vectors/cluster", level="county", levels=LEVELS, k=2).select("cluster").distinct().count() == 2
    assert ask(tables, "compute/clustering/spatial-aware", level="county", levels=LEVELS, k=3, weight=100.0).groupBy("cluster").count().count() == 3
    assert ask(tables, "compute/semantic/network").count() > 2
    for name in ("spatial/integration/available-characters", "spatial/integration/clusterlist"):
        assert ask(tables, name).columns


def test_order_of_phases():
    assert phases.plan(["region_clusters"]) == ["character_frequency", "semantics", "region_clusters"]
    assert phases.plan(["significance"], done=("character_frequency",)) == ["significance"]
    assert phases.chosen("0-1,space") == ["character_frequency", "significance", "space"]
    with pytest.raises(ValueError):
        phases.Settings(levels=("village",))
    assert phases.Settings.from_json({"hierarchy": ["a", "b"], "levels": [0]}).levels == ("a",)
