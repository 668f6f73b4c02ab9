"""Operators on tables of a few rows."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from gazetta.functions import text
from gazetta.operators import api, dedup, frequency, graph, ml, ngrams, regions, semantic, spatial, vectors
from gazetta.sources import schema, storage
from gazetta.sources.lexicon import first_label, last_label, lexicon


@pytest.fixture
def names(spark):
    rows = [("广州", "a", "石石头村"), ("广州", "a", "新村"), ("深圳", "b", "大村"), (None, "b", "村")]
    return spark.createDataFrame(rows, "city string, county string, name string").withColumn("id", F.monotonically_increasing_id())


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_document_frequency(names):
    got = frequency.global_frequency(names, text.character_set(F.col("name")))
    assert rows(got, "char", "village_count", "rank")[-1] == ("石", 1, 5) and ("村", 4, 1) in rows(got, "char", "village_count", "rank")
    regional = frequency.regional_frequency(names, text.character_set(F.col("name")), ["city"])
    assert ("广州", "村", 2, 1.0, 1) in rows(regional, "city", "char", "village_count", "frequency", "rank_within_region")
    assert ("广州", "新", 1, 0.5, 2) in rows(regional, "city", "char", "village_count", "frequency", "rank_within_region")
    assert regional.filter("city IS NULL").isEmpty()
    assert frequency.global_frequency(names.limit(0), text.character_set(F.col("name"))).isEmpty()


def test_thresholds_keep_listed_sizes(spark):
    df = spark.createDataFrame([(2, 3), (2, 2), (3, 9)], "n int, c int")
    assert rows(df.filter(ngrams.at_least("c", {2: 3})), "n", "c") == [(2, 3)]
    assert df.filter(ngrams.at_least("c", {})).count() == 3


def test_pruning_matches_null_keys(spark):
    a = spark.createDataFrame([(None, "x"), ("c", "y")], "city string, ngram string")
    assert rows(ngrams.prune(a.limit(1), a, ["city", "ngram"]), "ngram") == [("x",)]


def test_lexicons(spark):
    lex = lexicon(spark, {"terrain": {"hill": ["山", "岭"]}, "water": ["水", "山"]}, {"水": ["terrain"]})
    assert rows(first_label(lex), "char", "category") == [("山", "terrain"), ("岭", "terrain"), ("水", "water")]
    assert ("山", "water") in rows(last_label(lex), "char", "category") and lex.count() == 5


def test_sequences_and_conflicts(spark):
    labels = {"山": "terrain", "水": "water", "大": "size"}
    df = spark.createDataFrame([("大山",), ("山水",), ("大x",)], "name string").withColumn("sequence", semantic.sequence(F.col("name"), labels))
    assert rows(df, "sequence")[1] == (["size", "terrain"],) or ["size", "other"] in [r["sequence"] for r in df.collect()]
    assert rows(semantic.conflicts(df, [("water", "terrain")], 5), "sequence", "frequency") == [("terrain-water", 1)]
    kept = semantic.structures(df.drop("sequence"), labels, least=0.6)
    assert kept.count() == 2


@pytest.fixture
def points(spark):
    near = [(i, 113.0 + i * 0.01, 23.0) for i in range(3)] + [(10 + i, 114.0 + i * 0.01, 23.5) for i in range(3)] + [(99, 118.0, 25.0)]
    return spark.createDataFrame([(*r, "a" if r[0] < 10 else "b") for r in near], "id long, lon double, lat double, city string")


def test_clusters_and_noise(points):
    labels = spatial.dbscan(points, 20.0, 2, 30.0)
    assert rows(labels, "id", "cluster") == [(0, 0), (1, 0), (2, 0), (10, 1), (11, 1), (12, 1), (99, -1)]
    got = spatial.cluster_profiles(points, labels, ["city"])
    assert rows(got, "cluster", "size", "dominant_city") == [(0, 3, "a"), (1, 3, "b")]


def clustered(rows, radius, least, planar):
    """DBSCAN by all pairs."""
    def km(p, q):
        if planar:
            return 111.0 * math.dist(p[1:], q[1:])
        a, b, c, d = map(math.radians, (p[1], p[2], q[1], q[2]))
        h = math.sin((d - b) / 2) ** 2 + math.cos(b) * math.cos(d) * math.sin((c - a) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))

    near = {p[0]: [q[0] for q in rows if km(p, q) <= radius] for p in rows}
    core = {p for p in near if len(near[p]) >= least}
    label, count = {}, 0
    for p in sorted(core):
        if p not in label:
            stack, label[p] = [p], count
            while stack:
                for q in near[stack.pop()]:
                    if q in core and q not in label:
                        label[q] = count
                        stack.append(q)
            count += 1
    border = {p: min((label[q] for q in near[p] if q in core), default=-1) for p in near if p not in core}
    return label | border


@pytest.mark.parametrize(
    "lon, lat, spread, radius, least, planar", [(179.9, 65.0, 0.5, 8.0, 4, False), (100.0, 20.0, 0.1, 3.0, 5, False), (10.0, 45.0, 0.3, 6.0, 8, True), (0.0, 0.0, 0.4, 5.0, 1, False)]
)
def test_clusters_like_all_pairs(spark, lon, lat, spread, radius, least, planar):
    draw = random.Random(7)
    rows_ = [(i, (lon + draw.gauss(0, spread) * draw.choice((1, 0.2)) + 180) % 360 - 180, lat + draw.gauss(0, spread / 2)) for i in range(150)]
    rows_ += [(150 + i, lon, lat) for i in range(20)]  # equal places
    df = spark.createDataFrame([*rows_, (999, None, None)], "id long, lon double, lat double")
    assert dict(rows(spatial.dbscan(df, radius, least, planar=planar), "id", "cluster")) == clustered(rows_, radius, least, planar) | {999: -1}


def test_cells_that_meet_by_an_inner_core(spark):
    """None of the first cell's outermost cores reaches the second cell, but one between them does."""
    rows_ = [(0, 0.0266, 0.0005), (1, 0.0266, 0.026), (2, 0.001, 0.0133), (3, 0.026, 0.0133), (4, 0.0635, 0.0133), (5, 0.075, 0.0133)]
    df = spark.createDataFrame(rows_, "id long, lon double, lat double")
    assert set(dict(rows(spatial.dbscan(df, 4.2, 2, planar=True), "id", "cluster")).values()) == {0}
    for radius in (4.1, 4.2, 4.4):
        assert dict(rows(spatial.dbscan(df, radius, 2, planar=True), "id", "cluster")) == clustered(rows_, radius, 2, True)


def test_empty_tables_have_no_clusters(points):
    assert spatial.dbscan(points.limit(0), 5.0, 2).isEmpty()


def test_stratified_sample(spark):
    kind = F.when(F.col("id") % 3 == 0, F.lit("a")).when(F.col("id") % 1000 == 1, F.lit("b")).when(F.col("id") % 7 != 1, F.lit("c"))
    df = spark.range(5000).select(kind.alias("s"), "id")
    want = set()
    for s in ("a", "b", "c", None):
        ids = sorted((r.id for r in df.collect() if r.s == s), key=lambda i: hashlib.md5(f"1|{i}".encode()).hexdigest())
        want |= {(s, i) for i in ids[: max(1, int(len(ids) * 0.05))]}
    assert {(r.s, r.id) for r in regions.stratified_sample(df, "s", 0.05, "id", 1).collect()} == want
    assert regions.stratified_sample(df.limit(0), "s", 0.05, "id").isEmpty()


def test_neighbours(points):
    got = spatial.nearest(points, 2, 1.0, 30.0)
    assert rows(got.filter("a = 0"), "b", "rank") == [(1, 1), (2, 2)]
    assert got.count() == 14
    assert rows(spatial.density(points, (1, 5), 30.0).filter("id = 0"), "density_1km", "density_5km") == [(0, 2)]
    assert rows(spatial.counts_in_radius(points.filter("id = 1"), points, (1.5, 200.0)), "within_1.5km", "within_200km") == [(3, 6)]


def test_coincident_points_exclude_themselves_only(spark):
    p = spark.createDataFrame([(1, 113.0, 23.0), (2, 113.0, 23.0)], "id long, lon double, lat double")
    assert rows(spatial.nearest(p, 1, 1.0, 30.0), "a", "b") == [(1, 2), (2, 1)]


def test_components_and_walks(spark):
    nodes = spark.createDataFrame([(i,) for i in range(8)], "node long")
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(5)] + [(6, 7, 2.0)], "a long, b long, weight double")
    assert rows(graph.connected_components(nodes, edges), "node", "root") == [(i, 0) for i in range(6)] + [(6, 6), (7, 6)]
    assert rows(graph.expand(edges, nodes.limit(1), 2, 5), "node", "depth") == [(0, 0), (1, 1), (2, 2)]
    ranks = graph.pagerank(edges)
    assert sum(r["rank"] for r in ranks.collect()) == pytest.approx(1)
    labels = {r["node"]: r["label"] for r in graph.label_propagation(edges).collect()}
    assert labels[6] == labels[7] == 6 and len(labels) == 8


def test_vectors(spark):
    t = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "a", [0.9, 0.1]), (2, "b", [0.0, 1.0]), (3, "b", [0.1, 0.9])], "id long, g string, vector array<double>")
    assert rows(vectors.nearest(t.filter("id < 2"), t, 1), "query", "id") == [(0, 1), (1, 0)]
    got = {r["g"]: r for r in vectors.coherence(t, "g").collect()}
    dot = (0.9 * 1) / (0.82**0.5)
    assert got["a"]["intra"] == pytest.approx(dot) and got["a"]["inter"] < 0.3
    assert rows(vectors.analogy(t, 0, 2, 1, 1), "id") == [(3,)]
    assert vectors.outliers(t, "g", 0.5).isEmpty()


def test_models(spark):
    df = spark.createDataFrame([(i, float(i % 2) * 10 + i * 0.01, float(i % 2) * 10) for i in range(20)], "id long, x double, y double")
    v = ml.standardised(ml.assembled(df, ["x", "y"]))
    found = ml.kmeans_sweep(v, [2, 3], "scaled")
    assert ml.best(found)["k"] == 2 and ml.best(found, "davies_bouldin")["davies_bouldin"] < 0.1
    labelled, cost = ml.kmeans(v, 2, "scaled")
    assert cost < 1 and ml.representatives(labelled, "id", 1).count() == 2
    assert rows(ml.distinguishing(labelled, ["x", "y"], "scaled", 1), "rank") == [(1,), (1,)]
    assert ml.projected(v, 1).select("pca").first()[0].size == 1
    assert ml.bisecting(ml.assembled(df, ["x", "y"], "raw"), 2, "raw").select("cluster").distinct().count() == 2
    assert ml.gaussian_mixture(v, 2, "scaled").filter("is_uncertain").count() <= 20
    assert "noise" in ml.dbscan_advice(3, 60, 100) and "lower eps" in ml.dbscan_advice(1, 0, 100)


def test_duplicate_names(spark):
    p = spark.createDataFrame([(1, "c", "石岭村"), (2, "c", "石岭村"), (3, "c", "石山村"), (4, "d", "石岭村")], "id long, city string, name string")
    got = dedup.block_pairs(p, ["city"], F.levenshtein(F.col("a.name"), F.col("b.name"), 1) >= 0)
    assert rows(got, "id_a", "id_b") == [(1, 2), (1, 3), (2, 3)]
    rules = spark.range(1).select(dedup.pair_rules(F.lit("东村一"), F.lit("东村二"), F.lit(0.3)).alias("r")).first()["r"]
    assert {"same_base", "one_edit", "within_500m"} <= set(rules)
    merged = dedup.merged_lists(spark.createDataFrame([(1, "b;a"), (1, "a;c")], "root long, d string"), "root", "d")
    assert rows(merged, "d") == [("a;b;c",)]
    assert rows(dedup.survivors(p, "name", [F.asc("id")]), "id") == [(1,), (3,)]


def test_policy():
    policy = api.Policy()
    with pytest.raises(api.Rejected):
        policy.check({"city": None})
    with pytest.raises(api.Rejected):
        policy.check({"city": "x"}, limit=10**6)
    with pytest.raises(api.Rejected):
        policy.check({"city": "x"}, clustering=True)
    policy.check({"city": "x"}, 10)
    assert policy.rows(5000) == 1000 and policy.rows(None) == 100 and policy.page(3, 600) == (500, 1000)


def test_pages_and_subsets(names):
    page = api.paged(names, ["name"], 2, 3)
    assert (page["total"], page["has_next"], page["rows"].count()) == (4, False, 1)
    assert api.search(names, "村", city="广州").count() == 2
    assert api.where(names, city="").count() == 1 and api.where(names, city=["广州", "深圳"]).count() == 3
    wanted = api.Subset(ends="村", length=(2, 2))
    assert api.subset(names, wanted).count() == 2
    tagged = semantic.tags(names, {"石": "rock", "新": "new"})
    assert api.subset(tagged, api.Subset(any_tags=("sem_rock", "sem_new"))).count() == 2
    assert api.subset(tagged, api.Subset(structures=({"sem_rock": 1, "sem_new": 0}, {"sem_new": 1}))).count() == 2


def test_ids(spark):
    p = spark.createDataFrame([("v_1",), ("v_2",)], "id string")
    assert rows(api.by_ids(p, ["1", "v_1", "v_9"]), "id") == [("v_1",)]


def test_storage(spark, tmp_path):
    df = spark.createDataFrame([(None, "a", 1.0), (None, "a", float("nan")), ("x", "b", 2.0)], "city string, char string, z double")
    storage.save(df, f"{tmp_path}/t", ["city", "char"], ["city", "char", "z", "extra"])
    back = spark.read.parquet(f"{tmp_path}/t")
    assert back.count() == 2 and back.filter("isnan(z)").isEmpty() and "extra" in back.columns
    storage.export_csv(df, f"{tmp_path}/c", True)
    storage.export_json(df, f"{tmp_path}/j")
    assert spark.read.csv(f"{tmp_path}/c", header=True).count() == spark.read.json(f"{tmp_path}/j").count() == 3
    assert r"\begin{tabular}{lll}" in storage.latex_table(df, "c", "l")
    assert "| city | char | z |" in storage.markdown_report("r", {"t": df})
    a, b = (storage.run_record(spark, r, "freq", p, t) for r, p, t in (("r1", {"k": "1", "m": "2"}, "2024-01-01"), ("r2", {"k": "1", "m": "3", "n": "4"}, "2024-01-02")))
    assert rows(storage.active_runs(a.unionAll(b)), "run_id") == [("r2",)]
    assert rows(storage.parameter_changes(a, b), "name") == [("m",), ("n",)]
    assert storage.drop_tables(spark, ["missing"]) == []


def test_coordinates_and_levels(spark):
    raw = spark.createDataFrame([("113.1", "23"), ("x", "23"), ("200", "23")], "lon string, lat string")
    assert schema.load_coordinates(raw, "lon", "lat").count() == 1
    assert rows(spark.createDataFrame([("c",), ("q",)], "l string").select(schema.level_name(F.col("l"), {"c": "city"}).alias("l")), "l") == [("city",), ("q",)]
    assert schema.missing_columns(raw, {"lon": "string", "alt": "double"}) == ["alt"]
    h = schema.Hierarchy(("a", "b"))
    assert h.key("b") == ["a", "b"]
    df = spark.createDataFrame([("x", "y", 1), ("x", "z", 2)], "a string, b string, v int")
    assert rows(regions.rollup(df, h, F.sum("v").alias("v")), "region_level", "v") == [("a", 3), ("b", 1), ("b", 2)]


def test_streaming_counts(spark, tmp_path):
    from gazetta.streaming import tendency

    e = spark.createDataFrame([(i, f"2024-01-01 0{i % 3}:10:00", i, "ab"[i % 2], 1.0, "") for i in range(12)], "event_id long, ts string, user_id long, event_type string, value double, props string")
    e.withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/in/events.parquet")
    q = tendency.windowed_counts(tendency.events(spark, f"{tmp_path}/in/events.parquet", "*.parquet")).writeStream.format("memory").queryName("out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    counts = spark.table("out")
    assert counts.agg(F.sum("n")).first()[0] == 12
    assert tendency.windowed_tendency(counts).filter("lift IS NULL").isEmpty()


def test_neighbours_anywhere_on_the_globe(spark):
    """Against all pairs: high latitudes, both hemispheres, the 180th meridian and a pole."""
    import random
    from math import asin, cos, radians, sin, sqrt

    from gazetta.operators import spatial

    rng = random.Random(4)
    rows = []
    for lat, lon in ((65.0, 20.0), (-68.0, 179.95), (10.0, -179.98), (89.9, 0.0), (0.0, 0.0)):
        for _ in range(25):
            x = lon + rng.uniform(-0.3, 0.3) / max(0.02, cos(radians(lat)))
            rows.append((len(rows), (x + 180) % 360 - 180, max(-90.0, min(90.0, lat + rng.uniform(-0.2, 0.2)))))

    def km(p, q):
        h = sin(radians(q[2] - p[2]) / 2) ** 2 + cos(radians(p[2])) * cos(radians(q[2])) * sin(radians(q[1] - p[1]) / 2) ** 2
        return 2 * 6371.0 * asin(sqrt(min(1.0, h)))

    points = spark.createDataFrame(rows, "id long, lon double, lat double")
    for radius in (10.0, 300.0):
        want = {(p[0], q[0]) for p in rows for q in rows if km(p, q) <= radius}
        got = [(r["a"], r["b"]) for r in spatial.neighbours(points, points, radius).collect()]
        assert len(got) == len(set(got)) and {*got} == want
    near = {(r["a"], r["rank"]): r["b"] for r in spatial.nearest(points, 3).collect()}
    for p in rows:
        others = sorted((km(p, q), q[0]) for q in rows if q is not p)
        assert [near[p[0], k] for k in (1, 2, 3)] == [i for _, i in others[:3]]


def test_numbers_follow_the_order(spark):
    from gazetta.operators import spatial

    rows = spatial.numbered(spark.range(0, 1000, 3).repartition(5), "id", "n").collect()
    assert sorted((r["id"], r["n"]) for r in rows) == [(3 * k, k) for k in range(334)]


def test_naming_hotspots(spark):
    from gazetta.operators import spatial

    rows = [(i, 10 + (i % 7) * 0.001, 20 + (i % 5) * 0.001, int(i < 60), int(i < 3)) for i in range(90)] + [(100 + i, 11.0 + i, 25.0, 1, 0) for i in range(5)]
    found = spatial.naming_hotspots(spark.createDataFrame(rows, "id long, lon double, lat double, t_a int, t_b int"), ["t_a", "t_b"], bandwidth_km=2.0, least=4)
    assert {r["tag"] for r in found.collect()} == {"t_a"}


def test_block_pairs_look_at_different_names_once(spark):
    """However many places have a name, its pairs with other names are measured once; nothing is broadcast."""
    from pyspark.sql.functions import udf

    looked = spark.sparkContext.accumulator(0)

    @udf("boolean")
    def close(a, b):
        looked.add(1)
        return None not in (a, b) and (a[:-1] == b[:-1] or a == b)

    rows_ = [(i, "c", ("hill a", "hill b", "dale")[i % 3]) for i in range(90)] + [(90, "d", "hill a"), (91, None, "dale"), (92, None, "dale"), (93, "c", None)]
    p = spark.createDataFrame(rows_, "id int, city string, name string")
    out = dedup.block_pairs(p, ["city"], close(F.col("a.name"), F.col("b.name")), facts={"same": F.col("a.name") == F.col("b.name")})
    got = sorted((r["id_a"], r["id_b"], r["same"]) for r in out.collect())
    near = {("hill a", "hill b"), ("hill b", "hill a")}
    want = [(a[0], b[0], a[2] == b[2]) for a in rows_ for b in rows_ if a[0] < b[0] and a[1] == b[1] and a[2] and b[2] and (a[2] == b[2] or (a[2], b[2]) in near)]
    assert got == sorted(want)
    assert looked.value <= 60


def test_block_pairs_broadcast_no_side(spark):
    p = spark.range(9).selectExpr("id", "'c' AS city", "concat('hill ', id % 3) AS name")  # of a size that Spark knows to be small
    out = dedup.block_pairs(p, ["city"], F.levenshtein(F.col("a.name"), F.col("b.name"), 1) >= 0)
    assert out.count() == 36
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_near_duplicate_pairs_broadcast_nothing_when_run(spark, tmp_path):
    """The plan as it was run: sizes seen meanwhile don't turn a join of names into a broadcast either."""
    from gazetta import plans

    part = spark.range(60).selectExpr("id AS p_partkey", "concat('hill ', id % 3) AS p_name", "'b' AS p_brand", "'t' AS p_type", "cast(id % 2 AS int) AS p_size")
    part.write.parquet(f"{tmp_path}/part.parquet")
    out = plans.QUERIES["near_duplicate_pairs"](spark, str(tmp_path))
    got = {(r["id_a"], r["id_b"], r["same_name"]) for r in out.collect()}
    assert got == {(a, b, (a - b) % 6 == 0) for a in range(60) for b in range(a + 1, 60) if a % 3 == b % 3 or a % 2 == b % 2}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan
    assert "Broadcast" not in plan
