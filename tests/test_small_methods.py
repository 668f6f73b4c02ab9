"""Networks, linkage, density hierarchies, sampling and lexicon growth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazetta.operators import clustering, expansion, networks
from gazetta.sources.lexicon import lexicon
from gazetta.sources.schema import Hierarchy


@pytest.fixture
def barbell(spark):
    edges = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5), (7, 8)]
    return networks.collected(spark.createDataFrame([(a, b, 1.0) for a, b in edges], "a long, b long, weight double"))


def test_paths_and_cuts(barbell):
    assert networks.bridges(barbell) == [(2, 3), (7, 8)] and networks.cut_nodes(barbell) == [2, 3]
    between = networks.betweenness(barbell)
    assert between[2] == between[3] == pytest.approx(2 * 6 / (7 * 6)) and between[0] == 0
    close = networks.closeness(barbell)
    assert close[2] > close[0] > close[7]
    assert networks.diameter(barbell) == 3 and [len(c) for c in networks.components(barbell)] == [6, 2]


def test_communities(barbell):
    parts = networks.communities(barbell)
    assert {frozenset(p) for p in parts} == {frozenset({0, 1, 2}), frozenset({3, 4, 5}), frozenset({7, 8})}
    assert networks.modularity(barbell, parts) > networks.modularity(barbell, [set(barbell)])
    s = networks.summary(barbell)
    assert (s["nodes"], s["edges"], s["components"], s["communities"]) == (8, 8, 2, 3)
    central = networks.eigenvector(barbell)
    assert central[2] == pytest.approx(central[3]) and central[2] > central[0]
    assert networks.clustering_coefficient(barbell) == pytest.approx((4 + 2 / 3) / 8)


def test_linkage_and_density():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    assert sorted(np.bincount(clustering.ward_labels(x, 3))) == [30, 30, 30]
    noisy = np.concatenate([x, [[20.0, -20.0]]])
    labels, probability = clustering.hdbscan_labels(noisy, 10, 5)
    assert labels[-1] == -1 and probability[-1] == 0
    assert sorted(np.bincount(labels[labels >= 0])) == pytest.approx([30, 30, 30], abs=4)
    assert set(clustering.hdbscan_labels(x[:4], 10)[0]) == {-1}


def test_small_tables_only(spark):
    df = spark.createDataFrame([(i, float(i % 2) * 9 + i * 0.01) for i in range(24)], "id long, x double")
    got = clustering.small(df, "id", ["x"], "ward", k=2)
    assert sorted(r["count"] for r in got.groupBy("cluster").count().collect()) == [12, 12]
    assert clustering.small(df, "id", ["x"], "hdbscan", least_size=5, least_points=3).count() == 24
    with pytest.raises(ValueError):
        clustering.small(spark.range(6000).withColumn("x", F.lit(1.0)), "id", ["x"], "ward", k=2)


def test_features_and_samples(spark):
    rows = [(i, f"c{i % 2}", f"k{i % 4}", "ab"[i % 2] + "x" * (i % 3) + "yz"[i % 2], 113 + i * 0.01, 23 + (i % 5) * 0.1) for i in range(60)]
    p = spark.createDataFrame(rows, "id long, city string, county string, name string, lon double, lat double")
    f, columns = clustering.village_features(p, ["x"], 2)
    assert columns == ["f_length", "kw_0", "end_0", "end_1"]
    out, quality = clustering.clustered(f, columns, 2, components=2)
    assert out.count() == 60 and quality["silhouette"] > 0
    tree = clustering.nested(f, Hierarchy(("city", "county")), columns, 2)
    assert tree["city"].count() == 2 and tree["county"].columns == ["city", "county", "cluster"]
    assert clustering.sample(p, "random", 10, "id").count() == 10
    assert clustering.sample(p, "stratified", 12, "id", "city").count() == 12
    spread = clustering.sample(p, "spatial", 10, "id", cells=2)
    assert 4 <= spread.count() <= 12 and spread.columns == p.columns
    t = spark.createDataFrame([("c0", "a", 1.0), ("c0", "b", 2.0), ("c1", "a", 3.0)], "city string, char string, z double")
    wide, names = clustering.tendency_features(t, ["city"], "char", "z", 1)
    assert names == ["a", "b"] and wide.filter("region = 'c1'").first()["b"] == 0.0


def test_lexicon_growth(spark):
    lex = lexicon(spark, {"hill": ["山", "岭"], "water": ["水", "河"]})
    e = spark.createDataFrame([("山", [1.0, 0.0]), ("岭", [0.9, 0.1]), ("水", [0.0, 1.0]), ("峰", [1.0, 0.1]), ("湖", [1.0, 0.0])], "char string, vector array<double>")
    p = spark.createDataFrame([("峰", "hill", 0.9), ("湖", "water", 0.9), ("田", "hill", 0.8), ("x", "hill", 0.2)], "char string, category string, confidence double")
    got = expansion.accepted_labels(p, lex, e)
    assert sorted(r["char"] for r in got.collect()) == ["峰", "田"]
    grown = expansion.extended(lex, got)
    assert grown.count() == 6 and grown.agg(F.max("ord")).first()[0] == 5
    assert expansion.merged_categories(lex, ["hill", "water"], "nature").select("category").distinct().count() == 1
    assert expansion.split_category(lex, "hill", {"peak": ["山"]}).filter("category = 'peak'").count() == 1
    assert expansion.similar_categories(lex, e, -1.0).count() == 1
    assert [r[0] for r in expansion.unclassified(lex, {"natural": ["hill"]}).collect()] == ["water"]
    assert expansion.char_coverage(e.select("char"), lex).first()["labelled"] == 3


def test_result_cache(spark):
    from gazetta.operators.runtime import ResultCache

    now = [0.0]
    cache = ResultCache(10, 2, lambda: now[0])
    made = []

    def make(n):
        made.append(n)
        return spark.range(n)

    assert cache.get("r", make, n=3).count() == cache.get("r", make, n=3).count() == 3
    now[0] = 11.0
    cache.get("r", make, n=3)
    cache.get("r", make, n=4)
    cache.get("r", make, n=5)
    assert made == [3, 3, 4, 5] and cache.stats() == {"entries": 2, "hits": 1, "misses": 4}
    cache.clear()


def test_time_limit(spark):
    from gazetta.operators.runtime import within

    assert within(spark, 60, lambda: spark.range(5).count()) == 5
    slow = spark.range(400_000_000_000, numPartitions=4).agg(F.max(F.xxhash64(F.xxhash64("id"))))
    with pytest.raises(TimeoutError):
        within(spark, 2, lambda: slow.collect())


def test_prefix_matching(spark):
    from gazetta.operators import dedup

    rows = [(1, "t", "石桥村", "石桥东头"), (2, "t", "李家村", "石桥西头"), (3, "t", "李家村", "石桥村"), (4, "u", "王家村", "石桥北头"), (5, "t", "李家村", "李家石桥头")]
    p = spark.createDataFrame(rows, "id long, township string, committee string, name string")
    got = {r["id"]: (r["candidate"], r["remaining"], r["status"]) for r in dedup.prefix_matches(p, least=2).collect()}
    assert got == {1: ("石桥", "东头", "own"), 2: ("石桥", "西头", "other"), 5: ("李家", "石桥头", "own")}
    a = spark.createDataFrame([("石桥东头", "东头", "石桥村")], "a string, b string, m string")
    assert a.select(dedup.prefix_proposal(F.col("a"), F.col("b"), F.col("m"))).first()[0] == "b"


def test_names_are_cleaned_beyond_two_hundred_characters(spark, tmp_path):
    from gazetta import plans

    text = "a" * 30 + "1" * 300 + "(note)" + "b" * 40
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = plans.QUERIES["name_clean_whole"](spark, str(tmp_path)).first()
    assert row.clean_name == "a" * 30 + "b" * 40 and row.is_valid and row.had_brackets and row.had_noise


def test_names_one_edit_apart_at_their_start_meet(spark, tmp_path):
    from gazetta import plans

    names = ["old plate", "cold plate", "plate cold", "old plates", "bold crate"]
    rows = [(i, n, "b", "t", i) for i, n in enumerate(names)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.name_a, r.name_b): (r.distance, r.similarity) for r in plans.QUERIES["name_similarity_edits"](spark, str(tmp_path)).collect()}
    assert got == {("cold plate", "old plate"): (1, 0.9), ("cold plate", "old plates"): (2, 0.8), ("old plate", "old plates"): (1, 0.9)}
