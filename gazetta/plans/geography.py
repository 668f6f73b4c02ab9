"""Queries on coordinates, vectors, graphs, duplicates and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazetta.functions import text
from gazetta.operators import dedup, graph, ml, regions, spatial, vectors
from gazetta.sources.schema import POINTS_SQL, Hierarchy, places, points
from gazetta.sources.storage import active_runs, cut

from .frequency import _CHARS, _TEND, CITY, _joined, _joined_sql
from .registry import query, rounded

_HAV = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
_AB = _HAV.format(a="a", b="b")
_PLANAR = "111.0 * sqrt(pow({a}.lon - {b}.lon, 2) + pow({a}.lat - {b}.lat, 2))"
_PAB = _PLANAR.format(a="a", b="b")
LATITUDE = 26.0  # of the derived coordinates


@query(f"WITH {POINTS_SQL} SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM points WHERE lon BETWEEN 110 AND 115 AND lat BETWEEN 21 AND 24")
def bounding_box(spark, sf_dir):
    from gazetta.sources.schema import load_coordinates

    return rounded(load_coordinates(points(spark, sf_dir), "lon", "lat", (110, 115, 21, 24)).select("id", "lon", "lat"))


@query(f"WITH {POINTS_SQL} SELECT CASE WHEN grouping(county) = 1 THEN 'city' ELSE 'county' END AS region_level, city, county, count(*) AS villages, round(avg(lon), 6) AS centroid_lon, round(avg(lat), 6) AS centroid_lat FROM points GROUP BY GROUPING SETS ((city), (city, county))")
def regional_centroids(spark, sf_dir):
    out = regions.rollup(points(spark, sf_dir), Hierarchy(("city", "county")), F.count(F.lit(1)).alias("villages"), F.avg("lon").alias("centroid_lon"), F.avg("lat").alias("centroid_lat"))
    return rounded(out.select("region_level", "city", "county", "villages", "centroid_lon", "centroid_lat"))


@query(f"WITH {POINTS_SQL} SELECT a.id, count(*) FILTER ({_AB} <= 5) AS density_5km, count(*) FILTER ({_AB} <= 10) AS density_10km, count(*) FILTER ({_AB} <= 20) AS density_20km FROM points a JOIN points b ON a.id <> b.id GROUP BY a.id")
def radius_density(spark, sf_dir):
    return spatial.density(points(spark, sf_dir), (5, 10, 20), LATITUDE)


@query(f"WITH {POINTS_SQL} SELECT * FROM (SELECT a.id AS a, b.id AS b, round({_AB}, 6) AS km, row_number() OVER (PARTITION BY a.id ORDER BY {_AB}, b.id) AS rank FROM points a JOIN points b ON a.id <> b.id) WHERE rank <= 5")
def knn(spark, sf_dir):
    return rounded(spatial.nearest(points(spark, sf_dir), 5, 30.0, LATITUDE))


_FEATURES = (
    f"WITH {POINTS_SQL}, p AS (SELECT a.id, any_value(a.city) AS city, min({_AB}) AS nn_distance_1, count(*) FILTER ({_AB} <= 5) AS density_5km FROM points a JOIN points b ON a.id <> b.id GROUP BY a.id), "
    "e AS (SELECT min(nn_distance_1) AS n0, max(nn_distance_1) AS n1, min(density_5km) AS d0, max(density_5km) AS d1 FROM p), "
    "iso AS (SELECT id, city, nn_distance_1, density_5km, ((nn_distance_1 - n0) / (n1 - n0 + 1e-10) + (1 - (density_5km - d0) / (d1 - d0 + 1e-10))) / 2 AS isolation_score, nn_distance_1 > 10 AS is_isolated FROM p, e) "
)


def _features(spark, sf_dir):
    p = points(spark, sf_dir)
    near = spatial.neighbour_features(p, 5, 30.0, most_latitude=LATITUDE).select("id", "nn_distance_1")
    out = p.join(near, "id").join(spatial.density(p, (5,), LATITUDE), "id")
    return spatial.isolation_minmax(out)


@query(_FEATURES + "SELECT id, round(nn_distance_1, 6) AS nn_distance_1, density_5km, round(isolation_score, 6) AS isolation_score, is_isolated FROM iso")
def isolation(spark, sf_dir):
    return rounded(_features(spark, sf_dir).select("id", "nn_distance_1", "density_5km", "isolation_score", "is_isolated"))


@query(_FEATURES + "SELECT city, count(*) AS village_count, round(avg(nn_distance_1), 6) AS avg_nn_distance, round(avg(density_5km), 6) AS avg_density, round(avg(isolation_score), 6) AS avg_isolation, count(*) FILTER (is_isolated) AS n_isolated, round(stddev_samp(nn_distance_1) / avg(nn_distance_1), 6) AS dispersion FROM iso GROUP BY city")
def spatial_aggregates(spark, sf_dir):
    return rounded(spatial.regional_aggregates(_features(spark, sf_dir), ["city"]))


_EPS, _LEAST = 12.0, 5
_DBSCAN = (
    f"WITH RECURSIVE {POINTS_SQL}, near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM points a JOIN points b ON {_AB} <= {_EPS}), core AS MATERIALIZED (SELECT a FROM near GROUP BY a HAVING count(*) >= {_LEAST}), "
    "link AS MATERIALIZED (SELECT near.a, near.b FROM near JOIN core c1 ON c1.a = near.a JOIN core c2 ON c2.a = near.b), reach AS (SELECT a AS node, a AS root FROM core UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.node WHERE reach.root < link.b), "
    "roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node), num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM roots)), cl AS (SELECT node, cluster FROM roots JOIN num USING (root)), "
    "lab AS (SELECT near.a AS id, coalesce(min(CASE WHEN near.a = near.b THEN cluster END), min(cluster)) AS cluster FROM near JOIN cl ON cl.node = near.b GROUP BY near.a), "
    "labels AS (SELECT points.id, CAST(coalesce(lab.cluster, -1) AS BIGINT) AS cluster FROM points LEFT JOIN lab USING (id)) "
)


def _labels(spark, sf_dir):
    return spatial.dbscan(points(spark, sf_dir), _EPS, _LEAST, LATITUDE)


@query(_DBSCAN + "SELECT id, cluster FROM labels")
def dbscan(spark, sf_dir):
    return _labels(spark, sf_dir)


@query(_DBSCAN.replace(f"{_AB} <= {_EPS}", f"{_AB} <= 24.0") + "SELECT id, cluster FROM labels")
def dbscan_wide(spark, sf_dir):
    """With a radius that joins small tables' points, too."""
    return spatial.dbscan(points(spark, sf_dir), 24.0, _LEAST)


@query(
    _DBSCAN + ", r AS (SELECT points.*, cluster FROM points JOIN labels USING (id) WHERE cluster >= 0), ce AS (SELECT cluster, count(*) AS size, avg(lon) AS lon, avg(lat) AS lat FROM r GROUP BY cluster), "
    "md AS (SELECT cluster, min(city) AS dominant_city FROM (SELECT cluster, city, count(*) AS n, max(count(*)) OVER (PARTITION BY cluster) AS m FROM r GROUP BY cluster, city) WHERE n = m GROUP BY cluster) "
    f"SELECT a.cluster, any_value(b.size) AS size, round(any_value(b.lon), 6) AS centroid_lon, round(any_value(b.lat), 6) AS centroid_lat, any_value(dominant_city) AS dominant_city, round(avg({_PAB}), 6) AS avg_distance_km, round(max({_PAB}), 6) AS radius_km FROM r a JOIN ce b USING (cluster) JOIN md USING (cluster) GROUP BY a.cluster"
)
def cluster_profile_mode(spark, sf_dir):
    return rounded(spatial.cluster_profiles(points(spark, sf_dir), _labels(spark, sf_dir), ["city"]))


_H = 15.0
_KDE = f"dens AS (SELECT a.id, sum(exp(-pow(({_PAB}) / 111.0, 2) / (2 * pow({_H} / 111.0, 2)))) / (2 * pi() * pow({_H} / 111.0, 2) * (SELECT count(*) FROM points)) AS density_score FROM points a JOIN points b ON {_PAB} <= {_H} * 4 GROUP BY a.id)"


@query(f"WITH {POINTS_SQL}, {_KDE} SELECT id, round(density_score, 6) AS density_score, density_score >= (SELECT quantile_cont(density_score, 0.9) FROM dens) AS is_hot FROM dens")
def kde_hotspots(spark, sf_dir):
    scored = cut(spatial.kde(points(spark, sf_dir), _H, most_latitude=LATITUDE))
    floor = scored.agg(F.percentile("density_score", 0.9).alias("floor"))
    return rounded(scored.join(F.broadcast(floor)).select("id", "density_score", (F.col("density_score") >= F.col("floor")).alias("is_hot")))  # a single row


_HOT = _DBSCAN[_DBSCAN.index("core AS") : _DBSCAN.index("labels AS")].rstrip(", ").replace(f">= {_LEAST}", ">= 3")


@query(
    f"WITH RECURSIVE {POINTS_SQL}, {_KDE}, hp AS MATERIALIZED (SELECT points.*, density_score FROM points JOIN dens USING (id) WHERE density_score >= (SELECT quantile_cont(density_score, 0.8) FROM dens)), near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM hp a JOIN hp b ON {_PAB} <= 40.0), {_HOT}, "
    "r AS (SELECT hp.*, cluster FROM hp JOIN lab USING (id)), ce AS (SELECT cluster, count(*) AS size, avg(lon) AS lon, avg(lat) AS lat, avg(density_score) AS dens FROM r GROUP BY cluster), "
    "md AS (SELECT cluster, min(city) AS dominant_city FROM (SELECT cluster, city, count(*) AS n, max(count(*)) OVER (PARTITION BY cluster) AS m FROM r GROUP BY cluster, city) WHERE n = m GROUP BY cluster), "
    f"pr AS (SELECT a.cluster, avg({_PAB}) AS far, max({_PAB}) AS radius FROM r a JOIN ce b USING (cluster) GROUP BY a.cluster) "
    f"SELECT pr.cluster, any_value(b.size) AS size, round(any_value(b.lon), 6) AS centroid_lon, round(any_value(b.lat), 6) AS centroid_lat, any_value(dominant_city) AS dominant_city, round(any_value(far), 6) AS avg_distance_km, round(any_value(radius), 6) AS radius_km, round(any_value(b.dens), 6) AS mean_density, count(*) FILTER ({_PAB} <= radius + 1e-9) AS village_count "
    "FROM pr JOIN ce b USING (cluster) JOIN md USING (cluster), points a GROUP BY pr.cluster"
)
def hotspot_clusters(spark, sf_dir):
    return rounded(spatial.hotspots(points(spark, sf_dir), _H, 80.0, 40.0, 3, ["city"], LATITUDE))


@query(
    _DBSCAN + ", rows_ AS (SELECT points.*, cluster FROM points JOIN labels USING (id)), ch AS (SELECT cluster, lon, lat, unnest(list_distinct(string_split(regexp_replace(name, '[^0-9]', '', 'g'), ''))) AS char FROM rows_), "
    "cs AS (SELECT cluster, count(*) AS cluster_size FROM rows_ WHERE cluster >= 0 GROUP BY cluster), ga AS (SELECT char, count(*) AS n_all FROM ch GROUP BY char), ce AS (SELECT char, cluster, count(*) AS n, avg(lon) AS cx, avg(lat) AS cy FROM ch WHERE cluster >= 0 GROUP BY char, cluster), "
    "sp AS (SELECT ch.char, ch.cluster, stddev_pop(sqrt(pow(lon - cx, 2) + pow(lat - cy, 2))) AS s FROM ch JOIN ce USING (char, cluster) GROUP BY ch.char, ch.cluster) "
    "SELECT char, cluster, n, cluster_size, round(n::DOUBLE / cluster_size, 6) AS local_share, round((n::DOUBLE / cluster_size) / (n_all::DOUBLE / (SELECT count(*) FROM points)), 6) AS specificity, round(CASE WHEN n < 2 THEN 1.0 ELSE 1 / (1 + s) END, 6) AS coherence FROM ce JOIN sp USING (char, cluster) JOIN cs USING (cluster) JOIN ga USING (char)"
)
def integration_char_cluster(spark, sf_dir):
    digits = text.character_set(F.regexp_replace("name", "[^0-9]", ""))
    out = spatial.integration(points(spark, sf_dir), _labels(spark, sf_dir), digits)
    return rounded(out.select("char", "cluster", "n", "cluster_size", "local_share", "specificity", "coherence"))


_TZ = _joined_sql(CITY) + ", " + _TEND


def _long(spark, sf_dir):
    j = _joined(spark, sf_dir, CITY)
    from gazetta.functions import stats

    return j.withColumn("z_score", F.round(stats.z_binomial(F.col("village_count"), F.col("total_villages"), F.col("global_frequency")), 9))


@query(
    _TZ + ", v AS (SELECT city, char, p, round(z_score, 9) >= 1 AS x FROM z), o AS (SELECT city, sum(p * p) AS q, count(*) FILTER (x) AS m FROM v GROUP BY city), "
    "d AS (SELECT a.city AS region_1, b.city AS region_2, sum(a.p * b.p) AS dot, count(*) FILTER (a.x AND b.x) AS common FROM v a JOIN v b ON a.char = b.char AND a.city < b.city GROUP BY ALL) "
    "SELECT region_1, region_2, round(dot / (sqrt(o1.q) * sqrt(o2.q)), 6) AS cosine, round(sqrt(greatest(o1.q + o2.q - 2 * dot, 0.0)), 6) AS euclidean, round(CASE WHEN o1.m + o2.m - common = 0 THEN 0.0 ELSE common::DOUBLE / (o1.m + o2.m - common) END, 6) AS jaccard FROM d JOIN o o1 ON o1.city = region_1 JOIN o o2 ON o2.city = region_2"
)
def region_similarity(spark, sf_dir):
    return rounded(regions.similarity(_long(spark, sf_dir), "city", "char", "frequency", F.col("z_score") >= 1))


@query(_TZ + ", rd AS (SELECT city, char, row_number() OVER (PARTITION BY city ORDER BY round(z_score, 9) DESC, char) AS k FROM z WHERE round(z_score, 9) >= 0.5) SELECT city, string_agg(char, '' ORDER BY k) AS distinctive FROM rd WHERE k <= 10 GROUP BY city")
def distinctive_chars(spark, sf_dir):
    out = regions.distinctive(_long(spark, sf_dir), CITY, "char", 10, 0.5)
    return out.select("city", F.array_join("distinctive", "").alias("distinctive"))


_DOT = "list_dot_product({a}, {b})"
_VEC = "e AS (SELECT vec_id, label, [x::DOUBLE for x in embedding] AS v FROM embeddings), n AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS l FROM e)"


@query(f"WITH {_VEC} SELECT * FROM (SELECT a.vec_id AS query, b.vec_id AS id, round(list_dot_product(a.v, b.v) / (a.l * b.l), 6) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) / (a.l * b.l) DESC, b.vec_id) AS rank FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= 5")
def embedding_topk(spark, sf_dir):
    """The query set (every fiftieth vector) is the search's own; the table is whole."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rounded(vectors.nearest(e.filter("vec_id % 50 = 0"), e, 5, "vec_id", "embedding"))


@query(f"WITH {_VEC}, u AS (SELECT vec_id, [x / l for x in v] AS u, v, l FROM n), q AS (SELECT [b.u[i] + c.u[i] - a.u[i] for i in range(1, 65)] AS g FROM u a, u b, u c WHERE a.vec_id = 0 AND b.vec_id = 1 AND c.vec_id = 2) SELECT vec_id AS id, round(list_dot_product(v, g) / (l * sqrt(list_dot_product(g, g))), 6) AS similarity FROM u, q WHERE vec_id NOT IN (0, 1, 2) ORDER BY similarity DESC, id LIMIT 10")
def embedding_analogy(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rounded(vectors.analogy(e, 0, 1, 2, 10, id_col="vec_id", vector="embedding"))


_UNIT = f"WITH {_VEC}, u AS (SELECT vec_id, label, [x / l for x in v] AS u FROM n), m AS (SELECT label, any_value(c) AS c, list(x ORDER BY i) AS mean FROM (SELECT label, i, avg(u[i]) AS x, count(*) AS c FROM u, range(1, 65) t(i) GROUP BY label, i) GROUP BY label)"


@query(_UNIT + " SELECT a.label, any_value(a.c) AS n, round(any_value((a.c * list_dot_product(a.mean, a.mean) - 1) / (a.c - 1)), 6) AS intra, round(sum(list_dot_product(a.mean, b.mean) * b.c) / sum(b.c), 6) AS inter FROM m a JOIN m b ON a.label <> b.label GROUP BY a.label")
def intra_inter_similarity(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rounded(vectors.coherence(e, "label", "embedding"))


@query(_UNIT + " SELECT vec_id, u.label, round((c * list_dot_product(u, mean) - 1) / (c - 1), 6) AS peer_similarity FROM u JOIN m USING (label) WHERE (c * list_dot_product(u, mean) - 1) / (c - 1) < 0.1")
def embedding_outliers(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rounded(vectors.outliers(e, "label", 0.1, "vec_id", "embedding"))


@query(f"WITH {_VEC} SELECT a.vec_id AS id, round(list_dot_product(a.v, b.v) / (a.l * b.l), 6) AS cosine, round(list_distance(a.v, b.v), 6) AS euclidean, round(list_sum([abs(a.v[i] - b.v[i]) for i in range(1, 65)]), 6) AS manhattan FROM n a, n b WHERE b.vec_id = 0")
def vector_compare(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    first = F.broadcast(e.filter("vec_id = 0").select(F.col("embedding").alias("o")))  # one row
    a, b = F.col("embedding"), F.col("o")
    return rounded(e.join(first).select(F.col("vec_id").alias("id"), vectors.cosine(a, b).alias("cosine"), vectors.euclidean(a, b).alias("euclidean"), vectors.manhattan(a, b).alias("manhattan")))


def _edges(spark, sf_dir):
    """Orders link customers' nations to parts' sizes' nations: a small weighted graph of nations."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(li, o["o_orderkey"] == li["l_orderkey"]).join(s, li["l_suppkey"] == s["s_suppkey"]).filter("c_nationkey <> s_nationkey")
    return j.groupBy(F.least("c_nationkey", "s_nationkey").alias("a"), F.greatest("c_nationkey", "s_nationkey").alias("b")).agg(F.count(F.lit(1)).alias("weight"))


_EDGES = (
    "edges AS (SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b, count(*) AS weight FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL), "
    "both_ AS (SELECT a, b, weight FROM edges UNION ALL SELECT b, a, weight FROM edges)"
)


@query(f"WITH {_EDGES}, d AS (SELECT a AS node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS weighted_degree FROM both_ GROUP BY a) SELECT *, round(degree::DOUBLE / (count(*) OVER () - 1), 6) AS centrality FROM d")
def degree_centrality(spark, sf_dir):
    return rounded(graph.degree(_edges(spark, sf_dir)))


@query(f"WITH {_EDGES} SELECT * FROM (SELECT a, b, weight, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS rank FROM both_) WHERE rank <= 3")
def network_neighbors(spark, sf_dir):
    return graph.top_neighbours(_edges(spark, sf_dir), 3)


@query(
    f"WITH RECURSIVE {_EDGES}, moves AS MATERIALIZED (SELECT a, b, weight::DOUBLE / sum(weight) OVER (PARTITION BY a) AS share FROM both_), size AS MATERIALIZED (SELECT count(DISTINCT a)::DOUBLE AS n FROM both_), "
    "r AS (SELECT DISTINCT a AS node, 0 AS i, 1.0 / n AS rank FROM moves, size UNION ALL SELECT moves.b, r.i + 1, 0.15 / any_value(size.n) + 0.85 * sum(r.rank * moves.share) FROM r JOIN moves ON moves.a = r.node, size WHERE r.i < 50 GROUP BY moves.b, r.i) "
    "SELECT node, round(rank, 6) AS rank FROM r WHERE i = 50"
)
def pagerank(spark, sf_dir):
    return rounded(graph.pagerank(_edges(spark, sf_dir)))


@query(
    f"WITH RECURSIVE {_EDGES}, arcs AS MATERIALIZED (SELECT a, b, weight FROM both_ UNION ALL SELECT a, a, max(weight) FROM both_ GROUP BY a), "
    "l AS (SELECT DISTINCT a AS node, a AS label, 0 AS i FROM arcs UNION ALL SELECT a, arg_min(label, (-w, label)), i + 1 FROM (SELECT arcs.a, l.label, l.i, sum(weight) AS w FROM arcs JOIN l ON l.node = arcs.b WHERE l.i < 20 GROUP BY arcs.a, l.label, l.i) GROUP BY a, i) "
    "SELECT node, label FROM l WHERE i = 20"
)
def label_propagation(spark, sf_dir):
    return graph.label_propagation(_edges(spark, sf_dir))


@query(
    f"WITH RECURSIVE {_EDGES}, best AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS r FROM both_) WHERE r <= 2), "
    "walk AS (SELECT 0 AS node, 0 AS depth UNION SELECT best.b, walk.depth + 1 FROM walk JOIN best ON best.a = walk.node WHERE walk.depth < 3) SELECT node, min(depth) AS depth FROM walk GROUP BY node"
)
def bfs_expand(spark, sf_dir):
    e = _edges(spark, sf_dir)
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    start = spark.range(1).select(F.lit(0).alias("node"))
    return graph.expand(both, start, 3, 2)


@query(
    "WITH p AS (SELECT p_partkey AS id, p_brand AS city, p_type AS county, p_name || ' ' || p_size AS name FROM part) SELECT a.city, a.county, a.id AS id_a, b.id AS id_b, a.name = b.name AS same_name FROM p a JOIN p b ON a.city = b.city AND a.county = b.county AND a.id < b.id AND levenshtein(a.name, b.name) <= 1"
)
def near_duplicate_pairs(spark, sf_dir):
    p = places(spark, sf_dir).withColumn("name", F.concat_ws(" ", "name", "township"))
    near = F.levenshtein(F.col("a.name"), F.col("b.name"), 1) >= 0
    out = dedup.block_pairs(p, ["city", "county"], near)
    return out.select("city", "county", "id_a", "id_b", (F.col("name_a") == F.col("name_b")).alias("same_name"))


@query(
    f"WITH RECURSIVE {POINTS_SQL}, q AS (SELECT *, right(name, 1) AS tail FROM points), link AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM q a JOIN q b ON a.city = b.city AND a.tail = b.tail AND a.id <> b.id AND {_AB} <= 40), "
    "reach AS (SELECT id AS node, id AS root FROM points UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.node WHERE reach.root < link.b) SELECT node AS id, min(root) AS root FROM reach GROUP BY node"
)
def exact_merge_components(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("tail", F.substring("name", -1, 1))
    return dedup.same_name_components(p, ["city"], 40.0, "tail")


@query(f"WITH {_CHARS} SELECT city, county, name, count(*) AS n, min(id) AS first_id FROM places GROUP BY city, county, name HAVING count(*) > 1")
def duplicate_name_groups(spark, sf_dir):
    return dedup.duplicate_groups(places(spark, sf_dir), ["city", "county", "name"])


@query(
    f"WITH {_CHARS}, c AS (SELECT DISTINCT city, substr(name, 1, k) AS candidate FROM places, (VALUES (3), (5), (7)) t(k) WHERE length(name) >= k), "
    "m AS (SELECT id, name, arg_max(candidate, (length(candidate), candidate)) AS candidate, count(DISTINCT candidate) AS matches FROM places JOIN c USING (city) WHERE starts_with(name, candidate) AND length(name) - length(candidate) >= 2 GROUP BY id, name) SELECT id, name, candidate, substr(name, length(candidate) + 1) AS remaining, matches FROM m"
)
def longest_prefix_match(spark, sf_dir):
    p = places(spark, sf_dir)
    c = p.select("city", F.explode(F.array(*[F.when(F.length("name") >= k, F.substring("name", 1, k)) for k in (3, 5, 7)])).alias("candidate")).filter("candidate IS NOT NULL").distinct()
    return dedup.longest_prefix(p, c, ["city"])


@query("WITH r AS (SELECT o_orderpriority AS kind, o_orderkey AS run_id, o_orderdate AS created_at FROM orders) SELECT kind, arg_max(run_id, (created_at, run_id)) AS run_id, max(created_at) AS created_at FROM r GROUP BY kind")
def active_run_latest(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return active_runs(o.select(F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at")))


def _region_vectors(spark, sf_dir):
    f = _joined(spark, sf_dir, CITY).groupBy("city").pivot("char", list("aeilnorst")).agg(F.max("frequency")).fillna(0.0)
    return ml.standardised(ml.assembled(f, list("aeilnorst")))


@query()
def region_kmeans(spark, sf_dir):
    labelled, _ = ml.kmeans(_region_vectors(spark, sf_dir), 4, "scaled")
    return rounded(labelled.select("city", "cluster", "distance"))


@query()
def region_pca(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    return ml.projected(_region_vectors(spark, sf_dir), 2).select("city", vector_to_array("pca").alias("pca"))


@query()
def region_gmm(spark, sf_dir):
    return rounded(ml.gaussian_mixture(ml.projected(_region_vectors(spark, sf_dir), 2), 2, "pca").select("city", "cluster", "top_probability", "entropy"))


@query()
def char_word2vec(spark, sf_dir):
    p = places(spark, sf_dir).withColumn("chars", F.array_distinct(F.filter(text.characters(F.col("name")), lambda c: c != " ")))
    return ml.character_embeddings(p, "chars", 16, 3, 1, 2)


@query(
    "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL"
)
def event_tendency_counts(spark, sf_dir):
    """The batch form of the streaming counts, per day."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


