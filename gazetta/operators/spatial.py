"""Neighbourhoods on a grid: radius joins, kNN, density, DBSCAN, hotspots.

Points meet through equal grid cells: one side is repeated to the nine cells
around it, the join is an equi-join on the cell, and only then the distance is
computed. Cells are at least as wide as the radius everywhere up to the largest
latitude of the points, and meet across the 180th meridian. Points of id, lon, lat.
"""

from __future__ import annotations

from math import cos, floor, radians, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazetta.functions import geo, stats
from gazetta.operators import tiles
from gazetta.operators.graph import connected_components
from gazetta.sources.storage import cut

#: One degree of latitude in km, a little less than it is, so that cells are never too narrow.
_DEGREE = 110.5


def cell_sizes(radius_km: float, most_latitude: float) -> tuple[float, float]:
    """Width and height in degrees of cells that hold the radius up to a latitude."""
    height = radius_km / _DEGREE
    return min(360.0, height / max(0.0001, cos(radians(min(90.0, most_latitude + height))))), height


def around_globe(radius_km: float, most_latitude: float) -> tuple[float, float, int]:
    """Width and height of such cells, and how many there are around the globe: three at least, or one."""
    w, h = cell_sizes(radius_km, most_latitude)
    columns = floor(360.0 / w)
    return (360.0 / columns, h, columns) if columns >= 3 else (360.0, h, 1)


def highest(points: DataFrame) -> float:
    """The largest latitude, north or south, of the points."""
    return points.agg(F.max(F.abs("lat"))).first()[0] or 0.0


def neighbours(left: DataFrame, right: DataFrame, radius_km: float, most_latitude: float | None = None, planar: bool = False, on: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, km): points of `right` within the radius of points of `left`, itself included;
    with `on`, only those that agree in these columns.

    Without `most_latitude` the largest latitude is looked up; a smaller one than the points' loses pairs. Distances on a plane don't meet across the 180th meridian.
    """
    w, h, columns = (radius_km / _DEGREE, radius_km / _DEGREE, 0) if planar else around_globe(radius_km, highest(left) if most_latitude is None else most_latitude)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = left.select(F.col("id").alias("a"), F.col("lon").alias("__x"), F.col("lat").alias("__y"), *on, F.explode(around).alias("__d"))

    def column(cell: Column) -> Column:
        return cell if planar else F.pmod(cell, F.lit(columns))

    if columns == 1:
        a = a.filter("__d.i = 0")
    a = a.select("a", "__x", "__y", *on, column(geo.cell(F.col("__x"), w) + F.col("__d.i")).alias("__i"), (geo.cell(F.col("__y"), h) + F.col("__d.j")).alias("__j"))
    b = right.select(F.col("id").alias("b"), *on, F.col("lon").alias("__u"), F.col("lat").alias("__v"), column(geo.cell(F.col("lon"), w)).alias("__i"), geo.cell(F.col("lat"), h).alias("__j"))
    measure = geo.planar_km if planar else geo.haversine_km
    met = a.join(b, ["__i", "__j", *on]).withColumn("km", measure(F.col("__x"), F.col("__y"), F.col("__u"), F.col("__v")))
    return met.filter(F.col("km") <= radius_km).select("a", "b", "km")


def density(points: DataFrame, radii_km: tuple[int, ...] = (1, 5, 10), most_latitude: float | None = None) -> DataFrame:
    """id, density_<r>km: other points within each radius, without a row for each pair.

    Points with the same id are one point in several places, which don't count each other. Points without coordinates have no others.
    """
    most = float(max(radii_km))
    w, h, columns = around_globe(most, highest(points) if most_latitude is None else most_latitude)
    names = [f"density_{r}km" for r in radii_km]
    sums = tiles.pair_sums(points.select("id", "lon", "lat"), tiles.Counts(radii_km), w, h, columns, names)
    own = points.select("id", "lon", "lat").groupBy("id").agg(F.collect_list(F.struct("lon", "lat")).alias("p"))  # one, as ids are keys

    def met(r: int) -> Column:
        return F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + F.size(F.filter("p", lambda y: geo.haversine_km(x["lon"], x["lat"], y["lon"], y["lat"]) <= r)))

    counts = sums.groupBy("id").agg(*[F.sum(n).alias(n) for n in names]).join(own, "id").select("id", *[(F.col(n) - met(r)).alias(n) for n, r in zip(names, radii_km, strict=True)])
    return points.select("id").join(counts, "id", "left").fillna(0)


def starting_radius(points: DataFrame, k: int, most_km: float, box: float = 0.25) -> float:
    """A radius within which a point in a cell of usual density (the median over points) has about 2k others."""
    cells = points.groupBy(geo.cell(F.col("lon"), box), geo.cell(F.col("lat"), box)).agg(F.count(F.lit(1)).alias("n"), F.avg("lat").alias("lat"))
    area = (box * geo.DEGREE_KM) ** 2 * F.greatest(F.cos(F.radians("lat")), F.lit(0.01))
    usual = cells.select(F.percentile(F.col("n") / area, F.lit(0.5), F.col("n")).alias("d")).first()["d"]
    return min(most_km, sqrt(2 * k / (3.141592653589793 * usual))) if usual else most_km


def nearest(points: DataFrame, k: int = 10, start_km: float | None = None, most_latitude: float | None = None, most_km: float = 20_038.0) -> DataFrame:
    """(a, b, km, rank): the k nearest others of each point, ties by id.

    Points that have k others within the radius are done; the rest are looked up
    again with twice the radius, among all points, until none is left or
    the radius spans the globe. The first radius follows from the density, at most `start_km`.
    """
    todo, done = points, None
    total = points.count()
    want = min(k, total - 1)
    most_latitude = highest(points) if most_latitude is None else most_latitude
    radius = min(start_km or most_km, starting_radius(points, k, most_km)) if want > 0 else most_km
    while True:
        near = neighbours(todo, points, radius, most_latitude).filter("a <> b")
        rank = F.row_number().over(Window.partitionBy("a").orderBy("km", "b"))
        ranked = cut(near.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k))
        enough = ranked.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= want).select("a")
        found = ranked.join(enough, "a", "left_semi")
        done = found if done is None else done.unionByName(found)
        todo = cut(todo.join(enough.withColumnRenamed("a", "id"), "id", "left_anti"))
        if want <= 0 or radius >= most_km or todo.isEmpty():
            return done
        radius *= 2


def neighbour_features(points: DataFrame, k: int = 10, start_km: float | None = None, **options) -> DataFrame:
    """id and the distances to the 1st, 5th and k-th neighbour."""
    near = nearest(points, k, start_km, **options)
    wanted = sorted({1, 5, k})
    rows = near.groupBy(F.col("a").alias("id")).agg(*[F.max(F.when(F.col("rank") == r, F.col("km"))).alias(f"nn_distance_{r}") for r in wanted])
    return points.select("id").join(rows, "id", "left")


def isolation_minmax(df: DataFrame, distance: str = "nn_distance_1", dense: str = "density_5km", beyond_km: float = 10.0) -> DataFrame:
    """Mean of the normalised distance and the reversed normalised density."""
    ends = df.agg(*[f(c).alias(f"__{n}_{c}") for c in (distance, dense) for n, f in (("low", F.min), ("high", F.max))])

    def scaled(c: str) -> Column:
        return (F.col(c) - F.col(f"__low_{c}")) / (F.col(f"__high_{c}") - F.col(f"__low_{c}") + 1e-10)

    both = df.join(F.broadcast(ends))  # a single row
    return both.withColumns({"isolation_score": (scaled(distance) + (1 - scaled(dense))) / 2, "is_isolated": F.col(distance) > beyond_km}).drop(*ends.columns)


def isolation_inverse(df: DataFrame, dense: str = "density_1km", below: int = 5) -> DataFrame:
    return df.withColumns({"isolation_score": 1.0 / (F.col(dense) + 1), "is_isolated": F.col(dense) < below})


def regional_aggregates(features: DataFrame, keys: list[str]) -> DataFrame:
    return features.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("village_count"), F.avg("nn_distance_1").alias("avg_nn_distance"), F.avg("density_5km").alias("avg_density"),
        F.avg("isolation_score").alias("avg_isolation"), F.count_if("is_isolated").alias("n_isolated"),
        F.when(F.avg("nn_distance_1") > 0, F.stddev_samp("nn_distance_1") / F.nullif(F.avg("nn_distance_1"), F.lit(0.0))).alias("dispersion"),
    )


def hotspot_coverage(features: DataFrame, hotspots: DataFrame, keys: list[str]) -> DataFrame:
    """Hotspots per place of each region, 0 where there are none."""
    here = features.groupBy(*keys).agg(F.count(F.lit(1)).alias("village_count"))
    hot = hotspots.groupBy(*keys).agg(F.count(F.lit(1)).alias("hotspots"))
    return here.join(hot, keys, "left").fillna({"hotspots": 0}).withColumn("coverage", stats.ratio(F.col("hotspots"), F.col("village_count")))


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """Adds a number from 0 in the order of a distinct key: rows are sorted in ranges, and each range begins where the ones before end."""
    ranged = cut(df.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = ranged.withColumn("__part", part).join(F.broadcast(starts), "__part")  # a row per partition
    return own.withColumn(name, (F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("__id", "__part", "__start")


def dbscan(points: DataFrame, radius_km: float, least: int, most_latitude: float | None = None, planar: bool = False) -> DataFrame:
    """id, cluster: clusters numbered from 0 by their smallest core id, -1 for noise.

    A core has `least` points within the radius, itself included. Clusters are the
    components of cores; a border point belongs to its reachable core with the smallest cluster.

    Points in one cell with a diagonal below the radius are all neighbours: where there are `least`
    of them no pair is formed, and a cell's cores are one node of the graph. Cells are linked by their
    outermost cores; cores meet in full only where two cells that are near enough are still in different components.
    """
    most_latitude = 0.0 if planar else highest(points) if most_latitude is None else most_latitude

    def near(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
        return neighbours(left, right, km, most_latitude, planar)

    size = radius_km / (1.415 * 111.2)  # degrees, a little less than radius / sqrt(2)
    place = F.struct("id", "lon", "lat")
    placed = points.filter("lon IS NOT NULL AND lat IS NOT NULL").select("id", "lon", "lat", geo.cell(F.col("lon"), size).alias("__x"), geo.cell(F.col("lat"), size).alias("__y"))
    placed = cut(placed.join(placed.groupBy("__x", "__y").agg(F.count(F.lit(1)).alias("__n")), ["__x", "__y"]))
    few = placed.filter(F.col("__n") < least)
    others = near(few, placed, radius_km).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    marked = cut(placed.join(others, "id", "left").withColumn("core", (F.col("__n") >= least) | F.col("n").isNotNull()).drop("__n", "n"))
    cores, rest = marked.filter("core"), marked.filter("NOT core")

    lon, lat = F.col("lon"), F.col("lat")
    ends = [end(place, by) for by in (lon, lat, lon + lat, lon - lat) for end in (F.min_by, F.max_by)]
    cells = cut(cores.groupBy("__x", "__y").agg(F.min("id").alias("node"), F.array_distinct(F.array(*ends)).alias("__ends")))
    outer = cells.select("node", F.explode("__ends").alias("e")).select(F.col("node").alias("id"), "e.lon", "e.lat")
    roots = cut(connected_components(cells.select("node"), near(outer, outer, radius_km).select("a", "b")))

    middle = [((F.col(c) + 0.5) * size).alias(n) for c, n in (("__x", "lon"), ("__y", "lat"))]
    middles = cells.join(roots, "node").select(F.struct("node", "root").alias("id"), *middle)
    apart = near(middles, middles, radius_km * 2.001).filter("a.root < b.root").select("a", "b")
    named = cores.join(cells.select("__x", "__y", "node"), ["__x", "__y"])
    left = named.select(F.col("node").alias("u"), lon.alias("lon1"), lat.alias("lat1"))
    right = named.select(F.col("node").alias("v"), lon.alias("lon2"), lat.alias("lat2"))
    measure = geo.planar_km if planar else geo.haversine_km
    met = apart.join(left, F.col("a.node") == F.col("u")).join(right, F.col("b.node") == F.col("v"))
    links = met.filter(measure(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")) <= radius_km).select(F.col("a.root").alias("a"), F.col("b.root").alias("b"))
    joined = connected_components(roots.select(F.col("root").alias("node")).distinct(), links).select(F.col("node").alias("root"), F.col("root").alias("whole"))
    joined = cut(joined)
    numbers = numbered(joined.select("whole").distinct(), "whole", "cluster")
    clusters = roots.join(joined, "root").join(numbers, "whole").select("node", "cluster")
    labelled = cut(named.join(clusters, "node").select("id", "lon", "lat", "cluster"))
    border = near(rest, labelled.select(F.col("cluster").alias("id"), "lon", "lat"), radius_km).groupBy(F.col("a").alias("id")).agg(F.min("b").alias("cluster"))
    out = labelled.select("id", "cluster").unionByName(border)
    return points.select("id").join(out, "id", "left").fillna({"cluster": -1})


def cluster_profiles(points: DataFrame, labels: DataFrame, modes: list[str]) -> DataFrame:
    """Size, centroid, mean planar distance to it and the commonest regions (smallest on ties)."""
    rows = points.join(labels.filter("cluster >= 0"), "id")
    centre = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.avg("lon").alias("centroid_lon"), F.avg("lat").alias("centroid_lat"), *[F.mode(c, True).alias(f"dominant_{c}") for c in modes])
    far = rows.join(centre, "cluster").withColumn("km", geo.planar_km(F.col("lon"), F.col("lat"), F.col("centroid_lon"), F.col("centroid_lat")))
    return far.groupBy("cluster").agg(F.avg("km").alias("avg_distance_km"), F.max("km").alias("radius_km")).join(centre, "cluster")


def kde(points: DataFrame, bandwidth_km: float, reach: float = 4.0, most_latitude: float | None = None) -> DataFrame:
    """id, density_score: a Gaussian kernel in degrees, cut off at `reach` bandwidths.

    `most_latitude` changes nothing, as distances are planar; points without coordinates have no row.
    """
    h = bandwidth_km / geo.DEGREE_KM
    side = bandwidth_km * reach / _DEGREE
    sums = tiles.pair_sums(points.select("id", "lon", "lat"), tiles.Gaussian(bandwidth_km, bandwidth_km * reach), side, side, 0, ["__sum"])
    n = points.count()
    return sums.groupBy("id").agg((F.sum("__sum") / (2 * 3.141592653589793 * h * h * max(1, n))).alias("density_score"))


def hotspots(points: DataFrame, bandwidth_km: float = 5.0, percentile: float = 90.0, eps_km: float = 1.1, least: int = 5, modes: list[str] | None = None, most_latitude: float | None = None) -> DataFrame:
    """Clusters of the points at or above a percentile of the kernel density."""
    scored = cut(points.join(kde(points, bandwidth_km, most_latitude=most_latitude), "id"))
    floor = scored.agg(F.percentile("density_score", percentile / 100).alias("floor"))
    high = cut(scored.join(F.broadcast(floor), scored["density_score"] >= F.col("floor")).drop("floor"))  # a single row
    labels = dbscan(high.select("id", "lon", "lat"), eps_km, least, most_latitude, planar=True)
    out = cluster_profiles(high, labels, modes or [])
    dense = high.join(labels.filter("cluster >= 0"), "id").groupBy("cluster").agg(F.avg("density_score").alias("mean_density"))
    out = out.join(dense, "cluster")
    full = _counts_within(out.select(F.col("cluster").alias("id"), F.col("centroid_lon").alias("lon"), F.col("centroid_lat").alias("lat"), "radius_km"), points)
    return out.join(full.withColumnRenamed("id", "cluster"), "cluster", "left").fillna({"village_count": 0})


def naming_hotspots(points: DataFrame, tags: list[str], least_points: int = 10, **options) -> DataFrame:
    """Hotspots of the places with each 0/1 tag column, by tag; tags with fewer places have none."""
    out = None
    for tag in tags:  # a lexicon's categories
        here = points.filter(F.col(tag) == 1)
        if here.limit(least_points).count() == least_points:
            found = hotspots(here, **options).withColumn("tag", F.lit(tag))
            out = found if out is None else out.unionByName(found)
    return hotspots(points.limit(0), **options).withColumn("tag", F.lit("")) if out is None else out


def _counts_within(centres: DataFrame, points: DataFrame, box: float = 0.25) -> DataFrame:
    """Points inside each centre's own radius, through the cells that its box covers."""
    reach = F.col("radius_km") / geo.DEGREE_KM + 1e-9
    cells = centres.withColumn("__i", F.explode(F.sequence(geo.cell(F.col("lon") - reach, box), geo.cell(F.col("lon") + reach, box))))
    cells = cells.withColumn("__j", F.explode(F.sequence(geo.cell(F.col("lat") - reach, box), geo.cell(F.col("lat") + reach, box))))
    b = points.select(F.col("lon").alias("__u"), F.col("lat").alias("__v"), geo.cell(F.col("lon"), box).alias("__i"), geo.cell(F.col("lat"), box).alias("__j"))
    met = cells.join(b, ["__i", "__j"]).filter(geo.planar_km(F.col("lon"), F.col("lat"), F.col("__u"), F.col("__v")) <= F.col("radius_km") + 1e-9)
    return met.groupBy("id").agg(F.count(F.lit(1)).alias("village_count"))


def counts_in_radius(centres: DataFrame, points: DataFrame, radii_km: tuple[float, ...], planar: bool = False, most_latitude: float | None = None) -> DataFrame:
    """id, within_<r>km for fixed radii."""
    near = neighbours(centres, points, float(max(radii_km)), most_latitude, planar)
    counts = near.groupBy(F.col("a").alias("id")).agg(*[F.count_if(F.col("km") <= r).alias(f"within_{r:g}km") for r in radii_km])
    return centres.select("id").join(counts, "id", "left").fillna(0)


def integration(points: DataFrame, labels: DataFrame, items: Column, item: str = "char", least: int = 1) -> DataFrame:
    """Per item and cluster: its places, their share against the whole table's and
    how close together they lie."""
    rows = points.join(labels, "id")
    sizes = rows.filter("cluster >= 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"))
    everything = rows.agg(F.count(F.lit(1)).alias("total"))
    long = rows.select("cluster", "lon", "lat", F.explode(items).alias(item))
    overall = long.groupBy(item).agg(F.count(F.lit(1)).alias("n_all"))
    centre = long.filter("cluster >= 0").groupBy(item, "cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("lon").alias("cx"), F.avg("lat").alias("cy")).filter(F.col("n") >= least)
    away = long.join(centre, [item, "cluster"]).withColumn("d", F.sqrt((F.col("lon") - F.col("cx")) ** 2 + (F.col("lat") - F.col("cy")) ** 2))
    spread = away.groupBy(item, "cluster").agg(F.max("n").alias("n"), F.max("cx").alias("centroid_lon"), F.max("cy").alias("centroid_lat"), F.stddev_pop("d").alias("s"))
    out = spread.join(sizes, "cluster").join(overall, item).join(F.broadcast(everything))  # a single row
    local = stats.ratio(F.col("n"), F.col("cluster_size"))
    return out.select(
        item, "cluster", "n", "cluster_size", "centroid_lon", "centroid_lat", local.alias("local_share"),
        stats.ratio(local, stats.ratio(F.col("n_all"), F.col("total"))).alias("specificity"),
        F.when(F.col("n") < 2, F.lit(1.0)).otherwise(1 / (1 + F.col("s"))).alias("coherence"),
    )
