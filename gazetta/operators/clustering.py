"""Clusterings composed for regions, places and subsets of places."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazetta.functions import text
from gazetta.operators import frequency, ml, regions
from gazetta.sources.schema import Hierarchy

#: Rows that the small-table methods (linkage, density hierarchies) take in one task.
MOST_ROWS = 5000


def tendency_features(tendency: DataFrame, keys: list[str], item: str, metric: str, n: int) -> tuple[DataFrame, list[str]]:
    """Region x item values of the n strongest items of any region, 0 where a region lacks one."""
    best = frequency.top_per_region(tendency, keys, [F.desc(metric), F.asc(item)], n)
    names = [r[0] for r in best.select(item).distinct().orderBy(item).collect()]  # items of the lexicon or alphabet
    wide = tendency.filter(F.col(item).isin(*names)).groupBy(F.concat_ws("/", *keys).alias("region")).pivot(item, names).agg(F.first(metric)).fillna(0.0)
    return wide, names


def village_features(places: DataFrame, keywords: list[str], suffixes: int = 50, name: str = "name") -> tuple[DataFrame, list[str]]:
    """Length, keyword flags and the commonest endings as 0/1 columns."""
    ends = places.groupBy(text.suffix(F.col(name), 1).alias("s")).agg(F.count(F.lit(1)).alias("n")).filter("s IS NOT NULL")
    common = [r["s"] for r in ends.orderBy(F.desc("n"), "s").limit(suffixes).collect()]
    flags = {f"kw_{i}": F.col(name).contains(k).cast("double") for i, k in enumerate(keywords)}
    ones = {f"end_{i}": F.coalesce((text.suffix(F.col(name), 1) == s).cast("double"), F.lit(0.0)) for i, s in enumerate(common)}
    out = places.withColumns({"f_length": F.length(name).cast("double"), **flags, **ones})
    return out, ["f_length", *flags, *ones]


def clustered(df: DataFrame, columns: list[str], k: int, method: str = "kmeans", components: int | None = None, seed: int = 42) -> tuple[DataFrame, dict]:
    """Scaled (and projected) columns clustered; the table with `cluster`, and its quality."""
    v = ml.standardised(ml.assembled(df, columns))
    if components:
        v = ml.projected(v, components).withColumn("scaled", F.col("pca"))
    if method == "kmeans":
        out, _ = ml.kmeans(v, k, "scaled", seed)
    elif method == "gmm":
        out = ml.gaussian_mixture(v, k, "scaled", seed)
    elif method == "bisecting":
        out = ml.bisecting(v, k, "scaled", seed)
    else:
        raise ValueError(f"no method {method}")
    return out, ml.quality(out, "scaled")


def nested(places: DataFrame, hierarchy: Hierarchy, features: list[str], k: int) -> dict[str, DataFrame]:
    """One clustering per level over the means of its regions, keyed by level; a
    region's key holds its parents, which makes the tree."""
    out = {}
    for level in hierarchy.levels:
        keys = hierarchy.key(level)
        means = places.groupBy(*keys).agg(*[F.avg(f).alias(f) for f in features])
        out[level] = clustered(means, features, k)[0].select(*keys, "cluster")
    return out


def sample(df: DataFrame, how: str, rows: int, id_col: str, stratum: str | None = None, seed: int = 42, cells: int = 50) -> DataFrame:
    """A seeded sample of places: 'random', 'stratified' by a column, or 'spatial' over a grid of cells."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))
    if how == "random":
        return df.orderBy(order, id_col).limit(rows)
    total = max(1, df.count())
    if how == "stratified":
        return regions.stratified_sample(df, stratum, min(1.0, rows / total), id_col, seed)
    ends = df.agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))

    def at(v: str, low: str, high: str):
        return F.least(F.floor((F.col(v) - F.col(low)) / F.nullif(F.col(high) - F.col(low), F.lit(0.0)) * cells), F.lit(cells - 1))

    gridded = df.join(F.broadcast(ends)).withColumn("__cell", F.coalesce(at("lon", "x0", "x1"), F.lit(0)) * cells + F.coalesce(at("lat", "y0", "y1"), F.lit(0)))  # a single row
    used = gridded.select("__cell").distinct().count()
    rank = F.row_number().over(Window.partitionBy("__cell").orderBy(order, id_col))
    quota = max(1, -(-rows // max(1, used)))
    return gridded.withColumn("__r", rank).filter(F.col("__r") <= quota).drop("__r", "__cell", "x0", "x1", "y0", "y1")


def _bounded(df: DataFrame) -> int:
    n = df.limit(MOST_ROWS + 1).count()
    if n > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows: use k-means or dbscan")
    return n


def _merges(x: np.ndarray) -> list[tuple[int, int, float]]:
    """Ward's merges (cluster, cluster, height); new clusters are numbered from len(x)."""
    n = len(x)
    centre = {i: x[i] for i in range(n)}
    size = dict.fromkeys(range(n), 1)
    out = []
    for new in range(n, 2 * n - 1):
        ids = np.array([*centre])
        points, weights = np.stack([centre[i] for i in ids]), np.array([size[i] for i in ids], float)
        gaps = ((points[:, None] - points[None]) ** 2).sum(-1) * 2 * weights[:, None] * weights[None] / (weights[:, None] + weights[None])
        gaps[np.tril_indices(len(ids))] = np.inf
        a, b = divmod(int(gaps.argmin()), len(ids))
        i, j = int(ids[a]), int(ids[b])
        out.append((i, j, float(gaps[a, b] ** 0.5)))
        centre[new] = (centre[i] * size[i] + centre[j] * size[j]) / (size[i] + size[j])
        size[new] = size.pop(i) + size.pop(j)
        del centre[i], centre[j]
    return out


def ward_labels(x: np.ndarray, k: int) -> np.ndarray:
    """Cuts Ward's tree at k clusters, numbered by their first row."""
    n = len(x)
    groups = {i: [i] for i in range(n)}
    for new, (i, j, _) in enumerate(_merges(x)[: max(0, n - k)], n):
        groups[new] = groups.pop(i) + groups.pop(j)
    labels = np.empty(n, int)
    for number, members in enumerate(sorted(groups.values(), key=min)):
        labels[members] = number
    return labels


def hdbscan_labels(x: np.ndarray, least_size: int = 10, least_points: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Density clusters by excess of mass over mutual-reachability distances: (labels, probabilities), -1 for noise."""
    n = len(x)
    labels, probability = np.full(n, -1), np.zeros(n)
    if n < max(2, least_size):
        return labels, probability
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(gaps, axis=1)[:, min(least_points, n) - 1]
    reach = np.maximum(gaps, np.maximum(core[:, None], core[None]))
    best, source, left = reach[0].copy(), np.zeros(n, int), np.ones(n, bool)
    left[0] = False
    tree = []
    for _ in range(n - 1):  # minimum spanning tree
        v = int(np.where(left, best, np.inf).argmin())
        tree.append((float(best[v]), int(source[v]), v))
        left[v] = False
        closer = left & (reach[v] < best)
        best[closer], source[closer] = reach[v][closer], v
    node, up, members, height = n, [*range(2 * n - 1)], {i: [i] for i in range(n)}, {}
    sons: dict[int, tuple[int, int]] = {}

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for d, a, b in sorted(tree):
        ra, rb = top(a), top(b)
        up[ra] = up[rb] = node
        members[node], height[node], sons[node] = members[ra] + members[rb], d, (ra, rb)
        node += 1
    # condense: a split counts where both sides have least_size members; otherwise members fall out
    chosen: dict[int, list[int]] = {}
    stability, born, split, left_at = {}, {}, {}, {}
    todo = [(2 * n - 2, 0.0, 2 * n - 2)]
    while todo:
        i, birth, cluster = todo.pop()
        born.setdefault(cluster, birth)
        stability.setdefault(cluster, 0.0)
        if i < n:
            continue
        level = 1 / max(height[i], 1e-12)
        big = [s for s in sons[i] if len(members[s]) >= least_size]
        if len(big) == 2:
            stability[cluster] += (level - born[cluster]) * len(members[i])
            split[cluster] = big
            for m in members[i]:
                left_at[cluster, m] = level
            todo += [(s, level, s) for s in big]
        else:
            for s in sons[i]:
                if s in big:
                    todo.append((s, birth, cluster))
                else:
                    stability[cluster] += (level - born[cluster]) * len(members[s])
                    for m in members[s]:
                        left_at[cluster, m] = level
    value = dict(stability)
    for c in sorted(stability):  # children have smaller numbers than parents
        if c in split:
            inner = sum(value[s] for s in split[c])
            if inner > stability[c] or c == 2 * n - 2:
                value[c] = inner
                chosen[c] = [x_ for s in split[c] for x_ in chosen.get(s, [s])]
                continue
        chosen[c] = [c]
    picks = chosen.get(2 * n - 2, [])
    if picks == [2 * n - 2]:
        picks = []
    for number, c in enumerate(sorted(picks, key=lambda c: min(members[c]))):
        inside = np.array(members[c])
        level = np.array([left_at.get((c, m), 0.0) for m in members[c]])
        labels[inside], probability[inside] = number, np.minimum(level / max(level.max(), 1e-12), 1.0)
    return labels, probability


def small(df: DataFrame, id_col: str, columns: list[str], method: str, **options) -> DataFrame:
    """id, cluster, probability by 'ward' (k) or 'hdbscan' (least_size, least_points), in one
    task behind a check of the table's size."""
    _bounded(df)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat([*frames]).sort_values(id_col)
        x = whole[columns].to_numpy(float)
        if method == "ward":
            labels, probability = ward_labels(x, options["k"]), np.ones(len(x))
        else:
            labels, probability = hdbscan_labels(x, **options)
        yield pd.DataFrame({id_col: whole[id_col], "cluster": labels, "probability": probability})

    return df.select(id_col, *columns).repartition(1).mapInPandas(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, cluster long, probability double")


