"""Scaling, projection, clustering and cluster quality on Spark ML."""

from __future__ import annotations

from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazetta.operators.vectors import euclidean


def assembled(df: DataFrame, columns: list[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=output, handleInvalid="keep").transform(df)


def from_array(df: DataFrame, column: str, output: str = "features") -> DataFrame:
    return df.withColumn(output, array_to_vector(F.col(column)))


def standardised(df: DataFrame, column: str = "features", output: str = "scaled") -> DataFrame:
    """Centred and divided by the population's spread."""
    n = df.count()
    scaled = StandardScaler(withMean=True, withStd=True, inputCol=column, outputCol="__scaled").fit(df).transform(df)
    factor = (n / (n - 1)) ** 0.5 if n > 1 else 1.0
    return scaled.withColumn(output, array_to_vector(F.transform(vector_to_array("__scaled"), lambda x: x * factor))).drop("__scaled")


def projected(df: DataFrame, components: int, column: str = "scaled", output: str = "pca") -> DataFrame:
    """Principal components of a centred column, if it has more dimensions than asked for."""
    size = df.select(F.size(vector_to_array(column)).alias("n")).first()["n"]
    if size <= components:
        return df.withColumn(output, F.col(column))
    return PCA(k=components, inputCol=column, outputCol=output).fit(df).transform(df)


def kmeans(df: DataFrame, k: int, column: str = "features", seed: int = 42, rounds: int = 100):
    """The table with `cluster` and `distance` to its own centre, and the cost."""
    model = KMeans(k=k, featuresCol=column, predictionCol="cluster", seed=seed, maxIter=rounds).fit(df)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])  # k vectors
    out = model.transform(df)
    return out.withColumn("distance", euclidean(vector_to_array(column), F.get(centres, F.col("cluster")))), model.summary.trainingCost


def kmeans_sweep(df: DataFrame, ks: list[int], column: str = "features", seed: int = 42) -> list[dict]:
    """Quality of each k."""
    found = []
    for k in ks:
        labelled, cost = kmeans(df, k, column, seed)
        found.append({"k": k, "inertia": cost, **quality(labelled, column)})
    return found


def best(found: list[dict], metric: str = "silhouette") -> dict:
    """The row with the best metric; low is good for davies_bouldin only."""
    return (min if metric == "davies_bouldin" else max)(found, key=lambda r: r[metric])


def gaussian_mixture(df: DataFrame, k: int, column: str = "features", seed: int = 42) -> DataFrame:
    """cluster, probability (array), top_probability and entropy in bits."""
    model = GaussianMixture(k=k, featuresCol=column, predictionCol="cluster", probabilityCol="__p", seed=seed).fit(df)
    out = model.transform(df).withColumn("probability", vector_to_array("__p")).drop("__p")
    bits = F.aggregate("probability", F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return out.withColumns({"top_probability": F.array_max("probability"), "entropy": bits, "is_uncertain": (F.array_max("probability") < 0.5) | (bits > 2)})


def bisecting(df: DataFrame, k: int, column: str = "features", seed: int = 42) -> DataFrame:
    """A hierarchy from the top, cut at k clusters."""
    return BisectingKMeans(k=k, featuresCol=column, predictionCol="cluster", seed=seed).fit(df).transform(df)


def _moments(df: DataFrame, column: str) -> DataFrame:
    """Long form: cluster, dimension, n, mean, within-cluster sum of squares."""
    long = df.select("cluster", F.posexplode(vector_to_array(column)).alias("i", "v"))
    return long.groupBy("cluster", "i").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), (F.var_pop("v") * F.count(F.lit(1))).alias("ss"))


def quality(df: DataFrame, column: str = "features") -> dict:
    """Silhouette (of centroids), Davies-Bouldin and Calinski-Harabasz; zeros for one cluster.

    The silhouette compares each row's distance to its own centre with that to the nearest
    other centre: linear in the rows, where all pairs would be quadratic.
    """
    means = _moments(df, column).groupBy("cluster").agg(
        F.max("n").alias("n"), F.sum("ss").alias("ss"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centre")
    )
    rows = means.collect()  # one row a cluster
    k, n = len(rows), sum(r["n"] for r in rows)
    if k < 2 or n <= k:
        return {"silhouette": 0.0, "davies_bouldin": 0.0, "calinski_harabasz": 0.0}
    size = len(rows[0]["centre"])
    whole = [sum(r["n"] * r["centre"][i] for r in rows) / n for i in range(size)]
    between = sum(r["n"] * sum((r["centre"][i] - whole[i]) ** 2 for i in range(size)) for r in rows)
    within = sum(r["ss"] for r in rows)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in r["centre"]]) for r in rows])
    number = {r["cluster"]: i for i, r in enumerate(rows)}
    own = F.element_at(F.create_map(*[F.lit(x) for p in number.items() for x in p]), F.col("cluster"))
    far = df.select(own.alias("own"), F.transform(centres, lambda c: euclidean(vector_to_array(column), c)).alias("d"))
    far = far.select("own", F.get("d", F.col("own")).alias("a"), F.array_min(F.filter("d", lambda x, i: i != F.col("own"))).alias("b"))
    scatter = {r["own"]: r["s"] for r in far.groupBy("own").agg(F.avg("a").alias("s")).collect()}  # one row a cluster
    silhouette = far.agg(F.avg((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)))).first()[0]

    def gap(i: int, j: int) -> float:
        return sum((x - y) ** 2 for x, y in zip(rows[i]["centre"], rows[j]["centre"], strict=True)) ** 0.5

    worst = [max((scatter[i] + scatter[j]) / max(gap(i, j), 1e-12) for j in range(k) if j != i) for i in range(k)]
    return {"silhouette": silhouette or 0.0, "davies_bouldin": sum(worst) / k, "calinski_harabasz": (between / (k - 1)) / (within / (n - k)) if within else 0.0}


def distinguishing(df: DataFrame, names: list[str], column: str = "features", top: int = 10) -> DataFrame:
    """Per cluster the features whose mean lies furthest from the table's, in its spread."""
    long = df.select("cluster", F.posexplode(vector_to_array(column)).alias("i", "v"))
    everywhere = long.groupBy("i").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("spread"))
    here = long.groupBy("cluster", "i").agg(F.avg("v").alias("cluster_mean"))
    out = here.join(F.broadcast(everywhere), "i").withColumn("score", (F.col("cluster_mean") - F.col("mean")) / (F.col("spread") + 1e-10))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.abs("score").desc(), "i"))
    labels = F.array(*[F.lit(n) for n in names])
    return out.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select("cluster", F.get(labels, F.col("i")).alias("feature"), "score", "rank")


def representatives(df: DataFrame, id_col: str, top: int = 5) -> DataFrame:
    """The rows nearest to each cluster's centre."""
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("distance", id_col))
    return df.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select("cluster", id_col, "distance", "rank")


def dbscan_advice(clusters: int, noise: int, rows: int) -> str:
    """What to change about a density clustering that came out badly."""
    share = noise / max(1, rows)
    if clusters == 0:
        return "no clusters: raise eps or lower min_samples"
    if share > 0.5:
        return "mostly noise: raise eps"
    if clusters == 1:
        return "one cluster: lower eps"
    if clusters > rows / 5:
        return "very many clusters: raise min_samples"
    return "looks reasonable"


def character_embeddings(sequences: DataFrame, column: str, size: int = 100, window: int = 3, least: int = 1, rounds: int = 15, seed: int = 42) -> DataFrame:
    """word, vector: skip-gram vectors of the tokens in an array column."""
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=least, maxIter=rounds, seed=seed, inputCol=column, outputCol="__v").fit(sequences)
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))
