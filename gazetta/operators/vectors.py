"""Vectors in array columns: cosine neighbours, analogies, coherence of groups.

Dot products are JVM array functions. The query side of a neighbour search is a
stated set, repeated to the blocks of the table; the table itself is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.nullif(n, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def nearest(queries: DataFrame, table: DataFrame, k: int, id_col: str = "id", vector: str = "vector", least: float | None = None, blocks: int | None = None) -> DataFrame:
    """(query, id, similarity, rank): the k most similar rows of each query, itself left out.

    Each block of the table keeps its own k best of a query, so that
    what meets for the final rank is k times the number of blocks. There is a block
    for every 10,000 rows, and eight at least.
    """
    blocks = blocks or max(8, -(-table.count() // 10_000))
    q = queries.select(F.col(id_col).alias("query"), unit(F.col(vector)).alias("__q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__block"))
    t = table.select(F.col(id_col).alias("id"), unit(F.col(vector)).alias("__t"))
    t = t.withColumn("__block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    met = q.join(t, "__block").filter("query <> id").withColumn("similarity", dot(F.col("__q"), F.col("__t"))).drop("__q", "__t")
    if least is not None:
        met = met.filter(F.col("similarity") >= least)
    order = [F.desc("similarity"), F.asc("id")]
    local = F.row_number().over(Window.partitionBy("query", "__block").orderBy(*order))
    best = met.withColumn("__r", local).filter(F.col("__r") <= k)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    return best.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select("query", "id", "similarity", "rank")


def arithmetic(table: DataFrame, plus: list, minus: list, k: int, id_col: str = "id", vector: str = "vector") -> DataFrame:
    """The k rows most similar to the sum of some vectors less others, without those."""
    sign = F.when(F.col(id_col).isin(*plus), F.lit(1.0)).otherwise(F.lit(-1.0))
    parts = table.filter(F.col(id_col).isin(*plus, *minus)).select(F.posexplode(unit(F.col(vector))).alias("i", "v"), sign.alias("s"))
    goal = parts.groupBy("i").agg(F.sum(F.col("v") * F.col("s")).alias("v"))
    goal = goal.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("goal"))  # as long as a vector
    met = table.filter(~F.col(id_col).isin(*plus, *minus)).join(F.broadcast(goal))
    out = met.select(F.col(id_col).alias("id"), cosine(F.col(vector), F.col("goal")).alias("similarity"))
    return out.orderBy(F.desc("similarity"), "id").limit(k)


def analogy(table: DataFrame, a, b, c, k: int, **names) -> DataFrame:
    """What is to c as b is to a."""
    return arithmetic(table, [b, c], [a], k, **names)


def group_means(table: DataFrame, group: str, vector: str = "vector") -> DataFrame:
    """Mean unit vector and size of each group; the mean dot product of all pairs is
    the dot product of such means, so no pairs are formed."""
    parts = table.select(group, F.posexplode(unit(F.col(vector))).alias("i", "v"))
    means = parts.groupBy(group, "i").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("mean"), F.max("n").alias("n"))


def coherence(table: DataFrame, group: str, vector: str = "vector") -> DataFrame:
    """Mean cosine of pairs inside each group, and of pairs with members of other groups."""
    means = group_means(table, group, vector)
    a, b = means.alias("a"), means.alias("b")
    inside = means.select(group, "n", ((F.col("n") * dot(F.col("mean"), F.col("mean")) - 1) / F.nullif((F.col("n") - 1).cast("double"), F.lit(0.0))).alias("intra"))
    across = a.join(b, F.col(f"a.{group}") != F.col(f"b.{group}")).groupBy(F.col(f"a.{group}").alias(group)).agg(
        (F.sum(dot(F.col("a.mean"), F.col("b.mean")) * F.col("b.n")) / F.sum("b.n")).alias("inter")
    )
    return inside.join(across, group, "left")


def outliers(table: DataFrame, group: str, below: float, id_col: str = "id", vector: str = "vector") -> DataFrame:
    """Rows whose mean cosine with the others of their group is under a threshold."""
    means = group_means(table, group, vector)
    rows = table.select(id_col, group, unit(F.col(vector)).alias("u")).join(means, group)
    value = (F.col("n") * dot(F.col("u"), F.col("mean")) - 1) / F.nullif((F.col("n") - 1).cast("double"), F.lit(0.0))
    return rows.select(id_col, group, value.alias("peer_similarity")).filter(F.col("peer_similarity") < below)
