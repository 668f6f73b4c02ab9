"""Region tables: roll-ups, profiles, comparison, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazetta.functions import stats
from gazetta.sources.schema import Hierarchy


def rollup(df: DataFrame, hierarchy: Hierarchy, *aggregates: Column) -> DataFrame:
    """One pass over all levels; `region_level` names the level and the
    columns below it are null."""
    keys = [*hierarchy.levels]
    sets = [keys[: i + 1] for i in range(len(keys))]
    out = df.dropna(subset=keys).groupingSets(sets, *keys).agg(F.grouping_id().alias("__g"), *aggregates)
    names = [F.lit(x) for i, k in enumerate(keys) for x in (sum(1 << (len(keys) - 1 - j) for j in range(i + 1, len(keys))), k)]
    return out.withColumn("region_level", F.element_at(F.create_map(*names), F.col("__g").cast("int"))).drop("__g")


def overview(places: DataFrame, hierarchy: Hierarchy, chars: Column) -> DataFrame:
    """Places, regions per level and different characters of the whole table."""
    counts = places.agg(F.count(F.lit(1)).alias("villages"), *[F.countDistinct(F.struct(*hierarchy.key(k))).alias(f"n_{k}") for k in hierarchy.levels])
    distinct = places.select(F.explode(chars).alias("c")).agg(F.countDistinct("c").alias("n_chars"))
    return counts.join(F.broadcast(distinct))  # single rows


def top_values(df: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """The n most frequent values of each region as an array of (value, count)."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), value))
    best = counts.withColumn("__r", rank).filter(F.col("__r") <= n)
    lists = F.transform(F.array_sort(F.collect_list(F.struct("__r", F.col(value).alias("value"), "n"))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n")))
    return best.groupBy(*keys).agg(lists.alias(f"top_{value}"))


def feature_z(df: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """Each column's z across regions, with at least three values and some spread."""
    whole = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("spread", F.stddev_samp), ("n", F.count))])
    out = {}
    for c in columns:
        mean, spread, n = (F.col(f"__{x}_{c}") for x in ("mean", "spread", "n"))
        out[f"{c}_z"] = F.when((n >= 3) & (spread > 0), F.round((F.col(c) - mean) / F.nullif(spread, F.lit(0.0)), digits))
    return df.join(F.broadcast(whole)).withColumns(out).drop(*whole.columns)  # a single row


def compare_groups(df: DataFrame, group: Column, flags: list[str]) -> DataFrame:
    """Shares of 0/1 columns in two groups (group true and false) with the test of their difference."""
    long = df.select(group.alias("g"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("long").alias("v")) for c in flags])).alias("f"))
    a, b = F.col("g"), ~F.col("g")
    out = long.groupBy("f.feature").agg(F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"), F.sum(F.when(a, F.col("f.v")).otherwise(0)).alias("k_a"), F.sum(F.when(b, F.col("f.v")).otherwise(0)).alias("k_b"))
    chi2 = stats.chi2_yates(F.col("k_a"), F.col("n_a"), F.col("k_a") + F.col("k_b"), F.col("n_a") + F.col("n_b"))
    out = out.withColumns({"share_a": stats.ratio(F.col("k_a"), F.col("n_a")), "share_b": stats.ratio(F.col("k_b"), F.col("n_b")), "chi2": chi2})
    return out.withColumns({"difference": F.col("share_a") - F.col("share_b"), "is_significant": F.col("chi2") > stats.CRITICAL[0]})


def similarity(long: DataFrame, region: str, feature: str, value: str, extreme: Column | None = None) -> DataFrame:
    """Cosine, Euclidean distance and (with `extreme`, a flag of rows) Jaccard of
    all pairs of regions that share a feature.

    Works on the sparse long form: the join is on the feature, so zeros cost
    nothing. Pairs without a common feature have cosine 0 and aren't listed.
    """
    rows = long.select(region, feature, F.col(value).cast("double").alias("v"), (extreme if extreme is not None else F.lit(False)).alias("x"))
    own = rows.groupBy(region).agg(F.sum(F.col("v") * F.col("v")).alias("q"), F.count_if("x").alias("m"))
    a, b = rows.alias("a"), rows.alias("b")
    dots = (
        a.join(b, (F.col(f"a.{feature}") == F.col(f"b.{feature}")) & (F.col(f"a.{region}") < F.col(f"b.{region}")))
        .groupBy(F.col(f"a.{region}").alias("region_1"), F.col(f"b.{region}").alias("region_2"))
        .agg(F.sum(F.col("a.v") * F.col("b.v")).alias("dot"), F.count_if(F.col("a.x") & F.col("b.x")).alias("common"))
    )
    for i in ("1", "2"):
        dots = dots.join(own.select(F.col(region).alias(f"region_{i}"), F.col("q").alias(f"q{i}"), F.col("m").alias(f"m{i}")), f"region_{i}")
    union = F.col("m1") + F.col("m2") - F.col("common")
    return dots.select(
        "region_1", "region_2",
        (F.col("dot") / F.nullif(F.sqrt("q1") * F.sqrt("q2"), F.lit(0.0))).alias("cosine"),
        F.sqrt(F.greatest(F.col("q1") + F.col("q2") - 2 * F.col("dot"), F.lit(0.0))).alias("euclidean"),
        F.coalesce(stats.ratio(F.col("common"), union), F.lit(0.0)).alias("jaccard"),
    )


def distinctive(df: DataFrame, keys: list[str], item: str, k: int = 10, least_z: float = 2.0) -> DataFrame:
    """Each region's items with the largest z, as an ordered array."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("z_score"), item))
    best = df.filter(F.col("z_score") >= least_z).withColumn("__r", rank).filter(F.col("__r") <= k)
    return best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", item))), lambda x: x[item]).alias("distinctive"))


def full_outer(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Feature tables side by side, with 0 where one lacks a region."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, keys, "full_outer")
    return out.fillna(0)


def stratified_sample(df: DataFrame, stratum: str, share: float, id_col: str, seed: int = 42) -> DataFrame:
    """A share of each stratum, at least one row, chosen by a seeded digest of the id.

    Rows are counted by the digest's first four digits, which gives the buckets to take whole and the
    one to take in part; so only rows of one bucket are ranked together, however large the stratum.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))
    rows = df.withColumn("__o", digest).withColumn("__b", F.substring("__o", 1, 4))
    sizes = rows.groupBy(F.col(stratum).alias("__s"), F.col("__b").alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("__s")  # at most 65,536 rows each
    quota = F.greatest(F.lit(1), F.floor(F.sum("__n").over(w) * share))
    before = F.sum("__n").over(w.orderBy("__k")) - F.col("__n")
    takes = sizes.withColumn("__take", quota - before).filter("__take > 0").drop("__n")
    kept = rows.join(takes, F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("__b") == F.col("__k")))
    rank = F.row_number().over(Window.partitionBy("__s", "__k").orderBy("__o", id_col))
    return kept.withColumn("__r", rank).filter("__r <= __take").select(*df.columns)


def benjamini_hochberg(df: DataFrame, p: str, tie: list[str], keys: list[str] | None = None) -> DataFrame:
    """Adds q_value: p-values adjusted for the false discovery rate, per group of keys."""
    whole = Window.partitionBy(*(keys or []))
    rank = F.row_number().over(whole.orderBy(p, *tie))
    ranked = df.withColumn("__r", rank).withColumn("__raw", F.col(p) * F.count(F.lit(1)).over(whole) / F.col("__r"))
    tail = whole.orderBy("__r").rowsBetween(0, Window.unboundedFollowing)
    return ranked.withColumn("q_value", F.least(F.lit(1.0), F.min("__raw").over(tail))).drop("__r", "__raw")
