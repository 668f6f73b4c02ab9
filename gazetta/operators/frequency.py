"""Document frequency of characters, affixes and n-grams, by region and overall,
with the tendency and significance of each region's use.

Counts are integers summed by partial aggregation; totals join as broadcast
candidates that Catalyst sizes itself; rates are divided last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazetta.functions import stats, text
from gazetta.sources.schema import Hierarchy


def exploded(places: DataFrame, items: Column, name: str, keys: list[str]) -> DataFrame:
    """One row per item of each place, with the region's key; rows without a whole key go."""
    out = places.select(*keys, F.explode(items).alias(name))
    return out.dropna(subset=keys) if keys else out


def global_frequency(places: DataFrame, items: Column, item: str = "char") -> DataFrame:
    """item, village_count, total_villages, frequency, rank.

    `items` holds each item once per place for document frequency; the
    total counts the places, also those without items. Ties in rank go by item.
    """
    counts = exploded(places, items, item, []).groupBy(item).agg(F.count(F.lit(1)).alias("village_count"))
    total = places.agg(F.count(F.lit(1)).alias("total_villages"))
    out = counts.join(F.broadcast(total), how="inner")  # a single row
    out = out.withColumn("frequency", stats.ratio(F.col("village_count"), F.col("total_villages")))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("village_count"), item)).cast("long"))


def regional_frequency(places: DataFrame, items: Column, keys: list[str], item: str = "char") -> DataFrame:
    """The same per region (all columns of its key), with a dense rank."""
    counts = exploded(places, items, item, keys).groupBy(*keys, item).agg(F.count(F.lit(1)).alias("village_count"))
    totals = places.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("total_villages"))
    out = counts.join(totals, keys).withColumn("frequency", stats.ratio(F.col("village_count"), F.col("total_villages")))
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc("frequency")))
    return out.withColumn("rank_within_region", rank.cast("long"))


def with_global(regional: DataFrame, overall: DataFrame, item: str = "char") -> DataFrame:
    """Adds global_count, global_total, global_frequency and lift; zeros where the
    corpus-wide table lacks the item."""
    g = overall.select(item, F.col("village_count").alias("global_count"), F.col("total_villages").alias("global_total"), F.col("frequency").alias("global_frequency"))
    out = regional.join(g, item, "left").fillna({"global_count": 0, "global_frequency": 0.0})
    return out.withColumn("lift", stats.lift(F.col("frequency"), F.col("global_frequency")))


def tendency(joined: DataFrame, keys: list[str], least_all: int = 20, least_here: int = 5, by: str = "lift", item: str = "char") -> DataFrame:
    """Adds log_lift, log_odds, z_score, support_flag and the two dense ranks of `by`."""
    p, q = F.col("frequency"), F.col("global_frequency")
    n, total = F.col("village_count"), F.col("total_villages")
    out = joined.withColumns(
        {
            "log_lift": stats.log_lift(p, q),
            "log_odds": stats.log_odds(p, q),
            "z_score": stats.z_binomial(n, total, q),
            "support_flag": stats.support(F.col("global_count"), n, least_all, least_here),
        }
    )
    within = Window.partitionBy(*keys)
    return out.withColumns(
        {
            "rank_overrepresented": F.dense_rank().over(within.orderBy(F.col(by).desc_nulls_last())).cast("long"),
            "rank_underrepresented": F.dense_rank().over(within.orderBy(F.col(by).asc_nulls_last())).cast("long"),
        }
    )


def significance(joined: DataFrame, level: float = 0.95) -> DataFrame:
    """Adds the contingency test and the interval of the regional rate."""
    n, total, g, everything = (F.col(c) for c in ("village_count", "total_villages", "global_count", "global_total"))
    out = joined.withColumn("chi2", stats.chi2_yates(n, total, g, everything))
    v = stats.cramers_v(F.col("chi2"), everything)
    low, high = stats.wilson(n, total, level)
    return out.withColumns(
        {
            "p_value": stats.p_value(F.col("chi2")),
            "significance": stats.stars(F.col("chi2")),
            "cramers_v": v,
            "effect": stats.effect_size(v),
            "ci_lower": low,
            "ci_upper": high,
        }
    )


def goodness_of_fit(joined: DataFrame) -> DataFrame:
    """Adds the one-sample test against the corpus-wide rate."""
    out = joined.withColumn("chi2", stats.chi2_fit(F.col("village_count"), F.col("total_villages"), F.col("global_frequency")))
    v = stats.cramers_v(F.col("chi2"), F.col("total_villages"))
    return out.withColumns({"p_value": stats.p_value(F.col("chi2")), "is_significant": F.col("chi2") > stats.CRITICAL[0], "effect_size": v, "effect": stats.effect_size_fit(v)})


def all_levels(places: DataFrame, items: Column, hierarchy: Hierarchy, item: str = "char") -> DataFrame:
    """Frequencies of every level in one table, from one pass of grouping sets; the
    columns below a row's level are null."""
    keys = [*hierarchy.levels]
    sets = [keys[: i + 1] for i in range(len(keys))]
    rows = exploded(places, items, item, keys)
    counts = rows.groupingSets([[*s, item] for s in sets], *keys, item).agg(F.grouping_id().alias("__g"), F.count(F.lit(1)).alias("village_count"))
    totals = places.dropna(subset=keys).groupingSets(sets, *keys).agg(F.grouping_id().alias("__t"), F.count(F.lit(1)).alias("total_villages"))
    depth = {sum(1 << (len(keys) - 1 - j) for j in range(i + 1, len(keys))): keys[i] for i in range(len(keys))}
    naming = F.create_map(*[F.lit(x) for g, k in depth.items() for x in (g, k)])
    a = counts.withColumn("region_level", F.element_at(naming, F.shiftright("__g", 1).cast("int"))).drop("__g")
    b = totals.withColumn("region_level", F.element_at(naming, F.col("__t").cast("int"))).drop("__t")
    b = b.select(F.col("region_level").alias("__level"), *[F.col(k).alias(f"__{k}") for k in keys], "total_villages")
    match = (F.col("region_level") == F.col("__level")) & _all([F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    out = a.join(b, match).drop("__level", *[f"__{k}" for k in keys])
    return out.withColumn("frequency", stats.ratio(F.col("village_count"), F.col("total_villages")))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def top_per_region(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) if keys else F.row_number().over(Window.orderBy(*order))
    return df.withColumn("position", rank.cast("long")).filter(F.col("position") <= n)


def polarised(df: DataFrame, metric: str, n: int, tie: list[str]) -> DataFrame:
    """The n supported rows with the largest absolute metric."""
    return df.filter("support_flag").orderBy(F.abs(F.col(metric)).desc(), *tie).limit(n)


def affix(places: DataFrame, kind: str, n: int, name: str = "name") -> DataFrame:
    """Places that have the affix, with it as a one-item array for the functions above."""
    value = (text.suffix if kind == "suffix" else text.prefix)(F.col(name), n)
    return places.withColumn("pattern", value).filter(F.col("pattern").isNotNull())


def morphology(places: DataFrame, name: str = "name", suffixes=(1, 2, 3), prefixes=(2, 3)) -> DataFrame:
    return places.withColumns({**{f"suffix_{n}": text.suffix(F.col(name), n) for n in suffixes}, **{f"prefix_{n}": text.prefix(F.col(name), n) for n in prefixes}})
