"""Positional n-grams: counts, shares, tendency, significance, pruning, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazetta.functions import stats, text


def ngram_rows(places: DataFrame, sizes: tuple[int, ...], keys: list[str], name: str = "name", positions: tuple[str, ...] | None = None) -> DataFrame:
    """n, position, ngram of every place, one row per occurrence."""

    def of(n: int) -> Column:
        return F.transform(text.positional_ngrams(F.col(name), n), lambda x: F.struct(F.lit(n).alias("n"), x["position"].alias("position"), x["ngram"].alias("ngram")))

    found = F.concat(*[of(n) for n in sizes])
    rows = places.select(*keys, F.explode(found).alias("g")).select(*keys, "g.*")
    return rows.filter(F.col("position").isin(*positions)) if positions else rows


def ngram_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per region (or overall without keys), totals and percentages per n and position."""
    if keys:
        rows = rows.dropna(subset=keys)
    counts = rows.groupBy(*keys, "n", "position", "ngram").agg(F.count(F.lit(1)).alias("frequency"))
    whole = Window.partitionBy(*keys, "n", "position")
    out = counts.withColumn("total", F.sum("frequency").over(whole))
    return out.withColumn("percentage", 100 * stats.ratio(F.col("frequency"), F.col("total")))


def distinct_totals(counts: DataFrame, keys: list[str]) -> DataFrame:
    """How many different n-grams each region has per n and position."""
    return counts.groupBy(*keys, "n", "position").agg(F.count(F.lit(1)).alias("distinct_total"))


def ngram_tendency(regional: DataFrame, overall: DataFrame) -> DataFrame:
    """Joins corpus-wide counts to regional ones and adds lift, log-odds and z."""
    g = overall.select("n", "position", "ngram", F.col("frequency").alias("global_count"), F.col("total").alias("global_total"))
    out = regional.withColumnsRenamed({"frequency": "regional_count", "total": "regional_total"}).drop("percentage").join(g, ["n", "position", "ngram"])
    n, total, c, everything = (F.col(x) for x in ("regional_count", "regional_total", "global_count", "global_total"))
    return out.withColumns(
        {"lift": stats.lift(stats.ratio(n, total), stats.ratio(c, everything)), "log_odds": stats.ngram_log_odds(n, total, c, everything), "z_score": stats.z_binomial(n, total, stats.ratio(c, everything))}
    )


def ngram_significance(tendency: DataFrame) -> DataFrame:
    n, total, c, everything = (F.col(x) for x in ("regional_count", "regional_total", "global_count", "global_total"))
    out = tendency.withColumn("chi2", stats.chi2_yates(n, total, c, everything))
    return out.withColumns({"p_value": stats.p_value(F.col("chi2")), "cramers_v": stats.cramers_v(F.col("chi2"), everything), "is_significant": F.col("chi2") > stats.CRITICAL[0]})


def at_least(column: str, by_n: dict[int, int], n: str = "n") -> Column:
    """Per-n thresholds; an n without one is dropped, no thresholds keep all."""
    if not by_n:
        return F.lit(True)
    out = F.lit(False)
    for size, least in by_n.items():
        out = out | ((F.col(n) == size) & (F.col(column) >= least))
    return out


def prune(significant: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Rows of a table that the significant ones have a partner for."""
    match = None
    right = significant.select(*[F.col(c).alias(f"__{c}") for c in on]).distinct()
    for c in on:
        same = F.col(c).eqNullSafe(F.col(f"__{c}"))
        match = same if match is None else match & same
    return table.join(right, match, "left_semi")


def top_share(counts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k most frequent n-grams of each region with their share of all its n-grams."""
    rank = F.row_number().over(Window.partitionBy(*keys, "n", "position").orderBy(F.desc("frequency"), "ngram"))
    return counts.withColumn("position_rank", rank.cast("long")).filter(F.col("position_rank") <= k)


def templates(overall: DataFrame, least: dict[int, int], support: int = 50) -> DataFrame:
    """Open slots before a common ending and after a common beginning.

    An ending or beginning is common if at least `support` different n-grams of that
    size have it; `total` sums the counts and `example` is the rarest n-gram.
    """
    base = overall.filter("position = 'all'").select("n", "ngram", "frequency")
    ends = F.array(
        F.struct(F.lit("suffix").alias("pattern_type"), F.concat(F.lit("X"), F.substring("ngram", -1, 1)).alias("pattern")),
        F.struct(F.lit("prefix").alias("pattern_type"), F.concat(F.substring("ngram", 1, 1), F.lit("X")).alias("pattern")),
        F.struct(F.lit("frame").alias("pattern_type"), F.concat(F.substring("ngram", 1, 1), F.lit("X"), F.substring("ngram", -1, 1)).alias("pattern")),
    )
    rows = base.select("n", "ngram", "frequency", F.explode(ends).alias("p")).select("n", "ngram", "frequency", "p.*").filter("pattern_type <> 'frame' OR n > 2")
    grouped = rows.groupBy("n", "pattern_type", "pattern").agg(
        F.count(F.lit(1)).alias("distinct_ngrams"),
        F.sum(F.when(at_least("frequency", least), F.col("frequency")).otherwise(0)).alias("total"),
        F.min(F.when(at_least("frequency", least), F.struct("frequency", "ngram")))["ngram"].alias("example"),
    )
    return grouped.filter((F.col("distinct_ngrams") >= support) & F.col("example").isNotNull())


def place_ngrams(places: DataFrame, name: str = "name") -> DataFrame:
    """Two- and three-character runs of each name with its first and last ones."""
    two, three = text.ngrams(F.col(name), 2), text.ngrams(F.col(name), 3)
    return places.withColumns({"bigrams": two, "trigrams": three, "prefix_bigram": F.get(two, 0), "suffix_bigram": F.try_element_at(two, F.lit(-1)), "prefix_trigram": F.get(three, 0), "suffix_trigram": F.try_element_at(three, F.lit(-1))})
