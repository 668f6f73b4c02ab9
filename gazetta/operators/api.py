"""The read side: guarded, filtered, paged queries over result tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



class Rejected(ValueError):
    """A query that the policy doesn't allow."""


@dataclass(frozen=True)
class Policy:
    default_rows: int = 100
    most_rows: int = 1000
    absolute_rows: int = 10_000
    allow_scan: bool = False
    allow_clustering: bool = False

    def check(self, filters: dict, limit: int | None = None, clustering: bool = False) -> None:
        if not self.allow_scan and not any(v is not None for v in filters.values()):
            raise Rejected("a filter is needed")
        if limit is not None and limit > 10 * self.absolute_rows:
            raise Rejected(f"{limit} rows are too many")
        if clustering and not self.allow_clustering:
            raise Rejected("clustering at query time is switched off")

    def rows(self, limit: int | None) -> int:
        return min(limit or self.default_rows, self.most_rows)

    def page(self, page: int = 1, size: int = 100, most: int = 500) -> tuple[int, int]:
        """(limit, offset)"""
        size = max(1, min(size, most))
        return size, (max(1, page) - 1) * size


def guarded(policy: Policy, query: Callable[..., DataFrame], limit: int | None = None, **filters) -> DataFrame:
    policy.check(filters, limit)
    return query(**filters).limit(policy.rows(limit))


def paged(df: DataFrame, order: list, page: int = 1, size: int = 100, most: int = 500) -> dict:
    """One page (a DataFrame), the number of all rows, and whether more follow."""
    limit, offset = Policy().page(page, size, most)
    total = df.count()
    return {"rows": df.orderBy(*order).offset(offset).limit(limit), "total": total, "page": max(1, page), "has_next": offset + limit < total}


def where(df: DataFrame, **equal) -> DataFrame:
    """Equality for each value that isn't None; a list means any of them; an empty
    string also meets null, as for towns that have no county."""
    for column, value in equal.items():
        if value is None:
            continue
        if isinstance(value, (list, tuple, set)):
            df = df.filter(F.col(column).isin(*value))
        elif value == "":
            df = df.filter(F.col(column).isNull() | (F.col(column) == ""))
        else:
            df = df.filter(F.col(column) == value)
    return df


def search(places: DataFrame, query: str, name: str = "name", **equal) -> DataFrame:
    """Places whose name contains the query, under equality filters."""
    return where(places, **equal).filter(F.contains(name, F.lit(query)))


@dataclass(frozen=True)
class Subset:
    """A description of a set of places; unset parts don't limit it."""

    contains: str | None = None
    starts: str | None = None
    ends: str | None = None
    equals: str | None = None
    length: tuple[int | None, int | None] = (None, None)
    any_tags: tuple[str, ...] = ()
    all_tags: tuple[str, ...] = ()
    character_at: tuple[int, str] | None = None
    structures: tuple[dict[str, int], ...] = ()
    box: tuple[float, float, float, float] | None = None

    def condition(self, name: str = "name") -> Column:
        n, parts = F.col(name), []
        if self.contains is not None:
            parts.append(n.contains(self.contains))
        if self.starts is not None:
            parts.append(n.startswith(self.starts))
        if self.ends is not None:
            parts.append(n.endswith(self.ends))
        if self.equals is not None:
            parts.append(n == self.equals)
        low, high = self.length
        if low is not None:
            parts.append(F.length(n) >= low)
        if high is not None:
            parts.append(F.length(n) <= high)
        if self.any_tags:
            parts.append(F.greatest(*[F.col(t) for t in self.any_tags], F.lit(0)) == 1)
        parts += [F.col(t) == 1 for t in self.all_tags]
        if self.character_at:
            at, char = self.character_at
            parts.append(F.substring(n, at, 1) == char)
        if self.structures:
            either = F.lit(False)
            for s in self.structures:
                both = F.lit(True)
                for column, value in s.items():
                    both = both & (F.col(column).cast("int") == value)
                either = either | both
            parts.append(either)
        if self.box:
            west, east, south, north = self.box
            parts += [F.col("lon").between(west, east), F.col("lat").between(south, north)]
        out = F.lit(True)
        for p in parts:
            out = out & p
        return out


def subset(places: DataFrame, wanted: Subset, name: str = "name") -> DataFrame:
    return places.filter(wanted.condition(name))


def by_ids(places: DataFrame, ids: list, id_col: str = "id") -> DataFrame:
    """Rows with one of the ids, given with or without the prefix of village ids."""
    bare = [str(i).removeprefix("v_") for i in dict.fromkeys(ids)]
    wanted = places.sparkSession.createDataFrame([(b,) for b in bare], "__id string")
    return places.join(wanted, F.regexp_replace(F.col(id_col).cast("string"), "^v_", "") == F.col("__id"), "left_semi")


def top(df: DataFrame, order: list[Column], n: int, **equal) -> DataFrame:
    """The n first rows under equality filters; the limit is the feature."""
    return where(df, **equal).orderBy(*order).limit(n)


def character_score(overall: DataFrame, best: DataFrame, members: list[str]) -> DataFrame:
    """Points for frequent, regionally strong and labelled characters, and their tier."""
    rank = F.when(F.col("rank") <= 10, 10).when(F.col("rank") <= 30, 5).when(F.col("rank") <= 50, 3).otherwise(0)
    strong = F.when(F.col("max_lift") > 10, 10).when(F.col("max_lift") > 5, 7).when(F.col("max_lift") > 2, 5).otherwise(0)
    out = overall.join(best, "char", "left").withColumn("score", (rank + strong + F.when(F.col("char").isin(*members), 3).otherwise(0)).cast("long"))
    return out.withColumn("tier", F.when(F.col("score") >= 15, "high").when(F.col("score") >= 10, "medium").when(F.col("score") >= 5, "low").otherwise("none"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins from the least to the greatest value: bin, low, high, n."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.least(F.floor((F.col(column) - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)).cast("long")
    rows = df.filter(F.col(column).isNotNull()).join(F.broadcast(ends)).withColumn("bin", F.coalesce(bin_, F.lit(0).cast("long")))  # a single row
    return rows.groupBy("bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n")).select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def extreme_regions(tendency: DataFrame, keys: list[str], metric: str) -> DataFrame:
    return tendency.filter("support_flag").groupBy(*keys).agg(F.avg(F.abs(metric)).alias("mean_abs"), F.max(F.abs(metric)).alias("max_abs"), F.count(F.lit(1)).alias("items"))


def long_tags(tagged: DataFrame, columns: list[str]) -> DataFrame:
    """tag, villages: the sum of each tag column."""
    sums = tagged.agg(*[F.sum(c).alias(c) for c in columns])
    return sums.unpivot([], columns, "tag", "villages")


