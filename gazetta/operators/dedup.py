"""Near-duplicate names inside administrative blocks, and merges of equal names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazetta.functions import text
from gazetta.operators.graph import connected_components
from gazetta.operators.spatial import neighbours


def deletions(name: Column) -> Column:
    """The name and all names with one character left out: two names are within one
    edit of each other only if they have one of these in common."""
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name))))
    return F.array_distinct(F.concat(F.array(name), cut))


def block_pairs(places: DataFrame, keys: list[str], condition: Column, name: str = "name", ways: Column | None = None, facts: dict[str, Column] | None = None) -> DataFrame:
    """Pairs a.id < b.id in an administrative block whose names meet a condition on a.name and b.name.

    Only names with one of their `ways` in common meet (an array column of the name; names with
    one character left out by default, which loses no pair within one edit). Different names of a block meet first, once
    however many places have them; the condition and `facts` (further columns of a.name and b.name) are found then,
    and the places with such names follow. No side is broadcast: Spark takes rows for as few as they were before the ways.
    """
    rows = places.select("id", *keys, F.col(name).alias("name")).distinct()
    own = deletions(F.col(name)) if ways is None else ways
    names = places.select(*keys, F.col(name).alias("name"), own.alias("__ways")).distinct()
    met = names.withColumn("__way", F.explode("__ways")).drop("__ways")

    def same(left: str, right: str, columns: list[tuple[str, str]]) -> Column:
        return reduce(lambda x, y: x & y, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{d}")) for c, d in columns])

    block = [(k, k) for k in keys]
    close = met.alias("a").join(met.hint("merge").alias("b"), same("a", "b", [*block, ("__way", "__way")]) & condition)
    more = {} if facts is None else facts
    close = close.groupBy(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b")).agg(*[F.first(c).alias(n) for n, c in more.items()] or [F.lit(0).alias("__one")])
    first = close.alias("n").join(rows.hint("merge").alias("a"), same("n", "a", [*block, ("name_a", "name")])).select("n.*", F.col("a.id").alias("id_a"))
    both = first.alias("n").join(rows.hint("merge").alias("b"), same("n", "b", [*block, ("name_b", "name")]) & (F.col("n.id_a") < F.col("b.id")))
    return both.select(*[F.col(f"n.{k}").alias(k) for k in keys], F.col("n.id_a").alias("id_a"), F.col("b.id").alias("id_b"), "n.name_a", "n.name_b", *[F.col(f"n.{x}") for x in more])


def pair_rules(a: Column, b: Column, km: Column | None = None) -> Column:
    """The names of all rules that a pair of names meets."""
    near = km is not None
    rules = [
        ("same_name", a == b),
        ("same_base", (a != b) & (text.numbered(a)["base"] == text.numbered(b)["base"])),
        ("same_romanised", (a != b) & (text.romanised_key(a) == text.romanised_key(b)) & (text.romanised_key(a) != "")),
        ("one_edit", (a != b) & (text.limited_distance(a, b, 1) <= 1)),
        ("contained", (a != b) & (F.contains(a, b) | F.contains(b, a))),
        ("shared_characters", (a != b) & (text.shared_ratio(a, b) >= 0.8)),
    ]
    if near:
        rules += [("within_100m", km <= 0.1), ("within_500m", km <= 0.5)]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))


def merge_severity(rules: Column, km: Column) -> Column:
    return F.when(F.array_contains(rules, "same_name") & (km <= 0.5), "high").when((F.array_contains(rules, "same_base") | F.array_contains(rules, "same_romanised")) & (km <= 1), "medium").otherwise("none")


def fuzzy_severity(rules: Column, km: Column) -> Column:
    return F.when(F.array_contains(rules, "one_edit") & (km <= 0.5), "high").when(F.array_contains(rules, "shared_characters") & (km <= 1), "medium").otherwise("none")


def same_name_components(points: DataFrame, keys: list[str], most_km: float, name: str = "name", most_latitude: float | None = None) -> DataFrame:
    """(id, root) of places with equal names in a block, linked within a distance.

    Places meet by block, name and grid cell, so that a common name costs what its
    neighbourhoods hold, not its square. A null key is a key of its own.
    """
    whole = points.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in [*keys, name]})
    near = neighbours(whole, whole, most_km, most_latitude, on=(*keys, name)).filter("a < b")
    return connected_components(points.select(F.col("id").alias("node")), near.select("a", "b")).withColumnRenamed("node", "id")


def survivors(df: DataFrame, root: str, order: list[Column]) -> DataFrame:
    """The first row of each component in an order of preference."""
    rank = F.row_number().over(Window.partitionBy(root).orderBy(*order))
    return df.withColumn("__r", rank).filter("__r = 1").drop("__r")


def merged_lists(df: DataFrame, root: str, column: str, separator: str = ";") -> DataFrame:
    """Distinct entries of all members' lists, in order."""
    entries = df.select(root, F.explode(F.split(column, separator)).alias("x")).withColumn("x", F.trim("x")).filter("x <> ''")
    return entries.groupBy(root).agg(F.array_join(F.array_sort(F.collect_set("x")), separator).alias(column))


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).filter("n > 1")


def longest_prefix(places: DataFrame, candidates: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Each place with the longest candidate of its block that its name starts with and
    leaves at least `least` characters; `is_ambiguous` when two different ones are as long."""
    c = candidates.select(*[F.col(k).alias(f"__{k}") for k in keys], "candidate")
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    starts = F.startswith("name", "candidate") & (F.length("name") - F.length("candidate") >= least)
    met = places.join(c, same & starts).groupBy("id", "name").agg(F.max(F.struct(F.length("candidate").alias("n"), "candidate")).alias("m"), F.countDistinct("candidate").alias("matches"))
    return met.select("id", "name", F.col("m.candidate").alias("candidate"), F.substring("name", F.length("m.candidate") + 1, F.length("name")).alias("remaining"), "matches")


def name_audit(places: DataFrame, terms: dict[str, list[str]], name: str = "name", **strengths) -> DataFrame:
    """id, name, rules met, risk: names that look like something other than a place's.

    `strengths` are the weak, medium, protected terms and usual endings of text.term_strength.
    """
    n = F.col(name)
    hits = F.array_compact(F.array(*[F.when(F.size(text.any_of(n, words)) > 0, F.lit(rule)) for rule, words in terms.items()]))
    found = F.array_compact(F.array(*[F.when(n.contains(w), text.term_strength(n, w, **strengths)) for words in terms.values() for w in words]))
    return places.select("id", name, hits.alias("rules"), text.risk(found).alias("risk"))


def prefix_matches(places: DataFrame, least: int = 2) -> DataFrame:
    """Places whose name begins with a committee's name: id, name, candidate, remaining, status.

    A place's own committee is tried first ('own'), then the others of its township: the
    longest one that leaves enough of the name ('other'), unless another one that doesn't
    begin it is as long ('review'). A remainder that is no name, or begins like the rest of
    a longer one, is 'skipped'.
    """
    bare = places.select("id", "name", "township", text.admin_base(F.col("committee")).alias("own"))
    parents = bare.select(F.col("township").alias("__t"), F.col("own").alias("other")).filter("other IS NOT NULL AND other <> ''").distinct()

    def begins(c: str) -> Column:
        return F.startswith("name", c) & (F.length("name") - F.length(c) >= least) & (F.length(c) >= least)

    met = bare.join(parents, F.col("township").eqNullSafe(F.col("__t")) & begins("other"), "left")
    best = F.max(F.when(F.col("other").isNotNull(), F.struct(F.length("other").alias("n"), "other")))
    grouped = met.groupBy("id", "name", "own").agg(best["other"].alias("other"), F.count_if(F.length("other") >= least).alias("matches"))
    own = F.coalesce(begins("own"), F.lit(False))
    candidate = F.when(own, F.col("own")).otherwise(F.col("other"))
    out = grouped.withColumn("candidate", candidate).filter("candidate IS NOT NULL")
    out = out.withColumn("remaining", F.substring("name", F.length("candidate") + 1, F.length("name")))
    ending = F.col("remaining").isin(*text.ADMIN_SUFFIXES, *text.BARE_NAMES) | F.col("remaining").rlike(f"^[{text.NUMERALS}{text.BAD_STARTS}]")
    status = F.when(ending, "skipped").when(own, "own").when(F.col("matches") > 1, "review").otherwise("other")
    return out.select("id", "name", "candidate", "remaining", status.alias("status"))


def prefix_proposal(a: Column, b: Column, admin: Column) -> Column:
    """Which of two names to keep when one is the other with its parish name before it: 'a', 'b' or null."""
    parish = text.admin_base(admin)
    return F.when(a == F.concat(parish, b), "b").when(b == F.concat(parish, a), "a").when(a == F.concat(admin, b), "b").when(b == F.concat(admin, a), "a")
