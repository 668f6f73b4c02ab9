"""Growing a lexicon: accepting proposed labels, merging and splitting categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazetta.operators import vectors


def accepted_labels(proposed: DataFrame, lex: DataFrame, embeddings: DataFrame | None = None, confidence: float = 0.7, similarity: float = 0.3) -> DataFrame:
    """Proposals (char, category, confidence) that are confident and whose vector is near
    their category's members; without vectors for either they are accepted."""
    sure = proposed.filter(F.col("confidence") >= confidence)
    if embeddings is None:
        return sure
    members = lex.select("char", "category").distinct().join(embeddings, "char")
    means = vectors.group_means(members, "category").select("category", "mean")
    rows = sure.join(embeddings, "char", "left").join(F.broadcast(means), "category", "left")
    near = vectors.dot(vectors.unit(F.col("vector")), F.col("mean"))
    return rows.filter(near.isNull() | (near >= similarity)).select(*proposed.columns)


def extended(lex: DataFrame, accepted: DataFrame) -> DataFrame:
    """The lexicon with accepted labels after its own, without repeats."""
    last = lex.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))
    new = accepted.join(lex, ["char", "category"], "left_anti").join(F.broadcast(last))  # a single row
    rank = F.row_number().over(Window.orderBy("category", "char"))
    return lex.unionByName(new.select((F.col("last") + rank).cast("int").alias("ord"), "char", "category", F.lit("").alias("subcategory")))


def merged_categories(lex: DataFrame, names: list[str], into: str) -> DataFrame:
    out = lex.withColumn("category", F.when(F.col("category").isin(*names), F.lit(into)).otherwise(F.col("category")))
    return out.groupBy("char", "category", "subcategory").agg(F.min("ord").alias("ord")).select("ord", "char", "category", "subcategory")


def split_category(lex: DataFrame, category: str, parts: dict[str, list[str]]) -> DataFrame:
    """Moves listed characters of a category to new ones; the others stay."""
    target = F.lit(category)
    for name, chars in parts.items():
        target = F.when(F.col("char").isin(*chars), F.lit(name)).otherwise(target)
    return lex.withColumn("category", F.when(F.col("category") == category, target).otherwise(F.col("category")))


def similar_categories(lex: DataFrame, embeddings: DataFrame, least: float = 0.5, k: int = 5) -> DataFrame:
    """Pairs of categories by the mean cosine of their members, from category means alone."""
    means = vectors.group_means(lex.select("char", "category").distinct().join(embeddings, "char"), "category")
    a, b = means.alias("a"), means.alias("b")
    pairs = a.join(b, F.col("a.category") < F.col("b.category"))
    out = pairs.select(F.col("a.category").alias("first"), F.col("b.category").alias("second"), vectors.dot(F.col("a.mean"), F.col("b.mean")).alias("similarity"))
    return out.filter(F.col("similarity") >= least).orderBy(F.desc("similarity"), "first", "second").limit(k)


def unclassified(lex: DataFrame, roles: dict[str, list[str]]) -> DataFrame:
    """Categories without a role."""
    known = [c for cs in roles.values() for c in cs]
    return lex.select("category").distinct().filter(~F.col("category").isin(*known))


def char_coverage(chars: DataFrame, lex: DataFrame) -> DataFrame:
    """total, labelled and share of a table of characters."""
    labelled = chars.join(lex.select("char").distinct(), "char", "left_semi")
    both = chars.agg(F.count(F.lit(1)).alias("total")).join(F.broadcast(labelled.agg(F.count(F.lit(1)).alias("labelled"))))  # single rows
    return both.withColumn("share", F.col("labelled") / F.nullif(F.col("total").cast("double"), F.lit(0.0)))
