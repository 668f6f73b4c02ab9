"""Lexicons of characters by category and subcategory, as small tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The letter lexicon of the driver queries: category -> subcategory -> letters.
LETTERS = {
    "vowel": {"open": ["a", "o"], "close": ["e", "i", "u"]},
    "liquid": {"lateral": ["l"], "rhotic": ["r"]},
    "nasal": {"labial": ["m"], "dental": ["n"]},
    "stop": {"voiced": ["b", "d", "g"], "unvoiced": ["k", "p", "t", "c", "q"]},
    "fricative": {"sibilant": ["s", "z", "x"], "other": ["f", "h", "v", "j"]},
}


def flattened(categories: dict) -> list[tuple[int, str, str, str]]:
    """(order, char, category, subcategory), for flat and nested lexicons."""
    out, k = [], 0
    for parent, inner in categories.items():
        groups = inner.items() if isinstance(inner, dict) else [("", inner)]
        for sub, chars in groups:
            for c in chars:
                out.append((k, c, parent, sub))
                k += 1
    return out


def lexicon(spark: SparkSession, categories: dict, extra_labels: dict[str, list[str]] | None = None) -> DataFrame:
    """ord, char, category, subcategory; a character may have several rows."""
    rows = flattened(categories)
    k = len(rows)
    for char, parents in (extra_labels or {}).items():
        for parent in parents:
            if not any(c == char and p == parent for _, c, p, _ in rows):
                rows.append((k, char, parent, ""))
                k += 1
    return spark.createDataFrame(rows, "ord int, char string, category string, subcategory string")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file with `categories` and, if it has them, `multi_label` characters."""
    spec = json.loads(spark.read.text(path, wholetext=True).first()[0])
    return lexicon(spark, spec["categories"], spec.get("multi_label"))


def first_label(lex: DataFrame) -> DataFrame:
    return lex.groupBy("char").agg(F.min_by("category", "ord").alias("category"))


def last_label(lex: DataFrame) -> DataFrame:
    return lex.groupBy("char").agg(F.max_by("category", "ord").alias("category"))


def sql_values(categories: dict) -> str:
    rows = ", ".join(f"({k}, '{c}', '{p}', '{s}')" for k, c, p, s in flattened(categories))
    return f"lexicon AS (SELECT * FROM (VALUES {rows}) t(ord, char, category, subcategory))"


def label_pairs(categories: dict, last: bool = False) -> dict[str, str]:
    """char -> category, the first or the last one given."""
    out: dict[str, str] = {}
    for _, c, p, _ in flattened(categories):
        if last or c not in out:
            out[c] = p
    return out
