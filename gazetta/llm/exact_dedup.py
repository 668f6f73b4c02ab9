"""Exact deduplication by a content sort.

Rows are range-partitioned at sampled splitters of their normalised content
(its first characters, then its digest as the order among equal beginnings, then
the survivor's order), sorted externally inside each partition, and each
row is compared in full with its neighbour. The splitters may fall inside a
group of equal texts, so a group of any size is spread over as many partitions as
it fills; only the first and the last run of each partition can go on
next door, and those few run summaries are joined afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import numbered, place, shuffle_partitions, written

#: Characters of the normalised text that order it before its digest does.
SPLITTER_CHARS = 32
_DROPPED = re.compile(r"[\x20\x09-\x0D]+")
_RUN = [("__keep", "bigint"), ("__size", "bigint"), ("__head", "boolean"), ("__edge", "boolean"), ("__pid", "int")]


def normalised(text):
    return F.translate(text, " \t\n\x0b\f\r", "")


def _runs(heads_only: bool, keep_text: bool, schema: pa.Schema):
    """Compares neighbours of sorted partitions; the rows of a run are held back
    as columns without texts (and as heads only, if only those are wanted)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        names = [n for n in schema.names if n not in dict(_RUN)]
        done: list[list] = []  # rows of ended runs, to be sent
        held: list[list] = []  # rows of the run that goes on
        sha = norm = None
        size, first, weight = 0, True, 0

        def end(last: bool) -> None:
            nonlocal size, first
            if size:
                keep = held[0][0]
                done.extend([*row[1:], keep, size, k == 0, first or last, pid] for k, row in enumerate(held))
                first = False
            held.clear()
            size = 0

        def sent() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            columns = [batch[n].to_pylist() if n != "__text" else batch[n] for n in batch.schema.names]
            at = batch.schema.names.index("__text")
            texts = columns.pop(at)
            index = [n for n in batch.schema.names if n != "__text"]
            id_at, sha_at, out_at = index.index("__id"), index.index("__sha"), [index.index(n) for n in names if n != "__text"]
            text_at = names.index("__text") if keep_text else -1
            for k, row in enumerate(zip(*columns, strict=True)):
                text = None
                if row[sha_at] == sha:
                    text = texts[k].as_py()
                    if norm is None:
                        norm = _DROPPED.sub("", held_text)
                    same = _DROPPED.sub("", text) == norm
                else:
                    same = False
                if not same:
                    end(False)
                    sha, norm, held_text = row[sha_at], None, text if text is not None else texts[k].as_py()
                size += 1
                if size == 1 or not heads_only:
                    out = [row[id_at], *(row[i] for i in out_at)]
                    if keep_text:
                        value = text if text is not None else held_text
                        out.insert(1 + text_at, value)
                        weight += len(value)
                    held.append(out)
            if len(done) >= 10_000 or weight > 16_000_000:
                weight = 0
                if done:
                    yield sent()
        end(True)
        if done:
            yield sent()

    return compare


def _sorted(df: DataFrame, id_col: str, text_col: str, carried: list[str]) -> DataFrame:
    text = F.coalesce(F.col(place(df, text_col)).cast("string"), F.lit(""))
    rows = numbered(df).select(
        *carried,
        F.col(place(df, id_col)).cast("long").alias("__id"),
        text.alias("__text"),
        F.length(text).alias("__points"),
        normalised(text).alias("__norm"),
    )
    rows = rows.withColumn("__sha", F.sha2("__norm", 256)).withColumn("__start", F.substring("__norm", 1, SPLITTER_CHARS)).drop("__norm")
    order = [F.col("__start"), F.col("__sha"), F.col("__points").desc(), F.col("__id").asc_nulls_last()]
    return rows.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order).drop("__start")


def _stitched(runs: DataFrame) -> DataFrame:
    """Settles the runs that cross partition borders.

    There are at most two edge runs a partition; their summaries (a digest and
    three numbers) are all that is broadcast.
    """
    edges = (
        runs.filter("__edge AND __head")
        .groupBy("__sha")
        .agg(F.min("__pid").alias("__first"), F.sum("__size").alias("__all"), F.min_by("__keep", "__pid").alias("__kept"), F.count(F.lit(1)).alias("__n"))
        .filter("__n > 1")
        .drop("__n")
    )
    joined = runs.join(F.broadcast(edges), ["__sha"], "left")
    crossing = F.col("__first").isNotNull()
    return joined.select(
        *[c for c in runs.columns if c not in ("__keep", "__size", "__head")],
        F.when(crossing, F.col("__kept")).otherwise(F.col("__keep")).alias("__keep"),
        F.when(crossing, F.col("__all")).otherwise(F.col("__size")).alias("__size"),
        (F.col("__head") & (F.coalesce(F.col("__first"), F.col("__pid")) == F.col("__pid"))).alias("__head"),
    )


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Texts are equal when they are after deleting blanks (U+0020, U+0009 to
    U+000D); null counts as empty. The row with the most code points stays, then the one with
    the smallest id; a null id comes after all others. Of rows that repeat
    with the same id and text one is kept and all have its id as keep_id. Other columns are
    ignored; an empty table gives an empty result.
    """
    rows = _sorted(df, id_col, text_col, []).select("__id", "__text", "__sha")
    fields = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("__sha", T.StringType()), *[T.StructField(n, T._parse_datatype_string(t)) for n, t in _RUN]])
    arrow = to_arrow_schema(T.StructType([T.StructField("__id", T.LongType()), *fields.fields[1:]]))
    runs = written(rows.mapInArrow(_renamed(_runs(False, False, arrow), fields.names), fields), "runs")
    return _stitched(runs).select("doc_id", F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"), F.col("__head").alias("kept"), F.col("__sha").alias("text_sha256"))


def _renamed(run, names):
    def named(batches):
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=names)

    return named


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that exact_duplicates keeps, with df's own columns; a null text that
    is kept comes back empty."""
    at = place(df, text_col)
    carried = [T.StructField(f"__c{i}", f.dataType) for i, f in enumerate(df.schema.fields) if f"__c{i}" != at]
    rows = _sorted(df, id_col, text_col, [f.name for f in carried])
    fields = T.StructType([*carried, T.StructField("__text", T.StringType()), T.StructField("__sha", T.StringType()), *[T.StructField(n, T._parse_datatype_string(t)) for n, t in _RUN]])
    rows = rows.select(*[f.name for f in carried], "__id", "__text", "__sha")
    runs = written(rows.mapInArrow(_runs(True, True, to_arrow_schema(fields)), fields), "heads")
    kept = _stitched(runs).filter("__head")
    out = [F.col("__text" if f"__c{i}" == at else f"__c{i}").cast(f.dataType) for i, f in enumerate(df.schema.fields)]
    return kept.select(*out).toDF(*df.columns)
