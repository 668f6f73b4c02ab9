"""What the training-data operators share: tables, shared storage, salting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session that names none (as in tests) gets a temporary one; on a cluster executors
    wouldn't share it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="gazetta-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/gazetta-{label}-{uuid.uuid4().hex}"


_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def written(df: DataFrame, label: str, lasting: bool = False) -> DataFrame:
    """Cut the lineage: write to the shared folder once and read that table.

    Inside `scratch` the table goes at its end, unless it is lasting.
    """
    spark = df.sparkSession
    at = fresh_dir(spark, label)
    df.write.option("compression", "zstd").parquet(at)
    if not lasting and _SCRATCH.get() is not None:
        _SCRATCH.get().append(at)
    return spark.read.schema(df.schema).parquet(at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables written inside, from any file system; what is used afterwards
    must have been written as lasting."""
    made: list[str] = []
    token = _SCRATCH.set(made)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for at in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def numbered(df: DataFrame) -> DataFrame:
    """df with columns __c0, __c1 ... by position, so that no name can clash."""
    return df.toDF(*[f"__c{i}" for i in range(len(df.columns))])


def place(df: DataFrame, name: str) -> str:
    """The numbered name of a column: the exact name, or else one that differs in case only."""
    names = df.columns
    if name in names:
        return f"__c{names.index(name)}"
    return f"__c{[n.lower() for n in names].index(name.lower())}"


def picked(df: DataFrame, **columns: tuple[str, str]) -> DataFrame:
    """Only the named columns: new name = (column, type)."""
    return numbered(df).select(*[F.col(place(df, c)).cast(t).alias(n) for n, (c, t) in columns.items()])


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and text, an empty text for null."""
    rows = picked(df, doc_id=(id_col, "long"), text=(text_col, "string"))
    return rows.withColumn("text", F.coalesce("text", F.lit("")))


def salted_left_join(left: DataFrame, right: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """Left join on a key that may hold a third of the rows.

    Each left row takes one of `salts` values from its whole content, each right row
    is repeated for all of them, so a hot key meets `salts` tasks. `right`
    must have one row per key; its other columns must be new names. The sides are
    merged, never broadcast: an estimate of the repeated side's size can be far too low.
    """
    dealt = left.withColumn("__salt", F.pmod(F.xxhash64(*[left[c] for c in left.columns]), F.lit(salts)))
    spread = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(spread.hint("merge"), [key, "__salt"], "left").drop("__salt")
