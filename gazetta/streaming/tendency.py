"""Tendencies over a stream of events: an extension beyond batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazetta.functions import stats

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, pattern: str = "events*.parquet") -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)


def windowed_counts(stream: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each type per window; state older than the watermark is dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def windowed_tendency(counts: DataFrame) -> DataFrame:
    """Lift and z of each type in its window against all windows (on settled counts)."""
    everywhere, here, kind = Window.partitionBy(), Window.partitionBy("window"), Window.partitionBy("event_type")
    out = counts.withColumns({"window_n": F.sum("n").over(here), "type_n": F.sum("n").over(kind), "all_n": F.sum("n").over(everywhere)})
    q = stats.ratio(F.col("type_n"), F.col("all_n"))
    return out.withColumns({"lift": stats.lift(stats.ratio(F.col("n"), F.col("window_n")), q), "z_score": stats.z_binomial(F.col("n"), F.col("window_n"), q)})
