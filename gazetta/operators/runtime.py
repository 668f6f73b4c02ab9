"""Around queries: result caching, time limits, statistics."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class ResultCache:
    """Keeps the plans' results of recent calls in Spark's storage, by function and parameters.

    An entry goes when it is older than `seconds` or the least recently used of too many.
    """

    def __init__(self, seconds: float = 3600, most: int = 64, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.most, self.clock = seconds, most, clock
        self.entries: OrderedDict[str, tuple[float, DataFrame]] = OrderedDict()
        self.hits = self.misses = 0

    @staticmethod
    def key(name: str, parameters: dict) -> str:
        return name + json.dumps(parameters, sort_keys=True, default=str)

    def get(self, name: str, make: Callable[..., DataFrame], **parameters) -> DataFrame:
        key = self.key(name, parameters)
        found = self.entries.get(key)
        if found and self.clock() - found[0] < self.seconds:
            self.hits += 1
            self.entries.move_to_end(key)
            return found[1]
        self.misses += 1
        if found:
            found[1].unpersist()
        df = make(**parameters).cache()
        self.entries[key] = (self.clock(), df)
        self.entries.move_to_end(key)
        while len(self.entries) > self.most:
            self.entries.popitem(last=False)[1][1].unpersist()
        return df

    def clear(self) -> None:
        for _, df in self.entries.values():
            df.unpersist()
        self.entries.clear()

    def stats(self) -> dict:
        return {"entries": len(self.entries), "hits": self.hits, "misses": self.misses}


def within(spark: SparkSession, seconds: float, run: Callable[[], object]):
    """The result of run(); its Spark jobs are cancelled if it takes longer."""
    group, context = f"limit-{uuid.uuid4().hex}", spark.sparkContext
    over = threading.Event()

    def stop() -> None:
        over.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    context.setJobGroup(group, "limited in time", interruptOnCancel=True)
    timer.start()
    try:
        return run()
    except Exception as e:
        if over.is_set():
            raise TimeoutError(f"took longer than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)


def analyse(spark: SparkSession, names: list[str]) -> list[str]:
    """Computes the statistics of catalogue tables that exist, for the optimiser."""
    found = [n for n in names if spark.catalog.tableExists(n)]
    for n in found:
        spark.sql(f"ANALYZE TABLE {n} COMPUTE STATISTICS FOR ALL COLUMNS")
    return found
