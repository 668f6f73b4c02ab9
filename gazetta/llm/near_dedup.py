"""Dropping near duplicates: fingerprints propose, exact similarity decides.

Documents meet in buckets: a component of SimHash fingerprints (simhash.py) and, where
`banded`, MinHash bands of the shingles that decide, for similar texts with distant
fingerprints. BANDS keys of ROWS minima each are made of a text; a pair of similarity s
shares one with probability 1 - (1 - s^ROWS)^BANDS, which is 0.9995 at 0.8.

Inside a bucket each document is compared with the bucket's first one (by id), those
that aren't similar to it among themselves in the order of ids, each with those before it
that aren't similar to any other one. So of two documents of a bucket that aren't linked to a smaller one, the
larger was compared with the smaller: no two documents that stay are similar. Links are exact
similarities; their components are the groups, of each of which the document of smallest id stays.

No bucket is ever held as a whole: it is compared with its first document in salted parts, and what is left of it
in blocks of BLOCK documents. Only texts that share a bucket are read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, place, scratch, shuffle_partitions, written
from .simhash import _BLANK, _LOWER, SHARD, components, fingerprint, links

#: Documents of a bucket that are compared in one go.
BLOCK = 512
#: Documents of a bucket that are compared with its first one in one task's run.
PART = 64
#: Keys of a text that are looked up, and the minima that each is made of.
BANDS, ROWS = 25, 6
_DRAWN = np.random.default_rng(42).integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64)
_FLIPS, _FACTORS = _DRAWN[0], _DRAWN[1] | np.uint64(1)
_MIX, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
_AT_ONCE = 1024


def _chained(first: np.ndarray, more: list[np.ndarray]) -> np.ndarray:
    for x in more:
        first = (first ^ x) * _MIX
        first ^= first >> _SHIFT
    return first


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """Hashes of a text's word shingles in order (of all its words if they are fewer); none without words."""
    found = text.translate(_LOWER).translate(_BLANK).split(" ")
    hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in found if w], np.uint64)
    if not len(hashes):
        return hashes
    n = min(shingle, len(hashes))
    count = len(hashes) - n + 1
    return _chained(np.full(count, n, np.uint64), [hashes[k : k + count] for k in range(n)])


def shingle_set(text: str, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of `least` or more; empty ones are alike."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= least * (len(a) + len(b) - common)


def bands(text: str, shingle: int) -> np.ndarray:
    """The MinHash keys of a text's set of word shingles; none without words."""
    runs = shingle_hashes(text, shingle)
    if not len(runs):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(runs), _AT_ONCE):
        drawn = runs[i : i + _AT_ONCE] ^ _FLIPS
        drawn *= _FACTORS
        np.minimum(least, drawn.min(1), out=least)
    return _chained(np.arange(1, BANDS + 1, dtype=np.uint64), [*least.reshape(BANDS, ROWS).T])


def _prints(rows: DataFrame, words: int, shingle: int, banded: bool) -> DataFrame:
    many = pa.list_(pa.int64())
    schema = pa.schema([("doc", pa.int64()), ("uid", pa.binary()), ("fp", pa.int64()), ("bands", many)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), words) for t in batch["text"]], np.uint64).view(np.int64)
            keys = pa.array([bands(t.as_py(), shingle).view(np.int64) if banded else [] for t in batch["text"]], many)
            yield pa.RecordBatch.from_arrays([batch["doc"], batch["uid"], pa.array(values, pa.int64()), keys], schema=schema)

    return rows.select("doc", "uid", "text").mapInArrow(run, "doc long, uid binary, fp long, bands array<long>")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    schema = pa.schema([("num", pa.int64()), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in batch["text"]], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["num"], made], schema=schema)

    return texts.select("num", "text").mapInArrow(run, "num long, set binary")


_LINK = pa.schema([("num", pa.int64()), ("lead", pa.int64()), ("ok", pa.bool_())])


def _with_first(least: float):
    """Compares each row of a run of equal (lead, salt) with the run's first row, the lead itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, first = None, np.zeros(0, np.uint64)
        for batch in batches:
            rows = []
            for n, k, value in zip(batch["num"].to_pylist(), batch["lead"].to_pylist(), batch["set"], strict=True):
                own = np.frombuffer(value.as_buffer(), np.uint64)
                if n == k:
                    lead, first = k, own.copy()
                else:
                    if k != lead:
                        raise RuntimeError("a bucket's first document is missing")
                    rows.append((n, k, similar(own, first, least)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _LINK.types, strict=True)], schema=_LINK)

    return run


_LED = pa.schema([("key", pa.int64()), ("num", pa.int64()), ("lead", pa.int64())])


def _among(least: float):
    """Compares each row of a run of equal (key, block) with those before it that have no lead;
    the first that is similar becomes its lead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leads = None, []
        for batch in batches:
            rows = []
            for key, block, n, value in zip(*(batch[c].to_pylist() for c in ("key", "block", "num")), batch["set"], strict=True):
                if (key, block) != at:
                    at, leads = (key, block), []
                own = np.frombuffer(value.as_buffer(), np.uint64)
                lead = next((k for k, first in leads if similar(own, first, least)), None)
                if lead is None:
                    leads.append((n, own.copy()))
                rows.append((key, n, lead))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _LED.types, strict=True)], schema=_LED)

    return run


def _led(dealt: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    rows = dealt.join(sets, "num").select("key", "block", "num", "set")
    sorted_ = rows.repartition(shuffle_partitions(sets.sparkSession), "key", "block").sortWithinPartitions("key", "block", "num")
    return written(sorted_.mapInArrow(_among(least), "key long, num long, lead long"), "led")


def _rest_links(rest: DataFrame, sets: DataFrame, least: float, block: int) -> DataFrame:
    """(num, lead): links among what is left of the buckets (key, num).

    A bucket of more than `block` rows is dealt to blocks, those without a lead there meet again; if
    that hardly makes them fewer, each pair of blocks is compared.
    """
    found = rest.select("num", F.col("num").alias("lead")).limit(0)
    before = None
    while True:
        sizes = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        rest = written(rest.join(sizes, "key").select("key", "num", F.ceil(F.col("n") / block).cast("int").alias("k")), "rest")
        now = rest.count()
        if not now:
            return found
        own = F.pmod(F.xxhash64("num"), F.col("k")).cast("int")
        if before is not None and now > 0.7 * before:
            pairs = rest.select("key", "num", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"), "k")
            cells = pairs.select("key", "num", (F.least("own", "other") * F.col("k") + F.greatest("own", "other")).cast("long").alias("block"))
            return found.unionByName(_led(cells, sets, least).filter("lead IS NOT NULL").select("num", "lead"))
        led = _led(rest.select("key", "num", own.cast("long").alias("block")), sets, least)
        found = found.unionByName(led.filter("lead IS NOT NULL").select("num", "lead"))
        split = rest.filter("k > 1").select("key", "num")
        rest, before = led.filter("lead IS NULL").join(split, ["key", "num"]).select("key", "num"), now


def _similar_links(members: DataFrame, texts: DataFrame, shingle: int, least: float, block: int) -> DataFrame:
    """(num, lead): links that are exact similarities; members are (key, num, lead), lead being the bucket's smallest num."""
    pairs = written(members.filter("num <> lead").select("num", "lead").distinct(), "pairs")
    several = pairs.select("num").unionByName(pairs.select(F.col("lead").alias("num"))).distinct()
    sets = written(_sets(texts.join(several, "num"), shingle), "shingles")
    parts = pairs.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / min(block, PART)).cast("int").alias("k"))
    dealt = pairs.join(parts, "lead").select("num", "lead", F.pmod(F.xxhash64("num"), F.col("k")).cast("int").alias("salt"))
    firsts = parts.select(F.col("lead").alias("num"), "lead", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"))
    rows = dealt.unionByName(firsts).join(sets, "num")
    sorted_ = rows.repartition(shuffle_partitions(sets.sparkSession), "lead", "salt").sortWithinPartitions("lead", "salt", "num")
    compared = written(sorted_.select("num", "lead", "set").mapInArrow(_with_first(least), "num long, lead long, ok boolean"), "compared")
    rest = members.filter("num <> lead").join(compared.filter("NOT ok").select("num", "lead"), ["num", "lead"]).select("key", "num")
    return compared.filter("ok").select("num", "lead").unionByName(_rest_links(rest, sets, least, block))


def near_duplicates(df: DataFrame, id_col: str, text_col: str, words: int, radius: int, shingle: int, least: float, shard: int = SHARD, banded: bool = False, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(uid of documents that go, uid of documents that are there more than once); uid is a SHA-256 of id and text."""
    rows = _keyed(df, id_col, text_col)
    prints = written(_prints(rows, words, shingle, banded), "fingerprints")
    once = prints.groupBy("uid").agg(*[F.first(c).alias(c) for c in ("doc", "fp", "bands")], F.count(F.lit(1)).alias("n"))
    order = [F.col("doc").asc_nulls_last(), F.col("uid")]
    ranged = once.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    once = written(ranged.withColumn("num", F.monotonically_increasing_id()), "documents")  # numbers that follow the ids
    nodes = once.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    below = components(links(nodes.select("fp"), radius, shard))
    member = below.unionByName(below.select(F.col("root").alias("node"), "root").distinct())
    shared = nodes.join(member, nodes["fp"] == member["node"], "left").filter("node IS NOT NULL OR n > 1").select("fp", F.xxhash64(F.lit("component"), F.coalesce("root", "fp")).alias("key"))
    keyed = once.select("num", F.explode("bands").alias("key")) if banded else once.select("num", F.col("fp").alias("key")).limit(0)
    keyed = keyed.unionByName(once.select("num", "fp").join(shared, "fp").select("num", "key"))
    leads = keyed.groupBy("key").agg(F.min("num").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "lead")
    members = written(keyed.join(leads, "key").select("key", "num", "lead"), "members")  # a hot key is split by the skew join
    texts = rows.select("uid", "text").join(once.select("uid", "num").join(members.select("num").distinct(), "num"), "uid").dropDuplicates(["num"])
    met = _similar_links(members, texts, shingle, least, block)
    roots = components(met.select(F.col("num").alias("a"), F.col("lead").alias("b")))
    gone = once.select("uid", "num").join(roots.filter("node <> root").select(F.col("node").alias("num")), "num").select("uid")
    return gone, once.filter("n > 1").select("uid")


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = numbered(df)
    text = F.coalesce(F.col(place(df, text_col)).cast("string"), F.lit(""))
    doc = F.col(place(df, id_col)).cast("long")
    uid = F.unhex(F.sha2(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit("|"), text), 256))
    return rows.withColumns({"doc": doc, "text": text, "uid": uid})


def drop_near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 6, shingle: int = 5, least: float = 0.8, shard: int = SHARD, banded: bool = False, block: int = BLOCK
) -> DataFrame:
    """The rows of df without those that are linked to a row of smaller id.

    Candidates have SimHash fingerprints (of `words`-word shingles) linked at `radius` bits or
    fewer or, if `banded`, a MinHash band in common; a link is a Jaccard similarity of `least` or more of the sets of
    `shingle`-word shingles. Null texts count as empty, and empty ones are similar to each
    other; a null id comes last; of rows that repeat with id and text one stays; a text of any length is one set; df's
    columns stay as they are, whatever their names; an empty table stays empty.
    """
    with scratch(df.sparkSession):
        gone, repeated = near_duplicates(df, id_col, text_col, words, radius, shingle, least, shard, banded, block)
        gone = written(gone.distinct(), "gone", lasting=True)
        again = None if repeated.isEmpty() else written(repeated, "repeated", lasting=True)
    names = [f"__c{i}" for i in range(len(df.columns))]
    kept = _keyed(df, id_col, text_col).select(*names, "uid").join(gone, "uid", "left_anti")
    if again is not None:
        kept = kept.join(again, "uid", "left_anti").unionByName(kept.join(again, "uid", "left_semi").dropDuplicates(["uid"]))
    return kept.select(*names).toDF(*df.columns)
