"""SimHash near-deduplication with BK-trees.

Fingerprints that differ in at most `radius` bits agree on all bits of at least e of
radius + e blocks, so the trees are sharded by (e blocks, their bits): a
pair within the radius meets in a shard, and a shard only holds fingerprints
that share those bits. In each shard a BK-tree is built, whose children are
keyed by their Hamming distance to the parent, and every member is looked up along
the edges within the radius of its own distance. Trees and their queries meet by
a shuffle on the shard; sending all trees to all tasks would grow with the corpus.

Equal fingerprints are one node. A shard beyond `SHARD` members is dealt anew by
further parts of the remaining bits, and what is still too large is looked up in blocks
of tree and query members, so that no task holds more than two blocks; only
links that join parts leave a task. The links are then contracted to
components by passing on the smallest identifiers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise
from math import comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, salted_left_join, shuffle_partitions, written

BITS = 64
#: Members of a shard beyond which it is dealt anew.
SHARD = 4096
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BLANK = str.maketrans("\t\n\x0b\f\r", "     ")
_CHUNK = 65_536


def shingles(text: str, words: int) -> list[str]:
    found = [w for w in text.translate(_LOWER).translate(_BLANK).split(" ") if w]
    if len(found) < words:
        return [" ".join(found)] if found else []
    return [" ".join(s) for s in zip(*(found[i:] for i in range(words)), strict=False)]


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Bit b is 1 if over half of the shingles' hashes have it; 0 without words."""
    parts = shingles(text, words)
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(parts), _CHUNK):
        hashes = np.array([digest(s, seed) for s in parts[i : i + _CHUNK]], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(parts)).tobytes(), "big") if parts else 0


def fingerprints(df: DataFrame, id_col: str, text_col: str, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), words, seed) for t in batch["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(values, pa.int64())], schema=schema)

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


class BkTrees:
    """BK-trees over distinct 64-bit numbers, one for each shard, searched for many at a time.

    `shards` numbers the tree of each value from 0, in ascending order. The
    children of a node are a run of rows sorted by their distance to it.
    """

    def __init__(self, values: np.ndarray, shards: np.ndarray):
        self.values = values
        n = len(values)
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        starts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if n else np.zeros(0, np.int64)
        self.roots = dict(zip(shards[starts].tolist(), starts.tolist(), strict=True))
        groups = np.split(np.arange(n), starts[1:]) if n else []
        while groups:
            deeper = []
            for members in groups:
                root, rest = members[0], members[1:]
                if not len(rest):
                    continue
                far = np.bitwise_count(values[rest] ^ values[root]).astype(np.int64)
                order = far.argsort(kind="stable")
                rest, far = rest[order], far[order]
                cuts = np.flatnonzero(np.r_[True, far[1:] != far[:-1]])
                heads = rest[cuts]
                parent[heads], edge[heads] = root, far[cuts]
                deeper += np.split(rest, cuts[1:])
            groups = [g for g in deeper if len(g) > 1]
        key = np.where(parent >= 0, parent * (BITS + 1) + edge, -1)
        self.order = key.argsort(kind="stable")
        self.keys = key[self.order]

    def search(self, queries: np.ndarray, shards: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) for all nodes of its shard within the radius of each query."""
        out_q, out_n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        node = np.array([self.roots.get(s, -1) for s in shards.tolist()], np.int64)
        q = np.flatnonzero(node >= 0)
        node = node[q]
        while len(q):
            far = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            hit = far <= radius
            out_q.append(q[hit])
            out_n.append(node[hit])
            base = node * (BITS + 1)
            low = np.searchsorted(self.keys, base + np.maximum(far - radius, 1))
            high = np.searchsorted(self.keys, base + np.minimum(far + radius, BITS), "right")
            span = np.maximum(high - low, 0)
            q = np.repeat(q, span)
            within = np.arange(span.sum()) - np.repeat(span.cumsum() - span, span)
            node = self.order[np.repeat(low, span) + within]
        return np.concatenate(out_q), np.concatenate(out_n)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Those links that join parts which the ones before haven't joined."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            up[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def _bits(fp: Column, first: int, count: int) -> Column:
    return F.call_function("shiftrightunsigned", fp, F.lit(first)).bitwiseAND(F.lit((1 << count) - 1).cast("long"))


def _blocks(parts: int) -> list[tuple[int, int]]:
    """(first bit, bits) of `parts` blocks."""
    cuts = [BITS * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in pairwise(cuts)]


def scheme(count: int, radius: int) -> tuple[int, int]:
    """(blocks, equal): fingerprints within the radius agree on `equal` of so many blocks.

    The fewest combinations whose agreeing bits tell `count` fingerprints apart, but for a
    factor of eight; with more fingerprints the shards get more bits, not more members.
    """
    need = max(1.0, log2(max(2, count)) - 3)
    usable = [(m, m - radius) for m in range(radius + 1, min(BITS, radius + 33) + 1) if BITS * (m - radius) / m >= need]
    return min(usable or [(min(BITS, radius + 33), min(BITS, radius + 33) - radius)], key=lambda x: comb(*x))


#: Rows of whole shards that are searched together.
_TOGETHER = 32_768
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _search_shards(rows: pa.Table, radius: int) -> pa.RecordBatch:
    keys, fps = rows["key"].to_numpy(), rows["fp"].to_numpy()
    shard = np.unique(keys, return_inverse=True)[1]
    tree, ask = (np.flatnonzero(rows[c].to_numpy(zero_copy_only=False)) for c in ("in_tree", "in_query"))
    tree = tree[shard[tree].argsort(kind="stable")]
    index = BkTrees(fps[tree].view(np.uint64), shard[tree])
    found: list[tuple[int, int]] = []
    for i in range(0, len(ask), 512):
        part = ask[i : i + 512]
        q, n = index.search(fps[part].view(np.uint64), shard[part], radius)
        a, b = fps[part][q], fps[tree][n]
        other = a != b
        found += _forest(a[other], b[other])
    if found:
        both = np.array(found, np.int64)
        found = _forest(both[:, 0], both[:, 1])
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], schema=_LINK)


def _shard_links(radius: int):
    """Links within each shard of partitions sorted by shard, or between its tree
    block and its query block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= _TOGETHER:
                rows = pa.Table.from_batches(held)
                keys = rows["key"].to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))  # the last shard may go on
                if cut:
                    yield _search_shards(rows.slice(0, cut), radius)
                    held, size = rows.slice(cut).to_batches(), size - cut
        if size:
            yield _search_shards(pa.Table.from_batches(held), radius)

    return run


def links(nodes: DataFrame, radius: int, shard: int = SHARD) -> DataFrame:
    """(a, b): links that span the same components as all pairs within the radius.

    `nodes` has distinct fingerprints in a column fp.
    """
    fp = F.col("fp")
    parts, equal = scheme(nodes.count(), radius)
    blocks = _blocks(parts)
    ways = [*combinations(range(parts), equal)]
    keys = F.array(*[F.struct(F.lit(w).alias("way"), F.xxhash64(F.lit(w), *[_bits(fp, *blocks[i]) for i in way]).alias("key")) for w, way in enumerate(ways)])
    keyed = nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.key", "k.way")
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = written(keyed.join(counts, "key").select("fp", "key", "way", "n"), "shards")  # a hot key is split by the skew join
    cold = met.filter(F.col("n") <= shard).select("fp", "key")
    # the other blocks' bits differ in at most `radius` places: dealt to radius + 1 groups of bits, one group is equal
    again = F.lit(None).cast("array<bigint>")
    for w, way in enumerate(ways):
        halves = [h for i, (s, c) in enumerate(blocks) if i not in way for h in ((s, c // 2), (s + c // 2, c - c // 2))]
        groups = [halves[j :: radius + 1] for j in range(radius + 1)]
        more = F.array(*[F.xxhash64("key", F.lit(j), *[_bits(fp, *h) for h in g]) for j, g in enumerate(groups)])
        again = F.when(F.col("way") == w, more).otherwise(again)
    spread = met.filter(F.col("n") > shard).select("fp", F.explode(again).alias("key"))
    sizes = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    second = spread.join(sizes, "key")
    small = second.filter(F.col("n") <= shard).select("fp", "key")
    # what is still hot: tree blocks times query blocks, each pair of blocks once
    k = F.ceil(F.col("n") / F.lit(shard // 2)).cast("int")
    large = second.filter(F.col("n") > shard).select("fp", "key", k.alias("k"), F.pmod(F.xxhash64("fp", "key"), k).cast("int").alias("own"))
    pairs = large.select("fp", "key", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    cells = pairs.select(
        "fp",
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"),
        (F.col("own") <= F.col("other")).alias("in_tree"),
        (F.col("own") >= F.col("other")).alias("in_query"),
    )
    whole = cold.unionByName(small).select("fp", "key", F.lit(True).alias("in_tree"), F.lit(True).alias("in_query"))
    dealt = whole.unionByName(cells).repartition(shuffle_partitions(nodes.sparkSession), "key").sortWithinPartitions("key")
    return dealt.select("fp", "key", "in_tree", "in_query").mapInArrow(_shard_links(radius), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of links over longs, root the smallest.

    Each round links every node's neighbours to the smallest of them, first the
    larger ones, then the smaller ones, until nothing changes; a node that is
    linked to very many is handled by partial minima, never as a list.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_left_join(both, least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large.filter("u <> v"), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = salted_left_join(large, least, "u")
        small = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small = written(small, "small")
        same = (F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        if small.agg(*same).first() == now.agg(*same).first():
            return small.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now = small


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, seed: int = 42, shard: int = SHARD) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id for every row.

    Two rows are linked when their fingerprints differ in at most `radius`
    bits; component_id is the smallest id that can be reached. A null text is
    empty; texts without words have fingerprint zero; a null id is never a
    component's id unless it has no other; repeated rows share a
    component; other columns are ignored; an empty table gives an empty result.
    """
    rows = written(fingerprints(df, id_col, text_col, words, seed), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    member = components(links(nodes.select("fp"), radius, shard))
    rooted = nodes.join(member, nodes["fp"] == member["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id", "least", "n")
    # a class of one row needs no join; equal fingerprints that fill a partition are split by the skew join
    shared = classes.filter("n > 1 OR NOT component_id <=> least").select("fp", "component_id")
    joined = rows.join(shared, "fp", "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
