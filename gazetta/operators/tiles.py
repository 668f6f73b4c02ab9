"""Sums over all pairs of points within a radius, without a row for each pair.

Every point goes to the tiles around it, and a tile's points meet those in Arrow batches:
points that are too far from a block of the tile's points are passed over, and the rest are measured pair by
pair as matrices. Nothing is left out; a tile of very many points is dealt into
parts, and what they meet is read as a stream in the order of ids, in which it is added up,
so that sums don't depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetta.functions import geo

#: Points of a tile that are held at once, points that they meet at once, points of a block and rows of a matrix.
_PART, _STREAM, _BLOCK, _ROWS = 8192, 16384, 128, 512


class Counts:
    """Points within each of some radii on the globe."""

    def __init__(self, radii_km: tuple[float, ...]):
        self.radii = tuple(map(float, radii_km))
        self.reaches = [2 * np.sin(min(r / (2 * geo.EARTH_KM), pi / 2)) for r in self.radii]
        self.columns, self.kind = len(self.radii), "long"

    def place(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        x, y = np.radians(lon), np.radians(lat)
        return np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)], axis=1)

    def meet(self, t: Points, s: Points, away: np.ndarray, spread: float, sums: np.ndarray) -> None:
        """Adds what the points s, so far away from the middle of t, give to the sums of t."""
        for k, reach in enumerate(self.reaches):
            inside = away <= reach - spread
            sums[:, k] += np.count_nonzero(inside)
            for rows in _matrices(~inside & (away <= reach + spread)):
                sums[:, k] += self.within(k, t, s.of(rows))

    def within(self, k: int, t: Points, s: Points) -> np.ndarray:
        """By dot products; pairs too close to the radius for their last digits are measured as elsewhere."""
        dots, least, band = s.at @ t.at.T, 1 - self.reaches[k] ** 2 / 2, 4e-15
        sure = dots >= least + band
        out = sure.sum(axis=0, dtype=np.int32)
        if np.count_nonzero(dots >= least - band) > np.count_nonzero(sure):
            j, i = np.nonzero((dots >= least - band) & ~sure)
            np.add.at(out, i[_haversine_km(t.lon[i], t.lat[i], s.lon[j], s.lat[j]) <= self.radii[k]], 1)
        return out


class Gaussian:
    """A Gaussian kernel on the plane of degrees, cut off at a radius."""

    def __init__(self, bandwidth_km: float, radius_km: float):
        self.h, self.radius = bandwidth_km / geo.DEGREE_KM, radius_km
        self.reaches = [radius_km / geo.DEGREE_KM]
        self.columns, self.kind = 1, "double"

    def place(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        return np.stack([lon, lat], axis=1)

    def meet(self, t: Points, s: Points, away: np.ndarray, spread: float, sums: np.ndarray) -> None:
        """Adds the weights of the points s to the sums of t, one after another."""
        for rows in _matrices(away <= self.reaches[0] + spread):
            x = s.lon[rows][:, None] - t.lon
            y = s.lat[rows][:, None] - t.lat
            x *= x
            y *= y
            x += y
            km = np.sqrt(x, out=x)
            km *= geo.DEGREE_KM
            near = km <= self.radius
            degrees = np.divide(km, geo.DEGREE_KM, out=y)
            degrees *= degrees
            degrees /= -(2 * (self.h * self.h))
            weights = np.exp(degrees, out=degrees)
            weights *= near
            weights[0] += sums[:, 0]
            sums[:, 0] = np.add.reduce(weights, axis=0)  # row by row


def _matrices(chosen: np.ndarray) -> Iterator[np.ndarray]:
    rows = np.flatnonzero(chosen)
    return (rows[a : a + _ROWS] for a in range(0, len(rows), _ROWS))


def _haversine_km(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    dlat, dlon = np.radians(lat2 - lat1) / 2, np.radians(lon2 - lon1) / 2
    h = np.sin(dlat) * np.sin(dlat) + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(dlon) * np.sin(dlon)
    return 2 * geo.EARTH_KM * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


class Points:
    """Coordinates and places."""

    def __init__(self, lon: np.ndarray, lat: np.ndarray, at: np.ndarray):
        self.lon, self.lat, self.at = lon, lat, at

    def of(self, rows) -> Points:
        return Points(self.lon[rows], self.lat[rows], self.at[rows])


def _meet(kernel, targets: Points, sources: Points, sums: np.ndarray) -> None:
    """Adds to the targets' sums what the sources give, block by block of the targets."""
    for start in range(0, len(targets.lon), _BLOCK):
        rows = slice(start, start + _BLOCK)
        t = targets.of(rows)
        middle = t.at.mean(axis=0)
        spread = np.sqrt(((t.at - middle) ** 2).sum(axis=1)).max() + 1e-9
        kernel.meet(t, sources, np.sqrt(((sources.at - middle) ** 2).sum(axis=1)), spread, sums[rows])


def pair_sums(points: DataFrame, kernel, width: float, height: float, columns: int, names: list[str]) -> DataFrame:
    """id and the kernel's sums over all points within its reach, itself included; rows without both coordinates have none.

    Tiles of `width` and `height` degrees must be at least as wide as the reach; with `columns` they meet
    around the globe, 0 is a plane.
    """
    lon, lat = F.col("lon"), F.col("lat")
    known = points.filter("lon IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat)")

    def around(i: Column) -> Column:
        return F.pmod(i, F.lit(columns)) if columns else i

    placed = known.select("id", lon.cast("double").alias("lon"), lat.cast("double").alias("lat"), around(geo.cell(lon, width)).alias("i"), geo.cell(lat, height).alias("j"))
    fine = (geo.cell(lon, width / 8), geo.cell(lat, height / 8))
    tiles = placed.groupBy("i", "j").agg(F.ceil(F.count(F.lit(1)) / _PART).cast("int").alias("parts"))
    steps = [(di, dj) for di in ((0,) if 0 < columns < 3 else (-1, 0, 1)) for dj in (-1, 0, 1)]
    to = F.explode(F.array(*[F.struct(around(F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), F.struct("i", "j", "parts").alias("tile")) for di, dj in steps]))
    met = tiles.select(to.alias("x")).select("x.*").groupBy("i", "j").agg(F.collect_list("tile").alias("tiles"))  # nine at most
    sources = placed.join(met, ["i", "j"]).select("id", "lon", "lat", F.explode("tiles").alias("t"))
    sources = sources.select("id", "lon", "lat", "t.i", "t.j", F.explode(F.sequence(F.lit(0), F.col("t.parts") - 1)).alias("part"), F.lit(1).alias("source"))
    targets = placed.join(tiles, ["i", "j"]).select("id", "lon", "lat", "i", "j", F.pmod(F.xxhash64("id", "lon", "lat"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("source"))
    places = [F.when(F.col("source") == 0, c) for c in fine]  # a tile's own points by place, so that blocks are compact, the others by id
    rows = targets.unionByName(sources).repartition("i", "j", "part").sortWithinPartitions("i", "j", "part", "source", *places, "id", "lon", "lat")
    schema = points.select("id").schema
    for name in names:
        schema = schema.add(name, kernel.kind)
    return rows.mapInArrow(lambda batches: _sums(batches, kernel, names), schema)


def _sums(batches: Iterator[pa.RecordBatch], kernel, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows come by tile, its points first, then what they meet."""
    now, ids, held, targets, sums = None, [], [], None, None
    waiting = 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        out = tuple(np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        return out

    def flush() -> None:
        nonlocal targets, sums, waiting
        if targets is None:
            lon, lat = joined()
            targets = Points(lon, lat, kernel.place(lon, lat))
            sums = np.zeros((len(lon), kernel.columns), np.int64 if kernel.kind == "long" else np.float64)
        elif held:
            lon, lat = joined()
            _meet(kernel, targets, Points(lon, lat, kernel.place(lon, lat)), sums)
        waiting = 0

    def result() -> Iterator[pa.RecordBatch]:
        flush()
        at = 0
        for x in ids:
            yield pa.RecordBatch.from_arrays([x, *[pa.array(sums[at : at + len(x), k]) for k in range(kernel.columns)]], names=["id", *names])
            at += len(x)

    for batch in batches:
        keys = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("i", "j", "part", "source")], axis=1)
        lon, lat = (batch[c].to_numpy(zero_copy_only=False) for c in ("lon", "lat"))
        ends = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
        for a, z in zip(ends[:-1], ends[1:], strict=True):
            if a == z:
                continue
            *tile, source = keys[a].tolist()
            if tile != now:
                if now is not None:
                    yield from result()
                now, ids, targets = tile, [], None
                held.clear()
            if source and targets is None:
                flush()
            if not source:
                ids.append(batch["id"].slice(a, z - a))
            held.append((lon[a:z], lat[a:z]))
            waiting += z - a
            if source and waiting >= _STREAM:
                flush()
    if now is not None:
        yield from result()
