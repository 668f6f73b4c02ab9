"""Sums over pairs by tiles against all pairs, written out."""

import math
import random

import pyarrow as pa
import pytest

from gazetta.operators import spatial, tiles


def clumped(n, seed=3, lat=22.0):
    """Points in clumps, copies, points on tile borders and far ones."""
    rng = random.Random(seed)
    out = [(rng.gauss(110 + i % 3, 0.2), rng.gauss(lat, 0.2)) for i in range(n)]
    out += [(110.0, lat)] * 5 + [(-170.0, -lat), (0.0, 0.0)]
    return [(i, float(x), float(y)) for i, (x, y) in enumerate(out)]


def planar(a, b):
    return 111.0 * math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2)


def no_pairs(*args, **kwargs):
    raise AssertionError("a row for each pair")


def test_kernel_density_without_a_row_for_each_pair(spark, monkeypatch):
    monkeypatch.setattr(spatial, "neighbours", no_pairs)
    rows = clumped(600)
    odd = [(9000, None, 22.0), (9001, 110.0, None), (9002, float("nan"), 22.0)]
    points = spark.createDataFrame(rows + odd, "id long, lon double, lat double")
    got = {r["id"]: r["density_score"] for r in spatial.kde(points, 5.0).collect()}
    h = 5.0 / 111.0
    assert set(got) == {r[0] for r in rows}
    for a in rows:
        near = [d for b in rows if (d := planar(a, b)) <= 20.0]
        want = sum(math.exp(-((d / 111.0) ** 2) / (2 * h * h)) for d in near) / (2 * math.pi * h * h * len(rows + odd))
        assert got[a[0]] == pytest.approx(want, rel=1e-12)


def globe(a, b):
    x1, y1, x2, y2 = map(math.radians, (*a[1:], *b[1:]))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


@pytest.mark.parametrize(("lat", "radii"), [(22.0, (2, 5, 10)), (-89.9, (1, 30)), (50.0, (20, 9000))])
def test_density_without_a_row_for_each_pair(spark, monkeypatch, lat, radii):
    """At any latitude, across the 180th meridian, and where all longitudes are one tile."""
    monkeypatch.setattr(spatial, "neighbours", no_pairs)
    rows = [(i, x, max(-90.0, min(90.0, y))) for i, x, y in clumped(150, lat=lat)]
    rows += [(5000 + i, x, lat) for i, x in enumerate((179.99, -179.99, 180.0, -180.0))]
    points = spark.createDataFrame([*rows, (9000, None, 22.0), (9001, 110.0, float("nan"))], "id long, lon double, lat double")
    got = {r["id"]: tuple(r[f"density_{k}km"] for k in radii) for r in spatial.density(points, radii).collect()}
    assert got.pop(9000) == got.pop(9001) == (0,) * len(radii)
    assert got == {a[0]: tuple(sum(globe(a, b) <= k for b in rows) - 1 for k in radii) for a in rows}


def test_points_on_the_edge_of_the_kernel_count(spark):
    points = spark.createDataFrame([(0, 1.0, 1.0), (1, 1.0, 3.0), (2, 1.0, 3.0000001)], "id int, lon double, lat double")
    got = {r["id"]: r["density_score"] for r in spatial.kde(points, 55.5).collect()}  # 222 km: two degrees
    scale = 2 * math.pi * 0.5**2 * 3
    assert got[0] * scale == pytest.approx(1 + math.exp(-8), rel=1e-12)
    assert got[1] * scale == pytest.approx(2 + math.exp(-8), rel=1e-12)


def test_tiles_in_parts_and_streams(monkeypatch):
    """A tile that is met in many pieces of small batches gives the same sums."""
    monkeypatch.setattr(tiles, "_STREAM", 50)
    monkeypatch.setattr(tiles, "_BLOCK", 8)
    monkeypatch.setattr(tiles, "_ROWS", 16)
    rows = sorted(clumped(150)[:150], key=lambda r: r[1])
    table = [(r[0], r[1], r[2], 1, 2, 0, 0) for r in rows] + [(None, r[1], r[2], 1, 2, 0, 1) for r in rows]
    table += [(7, 5.0, 5.0, 9, 9, 0, 0)]
    names = ["id", "lon", "lat", "i", "j", "part", "source"]
    batches = [pa.RecordBatch.from_arrays([*map(pa.array, zip(*table[a : a + 37], strict=True))], names=names) for a in range(0, len(table), 37)]
    out = [r for b in tiles._sums(iter(batches), tiles.Gaussian(5.0, 20.0), ["s"]) for r in b.to_pylist()]
    assert [r["id"] for r in out] == [r[0] for r in rows] + [7]
    for a, r in zip(rows, out, strict=False):
        want = sum(math.exp(-((d / 5.0) ** 2) / 2) for b in rows if (d := planar(a, b)) <= 20.0)
        assert r["s"] == pytest.approx(want, rel=1e-12)
    assert out[-1]["s"] == 0.0


def test_weights_are_added_in_the_order_of_ids(spark):
    """To the last bit, however the rows are dealt: points of equal density lie on the percentile, and SQL adds by row."""
    rows = [(k, 109.67 + ((k * 7919) % 7640) / 1000.0, 20.23 + ((k * 104729) % 5370) / 1000.0) for k in range(400)]
    points = spark.createDataFrame(rows, "id long, lon double, lat double")
    h = 15.0 / 111.0
    found = [{r["id"]: r["density_score"] for r in spatial.kde(p, 15.0).collect()} for p in (points, points.repartition(7, "lat"))]
    assert found[0] == found[1]
    same = 0
    for a in rows:
        total = 0.0
        for b in rows:
            d = planar(a, b)
            if d <= 60.0:
                total += math.exp(-((d / 111.0) ** 2) / (2 * (h * h)))
        same += found[0][a[0]] == total / (2 * 3.141592653589793 * h * h * 400)
    assert same >= 390  # the exponential's own last bit may differ
