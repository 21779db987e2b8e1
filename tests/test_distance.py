"""Distance joins on places that repeat, against plain loops."""

import math
import random

import pytest

from ledgerline.operators import geo

SCHEMA = "id long, lat double, lon double, kind string"


def km(a, b):
    (y1, x1), (y2, x2) = ((math.radians(p[1]), math.radians(p[2])) for p in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))


def crowd(seed, n):
    """Places on a coarse grid, so that many rows share one; some ids and one position are null, some ids repeat."""
    rng = random.Random(seed)
    rows = [(rng.randrange(n), 48 + rng.randrange(12) * 0.05, 20 + rng.randrange(12) * 0.07, rng.choice("ab")) for _ in range(n)]
    return [*rows, (None, 48.0, 20.0, "a"), (n + 1, None, 20.0, "a")]


@pytest.mark.parametrize("block", [2, 256])
def test_pairs_and_nearest_of_repeated_places(spark, monkeypatch, block):
    monkeypatch.setattr(geo, "BLOCK", block)
    left, right = crowd(1, 150), crowd(2, 90)
    a, b = (spark.createDataFrame(rows, SCHEMA).repartition(3) for rows in (left, right))
    there = lambda rows: [r for r in rows if r[1] is not None]
    met = [(p, q) for p in there(left) for q in there(left) if p[0] is not None and q[0] is not None and p[0] < q[0] and km(p, q) <= 9]
    got = geo.near_pairs(a, a, 0.15, 9, same=True, carry=["kind"]).collect()
    assert sorted((r.left_id, r.right_id, r.left_kind, r.right_kind) for r in got) == sorted((p[0], q[0], p[3], q[3]) for p, q in met)
    two = [(p, q) for p in there(left) for q in there(right) if km(p, q) <= 9]
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r.left_id, r.right_id) for r in geo.near_pairs(a, b, 0.15, 9).collect()), key=key) == sorted(((p[0], q[0]) for p, q in two), key=key)
    best = {}
    for p, q in two:
        if q[0] is not None and p[0] is not None:  # null ids are left out below
            best.setdefault(p[0], []).append((round(km(p, q), 6), q[0]))
    near = {}
    for r in geo.nearest(a.where("id IS NOT NULL"), b.where("id IS NOT NULL"), 0.15, 9, 3).orderBy("left_id", "place").collect():
        near.setdefault(r.left_id, []).append((round(r.km, 6), r.right_id))
    assert near == {i: sorted(rows)[:3] for i, rows in best.items()}


def test_rows_of_one_place_meet_once(spark):
    rows = spark.range(400).selectExpr("id", "48.0 + id % 2 * 0.01 AS lat", "20.0D AS lon", "'a' AS kind")
    assert geo.near_blocks(rows, rows, 0.5, 20, same=True).count() == 3
    assert geo.near_pairs(rows, rows, 0.5, 20, same=True).count() == 400 * 399 // 2
