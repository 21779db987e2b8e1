"""Distance joins by grid cells, lines and polygons."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.scalars import haversine_km
from ledgerline.plans.scratch import materialize


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


#: Ids of one place in a row at most, and kilometres of a degree of latitude, rounded down.
BLOCK, DEGREE_KM = 256, 111.19


def place_blocks(places: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``block, lat, lon, ids`` and the carried columns: rows that agree in all but their id are one row, cut at ``BLOCK`` ids."""
    same = ["lat", "lon", *(carry or [])]
    place = F.row_number().over(Window.partitionBy(*same).orderBy("id"))
    rows = places.select("id", *same).withColumn("part", F.floor((place - 1) / BLOCK))
    ids = F.transform(F.collect_list(F.struct("id")), lambda x: x["id"])  # null ids stay
    blocks = rows.groupBy(*same, "part").agg(ids.alias("ids"))
    return materialize(blocks.drop("part").withColumn("block", F.monotonically_increasing_id()), "place-blocks")


def near_blocks(left: DataFrame, right: DataFrame, cell: float, max_km: float, same: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Pairs of blocks within a distance: ``left_block, left_ids, right_ids, km, one`` and the carried columns as ``left_*`` and ``right_*``.

    One side is put in all cells in reach, half as wide as that, then an equality join; a self join goes forward only, so that a
    pair of blocks is met once and ``one`` tells a block met with itself.  A cell must be at least ``max_km`` wide in both directions.
    The number of partitions is given, as pairs are many more than what Spark sees of the two tables.
    """
    reach = max_km / DEGREE_KM
    cells = lambda: [_cell(F.col("lat"), reach / 2).alias("cy"), _cell(F.col("lon"), cell / 2).alias("cx")]
    steps = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if not same or (dy, dx) >= (0, 0)]
    side = lambda rows, s, n: rows.select(F.col("block").alias(f"{s}_block"), F.col("ids").alias(f"{s}_ids"), F.col("lat").alias(f"lat{n}"), F.col("lon").alias(f"lon{n}"), *[F.col(c).alias(f"{s}_{c}") for c in carry or []], *cells())
    blocks = place_blocks(left, carry)
    a, b = side(blocks, "left", 1), side(blocks if same else place_blocks(right, carry), "right", 2)
    a = a.withColumn("step", F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps])))
    a = a.withColumns({"cy": F.col("cy") + F.col("step.dy"), "cx": F.col("cx") + F.col("step.dx"), "_here": (F.col("step.dy") == 0) & (F.col("step.dx") == 0)}).drop("step")
    context = left.sparkSession.sparkContext
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * context.defaultParallelism)
    pairs = a.repartition(parts, "cy", "cx").join(b.repartition(parts, "cy", "cx"), ["cy", "cx"]).where(F.abs(F.col("lat1") - F.col("lat2")) <= reach)
    if same:
        pairs = pairs.where("NOT _here OR left_block <= right_block")
    pairs = pairs.withColumn("km", haversine_km("lat1", "lon1", "lat2", "lon2")).where(F.col("km") <= max_km)
    one = F.col("left_block") == F.col("right_block") if same else F.lit(False)
    return pairs.select("left_block", "left_ids", "right_ids", "km", one.alias("one"), *[f"{s}_{c}" for c in carry or [] for s in ("left", "right")])


def spread_pairs(blocks: DataFrame, columns: list[str], same: bool = False, carry: list[str] | None = None) -> DataFrame:
    """``left_id, right_id``, the columns of the pair and the carried ones of each side; of a self join each pair once, by id."""
    carry = carry or []
    two = blocks.withColumn("a", F.explode("left_ids")).withColumn("b", F.explode("right_ids"))
    if not same:
        return two.select(F.col("a").alias("left_id"), F.col("b").alias("right_id"), *columns, *[f"{s}_{c}" for c in carry for s in ("left", "right")])
    two = two.where("CASE WHEN one THEN a < b ELSE a <> b END")
    first = F.col("a") < F.col("b")
    sides = [F.when(first, F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}")).alias(f"{x}_{c}") for c in carry for x, y in (("left", "right"), ("right", "left"))]
    return two.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), *columns, *sides)


def near_pairs(left: DataFrame, right: DataFrame, cell: float, max_km: float, same: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Pairs ``left_id, right_id, km`` within a distance, and the carried columns of both sides; ``same``: a self join, each pair once."""
    return spread_pairs(near_blocks(left, right, cell, max_km, same, carry), ["km"], same, carry)


def nearest(left: DataFrame, right: DataFrame, cell: float, max_km: float, count: int = 1) -> DataFrame:
    """The nearest rows of ``right`` for each row of ``left`` within a distance.

    Rows of one place have the same nearest ones, so a place is ranked once and then its rows, whose ids may repeat; of a place
    of ``right`` the least ids are enough.
    """
    first = lambda rows, key: rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.round("km", 6), F.asc_nulls_last("right_id")))).where(F.col("place") <= count)
    blocks = near_blocks(left, right, cell, max_km)
    few = first(blocks.select("left_block", "left_ids", "km", F.explode(F.slice(F.array_sort("right_ids"), 1, count)).alias("right_id")), "left_block")
    return first(few.select(F.explode("left_ids").alias("left_id"), "right_id", "km"), "left_id")


def snap(left: DataFrame, right: DataFrame, first_km: float, last_km: float, degrees_per_km: float = 1 / 60) -> DataFrame:
    """The nearest row of ``right``, searched in rings that double until ``last_km``; only rows not yet placed go on."""
    found, open_rows, km = None, left, first_km
    while True:
        hit = nearest(open_rows, right, km * degrees_per_km, km)
        found = hit if found is None else found.unionByName(hit)
        if km >= last_km:
            return found.drop("place")
        open_rows = open_rows.join(hit.select(F.col("left_id").alias("id")), "id", "left_anti")
        km = min(last_km, 2 * km)


def inside_polygons(points: DataFrame, corners: DataFrame, cell: float = 1.0) -> DataFrame:
    """Pairs ``id, polygon`` by ray casting; ``corners`` holds ``polygon, seq, lat, lon`` of open rings.

    Boxes of polygons are spread over cells for the join; crossings are counted per pair.
    """
    ring = Window.partitionBy("polygon").orderBy("seq")
    whole = Window.partitionBy("polygon")
    first = F.min_by(F.struct("lat", "lon"), "seq").over(whole)
    edges = corners.withColumn("n", F.coalesce(F.lead(F.struct("lat", "lon")).over(ring), first)).select("polygon", F.col("lat").alias("y1"), F.col("lon").alias("x1"), F.col("n.lat").alias("y2"), F.col("n.lon").alias("x2"))
    boxes = corners.groupBy("polygon").agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("low", F.min), ("high", F.max))])
    cells = boxes.withColumn("cy", F.explode(F.sequence(_cell(F.col("low_lat"), cell), _cell(F.col("high_lat"), cell)))).withColumn("cx", F.explode(F.sequence(_cell(F.col("low_lon"), cell), _cell(F.col("high_lon"), cell))))
    p = points.select("id", "lat", "lon", _cell(F.col("lat"), cell).alias("cy"), _cell(F.col("lon"), cell).alias("cx"))
    near = p.join(cells, ["cy", "cx"]).where("lat BETWEEN low_lat AND high_lat AND lon BETWEEN low_lon AND high_lon").select("id", "lat", "lon", "polygon")
    crossed = (F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))
    east = F.col("lon") < (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / F.when(F.col("y2") != F.col("y1"), F.col("y2") - F.col("y1")) + F.col("x1")
    hits = near.join(edges, "polygon").where(crossed & east).groupBy("id", "polygon").agg(F.count("*").alias("crossings"))
    return hits.where("crossings % 2 = 1").select("id", "polygon")


def measure(lines: DataFrame) -> DataFrame:
    """Add ``km_at``: the distance along the line up to each point; reads ``route_id, seq, lat, lon``."""
    order = Window.partitionBy("route_id").orderBy("seq")
    step = haversine_km(F.lag("lat").over(order), F.lag("lon").over(order), "lat", "lon")
    rows = lines.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    return rows.withColumn("km_at", F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def interpolate(measured: DataFrame, wanted: DataFrame) -> DataFrame:
    """The point at ``km`` along each wanted route (clamped to the line): ``route_id, km`` to ``lat, lon``."""
    order = Window.partitionBy("route_id").orderBy("seq")
    legs = measured.select("route_id", "seq", "lat", "lon", "km_at", F.lead("lat").over(order).alias("lat2"), F.lead("lon").over(order).alias("lon2"), F.lead("km_at").over(order).alias("km2")).where("km2 IS NOT NULL")
    ends = measured.groupBy("route_id").agg(F.max("km_at").alias("length"))
    at = wanted.join(ends, "route_id").withColumn("at", F.least(F.greatest(F.col("km"), F.lit(0.0)), F.col("length")))
    hit = at.join(legs, "route_id").where("at >= km_at AND at <= km2")
    share = F.when(F.col("km2") > F.col("km_at"), (F.col("at") - F.col("km_at")) / (F.col("km2") - F.col("km_at"))).otherwise(0.0)
    point = F.min_by(F.struct((F.col("lat") + (F.col("lat2") - F.col("lat")) * share).alias("lat"), (F.col("lon") + (F.col("lon2") - F.col("lon")) * share).alias("lon")), "seq")
    return hit.groupBy("route_id", "km").agg(point.alias("p")).select("route_id", "km", "p.lat", "p.lon")


def project(points: DataFrame, measured: DataFrame) -> DataFrame:
    """The nearest place of each point on its route: ``id, route_id`` to ``km_at`` along and ``off_km`` beside the line."""
    order = Window.partitionBy("route_id").orderBy("seq")
    legs = measured.select("route_id", "seq", F.col("lat").alias("y1"), F.col("lon").alias("x1"), "km_at", F.lead("lat").over(order).alias("y2"), F.lead("lon").over(order).alias("x2"), F.lead("km_at").over(order).alias("km2")).where("km2 IS NOT NULL")
    j = points.join(legs, "route_id")
    scale = F.cos(F.radians("lat"))
    dx, dy = (F.col("x2") - F.col("x1")) * scale, F.col("y2") - F.col("y1")
    px, py = (F.col("lon") - F.col("x1")) * scale, F.col("lat") - F.col("y1")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce((px * dx + py * dy) / F.when(dx * dx + dy * dy > 0, dx * dx + dy * dy), F.lit(0.0))))
    off = haversine_km("lat", "lon", F.col("y1") + (F.col("y2") - F.col("y1")) * t, F.col("x1") + (F.col("x2") - F.col("x1")) * t)
    j = j.withColumn("off_km", off).withColumn("along", F.col("km_at") + (F.col("km2") - F.col("km_at")) * t)
    best = F.min_by(F.struct("along", "off_km"), F.struct(F.round("off_km", 9).alias("o"), F.col("seq").alias("s")))
    return j.groupBy("id", "route_id").agg(best.alias("b")).select("id", "route_id", F.col("b.along").alias("km_at"), "b.off_km")


def corridor_side(waypoints: DataFrame, low: Column, high: Column) -> DataFrame:
    """Whether each waypoint lies behind, inside or ahead of a stretch of its route; reads ``km_at``."""
    side = F.when(F.col("km_at") < low, "behind").when(F.col("km_at") > high, "ahead").otherwise("inside")
    return waypoints.withColumn("side", side)


def spaced(rows: DataFrame, key: str, order: str, km: float) -> DataFrame:
    """Rows at least so far after the previous row of the sorted list (not the previous kept one)."""
    before = F.lag(order).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_gap", F.col(order) - before).where(F.col("_gap").isNull() | (F.col("_gap") >= km)).drop("_gap")


def _simplified(tolerance: float):
    def keep(points: np.ndarray) -> np.ndarray:
        kept, stack = np.zeros(len(points), bool), [(0, len(points) - 1)]
        kept[[0, -1]] = True
        while stack:
            a, b = stack.pop()
            if b - a < 2:
                continue
            d = points[b] - points[a]
            rel = points[a + 1 : b] - points[a]
            norm = np.hypot(*d)
            off = np.abs(rel[:, 0] * d[1] - rel[:, 1] * d[0]) / norm if norm else np.hypot(rel[:, 0], rel[:, 1])
            k = int(off.argmax())
            if off[k] > tolerance:
                kept[a + 1 + k] = True
                stack += [(a, a + 1 + k), (a + 1 + k, b)]
        return kept

    def work(line: pd.DataFrame) -> pd.DataFrame:
        line = line.sort_values("seq")
        return line[keep(line[["lon", "lat"]].to_numpy(float))]

    return work


def simplify(lines: DataFrame, tolerance: float) -> DataFrame:
    """Line simplification: drop points nearer than the tolerance (degrees) to the line through those kept.

    Which points stay depends on earlier choices, so each line (a bounded geometry) is handled as a whole.
    """
    return lines.groupBy("route_id").applyInPandas(_simplified(tolerance), lines.schema)


GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash(lat: Column, lon: Column, length: int) -> Column:
    """Interleaved halving of longitude and latitude, five bits a letter, by column arithmetic."""
    bits = 5 * length
    lon_bits, lat_bits = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lon + 180) / 360 * (1 << lon_bits)).cast("long"), F.lit((1 << lon_bits) - 1))
    y = F.least(F.floor((lat + 90) / 180 * (1 << lat_bits)).cast("long"), F.lit((1 << lat_bits) - 1))
    letters = []
    for i in range(length):
        value = F.lit(0).cast("long")
        for k in range(5 * i, 5 * i + 5):
            source, at = (x, lon_bits - 1 - k // 2) if k % 2 == 0 else (y, lat_bits - 1 - k // 2)
            value = value * 2 + F.shiftright(source, at).bitwiseAND(F.lit(1))
        letters.append(F.substr(F.lit(GEOHASH), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)


def grid_clusters(points: DataFrame, cell: float) -> DataFrame:
    """Counts and mean places per map cell; cells are cut towards zero."""
    return points.groupBy((F.col("lat") / cell).cast("int").alias("cy"), (F.col("lon") / cell).cast("int").alias("cx")).agg(F.count("*").alias("places"), F.round(F.avg("lat"), 5).alias("lat"), F.round(F.avg("lon"), 5).alias("lon"))


def slice_routes(measured: DataFrame, low: Column, high: Column) -> DataFrame:
    """The points of each route between two distances, with both cut ends."""
    ends = measured.select("route_id").distinct()
    cuts = interpolate(measured, ends.select("route_id", low.cast("double").alias("km")).unionByName(ends.select("route_id", high.cast("double").alias("km"))))
    inner = measured.where((F.col("km_at") > low) & (F.col("km_at") < high)).select("route_id", F.col("km_at").alias("km"), "lat", "lon")
    return cuts.unionByName(inner)


def station_plan(waypoints: DataFrame, end_at: Column, speed_kph: float, current_km: Column) -> DataFrame:
    """Planned time and state of each waypoint of a route driven at an even pace; reads ``route_id, seq, km_at``."""
    route = Window.partitionBy("route_id")
    total = F.greatest(F.lit(1.0), F.max("km_at").over(route))
    took = total / speed_kph * 3_600_000_000
    planned = F.unix_micros(end_at) - took + F.col("km_at") / total * took
    rows = waypoints.withColumn("planned_us", F.round(planned).cast("long")).withColumn("_ahead", F.col("km_at") >= current_km)
    first = F.min(F.when(F.col("_ahead"), F.struct("km_at", "seq"))).over(route)
    status = F.when(~F.col("_ahead"), "model-passed").when(F.col("seq") == first["seq"], "model-next").otherwise("planned")
    return rows.withColumn("status", status).drop("_ahead")
