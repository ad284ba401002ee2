"""The nearest stored place of every coordinate, by exact great-circle distance.

Points on the sphere are put into cubic cells as wide as the largest distance asked for, so whatever is that near to a coordinate
is in one of the 27 cells around it.  Cells are dealt to tasks by hash; a cell with very many places or coordinates is cut
into blocks, and every block of its places meets every block of its coordinates.  Within a task the cells are
cut finer, and the rings around a coordinate grow until nothing outside them can be nearer.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecrew.plans.combine import spread_out
from tidecrew.plans.durable import kept

# Mean radius of the earth in km, and the distance within which a place names a coordinate.
RADIUS = 6371.0088
WITHIN = 25.0
# Places, and coordinates, of a task, about; pairs held at a time.
PLACES = 1 << 15
POINTS = 1 << 16
PAIRS = 1 << 21
# Distances are told apart, and given, to this many decimals of a km.
DECIMALS = 6
CELL = ["_x", "_y", "_z"]


def _sound(df: DataFrame) -> DataFrame:
    """Rows with a place on the globe; one of two equal numbers that differ in the sign of zero."""
    found = F.col("latitude").between(-90, 90) & F.col("longitude").between(-360, 360)
    return df.filter(found).withColumns({c: F.col(c).cast("double") + F.lit(0.0) for c in ("latitude", "longitude")})


def _with_cell(df: DataFrame, edge: float) -> DataFrame:
    lat, lon = F.radians("latitude"), F.radians("longitude")
    axes = (F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))
    return df.withColumns({c: F.floor(axis * (RADIUS / edge)).cast("long") for c, axis in zip(CELL, axes, strict=True)})


def _around() -> Column:
    """A cell and the 26 around it."""
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    triples = F.flatten(
        F.transform(steps, lambda i: F.flatten(F.transform(steps, lambda j: F.transform(steps, lambda k: F.struct(
            (F.col("_x") + i).alias("_x"), (F.col("_y") + j).alias("_y"), (F.col("_z") + k).alias("_z"))))))
    )
    return F.explode(triples)


def _on_sphere(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    lat, lon = np.radians(lat), np.radians(lon)
    return RADIUS * np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)


def distance(lat: np.ndarray, lon: np.ndarray, other_lat: np.ndarray, other_lon: np.ndarray) -> np.ndarray:
    """Great-circle distances in km."""
    lat, lon, other_lat, other_lon = (np.radians(x) for x in (lat, lon, other_lat, other_lon))
    half = np.sin((other_lat - lat) / 2) ** 2 + np.cos(lat) * np.cos(other_lat) * np.sin((other_lon - lon) / 2) ** 2
    return np.round(2 * RADIUS * np.arcsin(np.minimum(1.0, np.sqrt(half))), DECIMALS)


def _keys(cells: np.ndarray) -> np.ndarray:
    """One number per cell; cells of a task may share one, which only means more to compare."""
    x, y, z = (cells[:, i].astype(np.uint64) for i in range(3))
    with np.errstate(over="ignore"):
        return x * np.uint64(0x9E3779B97F4A7C15) + y * np.uint64(0xC2B2AE3D27D4EB4F) + z * np.uint64(0x165667B19E3779F9)


def nearest_of(points: np.ndarray, places: np.ndarray, rank: np.ndarray, within: float) -> tuple[np.ndarray, np.ndarray]:
    """(distance, place) of the nearest place of every point; of equally near ones that of the lowest rank; infinity and -1 if none.

    ``points`` and ``places`` are rows of (latitude, longitude).
    """
    best, found = np.full(len(points), np.inf), np.full(len(points), -1, dtype=np.int64)
    if not len(points) or not len(places):
        return best, found
    where, spots = _on_sphere(*points.T), _on_sphere(*places.T)
    finest = max(0, min(10, int(math.log2(math.sqrt(len(places))))))
    offsets = np.stack(np.meshgrid(*[[-1, 0, 1]] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    left = np.arange(len(points))
    for level in range(finest, -1, -1):
        edge = within * 1.000001 / (1 << level)
        keys = _keys(np.floor(spots / edge).astype(np.int64))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        around = np.floor(where[left] / edge).astype(np.int64)[:, None, :] + offsets
        wanted = _keys(around.reshape(-1, 3))
        start, end = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
        sizes = (end - start).reshape(len(left), 27)
        start = start.reshape(len(left), 27)
        total = np.concatenate([[0], np.cumsum(sizes.sum(axis=1))])
        at = 0
        while at < len(left):
            stop = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
            n = sizes[at:stop].ravel()
            before = np.cumsum(n) - n
            place = order[np.arange(int(n.sum())) - np.repeat(before - start[at:stop].ravel(), n)]
            point = left[np.repeat(np.arange(at, stop), sizes[at:stop].sum(axis=1))]
            km = distance(*points[point].T, *places[place].T)
            first = np.lexsort((rank[place], km, point))
            chosen = first[np.concatenate([[True], point[first][1:] != point[first][:-1]])] if len(first) else first
            chosen = chosen[km[chosen] <= within]
            best[point[chosen]], found[point[chosen]] = km[chosen], place[chosen]
            at = stop
        left = left[best[left] > edge - 10.0**-DECIMALS]
    return best, found


def _search(left: pa.Table, right: pa.Table, within: float) -> pa.Table:
    points = np.stack([left.column(c).to_numpy() for c in ("latitude", "longitude")], axis=1)
    points = np.unique(points, axis=0)
    places = np.stack([right.column(c).to_numpy() for c in ("latitude", "longitude")], axis=1)
    names = right.column("display_name").to_pylist()
    place = {name: i for i, name in enumerate(sorted(set(names)))}
    km, found = nearest_of(points, places, np.array([place[n] for n in names], dtype=np.int64), within)
    some = np.flatnonzero(found >= 0)
    return pa.table(
        {
            "latitude": points[some, 0],
            "longitude": points[some, 1],
            "distance_km": km[some],
            "display_name": pa.array([names[i] for i in found[some].tolist()], pa.string()),
        }
    )


def nearest_places(points: DataFrame, places: DataFrame, within: float = WITHIN) -> DataFrame:
    """(latitude, longitude, display_name, distance_km): a row for every different coordinate of ``points``.

    Both tables have ``latitude`` and ``longitude``.  The name is NULL if no place is within that many km, or the coordinate
    is not on the globe; coordinates with a NULL have no row, places without a name name nothing.  Among equally near places the
    first name in order counts.
    """
    asked = kept(points.select(*[F.col(c).cast("double") + F.lit(0.0) for c in ("latitude", "longitude")]).toDF("latitude", "longitude").na.drop().distinct(), "points")
    named = _sound(places.filter("display_name is not null")).groupBy("latitude", "longitude").agg(F.min("display_name").alias("display_name"))
    stood = kept(_with_cell(named, within), "places")
    counted = kept(stood.groupBy(*CELL).agg(F.count(F.lit(1)).alias("places")), "cells")
    near = _with_cell(_sound(asked), within).select("latitude", "longitude", _around().alias("_cell")).select("latitude", "longitude", "_cell.*")
    near = kept(near.join(counted.select(*CELL), CELL, "left_semi"), "near")
    cells = near.groupBy(*CELL).agg(F.count(F.lit(1)).alias("points")).join(counted, CELL)
    # Small cells are put together by hash, so that tasks are neither many nor large.
    whole = counted.agg(F.coalesce(F.sum("places"), F.lit(0))).first()[0] + near.count()
    tasks = max(asked.sparkSession.sparkContext.defaultParallelism, -(-whole // POINTS))
    blocks = lambda n, size: F.ceil(F.col(n) / size).cast("long")
    cells = kept(cells.select(*CELL, blocks("places", PLACES).alias("_pb"), blocks("points", POINTS).alias("_cb")), "cells")
    bucket = F.pmod(F.xxhash64(*CELL), F.lit(tasks))

    def dealt(df: DataFrame, own: str, others: str, key) -> DataFrame:
        block = F.pmod(F.xxhash64("latitude", "longitude"), F.col(own))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1)).alias("_other")
        rows = df.join(cells, CELL).select(*df.columns, block.alias("_own"), other)
        # A cell in one piece goes by its bucket alone.
        task = (bucket * (1 << 20) + key(F.col("_own"), F.col("_other"))[0]) * (1 << 20) + key(F.col("_own"), F.col("_other"))[1]
        return spread_out(rows.withColumn("_task", task).drop("_own", "_other", *CELL), "_task")

    left = dealt(near, "_cb", "_pb", lambda own, other: (other, own))
    right = dealt(stood, "_pb", "_cb", lambda own, other: (own, other))
    found = left.groupBy("_task").cogroup(right.groupBy("_task")).applyInArrow(
        lambda a, b: _search(a, b, within), "latitude double, longitude double, distance_km double, display_name string"
    )
    answer = F.struct("distance_km", "display_name")
    rows = found.select("latitude", "longitude", answer.alias("answer")).unionByName(
        asked.select("latitude", "longitude", F.lit(None).cast("struct<distance_km: double, display_name: string>").alias("answer"))
    )
    best = rows.groupBy("latitude", "longitude").agg(F.min("answer").alias("answer"))
    return best.select("latitude", "longitude", "answer.display_name", "answer.distance_km")
