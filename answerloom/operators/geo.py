"""Distances on the globe, points in range, nearest points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom import fixed_values as V
from answerloom.plans.staging import cut_lineage

_HALF_ROUND_KM = math.pi * V.EARTH_RADIUS_KM
_WIDEN = 4
_FINER = 8  # cells per reach when places are counted cell by cell
_CROWDED = 4096  # places per cell from which a search starts closer by
_START_KM = 200.0
_LEAST_KM = 0.05


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * V.EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


class _Grid:
    """Bands of latitude cut in cells of about one side length, so that poles need no special care."""

    def __init__(self, km: float) -> None:
        self.reach = math.degrees(km / V.EARTH_RADIUS_KM)
        self.side = min(180.0, self.reach)
        self.reach_rad = km / V.EARTH_RADIUS_KM

    def band(self, lat: Column) -> Column:
        return F.floor((lat + 90) / self.side)

    def cells_in(self, band: Column) -> Column:
        low, high = band * self.side - 90, (band + 1) * self.side - 90
        nearest = F.when((low <= 0) & (high >= 0), 0.0).otherwise(F.least(F.abs(low), F.abs(high)))
        return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(nearest)) / self.side))

    def cell(self, band: Column, lon: Column) -> Column:
        cells = self.cells_in(band)
        return F.pmod(F.floor((lon + 180) * cells / 360), cells)

    def around(self, lat: Column, lon: Column) -> Column:
        """Every (band, cell) that can hold a point within reach."""
        top = F.least(F.lit(90.0), lat + self.reach)
        bottom = F.greatest(F.lit(-90.0), lat - self.reach)
        at_pole = (F.abs(lat) + self.reach >= 90) | F.lit(self.reach >= 90)
        turn = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(self.reach_rad)) / F.cos(F.radians(lat)))))
        half = F.when(at_pole, 180.0).otherwise(F.least(F.lit(180.0), turn + 1e-9))

        def in_band(band: Column) -> Column:
            cells = self.cells_in(band)
            first = F.floor((lon - half + 180) * cells / 360)
            last = F.least(F.floor((lon + half + 180) * cells / 360), first + cells - 1)
            return F.transform(
                F.sequence(first, last),
                lambda c: F.struct(band.alias("band"), F.pmod(c, cells).alias("cell")),
            )

        return F.flatten(F.transform(F.sequence(self.band(bottom), self.band(top)), in_band))


def _near(a: DataFrame, b: DataFrame, km: float) -> DataFrame:
    """Pairs of distinct places within reach: ``(lat, lon, b_lat, b_lon, km, ...)``."""
    grid = _Grid(km)
    left = a.withColumn("__at", F.explode(grid.around(F.col("lat"), F.col("lon"))))
    left = left.select(*a.columns, F.col("__at.band").alias("__band"), F.col("__at.cell").alias("__cell"))
    band = grid.band(F.col("b_lat"))
    right = b.withColumns({"__band": band, "__cell": grid.cell(band, F.col("b_lon"))})
    pairs = left.join(right, ["__band", "__cell"]).drop("__band", "__cell")
    distance = haversine(F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon"))
    return pairs.withColumn("km", distance).where(F.col("km") <= km)


def _places(points: DataFrame, prefix: str, *measures: Column) -> DataFrame:
    """Distinct places: any number of points on one spot is one row."""
    return points.groupBy(F.col("lat").alias(f"{prefix}lat"), F.col("lon").alias(f"{prefix}lon")).agg(*measures)


def within_distance(a: DataFrame, b: DataFrame, km: float) -> DataFrame:
    """``(id, other_id, km)`` of the points of b in range of each point of a."""
    other = b.select(F.col("id").alias("other_id"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    return _near(a.select("id", "lat", "lon"), other, km).select("id", "other_id", "km")


class _Cells(_Grid):
    """Cells as discs: a centre and the distance no point of the cell exceeds."""

    ROUND = 8  # around the poles, with fewer cells to a band, a cell is not near to a disc

    def put(self, places: DataFrame, lat: str, lon: str) -> DataFrame:
        band = self.band(F.col(lat))
        return places.withColumns({"band": band, "cell": self.cell(band, F.col(lon))})

    def discs(self, cells: DataFrame, prefix: str) -> DataFrame:
        in_band = self.cells_in(F.col("band"))
        width = 360 / in_band
        low = F.col("band") * self.side - 90
        high = F.least(F.lit(90.0), low + self.side)
        lat, lon = (low + high) / 2, (F.col("cell") + 0.5) * width - 180
        edge = lon + width / 2
        radius = F.greatest(haversine(lat, lon, low, edge), haversine(lat, lon, high, edge))
        return cells.select(
            F.col("band").alias(f"{prefix}band"),
            F.col("cell").alias(f"{prefix}cell"),
            *[c for c in cells.columns if c not in ("band", "cell")],
            lat.alias(f"{prefix}lat"),
            lon.alias(f"{prefix}lon"),
            F.when(in_band >= self.ROUND, radius).alias(f"{prefix}radius"),
        )


def count_within(a: DataFrame, b: DataFrame, km: float) -> DataFrame:
    """``(id, in_range)``: how many points of b are in range of each point of a, 0 included.

    Points on one spot are one place. Places are put in cells smaller than the
    reach; two cells that lie wholly within reach are counted as a whole, two
    that lie wholly apart not at all, and only the places of the others are
    compared one by one.
    """
    cells = _Cells(km / _FINER)
    spots = cells.put(_places(a, "", F.count(F.lit(1)).alias("__points")).select("lat", "lon"), "lat", "lon")
    others = cells.put(_places(b, "b_", F.count(F.lit(1)).alias("__n")), "b_lat", "b_lon")
    spots, others = cut_lineage(spots), cut_lineage(others)
    left = cells.discs(spots.select("band", "cell").distinct(), "")
    right = cells.discs(others.groupBy("band", "cell").agg(F.sum("__n").alias("__in_cell")), "b_")
    # Centres of cells with places in reach of each other are not farther apart than this.
    pairs = _near(left, right, min(1.75 * km, _HALF_ROUND_KM * 1.001))
    spread = F.col("radius") + F.col("b_radius")
    whole = F.coalesce(F.col("km") + spread < km * (1 - 1e-9), F.lit(False))
    apart = F.coalesce(F.col("km") - spread > km * (1 + 1e-9), F.lit(False))
    pairs = cut_lineage(
        pairs.where(~apart).select("band", "cell", "b_band", "b_cell", "__in_cell", whole.alias("whole"))
    )
    by_cell = pairs.where("whole").groupBy("band", "cell").agg(F.sum("__in_cell").alias("__whole"))
    edge = pairs.where("NOT whole").select("band", "cell", "b_band", "b_cell")
    near = spots.join(edge, ["band", "cell"]).join(
        others.withColumnsRenamed({"band": "b_band", "cell": "b_cell"}), ["b_band", "b_cell"]
    )
    in_reach = haversine(F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon")) <= km
    by_place = near.where(in_reach).groupBy("lat", "lon").agg(F.sum("__n").alias("__single"))
    counts = spots.join(by_cell, ["band", "cell"], "left").join(by_place, ["lat", "lon"], "left")
    counts = counts.select(
        "lat", "lon", (F.coalesce("__whole", F.lit(0)) + F.coalesce("__single", F.lit(0))).alias("in_range")
    )
    return a.join(counts, ["lat", "lon"], "left").select("id", F.coalesce("in_range", F.lit(0)).alias("in_range"))


def _first_reach(places: DataFrame) -> float:
    """A reach at which no cell is crowded."""
    reach = _START_KM
    while reach > _LEAST_KM:
        grid = _Grid(reach)
        band = grid.band(F.col("b_lat"))
        in_cell = places.groupBy(band.alias("band"), grid.cell(band, F.col("b_lon")).alias("cell")).count()
        if (in_cell.agg(F.max("count")).first()[0] or 0) <= _CROWDED:
            break
        reach /= _WIDEN
    return reach


def nearest(a: DataFrame, b: DataFrame, start_km: float | None = None) -> DataFrame:
    """``(id, nearest_id, km)``: the nearest point of b, ties by the smallest id.

    The search starts close by, the closer the more crowded b is, and widens
    only for places that found nothing, until it spans the globe. Whatever is
    found within the reach is exact.
    """
    spots = cut_lineage(_places(a, "", F.count(F.lit(1)).alias("__points")).select("lat", "lon"))
    others = cut_lineage(_places(b, "b_", F.min("id").alias("b_id")))
    found, reach, open_spots = [], start_km or _first_reach(others), spots
    while True:
        best = _near(open_spots, others, min(reach, _HALF_ROUND_KM * 1.001))
        best = best.groupBy("lat", "lon").agg(F.min(F.struct("km", "b_id")).alias("best"))
        best = cut_lineage(best)
        found.append(best)
        if reach >= _HALF_ROUND_KM:
            break
        open_spots = cut_lineage(open_spots.join(best, ["lat", "lon"], "left_anti"))
        if open_spots.isEmpty():
            break
        reach = min(reach * _WIDEN, _HALF_ROUND_KM * 1.001)
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return a.join(every, ["lat", "lon"], "left").select(
        "id", F.col("best.b_id").alias("nearest_id"), F.col("best.km").alias("km")
    )
