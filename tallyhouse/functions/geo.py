"""Distances on the sphere, and a radius join over a cell index.

Cells are bands of latitude, as high as the radius, cut into equal ranges of longitude that are no narrower than the
radius where the band is narrowest. A point lies in one cell. All points within the radius of it lie in the bands from
its latitude less the radius to its latitude plus the radius, and there within the longitudes that a circle of that
radius touches; those cells are looked up, over the antimeridian and around the poles. The join is an equi-join on cells; the exact
distance decides. Its cells are half as high and wide, and cut further into blocks of rows, so that no key of the join
holds more than some millions of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: mean radius of the earth in metres (IUGG).
EARTH = 6_371_008.8
#: Widens what is looked up, against rounding at the edge of a circle.
_ROOM = 1 + 1e-9
#: Rows of either side that a key of the radius join holds, about.
_BLOCK = 2048
#: Rows of one place that are held together, at most.
_HELD = 256


def metres(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column, cos_a: Column | None = None, cos_b: Column | None = None) -> Column:
    """Great-circle distance of two points in degrees, by haversines; cosines of the latitudes may be given."""
    half = lambda x: F.pow(F.sin(F.radians(x) / 2), 2)
    cosines = (F.cos(F.radians(lat_a)) if cos_a is None else cos_a) * (F.cos(F.radians(lat_b)) if cos_b is None else cos_b)
    h = half(lat_b - lat_a) + cosines * half(lon_b - lon_a)
    return 2 * EARTH * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


class Cells:
    """The index for one radius in metres, its cells as high as the radius or one of ``parts`` of it."""

    def __init__(self, radius: float, parts: int = 1):
        if not 0 < radius < EARTH * math.pi / 2:
            raise ValueError(f"a radius is above 0 and below a quarter of the globe: {radius}")
        self.degrees = math.degrees(radius / EARTH) * _ROOM
        self.side = self.degrees / parts
        self.bands = max(1, math.floor(180 / self.side))

    def band(self, lat: Column) -> Column:
        return F.least(F.floor((lat + 90) / 180 * self.bands), F.lit(self.bands - 1)).cast("int")

    def ranges(self, band: Column) -> Column:
        """Ranges of longitude in a band: as many as keep each as wide as a cell is high at the band's edge nearest to a pole."""
        south, north = band / self.bands * 180 - 90, (band + 1) / self.bands * 180 - 90
        least = F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs(south), F.abs(north)))))
        return F.greatest(F.lit(1), F.floor(least * 360 / self.side)).cast("long")

    def place(self, lon: Column, ranges: Column) -> Column:
        return F.pmod(F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * ranges).cast("long"), ranges)

    def own(self, lat: Column, lon: Column) -> Column:
        band = self.band(lat)
        return F.struct(band.alias("band"), self.place(lon, self.ranges(band)).alias("place"))

    def _touched(self, lat: Column) -> Column:
        """Array of the bands that a circle around a point touches."""
        return F.sequence(self.band(F.greatest(lat - self.degrees, F.lit(-90.0))), self.band(F.least(lat + self.degrees, F.lit(90.0))))

    def _reach(self, lat: Column) -> Column:
        """Degrees of longitude to either side that a circle around a point touches."""
        sine = F.sin(F.radians(F.lit(self.degrees))) / F.cos(F.radians(lat))
        over = (lat - self.degrees <= -90) | (lat + self.degrees >= 90)
        return F.when(over, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), sine))) * _ROOM)

    def _places(self, lon: Column, reach: Column, n: Column) -> Column:
        """Array of the places so touched in a band of ``n`` ranges; to be taken modulo ``n``."""
        first, last = F.floor((lon + 180 - reach) / 360 * n).cast("long"), F.floor((lon + 180 + reach) / 360 * n).cast("long")
        return F.sequence(first, F.least(last, first + n - 1))  # once around at most

    def near(self, lat: Column, lon: Column) -> Column:
        """Array of all cells that a circle around a point touches."""

        def of_band(band: Column) -> Column:
            n = self.ranges(band)
            return F.transform(self._places(lon, self._reach(lat), n), lambda p: F.struct(band.alias("band"), F.pmod(p, n).alias("place")))

        return F.flatten(F.transform(self._touched(lat), of_band))

    def placed(self, df: DataFrame, lat: Column, lon: Column) -> DataFrame:
        """``df`` with the cell of each point as __band and __place."""
        return df.withColumn("__band", self.band(lat)).withColumn("__place", self.place(lon, self.ranges(F.col("__band"))))

    def spread(self, df: DataFrame, lat: Column, lon: Column) -> DataFrame:
        """``df`` with a row for each cell of ``near``, as __band and __place."""
        banded = df.withColumn("__reach", self._reach(lat)).withColumn("__band", F.explode(self._touched(lat))).withColumn("__ranges", self.ranges(F.col("__band")))
        placed = banded.withColumn("__place", F.explode(self._places(lon, F.col("__reach"), F.col("__ranges"))))
        return placed.withColumn("__place", F.pmod("__place", "__ranges")).drop("__reach", "__ranges")


def radius_join(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str], radius: float, told: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows of both sides whose points (names of latitude and longitude) are ``radius`` metres apart or less, with ``metres``, or what ``told`` makes of them.

    Points with a NULL or a latitude beyond 90 have no partner; longitudes may be counted beyond 180. Places of ``left``
    are measured once for all rows that share one; the rows of ``right`` are copied to the cells around them, so the
    smaller side belongs there. Cells with many rows are dealt as blocks of each side, every block of one meeting every
    block of the other.
    """
    cells, parts = Cells(radius, 2), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    here = lambda lat, lon: F.col(lat).between(-90, 90) & F.col(lon).isNotNull()
    place = lambda names: {f"__{n}": F.col(c).cast("double") for n, c in zip(("lat", "lon"), names)}
    sites, key = ("__lat", "__lon"), ["__band", "__place"]
    meets = [*key, "__part_a", "__part_b"]
    hashed = lambda df: F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]).alias("__hash")
    rows = left.where(here(*a)).select(F.struct("*").alias("__row"), hashed(left), *[c.alias(n) for n, c in place(a).items()])
    points = right.where(here(*b)).select(F.struct("*").alias("__met"), hashed(right), *[c.alias(n) for n, c in place(b).items()]).repartition("__hash")
    lat, lon = (F.col(c) for c in sites)
    blocks = lambda df, name: df.groupBy(*key).agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias(name))
    # Copies may be many where their table is small: nothing is broadcast by its size.
    sizes = blocks(cells.placed(rows, lat, lon), "__n_a").join(blocks(cells.spread(points, lat, lon), "__n_b"), key).hint("shuffle_hash")

    order = Window.partitionBy(*sites).orderBy("__hash")
    held = rows.withColumn("__chunk", F.floor((F.row_number().over(order) - 1) / _HELD)).groupBy(*sites, "__chunk").agg(F.collect_list("__row").alias("__rows"))
    dealt = lambda name, *by: F.pmod(F.xxhash64(*by), F.col(name)).cast("int")
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    held = cells.placed(held, lat, lon).join(sizes, key).withColumn("__part_a", dealt("__n_a", *sites, "__chunk")).withColumn("__part_b", each("__n_b"))
    points = cells.spread(points, lat, lon).join(sizes, key).withColumn("__part_b", dealt("__n_b", "__hash")).withColumn("__part_a", each("__n_a"))

    def solid(df: DataFrame, x: str, *more: str) -> DataFrame:
        """Dealt by block, with the point as a vector of length one."""
        lat, lon = (F.radians(F.col(c)) for c in sites)
        axes = {f"__x_{x}": F.cos(lat) * F.cos(lon), f"__y_{x}": F.cos(lat) * F.sin(lon), f"__z_{x}": F.sin(lat), f"__cos_{x}": F.cos(lat)}
        return df.select(*meets, *more, *sites).repartition(parts, *meets).select(*meets, *more, *[F.col(c).alias(f"{c}_{x}") for c in sites], *[c.alias(n) for n, c in axes.items()])

    met = solid(held, "a", "__rows").join(solid(points, "b", "__met").hint("merge"), meets)
    # Squared chords decide but for those close to the radius.
    apart = [F.col(f"__{n}_a") - F.col(f"__{n}_b") for n in "xyz"]
    chord, most = apart[0] * apart[0] + apart[1] * apart[1] + apart[2] * apart[2], (2 * math.sin(radius / EARTH / 2)) ** 2
    room = most * 1e-6 + math.sqrt(most) * 1e-12
    far = metres(*[F.col(f"{c}_{x}") for x in "ab" for c in sites], F.col("__cos_a"), F.col("__cos_b"))
    met = met.where((chord <= most - room) | ((chord <= most + room) & (far <= radius)))
    return met.select("__rows", "__met", (told or (lambda c: c))(far).alias("metres")).select(F.explode("__rows").alias("__row"), "__met", "metres").select("__row.*", "__met.*", "metres")


def box_against_circle(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str], degrees: float) -> DataFrame:
    """n_box, n_circle, n_corners: pairs in a box of degrees (as one writes it for a radius), in the circle it stands for, and in the box alone.

    The circle has the box's half height as radius. Pairs of the box are found by buckets of degrees.
    """
    radius = math.radians(degrees) * EARTH
    bucket = lambda c: F.floor(F.col(c) / degrees)
    around = lambda c: F.explode(F.sequence(bucket(c) - 1, bucket(c) + 1))
    probes = left.withColumn("__y", around(a[0])).withColumn("__x", around(a[1]))
    points = right.withColumns({"__y": bucket(b[0]), "__x": bucket(b[1])})
    met = probes.join(points, ["__y", "__x"]).where((F.abs(F.col(a[0]) - F.col(b[0])) <= degrees) & (F.abs(F.col(a[1]) - F.col(b[1])) <= degrees))
    inside = metres(*[F.col(c) for c in (*a, *b)]) <= radius
    boxed = met.agg(F.count("*").alias("n_box"), F.count(F.when(~inside, 1)).alias("n_corners"))
    circled = radius_join(left, right, a, b, radius).agg(F.count("*").alias("n_circle"))
    return boxed.withColumn("one", F.lit(1)).join(circled.withColumn("one", F.lit(1)), "one").select("n_box", "n_circle", "n_corners")
