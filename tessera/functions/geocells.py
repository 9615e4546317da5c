"""Geohash cells as integer coordinates: bounds, neighbours, cells of a circle, boxes of a radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.geo import BASE32, EARTH_M, haversine

#: Metres of a degree in the flat measure that chooses the cells of a circle.
FLAT_M = 111_320
#: Points of a cell that meet its centres in one task, and the tasks among which the slices are dealt.
SLICE, TASKS = 500, 384


def sides(precision: int) -> tuple[int, int]:
    """Bits of the longitude and of the latitude of a cell."""
    return (5 * precision + 1) // 2, 5 * precision // 2


def clamped(c: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high)).cast("long")


def cell_x(lng: Column, precision: int) -> Column:
    n = 1 << sides(precision)[0]
    return clamped(F.floor((lng + 180) / 360 * n), 0, n - 1)


def cell_y(lat: Column, precision: int) -> Column:
    n = 1 << sides(precision)[1]
    return clamped(F.floor((lat + 90) / 180 * n), 0, n - 1)


def cell_code(x: Column, y: Column, precision: int) -> Column:
    """The geohash of a cell: bits of x and y in turn, x first, five to a letter."""
    bits_x, bits_y = sides(precision)
    letters = []
    for i in range(precision):
        value = F.lit(0)
        for k in range(5 * i, 5 * i + 5):
            c, n = (x, bits_x) if k % 2 == 0 else (y, bits_y)
            value = value * 2 + F.shiftright(c, n - 1 - k // 2).bitwiseAND(1)
        letters.append(F.substr(F.lit(BASE32), value.cast("int") + 1, F.lit(1)))
    return F.concat(*letters)


def cell_of(code: Column, precision: int) -> tuple[Column, Column]:
    """x and y of a geohash of this length; letters may be capital."""
    x, y = F.lit(0).cast("long"), F.lit(0).cast("long")
    for i in range(precision):
        value = F.instr(F.lit(BASE32), F.substr(F.lower(code), F.lit(i + 1), F.lit(1))).cast("long") - 1
        for k in range(5 * i, 5 * i + 5):
            bit = F.shiftright(value, 4 - k % 5).bitwiseAND(1)
            x, y = (x * 2 + bit, y) if k % 2 == 0 else (x, y * 2 + bit)
    return x, y


def cell_bounds(x: Column, y: Column, precision: int) -> Column:
    """``south, west, north, east`` of a cell."""
    w, h = 360 / (1 << sides(precision)[0]), 180 / (1 << sides(precision)[1])
    return F.struct((y * h - 90).alias("south"), (x * w - 180).alias("west"), ((y + 1) * h - 90).alias("north"), ((x + 1) * w - 180).alias("east"))


def bounds(code: Column, precision: int) -> Column:
    return cell_bounds(*cell_of(code, precision), precision)


AROUND = {"n": (0, 1), "ne": (1, 1), "e": (1, 0), "se": (1, -1), "s": (0, -1), "sw": (-1, -1), "w": (-1, 0), "nw": (-1, 1)}


def neighbours(code: Column, precision: int) -> Column:
    """A struct of the eight cells around; beyond a pole or the antimeridian it is empty."""
    x, y = cell_of(code, precision)
    n_x, n_y = (1 << b for b in sides(precision))
    fits = lambda a, b: (a >= 0) & (a < n_x) & (b >= 0) & (b < n_y)
    return F.struct(*[F.when(fits(x + dx, y + dy), cell_code(x + dx, y + dy, precision)).otherwise("").alias(name) for name, (dx, dy) in AROUND.items()])


def cells_of_circle(lat: Column, lng: Column, metres: float, precision: int) -> Column:
    """Geohashes of the cells whose box lies within ``metres`` of the point in the flat measure, the point's own first among them.

    Nothing is searched: rows of cells are a range of y, and in a row a range of x; the range of a row is then tested cell by cell.
    """
    reach = metres / FLAT_M
    across = reach / F.greatest(F.cos(F.radians(lat)), F.lit(1e-9))
    ys = F.sequence(cell_y(lat - reach, precision), cell_y(lat + reach, precision))
    xs = F.sequence(cell_x(lng - across, precision), cell_x(lng + across, precision))

    def near(c: Column) -> Column:
        b = cell_bounds(c["x"], c["y"], precision)
        d_lat = (F.least(F.greatest(lat, b["south"]), b["north"]) - lat) * FLAT_M
        d_lng = (F.least(F.greatest(lng, b["west"]), b["east"]) - lng) * FLAT_M * F.cos(F.radians(lat))
        own = (c["x"] == cell_x(lng, precision)) & (c["y"] == cell_y(lat, precision))
        return own | (F.sqrt(d_lat * d_lat + d_lng * d_lng) <= metres)

    every = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x"), y.alias("y")))))
    return F.transform(F.filter(every, near), lambda c: cell_code(c["x"], c["y"], precision))


def radius_box(lat: Column, lng: Column, metres: Column) -> Column:
    """``south, west, north, east`` around a circle. West may exceed east (across the antimeridian); a circle around a pole has all
    longitudes."""
    turn = metres / EARTH_M
    low, high = F.radians(lat) - turn, F.radians(lat) + turn
    inner = (low > -F.pi() / 2) & (high < F.pi() / 2)
    wide = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(turn) / F.cos(F.radians(lat)))))
    west, east = lng - wide, lng + wide
    return F.struct(
        F.greatest(F.lit(-90.0), F.degrees(low)).alias("south"), F.when(inner, F.when(west < -180, west + 360).otherwise(west)).otherwise(-180.0).alias("west"),
        F.least(F.lit(90.0), F.degrees(high)).alias("north"), F.when(inner, F.when(east > 180, east - 360).otherwise(east)).otherwise(180.0).alias("east"),
    )


def within_box(lat: Column, lng: Column, box: Column) -> Column:
    across = F.when(box["west"] > box["east"], (lng >= box["west"]) | (lng <= box["east"])).otherwise((lng >= box["west"]) & (lng <= box["east"]))
    return (lat >= box["south"]) & (lat <= box["north"]) & across


def with_cells(centres: DataFrame, metres: float, precision: int) -> DataFrame:
    """A row for each cell that a centre's box touches (``cell_x, cell_y``); the number of cells follows the radius, not the data."""
    box, n = radius_box(F.col("lat"), F.col("lng"), F.lit(float(metres))), 1 << sides(precision)[0]
    c = centres.withColumn("box", box)
    west, east = cell_x(F.col("box.west"), precision), cell_x(F.col("box.east"), precision)
    one_turn = F.col("box.west") <= F.col("box.east")
    xs = F.when(one_turn, F.sequence(west, east)).otherwise(F.array_distinct(F.concat(F.sequence(west, F.lit(n - 1).cast("long")), F.sequence(F.lit(0).cast("long"), east))))
    ys = F.sequence(cell_y(F.col("box.south"), precision), cell_y(F.col("box.north"), precision))
    return c.withColumn("cell_y", F.explode(ys)).withColumn("cell_x", F.explode(xs))


def radius_join(centres: DataFrame, points: DataFrame, metres: float, precision: int = 3, least: float = 0.0, tasks: int = TASKS) -> DataFrame:
    """Pairs of a centre (``centre, lat, lng``) and a point (``id, lat, lng``) from ``least`` to ``metres`` apart, with ``distance``.

    An equality join on cells, then the box, then the distance. Pairs may be many more than rows, so the work is dealt by pairs, not by
    bytes: a cell's points are cut into slices of ``SLICE`` or so, each of which meets the cell's centres in one of many tasks.
    """
    c = with_cells(centres.select("centre", "lat", "lng").repartition(tasks, "centre"), metres, precision)
    p = points.select("id", F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))
    p = p.where("p_lat is not null and p_lng is not null").withColumn("cell_x", cell_x(F.col("p_lng"), precision)).withColumn("cell_y", cell_y(F.col("p_lat"), precision))
    keys = ["cell_x", "cell_y", "slice"]
    sizes = p.groupBy("cell_x", "cell_y").agg(F.ceil(F.count("*") / SLICE).alias("slices"))  # a row for each cell of the grid at most
    p = p.join(sizes, ["cell_x", "cell_y"]).withColumn("slice", F.pmod(F.xxhash64("id"), "slices")).drop("slices")
    c = c.join(sizes, ["cell_x", "cell_y"]).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).drop("slices")
    met = c.repartition(tasks, *keys).join(p.repartition(tasks, *keys).hint("shuffle_hash"), keys).where(within_box(F.col("p_lat"), F.col("p_lng"), F.col("box")))
    met = met.withColumn("distance", haversine(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng")))
    return met.where((F.col("distance") >= least) & (F.col("distance") <= metres)).select("centre", "id", "distance")


def nearby(points: DataFrame, lat: float, lng: float, km: float = 10, limit: int = 50, types: list[str] | None = None, precision: int = 4) -> DataFrame:
    """Points around one place, nearest first: at most 500 km and 100 rows; a place off the globe is an error."""
    if not (-90 <= lat <= 90 and -180 <= lng <= 180):
        raise ValueError("latitude or longitude out of range")
    if not 0 < km <= 500:
        raise ValueError("a radius is more than 0 and at most 500 km")
    if types:
        points = points.where(F.col("type").isin(*types))
    centre = points.sparkSession.range(1).select(F.col("id").alias("centre"), F.lit(float(lat)).alias("lat"), F.lit(float(lng)).alias("lng"))
    return radius_join(centre, points, km * 1000, precision, tasks=16).drop("centre").orderBy("distance", "id").limit(max(1, min(int(limit), 100)))
