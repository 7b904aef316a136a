"""The nearest of a set of points for every address, by a grid index.

Points lie in the cells of a grid.  An address looks at its own cell and the
ring around it (three by three cells); a point found within one cell's width
is certainly the nearest, since the ring reaches at least that far on every
side.  Addresses without such a point go on with the next ring of cells, twice
as wide, until the bound holds or the cells cover every point.  So a round has
nine cells an address, most addresses end in the first, and only those in the
empty parts of the map go on; there is no join of all addresses with all points.

Distances are plain ones over the two coordinates: give projected coordinates,
or scale longitudes first (``scaled_longitude``).  Equal distances go to the
smallest point id.  Addresses and points at one place are searched once, for
all of them; an address without both coordinates, or an empty set of points,
gives NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions._util import as_col, fresh_name, name_col
from ..session import materialized

POINTS_PER_CELL = 2.0


def scaled_longitude(longitude: str | Column, latitude: float) -> Column:
    """A longitude in the length of degrees of latitude, near the given latitude."""
    return as_col(longitude) * F.lit(math.cos(math.radians(latitude)))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(1e300))


def cell_width(points: DataFrame, per_cell: float = POINTS_PER_CELL) -> float:
    """Width of square cells that hold ``per_cell`` of the points (x, y) on average over their extent."""
    r = points.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y")
                                                   for f in (F.min, F.max)]).first()
    if not r["n"]:
        return 1.0
    wide, high = r["max_x"] - r["min_x"], r["max_y"] - r["min_y"]
    area = wide * high or max(wide, high) ** 2 / r["n"]  # on a line: as if a row of squares
    return math.sqrt(area * per_cell / r["n"]) or 1.0


def nearest_points(addresses: DataFrame, points: DataFrame, *, x: str, y: str, point_x: str, point_y: str, point_id: str,
                   width: float | None = None, out: str = "nearest") -> DataFrame:
    """Add ``out`` (id of the nearest point) and ``<out>_distance`` to every address (see module doc)."""
    key_x, key_y = (fresh_name([*addresses.columns, out, f"{out}_distance"], c) for c in ("_x", "_y"))
    placed = addresses.select("*", name_col(x).cast("double").alias(key_x), name_col(y).cast("double").alias(key_y))
    ax, ay = name_col(key_x), name_col(key_y)
    p = materialized(
        points.select(name_col(point_x).cast("double").alias("x"), name_col(point_y).cast("double").alias("y"),
                      name_col(point_id).alias("id")).filter(_finite(F.col("x")) & _finite(F.col("y")) & F.col("id").isNotNull())
        .groupBy("x", "y").agg(F.min("id").alias("id")), "points")
    open_ = materialized(placed.filter(_finite(ax) & _finite(ay)).select(ax.alias("x"), ay.alias("y")).distinct(), "places")
    extent = p.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    w = cell_width(p) if width is None else float(width)
    found = []
    if extent[0] is not None:
        while True:
            cells = p.select("x", "y", "id", F.floor(F.col("x") / F.lit(w)).alias("cx"), F.floor(F.col("y") / F.lit(w)).alias("cy"))
            near = F.sequence(F.lit(-1), F.lit(1))
            asked = open_.select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(near).alias("dx")) \
                .select("ax", "ay", "dx", F.explode(near).alias("dy")) \
                .select("ax", "ay", (F.floor(F.col("ax") / F.lit(w)) + F.col("dx")).alias("cx"),
                        (F.floor(F.col("ay") / F.lit(w)) + F.col("dy")).alias("cy"))
            square = (F.col("ax") - F.col("x")) * (F.col("ax") - F.col("x")) + (F.col("ay") - F.col("y")) * (F.col("ay") - F.col("y"))
            best = asked.join(cells, ["cx", "cy"]).groupBy(F.col("ax").alias("x"), F.col("ay").alias("y")) \
                .agg(F.min(F.struct(square.alias("d"), F.col("id"))).alias("b")).select("x", "y", "b.*")
            searched = open_.join(best, ["x", "y"], "left")
            # the ring covers every point when all lie within one cell's width of the address
            seen_all = (F.col("x") - F.lit(w) <= F.lit(extent[0])) & (F.col("x") + F.lit(w) >= F.lit(extent[1])) \
                & (F.col("y") - F.lit(w) <= F.lit(extent[2])) & (F.col("y") + F.lit(w) >= F.lit(extent[3]))
            sure = F.col("d").isNotNull() & ((F.col("d") <= F.lit(w * w)) | seen_all)
            searched = materialized(searched.withColumn("sure", sure), "ring")
            found.append(searched.filter("sure").select("x", "y", "d", "id"))
            open_ = searched.filter(~F.col("sure")).select("x", "y")
            if open_.isEmpty():
                break
            w *= 2
    if not found:
        none = F.lit(None).cast(points.schema[point_id].dataType)
        return placed.drop(key_x, key_y).withColumns({out: none, f"{out}_distance": F.lit(None).cast("double")})
    answers = found[0]
    for more in found[1:]:
        answers = answers.unionByName(more)
    answers = answers.select(F.col("x").alias(key_x), F.col("y").alias(key_y), F.col("id").alias(out),
                             F.sqrt("d").alias(f"{out}_distance"))
    return placed.join(answers, [key_x, key_y], "left").drop(key_x, key_y)


def attach_nearest_yield(addresses: DataFrame, yields: DataFrame, *, x: str = "axisB", y: str = "axisL",
                         point_x: str = "lat", point_y: str = "lon", point_id: str = "request_id", **kw) -> DataFrame:
    """Per-panel yields (and multiples) of the nearest requested point that has a reply.

    ``yields``: one row per requested point with ``kwh_per_year_for_1_panel``
    (rows where it is NULL are no points).  Coordinates may be text.
    """
    from .yields import yield_column, yield_multiples

    one = yield_column(1)
    answered = yields.filter(F.col(one).isNotNull()) \
        .withColumns({point_x: name_col(point_x).try_cast("double"), point_y: name_col(point_y).try_cast("double")})
    numbers = {fresh_name(addresses.columns, f"_{c}"): c for c in (x, y)}
    asked = addresses.withColumns({n: name_col(c).cast("string").try_cast("double") for n, c in numbers.items()})
    nx, ny = numbers
    near = nearest_points(asked, answered, x=nx, y=ny, point_x=point_x, point_y=point_y, point_id=point_id,
                          out=point_id, **kw).drop(nx, ny)
    per_point = answered.groupBy(point_id).agg(F.max(one).alias(one))
    return near.join(yield_multiples(per_point), [point_id], "left")
