"""Great-circle distance and grid cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088  # fixed value
KM_PER_DEGREE = 111.19


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    dlat, dlng = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lng2 - lng1) / 2)
    h = dlat * dlat + dlng * dlng * F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def grid_cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(size)).cast("int")


def wrapped_cell(lng: Column, size: float) -> Column:
    """Longitude cell of a point; the 180th meridian belongs to the first cell."""
    span = int(round(360 / size))
    first = -(span // 2)
    return (F.pmod(grid_cell(lng, size) - F.lit(first), F.lit(span)) + F.lit(first)).cast("int")


def circle_cells(lat: Column, lng: Column, radius_km: Column, size: float) -> Column:
    """Array of struct(i, j): every cell a circle can touch.

    Longitude spread uses the circle's most polar latitude, so no cell is missed.
    A circle over a pole spans all longitudes; cells wrap at the 180th meridian.
    """
    dlat = radius_km / F.lit(KM_PER_DEGREE) + F.lit(1e-6)
    polar = F.greatest(F.abs(lat - dlat), F.abs(lat + dlat))
    cos_polar = F.cos(F.radians(F.least(polar, F.lit(89.9))))
    dlng = F.when(polar >= 89.9, F.lit(180.0)).otherwise(F.least(dlat / cos_polar * F.lit(1.01), F.lit(180.0)))
    rows = F.sequence(
        grid_cell(F.greatest(lat - dlat, F.lit(-90.0)), size), grid_cell(F.least(lat + dlat, F.lit(90.0)), size)
    )
    span = int(round(360 / size))
    first = -(span // 2)
    lo, hi = grid_cell(lng - dlng, size), grid_cell(lng + dlng, size)
    cols = F.sequence(lo, F.least(hi, lo + F.lit(span - 1)))
    wrapped = F.transform(cols, lambda j: (F.pmod(j - F.lit(first), F.lit(span)) + F.lit(first)).cast("int"))
    return F.flatten(
        F.transform(rows, lambda i: F.transform(wrapped, lambda j: F.struct(i.alias("i"), j.alias("j"))))
    )


#: Cell sizes of the grids that circles and points meet on; each divides 360.
GRIDS = [0.5, 4.0, 36.0, 360.0]


def circle_grid_cells(lat: Column, lng: Column, radius_km: Column) -> Column:
    """Array of struct(g, i, j): the cells a circle can touch on the finest grid that keeps them few.

    A circle takes a grid whose cells are at least a quarter of its half width, so it touches at
    most 10 x 10 cells of any grid but the last, and that has two rows of one cell.
    """
    dlat = radius_km / F.lit(KM_PER_DEGREE) + F.lit(1e-6)
    polar = F.least(F.greatest(F.abs(lat - dlat), F.abs(lat + dlat)), F.lit(89.9))
    half = F.when(polar >= 89.9, F.lit(180.0)).otherwise(F.least(dlat / F.cos(F.radians(polar)) * F.lit(1.01), F.lit(180.0)))
    wide = F.greatest(half, F.least(dlat, F.lit(180.0)))
    out = F.lit(None).cast("array<struct<g:int,i:int,j:int>>")
    for g, size in reversed(list(enumerate(GRIDS))):
        cells = _on_grid(circle_cells(lat, lng, radius_km, size), g)
        out = cells if g == len(GRIDS) - 1 else F.when(wide <= 4 * size, cells).otherwise(out)
    return out


def _on_grid(cells: Column, g: int) -> Column:
    return F.transform(cells, lambda c: F.struct(F.lit(g).alias("g"), c["i"].alias("i"), c["j"].alias("j")))


def point_grid_cells(lat: Column, lng: Column) -> Column:
    """Array of struct(g, i, j): a point's cell on every grid, so it meets each circle once."""
    return F.array(*[F.struct(F.lit(g).alias("g"), grid_cell(lat, s).alias("i"), wrapped_cell(lng, s).alias("j")) for g, s in enumerate(GRIDS)])
