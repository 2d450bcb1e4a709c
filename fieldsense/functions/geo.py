"""Range priors: an equal-area projection, distances to polygons by a grid cover, score adjustment."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsense.operators.sizes import small

#: Albers equal-area conic for California (EPSG:3310), GRS80; fixed values.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257222101
PARALLELS, ORIGIN, FALSE_NORTHING = (34.0, 40.5), (0.0, -120.0), -4_000_000.0


def _q(sin: float, e: float) -> float:
    return (1 - e * e) * (sin / (1 - (e * sin) ** 2) - math.log((1 - e * sin) / (1 + e * sin)) / (2 * e))


def constants() -> dict[str, float]:
    """Of the projection: e, n, c and the radius of its origin."""
    e = math.sqrt(2 * FLATTENING - FLATTENING**2)
    m = [math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2) for p in map(math.radians, PARALLELS)]
    q = [_q(math.sin(math.radians(p)), e) for p in PARALLELS]
    n = (m[0] ** 2 - m[1] ** 2) / (q[1] - q[0])
    c = m[0] ** 2 + n * q[0]
    return {"e": e, "n": n, "c": c, "rho0": SEMI_MAJOR * math.sqrt(c - n * _q(math.sin(math.radians(ORIGIN[0])), e)) / n}


def project(lat: Column, lon: Column) -> tuple[Column, Column]:
    """x, y in metres."""
    e, n, c, rho0 = constants().values()
    s = F.sin(F.radians(lat))
    own = (1 - e * e) * (s / (1 - (e * s) * (e * s)) - F.ln((1 - e * s) / (1 + e * s)) / (2 * e))
    rho, theta = SEMI_MAJOR * F.sqrt(c - n * own) / n, n * F.radians(lon - ORIGIN[1])
    return rho * F.sin(theta), FALSE_NORTHING + rho0 - rho * F.cos(theta)


@dataclass(frozen=True)
class Grid:
    """Square cells over a root square; each level cuts a cell's sides into 2^BITS."""

    x0: float
    y0: float
    size: float
    levels: int = 6

    BITS = 2

    def side(self, level: Column) -> Column:
        return F.lit(self.size) / F.pow(F.lit(float(1 << self.BITS)), level)

    def place(self, x: Column, y: Column) -> tuple[Column, Column]:
        """ix, iy of the finest cell that holds a point."""
        n = 1 << (self.BITS * self.levels)
        at = lambda v, v0: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((v - v0) / F.lit(self.size) * n))).cast("long")
        return at(x, self.x0), at(y, self.y0)

    def above(self, i: Column, level: int) -> Column:
        """Of a finest cell's ix or iy, that of the cell of this level around it."""
        return F.shiftright(i, self.BITS * (self.levels - level))

    @staticmethod
    def name(level: Column, ix: Column, iy: Column) -> Column:
        return F.shiftleft(level.cast("long"), 56) + F.shiftleft(ix, 28) + iy


#: The cell of points without a place.
NOWHERE = -1


def _gap(e: Column, x: Column, y: Column) -> Column:
    """Distance of a point from an edge."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    along = ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-12))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return F.sqrt(F.pow(x - e["x1"] - t * dx, 2) + F.pow(y - e["y1"] - t * dy, 2))


def _odd_parts(edges: Column, odd: Column, x: Column, y: Column, right: Column, bottom: Column) -> Column:
    """Parts that hold (x, y), from those that hold a cell's lower right corner and the edges that meet the cell: the way
    leads along y to the cell's right side and along that to the corner, and each edge on it changes its part's side."""

    def level(e: Column) -> Column:
        at = e["x1"] + (e["x2"] - e["x1"]) * F.try_divide(y - e["y1"], e["y2"] - e["y1"])
        return ((e["y1"] > y) != (e["y2"] > y)) & (at > x) & (at <= right)

    def upright(e: Column) -> Column:
        at = e["y1"] + (e["y2"] - e["y1"]) * F.try_divide(right - e["x1"], e["x2"] - e["x1"])
        return ((e["x1"] > right) != (e["x2"] > right)) & (at > bottom) & (at <= y)

    met = F.concat(odd, F.transform(F.filter(edges, level), lambda e: e["part"]), F.transform(F.filter(edges, upright), lambda e: e["part"]))
    # In order, a part cancels itself if it is there already.
    cancel = lambda kept, p: F.when(F.get(kept, F.size(kept) - 1) == p, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(F.array_append(kept, p))
    return F.aggregate(F.array_sort(met), F.slice(odd, 1, 0), cancel)


def cover(edges: DataFrame, cells: DataFrame, grid: Grid, most: int = 32) -> DataFrame:
    """(code, level, ix, iy, cell, edges, odd): for each range cells that hold all the given finest cells (ix, iy), one
    each, with the edges that can be nearest to a point in the cell and the parts that hold its lower right corner.

    With the nearest edge d away from a cell's centre and r from there to its corners, only edges within d + 2 r can be
    nearest to one of its points. Cells with more than `most` such edges are cut, down to the finest; a part of a cell has
    no edge that the cell hasn't, so each level looks at the edges that the one above has left.
    """
    every = edges.groupBy("code").agg(F.collect_list(F.struct("part", "x1", "y1", "x2", "y2")).alias("edges"))
    none = F.array().cast(f"array<{edges.schema['part'].dataType.simpleString()}>")
    zero = F.lit(0).cast("long")
    state = every.select("code", F.lit(0).alias("level"), zero.alias("ix"), zero.alias("iy"), "edges", none.alias("odd"))
    for level in range(grid.levels):
        kid = F.struct(*(grid.above(F.col(c), level + 1).alias(c) for c in ("ix", "iy")))
        parent = Grid.name(F.lit(level), grid.above(F.col("ix"), level), grid.above(F.col("iy"), level))
        kids = cells.groupBy(parent.alias("cell")).agg(F.collect_set(kid).alias("kids"))  # 4^BITS at most
        cut = (F.col("level") == level) & (F.size("edges") > most) & F.col("kids").isNotNull()
        if level:
            state = state.withColumn("cell", Grid.name(F.col("level"), F.col("ix"), F.col("iy"))).join(kids, "cell", "left")
        else:  # all of the root's
            state = state.withColumn("kids", F.array(*(F.struct(F.lit(x).cast("long").alias("ix"), F.lit(y).cast("long").alias("iy")) for x in range(1 << grid.BITS) for y in range(1 << grid.BITS))))
        state = state.withColumn("cut", cut).withColumn("kid", F.explode(F.when(F.col("cut"), F.col("kids")).otherwise(F.array(F.struct("ix", "iy")))))
        side, half = grid.side(F.lit(level)), grid.side(F.lit(level + 1))
        # Columns of their own: inside a lambda, a name that the same select gives away again would mean the new one.
        at = {"right": F.lit(grid.x0) + (F.col("ix") + 1) * side, "bottom": F.lit(grid.y0) + F.col("iy") * side}
        at |= {"mid_x": F.lit(grid.x0) + (F.col("kid.ix") + 0.5) * half, "mid_y": F.lit(grid.y0) + (F.col("kid.iy") + 0.5) * half}
        at |= {"kid_right": F.lit(grid.x0) + (F.col("kid.ix") + 1) * half, "kid_bottom": F.lit(grid.y0) + F.col("kid.iy") * half}
        state = state.withColumns(at)
        gap = lambda e: _gap(e, F.col("mid_x"), F.col("mid_y"))
        reach = F.array_min(F.transform("edges", gap)) * (1 + 1e-9) + half * math.sqrt(2) * (1 + 1e-9)
        near = F.get(F.transform(F.array(reach), lambda d: F.filter("edges", lambda e: gap(e) <= d)), F.lit(0))  # noqa: B023
        walk = _odd_parts(F.col("edges"), F.col("odd"), *map(F.col, ("kid_right", "kid_bottom", "right", "bottom")))
        state = state.select(
            "code",
            F.when(F.col("cut"), level + 1).otherwise(F.col("level")).alias("level"),
            "kid.ix",
            "kid.iy",
            F.when(F.col("cut"), near).otherwise(F.col("edges")).alias("edges"),
            F.when(F.col("cut"), walk).otherwise(F.col("odd")).alias("odd"),
        )
    return state.withColumn("cell", Grid.name(F.col("level"), F.col("ix"), F.col("iy")))


def distances(points: DataFrame, edges: DataFrame, key: str, most: int = 32, levels: int = 6) -> DataFrame:
    """(key, code, distance), 0 inside; null for points without a place. points: key, x, y; edges: code, part, x1, y1, x2,
    y2, a row for each edge of a polygon's rings. Inside is an odd number of crossings within a part.

    Points meet the cells of a cover by the cells around them, one of each range, so a point looks at `most` edges of a
    range or, where many are about as near, at those of a finest cell.
    """
    points = points.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    points = points.withColumns({c: F.when(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"), F.col(c)) for c in ("x", "y")})
    ends = points.select(F.col("x").alias("px"), F.col("y").alias("py")).union(edges.select("x1", "y1"))  # rings are closed: each corner begins an edge
    box = ends.agg(F.min("px"), F.min("py"), F.max("px"), F.max("py")).first()
    x0, y0, x1, y1 = (0.0 if v is None else v for v in box)
    size = max(x1 - x0, y1 - y0, 1e-6)
    longest = edges.groupBy("code").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    levels = levels if longest > most else 0  # no cell would be cut
    grid = Grid(x0 - size * 1e-6, y0 - size * 1e-6, size * (1 + 4e-6), levels)
    ix, iy = grid.place(F.col("x"), F.col("y"))
    placed = points.withColumns({"ix": ix, "iy": iy})
    leaves = cover(edges, placed.filter("x is not null").select("ix", "iy").distinct(), grid, most)
    nowhere = edges.select("code").distinct().select("code", *(F.lit(None).cast(t).alias(c) for c, t in leaves.dtypes if c not in ("code", "cell")), F.lit(NOWHERE).cast("long").alias("cell"))
    around = F.array(*(Grid.name(F.lit(k), grid.above(F.col("ix"), k), grid.above(F.col("iy"), k)) for k in range(levels + 1)))
    cells = F.explode(F.when(F.col("x").isNotNull(), around).otherwise(F.array(F.lit(NOWHERE).cast("long")))).alias("cell")
    side = grid.side(F.col("level"))
    corners = {"right": F.lit(grid.x0) + (F.col("ix") + 1) * side, "bottom": F.lit(grid.y0) + F.col("iy") * side}
    leaves = leaves.unionByName(nowhere).withColumns(corners).select("cell", "code", "edges", "odd", "right", "bottom")
    met = placed.select(key, "x", "y", cells).join(small(leaves), "cell")
    inside = F.size(_odd_parts(*map(F.col, ("edges", "odd", "x", "y", "right", "bottom")))) > 0
    nearest = F.array_min(F.transform("edges", lambda e: _gap(e, F.col("x"), F.col("y"))))
    return met.select(key, "code", F.when(F.col("x").isNotNull(), F.when(inside, 0.0).otherwise(nearest)).alias("distance"))


def range_weight(km: Column, scale: float = 20.0, floor: float = 0.02) -> Column:
    return F.greatest(F.exp(-km / scale), F.lit(floor))


def class_weights(weights: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(key, class, weight): the largest weight of a class's members (code, class); a member without a range weighs 1."""
    every = weights.select(key).distinct().crossJoin(small(members.select("code", "class")))  # a few hundred species for each point
    known = every.join(weights.select(key, "code", "weight"), [key, "code"], "left")
    return known.groupBy(key, "class").agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("weight"))


def range_check(distances: DataFrame, classes: DataFrame, members: DataFrame, state: list[str], key: str) -> DataFrame:
    """One row a class: members, mapped and unmapped codes, n, inside, median_out, max_out.

    distances: key, code, distance; classes: key, class of the points; members: code, class. Only points inside one of the
    ranges named in state count; a point's distance is that to the nearest range of its class.
    """
    there = distances.filter(F.col("code").isin(state)).groupBy(key).agg(F.min("distance").alias("d")).filter("d = 0").select(key)
    has_range = distances.select("code").distinct().withColumn("mapped", F.lit(True))
    listed = members.join(has_range, "code", "left")
    names = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("code")))), " ")
    lists = listed.groupBy("class").agg(names(F.lit(True)).alias("members"), names(F.col("mapped").isNotNull()).alias("mapped"), names(F.col("mapped").isNull()).alias("unmapped"))
    points = classes.join(there, key, "left_semi")
    nearest = points.join(members, "class").join(distances, [key, "code"]).groupBy(key, "class").agg(F.min("distance").alias("distance"))
    out = F.when(F.col("distance") > 0, F.col("distance"))
    found = nearest.groupBy("class").agg(F.avg((F.col("distance") == 0).cast("double")).alias("inside"), F.percentile(out, 0.5).alias("median_out"), F.max(out).alias("max_out"))
    return lists.join(points.groupBy("class").agg(F.count("*").alias("n")), "class", "left").join(found, "class", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def adjust(p: Column, weight: Column) -> Column:
    """sigmoid(logit(p) + ln(weight)); a missing weight is 1."""
    q = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p))
    return F.lit(1.0) / (1 + F.exp(-(F.ln(q / (1 - q)) + F.ln(F.coalesce(weight, F.lit(1.0))))))
