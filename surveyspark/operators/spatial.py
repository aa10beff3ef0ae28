"""Spatial joins and pixel reductions on plain columns: polygons are edge rows, rasters are pixel rows.

``edges`` (unit, x1, y1, x2, y2) hold each polygon's boundary; points lie in a unit if a ray to the right crosses its boundary
an odd number of times. The half-open rule (y1 <= y < y2) puts a point on a shared edge into exactly one unit.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyspark.sources.scratch import materialize

from .order import row_numbers


def in_strips(points: DataFrame, edges: DataFrame, id_: str, unit: str, cell: float, also: list[str] = ()) -> DataFrame:
    """(id, unit) by crossing parity. Points and edges meet in rows of a grid of height ``cell``: an equi join. With ``also``, points bring columns of these names that edges must match."""
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.filter(F.col("y1") != F.col("y2")).withColumn("__g", F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell))))
    placed = points.select(id_, *also, "x", "y", F.floor(F.col("y") / cell).alias("__g"))
    met = placed.join(rows, ["__g", *also]).filter((F.col("y") >= lo) & (F.col("y") < hi))
    cross = F.col("x1") + (F.col("y") - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) * (F.col("x2") - F.col("x1")) > F.col("x")
    return met.groupBy(id_, unit).agg(F.count_if(cross).alias("__n")).filter("__n % 2 = 1").drop("__n")


def touched_cells(rows: DataFrame, key: list[str], size: float) -> DataFrame:
    """(key, x1, y1, x2, y2, gx, gy): the cells of a grid that each segment passes, row by row."""
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = rows.select(*key, "x1", "y1", "x2", "y2", F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size))).alias("gy"))
    at = lambda y: F.when(hi == lo, F.col("x1")).otherwise(F.col("x1") + (y - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) * (F.col("x2") - F.col("x1")))
    a, b = at(F.greatest(lo, F.col("gy") * size)), at(F.least(hi, (F.col("gy") + 1) * size))
    left, right = F.when(hi == lo, F.least("x1", "x2")).otherwise(F.least(a, b)), F.when(hi == lo, F.greatest("x1", "x2")).otherwise(F.greatest(a, b))
    return rows.withColumn("gx", F.explode(F.sequence(F.floor(left / size - 1e-9), F.floor(right / size + 1e-9))))


def cell_cover(edges: DataFrame, unit: str, cell: float, factor: int = 8, levels: int = 2) -> tuple[list[tuple[float, DataFrame]], DataFrame]:
    """The cells of a hierarchy of grids that lie in a unit, [(size, (unit, gx, gy))] from coarse to fine, and the finest cells that a boundary passes.

    A cell that no edge passes lies in its unit or out of it as a whole, so its centre alone is tested; cells that an edge passes are
    cut up on the next level.
    """
    e = edges.select(F.col(unit).alias("unit"), "x1", "y1", "x2", "y2")
    frame = e.groupBy("unit").agg(F.min(F.least("x1", "x2")).alias("l"), F.min(F.least("y1", "y2")).alias("d"), F.max(F.greatest("x1", "x2")).alias("r"), F.max(F.greatest("y1", "y2")).alias("u"))
    inner, border = [], None
    for level in range(levels):
        size = cell * factor ** (levels - 1 - level)
        upto = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))  # noqa: B023, E731
        if border is None:
            cells = frame.withColumn("gx", upto("l", "r")).withColumn("gy", upto("d", "u")).select("unit", "gx", "gy")
        else:
            inside = lambda c: F.explode(F.sequence(F.col(c) * factor, F.col(c) * factor + factor - 1))
            cells = border.withColumn("gx", inside("gx")).withColumn("gy", inside("gy"))
        passed = materialize(touched_cells(e, ["unit"], size).select("unit", "gx", "gy").distinct(), "border")
        free = cells.join(passed, ["unit", "gx", "gy"], "left_anti")
        centres = free.select(F.struct("gx", "gy").alias("id"), "unit", ((F.col("gx") + 0.5) * size).alias("x"), ((F.col("gy") + 0.5) * size).alias("y"))
        inner.append((size, in_strips(centres, e, "id", "unit", size, ["unit"]).select("unit", "id.gx", "id.gy")))
        border = passed
    return inner, border


def points_in(points: DataFrame, edges: DataFrame, id_: str, unit: str, cell: float) -> DataFrame:
    """(id, unit) of points in polygons by a hierarchical cell cover: a point in a cell that lies in a unit needs no test, one in a cell that a
    boundary passes counts crossings with the edges of that unit in its row. Points on a shared edge are in exactly one unit."""
    inner, border = cell_cover(edges, unit, cell)
    at = lambda size: points.select(id_, "x", "y", F.floor(F.col("x") / size).alias("gx"), F.floor(F.col("y") / size).alias("gy"))
    found = [at(size).join(cover, ["gx", "gy"]).select(id_, F.col("unit").alias(unit)) for size, cover in inner]
    near = at(cell).join(border, ["gx", "gy"]).select(id_, "x", "y", "unit")
    e = edges.select(F.col(unit).alias("unit"), "x1", "y1", "x2", "y2")
    found.append(in_strips(near, e, id_, "unit", cell, ["unit"]).select(id_, F.col("unit").alias(unit)))
    return reduce(DataFrame.unionAll, found)


def unit_stats(points: DataFrame, inside: DataFrame, id_: str, unit: str, value: str) -> DataFrame:
    return points.join(inside, id_).groupBy(unit).agg(F.count("*").alias("n"), F.sum(value).alias("sum"), F.avg(value).alias("mean"))


def label_pixels(pixels: DataFrame, edges: DataFrame, unit: str, cell: float, size: float = 1.0, s: int = 1) -> DataFrame:
    """(row, col, unit, share): share of a pixel's s by s sub-pixel centres in each unit. Pixel (row, col) covers x in col .. col + size, y in row .. row + size."""
    steps = F.array(*[F.struct(F.lit((i + 0.5) / s).alias("dx"), F.lit((j + 0.5) / s).alias("dy"), F.lit(i * s + j).alias("k")) for i in range(s) for j in range(s)])
    subs = pixels.select("row", "col", F.explode(steps).alias("d")).select("row", "col", ((F.col("col") + F.col("d.dx")) * size).alias("x"), ((F.col("row") + F.col("d.dy")) * size).alias("y"), F.struct("row", "col", "d.k").alias("id"))
    found = points_in(subs, edges, "id", unit, cell)
    return found.groupBy(F.col("id.row").alias("row"), F.col("id.col").alias("col"), unit).agg((F.count("*") / (s * s)).alias("share"))


def zonal(pixels: DataFrame, labels: DataFrame, unit: str, floor: float = 0.0) -> DataFrame:
    """Area-weighted sum, mean, largest value, share of area above ``floor`` and the top pixel's share of the sum. Pixels are summed before units."""
    part = pixels.join(labels, ["row", "col"]).withColumn("__a", F.col("ha") * F.col("share"))
    sums = part.groupBy(unit).agg(F.sum(F.col("value") * F.col("share")).alias("sum"), (F.sum(F.col("value") * F.col("__a")) / F.sum("__a")).alias("mean"), F.max("value").alias("max"), (F.sum(F.when(F.col("value") > floor, F.col("__a")).otherwise(0.0)) / F.sum("__a")).alias("lit_share"), F.max(F.col("value") * F.col("share")).alias("__top"))
    return sums.withColumn("top_share", F.col("__top") / F.nullif(F.col("sum"), F.lit(0.0))).drop("__top")


def class_area(pixels: DataFrame, labels: DataFrame, unit: str, cls: Column, classes: list[str], mask: Column | None = None) -> DataFrame:
    """Hectares of each class by unit (and inside or outside ``mask``), a column a class."""
    part = pixels.join(labels, ["row", "col"]).withColumns({"__c": cls, "inside": mask if mask is not None else F.lit(True)})
    out = part.groupBy(unit, "inside").pivot("__c", classes).agg(F.sum(F.col("ha") * F.col("share")))
    return out.fillna(0.0, subset=classes)


def annual_loss(pixels: DataFrame, labels: DataFrame, unit: str, loss_year: str, cover: str, least: float) -> DataFrame:
    lost = pixels.filter((F.col(cover) >= least) & (F.col(loss_year) > 0)).join(labels, ["row", "col"])
    return lost.groupBy(unit, F.col(loss_year).alias("year")).agg(F.sum(F.col("ha") * F.col("share")).alias("loss_ha"))


def regrid(pixels: DataFrame, factor: int) -> DataFrame:
    """Coarse cells of factor by factor pixels: mean value and area."""
    return pixels.groupBy(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(F.avg("value").alias("value"), F.sum("ha").alias("ha"), F.count("*").alias("n"))


def segment_distance(px: Column, py: Column) -> Column:
    """Distance from a point to the segment (x1, y1) - (x2, y2)."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = dx * dx + dy * dy
    t = F.when(length == 0, 0.0).otherwise(F.least(F.greatest(((px - F.col("x1")) * dx + (py - F.col("y1")) * dy) / length, F.lit(0.0)), F.lit(1.0)))
    return F.hypot(px - F.col("x1") - t * dx, py - F.col("y1") - t * dy)


def dist_to(points: DataFrame, segments: DataFrame, id_: str, most: int = 20_000) -> DataFrame:
    """Distance to the nearest segment. Up to ``most`` segments, such as gates or one boundary, meet every point; more go through grids."""
    segments = segments.select(*[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    if segments.limit(most + 1).count() > most:
        return dist_by_grids(points, segments, id_)
    met = points.select(id_, "x", "y").join(F.broadcast(segments))
    return met.groupBy(id_).agg(F.min(segment_distance(F.col("x"), F.col("y"))).alias("distance"))


def dist_by_grids(points: DataFrame, segments: DataFrame, id_: str) -> DataFrame:
    """Distance to the nearest of any number of segments, by grids whose cells double from level to level.

    A point meets the segments in the cells around its own. All segments within a cell's size of it are among these, so that a nearest one
    within that size is the nearest of all; other points go on to the next level. Segments are placed by pieces no longer than a cell of the
    first level. Points whose coordinates are null or not finite have no distance.
    """
    ends = segments.agg(F.min(F.least("x1", "x2")).alias("x0"), F.min(F.least("y1", "y2")).alias("y0"), F.max(F.greatest("x1", "x2")).alias("x9"), F.max(F.greatest("y1", "y2")).alias("y9"), F.avg(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("mean"), F.count("*").alias("n")).first()
    wide = max(ends["x9"] - ends["x0"], ends["y9"] - ends["y0"], 1e-9)
    size = max(float(ends["mean"]), wide / math.sqrt(ends["n"]), wide / 1e6)
    # Pieces of a segment are no longer than a cell of the first level, so that each lies in four cells at most; all are kept whole for the distance.
    parts = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / size)).cast("int")
    cut = segments.withColumn("n", parts).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda u, v, k: F.col(u) + (F.col(v) - F.col(u)) * k / F.col("n")
    pieces = materialize(cut.select("x1", "y1", "x2", "y2", *[at(f"{c}1", f"{c}2", F.col("k") + d).alias(f"{c}{n}") for c in "xy" for n, d in (("a", 0), ("b", 1))]), "pieces")
    known = points.select(id_, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    finite = F.coalesce((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")), F.lit(False))  # NaN is above infinity here
    left, done = materialize(known.filter(finite), "points"), [known.filter(~finite).select(id_, F.lit(None).cast("double").alias("distance"))]
    while True:
        cell = lambda c: F.floor(c / size)
        span = lambda c: F.sequence(cell(F.least(f"{c}a", f"{c}b")), cell(F.greatest(f"{c}a", f"{c}b")))
        here = pieces.withColumn("gx", F.explode(span("x"))).withColumn("gy", F.explode(span("y"))).select("x1", "y1", "x2", "y2", "gx", "gy").distinct()
        around = left.withColumn("gx", F.explode(F.sequence(cell(F.col("x")) - 1, cell(F.col("x")) + 1))).withColumn("gy", F.explode(F.sequence(cell(F.col("y")) - 1, cell(F.col("y")) + 1)))
        met = around.join(here, ["gx", "gy"]).groupBy(id_).agg(F.min(segment_distance(F.col("x"), F.col("y"))).alias("distance"))
        found = materialize(met.filter(F.col("distance") <= size), "found")
        done.append(found)
        left = materialize(left.join(found, id_, "left_anti"), "points")
        if left.isEmpty():
            return reduce(DataFrame.unionAll, done)
        size *= 2


def adjacency(edges: DataFrame, unit: str, digits: int = 6) -> DataFrame:
    """(src, dst) of units that share a boundary point (queen), both ways."""
    corners = edges.select(F.col(unit).alias("u"), F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p"))
    corners = corners.select("u", F.round("p.x", digits).alias("x"), F.round("p.y", digits).alias("y")).distinct()
    return corners.withColumnRenamed("u", "src").join(corners.withColumnRenamed("u", "dst"), ["x", "y"]).filter("src <> dst").select("src", "dst").distinct()


def touches(adj: DataFrame, members: DataFrame) -> DataFrame:
    """Units outside ``members`` (unit) that touch one of them."""
    return adj.join(members.withColumnRenamed("unit", "dst"), "dst", "left_semi").select(F.col("src").alias("unit")).distinct().join(members, "unit", "left_anti")


def shape_stats(edges: DataFrame, unit: str) -> DataFrame:
    """Area, perimeter, compactness and centroid by the shoelace sums of a unit's edges in order."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    sums = edges.groupBy(unit).agg(F.sum(cross).alias("a"), F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("perimeter"), F.sum((F.col("x1") + F.col("x2")) * cross).alias("sx"), F.sum((F.col("y1") + F.col("y2")) * cross).alias("sy"))
    area = F.abs("a") / 2
    return sums.select(unit, area.alias("area"), "perimeter", (4 * 3.141592653589793 * area / F.nullif(F.col("perimeter") * F.col("perimeter"), F.lit(0.0))).alias("compactness"), (F.col("sx") / (3 * F.col("a"))).alias("cx"), (F.col("sy") / (3 * F.col("a"))).alias("cy"))


def treatment_groups(units: DataFrame, near: float) -> DataFrame:
    """Label by precedence from the flags border, gate, town, capital, near_settled and ``gate_km``: capital, town, gate, near_gate, border, spill, control."""
    near_gate = F.col("near_settled") & (F.col("gate_km") <= near)
    label = F.when(F.col("capital"), "capital").when(F.col("town"), "town").when(F.col("gate"), "gate").when(near_gate, "near_gate").when(F.col("border"), "border").when(F.col("near_settled"), "spill").otherwise("control")
    out = units.withColumns({"near_gate": near_gate, "group": label})
    return out.withColumn("clean_control", (F.col("group") == "control") & ~F.col("near_settled"))


def treatment_flags(pixels: DataFrame, unit: str, park: Column, old_park: Column, gate_units: DataFrame, gates: DataFrame, size: float) -> DataFrame:
    """(unit, border, gate, near_settled, gate_km) from pixels (row, col, unit), for ``treatment_groups``.

    ``park`` marks pixels inside any park, ``old_park`` those inside a long-standing one. A unit borders if a pixel of it lies in or beside
    an old park. Settled land is what lies outside parks: a unit is near if its settled land touches that of a unit in ``gate_units``
    (unit), itself included; ``gate_km`` is the distance of its settled land to the nearest of ``gates`` (x, y), in ``size`` a pixel. A unit
    without settled land is not near and has no distance.
    """
    flat = pixels.select("row", "col", F.col(unit).alias("unit"), F.coalesce(park, F.lit(False)).alias("park"), F.coalesce(old_park, F.lit(False)).alias("old"))
    beside = F.explode(F.array(*[F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    reach = lambda rows: rows.select(beside.alias("p")).select("p.row", "p.col").distinct()
    gate_unit = gate_units.select("unit").distinct()
    border = flat.join(reach(flat.filter("old")), ["row", "col"], "left_semi").select("unit", F.lit(True).alias("border")).distinct()
    settled = flat.filter("NOT park")
    near = settled.join(reach(settled.join(gate_unit, "unit", "left_semi")), ["row", "col"], "left_semi").select("unit", F.lit(True).alias("near_settled")).distinct()
    spots = settled.select(F.struct("unit", "row", "col").alias("id"), ((F.col("col") + 0.5) * size).alias("x"), ((F.col("row") + 0.5) * size).alias("y"))
    far = dist_to(spots, gates.select(F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2")), "id").groupBy(F.col("id.unit").alias("unit")).agg(F.min("distance").alias("gate_km"))
    out = flat.select("unit").distinct()
    for one in (border, near, far, gate_unit.withColumn("gate", F.lit(True))):
        out = out.join(one, "unit", "left")
    return out.select("unit", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("border", "gate", "near_settled")], "gate_km")


def spatial_block(df: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """Fixed blocks as cluster ids, counted from the least coordinates."""
    least = df.agg(F.min(x).alias("__x"), F.min(y).alias("__y"))  # one row
    joined = df.crossJoin(F.broadcast(least))
    block = F.concat_ws("_", F.floor((F.col(x) - F.col("__x")) / size), F.floor((F.col(y) - F.col("__y")) / size))
    return joined.withColumn("block", block).drop("__x", "__y")


def crossings(lines: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """(line, t): where on its way, from 0 to 1, a segment ``lines`` (line, x1, y1, x2, y2) meets an edge. Both are cut to the rows and cells of a grid that they pass."""
    q = touched_cells(edges.select("x1", "y1", "x2", "y2"), [], cell).withColumnsRenamed({c: f"e{c}" for c in ("x1", "y1", "x2", "y2")})
    met = touched_cells(lines, ["line"], cell).join(q, ["gx", "gy"])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ex, ey = F.col("ex2") - F.col("ex1"), F.col("ey2") - F.col("ey1")
    det = F.nullif(dx * ey - dy * ex, F.lit(0.0))
    px, py = F.col("ex1") - F.col("x1"), F.col("ey1") - F.col("y1")
    length = F.nullif(dx * dx + dy * dy, F.lit(0.0))
    # Along a parallel edge on the same line, its two ends count.
    ends = F.when(det.isNull() & (px * dy == py * dx) & (length > 0), F.array((px * dx + py * dy) / length, ((px + ex) * dx + (py + ey) * dy) / length))
    t, u = (px * ey - py * ex) / det, (px * dy - py * dx) / det
    hit = F.when(det.isNotNull() & u.between(-1e-12, 1 + 1e-12), F.array(t))
    return met.select("line", F.explode(F.coalesce(hit, ends)).alias("t")).filter("t > 0 AND t < 1").distinct()


def length_by_unit(lines: DataFrame, edges: DataFrame, id_: str, unit: str, cell: float) -> DataFrame:
    """Line length in each unit, exact: segments are cut wherever they meet an edge, and each piece lies in the units of its middle.

    A piece along a boundary counts for the unit that its middle counts for. ``lines`` may have several segments an id.
    """
    rows = materialize(lines.select(F.struct(F.col(id_).alias("id"), "x1", "y1", "x2", "y2").alias("line"), "x1", "y1", "x2", "y2").distinct(), "lines")
    cuts = crossings(rows, edges, cell).groupBy("line").agg(F.array_sort(F.collect_set("t")).alias("ts"))  # the crossings of one segment
    ts = F.concat(F.array(F.lit(0.0)), F.coalesce("ts", F.array().cast("array<double>")), F.array(F.lit(1.0)))
    pieces = rows.join(cuts, "line", "left").withColumn("ts", ts).select("line", "x1", "y1", "x2", "y2", F.posexplode(F.transform(F.slice("ts", 2, F.size("ts")), lambda v, i: F.struct(F.get("ts", i).alias("a"), v.alias("b")))).alias("k", "p"))
    mid = (F.col("p.a") + F.col("p.b")) / 2
    middle = materialize(pieces.select(F.struct("line", "k").alias("id"), (F.col("x1") + mid * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + mid * (F.col("y2") - F.col("y1"))).alias("y"), ((F.col("p.b") - F.col("p.a")) * F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("part")), "pieces")
    return middle.join(points_in(middle, edges, "id", unit, cell), "id").groupBy(unit).agg(F.sum("part").alias("length"))


def overlap_area(a: DataFrame, b: DataFrame, unit_a: str, unit_b: str, cell: float) -> DataFrame:
    """(unit_a, unit_b, area) of polygons that overlap, exact: ``a`` and ``b`` are edge rows that go round each polygon one way, holes the other.

    A polygon is the sum, with signs, of the strips to the left of its edges. Two strips share the integral of the lesser of two
    straight lines over their common heights, which is closed; so an overlap is one sum over pairs of edges, and corners that meet
    or sides that run along each other need no care. Edges are cut to the rows of a grid; within a row they meet once, in the
    cell where both polygons' frames have begun, and only where frames overlap.

    Polygons of a layer with the same edges are one shape: edges meet shape by shape, and pairs of polygons are only listed at the end.
    """

    def shapes(edges: DataFrame, unit: str, tag: str) -> tuple[DataFrame, DataFrame]:
        """Edges of one polygon of each shape, and (shape, polygon) of all. A shape is known by two hashes of its edges, in any order, and their number."""
        sides = [F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]
        known = edges.groupBy(F.col(unit).alias("u")).agg(F.bit_xor(F.xxhash64(*sides)).alias("h"), F.sum(F.shiftright(F.xxhash64(F.lit(tag), *sides), 24)).alias("k"), F.count("*").alias("n"))
        first = known.groupBy("h", "k", "n").agg(F.min("u").alias(f"{tag}u"))
        members = materialize(known.join(first, ["h", "k", "n"]).select(F.col("u").alias(f"{tag}m"), f"{tag}u"), "shapes")
        return edges.join(members.select(F.col(f"{tag}u").alias(unit)).distinct(), unit, "left_semi"), members

    def strips(edges: DataFrame, unit: str, tag: str) -> DataFrame:
        frame = edges.groupBy(F.col(unit).alias("u")).agg(F.min(F.least("x1", "x2")).alias("l"), F.max(F.greatest("x1", "x2")).alias("r"))
        up = edges.filter("y1 <> y2").select(F.col(unit).alias("u"), F.when(F.col("y2") > F.col("y1"), 1.0).otherwise(-1.0).alias("s"), *[F.when(F.col("y2") > F.col("y1"), F.col(p)).otherwise(F.col(q)).alias(p) for p, q in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))])
        rows = up.join(frame, "u").withColumn("gy", F.explode(F.sequence(F.floor(F.col("y1") / cell), F.floor(F.col("y2") / cell))))
        slope = (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
        low, high = F.greatest("y1", F.col("gy") * cell), F.least("y2", (F.col("gy") + 1) * cell)
        rows = rows.select("u", "s", "l", "r", "gy", (F.col("x1") - slope * F.col("y1")).alias("c"), slope.alias("m"), low.alias("lo"), high.alias("hi")).filter("hi > lo")
        first = F.floor(F.col("l") / cell)
        return rows.select(*[F.col(c).alias(f"{tag}{c}") for c in ("u", "s", "l", "r", "c", "m", "lo", "hi")], first.alias(f"{tag}first"), "gy", F.explode(F.sequence(first, F.floor(F.col("r") / cell))).alias("gx"))

    (a, of_a), (b, of_b) = shapes(a, unit_a, "a"), shapes(b, unit_b, "b")
    met = strips(a, unit_a, "a").join(strips(b, unit_b, "b"), ["gx", "gy"])
    met = met.filter((F.col("gx") == F.greatest("afirst", "bfirst")) & (F.col("al") < F.col("br")) & (F.col("bl") < F.col("ar")))
    lo, hi, base = F.greatest("alo", "blo"), F.least("ahi", "bhi"), F.greatest("al", "bl")
    line = lambda t, y: F.col(f"{t}c") + F.col(f"{t}m") * y - base
    whole = lambda t, p, q: (line(t, p) + line(t, q)) / 2 * (q - p)
    cross = (F.col("bc") - F.col("ac")) / F.nullif(F.col("am") - F.col("bm"), F.lit(0.0))
    lesser = lambda p, q: F.when(line("a", (p + q) / 2) <= line("b", (p + q) / 2), whole("a", p, q)).otherwise(whole("b", p, q))
    part = F.when((F.col("am") != F.col("bm")) & (cross > lo) & (cross < hi), lesser(lo, cross) + lesser(cross, hi)).otherwise(lesser(lo, hi))
    sums = met.filter(hi > lo).groupBy("au", "bu").agg(F.abs(F.sum(F.col("as") * F.col("bs") * part)).alias("area")).filter("area > 1e-9")
    return sums.join(of_a, "au").join(of_b, "bu").select(F.col("am").alias(unit_a), F.col("bm").alias(unit_b), "area")


def overlap_by_unit(pixels: DataFrame, a: DataFrame, b: DataFrame, unit_a: str, unit_b: str) -> DataFrame:
    """Area that units of two layers share, through their common pixel labels; the error is that of the pixels."""
    return pixels.join(a, ["row", "col"]).join(b.withColumnRenamed("share", "share_b"), ["row", "col"]).groupBy(unit_a, unit_b).agg(F.sum(F.col("ha") * F.col("share") * F.col("share_b")).alias("ha"))


def terrain(pixels: DataFrame, labels: DataFrame, unit: str, step: float) -> DataFrame:
    """Mean and deviation of height and mean slope in degrees, from central differences with the four neighbours."""
    beside = [("e", 0, 1), ("w", 0, -1), ("n", -1, 0), ("s", 1, 0)]
    shifted = pixels.select(F.explode(F.array(*[F.struct((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.lit(k).alias("k"), F.col("value").alias("v")) for k, dr, dc in beside])).alias("q")).select("q.*")
    around = shifted.groupBy("row", "col").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k, _, _ in beside])
    slope = F.degrees(F.atan(F.hypot((F.col("e") - F.col("w")) / (2 * step), (F.col("n") - F.col("s")) / (2 * step))))
    part = pixels.join(around, ["row", "col"], "left").withColumn("slope", slope).join(labels, ["row", "col"])
    return part.groupBy(unit).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.avg("slope").alias("slope"))


def rain_climate(df: DataFrame, unit: str, year: str, month: str, rain: str, dry: float, drought: float) -> DataFrame:
    """Mean and CV of yearly rain, mean number of dry months, share of years under ``drought`` times the mean."""
    years = df.groupBy(unit, year).agg(F.sum(rain).alias("y"), F.count_if(F.col(rain) < dry).alias("dry"))
    years = years.withColumn("__m", F.avg("y").over(Window.partitionBy(unit)))
    return years.groupBy(unit).agg(F.avg("y").alias("mean"), (F.stddev_samp("y") / F.avg("y")).alias("cv"), F.avg("dry").alias("dry_months"), F.avg((F.col("y") < drought * F.col("__m")).cast("double")).alias("drought_share"))


def reduce_regions(pixels: DataFrame, labels: DataFrame, unit: str, date_code: str, probability: str, least: float) -> DataFrame:
    """Alert area by unit and year (date codes YYDOY) and mean probability."""
    part = pixels.join(labels, ["row", "col"]).withColumn("year", (2000 + F.floor(F.col(date_code) / 1000)).cast("int"))
    return part.groupBy(unit, "year").agg(F.sum(F.when(F.col(probability) >= least, F.col("ha") * F.col("share")).otherwise(0.0)).alias("alert_ha"), F.avg(probability).alias("probability"))


def spatial_lag(df: DataFrame, adj: DataFrame, unit: str, x: str) -> DataFrame:
    """``z`` (deviation from the mean) and ``lag`` (mean z of neighbours, row-standardised)."""
    mean = df.agg(F.avg(x).alias("__m"))  # one row
    z = df.crossJoin(F.broadcast(mean)).select(F.col(unit).alias("unit"), (F.col(x) - F.col("__m")).alias("z"))
    lag = adj.join(z.withColumnRenamed("unit", "dst"), "dst").groupBy("src").agg(F.avg("z").alias("lag")).withColumnRenamed("src", "unit")
    return z.join(lag, "unit", "left").withColumnRenamed("unit", unit)


def keyed_place(number: Column, key: Column, n: Column, seed: int, rounds: int = 6) -> Column:
    """One step of a keyed bijection on 0 .. a * b - 1, the least such product of about equal sides that holds ``n``.

    The number is split into two digits; in each round one digit moves by a hash of the other, so every round can be undone.
    """
    from .econ import draw

    a = F.ceil(F.sqrt(n)).cast("long")
    b = F.ceil(n / a).cast("long")
    left, right = F.floor(number / b).cast("long"), F.pmod(number, b)
    for i in range(rounds):
        if i % 2:
            right = F.pmod(right + draw(seed, key, F.lit(i), left), b)
        else:
            left = F.pmod(left + draw(seed, key, F.lit(i), right), a)
    return left * b + right


def deals(ids: DataFrame, number: str, n: int, perms: int, seed: int) -> DataFrame:
    """``ids`` once for each draw, with the number ``to`` that a permutation of 0 .. n - 1 gives: arithmetic alone, without any sort or window.

    Numbers that fall outside are taken on until they come back; few do, and fewer each time.
    """
    every = ids.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(perms - 1))))
    step = lambda rows, c: rows.withColumn("to", keyed_place(F.col(c), F.col("draw"), F.lit(n), seed))
    now = materialize(step(every, number), "deals")
    inside, outside = now.filter(F.col("to") < n), now.filter(F.col("to") >= n)
    while outside.limit(1).count():
        again = materialize(step(outside, "to"), "deals")
        inside, outside = inside.unionByName(again.filter(F.col("to") < n)), again.filter(F.col("to") >= n)
    return inside


def moran(df: DataFrame, adj: DataFrame, unit: str, x: str, perms: int = 0, seed: int = 1) -> DataFrame:
    """Moran's I with row-standardised weights and, with ``perms``, a permutation p: values are dealt anew over units by a keyed bijection."""
    base = spatial_lag(df, adj, unit, x)
    value = base.agg((F.sum(F.col("z") * F.col("lag")) / F.sum(F.col("z") * F.col("z"))).alias("moran"))
    if not perms:
        return value
    ids = materialize(row_numbers(base.select(unit, "z"), [], [unit]).select(unit, "z", (F.col("__r") - 1).alias("r")), "numbered")
    places = deals(ids.select(unit, "r"), "r", ids.count(), perms, seed)
    dealt = materialize(places.join(ids.select(F.col("r").alias("to"), "z"), "to").select("draw", unit, "z"), "dealt")
    lag = adj.join(dealt.withColumnRenamed(unit, "dst"), "dst").groupBy("draw", F.col("src").alias(unit)).agg(F.avg("z").alias("lag"))
    stats = dealt.join(lag, ["draw", unit]).groupBy("draw").agg((F.sum(F.col("z") * F.col("lag")) / F.sum(F.col("z") * F.col("z"))).alias("i"))
    return value.crossJoin(stats).groupBy("moran").agg(((1 + F.count_if(F.abs("i") >= F.abs("moran"))) / (1 + F.count("*"))).alias("p"))


def lisa(df: DataFrame, adj: DataFrame, unit: str, x: str) -> DataFrame:
    """Local statistic and quadrant of each unit."""
    base = spatial_lag(df, adj, unit, x)
    m2 = base.agg(F.avg(F.col("z") * F.col("z")).alias("__m2"))  # one row
    quadrant = F.concat(F.when(F.col("z") >= 0, "H").otherwise("L"), F.when(F.col("lag") >= 0, "H").otherwise("L"))
    return base.crossJoin(F.broadcast(m2)).select(unit, (F.col("z") * F.col("lag") / F.col("__m2")).alias("local"), quadrant.alias("quadrant"))
