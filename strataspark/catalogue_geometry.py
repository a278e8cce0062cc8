"""Queries on scalars, frames, segments and supports, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import register
from .functions import angles, colours, frames, lines, profiles, supports, tidy
from .functions.grid import Grid
from .operators import statistics

XYZ = ("X", "Y", "Z")
UNIT_GRID = Grid((0.0, 0.0, 0.0), (11, 11, 11), (5.0, 5.0, 5.0))
FRAME = frames.LocalFrame((5.0, 3.0, 2.0), 37.0)


def _xyz(v: angles.Vector, digits: int = 6) -> list:
    return [tidy(c, digits).alias(n) for c, n in zip(v, ("x", "y", "z"), strict=True)]


def _point(*names: str) -> tuple:
    return tuple(F.col(n) for n in names)


# ---- frames

_FIT = "f AS (SELECT avg(X) AS tx, avg(Y) AS ty, -acos(abs(cos(0.5*atan2(2*covar_pop(X, Y), var_pop(X) - var_pop(Y))))) AS a FROM obs_points)"


@register("obs_points", f"WITH {_FIT} SELECT round(tx, 5)+0.0 AS tx, round(ty, 5)+0.0 AS ty, round(a, 5)+0.0 AS angle FROM f")
def euclidean_fit(p: DataFrame) -> DataFrame:
    return frames.fitted(p).select(*[tidy(F.col(c), 5).alias(c) for c in ("tx", "ty", "angle")])


@register("obs_points", f"WITH {_FIT} SELECT pid, round((X-tx)*cos(a) - (Y-ty)*sin(a), 4)+0.0 AS x, round((X-tx)*sin(a) + (Y-ty)*cos(a), 4)+0.0 AS y FROM obs_points, f")
def euclidean_transform(p: DataFrame) -> DataFrame:
    joined = p.crossJoin(F.broadcast(frames.fitted(p)))  # one row
    x, y = frames.turned(F.col("X") - F.col("tx"), F.col("Y") - F.col("ty"), F.col("angle"))
    return joined.select("pid", tidy(x, 4).alias("x"), tidy(y, 4).alias("y"))


@register("obs_points", "SELECT pid, round(X, 4)+0.0 AS x, round(Y + 0.00000001, 4)+0.0 AS y FROM obs_points")
def euclidean_round_trip(p: DataFrame) -> DataFrame:
    """Transformed and back."""
    joined = p.crossJoin(F.broadcast(frames.fitted(p)))
    x, y = frames.turned(F.col("X") - F.col("tx"), F.col("Y") - F.col("ty"), F.col("angle"))
    x, y = frames.turned(x, y, -F.col("angle"))
    return joined.select("pid", tidy(x + F.col("tx"), 4).alias("x"), tidy(y + F.col("ty") + 1e-8, 4).alias("y"))


@register("obs_points", "SELECT pid, round(cos(radians(37))*(X-5) - sin(radians(37))*(Y-3), 6)+0.0 AS x, round(sin(radians(37))*(X-5) + cos(radians(37))*(Y-3), 6)+0.0 AS y, round(Z-2, 6)+0.0 AS z FROM obs_points")
def box_project(p: DataFrame) -> DataFrame:
    return p.select("pid", *_xyz(FRAME.to_local(_point(*XYZ))))


@register("obs_points", "SELECT pid, round(cos(radians(37))*X + sin(radians(37))*Y + 5, 6)+0.0 AS x, round(-sin(radians(37))*X + cos(radians(37))*Y + 3, 6)+0.0 AS y, round(Z+2, 6)+0.0 AS z FROM obs_points")
def box_reproject(p: DataFrame) -> DataFrame:
    return p.select("pid", *_xyz(FRAME.to_world(_point(*XYZ))))


_NV = "n AS (SELECT oid, sin(radians(dip))*cos(radians(strike)) AS nx, -sin(radians(dip))*sin(radians(strike)) AS ny, cos(radians(dip)) AS nz FROM obs_orient)"


@register("obs_orient", f"WITH {_NV} SELECT oid, round(cos(radians(37))*nx - sin(radians(37))*ny, 5)+0.0 AS x, round(sin(radians(37))*nx + cos(radians(37))*ny, 5)+0.0 AS y, round(nz, 5)+0.0 AS z FROM n")
def box_project_vectors(o: DataFrame) -> DataFrame:
    return o.select("oid", *_xyz(FRAME.vectors_to_local(angles.strike_dip_normal("strike", "dip")), 5))


@register("obs_orient", f"WITH {_NV} SELECT oid, round(cos(radians(37))*nx + sin(radians(37))*ny, 5)+0.0 AS x, round(-sin(radians(37))*nx + cos(radians(37))*ny, 5)+0.0 AS y, round(nz, 5)+0.0 AS z FROM n")
def box_reproject_vectors(o: DataFrame) -> DataFrame:
    return o.select("oid", *_xyz(FRAME.vectors_to_world(angles.strike_dip_normal("strike", "dip")), 5))


@register("obs_points", "SELECT pid, round((X - 1)/50.0 + 0.000000001, 6)+0.0 AS x, round(Y/50.0 + 0.000000001, 6)+0.0 AS y, round(Z/50.0 + 0.000000001, 6)+0.0 AS z FROM obs_points")
def model_scale(p: DataFrame) -> DataFrame:
    """World to a model of size one."""
    return p.select("pid", *_xyz(tuple(c / 50.0 + 1e-9 for c in (F.col("X") - 1, F.col("Y"), F.col("Z")))))


@register("obs_points", "SELECT pid, round(X*50.0 + 1, 6)+0.0 AS x, round(Y*50.0, 6)+0.0 AS y, round(Z*50.0, 6)+0.0 AS z FROM obs_points")
def model_rescale(p: DataFrame) -> DataFrame:
    return p.select("pid", *_xyz((F.col("X") * 50.0 + 1, F.col("Y") * 50.0, F.col("Z") * 50.0)))


@register("obs_points", "WITH b AS (SELECT min(X) AS x0, max(X) AS x1, min(Y) AS y0, max(Y) AS y1 FROM obs_points WHERE feature_name = 'A') SELECT pid, X BETWEEN x0 - 0.1*(x1-x0) AND x1 + 0.1*(x1-x0) AND Y BETWEEN y0 - 0.1*(y1-y0) AND y1 + 0.1*(y1-y0) AS inside FROM obs_points, b")
def box_map_view(p: DataFrame) -> DataFrame:
    """The box of one feature's data in map view, a tenth wider on all sides, as a mask of all points."""
    box = p.where("feature_name = 'A'").agg(*[f(a).alias(f"{n}{a}") for a in ("X", "Y") for f, n in ((F.min, "low"), (F.max, "high"))])
    masks = []
    for a in ("X", "Y"):
        more = F.lit(0.1) * (F.col(f"high{a}") - F.col(f"low{a}"))
        masks.append(F.col(a).between(F.col(f"low{a}") - more, F.col(f"high{a}") + more))
    return p.crossJoin(F.broadcast(box)).select("pid", (masks[0] & masks[1]).alias("inside"))


# ---- colours and small rules


@register("strat_units", "SELECT unit, '#' || substr(md5('7:' || unit), 1, 6) AS colour FROM strat_units")
def hex_colours(u: DataFrame) -> DataFrame:
    return u.select("unit", colours.of_name(F.col("unit"), 7).alias("colour"))


_HEX = "h AS (SELECT unit, CASE WHEN pos % 2 = 0 THEN '#' || substr(md5(unit), 1, 6) ELSE '#' || substr(md5(unit), 1, 3) END AS c FROM strat_units), f AS (SELECT unit, CASE WHEN length(c) = 4 THEN substr(c,2,1)||substr(c,2,1)||substr(c,3,1)||substr(c,3,1)||substr(c,4,1)||substr(c,4,1) ELSE substr(c,2) END AS d FROM h)"


@register("strat_units", f"WITH {_HEX} SELECT unit, round(('0x'||substr(d,1,2))::INT/255.0, 6) AS red, round(('0x'||substr(d,3,2))::INT/255.0, 6) AS green, round(('0x'||substr(d,5,2))::INT/255.0, 6) AS blue, 1.0::DOUBLE AS alpha FROM f")
def colour_shares(u: DataFrame) -> DataFrame:
    text = F.concat(F.lit("#"), F.substring(F.md5("unit"), 1, 6))
    short = F.concat(F.lit("#"), F.substring(F.md5("unit"), 1, 3))
    shares = colours.rgb(F.when(F.col("pos") % 2 == 0, text).otherwise(short))
    return u.select("unit", *[F.round(c, 6).alias(n) for c, n in zip(shares, ("red", "green", "blue"), strict=True)], F.lit(1.0).alias("alpha"))


@register("obs_points", "SELECT round(sqrt(0.05*(max(X)-min(X))*(max(Y)-min(Y))), 6)+0.0 AS least FROM obs_points")
def minimum_fault_length(p: DataFrame) -> DataFrame:
    """The side of a square of a twentieth of the map."""
    width, height = (F.max(a) - F.min(a) for a in ("X", "Y"))
    return p.agg(tidy(F.sqrt(0.05 * width * height)).alias("least"))


@register("obs_points", "SELECT pid, 1.0::DOUBLE AS one, 0.0::DOUBLE AS zero, 2.5::DOUBLE AS growth FROM obs_points")
def constant_profiles(p: DataFrame) -> DataFrame:
    """The profiles that don't depend on a place: ones, zeros and constant growth."""
    return p.select("pid", F.lit(1.0).alias("one"), F.lit(0.0).alias("zero"), F.lit(2.5).alias("growth"))


@register("obs_points", "SELECT * FROM (VALUES ('plutons', 0.81, 0.12, 1.08, 1.38), ('laccoliths', 0.92, 0.11, 0.12, 0.02), ('major_mafic_sills', 0.85, 0.1, 0.01, 0.02), ('mesoscale_mafic_sills', 0.49, 0.13, 0.47, 0.33), ('minor_mafic_sills', 0.91, 0.25, 0.27, 0.04)) t(kind, exponent, exponent_dev, factor, factor_dev)")
def scaling_parameters(p: DataFrame) -> DataFrame:
    rows = [(k, *v) for k, v in profiles.SCALING.items()]
    return p.sparkSession.createDataFrame(rows, "kind string, exponent double, exponent_dev double, factor double, factor_dev double")


@register("obs_points", "SELECT pid, round(X + 0.6*1.08*pow(val + 1, 0.81), 6)+0.0 AS x, round(Y, 6)+0.0 AS y, round(Z + 0.8*1.08*pow(val + 1, 0.81), 6)+0.0 AS z FROM obs_points")
def scaled_contacts(p: DataFrame) -> DataFrame:
    """Contact points moved along the inflation vector by the thickness that their length scales to."""
    t = profiles.scaled_thickness(F.col("val") + 1, "plutons")
    return p.select("pid", *_xyz((F.col("X") + 0.6 * t, F.col("Y") + 0.0, F.col("Z") + 0.8 * t)))


HEADINGS = {
    "location": ("X", "Y", "Z"), "value": ("X", "Y", "Z", "feature_name", "val"), "normal": ("X", "Y", "Z", "feature_name", "nx", "ny", "nz"),
    "strike_dip": ("X", "Y", "Z", "feature_name", "strike", "dip"), "gradient": ("X", "Y", "Z", "feature_name", "gx", "gy", "gz"),
}


@register("strat_units", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {i}, '{c}')" for k, cs in HEADINGS.items() for i, c in enumerate(cs)) + ") t(kind, place, name)")
def headings(u: DataFrame) -> DataFrame:
    """The columns of each kind of observation."""
    return u.sparkSession.createDataFrame([(k, i, c) for k, cs in HEADINGS.items() for i, c in enumerate(cs)], "kind string, place int, name string")


# ---- triangles and tetrahedra


@register("obs_points", "SELECT pid, round(sqrt(4*val*val + 0 + 4)/2, 6)+0.0 AS area, round(-2*val/sqrt(4*val*val + 4), 6)+0.0 AS x, 0.0::DOUBLE AS y, round(2/sqrt(4*val*val + 4), 6)+0.0 AS z FROM obs_points")
def triangle_normals(p: DataFrame) -> DataFrame:
    """Area and normal of the triangle (X, Y, Z), (X + 1, Y, Z + val), (X, Y + 2, Z)."""
    x, y, z = _point(*XYZ)
    a, b, c = (x, y, z), (x + 1, y, z + F.col("val")), (x, y + 2, z)
    normal = angles.cross(tuple(q - o for q, o in zip(b, a, strict=True)), tuple(q - o for q, o in zip(c, a, strict=True)))
    return p.select("pid", tidy(angles.length(normal) / 2.0).alias("area"), *_xyz(angles.unit(normal)))


@register("obs_points", "SELECT pid, 2.0::DOUBLE AS x, -3.0::DOUBLE AS y, round(val, 6)+0.0 AS z FROM obs_points")
def tetrahedron_gradient(p: DataFrame) -> DataFrame:
    """The slope of the values 2 X - 3 Y + val Z at four scaled offsets of each point: differences through the inverse of the edges."""
    size = 1.5
    corners = [(0.0, 0.0, 0.0), (size, 0.0, 0.0), (0.0, size, 0.0), (size, size, -size)]
    place = [[F.col(a) + o for a, o in zip(XYZ, c, strict=True)] for c in corners]
    value = [2.0 * q[0] - 3.0 * q[1] + F.col("val") * q[2] for q in place]
    e = [[q[a] - place[0][a] for a in range(3)] for q in place[1:]]
    d = [v - value[0] for v in value[1:]]
    det = angles.dot(tuple(e[0]), angles.cross(tuple(e[1]), tuple(e[2])))
    rows = [angles.cross(tuple(e[1]), tuple(e[2])), angles.cross(tuple(e[2]), tuple(e[0])), angles.cross(tuple(e[0]), tuple(e[1]))]
    return p.select("pid", *_xyz(tuple((d[0] * rows[0][a] + d[1] * rows[1][a] + d[2] * rows[2][a]) / det for a in range(3))))


@register("strat_units", "SELECT 2*(i + 7*j) + h AS triangle, CASE WHEN h = 0 THEN i + 8*j ELSE i + 1 + 8*(j+1) END AS n1, CASE WHEN h = 0 THEN i + 1 + 8*j ELSE i + 8*(j+1) END AS n2, CASE WHEN h = 0 THEN i + 8*(j+1) ELSE i + 1 + 8*j END AS n3 FROM range(7) a(i), range(5) b(j), range(2) c(h)")
def plane_triangles(u: DataFrame) -> DataFrame:
    """Two triangles for each cell of a plane of 7 x 5 cells, as node numbers."""
    n = F.col("id")
    h, i, j = n % 2, F.floor(n / 2) % 7, F.floor(n / 14)
    low = F.when(h == 0, i + 8 * j).otherwise(i + 1 + 8 * (j + 1))
    return u.sparkSession.range(70).select(n.alias("triangle"), low.alias("n1"), F.when(h == 0, i + 1 + 8 * j).otherwise(i + 8 * (j + 1)).alias("n2"), F.when(h == 0, i + 8 * (j + 1)).otherwise(i + 1 + 8 * j).alias("n3"))


@register("strat_units", "SELECT face, count(*) AS n, 4*4*1.0::DOUBLE AS area FROM (SELECT face, i, j, h FROM range(6) f(face), range(4) a(i), range(4) b(j), range(2) c(h)) GROUP BY face")
def box_triangles(u: DataFrame) -> DataFrame:
    """The triangulated faces of a cube of 4 x 4 x 4 cells: number of triangles and area of each."""
    n = F.col("id")
    h, i, j, face = n % 2, F.floor(n / 2) % 4, F.floor(n / 8) % 4, F.floor(n / 32)
    flat = [(i + h, j + h), (i + 1 - h, j + h), (i + h, j + 1 - h)]
    # a face lies across one axis, at its lower or upper end
    corner = []
    for a, b in flat:
        fixed = (face % 2) * 4
        axis = F.floor(face / 2)
        corner.append((F.when(axis == 0, fixed).otherwise(a), F.when(axis == 1, fixed).when(axis == 0, a).otherwise(b), F.when(axis == 2, fixed).otherwise(b)))
    area = angles.length(angles.cross(*[tuple((q - o).cast("double") for q, o in zip(c, corner[0], strict=True)) for c in corner[1:]])) / 2.0
    return u.sparkSession.range(192).select(face.alias("face"), area.alias("area")).groupBy("face").agg(F.count("*").alias("n"), F.sum("area").alias("area"))


def _node_value(grid: Grid):  # noqa: ANN202
    """2 X - 3 Y + Z + 4 at a node."""
    nx, ny, _ = grid.nodes

    def of(node):  # noqa: ANN001, ANN202
        i, j, k = node % nx, F.floor(node / nx) % ny, F.floor(node / (nx * ny))
        return 2.0 * grid.step[0] * i - 3.0 * grid.step[1] * j + grid.step[2] * k + 4.0

    return of


@register("obs_points", "SELECT pid, round(2*X - 3*Y + Z + 4 + 0.0000001, 5)+0.0 AS value, 1.0::DOUBLE AS total, true AS inside FROM obs_points WHERE X <= 55 AND Y <= 55 AND Z <= 55")
def tetrahedral_value(p: DataFrame) -> DataFrame:
    """A linear function by the tetrahedron of each point; the weights sum to one and none is negative."""
    tets = supports.Tetrahedra(UNIT_GRID)
    df = tets.valued(tets.located(p).where("tet is not null"), _node_value(UNIT_GRID))
    b = [F.col(f"b{k}") for k in range(4)]
    return df.select("pid", tidy(tets.value() + 1e-7, 5).alias("value"), F.round(sum(b[1:], b[0]), 9).alias("total"), (F.least(*b) > -1e-9).alias("inside"))


@register("obs_points", "SELECT pid, 2.0::DOUBLE AS x, -3.0::DOUBLE AS y, 1.0::DOUBLE AS z FROM obs_points WHERE X <= 55 AND Y <= 55 AND Z <= 55")
def tetrahedral_gradient(p: DataFrame) -> DataFrame:
    tets = supports.Tetrahedra(UNIT_GRID)
    df = tets.valued(tets.located(p).where("tet is not null"), _node_value(UNIT_GRID))
    return df.select("pid", *_xyz(tets.gradient(), 6))


@register("obs_points", "SELECT pid, CAST(floor(X/5) + 11*(floor(Y/5) + 11*floor(Z/5)) AS BIGINT) AS cell, c AS corner, CAST(floor(X/5) + c % 2 + 12*(floor(Y/5) + c // 2 % 2 + 12*(floor(Z/5) + c // 4)) AS BIGINT) AS node FROM obs_points, range(8) t(c) WHERE X < 55 AND Y < 55 AND Z < 55")
def cell_corners(p: DataFrame) -> DataFrame:
    """The eight nodes of each point's cell."""
    cell = UNIT_GRID.cell()
    nodes = F.array(*[UNIT_GRID.corner(cell, c % 2, c // 2 % 2, c // 4).cast("bigint") for c in range(8)])
    inside = p.where("X < 55 AND Y < 55 AND Z < 55")
    return inside.select("pid", (cell[0] + 11 * (cell[1] + 11 * cell[2])).cast("bigint").alias("cell"), F.posexplode(nodes).alias("corner", "node")).withColumn("corner", F.col("corner").cast("bigint"))


@register("strat_units", "SELECT i + 7*(j + 6*k) AS node, i+x + 7*(j+y + 6*(k+z)) AS neighbour FROM range(1,6) a(i), range(1,5) b(j), range(1,4) c(k), range(-1,2) d(x), range(-1,2) e(y), range(-1,2) f(z)")
def grid_neighbours(u: DataFrame) -> DataFrame:
    """The 27 nodes around each inner node of a grid of 7 x 6 x 5 nodes."""
    nx, ny, nz = 7, 6, 5
    n = F.col("id")
    i, j, k = n % nx, F.floor(n / nx) % ny, F.floor(n / (nx * ny))
    inner = u.sparkSession.range(nx * ny * nz).where(i.between(1, nx - 2) & j.between(1, ny - 2) & k.between(1, nz - 2))
    around = F.array(*[F.lit(x + nx * (y + ny * z)) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)])
    return inner.select(n.alias("node"), F.explode(around).alias("d")).select("node", (F.col("node") + F.col("d")).cast("bigint").alias("neighbour"))


UNEVEN = supports.UnevenAxis((0.0, 1.0, 3.0, 4.5, 10.0, 20.0, 36.0, 51.0))


@register("obs_points", "WITH n AS (SELECT pid, X, [0.0, 1.0, 3.0, 4.5, 10.0, 20.0, 36.0, 51.0] AS a FROM obs_points), c AS (SELECT pid, X, a, least(len(list_filter(a, lambda q: q <= X)), 7) AS i FROM n) SELECT pid, i - 1 AS cell, round((X - a[i])/(a[i+1] - a[i]), 6)+0.0 AS place FROM c")
def uneven_cell(p: DataFrame) -> DataFrame:
    """The cell of an axis of uneven nodes, and the place in it."""
    return p.select("pid", UNEVEN.cell(F.col("X")).cast("bigint").alias("cell"), tidy(UNEVEN.local(F.col("X"))).alias("place"))


@register("obs_points", "WITH a AS (SELECT [0.0, 1.0, 3.0, 4.5, 10.0, 20.0, 36.0, 51.0] AS n), h AS (SELECT i, n[i+1]-n[i] AS l, n[i+2]-n[i+1] AS r FROM a, range(1,7) t(i)) SELECT CAST(i AS INT) AS node, round(2/(l*(l+r)), 9) AS before, round(-2/(l*(l+r)) - 2/(r*(l+r)), 9) AS here, round(2/(r*(l+r)), 9) AS after FROM h")
def uneven_second_difference(p: DataFrame) -> DataFrame:
    rows = [(i, *[round(w, 9) for w in UNEVEN.second_difference(i)]) for i in range(1, len(UNEVEN.nodes) - 1)]
    return p.sparkSession.createDataFrame(rows, "node int, before double, here double, after double")


_TRIANGLE = ((0.0, 0.0), (120.0, 0.0), (0.0, 130.0))


@register("obs_points", "SELECT pid, round(2*X - 3*Y + 1 + 0.0000001, 5)+0.0 AS value, round(X*X + X*Y + 0.0000001, 4)+0.0 AS quadratic, X/120 + Y/130 <= 1 AS inside FROM obs_points")
def triangle_value(p: DataFrame) -> DataFrame:
    """A linear function by the weights of one triangle, and a quadratic one by its six shape functions."""
    corners = [(F.lit(x), F.lit(y)) for x, y in _TRIANGLE]
    w = supports.triangle_weights((F.col("X"), F.col("Y")), corners)
    places = [*_TRIANGLE, *[tuple((a + b) / 2 for a, b in zip(_TRIANGLE[i], _TRIANGLE[j], strict=True)) for i in range(3) for j in range(i + 1, 3)]]
    linear = sum((c * (2 * x - 3 * y + 1) for c, (x, y) in zip(w[1:], _TRIANGLE[1:], strict=True)), w[0] * 1.0)
    shapes = supports.quadratic(w)
    second = sum((c * (x * x + x * y) for c, (x, y) in zip(shapes[1:], places[1:], strict=True)), shapes[0] * 0.0)
    return p.select("pid", tidy(linear + 1e-7, 5).alias("value"), tidy(second + 1e-7, 4).alias("quadratic"), (F.col("X") / 120 + F.col("Y") / 130 <= 1).alias("inside"))


# ---- lines

_ENDS = "e AS (SELECT oid, (oid % 50)*1.0 AS x, (oid % 37)*1.0 AS y, strike FROM obs_orient), l AS (SELECT oid, x + sin(radians(90-strike))*30 AS ax, y - cos(radians(90-strike))*30 AS ay, x - sin(radians(90-strike))*30 AS qx, y + cos(radians(90-strike))*30 AS qy FROM e)"
_CLIP = "c AS (SELECT *, qx-ax AS dx, qy-ay AS dy FROM l), t AS (SELECT *, greatest(0.0, CASE WHEN dx <> 0 THEN least((5-ax)/dx, (40-ax)/dx) WHEN ax < 5 OR ax > 40 THEN 2.0 ELSE 0.0 END, CASE WHEN dy <> 0 THEN least((4-ay)/dy, (30-ay)/dy) WHEN ay < 4 OR ay > 30 THEN 2.0 ELSE 0.0 END) AS t0, least(1.0, CASE WHEN dx <> 0 THEN greatest((5-ax)/dx, (40-ax)/dx) ELSE 1.0 END, CASE WHEN dy <> 0 THEN greatest((4-ay)/dy, (30-ay)/dy) ELSE 1.0 END) AS t1 FROM c)"


@register("obs_orient", f"WITH {_ENDS}, {_CLIP} SELECT oid, round(ax + t0*dx, 4)+0.0 AS x0, round(ay + t0*dy, 4)+0.0 AS y0, round(ax + t1*dx, 4)+0.0 AS x1, round(ay + t1*dy, 4)+0.0 AS y1 FROM t WHERE t0 + 1e-6 < t1")
def section_endpoints(o: DataFrame) -> DataFrame:
    """Lines across the strike through each place, cut to a box."""
    df = o.select("oid", "strike", (F.col("oid") % 50 * 1.0).alias("x"), (F.col("oid") % 37 * 1.0).alias("y"))
    a, b = lines.across((F.col("x"), F.col("y")), F.col("strike"), 30.0)
    df = df.select("oid", a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by"))
    t0, t1 = lines.clipped(_point("ax", "ay"), _point("bx", "by"), (F.lit(5.0), F.lit(4.0)), (F.lit(40.0), F.lit(30.0)))
    df = df.withColumns({"t0": t0, "t1": t1}).where(F.col("t0") + 1e-6 < F.col("t1"))
    at = lambda t, c: tidy(F.col(f"a{c}") + F.col(t) * (F.col(f"b{c}") - F.col(f"a{c}")), 4)
    return df.select("oid", at("t0", "x").alias("x0"), at("t0", "y").alias("y0"), at("t1", "x").alias("x1"), at("t1", "y").alias("y1"))


@register("trace_vertices", "WITH s AS (SELECT trace_id, seq, X, Y, lag(X) OVER w AS px, lag(Y) OVER w AS py FROM trace_vertices WINDOW w AS (PARTITION BY trace_id ORDER BY seq)) SELECT trace_id, count(*) AS n_vertices, count(DISTINCT (seq - 1) // 4) AS n_parts, round(coalesce(sum(sqrt((X-px)*(X-px) + (Y-py)*(Y-py))), 0), 4)+0.0 AS length FROM s GROUP BY trace_id")
def multiline_to_line(t: DataFrame) -> DataFrame:
    """Lines that come in parts of four vertices, joined into one each."""
    parts = t.withColumn("part", F.floor((F.col("seq") - 1) / 4)).groupBy("trace_id", "part").agg(F.sort_array(F.collect_list(F.struct("seq", "X", "Y"))).alias("v"))
    whole = parts.groupBy("trace_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "v"))), lambda p: p["v"])).alias("v"), F.count("*").alias("n_parts"))
    steps = F.zip_with(F.slice("v", 1, F.size("v") - 1), F.slice("v", 2, F.size("v")), lambda a, b: F.when(b.isNotNull(), F.hypot(b["X"] - a["X"], b["Y"] - a["Y"])).otherwise(0.0))
    return whole.select("trace_id", F.size("v").cast("bigint").alias("n_vertices"), "n_parts", tidy(F.when(F.size("v") > 1, F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0), 4).alias("length"))


# ---- variogram steps


@register("obs_points", "WITH d AS (SELECT X, count(*) AS n FROM obs_points WHERE feature_name = 'N' GROUP BY X), g AS (SELECT n, least(X - lag(X) OVER (ORDER BY X), lead(X) OVER (ORDER BY X) - X) AS gap FROM d), s AS (SELECT sum(n*gap)/sum(n)*4.0 AS step FROM g), r AS (SELECT step, CAST(ceil((SELECT max(X) - min(X) FROM d)/step) AS BIGINT) AS steps FROM s) SELECT round(CASE WHEN steps > 200 THEN step*steps/200 ELSE step END, 6)+0.0 AS step, least(steps, 200) AS steps FROM r")
def variogram_lags(p: DataFrame) -> DataFrame:
    """Four times the mean distance to the next other position, and the number of such steps in the range, 200 at most."""
    return statistics.lags(p.where("feature_name = 'N'"), "X").select(tidy(F.col("step")).alias("step"), "steps")


@register("obs_orient", "WITH b AS (SELECT round(dip) AS h, avg(strike) AS v FROM obs_orient GROUP BY 1), w AS (SELECT h, v, lag(v) OVER (ORDER BY h) AS a, lead(v) OVER (ORDER BY h) AS c FROM b), t AS (SELECT h, v FROM w WHERE (v > a AND v > c) OR (v < a AND v < c)), u AS (SELECT h, v, lag(v) OVER (ORDER BY h) AS a, lead(v) OVER (ORDER BY h) AS c FROM t), f AS (SELECT h FROM u WHERE v > 10 AND a < v*0.7 AND c < v*0.7) SELECT coalesce(min(h), (SELECT 2*(max(h) - min(h)) FROM b))+0.0 AS wavelength FROM f")
def fold_wavelength(o: DataFrame) -> DataFrame:
    """The first peak of a binned series that stands out by three tenths; without one, twice the range."""
    bins = o.groupBy(F.round("dip").alias("h")).agg(F.avg("strike").alias("v"))
    return statistics.wavelength(bins, "h", "v")


