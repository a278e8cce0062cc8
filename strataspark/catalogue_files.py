"""Queries that write model files into the shared folder and read them back, and queries on configurations and datasets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import register
from .catalogue_geometry import plane_triangles
from .functions import tidy
from .functions.grid import Grid
from .sinks import recipe, text
from .sources import config, files
from .sources.shared import shared_path

_V = "v AS (SELECT node, (node % 8) * 2.5 AS X, (node // 8) * 1.5 AS Y, (node * 7 % 13) / 4.0 AS Z FROM range(48) t(node))"
_T = "t AS (SELECT 2*(i + 7*j) + h AS triangle, CASE WHEN h = 0 THEN i + 8*j ELSE i + 1 + 8*(j+1) END AS n1, CASE WHEN h = 0 THEN i + 1 + 8*j ELSE i + 8*(j+1) END AS n2, CASE WHEN h = 0 THEN i + 8*(j+1) ELSE i + 1 + 8*j END AS n3 FROM range(7) a(i), range(5) b(j), range(2) c(h))"
_CORNERS = f"WITH {_V}, {_T} SELECT triangle, a.X AS x1, a.Z AS z1, b.Y AS y2, c.X AS x3, c.Z AS z3 FROM t JOIN v a ON a.node = n1 JOIN v b ON b.node = n2 JOIN v c ON c.node = n3"


def _surface(u: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = F.col("id")
    vertices = u.sparkSession.range(48).select(n.alias("node"), (n % 8 * 2.5).alias("X"), (F.floor(n / 8) * 1.5).alias("Y"), (n * 7 % 13 / 4.0).alias("Z"))
    return vertices, plane_triangles(u)


def _corners(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    out = triangles
    for i in (1, 2, 3):
        out = out.join(vertices.select(F.col("node").alias(f"n{i}"), *[F.col(a).alias(f"{a.lower()}{i}") for a in "XYZ"]), f"n{i}")
    return out.select("triangle", "x1", "z1", "y2", "x3", "z3")


def _round_trip(u: DataFrame, lines: DataFrame, read: Callable) -> DataFrame:
    return _corners(*read(u.sparkSession, text.save(lines, shared_path(u.sparkSession, "surface"))))


@register("strat_units", _CORNERS)
def surface_obj_file(u: DataFrame) -> DataFrame:
    return _round_trip(u, text.surface_obj(*_surface(u)), files.surface_obj)


@register("strat_units", _CORNERS)
def surface_gocad_file(u: DataFrame) -> DataFrame:
    return _round_trip(u, text.surface_gocad(*_surface(u), "plane"), files.surface_gocad)


@register("strat_units", f"WITH {_V} SELECT node AS number, X, Y, Z FROM v")
def surface_vtk_file(u: DataFrame) -> DataFrame:
    """The points of a surface, written as legacy VTK and read back."""
    spark = u.sparkSession
    path = text.save(text.surface_vtk(*_surface(u), "plane"), shared_path(spark, "vtk"))
    got = files.vtk_numbers(spark, path, "POINTS", 48)
    return got.select(F.col("number").cast("bigint").alias("number"), *[F.get(F.split("line", " "), F.lit(i)).cast("double").alias(a) for i, a in enumerate("XYZ")])


@register("strat_units", "SELECT line, section, place FROM (VALUES (0, 0, 'GOCAD TSurf 1'), (0, 2, 'name:plane'), (2, 0, 'TRGL 1 2 9'), (2, 69, 'TRGL 48 47 40'), (3, 0, 'END')) t(section, place, line)")
def surface_gocad_lines(u: DataFrame) -> DataFrame:
    """Some lines of a GOCAD surface, as they are in the file."""
    some = text.surface_gocad(*_surface(u), "plane")
    at = F.struct("section", F.col("place").cast("int"))
    return some.where(at.isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in ((0, 0), (0, 2), (2, 0), (2, 69), (3, 0))])).select("line", "section", F.col("place").cast("int").alias("place"))


@register("obs_orient", "SELECT oid AS number, strike + 0.0 AS X, dip + 0.0 AS Y, 0.0::DOUBLE AS Z, polarity + 0.0 AS value FROM obs_orient")
def points_gocad_file(o: DataFrame) -> DataFrame:
    spark = o.sparkSession
    points = o.select("oid", F.col("strike").alias("X"), F.col("dip").alias("Y"), F.lit(0.0).alias("Z"), F.col("polarity").cast("double").alias("value"))
    return files.points_gocad(spark, text.save(text.points_gocad(points, "turns", "oid", ["value"]), shared_path(spark, "vset")), ["value"])


@register("obs_orient", "SELECT row_number() OVER (ORDER BY oid) - 1 AS number, round(sin(radians(dip)), 6)+0.0 AS x FROM obs_orient")
def vectors_vtk_file(o: DataFrame) -> DataFrame:
    """Points with vectors; the vectors' first part read back."""
    spark = o.sparkSession
    rows = o.select("oid", *[F.lit(0.0).alias(a) for a in "XYZ"], F.sin(F.radians("dip")).alias("a"), F.lit(0.0).alias("b"), F.cos(F.radians("dip")).alias("c"))
    path = text.save(text.points_vtk(rows, "turns", "oid", ("a", "b", "c")), shared_path(spark, "vectors"))
    got = files.vtk_numbers(spark, path, "VECTORS", o.count())
    return got.select(F.col("number").cast("bigint").alias("number"), tidy(F.get(F.split("line", " "), F.lit(0)).cast("double"), 6).alias("x"))


@register("obs_points", "SELECT pid, X, Y, Z, val, feature_name FROM obs_points")
def points_csv_file(p: DataFrame) -> DataFrame:
    """Constraints written as CSV and read with their schema."""
    rows = p.select("pid", "X", "Y", "Z", "val", "feature_name")
    return files.points_csv(p.sparkSession, text.save_csv(rows, shared_path(p.sparkSession, "csv")))


@register("strat_units", "SELECT unit, grp, pos, thickness FROM strat_units")
def column_json_file(u: DataFrame) -> DataFrame:
    rows = u.select("unit", "grp", "pos", "thickness")
    return u.sparkSession.read.schema(rows.schema).json(text.save_json(rows, shared_path(u.sparkSession, "json")))


GRID = Grid((0.0, 1.0, 2.0), (5, 4, 3), (2.0, 2.5, 4.0))


@register("strat_units", "SELECT node AS number, (node * 5 % 17) + 0.0 AS value FROM range(120) t(node)")
def grid_vtk_file(u: DataFrame) -> DataFrame:
    """The node values of a grid, written as structured points and read back."""
    spark = u.sparkSession
    nodes = GRID.node_frame(spark).withColumn("value", (F.col("node") * 5 % 17).cast("double"))
    path = text.save(text.grid_vtk(GRID, nodes, "grid", ["value"]), shared_path(spark, "grid"))
    got = files.vtk_numbers(spark, path, "LOOKUP_TABLE", 120)
    return got.select(F.col("number").cast("bigint").alias("number"), F.col("line").cast("double").alias("value"))


@register("strat_units", "SELECT * FROM (VALUES ('AXIS_O', '0.000000 1.000000 2.000000'), ('AXIS_U', '10.000000 0.000000 0.000000'), ('AXIS_V', '0.000000 10.000000 0.000000'), ('AXIS_W', '0.000000 0.000000 12.000000'), ('AXIS_MIN', '0.000000 0.000000 0.000000'), ('AXIS_MAX', '1.000000 1.000000 1.000000'), ('AXIS_N', '6 5 4')) t(key, words)")
def voxet_header_file(u: DataFrame) -> DataFrame:
    spark = u.sparkSession
    path = text.save(text.voxet_header(spark, GRID, "block", {"unit": "block_unit@@"}), shared_path(spark, "voxet"))
    return spark.createDataFrame([(k, " ".join(v)) for k, v in files.voxet_header(spark, path).items()], "key string, words string")


@register("map_units", "SELECT CAST(rank AS BIGINT) AS number, 5 AS n, x0 AS first_x, y1 AS third_y FROM map_units")
def polygons_wkt_file(u: DataFrame) -> DataFrame:
    """Units as well-known text, one line each, and read back."""
    corners = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0")]
    rings = u.select("rank", F.array(*[F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for x, y in corners]).alias("ring"))
    got = files.wkt_rings(u.sparkSession, text.save(text.wkt_lines(rings, "rank", "ring"), shared_path(u.sparkSession, "wkt")))
    return got.select("number", F.size("ring").alias("n"), F.get("ring", F.lit(0))["x"].alias("first_x"), F.get("ring", F.lit(2))["y"].alias("third_y"))


@register("strat_units", "SELECT CAST(i AS INT) AS px, j AS py, CASE WHEN (i + j) % 5 = 4 THEN NULL ELSE (i*j) / 2.0 END AS value FROM range(9) a(i), range(6) b(j)")
def raster_file(u: DataFrame) -> DataFrame:
    """A raster as an ASCII grid and read back; gaps stay gaps."""
    spark, n = u.sparkSession, F.col("id")
    i, j = n % 9, F.floor(n / 9)
    cells = spark.range(54).select(i.alias("px"), j.alias("py"), F.when((i + j) % 5 != 4, (i * j) / 2.0).alias("v"))
    path = text.save(text.raster_ascii(cells, (9, 6), (0.0, 0.0), 1.0, "v"), shared_path(spark, "raster"))
    return files.raster_ascii(spark, path, (9, 6))


# ---- datasets and configurations


@register("strat_units", "SELECT x + 0.0 AS X, y + 0.0 AS Y, 2.0 + k AS Z, 2.0 + k AS val, 'strati' AS feature_name FROM range(10) a(x), range(10) b(y), range(2) c(k)")
def horizontal_layers(u: DataFrame) -> DataFrame:
    return files.horizontal(u.sparkSession)


@register("strat_units", "SELECT x + 0.0 AS X, y + 0.0 AS Y, round(CASE WHEN k = 1 THEN 3.5 + sin(pi()/6*x + pi()/2)*0.5 ELSE 2.0 END, 6)+0.0 AS Z, 2.0 + k AS val FROM range(10) a(x), range(10) b(y), range(2) c(k)")
def horizontal_layers_with_wave(u: DataFrame) -> DataFrame:
    return files.horizontal(u.sparkSession, 0.5).select("X", "Y", tidy("Z").alias("Z"), "val")


OLD_TEXT = """{ # names of an older project
  'otype': 'strike', d: 'dip_deg', // the dip
  "c": "unit_name", o: 'OBJECTID', fdipnull: -99, unknown: [1, 2,],
}"""


@register("strat_units", "SELECT * FROM (VALUES ('fault', 'dip_null_value', '-99'), ('fold', 'objectid_column', '\"OBJECTID\"'), ('geology', 'objectid_column', '\"OBJECTID\"'), ('geology', 'unitname_column', '\"unit_name\"'), ('structure', 'dip_column', '\"dip_deg\"'), ('structure', 'objectid_column', '\"OBJECTID\"'), ('structure', 'orientation_type', '\"strike\"')) t(layer, key, value)")
def config_changes(u: DataFrame) -> DataFrame:
    """What a text with older keys, comments and loose quotes changes."""
    spark = u.sparkSession
    return config.Config().update_from_text(OLD_TEXT).frame(spark).exceptAll(config.Config().frame(spark))


@register("strat_units", "SELECT * FROM (VALUES ('fault', 13), ('fold', 6), ('geology', 14), ('structure', 8)) t(layer, n)")
def config_defaults(u: DataFrame) -> DataFrame:
    return config.Config().frame(u.sparkSession).groupBy("layer").agg(F.count("*").cast("int").alias("n"))


@register("obs_orient", "SELECT oid AS ID, strike AS DIPDIR, dip AS DIP, unit AS DESCRIPTION FROM obs_orient")
def renamed_layer(o: DataFrame) -> DataFrame:
    """A layer's own column names, by its configuration."""
    own = config.Config().update({"structure": {"objectid_column": "oid", "dipdir_column": "strike", "dip_column": "dip", "description_column": "unit"}})
    return own.renamed(o, "structure").select("ID", "DIPDIR", "DIP", "DESCRIPTION")


@register("strat_units", "SELECT * FROM (VALUES ('unknown key fault.colour'), ('unknown layer rivers'), ('fault.minimum_fault_length is not a number'), ('no layer geology'), ('no key structure.dip_column')) t(problem)")
def config_problems(u: DataFrame) -> DataFrame:
    changes = {"rivers": {}, "fault": {"colour": 1, "minimum_fault_length": "long"}}
    whole = {"structure": {k: v for k, v in config.DEFAULTS["structure"].items() if k != "dip_column"}}
    return u.sparkSession.createDataFrame([(x,) for x in config.faults(changes) + config.missing(whole)], "problem string")


@register("strat_units", "SELECT unit, 'https://maps/' || lower(unit) || '?box=0,5,10,15,EPSG:28350&crs=EPSG:28350' AS address FROM strat_units")
def file_names(u: DataFrame) -> DataFrame:
    """Addresses with the box and the projection filled in."""
    template = F.concat(F.lit("https://maps/"), F.lower("unit"), F.lit("?box={BBOX_STR}&crs={PROJ_STR}"))
    return u.select("unit", config.with_box(template, (0.0, 5.0, 10.0, 15.0), "EPSG:28350").alias("address"))


@register("strat_units", "SELECT CAST(grp AS BIGINT) AS grp, CAST(pos AS BIGINT) AS pos, unit, thickness FROM strat_units")
def recipe_column(u: DataFrame) -> DataFrame:
    """The column of a model whose recipe was written and read back."""
    none = u.sparkSession.createDataFrame([], "name string, kind string, faults array<string>")
    path = recipe.save(shared_path(u.sparkSession, "recipe"), ([0.0, 0.0, 0.0], [10.0, 10.0, 10.0], [5, 5, 5]), u, none)
    return recipe.load(u.sparkSession, path).column


@register("obs_points", "SELECT feature_name AS feature, count(*) AS n, round(avg(X), 6)+0.0 AS mean_x, CASE WHEN feature_name = 'A' THEN 1 ELSE 0 END AS n_faults FROM obs_points GROUP BY feature_name")
def recipe_features(p: DataFrame) -> DataFrame:
    """Features of a model read back from its recipe, with the observations of each by the path that it names; faults that aren't features go."""
    spark = p.sparkSession
    data = shared_path(spark, "observations")
    p.select("pid", "X", "Y", "Z", "val", "feature_name").write.parquet(data)
    names = p.select(F.col("feature_name").alias("name")).distinct()
    features = names.select("name", F.lit("foliation").alias("kind"), F.when(F.col("name") == "A", F.array(F.lit("N"), F.lit("unknown"))).otherwise(F.array().cast("array<string>")).alias("faults"))
    column = spark.createDataFrame([], "grp bigint, pos bigint, unit string, thickness double")
    back = recipe.load(spark, recipe.save(shared_path(spark, "recipe"), ([0.0] * 3, [10.0] * 3, [5] * 3), column, features, data))
    got = back.data.groupBy(F.col("feature_name").alias("name")).agg(F.count("*").alias("n"), tidy(F.avg("X")).alias("mean_x"))
    return back.features.join(got, "name").select(F.col("name").alias("feature"), "n", "mean_x", F.size("faults").alias("n_faults"))
