"""Points, surfaces and grids as text: OBJ, VTK, GOCAD, JSON, WKT and CSV.

`lines` functions give (section, place, line). `save` sorts them by ranges into a folder of part files
whose concatenation, in the order of names, is the file; `joined` copies them into one file. Numbers
have six decimals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import Grid


def _text(pattern: str, *columns: Column | str) -> Column:
    return F.format_string(pattern, *columns)


def _section(number: int, df: DataFrame, place: Column | str, line: Column) -> DataFrame:
    at = F.col(place) if isinstance(place, str) else place
    return df.select(F.lit(number).alias("section"), at.cast("bigint").alias("place"), line.alias("line"))


def _fixed(spark: SparkSession, number: int, lines: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(number, i, x) for i, x in enumerate(lines)], "section int, place bigint, line string")


def _all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def surface_obj(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """vertices: node (0, 1, ... without gaps), X, Y, Z; triangles: triangle, n1, n2, n3. OBJ counts from 1."""
    return _all(
        _section(0, vertices, "node", _text("v %.6f %.6f %.6f", "X", "Y", "Z")),
        _section(1, triangles, "triangle", _text("f %d %d %d", *[F.col(c) + 1 for c in ("n1", "n2", "n3")])),
    )


def surface_gocad(vertices: DataFrame, triangles: DataFrame, name: str) -> DataFrame:
    spark = vertices.sparkSession
    head = ["GOCAD TSurf 1", "HEADER {", f"name:{name}", "}", "GOCAD_ORIGINAL_COORDINATE_SYSTEM", "NAME Default", 'AXIS_NAME "X" "Y" "Z"', 'AXIS_UNIT "m" "m" "m"', "ZPOSITIVE Elevation", "END_ORIGINAL_COORDINATE_SYSTEM", "TFACE"]
    return _all(
        _fixed(spark, 0, head),
        _section(1, vertices, "node", _text("VRTX %d %.6f %.6f %.6f", F.col("node") + 1, "X", "Y", "Z")),
        _section(2, triangles, "triangle", _text("TRGL %d %d %d", *[F.col(c) + 1 for c in ("n1", "n2", "n3")])),
        _fixed(spark, 3, ["END"]),
    )


def surface_vtk(vertices: DataFrame, triangles: DataFrame, name: str) -> DataFrame:
    """Legacy VTK polygons."""
    spark = vertices.sparkSession
    n = vertices.agg(F.count("*").alias("n"))
    m = triangles.agg(F.count("*").alias("m"))
    return _all(
        _fixed(spark, 0, ["# vtk DataFile Version 3.0", name, "ASCII", "DATASET POLYDATA"]),
        _section(1, n, F.lit(0), _text("POINTS %d double", "n")),
        _section(2, vertices, "node", _text("%.6f %.6f %.6f", "X", "Y", "Z")),
        _section(3, m, F.lit(0), _text("POLYGONS %d %d", "m", F.col("m") * 4)),
        _section(4, triangles, "triangle", _text("3 %d %d %d", "n1", "n2", "n3")),
    )


def points_gocad(points: DataFrame, name: str, number: str, values: Sequence[str] = ()) -> DataFrame:
    """A GOCAD set of points, with properties if there are any."""
    spark = points.sparkSession
    head = ["GOCAD VSet 1", "HEADER {", f"name:{name}", "}"] + ([f"PROPERTIES {' '.join(values)}"] if values else [])
    kind = "PVRTX" if values else "VRTX"
    line = _text(f"{kind} %d %.6f %.6f %.6f" + " %.6f" * len(values), number, "X", "Y", "Z", *values)
    return _all(_fixed(spark, 0, head), _section(1, points, number, line), _fixed(spark, 2, ["END"]))


def points_vtk(points: DataFrame, name: str, number: str, vectors: Sequence[str] = ()) -> DataFrame:
    """Legacy VTK points, with vectors if their three columns are named."""
    spark = points.sparkSession
    n = points.agg(F.count("*").alias("n"))
    parts = [_fixed(spark, 0, ["# vtk DataFile Version 3.0", name, "ASCII", "DATASET POLYDATA"]), _section(1, n, F.lit(0), _text("POINTS %d double", "n")), _section(2, points, number, _text("%.6f %.6f %.6f", "X", "Y", "Z"))]
    if vectors:
        parts += [_section(3, n, F.lit(0), _text("POINT_DATA %d", "n")), _fixed(spark, 4, ["VECTORS vectors double"]), _section(5, points, number, _text("%.6f %.6f %.6f", *vectors))]
    return _all(*parts)


def grid_vtk(grid: Grid, nodes: DataFrame, name: str, values: Sequence[str]) -> DataFrame:
    """Legacy VTK structured points with node values: nodes has node and the values."""
    spark, (nx, ny, nz) = nodes.sparkSession, grid.nodes
    head = ["# vtk DataFile Version 3.0", name, "ASCII", "DATASET STRUCTURED_POINTS", f"DIMENSIONS {nx} {ny} {nz}", "ORIGIN {} {} {}".format(*grid.origin), "SPACING {} {} {}".format(*grid.step), f"POINT_DATA {nx * ny * nz}"]
    parts = [_fixed(spark, 0, head)]
    for i, v in enumerate(values):
        parts += [_fixed(spark, 1 + 2 * i, [f"SCALARS {v} double 1", "LOOKUP_TABLE default"]), _section(2 + 2 * i, nodes, "node", _text("%.6f", v))]
    return _all(*parts)


def voxet_header(spark: SparkSession, grid: Grid, name: str, properties: Mapping[str, str]) -> DataFrame:
    """A GOCAD voxet; properties: name to the file of its numbers."""
    number = lambda xs: " ".join(f"{x:.6f}" for x in xs)
    lines = ["GOCAD Voxet 1", "HEADER {", f"name: {name}", "}", f"AXIS_O {number(grid.origin)}"]
    for axis, letter in enumerate("UVW"):
        lines.append(f"AXIS_{letter} " + number([grid.maximum[axis] - grid.origin[axis] if a == axis else 0.0 for a in range(3)]))
    lines += ["AXIS_MIN 0.000000 0.000000 0.000000", "AXIS_MAX 1.000000 1.000000 1.000000", "AXIS_N {} {} {}".format(*grid.nodes)]
    for i, (p, file) in enumerate(properties.items(), start=1):
        lines += [f"PROPERTY {i} {p}", f"PROP_ETYPE {i} IEEE", f"PROP_FORMAT {i} RAW", f"PROP_ESIZE {i} 4", f"PROP_OFFSET {i} 0", f"PROP_FILE {i} {file}"]
    return _fixed(spark, 0, [*lines, "END"])


def wkt_lines(df: DataFrame, number: str, ring: str, kind: str = "POLYGON") -> DataFrame:
    """One line per geometry: its id, a tab, and well-known text of its places."""
    places = F.concat_ws(", ", F.transform(ring, lambda p: F.format_string("%.6f %.6f", p["x"], p["y"])))
    body = F.concat(F.lit(f"{kind} (("), places, F.lit("))")) if kind == "POLYGON" else F.concat(F.lit(f"{kind} ("), places, F.lit(")"))
    return _section(0, df, number, F.concat(F.col(number).cast("string"), F.lit("\t"), body))


def raster_ascii(cells: DataFrame, size: tuple[int, int], corner: tuple[float, float], cell: float, value: str) -> DataFrame:
    """An ASCII grid, from the upper row down; cells has px, py and the value; one row of the file is one group."""
    head = [f"ncols {size[0]}", f"nrows {size[1]}", f"xllcorner {corner[0]}", f"yllcorner {corner[1]}", f"cellsize {cell}", "NODATA_value -9999"]
    rows = cells.groupBy("py").agg(F.sort_array(F.collect_list(F.struct("px", F.when(F.col(value).isNotNull(), F.format_string("%.6f", value)).otherwise("-9999").alias("v")))).alias("row"))
    return _all(_fixed(cells.sparkSession, 0, head), _section(1, rows, size[1] - 1 - F.col("py"), F.concat_ws(" ", F.transform("row", lambda c: c["v"]))))


def save(lines: DataFrame, path: str) -> str:
    """Sorted by ranges into a folder of part files, without moving all lines through one task."""
    lines.orderBy("section", "place").select("line").write.text(path)
    return path


def joined(spark: SparkSession, folder: str, file: str) -> str:
    """The part files of a folder copied into one file, in their order, by the driver; memory stays small."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(file)
    fs = source.getFileSystem(conf)
    out = target.getFileSystem(conf).create(target, True)
    try:
        for path in sorted(s.getPath().toString() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-")):
            part = fs.open(jvm.org.apache.hadoop.fs.Path(path))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            part.close()
    finally:
        out.close()
    return file


def save_csv(df: DataFrame, path: str) -> str:
    df.write.option("header", True).csv(path)
    return path


def save_json(df: DataFrame, path: str) -> str:
    """One JSON object per line."""
    df.write.json(path)
    return path
