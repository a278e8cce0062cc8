"""Queries on maps, processed inputs, fault networks and orders, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalogue import register
from .functions import tidy
from .operators import inputs, layers, network, topology

# ---- topology


def _to_segment(p: str, a: str, b: str) -> str:
    """SQL for the square of the distance of point p from the segment a b."""
    ex, ey = f"({b}x-{a}x)", f"({b}y-{a}y)"
    t = f"least(greatest((({p}x-{a}x)*{ex} + ({p}y-{a}y)*{ey})/({ex}*{ex}+{ey}*{ey}), 0), 1)"
    return f"(power({a}x + {t}*{ex} - {p}x, 2) + power({a}y + {t}*{ey} - {p}y, 2))"


def _side(p: str, a: str, b: str) -> str:
    return f"(({b}x-{a}x)*({p}y-{a}y) - ({b}y-{a}y)*({p}x-{a}x))"


_PAIRS = "s AS (SELECT p.id AS fault1, q.id AS fault2, p.ax AS ax, p.ay AS ay, p.bx AS bx, p.by_ AS by, q.ax AS cx, q.ay AS cy, q.bx AS dx, q.by_ AS dy FROM fault_lines p JOIN fault_lines q ON p.id > q.id)".replace(" AS by,", ' AS "by",')
_NEAR = f"least({_to_segment('a', 'c', 'd')}, {_to_segment('b', 'c', 'd')}, {_to_segment('c', 'a', 'b')}, {_to_segment('d', 'a', 'b')})".replace("by", '"by"')
_CROSS = f"({_side('a', 'c', 'd')} * {_side('b', 'c', 'd')} < 0 AND {_side('c', 'a', 'b')} * {_side('d', 'a', 'b')} < 0)".replace("by", '"by"')


@register("fault_lines", f"WITH {_PAIRS} SELECT fault1, fault2, 60 AS angle, 'T' AS type FROM s WHERE {_CROSS} OR {_NEAR} <= 1600")
def fault_fault_relations(f: DataFrame) -> DataFrame:
    """Faults within forty units of each other."""
    return topology.fault_relations(f, 40.0)


_IN = "d AS (SELECT *, bx-ax AS ex, by_-ay AS ey FROM fault_lines, map_units), t AS (SELECT *, greatest(0.0, CASE WHEN ex <> 0 THEN least((x0-ax)/ex, (x1-ax)/ex) WHEN ax < x0 OR ax > x1 THEN 2.0 ELSE 0.0 END, CASE WHEN ey <> 0 THEN least((y0-ay)/ey, (y1-ay)/ey) WHEN ay < y0 OR ay > y1 THEN 2.0 ELSE 0.0 END) AS t0, least(1.0, CASE WHEN ex <> 0 THEN greatest((x0-ax)/ex, (x1-ax)/ex) ELSE 1.0 END, CASE WHEN ey <> 0 THEN greatest((y0-ay)/ey, (y1-ay)/ey) ELSE 1.0 END) AS t1 FROM d)"


@register("fault_lines map_units", f"WITH {_IN} SELECT unit, id AS fault FROM t WHERE t0 <= t1")
def fault_unit_relations(f: DataFrame, u: DataFrame) -> DataFrame:
    return topology.faults_in_units(f, u)


def _rings(u: DataFrame) -> DataFrame:
    corners = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0")]
    return u.select("unit", "rank", "intrusive", F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in corners]).alias("ring"))


_TOUCH = "c AS (SELECT a.unit AS unit1, b.unit AS unit2, a.rank AS r1, b.rank AS r2, CASE WHEN a.x1 = b.x0 OR b.x1 = a.x0 THEN least(a.y1, b.y1) - greatest(a.y0, b.y0) ELSE 0 END + CASE WHEN a.y1 = b.y0 OR b.y1 = a.y0 THEN least(a.x1, b.x1) - greatest(a.x0, b.x0) ELSE 0 END AS length FROM map_units a JOIN map_units b ON a.unit < b.unit AND NOT a.intrusive AND NOT b.intrusive WHERE ((a.x1 = b.x0 OR b.x1 = a.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)) OR ((a.y1 = b.y0 OR b.y1 = a.y0) AND least(a.x1, b.x1) > greatest(a.x0, b.x0)))"


@register("map_units", f"WITH {_TOUCH} SELECT unit1, unit2, length FROM c")
def all_contacts(u: DataFrame) -> DataFrame:
    """The boundaries that units which aren't intrusive share."""
    return topology.contacts(_rings(u).where("not intrusive"))


@register("map_units", f"WITH {_TOUCH} SELECT unit1, unit2 FROM c")
def unit_unit_relations(u: DataFrame) -> DataFrame:
    return topology.contacts(_rings(u).where("not intrusive")).drop("length")


@register("map_units", f"WITH {_TOUCH} SELECT unit1, unit2, CAST(least(r1, r2) AS BIGINT) AS id, CASE WHEN r1 < r2 THEN unit1 ELSE unit2 END AS basal_unit, CASE WHEN abs(r1 - r2) > 1 THEN 'ABNORMAL' ELSE 'BASAL' END AS type, length FROM c")
def basal_contact_lines(u: DataFrame) -> DataFrame:
    rings = _rings(u)
    return topology.basal_contacts(topology.contacts(rings.where("not intrusive")), rings)


# ---- processed inputs

_VALUES = "v AS (SELECT unit, 'group_' || grp AS feature_name, row_number() OVER (PARTITION BY grp ORDER BY pos DESC) AS fb, coalesce(sum(CASE WHEN rb > 1 THEN thickness ELSE 0.0 END) OVER (PARTITION BY grp ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS val, grp, pos FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pos DESC) AS rb FROM strat_units)), w AS (SELECT *, row_number() OVER (ORDER BY grp, pos DESC) - 1 AS interface FROM v WHERE fb > 1)"
_VEC = ", ".join(f"round({c}, 6)+0.0 AS {n}" for n, c in (("gx", "sin(radians(dip))*cos(radians(strike))*2*p"), ("gy", "-sin(radians(dip))*sin(radians(strike))*2*p"), ("gz", "cos(radians(dip))*2*p")))


def _input(c: DataFrame, o: DataFrame, u: DataFrame, **more: object) -> inputs.MapInput:
    units = u.withColumn("n", F.row_number().over(W.orderBy("unit")) - 1)  # one row per unit
    at = o.withColumn("n", F.col("oid") % 25).join(F.broadcast(units.select("n", F.col("unit").alias("name"))), "n")
    at = at.select("oid", "strike", "dip", "polarity", "name", *[(F.col("oid") % m * 1.0).alias(a) for a, m in (("X", 50), ("Y", 40), ("Z", 30))])
    return inputs.MapInput(c, at, u, scale=2.0, **more)


@register("contacts obs_orient strat_units", f"WITH {_VALUES} SELECT cid, round(X, 6) AS X, round(Y, 6) AS Y, round(Z, 6) AS Z, feature_name, val FROM contacts JOIN w ON unit = name")
def contact_values(c: DataFrame, o: DataFrame, u: DataFrame) -> DataFrame:
    """Contacts with the height of their unit's base in its group."""
    return _input(c, o, u).contact_values().select("cid", *[F.round(a, 6).alias(a) for a in "XYZ"], "feature_name", "val")


@register("contacts obs_orient strat_units", f"WITH {_VALUES} SELECT cid, feature_name, interface FROM contacts JOIN w ON unit = name")
def contact_interfaces(c: DataFrame, o: DataFrame, u: DataFrame) -> DataFrame:
    return _input(c, o, u, use_thickness=False).contact_values().select("cid", "feature_name", "interface")


@register("contacts obs_orient strat_units", "SELECT cid, 'group_' || grp AS feature_name FROM contacts LEFT JOIN strat_units ON unit = name")
def feature_names(c: DataFrame, o: DataFrame, u: DataFrame) -> DataFrame:
    return _input(c, o, u).feature_names(c).select("cid", "feature_name")


_OR = "u AS (SELECT *, row_number() OVER (ORDER BY unit) - 1 AS n FROM strat_units), p AS (SELECT oid, strike, dip, polarity AS p, 'group_' || grp AS feature_name FROM obs_orient o JOIN u ON u.n = o.oid % 25)"


@register("contacts obs_orient strat_units", f"WITH {_OR} SELECT oid, feature_name, {_VEC} FROM p")
def contact_orientation_vectors(c: DataFrame, o: DataFrame, u: DataFrame) -> DataFrame:
    """Normals of length two with the sign of their polarity, named by their unit's group."""
    return _input(c, o, u).orientation_vectors().select("oid", "feature_name", *[tidy(F.col(g)).alias(g) for g in inputs.VECTOR])


def _faults(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    ends = F.explode(F.array(F.struct(F.col("ax").alias("X"), F.col("ay").alias("Y"), F.lit(0.0).alias("Z")), F.struct(F.col("bx").alias("X"), F.col("by_").alias("Y"), F.lit(0.0).alias("Z"))))
    places = f.select("name", ends.alias("e")).select("name", "e.*")
    strike = F.pmod(F.degrees(F.atan2(F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay"))), F.lit(360.0))
    return places, f.select("name", F.col("ax").alias("X"), F.col("ay").alias("Y"), F.lit(0.0).alias("Z"), strike.alias("strike"), (F.lit(40.0) + F.col("id") % 50).alias("dip"))


@register("fault_lines", "SELECT name AS feature_name, ax AS X, ay AS Y, 0.0::DOUBLE AS Z, 0.0::DOUBLE AS val, 0 AS coord FROM fault_lines UNION ALL SELECT name, bx, by_, 0.0, 0.0, 0 FROM fault_lines")
def fault_trace_points(f: DataFrame) -> DataFrame:
    """The ends of each fault as points of value nought."""
    places, turns = _faults(f)
    return inputs.MapInput(places, turns, places, places, turns).fault_traces()


_FV = "t AS (SELECT name, (degrees(atan2(bx-ax, by_-ay)) + 360.0) % 360.0 AS strike, 40.0 + id % 50 AS dip, ax, ay, bx, by_, displacement FROM fault_lines), n AS (SELECT *, sin(radians(dip))*cos(radians(strike)) AS gx, -sin(radians(dip))*sin(radians(strike)) AS gy, cos(radians(dip)) AS gz FROM t)"


@register("fault_lines", f"WITH {_FV} SELECT name AS feature_name, round(gx, 5)+0.0 AS gx, round(gy, 5)+0.0 AS gy, round(gz, 5)+0.0 AS gz, 0 AS coord FROM n")
def fault_orientation_vectors(f: DataFrame) -> DataFrame:
    places, turns = _faults(f)
    return inputs.MapInput(places, turns, places, places, turns).fault_vectors().select("feature_name", *[tidy(F.col(g), 5).alias(g) for g in inputs.VECTOR], "coord")


@register("fault_lines", f"WITH {_FV} SELECT name, round((ax+bx)/2, 6)+0.0 AS centre_x, round((ay+by_)/2, 6)+0.0 AS centre_y, 0.0::DOUBLE AS centre_z, round(gx, 5)+0.0 AS normal_x, round(gy, 5)+0.0 AS normal_y, round(gz, 5)+0.0 AS normal_z, 0.0::DOUBLE AS slip_x, 0.0::DOUBLE AS slip_y, -1.0::DOUBLE AS slip_z, CASE WHEN displacement > 0 THEN displacement + 0.0 ELSE 0.0 END AS displacement FROM n")
def fault_property_table(f: DataFrame) -> DataFrame:
    """Centre, normal, slip and displacement of each fault; one with an unknown displacement gets 0."""
    places, turns = _faults(f)
    known = f.where("displacement > 0").select("name", (F.col("displacement") + 0.0).cast("double").alias("displacement"))
    got = inputs.MapInput(places, turns, places, places, turns).fault_properties(known)
    return got.select("name", *[tidy(F.col(c), 5 if c.startswith("normal") else 6).alias(c) for c in got.columns[1:-1]], "displacement")


@register("contacts obs_orient strat_units fault_lines", f"WITH {_VALUES}, {_OR} SELECT 'value' AS family, feature_name, count(*) AS n FROM contacts JOIN w ON unit = name GROUP BY feature_name UNION ALL SELECT 'gradient', feature_name, count(*) FROM p GROUP BY feature_name UNION ALL SELECT 'gradient', name, 1 FROM fault_lines UNION ALL SELECT 'value', name, 2 FROM fault_lines")
def constraint_table(c: DataFrame, o: DataFrame, u: DataFrame, f: DataFrame) -> DataFrame:
    """Contacts, orientations and faults in one table: rows of each family and feature."""
    places, turns = _faults(f)
    data = _input(c, o, u, fault_locations=places, fault_orientations=turns).data()
    return data.withColumn("family", F.when(F.col("val").isNotNull(), "value").otherwise("gradient")).groupBy("family", "feature_name").agg(F.count("*").alias("n"))


@register("contacts obs_orient strat_units", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pos DESC) AS fb, row_number() OVER (PARTITION BY grp ORDER BY pos) AS ft, row_number() OVER (ORDER BY grp, pos) - 1 AS id FROM strat_units), s AS (SELECT *, CASE WHEN fb > 1 THEN thickness ELSE 0.0 END AS step FROM r), l AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY grp ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS lo FROM s) SELECT unit, grp, CASE WHEN fb > 1 THEN lo END AS low, CASE WHEN ft > 1 THEN lo + step END AS high, id FROM l")
def input_column(c: DataFrame, o: DataFrame, u: DataFrame) -> DataFrame:
    return _input(c, o, u).stratigraphic_column()


@register("obs_points", "SELECT pid, X, Y, Z, val FROM obs_points WHERE feature_name = 'R'")
def data_for_feature(p: DataFrame) -> DataFrame:
    return p.where(F.col("feature_name") == "R").select("pid", "X", "Y", "Z", "val")


# ---- faults


@register("fault_lines", "SELECT id, round(2*h, 6)+0.0 AS vertical_radius, round(h, 6)+0.0 AS horizontal_radius, round(h/2, 6)+0.0 AS influence FROM (SELECT id, sqrt((bx-ax)*(bx-ax) + (by_-ay)*(by_-ay))/2 AS h FROM fault_lines)")
def fault_events(f: DataFrame) -> DataFrame:
    """The extents of each fault from the diagonal of its box."""
    long = F.hypot(F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay"))
    return f.select("id", *[tidy(long / d).alias(n) for n, d in (("vertical_radius", 1.0), ("horizontal_radius", 2.0), ("influence", 4.0))])


@register("fault_lines", "SELECT id, name FROM fault_lines WHERE sqrt((bx-ax)*(bx-ax) + (by_-ay)*(by_-ay)) >= 20")
def faults_for_export(f: DataFrame) -> DataFrame:
    return f.where(F.hypot(F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay")) >= 20).select("id", "name")


@register("fault_lines", "SELECT id, CASE WHEN displacement = -1 THEN 100.0 ELSE displacement + 0.0 END AS displacement FROM fault_lines")
def fault_throw(f: DataFrame) -> DataFrame:
    """A displacement that isn't known (-1) becomes 100."""
    return f.select("id", F.when(F.col("displacement") == -1, F.lit(100.0)).otherwise(F.col("displacement") + 0.0).cast("double").alias("displacement"))


@register("map_units", "SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS id FROM (SELECT DISTINCT unit FROM map_units)")
def column_from_map(u: DataFrame) -> DataFrame:
    """The distinct units of a map, numbered by name."""
    return u.select("unit").distinct().select("unit", (F.row_number().over(W.orderBy("unit")) - 1).cast("bigint").alias("id"))


_EDGES = "e AS (SELECT p.id AS younger, q.id AS older, CASE WHEN (p.id + q.id) % 3 = 0 THEN 'ABUTTING' WHEN (p.id + q.id) % 3 = 1 THEN 'FAULTED' ELSE 'NONE' END AS kind FROM fault_lines p JOIN fault_lines q ON q.id IN (p.id * 2, p.id * 2 + 1))"


def _edges(f: DataFrame) -> DataFrame:
    """Each fault cuts two others by number: a tree."""
    kids = f.select(F.col("id").alias("younger"), F.explode(F.array(F.col("id") * 2, F.col("id") * 2 + 1)).alias("older"))
    kids = kids.join(f.select(F.col("id").alias("older")), "older", "left_semi")
    return network.with_kinds(kids, F.pmod(F.col("younger") + F.col("older"), F.lit(3)))


@register("fault_lines", f"WITH {_EDGES} SELECT id FROM fault_lines WHERE id NOT IN (SELECT older FROM e)")
def fault_roots(f: DataFrame) -> DataFrame:
    """Faults that no other one cuts."""
    return network.roots(f.select("id"), _edges(f))


@register("fault_lines", f"WITH {_EDGES} SELECT younger, older, kind FROM e")
def fault_topology(f: DataFrame) -> DataFrame:
    return _edges(f).select("younger", "older", "kind")


@register("fault_lines", f"WITH {_EDGES} SELECT younger, older, kind FROM e WHERE younger = 7 OR older = 7")
def fault_relationships(f: DataFrame) -> DataFrame:
    return network.of_fault(_edges(f), 7).select("younger", "older", "kind")


@register("fault_lines", f"WITH {_EDGES} SELECT younger, older, kind FROM e WHERE younger <> 7 AND older <> 7")
def fault_removed(f: DataFrame) -> DataFrame:
    return network.without(_edges(f), 7).select("younger", "older", "kind")


@register("fault_lines", "WITH RECURSIVE w AS (SELECT id, id AS reached, 0 AS hops FROM fault_lines UNION ALL SELECT w.id, f.id, w.hops + 1 FROM w JOIN fault_lines f ON f.id = w.reached * 2) SELECT id, max(hops) AS hops, max(reached) AS last FROM w GROUP BY id")
def fault_walk(f: DataFrame) -> DataFrame:
    """From each fault along the first fault that it cuts, to the end."""
    return network.walk(f.select("id"), _edges(f).groupBy("younger").agg(F.min("older").alias("older")))


@register("fault_lines", "SELECT p.id AS fault1, q.id AS fault2, round(abs((p.id*37 % 360) - (q.id*37 % 360)), 6)+0.0 AS angle FROM fault_lines p JOIN fault_lines q ON p.system = q.system AND p.id < q.id")
def fault_angles(f: DataFrame) -> DataFrame:
    """The angle between the dip directions of faults of one system."""
    a = f.select("system", F.col("id").alias("fault1"), (F.col("id") * 37 % 360).alias("d1"))
    b = f.select("system", F.col("id").alias("fault2"), (F.col("id") * 37 % 360).alias("d2"))
    return a.join(b, "system").where("fault1 < fault2").select("fault1", "fault2", tidy(F.abs(F.col("d1") - F.col("d2")).cast("double")).alias("angle"))


# ---- orders and sets


@register("strat_units", "SELECT unit, row_number() OVER (ORDER BY thickness DESC, unit) - 1 AS rank FROM strat_units")
def order_from_list(u: DataFrame) -> DataFrame:
    """Units by a given list of names: here the one of falling thickness."""
    names = u.agg(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("thickness"), "unit"))), lambda s: s["unit"]).alias("names"))  # a column's units
    return network.ranked(u.select("unit"), names, "unit")


@register("strat_units", "SELECT unit, grp, pos, row_number() OVER (PARTITION BY grp ORDER BY md5(unit)) - 1 AS new_pos FROM strat_units")
def order_updated(u: DataFrame) -> DataFrame:
    """Units in the order of given identifiers within their groups."""
    return u.select("unit", "grp", "pos", (F.row_number().over(W.partitionBy("grp").orderBy(F.md5("unit"))) - 1).cast("bigint").alias("new_pos"))


@register("unit_contacts strat_units", "WITH r AS (SELECT unit, row_number() OVER (ORDER BY grp, pos) AS a, row_number() OVER (ORDER BY unit) AS b, row_number() OVER (ORDER BY thickness, unit) AS c FROM strat_units), k AS (SELECT 'age' AS sorter, unit, a AS rank FROM r UNION ALL SELECT 'name', unit, b FROM r UNION ALL SELECT 'thickness', unit, c FROM r), t AS (SELECT x.sorter, sum(length) AS total FROM unit_contacts JOIN k x ON x.unit = unit1 JOIN k y ON y.unit = unit2 AND y.sorter = x.sorter WHERE abs(x.rank - y.rank) = 1 GROUP BY x.sorter) SELECT sorter, CAST(total AS BIGINT) AS total FROM t ORDER BY total DESC, sorter LIMIT 1")
def best_of_sorters(c: DataFrame, u: DataFrame) -> DataFrame:
    """Of three orders the one with the greatest length of contacts between neighbours."""
    orders = {"age": ("grp", "pos"), "name": ("unit",), "thickness": ("thickness", "unit")}
    ranked = [u.select(F.lit(n).alias("sorter"), "unit", F.row_number().over(W.orderBy(*by)).alias("rank")) for n, by in orders.items()]
    return network.best_order(c, ranked[0].unionByName(ranked[1]).unionByName(ranked[2]))


@register("obs_orient", "SELECT oid, dip, strike + 1 AS turn FROM obs_orient")
def grid_merge(o: DataFrame) -> DataFrame:
    """The properties of two tables over the same cells, side by side."""
    return o.select("oid", "dip").join(o.select("oid", (F.col("strike") + 1).alias("turn")), "oid")


_SURFACE = "v AS (SELECT node, CASE WHEN node % 7 = 3 THEN NULL ELSE node * 0.5 END AS z FROM range(48) t(node)), k AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS new FROM v WHERE z IS NOT NULL), t AS (SELECT 2*(i + 7*j) + h AS triangle, CASE WHEN h = 0 THEN i + 8*j ELSE i + 1 + 8*(j+1) END AS n1, CASE WHEN h = 0 THEN i + 1 + 8*j ELSE i + 8*(j+1) END AS n2, CASE WHEN h = 0 THEN i + 8*(j+1) ELSE i + 1 + 8*j END AS n3 FROM range(7) a(i), range(5) b(j), range(2) c(h))"


@register("strat_units", f"WITH {_SURFACE} SELECT triangle, a.new AS n1, b.new AS n2, c.new AS n3 FROM t JOIN k a ON a.node = n1 JOIN k b ON b.node = n2 JOIN k c ON c.node = n3")
def surface_without_gaps(u: DataFrame) -> DataFrame:
    """A surface without the vertices that have no height and the triangles that use them, numbered anew."""
    from .catalogue_geometry import plane_triangles

    vertices = u.sparkSession.range(48).select(F.col("id").alias("node"), F.when(F.col("id") % 7 != 3, F.col("id") * 0.5).alias("z"))
    return network.without_gaps(vertices, plane_triangles(u))


@register("obs_points", "SELECT coord, count(*) AS n, round(sum(val), 4)+0.0 AS total FROM (SELECT 0 AS coord, val FROM obs_points WHERE feature_name = 'A' UNION ALL SELECT 1, val + 1 FROM obs_points WHERE feature_name = 'N' UNION ALL SELECT 2, val + 2 FROM obs_points WHERE feature_name = 'R') GROUP BY coord")
def frame_data(p: DataFrame) -> DataFrame:
    """The three coordinates' tables of a frame as one, by coordinate."""
    parts = [p.where(F.col("feature_name") == n).select(F.lit(i).alias("coord"), (F.col("val") + i).alias("val")) for i, n in enumerate("ANR")]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.groupBy("coord").agg(F.count("*").alias("n"), tidy(F.sum("val"), 4).alias("total"))


# ---- layers


@register("map_text", "SELECT ID AS id, CASE WHEN unit IS NULL THEN 'Fault_' || ID ELSE unit END AS name, length(coalesce(description, '')) AS size, regexp_matches(lower(coalesce(description, '')), 'synclin|anticlin|secret|token') AS is_fold, contains(lower(coalesce(description, '')), 'synclin') AS syncline, CASE WHEN ID % 90 = 0 THEN NULL ELSE (ID % 90) * 1.0 END AS dip, coalesce(quality, 0) AS min_age, coalesce(toxic * 1000, 100000) AS max_age FROM map_text WHERE length(coalesce(description, '')) >= 500")
def fold_layer(m: DataFrame) -> DataFrame:
    """A fold or fault layer parsed as a whole: names, shortest length, kind by words, dips of nought unknown, default ages."""
    return layers.lines_layer(m.withColumn("dip", (F.col("ID") % 90) * 1.0), least=500, words=("synclin", "anticlin", "secret", "token"))


@register("map_text", "SELECT unit, count(*) AS n_parts, min(ID) AS first_id, CAST(sum(length(coalesce(description, ''))) AS BIGINT) AS size FROM map_text WHERE unit NOT IN ('wiki', 'books') GROUP BY unit")
def geology_layer(m: DataFrame) -> DataFrame:
    """Polygons of a unit dissolved into one row; ignored codes are left out."""
    kept = m.where(~F.col("unit").isin("wiki", "books"))
    return layers.dissolved(kept, "unit", F.length(F.coalesce("description", F.lit(""))))


@register("obs_orient", "SELECT oid AS id, ((strike + 90.0) % 360.0)+0.0 AS dip_direction, dip, unit FROM obs_orient")
def fault_orientation_layer(o: DataFrame) -> DataFrame:
    """Fault orientations as observations: dip direction from strike."""
    return o.select(F.col("oid").alias("id"), (F.pmod(F.col("strike") + 90.0, F.lit(360.0)) + 0.0).alias("dip_direction"), "dip", "unit")


@register("obs_orient", "SELECT 'dip' AS field, 'range' AS rule, 'error' AS severity, CAST(sum(CASE WHEN dip IS NULL OR dip < 0 OR dip > 60 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM obs_orient UNION ALL SELECT 'strike', 'range', 'error', CAST(sum(CASE WHEN strike IS NULL OR strike < 0 OR strike > 300 THEN 1 ELSE 0 END) AS BIGINT) FROM obs_orient UNION ALL SELECT 'unit', 'blank', 'error', CAST(sum(CASE WHEN trim(unit) = '' THEN 1 ELSE 0 END) AS BIGINT) FROM obs_orient UNION ALL SELECT 'unit', 'null', 'error', CAST(sum(CASE WHEN unit IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM obs_orient UNION ALL SELECT 'polarity', 'null', 'warning', CAST(sum(CASE WHEN polarity IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM obs_orient UNION ALL SELECT 'oid', 'duplicate', 'error', count(*) - count(DISTINCT oid) FROM obs_orient UNION ALL SELECT 'layer', 'missing column', 'error', 1")
def structure_layer_check(o: DataFrame) -> DataFrame:
    """All rules of a structure layer in one pass: ranges, nulls, blanks, ids, columns that must be there and warnings."""
    rules = layers.Rules(ids=("oid",), required=("unit", "layer"), optional=("polarity",), ranges={"dip": (0.0, 60.0), "strike": (0.0, 300.0)})
    return layers.check(o, rules)


@register("map_text", "SELECT 'unit' AS field, 'text' AS rule, 'error' AS severity, CAST(sum(CASE WHEN contains(lower(unit), 'web') THEN 1 ELSE 0 END) AS BIGINT) AS n FROM map_text UNION ALL SELECT 'quality', 'null', 'warning', CAST(sum(CASE WHEN quality IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM map_text UNION ALL SELECT 'description', 'null', 'error', CAST(sum(CASE WHEN description IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM map_text UNION ALL SELECT 'description', 'blank', 'error', CAST(sum(CASE WHEN trim(description) = '' THEN 1 ELSE 0 END) AS BIGINT) FROM map_text")
def fault_layer_check(m: DataFrame) -> DataFrame:
    rules = layers.Rules(required=("description",), optional=("quality",), texts={"unit": "web"})
    return layers.check(m, rules)


@register("map_units", "SELECT 'polygon' AS kind, count(*) AS n, CAST(sum(CASE WHEN x1 <= x0 THEN 1 ELSE 0 END) AS BIGINT) AS n_invalid FROM map_units")
def geometry_check(u: DataFrame) -> DataFrame:
    """Kinds of geometry and the number that aren't closed, too short or without an area."""
    return layers.geometry_check(_rings(u), "ring")
