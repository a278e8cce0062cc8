"""Joins and graphs: faults, contacts, units, nearest observations."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import staged


def with_ids(pairs: DataFrame, names: DataFrame, left: str, right: str, name: str, number: str) -> DataFrame:
    """Pairs of names with the ids of both."""
    out = pairs
    for side in (left, right):
        out = out.join(names.select(F.col(name).alias(side), F.col(number).alias(f"{side}_id")), side)
    return out


def matrix(edges: DataFrame, left: str, right: str, code: str, names: list[str]) -> DataFrame:
    """One row per left name and one column per right name; 0 where there is no edge."""
    wide = edges.groupBy(left).pivot(right, names).agg(F.max(code))
    return wide.select(left, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def basal(contacts: DataFrame, order: DataFrame, unit: str = "unit", rank: str = "rank") -> DataFrame:
    """The unit of a contact that comes first in the order, its rank, and whether units between the two are missing."""
    o1 = order.select(F.col(unit).alias("unit1"), F.col(rank).alias("r1"))
    o2 = order.select(F.col(unit).alias("unit2"), F.col(rank).alias("r2"))
    both = contacts.join(o1, "unit1").join(o2, "unit2")
    first = F.least("r1", "r2")
    return both.select("unit1", "unit2", "length", first.alias("id"), F.when(F.col("r1") < F.col("r2"), F.col("unit1")).otherwise(F.col("unit2")).alias("basal_unit"), F.when(F.abs(F.col("r1") - F.col("r2")) > 1, "ABNORMAL").otherwise("BASAL").alias("kind"))


def undirected(edges: DataFrame, a: str = "unit1", b: str = "unit2") -> DataFrame:
    return edges.select(F.col(a).alias("unit"), F.col(b).alias("other"), "length").unionByName(edges.select(F.col(b).alias("unit"), F.col(a).alias("other"), "length"))


def by_age(units: DataFrame, low: str, high: str, group: str, name: str) -> DataFrame:
    """Order by group and mean age; equal ages by name."""
    mean = (F.col(low) + F.col(high)) / 2.0
    return units.withColumn("mean_age", mean).withColumn("rank", F.row_number().over(W.orderBy(group, mean, name)))


def closure(edges: DataFrame, a: str, b: str, most: int = 64) -> DataFrame:
    """All (a, b) that a path joins: each round lengthens the pairs that the round before found, until none is new."""
    reach = fresh = _cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    step = reach.select(F.col("a").alias("b"), F.col("b").alias("c"))
    for _ in range(most):
        longer = fresh.join(step, "b").select("a", F.col("c").alias("b")).distinct()
        fresh = _cut(longer.join(reach, ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            return reach
        reach = reach.unionByName(fresh)
    raise ValueError("a longer chain than expected")


def peel(edges: Iterable[tuple[str, str]]) -> list[str]:
    """A topological order of a small directed graph; ties by name, and an edge that would close a cycle is left out."""
    after: dict[str, set[str]] = {}
    for x, y in sorted(set(edges)):
        after.setdefault(x, set())
        after.setdefault(y, set())
        if x != y and not _reaches(after, y, x):
            after[x].add(y)
    waiting = {n: sum(n in out for out in after.values()) for n in after}
    ready, out = sorted(n for n, k in waiting.items() if not k), []
    while ready:
        n = ready.pop(0)
        out.append(n)
        for m in after[n]:
            waiting[m] -= 1
        ready = sorted({*ready, *(m for m in after[n] if not waiting[m])})
    return out


def _reaches(after: dict[str, set[str]], start: str, goal: str) -> bool:
    queue, seen = deque([start]), {start}
    while queue:
        n = queue.popleft()
        if n == goal:
            return True
        queue += after.get(n, set()) - seen
        seen |= after.get(n, set())
    return False


def tour(lengths: dict[tuple[str, str], float]) -> list[str]:
    """An order of units along long contacts: from the unit with the longest contact, always the longest to a new unit."""
    weight = {frozenset(k): float(v) for k, v in lengths.items()}
    names = sorted({n for k in lengths for n in k})
    if not names:
        return []
    start = max(names, key=lambda n: (max((v for k, v in weight.items() if n in k), default=0.0), n))
    out = [start]
    while len(out) < len(names):
        rest = [n for n in names if n not in out]
        tail = max(rest, key=lambda n: (weight.get(frozenset((out[-1], n)), 0.0), n))
        head = max(rest, key=lambda n: (weight.get(frozenset((out[0], n)), 0.0), n))
        if weight.get(frozenset((out[-1], tail)), 0.0) >= weight.get(frozenset((out[0], head)), 0.0):
            out.append(tail)
        else:
            out.insert(0, head)
    return out


def nearest(points: DataFrame, targets: DataFrame, key: str, target: str, xy: tuple[str, ...] = ("X", "Y"), cell: float | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """For each point the nearest target and its distance; ties go to the smaller target key.

    Cells of points keep the cells of targets that may hold the nearest target of one of their points:
    those whose least distance isn't beyond the most that another can have. Coarse cells are cut into
    4 by 4 down to `cell`, and only children of what was kept are compared, so points far from all
    targets meet the nearest cells' targets only. Targets at one place count once.
    """
    t = _cut(targets.groupBy(*[F.col(c).alias(f"__{c}") for c in xy]).agg(F.min(F.struct(F.col(target).alias("__t"), *keep)).alias("__m")))
    p = _cut(points.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__x{c}") for c in xy]))
    spans = t.agg(F.count("*").alias("n"), *[F.max(f"__{c}").alias(f"h{c}") for c in xy], *[F.min(f"__{c}").alias(f"l{c}") for c in xy]).first()
    far = p.agg(*[F.max(f"__x{c}").alias(f"h{c}") for c in xy], *[F.min(f"__x{c}").alias(f"l{c}") for c in xy]).first()
    if spans[1] is None or far[0] is None:
        kept = {c: kind for c, kind in targets.dtypes if c in keep}
        return points.select(key, F.lit(None).cast(dict(targets.dtypes)[target]).alias(target), F.lit(None).cast("double").alias("distance"), *[F.lit(None).cast(kept[c]).alias(c) for c in keep]).limit(0)
    reach = max(max(spans[f"h{c}"], far[f"h{c}"]) - min(spans[f"l{c}"], far[f"l{c}"]) for c in xy)
    if cell is None:  # as wide as holds about four targets, also where they lie close together
        cell = max(reach, 1e-9) * min(1.0, (4.0 / spans["n"]) ** (1.0 / len(xy)))
        width = F.lit(cell) / F.pow(F.lit(2.0), F.col("half"))
        cut = t.select(F.explode(F.sequence(F.lit(0), F.lit(15))).alias("half"), *[f"__{c}" for c in xy])  # one pass counts the cells that hold targets at each width
        held = cut.groupBy("half").agg(F.approx_count_distinct(F.struct(*[F.floor(F.col(f"__{c}") / width) for c in xy])).alias("n"))
        cell /= 2 ** min((r.half for r in held.collect() if spans["n"] <= 4 * r.n), default=15)
    pc, tc = [f"__p{i}" for i in range(len(xy))], [f"__q{i}" for i in range(len(xy))]
    a = p.select("*", *[F.floor(F.col(f"__x{c}") / cell).alias(n) for c, n in zip(xy, pc, strict=True)])
    b = t.select("*", *[F.floor(F.col(f"__{c}") / cell).alias(n) for c, n in zip(xy, tc, strict=True)])
    full, held = (_cut(d.select(*n).distinct().dropna()) for d, n in ((a, pc), (b, tc)))
    levels = 0
    while cell * 4**levels < reach:
        levels += 1

    def coarse(cells: DataFrame, names: list[str], k: int, up: bool) -> DataFrame:
        """The cells of level k, with their parents if `up`."""
        at = [F.floor(F.col(n) / 4**k).alias(n) for n in names]
        parents = [F.floor(F.col(n) / 4 ** (k + 1)).alias(f"{n}u") for n in names] if up else []
        return cells.select(*at, *parents).distinct()

    pairs = coarse(full, pc, levels, False).crossJoin(coarse(held, tc, levels, False))
    for k in range(levels, -1, -1):
        if k < levels:
            wide = pairs.select(*[F.col(n).alias(f"{n}u") for n in (*pc, *tc)])
            pairs = wide.join(coarse(full, pc, k, True), [f"{n}u" for n in pc]).join(coarse(held, tc, k, True), [f"{n}u" for n in tc])
        apart = [F.abs(F.col(p) - F.col(q)) for p, q in zip(pc, tc, strict=True)]
        least = sum((F.greatest(d - 1, F.lit(0)) * F.greatest(d - 1, F.lit(0)) for d in apart), F.lit(0))
        most = sum(((d + 1) * (d + 1) for d in apart), F.lit(0))
        pairs = pairs.select(*pc, *tc, least.alias("__least"), F.min(most).over(W.partitionBy(*pc)).alias("__most")).where("__least <= __most").select(*pc, *tc)
    square = sum(((F.col(f"__x{c}") - F.col(f"__{c}")) * (F.col(f"__x{c}") - F.col(f"__{c}")) for c in xy), F.lit(0.0))
    got = a.join(pairs.join(b, tc).drop(*tc), pc).select("__k", F.sqrt(square).alias("__d"), "__m")
    best = got.groupBy("__k").agg(F.min(F.struct("__d", "__m")).alias("m"))
    return best.select(F.col("__k").alias(key), F.col("m.__m.__t").alias(target), F.col("m.__d").alias("distance"), *[F.col(f"m.__m.{k}").alias(k) for k in keep])


def raster_cell(x: Column, y: Column, origin: tuple[float, float], pixel: tuple[float, float], size: tuple[int, int]) -> tuple[Column, Column]:
    """Pixel of a place: truncated, and held at the edges."""
    px = ((x - F.lit(origin[0])) / F.lit(pixel[0])).cast("int")
    py = ((y - F.lit(origin[1])) / F.lit(pixel[1])).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(size[0] - 1), px)), F.greatest(F.lit(0), F.least(F.lit(size[1] - 1), py))


def toward_hanging_wall(dip_direction: Column, downthrow: Column) -> Column:
    """A dip direction more than 90 degrees from the downthrow is turned round."""
    d = F.pmod(dip_direction - downthrow, F.lit(360.0))
    apart = F.least(d, F.lit(360.0) - d)
    return F.when(apart > 90.0, F.pmod(dip_direction + 180.0, F.lit(360.0))).otherwise(dip_direction)


def _cut(df: DataFrame) -> DataFrame:
    return staged(df, "relations")


def _merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join without broadcast: staged tables are small as files, but not in the driver's memory."""
    return left.join(right.hint("merge"), on, how)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that edges (ka, kb) join to each node.

    Each round a node joins its smallest neighbour, chains are followed to their ends, and edges are drawn
    between what is left, so a long chain takes few rounds.
    """
    edges = _cut(edges.select("ka", "kb").unionByName(edges.select(F.col("kb").alias("ka"), F.col("ka").alias("kb"))).distinct())
    label = nodes.select("node", F.col("node").alias("label"))
    while not edges.isEmpty():
        up = edges.groupBy(F.col("ka").alias("k")).agg(F.min("kb").alias("low")).select("k", F.least("k", "low").alias("up"))
        up, moved = _cut(up), True
        while moved:  # two steps up a chain per round, then two from there
            above = up.select(F.col("k").alias("up"), F.col("up").alias("far"))
            twice = _merged(up, above, "up").select("k", F.col("up").alias("was"), F.col("far").alias("up"))
            up = _cut(_merged(twice, above, "up").select("k", F.col("far").alias("up"), (F.col("was") != F.col("far")).alias("moved")))
            moved, up = not up.where("moved").isEmpty(), up.select("k", "up")
        label = _cut(_merged(label, up.withColumnRenamed("k", "label"), "label", "left").select("node", F.coalesce("up", "label").alias("label")))
        for end in ("ka", "kb"):
            edges = _merged(edges, up.select(F.col("k").alias(end), F.col("up").alias(f"{end}u")), end)
        edges = _cut(edges.where("kau <> kbu").select(F.col("kau").alias("ka"), F.col("kbu").alias("kb")).distinct())
    return label


def clusters(points: DataFrame, key: str, x: str, y: str, reach: float) -> DataFrame:
    """Single-link clusters: points within `reach` of each other share the smallest key.

    Points of a cell, whose diagonal is within `reach`, are one node; cells side by side are always within
    reach. Other cells near each other are told apart by the boxes of their points where these are within
    reach as a whole or not at all. Only cells that are neither, and that the rest hasn't joined, compare
    their places, so dense points cost no more than the cells they fill.
    """
    side = reach / 5**0.5 * (1 - 1e-9)
    cells = [F.floor(F.col(c) / side).alias(n) for c, n in ((x, "cx"), (y, "cy"))]
    lone = F.col(x).isNull() | F.col(y).isNull()
    places = points.where(~lone).select(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y"), *cells)
    spots = _cut(places.groupBy("x", "y", "cx", "cy").agg(F.min("k").alias("k")))
    nodes = _cut(spots.groupBy("cx", "cy").agg(F.min("k").alias("node"), *[f(c).alias(f"{n}{c}") for c in "xy" for f, n in ((F.min, "l"), (F.max, "h"))]))
    around = [(i, j) for i in range(4) for j in range(-3, 4) if (i, j) > (0, 0) and (i, abs(j)) != (3, 3)]
    a, b = (nodes.select(*[F.col(c).alias(f"{c}{n}") for c in nodes.columns]) for n in "ab")
    a = a.withColumn("at", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in around])))
    a = a.withColumns({"cxb": F.col("cxa") + F.col("at.i"), "cyb": F.col("cya") + F.col("at.j")}).drop("at")
    most = [F.greatest(f"h{c}a", f"h{c}b") - F.least(f"l{c}a", f"l{c}b") for c in "xy"]
    least = [F.greatest(F.col(f"l{c}b") - F.col(f"h{c}a"), F.col(f"l{c}a") - F.col(f"h{c}b"), F.lit(0.0)) for c in "xy"]
    size = lambda d: F.sqrt(d[0] * d[0] + d[1] * d[1])
    near = _merged(a, b, ["cxb", "cyb"]).where(size(least) <= reach)
    near = _cut(near.select(F.col("nodea").alias("ka"), F.col("nodeb").alias("kb"), "cxa", "cya", "cxb", "cyb", (size(most) <= reach).alias("joined")))
    label = components(nodes, near.where("joined"))
    unsure = near.where("not joined")
    for n in "ab":
        unsure = _merged(unsure, label.select(F.col("node").alias(f"k{n}"), F.col("label").alias(f"label{n}")), f"k{n}")
    unsure = _cut(unsure.where("labela <> labelb").select("labela", "labelb", "cxa", "cya", "cxb", "cyb"))
    for n in "ab":
        unsure = _merged(unsure, spots.select(*[F.col(c).alias(f"{c}{n}") for c in ("x", "y", "cx", "cy")]), [f"cx{n}", f"cy{n}"])
    met = unsure.where(size([F.col(f"{c}a") - F.col(f"{c}b") for c in "xy"]) <= reach).select(F.col("labela").alias("ka"), F.col("labelb").alias("kb"))
    last = components(label.select(F.col("label").alias("node")).distinct(), met)
    label = _merged(label, last.select(F.col("node").alias("label"), F.col("label").alias("cluster")), "label").select("node", "cluster")
    found = _merged(places.select("k", "cx", "cy"), _merged(nodes, label, "node").select("cx", "cy", "cluster"), ["cx", "cy"]).select(F.col("k").alias(key), "cluster")
    return found.unionByName(points.where(lone).select(key, F.col(key).alias("cluster")))
