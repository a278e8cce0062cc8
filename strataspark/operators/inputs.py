"""Processed map tables as one constraint table: contacts, orientations and faults. Every table is a lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import angles

VECTOR = ("gx", "gy", "gz")


@dataclass(frozen=True)
class MapInput:
    """contacts (X, Y, Z, name), orientations (X, Y, Z, strike, dip, polarity, name), column (grp, pos, unit, thickness) and fault tables.

    `use_thickness`: contacts get the height of their unit's base; else the number of their interface.
    `scale` is the length of orientation vectors.
    """

    contacts: DataFrame
    orientations: DataFrame
    column: DataFrame
    fault_locations: DataFrame | None = None
    fault_orientations: DataFrame | None = None
    use_thickness: bool = True
    scale: float = 1.0

    def unit_values(self) -> DataFrame:
        """unit, its group, `val` (height of its base) and `interface`; the lowest unit of a group has no base.

        Positions count downwards; a unit without a thickness above nought has no value and adds none, but
        the top one, whose thickness counts as endless.
        """
        down = W.partitionBy("grp").orderBy(F.desc("pos"))
        ranked = self.column.withColumns({"from_base": F.row_number().over(down), "from_top": F.row_number().over(W.partitionBy("grp").orderBy("pos"))})
        good = (F.col("thickness") > 0) | (F.col("from_top") == 1)
        step = F.when((F.col("from_base") > 1) & (F.col("thickness") > 0), F.col("thickness")).otherwise(0.0)
        below = F.coalesce(F.sum(step).over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        valued = ranked.withColumn("val", F.when(F.coalesce(good, F.lit(False)), below)).where("from_base > 1")
        order = F.row_number().over(W.orderBy("grp", F.desc("pos"))) - 1  # a column has as many rows as units
        return valued.select("unit", F.concat(F.lit("group_"), F.col("grp").cast("string")).alias("feature_name"), "val", order.cast("bigint").alias("interface"))

    def feature_names(self, df: DataFrame, name: str = "name") -> DataFrame:
        """Rows with the group of their unit as feature_name; unknown units have none."""
        groups = self.column.select(F.col("unit").alias(name), F.concat(F.lit("group_"), F.col("grp").cast("string")).alias("feature_name"))
        return df.join(F.broadcast(groups), name, "left")  # one row per unit

    def contact_values(self) -> DataFrame:
        """Contacts of units that have a base, with val or interface."""
        column = "val" if self.use_thickness else "interface"
        values = F.broadcast(self.unit_values().withColumnRenamed("unit", "name"))  # one row per unit
        joined = self.contacts.join(values, "name").where(F.col(column).isNotNull())
        return joined.select(*[c for c in self.contacts.columns if c != "name"], "feature_name", column)

    def orientation_vectors(self) -> DataFrame:
        return self._vectors(self.feature_names(self.orientations), F.lit(self.scale) * F.col("polarity"))

    def fault_vectors(self) -> DataFrame:
        return self._vectors(self.fault_orientations.withColumnRenamed("name", "feature_name"), F.lit(1.0)).withColumn("coord", F.lit(0))

    @staticmethod
    def _vectors(df: DataFrame, size: Column) -> DataFrame:
        normal = angles.strike_dip_normal("strike", "dip")
        drop = [c for c in ("strike", "dip", "polarity", "name") if c in df.columns]
        return df.withColumns({n: c * size for n, c in zip(VECTOR, normal, strict=True)}).drop(*drop)

    def fault_traces(self) -> DataFrame:
        """Points on a fault's surface: value and coordinate nought."""
        return self.fault_locations.withColumnRenamed("name", "feature_name").withColumns({"val": F.lit(0.0), "coord": F.lit(0)})

    def data(self) -> DataFrame:
        """All constraints in one table; columns that a family lacks are null."""
        parts = [self.contact_values(), self.orientation_vectors()]
        parts += [self.fault_vectors()] if self.fault_orientations is not None else []
        parts += [self.fault_traces()] if self.fault_locations is not None else []
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out

    def fault_properties(self, displacement: DataFrame) -> DataFrame:
        """Per fault the mean of its points, the mean normal, a slip straight down and its displacement, 0 if unknown."""
        centre = self.fault_locations.groupBy("name").agg(*[F.avg(a).alias(f"centre_{a.lower()}") for a in ("X", "Y", "Z")])
        normal = self.fault_vectors().groupBy(F.col("feature_name").alias("name")).agg(*[F.avg(g).alias(f"normal_{g[1]}") for g in VECTOR])
        slip = [F.lit(v).alias(f"slip_{a}") for a, v in zip("xyz", (0.0, 0.0, -1.0), strict=True)]
        return centre.join(normal, "name", "left").join(displacement, "name", "left").select("name", *[c for c in centre.columns if c != "name"], *[c for c in normal.columns if c != "name"], *slip, F.coalesce("displacement", F.lit(0.0)).alias("displacement"))

    def stratigraphic_column(self) -> DataFrame:
        """Per unit its group, the values between which it lies and its number; the top one has no upper end, the lowest no lower."""
        down = W.partitionBy("grp").orderBy(F.desc("pos"))
        step = F.when(F.row_number().over(down) > 1, F.col("thickness")).otherwise(0.0)
        sized = self.column.withColumn("step", step).withColumn("low", F.coalesce(F.sum("step").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        first, last = F.row_number().over(W.partitionBy("grp").orderBy("pos")) == 1, F.row_number().over(down) == 1
        number = F.row_number().over(W.orderBy("grp", "pos")) - 1
        return sized.select("unit", "grp", F.when(~last, F.col("low")).alias("low"), F.when(~first, F.col("low") + F.col("step")).alias("high"), number.cast("bigint").alias("id"))
