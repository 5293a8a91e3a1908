"""Voxel tables generated from a table of objects: (object_id, entity, z, y, x, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Grid (z, y, x) and spacing in micrometres.
SHAPE = (9, 13, 13)
SPACING = (0.1, 0.05, 0.05)
#: Integer inequalities by entity; k numbers the object. Place and size go with k by 2, 3, 4 and 5, so 60 objects in a row differ.
SHAPES = {
    "cell": "9 * (z - 4) * (z - 4) + 4 * (y - 6) * (y - 6) + 4 * (x - 6) * (x - 6) <= 144 - 9 * (k % 4)",
    "nucleus": "(z - 4) * (z - 4) + (y - 5 - k % 2) * (y - 5 - k % 2) + (x - 4 - k % 3) * (x - 4 - k % 3) <= 4 + k % 5",
}
#: Boxes of the labelled entity; the number of labels goes with k.
MITO_LABEL = (
    "CASE WHEN x BETWEEN 8 AND 9 + k % 2 AND z BETWEEN 3 AND 4 + k % 3 AND y BETWEEN 2 AND 3 + k % 2 THEN 1 WHEN x BETWEEN 7 + k % 3 AND 10 AND z BETWEEN 3 AND 5 AND y BETWEEN 6 AND 7 THEN 2 "
    "WHEN k % 3 > 0 AND x = 6 AND z BETWEEN 2 AND 6 - k % 2 AND y BETWEEN 9 AND 10 THEN 3 WHEN k % 5 > 1 AND x BETWEEN 2 AND 3 + k % 4 AND z BETWEEN 4 AND 5 AND y = 8 THEN 4 ELSE 0 END"
)


def generated(objects: DataFrame) -> DataFrame:
    """The voxels of each object (object_id, k)."""
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grid = objects.select("object_id", "k").withColumn("z", axis(SHAPE[0])).withColumn("y", axis(SHAPE[1])).withColumn("x", axis(SHAPE[2]))
    entities = [F.when(F.expr(sql), F.struct(F.lit(name).alias("entity"), F.lit(1).alias("label"))) for name, sql in SHAPES.items()]
    mito = F.expr(MITO_LABEL)
    entities.append(F.when(mito > 0, F.struct(F.lit("mito").alias("entity"), mito.alias("label"))))
    rows = grid.withColumn("e", F.explode(F.array(*entities))).where("e is not null")  # compiled; a filter inside the arrays is not
    return rows.select("object_id", F.coalesce("e.entity", F.lit("")).alias("entity"), "z", "y", "x", F.coalesce("e.label", F.lit(0)).alias("label"))


def sql() -> str:
    """The same table as common table expressions g and vox for the checks."""
    parts = [f"SELECT object_id, '{n}' AS entity, z, y, x, 1 AS label FROM g WHERE {c}" for n, c in SHAPES.items()]
    parts.append(f"SELECT * FROM (SELECT object_id, 'mito' AS entity, z, y, x, {MITO_LABEL} AS label FROM g) WHERE label > 0")
    axes = ", ".join(f"unnest(range({n})) AS {a}({b})" for n, a, b in zip(SHAPE, ("az", "ay", "ax"), "zyx", strict=True))
    return f"g AS (SELECT 'obj' || s_suppkey AS object_id, s_suppkey AS k, z::INT AS z, y::INT AS y, x::INT AS x FROM supplier, {axes}), vox AS ({' UNION ALL '.join(parts)})"
