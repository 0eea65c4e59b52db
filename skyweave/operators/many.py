"""Many simulations in one plan: their geometry is a table, not literals of a query for each.

``headers`` has a row for each simulation: (sim, box, n, h, redshift), box in kpc/h and n cells along it. Particles and
objects carry ``sim``. Grids and offsets of different sizes share one scan, one shuffle and one join.
"""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import physics
from . import filters, grid

#: Simulations whose headers are broadcast, and whose weights are made on the driver.
SIMULATIONS = 1 << 10
SCHEMA = "sim string, box double, n int, h double, redshift double"


def headers(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """From (sim, box, n, h, redshift)."""
    return spark.createDataFrame(rows, SCHEMA)


def _with_header(rows: DataFrame, table: DataFrame) -> DataFrame:
    if table.limit(SIMULATIONS + 1).count() > SIMULATIONS:
        raise ValueError(f"more than {SIMULATIONS} simulations at once")
    return rows.join(F.broadcast(table.select(*[F.col(c).alias(c if c == "sim" else f"sim_{c}") for c in ("sim", "box", "n", "h", "redshift")])), "sim")


def _cell(x: str) -> Column:
    return F.least(F.floor(F.col(x) * F.col("sim_n") / F.col("sim_box")), F.col("sim_n") - 1).cast("int")


def fields(particles: DataFrame, table: DataFrame, ptype: str, projection: str = "xy", unit: float = 1e10) -> DataFrame:
    """(sim, i, j, value): each simulation's 2D field on its own grid. Particles outside their box, or without a header, are left out."""
    x, y = physics.axes(projection)
    rows = _with_header(grid.of_type(particles, ptype), table)
    inside = [(F.col(c) >= 0) & (F.col(c) <= F.col("sim_box")) for c in (x, y)]
    header = SimpleNamespace(box=F.col("sim_box"), n=F.col("sim_n"), h=F.col("sim_h"), a=1 / (1 + F.col("sim_redshift")))
    value = grid.weight(ptype, header, projection, unit=unit)
    return rows.where(inside[0] & inside[1]).groupBy("sim", _cell(x).alias("i"), _cell(y).alias("j")).agg(F.sum(value).alias("value"))


def profiles(field: DataFrame, objects: DataFrame, table: DataFrame, filter_type: str | Callable, radii, unit: float, projection: str = "xy", key: str = "group_id") -> DataFrame:
    """(sim, key, radius, value): every object's profile in its own simulation, with radii in units of ``unit`` kpc/h.

    A pixel's length, for the excess, is its simulation's own. An object over empty cells has zeros.
    """
    spark = field.sparkSession
    weights, halves = [], []
    for r in table.limit(SIMULATIONS).collect():
        per_unit = unit / (r["box"] / r["n"])
        kernels = filters.Kernels.of(filter_type, radii, per_unit, r["box"] / r["n"], 3 / per_unit if filter_type == "DSigma" else None)
        if not kernels.by_distance:
            raise NotImplementedError("only filters that depend on the distance alone")
        q = np.unique(kernels.geometry.distances()[0], return_index=True)
        halves.append((r["sim"], kernels.geometry.half))
        weights += [(r["sim"], at, int(a), float(w)) for i, at in enumerate(kernels.radii) for a, w in zip(q[0], kernels.flat(i)[q[1]], strict=True) if w]
    reach = F.broadcast(spark.createDataFrame(halves, "sim string, half int"))
    told = spark.createDataFrame(weights, "sim string, radius double, q int, w double")
    x, y = physics.axes(projection)
    at = lambda c: F.rint(F.col(f"pos_{c}") / (F.col("sim_box") / F.col("sim_n"))).cast("int")
    placed = _with_header(objects.select("sim", key, f"pos_{x}", f"pos_{y}"), table).join(reach, "sim").select("sim", key, "sim_n", "half", at(x).alias("ci"), at(y).alias("cj"))
    around = placed.withColumn("di", F.explode(F.sequence(-F.col("half"), F.col("half")))).withColumn("dj", F.explode(F.sequence(-F.col("half"), F.col("half"))))
    cells = around.select("sim", key, (F.col("di") * F.col("di") + F.col("dj") * F.col("dj")).alias("q"), F.pmod(F.col("ci") + F.col("di"), F.col("sim_n")).alias("i"), F.pmod(F.col("cj") + F.col("dj"), F.col("sim_n")).alias("j"))
    sums = cells.join(field, ["sim", "i", "j"]).groupBy("sim", key, "q").agg(F.sum("value").alias("value"))
    got = sums.join(told, ["sim", "q"]).groupBy("sim", key, "radius").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
    every = objects.select("sim", key).distinct().join(F.broadcast(table.select("sim")), "sim").crossJoin(F.broadcast(spark.createDataFrame([(float(r),) for r in radii], "radius double")))
    return every.join(got, ["sim", key, "radius"], "left").select("sim", key, "radius", F.coalesce("value", F.lit(0.0)).alias("value"))
