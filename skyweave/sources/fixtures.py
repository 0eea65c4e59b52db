"""Particle, halo and subhalo views over the synthetic star-schema tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Header:
    box: float = 102400.0
    h: float = 0.6774
    omega_m: float = 0.3089
    omega_b: float = 0.0486
    z: float = 0.5
    n: int = 64

    @property
    def a(self) -> float:
        return 1 / (1 + self.z)

    @property
    def cell(self) -> float:
        return self.box / self.n


HEADER = Header()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, p, s, n = (F.col(f"l_{x}") for x in ("orderkey", "partkey", "suppkey", "linenumber"))
    ptype = F.when(F.col("l_returnflag") == "A", "gas").when(F.col("l_returnflag") == "N", "DM").when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "Stars").when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "BH")
    box = F.lit(102400)
    return table(spark, sf_dir, "lineitem").select(
        (o * 10 + n).alias("particle_id"), ptype.alias("ptype"),
        ((o * 7919 + n * 7717) % box).cast("double").alias("x"), ((p * 7723 + n * 6311 + o * 31) % box).cast("double").alias("y"), ((s * 9973 + o * 17 + p * 13) % box).cast("double").alias("z"),
        F.col("l_quantity").alias("mass"), (F.lit(1.0) + F.col("l_discount")).alias("electron_abundance"), F.col("l_extendedprice").alias("internal_energy"), (F.lit(1.0) + F.lit(100.0) * F.col("l_tax")).alias("density"),
        ((F.col("l_discount") - F.lit(0.05)) * F.lit(2000.0)).alias("vz"),
    )


def halos(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    pos = [((c * m + b) % 102400).cast("double").alias(f"pos_{x}") for x, m, b in (("x", 104729, 0), ("y", 7907, 13), ("z", 6421, 29))]
    return table(spark, sf_dir, "customer").select(c.alias("group_id"), *pos, (F.rint((F.col("c_acctbal") + F.lit(1000.0)) * F.lit(100.0)) * F.lit(1e8)).alias("group_mass"), (F.lit(400) + c % 17 * 100).cast("double").alias("group_rad"))


def subhalos(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    parents = halos(spark, sf_dir)
    pos = [F.pmod(F.col(f"pos_{x}") + (o % 401 - 200).cast("double"), F.lit(102400.0)).alias(f"pos_{x}") for x in "xyz"]
    rows = table(spark, sf_dir, "orders").join(parents, F.col("o_custkey") == F.col("group_id"))
    return rows.select(o.alias("subhalo_id"), F.col("o_custkey").alias("parent_group_id"), *pos, (F.col("o_totalprice") * F.lit(1e6)).alias("subhalo_mstar"), (F.col("o_totalprice") * F.lit(1e8)).alias("subhalo_mass"))
