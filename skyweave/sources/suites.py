"""Normalising projections for the three suites' catalogues and particles, and snapshot paths."""

from __future__ import annotations

import os
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Particle types by group number. Fixed values.
PTYPES = {"gas": 0, "DM": 1, "Stars": 4, "BH": 5}
GAS_ALIASES = ("tSZ", "kSZ", "tau", "ionized_gas", "neutral_gas")


def data_root(root: str | None = None, variable: str = "SKYWEAVE_DATA", default: str = "data") -> str:
    """The argument, else the environment's, else the default; ends in a slash."""
    return (root or os.environ.get(variable) or default).rstrip("/") + "/"


def check_redshift(z: float, header_z: float | None, tolerance: float = 0.02) -> float:
    """The redshift to use; warns if it isn't the header's."""
    if header_z is not None and abs(z - header_z) > tolerance:
        warnings.warn(f"redshift {z} differs from the header's {header_z}", stacklevel=2)
    return z


def scan(spark: SparkSession, path: str, ptype: str, columns: list[str]) -> DataFrame:
    """Chosen columns of one particle type; derived gas types read gas. Pruning and the filter reach the files."""
    wanted = "gas" if ptype in GAS_ALIASES else ptype
    return spark.read.parquet(path).where(F.col("ptype") == wanted).select(*columns)


def constant_mass(particles: DataFrame, mass_table: list[float]) -> DataFrame:
    """Dark matter without own masses takes the header's."""
    return particles.withColumn("mass", F.lit(float(mass_table[1])))


def _scaled(df: DataFrame, factors: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.col(c) * F.lit(f) for c, f in factors.items() if c in df.columns})


def halos_a(df: DataFrame) -> DataFrame:
    return _scaled(df, {"group_mass": 1e10})


def subhalos_a(df: DataFrame) -> DataFrame:
    return _scaled(df, {"subhalo_mass": 1e10, "subhalo_mstar": 1e10})


def halos_b(df: DataFrame, h: float) -> DataFrame:
    return _scaled(df, dict.fromkeys(("pos_x", "pos_y", "pos_z", "group_mass", "group_rad"), h))


def subhalos_b(df: DataFrame, h: float) -> DataFrame:
    """Mass is dark matter within the aperture and total; the parent is the host's index."""
    mass = ((F.col("dm_30kpc") + F.col("total_mass")) * F.lit(h)).alias("subhalo_mass")
    return _scaled(df, dict.fromkeys(("pos_x", "pos_y", "pos_z", "subhalo_mstar"), h)).select("subhalo_id", F.col("parent_halo_index").alias("parent_group_id"), "pos_x", "pos_y", "pos_z", mass, "subhalo_mstar")


def halos_c(df: DataFrame, h: float) -> DataFrame:
    """Centrals only, lengths in cMpc and masses in 1e10 Msun."""
    own = _scaled(df.where("is_central"), {**dict.fromkeys(("pos_x", "pos_y", "pos_z", "group_rad"), 1000 * h), "group_mass": 1e10 * h})
    return own.drop("is_central")


def particles_c(df: DataFrame, h: float) -> DataFrame:
    """Positions in cMpc and masses in 1e10 Msun to ckpc/h and 1e10 Msun/h; velocities stay."""
    return _scaled(df, {**dict.fromkeys("xyz", 1000 * h), "mass": h})
