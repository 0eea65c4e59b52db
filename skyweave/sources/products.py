"""Stored products: field and map tables by all their parameters, measurement archives, run configurations."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Product:
    """Everything that a stored grid depends on: two requests share a path only if all of it is equal."""

    suite: str
    sim: str
    snapshot: int
    ptype: str
    n: int
    projection: str = "xy"
    feedback: str | None = None
    kind: str = "field"
    dim: str = "2D"
    mask_radius: float | None = None
    beam: float | None = None

    def path(self, base: str) -> str:
        if self.kind == "map" and self.dim == "3D":
            raise ValueError("maps are 2D")
        return f"{base.rstrip('/')}/products/" + "/".join(f"{k}={v}" for k, v in asdict(self).items())

    def legacy_name(self) -> str:
        """The flat name of a grid in array files."""
        parts = [self.sim, *([self.feedback] if self.feedback else []), str(self.snapshot), self.ptype, str(self.n), *([self.projection] if self.dim == "2D" else ["3D"]), *(["map"] if self.kind == "map" else [])]
        return "_".join(parts) + ".npy"


def save(grid: DataFrame, product: Product, base: str) -> str:
    grid.write.mode("overwrite").parquet(product.path(base))
    return product.path(base)


def load(spark: SparkSession, product: Product, base: str) -> DataFrame:
    """ValueError if it was never stored."""
    try:
        return spark.read.parquet(product.path(base))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise ValueError(f"no stored product at {product.path(base)}") from None


def load_or_make(spark: SparkSession, product: Product, base: str, make, keep: bool = False) -> DataFrame:
    try:
        return load(spark, product, base)
    except ValueError:
        grid = make()
        return spark.read.parquet(save(grid, product, base)) if keep else grid


def measurements(spark: SparkSession, path: str) -> DataFrame:
    """(outer, inner, idx, value) of a .npz archive with keys outer/inner; matrices are flattened by rows."""
    rows = []
    with np.load(path) as z:
        for key in z.files:
            outer, _, inner = key.partition("/")
            rows += [(outer, inner, i, float(v)) for i, v in enumerate(np.ravel(z[key]))]
    return spark.createDataFrame(rows, "outer string, inner string, idx int, value double")


def save_measurements(data: dict, path: str) -> None:
    if not isinstance(data, dict) or not all(isinstance(v, dict) for v in data.values()):
        raise TypeError("measurements are a dict of dicts")
    np.savez(path, **{f"{outer}/{inner}": np.asarray(v) for outer, own in data.items() for inner, v in own.items()})


def measurement_csv(spark: SparkSession, path: str, radius: str, value: str) -> DataFrame:
    rows = spark.read.csv(path, header=True)
    return rows.select(F.col(radius).cast("double").alias("radius"), F.col(value).cast("double").alias("value"), F.col(f"{value}_err").cast("double").alias("err"))


def number(x):
    """YAML reads 1e13 without a sign as text."""
    try:
        return float(x)
    except (TypeError, ValueError):
        return x


def read_config(spark: SparkSession, path: str) -> dict:
    """A run configuration in YAML, from any file that Spark reaches. ValueError if it isn't a mapping."""
    import yaml

    config = yaml.safe_load(spark.read.text(path, wholetext=True).first()[0])
    if not isinstance(config, dict):
        raise ValueError(f"{path} has no configuration")
    return config


def simulations(spark: SparkSession, config: dict) -> DataFrame:
    """(sim_type, name, snapshot, feedback, redshift) of a run configuration."""
    rows = [(g["sim_type"], s["name"], int(s["snapshot"]), s.get("feedback"), None if s.get("redshift") is None else float(s["redshift"])) for g in config["simulations"] for s in g["sims"]]
    return spark.createDataFrame(rows, "sim_type string, name string, snapshot int, feedback string, redshift double")


def nested(archive: DataFrame) -> dict:
    """A small archive (path, idx, value) as nested dicts of arrays, by the parts of its paths."""
    out: dict = {}
    for r in archive.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("v")).collect():
        *groups, name = r["path"].strip("/").split("/")
        at = out
        for g in groups:
            at = at.setdefault(g, {})
        at[name] = np.array([x["value"] for x in r["v"]])
    return out


# ---------------------------------------------------------------- results of runs


def _spectrum_path(base: str, suite: str, sim: str, snapshot: int, grid: int, feedback: str | None, kind: str = "Pk") -> str:
    if suite in ("B", "C") and not feedback:
        raise ValueError(f"suite {suite} needs a feedback variant")
    name = "_".join([sim, *([feedback] if suite in ("B", "C") else []), str(snapshot), kind, str(grid)])
    return f"{base.rstrip('/')}/{suite}/products/3D/{name}.parquet"


def save_spectra(spectra: DataFrame, base: str, suite: str, sim: str, snapshot: int, grid: int, feedback: str | None = None, kind: str = "Pk") -> str:
    """Keep power spectra, or with another ``kind`` what goes with them, by all that they depend on."""
    path = _spectrum_path(base, suite, sim, snapshot, grid, feedback, kind)
    spectra.write.mode("overwrite").parquet(path)
    return path


def load_spectra(spark: SparkSession, base: str, suite: str, sim: str, snapshot: int, grid: int, feedback: str | None = None, kind: str = "Pk") -> DataFrame:
    """FileNotFoundError if they were never kept."""
    path = _spectrum_path(base, suite, sim, snapshot, grid, feedback, kind)
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise FileNotFoundError(f"no power spectra at {path}") from None


def result_key(suite: str, sim: str, feedback: str | None = None) -> str:
    return f"{suite}__{sim}" + (f"_{feedback}" if feedback and feedback != sim else "")


def save_profiles(profiles: DataFrame, path: str) -> str:
    """Profiles (suite, sim, feedback, x, mean, err) of a run's simulations, a partition for each."""
    key = F.concat(F.col("suite"), F.lit("__"), F.col("sim"), F.when(F.col("feedback").isNotNull() & (F.col("feedback") != F.col("sim")), F.concat(F.lit("_"), F.col("feedback"))).otherwise(F.lit("")))
    profiles.select(key.alias("key"), "x", "mean", "err").write.mode("overwrite").partitionBy("key").parquet(path)
    return path


def load_profiles(spark: SparkSession, path: str, suite: str, sim: str, feedback: str | None = None) -> DataFrame:
    """One simulation's profile; the other partitions aren't read."""
    return spark.read.parquet(path).where(F.col("key") == result_key(suite, sim, feedback)).select("x", "mean", "err").orderBy("x")


def save_scalars(results: DataFrame, path: str) -> str:
    """Numbers (name, value) of a run."""
    results.select("name", F.col("value").cast("double").alias("value")).coalesce(1).write.mode("overwrite").json(path)
    return path


def load_scalars(spark: SparkSession, path: str) -> dict[str, float]:
    return {r["name"]: r["value"] for r in spark.read.schema("name string, value double").json(path).collect()}
