"""A simulation as one object: its tables, its fields and maps, and stacks of them."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import physics
from ..functions.cosmology import Flat, map_pixels, pixel_length
from ..operators import beam, grid, masks, selection, stack, tiles
from ..sources import products, snapshots, suites
from ..sources.fixtures import Header


def normalised(rows: DataFrame, suite: str, kind: str, h: float) -> DataFrame:
    """A suite's particles, halos or subhalos in the first suite's units."""
    rules = {("A", "halos"): suites.halos_a, ("A", "subhalos"): suites.subhalos_a, ("B", "halos"): suites.halos_b, ("B", "subhalos"): suites.subhalos_b, ("C", "halos"): suites.halos_c, ("C", "particles"): suites.particles_c}
    if suite not in ("A", "B", "C"):
        raise ValueError(f"unknown suite: {suite}")
    rule = rules.get((suite, kind))
    return rows if rule is None else rule(rows) if suite == "A" else rule(rows, h)


@dataclass
class Simulation:
    """Particles, halos and subhalos with their header. Grids that were set come before stored and computed ones."""

    particles: DataFrame
    halos: DataFrame
    subhalos: DataFrame
    header: Header
    suite: str = "A"
    name: str = "sim"
    snapshot: int = 0
    feedback: str | None = None
    base: str | None = None
    grids: dict = field(default_factory=dict)

    @property
    def cosmology(self) -> Flat:
        return Flat(self.header.h, self.header.omega_m, self.header.omega_b)

    def subset(self, ptype: str, columns: list[str] | None = None) -> DataFrame:
        """Particles of a type or composite, with some of their columns."""
        rows = grid.of_type(self.particles, ptype)
        return rows.select(*columns) if columns else rows

    def set_field(self, ptype: str, value: DataFrame, n: int | None = None, projection: str = "xy") -> None:
        self.grids["field", ptype, n or self.header.n, projection] = value

    def set_map(self, ptype: str, value: DataFrame, z: float | None = None, pixel: float = 0.5, beam_arcmin: float | None = None, projection: str = "xy") -> None:
        self.grids["map", ptype, self.header.z if z is None else z, pixel, beam_arcmin or None, projection] = value

    def _product(self, ptype: str, n: int, projection: str, mask_radius: float | None, **more) -> products.Product:
        return products.Product(self.suite, self.name, self.snapshot, ptype, n, projection, self.feedback, mask_radius=mask_radius, **more)

    def load_halos(self) -> DataFrame:
        """The halo catalogue in the first suite's units."""
        return self.halos

    def load_subhalos(self) -> DataFrame:
        return self.subhalos

    def load_subsets(self, ptype: str, columns: list[str] | None = None) -> DataFrame:
        """Particles of all the snapshot's files; the columns and the type reach the scan."""
        return self.subset(ptype, columns)

    def load_subset(self, ptype: str, path: str, columns: list[str] | None = None) -> DataFrame:
        """Particles of one file of the snapshot."""
        rows = grid.of_type(normalised(self.particles.sparkSession.read.parquet(path), self.suite, "particles", self.header.h), ptype)
        return rows.select(*columns) if columns else rows

    @classmethod
    def open(cls, spark: SparkSession, path: str, suite: str, name: str = "sim", snapshot: int = 0, n: int = 64, **more) -> Simulation:
        """A snapshot's tables under a folder: ``header`` (one row of attributes), ``particles``, ``halos``, ``subhalos``, in the suite's own units."""
        read = lambda x: spark.read.parquet(f"{path.rstrip('/')}/{x}")
        header = snapshots.header_of(read("header"), suite, n)
        own = {x: normalised(read(x), suite, x, header.h) for x in ("particles", "halos", "subhalos")}
        return cls(**own, header=header, suite=suite, name=name, snapshot=snapshot, **more)

    def make_field(self, ptype: str, n: int | None = None, projection: str = "xy", mask_radius: float | None = None, load: bool = True, save: bool = False, dim: str = "2D") -> DataFrame:
        """The one that was set, a stored one, or one from the particles; with ``mask_radius`` the cells in halos' balls of so many radii.

        A 3D field has clouds of three cells along each axis around its particles, or in balls the cells' own sums; of
        composites the components are stored and read one by one.
        """
        if dim not in ("2D", "3D"):
            raise ValueError(f"a field is 2D or 3D, not {dim}")
        n = n or self.header.n
        if ("field", ptype, n, projection) in self.grids and mask_radius is None and dim == "2D":
            return self.grids["field", ptype, n, projection]
        if dim == "3D":
            return self._field_3d(ptype, n, projection, mask_radius, load, save)

        def make() -> DataFrame:
            if mask_radius is None:
                return grid.field(self.particles, ptype, self.header, n, projection)
            return grid.project(self._field_3d(ptype, n, projection, mask_radius, load, False), projection)

        return self._stored(self._product(ptype, n, projection, mask_radius), make, load, save)

    def _field_3d(self, ptype: str, n: int, projection: str, mask_radius: float | None, load: bool, save: bool) -> DataFrame:
        parts = grid.COMPONENTS.get(ptype)

        def make() -> DataFrame:
            if parts and self.base is not None and save:
                rows = [self._field_3d(p, n, projection, mask_radius, load, save) for p in parts]
                return reduce(DataFrame.unionByName, rows).groupBy("i", "j", "k").agg(F.sum("value").alias("value"))
            rows, value = grid.of_type(self.particles, ptype), grid.weight(ptype, self.header, projection, n)
            if mask_radius is None:
                return grid.tsc_grid(rows, value, self.header.box, n)
            near = masks.centre_cells(self.halos, self.header.box, n, F.col("group_rad") * F.lit(float(mask_radius)))
            return masks.masked(grid.nearest_grid_3d(rows, value, self.header.box, n), near, n)

        return self._stored(self._product(ptype, n, projection if ptype == "kSZ" else "xyz", mask_radius, dim="3D"), make, load, save)

    def suppression(self, n: int = 512, load: bool = False, save: bool = False) -> dict[str, DataFrame]:
        """Spectra (bin, k, p_dm, p_total, p_cross, suppression, coherence) and correlations (bin, r, xi_dm, xi_total, xi_cross) of dark and all matter.

        Dark matter of the same run stands for a run without baryons. With ``save`` both tables and the fields behind them
        are stored, and with ``load`` stored ones are taken.
        """
        at = (self.base, self.suite, self.name, self.snapshot, n, self.feedback)
        spark = self.particles.sparkSession
        if load:
            try:
                return {"spectra": products.load_spectra(spark, *at), "correlations": products.load_spectra(spark, *at, kind="Xi")}
            except FileNotFoundError:
                pass
        box = self.header.box / 1e3
        field = lambda t: tiles.kept(tiles.filled(self.make_field(t, n, load=load or save, save=save, dim="3D"), (n, n, n)))
        dm, total = (tiles.kept(tiles.transform(tiles.overdensity(field(t)))) for t in ("DM", "total"))
        pairs = {"dm": (dm, None), "total": (total, None), "cross": (dm, total)}
        named = lambda f, x, v, *keep: reduce(lambda a, b: a.join(b, "bin"), [f(*p, box).select("bin", *(keep if i == 0 else ()), F.col(v).alias(f"{v}_{c}")) for i, (c, p) in enumerate(pairs.items())])
        spectra = named(tiles.power, "k", "p", "k", "n_modes")
        spectra = spectra.select("*", F.try_divide(F.col("p_total"), F.col("p_dm")).alias("suppression"), F.try_divide(F.col("p_cross"), F.sqrt(F.col("p_dm") * F.col("p_total"))).alias("coherence"))
        correlations = named(tiles.correlation, "r", "xi", "r").where(F.col("r") <= box)
        if save:
            if self.base is None:
                raise ValueError("there is no folder to save to")
            products.save_spectra(spectra, *at)
            products.save_spectra(correlations, *at, kind="Xi")
        return {"spectra": spectra, "correlations": correlations}

    def _stored(self, product: products.Product, make: Callable[[], DataFrame], load: bool, save: bool) -> DataFrame:
        if self.base is None or not (load or save):
            return make()
        if load:
            return products.load_or_make(self.particles.sparkSession, product, self.base, make, save)
        return self.particles.sparkSession.read.parquet(products.save(make(), product, self.base))

    def map_pixels(self, z: float | None = None, pixel: float = 0.5) -> tuple[int, float]:
        return map_pixels(self.header.box, self.header.z if z is None else z, pixel, self.cosmology)

    def make_map(self, ptype: str, z: float | None = None, pixel: float = 0.5, beam_arcmin: float | None = 1.6, projection: str = "xy", mask_radius: float | None = None, load: bool = True, save: bool = False) -> DataFrame:
        """The field at the map's own pixel count, under the beam. A beam of None or 0 leaves the field, and saves as such."""
        z, beam_arcmin = self.header.z if z is None else z, beam_arcmin or None
        key = ("map", ptype, z, pixel, beam_arcmin, projection)
        if key in self.grids and mask_radius is None:
            return self.grids[key]
        n, true_pixel = self.map_pixels(z, pixel)
        if beam_arcmin is None:
            return self.make_field(ptype, n, projection, mask_radius, load, save)
        bare = lambda: beam.beamed_map(self.make_field(ptype, n, projection, mask_radius, load), n, beam_arcmin, true_pixel)
        return self._stored(self._product(ptype, n, projection, mask_radius, kind="map", beam=beam_arcmin), bare, load, save)

    def select(self, use_subhalos: bool = False, mean_mass: float | None = selection.TARGET_MASS, upper: float | None = selection.UPPER_MASS, density: float = selection.ABUNDANCE, chosen: DataFrame | None = None) -> tuple[DataFrame, str]:
        """The objects of a stack and their key: a caller's own, subhalos by abundance, or halos by mean mass.

        Without a mean mass halos of bin 2 are taken, with a DeprecationWarning.
        """
        objects, key = (self.subhalos, "subhalo_id") if use_subhalos else (self.halos, "group_id")
        if chosen is not None:
            return selection.chosen(objects, chosen, key), key
        if use_subhalos:
            rows = objects if upper is None else selection.below_parent_mass(objects, self.halos, upper)
            return selection.abundance(rows, self.header.box, density), key
        if mean_mass is None:
            warnings.warn("no mean mass is given: halos of mass bin 2 are taken", DeprecationWarning, stacklevel=2)
            return selection.binned(objects, 2), key
        return selection.massive(objects, mean_mass, upper), key

    def stack(self, value: DataFrame, n: int, filter_type: str | Callable, radii, unit: str, distance: float = 1.0, z: float | None = None, projection: str = "xy", pixel: float = 0.5, way: str | None = None, **chosen) -> DataFrame:
        """(key, radius, value): profiles of any grid, with radii in multiples of ``distance`` kpc/h or arcmin.

        An excess is divided by the area of a true pixel in the unit; its ring is three pixels wide, or 0.75 in arcmin. The
        running excess goes by comoving bins whose geometric means are the radii, which are arcmin, and by the area
        in pc^2 of a pixel of nominally ``pixel`` arcmin.
        """
        z = self.header.z if z is None else z
        true_pixel = pixel_length(unit, self.header.box, n, z, self.cosmology)
        options: dict = {}
        if filter_type == "DSigma":
            options = {"pixel": true_pixel, "dr": 0.75 if unit == "arcmin" else 3 * true_pixel / distance}
        elif filter_type == "DSigma_mccarthy":
            if unit != "arcmin":
                raise ValueError("the running excess takes radii in arcmin")
            options = dict(zip(("edges", "pixel"), physics.running_bins(radii, z, pixel, self.cosmology), strict=True))
        objects, key = self.select(**chosen)
        return stack.profiles(value, objects, n, self.header.box, filter_type, radii, distance * self.header.box / n / true_pixel, projection, key, way=way, **options)

    def stack_field(self, ptype: str, filter_type: str | Callable, radii, distance: float | None = 1000.0, n: int | None = None, projection: str = "xy", subtract_mean: bool = False, mask_radius: float | None = None, load: bool = True, save: bool = False, **chosen) -> DataFrame:
        """Profiles of a field; without a ``distance`` radii are in mean radii of halos of mass bin 2."""
        n = n or self.header.n
        if distance is None:
            distance = selection.mean_radius(self.halos).first()[0]
        f = self.make_field(ptype, n, projection, mask_radius, load, save)
        if subtract_mean:
            f = grid.subtract_mean(f, n)
        return self.stack(f, n, filter_type, radii, "kpc/h", distance, projection=projection, **chosen)

    def stack_map(self, ptype: str, filter_type: str | Callable, radii, distance: float = 1.0, z: float | None = None, pixel: float = 0.5, beam_arcmin: float | None = 1.6, projection: str = "xy", subtract_mean: bool = False, mask_radius: float | None = None, load: bool = True, save: bool = False, **chosen) -> DataFrame:
        """Profiles of a map with radii in arcminutes: optical depth in microkelvin, other effects by arcmin2."""
        n, _ = self.map_pixels(z, pixel)
        m = self.make_map(ptype, z, pixel, beam_arcmin, projection, mask_radius, load, save)
        if subtract_mean:
            m = grid.subtract_mean(m, n)
        got = self.stack(m, n, filter_type, radii, "arcmin", distance, z, projection, pixel, **chosen)
        scaled = {"tau": physics.tau_to_microkelvin(F.col("value"), pixel), "kSZ": physics.per_arcmin2(F.col("value"), pixel), "tSZ": physics.per_arcmin2(F.col("value"), pixel)}
        return got.withColumn("value", scaled[ptype]) if ptype in scaled else got

    def at(self, z: float) -> Simulation:
        return replace(self, header=replace(self.header, z=z), grids={})
