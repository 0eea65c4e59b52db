"""Column builders of particle physics, unit conversions and small expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as k
from .cosmology import PLANCK18, Flat, arcmin_to_comoving

AXES = {"xy": ("x", "y"), "xz": ("x", "z"), "yz": ("y", "z")}
LINE_OF_SIGHT = {"xy": "z", "xz": "y", "yz": "x"}


def axes(projection: str) -> tuple[str, str]:
    if projection not in AXES:
        raise NotImplementedError(f"Projection type not implemented: {projection}")
    return AXES[projection]


def mass(unit: float = 1e10) -> Column:
    return F.col("mass") * F.lit(unit)


def ionized_mass(unit: float = 1e10) -> Column:
    """Electrons' share of the gas mass: mass, electron abundance, X_H and mu_e = 2 / (1 + X_H)."""
    return F.col("mass") * F.lit(unit) * F.col("electron_abundance") * F.lit(k.X_H * 2 / (1 + k.X_H))


def ionized_mass_from_density(h: float, a: float) -> Column:
    """Where the electron density per proper Mpc^3 is given: electrons of the particle's proper volume, in Msun/h."""
    electrons = F.col("electron_number_density") * (F.col("mass") / F.lit(h) / F.col("densities")) * F.lit(a**3)
    return electrons * F.lit(k.M_P * 2 / (1 + k.X_H) / k.SOLAR_MASS * h)


def neutral_mass(unit: float = 1e10) -> Column:
    return mass(unit) - ionized_mass(unit)


def temperature() -> Column:
    x = F.col("electron_abundance")
    return F.lit((k.GAMMA - 1) / k.K_B * 4 * k.M_P * k.UNIT_C) * F.col("internal_energy") / (F.lit(1 + 3 * k.X_H) + F.lit(4 * k.X_H) * x)


def electron_density(h: float) -> Column:
    unit = 1e10 * (k.SOLAR_MASS / h) / (k.KPC_CM / h) ** 3
    return F.col("electron_abundance") * F.lit(k.X_H * unit / k.M_P) * F.col("density")


def pixel_area_cm2(box: float, n: int, h: float, a: float) -> float:
    return (a * box * (k.KPC_CM / h) / n) ** 2


def _electrons_per_area(box: float, n: int, h: float, a: float) -> Column:
    """Electrons in the particle's volume over the pixel's area."""
    return electron_density(h) * (F.col("mass") / F.col("density")) * F.lit((k.KPC_CM / h) ** 3 / pixel_area_cm2(box, n, h, a))


def tau(box: float, n: int, h: float, a: float) -> Column:
    return _electrons_per_area(box, n, h, a) * F.lit(k.SIGMA_T)


def compton_y(box: float, n: int, h: float, a: float) -> Column:
    return _electrons_per_area(box, n, h, a) * temperature() * F.lit(k.K_B * k.SIGMA_T / (k.M_E * k.C**2))


def ksz(box: float, n: int, h: float, a: float, projection: str = "xy", strict_units: bool = False) -> Column:
    """Doppler signal of the velocity along the line of sight; v in km/s over c in cm/s unless ``strict_units``."""
    v = F.col(f"v{LINE_OF_SIGHT[projection]}") * F.lit(a**0.5 * (1e5 if strict_units else 1.0) / k.C)
    return tau(box, n, h, a) * v


def sz_from_catalogue(h: float, a: float, pixel_cm2: float) -> dict[str, Column]:
    """tSZ, optical depth and the three kSZ weights where y * area and electron densities are given."""
    volume = F.col("mass") / F.lit(h) / F.col("densities") * F.lit(a**3)
    t = F.col("electron_number_density") * volume * F.lit(k.SIGMA_T / pixel_cm2)
    return {"tSZ": F.col("compton_y") * F.lit(k.MPC_CM**2 / pixel_cm2), "tau": t, **{f"kSZ_{x}": t * F.col(f"v{x}") / F.lit(k.C) for x in "xyz"}}


def tau_to_microkelvin(value: Column, pixel_arcmin: float) -> Column:
    return value * F.lit(k.T_CMB * 1e6 * k.V_OVER_C * pixel_arcmin**2)


def per_arcmin2(value: Column, pixel_arcmin: float) -> Column:
    return value * F.lit(pixel_arcmin**2)


def ksz_from_delta_sigma(value: Column, z: float, v_km: float = 300.0, cosmo: Flat = PLANCK18, mu_e: float = k.MU_E_KSZ, comoving: bool = False) -> dict[str, Column]:
    """Temperature in microkelvin and optical depth of an excess surface density in kg/m^2."""
    m_p, sigma_t, c = 1.67262192369e-27, 6.6524587321e-29, 299792458.0
    physical = value * F.lit((1 + z) ** 2 if comoving else 1.0)
    per = cosmo.omega_b / cosmo.omega_m * sigma_t / (mu_e * m_p)
    return {"dT_muK": physical * F.lit(-k.T_CMB * v_km * 1e3 / c * per * 1e6), "tau": physical * F.lit(per)}


def ksz_covariance_factor(z: float, v_km: float = 300.0, cosmo: Flat = PLANCK18, mu_e: float = k.MU_E_KSZ, comoving: bool = False) -> float:
    """By which a covariance in (kg/m^2)^2 is scaled to microkelvin^2."""
    m_p, sigma_t, c = 1.67262192369e-27, 6.6524587321e-29, 299792458.0
    alpha = -k.T_CMB * v_km * 1e3 / c * cosmo.omega_b / cosmo.omega_m * sigma_t / (mu_e * m_p) * 1e6
    return alpha**2 * ((1 + z) ** 4 if comoving else 1.0)


def mass_to_temperature(value: Column, v_km: float = 300.0, mu_e: float = k.MU_E_KSZ) -> Column:
    m_p, sigma_t, c = 1.67262192369e-27, 6.6524587321e-29, 299792458.0
    return value * F.lit(k.T_CMB * v_km * 1e3 / c * sigma_t / (mu_e * m_p))


def minimum_image(dx: Column, box: float) -> Column:
    """dx >= L/2 moves down a box, dx < -L/2 up."""
    half, full = F.lit(box / 2), F.lit(float(box))
    return F.when(dx >= half, dx - full).when(dx < -half, dx + full).otherwise(dx)


def right_wrap(x: Column, box: float) -> Column:
    return F.when(x >= F.lit(float(box)), x - F.lit(float(box))).otherwise(x)


def comparative_factor(one: str, two: str, omega_b: float, omega_m: float) -> float:
    """Brings a ratio of two particle types to units of the cosmic baryon fraction."""
    f_b = omega_b / omega_m
    if two == "total" and one in ("ionized_gas", "gas"):
        return 1 / f_b
    if two == "total" and one == "DM":
        return omega_b / (omega_m - omega_b) / f_b
    return 1.0


def label(name: Column, tex: bool = True) -> Column:
    """A name for a figure: underscores escaped, or as dashes."""
    return F.replace(name, F.lit("_"), F.lit("\\_" if tex else "-"))


def sci(num: Column) -> Column:
    """5.2e13: two decimals at most, no trailing zeros."""
    text = F.format_string("%.2e", num.cast("double"))
    base = F.regexp_replace(F.substring_index(text, "e", 1), r"\.?0+$", "")
    return F.concat(base, F.lit("e"), F.substring_index(text, "e", -1).cast("int").cast("string"))


def is_7smooth(n: int) -> bool:
    for p in (2, 3, 5, 7):
        while n > 1 and n % p == 0:
            n //= p
    return n == 1


def snap_7smooth(x: float) -> int:
    """The nearest integer of primes up to 7; the lower one of two as near."""
    near = round(x)
    return next(c for d in range(near + 2) for c in (near - d, near + d) if c >= 1 and is_7smooth(c))


def equal_cell_grids(boxes: list[float], base: int) -> list[int]:
    return [snap_7smooth(base * b / min(boxes)) for b in boxes]


def geometric_edges(centres, first: float | None = None, pick: str = "mid") -> tuple[np.ndarray, tuple[float, float]]:
    """Rising edges whose neighbours have the given geometric means, and the open interval of the first edge.

    Every edge is k * b0 or k / b0 with alternating exponent; an edge below its centre bounds b0 from one side.
    """
    r = np.asarray(centres, float)
    if (r <= 0).any():
        raise ValueError("centres must be positive")
    factors = [1.0]
    for x in r:
        factors.append(x * x / factors[-1])
    highs = [x / f for x, f in zip(r[::2], factors[0::2], strict=False)]
    lows = [f / x for x, f in zip(r[1::2], factors[1::2], strict=False)]
    lower, upper = max([0.0, *lows]), min([np.inf, *highs])
    if not 0 <= lower < upper:
        raise ValueError("no rising edges have these centres")
    starts = {"mid": (lower + upper) / 2, "mean": (lower + upper) / 2, "geom": np.sqrt(lower * upper), "geometric": np.sqrt(lower * upper), "lower": lower + 1e-12, "upper": upper - 1e-12}
    if first is None:
        if pick not in starts:
            raise ValueError(f"unknown pick: {pick}")
        first = starts[pick]
    elif not lower < first < upper:
        raise ValueError(f"the first edge {first} is outside ({lower}, {upper})")
    return np.array([f * first if i % 2 == 0 else f / first for i, f in enumerate(factors)]), (float(lower), float(upper))


def running_bins(radii_arcmin, z: float, pixel_arcmin: float, cosmo: Flat) -> tuple[tuple, float]:
    """Edges in arcmin of comoving bins whose geometric means are the given radii, and a pixel's comoving length in pc.

    The bins are laid out with the reference cosmology, and seen with the simulation's own.
    """
    edges, _ = geometric_edges(np.array([arcmin_to_comoving(float(r), z) / 1000 for r in radii_arcmin]), pick="geom")
    mpc_h = cosmo.comoving_mpc(z) * cosmo.h  # for a radian
    return tuple(np.degrees(np.asarray(edges) / mpc_h) * 60), float(np.radians(pixel_arcmin / 60) * mpc_h * 1e6 / cosmo.h)
