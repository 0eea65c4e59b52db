"""Distances in a flat universe with cold matter, photons, massless neutrinos and a constant."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .constants import T_CMB

_C_KM = 299792.458
#: Photon density parameter times h^2 at 1 K, and neutrinos' share for three massless species.
_PHOTONS = 2.472796e-5 / T_CMB**4
_NEUTRINOS = 0.22710731766 * 3.04


@dataclass(frozen=True)
class Flat:
    h: float = 0.6766
    omega_m: float = 0.30966
    omega_b: float = 0.04897
    t_cmb: float = T_CMB

    @property
    def omega_r(self) -> float:
        return _PHOTONS * self.t_cmb**4 / self.h**2 * (1 + _NEUTRINOS)

    def e(self, z):
        r = self.omega_r
        return np.sqrt(self.omega_m * (1 + z) ** 3 + r * (1 + z) ** 4 + 1 - self.omega_m - r)

    def comoving_mpc(self, z: float) -> float:
        """Transverse comoving distance by Gauss-Legendre quadrature."""
        x, w = np.polynomial.legendre.leggauss(64)
        return _C_KM / (100 * self.h) * z / 2 * float(np.sum(w / self.e(z / 2 * (x + 1))))


PLANCK18 = Flat()


def comoving_to_arcmin(length_kpc_h: float, z: float, cosmo: Flat = PLANCK18) -> float:
    return float(np.degrees(length_kpc_h / cosmo.h / 1000 / cosmo.comoving_mpc(z)) * 60)


def arcmin_to_comoving(theta_arcmin: float, z: float, cosmo: Flat = PLANCK18) -> float:
    """kpc/h"""
    return float(np.radians(theta_arcmin / 60) * cosmo.comoving_mpc(z) * 1000 * cosmo.h)


def map_pixels(box_kpc_h: float, z: float, pixel_arcmin: float, cosmo: Flat) -> tuple[int, float]:
    """Pixels along a map of the whole box, and their true size."""
    theta = comoving_to_arcmin(box_kpc_h, z, cosmo)
    n = int(np.ceil(theta / pixel_arcmin))
    return n, theta / n


def pixel_length(unit: str, box_kpc_h: float, n: int, z: float, cosmo: Flat = PLANCK18) -> float:
    """A pixel of n along the box, in kpc/h or as seen in arcmin; ValueError for another unit."""
    if unit == "kpc/h":
        return box_kpc_h / n
    if unit == "arcmin":
        return comoving_to_arcmin(box_kpc_h, z, cosmo) / n
    raise ValueError(f"the unit is kpc/h or arcmin, not {unit}")
