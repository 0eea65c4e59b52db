"""Beam smoothing of periodic maps: a one-dimensional kernel along each axis, by transforms of whole lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of the lines that one task transforms at a time.
LINE_CELLS = 1 << 18


def gauss_beam(ell2, fwhm_rad: float):
    return np.exp(-0.5 * fwhm_rad**2 * np.asarray(ell2) / (8 * np.log(2)))


def fourier_kernel(n: int, fwhm: float, pixel: float) -> np.ndarray:
    """The beam along one axis of n periodic pixels: the inverse transform of its window. Not truncated."""
    ell = 2 * np.pi * np.fft.fftfreq(n, d=pixel)
    return np.fft.ifft(gauss_beam(ell**2, fwhm)).real


def gaussian_kernel(n: int, fwhm: float, pixel: float, truncate: float = 4.0) -> np.ndarray:
    """A sampled Gaussian of sigma = fwhm / 2.355, cut at ``truncate`` sigmas, normalised, wrapped."""
    sigma = fwhm / (2.355 * pixel)
    reach = int(truncate * sigma + 0.5)
    d = np.arange(-reach, reach + 1)
    w = np.exp(-0.5 * (d / sigma) ** 2)
    out = np.zeros(n)
    np.add.at(out, d % n, w / w.sum())
    return out


def _lines(axis: str, other: str, kernel: np.ndarray):
    n, window = len(kernel), np.fft.rfft(kernel)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        at, lines = np.unique(p[other].to_numpy(), return_inverse=True)
        a = np.zeros((len(at), n))
        np.add.at(a, (lines, p[axis].to_numpy()), p["value"].to_numpy())
        a = np.fft.irfft(np.fft.rfft(a, axis=1) * window, n, axis=1)
        return pd.DataFrame({axis: np.tile(np.arange(n, dtype=np.int32), len(at)), other: np.repeat(at, n).astype(np.int32), "value": a.ravel()})

    return run


def convolve(field: DataFrame, kernel: np.ndarray) -> DataFrame:
    """C D C^T for the circulant C of a kernel: lines along i, many at a time, then along j, by their transforms."""
    n = len(kernel)
    many = max(1, LINE_CELLS // n)
    for axis, other in (("i", "j"), ("j", "i")):
        rows = field.select("i", "j", F.col("value").cast("double").alias("value"), F.floor(F.col(other) / many).alias("block"))
        field = rows.groupBy("block").applyInPandas(_lines(axis, other, kernel), f"{axis} int, {other} int, value double")
    return field.select("i", "j", "value")


def beamed_map(field: DataFrame, n: int, fwhm: float | None, pixel: float) -> DataFrame:
    """A map at the beam's resolution; a beam of None or 0 leaves the field."""
    return convolve(field, fourier_kernel(n, fwhm, pixel)) if fwhm else field
