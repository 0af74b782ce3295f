"""Tapers, transfer functions, Fourier axes and periodograms.

Small transforms run inside the JVM as higher-order functions over arrays with the tables of sines
and cosines as literals; large ones are Arrow UDFs over batches of equally long vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def hann(n: int, periodic: bool = True) -> np.ndarray:
    """Hann taper, periodic (denominator n) or symmetric (n - 1)."""
    if n == 1:
        return np.ones(1)
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n if periodic else n - 1))


def hamming(n: int) -> np.ndarray:
    """Hamming taps of unit sum."""
    w = np.hamming(n)
    return w / w.sum()


def transfer_power(k: np.ndarray, taps: int, dx: float) -> np.ndarray:
    """Squared modulus of the Hamming filter at wavenumbers ``k``; one tap passes everything."""
    if taps <= 1:
        return np.ones_like(k)
    w = hamming(taps)
    h = (w * np.exp(-2j * np.pi * np.multiply.outer(k, np.arange(taps)) * dx)).sum(axis=-1)
    return np.abs(h) ** 2


def transfer_column(k: Column, taps: int, dx: float) -> Column:
    """The same as a column of the wavenumber."""
    if taps <= 1:
        return F.lit(1.0)
    w = hamming(taps)
    re, im = (sum((float(a) * f(2 * math.pi * dx * i * k) for i, a in enumerate(w)), F.lit(0.0)) for f in (F.cos, F.sin))
    return re * re + im * im


def half_power(taps: int, dx: float, points: int = 200_001) -> float:
    """Wavenumber at which the filter passes half the power."""
    k = np.linspace(0, 0.5 / dx, points)
    return float(k[np.argmin(np.abs(transfer_power(k, taps, dx) - 0.5))])


def spacing_of(k_max: Column) -> Column:
    """Sample spacing whose largest wavenumber is ``k_max``."""
    return 1 / (2 * k_max)


def decimation(dx_native: float, dx_target: float, length: float) -> tuple[int, int, int]:
    """(factor, target rows, native rows) of a segment of ``length``."""
    m = max(1, round(dx_target / dx_native))
    n = max(4, round(length / dx_target))
    return m, n, n * m


def matern_psd(kx: np.ndarray, ky: np.ndarray, nu: float, scale: float, variance: float) -> np.ndarray:
    """Isotropic two-dimensional Matern density."""
    a = math.sqrt(2 * nu) / scale
    k2 = (2 * np.pi) ** 2 * (np.add.outer(kx**2, ky**2))
    c = variance * 4 * math.pi * math.gamma(nu + 1) * a ** (2 * nu) / math.gamma(nu)
    return c * (a * a + k2) ** (-(nu + 1))


def gaussian_field(nx: int, ny: int, dx: float, dy: float, density, seed: int = 42) -> np.ndarray:
    """Random field with the given two-dimensional density (a function of kx and ky)."""
    noise = np.random.default_rng(seed).standard_normal((nx, ny))
    s = density(np.fft.fftfreq(nx, dx), np.fft.fftfreq(ny, dy))
    return np.fft.ifft2(np.fft.fft2(noise) * np.sqrt(s / (dx * dy))).real


def _detrended(x: np.ndarray, kind: str | None) -> np.ndarray:
    """Rows without their mean or least-squares line."""
    if kind is None:
        return x
    x = x - x.mean(axis=1, keepdims=True)
    if kind == "linear":
        t = np.arange(x.shape[1]) - (x.shape[1] - 1) / 2
        x = x - (x @ t / (t @ t))[:, None] * t
    return x


def periodograms(x: np.ndarray, dx: float, detrend: str | None = "linear", periodic: bool = True, doubled: bool = True, raw: bool = False) -> np.ndarray:
    """One-sided tapered periodogram of every row.

    Density |X|**2 dx / (n mean(w**2)); ``doubled`` adds the negative side to interior
    wavenumbers; ``raw`` leaves the plain squared modulus.
    """
    n = x.shape[1]
    w = hann(n, periodic)
    p = np.abs(np.fft.rfft(_detrended(x, detrend) * w, axis=1)) ** 2
    if raw:
        return p
    p *= dx / (n * np.mean(w**2))
    if doubled:
        p[:, 1 : (n + 1) // 2] *= 2
    return p


def periodogram_udf(dx: float, **options):
    """Arrow UDF: array<double> to its periodogram; vectors of a batch are grouped by length.

    A vector that is null, shorter than 2 or holds a null or NaN has a null periodogram.
    """

    def run(v: pd.Series) -> pd.Series:
        out = np.empty(len(v), dtype=object)
        size = np.array([0 if a is None else len(a) for a in v])
        for n in np.unique(size[size > 1]):
            at = np.flatnonzero(size == n)
            m = np.stack([np.asarray(v.iloc[i], dtype=float) for i in at])
            ok = np.isfinite(m).all(axis=1)
            for i, p in zip(at[ok], periodograms(m[ok], dx, **options)):
                out[i] = p
        return pd.Series(out, index=v.index)

    return F.pandas_udf(run, ArrayType(DoubleType()))


def welch_udf(dx: float, nperseg: int, detrend: str | None = "constant"):
    """Arrow UDF: mean periodogram of half-overlapping pieces of ``nperseg`` samples."""

    def run(v: pd.Series) -> pd.Series:
        out = np.empty(len(v), dtype=object)
        for i, a in enumerate(v):
            if a is None or len(a) < nperseg or not np.isfinite(x := np.asarray(a, dtype=float)).all():
                continue
            pieces = np.lib.stride_tricks.sliding_window_view(x, nperseg)[:: nperseg // 2]
            out[i] = periodograms(pieces, dx, detrend).mean(axis=0)
        return pd.Series(out, index=v.index)

    return F.pandas_udf(run, ArrayType(DoubleType()))


def dft_power(v: Column, n: int, dx: float) -> Column:
    """The linear-detrended, periodic-Hann periodogram of an array of ``n`` doubles, all in the JVM.

    Detrending, taper and transform are linear, so each wavenumber is two dot products of the
    vector with a literal row.
    """
    eye = _detrended(np.eye(n), "linear") * hann(n)
    spec = np.fft.rfft(eye, axis=1)  # row i: transform of the i-th unit vector
    power = np.full(n // 2 + 1, dx / (n * np.mean(hann(n) ** 2)))
    power[1 : (n + 1) // 2] *= 2
    spec = spec * np.sqrt(power)

    def matrix(m: np.ndarray) -> Column:
        return F.expr("array(" + ", ".join("array(" + ", ".join(f"{float(c)!r}D" for c in row) + ")" for row in m.T) + ")")

    def dots(m: np.ndarray) -> Column:
        return F.transform(matrix(m), lambda row: F.aggregate(F.zip_with(v, row, lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t))

    return F.zip_with(dots(spec.real), dots(spec.imag), lambda re, im: re * re + im * im)


def periodogram_2d_udf(rows: int, cols: int, dx: float, dy: float):
    """Arrow UDF: a flattened patch (row by row) to its flattened two-sided density.

    Symmetric Hann taper on both axes, no detrending, unshifted axes.
    """
    w = np.multiply.outer(hann(rows, False), hann(cols, False))
    scale = dx * dy / (rows * cols) / np.mean(w**2)

    def run(v: pd.Series) -> pd.Series:
        out = np.empty(len(v), dtype=object)
        for i, a in enumerate(v):
            if a is not None and len(a) == rows * cols and np.isfinite(x := np.asarray(a, dtype=float)).all():
                out[i] = (np.abs(np.fft.fft2(x.reshape(rows, cols) * w)) ** 2 * scale).ravel()
        return pd.Series(out, index=v.index)

    return F.pandas_udf(run, ArrayType(DoubleType()))
