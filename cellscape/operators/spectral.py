"""Spectra: one row a spectrum, ARRAY<DOUBLE> over the bands of a small band catalog (band from 0, wl_nm)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscape.functions.indices import normalized_difference
from cellscape.operators.catalog import band_at


def value_at(bands: DataFrame, nm: float, tol: float = 15.0, spectrum: str = "spectrum") -> Column:
    return F.get(F.col(spectrum), F.lit(band_at(bands, nm, tol)))


def wavelength_subset(spectra: DataFrame, bands: DataFrame, nms: list[float], tol: float = 15.0) -> DataFrame:
    return spectra.select("vec_id", *[value_at(bands, nm, tol).alias(f"nm_{round(nm)}") for nm in nms])


def ratio(spectra: DataFrame, bands: DataFrame, nm_a: float, nm_b: float, key: str = "vec_id", tol: float = 15.0) -> DataFrame:
    """(key, value): the value at one wavelength over that at another; missing where that is 0."""
    return spectra.select(key, F.try_divide(value_at(bands, nm_a, tol), value_at(bands, nm_b, tol)).alias("value"))


def normalized_ratio(spectra: DataFrame, bands: DataFrame, nm_a: float, nm_b: float, key: str = "vec_id", tol: float = 15.0) -> DataFrame:
    """(key, value): the normalised difference of the values at two wavelengths."""
    return spectra.select(key, normalized_difference(value_at(bands, nm_a, tol), value_at(bands, nm_b, tol)).alias("value"))


def absorption_depth(spectra: DataFrame, bands: DataFrame, feature: float, left: float, right: float, tol: float = 20.0) -> DataFrame:
    """(vec_id, depth): 1 - R / Rc, Rc on the line between the shoulders; missing where Rc is not positive."""
    if not left < feature < right:
        raise ValueError("the feature must lie between its shoulders")
    wl = {b: w for b, w in bands.select("band", "wl_nm").collect()}
    at = [band_at(bands, nm, tol) for nm in (left, feature, right)]
    t = (wl[at[1]] - wl[at[0]]) / (wl[at[2]] - wl[at[0]])
    lo, mid, hi = (F.get("spectrum", F.lit(b)) for b in at)
    line = lo + (hi - lo) * t
    return spectra.select("vec_id", F.when(line > 0, 1 - mid / line).alias("depth"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def spectral_angle(spectra: DataFrame, reference: list[float]) -> DataFrame:
    """(vec_id, angle) in radians to the reference; missing with a missing band or a zero norm."""
    ref = F.array(*[F.lit(float(x)) for x in reference])
    x = F.col("spectrum")
    cos = F.try_divide(dot(x, ref), F.sqrt(dot(x, x)) * F.lit(float(np.linalg.norm(reference))))
    return spectra.select("vec_id", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))).alias("angle"))


def mean_spectra(spectra: DataFrame, by: str) -> DataFrame:
    """(by, band, value): mean of every band in each class, partial sums first."""
    return spectra.select(by, F.posexplode("spectrum").alias("band", "v")).groupBy(by, "band").agg(F.avg("v").alias("value"))


def endmembers(spectra: DataFrame, labels: list[int]) -> np.ndarray:
    """Mean spectra of labels as a matrix (bands, labels): bands x labels numbers reach the driver."""
    rows = mean_spectra(spectra.filter(F.col("label").isin(labels)), "label").collect()
    out = np.zeros((1 + max(r.band for r in rows), len(labels)))
    for r in rows:
        out[r.band, labels.index(r.label)] = r.value
    return out


def hull_removed(wl: np.ndarray, y: np.ndarray) -> np.ndarray:
    """y over its upper convex hull along wl; hull points give 1, input order is kept."""
    out, ok = np.full(len(y), np.nan), np.isfinite(y) & np.isfinite(wl)
    if ok.sum() < 2:
        return out
    order = np.flatnonzero(ok)[np.argsort(wl[ok], kind="stable")]
    top: list[int] = []
    for i in order:
        while len(top) > 1 and (y[top[-1]] - y[top[-2]]) * (wl[i] - wl[top[-2]]) <= (y[i] - y[top[-2]]) * (wl[top[-1]] - wl[top[-2]]):
            top.pop()
        top.append(i)
    line = np.interp(wl[order], wl[top], y[top])
    out[order] = np.where(line > 0, y[order] / np.where(line > 0, line, 1), np.nan)
    return out


def continuum_removal(spectra: DataFrame, wl: list[float]) -> DataFrame:
    """(vec_id, label, removed): hull-removed spectra in Arrow batches."""
    w = np.asarray(wl, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [hull_removed(w, np.array(s.as_py(), float)) for s in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.float64()))], names=["vec_id", "label", "removed"])

    return spectra.select("vec_id", "label", "spectrum").mapInArrow(run, "vec_id long, label int, removed array<double>")


def nnls(a: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least squares with non-negative unknowns, by active sets; an error where they do not settle."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    gram, rhs = a.T @ a, a.T @ y
    for _ in range(30 * n + 100):
        grad = rhs - gram @ x
        grad[free] = -np.inf
        k = int(np.argmax(grad))
        if grad[k] <= 1e-12:
            break
        free[k] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(gram[np.ix_(free, free)], rhs[free], rcond=None)[0]
            if (s[free] > 0).all():
                x = s
                break
            low = free & (s <= 0)
            step = np.min(x[low] / (x[low] - s[low]))
            x = x + step * (s - x)
            free &= x > 1e-14
            x[~free] = 0
    else:
        raise RuntimeError("the active sets did not settle")
    return x


def unmix_ucls(spectra: DataFrame, members: np.ndarray) -> DataFrame:
    """(vec_id, abundance, rmse) by unconstrained least squares: dot products with the pseudoinverse's rows."""
    inverse = np.linalg.pinv(members)
    x = F.col("spectrum")
    lit = lambda v: F.array(*[F.lit(float(e)) for e in v])
    found = spectra.select("vec_id", "spectrum", F.array(*[dot(x, lit(row)) for row in inverse]).alias("abundance"))
    model = F.array(*[dot(F.col("abundance"), lit(row)) for row in members])
    gap = F.zip_with("spectrum", model, lambda a, b: (a - b) * (a - b))
    return found.select("vec_id", "abundance", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda acc, v: acc + v) / F.size("spectrum")).alias("rmse"))


def unmix_fcls(spectra: DataFrame, members: np.ndarray) -> DataFrame:
    """(vec_id, abundance, rmse) with abundances that are not negative and sum to one, in Arrow batches."""
    delta = 1e-4 / max(float(np.abs(members).max()), 1e-6)
    a = np.vstack([delta * members, np.ones(members.shape[1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shares, rmse = [], []
            for s in b.column(1):
                y = np.array(s.as_py(), float)
                if not np.isfinite(y).all():
                    shares.append(None)
                    rmse.append(None)
                    continue
                x = nnls(a, np.append(delta * y, 1.0))
                x = x / x.sum() if x.sum() > 0 else x
                shares.append(x)
                rmse.append(float(np.sqrt(np.mean((members @ x - y) ** 2))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shares, pa.list_(pa.float64())), pa.array(rmse, pa.float64())], names=["vec_id", "abundance", "rmse"])

    return spectra.select("vec_id", "spectrum").mapInArrow(run, "vec_id long, abundance array<double>, rmse double")
