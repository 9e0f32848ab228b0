"""Distribution functions: the normal one as a column expression, the beta family on Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Coefficients of Hart's rational approximation of the normal distribution function, highest power first.
HART_TOP = [3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
HART_BOTTOM = [8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
HART_LIMIT, ROOT_2PI = 7.07106781186547, 2.506628274631


def two_sided_p(z: Column) -> Column:
    """2 * Phi(-|z|)."""
    x = F.abs(z)

    def horner(coefficients: list[float]) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + c
        return out

    far = x + 0.65
    for k in (4, 3, 2, 1):
        far = x + k / far
    density = F.exp(-x * x / 2)
    return 2 * F.when(x < HART_LIMIT, density * horner(HART_TOP) / horner(HART_BOTTOM)).otherwise(density / far / ROOT_2PI)


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)  # a new one each time: one that was called cannot be sent to a task


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    x, a, b = (np.asarray(v, float) for v in np.broadcast_arrays(x, a, b))
    swap = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
        tiny = 1e-300
        c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 400):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + top * d, 1 + top / c
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.nanmax(np.abs(d * c - 1), initial=0) < 1e-15:
                break
        out = np.where(x <= 0, 0.0, front * h)
    return np.where(swap, 1 - out, out)


def beta_quantile(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the regularised incomplete beta function reaches p, by bisection."""
    p, a, b = (np.asarray(v, float) for v in np.broadcast_arrays(p, a, b))
    low, high = np.zeros_like(p), np.ones_like(p)
    for _ in range(60):
        # geometric steps while the root may be tiny
        mid = np.where(low > 0, (low + high) / 2, np.where(high > 1e-290, high * 1e-4, 0))
        above = beta_cdf(mid, a, b) >= p
        low, high = np.where(above, low, mid), np.where(above, mid, high)
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p value of a correlation r of n pairs (t with n - 2 degrees of freedom); 1 for two pairs."""
    out = np.full(len(r), np.nan)
    ok = (n > 2) & r.notna()
    if ok.any():
        out[ok] = beta_cdf(np.clip(1 - r[ok] ** 2, 0, 1), (n[ok] - 2) / 2, 0.5)
    out[(n == 2) & r.notna()] = 1.0
    return pd.Series(out).astype(object).where(~np.isnan(out), None).astype("Float64")


@F.pandas_udf(DoubleType())
def beta_threshold(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """Beta quantile, to six significant digits."""
    ok = (p.notna() & a.notna() & b.notna()).to_numpy()
    out = np.full(len(p), np.nan)
    if ok.any():
        q = beta_quantile(p[ok].to_numpy(), a[ok].to_numpy(), b[ok].to_numpy())
        digits = np.floor(np.log10(np.where(q > 0, q, 1)))
        out[ok] = np.round(q / 10.0**digits, 5) * 10.0**digits
    return pd.Series(out).astype("Float64")


@F.pandas_udf(DoubleType())
def hwe_p(n0: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """Exact Hardy-Weinberg p value of the three genotype counts: the probabilities of all numbers of heterozygotes that are
    no likelier than the one seen. Neighbouring probabilities have a simple ratio, so one cumulative sum gives them all."""
    out = []
    for a, h, b in zip(n0.to_numpy(), n1.to_numpy(), n2.to_numpy(), strict=True):
        n, rare = a + h + b, h + 2 * min(a, b)
        het = np.arange(rare % 2, rare + 1, 2).astype(float)
        low = (rare - het) / 2
        ratio = 4 * low[:-1] * (n - het - low)[:-1] / ((het[:-1] + 2) * (het[:-1] + 1))
        logs = np.r_[0.0, np.cumsum(np.log(ratio))]
        w = np.exp(logs - logs.max())
        out.append(min(1.0, float(w[w <= w[het == h] * (1 + 1e-9)].sum() / w.sum())))
    return pd.Series(out, dtype=float)
