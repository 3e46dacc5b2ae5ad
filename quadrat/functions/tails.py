"""Tail probabilities. Normal quantiles stay in the JVM; the rest runs on Arrow batches.

The functions are applied to finished test rows (one per group or contrast), never to raw data.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Coefficients of Wichura's algorithm AS 241 (PPND16), Applied Statistics 37 (1988), lowest power first.
_CENTRE_NUM = (3.3871328727963666080, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
               4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3)
_CENTRE_DEN = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
               2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)
_MIDDLE_NUM = (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
               1.27045825245236838258, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4)
_MIDDLE_DEN = (1.0, 2.05319162663775882187, 1.67638483018380384940, 6.89767334985100004550e-1,
               1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
_FAR_NUM = (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 2.96560571828504891230e-1,
            2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
_FAR_DEN = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
            7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)


def _poly_sql(coefs, r: str) -> str:
    text = f"CAST({coefs[-1]!r} AS DOUBLE)"
    for c in reversed(coefs[:-1]):
        text = f"({text} * {r} + CAST({c!r} AS DOUBLE))"
    return text


def normal_quantile_sql(p: str) -> str:
    """SQL text of the standard normal quantile of the expression ``p`` (0 < p < 1)."""
    q = f"(({p}) - CAST(0.5 AS DOUBLE))"
    centre = f"(CAST(0.180625 AS DOUBLE) - {q} * {q})"
    tail = f"sqrt(-ln(least({p}, 1 - ({p}))))"
    middle = f"({tail} - CAST(1.6 AS DOUBLE))"
    far = f"({tail} - CAST(5.0 AS DOUBLE))"
    return (
        f"(CASE WHEN abs({q}) <= 0.425 THEN {q} * {_poly_sql(_CENTRE_NUM, centre)} / {_poly_sql(_CENTRE_DEN, centre)} "
        f"ELSE sign({q}) * (CASE WHEN {tail} <= 5 "
        f"THEN {_poly_sql(_MIDDLE_NUM, middle)} / {_poly_sql(_MIDDLE_DEN, middle)} "
        f"ELSE {_poly_sql(_FAR_NUM, far)} / {_poly_sql(_FAR_DEN, far)} END) END)"
    )


def normal_quantile(p: str) -> Column:
    """Standard normal quantile of column ``p``, evaluated in the JVM."""
    return F.expr(normal_quantile_sql(p))


# Lanczos coefficients for g = 7 and nine terms.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905,
            -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
_TINY = 1e-300


def log_gamma(x) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers."""
    x = np.asarray(x, float) - 1
    total = np.full(x.shape, _LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        total = total + c / (x + i)
    t = x + 7.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * np.log(t) - t + np.log(total)


def _away(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) > _TINY, x, _TINY)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    # Lentz's evaluation of the continued fraction of the incomplete beta function; finished rows are left behind.
    c, d = np.ones_like(x), 1 / _away(1 - (a + b) * x / (a + 1))
    out, live = d.copy(), np.arange(len(x))
    h = d
    for m in range(1, 10_000):
        if not len(live):
            break
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / _away(1 + num * d)
            c = _away(1 + num / c)
            h = h * c * d
        out[live] = h
        more = np.abs(c * d - 1) >= 1e-16
        live, a, b, x, c, d, h = (v[more] for v in (live, a, b, x, c, d, h))
    return out


def beta_regularised(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function of arrays of one length; NaN where an argument is."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(np.atleast_1d(a), b, x))
    out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.nan))
    out[np.isnan(a) | np.isnan(b) | np.isnan(x)] = np.nan
    some = (x > 0) & (x < 1) & (a > 0) & (b > 0)
    a, b, x = a[some], b[some], x[some]
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-x))
    near = x < (a + 1) / (a + b + 2)
    low, high, at = np.where(near, a, b), np.where(near, b, a), np.where(near, x, 1 - x)
    part = front * _beta_fraction(low, high, at) / low
    out[some] = np.where(near, part, 1 - part)
    return out


def f_sf(f, df1, df2) -> np.ndarray:
    """P(F > f); NaN for missing arguments and without degrees of freedom."""
    f, df1, df2 = (np.array(v, float) for v in np.broadcast_arrays(np.atleast_1d(np.asarray(f, float)), df1, df2))
    sound = (df1 > 0) & (df2 > 0) & ~np.isnan(f)
    out = np.full(f.shape, np.nan)
    out[sound] = np.where(f[sound] <= 0, 1.0, beta_regularised(df2[sound] / 2, df1[sound] / 2, df2[sound] / (df2[sound] + df1[sound] * np.maximum(f[sound], 0))))
    return out


def t_sf_two_sided(t, df) -> np.ndarray:
    return f_sf(np.asarray(t, float) ** 2, 1.0, df)


def gamma_upper(a, x) -> np.ndarray:
    """Regularised upper incomplete gamma function of arrays of one length."""
    a, x = (np.array(v, float) for v in np.broadcast_arrays(np.atleast_1d(a), x))
    out = np.where(np.isnan(x) | (a <= 0) | np.isnan(a), np.nan, 1.0)
    some = np.flatnonzero((x > 0) & (a > 0))
    front = np.exp(a[some] * np.log(x[some]) - x[some] - log_gamma(a[some]))
    series = x[some] < a[some] + 1
    at, k = some[series], a[some][series].copy()
    term = 1 / k
    total, step = term.copy(), x[at]
    while len(k) and (np.abs(term) > np.abs(total) * 1e-17).any():
        k = k + 1
        term = term * step / k
        total = total + term
    out[at] = 1 - front[series] * total
    at = some[~series]
    if len(at):
        b, alpha = x[at] + 1 - a[at], a[at]
        c, d = np.full(len(at), 1 / _TINY), 1 / b
        h = d.copy()
        for i in range(1, 10_000):
            num = -i * (i - alpha)
            b = b + 2
            d = 1 / _away(num * d + b)
            c = _away(b + num / c)
            h = h * c * d
            if (np.abs(c * d - 1) < 1e-16).all():
                break
        out[at] = front[~series] * h
    return out


def chi2_sf(x, df) -> np.ndarray:
    return gamma_upper(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def normal_sf(z) -> np.ndarray:
    """P(Z > z)."""
    z = np.asarray(z, float) / math.sqrt(2)
    return 0.5 * np.fromiter(map(math.erfc, z.ravel().tolist()), float, z.size).reshape(z.shape)


def _range_cdf(q: np.ndarray, k: int) -> np.ndarray:
    """P(range of k standard normals <= q) for a vector of q."""
    z = np.linspace(-9.0, 9.0, 1201)
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    upper = 1 - normal_sf(z)
    inner = upper[None, :] - (1 - normal_sf(z[None, :] - np.asarray(q, float)[:, None]))
    return k * (density[None, :] * np.clip(inner, 0, 1) ** (k - 1)).sum(axis=1) * (z[1] - z[0])


def _one_range_sf(q: np.ndarray, k: int, df: float) -> np.ndarray:
    """P(studentised range of k means > q) for positive q and one number of means and of degrees of freedom."""
    if math.isinf(df):
        return np.clip(1 - _range_cdf(q, k), 0, 1)
    # Average over the scale s = sqrt(chi2_df / df) by Gauss-Legendre quadrature.
    spread = 9 / math.sqrt(2 * df)
    low, high = max(1e-9, 1 - spread), 1 + spread
    nodes, weights = np.polynomial.legendre.leggauss(160)
    s = low + (high - low) * (nodes + 1) / 2
    log_density = (math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2)
    mass = weights * (high - low) / 2 * np.exp(log_density)
    out = np.empty(len(q))
    for at in range(0, len(q), 16):  # 16 x 160 scales x 1201 nodes at a time
        some = q[at:at + 16]
        inside = _range_cdf(np.outer(some, s).ravel(), k).reshape(len(some), -1)
        out[at:at + 16] = 1 - inside @ mass / mass.sum()
    return np.clip(out, 0, 1)


def studentised_range_sf(q, k, df=math.inf) -> np.ndarray:
    """P(studentised range of k means > q) with ``df`` error degrees of freedom, for arrays of one length."""
    q, k, df = (np.array(v, float) for v in np.broadcast_arrays(np.atleast_1d(np.asarray(q, float)), k, df))
    out = np.where(q <= 0, 1.0, np.nan)
    some = np.flatnonzero((q > 0) & (df > 0) & (k > 1))
    for pair in set(zip(k[some].tolist(), df[some].tolist())):
        at = some[(k[some] == pair[0]) & (df[some] == pair[1])]
        values, back = np.unique(q[at], return_inverse=True)
        out[at] = _one_range_sf(values, int(pair[0]), pair[1])[back]
    return out


def _upper_quantile(sf, p: np.ndarray) -> np.ndarray:
    """Smallest x with sf(x) <= p for decreasing tails, by doubling and bisection of all rows at once."""
    low, high = np.zeros(len(p)), np.ones(len(p))
    while (more := sf(high) > p).any():
        low, high = np.where(more, high, low), np.where(more, 2 * high, high)
    for _ in range(60):
        mid = (low + high) / 2
        above = sf(mid) > p
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return (low + high) / 2


def studentised_range_quantile(p, k, df) -> np.ndarray:
    p, k, df = (np.array(v, float) for v in np.broadcast_arrays(np.atleast_1d(np.asarray(p, float)), k, df))
    return _upper_quantile(lambda q: studentised_range_sf(q, k, df), p)


def t_quantile_two_sided(p, df) -> np.ndarray:
    p, df = (np.array(v, float) for v in np.broadcast_arrays(np.atleast_1d(np.asarray(p, float)), df))
    return _upper_quantile(lambda t: t_sf_two_sided(t, df), p)


def _whole(fn, *series: pd.Series) -> pd.Series:
    """``fn`` of a whole batch as arrays; rows with a missing argument stay missing."""
    arrays = [s.astype("float64").to_numpy() for s in series]
    known = ~np.any([np.isnan(a) for a in arrays], axis=0)
    out = np.full(len(known), np.nan)
    if known.any():
        out[known] = fn(*(a[known] for a in arrays))
    return pd.Series(pd.array(np.where(np.isnan(out), 0.0, out), "Float64")).mask(np.isnan(out))


@F.pandas_udf(DoubleType())
def p_two_sided_normal(z: pd.Series) -> pd.Series:
    return _whole(lambda v: 2 * normal_sf(np.abs(v)), z)


@F.pandas_udf(DoubleType())
def p_upper_normal(z: pd.Series) -> pd.Series:
    return _whole(normal_sf, z)


@F.pandas_udf(DoubleType())
def p_two_sided_t(t: pd.Series, df: pd.Series) -> pd.Series:
    return _whole(t_sf_two_sided, t, df)


@F.pandas_udf(DoubleType())
def p_f(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _whole(f_sf, f, df1, df2)


@F.pandas_udf(DoubleType())
def p_chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return _whole(chi2_sf, x, df)


@F.pandas_udf(DoubleType())
def p_studentised_range(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail; a NULL ``df`` stands for infinitely many degrees of freedom."""
    return _whole(studentised_range_sf, q, k, df.astype("float64").fillna(math.inf))


@F.pandas_udf(DoubleType())
def q_studentised_range(p: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    def distinct(*arrays: np.ndarray) -> np.ndarray:
        rows, back = np.unique(np.stack(arrays, 1), axis=0, return_inverse=True)
        return studentised_range_quantile(*rows.T)[back.ravel()]
    return _whole(distinct, p, k, df)


@F.pandas_udf(DoubleType())
def q_two_sided_t(p: pd.Series, df: pd.Series) -> pd.Series:
    return _whole(t_quantile_two_sided, p, df)


#: Largest sample whose rank-sum distribution is counted out.
EXACT_ROWS = 200


def _rank_sum_shares(m: int, n: int) -> np.ndarray:
    """Share of the arrangements of m and n values for every rank-sum statistic 0..m*n."""
    # Generating function: product over i of (1 - x^(n+i)) / (1 - x^i), multiplied out exactly in Python integers.
    size = m * n + 1
    poly = [0] * size
    poly[0] = 1
    for i in range(1, m + 1):
        for k in range(size - 1, n + i - 1, -1):
            poly[k] -= poly[k - n - i]
        for k in range(i, size):
            poly[k] += poly[k - i]
    total = sum(poly)
    return np.array([v / total for v in poly])


def rank_sum_p(w, m, n, tie_term, exact) -> np.ndarray:
    """Two-sided p of rank-sum statistics: exact, or normal with continuity and tie corrections. NaN without spread."""
    w, m, n, tie_term = (np.array(v, float) for v in np.broadcast_arrays(np.atleast_1d(np.asarray(w, float)), m, n, tie_term))
    exact = np.broadcast_to(exact, w.shape)
    total, centred = m + n, w - m * n / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        sigma = np.sqrt(m * n / 12 * ((total + 1) - tie_term / (total * (total - 1))))
        z = (centred - np.sign(centred) * 0.5) / sigma
    usable = (m > 0) & (n > 0)
    out = np.where(usable & (sigma > 0), 2 * normal_sf(np.where(np.isfinite(z), np.abs(z), 0.0)), np.nan)
    sizes = np.stack([np.minimum(m, n), np.maximum(m, n)], 1)
    chosen = usable & exact
    if (sizes[chosen] > EXACT_ROWS).any():
        raise ValueError(f"the exact test is for samples of at most {EXACT_ROWS} rows")
    for low, high in {tuple(r) for r in sizes[chosen].tolist()}:
        shares = np.cumsum(_rank_sum_shares(int(low), int(high)))
        at = np.flatnonzero(chosen & (sizes[:, 0] == low) & (sizes[:, 1] == high))
        k = np.round(w[at]).astype(int)
        below, above = shares[k], 1 - np.where(k > 0, shares[np.maximum(k - 1, 0)], 0.0)
        out[at] = np.minimum(2 * np.where(w[at] > low * high / 2, above, below), 1.0)
    return np.minimum(out, 1.0)
