"""Dense numerics of one small group, on numpy: called by grouped functions on data
that Spark has joined and dealt."""

from __future__ import annotations

import math

import numpy as np


def em_normal(x: np.ndarray, rounds: int = 500, tol: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (divisor n) of a multivariate normal with missing values
    (NaN), by expectation and maximisation over the patterns of what is missing."""
    x = x[~np.isnan(x).all(1)]
    n, p = x.shape
    centre, scale = np.nanmean(x, 0), np.nanstd(x, 0)
    scale = np.where(scale > 0, scale, 1.0)
    z = (x - centre) / scale
    seen = ~np.isnan(z)
    patterns, back = np.unique(seen, axis=0, return_inverse=True)
    mu, cov = np.zeros(p), np.diag(np.nanvar(z, 0) + 1e-12)
    for _ in range(rounds):
        total, square = np.zeros(p), np.zeros((p, p))
        for k, o in enumerate(patterns):
            rows = z[back == k]
            m = ~o
            full = np.where(np.isnan(rows), 0.0, rows)
            extra = np.zeros((p, p))
            if m.any():
                inner = cov[np.ix_(o, o)] + 1e-10 * np.eye(o.sum())
                b = np.linalg.solve(inner, cov[np.ix_(o, m)]).T
                full[:, m] = mu[m] + (rows[:, o] - mu[o]) @ b.T
                extra[np.ix_(m, m)] = cov[np.ix_(m, m)] - b @ cov[np.ix_(o, m)]
            total += full.sum(0)
            square += full.T @ full + len(rows) * extra
        new = total / n
        new_cov = square / n - np.outer(new, new)
        done = max(np.abs(new - mu).max(), np.abs(new_cov - cov).max()) < tol
        mu, cov = new, new_cov
        if done:
            break
    return centre + scale * mu, cov * np.outer(scale, scale)


def ppca(y: np.ndarray, k: int, tol: float = 1e-5, rounds: int = 1000, seed: int = 29) -> tuple[np.ndarray, np.ndarray]:
    """Probabilistic PCA with missing values of standardised columns: the fitted
    matrix, and the cumulative share of the observed variance by component."""
    n, p = y.shape
    seen = ~np.isnan(y)
    full = np.where(seen, y, 0.0)
    c = np.random.default_rng(seed).standard_normal((p, k))
    x = full @ c @ np.linalg.pinv(c.T @ c)
    back = x @ c.T
    ss = ((full - back)[seen] ** 2).sum() / max(seen.sum(), 1)
    missing, old = (~seen).sum(), None
    for _ in range(rounds):
        s = np.linalg.inv(np.eye(k) + c.T @ c / ss)
        if missing:
            full = np.where(seen, y, back)
        x = full @ c @ s / ss
        c = full.T @ x @ np.linalg.pinv(x.T @ x + n * s)
        back = x @ c.T
        ss = max((((full - back) ** 2).sum() + n * np.trace(c.T @ c @ s) + missing * ss) / (n * p), 1e-12)
        value = n * (p * math.log(ss) + np.trace(s) - np.linalg.slogdet(s)[1]) + np.trace(x.T @ x) - missing * math.log(ss)
        if old is not None and abs(1 - value / old) < tol:
            break
        old = value
    c, _ = np.linalg.qr(c)
    x = full @ c
    _, v = np.linalg.eigh(np.atleast_2d(np.cov(x.T)))
    c = c @ v[:, ::-1]
    x = full @ c
    whole = (y[seen] ** 2).sum()
    share = np.array([1 - (((y - x[:, : j + 1] @ c[:, : j + 1].T)[seen]) ** 2).sum() / whole for j in range(k)])
    return x @ c.T, share


def ppca_series(y: np.ndarray, mean: float, std: float, explain: float = 0.99, tol: float = 1e-5, start: float = 0.5, n_pcs: int = 0) -> np.ndarray:
    """The first column of y as the fewest components that explain enough give it."""
    most = y.shape[1] - 1
    if n_pcs:
        return ppca(y, min(n_pcs, most), tol)[0][:, 0] * std + mean
    k = int(np.clip(round(most * start), min(2, most), most))
    while True:
        _, share = ppca(y, k, tol)
        if share[-1] >= explain or k >= most:
            break
        last = share[-1] - (share[-2] if k > 1 else 0)
        k = min(most, k + int(np.clip(round((explain - share[-1]) / max(last, 1e-9)), 1, 10)))
    enough = np.flatnonzero(share >= explain)
    k = int(enough[0]) + 1 if len(enough) else k
    return ppca(y, k, tol)[0][:, 0] * std + mean


def variance_change(x: np.ndarray, alpha: float = 1e-10) -> int | None:
    """Where the variance changes, if the likelihood ratio of the best split is beyond
    the asymptotic threshold at alpha; else None."""
    n = len(x)
    if n < 6:
        return None
    sq = np.cumsum((x - x.mean()) ** 2)
    t = np.arange(2, n - 1)
    with np.errstate(divide="ignore"):
        ratio = n * np.log(sq[-1] / n) - t * np.log(np.maximum(sq[t - 1], 1e-300) / t) - (n - t) * np.log(np.maximum(sq[-1] - sq[t - 1], 1e-300) / (n - t))
    ll = math.log(math.log(n))
    a, b = math.sqrt(2 * ll), 2 * ll + 0.5 * math.log(ll) - math.lgamma(0.5)
    # -ln ln of (1 - alpha + e^(-2 e^b)) ^ (-1/2), kept exact for tiny alpha
    inner = -0.5 * math.log1p(-alpha + math.exp(-2 * math.exp(b)))
    if inner <= 0:
        return None  # so short a series can't reach alpha
    limit = (-math.log(inner) / a + b / a) ** 2
    best = int(ratio.argmax())
    return int(t[best]) if ratio[best] >= limit else None


def d1(obs: np.ndarray, pred: np.ndarray) -> float:
    den = (np.abs(pred - obs.mean()) + np.abs(obs - obs.mean())).sum()
    return float(1 - np.abs(pred - obs).sum() / den) if den > 0 else 1.0


def pca(a: np.ndarray, scale: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, loadings and variances of centred (and scaled) columns."""
    z = a - a.mean(0)
    if scale:
        sd = z.std(0, ddof=1)
        z = z / np.where(sd > 0, sd, 1)
    _, s, v = np.linalg.svd(z, full_matrices=False)
    return z @ v.T, v.T, s**2 / (len(a) - 1)


def km(lon1, lat1, lon2, lat2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin((np.radians(lon2) - np.radians(lon1)) / 2) ** 2
    return 2 * 6371.009 * np.arcsin(np.sqrt(np.minimum(1, a)))


def distances(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    return km(lon[:, None], lat[:, None], lon[None], lat[None])


def _standardised(f: np.ndarray, f0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one neighbourhood (n x p and p) or many of them (with one axis before)."""
    m, s = f.mean(-2, keepdims=True), f.std(-2, keepdims=True)
    s = np.where(s > 0, s, 1)
    return np.concatenate([np.ones((*f.shape[:-1], 1)), (f - m) / s], -1), np.concatenate([np.ones((*f0.shape[:-1], 1)), (f0 - m[..., 0, :]) / s[..., 0, :]], -1)


def drift_weights(f: np.ndarray, f0: np.ndarray, h: np.ndarray, h0: np.ndarray, nug: np.ndarray, psill: np.ndarray, rng: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and variances of kriging with external drift and an exponential
    variogram for many points; range 0: pure nugget, so least squares. Systems that
    have no one solution get the least one."""
    x, x0 = _standardised(f, f0)
    (b, n), p = h0.shape, x.shape[-1]
    nug, psill, rng = (v[:, None] for v in (nug, psill, rng))
    has, far = rng > 0, np.where(rng > 0, rng, 1.0)
    c0 = np.where(has, psill * np.exp(-h0 / far), 0.0)
    c = np.where(has[:, :, None], psill[:, :, None] * np.exp(-h / far[:, :, None]), 0.0) + np.where(has, nug, nug + psill)[:, :, None] * np.eye(n)
    top = np.zeros((b, n + p, n + p))
    top[:, :n, :n], top[:, :n, n:], top[:, n:, :n] = c, x, x.transpose(0, 2, 1)
    right = np.concatenate([c0, x0], 1)
    try:
        solved = np.linalg.solve(top, right[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        solved = np.full((b, n + p), np.nan)
    off = np.abs((top @ solved[:, :, None])[:, :, 0] - right).max(1) if n + p else np.zeros(b)
    for i in np.flatnonzero(~(off <= 1e-8 * np.maximum(1, np.abs(right).max(1)))):
        solved[i] = np.linalg.lstsq(top[i], right[i], rcond=None)[0]
    w = solved[:, :n]
    return w, (nug + psill)[:, 0] - (w * c0).sum(1) - (solved[:, n:] * x0).sum(1)


def gwr_weights(f: np.ndarray, f0: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For many points the rows z with z @ y the weighted regression's value at f0, for
    any y, and whether the rank was too low, when the least solution is taken."""
    x, x0 = _standardised(f, f0)
    # by the singular values of the weighted rows: normal equations would square their spread
    root = np.sqrt(w)[:, :, None]
    u, s, v = np.linalg.svd(root * x, full_matrices=False)
    kept = s > s[:, :1] * math.sqrt(x.shape[-1] * np.finfo(float).eps)
    t = np.where(kept, (v @ x0[:, :, None])[:, :, 0] / np.where(kept, s, 1), 0)
    return (root * (u @ t[:, :, None]))[:, :, 0], kept.sum(1) < x.shape[-1]


def _solved(c: np.ndarray, right: np.ndarray) -> np.ndarray:
    """c^-1 @ right of many systems; of singular ones the least solution."""
    try:
        out = np.linalg.solve(c, right)
    except np.linalg.LinAlgError:
        out = np.full(right.shape, np.nan)
    for i in np.flatnonzero(~np.isfinite(out).all((1, 2))):
        out[i] = np.linalg.pinv(c[i]) @ right[i] if np.isfinite(c[i]).all() else np.nan
    return out


#: The share of the golden section.
_GOLD = (math.sqrt(5) - 1) / 2


def fit_ranges(h: np.ndarray, gamma: np.ndarray, weight: np.ndarray, nug: np.ndarray, psill: np.ndarray, least: float) -> np.ndarray:
    """Of many exponential variograms the range with the least weighted squares over
    bins (systems, bins) of weight 0 where empty: the best of a row of ranges, then by
    golden section between the two beside it. NaN where the best is at an end."""
    high = np.log(10 * np.where(weight > 0, h, 0).max(1).clip(least, None))
    low = math.log(least)

    def error(log_range: np.ndarray) -> np.ndarray:
        fit = nug[:, None] + psill[:, None] * (1 - np.exp(-h / np.exp(log_range)[:, None]))
        return (weight * (gamma - fit) ** 2).sum(1)

    steps = 40
    at = low + (high - low) * (np.arange(steps) / (steps - 1))[:, None]
    best = np.argmin([error(x) for x in at], 0)
    inside = (best > 0) & (best < steps - 1)
    mid, every = np.clip(best, 1, steps - 2), np.arange(len(h))
    a, b = at[mid - 1, every], at[mid + 1, every]
    x, y = b - _GOLD * (b - a), a + _GOLD * (b - a)
    ex, ey = error(x), error(y)
    for _ in range(24):
        left = ex < ey
        a, b = np.where(left, a, x), np.where(left, y, b)
        new = np.where(left, b - _GOLD * (b - a), a + _GOLD * (b - a))
        e = error(new)
        x, y, ex, ey = np.where(left, new, y), np.where(left, x, new), np.where(left, e, ey), np.where(left, ex, e)
    return np.where(inside, np.exp((a + b) / 2), np.nan)


def fit_variograms(f: np.ndarray, y: np.ndarray, lon: np.ndarray, lat: np.ndarray, far: np.ndarray, width: float = 5.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """nugget, partial sill and range of exponential variograms of the residuals of a
    trend, of many neighbourhoods (systems, neighbours): pairs up to 1.4 far apart in
    bins of that width. The nugget is the least bin and the sill the residuals' variance;
    only the range is fitted, by weights N / h^2. Least squares first, then generalised
    least squares with that model. No fit: (variance, 0, 0)."""
    b, n, _ = f.shape
    if n < 2:
        return np.zeros(b), np.zeros(b), np.zeros(b)
    x, _ = _standardised(f, f[:, 0])
    h = km(lon[:, :, None], lat[:, :, None], lon[:, None, :], lat[:, None, :])
    i, j = np.triu_indices(n, 1)
    d = h[:, i, j]
    use = (d > 0) & (d <= 1.4 * far[:, None])
    cell = np.floor(d[use] / width).astype(np.int64)
    bins = int(cell.max()) + 1 if len(cell) else 1
    flat = np.nonzero(use)[0] * bins + cell
    total = lambda v=None: np.bincount(flat, v, b * bins).reshape(b, bins)
    count = total()
    there = count > 0
    full = np.flatnonzero(there.any(0))  # bins that are empty in all systems count for none
    count, there = count[:, full], there[:, full]
    hb = total(d[use])[:, full] / np.maximum(count, 1)
    weight = np.where(there, count / np.where(there, hb, 1) ** 2, 0)

    def fit(r: np.ndarray):
        gamma = total(((r[:, i] - r[:, j]) ** 2)[use])[:, full] / (2 * np.maximum(count, 1))
        var = r.var(1, ddof=1)
        nug = np.where(there, gamma, np.inf).min(1, initial=np.inf)
        nug = np.where(np.isfinite(nug), nug, var)
        psill = var - nug
        ok = (psill > 0) & (there.sum(1) >= 3)
        rng = np.full(b, np.nan)
        if ok.any():
            rng[ok] = fit_ranges(hb[ok], gamma[ok], weight[ok], nug[ok], psill[ok], width / 10)
        return var, nug, psill, rng

    r = y - (x @ (np.linalg.pinv(x) @ y[:, :, None]))[:, :, 0]
    var, nug, psill, rng = fit(r)
    again = np.isfinite(rng)
    if again.any():
        c = np.where(again, psill, 0)[:, None, None] * np.exp(-h / np.where(again, rng, 1)[:, None, None]) + np.where(again, nug, 1)[:, None, None] * np.eye(n)
        s = _solved(c, np.concatenate([x, y[:, :, None]], 2))
        left, right = x.transpose(0, 2, 1) @ s[:, :, :-1], x.transpose(0, 2, 1) @ s[:, :, -1:]
        bad = ~np.isfinite(left).all((1, 2))
        beta = np.linalg.pinv(np.where(bad[:, None, None], 0, left)) @ right
        gls = y - (x @ beta)[:, :, 0]
        r = np.where((again & ~bad)[:, None], gls, r)
        var, nug, psill, rng = fit(r)
    found = again & np.isfinite(rng)
    return np.where(found, nug, var), np.where(found, psill, 0.0), np.where(found, rng, 0.0)


def fit_variogram(f: np.ndarray, y: np.ndarray, lon: np.ndarray, lat: np.ndarray, width: float = 5.0, far: float | None = None) -> tuple[float, float, float]:
    """fit_variograms of one neighbourhood; far: else the farthest pair."""
    far = distances(lon, lat).max() if far is None else far
    return tuple(float(v[0]) for v in fit_variograms(f[None], y[None], lon[None], lat[None], np.array([far]), width))


def fix_crossed(tmin: np.ndarray, tmax: np.ndarray, tail: int = 15) -> tuple[np.ndarray, np.ndarray, int]:
    """Where tmin >= tmax: their mean less and plus half the mean range of the valid
    days within `tail` days, one after the other, so what is mended counts for later
    days. Also how many were mended."""
    tmin, tmax = tmin.copy(), tmax.copy()
    bad = np.flatnonzero(tmin >= tmax)
    for i in bad:
        a, b = max(0, i - tail), i + tail + 1
        span = tmax[a:b] - tmin[a:b]
        span = span[span > 0]
        if not len(span):
            raise ValueError("no valid pair of minimum and maximum near")
        mid, half = (tmin[i] + tmax[i]) / 2, span.mean() / 2
        tmin[i], tmax[i] = mid - half, mid + half
    return tmin, tmax, len(bad)
