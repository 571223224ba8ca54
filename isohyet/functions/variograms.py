"""Variogram models and their automatic choice, for many empirical variograms at once.

For a model and a range the variogram is linear in nugget and partial sill, so these two
follow from weighted least squares in closed form; only the range is searched."""

from __future__ import annotations

import math

import numpy as np

#: Shapes that are tried by default, and the smoothness of those that have one.
MODELS = ("Sph", "Exp", "Gau", "Ste")
KAPPAS = (0.05, *(round(0.2 + 0.1 * i, 1) for i in range(19)), 5.0, 10.0)
_GOLD = (math.sqrt(5) - 1) / 2


def bessel_k(nu: float, x: np.ndarray) -> np.ndarray:
    """Logarithm of the modified Bessel function of the second kind, x > 0: the integral
    of exp(-x cosh t) cosh(nu t) by the trapezoid rule, which converges very fast."""
    flat = x.ravel()
    step = np.arccosh(1 + (60 + 30 * nu) / flat) / 300  # beyond 300 steps nothing is left
    t = step * np.arange(301)[:, None]
    f = -flat * np.cosh(t) + np.logaddexp(nu * t, -nu * t) - math.log(2)
    f[0] -= math.log(2)  # the ends count by half
    top = f.max(0)
    return (top + np.log(np.exp(f - top).sum(0) * step)).reshape(x.shape)


def shape(model: str, u: np.ndarray, kappa: float = 0.5) -> np.ndarray:
    """The rise from 0 to 1 of a model at distances of u ranges."""
    if model == "Exp":
        return 1 - np.exp(-u)
    if model == "Gau":
        return 1 - np.exp(-(u**2))
    if model == "Sph":
        v = np.minimum(u, 1)
        return 1.5 * v - 0.5 * v**3
    if model == "Ste":
        z = np.maximum(2 * math.sqrt(kappa) * u, 1e-12)
        log = (1 - kappa) * math.log(2) - math.lgamma(kappa) + kappa * np.log(z) + bessel_k(kappa, z)
        return 1 - np.exp(np.minimum(log, 0.0))
    raise ValueError(f"no variogram model {model}")


def _sills(g: np.ndarray, gamma: np.ndarray, w: np.ndarray, nug: np.ndarray | None, sill: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Nugget and partial sill of least weighted squares, neither below 0; where they are
    given they stay. sill is the partial one. All of shape (systems, bins) or (systems,)."""
    total = lambda v: (w * v).sum(1)
    none = np.zeros(len(g))
    with np.errstate(divide="ignore", invalid="ignore"):
        if nug is not None and sill is not None:
            return nug, sill
        if nug is not None:
            return nug, np.nan_to_num(np.maximum(total(g * (gamma - nug[:, None])) / total(g * g), 0))
        if sill is not None:
            return np.nan_to_num(np.maximum(total(gamma - sill[:, None] * g) / total(1.0), 0)), sill
        s, sg, sgg, sy, sgy = total(1.0), total(g), total(g * g), total(gamma), total(g * gamma)
        det = s * sgg - sg * sg
        p = np.where(det > 1e-12 * s * sgg, (s * sgy - sg * sy) / det, 0.0)
        n = (sy - p * sg) / s
        # a side below 0: the best on the border
        n, p = np.where(p < 0, sy / s, n), np.maximum(p, 0)
        return np.nan_to_num(np.maximum(n, 0)), np.nan_to_num(np.where(n < 0, np.maximum(sgy / sgg, none), p))


def fit_model(model: str, kappa: float, h: np.ndarray, gamma: np.ndarray, w: np.ndarray, nug: np.ndarray | None = None, sill: np.ndarray | None = None, steps: int = 40, rounds: int = 30) -> tuple[np.ndarray, ...]:
    """nugget, partial sill, range and weighted squares of one model for many variograms
    (systems, bins; weight 0: no bin). The range is the best of a row of them, then found
    by golden section between the two beside it; NaN where the best is the least one."""
    far = np.where(w > 0, h, 0).max(1)
    near = np.where(w > 0, h, np.inf).min(1)
    low, high = np.log(np.maximum(near, 1e-9) / 10), np.log(np.maximum(10 * far, 1e-8))

    def at(log_range):
        g = shape(model, h / np.exp(log_range)[:, None], kappa)
        n, p = _sills(g, gamma, w, nug, sill)
        return n, p, (w * (gamma - n[:, None] - p[:, None] * g) ** 2).sum(1)

    grid = low + (high - low) * (np.arange(steps) / (steps - 1))[:, None]
    errors = np.array([at(x)[2] for x in grid])
    best, every = errors.argmin(0), np.arange(len(h))
    mid = np.clip(best, 1, steps - 2)
    a, b = grid[mid - 1, every], grid[mid + 1, every]
    x, y = b - _GOLD * (b - a), a + _GOLD * (b - a)
    ex, ey = at(x)[2], at(y)[2]
    for _ in range(rounds):
        left = ex < ey
        a, b = np.where(left, a, x), np.where(left, y, b)
        new = np.where(left, b - _GOLD * (b - a), a + _GOLD * (b - a))
        e = at(new)[2]
        x, y, ex, ey = np.where(left, new, y), np.where(left, x, new), np.where(left, e, ey), np.where(left, ex, e)
    found = (a + b) / 2
    n, p, e = at(found)
    return n, p, np.where(best > 0, np.exp(found), np.nan), e


def autofit(h: np.ndarray, gamma: np.ndarray, count: np.ndarray, models: tuple[str, ...] = MODELS, kappas: tuple[float, ...] = KAPPAS, nug: np.ndarray | None = None, sill: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Of many empirical variograms (systems, bins; count 0: no bin) the model with the
    least squares weighted by count / h^2: model, kappa (NaN where it has none), nug,
    psill, rng, sserr, status; of equally good ones the first. nug and sill (the partial one) of each system stay as given
    if they are. ok, too few bins (less than three), or no fit, where every model's best
    range is the least one or it has no sill."""
    w = np.where((count > 0) & (h > 0), count / np.where(h > 0, h, 1) ** 2, 0.0)
    b = len(h)
    out = {c: np.full(b, np.nan) for c in ("kappa", "nug", "psill", "rng")} | {"sserr": np.full(b, np.inf), "model": np.full(b, None, object)}
    usable = (w > 0).sum(1) >= 3
    i = np.flatnonzero(usable)
    if len(i):
        some = [None if v is None else v[i] for v in (nug, sill)]
        for model in models:
            for kappa in kappas if model == "Ste" else (np.nan,):
                n, p, r, e = fit_model(model, kappa, h[i], gamma[i], w[i], *some)
                # one that is the same but for rounding is not better
                better = np.isfinite(r) & (p > 0) & (e < out["sserr"][i] - 1e-12 * (w[i] * gamma[i] ** 2).sum(1))
                to = i[better]
                for c, v in (("kappa", np.full(len(i), kappa)), ("nug", n), ("psill", p), ("rng", r), ("sserr", e)):
                    out[c][to] = v[better]
                out["model"][to] = model
    found = np.isfinite(out["sserr"])
    out["sserr"][~found] = np.nan
    out["status"] = np.where(found, "ok", np.where(usable, "no fit", "too few bins")).astype(object)
    return out
