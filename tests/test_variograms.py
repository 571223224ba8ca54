"""Variogram models: known ones are found again, whatever is beside them."""

import math

import numpy as np
import pytest

from isohyet.functions import variograms
from isohyet.operators import interp

H = np.linspace(5, 300, 60)


def test_bessel_of_half_orders():
    """Of order 1/2 and 3/2 there are closed forms."""
    x = np.geomspace(1e-6, 300, 50)
    half = 0.5 * np.log(math.pi / (2 * x)) - x
    assert variograms.bessel_k(0.5, x) == pytest.approx(half, abs=1e-9)
    assert variograms.bessel_k(1.5, x) == pytest.approx(half + np.log1p(1 / x), abs=1e-9)


def test_shapes():
    u = np.linspace(0.001, 4, 50)
    assert variograms.shape("Ste", u, 0.5) == pytest.approx(variograms.shape("Exp", u * math.sqrt(2), 0), abs=1e-9)
    for m in variograms.MODELS:
        g = variograms.shape(m, u, 1.3)
        assert (np.diff(g) >= -1e-12).all() and 0 <= g[0] < 0.05 and g[-1] > 0.95


@pytest.mark.parametrize("model,kappa", [("Sph", 0), ("Exp", 0), ("Gau", 0), ("Ste", 0.3), ("Ste", 1.5)])
def test_known_models(model, kappa):
    r = np.random.default_rng(3)
    nug, psill, rng = r.uniform(0.1, 2, 5), r.uniform(1, 5, 5), r.uniform(30, 120, 5)
    gamma = nug[:, None] + psill[:, None] * variograms.shape(model, H / rng[:, None], kappa)
    h, count = np.tile(H, (5, 1)), np.tile(np.arange(60.0) + 5, (5, 1))
    count[:, 50:] = 0  # empty bins count for nothing, whatever is in them
    gamma[:, 50:] = 1e6
    out = variograms.autofit(h, gamma, count)
    assert set(out["status"]) == {"ok"} and set(out["model"]) == {model}
    if kappa:
        assert out["kappa"] == pytest.approx(np.full(5, kappa))
    for c, v in (("nug", nug), ("psill", psill), ("rng", rng)):
        assert out[c] == pytest.approx(v, rel=2e-3, abs=2e-3)


def test_given_values_stay():
    gamma = (0.5 + 2 * variograms.shape("Exp", H / 60))[None]
    out = variograms.autofit(H[None], gamma, np.ones((1, 60)), ("Exp",), nug=np.array([0.5]))
    assert out["nug"][0] == 0.5 and out["psill"][0] == pytest.approx(2, rel=1e-4) and out["rng"][0] == pytest.approx(60, rel=1e-3)
    out = variograms.autofit(H[None], gamma, np.ones((1, 60)), ("Exp",), nug=np.array([0.5]), sill=np.array([2.0]))
    assert out["rng"][0] == pytest.approx(60, rel=1e-3)


def test_no_worse_than_a_search(spark):
    """Noisy variograms: no point of a fine search over range and sills is better."""
    r = np.random.default_rng(8)
    gamma = np.abs(1 + 2 * variograms.shape("Sph", H / 80) + 0.4 * r.standard_normal(60))
    w = 1 / H**2
    n, p, rng, e = (float(v[0]) for v in variograms.fit_model("Sph", np.nan, H[None], gamma[None], w[None]))
    best = min(float((w * (gamma - a - b * variograms.shape("Sph", H / c)) ** 2).sum()) for c in np.linspace(5, 400, 120) for a in np.linspace(0, 3, 25) for b in np.linspace(0, 4, 25))
    assert e <= best + 1e-12


def test_failures_have_a_status(spark):
    flat = [("flat", float(i + 1), 10.0, 3.0) for i in range(20)]
    few = [("few", 5.0, 10.0, 1.0), ("few", 15.0, 10.0, 2.0)]
    zero = [("zero", 0.0, 3.0, 1.0), ("zero", None, 3.0, 1.0), ("zero", 5.0, 0.0, 2.0), ("zero", 5.0, 1.0, None)]
    good = [("good", float(h), 9.0, float(1 + 2 * variograms.shape("Gau", np.array([h / 70]))[0])) for h in H]
    rows = spark.createDataFrame([(k, n, h, g) for k, h, n, g in flat + few + zero + good], "k string, n double, h double, gamma double")
    got = {r.k: r for r in interp.autofit_variograms(rows, "k", kappas=(0.5, 2.0)).collect()}
    assert {k: r.status for k, r in got.items()} == {"flat": "no fit", "few": "too few bins", "zero": "too few bins", "good": "ok"}
    assert got["good"].model == "Gau" and got["good"].rng == pytest.approx(70, rel=1e-3) and got["flat"].rng is None
    assert interp.autofit_variograms(rows.where("k = 'x'"), "k").count() == 0
