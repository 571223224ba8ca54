"""Near vectors: what is sent, and pairs on the border."""

import numpy as np

from isohyet.llm import pq


def _brute(x, cosine=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = u @ u.T >= cosine
    label = np.arange(len(u))
    while True:
        new = np.where(g, label[None, :], len(u)).min(1)
        if (new == label).all():
            return g.sum(1) - 1, label
        label = new


def test_vectors_are_sent_to_few_lists(spark, monkeypatch):
    r = np.random.default_rng(3)
    x = np.repeat(r.normal(size=(1500, 64)), 4, 0)
    x[1::4] += r.normal(size=(1500, 64)) * 0.25
    x[2::4] += r.normal(size=(1500, 64)) * 0.33  # about the radius away
    # pairs so close to the border that 16 bits cannot tell
    for i in range(0, 400, 4):
        a, b = x[i] / np.linalg.norm(x[i]), r.normal(size=64)
        b -= (b @ a) * a
        x[i + 3] = a * (0.95 + (i % 8 - 2) * 1e-7) + b / np.linalg.norm(b) * np.sqrt(1 - 0.95**2)
    kept, real = {}, pq.table
    monkeypatch.setattr(pq, "table", lambda df, name: kept.setdefault(name, real(df, name)))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = pq.near_vectors(df).orderBy("vec_id").toPandas()
    n, label = _brute(x)
    assert (got.n_links.to_numpy() == n).all() and (got.component_id.to_numpy() == label).all()
    sent = kept["coded"].selectExpr("avg(size(probes) * length(vec))").first()[0]
    assert sent < 3 * 64 * 8  # bytes of three whole vectors
    assert kept["found"].where("not sure").count() >= 50
