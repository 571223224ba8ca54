"""Text operators over all rows, sources, lengths and languages."""

from collections import Counter

import numpy as np

from isohyet.llm import pq

DOCS = "doc_id long, text string, lang string, source string"


def test_pipeline_ends_in_the_order_of_the_mix(spark):
    import corpus_pipeline

    sources = {i: "a" if i < 1600 else "b" if i < 2000 else "c" for i in range(2100)}
    docs = spark.createDataFrame([(i, f"text {i}", "en", s) for i, s in sources.items()], DOCS)
    out = corpus_pipeline.tokens_stage(spark, docs.orderBy("doc_id"), "").collect()
    ranks = [r.mix_rank for r in out]
    assert ranks == sorted(set(ranks)) and sorted(r.doc_id for r in out) == sorted(sources)
    n = Counter(sources.values())
    w = {s: n[s] ** 0.5 / sum(x**0.5 for x in n.values()) for s in n}
    seen, left = Counter(), Counter(n)
    for t, r in enumerate(out, 1):
        seen[sources[r.doc_id]] += 1
        left[sources[r.doc_id]] -= 1
        assert all(abs(seen[s] - t * w[s]) <= 32 for s in w)  # a whole block, and one under way
        if min(left.values()) == 0:
            break
    assert len(seen) == 3 and t > 300


def test_vectors_of_every_length_link(spark):
    r = np.random.default_rng(3)
    rows, of = [], {}
    for size, n in ((12, 60), (7, 40), (3, 1)):
        base = r.standard_normal((n, size))
        base[n // 2 :] = base[r.integers(0, max(n // 8, 1), n - n // 2)] + 0.05 * r.standard_normal((n - n // 2, size))
        base[-1] = base[0]
        for v in base:
            of[len(rows)] = v / np.linalg.norm(v)
            rows.append((len(rows), [float(x) for x in v]))
    rows += [(1000 + i, []) for i in range(90)]  # the most frequent length is 0
    got = {x.vec_id: x for x in pq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = {i: sum(j != i and len(of[j]) == len(of[i]) and of[i] @ of[j] >= 0.95 for j in of) for i in of}
    assert {i: x.n_links for i, x in got.items()} == want | {1000 + i: 0 for i in range(90)}
    assert any(want[i] for i in range(60)) and any(want[i] for i in range(60, 100))
    least, links = {i: i for i in of}, [(i, j) for i in of for j in of if len(of[i]) == len(of[j]) and of[i] @ of[j] >= 0.95]
    for _ in of:
        for i, j in links:
            least[i] = min(least[i], least[j])
    assert all(got[i].component_id == least[i] and got[i].kept == (least[i] == i) for i in of)
