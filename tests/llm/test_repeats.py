"""Repeats, vectors, components and the pipeline against brute force."""

import numpy as np
import pytest

from isohyet.llm import anchors, common, minhash, pq, suffix

DOCS = "doc_id long, text string, hits string, part string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOCS).repartition(3)


def corpus(seed, copies=30):
    r = np.random.default_rng(seed)
    word = lambda n: " ".join(f"w{x}" for x in r.integers(0, 3000, n))
    shared = [word(int(n)) for n in r.integers(15, 140, 8)]
    texts = [None, "", " ", "x", "é" * 900, "a " * 600, "z" * 2500, word(400)]
    for _ in range(copies):
        parts = [word(int(r.integers(0, 60)))]
        for k in r.integers(0, len(shared), r.integers(1, 4)):
            s = shared[k]
            cut = int(r.integers(0, max(1, len(s) // 3)))
            parts += [s[cut:] if r.random() < 0.5 else s, word(int(r.integers(0, 40)))]
        texts.append(" ".join(parts))
    texts += [texts[-1], texts[-1], texts[-2] + " tail", "head " + texts[-3]]
    return [texts[i] for i in r.permutation(len(texts))]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_words(spark, seed):
    texts = corpus(seed)
    seen, want = set(), {}
    for i, t in enumerate(texts):
        w = (t or "").split(" ") if t else []
        w = [x for x in w if x]
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(g)
        want[i] = (len(w), sum(gone), " ".join(x for x, y in zip(w, gone) if not y))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in anchors.drop_repeats(docs_of(spark, texts)).collect()}
    assert got == want


@pytest.mark.parametrize("seed", [3, 4])
def test_repeated_bytes(spark, seed):
    texts = corpus(seed)
    raw = [(t or "").encode() for t in texts]
    n = {}
    for t in raw:
        for k in range(len(t) - 399):
            n[t[k : k + 400]] = n.get(t[k : k + 400], 0) + 1
    want = {}
    for i, t in enumerate(raw):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 399):
            if n[t[k : k + 400]] > 1:
                gone[k : k + 400] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i] = (len(t), int(gone.sum()), spans, np.frombuffer(t, np.uint8)[~gone].tobytes())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.drop_repeated_bytes(docs_of(spark, texts)).collect()}
    assert got == want


def test_repeats_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert anchors.drop_repeats(empty).count() == 0 and suffix.drop_repeated_bytes(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b", "", ""), (1, None, "", ""), (2, "c " * 30, "", ""), (2, "c " * 30, "", "")], DOCS)
    assert sorted((r.doc_id or 0, r.n_words) for r in anchors.drop_repeats(odd).collect()) == [(0, 2), (1, 0), (2, 30), (2, 30)]
    assert suffix.drop_repeated_bytes(odd).count() == 4


def test_rows_of_one_document_are_one_place(spark):
    text = " ".join(f"v{i}" for i in range(200))
    odd = spark.createDataFrame([(2, text, "", ""), (2, text, "", ""), (3, "other " + text[100:700] + " tail", "", "")], DOCS)
    got = suffix.drop_repeated_bytes(odd).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(2, 600), (2, 600), (3, 600)]
    alone = suffix.drop_repeated_bytes(odd.where("doc_id = 2")).collect()
    assert [r.n_removed for r in alone] == [0, 0]


def test_both_halves_of_a_hash_decide():
    r = np.random.default_rng(11)
    h, other = r.integers(0, 8, 500).astype(np.uint64), r.integers(0, 8, 500).astype(np.uint64)
    order, start, count = anchors._runs(h, other)
    runs = [sorted(order[a : a + n].tolist()) for a, n in zip(start, count)]
    want = {}
    for i, x in enumerate(zip(h.tolist(), other.tolist())):
        want.setdefault(x, []).append(i)
    assert sorted(runs) == sorted(want.values())
    assert anchors._runs(h, None)[2].tolist() == np.bincount(h.astype(int)).tolist()


def test_long_texts_and_many_parts(spark, monkeypatch):
    """A text longer than the pieces that are worked on at once, and a hot passage."""
    r = np.random.default_rng(12)
    word = lambda n: " ".join(f"w{x}" for x in r.integers(0, 10**6, n))
    hot = word(80)
    texts = [word(230_000), *(f"{word(30)} {hot} {word(30)}" for _ in range(100)), hot]
    texts.append(texts[0][1_000_000:1_003_000])
    monkeypatch.setattr(anchors, "PART", 1 << 15)  # some seventy parts
    got = {x.doc_id: x for x in suffix.drop_repeated_bytes(docs_of(spark, texts)).collect()}
    assert got[0].n_removed == 3000 and got[102].n_removed == 3000
    assert all(len(hot) <= got[i].n_removed <= len(hot) + 14 for i in range(1, 101)) and got[101].n_removed == len(hot)
    words_ = {x.doc_id: x.n_removed for x in anchors.drop_repeats(docs_of(spark, texts)).collect()}
    assert words_[0] == 0 and words_[1] == 0 and all(words_[i] == 80 for i in range(2, 102))
    assert words_[102] >= len(texts[102].split()) - 2


def test_rows_of_chunks_are_dealt_over_all_parts(spark, monkeypatch):
    """No part gets the own rows of all chunks, in the search for hits and in the merge."""
    r = np.random.default_rng(14)
    word = lambda n: " ".join(f"w{x}" for x in r.integers(0, 10**6, n))
    hot = word(80)
    docs = spark.createDataFrame([(i, f"{word(30)} {hot} {word(30)}", "x", "y") for i in range(400)], DOCS).repartition(16)
    real, seen = anchors.dealt, []

    def dealt(rows, parts):
        own = "symbols is null" if "symbols" in rows.columns else "key is null" if "key" in rows.columns else "false"
        seen.append([x.part for x in rows.where(own).select("part").collect()])
        return real(rows, parts)

    monkeypatch.setattr(anchors, "dealt", dealt)
    monkeypatch.setattr(suffix, "dealt", dealt)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        suffix.repeated_starts(docs)
        anchors.anchor_hits(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = [parts for parts in seen if len(parts) > 8]
    assert len(found) >= 3 and all(max(parts.count(p) for p in parts) <= 4 and len(set(parts)) > 8 for parts in found)


def test_passages_of_over_50_words_under_the_length(spark):
    """What counts is bytes: of 52 words that two documents share, with fewer bytes than
    the length nothing goes, with as many all; a smaller length takes both."""
    words = lambda n, k: " ".join(f"{k}{i:0{n - 1}d}" for i in range(52))
    short, full = words(6, "s"), words(7, "f")
    assert len(short) == 363 and len(full) == 415
    texts = [f"{a} {p} {b}" for p, sides in ((short, "ABCD"), (full, "EFGH")) for a, b in (sides[:2], sides[2:])]
    removed = lambda length: [x.n_removed for x in suffix.drop_repeated_bytes(docs_of(spark, texts), length=length).orderBy("doc_id").collect()]
    assert removed(400) == [0, 0, 417, 417]
    assert removed(300) == [365, 365, 417, 417]


def test_merge_is_the_order_of_all_suffixes():
    """The merged intervals are those of sorting all suffixes at once."""
    r = np.random.default_rng(6)
    shards = []
    for _ in range(4):
        n = r.integers(1, 12, 9)
        shards.append((r.integers(0, 3, n.sum()).astype(np.uint64), n))
    depths = (2, 4)
    begin, text, got = suffix.merged_classes(shards, depths)
    sizes = np.concatenate([n for _, n in shards])
    for d in depths:
        classes = {}
        for b, n in zip(begin, sizes):
            for k in range(n - d + 1):
                classes.setdefault(tuple(text[b + k : b + k + d]), set()).add(int(got[d][b + k]))
        assert all(len(v) == 1 for v in classes.values())
        ordered = [next(iter(classes[k])) for k in sorted(classes)]
        assert ordered == sorted(set(ordered))


def test_near_vectors(spark):
    r = np.random.default_rng(7)
    base = r.standard_normal((150, 16))
    near = base[r.integers(0, 10, 120)] + 0.06 * r.standard_normal((120, 16))
    rows = [(i, [float(np.float32(x)) for x in v], "extra") for i, v in enumerate(np.concatenate([base, near]))]
    rows += [(300, None, ""), (301, [0.0] * 16, ""), (302, [float("nan")] * 16, ""), (303, [None] + [1.0] * 15, ""), (304, [1.0, 2.0], ""), (305, rows[5][1], ""), (306, rows[5][1], "")]
    order = r.permutation(len(rows))
    df = spark.createDataFrame([rows[i] for i in order], "vec_id long, embedding array<double>, list string")
    good = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(good)
    p = {i: i for i, *_ in rows}

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    n = dict.fromkeys(p, 0)
    for i in ids:
        for j in ids:
            if i < j and good[i] @ good[j] >= 0.95:
                n[i] += 1
                n[j] += 1
                a, b = find(i), find(j)
                p[max(a, b)] = min(a, b)
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in pq.near_vectors(df).collect()}
    assert got == {i: (n[i], find(i), find(i) == i) for i in p}
    assert sum(n.values()) > 100
    assert pq.near_vectors(df.limit(0)).count() == 0


def test_components(spark):
    r = np.random.default_rng(8)
    links = [(i, i + 1) for i in range(0, 300) if i % 37] + [(int(a), int(b)) for a, b in r.integers(400, 500, (40, 2))] + [(600, x) for x in range(601, 700)]
    p = {x: x for e in links for x in e}

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {y for a, b in links if a != b for y in (a, b)}}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from isohyet.llm import bpe, minhash, mixing, pii
    from isohyet.llm.queries import vocabulary

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = out
        out = stage(spark, out, d)
        if i < 4:
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / str(i)))
            out = spark.read.parquet(str(tmp_path / str(i)))
        if i == 1:
            assert out.count() == minhash.near_duplicates(before, 80).where("kept").count()
        if i == 2:
            want = {r.doc_id: pii.redact(r.text, pii.find(r.text)) if r.text else r.text for r in before.collect()}
            assert {r.doc_id: r.text for r in out.collect()} == want
        if i == 3:
            assert out.count() == before.count() == mixing.mix(before).count()
    last = {r.doc_id: r.ids for r in out.collect()}
    assert last == {r.doc_id: r.ids for r in bpe.encode(before, vocabulary()).collect()}
    assert corpus_pipeline.run(spark, d).count() == len(last)


def thue_morse(bits, a, b):
    """2 ** bits letters; any polynomial with an odd base modulo a power of two takes it
    for what it is with a and b exchanged."""
    return "".join(b if i.bit_count() % 2 else a for i in range(2**bits))


def test_words_that_a_polynomial_confuses(spark):
    x, y = thue_morse(10, "a", "b"), thue_morse(10, "b", "a")
    head = " ".join(f"w{i}" for i in range(19))
    got = {r.doc_id: r.n_removed for r in anchors.drop_repeats(docs_of(spark, [f"{head} {x}", f"{head} {y}", f"{head} {x}"])).collect()}
    assert got == {0: 0, 1: 0, 2: 20}
    near = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_of(spark, [x, y, x])).collect()}
    assert near == {0: 0, 1: 1, 2: 0}


def test_words_of_words_that_a_polynomial_confuses(spark):
    """The same pattern made of words, in windows of 16 words and of 20."""
    x, y = (" ".join(p) for p in ((("aa", "bb")[i.bit_count() % 2] for i in range(16)), (("bb", "aa")[i.bit_count() % 2] for i in range(16))))
    got = {r.doc_id: r.n_removed for r in anchors.drop_repeats(docs_of(spark, [x, y, x]), window=16, block=8).collect()}
    assert got == {0: 0, 1: 0, 2: 16}


def test_bytes_that_a_polynomial_confuses(spark):
    x, y = thue_morse(11, "a", "b"), thue_morse(11, "b", "a")
    texts = [x[:1500], y[:1500], "q" + x[100:900], y[3:700] + "z"]
    n = {}
    for t in texts:
        for k in range(len(t) - 399):
            n[t[k : k + 400]] = n.get(t[k : k + 400], 0) + 1
    want = {}
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 399):
            if n[t[k : k + 400]] > 1:
                gone[k : k + 400] = True
        want[i] = int(gone.sum())
    assert {r.doc_id: r.n_removed for r in suffix.drop_repeated_bytes(docs_of(spark, texts)).collect()} == want


def test_word_hashes_of_many_words():
    """As many different hashes as words, of any length and place; seeds differ."""
    r = np.random.default_rng(4)
    words_ = [bytes(r.integers(97, 99, n).astype(np.uint8)) for n in [*range(1, 40), 255, 256, 257, 300] for _ in range(200)]
    data = np.frombuffer(b" ".join(words_), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words_]) - 1
    starts = ends - [len(w) for w in words_]
    h, g = common.word_hashes(data, starts, ends), common.word_hashes(data, starts, ends, 7)
    by = {}
    for w, x in zip(words_, h.tolist(), strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by) and not (h == g).any()


def test_string_hashes_agree_and_differ():
    r = np.random.default_rng(5)
    data = r.integers(0, 3, 4000).astype(np.uint8)
    for second in (False, True):
        h = suffix.Hashes(data, second)
        for n in (1, 7, 32, 400):
            at = np.arange(len(data) - n + 1)
            got = {}
            for k, x in zip(at.tolist(), h.of(at, n).tolist(), strict=True):
                assert got.setdefault(data[k : k + n].tobytes(), x) == x
            assert len(set(got.values())) == len(got)
