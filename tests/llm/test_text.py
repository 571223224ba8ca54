"""Text operators against brute force, with nulls, empty texts, ties and extra columns."""

import hashlib
import heapq
import re
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from isohyet.llm import bpe, chat, langid, minhash, mixing, pii, quality
from isohyet.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, bands string"


def docs_of(spark, texts, langs=None, sources=None):
    rows = [(i, t, (langs or {}).get(i, "en"), (sources or {}).get(i, "a"), len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \t\n", "one", "a b c \U0001f600", "word " * 3000, "Same text here for all of us. " * 3, "Same text here for all of us. " * 3]


# -- chat ---------------------------------------------------------------------


def test_chat_round_trip(spark):
    texts = [r"\### Assistant: </turn> ok", "<turn>x<says>y<next>z</turn>", "\\", "\\\\</turn", None, "", "plain\nlines", "<\\turn>"]
    rows = [(1, i, "user" if i % 3 else "assistant", t, "extra") for i, t in enumerate(texts)] + [(2, 0, None, "hi", ""), (2, 0, None, "hi", ""), (3, None, "assistant", "a", ""), (None, 1, "user", "n", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chats(df)
    got = {r.conv_id: r for r in out.withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert [(b.role, b.text) for b in got[1].back] == [("user" if i % 3 else "assistant", t or "") for i, t in enumerate(texts)]
    assert got[1].loss == "".join((t or "") for i, t in enumerate(texts) if i % 3 == 0)
    assert [(b.role, b.text) for b in got[2].back] == [("", "hi")] * 2 and got[2].loss == "" and got[2].n_turns == 2
    assert got[1].formatted.count(chat.OPEN) == 6  # two pairs of user turns merged
    assert set(got) == {1, 2, 3, None}
    assert chat.format_chats(df.limit(0)).count() == 0


# -- language -----------------------------------------------------------------


def test_chat_of_many_turns(spark):
    said = [(1, i, ("user", "assistant", "assistant")[i % 3] if i % 50 else None, f"t{i} <turn> \\") for i in range(3000)]
    out = chat.format_chats(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"))
    got = out.select("n_turns", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert got.n_turns == 3000 and [(x.role, x.text) for x in got.back] == [(r or "", t) for _, _, r, t in said]
    assert got.loss == "".join(t for _, _, r, t in said if r == "assistant")


def test_language_held_out(spark):
    words = {"en": "the and of that with from have this they which".split(), "de": "der und das nicht mit auch sich werden eine über".split()}
    r = np.random.default_rng(1)
    texts, langs = [], {}
    for i in range(120):
        lang = ("en", "de")[i % 2]
        langs[i] = lang
        texts.append(" ".join(r.choice(words[lang], 30)))
    texts += [None, "123 !!", "", "12"]
    docs = docs_of(spark, texts, langs)
    samples = langid.sample(docs.where("doc_id < 60"), texts=20, chars=200)
    assert sorted(samples) == ["de", "en"] and all(len(s) <= 20 * 210 for s in samples.values())
    got = {x.doc_id: x for x in langid.identify(docs, samples).collect()}
    assert all(got[i].lang_pred == langs[i] for i in range(60, 120))
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in range(120, 124))
    assert all(0 <= x.score <= 1 for x in got.values())
    assert {x.lang_pred for x in langid.identify(docs, {}).collect()} == {"und"}
    assert langid.identify(docs.limit(0), samples).count() == 0


def phrases(train, text):
    at = n = 0
    while at < len(text):
        size = 0
        while at + size < len(text) and text[at : at + size + 1] in train:
            size += 1
        at += max(size, 1)
        n += 1
    return n


def test_parse_matches_brute_force():
    r = np.random.default_rng(4)
    trains = {"x": b"abracadabra abra", "y": bytes(r.choice(list(b"abcd "), 300).tolist()), "z": b"ab" * 40}
    texts = [b"abra cad zabra bra", b"", b"q", bytes(r.choice(list(b"abcdr "), 10_000).tolist()), b"ab" * 3000, b"abc" * 200, b"a" * 256, b"a" * 257, bytes(r.choice(list(b"abx"), 511).tolist()), bytes(r.choice(list(b"abx"), 513).tolist())]
    m = langid.Models(trains)
    got = m.phrases(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert got.tolist() == [[phrases(trains[n], t) for n in m.names] for t in texts]


def test_every_language_is_learned(spark, monkeypatch):
    r = np.random.default_rng(5)
    letters = [chr(c) for c in range(97, 123)]
    words = {f"l{i:02d}": ["".join(r.choice(letters, 6)) for _ in range(8)] for i in range(70)}
    texts, langs = [], {}
    for i in range(280):
        langs[i] = f"l{i % 70:02d}"
        texts.append(" ".join(r.choice(words[langs[i]], 20)))
    docs = docs_of(spark, texts, langs)
    samples = langid.sample(docs.where("doc_id < 210").union(docs.where("doc_id < 70")))
    assert len(samples) == 70
    got = {x.doc_id: x.lang_pred for x in langid.identify(docs, samples).collect()}
    assert all(got[i] == langs[i] for i in range(210, 280))
    monkeypatch.setattr(langid, "GROUP", 200)
    assert {x.doc_id: x.lang_pred for x in langid.identify(docs, samples).collect()} == got


# -- mixing -------------------------------------------------------------------


def earliest_deadlines(sizes, weights, block):
    """(source, job): (release, deadline, slot), one slot after the other."""
    total, jobs = sum(weights.values()), []
    for s, n in sizes.items():
        jobs += [((j - 1) * total // weights[s], -(-j * total // weights[s]), -weights[s], s, j) for j in range(1, -(-n // block) + 1)]
    jobs.sort()
    ready, out, t, i = [], {}, 0, 0
    while ready or i < len(jobs):
        while i < len(jobs) and jobs[i][0] <= t:
            heapq.heappush(ready, (*jobs[i][1:], jobs[i][0]))
            i += 1
        if ready:
            d, _, s, j, r = heapq.heappop(ready)
            out[s, j] = (r, d, t)
        t += 1
    return out


MANY = {f"s{i:04d}": 9 + (i * 7919) % 40 for i in range(3000)}


@pytest.mark.parametrize(
    "sizes, weights",
    [
        ({"a": 400, "b": 300, "c": 100}, None),
        ({"a": 4000, "b": 8000}, {"a": 1, "b": 2}),
        ({"a": 900, "b": 500, "c": 333}, {"a": 0.5, "b": 0.3, "c": 0.2}),
        ({"big": 25_000} | {f"s{i}": 40 for i in range(500)}, {"big": 500} | {f"s{i}": 1 for i in range(500)}),
        (MANY, None),
    ],
)
def test_schedule_is_earliest_deadline_first(spark, sizes, weights):
    block = 4
    n = spark.createDataFrame(list(sizes.items()), "src string, n long")
    w = mixing.weighted(n, weights)
    exact = {r.src: r.w for r in w.collect()}
    got = {(r.src, r.job): (r.release, r.deadline, r.slot) for r in mixing.schedule(w, block, 64).collect()}
    assert got == earliest_deadlines(sizes, exact, block)
    total, slots = sum(exact.values()), sorted((slot, s) for (s, _), (_, _, slot) in got.items())
    ends = {}
    for slot, s in slots:
        ends[s] = slot
    seen = Counter()
    for t, (slot, s) in enumerate(slots[: min(ends.values())], 1):  # until the first source runs out
        assert slot == t - 1
        seen[s] += 1
        for x in exact if len(exact) < 10 or t % 97 == 0 else (s,):
            assert abs(seen[x] * total - t * exact[x]) < total  # less than one block


def test_schedule_over_many_stretches(spark, monkeypatch):
    """Sums in stretches of three windows, lists of five: nothing changes."""
    monkeypatch.setattr(mixing, "STRETCH", 3)
    monkeypatch.setattr(mixing, "LISTED", 5)
    sizes = {"a": 900, "b": 500, "c": 333} | {f"s{i}": 9 + i % 5 for i in range(40)}
    w = mixing.weighted(spark.createDataFrame(list(sizes.items()), "src string, n long"))
    got = {(r.src, r.job): (r.release, r.deadline, r.slot) for r in mixing.schedule(w, 4, 16).collect()}
    assert got == earliest_deadlines(sizes, {r.src: r.w for r in w.collect()}, 4)


def test_mix_is_the_same_with_finer_ranges(spark, monkeypatch):
    docs = docs_of(spark, ["t"] * 300, sources={i: "ab"[i % 3 == 0] for i in range(300)})
    want = sorted(mixing.mix(docs, block=4).collect())
    monkeypatch.setattr(mixing, "HEX_DIGITS", 1)
    monkeypatch.setattr(mixing, "RANGE", 4)
    assert sorted(mixing.mix(docs, block=4).collect()) == want


def test_mix_deals_blocks(spark):
    sources = {i: "a" if i < 400 else "b" if i < 700 else "c" for i in range(800)}
    docs = docs_of(spark, ["t"] * 800, sources=sources)
    rows = sorted(mixing.mix(docs, {"a": 0.5, "b": 0.3, "c": 0.2}, block=4).collect(), key=lambda r: r.mix_rank)
    assert sorted(r.doc_id for r in rows) == list(range(800)) and len({r.mix_rank for r in rows}) == 800
    w = mixing.weighted(spark.createDataFrame([("a", 400), ("b", 300), ("c", 100)], "src string, n long"), {"a": 0.5, "b": 0.3, "c": 0.2})
    want = earliest_deadlines(Counter(sources.values()), {r.src: r.w for r in w.collect()}, 4)
    assert all(want[r.source, r.mix_block + 1] == (r.mix_release, r.mix_deadline, r.mix_slot) for r in rows)
    assert Counter((r.source, r.mix_block) for r in rows) == Counter((s, j - 1) for s, j in want for _ in range(4))


def test_mix_odd_rows(spark):
    rows = [(1, "x", "en", None, 1, "", ""), (1, "x", "en", None, 1, "", ""), (2, None, None, "b", None, "", ""), (None, "", "", "b", 0, "", "")]
    out = mixing.mix(spark.createDataFrame(rows, DOCS))
    assert out.count() == 4 and out.columns[:7] == [c.split()[0] for c in DOCS.split(", ")]
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    ordered = mixing.in_order(mixing.mix(spark.createDataFrame(rows, DOCS)), 2).collect()
    assert [r.mix_rank for r in ordered] == sorted(r.mix_rank for r in ordered)


# -- BPE ----------------------------------------------------------------------


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    r = np.random.default_rng(2)
    texts = [*ODD, "aaaaaaaa aaa", "it's we'll   x", "a<|endoftext|>b <|endoftext|>", "é" * 300, "!" * 1000, "ab" * 500] + ["".join(r.choice(list("ab etn\n 'sé1"), 80)) for _ in range(200)]
    got = {x.doc_id: x for x in bpe.encode(docs_of(spark, texts), vocabulary()).collect()}
    for i, s in enumerate(texts):
        ids = t.encode(s or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].text == t.decode(ids, skip_special_tokens=False)


def test_bpe_pairs():
    c = bpe.Codec(open(vocabulary(), encoding="utf-8").read())
    r = np.random.default_rng(3)
    words = [w for w in c.id_of if 2 <= len(w) <= 6]
    pick = [words[i] for i in r.integers(0, len(words), 3000)]
    a, b = np.array([c.id_of[w] for w in pick[::2]]), np.array([c.id_of[w] for w in pick[1::2]])
    flat, sizes = c.exact([x + y for x, y in zip(pick[::2], pick[1::2])])
    merged = np.split(flat, np.cumsum(sizes)[:-1])
    want = [t.tolist() == [c.id_of[x], c.id_of[y]] for t, x, y in zip(merged, pick[::2], pick[1::2])]
    assert c.compatible(a, b).tolist() == want
    c.encode(["the quick brown fox " + "xyzzyq"])
    assert c.verified > 0


def test_bpe_words_are_the_pattern():
    split = regex.compile(r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""").findall
    r = np.random.default_rng(8)
    texts = ["".join(r.choice(list("  \n\t\x1c\x85\x27\x27sdmtlevrAé٣1!.　 "), int(r.integers(1, 30)))) for _ in range(20_000)]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    starts = bpe.word_starts(points, np.cumsum([0, *map(len, texts)]))
    want = np.cumsum([0, *(len(w) for t in texts for w in split(t))])[:-1]
    assert starts.tolist() == want.tolist()


def test_bpe_long_words_and_hash_collisions(monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    r = np.random.default_rng(9)
    texts = ["".join(r.choice(list("aeinst"), 20_000)), "x" * 5001, "", *("".join(r.choice(list("aeinst "), 500)) for _ in range(60))]
    c = bpe.Codec(open(vocabulary(), encoding="utf-8").read())
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in c.encode(texts)] == want
    narrow = bpe.word_hashes
    monkeypatch.setattr(bpe, "word_hashes", lambda *a: narrow(*a) & np.uint64(255))
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    for _ in range(3):
        assert [x.tolist() for x in c.encode(texts)] == want


# -- personal data ------------------------------------------------------------


def base(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_pii_base_rules():
    r = np.random.default_rng(4)
    texts = ["a@b@c.d x.y@z..w q@r.s@t.u", "1.2.3.4.5.6.7.8 0001.2.3.4 300.1.1.1 1.2.3", "0" * 4000 + "7.0.00.255 " + "8" * 50 + ".1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (555) 123-4567 ++49 30 1234567-"]
    texts += ["".join(r.choice(list("ab@.1234567890+- ()é"), 120)) for _ in range(3000)]
    for t in texts:
        assert [s for s in pii.find(t) if s[0] in ("email", "ip", "card", "phone")] == base(t), t


def test_pii_very_long_digits():
    zeros = "0" * 9000  # longer than int() reads
    assert pii.find(f"{zeros}.1.2.3") == [("ip", 0, 9006)] and pii.find(f"{zeros}9999.1.2.3") == []


def test_pii_added_and_redacted(spark):
    texts = [*ODD, "IBAN: DE89370400440532013000 and mail x.y@z.org", 'token = "24be64439e3e49cf46b2d7c90f3602a3"', "ftp://me:secret@host/x"]
    docs = docs_of(spark, texts)
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.pii_spans(docs).collect()}
    assert [k for k, *_ in spans[8]] == ["email", "account"] and spans[9][0][0] == "secret" and spans[10][0][0] == "login"
    out = {r.doc_id: r for r in pii.redact_documents(docs).collect()}
    assert out[8].text == "IBAN: [ACCOUNT] and mail [EMAIL]" and out[8].n_chars == len(out[8].text)
    assert out[0].text is None and out[4].text == ODD[4]
    assert pii.redact_documents(docs).columns == docs.columns


# -- quality ------------------------------------------------------------------


def test_binomial_is_exact(spark):
    from math import comb

    cases = [(k, n, p) for n in (1, 5, 40, 300) for k in (0, 1, 3, n // 50) for p in (0.002, 0.05) if k <= n]
    for k, n, p in cases:
        got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("x")).first().x
        want = 1.0 if k >= n * p else sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert got == pytest.approx(want, rel=1e-7, abs=1e-12), (k, n, p)


@pytest.mark.parametrize("n,k,p", [(400_000, 3_800, 0.01), (30_000_000, 298_500, 0.01), (2_000_000, 99_000, 0.05)])
def test_binomial_of_many_labels(spark, n, k, p):
    from math import exp, lgamma, log

    first = lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p)
    total, term = 0.0, 1.0
    for i in range(k + 1):  # every term
        total += term
        term *= (k - i) / (n - k + i + 1) * (1 - p) / p
    got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("x")).first().x
    assert 0 < got < 1 and got == pytest.approx(exp(first) * total, rel=1e-5)


def test_quality_counts(spark):
    lines = "good line of words here\n\n good\ngood line of words here\ngood line of words here\n ## $$"
    texts = [*ODD, lines, "alpha beta gamma delta epsilon zeta eta theta " * 4, " ".join(str(i) for i in range(40))]
    got = {r.doc_id: r for r in quality.quality_rules(docs_of(spark, texts), spark.createDataFrame([], "doc_id long, quality int")).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        win = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        n = Counter(win)
        cov = {k + j for k, x in enumerate(win) if n[x] > 1 for j in range(8)}
        ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(cov))
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (len(w) < 20 or 100 * len(cov) > 30 * len(w)) and g.kept == (not g.base_failed)


def test_quality_thresholds(spark):
    plain = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(2000)]
    junk = [" ".join(f"w{i}##{j}" for j in range(30)) for i in range(50)]
    docs = docs_of(spark, plain + junk)
    labels = spark.createDataFrame([(i, 1) for i in range(2000)] + [(2000 + i, 0) for i in range(25)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_rules(docs, labels, alpha=0.05).collect()}
    assert all(got[i].kept for i in range(2000)) and not any(got[2000 + i].kept for i in range(50))
    assert all("symbol_share" in got[2000 + i].rejected_by for i in range(50))
    kept = quality.filter_quality(docs, labels, alpha=0.05)
    assert kept.columns == docs.columns and kept.count() == 2000


def test_quality_levels_hold_all_rules_together(spark):
    from math import comb

    rng, n, alpha, delta = np.random.default_rng(3), 1500, 0.05, 0.05
    values = {"x": rng.random(n) ** 6, "y": rng.random(n) ** 9}
    cutoffs = {"x": (0.99, 0.95, 0.9, 0.8, 0.6), "y": (0.95, 0.7)}
    steps = quality.levels(cutoffs)
    assert [s["y"] for s in steps] == [0.95, 0.95, 0.95, 0.7, 0.7]
    strata = ["a" if i < 1000 else "b" for i in range(n)]
    rows = [(i, strata[i], 30, 0, float(values["x"][i]), float(values["y"][i])) for i in range(n)]
    measured = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, n_repeat_words long, x double, y double")
    labels = spark.createDataFrame([(i, 1) for i in range(n)] + [(5, 1)], "doc_id long, quality int")
    want = set()
    for lang in "ab":
        at = np.array([s == lang for s in strata])
        chosen = None
        for step in steps:
            k = int((at & ((values["x"] > step["x"]) | (values["y"] > step["y"]))).sum())
            m = int(at.sum())
            if k >= m * alpha or sum(comb(m, i) * alpha**i * (1 - alpha) ** (m - i) for i in range(k + 1)) > delta / 2:
                break
            chosen = step, k
        if chosen:
            want |= {(lang, r, c, int(at.sum()), chosen[1]) for r, c in chosen[0].items()}
    assert want
    got = quality.thresholds(measured, labels, alpha, delta, cutoffs).collect()
    assert {(r.stratum, r.rule, r.cutoff, r.n_good, r.n_rejected) for r in got} == want


# -- near-duplicates ----------------------------------------------------------


def brute_components(texts, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    p = list(range(len(texts)))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                p[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_near_duplicates(spark):
    r = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in r.integers(0, 5000, n)]
    texts = list(ODD)
    for _ in range(12):  # groups around a centre, whose members are often apart from each other
        centre = word(120)
        for _ in range(25):
            c = list(centre)
            for at in r.integers(0, 120, r.integers(0, 5)):
                c[at] = f"n{r.integers(0, 10**6)}"
            texts.append(" ".join(c))
    texts += [" ".join(word(60)) for _ in range(60)] + ["few words", "FEW words", "few  words", "other words"]
    order = r.permutation(len(texts))
    texts = [texts[i] for i in order]
    want = brute_components(texts, 85)
    got = {x.doc_id: x for x in minhash.near_duplicates(docs_of(spark, texts), 85).collect()}
    assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == want
    assert all(x.kept == (x.component_id == i) for i, x in got.items())
    kept = minhash.drop_near_duplicates(docs_of(spark, texts), percent=85)
    assert {x.doc_id for x in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_near_duplicates_odd_rows(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "same words in a row here", "", "", 1, "", ""), (1, "same words in a row here", "", "", 1, "", ""), (None, "same words in a row here", "", "", 1, "", ""), (5, "same words in a row here", "", "", 1, "", "")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((x.doc_id or 0, x.component_id or 0, x.kept) for x in got) == [(0, 0, True), (1, 1, True), (1, 1, True), (5, 1, False)]


def test_tiles_find_all_links(spark):
    texts = [" ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(1, 61)), " ".join(f"x{i}" for i in range(60))]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    members = spark.createDataFrame([(9, i, i, 3) for i in range(3)], "bucket long, rep long, label long, n long")
    assert [tuple(sorted((x.a, x.b))) for x in minhash.confirm_tiles(members, frame, 85).collect()] == [(0, 1)]


def test_circulant():
    s = np.unique(np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64))
    t = np.concatenate([s[:400], np.random.default_rng(2).integers(0, 2**63, 100, dtype=np.uint64)])
    a, b = minhash.signature(s, 400), minhash.signature(t, 400)
    assert abs((a == b).mean() - 400 / 600) < 0.12
    assert hashlib.sha256(a.tobytes()).digest() == hashlib.sha256(minhash.signature(s[::-1], 400).tobytes()).digest()
