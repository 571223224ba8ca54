"""The pipeline as a whole against brute force, over odd rows and empty tables."""

import hashlib
import re

import numpy as np

import corpus_pipeline
from isohyet.llm import bpe, pii, quality
from isohyet.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, mix_slot string"
LABELS = "doc_id long, quality int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def passes(text):
    """The base rules; with so few labels no other rule may reject anything."""
    w = words(text)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    repeated = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    return len(w) >= 20 and 100 * len(repeated) <= 30 * len(w)


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def survivors(texts):
    """The smallest of each group of linked texts."""
    sets, least = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    links = [(i, j) for i in texts for j in texts if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    return [i for i in texts if least[i] == i]


def write(spark, folder, docs, labels):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_against_brute_force(spark, tmp_path):
    r = np.random.default_rng(8)
    fresh = lambda n: " ".join(f"w{x}" for x in r.integers(0, 9000, n))
    texts = [fresh(60) for _ in range(30)]
    texts += [texts[3], texts[3].upper(), texts[4] + " tail", texts[5].replace(" ", "\n"), None, "", " \t", "too few words", "one two three four five six seven eight " * 5, "w " * 40]
    texts += [f"{fresh(30)} write to someone.{i}@mail.example.org or +49 30 1234567 {fresh(10)}" for i in range(6)]
    texts += [fresh(6000)]
    docs = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None, "a")[i % 4], len(t or ""), "x", "y") for i, t in enumerate(texts)]
    got = corpus_pipeline.run(spark, write(spark, tmp_path, docs, [(i, i % 2) for i in range(20)])).collect()
    kept = survivors({i: t for i, t in enumerate(texts) if passes(t)})
    mails = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    clean = {i: re.sub(r"\+49 30 1234567", "[PHONE]", mails.sub("[EMAIL]", texts[i])) for i in kept}
    assert len(kept) == 37 and {x.doc_id for x in got} == set(kept) and len(got) == len(kept)
    assert {x.doc_id: x.decoded_sha256 for x in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in clean.items()}
    assert all(x.n_tokens == len(x.ids) for x in got)
    assert [x.mix_rank for x in got] == sorted({x.mix_rank for x in got})


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path, [], [])).count() == 0


def test_operators_on_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert bpe.encode_digests(docs, vocabulary()).count() == 0
    assert pii.pii_spans(docs).count() == pii.redact_documents(docs).count() == 0
    assert quality.quality_rules(docs, spark.createDataFrame([], LABELS)).count() == 0
