"""Ranked lexical search: postings scored window by window.

A task numbers its documents by doc_id and goes through them in windows of WINDOW. In a
window it adds the postings of an item's terms into one array of scores that stays in the
cache, marks the buckets it has touched, takes the scores from just these and keeps the
best of them in the item's heap. Tasks hand on their heaps; a window over items picks the
best of all."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohyet.llm.common import table
from isohyet.shipping import map_arrow

#: Documents of a window and of a bucket in it.
WINDOW, BUCKET = 16384, 64
#: Bytes of the items of a block, for which the documents are read once.
BLOCK = 16 << 20
#: Postings that a task holds at once.
HELD = 4 << 20

_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")  # of UTF-8, where all others are separators


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text: runs of digits, letters and all that is not ASCII; only A-Z in
    lower case."""
    return _TERM.findall(text.lower()) if text else []


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms), and of the terms in the vocabulary their numbers and how often
    they occur, 32-bit numbers in binaries; of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of one block of items

    def run(batches):
        known = shared.value
        for b in batches:
            n, ids, tfs = [], [], []
            for text in b.column(1).cast(pa.large_binary()).to_pylist():
                counts = Counter(terms(text))
                hit = [(known[t], c) for t, c in counts.items() if t in known]
                n.append(counts.total())
                ids.append(np.array([i for i, _ in hit], np.uint32).tobytes())
                tfs.append(np.array([c for _, c in hit], np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(tfs, pa.binary())], ["doc_id", "n", "terms", "tf"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(rows, run, "doc_id long, n long, terms binary, tf binary")


def _holding(postings: DataFrame, size: int) -> np.ndarray:
    """Of each term the number of documents that hold it."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint32), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["term", "df"])

    out = np.zeros(size, np.int64)
    for r in map_arrow(postings.select("terms"), run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # terms of one block
        out[r["term"]] = r["df"]
    return out


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of documents of n terms; all whole numbers, rounded down."""
    if len(n) and 75 * int(n.max()) * documents >= 2**63:
        return 25 + np.array([75 * int(x) * documents // total for x in n], np.int64)
    return 25 + 75 * n * documents // total


class Heaps:
    """Of each item its k best (score, -doc_id)."""

    def __init__(self, items: int, k: int):
        self.k, self.best = k, [[] for _ in range(items)]

    def offer(self, item: int, score: np.ndarray, doc: np.ndarray) -> None:
        heap = self.best[item]
        if len(heap) == self.k:
            better = score >= heap[0][0]
            score, doc = score[better], doc[better]
        if len(score) > self.k:
            top = np.lexsort((doc, -score))[: self.k]
            score, doc = score[top], doc[top]
        for s, d in zip(score.tolist(), doc.tolist(), strict=True):
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -d))
            elif (s, -d) > heap[0]:
                heapq.heapreplace(heap, (s, -d))


def score_windows(doc: np.ndarray, m: np.ndarray, first: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, items: list[tuple[np.ndarray, np.ndarray]], heaps: Heaps) -> None:
    """Score documents (by doc_id; of document i the postings from first[i] to
    first[i + 1]) for all items (their terms and how often each), window by window."""
    scores = np.zeros(WINDOW, np.int64)
    marks = np.zeros(WINDOW // BUCKET, bool)
    buckets = scores.reshape(-1, BUCKET)
    for base in range(0, len(doc), WINDOW):
        last = min(base + WINDOW, len(doc))
        a, z = first[base], first[last]
        slot = np.repeat(np.arange(last - base), np.diff(first[base : last + 1]))
        order = np.argsort(term[a:z], kind="stable")
        t, slot, f = term[a:z][order], slot[order], tf[a:z][order].astype(np.int64)
        part = weights[t] * (1_000_000_000 * f // (1000 * f + 8 * m[base + slot]))
        there, at = np.unique(t, return_index=True)
        where = dict(zip(there.tolist(), zip(at.tolist(), np.append(at, len(t))[1:].tolist(), strict=True), strict=True))
        for i, (ids, times) in enumerate(items):
            for x, r in zip(ids, times, strict=True):
                if span := where.get(x):
                    to = slot[span[0] : span[1]]  # each document once
                    scores[to] += part[span[0] : span[1]] if r == 1 else r * part[span[0] : span[1]]
                    marks[to // BUCKET] = True
            hit = np.flatnonzero(marks)
            if len(hit):
                found = buckets[hit]
                row, column = np.nonzero(found > 0)
                heaps.offer(i, found[row, column], doc[base + hit[row] * BUCKET + column])
                buckets[hit] = 0
                marks[hit] = False


def search(docs: DataFrame, items: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id and score: of each item (item_id, text) the k documents with
    the highest scores above 0, equal scores by doc_id.

    A document's score is the sum over the item's terms, repeats included, of the term's
    weight floor(1000 ln((2N + 2) / (2df + 1))) times (10^9 tf) div (1000 tf + 8m), m = 25 +
    (75 n N) div L; N documents have terms, L in all, n in this one; df documents hold the
    term, this one tf times.

    Items are taken in blocks by their bytes; for each block the documents are read once.
    Null or empty texts have no terms: such items have no rows. Documents without terms
    count for nothing; those with a null doc_id count in N, L and df, but are not ranked.
    Repeated rows are documents, or items, of their own. Other columns are ignored."""
    spark = docs.sparkSession
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block))
    asked = table(items.select(F.col("item_id").alias("item_id"), F.col("text").alias("text"), F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int").alias("part")), "items")
    kind = items.schema["item_id"].dataType.simpleString()
    out = None
    for i in range(blocks):
        found = _search_block(docs, [tuple(r) for r in asked.where(F.col("part") == i).select("item_id", "text").collect()], kind, k)  # about BLOCK bytes
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


def _search_block(docs: DataFrame, items: list[tuple], kind: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    asked = []
    for _, text in items:
        counts = Counter(terms(text.encode() if text else None))
        asked.append(([vocabulary.setdefault(t, len(vocabulary)) for t in counts], list(counts.values())))
    postings = table(_postings(docs, vocabulary), "postings")
    n = postings.agg(F.count(F.when(F.col("n") > 0, 1)).alias("n"), F.sum("n").alias("l")).first()
    documents, total = n["n"], n["l"] or 1
    df = _holding(postings, len(vocabulary))
    weights = np.array([weight(documents, int(x)) for x in df], np.int64)
    shared = spark.sparkContext.broadcast((weights, asked))  # of one block of items

    def run(batches):
        weights, asked = shared.value
        heaps, held, count = Heaps(len(asked), k), [], 0

        def flush():
            if not held:
                return
            doc, n = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            sizes = np.concatenate([h[2] for h in held])
            term, tf = (np.frombuffer(b"".join(h[i] for h in held), np.uint32) for i in (3, 4))
            order = np.argsort(doc, kind="stable")
            first = np.cumsum(sizes) - sizes
            sizes = sizes[order]
            begin = np.append(0, np.cumsum(sizes))
            at = np.repeat(first[order] - begin[:-1], sizes) + np.arange(len(term))
            score_windows(doc[order], lengths(n[order], documents, total), begin, term[at], tf[at], weights, asked, heaps)
            held.clear()

        for b in batches:
            ids, tfs = b.column(2).to_pylist(), b.column(3).to_pylist()
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), sizes, b"".join(ids), b"".join(tfs)))
            count += int(sizes.sum())
            if count >= HELD:
                flush()
                count = 0
        flush()
        rows = [(i, s, -d) for i, heap in enumerate(heaps.best) for s, d in heap]
        item, score, doc = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(score, pa.int64()), pa.array(doc, pa.int64())], ["item", "score", "doc_id"])

    best = map_arrow(postings.where("doc_id is not null and octet_length(terms) > 0"), run, "item int, score long, doc_id long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(items)], f"item int, item_id {kind}")
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
