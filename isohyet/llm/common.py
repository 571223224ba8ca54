"""Shared pieces: tables in the cluster's shared folder, checked broadcasts,
connected components and vectorised words, shingles and Arrow helpers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.tables import release, shared_dir, table  # noqa: F401

#: Rows of one bigint that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else as it is:
    Spark then joins it by a shuffle. df should be cheap to count (a table)."""
    return F.broadcast(df) if df.count() <= rows else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over the links a-b.

    Rounds of: every node takes the least label among its neighbours' labels and
    its own, then the label of its label. Each round is two equi-joins and a sum
    by key, so no node's links ever meet in one task; links inside one component
    are dropped as soon as both ends agree. Every round leaves fewer labels, and rounds
    go on until no link is left. No row for nodes without links."""
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    e = table(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    parent = None
    while not e.isEmpty():
        # every node hooks to its least neighbour (or stays), then paths are halved
        both = e.select(F.col("a").alias("node"), F.col("b").alias("up")).unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("up")))
        step = both.groupBy("node").agg(F.min("up").alias("up")).select("node", F.least("node", "up").alias("up"))
        step = table(step, "step")
        for _ in range(2):
            up = step.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
            step = step.join(up, F.col("up") == F.col("_n"), "left").select("node", F.coalesce("_u", "up").alias("up"))
        step = table(step, "jump")
        if parent is None:
            parent = step
        else:
            s = step.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
            parent = table(parent.join(s, F.col("up") == F.col("_n"), "left").select("node", F.coalesce("_u", "up").alias("up")), "parent")
        sa, sb = step.toDF("a", "ua"), step.toDF("b", "ub")
        e = e.join(sa, "a", "left").join(sb, "b", "left").select(F.coalesce("ua", "a").alias("a"), F.coalesce("ub", "b").alias("b")).where("a <> b")
        e = table(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if parent is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return parent.select("node", F.col("up").alias("component"))


# -- Arrow and numpy ---------------------------------------------------------

#: Longer words are hashed by themselves.
LONG = 256
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers, as random as the generator."""
    return np.random.PCG64([20240917, seed]).random_raw(n) | np.uint64(1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and the offsets (one
    more than texts); a null counts as an empty text."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each hold about so many bytes; a
    longer text comes alone."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of all texts, and of which
    text each is; words never go on from one text to the next."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SEPARATOR[data]
    edge = np.empty(len(data) + 1, bool)
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[0], edge[-1] = inside[0], inside[-1]
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    cut = cut[inside[cut] & inside[cut - 1]]
    at = np.flatnonzero(edge)
    if len(cut):  # a text that ends in a word before one that starts with a word
        at = np.sort(np.concatenate([at, cut, cut]))
    starts, ends = at[::2], at[1::2]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes: eight at a time are mixed into it, so what
    comes later in a word never cancels what came before; words longer than LONG are
    hashed whole. Another seed gives another hash."""
    size = ends - starts
    out = mix(size.astype(np.uint64) + multipliers(1, seed)[0])
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    at = np.flatnonzero(size <= LONG)
    done = 0
    while len(at):
        left = size[at] - done
        v = eight[starts[at] + done]
        short = left < 8
        v[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[at] = mix((out[at] ^ v) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        done += 8
        at = at[left > 8]
    for i in np.flatnonzero(size > LONG):
        whole = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        out[i] = np.frombuffer(whole, "<u8")[0]
    return out


def shingles(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each n consecutive words, by its first word: each place has a multiplier of
    its own, so no pattern of words cancels out."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out, m = np.zeros(len(hashes) - n + 1, np.uint64), len(hashes) - n + 1
    for k, r in enumerate(multipliers(n, seed + 1)):
        out += hashes[k : k + m] * r
    return mix(out)


def long_bytes(parts: list[np.ndarray]) -> pa.Array:
    """A binary column of the arrays' bytes."""
    return pa.array([np.ascontiguousarray(p).tobytes() for p in parts], pa.binary())


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each run of equal values in the first `keys` columns (numbers
    without nulls); the rows must come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1), b.num_rows]
        for at, to in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(k[:, at])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(at, to - at))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def with_texts(docs: DataFrame, info: DataFrame) -> DataFrame:
    """doc_id, text and the columns of info (a table by doc_id) for the documents in
    info. While the ids are few enough to be broadcast, only their texts are shuffled."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = info.select("doc_id")
    if ids.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(ids), "doc_id", "left_semi")
    return rows.join(info.hint("shuffle_merge"), "doc_id")
