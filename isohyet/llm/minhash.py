"""Near-duplicates: circulant MinHash, banding, links confirmed on whole sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import components, mix, pieces, shingles, small, table, text_bytes, word_hashes, words
from isohyet.shipping import map_arrow

WORDS = 5
BANDS, ROWS = 20, 5  # a pair at 0.85 is missed with probability (1 - 0.85 ** 5) ** 20 = 8e-6, at 0.8 3.5e-4
#: Documents of one side of a tile of pairs.
TILE = 128

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation, of all 32-bit numbers; works in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def text_sets(texts: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """Of each text the sorted set of its shingles' hashes: n consecutive words, or
    all words if there are fewer, A-Z in lower case; empty without words."""
    data, offsets = text_bytes(texts)
    data = _LOWER[data]
    starts, ends, owner = words(data, offsets)
    h = word_hashes(data, starts, ends)
    whole = shingles(h, n)
    at = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= n:
            s = np.sort(whole[a : b - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(shingles(h[a:b], b - a) ^ np.uint64(b - a) if b > a else np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray, k: int) -> np.ndarray:
    """The k circulant coordinates of a set that is not empty: the first permutation
    puts the elements on a circle of 2 ** 32 places; coordinate i is the least of the
    second one, shifted by i places."""
    place, shift = (mix(s + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32), np.arange(k, dtype=np.uint32)
    return np.min([_second(place[i : i + 1024, None] + shift).min(0) for i in range(0, len(place), 1024)], 0)


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set (f1, f2) and the hashes
    of its bands, for every row of docs."""

    def run(batches):
        tag = np.arange(bands, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)
        for b in pieces(batches):
            n, f1, f2, out = [], [], [], []
            for s in text_sets(b.column(1)):
                n.append(len(s))
                m = mix(s + np.uint64(1))
                f1.append(int(m.sum(dtype=np.uint64).view(np.int64)))
                f2.append(int(np.bitwise_xor.reduce(mix(m)).view(np.int64)) if len(s) else 0)
                if len(s):
                    sig, h = signature(s, bands * rows).astype(np.uint64).reshape(bands, rows), tag.copy()
                    for j in range(rows):
                        h = mix(h + sig[:, j])
                    out.append(h.view(np.int64))
                else:
                    out.append(np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "f1", "f2", "bands"])

    kept = docs.select("doc_id", "text")
    return map_arrow(kept, run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_shingles long, f1 long, f2 long, bands array<bigint>")


def _linked(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def _texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """The texts of some documents; only theirs are shuffled later. Of rows with one
    doc_id, one."""
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(small(ids), "id", "left_semi")
    return table(rows, "texts").dropDuplicates(["id"])


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose sets are that similar. Pairs of one a are
    dealt in lots of about 64, each with a copy of a's text; a task reads its rows
    in order and holds one set of a at a time."""
    n = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    lots = table(pairs.join(n, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / 64)).cast("int").alias("lot")), "lots")
    own = lots.select("a", "lot").distinct().join(texts, F.col("a") == F.col("id")).select("a", "lot", F.lit(0).alias("side"), "id", "text")
    other = lots.join(texts, F.col("b") == F.col("id")).select("a", "lot", F.lit(1).alias("side"), "id", "text")

    def run(batches):
        key, held = None, None
        for b in pieces(batches):
            a, lot, side, ids = (b.column(i).to_pylist() for i in range(4))
            out = []
            for i, s in enumerate(text_sets(b.column(4))):
                if side[i] == 0:
                    key, held = (a[i], lot[i]), s
                elif key == (a[i], lot[i]):
                    both = len(np.intersect1d(held, s, assume_unique=True))
                    if _linked(len(held), len(s), both, percent):
                        out.append((a[i], ids[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], b.schema.field(0).type), pa.array([x[1] for x in out], b.schema.field(3).type)], ["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return map_arrow(own.unionByName(other).repartition("a", "lot").sortWithinPartitions("a", "lot", "side"), run, f"a {kind}, b {kind}")


def confirm_tiles(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links between members (bucket, rep, label, n) of one bucket with different labels:
    every such pair is tested. A bucket of n is cut in blocks of TILE; a task takes a
    pair of blocks and returns no more links than join what it found apart."""
    ranked = members.withColumn("nb", F.ceil(F.col("n") / TILE).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    mates = F.sequence(F.lit(0), F.col("nb") - 1)
    rows = ranked.select("bucket", "rep", "label", "block", F.explode(mates).alias("mate")).select("bucket", F.least("block", "mate").alias("i"), F.greatest("block", "mate").alias("j"), (F.col("block") > F.col("mate")).cast("int").alias("side"), "rep", "label")
    rows = rows.join(texts, F.col("rep") == F.col("id")).drop("id").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side", "rep")

    def run(batches):
        tile: list[tuple] = []
        key = None

        def links():
            parent = {r: r for *_, r, _, _ in tile}

            def find(x):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            left = [t for t in tile if t[0] == 0]
            right = [t for t in tile if t[0] == 1] if key[1] != key[2] else left
            flat = np.concatenate([t[3] for t in left]) if left else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(left)), [len(t[3]) for t in left])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for _, rep, label, s in right:
                lo, hi = np.searchsorted(flat, s), np.searchsorted(flat, s, "right")
                hits = np.concatenate([[0], np.cumsum(hi - lo)])
                where = np.arange(hits[-1]) + np.repeat(lo - hits[:-1], hi - lo)
                both = np.bincount(owner[where], minlength=len(left))
                for i in np.flatnonzero(both):
                    _, r, other, t = left[i]
                    if other != label and _linked(len(s), len(t), int(both[i]), percent) and find(r) != find(rep):
                        parent[find(r)] = find(rep)
                        yield r, rep

        def batch(found, schema):
            kind = schema.field(4).type
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], kind), pa.array([x[1] for x in found], kind)], ["a", "b"])

        schema = None
        for b in pieces(batches):
            schema, found = b.schema, []
            at = [b.column(i).to_pylist() for i in range(6)]
            for i, s in enumerate(text_sets(b.column(6))):
                now = at[0][i], at[1][i], at[2][i]
                if now != key:
                    found += links() if tile else ()
                    tile, key = [], now
                tile.append((at[3][i], at[4][i], at[5][i], s))
            yield batch(found, schema)
        if tile:
            yield batch(list(links()), schema)

    kind = members.schema["rep"].dataType.simpleString()
    return map_arrow(rows, run, f"a {kind}, b {kind}")


def _ends(by: Column | str) -> list[Column]:
    return [F.min(by).alias("lo"), F.max(by).alias("hi")]


def near_duplicates(docs: DataFrame, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs.

    Documents are linked when 100 * common shingles >= percent * all shingles of both;
    component_id is the smallest doc_id reachable by links, kept its row. Sets that are
    equal (by size and 128-bit fingerprint) are one class, whose smallest doc_id stands
    for it. The classes' bands make buckets; each bucket's smallest class is compared
    with all others, then, where classes not yet connected remain beside it, so is the
    largest, then all pairs still apart, in tiles: no pair of a bucket is left out unless
    links already connect it. Null or empty text, or no words: n_shingles 0, alone.
    Repeated rows of a doc_id share its component; a null doc_id is alone, kept. Other
    columns are ignored; empty docs give an empty result."""
    sets = table(sketches(docs, bands, rows), "sketches")
    full = sets.where("n_shingles > 0 and doc_id is not null")
    classes = table(full.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    members = table(full.select("doc_id", "f1", "f2", "n_shingles").distinct().join(classes, ["f1", "f2", "n_shingles"]).select("doc_id", "rep"), "members")
    reps = full.select("doc_id", "bands").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    buckets = table(reps.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("bucket")), "buckets")
    ends = table(buckets.groupBy("bucket").agg(*_ends("rep"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("rep").bitwiseAND(F.lit((1 << 40) - 1))).alias("who")).where("n > 1"), "ends")
    # of buckets with the same classes (up to a hash), one is enough from here on
    ends = ends.groupBy("n", "lo", "hi", "who").agg(F.min("bucket").alias("bucket"))
    held = table(buckets.join(ends, "bucket"), "held")
    pairs = table(held.where("rep <> lo").select(F.col("lo").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    ids = table(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    texts = _texts_of(ids, docs)
    links = table(confirm(pairs, texts, percent), "links")
    joined = components(links)
    for last in (False, True):
        # classes beside the smallest that are not all connected
        rest = held.where("rep <> lo" if not last else "rep <> lo and rep <> hi and n > 3").where("n > 2")
        rest = table(rest.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component"), "rest")
        open_ = rest.groupBy("bucket").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("bucket")
        rest = table(rest.join(table(open_, "open"), "bucket", "left_semi"), "apart")
        if rest.isEmpty():
            break
        if last:
            more = confirm_tiles(rest.select("bucket", "rep", "label", "n"), texts, percent)
        else:
            top = table(rest.where("rep = hi").select("bucket", F.col("label").alias("top")), "top")
            more = confirm(table(rest.where("rep <> hi").join(top, "bucket").where("label <> top").select(F.col("hi").alias("a"), F.col("rep").alias("b")).distinct(), "pairs"), texts, percent)
        links = table(links.unionByName(more), "links")
        joined = components(links)
    found = members.join(joined, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    out = sets.select("doc_id", "n_shingles").join(table(found, "found"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """docs without the documents that near_duplicates does not keep; all columns.
    Repeated rows of a doc_id that stays all stay."""
    gone = table(near_duplicates(docs, **how).where(~F.col("kept")).select("doc_id").distinct(), "gone")
    return docs.join(small(gone), "doc_id", "left_anti").select(docs.columns)
