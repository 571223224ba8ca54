"""Suffix-array deduplication: Burrows-Wheeler transforms of shards merged by
refining their interleave.

The strings that are merged are not single bytes but blocks of BLOCK bytes, laid out
from anchors that the text itself fixes: every string of LENGTH bytes has one anchor,
the least hash among its runs of ANCHOR bytes, so wherever it stands, its blocks are
the same. LENGTH bytes are then a dozen symbols, and the merge needs as many passes
instead of LENGTH. Strings with the same anchor meet in one part. Common prefixes of
the merged order give the repeated intervals; where blocks alone cannot tell, at the
ends of a repeat, the bytes decide."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.anchors import PARTITIONS, PROBES, _by_part, _part, _rows, dealt, own_part, parts_of, sent, settle_hits
from isohyet.llm.common import groups, mix, multipliers, pieces, small, table, text_bytes, with_texts
from isohyet.shipping import map_arrow

LENGTH, BLOCK = 400, 32
#: Bytes of an anchor.
ANCHOR = 200
#: Bytes of text that are worked on at once; a longer text comes alone.
PIECE = 2 << 20

_META = np.dtype([("a", "<u4"), ("lo", "<u4"), ("hi", "<u4"), ("key", "<u8"), ("q0", "<i2"), ("q1", "<i2"), ("zlo", "<i2"), ("len", "<u2")])


#: A prime; what is below its square fits 62 bits.
_P = np.uint64(2**31 - 1)


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo the prime; x below 2 ** 62."""
    x = (x & _P) + (x >> np.uint64(31))
    x = (x & _P) + (x >> np.uint64(31))
    return np.where(x >= _P, x - _P, x)


class _Powers:
    """Powers of a base modulo the prime, as many as were asked for so far."""

    def __init__(self, base: int):
        self.base, self.found = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.found) < n:
            step = np.uint64(pow(self.base, len(self.found), int(_P)))
            self.found = np.concatenate([self.found, _mod(self.found * step)])
        return self.found[:n]


class _Family:
    """A polynomial over random values of the bytes, at a random base."""

    def __init__(self, seed: int):
        r = multipliers(257, 100 + seed) % _P
        base = int(r[256])
        self.values, self.power, self.inverse = r[:256], _Powers(base), _Powers(pow(base, -1, int(_P)))


#: Two for the first hash of a string, two for the second.
_families = [_Family(i) for i in range(4)]


class Hashes:
    """Hashes of any substrings of some bytes: two polynomials modulo a prime. Two strings
    of n bytes that differ collide for at most n / 2 ** 31 of the bases in each, whatever
    their pattern; second gives a hash that has nothing to do with the first."""

    def __init__(self, data: np.ndarray, second: bool = False):
        self.families = _families[2:] if second else _families[:2]
        self.totals = []
        for f in self.families:
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_mod(f.values[data] * f.power.upto(len(data))), out=total[1:])
            self.totals.append(total)

    def of(self, at: np.ndarray, length) -> np.ndarray:
        a, b = (_mod(_mod(t[at + length] - t[at]) * f.inverse.upto(len(t))[at]) for t, f in zip(self.totals, self.families, strict=True))
        return mix((a << np.uint64(31)) + b + mix(np.atleast_1d(np.asarray(length, np.uint64))))


def anchors(h: Hashes, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all strings of that length, by where they start: their anchors, each with
    the first and the last start that it is the anchor of, and its hash. The anchor is
    the least hash of the k-byte runs in the string, of equal ones the leftmost."""
    n, w = int(offsets[-1]), length - k + 1
    room = np.diff(offsets) - length + 1
    has = np.flatnonzero(room > 0)
    if not len(has):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    runs = h.of(np.arange(n - k + 1), k)
    mask = np.uint64((1 << n.bit_length()) - 1)
    packed = (runs & ~mask) | np.arange(len(runs), dtype=np.uint64)
    rows = np.concatenate([packed, np.full(-len(packed) % w, np.uint64(2**64 - 1))]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    room = room[has]
    s = np.arange(room.sum()) + np.repeat(offsets[:-1][has] - (np.cumsum(room) - room), room)
    a = (np.minimum(behind[s], ahead[s + w - 1]) & mask).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    # the least hashes are small numbers: mixed again, they are dealt evenly
    return a[first], s[first], s[np.append(first[1:], len(a)) - 1], mix(runs[a[first]])


def shard_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of a shard (strings, each ended by a 0) in order of their first
    `depth` symbols and the end; ends in the order of the strings."""
    rank, h = text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while h < depth:
        beyond = np.concatenate([rank[h:], np.zeros(min(h, len(rank)), np.int64)])[: len(rank)]
        # nothing beyond an end counts: a suffix that has ended compares by its end
        key = rank * (len(text) + 2) + np.where(rank == 0, 0, beyond)
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        new = np.empty(len(rank), np.int64)
        new[order] = step
        rank, h = new, 2 * h
    return order


def merged_classes(shards: list[tuple[np.ndarray, np.ndarray]], depths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Merge the transforms of shards, each the symbols of its strings one after the
    other and the strings' lengths. Returns where each string begins in the joined
    text (each has an end of one place), the joined text, and for each depth the
    interval of every suffix: equal numbers for equal first `depth` symbols.

    The interleave begins as one shard after the other. A pass deals the suffixes, in
    the order so far, to the symbols before them: afterwards the interleave is right
    for one symbol more, and a border opens where symbols or intervals differ, whose
    common prefix is the number of passes. Only the interleave moves; no shard is
    sorted again."""
    sizes = np.concatenate([n for _, n in shards])
    begin = np.cumsum(sizes + 1) - sizes - 1
    total = int((sizes + 1).sum())
    symbols = np.concatenate([s for s, _ in shards])
    _, ids = np.unique(symbols, return_inverse=True)
    text = np.zeros(total, np.int32)
    inside = np.ones(total, bool)
    inside[begin + sizes] = False
    text[inside] = ids + 1
    before = np.arange(-1, total - 1)
    before[begin] = begin + sizes  # before a string's first symbol stands its end
    order, at, k = [], 0, 0
    for s, n in shards:
        size = len(s) + len(n)
        order.append(shard_order(text[at : at + size], max(depths)) + at)
        at, k = at + size, k + len(n)
    order = np.concatenate(order)
    preceding = text[before]
    interval = np.zeros(total, np.int32)
    out = {}
    for h in range(1, max(depths) + 1):
        c = preceding[order]
        by = np.argsort(c, kind="stable")
        c, old = c[by], interval[by]
        order = before[order[by]]
        interval = np.concatenate([[0], np.cumsum((c[1:] != c[:-1]) | (old[1:] != old[:-1]))]).astype(np.int32)
        if h in depths:
            out[h] = np.empty(total, np.int32)
            out[h][order] = interval
    return begin, text, out


def repeated_parts(shards: list[tuple[np.ndarray, np.ndarray]], inner: int, outer: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each shard (symbols, meta) the ranges of starts, pairs of first and last, all
    of whose strings stand elsewhere too, and those whose bytes must be compared."""
    meta = np.concatenate([m for _, m in shards])
    begin, _, cls = merged_classes([(s, m["len"].astype(np.int64)) for s, m in shards], (inner, outer))
    n = (meta["q1"] - meta["q0"] + 1).astype(np.int64)
    i = np.repeat(np.arange(len(meta)), n)
    q = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + meta["q0"][i]
    zlo, end = meta["zlo"][i].astype(np.int64), meta["zlo"][i].astype(np.int64) + meta["len"][i]
    tag = mix(meta["key"][i] + q.astype(np.uint64))

    def twice(depth: int, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (z >= zlo) & (z + depth <= end)
        key = np.where(ok, mix(tag ^ cls[depth][np.where(ok, begin[i] + z - zlo, 0)].astype(np.uint64)), 0)
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        return ok & (count[back] > 1), back

    full, wide = twice(outer, -q - 1)
    more, core = twice(inner, -q)
    open_ = more & ~full
    # an open place may repeat one that is settled: one of each such interval goes with it
    beside = np.flatnonzero(full & np.isin(core, core[open_]))
    _, first = np.unique(np.stack([core[beside], wide[beside]]), axis=1, return_index=True) if len(beside) else (None, np.zeros(0, np.int64))
    open_[beside[first]] = True
    g = meta["a"][i].astype(np.int64) - BLOCK * q
    lo, hi = np.maximum(meta["lo"][i], g - BLOCK + 1), np.minimum(meta["hi"][i], g)
    shard = np.repeat(np.arange(len(shards)), [len(m) for _, m in shards])[i]
    pick = lambda mask: np.stack([lo[mask], hi[mask]], 1).astype(np.uint32)
    return [(pick(full & (shard == k)), pick(open_ & (shard == k))) for k in range(len(shards))]


def _pairs(binary: list[bytes | None]) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in binary if x), np.uint32).reshape(-1, 2).astype(np.int64)


def repeated_starts(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """(doc_id, ranges, starts): which strings of that many bytes also start anywhere
    else; ranges are pairs of first and last start, starts single ones, 32-bit numbers
    in binaries. docs should hold each text once."""
    parts = parts_of(docs)
    inner = (length - BLOCK + 1) // BLOCK  # whole blocks in any string of the length
    outer = -(-(length + BLOCK) // BLOCK)  # blocks from one before to cover all strings of a step

    def probe(batches):
        task = TaskContext.get().partitionId()
        for nth, b in enumerate(pieces(batches, most=PIECE)):
            data, offsets = text_bytes(b.column(1))
            a, _, _, key = anchors(Hashes(data), offsets, length, k)
            if len(a):
                yield sent(key, a, np.ones(len(a), bool), (task << 32) | nth, parts, b.column(0).to_pylist(), offsets[:-1])

    kept = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits = table(settle_hits(map_arrow(kept, probe, PROBES), parts), "anchor-documents")
    shard = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("symbols", pa.binary()), ("meta", pa.binary()), ("sure", pa.binary()), ("ids", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int32()))])

    def strings(batches):
        task = TaskContext.get().partitionId()
        for nth, b in enumerate(pieces(batches, most=PIECE)):
            chunk = (task << 32) | nth
            data, offsets = text_bytes(b.column(1))
            h = Hashes(data)
            a, lo, hi, key = anchors(h, offsets, length, k)
            live = [np.frombuffer(x, np.uint32) for x in b.column(2).to_pylist()]
            live = np.concatenate(live).astype(np.int64) + np.repeat(offsets[:-1], [len(x) for x in live])
            keep = np.isin(a, live)
            a, lo, hi, key = a[keep], lo[keep], hi[keep], key[keep]
            if not len(a):
                continue
            doc = np.searchsorted(offsets, a, "right") - 1
            q0, q1 = (a - hi) // BLOCK, (a - lo) // BLOCK
            zlo = np.maximum(-q1 - 1, -((a - offsets[doc]) // BLOCK))
            zhi = np.minimum(-q0 + outer - 2, (offsets[doc + 1] - a) // BLOCK - 1)
            size = zhi - zlo + 1
            whole = (zlo == -q1 - 1) & (zhi == -q0 + outer - 2)
            same = mix(h.of(a + BLOCK * zlo, BLOCK * size) + mix(key + (q0 * 64 + q1).astype(np.uint64)) + whole.astype(np.uint64))
            _, first, back, count = np.unique(same, return_index=True, return_inverse=True, return_counts=True)
            sure = whole & (count[back] > 1)
            send = np.flatnonzero(~sure | (first[back] == np.arange(len(a))))
            meta = np.zeros(len(a), _META)
            for name, x in (("a", a), ("lo", lo), ("hi", hi), ("key", key), ("q0", q0), ("q1", q1), ("zlo", zlo), ("len", size)):
                meta[name] = x
            by, there, spans = _by_part(_part(key[send], parts))
            rows = []
            for p, (x, y) in zip(there.tolist(), spans, strict=True):
                at = send[by[x:y]]
                n = size[at]
                place = np.repeat(a[at] + BLOCK * zlo[at], n) + BLOCK * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                rows.append((p, chunk, h.of(place, BLOCK).tobytes(), meta[at].tobytes(), None, None, None))
            rows.append((own_part(chunk, parts), chunk, None, None, np.stack([lo[sure], hi[sure]], 1).astype(np.uint32).tobytes(), b.column(0).to_pylist(), offsets[:-1].astype(np.int32)))
            yield _rows(shard, rows)

    told = pa.schema([("chunk", pa.int64()), ("full", pa.binary()), ("open", pa.binary()), ("ids", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int32()))])

    def merge(batches):
        for g in groups(batches, 1):
            chunks, shards, rows = [], [], []
            for chunk, symbols, meta, sure, ids, firsts in zip(*(g.column(i).to_pylist() for i in range(1, 7)), strict=True):
                if symbols is None:
                    rows.append((chunk, sure, b"", ids, firsts))
                else:
                    chunks.append(chunk)
                    shards.append((np.frombuffer(symbols, np.uint64), np.frombuffer(meta, _META)))
            yield _rows(told, rows)
            if shards:
                found = repeated_parts(shards, inner, outer)
                yield _rows(told, [(c, full.tobytes(), open_.tobytes(), None, None) for c, (full, open_) in zip(chunks, found, strict=True) if len(full) or len(open_)])

    def gather(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("ranges", pa.binary()), ("open", pa.binary())])
        for g in groups(batches, 1):
            own = g.filter(pa.compute.is_valid(g.column("ids")))
            ids, firsts = own.column("ids")[0].values.to_numpy(), own.column("firsts")[0].values.to_numpy().astype(np.int64)
            out = []
            for name in ("full", "open"):
                p = _pairs(g.column(name).to_pylist())
                doc = np.searchsorted(firsts, p[:, 0], "right") - 1
                order = np.argsort(doc, kind="stable")
                doc, p = doc[order], p[order]
                there, at = np.unique(doc, return_index=True)
                out.append({int(d): (x - firsts[d]).astype(np.uint32).tobytes() for d, x in zip(there, np.split(p, at[1:]), strict=True)} if len(p) else {})
            docs_ = sorted({*out[0], *out[1]})
            yield pa.RecordBatch.from_arrays([pa.array(ids[docs_], pa.int64()), *(pa.array([o.get(d, b"") for d in docs_], pa.binary()) for o in out)], schema=schema)

    found = map_arrow(with_texts(docs, hits).select("doc_id", "text", "hits"), strings, "part int, chunk long, symbols binary, meta binary, sure binary, ids array<bigint>, firsts array<int>")
    found = map_arrow(dealt(found, parts), merge, "chunk long, full binary, open binary, ids array<bigint>, firsts array<int>")
    ranges = map_arrow(found.repartition(min(parts, PARTITIONS), "chunk").sortWithinPartitions("chunk"), gather, "doc_id long, ranges binary, open binary")
    ranges = table(table(ranges, "ranges").dropDuplicates(["doc_id"]), "range-documents")

    def ends(batches):
        task = TaskContext.get().partitionId()
        for nth, b in enumerate(pieces(batches, most=PIECE)):
            data, offsets = text_bytes(b.column(1))
            p = [_pairs([x]) for x in b.column(2).to_pylist()]
            p = np.concatenate(p) + np.repeat(offsets[:-1], [len(x) for x in p])[:, None]
            n = p[:, 1] - p[:, 0] + 1
            s = np.unique(np.repeat(p[:, 0] - (np.cumsum(n) - n), n) + np.arange(n.sum()))
            yield sent(Hashes(data).of(s, length), s, np.ones(len(s), bool), (task << 32) | nth, parts, b.column(0).to_pylist(), offsets[:-1], Hashes(data, second=True).of(s, length))

    open_ = table(ranges.where(F.length("open") > 0).select("doc_id", "open"), "open")
    starts = settle_hits(map_arrow(with_texts(docs, open_).select("doc_id", "text", "open"), ends, PROBES), parts, wide=True)
    return table(ranges.select("doc_id", "ranges").join(table(starts, "starts").withColumnRenamed("hits", "starts"), "doc_id", "left"), "repeats")


def drop_repeated_bytes(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary; with digest kept_sha256 of
    it) for every row of docs: every byte of the UTF-8 text covered by a string of
    `length` bytes that also starts anywhere else, same document included, goes.

    Equal texts are one class: of two or more documents all bytes go (if there are as
    many as length), and one stands for them in the search. Null or empty text: no
    bytes. Rows of one doc_id should have one text and are one place. A null doc_id is
    neither compared nor changed. Strings are compared by 128-bit hashes, or block by
    block by 64-bit ones where they share an anchor, which has 64 bits too. Other columns
    are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length)).select("doc_id", F.md5(F.col("text").cast("binary")).alias("m"), F.octet_length("text").alias("n"))
    many = table(known.groupBy("m", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top")).where("rep <> top"), "copied")
    copies = table(known.join(many.select("m", "n", "rep"), ["m", "n"]).select("doc_id", "rep").distinct(), "copies")
    others = docs.join(small(copies.where("doc_id <> rep").select("doc_id")), "doc_id", "left_anti")
    again = table(known.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if not again.isEmpty():  # rows of one doc_id are one place
        others = others.join(small(again), "doc_id", "left_anti").select("doc_id", "text").unionByName(others.join(small(again), "doc_id", "left_semi").select("doc_id", "text").dropDuplicates(["doc_id"]))
    found = repeated_starts(others, length, k)
    found = found.join(copies.select("doc_id", F.lit(True).alias("all")), "doc_id", "full").select("doc_id", F.coalesce("all", F.lit(False)).alias("all"), "ranges", "starts")
    found = table(found, "found")

    def cut(batches):
        for b in batches:
            out = []
            for text, all_, ranges, starts in zip(b.column(1).cast(pa.large_binary()).to_pylist(), *(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                text = text or b""
                n, kept, spans = len(text), text, 0
                if all_:
                    kept, spans = b"", 1
                elif ranges or starts:
                    step = np.zeros(n + 1, np.int64)
                    p = _pairs([ranges])
                    np.add.at(step, p[:, 0], 1)
                    np.add.at(step, p[:, 1] + length, -1)
                    s = np.frombuffer(starts or b"", np.uint32).astype(np.int64)
                    np.add.at(step, s, 1)
                    np.add.at(step, s + length, -1)
                    gone = np.cumsum(step[:n]) > 0
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((n, n - len(kept), spans, hashlib.sha256(kept).hexdigest() if digest else kept))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in list(zip(*out, strict=True))[:3]), pa.array([o[3] for o in out], pa.string() if digest else pa.binary())] if out else [b.column(0), *(pa.array([], pa.int64()) for _ in range(3)), pa.array([], pa.string() if digest else pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    ids = small(found.select("doc_id"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("all", "boolean"), ("ranges", "binary"), ("starts", "binary"))]
    same = rows.join(ids, "doc_id", "left_anti").select("doc_id", "text", *none)
    other = rows.join(ids, "doc_id", "left_semi").join(found.hint("shuffle_merge"), "doc_id").select("doc_id", "text", "all", "ranges", "starts")
    out = map_arrow(same.unionByName(other), cut, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}")
    return out.withColumnRenamed("kept", "kept_sha256") if digest else out
