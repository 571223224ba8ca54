"""Substring duplicates over words: fixed-block anchors, rolling probes, exact
repeats of a window.

All that is shuffled is packed: a row carries the numbers of many windows, so a task
works with numpy on arrays; Spark deals the rows by their part."""

from __future__ import annotations

import hashlib
from itertools import compress, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import BROADCAST_ROWS, groups, mix, pieces, shingles, table, text_bytes, with_texts, word_hashes, words
from isohyet.shipping import map_arrow

#: Words of a window, and of a block. A window holds a whole block of its document
#: wherever it starts, as 2 * BLOCK - 1 is not more than WINDOW.
WINDOW, BLOCK = 20, 10
#: Bytes of text of a chunk, the unit in which windows are packed.
CHUNK = 8 << 20


#: Bytes of text a part of the hashes is made for, and the most shuffle partitions
#: that the parts are dealt to; a task takes one part after the other.
PART, PARTITIONS = 16 << 20, 4096


def parts_of(df: DataFrame) -> int:
    """Into how many parts hashes are dealt: by the bytes of all texts, 64 at least."""
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(64, -(-size // PART))


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    """The rows by their part, each part in one piece of one partition."""
    n = min(parts, PARTITIONS)
    return rows.repartitionById(n, (F.col("part") % n).cast("int")).sortWithinPartitions("part")


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.uint32)


def own_part(chunk: int, parts: int) -> int:
    """The part for the row of a chunk itself: by a hash, as chunk % parts would be the
    same few parts for all tasks where parts has many factors of 2."""
    return int(_part(mix(np.array([chunk], np.uint64)), parts)[0])


def _by_part(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """An order by part, the parts there are, and where each begins and ends."""
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")
    there, at = np.unique(part[order], return_index=True)
    return order, there, list(zip(at.tolist(), np.append(at, len(part))[1:].tolist(), strict=True))


def _groups_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by h, where each value's run starts in it, and how long it is."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return order, start, np.diff(np.append(start, len(s)))


def _runs(h: np.ndarray, other: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_groups_of 128-bit values, whose halves are h and other."""
    order, start, count = _groups_of(h)
    if other is None or not len(h):
        return order, start, count
    a, b = h[order], other[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():  # one half is equal, the other is not
        order = np.lexsort((other, h))
        a, b = h[order], other[order]
        start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        count = np.diff(np.append(start, len(a)))
    return order, start, count


PROBES = "part int, chunk long, key binary, other binary, low binary, blocks binary, sure binary, ids array<bigint>, firsts array<int>"
_PROBES = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("key", pa.binary()), ("other", pa.binary()), ("low", pa.binary()), ("blocks", pa.binary()), ("sure", pa.binary()), ("ids", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int32()))])


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def settle_hits(probes: DataFrame, parts: int, wide: bool = False) -> DataFrame:
    """(doc_id, hits) from what chunks have sent: a place is a hit if its number came
    at least twice, or if the chunk was sure. Numbers have 32 bits, the lowest set for a
    block, which one of the two must be; or, if wide, 128 bits, and all are alike.
    Places are counted from their document's first."""
    kind = np.uint64 if wide else np.uint32
    one = kind(1)

    def match(batches):
        schema = pa.schema([("chunk", pa.int64()), ("hits", pa.binary()), ("ids", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int32()))])
        for g in groups(batches, 1):
            chunks, keys, others, at, rows = [], [], [], [], []
            for chunk, key, other, low, blocks, sure, ids, firsts in zip(*(g.column(i).to_pylist() for i in range(1, 9)), strict=True):
                if key is None:
                    rows.append((chunk, sure, ids, firsts))
                    continue
                n = np.frombuffer(blocks, np.uint32)
                chunks.append(chunk)
                keys.append(np.frombuffer(key, kind))
                others.append(np.frombuffer(other or b"", np.uint64))
                at.append(np.frombuffer(low, np.uint16).astype(np.uint32) + (np.repeat(np.arange(len(n), dtype=np.uint32), n) << np.uint32(16)))
            yield _rows(schema, rows)
            if not keys:
                continue
            if wide:
                order, start, count = _runs(np.concatenate(keys), np.concatenate(others))
                hits = np.zeros(len(order), bool)
                hits[order[np.repeat(count > 1, count)]] = True
                hits = np.split(hits, np.cumsum([len(k) for k in keys])[:-1])
            else:
                s = np.sort(np.concatenate(keys))
                start = np.flatnonzero(np.concatenate([[True], (s[1:] ^ s[:-1]) > 1]))
                last = np.append(start[1:], len(s)) - 1
                live = s[start[(last > start) & ((s[last] & one) == 1)]] >> one  # twice or more, once as a block
                if not len(live):
                    continue
                hits = (live[np.minimum(np.searchsorted(live, key >> one), len(live) - 1)] == key >> one for key in keys)
            found = ((chunk, where[hit].tobytes(), None, None) for chunk, where, hit in zip(chunks, at, hits, strict=True) if hit.any())
            while rows := list(islice(found, 256)):
                yield _rows(schema, rows)

    def gather(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("hits", pa.binary())])
        for g in groups(batches, 1):
            own = g.filter(pa.compute.is_valid(g.column("ids")))
            ids, firsts = own.column("ids")[0].values, own.column("firsts")[0].values.to_numpy()
            hits = np.unique(np.frombuffer(b"".join(g.column("hits").to_pylist()), np.uint32)).astype(np.int64)
            doc = np.searchsorted(firsts, hits, "right") - 1  # documents without words share a first with the next
            there, at = np.unique(doc, return_index=True)
            out = [(h - firsts[d]).astype(np.uint32).tobytes() for d, h in zip(there, np.split(hits, at[1:]), strict=True)] if len(hits) else []
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(there)), pa.array(out, pa.binary())], schema=schema)

    found = map_arrow(dealt(probes, parts), match, "chunk long, hits binary, ids array<bigint>, firsts array<int>")
    found = map_arrow(found.repartition(min(parts, PARTITIONS), "chunk").sortWithinPartitions("chunk"), gather, "doc_id long, hits binary")
    return table(found, "hits").dropDuplicates(["doc_id"])


def sent(h: np.ndarray, pos: np.ndarray, block: np.ndarray, chunk: int, parts: int, ids: list, first: np.ndarray, other: np.ndarray | None = None) -> pa.RecordBatch:
    """The rows of a chunk for settle_hits: of each place its 64-bit hash (with other,
    the second half of a 128-bit one), where it is in the chunk, and whether it is a
    block. What comes twice in the chunk, once as a block, is sure; one of it goes on
    for the others."""
    order, start, count = _runs(h, other)
    has = np.logical_or.reduceat(block[order], start) if len(start) else np.zeros(0, bool)
    sure = np.repeat((count > 1) & has, count)  # in the order
    send = ~sure
    send[start] = True
    mark = np.where(sure, True, block[order])
    kept, marks = order[send], mark[send]
    back = np.argsort(kept, kind="stable")
    kept, marks = kept[back], marks[back]
    key = h[kept] if other is not None else ((h[kept] & np.uint64(0xFFFFFFFFFFFFFFFE)) | marks.astype(np.uint64)).astype(np.uint32)
    by, there, spans = _by_part(_part(h[kept], parts))
    rows = []
    for p, (a, z) in zip(there.tolist(), spans, strict=True):
        at = pos[kept[by[a:z]]]
        blocks = np.bincount(at >> 16, minlength=1).astype(np.uint32)
        rows.append((p, chunk, key[by[a:z]].tobytes(), other[kept[by[a:z]]].tobytes() if other is not None else None, at.astype(np.uint16).tobytes(), blocks.tobytes(), None, None, None))
    rows.append((own_part(chunk, parts), chunk, None, None, None, None, np.sort(pos[order[sure]]).astype(np.uint32).tobytes(), ids, first.astype(np.int32)))
    return _rows(_PROBES, rows)


def anchor_hits(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(doc_id, hits): the words of a document at which a run of `block` words starts
    that is a reference block (from word 0, block, 2 * block, ... of its document)
    in one place and found by the rolling probe in another; hits are 32-bit numbers
    in a binary. Documents with fewer words than a window have none.

    Every rolling probe and every block goes, by its hash, to one part. What a chunk
    can settle by itself, it does: of blocks found again in it, one goes on."""
    parts = parts_of(docs)

    def probe(batches):
        task = TaskContext.get().partitionId()
        for nth, b in enumerate(pieces(batches, most=CHUNK)):
            chunk = (task << 32) | nth
            data, offsets = text_bytes(b.column(1))
            starts, ends, owner = words(data, offsets)
            size = np.bincount(owner, minlength=b.num_rows)
            first = np.cumsum(size) - size
            if len(owner) < block:
                continue
            g = shingles(word_hashes(data, starts, ends), block)
            pos = np.flatnonzero((owner[: len(g)] == owner[block - 1 :]) & (size[owner[: len(g)]] >= window))
            h = g[pos]
            aligned = (pos - first[owner[pos]]) % block == 0
            yield sent(h, pos, aligned, chunk, parts, b.column(0).to_pylist(), first)

    kept = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return settle_hits(map_arrow(kept, probe, PROBES), parts)


def repeated_windows(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(doc_id, starts): the windows whose words also start earlier (in a document with
    a smaller doc_id, or in the same one), as 32-bit numbers in a binary.

    Hits are extended over all windows that hold their block; of equal windows all
    but the earliest are repeats. A chunk sends only its earliest of each, the others
    are settled there, so a passage that many documents share is one entry a chunk."""
    parts = parts_of(docs)
    hits = table(anchor_hits(docs, window, block), "hit-documents")
    joined = with_texts(docs, hits)

    def extend(batches):
        schema = pa.schema([("part", pa.int32()), ("hash", pa.binary()), ("other", pa.binary()), ("doc", pa.binary()), ("start", pa.binary())])
        for b in pieces(batches, most=CHUNK):
            b = b.take(pa.compute.sort_indices(b.column(0)))
            data, offsets = text_bytes(b.column(1))
            starts, ends, owner = words(data, offsets)
            size = np.bincount(owner, minlength=b.num_rows)
            first = np.cumsum(size) - size
            anchors = [np.frombuffer(h, np.uint32) for h in b.column(2).to_pylist()]
            at = np.concatenate(anchors).astype(np.int64) + np.repeat(first, [len(a) for a in anchors])
            step = np.zeros(len(owner) + window + 1, np.int32)
            doc_first = first[owner[at]]
            np.add.at(step, np.maximum(at - (window - block), doc_first), 1)
            np.add.at(step, at + 1, -1)
            near = np.cumsum(step[: len(owner)]) > 0
            g, g2 = (shingles(word_hashes(data, starts, ends, seed), window, seed) for seed in (0, 7))
            pos = np.flatnonzero(near[: len(g)] & (owner[: len(g)] == owner[window - 1 :]))
            h, other, ids = g[pos], g2[pos], b.column(0).to_numpy()
            doc, start = ids[owner[pos]], (pos - first[owner[pos]]).astype(np.uint32)
            order, run, count = _runs(h, other)  # documents are in order, so the first of a run is the earliest
            lead = order[run]
            head = np.repeat(lead, count)
            later = (doc[order] > doc[head]) | (start[order] > start[head])
            rest = order[later]
            by, there, spans = _by_part(_part(h[lead], parts))
            rows = [(p, h[lead[by[a:z]]].tobytes(), other[lead[by[a:z]]].tobytes(), doc[lead[by[a:z]]].tobytes(), start[lead[by[a:z]]].tobytes()) for p, (a, z) in zip(there.tolist(), spans, strict=True)]
            by, there, spans = _by_part(_part(mix(doc[rest].astype(np.uint64)), parts))
            rows += [(p, None, None, doc[rest[by[a:z]]].tobytes(), start[rest[by[a:z]]].tobytes()) for p, (a, z) in zip(there.tolist(), spans, strict=True)]
            yield _rows(schema, rows)

    out = pa.schema([("part", pa.int32()), ("doc", pa.binary()), ("start", pa.binary())])

    def deal(doc, start):
        by, there, spans = _by_part(_part(mix(doc.astype(np.uint64)), parts))
        return _rows(out, [(p, doc[by[a:z]].tobytes(), start[by[a:z]].tobytes()) for p, (a, z) in zip(there.tolist(), spans, strict=True)])

    def settle(batches):
        for g in groups(batches, 1):
            held = []
            for h, o, d, s in zip(*(g.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                if h is None:
                    yield deal(np.frombuffer(d, np.int64), np.frombuffer(s, np.uint32))
                else:
                    held.append((h, o, d, s))
            if held:
                h, o, d, s = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*held, strict=True), (np.uint64, np.uint64, np.int64, np.uint32), strict=True))
                order = np.lexsort((s, d, o, h))
                h, o, d, s = h[order], o[order], d[order], s[order]
                run = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])]))
                head = np.repeat(run, np.diff(np.append(run, len(h))))
                later = (d > d[head]) | (s > s[head])
                yield deal(d[later], s[later])

    def gather(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("starts", pa.binary())])
        for g in groups(batches, 1):
            d, s = (np.frombuffer(b"".join(g.column(c).to_pylist()), t) for c, t in (("doc", np.int64), ("start", np.uint32)))
            order = np.lexsort((s, d))
            d, s = d[order], s[order]
            there, at = np.unique(d, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array([x.tobytes() for x in np.split(s, at[1:])] if len(s) else [], pa.binary())], schema=schema)

    found = map_arrow(joined.select("doc_id", "text", "hits"), extend, "part int, hash binary, other binary, doc binary, start binary")
    told = map_arrow(dealt(found, parts), settle, "part int, doc binary, start binary")
    return table(map_arrow(dealt(told, parts), gather, "doc_id long, starts binary"), "windows")


def drop_repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (with digest: kept_sha256 of it) for
    every row of docs: each word covered by a repeated window goes, the others are
    joined by one space.

    Words are [^\\x20\\x09-\\x0D]+, unchanged; windows are compared by 128-bit hashes.
    Null or empty text: no words. Rows of one doc_id should have one text; they are
    the same place, so none is a repeat of the other. A null doc_id is neither
    compared nor changed. Other columns are ignored."""
    repeats = repeated_windows(docs, window, block)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def cut(batches):
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for text, starts in zip(b.column(1).cast(pa.large_binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                w = (text or b"").split()  # bytes.split parts at just these six characters
                n_words.append(len(w))
                if starts:
                    s, step = np.frombuffer(starts, np.uint32).astype(np.int64), np.zeros(len(w) + 1, np.int64)
                    np.add.at(step, s, 1)
                    np.add.at(step, s + window, -1)
                    keep = np.cumsum(step[:-1]) == 0
                    w = list(compress(w, keep.tolist()))
                n_removed.append(n_words[-1] - len(w))
                kept.append(hashlib.sha256(b" ".join(w)).hexdigest() if digest else b" ".join(w).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    ids = repeats.select("doc_id")
    if ids.count() <= BROADCAST_ROWS:
        # only the texts that change meet their windows
        same = rows.join(F.broadcast(ids), "doc_id", "left_anti").withColumn("starts", F.lit(None).cast("binary"))
        other = rows.join(F.broadcast(ids), "doc_id", "left_semi").join(repeats.hint("shuffle_merge"), "doc_id")
        joined = same.unionByName(other)
    else:
        joined = rows.join(repeats, "doc_id", "left")
    return map_arrow(joined.select("doc_id", "text", "starts"), cut, "doc_id long, n_words long, n_removed long, kept string").withColumnRenamed("kept", "kept_sha256" if digest else "kept_text")
