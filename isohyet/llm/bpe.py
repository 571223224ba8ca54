"""Byte-level BPE: greedy proposals, vectorised checks of adjacent pairs, exact
merges for the words that fail."""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from isohyet.llm.common import pieces, word_hashes
from isohyet.shipping import map_arrow

#: New words after which a Python worker forgets those not met since as many before.
REMEMBERED = 400_000


def _byte_letters() -> dict[int, str]:
    """The usual rule of byte-level vocabularies: printable bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Kinds of code points: letters, numbers, white space, others.
LETTER, NUMBER, SPACE, OTHER = range(4)
#: Bytes from which on a word is worked on by itself.
LONG = 200
#: A rank beyond all ranks.
NEVER = np.int64(1 << 40)


@lru_cache(1)
def _kinds() -> np.ndarray:
    every = "".join(map(chr, range(0x110000)))
    kinds = np.full(len(every), OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            kinds[m.start() : m.end()] = kind
    return kinds


def word_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the words of byte-level vocabularies begin in the code points of several
    texts: '(?:[sdmt]|ll|ve|re)| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

    A word begins where the kind changes. Of white space before a word the last one
    stands by itself, or, if it is a blank, goes with the word. An apostrophe that
    begins a word takes the letters of a short form, and a word begins after them."""
    kind = _kinds()[points]
    text = np.zeros(len(points) + 1, bool)
    text[offsets] = True
    begin = text[:-1].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    last = np.flatnonzero((kind[:-1] == SPACE) & begin[1:] & ~text[1:-1])
    begin[last] = True
    begin[last[points[last] == 32] + 1] = False
    mark = np.flatnonzero((points == 39) & begin)
    pad = np.concatenate([points, np.zeros(3, points.dtype)])
    inside = lambda k: np.logical_and.reduce([~text[np.minimum(mark + j, len(points))] for j in range(1, k + 1)])
    is_ = lambda k, letters: np.isin(pad[mark + k], [ord(c) for c in letters])
    short = is_(1, "sdmt") & inside(1)
    long = (is_(1, "l") & is_(2, "l") | is_(1, "vr") & is_(2, "e")) & inside(2)
    begin[mark[short | long] + 1] = False
    after = np.concatenate([mark[short] + 2, mark[long] + 3])
    begin[after[after < len(points)]] = True
    return np.flatnonzero(begin)


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each different word, and which of them each word is. Words follow each
    other without a gap. Hashes propose, the bytes decide."""
    _, first, back = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    size, like = ends - starts, first[back]
    same = (size == size[like]).all() and (data[starts[0] : ends[-1]] == data[np.repeat(starts[like] - starts, size) + np.arange(starts[0], ends[-1])]).all()
    if not same:
        seen: dict[bytes, int] = {}
        raw = data.tobytes()
        back = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        _, first = np.unique(back, return_index=True)
    return first, back


def _every_other(at: np.ndarray) -> np.ndarray:
    """Of places that follow each other (pairs of one token in a run) every second."""
    first = np.append(True, np.diff(at) > 1)
    start = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - start) % 2 == 0]


def _in_order(found: list[np.ndarray], owners: list[np.ndarray], words: int) -> tuple[np.ndarray, np.ndarray]:
    owner = np.concatenate(owners)
    return np.concatenate(found)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=words)


class Codec:
    """A byte-level BPE vocabulary in the JSON form of the tokenizers library."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        byte_of = {c: b for b, c in _byte_letters().items()}
        raw = lambda s: bytes(byte_of[c] for c in s)
        self.id_of = {raw(s): i for s, i in model["vocab"].items() if all(c in byte_of for c in s)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.id_of = {s: i for s, i in self.id_of.items() if i not in set(self.added.values())}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        size = max([*self.id_of.values(), *self.added.values()]) + 1
        self.pieces: list[bytes] = [b""] * size
        for s, i in self.id_of.items():
            self.pieces[i] = s
        for s, i in self.added.items():
            self.pieces[i] = s.encode()
        # order[t]: when t's merge applies (bytes: before all); left, right: what it is merged from
        self.order, self.left, self.right = np.full(size, -1, np.int64), np.arange(size), np.arange(size)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        keys, orders = [], []
        for rank, (a, b) in enumerate(pairs):
            x, y = raw(a), raw(b)
            i, l, r = self.id_of[x + y], self.id_of[x], self.id_of[y]
            self.merge.setdefault((l, r), (rank, i))
            keys.append(l * size + r)
            orders.append(rank)
            if self.order[i] < 0:
                self.order[i], self.left[i], self.right[i] = rank, l, r
        keys, orders = np.array(keys, np.int64), np.array(orders, np.int64)
        by = np.argsort(keys, kind="stable")
        self.keys, self.key_order, self.size = keys[by], orders[by], size
        self.byte_ids = np.array([self.id_of[bytes([c])] for c in range(256)], np.int64)
        made = {rank: i for rank, i in self.merge.values()}
        self.made = np.array([made.get(r, -1) for r in range(len(pairs))], np.int64)
        self.piece_len = np.array([len(p) for p in self.pieces], np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)])[:-1]
        self.flat = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        # the words' bytes as a tree: edges node * 256 + byte, sorted, the nodes they lead to, and what ends there
        nodes: dict[bytes, int] = {b"": 0}
        edges = []
        for w in sorted(self.id_of):
            for n in range(1, len(w) + 1):
                if w[:n] not in nodes:
                    nodes[w[:n]] = len(nodes)
                    edges.append((nodes[w[: n - 1]] * 256 + w[n - 1], nodes[w[:n]]))
        edges = np.array(sorted(edges), np.int64).reshape(-1, 2)
        self.edges, self.to = edges[:, 0].copy(), edges[:, 1].copy()
        self.ends_here = np.full(len(nodes), -1, np.int64)
        for w, i in self.id_of.items():
            self.ends_here[nodes[w]] = i
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.verified = self.merged = 0

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """When the pair (a, b) would be merged; beyond all ranks if never."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_order[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each adjacent pair of tokens, whether BPE over their joined bytes gives
        just these two. Undoes merges from the latest backwards; a pair fails if the
        tokens that face each other at some moment would have been merged before
        the next merge of either side happened."""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        until = np.full(len(a), NEVER)  # the merge that ended this moment
        strict = np.zeros(len(a), bool)  # a merge of the same rank further left comes first
        while len(live):
            rank = self._rank(a, b)
            bad = (rank < until) | (strict & (rank == until) & (rank < NEVER))
            ok[live[bad]] = False
            oa, ob = self.order[a], self.order[b]
            go = ~bad & ((oa >= 0) | (ob >= 0))
            live, a, b, oa, ob = live[go], a[go], b[go], oa[go], ob[go]
            later_a = oa > ob
            until = np.where(later_a, oa, ob)
            # of equal ranks the left one is merged first: b's merge is undone before a's,
            # and the facing pair, left of what b was merged from, wins a tie against b's merge
            strict = ~later_a
            a, b = np.where(later_a, self.right[a], a), np.where(later_a, b, self.left[b])
        return ok

    def exact(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Merging by rank, leftmost first, of many words side by side: a round
        merges each word's pairs of least rank. The tokens of all words, one word
        after the other, and how many each has."""
        found, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        sizes = np.array([len(w) for w in words], np.int64)
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        last = np.append(owner[1:] != owner[:-1], True)
        rank = np.where(last, NEVER, self._rank(ids, np.append(ids[1:], 0)))
        while len(ids):
            start = np.flatnonzero(np.append(True, last[:-1]))
            size = np.diff(np.append(start, len(ids)))
            least = np.minimum.reduceat(rank, start)
            over = least >= NEVER
            if over.any():
                gone = np.repeat(over, size)
                found.append(ids[gone])
                owners.append(owner[gone])
                ids, owner, last, rank = ids[~gone], owner[~gone], last[~gone], rank[~gone]
                least, size = least[~over], size[~over]
            at = np.flatnonzero(rank == np.repeat(least, size))
            if not len(at):
                continue
            at = _every_other(at)
            ids[at] = self.made[rank[at]]
            last[at] |= last[at + 1]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, owner, last, rank = ids[keep], owner[keep], last[keep], rank[keep]
            at = at - np.arange(len(at))
            near = np.unique(np.concatenate([at, np.maximum(at - 1, 0)]))
            rank[near] = np.where(last[near], NEVER, self._rank(ids[near], ids[np.minimum(near + 1, len(ids) - 1)]))
        return _in_order(found, owners, len(words))

    def exact_long(self, word: bytes) -> np.ndarray:
        """exact() for one long word: all places of the least rank at once."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)]
        while len(ids) > 1:
            rank = self._rank(ids[:-1], ids[1:])
            least = rank.min()
            if least >= NEVER:
                break
            at = _every_other(np.flatnonzero(rank == least))
            ids[at] = self.made[least]
            ids = np.delete(ids, at + 1)
        return ids

    def _longest(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The longest token that begins at each place and ends by its end."""
        best = np.full(len(at), -1, np.int64)
        live, node, depth = np.arange(len(at)), np.zeros(len(at), np.int64), 0
        while len(live):
            key = node * 256 + data[at[live] + depth]
            i = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            ok = self.edges[i] == key
            live, node, depth = live[ok], self.to[i[ok]], depth + 1
            ends = self.ends_here[node]
            best[live[ends >= 0]] = ends[ends >= 0]
            more = at[live] + depth < end[live]
            live, node = live[more], node[more]
        return best

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The greedy longest-match tokens of each word, all words side by side, and
        how many each has."""
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(sizes)
        at, live = end - sizes, np.flatnonzero(sizes < LONG)
        found, owners = [], []
        while len(live):
            t = self._longest(data, at[live], end[live])
            found.append(t)
            owners.append(live)
            at[live] += self.piece_len[t]
            live = live[at[live] < end[live]]
        for w in np.flatnonzero(sizes >= LONG).tolist():
            places = np.arange(at[w], end[w])
            t = self._longest(data, places, np.full(len(places), end[w]))
            step, chain, i = self.piece_len[t].tolist(), [], 0
            while i < len(step):
                chain.append(i)
                i += step[i]
            found.append(t[chain])
            owners.append(np.full(len(chain), w))
        return _in_order(found, owners, len(words))

    def learn(self, new: list[bytes]) -> None:
        """Encode words not met so far and remember their ids' bytes."""
        flat, sizes = self.propose(new)
        ends = np.cumsum(sizes)
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = False  # no pair from one word to the next
        at = np.flatnonzero(inner)
        ok = np.ones(len(new), bool)
        ok[np.searchsorted(ends, at[~self.compatible(flat[at], flat[at + 1])], "right")] = False
        fails = [w for w, good in zip(new, ok.tolist(), strict=True) if not good]
        short, long = [w for w in fails if len(w) < LONG], [w for w in fails if len(w) >= LONG]
        self.verified += len(new) - len(fails)
        self.merged += len(fails)
        self._remember([w for w, good in zip(new, ok.tolist(), strict=True) if good], flat[np.repeat(ok, sizes)], sizes[ok])
        if short:
            self._remember(short, *self.exact(short))
        for w in long:
            self.known[w] = self.exact_long(w).astype("<u4").tobytes()

    def _remember(self, words: list[bytes], flat: np.ndarray, sizes: np.ndarray) -> None:
        ids, ends = flat.astype("<u4").tobytes(), np.cumsum(sizes) * 4
        self.known.update((w, ids[a:b]) for w, a, b in zip(words, (ends - 4 * sizes).tolist(), ends.tolist(), strict=True))

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """The ids' bytes of different words. What is remembered are the words of the
        last two rounds of REMEMBERED new ones."""
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        new = []
        for w in words:
            if w not in self.known:
                if w in self.older:
                    self.known[w] = self.older[w]
                else:
                    new.append(w)
        if new:
            self.learn(new)
        return [self.known[w] for w in words]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        parts, owner = [], []
        marks: dict[int, list[tuple[int, int]]] = {}
        for i, t in enumerate(texts):
            cut = self.special.split(t) if self.special else [t]
            for j, p in enumerate(cut):
                if j % 2:
                    marks.setdefault(i, []).append((len(parts), self.added[p]))
                elif p:
                    parts.append(p)
                    owner.append(i)
        joined = "".join(parts)
        raw = joined.encode()
        if raw:
            data = np.frombuffer(raw, np.uint8)
            at = np.concatenate([np.flatnonzero((data & 0xC0) != 0x80), [len(data)]])  # where code points begin
            offsets = np.cumsum([0, *map(len, parts)])
            first = word_starts(np.frombuffer(joined.encode("utf-32-le"), np.uint32), offsets)
            s, e = at[first], np.append(at[first[1:]], len(data))
            of, back = distinct(data, s, e)
            ids = self._ids_of([raw[a:b] for a, b in zip(s[of].tolist(), e[of].tolist(), strict=True)])
            n = np.array([len(x) // 4 for x in ids])
            flat, start = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(n) - n
            size = n[back]
            ends = np.cumsum(size)
            flat = flat[np.repeat(start[back] - (ends - size), size) + np.arange(ends[-1])]
            to = np.append(0, ends)[np.append(np.searchsorted(first, offsets[:-1]), len(first))]
        else:
            flat, to = np.zeros(0, "<u4"), np.zeros(1, np.int64)
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        out = [flat[to[a] : to[b]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for i, own in marks.items():
            x, last = [], bounds[i]
            for k, m in own:
                x += [flat[to[last] : to[k]], np.array([m], "<u4")]
                last = k
            out[i] = np.concatenate([*x, flat[to[last] : to[bounds[i + 1]]]])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text of the ids, special tokens included."""
        i = ids.astype(np.int64)
        size = self.piece_len[i]
        ends = np.cumsum(size)
        if not len(i) or not ends[-1]:
            return b""
        where = np.arange(ends[-1]) + np.repeat(self.piece_at[i] - (ends - size), size)
        return self.flat[where].tobytes().decode("utf-8", "replace").encode()


@lru_cache(2)
def _codec(text: str) -> Codec:
    return Codec(text)


def _runs(docs: DataFrame, vocabulary: str, make, fields: list[tuple[str, pa.DataType]], schema: str, carried: tuple[str, ...] = ()) -> DataFrame:
    with open(vocabulary, encoding="utf-8") as f:  # some MB, whatever the documents
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        codec = _codec(spec.value)
        for b in pieces(batches):
            if b.num_rows:
                texts = [t or "" for t in b.column(1).to_pylist()]
                columns = make(codec, texts)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)), *b.columns[2:]], ["doc_id", *(n for n, _ in fields), *carried])

    kept = docs.select("doc_id", "text", *carried)
    return map_arrow(kept, run, ", ".join([f"doc_id {kept.schema['doc_id'].dataType.simpleString()}", schema, *(f"{c} {kept.schema[c].dataType.simpleString()}" for c in carried)]))


def encode(docs: DataFrame, vocabulary: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids (array<int>) and text, which is decoded from the ids, for every
    row of docs. vocabulary: path of a byte-level BPE file of the tokenizers
    library, read by the driver. Null or empty text: no ids and an empty text.
    Strings of special tokens in a text become their ids. Rows are independent and
    keep their order: no shuffle; a worker remembers a bounded number of words.
    The columns carried come with their rows."""

    def make(codec, texts):
        ids = codec.encode(texts)
        return [i.astype(np.int32) for i in ids], [codec.decode(i).decode() for i in ids]

    return _runs(docs, vocabulary, make, [("ids", pa.list_(pa.int32())), ("text", pa.string())], "ids array<int>, text string", carried)


def encode_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what encode() gives; the
    ids and texts stay in the worker."""

    def make(codec, texts):
        ids = codec.encode(texts)
        return [len(i) for i in ids], [hashlib.sha256(i.tobytes()).hexdigest() for i in ids], [hashlib.sha256(codec.decode(i)).hexdigest() for i in ids]

    return _runs(docs, vocabulary, make, [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())], "n_tokens long, ids_sha256 string, decoded_sha256 string")
