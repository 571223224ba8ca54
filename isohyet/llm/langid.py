"""Language identification by cross-parsing against suffix automata."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import pieces, table, text_bytes
from isohyet.shipping import map_arrow

UNDETERMINED = "und"
#: A text is parsed in pieces of so many bytes side by side; the parse of a piece goes
#: on into the next until both begin a phrase at the same place, so the phrases are
#: those of one parse from the start.
PIECE = 256
#: Languages whose models a worker holds at once; more are gone through in groups.
GROUP = 32

_LETTER = np.zeros(256, bool)
_LETTER[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)] = True
_LETTER[128:] = True  # bytes of other letters; they are learned as they are


def sample(docs: DataFrame, texts: int = 48, chars: int = 400) -> dict[str, bytes]:
    """The labelled sample that models are made of: per lang at most so many texts,
    of each its first so many characters. The bound is texts * chars a language, of
    which there are as many as lang has values. Texts are taken by a hash of doc_id:
    the least in each of `texts` classes (of rows with one doc_id the least text), so
    the choice is the same at every size and costs one grouped minimum. Rows without
    lang, text or doc_id are not learned from."""
    h = F.xxhash64(F.col("doc_id").cast("string"))
    rows = docs.where("lang is not null and text is not null and doc_id is not null").select(F.col("lang").cast("string").alias("lang"), F.substring("text", 1, chars).alias("t"), h.alias("h"))
    picks = rows.groupBy("lang", F.pmod("h", F.lit(texts)).alias("k")).agg(F.min(F.struct("h", "t")).alias("x")).select("lang", "x.h", "x.t")
    out: dict[str, list[tuple[int, str]]] = {}
    for lang, key, text in picks.collect():
        out.setdefault(lang, []).append((key, text))
    return {lang: b"\x00".join(normalise(pa.array([t for _, t in sorted(out[lang])]), True)) for lang in sorted(out)}


def normalise(texts: pa.Array, split: bool = False):
    """Lower case, each run of other ASCII than letters one space, none at the start.
    The bytes of all texts and their offsets, or with split a list of bytes."""
    data, offsets = text_bytes(pc.utf8_lower(texts))
    data = np.where(_LETTER[data], data, np.uint8(32))
    space = data == 32
    before = np.empty(len(data), bool)
    before[1:] = space[:-1]
    starts = offsets[:-1]
    before[starts[starts < len(data)]] = True
    keep = ~(space & before)
    total = np.concatenate([[0], np.cumsum(keep)])
    data, offsets = data[keep], total[offsets]
    return [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] if split else (data, offsets)


def automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of text; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Models:
    """Per language a table over (state, symbol): where the parse goes on, and how
    many phrases end there. Symbol 1 is a byte not learned."""

    def __init__(self, samples: dict[str, bytes]):
        self.names = sorted(samples)
        seen = sorted(set().union(*samples.values()) - {0}) if samples else []
        self.symbol = np.ones(256, np.int64)
        self.symbol[seen] = np.arange(2, len(seen) + 2)
        width = len(seen) + 2
        self.tables, self.weights = [], []
        for name in self.names:
            step = automaton(samples[name])
            root = np.zeros(width, np.int64)
            root[1] = 1  # alone, as a phrase
            for c, q in step[0].items():
                if c:
                    root[self.symbol[c]] = (q * width) << 2
            root[2:][root[2:] == 0] = 1
            t = np.tile(root + 1, (len(step), 1))  # a phrase ends, the symbol begins the next
            t[0] = root
            t[1:, 0], t[0, 0] = 1, 0
            for s, row in enumerate(step):
                for c, q in row.items():
                    if c:
                        t[s, self.symbol[c]] = (q * width) << 2
            self.tables.append(t.ravel().astype(np.int32))
            self.weights.append(math.log2(max(2, len(samples[name]))))

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text, the phrases of its parse in each language."""
        sizes = np.diff(offsets)
        n_pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(sizes)), n_pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
        at = np.repeat(offsets[:-1], n_pieces) + nth * PIECE
        left = np.minimum(PIECE, np.repeat(offsets[1:], n_pieces) - at)
        steps = np.arange(PIECE)[:, None]
        inside = steps < left[None, :]
        symbols = self.symbol[data[np.minimum(at[None, :] + steps, len(data) - 1)]] if len(data) else np.zeros((PIECE, 0), np.int64)
        goes_on = np.flatnonzero(owner[:-1] == owner[1:])
        out = np.zeros((len(sizes), len(self.names)), np.int64)
        for k, table in enumerate(self.tables):
            state = np.zeros(len(owner), np.int64)
            begins = np.zeros((PIECE, len(owner)), bool)  # a phrase begins here
            for j, row in enumerate(symbols):
                v = table[state + row]
                begins[j] = (state == 0) | (v & 3 > 0)
                state = v >> 2
            begins &= inside
            extra, met = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
            live, state = goes_on, state[goes_on]
            for j in range(PIECE):
                if not len(live):
                    break
                to = live + 1
                v = table[state + symbols[j, to]]
                here = ((state == 0) | (v & 3 > 0)) & inside[j, to]
                hit = here & begins[j, to]
                extra[live] += here & ~hit
                met[to] = j + 1
                met[to[hit]] = j
                more = ~hit & inside[j, to]
                live, state = live[more], v[more] >> 2
            count = (begins & (steps >= met[None, :])).sum(0) + extra
            out[:, k] = np.bincount(owner, count, len(sizes))
            for t in np.unique(owner[live[met[live + 1] == PIECE]]).tolist():  # parses that do not meet within a piece
                out[t, k] = self.one_by_one(table, data[offsets[t] : offsets[t + 1]])
        return out

    def one_by_one(self, table: np.ndarray, text: np.ndarray) -> int:
        """The phrases of one text, symbol after symbol."""
        step, state, n = memoryview(table), 0, 0
        for x in self.symbol[text].tolist():
            v = step[state + x]
            n += not state or v & 3 > 0
            state = v >> 2
        return n


@lru_cache(1)
def _models(samples: tuple[tuple[str, bytes], ...]) -> Models:
    return Models(dict(samples))


def identify(docs: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred and score for every row of docs, from text alone.

    The language whose automaton needs the fewest phrases for the text, each counted
    with the logarithm of the sample's size (the Ziv-Merhav estimate of cross
    entropy); of equal ones the first by name. score: 1 less the ratio of the least
    to the second least, so 0 for a tie; 1 with a single language. Null text, text
    without a letter, or no language learned: und with score 0. Rows are
    independent, repeated ones each give a row, other columns are ignored."""
    spark = docs.sparkSession
    names = sorted(samples)
    kept = docs.select("doc_id", "text")
    kind = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, "
    best = "least double, second double, lang_pred string"
    lots = [names[i : i + GROUP] for i in range(0, len(names), GROUP)] or [[]]
    rows = kept.select("*", F.lit(math.inf).alias("least"), F.lit(math.inf).alias("second"), F.lit(None).cast("string").alias("lang_pred"))
    for i, lot in enumerate(lots):
        sent = spark.sparkContext.broadcast(tuple((name, samples[name]) for name in lot))
        rows = map_arrow(rows, _compare(sent), f"{kind}text string, {best}")
        if i + 1 < len(lots):
            rows = table(rows, "languages")
    known = F.col("lang_pred").isNotNull() & F.col("text").rlike(r"\p{L}")
    score = F.when(F.lit(len(names) == 1), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("least") / F.greatest(F.col("second"), F.lit(1e-9))))
    return rows.select("doc_id", F.when(known, F.col("lang_pred")).otherwise(UNDETERMINED).alias("lang_pred"), F.when(known, score).otherwise(0.0).alias("score"))


def _compare(sent):
    """Of doc_id, text, least, second and lang_pred so far, with the languages sent."""

    def run(batches):
        m = _models(sent.value)
        for b in pieces(batches, most=1 << 20):
            least, second = b.column(2).to_numpy().copy(), b.column(3).to_numpy().copy()
            pred = np.array(b.column(4).to_pylist(), object)
            if m.names and b.num_rows:
                cost = m.phrases(*normalise(b.column(1).fill_null(""))) * np.array(m.weights)
                for k, name in enumerate(m.names):
                    less = cost[:, k] < least
                    second = np.where(less, least, np.minimum(second, cost[:, k]))
                    pred[less] = name
                    least = np.where(less, cost[:, k], least)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(least), pa.array(second), pa.array(pred, pa.string())], ["doc_id", "text", "least", "second", "lang_pred"])

    return run
