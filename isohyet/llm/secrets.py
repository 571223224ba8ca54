"""Secrets: all rules in one automaton over bytes.

The rules' regular expressions, reversed, become one automaton by subset construction,
which is minimised and laid out as a transition array over classes of bytes. One pass over
a text from its end tells for every place which rules have a match that starts there; the
leftmost of them is then followed to its longest end in the rule's own array. So matches
are leftmost, longest and do not overlap within a kind, and no rule is tried at places
where it can't match."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from isohyet.shipping import map_arrow


@dataclass(frozen=True)
class Rule:
    """kind, the expression (of bytes: literals, classes, groups, |, ?, *, +, {}) and what
    a match must fulfil beside it."""

    kind: str
    pattern: str
    check: Callable[[bytes], bool] | None = None


def _any_case(words: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words)


_VALUE = r"[A-Za-z0-9+/_.=-]+"
_ASSIGN = rf"""({_any_case("password|passwd|secret|token|api_?key")})["']?\x20*[:=]\x20*["']?({_VALUE})"""
_assign = re.compile(_ASSIGN.encode())

#: The base kinds come first, in the order they are listed. A failing match of assign takes
#: up its place, so its length is checked after it; of access and hex, whose matches are
#: whole runs of a class, the least length can stand in the expression.
RULES = (
    Rule("assign", _ASSIGN, lambda m: len(_assign.fullmatch(m)[2]) >= 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("private_key", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", lambda m: len(m) >= 40),
    Rule("prefixed", r"(gh[oprsu]_|glpat-|xox[abprs]-|sk_live_)[A-Za-z0-9_-]+", lambda m: len(m) >= 20),
)
BASE = ("assign", "access", "hex")


# -- expressions to automata --------------------------------------------------


class Nfa:
    """States with edges on sets of bytes and empty edges."""

    def __init__(self):
        self.edges: list[list[tuple[int, int]]] = []  # of each state: set of bytes as bits, target
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, parsed: Iterable, start: int, back: bool) -> int:
        """Append what the parsed expression says (from its end if back); the last state."""
        items = list(parsed)
        for op, arg in reversed(items) if back else items:
            start = self._item(op, arg, start, back)
        return start

    def _item(self, op, arg, start: int, back: bool) -> int:
        if op in (sre.LITERAL, sre.NOT_LITERAL, sre.IN):
            end = self.state()
            self.edges[start].append((_bytes_of(op, arg), end))
            return end
        if op is sre.SUBPATTERN:
            return self.add(arg[3], start, back)
        if op is sre.BRANCH:
            end = self.state()
            for way in arg[1]:
                self.empty[self.add(way, start if len(arg[1]) == 1 else self._from(start), back)].append(end)
            return end
        if op is sre.MAX_REPEAT:
            least, most, inner = arg
            for _ in range(least):
                start = self.add(inner, start, back)
            if most is sre.MAXREPEAT:
                loop = self._from(start)
                self.empty[self.add(inner, loop, back)].append(loop)
                return self._from(loop)
            end = self.state()
            self.empty[start].append(end)
            for _ in range(most - least):
                start = self.add(inner, start, back)
                self.empty[start].append(end)
            return end
        raise ValueError(f"{op} can't be in a rule")

    def _from(self, state: int) -> int:
        new = self.state()
        self.empty[state].append(new)
        return new

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def _bytes_of(op, arg) -> int:
    """A set of bytes as the bits of a number."""
    if op is sre.LITERAL:
        return 1 << arg
    every = (1 << 256) - 1
    if op is sre.NOT_LITERAL:
        return every & ~(1 << arg)
    bits, negate = 0, False
    for kind, v in arg:
        if kind is sre.NEGATE:
            negate = True
        elif kind is sre.LITERAL:
            bits |= 1 << v
        elif kind is sre.RANGE:
            bits |= (1 << (v[1] + 1)) - (1 << v[0])
        else:
            raise ValueError(f"{kind} can't be in a class of a rule")
    return every & ~bits if negate else bits


class Automaton:
    """A minimal automaton: classes (256 bytes to their class), width (classes), table
    (state * width + class to the next state times width) and accept (of each state, the
    rules as bits). State 0 is dead or, where it searches, the start."""

    def __init__(self, patterns: list[str], back: bool, search: bool):
        nfa = Nfa()
        begin, ends = nfa.state(), {}
        for i, p in enumerate(patterns):
            ends[nfa.add(_parser.parse(p), nfa._from(begin), back)] = 1 << i
        sets = sorted({b for e in nfa.edges for b, _ in e})
        belongs = [tuple(b >> c & 1 for b in sets) for c in range(256)]
        kinds = {k: i for i, k in enumerate(dict.fromkeys(belongs))}
        self.classes = bytes(kinds[k] for k in belongs)
        member = {b: [kinds[k] for k in kinds if k[j]] for j, b in enumerate(sets)}
        first = nfa.closure([begin])
        table, accept = self._subsets(nfa, first, ends, member, len(kinds), search)
        self.width = len(kinds)
        self._minimise(table, accept)

    @staticmethod
    def _subsets(nfa: Nfa, first: frozenset, ends: dict, member: dict, width: int, search: bool) -> tuple[np.ndarray, np.ndarray]:
        zero = first if search else frozenset()
        number, todo, rows = {zero: 0}, [zero], []
        if not search:
            number[first] = 1
            todo.append(first)
        for states in todo:
            reach: list[set[int]] = [set(first) if search else set() for _ in range(width)]
            for s in states:
                for b, t in nfa.edges[s]:
                    for c in member[b]:
                        reach[c].add(t)
            row = []
            for r in reach:
                to = nfa.closure(r)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            rows.append(row)
        accept = [0] * len(number)
        for states, i in number.items():
            for s in states:
                accept[i] |= ends.get(s, 0)
        return np.array(rows), np.array(accept)

    def _minimise(self, table: np.ndarray, accept: np.ndarray) -> None:
        """Classes of states by what they accept, refined until all of a class go to the
        same classes; numbered so that those that accept nothing come first."""
        _, of = np.unique(accept, return_inverse=True)
        while True:
            _, new = np.unique(np.column_stack([of, of[table]]), axis=0, return_inverse=True)
            new = new.ravel()
            if new.max() == of.max():
                break
            of = new
        _, some = np.unique(of, return_index=True)
        key = np.lexsort((some != some[of[0]], accept[some] > 0))  # state 0 stays the first
        rank = np.empty(len(key), int)
        rank[key] = np.arange(len(key))
        some = some[key]
        self.start = int(rank[of[min(1, len(of) - 1)]]) * self.width  # where not searching
        self.table = (rank[of[table[some]]] * self.width).ravel().tolist()
        self.accept = accept[some].tolist()
        self.quiet = int((accept[some] == 0).sum()) * self.width  # states from here on accept


class Scanner:
    """All rules over one text after the other."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.starts = Automaton([r.pattern for r in rules], back=True, search=True)
        self.longest = [Automaton([r.pattern], back=False, search=False) for r in rules]

    def places(self, data: bytes) -> list[tuple[int, int]]:
        """(place, rules as bits) from the end of the text on: at and before the place,
        down to the next one listed, matches of these rules start."""
        a = self.starts
        table, accept, quiet, width = a.table, a.accept, a.quiet, a.width
        out, state, on, at = [], 0, 0, len(data)
        for c in data.translate(a.classes)[::-1]:
            state = table[state + c]
            at -= 1
            if state >= quiet or on:
                now = accept[state // width]
                if now != on:
                    out.append((at, now))
                    on = now
        if on:
            out.append((-1, 0))
        return out

    def find(self, data: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) in bytes, by start and then by the order of the rules."""
        places = self.places(data)
        if not places:
            return []
        found = []
        for i, rule in enumerate(self.rules):
            done, high = 0, None
            runs = []  # first and last start of runs of starts, from the right
            for at, now in places:
                if now >> i & 1:
                    high = at if high is None else high
                elif high is not None:
                    runs.append((at + 1, high))
                    high = None
            for low, high in reversed(runs):
                at = max(low, done)
                while at <= high:
                    done = self.end(i, data, at)
                    if rule.check is None or rule.check(data[at:done]):
                        found.append((at, i, done))
                    at = max(at + 1, done)
        return [(self.rules[i].kind, s, e) for s, i, e in sorted(found)]

    def end(self, i: int, data: bytes, at: int) -> int:
        """Where the longest match of a rule that starts here ends."""
        a = self.longest[i]
        table, classes, quiet, state, last = a.table, a.classes, a.quiet, a.start, at
        for at in range(at, len(data)):  # noqa: B020
            state = table[state + classes[data[at]]]
            if state >= quiet:
                last = at + 1
            elif state == 0:
                break
        return last


_own: list[Scanner] = []


def scanner() -> Scanner:
    """The scanner of RULES, made once in a process."""
    if not _own:
        _own.append(Scanner())
    return _own[0]


def code_points(data: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans in bytes as spans in code points."""
    if not spans or data.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [(k, int(before[s]), int(before[e])) for k, s, e in spans]


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) by start and then by the order of
    RULES, in code points, the end exclusive, for every row of docs.

    Of each kind matches are leftmost, longest and do not overlap; those that fail a
    rule's check are dropped. Letters of A-Z only have two cases. Null or empty text: no
    spans. Repeated rows each give a row. Other columns are ignored. Rows are independent:
    no shuffle."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        scan = scanner()
        for b in batches:
            out = []
            for data in b.column(1).cast(pa.large_binary()).to_pylist():
                data = data or b""
                out.append([{"kind": k, "start": s, "end": e} for k, s, e in code_points(data, scan.find(data))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    kept = docs.select("doc_id", "text")
    return map_arrow(kept, run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>")


def mask_secrets(docs: DataFrame) -> DataFrame:
    """docs with every secret in text replaced by its kind in brackets; of spans that
    overlap, one mark for all, with the kind of the first. Null text stays null. All rows
    and columns stay."""

    def run(batches):
        scan = scanner()
        for b in batches:
            at = b.schema.get_field_index("text")
            texts = []
            for data in b.column(at).cast(pa.large_binary()).to_pylist():
                texts.append(data if data is None else masked(data, scan.find(data)))
            arrays = list(b.columns)
            arrays[at] = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=b.schema)

    return map_arrow(docs, run, docs.schema)


def masked(data: bytes, spans: list[tuple[str, int, int]]) -> bytes:
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            out += [data[at:s], f"[{kind.upper()}]".encode()]
        at = max(at, e)
    return b"".join(out) + data[at:]
