"""Personal data: anchors found by an Aho-Corasick automaton, expanded and checked
by local parsers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from isohyet.shipping import map_arrow

#: Kinds of spans, in the order they are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "account", "secret", "login")
#: Cues of account numbers and of secrets, lower case.
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "cuenta", "compte")
SECRET_CUES = ("token", "api_key", "apikey", "secret", "password", "passwd")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){3,8}")
_NUMBER = re.compile(r"[ \t]*(?:no\.?|nr\.?|number|#)?[ \t]*[:=]?[ \t]*([0-9](?:[ -]?[0-9]){5,19})(?![0-9])", re.I)
_SECRET = re.compile(r"[\"']?[ \t]*[:=][ \t]*[\"']?([A-Za-z0-9_/+.-]{16,})")
_LOGIN = re.compile(r"://([^\s/@:]+:[^\s/@]+)@")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for c in digits[-2::-2])
    return total % 10 == 0


def iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    for kind, cues in (("at", ("@",)), ("plus", ("+",)), ("scheme", ("://",)), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for c in cues:
            for form in {c, c.upper(), c.capitalize()}:
                a.add_word(form, (kind, len(c)))
    a.make_automaton()
    return a


_cues: list[ahocorasick.Automaton] = []


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by kind and start.

    The base kinds are leftmost and do not overlap within a kind. A run of digits
    is an anchor at its first digit: no later one in the run could begin a match
    that the first cannot."""
    if not _cues:
        _cues.append(_automaton())
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    end = dict.fromkeys(("email", "ip", "card", "account"), 0)
    run = -2  # the last digit seen
    for at, (cue, size) in _cues[0].iter(text):
        if cue == "digit":
            if at == run + 1:
                run = at
                continue
            run = at
            if at >= end["ip"] and (m := _IP.match(text, at)):
                end["ip"] = m.end()
                if all(len(g) <= 3 and int(g or 0) <= 255 for g in (x.lstrip("0") for x in m.groups())):
                    found["ip"].append(m.span())
            if at >= end["card"] and (m := _CARD.match(text, at)):
                end["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        elif cue == "at":
            start = at
            while start > end["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at)):
                found["email"].append((start, m.end()))
                end["email"] = m.end()
        elif cue == "plus":
            if (m := _PHONE.match(text, at)) and 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found["phone"].append(m.span())
        elif cue == "scheme":
            if m := _LOGIN.match(text, at - size + 1):
                found["login"].append(m.span(1))
        elif cue == "account" and at >= end["account"]:
            m = _NUMBER.match(text, at + 1)
            span = m.span(1) if m else next((x.span() for x in _IBAN.finditer(text, at + 1, at + 60) if iban(x[0])), None)
            if span:
                found["account"].append(span)
                end["account"] = span[1]
        elif cue == "secret":
            if (m := _SECRET.match(text, at + 1)) and any(c.isdigit() for c in m[1]) and (not found["secret"] or m.start(1) >= found["secret"][-1][1]):
                found["secret"].append(m.span(1))
    return [(k, s, e) for k in KINDS for s, e in found[k]]


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by its kind in brackets; of spans that
    overlap, one mark for all, with the kind of the first."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def _strings(batch: pa.RecordBatch, name: str) -> Iterator[str]:
    return (x.as_py() or "" for x in batch.column(batch.schema.get_field_index(name)))


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end), for every row of docs.
    Null or empty text: no spans. Repeated rows each give a row. Other columns
    are ignored. Rows are independent: no shuffle."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] if t else [] for t in _strings(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    kept = docs.select("doc_id", "text")
    return map_arrow(kept, run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>")


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets; n_chars, if
    there is one, counts the new text. Null text stays null. All rows and columns stay."""
    columns, schema = docs.columns, docs.schema
    has_count = "n_chars" in columns

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            texts = [redact(t, find(t)) if t else t for t in b.column(at).to_pylist()]
            arrays = list(b.columns)
            arrays[at] = pa.array(texts, b.schema.field(at).type)
            if has_count:
                i = b.schema.get_field_index("n_chars")
                arrays[i] = pa.array([o if t is None else len(t) for o, t in zip(b.column(i).to_pylist(), texts, strict=True)], b.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=b.schema)

    return map_arrow(docs, run, schema).select(columns)
