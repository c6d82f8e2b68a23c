"""Secret scanning with an assignment-aware lexer.

Three plain patterns give the base spans. Beside them, lines that assign are
read as source or configuration: names, operators and string literals are
lexed into (name, literal) pairs; a literal may be put together from literals
and names with ``+``; a name stands for the value it was last given in the
text. Strings may have prefixes, backticks or triple quotes; the name may be a
subscript (``env["NAME"] = ...``), have a type (``name: str = ...``), be an XML
tag or attribute, or stand in a pair beside it (``name: NAME``, ``value: ...``).
Lines of configuration may give values without quotes; a word without digits is
a name there; an indented block behind ``|`` or ``>`` is the value of its key.
Of values over several lines each line is a span, armour (``-----``) aside.
A literal is scored by how sensitive the name is and by the literal's own look,
and a pair from a score of ``threshold`` on is a ``lexed`` span, at the literal
itself (for a name: where its literal stands). Base spans stay as they are; a
lexed span inside one of them is not repeated.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as T

_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "lexed")
# Parts of sensitive names, and how sensitive they are.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 2, "secret": 3, "token": 2, "apikey": 3, "api_key": 3, "accesskey": 3, "access_key": 3,
    "privatekey": 3, "private_key": 3, "credential": 2, "credentials": 2, "auth": 1, "key": 1, "bearer": 2, "signature": 1,
}
# Literals that stand for no secret.
HARMLESS = {b"changeme", b"example", b"password", b"none", b"null", b"true", b"false", b"undefined", b"your_password", b"xxxxxx", b"redacted"}
_TOKEN = re.compile(
    rb"""(?P<string>(?:[bBrRfFuUL]{1,2}|[@$])?(?:\"{3}(?s:(?:[^\\]|\\.)*?)\"{3}|'{3}(?s:(?:[^\\]|\\.)*?)'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`))"""
    rb"""|(?P<name>[A-Za-z_$][A-Za-z0-9_$.-]*)|(?P<op>:=|=>|==|!=|<=|>=|[=:+,;(){}\[\]])|(?P<end>\n)|(?P<other>[^\s])"""
)


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind number) in bytes."""
    low = data.lower()
    spans = []
    if any(w in low for w in (b"passw", b"secret", b"token", b"api")):
        spans += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(data) if len(m[2]) >= 6]
    if b"AKIA" in data:
        spans += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(data) if m.end() - m.start() >= 20]
    spans += [(m.start(), m.end(), 2) for m in _HEX.finditer(data)]
    return sorted(spans)


def entropy(counts: Counter) -> float:
    n = counts.total()
    return -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0


def name_score(name: bytes) -> int:
    parts = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.decode("ascii", "replace")).lower()
    joined = parts.replace("-", "_").replace(".", "_")
    pieces = set(joined.split("_")) | {a + "_" + b for a, b in zip(joined.split("_"), joined.split("_")[1:])} | {joined.replace("_", "")}
    return max((w for p, w in SENSITIVE.items() if p in pieces), default=0)


class Literal:
    """A value as the counts of its bytes and a tree of the byte spans of its
    literals: joining two costs the same however long they are."""

    __slots__ = ("counts", "short", "parts")

    def __init__(self, counts: Counter, short: bytes | None, parts: tuple):
        self.counts, self.short, self.parts = counts, short, parts

    @classmethod
    def at(cls, data: bytes, start: int, end: int) -> Literal:
        value = data[start:end]
        return cls(Counter(value), value if len(value) <= _SHORT else None, (start, end))

    @classmethod
    def lines(cls, data: bytes, start: int, end: int) -> Literal | None:
        """The lines of a value as one literal, without their indentation and
        without armour; None if nothing is left."""
        value = None
        for m in _LINE.finditer(data, start, end):
            if not m[0].startswith(b"-----"):
                one = cls.at(data, m.start(), m.end())
                value = one if value is None else value + one
        return value

    def __add__(self, other: Literal) -> Literal:
        short = None if self.short is None or other.short is None else self.short + other.short
        return Literal(self.counts + other.counts, short if short is None or len(short) <= _SHORT else None, (self, other))


_SHORT = max(map(len, HARMLESS))
_TRIPLE = re.compile(rb"\"{3}|'{3}")
_LINE = re.compile(rb"[^\s](?:[^\n]*[^\s])?")


def literal_score(value: Literal) -> int:
    """0 to 3, and 4 for a strong one: letters and digits in high disorder."""
    counts = value.counts
    n = counts.total()
    if n < 6 or (value.short is not None and value.short.lower() in HARMLESS) or 32 in counts or len(counts) < 4:
        return 0
    kinds = {0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 for c in counts}
    disorder = entropy(counts)
    # A short literal cannot reach 3.0 with all its bytes different but a few.
    high = disorder >= 3.0 or (len(kinds) >= 3 and disorder >= 0.85 * math.log2(n))
    strong = 2 in kinds and bool({0, 1} & kinds) and disorder >= (3.0 if len(kinds) >= 3 else 3.5)
    return 1 + high + (len(kinds) >= 2) + strong


# Values without quotes in lines of configuration: NAME=value, export NAME=value, - name: value.
_BARE = re.compile(rb"""^[ \t]*+(?:-[ \t]++)?(?:(?:export|set|env)[ \t]++)?([A-Za-z_$][A-Za-z0-9_$.-]*+)[ \t]*+(?::=|=>|=|:)[ \t]*+([^\s"'`(){}\[\]<>,;#$=:][^\s"'`(){}\[\]<>,;#$]*+)[ \t]*+[,;]?[ \t]*+(?:(?:\#|//)[^\n]*+)?\r?$""", re.M | re.I)
# What stands for another name and not for a value: words without digits, and attributes.
_REFERENCE = re.compile(rb"[A-Za-z_]+|[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+")
_NAME = re.compile(rb"[A-Za-z_$][A-Za-z0-9_$.-]*")
_SIGNS = (b"=", b":", b":=", b"=>")
# The first line of an indented block: name: |
_BLOCK = re.compile(rb"^([ \t]*+)(?:-[ \t]++)?[\"']?([A-Za-z_$][A-Za-z0-9_$.-]*+)[\"']?[ \t]*+:[ \t]*+[|>][0-9+-]*+[ \t]*+(?:\#[^\n]*+)?\r?\n", re.M)
_ELEMENT = re.compile(rb"<([A-Za-z_][A-Za-z0-9_.-]*+)(?:[ \t][^<>\n]*+)?>\s*+([^<>\s]++)\s*+</([A-Za-z0-9_.-]++)>")
# Names of the two halves of a pair: name: NAME, value: VALUE.
_LABELS, _VALUES = (b"name", b"key", b"id"), (b"value",)


def _inside(text: bytes, start: int) -> tuple[int, int]:
    """Where the content of a string token lies that starts at ``start``."""
    quote = min(i for i in (text.find(q) for q in (b'"', b"'", b"`")) if i >= 0)
    width = 3 if text[quote : quote + 3] in (b'"""', b"'''") and len(text) >= quote + 6 else 1
    return start + quote + width, start + len(text) - width


def _placed(data: bytes):
    """(name, value) of indented blocks and of XML elements."""
    end = 0
    while (b"|" in data or b">" in data) and (m := _BLOCK.search(data, end)):
        end = at = m.end()
        while at < len(data):
            stop = data.find(b"\n", at) + 1 or len(data)
            line = data[at:stop]
            if line.strip():
                if len(line) - len(line.lstrip(b" \t")) <= len(m[1]):
                    break
                end = stop
            at = stop
        if (value := Literal.lines(data, m.end(), end)) is not None:
            yield m[2], value
    for m in _ELEMENT.finditer(data) if b"</" in data else ():
        if m[1] == m[3]:
            yield m[1], Literal.at(data, *m.span(2))


def assignments(data: bytes):
    """(name, value) of each literal that is assigned. Reads the tokens of a
    text from left to right, once. A value may go on in the next line after a
    sign, a plus or a backslash, before a plus, and inside brackets, where
    literals next to each other are one and commas part them."""
    known: dict[bytes, Literal] = {}
    bare = {m.start(1): m.span(2) for m in _BARE.finditer(data) if not _REFERENCE.fullmatch(m[2])}
    tokens = [(m.lastgroup, m[0], m.start(), m.end()) for line in _assigning(data) for m in _TOKEN.finditer(data, *line)]
    i, n, label = 0, len(tokens), None
    while i < n:
        kind, text, at, _ = tokens[i]
        name = text if kind == "name" else data[slice(*_inside(text, at))] if kind == "string" else None
        # A subscript's name stands between brackets, and its sign behind them.
        sign = i + 1 + (kind == "string" and i > 0 and tokens[i - 1][1] == b"[" and i + 1 < n and tokens[i + 1][1] == b"]")
        if name is None or sign >= n or tokens[sign][1] not in _SIGNS or not _NAME.fullmatch(name):
            i += 1
            continue
        i = sign + 1
        if tokens[sign][1] == b":" and i + 1 < n and tokens[i][0] == "name" and tokens[i + 1][1] == b"=":
            i += 2  # a type
        if name.lower() in _LABELS and i < n and tokens[i][0] in ("name", "string"):
            label = tokens[i][1] if tokens[i][0] == "name" else data[slice(*_inside(tokens[i][1], tokens[i][2]))]
        elif name.lower() in _VALUES and label is not None:
            name, label = label, None
        value, wanted, depth, line = None, True, 0, True
        while i < n:
            kind, text, start, end = tokens[i]
            literal = None
            if kind == "string" and (wanted or depth):
                if not (line and depth == 0) and i + 1 < n and tokens[i + 1][1] in _SIGNS:
                    break  # the name of another pair
                inner = _inside(text, start)
                literal = (Literal.lines(data, *inner) if b"\n" in text else None) or Literal.at(data, *inner)
            elif kind == "name" and wanted and text in known:
                literal = known[text]
            if literal is not None:
                value, wanted = literal if value is None else value + literal, False
            elif text == b"+" and not wanted:
                wanted = True
            elif text in (b"(", b"[") and wanted:
                depth += 1
            elif text in (b")", b"]") and depth:
                depth -= 1
            elif text == b"," and depth and value is not None:
                yield name, value
                found, value, wanted = True, None, True
            elif kind == "end" and (depth or wanted or (i + 1 < n and tokens[i + 1][1] == b"+")):
                line = False
            elif not (text == b"\\" and i + 1 < n and tokens[i + 1][0] == "end"):
                break
            else:
                i += 1  # a backslash and the line's end
                line = False
            i += 1
        if value is None and at in bare:
            value = Literal.at(data, *bare[at])
        if value is not None:
            known[name] = value
            yield name, value


def _assigning(data: bytes):
    """Byte ranges of the lines with an assignment sign, and of the lines that
    go on from them. A string in triple quotes goes on to its end."""
    start, open_, covered = 0, False, 0
    for line in data.split(b"\n"):
        bare = line.strip()
        if start < covered:  # inside a string of the range before
            start += len(line) + 1
            continue
        if b"=" in line or b":" in line or (open_ and (not bare or last in b"=:+([\\," or bare[:1] in b"+'\")]")):
            covered = max(_closed(data, line, start), start + len(line) + 1)
            yield start, min(len(data), covered)
            open_, last = True, bare[-1:] or (last if open_ else b"=")
        else:
            open_ = False
        start += len(line) + 1


def _closed(data: bytes, line: bytes, start: int) -> int:
    """The end of the line in which triple quotes opened in ``line`` are
    closed, or 0 if an empty line comes first."""
    opened, at = None, 0
    for m in _TRIPLE.finditer(line):
        opened, at = (m[0], m.end()) if opened is None else (None, 0) if m[0] == opened else (opened, at)
    if opened is None:
        return 0
    close = data.find(opened, start + at)
    if close < 0 or data.find(b"\n\n", start + at, close) >= 0:
        return 0
    return data.find(b"\n", close) + 1 or len(data)


def lexed_spans(data: bytes, threshold: int) -> set[tuple[int, int]]:
    out, seen = set(), set()
    held = []  # keeps the trees, so that an id stays one tree's
    for name, value in chain(assignments(data), _placed(data)):
        sensitive = name_score(name)
        if sensitive and (own := literal_score(value)) and sensitive + own >= threshold:
            held.append(value)
            todo = [value]
            while todo:
                one = todo.pop()
                if id(one) in seen:
                    continue
                seen.add(id(one))
                if isinstance(one.parts[0], Literal):
                    todo.extend(one.parts)
                elif one.parts[1] > one.parts[0]:
                    out.add(one.parts)
    return out


def spans(data: bytes, threshold: int = 5) -> list[tuple[int, int, int]]:
    """Base and lexed spans in code points, by start and then kind."""
    base = base_spans(data)
    extra = []
    if b"=" in data or b":" in data or b"</" in data:
        starts, reach = [b for b, _, _ in base], [0, *accumulate((f for _, f, _ in base), max)]
        extra = [(s, e, 3) for s, e in lexed_spans(data, threshold) if reach[bisect_right(starts, s)] < e]
    found = sorted([*base, *extra], key=lambda x: (x[0], x[2], x[1]))
    if not found or data.isascii():
        return found
    places, at, points = {}, 0, 0
    for p in sorted({x for s, e, _ in found for x in (s, e)}):
        points += sum((b & 0xC0) != 0x80 for b in data[at:p])
        places[p], at = points, p
    return [(places[s], places[e], k) for s, e, k in found]


_KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, threshold: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id and spans, an array of (kind, start,
    end) by start and then kind in the order of ``KINDS``, in code points, ends
    exclusive. A null text counts as empty. Overlapping spans of different
    kinds are all given. ``threshold``: sensitivity of the name (1 to 3) and
    look of the literal (1 to 4) must add up to it.
    """

    def run(batches):
        for batch in batches:
            for block in T.blocks(batch.column(batch.schema.get_field_index("text"))):
                found = [[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in spans(block.text(i), threshold)] for i in range(len(block))]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")).slice(block.first, len(block)), pa.array(found, _KIND)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def redact(docs: DataFrame, mask: str = "[secret]", threshold: int = 5) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mask``; spans that
    overlap are replaced as one. Null texts stay null."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            for i, text in enumerate(texts):
                merged = []
                for s, e, _ in spans(text.encode(), threshold) if text else []:
                    if merged and s < merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                for s, e in reversed(merged):
                    text = text[:s] + mask + text[e:]
                texts[i] = text
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
