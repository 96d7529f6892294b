"""Secret scans by assignment-aware lexing.

Every text is scanned for three base kinds (see ``BASE_KINDS``). Beyond those, texts that
hold a sensitive word are lexed as source or configuration, in one pass whose time
is linear in the text: names, literals, operators, brackets and tags, on any line and in
comments too. This yields pairs of a name and a value: assignments (with types, indices, keys of
mappings and indented keys), elements of lists, arguments of calls, attributes and XML elements.
Constants are propagated: a name assigned another name takes that one's literal, set
before or after, and joined literals count as one value. A pair is scored by how sensitive
its target name (or what the name stands in) is and by the value's length, character classes and
entropy; pairs that score enough give a span of kind ``named`` over each literal the
value is made of, wherever that stands, unless a base span covers it. So masking all
spans leaves no propagated secret, and masks no name.

Defined results: a null text counts as empty; offsets are code points, end
exclusive; rows are judged one by one, so repeated rows and ids get equal
results; texts are never cut; values joined from several literals count up to ``LONGEST`` characters; an empty table gives an empty result; extra columns
of the input are kept by ``redact`` and left alone by ``scan``.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantide.llm.common import table

# The base kinds' patterns and least lengths, as the query's contract states them.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_VALUE = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "named")

#: parts of names (split at case changes and non-letters) and how sensitive they are
SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 2, "apikey": 3, "credential": 3, "credentials": 3, "auth": 2, "bearer": 2, "private": 1, "access": 1, "api": 1, "key": 1, "signing": 1, "encryption": 1, "client": 0, "session": 1, "salt": 1, "dsn": 2, "webhook": 1}
LEAST_SCORE = 5.0
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|<.*>|\$\{.*\}|%.*%|\{\{.*\}\}|none|null|true|false|changeme|example|your[-_ ].*|todo|redacted)$")

#: addresses without a user
PLAIN_URL = re.compile(r"(?i)^[a-z+]*:?//[^@]*$")
#: a name is taken as code and configuration write it, dots and dashes included
_TOKEN = re.compile(
    r"""(?P<space>[^\S\n]+|\\\n|\\.)|(?P<name>[A-Za-z_$][\w$]*(?:[.\-][A-Za-z_$][\w$]*)*)"""
    r"""|(?P<triple>\"{3}|'{3})|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`[^`\n]*`)"""
    r"""|(?P<op>:=|=>|[-=!<>~]=+|=~|->|::|[=:])|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<sep>[,;|&?])|(?P<line>\n)|(?P<number>\d[\w.]*)|(?P<other>.)"""
)
_BARE = re.compile(r"""[^\s"'`;,(){}\[\]<>&?#|]+""")
_REFERENCE = re.compile(r"[A-Za-z_$][\w$.]*")
_TAG = re.compile(r"<([A-Za-z_][\w.:\-]*)")
_ELEMENT = re.compile(r"([^<\n]*)</")
_AFTER_LINE = re.compile(r"[^\S\n]*")
_CONTINUED = re.compile(r"(?:[^\S\n]|\\\n)*")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: types that a declaration may put between a name and its value
TYPES = frozenset("string str text char varchar bytes".split())
#: letters that stand before a string literal
PREFIXES = frozenset("f r b u fr rf br rb".split())
#: names that say what the value beside them is called, and names of such values
CALLED, VALUED = frozenset("name key id property".split()), frozenset("value content default".split())
#: beginnings of the names of calls whose arguments name a secret and don't hold one
READERS = ("get", "env", "read", "load", "fetch", "input", "find", "has", "require")
#: joined literals longer than this are no secrets
LONGEST = 1 << 12


class Lexer:
    """One pass over a text's tokens: assignments of literals and names to names, in ``found`` as (name, its context, parts, place).

    A part is ("literal", start, end) or ("name", start, end). What is in brackets belongs to the name before them: elements of
    a list and arguments of a call are values of it, keys of a mapping get it as context, as do indented keys below one that has no value.
    """

    def __init__(self, text: str):
        self.text, self.found = text, []
        # open brackets: kind, the name they belong to, context of names inside, what was being assigned outside, and the last literal, number and called name inside
        self.frames: list[dict] = []
        self.frame = self.fresh("", None, ())
        self.target: str | None = None
        self.context: tuple[str, ...] = ()
        self.parts: list[tuple[str, int, int]] = []
        self.op = ""
        self.last: str | None = None
        self.before: str | None = None
        self.path: list[tuple[int, str]] = []
        self.indent = 0
        self.tag: str | None = None
        self.plus = False
        self.run()

    @staticmethod
    def fresh(kind: str, name: str | None, context: tuple[str, ...], outside: tuple = ()) -> dict:
        return {"kind": kind, "name": name, "context": context, "outside": outside, "first": None, "called": None}

    def record(self, name: str, parts: list[tuple[str, int, int]], context: tuple[str, ...] = ()) -> None:
        self.found.append((name, context, parts, parts[0][1]))
        short = name.rsplit(".", 1)[-1].lower()
        if short in CALLED and parts[0][0] == "literal":
            self.frame["called"] = self.text[parts[0][1] : parts[0][2]]
        elif short in VALUED and self.frame["called"]:
            self.found.append((self.frame["called"], context, parts, parts[0][1]))

    def finish(self) -> None:
        if self.target is not None and self.parts:
            self.record(self.target, self.parts, self.context)
        self.target, self.parts, self.op = None, [], ""

    def forget(self) -> None:
        self.last = self.before = None

    def run(self) -> None:
        text, at, size = self.text, 0, len(self.text)
        match, triples = _TOKEN.match, {'"""': True, "'''": True}
        while at < size:
            m = match(text, at)
            kind, start, at = m.lastgroup, at, m.end()
            if kind == "space" or kind == "number":
                continue
            if kind != "line":
                self.plus = m.group() == "+"
            # the letters before a string say how it is read
            if kind == "name" and m.group().lower() in PREFIXES and text[at : at + 1] in ("'", '"'):
                continue
            if kind == "name":
                # a name after a value starts something new
                if self.target is not None and self.parts:
                    self.finish()
                self.before, self.last = self.last, m.group()
            elif kind == "triple":
                end = text.find(m.group(), at) if triples[m.group()] else -1
                if end < 0:
                    triples[m.group()] = False
                else:
                    self.string(at, end)
                    at = end + 3
            elif kind == "string":
                self.string(start + 1, at - 1)
            elif kind == "op":
                if m.group() in ("=", ":", ":=", "=>"):
                    at = self.assign(m.group(), at)
                else:
                    self.finish()
                    self.forget()
            elif kind == "line":
                self.line(at)
            elif kind == "open":
                self.open(m.group())
            elif kind == "close":
                self.close()
            elif kind == "sep":
                self.finish()
                self.forget()
            else:
                at = self.other(m.group(), start, at)
        self.finish()

    def string(self, start: int, end: int) -> None:
        frame, part = self.frame, ("literal", start, end)
        if self.target is not None:
            self.parts.append(part)
            return
        self.before, self.last = self.last, self.text[start:end]
        if frame["kind"] in ("(", "[") and frame["name"]:
            self.record(frame["name"], [part], frame["context"])
        if frame["kind"] == "(":
            # the first of two literals in a call names the second
            if frame["first"]:
                self.record(frame["first"], [part])
            frame["first"] = self.last

    def assign(self, op: str, at: int) -> int:
        if self.target is not None and op == "=" and self.op == ":":
            self.parts = []  # what stood between was the name's type
        elif self.last is None:
            self.finish()
            return at
        else:
            self.finish()
            self.target = self.before if self.before and op == "=" and self.last.lower() in TYPES else self.last
            self.context = self.frame["context"] or tuple(k for _, k in self.path[-3:])
        self.op = op
        self.forget()
        return self.bare(at)

    def bare(self, at: int) -> int:
        """Read an unquoted value, and what is added to it, from here on."""
        at = _CONTINUED.match(self.text, at).end()
        m = _BARE.match(self.text, at)
        if not m:
            return at
        value, end = m.group(), m.end()
        if value in ("new", "await"):
            return self.bare(end)
        if value.lower() in PREFIXES and self.text[end : end + 1] in ("'", '"'):
            return end
        if self.text[end : end + 1] in ("(", "["):
            self.last = value  # a call or an element: what is inside belongs to the target
            return end
        if value in ("+", "=") or value[0] in "=:+":
            return at
        pieces = value.split("+")
        if all(not p or _REFERENCE.fullmatch(p) for p in pieces):
            for p in pieces:
                if p:
                    self.parts.append(("name", at, at + len(p)))
                at += len(p) + 1
        else:
            self.parts.append(("literal", at, at + len(value.rstrip(".:!"))))
        return end

    def line(self, at: int) -> None:
        after = _AFTER_LINE.match(self.text, at).end()
        following = self.text[after : after + 1]
        if self.frame["kind"] in ("(", "["):
            return
        if self.target is not None and (following == "+" or self.plus):
            return
        if following in ("\n", ""):
            self.finish()
            self.forget()
            self.frame["called"] = None
            return
        if self.target is not None and not self.parts and self.op == ":" and not self.frames:
            self.path.append((self.indent, self.target))
        self.finish()
        self.forget()
        self.indent, self.tag = after - at, None
        while self.path and self.path[-1][0] >= self.indent:
            self.path.pop()

    def open(self, kind: str) -> None:
        name, context = self.target, self.context
        if self.last is not None and kind != "{":
            called = self.last
            if called.rsplit(".", 1)[-1].lower().startswith(READERS) or kind == "[" and name is not None:
                name = None
            elif name is None:
                name, context = called, ()
        inside = (*context[-2:], name) if kind == "{" and name else ()
        self.frames.append(self.frame)
        self.frame = self.fresh(kind, name, inside if kind == "{" else context, (self.target, self.context, self.parts, self.op, self.last))
        self.target, self.parts, self.op = None, [], ""
        self.forget()

    def close(self) -> None:
        inner, last = self.frame, self.last
        self.finish()
        self.forget()
        if not self.frames:
            return
        self.frame = self.frames.pop()
        self.target, self.context, self.parts, self.op, base = inner["outside"]
        if inner["kind"] == "[" and self.target is None and base is not None:
            # an element is named by its index as well
            self.last = f"{base}.{last}" if last else base

    def other(self, char: str, start: int, at: int) -> int:
        if char == "+":
            return self.bare(at) if self.target is not None else at
        if char == "<":
            self.finish()
            m = _TAG.match(self.text, start)
            if m:
                self.tag, at = m[1], m.end()
                self.frame["called"] = None
        elif char == ">" and self.tag:
            self.finish()
            m = _ELEMENT.match(self.text, at)
            if m and m[1].strip():
                lead = len(m[1]) - len(m[1].lstrip())
                part = ("literal", at + lead, at + len(m[1].rstrip()))
                for name in {self.tag, self.frame["called"] or self.tag}:
                    self.found.append((name, (), [part], at))
                at = m.end(1)
            self.tag = None
        elif self.target is not None and not self.parts:
            return at  # a sign before a value
        self.forget()
        return at


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each base kind, ordered by start and kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def name_parts(name: str) -> list[str]:
    return [p.lower() for p in _PART.findall(name)]


def sensitivity(name: str) -> int:
    parts = name_parts(name)
    whole = sum(SENSITIVE.get(p, SENSITIVE.get(p.removesuffix("s"), 0)) for p in parts)
    return min(4, max(whole, 3 if "".join(parts[-2:]) in ("apikey", "privatekey", "secretkey", "accesskey") else 0))


def entropy(value: str) -> float:
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) if n else 0.0


def literal_score(value: str) -> float:
    """0 for what can't be a secret; else up to 4, by length, character classes and entropy."""
    if len(value) < 8 or PLACEHOLDER.match(value) or " " in value.strip() or PLAIN_URL.match(value):
        return 0.0
    classes = sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    if classes == 1 and not re.search("[0-9]", value):
        return 0.0
    return min(1.0, len(value) / 16) + 0.5 * (classes - 1) + min(1.5, entropy(value) / 2.5)


def pairs(text: str) -> Iterator[tuple[str, tuple[str, ...], str, list[tuple[int, int]]]]:
    """(name, context, value, spans of the literals it is made of) for each assignment; constants are propagated, joined literals concatenated.

    A name stands for what was assigned to it last before, or if nothing was, first after; an unknown one is a bare literal.
    """
    found = Lexer(text).found
    places: dict[str, list[int]] = {}
    for n, (name, *_) in enumerate(found):
        places.setdefault(name, []).append(n)
    done: dict[int, tuple[str | None, list[tuple[int, int]]]] = {}

    def source(n: int, part: tuple[str, int, int]) -> int | None:
        known = places.get(text[part[1] : part[2]]) if part[0] == "name" else None
        return None if known is None else known[max(0, bisect.bisect_left(known, n) - 1)]

    for first in range(len(found)):
        todo, opened = [first], set()
        while todo:
            n = todo[-1]
            parts = found[n][2]
            needed = [k for p in parts if (k := source(n, p)) is not None and k not in done and k not in opened and k != n]
            if needed and n not in done:
                opened.add(n)
                todo += needed
                continue
            todo.pop()
            if n in done:
                continue
            value, where = "", []
            for p in parts:
                k = source(n, p)
                piece, spans_ = done[k] if k in done else (text[p[1] : p[2]], [p[1:]])
                if piece is None or value and len(value) + len(piece) > LONGEST:
                    value, where = None, []
                    break
                value, where = value + piece, where + spans_
            done[n] = value, where
    for n, (name, context, _, _) in enumerate(found):
        value, where = done[n]
        if value is not None:
            yield name, context, value, [(a, b) for a, b in where if b > a]


def named_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    lowered = text.lower()
    if not any(c in text for c in "=:(>") or not any(k in lowered for k, v in SENSITIVE.items() if v):
        return []
    starts = [s for _, s, _ in base]
    ends = list(itertools.accumulate((e for *_, e in base), max))
    levels, scores = functools.cache(sensitivity), functools.cache(literal_score)
    found = set()
    for name, context, value, where in pairs(text):
        # a sensitive context counts a little less than a sensitive name
        level = max(levels(name), levels(".".join(context)) - 1 if context else 0)
        if level >= 1 and (score := scores(value)) and level + score >= LEAST_SCORE:
            for start, end in where:
                k = bisect.bisect_right(starts, start)
                if not k or ends[k - 1] < end:
                    found.add(("named", start, end))
    return sorted(found)


def spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans, and all spans, both ordered by start and kind."""
    text = text or ""
    base = base_spans(text)
    return base, sorted({*base, *named_spans(text, base)}, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256 and spans for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for t in batch.column(1):
                base, found = spans(t.as_py())
                for kind in BASE_KINDS:
                    out[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, pa.int64() if k[:2] == "n_" else pa.string()) for k, v in out.items()]], names=[key, *out])

    kind = dict(docs.select(key).dtypes)[key]
    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str | None, mask: str = "[secret]") -> str | None:
    """The text with every found span replaced; overlapping spans count as one."""
    if not text:
        return text
    _, found = spans(text)
    if not found:
        return text
    parts, upto = [], 0
    for _, start, end in found:
        if end <= upto:
            continue
        if start >= upto:
            parts += [text[upto:start], mask]
        upto = end
    return "".join(parts) + text[upto:]


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """All rows and columns, with secrets masked in the text and the length column set anew where they were."""
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([redacted(t.as_py()) for t in batch.column(at)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    if length and length in names:
        kind = dict(docs.dtypes)[length]
        out = out.withColumn(length, F.coalesce(F.length(text), F.lit(0)).cast(kind))
    return out


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
