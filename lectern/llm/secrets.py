"""Secret scanning with assignment-aware lexing (operator 5).

Two layers. The base layer finds the three fixed patterns. The second layer reads
the text as source or configuration syntax: every `name = literal`, `name: literal`,
`"name": "literal"` or `name => literal` gives a name-literal pair, adjacent
literals joined by `+` are one, bare identifiers on the right are looked up among
the constants assigned earlier in the text, and the literal is scored by how
sensitive the name it reaches is and how much it looks like a credential.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm._spark import session_for_texts

# The base patterns, their least lengths and the order of the kinds.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "named")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

# What the parts of a target name say about its literal.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "private": 0.6, "key": 0.5, "access": 0.4,
    "signature": 0.5, "salt": 0.5, "cookie": 0.5, "session": 0.4, "dsn": 0.6, "cert": 0.4,
}
PLACEHOLDER = re.compile(r"^(?:x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|null|none|nil|true|false|undefined|changeme|change_me|example|sample|dummy|test|todo|your[_-].*|password|secret|token)$", re.IGNORECASE)
THRESHOLD = 0.55
LEAST_LITERAL = 8

_OPERATOR = re.compile(r"=>|:=|[=:]")
# A name before its operator, read backwards: blanks, a closing quote, a bracket or both, or a type, the name.
_EMAN = re.compile(r"""[ \t]*(?:\]?["']|\]|\w*[A-Za-z_][^\S\n]*:[^\S\n]*)?([A-Za-z0-9_.\-]*[A-Za-z_])""", re.ASCII)
_BARE = r"""[^\s"'`,;{}()\[\]<>+]+"""
_TERM = re.compile(r"""[ \t]*(?:[rbfuRBFU]{0,2}("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)|(\$\{[A-Za-z_][A-Za-z0-9_.\-]*\}|""" + _BARE + r"""))""")
_PLUS = re.compile(r"[ \t]*\+(?!\+)")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_IDENTIFIER = re.compile(r"\$?\{?([A-Za-z_][A-Za-z0-9_.\-]*)\}?", re.ASCII)


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float = 1.0

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each fixed pattern, the too short ones dropped."""
    found = []
    if ":" in text or "=" in text:
        found += [Span("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [Span("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [Span("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


HEAD, TAIL = 64, 2  # characters that say whether a literal is a placeholder


@dataclass(frozen=True)
class Characters:
    """What a score needs of a literal of any length: how often it holds each character, and its ends. Those of a sum follow from its parts'."""

    length: float
    head: str
    tail: str
    codes: array
    counts: array

    @classmethod
    def of(cls, literal: str) -> Characters:
        n = Counter(literal)
        return cls(len(literal), literal[:HEAD], literal[-TAIL:], array("I", map(ord, n)), array("d", n.values()))

    def __add__(self, other: Characters) -> Characters:
        n = Counter(dict(zip(self.codes, self.counts)))
        for c, k in zip(other.codes, other.counts):
            n[c] += k
        length = self.length + other.length
        scale = 1.0 if length < 1e15 else 1e-3  # a constant doubled for ever; only shares count
        head = self.head if len(self.head) == HEAD else (self.head + other.head)[:HEAD]
        tail = other.tail if len(other.tail) == TAIL else (self.tail + other.tail)[-TAIL:]
        return Characters(length * scale, head, tail, array("I", n), array("d", (k * scale for k in n.values())))


class Runs:
    """Characters of the ends of bare words. In `a=b=c` each operator begins a literal up to the end of the same word: they are summed from the right, once."""

    def __init__(self, text: str):
        self.text, self.end, self.starts, self.sums = text, -1, [], []

    def characters(self, a: int, b: int) -> Characters:
        if b != self.end:
            self.end, self.starts = b, [m.end() for m in _OPERATOR.finditer(self.text, a, b)]
            total, sums = Characters.of(""), []
            for x, y in zip(reversed(self.starts), reversed([*self.starts[1:], b])):
                total = Characters.of(self.text[x:y]) + total
                sums.append(total)
            self.sums = sums[::-1]
        i = bisect_left(self.starts, a)
        return Characters.of(self.text[a : self.starts[i]]) + self.sums[i] if i < len(self.starts) else Characters.of(self.text[a:b])


class Literal:
    """A run of the text, or two literals joined. Joining copies nothing, so constants built of constants cost a node each, until a score is asked for."""

    __slots__ = ("first", "start", "end", "empty", "parts", "known", "bare")

    def __init__(self, start: int, end: int, parts: tuple[Literal, Literal] | None = None):
        self.first = parts[0].first if parts else start
        self.start, self.end, self.parts, self.known = start, end, parts, None
        self.empty, self.bare = not parts and start == end, False

    def __add__(self, other: Literal) -> Literal:
        start, end = min(self.start, other.start), max(self.end, other.end)
        if self.empty or other.empty:
            x = other if self.empty else self
            kept = Literal(start, end, (x, _NOTHING))
            kept.empty = x.empty
            return kept
        return Literal(start, end, (self, other))

    def characters(self, runs: Runs) -> Characters:
        stack = [self]
        while self.known is None:
            x = stack[-1]
            waiting = [p for p in x.parts or () if p.known is None]
            if waiting:
                stack += waiting
                continue
            x.known = x.parts[0].known + x.parts[1].known if x.parts else runs.characters(x.start, x.end) if x.bare else Characters.of(runs.text[x.start : x.end])
            x.parts = None  # its sum says all
            stack.pop()
            while stack and stack[-1].known is not None:
                stack.pop()
        return self.known


_NOTHING = Literal(0, 0)
_NOTHING.known = Characters.of("")


@dataclass(frozen=True)
class Pair:
    """A literal that reaches `name`; several names if constants carry it on."""

    name: str
    literal: Literal

    @property
    def span(self) -> tuple[int, int]:
        return self.literal.start, self.literal.end


def name_literal_pairs(text: str) -> Iterator[Pair]:
    """Pairs in text order, constants propagated: `A = "x"; token = A` also pairs token with "x".

    Unquoted literals are constants too (`A=x`, `token=${A}`). As a bare word may be a literal as well as a
    name, an unquoted constant hides neither a quoted one of its name nor, without a `$`, the word itself: all are paired.
    A sum ends before a bare term that holds an operator itself. The time is linear in the text.
    """
    constants: dict[str, Literal] = {}
    unquoted: dict[str, Literal] = {}
    n, txet = len(text), text[::-1]
    done = run = 0  # run: end of the bare word that the last operator stood in
    for m in _OPERATOR.finditer(text):
        at = m.start()
        if at < done:
            continue
        name = _EMAN.match(txet, n - at)
        if not name:
            continue
        target = name[1][::-1]
        literal = known = word = None
        quoted = False
        pos, count = m.end(), 0
        while True:
            if not count and pos < run and (run - pos > 2 or text[run : run + 1] not in "\"'`"):
                a, b, is_quoted, end = pos, run, False, run
            elif t := _TERM.match(text, pos):
                is_quoted, end = t[1] is not None, t.end()
                a, b = (t.start(1) + 1, t.end(1) - 1) if is_quoted else t.span(2)
                if not is_quoted and count and _OPERATOR.search(text, a, b):
                    break
                if not is_quoted:
                    run = max(run, b)
            else:
                break
            piece = Literal(a, b)
            piece.bare = not is_quoted
            if not is_quoted:
                word, known = piece, _IDENTIFIER.fullmatch(text, a, b)
                if known and (known[1] in constants or known[1] in unquoted):
                    is_quoted = known[1] in constants
                    piece = constants[known[1]] if is_quoted else unquoted[known[1]]
            literal = literal + piece if count else piece
            count += 1
            quoted |= is_quoted
            pos = end
            plus = _PLUS.match(text, pos)
            if not plus:
                break
            pos = plus.end()
        if literal is None:
            continue
        others = []
        if count == 1 and known and known[1] in unquoted:
            others = [unquoted[known[1]]]
            if text[word.start] != "$" and known[1] not in constants:
                others.append(word)
        if quoted:
            constants[target] = literal
            done = max(done, pos)
        elif text[literal.first] not in "=:":  # of `==` and `::`
            unquoted[target] = literal
        if others and quoted:
            unquoted[target] = others[0]
        for found in (literal, *(x for x in others if x is not literal)):
            yield Pair(target, found)


def name_score(name: str) -> float:
    """Highest weight of the name's parts (camelCase, snake_case and dotted), a little more for two."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    joined = {a + b for a, b in zip(parts, parts[1:])}
    weights = sorted((NAME_WEIGHTS[p] for p in {*parts, *joined} if p in NAME_WEIGHTS), reverse=True)
    return min(1.0, weights[0] + 0.25 * sum(weights[1:])) if weights else 0.0


def is_placeholder(c: Characters) -> bool:
    """PLACEHOLDER of a literal of any length: long ones are no fixed words, so their ends and characters decide."""
    if c.length <= HEAD:
        return bool(PLACEHOLDER.match(c.head))
    kinds = {chr(x) for x in c.codes}
    enclosed = any(c.head.startswith(a) and c.tail.endswith(b) for a, b in (("<", ">"), ("${", "}"), ("{{", "}}"), ("%", "%")))
    return enclosed or kinds <= {"x", "X"} or kinds == {"*"} or kinds == {"."} or c.head[:5].lower() in ("your_", "your-")


def character_score(c: Characters) -> float:
    """0 for placeholders, prose and short values; nears 1 for long values of high entropy, however long."""
    n = c.length
    if n < LEAST_LITERAL or any(chr(x).isspace() for x in c.codes) or is_placeholder(c):
        return 0.0
    entropy = -sum(k / n * math.log2(k / n) for k in c.counts)
    kinds = {"a" if "a" <= x <= "z" else "A" if "A" <= x <= "Z" else "0" if "0" <= x <= "9" else "." for x in map(chr, c.codes)}
    return min(1.0, entropy / 4) * (0.5 + 0.5 * min(1.0, len(kinds) / 2)) * min(1.0, n / 12)


def literal_score(literal: str) -> float:
    return character_score(Characters.of(literal))


def named_spans(text: str, base: list[Span]) -> list[Span]:
    """Literals whose names make them secrets and that no base span covers already."""
    if ":" not in text and "=" not in text:
        return []
    covered = sorted((s.start, s.end) for s in base)
    starts, reach = [a for a, _ in covered], list(accumulate((b for _, b in covered), max))
    found: dict[tuple[int, int], float] = {}
    runs = Runs(text)
    for pair in name_literal_pairs(text):
        sensitive = name_score(pair.name)
        if not sensitive or pair.literal.empty:
            continue
        score = sensitive * character_score(pair.literal.characters(runs))
        before = bisect_right(starts, pair.span[0])
        if score >= THRESHOLD and not (before and reach[before - 1] >= pair.span[1]):
            found[pair.span] = max(score, found.get(pair.span, 0.0))
    return [Span("named", a, b, s) for (a, b), s in sorted(found.items())]


def scan(text: str | None) -> list[Span]:
    """All spans by start, then kind as listed. Offsets are code points, ends exclusive; null is empty."""
    text = text or ""
    base = base_spans(text)
    rank = KINDS.index
    return sorted([*base, *named_spans(text, base)], key=lambda s: (s.start, rank(s.kind), s.end))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def find_secrets(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of df: its id and `spans`, an array of (kind, start, end, score).

    Null and empty texts have no spans; repeated rows and null ids stay as they are;
    other columns are not read, so their names cannot clash. No shuffle.
    """
    session_for_texts(df.sparkSession)
    id_field = df.schema[id_col]

    def run(batches):
        for b in batches:
            rows = [[{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score} for s in scan(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(_SPAN))], ["id", "spans"])

    body = df.select(df[f"`{id_col}`"].alias("id"), df[f"`{text}`"].alias("text"))
    kind = id_field.dataType.simpleString()
    out = body.mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    return out.withColumnRenamed("id", id_col)


def joined(spans: list[Span]) -> str:
    return ",".join(map(str, spans))


def base_digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined([s for s in spans if s.kind != "named"]).encode()).hexdigest()
