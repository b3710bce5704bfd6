"""Secrets in whole texts: fixed patterns, and literals that reach sensitive names.

Patterns of three kinds give spans as they stand. Beside them a lexer reads assignments as
source and configuration files write them (``name = "literal"``, ``"name": 'literal'``,
``NAME=literal``, ``a := b + "literal"``), keeps what each name holds, and follows names and
sums of names to the literals they came from. A value is scored by the name it is assigned
to and by its own shape; from THRESHOLD up, each literal it is made of is a span of kind
``literal``, unless a pattern's span covers it already.

Defined results: null and empty texts have no spans; repeated rows give repeated results; a
null doc_id stays null; other columns are ignored; an empty table gives an empty result.
Texts are scanned whole, and values are scored whole: those of a sum by counts of characters
added up, and by the ends where its parts meet.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ledgersieve.llm.common import map_texts, pick


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The patterns of the query's contract and the least length of each match.
KINDS = ("assign", "access", "hex", "literal")
_NAMES = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")),
                   _either_case("api") + "_?" + _either_case("key")])
ASSIGN = re.compile(rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_LEAST = 6
#: Runs shorter than the least length are never whole matches, so they need no look.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Parts of names whose values are secret, and parts of values that stand for none.
SENSITIVE = frozenset(("password passwd passphrase pwd pass secret token apikey key credential "
                       "credentials auth bearer private signing").split())
HARMLESS = ("example", "changeme", "placeholder", "redacted", "dummy", "xxxx", "****", "<", "${", "{{")
THRESHOLD = 0.7
#: Characters of a value's ends that can be part of a mark that goes on in the next part.
_EDGE = max(map(len, HARMLESS)) - 1

# A backslash outside strings takes the character after it along: no string begins at an escaped
# quote, so at most the last quotes of a line are read in vain, and a line is read in linear time.
_LEXER = re.compile(r"""
    (?P<string>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')
  | (?P<escape>\\.)
  | (?P<name>[A-Za-z_][A-Za-z0-9_.-]*)
  | (?P<op>:=|=>|==|!=|<=|>=|=|:)
  | (?P<plus>\+)
  | (?P<bare>[A-Za-z0-9/+_$%&*@~^|.-]+)
  | (?P<end>[\n;,(){}\[\]])
""", re.VERBOSE)
_ASSIGNS = frozenset((":=", "=>", "=", ":"))


@dataclass
class Shape:
    """What a value is scored by; that of a sum follows from those of its parts."""
    counts: Counter
    length: int
    harmless: bool
    head: str
    tail: str

    @classmethod
    def of(cls, text: str) -> Shape:
        low = text.lower()
        return cls(Counter(text), len(text), any(x in low for x in HARMLESS), low[:_EDGE], low[-_EDGE:])

    def __add__(self, other: Shape) -> Shape:
        border = self.tail + other.head
        return Shape(self.counts + other.counts, self.length + other.length,
                     self.harmless or other.harmless or any(x in border for x in HARMLESS),
                     (self.head + other.head)[:_EDGE], (self.tail + other.tail)[-_EDGE:])


@dataclass
class Value:
    """A literal (with its span) or a sum of values, whose shape is known at once."""
    text: str
    span: tuple[int, int] | None = None
    parts: tuple[Value, ...] = ()
    told: bool = False
    known: Shape | None = None

    def shape(self) -> Shape:
        if self.known is None:
            self.known = Shape.of(self.text)
        return self.known


def added(parts: list[Value]) -> Value:
    total = parts[0].shape()
    for part in parts[1:]:
        total = total + part.shape()
    return Value("", None, tuple(parts), known=total)


def sensitive(name: str) -> float:
    """How clearly a name asks for a secret."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)]
    hits = sum(p in SENSITIVE for p in parts)
    return 0.0 if not hits or parts[-1] in ("id", "name", "type", "length", "count") else \
        0.4 if parts == ["key"] else 0.5


def shape(value: Shape) -> float:
    """How much a value looks made by a generator rather than written by a person."""
    counts, length = value.counts, value.length
    if length < 6 or value.harmless or counts[" "]:
        return -1.0
    shares = [n / length for n in counts.values()]
    bits = -sum(x * math.log2(x) for x in shares if x)
    kinds = sum(any(test(c) for c in counts) for test in (str.isdigit, str.isupper, str.islower))
    return 0.1 * (length >= 8) + 0.1 * (length >= 16) + 0.15 * (bits >= 2.5) \
        + 0.15 * (bits >= 3.3) + 0.1 * (kinds >= 2)


def literals(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that flow into sensitive names."""
    held: dict[str, Value] = {}
    found: list[tuple[int, int]] = []
    tokens = [(m.lastgroup, m.group(), m.start(), m.end()) for m in _LEXER.finditer(text)
              if m.lastgroup != "escape"]
    at = 0
    while at + 1 < len(tokens):
        kind, name, _, name_end = tokens[at]
        if kind not in ("name", "string") or tokens[at + 1][1] not in _ASSIGNS:
            at += 1
            continue
        quoted, near = kind == "string", "\n" not in text[name_end:tokens[at + 1][2]]
        name = name[1:-1] if quoted else name
        at, parts, end = at + 2, [], tokens[at + 1][3]
        while near and at < len(tokens) and "\n" not in text[end:tokens[at][2]]:
            kind, word, start, end = tokens[at]
            if kind == "string":
                parts.append(Value(word[1:-1], (start + 1, end - 1)))
            elif kind in ("name", "bare"):
                after = tokens[at + 1][1] if at + 1 < len(tokens) else ""
                if after in _ASSIGNS:
                    break  # the next assignment begins
                while at + 1 < len(tokens) and tokens[at + 1][0] in ("name", "bare") \
                        and tokens[at + 1][2] == end:
                    at += 1  # a bare literal goes on until something stands between
                    end = tokens[at][3]
                word = text[start:end]
                parts.append(held.get(word) or Value(word, (start, end)))
            else:
                break
            at += 1
            if at < len(tokens) and tokens[at][0] == "plus":
                end, at = tokens[at][3], at + 1
            else:
                break
        if not parts:
            continue
        value = parts[0] if len(parts) == 1 else added(parts)
        held[name] = value
        asked = sensitive(name)
        if asked and asked + shape(value.shape()) >= THRESHOLD:
            todo = [value]
            while todo:
                one = todo.pop()
                if not one.told:
                    one.told = True
                    todo += one.parts
                    if one.span:
                        found.append(one.span)
    return sorted(set(found))


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets by start, then kind; the end is exclusive."""
    text = text or ""
    assigns = ":" in text or "=" in text
    base = [("hex", *m.span()) for m in HEX.finditer(text)]
    base += [("access", *m.span()) for m in ACCESS.finditer(text)]
    if assigns:
        base += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(1)) >= ASSIGN_LEAST]
    more = literals(text) if assigns else []
    if more:
        covered, reach = sorted((a, b) for _, a, b in base), []
        for a, b in covered:
            reach.append((a, max(b, reach[-1][1] if reach else 0)))
        at, end = 0, -1
        for a, b in more:
            while at < len(reach) and reach[at][0] <= a:
                end = reach[at][1]
                at += 1
            if b > end:
                base.append(("literal", a, b))
    return sorted(base, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of each pattern, and all spans, for each row of ``docs``."""
    def start():
        def work(texts):
            found = [spans(t) for t in texts]
            base = [[s for s in f if s[0] != "literal"] for f in found]
            counts = [[sum(s[0] == k for s in f) for f in found] for k in KINDS]
            digests = [hashlib.sha256(written(b).encode()).hexdigest() for b in base]
            return [*counts[:3], digests, [written(f) for f in found], counts[3]]
        return work

    return map_texts(
        pick(docs, "doc_id", "text"), ["doc_id"],
        "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
        "n_literal long", start)
