"""Secret scan by assignment-aware lexing (operator 1).

Two layers over each whole text:

* *Base patterns*: keyword assignments, access key ids and long hex runs.
* *Lexed assignments*: every line with an assignment sign is cut into strings,
  names, signs and bare words. Name-literal pairs are read from source and
  configuration syntax (``name = "x"``, ``name: x``, ``"name": "x"``,
  ``name := "x"``, ``name: Type = "x"``, ``map["name"] = "x"``). Literals
  joined with ``+`` are one value; a name on the right-hand side stands for the
  value bound to it earlier in the text (constant propagation). A value is
  reported where its target name is sensitive and the value looks like a
  secret: name score times literal score of at least ``threshold``. A bare value
  reaches to the next blank, quote, comma or semicolon if its target is
  sensitive, and to the next assignment sign otherwise.

A joined value is a node over its parts with a summary of bounded size (length,
counts per ASCII character, flags), so ``b = a + a``, ``c = b + b`` and so on cost
one step each, however long the value is. Only values of sensitive targets are
scored, each node once, and a literal is reported once.

Spans are code-point offsets, end exclusive; a lexed span is the literal
without its quotes, and is left out where a base span covers it.

The scan is one pass without a shuffle. Defined results: null or empty text
has no spans; repeated rows and null ids give one row each; an empty table an
empty result; other columns are not read. Work is linear in the text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind_of, map_batches, text_of

# Kinds in output order, base patterns and least lengths.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_MIN, ACCESS_MIN = 8, 16
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Words of a target name and how much they speak for (or against) a secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0,
    "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8,
    "privatekey": 1.0, "accesskey": 0.9, "signingkey": 0.9, "encryptionkey": 0.9, "salt": 0.6,
}
SENSITIVE_PAIRS = {("api", "key"), ("private", "key"), ("access", "key"), ("signing", "key"),
                   ("encryption", "key"), ("secret", "key"), ("account", "key"), ("client", "key")}
HARMLESS = {"file", "path", "url", "uri", "name", "id", "length", "size", "type", "count", "policy",
            "hint", "field", "label", "max", "min", "expires", "expiry", "ttl", "limit", "count", "prompt"}
PLACEHOLDER = re.compile(
    r"change_?me|example|placeholder|your[_-]|xxxx|\*\*\*|<[^<>]*>|\$\{|\{\{|^(null|none|true|false|undefined|default)$",
    re.I)

TOKEN = re.compile(r"""
    (?P<str>"(?:[^"\\]|\\.)*"?|(?<!\w)'(?:[^'\\]|\\.)*'?|`[^`]*`?)
  | (?P<name>[A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*)
  | (?P<op>:=|=>|==|!=|<=|>=|[=:+\[\]])
  | (?P<other>[^\s"'`\[\]=:+]+|\S)
""", re.X | re.A)
SIGNS = ("=", ":", ":=", "=>")
KIND_OF_CHARACTER = tuple(map(re.compile, ("[a-z]", "[A-Z]", "[0-9]", r"[^\w\s]")))
BARE = re.compile(r"""[^\s"'`,;]+""")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def name_score(name: str) -> float:
    """How likely a variable of this name holds a secret, 0 to 1."""
    words = [w.lower() for w in WORDS.findall(name)]
    best = max([SENSITIVE.get(w, 0.0) for w in words], default=0.0)
    if any(p in SENSITIVE_PAIRS for p in zip(words, words[1:])):
        best = max(best, 0.9)
    return best * 0.3 if words and words[-1] in HARMLESS else best


class _Value:
    """A literal, or values joined. ``summary`` is (length, counts per character,
    kinds of characters, placeholder, blank, space inside, space at its head, at its
    tail); characters beyond ASCII are counted as one."""

    __slots__ = ("text", "span", "parts", "summary", "told")

    def __init__(self, text: str = "", span: tuple[int, int] | None = None, parts: tuple = ()):
        self.text, self.span, self.parts, self.summary, self.told = text, span, parts, None, False

    def _own(self) -> tuple:
        s = self.text
        kinds = sum(1 << i for i, p in enumerate(KIND_OF_CHARACTER) if p.search(s))
        return (len(s), Counter(s.encode("ascii", "replace").decode()), kinds, PLACEHOLDER.search(s) is not None,
                not s.strip(), " " in s.strip(), s[:1] == " ", s[-1:] == " ")

    def _joined(self) -> tuple:
        n, chars, kinds, bad, blank, inside, head, tail = self.parts[0].summary
        chars = Counter(chars)
        for p in self.parts[1:]:
            n2, chars2, kinds2, bad2, blank2, inside2, head2, tail2 = p.summary
            n, kinds, bad = n + n2, kinds | kinds2, bad or bad2
            chars.update(chars2)
            inside = inside or inside2 or (not blank and not blank2 and (tail or head2))
            head, tail = head or blank and head2, tail2 or blank2 and tail
            blank = blank and blank2
        return n, chars, kinds, bad, blank, inside, head, tail

    def summarised(self) -> tuple:
        """The summary; parts come first, each node once, without recursion."""
        stack = [self]
        while stack:
            v = stack[-1]
            if v.summary is None:
                open_parts = [p for p in v.parts if p.summary is None]
                if open_parts:
                    stack.extend(open_parts)
                    continue
                v.summary = v._joined() if v.parts else v._own()
            stack.pop()
        return self.summary

    def score(self) -> float:
        """How much the value looks like a secret, 0 to 1: length, mix, entropy."""
        n, chars, kinds, bad, _, inside, _, _ = self.summarised()
        if n < 8 or bad or inside:
            return 0.0
        entropy = -sum(c / n * math.log2(c / n) for c in chars.values())
        return min(1.0, 0.3 * (entropy / 3.0) + 0.25 * bin(kinds).count("1") + 0.1 * (n >= 16))

    def tell(self, found: dict) -> None:
        """Add the spans of the literals that are not told yet."""
        stack = [self]
        while stack:
            v = stack.pop()
            if not v.told:
                v.told = True
                stack.extend(reversed(v.parts))
                if v.span is not None:
                    found[v.span] = None


def literal_score(value: str) -> float:
    return _Value(value).score()


def _value(tokens: list, i: int, line: str, bound: dict, at: int, sensitive: bool) -> tuple[_Value | None, int]:
    """The value that starts at token i, and the token after what it takes."""
    parts: list[_Value] = []
    while i < len(tokens):
        kind, word, a, b = tokens[i]
        if kind == "str" and len(word) > 1 and word[-1] == word[0]:
            parts.append(_Value(word[1:-1], (at + a + 1, at + b - 1)))
        elif kind == "name" and word in bound:
            parts.append(bound[word])
        elif not parts and (sensitive and (m := BARE.match(line, a))):
            while i < len(tokens) and tokens[i][2] < m.end():
                i += 1
            return _Value(m[0], (at + a, at + m.end())), i
        elif not parts and BARE.match(word):
            end = i
            while end < len(tokens) and (end == i or tokens[end][2] == tokens[end - 1][3]) and tokens[end][0] != "str" \
                    and tokens[end][1] not in SIGNS and (m := BARE.match(tokens[end][1])) and m[0] == tokens[end][1]:
                end += 1
            if end == i:
                return None, i
            stop = tokens[end - 1][3]
            return _Value(line[a:stop], (at + a, at + stop)), end
        else:
            break
        if i + 1 < len(tokens) and tokens[i + 1][1] == "+":
            i += 2
            continue
        i += 1
        break
    if len(parts) > 1:
        return _Value(parts=tuple(parts)), i
    return (parts[0] if parts else None), i


def _target(tokens: list, i: int) -> str | None:
    """The name that the assignment sign at token i assigns to."""
    if i and tokens[i - 1][1] == "]" and i > 2 and tokens[i - 2][0] == "str":
        return tokens[i - 2][1].strip("\"'`")
    if i > 2 and tokens[i][1] == "=" and tokens[i - 1][0] == "name" and tokens[i - 2][1] == ":" \
            and tokens[i - 3][0] == "name":
        return tokens[i - 3][1]  # name: Type = value
    if i and tokens[i - 1][0] in ("name", "str"):
        return tokens[i - 1][1].strip("\"'`")
    return None


def lexed(text: str, threshold: float) -> list[tuple[int, int]]:
    """Spans of literals that reach sensitive names, in order of discovery."""
    found: dict[tuple[int, int], None] = {}
    bound: dict[str, _Value] = {}
    at = 0
    for line in text.split("\n"):
        if "=" in line or ":" in line:
            tokens = [(m.lastgroup, m[0], m.start(), m.end()) for m in TOKEN.finditer(line)]
            i = 0
            while i < len(tokens):
                if tokens[i][0] != "op" or tokens[i][1] not in SIGNS:
                    i += 1
                    continue
                name = _target(tokens, i)
                i += 1
                if not name:
                    continue
                speaks = name_score(name)
                value, after = _value(tokens, i, line, bound, at, speaks >= threshold)
                if value is None:
                    continue
                bound[name] = value
                if speaks >= threshold:
                    if speaks * value.score() >= threshold:
                        value.tell(found)
                    i = max(i, after)
        at += len(line) + 1
    return [s for s in found if s[1] > s[0]]


def scan(text: str | None, threshold: float = 0.5) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text by start, then kind as listed."""
    text = text or ""
    low = text.lower()
    out = []
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_MIN]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if ("=" in text or ":" in text) and any(
            w in low for w in ("pass", "pwd", "secret", "token", "key", "cred", "auth", "bearer", "salt")):
        starts, furthest = [], []  # a base span that begins at or before a literal and ends at or after it covers it
        for _, s, e in sorted(out, key=lambda x: x[1]):
            starts.append(s)
            furthest.append(max(e, furthest[-1]) if furthest else e)
        for a, b in lexed(text, threshold):
            k = bisect_right(starts, a)
            if not k or furthest[k - 1] < b:
                out.append(("literal", a, b))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = 0.5) -> DataFrame:
    """One row per input row: id and spans, an array of (kind, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t.as_py(), threshold)]
                     for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    found = map_batches(rows, run, f"id {kind_of(rows, 'id')}, "
                                   "spans array<struct<kind:string,start:bigint,end:bigint>>")
    return found.withColumnRenamed("id", id_col)
