"""Secret scans: fixed patterns, and assignment-aware lexing.

The lexer is a tokenizer with a stack of open brackets. It reads source and configuration syntax
into name-literal pairs: ``name = value``, ``name: value`` (where a name starts a statement or is
quoted), ``name := value``, ``name += value``, ``map["name"] = value``, ``--name=value``,
``<name>literal</name>`` and ``set("name", "literal")``. A value is made of literals (quoted,
triple-quoted or bare), names, lists, calls and maps, over several lines inside brackets or after a
``+``. Parts joined by ``+``, by standing side by side or by a joining call make one literal; the
elements of a list are literals of their own; a map hands its name on to its entries. A value that
is a name stands for what was bound to that name before (constants are propagated, in text order,
also through several names). Comments end a statement; what they assign is reported, but binds
nothing. A blank line outside a string closes all brackets, so prose can't hold them open.

A literal's score is the sensitivity of the most sensitive name that it reaches, times how much it
looks like a secret; placeholders and references to an environment score 0. Lexing has no bounds
of length, and names share the values that they carry on, so that the time is linear in the
text. A value that a concatenation holds in several ways counts each time in the concatenation's
own score. Spans are code points, end exclusive.

Edge cases: null and empty texts have no spans; very long texts are scanned whole; of spans with
one start the kind listed first comes first, then the shorter; repeated rows and null ids are
scanned one by one; empty tables give empty results. Further columns are ignored by ``scan`` and
kept by ``redact`` (which renews ``n_chars`` where there is one).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.lean import lean
from notelake.storage import table

KINDS = ("assign", "access", "hex", "lexed")
#: Literals score from 0 to 1; from this on they are reported.
REPORT = 0.5
MASK = "[secret]"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_TOKEN = re.compile(
    r'''(?P<triple>"""(?:[^"\\]++|\\.|"(?!""))*+"""|\'{3}(?:[^'\\]++|\\.|'(?!''))*+\'{3})
    |(?P<string>"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`\n]*+`)
    |(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+)
    |(?P<sigil>(?:\$|@|--?)(?=[A-Za-z_]))
    |(?P<line>\n[^\S\n]*+)
    |(?P<note>(?<!\S)(?:\#|//))
    |(?P<sign>:=|=>|[=!<>]=|\+=|::|=|:(?!/))
    |(?P<mark>[+,;(){}\[\]<&|>])
    |(?P<word>[^\s"'`,;(){}<>\[\]+=:&|\#]++|\#)
    |(?P<other>["'`:])''',
    re.X | re.S,
)
#: Paragraphs without any of these assign nothing.
_TELLING = re.compile(r"""[=:]|\(\s*+["']|</""")
_BREAK = re.compile(r'\n[^\S\n]*+\n|"""|\'{3}')
_ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*+)>[\x20\t]*+([^<>\n]++)</\1>", re.A)
_KEY = re.compile(r"[A-Za-z_][\w.-]*\Z", re.A)
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")
#: Letters that may stand before a string; calls that join their parts, or that read an environment.
_PREFIXES = frozenset("r b f u rb br fr rf".split())
_JOINERS = frozenset("join concat format strcat append decode encode b64decode fromhex unhexlify bytes str string".split())
_REFERENCES = frozenset("getenv environ env get lookup input prompt getpass".split())
_ASSIGNING = frozenset([":=", "=>", "=", ":", "+="])
_OPENS, _CLOSES = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")
_STARTS = frozenset(["", "\n", "{", ",", "(", "[", ";", "-", "#", ">", "|", "&"])
_SUBWORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_HOLDS = re.compile(r"\$\{|\$\(|%\(|\{\{|<[^>]*>|getenv|environ|process\.env|[Xx]{3,}|\*{3,}|\.\.\.")
_DULL = frozenset("none null nil true false undefined changeme example sample placeholder default required optional string text test dummy redacted hidden empty todo unknown".split())

#: How telling a part of a name is; pairs of parts count as one word.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "pass": 0.8, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "accesskey": 1.0, "privatekey": 1.0, "secretkey": 1.0, "signingkey": 1.0, "encryptionkey": 1.0, "credential": 1.0, "credentials": 1.0, "creds": 1.0, "bearer": 0.9, "auth": 0.7, "authorization": 0.8, "jwt": 0.9, "key": 0.6, "pin": 0.6, "dsn": 0.6, "connectionstring": 0.8, "cookie": 0.6, "session": 0.5, "salt": 0.6}
#: Parts that say that a name is about something else than the value itself.
HARMLESS = frozenset("public name names id ids url uri path file dir count length size max min limit type hint label field column header index expires expiry ttl policy regex pattern format".split())
#: Entries of a sensitive map that aren't secrets themselves; how much of its name others inherit.
PLAIN_ENTRIES = HARMLESS | frozenset("user username login email host hostname port region zone database db schema version env environment provider service bucket account".split())
INHERITED = 0.8


def name_score(name: str) -> float:
    parts = [p.lower() for p in _SUBWORD.findall(name)]
    if not parts:
        return 0.0
    best = max(SENSITIVE.get(p, 0.0) for p in [*parts, *(a + b for a, b in zip(parts, parts[1:], strict=False))])
    return best * (0.3 if HARMLESS.intersection(parts) else 1.0)


def literal_score(value: str) -> float:
    """0 to 1: long, varied strings of several kinds of characters look like secrets.

    The lines of a literal of several lines count as one, the frame of an armoured key not at all."""
    if "\n" in value:
        value = "".join(x.strip() for x in value.split("\n") if not x.strip().startswith("-----"))
    if len(value) < 6 or value.lower() in _DULL or _HOLDS.search(value) or any(c.isspace() for c in value):
        return 0.0
    return _variety(len(value), Counter(value))


def _variety(n: int, chars: Counter[str]) -> float:
    bits = -sum(k / n * math.log2(k / n) for k in chars.values())
    kinds = sum(any(f(c) for c in chars) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    plain = kinds == 1 and all(c.isalpha() for c in chars)
    return max(0.0, min(1.0, bits / 3.5) * min(1.0, 0.55 + n / 40) * (0.6 if plain else 1.0))


class _Joined:
    """What scoring needs of a concatenation: its characters, ends and placeholders."""

    KEPT = 16  # more than the longest placeholder mark and the longest dull word

    def __init__(self, value: str = ""):
        self.n, self.chars, self.head, self.tail = len(value), Counter(value), value[: self.KEPT], value[-self.KEPT :]
        self.held, self.opened, self.closed = bool(_HOLDS.search(value)), "<" in value, ">" in value

    def add(self, x: _Joined) -> None:
        self.held = self.held or x.held or (self.opened and x.closed) or bool(_HOLDS.search(self.tail + x.head))
        self.n += x.n
        self.chars.update(x.chars)
        self.head, self.tail = (self.head + x.head)[: self.KEPT], (self.tail + x.tail)[-self.KEPT :]
        self.opened, self.closed = self.opened or x.opened, self.closed or x.closed

    def score(self) -> float:
        if self.n <= self.KEPT:
            return literal_score(self.head)
        return 0.0 if self.held or any(c.isspace() for c in self.chars) else _variety(self.n, self.chars)


class _Value:
    """A literal, or a concatenation of values that other values may share."""

    def __init__(self, text: str = "", start: int = 0, end: int = 0, parts: tuple[_Value, ...] = ()):
        self.text, self.start, self.end, self.parts = text, start, end, parts
        self.reach, self.told, self.shared = 0.0, False, False
        self.joined: _Joined | None = None

    def join(self, last: _Value | None) -> None:
        """Sums up the parts; takes over those of ``last`` where no name stands for it any more."""
        first, *rest = self.parts
        if first is last and not first.shared and first.joined:
            self.joined, first.joined = first.joined, None
        else:
            self.joined, rest = _Joined(), self.parts
        for x in rest:
            self.joined.add(x.joined or _Joined(x.text))


def base_spans(text: str) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, value start, value end) of the fixed patterns."""
    found = [("assign", m.start(), m.end(), m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    for kind, pattern in (("access", _ACCESS), ("hex", _HEX)):
        found += [(kind, m.start(), m.end(), m.start(), m.end()) for m in pattern.finditer(text)]
    return found


#: How a part of a value stands in the text. A bare word is a literal where it is the value itself; in
#: a list or call, or after a dollar sign, it can only be a name.
QUOTED, BARE, REFERENCE = range(3)
_Part = tuple[str, int, int, int]


class _Pair:
    """An assignment that is being read: names, and groups of parts that make one literal each."""

    def __init__(self, names: list[str], sign: str, outer: float = 0.0, binds: bool = False):
        self.names, self.sign, self.outer, self.binds = names, sign, outer, binds
        self.groups: list[list[_Part]] = []
        self.open = True
        self.known: list[float] = []

    def sensitivity(self) -> float:
        if self.known:
            return self.known[0]
        own = max(name_score(n) for n in self.names)
        if self.outer and not any(PLAIN_ENTRIES.intersection(p.lower() for p in _SUBWORD.findall(n)) for n in self.names):
            own = max(own, self.outer * INHERITED)
        self.known.append(own)
        return own


class _Frame:
    """An open bracket: whose value it is part of, and the plain strings that are its elements."""

    def __init__(self, kind: str = "", owner: _Pair | None = None, joins: bool = False, skips: bool = False, called: bool = False):
        self.kind, self.owner, self.joins, self.skips, self.called = kind, owner, joins, skips, called
        self.elements: list[tuple[str, int, int] | None] = [None]
        self.pair: _Pair | None = None


class _Lexer:
    """Reads one paragraph after the other; ``out`` gets each pair where it ends.

    ``last``, ``kind`` and ``at`` are the token before, its kind and its end, ``before`` the token
    before that; ``key`` is a key that a closed bracket made (``map["key"]``)."""

    def __init__(self, text: str, out: Callable[[_Pair], None]):
        self.text, self.out = text, out

    def paragraph(self, begin: int, end: int) -> None:
        self.stack = [_Frame()]
        self.last, self.kind, self.at, self.before, self.key = "", "", begin, "", None
        self.ended, self.comment = False, 0
        for m in _TOKEN.finditer(self.text, begin, end):
            kind, token = m.lastgroup, m[0]
            if self.ended and kind != "line":
                if token != "+":
                    self.finish(self.stack[-1])
                self.ended = False
            getattr(self, kind)(token, m.start(), m.end())
        while self.stack:
            self.finish(self.stack.pop())

    def step(self, token: str, kind: str, end: int) -> None:
        self.before, self.last, self.kind, self.at, self.key = self.last, token, kind, end, None

    def target(self) -> _Pair | None:
        """Whose value the next operand belongs to."""
        f = self.stack[-1]
        if f.skips:
            return None
        if f.pair:
            return f.pair if f.pair.open else None
        return f.owner if f.kind in ("(", "[") else None

    def finish(self, frame: _Frame) -> None:
        if frame.pair:
            self.out(frame.pair)
            frame.pair = None

    def operand(self, text: str, start: int, end: int, how: int) -> None:
        f, p = self.stack[-1], self.target()
        if p is None:
            return
        if how == BARE and (p is not f.pair or (self.kind == "sigil" and self.at == start)):
            how = REFERENCE
        beside = how == QUOTED and self.kind == "string" and self.last not in (",", ";")
        if p.groups and (self.last == "+" or f.joins or beside):
            p.groups[-1].append((text, start, end, how))
        elif p is f.pair and p.groups:
            p.open = False
        else:
            p.groups.append([(text, start, end, how)])

    def drop(self, end: int) -> None:
        """What was taken for a part, and ends there, turns out to be a key, a prefix or a call."""
        f = self.stack[-1]
        p = f.pair or f.owner
        if p and p.groups and p.groups[-1][-1][2] == end:
            p.groups[-1].pop()
            if not p.groups[-1]:
                p.groups.pop()

    def string(self, token: str, start: int, end: int, ticks: int = 1) -> None:
        if self.kind == "name" and self.at == start:
            if self.last.lower() not in _PREFIXES:  # an apostrophe; what follows is read as words
                self.step("'", "word", end)
                return
            self.drop(self.at)
            self.last, self.kind = self.before, "mark"
        f, part = self.stack[-1], (self.text[start + ticks : end - ticks], start + ticks, end - ticks)
        f.elements[-1] = part if f.elements[-1] is None and self.last in ("(", "[", ",") else None
        self.operand(*part, QUOTED)
        self.step(token, "string", end)

    def triple(self, token: str, start: int, end: int) -> None:
        self.string(token, start, end, 3)

    def name(self, token: str, start: int, end: int) -> None:
        self.operand(token, start, end, BARE)
        self.step(token, "name", end)

    def sigil(self, token: str, start: int, end: int) -> None:
        self.step(token if token == "$" else self.last, "sigil", end)

    def word(self, token: str, start: int, end: int) -> None:
        if token[0] == "." and self.at == start and self.kind in ("string", "mark"):  # a method of what was read
            self.step(token, "name", end)
            return
        self.operand(token, start, end, BARE)
        self.step(token, "word", end)

    def other(self, token: str, start: int, end: int) -> None:
        self.step(token, "word", end)

    def line(self, token: str, start: int, end: int) -> None:
        f = self.stack[-1]
        if self.comment:
            while len(self.stack) > self.comment:
                self.finish(self.stack.pop())
            self.comment, f = 0, self.stack[-1]
            self.finish(f)
        elif f.kind in ("(", "["):  # a blank like others
            return
        elif f.pair and (self.last == "+" or self.kind == "sign"):  # the value goes on
            return
        elif f.pair:
            self.ended = True
        self.step("\n", "line", end)

    def note(self, token: str, start: int, end: int) -> None:
        if not self.comment:
            self.comment = len(self.stack)
            self.finish(self.stack[-1])
        self.step("#", "note", end)

    def sign(self, token: str, start: int, end: int) -> None:
        f, key, quoted = self.stack[-1], self.key, True
        if key is None and self.kind in ("name", "string"):
            quoted = self.kind == "string"
            key = self.last.strip("\"'`") if quoted else self.last.rstrip(".-")
        starts = quoted or self.before in _STARTS
        if key is None or not _KEY.match(key) or token not in _ASSIGNING or (token == ":" and not starts):
            if f.pair and token not in (":", "::"):
                f.pair.open = False
            self.step(token, "word", end)
            return
        names, previous = [key], f.pair
        self.drop(self.at - 1 if quoted and self.kind == "string" else self.at)
        if previous and not previous.groups:
            if previous.sign == ":" and token == "=":  # a type stood between
                names = previous.names
            elif token != ":":
                names = previous.names
                names.append(key)
            f.pair = None
        self.finish(f)
        outer = f.owner.sensitivity() if f.owner and f.kind == "{" else 0.0
        f.pair = _Pair(names, token, outer, not self.comment)
        if token == "+=":
            f.pair.groups.append([(key, start, start, REFERENCE)])
        self.step("+" if token == "+=" else token, "sign", end)

    def mark(self, token: str, start: int, end: int) -> None:
        f = self.stack[-1]
        if token in _OPENS:
            beside = self.at == start
            named = beside and self.kind == "name"
            # an index, a variable of a shell or template, or a call that reads an environment
            skips = f.skips or (beside and (self.last in ("$", "%", "{") and token == "{" or token == "[" and (named or self.last in (")", "]"))))
            callee = self.last.lower().split(".") if named else [""]
            if named and token == "(":
                self.drop(self.at)
                skips = skips or not _REFERENCES.isdisjoint(callee)
            owner = self.target()
            joins = callee[-1] in _JOINERS or (f.joins and token != "{")
            self.stack.append(_Frame(token, owner, joins, skips, named))
        elif token in _CLOSES:
            if len(self.stack) > 1 and _OPENS[f.kind] == token:
                self.finish(f)
                self.stack.pop()
                two = f.elements[:2]
                if f.kind == "(" and f.called and len(two) == 2 and all(two) and _KEY.match(two[0][0]):
                    pair = _Pair([two[0][0]], "(")
                    pair.groups = [[(*two[1], QUOTED)]]
                    self.out(pair)
                self.step(token, "mark", end)
                if token == "]" and f.called and len(f.elements) == 1 and f.elements[0]:
                    self.key = f.elements[0][0]
                return
        elif token in ",;":
            self.finish(f)
            f.elements.append(None)
        elif token == "<":
            if m := _ELEMENT.match(self.text, start):
                value = m[2].rstrip(" \t")
                pair = _Pair([m[1]], "<", binds=not self.comment)
                pair.groups = [[(value, m.start(2), m.start(2) + len(value), QUOTED)]]
                self.out(pair)
        elif token != "+" and f.pair:
            f.pair.open = False
        self.step(token, "mark", end)


def _paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """Stretches between blank lines that could assign something; no triple-quoted string is cut."""
    at = search = 0
    while m := _BREAK.search(text, search):
        if m[0][0] != "\n":
            close = text.find(m[0], m.end())
            search = close + 3 if close >= 0 else m.end()
            continue
        if _TELLING.search(text, at, m.start()):
            yield at, m.start()
        at = search = m.end() - 1
    if _TELLING.search(text, at):
        yield at, len(text)


def pairs(text: str) -> list[_Pair]:
    """All assignments of a text, in the order in which they end."""
    found: list[_Pair] = []
    if _TELLING.search(text):
        lexer = _Lexer(text, found.append)
        for begin, end in _paragraphs(text):
            lexer.paragraph(begin, end)
    return found


def lexed_spans(text: str) -> list[tuple[str, int, int, int, int]]:
    """Literals that reach a sensitive name, by propagation of constants."""
    bound: dict[str, _Value] = {}
    best: set[tuple[int, int]] = set()
    for pair in pairs(text):
        name, wholes = pair.names[-1], []
        for group in pair.groups:
            values: list[_Value] = []
            for raw, start, end, how in group:
                if how != QUOTED and _NAME.match(raw) and raw in bound:
                    values.append(bound[raw])
                    bound[raw].shared |= raw != name
                elif how != REFERENCE:
                    bare = raw if how == QUOTED else raw.rstrip(".!?")
                    values.append(_Value(bare, start, start + len(bare)))
            values = list(dict.fromkeys(values))
            if len(values) > 1:
                wholes.append(_Value(parts=tuple(values)))
                wholes[-1].join(bound.get(name))
            else:
                wholes += values
        if not wholes:
            continue
        whole = wholes[0] if len(wholes) == 1 else _Value(parts=tuple(dict.fromkeys(wholes)))
        if pair.binds:
            for n in pair.names:
                bound[n] = whole
            whole.shared |= len(pair.names) > 1
        sensitive = pair.sensitivity()
        if not sensitive:
            continue
        ways = [whole]
        while ways:  # each value is met once for each higher sensitivity
            x = ways.pop()
            if x.reach < sensitive:
                x.reach = sensitive
                ways += x.parts
                if not x.parts and sensitive * literal_score(x.text) >= REPORT and x.end > x.start:
                    best.add((x.start, x.end))
        ways = [x for x in wholes if x.parts and x.joined and sensitive * x.joined.score() >= REPORT]
        while ways:
            x = ways.pop()
            if not x.told:
                x.told = True
                ways += x.parts
                if not x.parts and x.end > x.start:
                    best.add((x.start, x.end))
    return [("lexed", a, b, a, b) for a, b in sorted(best)]


def spans(text: str | None) -> list[tuple[str, int, int, int, int]]:
    """All spans by start, then kind; lexed literals inside a fixed pattern's span aren't repeated."""
    text = text or ""
    base = base_spans(text)
    more = lexed_spans(text)
    if more and base:
        cover = sorted((a, b) for _, a, b, _, _ in base)
        more = [x for x in more if not any(a <= x[1] and x[2] <= b for a, b in cover)] if len(cover) * len(more) <= 1_000_000 else _uncovered(more, cover)
    return sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _uncovered(more: list[tuple], cover: list[tuple[int, int]]) -> list[tuple]:
    out, at, reach = [], 0, -1
    for x in sorted(more, key=lambda x: x[1]):
        while at < len(cover) and cover[at][0] <= x[1]:
            reach = max(reach, cover[at][1])
            at += 1
        if x[2] > reach:
            out.append(x)
    return out


def _written(found: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _, _ in found)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_lexed, base_sha256, spans) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, written = [], [], []
            for text in b.column(1):
                found = spans(text.as_py())
                by = Counter(x[0] for x in found)
                counts.append([by[k] for k in KINDS])
                digests.append(hashlib.sha256(_written([x for x in found if x[0] != "lexed"]).encode()).hexdigest())
                written.append(_written(found))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.array(digests, pa.string()), pa.array(written, pa.string())], names=names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_lexed", "base_sha256", "spans"]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, n_assign long, n_access long, n_hex long, n_lexed long, base_sha256 string, spans string")


def redacted(text: str | None) -> str | None:
    """The text with the value of every span masked; overlapping spans make one mask."""
    if not text:
        return text
    out, at = [], 0
    for a, b in sorted((x[3], x[4]) for x in spans(text)):
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, with secrets masked in ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            texts = [redacted(t.as_py()) for t in b.column(at)]
            b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            yield b

    out = docs.mapInArrow(lean(run), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def secret_scan_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of ``op6_secret_scan``, which SQL can express."""
    return op6_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


_ANY_CASE = "".join(f"[{c.upper()}{c}]" for c in "password"), "".join(f"[{c.upper()}{c}]" for c in "passwd"), *("".join(f"[{c.upper()}{c}]" for c in x) for x in ("secret", "token")), "[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_SQL_KINDS = {"assign": rf"""({'|'.join(_ANY_CASE)})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}


def _sql_spans(kind: str, order: int, pattern: str) -> str:
    size = f"length(regexp_extract(x, '{pattern}', 2)) >= 6" if kind == "assign" else f"length(x) >= {20 if kind == 'access' else 24}"
    before = "list_sum(list_transform(gaps[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(found[1:i-1], lambda y: length(y))), 0)"
    return f"""SELECT r, '{kind}' AS kind, {order} AS o, CAST({before} AS BIGINT) AS a, length(x) AS size FROM (
  SELECT r, gaps, found, unnest(found) AS x, unnest(range(1, len(found) + 1)) AS i FROM (
    SELECT r, regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS found FROM d) WHERE len(found) > 0) WHERE {size}"""


BASE_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
spans AS ({' UNION ALL '.join(_sql_spans(k, i, p) for i, (k, p) in enumerate(_SQL_KINDS.items()))}),
written AS (SELECT r, string_agg(kind || ':' || a || ':' || (a + size), ',' ORDER BY a, o) AS x, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _SQL_KINDS)} FROM spans GROUP BY r)
SELECT doc_id, {', '.join(f'CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}' for k in _SQL_KINDS)}, sha256(coalesce(x, '')) AS base_sha256 FROM d LEFT JOIN written USING (r)
"""
