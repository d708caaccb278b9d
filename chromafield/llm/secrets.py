"""Secrets in texts: fixed patterns, and assignments read as source or configuration syntax.

The lexer looks at every ``=``, ``:``, ``:=`` and ``=>`` of a text, reads the names before it
(quoted, dotted, hyphenated or plain; a quoted or plain subscript, the name before brackets, the
name before a type) and the values after it: quoted literals, with or without a prefix, side by
side or joined with names by ``+``; literals within brackets or the arguments of a call, but not
the key of a lookup; alternatives after ``or``, ``||`` or ``??``; or one bare word.  A value may
begin on the next line if it is quoted, bracketed or, below a ``:``, one indented word.  A name that was given literals before is a constant: where it is
used as a value, its literals count for the name on the left as well, over any number of steps.
Brackets nest to any depth.
Each literal is scored by how sensitive the best of its target names is, times how much the
literal looks like a secret; from ``threshold`` on it is reported with the kind ``literal``.

A text is lexed in one pass on its own, whole; nothing is looked up in other rows.  Constants form
a graph that is solved once: what is asked of a name goes from users to what they use, and what a
value looks like, kept as its length, character counts and beginning, goes down to its literals;
so the time grows with the text, not with the length of the chains.

Defined results: a null text counts as empty and has no spans; offsets count code points, the
end exclusive; rows that repeat an id or a text are scanned each for itself; an empty table gives an
empty result.  Result columns replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chromafield.llm.rows import with_text_columns

# fixed values: the base patterns
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that are long enough
KINDS = ("assign", "access", "hex", "literal")

#: what a word of a target name says about its value
SENSITIVE = {
    "password": 1.0,
    "passwd": 1.0,
    "pwd": 0.9,
    "passphrase": 1.0,
    "secret": 1.0,
    "token": 0.9,
    "apikey": 1.0,
    "credential": 0.9,
    "credentials": 0.9,
    "bearer": 0.8,
    "auth": 0.7,
    "authorization": 0.8,
    "signature": 0.5,
    "private": 0.5,
    "access": 0.4,
    "api": 0.4,
    "key": 0.4,
}
PLACEHOLDERS = re.compile(
    r"^(?:x+|\*+|\.+|changeme|example|placeholder|your[-_ ].*|none|null|true|false|todo)$",
    re.IGNORECASE,
)
THRESHOLD = 0.5
SHORTEST = 8

_OPERATOR = re.compile(r"(?::=|=>|(?<![=!<>:])=(?![=>])|(?<!:):(?![:=/]))[ \t]*")
_NAME = re.compile(r"[A-Za-z_][\w.\-]*")
_LITERAL = re.compile(
    r"""(?P<prefix>[bfrBFR]{1,2}|u8|[uUL]|[@$]{1,2})?(?:"""
    r"""(?P<triple>\"{3}|'{3})(?P<long>(?:\\[\s\S]|(?!(?P=triple))[^\\])*)(?P=triple)|"""
    r"""(?P<quote>["'`])(?P<body>(?:\\.|(?!(?P=quote))[^\\\n])*)(?P=quote))"""
)
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>|&]+""")
_PLUS = re.compile(r"[ \t]*\+\s*")
_BLANK, _SPACE = re.compile(r"[ \t]*"), re.compile(r"\s*")
_CALL = re.compile(r"(?:(?:new|await)[ \t]+)?[&*]?([A-Za-z_$][\w.$:]*!?)\(")
_GROUP = re.compile(r"(?:new[ \t]+[\w.]+\[\d*\][ \t]*)?&?[(\[{]")
_TAIL = re.compile(r"(?:\.\w+\(\))+")
_KEY = re.compile(r"""(["'`]?)([A-Za-z_][\w.\-]*)\1\s*(?:=>|=(?![=>])|:(?![:=/]))\s*""")
_ELSE = re.compile(r"[ \t]*(?:\|\||\?\?|\?:|or\b)\s*")
_BELOW = re.compile(r"(?:[|>][+\-\d]*[ \t]*)?\r?\n")
_LINE = re.compile(r"([ \t]+)([^\s\"'`,;(){}\[\]<>|&]+)[ \t]*\r?(?:\n|\Z)")
_BRACKET = re.compile(r"[\[\]<>\n]")
_LOOKUP = re.compile(r"(?:^|[._:$])(?:get\w*|\w*env|lookup|fetch|setting|config|option)$", re.IGNORECASE)
#: arguments by name that stand for the value of the whole call
FALLBACKS = {"default", "default_value", "defaultValue", "fallback", "value"}
HEAD = 256  # characters of a value's beginning that are looked at
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

Span = tuple[int, int]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches of the base patterns that are long enough, per kind, leftmost first."""
    found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return found


def _openers(text: str) -> dict[int, int]:
    """Where the bracket opened that closes at a position, for ``[]`` and ``<>`` of one line."""
    open_at: dict[str, list[int]] = {"]": [], ">": []}
    found = {}
    for m in _BRACKET.finditer(text):
        c = m[0]
        if c == "\n":
            for stack in open_at.values():
                stack.clear()
        elif c in "[<":
            open_at["]" if c == "[" else ">"].append(m.start())
        elif open_at[c]:
            found[m.start()] = open_at[c].pop()
    return found


def _name_before(text: str, end: int) -> tuple[str | None, int]:
    """The name that ends before ``end``, without its quotes, and its start."""
    while end and text[end - 1] in " \t":
        end -= 1
    if end and text[end - 1] in "\"'`":
        end -= 1
    start = end
    while start and (text[start - 1].isalnum() or text[start - 1] in "_.-"):
        start -= 1
    return text[start:end].lstrip("-.0123456789") or None, start


def _names_before(text: str, end: int, openers: dict[int, int], typed: bool = False) -> list[str]:
    """All names that the value after ``end`` is given to."""
    names = []
    while True:
        while end and text[end - 1] in " \t":
            end -= 1
        at = openers.get(end - 1)
        if at is None:
            break
        inner = text[at + 1 : end - 1].strip() if text[at] == "[" else ""
        if m := _NAME.fullmatch(inner.strip("\"'`").lstrip(":")):
            names.append(m[0])
            if inner[0] in "\"'`":
                return names
        end = at
    name, start = _name_before(text, end)
    if name:
        names.append(name)
    while start and text[start - 1] in " \t&*?":
        start -= 1
    if name and not typed and start > 1 and text[start - 1] == ":" and text[start - 2] != ":":
        # a type, or a value that holds an assignment of its own
        names += _names_before(text, start - 1, openers, True)
    return list(dict.fromkeys(names))


def _literal_term(m: re.Match) -> tuple[str, Span]:
    span = m.span("long" if m["triple"] else "body")
    if set(m["prefix"] or "") & set("fF$"):
        fixed = re.sub(r"\{[^{}]*\}", "", m["long" if m["triple"] else "body"])
        if len(fixed) < SHORTEST:
            return "name", span  # nothing but placeholders
    return "literal", span


def _sum(text: str, at: int, inside: bool) -> tuple[list[tuple[str, Span]], int]:
    """Terms of the sum at ``at``: ``('literal' | 'name' | 'bare', span)``, and its end."""
    terms, end = [], at
    while True:
        if m := _LITERAL.match(text, at):
            terms.append(_literal_term(m))
            end = m.end()
            beside = (_SPACE if inside else _BLANK).match(text, end).end()
            if _LITERAL.match(text, beside):
                at = beside
                continue
        elif m := _BARE.match(text, at):
            plain = _NAME.fullmatch(m[0].split("+")[0])
            if plain and (terms or "+" in m[0] or _PLUS.match(text, m.end())):
                m = _NAME.match(text, at)
                terms.append(("name", m.span()))
            elif terms:
                break
            else:
                terms.append(("bare", m.span()))
            end = m.end()
        else:
            break
        more = _PLUS.match(text, end)
        if not more:
            break
        at = more.end()
    return terms, end


class _Quoted(list):
    """Values that all hold a literal; lists go up through brackets without being looked at again."""


def _quoted(values: list[list[tuple[str, Span]]]) -> _Quoted:
    if isinstance(values, _Quoted):
        return values
    return _Quoted(v for v in values if any(kind == "literal" for kind, _ in v))


def _run(steps):
    """Result of a generator that yields the generators it waits for; no recursion."""
    stack, value = [steps], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def _elements(text: str, at: int, lookup: bool, known: dict):
    """Values with literals in the brackets that opened before ``at``, and their end."""
    found, first = _Quoted(), lookup
    while True:
        at = _SPACE.match(text, at).end()
        key = _KEY.match(text, at)
        if key:
            at = key.end()
        if at not in known:
            known[at] = yield _value_steps(text, at, True, known)
        values, end = known[at]
        # what has a key of its own belongs to that
        if key[2] in FALLBACKS if key else not first:
            values = _quoted(values)
            found = _Quoted(found + values) if found else values
        first = False
        at = _SPACE.match(text, end).end()
        if text[at : at + 1] != ",":
            break
        at += 1
    return found, at + (text[at : at + 1] in tuple(")]}"))


def _value_steps(text: str, at: int, inside: bool, known: dict):
    """Terms of every value at ``at``, and the end of the last; see ``_run``.

    ``known`` holds what was found at positions within brackets, which the assignments there
    look at again.
    """
    call = _CALL.match(text, at)
    group = call or _GROUP.match(text, at)
    values, end = [], at
    if group:
        lookup = bool(call and _LOOKUP.search(call[1]))
        values, end = yield _elements(text, group.end(), lookup, known)
        if m := _TAIL.match(text, end):
            end = m.end()
    if not values and not (group and inside):
        terms, upto = _sum(text, at, inside)
        if terms:
            values, end = [terms], max(end, upto)
    while other := _ELSE.match(text, end):
        if _LITERAL.match(text, other.end()):
            terms, end = _sum(text, other.end(), inside)
            values = values + _quoted([terms])
        else:
            break
    return values, end


def _value_at(text: str, operator: re.Match) -> tuple[int, list[list[tuple[str, Span]]]] | None:
    """Where the value after an operator begins if that is on a later line; one word's terms."""
    below = _BELOW.match(text, operator.end())
    if not below:
        return operator.end(), []
    at = _SPACE.match(text, below.end()).end()
    literal = _LITERAL.match(text, at)
    if (literal and not _KEY.match(text, at)) or _GROUP.match(text, at):
        return at, []
    line = _LINE.match(text, below.end()) if operator[0].startswith(":") else None
    if line and not line[2].endswith(":") and not line[2].startswith(("-", "#")):
        start = text.rfind("\n", 0, operator.start()) + 1
        if len(line[1]) > _BLANK.match(text, start).end() - start and "=" not in line[2].rstrip("="):
            return at, [[("bare", line.span(2))]]
    return None


def assignments(text: str) -> list[tuple[str, list[tuple[str, Span]]]]:
    """``(name, terms)`` for every name and value of an assignment, in the order of the text."""
    found, known = [], {}
    openers = _openers(text)
    for m in _OPERATOR.finditer(text):
        names = _names_before(text, m.start(), openers)
        place = _value_at(text, m) if names else None
        if place:
            values = place[1] or _run(_value_steps(text, place[0], False, known))[0]
            found += [(name, terms) for terms in values for name in names]
    return found


def name_score(name: str) -> float:
    """0 to 1: the sum of what its words say, at most 1."""
    words = [w.lower() for w in _WORDS.findall(name)]
    pairs = ["".join(p) for p in zip(words, words[1:])]
    return min(1.0, sum(SENSITIVE.get(w, 0.0) for w in words + pairs))


class Value:
    """What is known of a value: its length, how often each character occurs, and its beginning."""

    __slots__ = ("size", "counts", "head")

    def __init__(self, text: str = ""):
        self.size, self.counts, self.head = len(text), Counter(text), text[:HEAD]

    def add(self, other: Value) -> None:
        """``other`` behind this one."""
        self.size += other.size
        for c, n in other.counts.items():
            self.counts[c] += n
        if len(self.head) < HEAD:
            self.head = (self.head + other.head)[:HEAD]
        if self.size > 1 << 62:  # a value that doubles again and again: the shares are enough
            self.counts = Counter({c: n // 2 + 1 for c, n in self.counts.items()})
            self.size = sum(self.counts.values())

    def placeholder(self) -> bool:
        if self.size <= HEAD:
            return bool(PLACEHOLDERS.match(self.head))
        one = {c.lower() for c in self.counts}
        return one in ({"x"}, {"*"}, {"."}) or bool(PLACEHOLDERS.match(self.head) and "\n" not in self.counts)

    def score(self) -> float:
        """0 to 1: long, varied and no placeholder."""
        if self.size < SHORTEST or self.placeholder() or self.head.startswith(("${", "{{", "<", "%(")):
            return 0.0
        shares = [n / self.size for n in self.counts.values()]
        entropy = -sum(p * math.log2(p) for p in shares)
        return max(0.0, min(1.0, entropy / 3.0) - 2 * self.counts.get(" ", 0) / self.size)


def literal_score(value: str) -> float:
    return Value(value).score()


def asked_of(uses: dict[str, list[str]]) -> dict[str, float]:
    """The best name score among a name and all that use it, over any number of steps.

    ``uses`` lists the names that a name's values mention.  The best name claims all it reaches,
    then the next best what is left.
    """
    asked: dict[str, float] = {}
    for score, name in sorted(((name_score(n), n) for n in uses), reverse=True):
        todo = [] if name in asked else [name]
        while todo:
            at = todo.pop()
            if at not in asked:
                asked[at] = score
                todo += uses[at]
    return asked


def literal_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    """Literals assigned, directly or over constants, to names that ask for secrecy."""
    pairs = assignments(text)
    uses: dict[str, list[str]] = {name: [] for name, _ in pairs}
    latest: dict[str, int] = {}  # the value that a name has so far
    values: list[Value] = []
    owns: list[list[Span]] = []  # literals in a value itself
    parts: list[list[int]] = []  # values that a value mentions
    for name, terms in pairs:
        value, own, mentioned = Value(), [], []
        for kind, span in terms:
            word = text[span[0] : span[1]]
            if kind == "literal" or word not in uses:
                # an unknown name in a sum is no literal
                if kind != "name":
                    own.append(span)
                    value.add(Value(word))
            else:
                uses[name].append(word)
                if word in latest:
                    mentioned.append(latest[word])
                    value.add(values[latest[word]])
        latest[name] = len(values)
        values.append(value)
        owns.append(own)
        parts.append(mentioned)

    asked = asked_of(uses)
    # a part of a longer secret counts as the whole does: from later values to what they mention
    looks = [value.score() if asked[name] else 0.0 for value, (name, _) in zip(values, pairs)]
    for at in range(len(values) - 1, -1, -1):
        for part in parts[at]:
            looks[part] = max(looks[part], looks[at])
    secrecy: dict[Span, float] = {}
    likeness: dict[Span, float] = {}
    for (name, _), own, look in zip(pairs, owns, looks):
        for span in own:
            secrecy[span] = max(secrecy.get(span, 0.0), asked[name])
            likeness[span] = max(likeness.get(span, 0.0), look)
    return [(*s, "literal") for s, score in secrecy.items() if score * likeness[s] >= threshold]


def ordered(spans: list[tuple[int, int, str]]) -> str:
    """``kind:start:end``, by start, then kind."""
    spans = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(
    docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` with counts per base kind, the digest of the base spans and all spans."""
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]]
    fields += [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]

    def make():
        def run(texts: pa.Array) -> list[pa.Array]:
            out: list[list] = [[] for _ in fields]
            for text in texts.to_pylist():
                base = base_spans(text or "")
                more = literal_spans(text or "", threshold)
                counts = Counter(s[2] for s in base)
                digest = hashlib.sha256(ordered(base).encode()).hexdigest()
                row = [*(counts[k] for k in KINDS[:3]), digest, ordered(base + more)]
                for column, value in zip(out, row):
                    column.append(value)
            types = [pa.int64()] * 3 + [pa.string()] * 2
            return [pa.array(c, t) for c, t in zip(out, types)]

        return run

    return with_text_columns(docs, text_col, fields, make, keep)
