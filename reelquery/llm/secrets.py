"""Secret scanning: assignment-aware lexing over base patterns.

``find`` returns the spans ``(kind, start, end)`` of one text in code points, end exclusive.  Base kinds:

* ``assign``: a sensitive word, ``:`` or ``=``, and a value of 6 or more characters; the whole match
* ``access``: ``AKIA`` and capitals or digits, 20 or more characters in all
* ``hex``: a run of 24 or more lower-case hexadecimal digits

Matches are leftmost and do not overlap within a kind; those that are too short are dropped *after* matching.

The lexer adds ``literal`` spans.  It reads every line that holds an operator from left to right as strings, names, operators and
the rest, and pairs names with literals: ``name = literal``, ``name: literal``, ``"name" => literal``, ``x["name"] = literal``, typed
targets (``name: type = literal``), joined literals (``"a" + "b"``) and bare values; what stands in a string is read as text of its
own once more.  The constant a name was given is carried to other names (``X = "..."; password = X``), unless it was given in a
comment line; a bare value is carried to ``$X`` and ``${X}`` only, if its name starts a line (``X=...``, then ``PASSWORD=${X}``).  A
literal is scored by its target's sensitive words, its length and its variety, and is reported from ``THRESHOLD`` on; a constant
that reaches a sensitive name later is reported where it was written.  A literal is a span, and a joined one a list of literals,
never a copy, so the work is in proportion to the text whatever it holds.

What a name is given is no literal if it is an expression: a call, an index, or dotted names without digits (``os.environ``).  The quoted
alternatives of an expression are: ``c ? "..." : "..."``, ``x || "..."``, ``x ?? "..."`` and, after ``=``, ``x or "..."`` and ``"..." if c else "..."``;
each counts on its own and none is carried.  Under a sensitive name the lines of a YAML block scalar are its parts, and the value of a nested
key such as ``value`` or ``default`` is its own (``{"password": {"value": "..."}}``, and the same by indentation).  ``<name>...</name>`` without blanks,
and ``name="..." value="..."`` within an element, are pairs too.

Every text is read whole; null counts as empty.  Spans may overlap across kinds.  Repeated rows give equal rows; an empty table gives
none; columns other than ``secret_spans`` travel along.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "literal")
THRESHOLD = 0.6
# fixed values: the base patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the same as dropping short ones afterwards
WORDS = ("pass", "secret", "token", "api")
#: How strongly a word in a target's name says that its value is secret.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "authtoken": 1.0, "bearer": 0.8, "auth": 0.6, "key": 0.4}
#: A key alone says little; these words before it say that it is secret.
SENSITIVE |= {f"{w}key": 0.9 for w in ("encryption", "decryption", "signing", "signature", "master", "shared", "session", "hmac", "aes", "rsa", "ssh", "cipher", "crypto", "account", "storage", "service", "deploy", "client", "jwt", "cookie", "webhook")}
#: Values that stand for a secret without being one.
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|none|null|true|false|change_?me|example.*|placeholder|your[_-].*|todo|test|dummy|string|str|int|bool)$")

_OP = re.compile(r"[:=]")
_STRING = r"""(?:[rbfuRBFU]{1,2}(?=["'`]))?(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`]*)`)"""
_QUOTED = re.compile(_STRING)
#: A string (no apostrophe inside a word), a name, an operator, what may stand between a name and its operator, anything else.
_TOKEN = re.compile(rf"""(?<![A-Za-z0-9_]){_STRING}|(?P<name>[A-Za-z0-9_.$@-]+)|(?P<op>=>|:=|[=!<>~]=+|::+|:/|[:=])|(?P<blank>[ \t\]]+)|[^\n]""")
_NAME = re.compile(r"[A-Za-z0-9_.$@-]+")
_TYPED = re.compile(r"[ \t]*[A-Za-z_][A-Za-z0-9_.]*(?:\[[^\[\]\n=:]*\])?[ \t]*=(?![=>])")
_BLANK = re.compile(r"[ \t]*")
_EXPRESSION = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*[(\[]|[A-Za-z_]+(?:\.[A-Za-z_]+)+(?![A-Za-z0-9+/_.=@$-])")
#: What stands before a quoted alternative: a bounded stretch of brackets, strings and the rest.
_BEFORE = r"""(?:\([^()\n]{0,150}\)|\[[^\[\]\n]{0,150}\]|"[^"\n]{0,100}"|'[^'\n]{0,100}'|[^\n?|;{},()\[\]"'`]){0,60}?"""
_CHOICE = re.compile(_BEFORE + r"""(?:\?\??|\|\|)[ \t]*(?=["'`])""")
_CHOICE_WORD = re.compile(_BEFORE + r"""(?:(?:\?\??|\|\|)|(?<![A-Za-z0-9_])(?:or|else))[ \t]*(?=["'`])""")
_OTHER = re.compile(r"""[ \t]*(?::|\?\?|\|\||or(?=[ \t]))[ \t]*(?=["'`])""")
# fixed values: keys that hold the value of the name above them
_HOLDER = r"""["']?(?:value|default|data|content|plain|plaintext|plain_text|string|literal)["']?[ \t]*[:=][ \t]*"""
_NESTED = re.compile(r"""\s{0,80}\{\s{0,80}(?:["']?[A-Za-z_]+["']?[ \t]*[:=][ \t]*(?:"[^"\n]{0,100}"|'[^'\n]{0,100}'|[A-Za-z0-9_.]{1,50})[ \t]*,?\s{0,80}){0,8}?""" + _HOLDER)
_INDENTED = re.compile(r"[ \t]*\n([ \t]+)" + _HOLDER)
_BLOCK = re.compile(r"[ \t]*[|>][0-9+-]{0,2}[ \t]*\n")
_BLOCK_LINE = re.compile(r"([ \t]*)([^\n]*?)[ \t\r]*(?:\n|\Z)")
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]{0,80})(?:[ \t][^<>\n]{0,200})?>\s{0,80}([^<>\s]+)\s{0,80}</\1>")
_ATTRIBUTES = re.compile(r"""(?<![A-Za-z0-9_-])(?:key|name|id)=["']([^"'\n<>]{1,80})["'][ \t]+(?:value|content)=["']([^"'\n<>]+)["']""")
_BARE = re.compile(r"[A-Za-z0-9_$][A-Za-z0-9+/_.@$-]*(?:={1,2}(?![A-Za-z0-9+/_.=@$-]))?")
_REFERENCE = re.compile(r"""(["']?)\$(?:\{([A-Za-z_][A-Za-z0-9_]*)\}|([A-Za-z_][A-Za-z0-9_]*))\1(?![A-Za-z0-9+/_.=@${"'-])""")
_LINE_START = re.compile(r"""[ \t]*(?:(?:export|set|-)[ \t]+)?["']?""")
_COMMENT = re.compile(r"[ \t]*(?:#|//|--|;)")
_JOIN = re.compile(r"[ \t]*\+?[ \t]*(?=[rbfuRBFU]{0,2}[\"'`])|[ \t]*\+[ \t]*(?=[A-Za-z_])")
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


class Literal:
    """A span of the text, or others joined.  Length (up to 12) and variety are all that a score needs."""

    __slots__ = ("length", "parts", "quoted", "real", "span", "told", "variety")

    def __init__(self, text: str = "", span: tuple[int, int] | None = None, quoted: bool = True, parts: tuple["Literal", ...] = ()):
        self.span, self.parts, self.told = span, parts, False
        if span:
            value = text[span[0] : span[1]]
            self.length, self.variety, self.real, self.quoted = min(12, len(value)), variety(value), not PLACEHOLDER.match(value), quoted
        else:
            self.length, self.variety = min(12, sum(p.length for p in parts)), max(p.variety for p in parts)
            self.real, self.quoted = any(p.real for p in parts), parts[0].quoted

    def tell(self, out: set[tuple[str, int, int]]) -> None:
        """Adds the spans it is made of; each literal does so once."""
        todo = [self]
        while todo:
            x = todo.pop()
            if not x.told:
                x.told = True
                todo += x.parts
                if x.span:
                    out.add(("literal", *x.span))


def sensitivity(name: str) -> float:
    """The strongest sensitive word in a name such as db_password, apiKey or aws.secret-access-key."""
    words = [w.lower() for w in _SPLIT.findall(name)]
    pairs = [a + b for a, b in zip(words, words[1:], strict=False)]
    return max((SENSITIVE.get(w, 0.0) for w in words + pairs), default=0.0)


def variety(value: str) -> float:
    """Shannon entropy of the characters, in bits."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def score(name: str, value: Literal) -> float:
    if value.length < 6 or not value.real:
        return 0.0
    return sensitivity(name) * (0.5 + 0.25 * value.length / 12 + 0.25 * min(1.0, value.variety / 3))


class Lexer:
    """Reads a text once, from left to right."""

    def __init__(self, text: str):
        self.text = text
        self.constants: dict[str, Literal] = {}  # by bare name
        self.settings: dict[str, Literal] = {}  # by $name

    def assignments(self) -> Iterator[tuple[str, Literal]]:
        """Names with the literals they are given, in text order, constants carried over."""
        text, at = self.text, 0
        while m := _OP.search(text, at):  # lines without an operator assign nothing
            line = max(text.rfind("\n", at, m.start()) + 1, at)
            at = text.find("\n", m.start())
            at = yield from self._line(line, at if at >= 0 else len(text), True)

    def elements(self) -> Iterator[tuple[str, Literal]]:
        """The pairs of elements and of attributes."""
        if "<" in self.text:
            for pattern in (_ELEMENT, _ATTRIBUTES):
                for m in pattern.finditer(self.text):
                    yield m[1], Literal(self.text, m.span(2))

    def _choices(self, at: int, end: int, words: bool) -> Iterator[Literal]:
        """The quoted alternatives of the expression at ``at`` on its line."""
        m = (_CHOICE_WORD if words else _CHOICE).match(self.text, at, end)
        while m and (q := _QUOTED.match(self.text, m.end(), end)):
            k = q.lastindex
            if k and q.end(k) > q.start(k):
                yield Literal(self.text, q.span(k))
            m = _OTHER.match(self.text, q.end(), end)

    def _under(self, at: int, column: int) -> Literal | None:
        """The value that stands below a name in ``column``, whose operator ends at ``at``: a block of lines, or a nested key's."""
        text = self.text
        if m := _BLOCK.match(text, at):
            parts, z = [], m.end()
            while z < len(text) and (m := _BLOCK_LINE.match(text, z)) and (len(m[1]) > column or not m[2]):
                if m[2]:
                    parts.append(Literal(text, m.span(2)))
                z = m.end()
            return parts[0] if len(parts) == 1 else Literal(parts=tuple(parts)) if parts else None
        m = _NESTED.match(text, at) or _INDENTED.match(text, at)
        if m and (m.re is _NESTED or len(m[1]) > column):
            return self._literal(m.end(), len(text))[0]
        return None

    def _line(self, at: int, end: int, outer: bool) -> Iterator[tuple[str, Literal]]:
        text, start, first = self.text, at, True
        carry = not _COMMENT.match(text, at, end)
        name, place = "", 0  # the last name, and where it stands
        while at < end:
            m = _TOKEN.match(text, at, end)
            if not m:
                break
            at = m.end()
            if m["op"]:
                value = None
                if name and m["op"] in ("=", ":", "=>", ":="):
                    typed = _TYPED.match(text, at, end) if m["op"] == ":" else None
                    value, stop = self._literal(_BLANK.match(text, typed.end() if typed else at).end(), len(text) if outer else end)
                    if outer:
                        if not value and sensitivity(name) and (below := self._under(at, place - start)):
                            yield name, below
                        yield from ((name, x) for x in self._choices(stop if value else at, end, m["op"] == "="))
                if value:
                    at = stop
                    if carry and value.quoted:
                        # what carries a name further is a quoted value, not a word of prose
                        self.constants[name] = self.settings[name] = value
                    elif carry and first and place - start < 80 and _LINE_START.fullmatch(text, start, place):
                        self.settings[name] = value
                    yield name, value
                    if outer:
                        for part in value.parts or (value,):
                            if part.span and part.quoted and start <= part.span[0] and _OP.search(text, *part.span):
                                yield from self._line(*part.span, False)
                first = False
                bare = value is not None and value.span and not value.quoted and value.span[1] == at
                name, place = (text[value.span[0] : at], value.span[0]) if bare else ("", 0)
            elif m["name"]:
                name, place = m["name"], m.start()
            elif k := m.lastindex if not m["blank"] else None:
                a, z = m.span(k)
                name, place = (m[k], m.start()) if _NAME.fullmatch(text, a, z) else ("", 0)
                if outer and _OP.search(text, a, z):
                    yield from self._line(a, z, False)
            elif not m["blank"]:
                name = ""
        return max(at, end)

    def _literal(self, at: int, end: int) -> tuple[Literal | None, int]:
        """The value that starts at ``at``, and where it ends: a known ``$name``, quoted parts joined, known names, or a bare value."""
        text = self.text
        if (m := _REFERENCE.match(text, at, end)) and m[1] != "'" and (m[2] or m[3]) in self.settings:  # single quotes do not expand
            return self.settings[m[2] or m[3]], m.end()
        parts: list[Literal] = []
        stop = at
        while True:
            if m := _QUOTED.match(text, at, end):
                k = m.lastindex
                if k and m.end(k) > m.start(k):
                    parts.append(Literal(text, m.span(k)))
            elif _EXPRESSION.match(text, at, end):
                break
            elif m := _BARE.match(text, at, end):
                if m[0] in self.constants:
                    parts.append(self.constants[m[0]])
                elif parts:
                    break
                else:
                    return Literal(text, m.span(), False), m.end()
            else:
                break
            stop = m.end()
            if not (j := _JOIN.match(text, stop, end)):
                break
            at = j.end()
        return (parts[0] if len(parts) == 1 else Literal(parts=tuple(parts)) if parts else None), stop


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans, by start and then by kind."""
    if not text:
        return []
    out = set()
    low = text.lower()
    if any(w in low for w in WORDS):
        out |= {("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6}
    if "AKIA" in text:
        out |= {("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20}
    out |= {("hex", *m.span()) for m in HEX.finditer(text)}
    lexer = Lexer(text)
    for name, value in chain(lexer.assignments(), lexer.elements()):
        if score(name, value) >= THRESHOLD:
            value.tell(out)
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``secret_spans array<struct<kind, start, end>>``; a column of that name is replaced.  No shuffle."""
    docs = docs.drop("secret_spans")
    kind = "array<struct<kind: string, start: int, end: int>>"
    schema = docs.select("*", F.lit(None).cast(kind).alias("secret_spans")).schema
    at = docs.columns.index(text)
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find(t.as_py())] for t in b.column(at)], arrow)
            yield pa.RecordBatch.from_arrays([*b.columns, spans], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def digests(scanned: DataFrame) -> DataFrame:
    """The digest columns of scanned documents, inside the JVM."""
    base = F.filter("secret_spans", lambda s: s["kind"] != "literal")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select("doc_id", *map(count, KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))
