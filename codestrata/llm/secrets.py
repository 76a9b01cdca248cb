"""Secret scanning by assignment: which name is a literal given to, and is it a name that holds secrets?

A text is lexed once from its begin to its end: literals (in quotes, in three of them or in backticks over lines, with their
escapes undone for scoring), private keys, targets with their operator, brackets, tags, comment marks, lines with their
indentation, words. A parser takes name-literal pairs from the tokens, in the forms of source code and configuration files:
``name = "x"``, ``name: 'x'``, ``"name": "x"``, ``name => x``, ``name := x``, ``Type name = "x"``, ``name: Type = "x"``,
``export NAME=x``, ``<a name="x">``, ``<name>x</name>``, ``--name=x``, bare ``NAME=x``, block scalars (``name: |`` with the deeper lines that
follow), and pairs that give name and value apart (``name: PASSWORD`` then ``value: x``, ``key="password" value="x"``). It holds the
brackets and indented keys it is in; a name that only says "value" is read with the key around it. Literals joined by
``+``, ``.`` or nothing are one. A right side that is a name takes the literal that this name has at that place (constants
are propagated, over any number of steps and also as a part of a joined literal; a name assigned anew has its new value from
there on). A literal's score adds up what its target name says, how random it looks, and whether it has a known form;
placeholders and references to the environment score nothing. ``score >= least`` is a finding; a literal of a known form is
one whatever its name says.

A bare value is a literal if it has a known form or a digit, or ends its line and is neither a dotted name nor
assignments itself, as those are code. Amid a line a bare value after ``:`` is taken as prose unless it has a known form or
both letters and digits, and one after ``=`` only counts for names that score 0.5.

Defined results: null and empty texts have no findings; a text without ``=``, ``:`` and ``</`` can have none and is not lexed;
texts are lexed whole and in linear time; a literal found twice at the same place counts once, with its highest score;
repeated rows repeat their findings; null ids stay null; extra columns are kept by redaction; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, slices, table

LEAST = 0.6
REDACTED = "[REDACTED]"

_STRING = r"""(?:\"{3}(?:[^"\\]|\\(?s:.)|"(?!""))*+\"{3}|'{3}(?:[^'\\]|\\(?s:.)|'(?!''))*+'{3}|"-----BEGIN[^"]*+"|'-----BEGIN[^']*+'|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\(?s:.))*+`)"""
_PEM = r"(?:[|>][+\-]?+[ \t]*+\n)?+[ \t]*+-----BEGIN[ ](?:[^-]|-(?!----(?:BEGIN|END)))*+-----END[ ][A-Z0-9 ]*+-----"
_JOIN = r"(?:[ \t]*+[+.][ \t]*+(?:\n[ \t]*+)?+|[ \t]*+\n[ \t]*+[+.][ \t]*+|[ \t]*+)"
_TOKEN = re.compile(
    rf"""
    (?P<target>
        (?<![\w.$\-])(?:--?)?(?P<quote>["']?)(?P<name>[A-Za-z_$][\w.$\-]*+)(?P=quote)   # perhaps in quotes
        (?:\[(?P<key>{_STRING})\])?+                                            # config["password"]
        [ \t]*+(?::[ \t]*+[A-Za-z_][\w<>\[\].|?]*+[ \t]*+(?==[^=>]))?+           # name: Type =
        (?P<op>:=|=>|=(?![=>])|:(?![:/]))[ \t]*+)
  | (?P<string>{_STRING})
  | <(?P<tag>[A-Za-z_][\w.\-]*+)(?:[ \t][^<>\n]*+)?>(?P<inner>[^<>]*+)</(?P=tag)>
  | (?P<open>[{{\[(])
  | (?P<close>[}}\])])
  | (?P<line>\n[ \t]*+)
  | (?P<word>[\w.$\-]++)
  | (?P<blank>[ \t\r]++)
  | (?P<other>(?s:.))
    """,
    re.VERBOSE,
)
_RIGHT = re.compile(rf"(?P<literals>[rbfuRBFU@]{{0,2}}{_STRING}(?:{_JOIN}{_STRING})*+)|(?P<pem>{_PEM})|(?P<block>[|>][+\-]?\d?[ \t]*+(?=\n))|(?P<bare>\$?[^\s\"'`,;(){{}}\[\]<>]++)")
_MORE = re.compile(rf"[ \t]*+[+.][ \t]*+(?:{_STRING}|(?P<name>\$?[A-Za-z_][\w.\-]*+))")
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|(.))", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}
#: Words that may stand before a target at the begin of its line.
_LEAD_COLON, _LEAD = {"export"}, {"export", "set", "const", "let", "var", "ENV"}
_NAMED, _VALUED = {"name", "key", "field", "variable", "id"}, {"value", "val", "default", "content", "data", "text", "string"}
_LITERAL = re.compile(_STRING)
_NAME = re.compile(r"\$?[A-Za-z_][\w.\-]*\Z")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_STRONG = {"password", "passwd", "pwd", "passphrase", "secret", "secrets", "token", "apikey", "credential", "credentials", "privatekey", "accesskey", "pass", "authtoken", "secretkey", "bearer"}
_PAIRS = {("api", "key"), ("access", "key"), ("private", "key"), ("secret", "key"), ("signing", "key"), ("encryption", "key"), ("auth", "key"), ("connection", "string"), ("client", "secret"), ("master", "key")}
_WEAK = {"key", "auth", "authorization", "signature", "salt", "cert", "session", "cookie", "login"}
_HARMLESS = {"count", "counts", "length", "len", "size", "max", "min", "limit", "type", "name", "path", "file", "url", "field", "regex", "pattern", "policy", "expiry", "ttl", "id", "num", "index", "header", "label", "hint"}
_PLACEHOLDER = re.compile(
    r"(?i)\A(?:x{3,}|\*{2,}|\.{3,}|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|\$\w+|your[ _-].*|my[ _-]?(?:password|secret|token)|change[ _-]?me.*|example.*|.*placeholder.*|password|secret|token|test|dummy|sample|none|null|nil|true|false|undefined|todo|\d{1,4}|os\.environ.*|process\.env.*|env\(.*)\Z"
)
_FORM = re.compile(
    r"\A(?:AKIA[0-9A-Z]{16}|gh[pousr]_\w{30,}|xox[baprs]-[\w-]{10,}|sk-[\w-]{16,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]*|-----BEGIN .*|AIza[\w-]{35}|glpat-[\w-]{16,})"
)


_DIGIT = re.compile(r"\d")
_INDENT = re.compile(r"[ \t]*+")
_END = re.compile(r"[ \t\r]*(?:#.*)?(?:\n|\Z)")
_DOTTED = re.compile(r"\$?[A-Za-z_]\w*(?:(?:\.|->|::)[A-Za-z_]\w*)+")
_PUBLIC = re.compile(r"-----BEGIN [A-Z0-9 ]*(?:CERTIFICATE|PUBLIC KEY)")


def _content(literal: str) -> str:
    """What stands within a literal's quotes."""
    return literal[3:-3] if literal[:3] in ('"""', "'''") and len(literal) >= 6 else literal[1:-1]


def name_score(name: str) -> float:
    """How much a target's name says that its value is secret, 0 to 0.5."""
    parts = [p.lower() for p in _PART.findall(name)]
    if not parts:
        return 0.0
    if parts[-1] in _HARMLESS:
        return 0.0
    if _STRONG & set(parts) or "".join(parts[-2:]) in _STRONG or _PAIRS & set(zip(parts, parts[1:], strict=False)):
        return 0.5
    return 0.2 if _WEAK & set(parts) else 0.0


def literal_score(value: str) -> float:
    """How much a literal looks like a secret, 0 to 0.6; below 0 for placeholders."""
    if len(value) < 4 or _PLACEHOLDER.match(value):
        return -1.0
    if _FORM.match(value.strip()):
        return 0.6
    if any(c.isspace() for c in value):
        return 0.05 if len(value) < 80 else 0.0
    counts = [value.count(c) for c in set(value)]
    bits = -sum(c / len(value) * math.log2(c / len(value)) for c in counts)
    kinds = sum(map(bool, (re.search(r"[a-z]", value), re.search(r"[A-Z]", value), re.search(r"\d", value), re.search(r"[^\w]", value))))
    return 0.1 + min(0.2, len(value) / 100) + min(0.15, max(0.0, bits - 2) / 10) + 0.05 * max(0, kinds - 1)


def unescaped(content: str) -> str:
    """The characters that a literal's escapes stand for."""
    if "\\" not in content:
        return content
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN.get(m[3], m[3]), content)


class Pair:
    """A target and the value that it is given: its place in the text, within its quotes, and how it was written."""

    __slots__ = ("begin", "end", "how", "target", "value")

    def __init__(self, target: str, value: str, begin: int, end: int, how: str) -> None:
        self.target, self.value, self.begin, self.end, self.how = target, value, begin, end, how


class Parser:
    """Name-literal pairs of a text, in order."""

    def __init__(self, text: str, at: int = 0, stop: int | None = None, constants: dict[str, Pair] | None = None) -> None:
        self.text, self.at, self.stop = text, at, len(text) if stop is None else stop
        self.constants: dict[str, Pair] = {} if constants is None else constants
        self.inside: tuple[int, int] | None = None  # a literal over lines, which is read for assignments too
        self.around: list[tuple[int, str]] = []  # keys of the brackets we are in (indent -1) and of less indented lines
        self.indent, self.brackets, self.digit_at = 0, 0, -1
        self.named: tuple[str, int] | None = None  # the literal of "name:", and the number of brackets around it
        self.lead_colon = self.lead = True  # nothing but what may lead stands between the line's begin and here

    def pairs(self) -> Iterator[Pair]:
        text, token = self.text, _TOKEN.match
        self.start_line(_INDENT.match(text, self.at, self.stop).end() - self.at)
        last = ""
        while m := token(text, self.at, self.stop):
            kind, self.at = m.lastgroup, m.end()
            if kind == "op" or m["target"] is not None:
                name = f"{m['name']}.{m['key'][1:-1]}" if m["key"] else m["name"]
                pair = self.right(name, m["op"], m.start("op") > m.start() and m["quote"] != "")
                last = name
                if pair:
                    yield self.settled(pair)
                if self.inside:
                    yield from Parser(text, *self.inside, self.constants).pairs()
                    self.inside = None
                self.lead = self.lead_colon = False
                continue
            if m["line"] is not None:
                self.start_line(m.end() - m.start() - 1)
            elif m["tag"] is not None:
                value = m["inner"].strip()
                begin = m.start("inner") + m["inner"].find(value) if value else m.start("inner")
                if value and "\n" not in value:
                    yield self.settled(Pair(m["tag"], value, begin, begin + len(value), "bare"))
                self.at = m.start("inner")
            elif m["open"]:
                self.enter(-1, last)
            elif m["close"]:
                while self.around and self.around.pop()[0] >= 0:
                    pass
                self.brackets = max(0, self.brackets - 1)
                self.named = None
            elif m["word"]:
                self.lead_colon = self.lead_colon and (m["word"] in _LEAD_COLON or not m["word"].strip("-"))
                self.lead = self.lead and (m["word"] in _LEAD or not m["word"].strip("-"))
            elif m["string"]:
                self.lead = self.lead_colon = False
                if "\n" in m["string"]:
                    yield from Parser(text, m.start() + (len(m["string"]) - len(_content(m["string"]))) // 2, m.end(), self.constants).pairs()
            elif m["other"]:
                self.lead_colon = self.lead_colon and m["other"] == "#"
                self.lead = self.lead and m["other"] in "#;&?"
            last = "" if m["blank"] is None else last

    def enter(self, indent: int, name: str) -> None:
        """Into a bracket (indent -1) or below a key; one without a name has that of the one around it."""
        self.around.append((indent, name or (self.around[-1][1] if self.around else "")))
        self.brackets += indent < 0

    def start_line(self, indent: int) -> None:
        self.indent = indent
        self.lead = self.lead_colon = True
        while self.around and self.around[-1][0] >= indent:
            self.around.pop()

    def settled(self, pair: Pair) -> Pair:
        """The pair under the name that says most, remembered as a constant."""
        name = pair.target.rpartition(".")[2].lower()
        self.constants[pair.target] = pair
        if name in _NAMED:
            self.named = (pair.value, self.brackets) if _NAME.match(pair.value) else None
        elif name in _VALUED:
            outer = self.named[0] if self.named and self.named[1] == self.brackets else self.around[-1][1] if self.around else ""
            self.named = None
            if outer and name_score(outer) > name_score(pair.target):
                return Pair(f"{outer}.{pair.target}" if outer.rpartition(".")[2] != pair.target else outer, pair.value, pair.begin, pair.end, pair.how)
        else:
            self.named = None
        return pair

    def right(self, target: str, op: str, quoted: bool) -> Pair | None:
        """What stands to the right of an operator, which ends at ``at``; ``at`` moves on behind what need not be read again."""
        text, begin = self.text, self.at
        m = _RIGHT.match(text, begin, self.stop)
        if op == ":" and (m is None or m["block"] is not None) and _END.match(text, m.end() if m else begin, self.stop):
            self.enter(self.indent, target)
        if m is None:
            return None
        if m["literals"] is not None:
            return self.literals(target, m)
        if m["pem"] is not None:
            self.at = m.end()
            start = begin + m[0].index("-----BEGIN")
            return Pair(target, text[start : m.end()], start, m.end(), "bare")
        if m["block"] is not None:
            return self.block(target, m.end())
        right = m["bare"]
        if _NAME.match(right.rstrip(".:")) and (known := self.constants.get(right.rstrip(".:").lstrip("$"))):
            end, value = self.joined(begin + len(right.rstrip(".:")), known.value)
            if end > begin + len(right):
                self.at = end
                return Pair(target, value, begin, end, "propagated")
            return Pair(target, known.value, known.begin, known.end, "propagated")
        if self.digit_at < begin:
            self.digit_at = d.start() if (d := _DIGIT.search(text, begin, self.stop)) else self.stop
        form, digit = bool(_FORM.match(right)), self.digit_at < begin + len(right)
        mixed = digit and op == ":" and bool(re.search(r"[A-Za-z]", right))
        if op == ":" and not (form or mixed or (self.lead_colon and not quoted)):
            return None
        if op != ":" and not form and not self.lead and name_score(target) < 0.5:
            return None
        whole = right.find("=", 0, len(right) - 2) < 0 and not _PLACEHOLDER.match(right.rstrip("=")) and _END.match(text, m.end(), self.stop) and not _DOTTED.fullmatch(right)
        return Pair(target, right, begin, begin + len(right), "bare") if form or digit or whole else None

    def literals(self, target: str, m: re.Match) -> Pair:
        found = list(_LITERAL.finditer(m[0]))
        begin = m.start()
        value = "".join(unescaped(_content(x[0])) for x in found)
        lead, tail = ((len(x[0]) - len(_content(x[0]))) // 2 for x in (found[0], found[-1]))
        end, joined = self.joined(m.end(), value)
        if end > m.end():
            self.at = end
            return Pair(target, joined, begin, end, "propagated")
        self.at = m.end()
        if any("\n" in x[0] for x in found):
            self.inside = begin + found[0].start() + lead, begin + found[-1].end() - tail
        return Pair(target, value, begin + found[0].start() + lead, begin + found[-1].end() - tail, "literal")

    def joined(self, at: int, value: str) -> tuple[int, str]:
        """The value with the constants and literals that are joined to it from ``at`` on, and where they end; at least one constant is among them."""
        end, out, parts, names = at, value, value, False
        while m := _MORE.match(self.text, at, self.stop):
            if m["name"] is None:
                x = _LITERAL.search(m[0])
                parts += unescaped(_content(x[0]))
            elif known := self.constants.get(m["name"].lstrip("$")):
                parts, names = parts + known.value, True
            else:
                break
            at = m.end()
            end, out = at, parts
        return (end, out) if names else (0, value)

    def block(self, target: str, at: int) -> Pair | None:
        """The lines below that are indented more deeply; they are also read for assignments inside them."""
        text, begin, end = self.text, -1, -1
        while at < self.stop:
            stop = text.find("\n", at + 1, self.stop)
            stop = self.stop if stop < 0 else stop
            first = _INDENT.match(text, at + 1, self.stop).end()
            if first < stop:
                if first - at - 1 <= self.indent:
                    break
                begin, end = (first if begin < 0 else begin), stop
            at = stop
        if begin < 0:
            return None
        value = text[begin:end].rstrip()
        if value.startswith("-----BEGIN"):
            self.at = end
        return Pair(target, value, begin, begin + len(value), "bare")


def scan(text: str, least: float = LEAST) -> list[tuple[str, int, int, str, float]]:
    """Findings (name, begin, end, how, score) in order of place: the literal's place in characters, within its quotes."""
    found: dict[tuple[int, int], tuple[str, str, float]] = {}
    for p in Parser(text).pairs():
        score = name_score(p.target)
        form = p.value.strip()
        if score or (_FORM.match(form) and not _PUBLIC.match(form)):
            score = round(score + literal_score(p.value), 4)
            key = (p.begin, p.end)
            if score >= least and (key not in found or found[key][2] < score):
                found[key] = (p.target, p.how, score)
    return [(n, b, e, how, s) for (b, e), (n, how, s) in sorted(found.items())]


def _may_assign() -> "F.Column":
    return F.contains("text", F.lit("=")) | F.contains("text", F.lit(":")) | F.contains("text", F.lit("</"))


def findings(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, name, begin, end, how, score, digest): where each secret stands, and the MD5 of it, never itself."""
    import hashlib

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [
                    (i, *f, hashlib.md5(text[f[1] : f[2]].encode()).hexdigest())
                    for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                    for f in scan(text, least)
                ]
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                        ["doc_id", "name", "begin", "end", "how", "score", "digest"],
                    )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(_may_assign())
    return rows.mapInArrow(run, "doc_id long, name string, begin int, end int, how string, score double, digest string")


def redact(text: str, least: float = LEAST) -> str:
    """The text with each secret replaced."""
    out, at = [], 0
    for _, begin, end, _, _ in scan(text, least):
        if begin >= at:
            out += [text[at:begin], REDACTED]
            at = end
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """All documents, their secrets replaced; ``n_chars`` follows where the text changed."""
    (new,) = fresh(docs, "_redacted")

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else redact(t, least))

    out = docs.withColumn(new, cleaned(F.when(_may_assign(), F.col("text"))))
    changed = F.col(new).isNotNull() & (F.col(new) != F.col("text"))
    columns = {"text": F.coalesce(new, "text"), "n_chars": F.when(changed, F.char_length(new).cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(table(spark, sf_dir, "documents"))


QUERIES = {"op8_secret_scan": op8}
ORACLE_SQL: dict[str, str] = {}
