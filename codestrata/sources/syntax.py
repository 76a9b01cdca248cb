"""A C# lexer and a tolerant recursive-descent parser: source text to a tree of plain nodes.

Made to run inside Spark tasks, one file at a time, without state between files. What doesn't parse is skipped up to the
next statement or member, so a damaged file still gives the declarations that can be read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

_TOKEN = re.compile(
    r"""
    (?P<space>[^\S\n]+|\n) | (?P<note>//[^\n]*|/\*.*?(?:\*/|\Z))
  | (?P<raw>\$*"{3,}) | (?P<hole>\$@"|@\$"|\$") | (?P<str>@"(?:[^"]|"")*"|"(?:[^"\\\n]|\\.)*")(?:u8)?
  | (?P<chr>'(?:[^'\\\n]|\\[^\n]+?)')
  | (?P<num>0[xX][\da-fA-F_]+[uUlL]*|0[bB][01_]+[uUlL]*|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?[fFdDmM]?|\d[\d_]*(?:[eE][+-]?\d+)?[fFdDmMuUlL]*)
  | (?P<id>@?[^\W\d]\w*)
  | (?P<op>\?\?=|<<=|=>|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|->|::|\?\?|\.\.|.)
    """,
    re.X | re.S,
)
_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(\w+)[ \t]*([^\n]*)")
KEYWORDS = frozenset(
    "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally "
    "fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public "
    "readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while".split()
)
PREDEFINED = frozenset("bool byte sbyte char decimal double float int uint long ulong short ushort string object void".split())
MODIFIERS = frozenset(
    "public private protected internal static abstract sealed virtual override readonly const extern unsafe volatile partial async new required file fixed ref".split()
)
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= ??= >>= >>>=".split())
_LEVELS = [{"||": "LogicalOr"}, {"&&": "LogicalAnd"}, {"|": "BitOr"}, {"^": "Xor"}, {"&": "BitAnd"}, {"==": "Equals", "!=": "NotEquals"}, {"<": "Less", ">": "Greater", "<=": "LessEquals", ">=": "GreaterEquals"}, {"<<": "Left", ">>": "Right"}, {"+": "Add", "-": "Subtract"}, {"*": "Multiply", "/": "Divide", "%": "Modulo"}]
_RELATIONAL = 6


class Token:
    __slots__ = ("begin", "end", "kind", "text")

    def __init__(self, kind: str, text: str, begin: int, end: int) -> None:
        self.kind, self.text, self.begin, self.end = kind, text, begin, end


class Node:
    """kind, child nodes, the range of its tokens, and what else its kind needs."""

    __slots__ = ("begin", "end", "info", "kids", "kind")

    def __init__(self, kind: str, kids: list[Node], begin: int, end: int, info=None) -> None:
        self.kind, self.kids, self.begin, self.end, self.info = kind, kids, begin, end, info

    def below(self) -> Iterator[Node]:
        """All descendants, in order of the text."""
        stack = self.kids[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack += node.kids[::-1]


class Unexpected(Exception):
    """The tokens aren't what the grammar wants here."""


class Uncut(Exception):
    """A text whose methods can't be parsed by themselves."""


_BRACES = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|@"(?:[^"]|"")*"|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\[^\n]+?)'|[{};]""", re.S)
_ACCESS = "public|private|protected|internal|static|abstract|sealed|virtual|override|async|new|unsafe|extern|partial|readonly"
_HEAD = re.compile(
    rf"\s*((?:(?:{_ACCESS})\s+)+(?!(?:{_ACCESS}|class|struct|interface|record|enum|delegate|event|implicit|explicit|operator|ref|const|required|file|volatile|fixed)\b)"
    r"[^\W\d][\w.]*(?:<[\w.,<> ]*>)?(?:\[\])?\??\s+[^\W\d]\w*\s*\([^(){};\"'/#]*\)\s*)\Z"
)


def methods_in(text: str, longest: int = 20_000) -> list[tuple[int, int]]:
    """Where methods with a modifier and a block begin and end, found by their braces alone; what they are, the parser says.

    Nothing is found in a text with directives, interpolated or raw strings, as they decide what its braces are.
    """
    found: list[tuple[int, int]] = []
    if "#" in text or "$" in text or '"""' in text:
        return found
    depth, behind, begin, inside = 0, 0, -1, 0
    for m in _BRACES.finditer(text):
        c = m[0]
        if c == "{":
            depth += 1
            if begin < 0:
                head = _HEAD.match(text, behind, m.start()) if text[m.start() - 1 : m.start()] in (" ", ")", "\n", "\t", "\r") else None
                if head:
                    begin, inside = head.start(1), depth
                behind = m.end()
        elif c == "}":
            if begin >= 0 and depth == inside:
                if m.end() - begin <= longest:
                    found.append((begin, m.end()))
                begin = -1
            depth -= 1
            behind = m.end()
        elif c == ";":
            behind = m.end()
    return found


def condition(text: str, defined: set[str]) -> bool:
    """The value of the condition of an #if."""
    tokens = re.findall(r"\w+|&&|\|\||==|!=|!|\(|\)", re.sub(r"//.*", "", text))
    at = 0

    def either() -> bool:
        nonlocal at
        value = both()
        while at < len(tokens) and tokens[at] == "||":
            at += 1
            value = both() or value
        return value

    def both() -> bool:
        nonlocal at
        value = same()
        while at < len(tokens) and tokens[at] == "&&":
            at += 1
            value = same() and value
        return value

    def same() -> bool:
        nonlocal at
        value = one()
        while at < len(tokens) and tokens[at] in ("==", "!="):
            equal = tokens[at] == "=="
            at += 1
            value = (value == one()) == equal
        return value

    def one() -> bool:
        nonlocal at
        token = tokens[at] if at < len(tokens) else ""
        at += 1
        if token == "!":
            return not one()
        if token == "(":
            value = either()
            at += 1
            return value
        return token == "true" or token in defined

    return either()


def tokens_of(text: str, symbols: set[str] | frozenset[str] = frozenset(), cuts: dict[int, tuple] | None = None) -> list[Token]:
    """The tokens of the active parts of a source text, ended by one of kind "end". Each of ``cuts`` (begin to end and more) is one of kind "cut"."""
    out: list[Token] = []
    defined = set(symbols)
    branches: list[list[bool]] = []  # of each #if: whether the branch is active, whether one was
    size = len(text)

    def skip_inactive(at: int) -> int:
        """From the begin of a line in an inactive branch to the line of a directive that may end it."""
        while at < size:
            m = _DIRECTIVE.match(text, at)
            if m and m[1] in ("if", "elif", "else", "endif"):
                return at
            stop = text.find("\n", at)
            at = size if stop < 0 else stop + 1
        return size

    def directive(at: int) -> int | None:
        """Behind the directive that stands at the begin of a line, or None without one."""
        m = _DIRECTIVE.match(text, at)
        if not m:
            return None
        name, outer = m[1], all(b[0] for b in branches[:-1])
        if name == "if":
            on = all(b[0] for b in branches) and condition(m[2], defined)
            branches.append([on, on])
        elif name == "elif" and branches:
            on = outer and not branches[-1][1] and condition(m[2], defined)
            branches[-1] = [on, branches[-1][1] or on]
        elif name == "else" and branches:
            branches[-1] = [outer and not branches[-1][1], True]
        elif name == "endif" and branches:
            branches.pop()
        elif name == "define":
            defined.add(m[2].split("//")[0].strip())
        elif name == "undef":
            defined.discard(m[2].split("//")[0].strip())
        end = m.end()
        if not all(b[0] for b in branches):
            return skip_inactive(min(size, end + 1))
        return end

    def lex(at: int, inside: bool) -> int:
        """Up to the end of the text, or of the hole of an interpolated string."""
        depth, fresh = 0, not inside
        while at < size:
            if cuts and (stop := cuts.get(at)):
                out.append(Token("cut", "", at, stop[0]))
                at, fresh = stop[0], False
                continue
            if fresh:
                fresh = False
                if (after := directive(at)) is not None:
                    fresh = after < size and text[after - 1] == "\n"
                    at = after
                    continue
            m = _TOKEN.match(text, at)
            kind, value = m.lastgroup, m[0]
            if kind == "space":
                fresh = value == "\n" and not inside
            elif kind == "raw":
                at = raw(at, value)
                continue
            elif kind == "hole":
                at = interpolated(at, value)
                continue
            elif kind != "note":
                if inside and kind == "op" and depth == 0 and value in "}:":
                    return at
                depth += (value in ("(", "[", "{")) - (value in (")", "]", "}"))
                out.append(Token(kind, value, at, m.end()))
            at = m.end()
        return at

    def raw(at: int, opening: str) -> int:
        dollars, quotes = opening.count("$"), opening.count('"')
        if quotes > 3 and quotes % 2 == 0 and not dollars and text.find('"' * quotes, at + quotes) < 0:
            out.append(Token("rawstr", opening, at, at + quotes))
            return at + len(opening)
        begin = at + len(opening)
        end = text.find('"' * quotes, begin)
        end = size if end < 0 else end
        if not dollars:
            out.append(Token("rawstr", text[at : end + quotes], at, min(size, end + quotes)))
            return min(size, end + quotes)
        return holes(at, begin, lambda p: text.startswith('"' * quotes, p), quotes, dollars, False)

    def interpolated(at: int, opening: str) -> int:
        verbatim = "@" in opening
        return holes(at, at + len(opening), lambda p: text[p] == '"', 1, 1, not verbatim, verbatim)

    def holes(at: int, begin: int, closes, width: int, braces: int, escapes: bool, verbatim: bool = False) -> int:
        out.append(Token("open", text[at:begin], at, begin))
        p = begin
        while p < size:
            if closes(p):
                if verbatim and text.startswith('""', p):
                    p += 2
                    continue
                break
            c = text[p]
            if c == "\\" and escapes:
                p += 2
            elif c == "{" and text.startswith("{" * braces, p):
                if braces == 1 and text.startswith("{{", p):
                    p += 2
                    continue
                out.append(Token("{", text[p : p + braces], p, p + braces))
                p = lex(p + braces, True)
                if p < size and text[p] == ":":  # a format
                    while p < size and text[p] != "}":
                        p += 1
                out.append(Token("}", text[p : p + braces], p, min(size, p + braces)))
                p += braces
            elif c == "\n" and escapes:
                break
            else:
                p += 1
        end = min(size, p + width)
        out.append(Token("close", text[p:end], p, end))
        return end

    lex(0, False)
    out.append(Token("end", "", size, size))
    return out


class Parser:
    """Parses one source text; ``types`` and ``injected`` collect what it finds on the way."""

    def __init__(self, text: str, symbols: set[str] | frozenset[str] = frozenset(), cuts: dict[int, tuple] | None = None) -> None:
        """``cuts``: for the begin of a method that was parsed by itself its end, and what stands for it in a node "Cut"."""
        self.source = text
        self.cuts = cuts
        self.tokens = tokens_of(text, symbols, cuts)
        self.at = 0
        self.damaged = False  # whether something was skipped
        self.lines = [m.start() for m in re.finditer("\n", text)]
        self.match: dict[int, int] = {}
        self.named: set[int] = set()  # tokens of declared names
        self.shifts: set[int] = set()  # the first of two ">" that are one operator
        open_: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind == "op":
                if t.text in "([{":
                    open_.append(i)
                elif t.text in ")]}":
                    wanted = "([{"[")]}".index(t.text)]
                    while t.text == "}" and open_ and self.tokens[open_[-1]].text != "{":
                        open_.pop()  # never closed
                    if open_ and self.tokens[open_[-1]].text == wanted:
                        self.match[open_.pop()] = i

    # Tokens

    def line(self, token: int) -> int:
        return bisect_right(self.lines, self.tokens[min(token, len(self.tokens) - 1)].begin - 1) + 1

    def last_line(self, node: Node) -> int:
        return bisect_right(self.lines, self.tokens[node.end - 1].end - 1) + 1

    def text(self, node: Node) -> str:
        return self.source[self.tokens[node.begin].begin : self.tokens[node.end - 1].end] if node.end > node.begin else ""

    def peek(self, ahead: int = 0) -> str:
        """The text of a coming token; "" for literals, so that they look like no operator."""
        i = self.at + ahead
        if i >= len(self.tokens):
            return ""
        t = self.tokens[i]
        return t.text if t.kind in ("op", "id") else ""

    def kind(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.tokens[i].kind if i < len(self.tokens) else "end"

    def take(self, text: str) -> bool:
        if self.peek() == text:
            self.at += 1
            return True
        return False

    def want(self, text: str) -> None:
        if not self.take(text):
            raise Unexpected(f"{text} wanted, {self.peek()} found")

    def is_name(self, ahead: int = 0) -> bool:
        return self.kind(ahead) == "id" and self.peek(ahead) not in KEYWORDS

    def name(self) -> str:
        if not self.is_name():
            raise Unexpected("name wanted")
        self.at += 1
        return self.tokens[self.at - 1].text.lstrip("@")

    def tried(self, parse, *args):
        """What a parse function gives, or None with everything as before."""
        at = self.at
        try:
            return parse(*args)
        except Unexpected:
            self.at = at
            return None

    def node(self, kind: str, kids: list, begin: int, info=None) -> Node:
        return Node(kind, [k for k in kids if k is not None], begin, self.at, info)

    # Types

    def type_arguments(self) -> list[Node]:
        self.want("<")
        out = []
        while self.peek() not in (">",):
            if self.peek() == ",":
                self.at += 1
                continue
            out.append(self.type())
            if self.peek() not in (",", ">"):
                raise Unexpected("type arguments")
        self.want(">")
        return out

    def simple_name(self, generic: bool = True) -> Node:
        begin = self.at
        text = self.name()
        if generic and self.peek() == "<" and (args := self.tried(self.type_arguments)) is not None:
            return self.node("GenericName", args, begin, text)
        return self.node("IdentifierName", [], begin, text)

    def type(self, nullable: bool = True) -> Node:
        begin = self.at
        if self.peek() in ("ref", "scoped") and (self.kind(1) == "id"):
            self.at += 1
            self.take("readonly")
            return self.node("RefType", [self.type()], begin)
        if self.peek() == "(":
            self.at += 1
            kids = []
            while True:
                kids.append(self.type())
                if self.is_name():
                    self.named.add(self.at)
                    self.at += 1
                if not self.take(","):
                    break
            self.want(")")
            if len(kids) < 2:
                raise Unexpected("tuple type")
            found = self.node("TupleType", kids, begin)
        elif self.peek() in PREDEFINED and self.kind() == "id":
            self.at += 1
            found = self.node("PredefinedType", [], begin)
        elif self.peek() == "delegate" and self.peek(1) == "*":
            self.at += 2
            self.tried(self.type_arguments)
            found = self.node("FunctionPointer", [], begin)
        else:
            found = self.simple_name()
            if self.peek() == "::":
                self.at += 1
                found = self.node("AliasQualifiedName", [found, self.simple_name()], begin)
            while self.peek() == "." and self.is_name(1):
                self.at += 1
                right = self.simple_name()
                found = self.node("QualifiedName", [found, right], begin)
        while True:
            if nullable and self.peek() == "?" and self.nullable_follows():
                self.at += 1
                found = self.node("NullableType", [found], begin)
            elif self.peek() == "*" and (self.peek(1) in ("*", ">", ")", ",") or self.is_name(1)) and self.source_is_pointer():
                self.at += 1
                found = self.node("PointerType", [found], begin)
            elif self.peek() == "[" and self.peek(1) in ("]", ","):
                self.at += 1
                while self.take(","):
                    pass
                self.want("]")
                found = self.node("ArrayType", [found], begin)
            else:
                return found

    def nullable_follows(self) -> bool:
        """Whether "?" makes the type before it nullable: what comes next can't begin the branch of a conditional."""
        after = self.peek(1)
        if after in (")", ">", ",", ";", "]", "}", "=", "{", "[", "?", "&&", "||", "??", "==", "!=", "=>", "and", "or"):
            return True
        return self.is_name(1) and self.peek(2) in ("=", ";", ",", ")", "{", "=>", "in", "(", "<", ".", "this", ":") and not (self.peek(2) == ":" or (self.peek(2) in ("(", ".", "<") and self.in_expression))

    in_expression = False

    def source_is_pointer(self) -> bool:
        return not self.in_expression

    # Expressions

    def expression(self) -> Node:
        begin = self.at
        if (made := self.lambda_()) is not None:
            return made
        if self.peek() == "from" and self.is_name(1) and (self.peek(2) == "in" or self.is_name(2)):
            if (made := self.tried(self.query)) is not None:
                return made
        if self.peek() == "throw":
            self.at += 1
            return self.node("ThrowExpression", [self.expression()], begin)
        if self.peek() == "ref":
            self.at += 1
            return self.node("RefExpression", [self.expression()], begin)
        left = self.conditional()
        if self.peek() in _ASSIGN or (self.peek() == ">" and self.peek(1) == ">="):
            if self.peek() == ">":
                self.shifts.add(self.at)
                self.at += 1
            self.at += 1
            return self.node("Assignment", [left, self.expression()], begin)
        return left

    def conditional(self) -> Node:
        begin = self.at
        left = self.coalesce()
        if self.peek() == "?":
            self.at += 1
            yes = self.expression()
            self.want(":")
            return self.node("ConditionalExpression", [left, yes, self.expression()], begin)
        return left

    def coalesce(self) -> Node:
        begin = self.at
        left = self.binary(0)
        if self.peek() == "??":
            self.at += 1
            right = self.expression() if self.peek() == "throw" else self.coalesce()
            return self.node("BinaryExpression", [left, right], begin, "??")
        return left

    def binary(self, level: int) -> Node:
        if level == len(_LEVELS):
            return self.range_()
        begin = self.at
        left = self.binary(level + 1)
        while True:
            op = self.peek()
            if level == _RELATIONAL and op in ("is", "as"):
                self.at += 1
                left = self.tested(left, begin) if op == "is" else self.node("AsExpression", [left, self.asked_type()], begin, "as")
                continue
            if level == _RELATIONAL + 1 and op == ">" and self.peek(1) == ">" and self.tokens[self.at].end == self.tokens[self.at + 1].begin and self.peek(2) != ">=":
                self.shifts.add(self.at)
                self.at += 2
                left = self.node("BinaryExpression", [left, self.binary(level + 1)], begin, ">>")
                continue
            if op not in _LEVELS[level] or (op == ">" and self.peek(1) in (">", ">=") and self.tokens[self.at].end == self.tokens[self.at + 1].begin):
                return left
            self.at += 1
            left = self.node("BinaryExpression", [left, self.binary(level + 1)], begin, op)

    def asked_type(self) -> Node:
        outer, self.in_expression = self.in_expression, True
        try:
            return self.type()
        finally:
            self.in_expression = outer

    def tested(self, left: Node, begin: int) -> Node:
        pattern = self.pattern()
        if pattern.kind == "TypePattern":
            return self.node("BinaryExpression", [left, *pattern.kids], begin, "is")
        return self.node("IsPatternExpression", [left, pattern], begin)

    def range_(self) -> Node:
        begin = self.at
        if self.take(".."):
            return self.node("RangeExpression", [self.unary()] if self.operand_follows() else [], begin)
        left = self.switched()
        if self.take(".."):
            return self.node("RangeExpression", [left, self.unary() if self.operand_follows() else None], begin)
        return left

    def switched(self) -> Node:
        begin = self.at
        left = self.unary()
        while True:
            if self.peek() == "switch" and self.peek(1) == "{":
                self.at += 2
                arms = []
                while self.peek() != "}":
                    start = self.at
                    kids = [self.pattern()]
                    if self.take("when"):
                        kids.append(self.node("WhenClause", [self.expression()], start))
                    self.want("=>")
                    kids.append(self.expression())
                    arms.append(self.node("SwitchExpressionArm", kids, start))
                    if not self.take(","):
                        break
                self.want("}")
                left = self.node("SwitchExpression", [left, *arms], begin)
            elif self.peek() == "with" and self.peek(1) == "{":
                self.at += 1
                left = self.node("WithExpression", [left, self.initializer()], begin)
            else:
                return left

    def operand_follows(self) -> bool:
        t = self.tokens[self.at]
        if t.kind in ("num", "str", "chr", "rawstr", "open"):
            return True
        if t.kind == "id":
            return t.text not in KEYWORDS or t.text in PREDEFINED or t.text in ("this", "base", "new", "typeof", "sizeof", "default", "null", "true", "false", "delegate", "checked", "unchecked", "stackalloc")
        return t.text in ("(", "~", "!")

    def unary(self) -> Node:
        begin = self.at
        op = self.peek()
        if op in ("+", "-", "!", "~", "++", "--", "&", "*", "^"):
            self.at += 1
            return self.node("PrefixUnary", [self.unary()], begin, op)
        if op == "await" and (self.kind(1) in ("id", "num", "str", "open") or self.peek(1) == "(") and self.peek(1) not in ("is", "as", "switch", "with", "in"):
            self.at += 1
            return self.node("AwaitExpression", [self.unary()], begin)
        if op == "(" and (made := self.tried(self.cast)) is not None:
            return made
        return self.postfix(self.primary(), begin)

    def cast(self) -> Node:
        begin = self.at
        self.want("(")
        outer, self.in_expression = self.in_expression, False
        try:
            kind = self.type()
        finally:
            self.in_expression = outer
        self.want(")")
        sure = kind.kind in ("PredefinedType", "ArrayType", "NullableType", "PointerType") and not (kind.kind == "NullableType" and not self.operand_follows())
        if not (self.operand_follows() or self.peek() == "await" or (sure and self.peek() in ("-", "+", "&", "*"))):
            raise Unexpected("cast")
        if self.kind() == "id" and self.peek() in ("is", "as", "switch", "with", "and", "or", "when", "in"):
            raise Unexpected("cast")
        return self.node("CastExpression", [kind, self.unary()], begin)

    def arguments(self, close: str) -> Node:
        begin = self.at
        self.at += 1
        kids = []
        while self.peek() != close:
            if self.peek() == ",":
                self.at += 1
                continue
            start = self.at
            parts = []
            if self.is_name() and self.peek(1) == ":":
                parts.append(self.simple_name(False))
                self.at += 1
            if self.peek() in ("ref", "out", "in"):
                self.at += 1
            parts.append(self.declared() or self.expression())
            kids.append(self.node("Argument", parts, start))
            if self.peek() not in (",", close):
                raise Unexpected("argument")
        self.want(close)
        return self.node("ArgumentList", kids, begin)

    def declared(self) -> Node | None:
        """``var x``, ``int x`` or ``var (a, b)`` where an expression may stand."""

        def parse() -> Node:
            begin = self.at
            if self.peek() == "var" and self.peek(1) == "(":
                self.at += 1
                return self.node("DeclarationExpression", [self.designations()], begin)
            kind = self.type()
            if not self.is_name() or self.peek(1) not in (")", ",", "]", "=", ":"):
                raise Unexpected("declaration")
            self.named.add(self.at)
            self.at += 1
            return self.node("DeclarationExpression", [kind, Node("Designation", [], self.at - 1, self.at, self.tokens[self.at - 1].text)], begin)

        if not (self.kind() == "id" and (self.kind(1) == "id" or self.peek(1) in ("<", ".", "[", "?", "("))):
            return None
        return self.tried(parse)

    def designations(self) -> Node:
        begin = self.at
        kids = []
        self.want("(")
        while self.peek() != ")":
            if self.peek() == "(":
                kids.append(self.designations())
            else:
                self.named.add(self.at)
                kids.append(Node("Designation", [], self.at, self.at + 1, self.name()))
            if not self.take(","):
                break
        self.want(")")
        return self.node("Designations", kids, begin)

    def postfix(self, left: Node, begin: int) -> Node:
        while True:
            op = self.peek()
            if op == "." and self.is_name(1):
                self.at += 1
                left = self.node("MemberAccess", [left, self.member_name()], begin)
            elif op == "->" and self.is_name(1):
                self.at += 1
                left = self.node("MemberAccess", [left, self.simple_name(False)], begin)
            elif op == "(":
                left = self.node("Invocation", [left, self.arguments(")")], begin)
            elif op == "[":
                left = self.node("ElementAccess", [left, self.arguments("]")], begin)
            elif op in ("++", "--"):
                self.at += 1
                left = self.node("PostfixUnary", [left], begin, op)
            elif op == "!" and self.tokens[self.at - 1].end == self.tokens[self.at].begin and not self.bang_is_prefix():
                self.at += 1
                left = self.node("PostfixUnary", [left], begin, op)
            elif op == "?" and self.peek(1) in (".", "[") and self.tokens[self.at].end == self.tokens[self.at + 1].begin and (self.peek(1) == "." or self.tokens[self.at - 1].end == self.tokens[self.at].begin):
                self.at += 1
                start = self.at
                if self.take("."):
                    first = self.node("MemberBinding", [self.member_name()], start)
                else:
                    first = self.node("ElementBinding", [self.arguments("]")], start)
                return self.node("ConditionalAccessExpression", [left, self.postfix(first, start)], begin)
            else:
                return left

    def bang_is_prefix(self) -> bool:
        self.at += 1
        try:
            return self.operand_follows() and self.peek() not in ("(",)
        finally:
            self.at -= 1

    def member_name(self) -> Node:
        begin = self.at
        text = self.name()
        if self.peek() == "<" and (args := self.tried(self.generic_call)) is not None:
            return self.node("GenericName", args, begin, text)
        return self.node("IdentifierName", [], begin, text)

    def generic_call(self) -> list[Node]:
        outer, self.in_expression = self.in_expression, False
        try:
            args = self.type_arguments()
        finally:
            self.in_expression = outer
        if not (self.peek() in ("(", ")", "]", "}", ":", ";", ",", ".", "?", "==", "!=", "|", "^", "&&", "||", "&", "[", "::", "{") or self.kind() == "end"):
            raise Unexpected("type arguments")
        return args

    def primary(self) -> Node:
        begin = self.at
        t = self.tokens[begin]
        if t.kind in ("num", "str", "chr", "rawstr"):
            self.at += 1
            return self.node("Literal", [], begin)
        if t.kind == "open":
            self.at += 1
            kids = []
            while self.kind() not in ("close", "end"):
                if self.kind() == "{":
                    self.at += 1
                    kids.append(self.expression())
                    if self.take(","):
                        kids.append(self.expression())
                    if self.kind() != "}":
                        raise Unexpected("hole")
                self.at += 1
            self.at += 1
            return self.node("InterpolatedString", kids, begin)
        text = self.peek()
        if t.kind == "id":
            if text in ("true", "false", "null"):
                self.at += 1
                return self.node("Literal", [], begin)
            if text == "this":
                self.at += 1
                return self.node("This", [], begin)
            if text == "base":
                self.at += 1
                return self.node("Base", [], begin)
            if text == "new":
                return self.created()
            if text in ("typeof", "sizeof") and self.peek(1) == "(":
                self.at += 2
                kind = self.type()
                self.want(")")
                return self.node("TypeOfExpression" if text == "typeof" else "SizeOfExpression", [kind], begin)
            if text == "default":
                self.at += 1
                kids = []
                if self.take("("):
                    kids = [self.type()]
                    self.want(")")
                return self.node("Default", kids, begin)
            if text in ("checked", "unchecked") and self.peek(1) == "(":
                self.at += 2
                kids = [self.expression()]
                self.want(")")
                return self.node("Checked", kids, begin)
            if text == "stackalloc":
                self.at += 1
                kids = []
                if self.kind() == "id":
                    kids.append(self.simple_name() if self.is_name() else self.type())
                if self.peek() == "[":
                    kids.append(self.arguments("]"))
                if self.peek() == "{":
                    kids.append(self.initializer())
                return self.node("StackAlloc", kids, begin)
            if text in PREDEFINED:
                self.at += 1
                return self.node("PredefinedType", [], begin)
            if text == "global" and self.peek(1) == "::":
                self.at += 2
                return self.node("AliasQualifiedName", [self.member_name()], begin)
            if text not in KEYWORDS:
                return self.member_name()
        if text == "(":
            self.at += 1
            kids = []
            while True:
                start = self.at
                parts = []
                if self.is_name() and self.peek(1) == ":" and self.peek(2) != ":":
                    parts.append(self.simple_name(False))
                    self.at += 1
                parts.append(self.declared() or self.expression())
                kids.append(parts[0] if len(parts) == 1 else self.node("Argument", parts, start))
                if not self.take(","):
                    break
            self.want(")")
            return self.node("Parenthesized" if len(kids) == 1 else "Tuple", kids, begin)
        if text == "[":  # a collection
            return self.node("Collection", [self.arguments("]")], begin)
        raise Unexpected(f"expression wanted, {t.text!r} found")

    def created(self) -> Node:
        begin = self.at
        self.want("new")
        if self.peek() == "(":
            kids = [self.arguments(")")]
            if self.peek() == "{":
                kids.append(self.initializer())
            return self.node("ImplicitObjectCreationExpression", kids, begin)
        if self.peek() == "{":
            return self.node("AnonymousObject", [self.initializer()], begin)
        if self.peek() == "[":
            self.at = self.match.get(self.at, self.at) + 1
            return self.node("ArrayCreation", [self.initializer()], begin)
        outer, self.in_expression = self.in_expression, True
        try:
            kind = self.type()
        finally:
            self.in_expression = outer
        if kind.kind == "ArrayType":
            return self.node("ArrayCreation", [kind, self.initializer() if self.peek() == "{" else None], begin)
        if self.peek() == "[":
            sizes = self.arguments("]")
            while self.peek() == "[" and self.peek(1) in ("]", ","):
                self.at = self.match[self.at] + 1
            return self.node("ArrayCreation", [Node("ArrayType", [kind], kind.begin, self.at), sizes, self.initializer() if self.peek() == "{" else None], begin)
        given = self.arguments(")") if self.peek() == "(" else None
        filled = self.initializer() if self.peek() == "{" else None
        if given is None and filled is None:
            raise Unexpected("creation")
        return self.node("ObjectCreationExpression", [kind, given, filled], begin)

    def initializer(self) -> Node:
        begin = self.at
        self.want("{")
        kids = []
        while self.peek() != "}":
            kids.append(self.initializer() if self.peek() == "{" else self.initial())
            if not self.take(","):
                break
        self.want("}")
        return self.node("Initializer", kids, begin)

    def initial(self) -> Node:
        begin = self.at
        if self.peek() == "[":
            kids = [self.arguments("]")]
            self.want("=")
            kids.append(self.initializer() if self.peek() == "{" else self.expression())
            return self.node("Assignment", kids, begin)
        if self.is_name() and self.peek(1) == "=":
            kids = [self.simple_name(False)]
            self.at += 1
            kids.append(self.initializer() if self.peek() == "{" else self.expression())
            return self.node("Assignment", kids, begin)
        return self.expression()

    def lambda_(self) -> Node | None:
        begin = at = self.at
        while self.peek(at - begin) in ("async", "static") and (self.kind(at - begin + 1) == "id" or self.peek(at - begin + 1) == "("):
            at += 1
        ahead = at - begin
        if self.peek(ahead) == "delegate":
            self.at = at + 1
            names, kids = [], []
            if self.peek() == "(":
                params = self.parameters(")")
                names, kids = [p.info["name"] for p in params], params
            kids = [*kids, self.block()]
            return self.node("AnonymousMethodExpression", kids, begin, {"names": names})
        if self.is_name(ahead) and self.peek(ahead + 1) == "=>":
            self.at = at
            name = self.name()
            self.at += 1
            return self.node("LambdaExpression", [self.lambda_body()], begin, {"names": [name], "simple": True})
        if self.peek(ahead) == "(" and at in self.match and self.peek(self.match[at] + 1 - begin) == "=>":
            self.at = at

            def parse() -> Node:
                params = self.lambda_parameters()
                self.want("=>")
                return self.node("LambdaExpression", [*params, self.lambda_body()], begin, {"names": [p.info["name"] for p in params], "simple": False})

            if (made := self.tried(parse)) is not None:
                return made
            self.at = begin
        return None

    def lambda_parameters(self) -> list[Node]:
        close = self.match[self.at]
        names, at = [], self.at + 1
        while at < close and self.tokens[at].kind == "id" and self.tokens[at].text not in KEYWORDS and self.tokens[at + 1].text in (",", ")"):
            names.append(Node("Parameter", [], at, at + 1, {"name": self.tokens[at].text.lstrip("@"), "type": None}))
            at += 2
        if at > close or self.at + 1 == close:
            self.at = close + 1
            return names
        return self.parameters(")")

    def lambda_body(self) -> Node:
        return self.block() if self.peek() == "{" else self.expression()

    def query(self) -> Node:
        begin = self.at
        kids = []
        while self.peek() in ("from", "let", "where", "orderby", "select", "group", "join", "into", "on", "equals", "by", "ascending", "descending", ",", "in"):
            word = self.peek()
            self.at += 1
            if word in ("from", "join"):
                if not (self.is_name() and self.peek(1) == "in"):
                    kids.append(self.type())
                self.named.add(self.at)
                self.name()
            elif word in ("let", "into"):
                self.named.add(self.at)
                self.name()
                if word == "let":
                    self.want("=")
                    kids.append(self.expression())
            elif word not in ("ascending", "descending"):
                kids.append(self.expression())
        if not kids:
            raise Unexpected("query")
        return self.node("QueryExpression", kids, begin)

    # Patterns

    def pattern(self) -> Node:
        begin = self.at
        left = self.pattern_and()
        while self.peek() == "or":
            self.at += 1
            left = self.node("BinaryPattern", [left, self.pattern_and()], begin, "or")
        return left

    def pattern_and(self) -> Node:
        begin = self.at
        left = self.pattern_not()
        while self.peek() == "and":
            self.at += 1
            left = self.node("BinaryPattern", [left, self.pattern_not()], begin, "and")
        return left

    def pattern_not(self) -> Node:
        begin = self.at
        if self.peek() == "not" and self.peek(1) not in (")", ";", ",", "=>", "&&", "||", ":"):
            self.at += 1
            return self.node("UnaryPattern", [self.pattern_not()], begin)
        return self.pattern_one()

    def designation(self) -> Node | None:
        if self.is_name() and self.peek() not in ("and", "or", "when", "not"):
            self.named.add(self.at)
            self.at += 1
            return Node("Designation", [], self.at - 1, self.at, self.tokens[self.at - 1].text)
        return None

    def pattern_one(self) -> Node:
        begin = self.at
        op = self.peek()
        if op in ("<", ">", "<=", ">="):
            self.at += 1
            return self.node("RelationalPattern", [self.binary(_RELATIONAL + 1)], begin)
        if op == "var":
            if self.peek(1) == "(":
                self.at += 1
                return self.node("VarPattern", [self.designations()], begin)
            if self.is_name(1):
                self.at += 1
                return self.node("VarPattern", [self.designation()], begin)
        if op == "_" and not self.is_name(1):
            self.at += 1
            return self.node("DiscardPattern", [], begin)
        if op == "[":
            self.at += 1
            kids = []
            while self.peek() != "]":
                start = self.at
                if self.take(".."):
                    kids.append(self.node("SlicePattern", [self.pattern() if self.peek() not in (",", "]") else None], start))
                else:
                    kids.append(self.pattern())
                if not self.take(","):
                    break
            self.want("]")
            return self.node("ListPattern", [*kids, self.designation()], begin)
        if op in ("{", "("):
            if op == "(":
                inner = self.tried(self.in_parentheses)
                if inner is not None and self.peek() != "{" and not (self.is_name() and self.peek() not in ("and", "or", "when")):
                    return self.node("ParenthesizedPattern", [inner], begin)
                self.at = begin
            return self.recursive(None, begin)

        def typed() -> Node:
            outer, self.in_expression = self.in_expression, True
            try:
                kind = self.type()
            finally:
                self.in_expression = outer
            if self.peek() == "{" or (self.peek() == "(" and self.peek(1) != ""):
                return self.recursive(kind, begin)
            if (name := self.designation()) is not None:
                return self.node("DeclarationPattern", [kind, name], begin)
            if self.peek() in ("+", "-", "*", "/", "(", "[", ".", "<<", "%", "++") or self.kind() in ("num", "str"):
                raise Unexpected("constant")
            return self.node("TypePattern", [kind], begin)

        if self.kind() == "id" and (op in PREDEFINED or op not in KEYWORDS) and (made := self.tried(typed)) is not None:
            return made
        return self.node("ConstantPattern", [self.binary(_RELATIONAL + 1)], begin)

    def in_parentheses(self) -> Node:
        self.want("(")
        inner = self.pattern()
        self.want(")")
        return inner

    def recursive(self, kind: Node | None, begin: int) -> Node:
        kids, parts = [kind], []
        for open_, close in (("(", ")"), ("{", "}")):
            if self.peek() != open_:
                continue
            self.at += 1
            while self.peek() != close:
                start = self.at
                if self.is_name() and (self.peek(1) in (":", ".")):
                    mark = self.at
                    while self.is_name():
                        self.at += 1
                        if not self.take("."):
                            break
                    if not self.take(":"):
                        self.at = mark
                parts.append(self.node("Subpattern", [self.pattern()], start))
                if not self.take(","):
                    break
            self.want(close)
        return self.node("RecursivePattern", [*kids, *parts, self.designation()], begin)

    # Statements

    def block(self) -> Node:
        begin = self.at
        self.want("{")
        end = self.match.get(begin, len(self.tokens) - 1)
        kids = []
        while self.at < end:
            start = self.at
            try:
                kids.append(self.statement())
            except Unexpected:
                self.at = max(start + 1, self.resume(start, end))
            if self.at <= start:
                self.at = start + 1
        self.at = min(end + 1, len(self.tokens) - 1)
        return self.node("Block", kids, begin)

    def resume(self, start: int, end: int) -> int:
        """Behind the statement that didn't parse."""
        at = start
        self.damaged = True
        while at < end:
            if self.tokens[at].kind == "cut":
                raise Uncut
            text = self.tokens[at].text if self.tokens[at].kind == "op" else ""
            if text == ";":
                return at + 1
            if text in ("(", "[", "{") and at in self.match:
                at = self.match[at]
                if text == "{":
                    return at + 1
            at += 1
        return end

    def statement(self) -> Node:
        begin = self.at
        word = self.peek()
        made = getattr(self, f"_{word}_statement", None) if self.kind() == "id" and word.isalpha() else None
        if made is not None and (made_ := made(begin)) is not None:
            return made_
        if word == "{":
            return self.block()
        if word == ";":
            self.at += 1
            return self.node("EmptyStatement", [], begin)
        if self.is_name() and self.peek(1) == ":" and self.peek(2) != ":":
            self.named.add(self.at)
            self.at += 2
            return self.node("LabeledStatement", [self.statement()], begin)
        if (made_ := self.tried(self.local_function)) is not None:
            return made_
        if (made_ := self.tried(self.local_declaration)) is not None:
            self.want(";")
            return self.node("LocalDeclarationStatement", [made_], begin)
        value = self.expression()
        self.want(";")
        return self.node("ExpressionStatement", [value], begin)

    def local_declaration(self) -> Node:
        begin = self.at
        while self.peek() in ("const", "scoped") and self.kind(1) == "id":
            self.at += 1
        kind = self.type()
        if not self.is_name() or self.peek(1) not in ("=", ";", ",", ":", "in", ")"):
            raise Unexpected("declaration")
        return self.node("VariableDeclaration", [kind, *self.declarators()], begin, kind)

    def declarators(self) -> list[Node]:
        out = []
        while True:
            start = self.at
            self.named.add(self.at)
            text = self.name()
            kids = []
            if self.peek() == "[":
                kids.append(self.arguments("]"))
            if self.take("="):
                kids.append(self.initializer() if self.peek() == "{" else self.expression())
            out.append(self.node("VariableDeclarator", kids, start, text))
            if not self.take(","):
                return out

    def local_function(self) -> Node:
        begin = self.at
        while self.peek() == "[":
            self.attribute_list()
        mods = []
        while self.peek() in ("static", "async", "unsafe", "extern"):
            mods.append(self.peek())
            self.at += 1
        kind = self.type()
        place = self.at
        text = self.name()
        if self.peek() == "<":
            self.at = self.skip_angles()
        if self.peek() != "(" or self.peek(self.match.get(self.at, self.at) + 1 - self.at) not in ("{", "=>", "where"):
            raise Unexpected("local function")
        params = self.parameters(")")
        self.constraints()
        self.named.add(place)
        body = self.body()
        return self.node("LocalFunction", [kind, *params, body], begin, {"name": text, "static": "static" in mods, "body": body})

    def skip_angles(self) -> int:
        depth, at = 0, self.at
        while at < len(self.tokens):
            text = self.tokens[at].text
            depth += (text == "<") - (text == ">")
            at += 1
            if not depth:
                return at
        raise Unexpected("type parameters")

    def _parenthesized(self) -> Node:
        self.want("(")
        value = self.expression()
        self.want(")")
        return value

    def _if_statement(self, begin: int) -> Node:
        self.at += 1
        test = self._parenthesized()
        then = self.statement()
        kids = [test, then]
        start = self.at
        if self.take("else"):
            kids.append(self.node("ElseClause", [self.statement()], start))
        return self.node("IfStatement", kids, begin)

    def _while_statement(self, begin: int) -> Node:
        self.at += 1
        test = self._parenthesized()
        return self.node("WhileStatement", [test, self.statement()], begin)

    def _do_statement(self, begin: int) -> Node:
        self.at += 1
        body = self.statement()
        self.want("while")
        test = self._parenthesized()
        self.take(";")
        return self.node("DoStatement", [body, test], begin)

    def _for_statement(self, begin: int) -> Node:
        self.at += 1
        self.want("(")
        kids = []
        if self.peek() != ";":
            if (made := self.tried(self.local_declaration)) is not None:
                kids.append(made)
            else:
                kids += self.expressions(";")
        self.want(";")
        if self.peek() != ";":
            kids.append(self.expression())
        self.want(";")
        kids += self.expressions(")")
        self.want(")")
        return self.node("ForStatement", [*kids, self.statement()], begin)

    def expressions(self, close: str) -> list[Node]:
        out = []
        while self.peek() != close:
            out.append(self.expression())
            if not self.take(","):
                break
        return out

    def _foreach_statement(self, begin: int) -> Node:
        self.at += 1
        self.want("(")
        kind, kids = "ForEachStatement", []
        if self.peek() == "(" or (self.peek() == "var" and self.peek(1) == "("):
            kind = "ForEachVariableStatement"
            kids.append(self.declared() or self.expression())
        else:
            kids.append(self.type())
            self.named.add(self.at)
            self.name()
        self.want("in")
        kids.append(self.expression())
        self.want(")")
        return self.node(kind, [*kids, self.statement()], begin)

    def _await_statement(self, begin: int) -> Node | None:
        if self.peek(1) in ("foreach", "using"):
            self.at += 1
            made = self._foreach_statement(begin) if self.peek() == "foreach" else self._using_statement(begin)
            return made
        return None

    def _switch_statement(self, begin: int) -> Node | None:
        self.at += 1
        value = self.primary() if self.peek() == "(" else self._parenthesized()
        self.want("{")
        sections = []
        while self.peek() != "}":
            start = self.at
            kids = []
            while (self.peek() == "case") or (self.peek() == "default" and self.peek(1) == ":"):
                kids.append(self.label())
            if not kids:
                raise Unexpected("label")
            end = self.match.get(begin, None)
            while self.peek() not in ("case", "}") and not (self.peek() == "default" and self.peek(1) == ":") and self.kind() != "end":
                place = self.at
                try:
                    kids.append(self.statement())
                except Unexpected:
                    self.at = max(place + 1, self.resume(place, len(self.tokens) - 1 if end is None else end))
            sections.append(self.node("SwitchSection", kids, start))
            if self.kind() == "end":
                break
        self.want("}")
        return self.node("SwitchStatement", [value, *sections], begin)

    def label(self) -> Node:
        begin = self.at
        if self.take("default"):
            self.want(":")
            return self.node("DefaultSwitchLabel", [], begin)
        self.want("case")
        pattern = self.pattern()
        kids, kind = [pattern], "CasePatternSwitchLabel"
        if pattern.kind in ("ConstantPattern", "TypePattern") and self.peek() == ":" and (pattern.kind == "ConstantPattern" or pattern.kids[0].kind in ("IdentifierName", "QualifiedName")):
            kids, kind = pattern.kids, "CaseSwitchLabel"
        elif self.take("when"):
            kids.append(Node("WhenClause", [self.expression()], begin, self.at))
        self.want(":")
        return self.node(kind, kids, begin)

    def _return_statement(self, begin: int) -> Node:
        self.at += 1
        value = None if self.peek() == ";" else self.expression()
        self.want(";")
        return self.node("ReturnStatement", [value], begin)

    def _throw_statement(self, begin: int) -> Node:
        self.at += 1
        value = None if self.peek() == ";" else self.expression()
        self.want(";")
        return self.node("ThrowStatement", [value], begin)

    def _goto_statement(self, begin: int) -> Node:
        self.at += 1
        value = None
        if self.take("case"):
            value = self.expression()
        elif not self.take("default"):
            value = self.simple_name(False)
        self.want(";")
        return self.node("GotoStatement", [value], begin)

    def _break_statement(self, begin: int) -> Node:
        self.at += 1
        self.want(";")
        return self.node("BreakStatement", [], begin)

    def _continue_statement(self, begin: int) -> Node:
        self.at += 1
        self.want(";")
        return self.node("ContinueStatement", [], begin)

    def _yield_statement(self, begin: int) -> Node | None:
        if self.peek(1) == "return":
            self.at += 2
            value = self.expression()
            self.want(";")
            return self.node("YieldReturnStatement", [value], begin)
        if self.peek(1) == "break":
            self.at += 2
            self.want(";")
            return self.node("YieldBreakStatement", [], begin)
        return None

    def _try_statement(self, begin: int) -> Node:
        self.at += 1
        kids = [self.block()]
        while self.peek() == "catch":
            start = self.at
            self.at += 1
            parts, kind, name = [], None, ""
            if self.take("("):
                kind = self.type()
                if self.is_name():
                    self.named.add(self.at)
                    name = self.name()
                self.want(")")
                parts.append(self.node("CatchDeclaration", [kind], start))
            if self.take("when"):
                parts.append(self.node("CatchFilter", [self._parenthesized()], start))
            body = self.block()
            kids.append(self.node("CatchClause", [*parts, body], start, {"type": kind, "name": name, "block": body}))
        if self.peek() == "finally":
            start = self.at
            self.at += 1
            kids.append(self.node("FinallyClause", [self.block()], start))
        return self.node("TryStatement", kids, begin)

    def _using_statement(self, begin: int) -> Node:
        self.at += 1
        if self.take("("):
            held = self.tried(self.local_declaration)
            held = self.expression() if held is None else held
            self.want(")")
            return self.node("UsingStatement", [held, self.statement()], begin)
        made = self.local_declaration()
        self.want(";")
        return self.node("LocalDeclarationStatement", [made], begin)

    def _lock_statement(self, begin: int) -> Node:
        self.at += 1
        value = self._parenthesized()
        return self.node("LockStatement", [value, self.statement()], begin)

    def _fixed_statement(self, begin: int) -> Node:
        self.at += 1
        self.want("(")
        made = self.local_declaration()
        self.want(")")
        return self.node("FixedStatement", [made, self.statement()], begin)

    def _checked_statement(self, begin: int) -> Node | None:
        if self.peek(1) != "{":
            return None
        self.at += 1
        return self.node("CheckedStatement", [self.block()], begin)

    _unchecked_statement = _unsafe_statement = _checked_statement

    # Declarations

    def attribute_list(self) -> list[Node]:
        """The attributes of one pair of brackets."""
        end = self.match.get(self.at)
        if end is None:
            raise Unexpected("attributes")
        self.at += 1
        if self.kind() == "id" and self.peek(1) == ":" and self.peek(2) != ":":
            self.at += 2
        out = []
        try:
            while self.at < end:
                begin = self.at
                kind = self.type()
                arguments, kids = None, [kind]
                if self.peek() == "(":
                    self.at += 1
                    arguments = []
                    while self.peek() != ")":
                        key, place = None, self.at
                        if self.is_name() and self.peek(1) in ("=", ":") and self.peek(2) != "=":
                            key = self.name()
                            self.at += 1
                        value = self.expression()
                        kids.append(value)
                        arguments.append((key, self.text(value)))
                        if self.at <= place or not self.take(","):
                            break
                    self.want(")")
                out.append(self.node("Attribute", kids, begin, {"name": self.text(kind), "arguments": arguments or None}))
                if not self.take(","):
                    break
        except Unexpected:
            pass
        self.at = end + 1
        return out

    def attributes(self) -> list[Node]:
        out = []
        while self.peek() == "[":
            out += self.attribute_list()
        return out

    def modifiers(self) -> list[str]:
        out = []
        while self.kind() == "id" and self.peek() in MODIFIERS:
            word = self.peek()
            if word == "ref" and self.peek(1) not in ("struct", "partial"):
                break
            if word in ("partial", "async", "required", "file") and not (self.kind(1) == "id" or self.peek(1) == "("):
                break
            if word in ("partial", "async", "required", "file") and self.peek(1) in ("=", ";", ",", "(", "{"):
                break
            out.append(word)
            self.at += 1
        return out

    def parameters(self, close: str) -> list[Node]:
        self.at += 1
        out = []
        while self.peek() != close:
            begin = self.at
            attrs = self.attributes()
            while self.peek() in ("ref", "out", "in", "params", "this", "scoped", "readonly") and (self.kind(1) == "id" or self.peek(1) in ("(", "[")):
                self.at += 1
            kind = self.type()
            name = self.name() if self.is_name() else ""
            initial = self.expression() if self.take("=") else None
            out.append(self.node("Parameter", [*attrs, kind, initial], begin, {"name": name, "type": kind, "attributes": attrs}))
            if not self.take(","):
                break
        self.want(close)
        return out

    def type_parameters(self) -> list[str]:
        out = []
        if self.peek() != "<":
            return out
        end = self.skip_angles()
        self.at += 1
        while self.at < end - 1:
            self.attributes()
            if self.peek() in ("in", "out"):
                self.at += 1
            if self.is_name():
                out.append(self.name())
            if not self.take(","):
                break
        self.at = end
        return out

    def constraints(self) -> list[tuple[str, list[str]]]:
        out = []
        while self.peek() == "where" and self.is_name(1) and self.peek(2) == ":":
            self.at += 1
            name = self.name()
            self.at += 1
            parts = []
            while True:
                begin = self.at
                if self.peek() == "new" and self.peek(1) == "(":
                    self.at += 3
                elif self.peek() in ("class", "struct", "default"):
                    self.at += 1
                    self.take("?")
                elif self.peek() == "allows":
                    self.at += 3
                else:
                    self.type()
                parts.append(self.text(Node("", [], begin, self.at)))
                if not self.take(","):
                    break
            out.append((name, parts))
        return out

    def body(self) -> Node | None:
        """A block or an expression body; None for neither. The ";" belongs to the declaration."""
        if self.peek() == "{":
            made = self.block()
            self.take(";")
            return made
        if self.peek() == "=>":
            begin = self.at
            self.at += 1
            made = self.node("ArrowExpressionClause", [self.expression()], begin)
            self.want(";")
            return made
        self.want(";")
        return None

    def unit(self) -> Node:
        """The whole text."""
        kids: list[Node] = []
        self.declarations(kids, "", len(self.tokens) - 1)
        return self.node("CompilationUnit", kids, 0)

    def declarations(self, kids: list[Node], namespace: str, end: int) -> None:
        while self.at < end:
            start = self.at
            try:
                if self.peek() in ("}", ")", "]", ";"):
                    self.at += 1
                    continue
                if self.peek() == "global" and self.peek(1) == "using":
                    self.at += 1
                if self.peek() in ("using", "extern") and (self.peek() == "extern" and self.peek(1) == "alias" or self.using_directive()):
                    self.at = self.resume(self.at, end)
                elif self.peek() == "[" and self.peek(1) in ("assembly", "module") and self.peek(2) == ":" and self.at in self.match:
                    self.at = self.match[self.at] + 1
                elif self.peek() == "namespace":
                    self.at += 1
                    begin = self.at
                    while self.is_name():
                        self.at += 1
                        if not self.take("."):
                            break
                    # The innermost declaration of a namespace names it, as it is written there.
                    inner = self.text(Node("", [], begin, self.at))
                    if self.take(";"):
                        namespace = inner
                        continue
                    close = self.match.get(self.at, end)
                    self.want("{")
                    self.declarations(kids, inner, close)
                    self.at = close + 1
                    self.take(";")
                else:
                    kids.append(self.tried(self.member, namespace, None) or self.statement())
            except Unexpected:
                self.at = max(start + 1, self.resume(start, end))
            if self.at <= start:
                self.at = start + 1

    def using_directive(self) -> bool:
        return self.peek() == "using" and (self.peek(1) in ("static", "unsafe") or (self.is_name(1) and self.peek(2) in (";", ".", "=", "::", "<"))) and self.peek(1) != "var"

    def member(self, namespace: str, owner: str | None) -> Node:
        """A declaration of a type or, inside one (``owner``), of another member."""
        begin = self.at
        attrs = self.attributes()
        mods = self.modifiers()
        word = self.peek()
        if word == "record" and (self.peek(1) in ("struct", "class") or (self.is_name(1) and self.peek(2) in ("(", "{", ":", "<", ";"))) or word in ("class", "struct", "interface"):
            return self.type_declaration(begin, attrs, mods, namespace)
        if word == "enum":
            return self.enum_declaration(begin, attrs, mods, namespace)
        if word == "delegate" and self.peek(1) != "*":
            return self.delegate_declaration(begin, attrs, mods, namespace)
        if owner is None:
            raise Unexpected("type")
        base = {"attributes": attrs, "modifiers": mods}
        if word == "event":
            self.at += 1
            kind = self.type()
            if self.peek(1) in ("{", "."):
                name = self.qualified()
                return self.node("Event", [*attrs, kind, *self.accessors()], begin, base | {"names": [name], "type": kind})
            made = self.declarators()
            self.want(";")
            return self.node("Event", [*attrs, kind, *made], begin, base | {"names": [d.info for d in made], "type": kind})
        if word == "~":
            self.at += 2
            self.parameters(")")
            body = self.body()
            return self.node("Destructor", [*attrs, body], begin, base)
        if word in ("implicit", "explicit"):
            while self.peek() != "(" and self.kind() != "end":
                self.at += 1
            params = self.parameters(")")
            return self.node("Operator", [*attrs, *params, self.body()], begin, base)
        if self.is_name() and word == owner and self.peek(1) == "(":
            self.at += 1
            params = self.parameters(")")
            chained = None
            if self.take(":"):
                start = self.at
                self.at += 1
                chained = self.node("ConstructorInitializer", [self.arguments(")")], start)
            body = self.body()
            return self.node("Constructor", [*attrs, *params, chained, body], begin, base | {"name": word, "parameters": params, "body": body})
        kind = self.type()
        if self.take("operator"):
            while self.peek() != "(" and self.kind() != "end":
                self.at += 1
            params = self.parameters(")")
            return self.node("Operator", [*attrs, kind, *params, self.body()], begin, base)
        name = self.qualified()
        if name == "this":
            params = self.parameters("]")
            kids = self.property_body()
            return self.node("Indexer", [*attrs, kind, *params, *kids], begin, base | {"type": kind, "parameters": params})
        if self.peek() in ("(", "<"):
            self.type_parameters()
            params = self.parameters(")")
            limits = self.constraints()
            body = self.body()
            return self.node("Method", [*attrs, kind, *params, body], begin, base | {"name": name, "type": kind, "parameters": params, "body": body, "constraints": limits})
        if self.peek() in ("{", "=>"):
            return self.node("Property", [*attrs, kind, *self.property_body()], begin, base | {"name": name, "type": kind})
        self.at -= 1
        made = self.declarators()
        self.want(";")
        return self.node("Field", [*attrs, kind, *made], begin, base | {"names": [d.info for d in made], "type": kind})

    def qualified(self) -> str:
        """The last part of a name that may be that of an interface's member."""
        while True:
            if self.peek() == "this":
                self.at += 1
                return "this"
            place = self.at
            text = self.name()
            if self.peek() == "<":
                end = self.tried(self.skip_angles)
                if end is not None and self.tokens[end].text == ".":
                    self.at = end
            if not self.take("."):
                self.at = place + 1
                return text

    def accessors(self) -> list[Node]:
        close = self.match.get(self.at)
        self.want("{")
        out = []
        while self.at < (close or 0):
            start = self.at
            try:
                self.attributes()
                while self.kind() == "id" and self.peek() not in ("get", "set", "init", "add", "remove"):
                    self.at += 1
                self.name()
                out.append(self.node("Accessor", [self.body()], start))
            except Unexpected:
                self.at = max(start + 1, self.resume(start, close))
        self.at = (close if close is not None else self.at) + 1
        return out

    def property_body(self) -> list[Node]:
        if self.peek() == "=>":
            made = self.body()
            return [made] if made else []
        out = self.accessors()
        if self.take("="):
            out.append(self.expression())
            self.want(";")
        return out

    def type_declaration(self, begin: int, attrs: list[Node], mods: list[str], namespace: str) -> Node:
        word = self.peek()
        self.at += 1
        kind = word
        if word == "record":
            kind = "record struct" if self.peek() == "struct" else "record"
            if self.peek() in ("struct", "class"):
                self.at += 1
        name = self.name()
        generic = self.type_parameters()
        params = self.parameters(")") if self.peek() == "(" else []
        bases = []
        if self.take(":"):
            while True:
                start = self.at
                base = self.type()
                if self.peek() == "(":
                    self.node("PrimaryBase", [self.arguments(")")], start)
                bases.append(base)
                if not self.take(","):
                    break
        limits = self.constraints()
        members: list[Node] = []
        if self.peek() == "{":
            close = self.match.get(self.at, len(self.tokens) - 1)
            self.at += 1
            while self.at < close:
                start = self.at
                if self.tokens[start].kind == "cut":
                    self.at += 1
                    if self.peek() == ";":
                        raise Uncut  # it belongs to the method
                    members.append(self.node("Cut", [], start, self.cuts[self.tokens[start].begin][1]))
                    continue
                if self.take(";"):
                    continue
                try:
                    members.append(self.member(namespace, name))
                except Unexpected:
                    self.at = max(start + 1, self.resume(start, close))
                if self.at <= start:
                    self.at = start + 1
            self.at = min(close + 1, len(self.tokens) - 1)
            self.take(";")
            end = close + 1
        else:
            self.want(";")
            end = self.at
        made = self.node("Type", [*attrs, *params, *bases, *members], begin, {
            "kind": kind, "name": name, "generic": generic, "modifiers": mods, "attributes": attrs, "bases": bases, "constraints": limits, "members": members,
            "parameters": params if word == "record" else [], "namespace": namespace,
        })
        made.end = max(begin + 1, min(end, self.at))
        return made

    def enum_declaration(self, begin: int, attrs: list[Node], mods: list[str], namespace: str) -> Node:
        self.at += 1
        name = self.name()
        base = self.type() if self.take(":") else None
        close = self.match.get(self.at, len(self.tokens) - 1)
        self.want("{")
        members = []
        while self.at < close:
            start = self.at
            own = self.attributes()
            text = self.name()
            value = self.expression() if self.take("=") else None
            members.append(self.node("EnumMember", [*own, value], start, {"name": text, "value": value, "attributes": own}))
            if not self.take(","):
                break
        self.at = close + 1
        end = self.at
        self.take(";")
        made = self.node("Enum", [*attrs, base, *members], begin, {"kind": "enum", "name": name, "generic": [], "modifiers": mods, "attributes": attrs, "base": base, "members": members, "namespace": namespace})
        made.end = end
        return made

    def delegate_declaration(self, begin: int, attrs: list[Node], mods: list[str], namespace: str) -> Node:
        self.at += 1
        kind = self.type()
        name = self.name()
        generic = self.type_parameters()
        params = self.parameters(")")
        limits = self.constraints()
        self.want(";")
        return self.node("Delegate", [*attrs, kind, *params], begin, {
            "kind": "delegate", "name": name, "generic": generic, "modifiers": mods, "attributes": attrs, "type": kind, "parameters": params, "constraints": limits, "members": [], "namespace": namespace,
        })
