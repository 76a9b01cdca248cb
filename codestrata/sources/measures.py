"""Measures of the syntax tree of a method body or type: complexities, nesting, operators, cohesion, coupling, occurrences."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

from .syntax import Node, Parser

_LOOPS = {"ForStatement", "ForEachStatement", "WhileStatement", "DoStatement"}
_NESTING = _LOOPS | {"IfStatement", "SwitchStatement", "SwitchExpression", "CatchClause", "LambdaExpression", "AnonymousMethodExpression", "ConditionalExpression"}
_BRANCHES = _LOOPS | {"IfStatement", "ConditionalExpression", "CatchClause", "ConditionalAccessExpression", "SwitchExpressionArm", "GotoStatement", "CaseSwitchLabel", "CasePatternSwitchLabel"}
_OPERATOR_NODES = _LOOPS | {
    "IfStatement", "ElseClause", "SwitchStatement", "SwitchExpression", "CaseSwitchLabel", "CasePatternSwitchLabel", "SwitchExpressionArm", "ReturnStatement", "ThrowStatement",
    "ThrowExpression", "TryStatement", "CatchClause", "FinallyClause", "ObjectCreationExpression", "ImplicitObjectCreationExpression", "TypeOfExpression", "IsPatternExpression",
    "AsExpression", "AwaitExpression", "YieldReturnStatement", "YieldBreakStatement", "ConditionalAccessExpression",
}
_OPERATORS = frozenset("+ - * / % = += -= *= /= %= &= |= ^= <<= >>= == != < > <= >= && || ! & | ^ ~ << >> ++ -- . ?? ??= =>".split())
PRIMITIVES = frozenset("bool byte sbyte char decimal double float int uint long ulong short ushort string object void nint nuint dynamic var".split())


class _Cognitive:
    """Structural increments with nesting, flat ones for else, goto and recursion, and one for each change of logical operator."""

    def __init__(self) -> None:
        self.total, self.last = 0, ""

    def walk(self, node: Node, nesting: int) -> None:
        for kid in node.kids:
            self.last = ""
            kind = kid.kind
            if kind == "IfStatement":
                self.chain(kid, nesting)
            elif kind in ("SwitchStatement", "SwitchExpression", "CatchClause", "ConditionalExpression") or kind in _LOOPS:
                self.total += 1 + nesting
                self.walk(kid, nesting + 1)
            elif kind == "GotoStatement":
                self.total += 1
                self.walk(kid, nesting)
            elif kind == "BinaryExpression" or kind == "AsExpression":
                self.binary(kid, nesting)
            elif kind == "IsPatternExpression":
                self.tested(kid, nesting)
            elif kind == "LocalFunction":
                if not kid.info["static"]:
                    self.walk(kid, nesting)
            elif kind in ("LambdaExpression", "AnonymousMethodExpression"):
                self.walk(kid, nesting + 1)
            else:
                self.walk(kid, nesting)

    def chain(self, node: Node, nesting: int) -> None:
        self.total += 1 + nesting
        while True:
            self.condition(node.kids[0], nesting + 1)
            self.walk(node.kids[1], nesting + 1)
            if len(node.kids) < 3:
                return
            self.total += 1
            other = node.kids[2].kids[0]
            if other.kind != "IfStatement":
                self.walk(other, nesting + 1)
                return
            self.last, node = "", other

    def condition(self, node: Node, nesting: int) -> None:
        if node.kind in ("BinaryExpression", "AsExpression"):
            self.binary(node, nesting)
        elif node.kind == "IsPatternExpression":
            self.tested(node, nesting)
        else:
            for kid in node.kids:
                self.condition(kid, nesting)

    def tested(self, node: Node, nesting: int) -> None:
        self.condition(node.kids[0], nesting)
        self.pattern(node.kids[1], nesting)

    def binary(self, node: Node, nesting: int) -> None:
        op = node.info
        if op not in ("&&", "||"):
            self.walk(node, nesting)
            return
        if self.last != op:
            self.total += 1
            self.last = op
        self.operand(node.kids[0], nesting)
        self.last = op
        self.operand(node.kids[1], nesting)

    def operand(self, node: Node, nesting: int) -> None:
        if node.kind == "BinaryExpression" and node.info in ("&&", "||"):
            self.binary(node, nesting)
        elif node.kind == "IsPatternExpression":
            self.tested(node, nesting)
        else:
            saved, self.last = self.last, ""
            self.walk(node, nesting)
            self.last = saved

    def pattern(self, node: Node, nesting: int) -> None:
        if node.kind == "BinaryPattern":
            op = "||" if node.info == "or" else "&&"
            if self.last != op:
                self.total += 1
                self.last = op
            for i, kid in enumerate(node.kids):
                if i:
                    self.last = op
                while kid.kind == "ParenthesizedPattern":
                    kid = kid.kids[0]
                if kid.kind == "BinaryPattern":
                    self.pattern(kid, nesting)
                else:
                    saved, self.last = self.last, ""
                    self.pattern(kid, nesting)
                    self.last = saved
        elif node.kind in ("ParenthesizedPattern", "UnaryPattern"):
            self.pattern(node.kids[0], nesting)
        elif node.kind == "RecursivePattern":
            for part in node.kids:
                if part.kind == "Subpattern":
                    self.pattern(part.kids[0], nesting)


def invoked_name(call: Node, text) -> str:
    """The name that an invocation calls; its whole text if it is no name."""
    target = call.kids[0]
    if target.kind in ("IdentifierName", "GenericName"):
        return target.info
    if target.kind == "MemberAccess":
        return target.kids[1].info
    if target.kind == "MemberBinding":
        return target.kids[0].info
    return text(target)


def cognitive(body: Node | None, method: str | None) -> int:
    if body is None:
        return 0
    state = _Cognitive()
    state.walk(body, 0)
    for call in body.below():
        if call.kind == "Invocation" and method is not None:
            target = call.kids[0]
            plain = target.info if target.kind == "IdentifierName" else None
            if target.kind == "MemberAccess" and target.kids[0].kind == "This" and target.kids[1].kind == "IdentifierName":
                plain = target.kids[1].info
            if plain == method:
                return state.total + 1
    return state.total


def cyclomatic(body: Node | None) -> int:
    if body is None:
        return 1
    return 1 + sum(n.kind in _BRANCHES or (n.kind == "BinaryExpression" and n.info in ("&&", "||", "??")) for n in body.below())


def nesting(body: Node | None) -> int:
    if body is None:
        return 0
    deepest, stack = 0, [(body, 0)]
    while stack:
        node, depth = stack.pop()
        deepest = max(deepest, depth)
        for kid in node.kids:
            deeper = kid.kind in _NESTING and not (kid.kind == "IfStatement" and node.kind == "ElseClause")
            stack.append((kid, depth + deeper))
    return deepest


def halstead(body: Node | None, parser: Parser) -> dict[str, float]:
    """Distinct and total operators and operands of a body, and what follows from them."""
    operators: Counter[str] = Counter()
    operands: Counter[str] = Counter()
    if body is not None:
        operators.update(n.kind for n in body.below() if n.kind in _OPERATOR_NODES)
        i = body.begin
        while i < body.end:
            token = parser.tokens[i]
            if token.kind == "op":
                if i in parser.shifts:
                    i += 1
                    operators[token.text + parser.tokens[i].text] += 1
                elif token.text in _OPERATORS:
                    operators[token.text] += 1
            elif token.kind in ("num", "str", "chr") or (token.kind == "id" and (i in parser.named or token.text in ("true", "false", "null", "this", "base"))):
                operands[token.text] += 1
            i += 1
    total1, total2, n1, n2 = operators.total(), operands.total(), len(operators), len(operands)
    volume = (total1 + total2) * math.log2(n1 + n2) if n1 + n2 else 0.0
    difficulty = n1 / 2.0 * (total2 / n2) if n2 else 0.0
    effort = difficulty * volume
    return {"n1": n1, "n2": n2, "total1": total1, "total2": total2, "volume": volume, "difficulty": difficulty, "effort": effort, "bugs": effort ** (2.0 / 3.0) / 3000.0}


def half_even(x: float, digits: int) -> float:
    scale = 10**digits
    return round(x * scale) / scale


class Part:
    """What a method that was parsed by itself adds to its type and file; lines count from its own first one."""

    __slots__ = ("asked", "called", "captures", "caught", "invoked", "names", "row", "static", "thrown", "types")

    def __init__(self, method: Node, parser: Parser, row: dict) -> None:
        self.row = row
        self.static, self.names = "static" in method.info["modifiers"], _names(method.info["body"])
        self.types, self.invoked = _method_types(method), _invoked(method, parser.text)
        self.captures = captures([method], parser)
        nodes = list(_with_methods(Node("", [method], 0, 0)))
        self.caught, self.thrown = _caught(nodes, parser), _thrown(nodes, parser)
        self.called, self.asked = _registered(method, parser)


def _moved(rows: list[dict], by: int) -> list[dict]:
    return [r | {"line": r["line"] + by} | ({"message": f"catch-all at line {r['line'] + by}"} if r.get("kind") == "CatchAllException" else {}) for r in rows]


def _names(body: Node | None) -> set[str]:
    """The names in a body, and those of members of this."""
    if body is None:
        return set()
    return {n.info for n in body.below() if n.kind == "IdentifierName"} | {n.kids[1].info for n in body.below() if n.kind == "MemberAccess" and n.kids[0].kind == "This"}


def cohesion(members: list[Node]) -> float | None:
    """Lack of cohesion (Henderson-Sellers) of the instance methods and constructors; null without fields or with one of them."""
    fields = {n for m in members if m.kind == "Field" and "static" not in m.info["modifiers"] for n in m.info["names"]}
    seen = [_names(m.info["body"]) for m in members if m.kind in ("Method", "Constructor") and "static" not in m.info["modifiers"]] if fields else []
    seen += [m.info.names for m in members if m.kind == "Cut" and not m.info.static]
    if not fields or len(seen) <= 1:
        return None
    used, n = sum(len(s & fields) for s in seen), len(seen)
    return half_even(max(0.0, (used / len(fields) - n) / (1.0 - n)), 2)


def named_types(kind: Node | None) -> Iterator[str]:
    """The names in a type, without those of its namespaces."""
    if kind is None:
        return
    if kind.kind in ("IdentifierName", "GenericName"):
        yield kind.info
    if kind.kind in ("GenericName", "TupleType", "ArrayType", "NullableType"):
        for kid in kind.kids:
            yield from named_types(kid)
    elif kind.kind == "QualifiedName":
        yield from named_types(kind.kids[1])


def _body_types(body: Node | None) -> Iterator[str]:
    for n in body.below() if body is not None else ():
        if n.kind == "LocalDeclarationStatement":
            yield from named_types(n.kids[0].info)
        elif n.kind in ("ObjectCreationExpression", "CastExpression", "TypeOfExpression"):
            yield from named_types(n.kids[0])


def _method_types(m: Node) -> set[str]:
    """The names of types in the signature and body of a method or constructor."""
    found = set(named_types(m.info["type"])) if m.kind == "Method" else set()
    for p in m.info["parameters"]:
        found.update(named_types(p.info["type"]))
    found.update(_body_types(m.info["body"]))
    return found


def coupled(declaration: Node) -> int:
    """Distinct types that the bases, signatures and bodies of a type name, without itself and the built-in ones."""
    found: set[str] = set()
    for base in declaration.info["bases"]:
        found.update(named_types(base))
    for m in declaration.info["members"]:
        if m.kind in ("Field", "Property"):
            found.update(named_types(m.info["type"]))
        elif m.kind in ("Method", "Constructor"):
            found |= _method_types(m)
        elif m.kind == "Cut":
            found |= m.info.types
    return len(found - {declaration.info["name"]} - PRIMITIVES)


def _invoked(m: Node, text) -> set[str]:
    return {invoked_name(n, text) for n in m.below() if n.kind == "Invocation"}


def response(members: list[Node], text) -> int:
    """Methods and constructors, and the distinct names that they invoke."""
    own = [m.info.invoked if m.kind == "Cut" else _invoked(m, text) for m in members if m.kind in ("Method", "Constructor", "Cut")]
    return len(own) + len(set().union(*own))


def captures(members: list[Node], parser: Parser) -> list[dict]:
    """Lambdas and anonymous methods that use parameters or locals of the member around them."""
    out = []
    for m in [*[x for x in members if x.kind in ("Method", "Cut")], *[x for x in members if x.kind == "Constructor"]]:
        if m.kind == "Cut":
            if m.info.captures:
                out += _moved(m.info.captures, parser.line(m.begin) - 1)
            continue
        where = m.info["name"] + (".ctor" if m.kind == "Constructor" else "")
        locals_ = [n for n in m.below() if n.kind == "VariableDeclarator"]
        params = {p.info["name"] for p in m.info["parameters"]}
        for n in m.below():
            if n.kind not in ("LambdaExpression", "AnonymousMethodExpression"):
                continue
            outer = params | {d.info for d in locals_ if not (n.begin <= d.begin and d.end <= n.end)}
            held = sorted({k.info for k in n.below() if k.kind == "IdentifierName"} & outer - set(n.info["names"]))
            if held:
                label = "anonymous method" if n.kind == "AnonymousMethodExpression" else f"lambda ({', '.join(n.info['names'])}) => ..."
                out.append({"method": where, "kind": "ClosureCapture", "line": parser.line(n.begin), "message": f"captures: {', '.join(held)}", "detail": label})
    return out


def _with_methods(declaration: Node) -> Iterator[tuple[Node, str]]:
    """Every descendant of a type, with the name of the method, constructor or property around it."""
    stack = [(k, "<unknown>") for k in declaration.kids[::-1]]
    while stack:
        node, where = stack.pop()
        yield node, where
        inner = node.info["name"] if node.kind in ("Method", "Constructor", "Property") else where
        stack += [(k, inner) for k in node.kids[::-1]]


def exceptions(declaration: Node, parser: Parser) -> list[dict]:
    """Catches of everything without rethrow, new exceptions that drop the caught one, and throws of the base exception."""
    nodes = list(_with_methods(declaration))
    return _caught(nodes, parser) + _thrown(nodes, parser)


_SYSTEM = ("Exception", "System.Exception")


def _exception(kind: str, where: str, node: Node, message: str, parser: Parser) -> dict:
    return {"method": where, "kind": kind, "line": parser.line(node.begin), "message": message, "detail": None}


def _caught(nodes: list[tuple[Node, str]], parser: Parser) -> list[dict]:
    out = []
    for node, where in nodes:
        if node.kind == "Cut" and node.info.caught:
            out += _moved(node.info.caught, parser.line(node.begin) - 1)
        if node.kind != "CatchClause":
            continue
        kind, name, block = node.info["type"], node.info["name"], node.info["block"]
        throws = [n for n in block.below() if n.kind == "ThrowStatement"]
        if (kind is None or parser.text(kind) in _SYSTEM) and all(t.kids for t in throws):
            out.append(_exception("CatchAllException", where, node, f"catch-all at line {parser.line(node.begin)}", parser))
        for t in throws if name else ():
            made = t.kids[0] if t.kids and t.kids[0].kind == "ObjectCreationExpression" else None
            if made is None:
                continue
            given = next((k for k in made.kids[1:] if k.kind == "ArgumentList"), None)
            if given is None or not any(n.kind == "IdentifierName" and n.info == name for n in given.below()):
                out.append(_exception("MissingInnerException", where, t, f"throw new {parser.text(made.kids[0])} without inner exception", parser))
    return out


def _thrown(nodes: list[tuple[Node, str]], parser: Parser) -> list[dict]:
    out = []
    for node, where in nodes:
        if node.kind == "Cut" and node.info.thrown:
            out += _moved(node.info.thrown, parser.line(node.begin) - 1)
        if node.kind == "ThrowStatement" and node.kids and node.kids[0].kind == "ObjectCreationExpression" and parser.text(node.kids[0].kids[0]) in _SYSTEM:
            out.append(_exception("ThrowingSystemException", where, node, "throw new Exception() directly", parser))
    return out


_INJECT = {"Inject": None, "InjectAttribute": None} | {f"{c}.{n}": c for c in ("VContainer", "Zenject") for n in ("Inject", "InjectAttribute")} | {f"Zenject.InjectOptional{s}": "Zenject" for s in ("", "Attribute")}
_BINDS = ("Bind", "BindInterfacesTo", "BindInterfacesAndSelfTo")


def registrations(unit: Node, parser: Parser) -> list[dict]:
    """What a file registers with a container of dependencies, and what it asks to be injected."""
    called, asked = _registered(unit, parser)
    return called + asked


def _registered(unit: Node, parser: Parser) -> tuple[list[dict], list[dict]]:
    called: list[dict] = []
    out, above = called, {}
    nodes = [unit, *unit.below()]
    for n in nodes:
        for k in n.kids:
            above[id(k)] = n

    def row(service: str, made: str, container: str, lifetime: str | None, node: Node) -> None:
        out.append({"service": service, "implementation": made, "container": container, "lifetime": lifetime, "line": parser.line(node.begin)})

    for call in nodes:
        if call.kind == "Cut":
            out += _moved(call.info.called, parser.line(call.begin) - 1)
        if call.kind != "Invocation" or call.kids[0].kind not in ("MemberAccess", "GenericName", "IdentifierName"):
            continue
        target = call.kids[0].kids[1] if call.kids[0].kind == "MemberAccess" else call.kids[0]
        args = [parser.text(a) for a in target.kids] if target.kind == "GenericName" else []
        given = [a.kids[-1] for a in call.kids[1].kids if a.kids]
        if target.info == "Register" and len(args) in (1, 2):
            lifetime = next((w for a in given for w in ("Singleton", "Transient", "Scoped") if w in parser.text(a)), None)
            row(args[0], args[-1], "VContainer", lifetime, call)
        elif target.info == "RegisterInstance":
            first = args[0] if args and call.kids[0].kind == "MemberAccess" else parser.text(given[0]) if given else "Unknown"
            row(first, first, "VContainer", "Singleton", call)
        elif target.info == "RegisterFactory":
            row(*[args[0] if args else "Unknown"] * 2, "VContainer", "Transient", call)
        elif target.info in _BINDS:
            service, made, lifetime = args[0] if args else "Unknown", None, None
            node = above.get(id(call))
            while node is not None and node.kind == "MemberAccess" and (outer := above.get(id(node))) is not None and outer.kind == "Invocation":
                step = node.kids[1]
                if step.info == "To" and step.kind == "GenericName":
                    made = parser.text(step.kids[0])
                lifetime = {"AsSingle": "Singleton", "AsTransient": "Transient", "AsCached": "Scoped"}.get(step.info, lifetime)
                node = above.get(id(outer))
            row(service, made or service if target.info == "Bind" else service, "Zenject", lifetime, call)
    out = asked_ = []
    for a in nodes:
        if a.kind == "Cut":
            out += _moved(a.info.asked, parser.line(a.begin) - 1)
        if a.kind == "Attribute" and a.info["name"] in _INJECT:
            owner = above.get(id(a))
            info = owner.info if owner is not None and owner.kind in ("Field", "Property", "Method", "Parameter") else None
            asked = "Unknown"
            if info is not None:
                asked = info["name"] if owner.kind == "Method" else parser.text(info["type"])
            row(asked, asked, _INJECT[a.info["name"]] or "Unknown", None, a)
    return called, asked_
