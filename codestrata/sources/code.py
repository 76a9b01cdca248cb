"""Source code as rows: every type of every file, with its members and their measures, in one pass over the files.

A file is parsed by itself inside the task that reads it (`parse_files` is one MapInArrow, without a shuffle), so any number
of files spreads over any number of executors. What needs more than one file (which bases are interfaces, partial types,
references) are joins over the rows: `codestrata.operators.resolve` and `codestrata.operators.dependencies`.

Defined results: a null or empty text has no rows; what cannot be parsed is left out up to the next member; a file that occurs
twice has its rows twice; metrics of a member that is no method are null; a method without a body has complexity 0, 1 and 0
and empty counts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import measures
from .syntax import Node, Parser, Uncut, Unexpected, methods_in

_ATTRIBUTES = "array<struct<name:string,arguments:map<string,string>>>"
_MEMBER = (
    f"struct<name:string,type:string,member_kind:string,modifiers:array<string>,parameters:array<struct<name:string,type:string>>,attributes:{_ATTRIBUTES},"
    "cog:int,cyc:int,nesting:int,lines:int,start_line:int,n1:int,n2:int,total1:int,total2:int,volume:double,difficulty:double,effort:double,bugs:double>"
)
TYPE = (
    "path string, assembly string, name string, namespace string, kind string, modifiers array<string>, base string, interfaces array<string>, "
    f"members array<{_MEMBER}>, constructor_params array<string>, attributes {_ATTRIBUTES}, "
    "constraints array<struct<parameter:string,limits:array<string>>>, enum_base string, is_nested boolean, line_count int, start_line int, qualified string, type_id string, "
    "lcom double, cbo int, rfc int, dit int, occurrences array<struct<method:string,kind:string,line:int,message:string,detail:string>>"
)
REGISTRATION = "path string, service string, implementation string, container string, lifetime string, line int"


def _arguments(given: list[tuple[str | None, str]] | None) -> list[tuple[str, str]] | None:
    if not given:
        return None
    out: dict[str, str] = {}
    for key, value in given:
        out[key if key is not None else f"arg{len(out)}"] = value
    return list(out.items())


def _attributes(nodes: list[Node]) -> list[dict]:
    return [{"name": a.info["name"], "arguments": _arguments(a.info["arguments"])} for a in nodes]


_UNMEASURED = dict.fromkeys(("cog", "cyc", "nesting", "start_line", "n1", "n2", "total1", "total2", "volume", "difficulty", "effort", "bugs"))


def _member(parser: Parser, node: Node, name: str, kind: str, type_: str) -> dict:
    info = node.info
    row = {
        "name": name, "type": type_, "member_kind": kind, "modifiers": info.get("modifiers", []), "attributes": _attributes(info.get("attributes", [])), "lines": 0,
        "parameters": [{"name": p.info["name"], "type": parser.text(p.info["type"]) if p.info["type"] is not None else "unknown"} for p in info.get("parameters", [])],
    } | _UNMEASURED
    if kind == "Method" and node.kind == "Method":
        body = info["body"]
        row |= measures.halstead(body, parser)
        row |= {
            "cog": measures.cognitive(body, name), "cyc": measures.cyclomatic(body), "nesting": measures.nesting(body),
            "lines": parser.last_line(node) - parser.line(node.begin) + 1, "start_line": parser.line(node.begin),
        }
    return row


def _members(parser: Parser, declaration: Node) -> Iterator[dict]:
    info = declaration.info
    if declaration.kind == "Delegate":
        yield _member(parser, declaration, "Invoke", "Method", parser.text(info["type"])) | {"modifiers": ["public"], "attributes": []}
        return
    for m in info["members"]:
        if m.kind == "Cut":
            yield m.info.row | {"start_line": parser.line(m.begin)}
        elif m.kind == "EnumMember":
            value = m.info["value"]
            yield _member(parser, m, m.info["name"], m.kind, "enum" if value is None else f"enum = {parser.text(value)}")
        elif m.kind in ("Field", "Event"):
            for name in m.info["names"]:
                yield _member(parser, m, name, m.kind, parser.text(m.info["type"]))
        elif m.kind in ("Property", "Method"):
            yield _member(parser, m, m.info["name"], m.kind, parser.text(m.info["type"]))
        elif m.kind == "Indexer":
            yield _member(parser, m, "this[]", m.kind, parser.text(m.info["type"]))
    for p in info.get("parameters", []):  # of a record
        yield _member(parser, Node("Property", [], p.begin, p.end, {}), p.info["name"], "Property", parser.text(p.info["type"]))


#: Methods by their text: equal texts are parsed once by each Python worker. As many as MOST are kept.
_PARTS: dict[str, measures.Part | None] = {}
MOST = 20_000


def _part(text: str) -> measures.Part | None:
    """A method parsed by itself; None if that might differ from what it is in its file."""
    if text not in _PARTS:
        if len(_PARTS) >= MOST:
            _PARTS.clear()
        _PARTS[text] = _parsed(text)
    return _PARTS[text]


def _parsed(text: str) -> measures.Part | None:
    parser = Parser(text)
    try:
        node = parser.member("", "")
    except (Unexpected, RecursionError):
        return None
    brackets = sum(t.kind == "op" and t.text in "([{)]}" for t in parser.tokens)
    whole = node.kind == "Method" and parser.kind() == "end" and not parser.damaged and 2 * len(parser.match) == brackets
    if not whole or any(n.kind in ("Type", "Enum", "Delegate") for n in node.below()):
        return None
    return measures.Part(node, parser, _member(parser, node, node.info["name"], "Method", parser.text(node.info["type"])))


def _unit(text: str, symbols: frozenset[str]) -> tuple[Parser, Node]:
    """The tree of a text, in which methods that can be parsed by themselves are nodes "Cut" of their Part."""
    cuts = {begin: (end, part) for begin, end in methods_in(text) if (part := _part(text[begin:end]))}
    if cuts:
        parser = Parser(text, symbols, cuts)
        try:
            unit = parser.unit()
            if sum(n.kind == "Cut" for n in unit.below()) == len(cuts):  # none where no method stands
                return parser, unit
        except (Uncut, Unexpected, RecursionError):
            pass
    parser = Parser(text, symbols)
    return parser, parser.unit()


def types_of(path: str, text: str, assembly: str = "", symbols: frozenset[str] = frozenset()) -> tuple[list[dict], list[dict]]:
    """(rows of TYPE, rows of REGISTRATION) of one source text."""
    return _rows(path, text, assembly, symbols), _registrations(path, text, assembly, symbols)


def _registrations(path: str, text: str, assembly: str, symbols: frozenset[str]) -> list[dict]:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
    try:
        parser, unit = _unit(text, symbols)
    except (Unexpected, RecursionError):
        return []
    return [{"path": path} | r for r in measures.registrations(unit, parser)]


def _rows(path: str, text: str, assembly: str, symbols: frozenset[str]) -> list[dict]:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
    try:
        parser, unit = _unit(text, symbols)
    except (Unexpected, RecursionError):
        return []
    interfaces = {n.info["name"] for n in unit.below() if n.kind == "Type" and n.info["kind"] == "interface"}
    rows: list[dict] = []
    stack: list[tuple[Node, list[tuple[str, int]]]] = [(k, []) for k in unit.kids[::-1]]
    while stack:
        node, around = stack.pop()
        inner = around
        if node.kind in ("Type", "Enum", "Delegate"):
            rows.append(_row(parser, node, around, path, assembly, interfaces))
            inner = [*around, (node.info["name"], len(node.info["generic"]))]
        stack += [(k, inner) for k in node.kids[::-1]]
    return rows


def _row(parser: Parser, node: Node, around: list[tuple[str, int]], path: str, assembly: str, interfaces: set[str]) -> dict:
    info = node.info
    kind, namespace = info["kind"], info["namespace"]
    segments = [*around, (info["name"], len(info["generic"]))]
    prefix = f"{namespace}." if namespace else ""
    bases = [parser.text(b) for b in info.get("bases", [])]
    members = info["members"]
    body = node.kind == "Type"
    depth = 0
    if body and kind in ("class", "record") and bases:
        first = info["bases"][0]
        depth = int(first.kind == "QualifiedName" or (first.info if first.kind in ("IdentifierName", "GenericName") else bases[0]) not in interfaces)
    params = [p for m in members if m.kind == "Constructor" for p in m.info["parameters"]] + (info["parameters"] if body else [])
    return {
        "path": path, "assembly": assembly, "name": info["name"] + (f"<{','.join(info['generic'])}>" if info["generic"] else ""), "namespace": namespace, "kind": kind,
        "modifiers": info["modifiers"], "base": bases[0] if bases and kind != "interface" else None, "interfaces": bases if kind == "interface" else bases[1:],
        "members": list(_members(parser, node)), "constructor_params": [parser.text(p.info["type"]) for p in params], "attributes": _attributes(info["attributes"]),
        "constraints": [{"parameter": p, "limits": c} for p, c in info.get("constraints", [])], "enum_base": parser.text(info["base"]) if info.get("base") is not None else None,
        "is_nested": bool(around), "line_count": parser.last_line(node) - parser.line(node.begin) + 1, "start_line": parser.line(node.begin),
        "qualified": prefix + ".".join(n for n, _ in segments), "type_id": f"{assembly}::{prefix}" + "+".join(f"{n}`{a}" if a else n for n, a in segments),
        "lcom": measures.cohesion(members) if body else None, "cbo": measures.coupled(node) if body else None, "rfc": measures.response(members, parser.text) if body else None,
        "dit": depth if body else None, "occurrences": [*measures.captures(members, parser), *measures.exceptions(node, parser)] if body else [],
    }


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


#: Rows and members in a batch that goes back to Spark, about.
BATCH = 2000


def _mapped(files: DataFrame, ddl: str, rows_of, symbols: frozenset[str]) -> DataFrame:
    schema = _arrow(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for path, text, assembly in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for row in rows_of(path, text, assembly or "", symbols) if text else []:
                    rows.append(row)
                    held += 1 + len(row.get("members", ()))
                if held >= BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    assembly = F.col("assembly") if "assembly" in files.columns else F.lit("")
    return files.select("path", "text", assembly.cast("string").alias("assembly")).mapInArrow(run, ddl)


def parse_files(files: DataFrame, symbols: Iterable[str] = ()) -> DataFrame:
    """Rows of TYPE of files (path, text, and the assembly where it is known), before anything is resolved between files."""
    return _mapped(files, TYPE, _rows, frozenset(symbols))


def registrations(files: DataFrame, symbols: Iterable[str] = ()) -> DataFrame:
    """Rows of REGISTRATION of files (path, text)."""
    return _mapped(files, REGISTRATION, _registrations, frozenset(symbols))


def read_sources(spark: SparkSession, folder: str, assembly: str = "", exclude: list[str] | None = None) -> DataFrame:
    """(path, text, assembly) of the source files below a folder, without those below the excluded ones (whatever their case)."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.cs").option("wholetext", "true").text(folder)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    rows = files.select(path.alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"), F.lit(assembly).alias("assembly"))
    for folder_ in exclude or []:
        rows = rows.filter(~F.startswith(F.lower("path"), F.lit(folder_.rstrip("/").lower() + "/")))
    return rows


def members_of(types: DataFrame) -> DataFrame:
    """A row for each member: the type's id, and the member with the names that `operators.metrics` takes."""
    m = F.col("m")
    plain = ("type", "member_kind", "cog", "cyc", "nesting", "lines", "start_line", "n1", "n2", "total1", "total2", "volume", "difficulty", "effort", "bugs", "parameters", "modifiers")
    return types.select("type_id", F.explode("members").alias("m")).select("type_id", m["name"].alias("method"), *[m[c].alias(c) for c in plain], F.size(m["parameters"]).alias("params"))


def occurrences_of(types: DataFrame) -> DataFrame:
    """A row for each captured closure and doubtful exception: type_id, method, kind, line, message, detail."""
    return types.select("type_id", F.explode("occurrences").alias("o")).select("type_id", "o.*")
