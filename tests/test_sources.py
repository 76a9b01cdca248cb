"""Source code, project metadata, sinks and streams on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from codestrata import sinks
from codestrata.operators import dependencies
from codestrata.sources import code, measures, projects, syntax
from codestrata.streaming import changes


def method(text, name="M"):
    parser = syntax.Parser(f"class C {{ {text} }}")
    return parser, next(n for n in parser.unit().below() if n.kind == "Method" and n.info["name"] == name)


@pytest.mark.parametrize(("text", "cognitive", "cyclomatic", "nesting"), [
    ("void M();", 0, 1, 0), ("void M() { }", 0, 1, 0), ("int M() => a > 1 ? 2 : 3;", 1, 2, 1),
    ("void M() { if (a) { if (b) { x(); } } else if (c) { } else { } }", 5, 4, 2),
    ("void M() { if (a && b || c && !d) { } }", 4, 5, 1), ("bool M() => a && b && c;", 1, 3, 0),
    ("void M() { foreach (var x in xs) { while (true) { do { } while (b); } } }", 6, 4, 3),
    ("void M() { foreach (var (k, v) in xs) { } for (int i = 0, j = 1; i < 3; i++, j--) ; }", 1, 2, 1),
    ("void M() { switch (x) { case 1: break; case 2 when y: goto case 1; default: break; } }", 2, 4, 1),
    ("int M() => x switch { 1 => 2, > 3 and < 9 => 4, null or \"a\" => 5, _ => 6 };", 1, 5, 1),
    ("void M() { try { } catch (IOException) { if (a) { } } catch { } finally { } }", 4, 4, 2),
    ("void M() { Run(() => { if (a) { } }); }", 2, 2, 2), ("void M() { Run(delegate (int x) { if (x > 1) return; }); }", 2, 2, 2),
    ("void M() { M(); }", 1, 1, 0), ("void M() { this.M(); }", 1, 1, 0), ("void M() { other.M(); }", 0, 1, 0),
    ("void M() { var y = a?.b?.c ?? d; x ??= 2; }", 0, 4, 0), ("void M() { if (x is A or B and not C) { } }", 3, 2, 1), ("void M() { if (x is { P: 1 or 2 } q && q.P > 0) { } }", 3, 3, 1),
    ("void M() { static void L() { if (a) { } } void N() { if (a) { } } }", 1, 3, 1),
    ('void M() { var s = $"{(a ? 1 : 2):x} {b,5} {{no}}" + @"if (""x"")" + """raw "if" """; }', 1, 2, 1),
    ("void M() { if (a) return; else throw new Exception(nameof(a)); }", 2, 2, 1),
    ("void M() { var x = (Foo)bar; var y = (a) + b; var z = a < b > (c); List<Map<int, A>> l = new(); l = new List<Map<int, A>> { new() { [1] = 2 } }; }", 0, 1, 0),
    ("async Task M() { await foreach (var x in xs) { } await using var f = G(); lock (o) { yield return 1; } label: goto label; }", 2, 3, 1),
    ("void M() { var q = from x in xs where x > 1 && y select x; int b = a >> 1; b >>= 2; Span<int> s = stackalloc int[3]; ref int r = ref s[0]; }", 1, 2, 0),
])
def test_complexities(text, cognitive, cyclomatic, nesting):
    _, m = method(text)
    body = m.info["body"]
    assert (measures.cognitive(body, "M"), measures.cyclomatic(body), measures.nesting(body)) == (cognitive, cyclomatic, nesting)


def test_halstead_counts():
    parser, m = method("int M() { int x = 1; if (x > 1) { return x + 1; } return x >> 2; }")
    h = measures.halstead(m.info["body"], parser)
    # = If > Return + Return >> | x 1 1 1 2
    assert (h["total1"], h["n1"], h["total2"], h["n2"]) == (7, 6, 5, 3)


def rows_of(text, assembly="A", symbols=frozenset()):
    return {r["qualified"]: r for r in code.types_of("f.cs", text, assembly, symbols)[0]}


SOURCE = """
using System;
[assembly: Foo]
namespace N.O
{
    /// <summary>A "comment" { with braces</summary>
    [Serializable, Named("x", Order = 2)]
    public abstract partial class Base<T, U> : Other.Parent<T>, IFoo where T : class, IBar<U>, new() where U : struct
    {
        private const int A = 1, B = 2;
        [SerializeField] readonly Dictionary<string, List<T>> map = new() { { "a", null } };
        public event Action<int> Changed;
        public event EventHandler Custom { add { } remove { } }
        public int P { get; private set; } = 3;
        public string Q => map["x"].ToString();
        public T this[int i, string s] { get => default; }
        public Base(int x, Foo y) : base(x) { this.map = null; }
        static Base() { }
        ~Base() { }
        public static Base<T, U> operator +(Base<T, U> a, Base<T, U> b) => a;
        public static implicit operator int(Base<T, U> a) => 1;
        protected override async Task<(int a, Foo b)> Run<V>(ref int z, params Foo[] rest) where V : T { await Task.Delay(A); return (1, map[null]); }
        void IFoo.Do() { }
        enum Kind : byte { One = 1, [Old] Two, Three = One | Two }
        interface IInner : IOne, ITwo { void X(); int Y { get; } }
        public struct S { int q; }
    }
}
public record Point(int X, int Y = 2) : Shape(X), IEquatable<Point> { public int Z; }
public record struct Small(int V);
public delegate Task<int> Work<in T>(T item, CancellationToken token) where T : class;
#if DEBUG && !OTHER
class OnlyDebug { }
#elif RELEASE
class OnlyRelease { }
#else
class Neither { }
#endif
"""


def test_declarations():
    r = rows_of(SOURCE)
    assert set(r) == {"N.O.Base", "N.O.Base.Kind", "N.O.Base.IInner", "N.O.Base.S", "Point", "Small", "Work", "Neither"}
    b = r["N.O.Base"]
    assert (b["name"], b["type_id"], b["kind"], b["base"], b["interfaces"], b["start_line"], b["line_count"]) == ("Base<T,U>", "A::N.O.Base`2", "class", "Other.Parent<T>", ["IFoo"], 7, 21)
    assert b["modifiers"] == ["public", "abstract", "partial"] and b["constructor_params"] == ["int", "Foo"]
    assert b["attributes"] == [{"name": "Serializable", "arguments": None}, {"name": "Named", "arguments": [("arg0", '"x"'), ("Order", "2")]}]
    assert b["constraints"] == [{"parameter": "T", "limits": ["class", "IBar<U>", "new()"]}, {"parameter": "U", "limits": ["struct"]}]
    assert [(m["name"], m["member_kind"]) for m in b["members"]] == [
        ("A", "Field"), ("B", "Field"), ("map", "Field"), ("Changed", "Event"), ("Custom", "Event"), ("P", "Property"), ("Q", "Property"), ("this[]", "Indexer"), ("Run", "Method"), ("Do", "Method")]
    run = b["members"][-2]
    assert (run["type"], run["parameters"], run["lines"], run["modifiers"]) == ("Task<(int a, Foo b)>", [{"name": "z", "type": "int"}, {"name": "rest", "type": "Foo[]"}], 1, ["protected", "override", "async"])
    assert [(m["name"], m["type"]) for m in r["N.O.Base.Kind"]["members"]] == [("One", "enum = 1"), ("Two", "enum"), ("Three", "enum = One | Two")] and r["N.O.Base.Kind"]["enum_base"] == "byte"
    assert (r["N.O.Base.IInner"]["base"], r["N.O.Base.IInner"]["interfaces"], r["N.O.Base.S"]["type_id"]) == (None, ["IOne", "ITwo"], "A::N.O.Base`2+S")
    assert (r["Point"]["kind"], r["Point"]["base"], [m["name"] for m in r["Point"]["members"]], r["Point"]["constructor_params"]) == ("record", "Shape", ["Z", "X", "Y"], ["int", "int"])
    assert r["Small"]["kind"] == "record struct" and r["Small"]["dit"] == 0 and r["Point"]["dit"] == 1
    work = r["Work"]["members"][0]
    assert (r["Work"]["kind"], work["name"], work["type"], work["cog"], [p["type"] for p in work["parameters"]]) == ("delegate", "Invoke", "Task<int>", None, ["T", "CancellationToken"])
    assert "OnlyDebug" in rows_of(SOURCE, symbols=frozenset({"DEBUG"})) and "Neither" in rows_of(SOURCE, symbols=frozenset({"DEBUG", "OTHER"}))


def test_damaged_sources_keep_what_can_be_read():
    r = rows_of("class A { void M( { } int x; void N() { if (a) { } } } class B { int y = ; int z; } } } class D { ")
    assert {"A", "B", "D"} <= set(r) and "z" in [m["name"] for m in r["B"]["members"]]
    for text in ("", "{", "}}}", "class", "class C {", '"', "/*", "#if", "$\"{", "class C { void M() { a.b. } }", "\x00" * 50, "(" * 3000, "class C { int M() => " + "1 + " * 3000 + "1; }", "[" * 500):
        code.types_of("x", text)


def test_cohesion_coupling_response():
    c = rows_of("class C : Base, IX { int a, b; static int s; List<Foo> l; void M() { a = 1; } void N() { this.b = 2; Q.Run(); var x = (Bar)new Baz(typeof(Qux)); Baz y = null; } C(C c) { } }")["C"]
    assert (c["lcom"], c["cbo"], c["rfc"]) == (1.17, 7, 4)
    assert rows_of("class C { int a; void M() { a = 1; } }")["C"]["lcom"] is None and rows_of("class C { int a; void M() { a = 1; } void N() { a = 2; } }")["C"]["lcom"] == 0.0
    assert rows_of("interface I { } class C : I { }")["C"]["dit"] == 0 and rows_of("class C : I { }")["C"]["dit"] == 1


def test_occurrences():
    c = rows_of("""class C {
        void M(int p) { int q = 0; Run(x => p + x); Run((a, b) => a + b); Run(delegate { q++; }); }
        void N() { try { } catch (Exception e) { throw new Foo("x"); } try { } catch (A a) { throw new Foo("x", a); } try { } catch { throw; } throw new Exception("y"); }
    }""")["C"]
    assert [(o["method"], o["kind"], o["message"]) for o in c["occurrences"]] == [
        ("M", "ClosureCapture", "captures: p"), ("M", "ClosureCapture", "captures: q"), ("N", "CatchAllException", "catch-all at line 3"), ("N", "MissingInnerException", "throw new Foo without inner exception"),
        ("N", "ThrowingSystemException", "throw new Exception() directly")]


def test_registrations():
    _, found = code.types_of("x", """class C { [Inject] Foo f; [Zenject.Inject] void Set() { } void I([Inject] Bar b) {
        b.Register<IA, A>(Lifetime.Scoped); b.Register<A>(); b.Register(x); b.RegisterInstance(thing); b.RegisterFactory<F>(x); c.Bind<IS>().To<S>().AsCached(); c.BindInterfacesTo<T>().AsSingle(); } }""")
    got = {(r["service"], r["implementation"], r["container"], r["lifetime"]) for r in found}
    assert got == {("IA", "A", "VContainer", "Scoped"), ("A", "A", "VContainer", None), ("thing", "thing", "VContainer", "Singleton"), ("F", "F", "VContainer", "Transient"), ("IS", "S", "Zenject", "Scoped"), ("T", "T", "Zenject", "Singleton"),
                   ("Foo", "Foo", "Unknown", None), ("Set", "Set", "Zenject", None), ("Bar", "Bar", "Unknown", None)}


def test_sources_to_edges(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "A.cs").write_text("namespace N; class A : B, I { C<D> f; E[] g; void M(F p) { } A(G q) { } class Inner { } Inner i; }")
    (tmp_path / "a" / "B.cs").write_text("﻿namespace N; class B { } interface I { } class C<T> where T : F { } class D { } enum E { X } class F { } class G { } class U { A.Inner x; Unknown y; }")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip" / "Z.cs").write_text("class Z { }")
    types = code.parse_files(code.read_sources(spark, str(tmp_path), "P", [str(tmp_path / "SKIP")]))
    assert types.filter("name = 'Z'").count() == 0
    got = {(r.from_id.split(".")[-1], r.to_id.split(".")[-1], r.kind) for r in dependencies.build(types).collect()}
    assert got == {("A", "B", "Inheritance"), ("A", "I", "InterfaceImpl"), ("A", "C`1", "FieldType"), ("A", "D", "FieldType"), ("A", "E", "FieldType"), ("A", "F", "MethodParam"), ("A", "G", "ConstructorParam"), ("A", "A+Inner", "FieldType"), ("C`1", "F", "GenericConstraint")}
    both = dependencies.with_registrations(dependencies.build(types), spark.createDataFrame([("S", "T")], "service string, implementation string"))
    assert both.filter("kind = 'DIRegistration' AND from_id IS NULL").count() == 1
    assert code.parse_files(spark.createDataFrame([("x", None), ("y", "")], "path string, text string")).count() == 0


def test_partial_types_and_interfaces_of_other_files(spark):
    files = [("b.cs", "partial class P : Base { int x; P(int a) { } } partial class P { }"), ("a.cs", "[A(1)] partial class P : IX { void M() { } }"), ("c.cs", "[A(2), B] partial class P : Base, IX, IY { int y; } interface IX { } class Base { } class Q : IX { }")]
    types = code.parse_files(spark.createDataFrame(files, "path string, text string"))
    got = {r.name: r for r in dependencies.merged_partials(dependencies.resolved_bases(types)).collect()}
    p = got["P"]
    assert (p.base, p.interfaces, [m.name for m in p.members], p.constructor_params, p.line_count, p.path) == ("Base", ["IX", "IY"], ["M", "x", "y"], ["int"], 4, "a.cs")
    assert [(a.name, dict(a.arguments or {})) for a in p.attributes] == [("A", {"arg0": "1"}), ("B", {})] and (got["Q"].base, got["Q"].interfaces) == (None, ["IX"])


def test_cycles(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "A"), ("C", "C"), ("X", "Y"), ("Y", "Z"), ("Z", "X")], "from_type string, to_type string")
    a = spark.createDataFrame([("p", ["q", "x"]), ("q", ["p"]), ("r", [])], "name string, references array<string>")
    got = [(r.level, r.size, r.member) for r in dependencies.all_cycles(e, a).collect()]
    assert got == [("Type", 3, "X"), ("Type", 3, "Y"), ("Type", 3, "Z"), ("Assembly", 2, "p"), ("Assembly", 2, "q"), ("Type", 2, "A"), ("Type", 2, "B")]


def test_assembly_definitions(spark):
    files = spark.createDataFrame([("/p/a/A.asmdef", '{"name": "A", "references": ["B", "GUID:00FF", "guid:zz", null]}'), ("/p/b/B.asmdef", '{"name": null}'), ("/p/a/in/C.asmdef", '{"name": "C", "references": []}'), ("/p/x.asmdef", "not json"), ("/p/n", None)], "path string, text string")
    metas = spark.createDataFrame([("/p/b/B.asmdef.meta", "x: 1\n  GUID: 00ff \n"), ("/p/a/in/C.asmdef.meta", "guid: 00FF"), ("/p/a/A.asmdef.meta", "guid:\n")], "path string, text string")
    d = projects.assembly_definitions(files, metas)
    got = {r.name: (r.references, r.unresolved, r.directory) for r in d.collect() if r.path != "/p/x.asmdef"}
    assert got == {"A": (["B", "C"], ["guid:zz"], "/p/a"), "B": ([], [], "/p/b"), "C": ([], [], "/p/a/in")}
    paths = spark.createDataFrame([("/p/a/x.cs",), ("/P/A/in/y.cs",), ("/p/z.cs",)], "path string")
    d = d.filter("path <> '/p/x.asmdef'")
    assert {r.path: r.name for r in projects.assembly_of(paths, d).collect()} == {"/p/a/x.cs": "A", "/P/A/in/y.cs": "C", "/p/z.cs": None}
    loose = projects.with_loose_files(d, paths, "/p").filter("name = 'Assembly-CSharp'").first()
    assert (loose.references, loose.exclude) == (["C", "A", "B"], ["/p/a/in", "/p/a", "/p/b"]) or set(loose.references) == {"A", "B", "C"}
    assert projects.with_loose_files(d, paths.limit(1), "/p").count() == 3
    with pytest.raises(projects.NotFound):
        projects.by_name(d, "none")
    assert [r.name for r in projects.by_name(d, "a").collect()] == ["A"] and projects.by_prefix(d, "c").count() == 1


def test_project_files(spark):
    xml = """<Project xmlns="http://x"><ItemGroup><Reference Include="R"><HintPath>..\\lib\\R.dll</HintPath></Reference><Reference Include="S"/><ProjectReference Include="P.csproj"/>
      <!-- <HintPath>no</HintPath> --></ItemGroup><PropertyGroup><DefineConstants>A;B, C;A</DefineConstants><LangVersion>9.0</LangVersion><LangVersion>10</LangVersion></PropertyGroup></Project>"""
    p = projects.project_files(spark.createDataFrame([("/s/x/X.csproj", xml), ("/s/y.csproj", "<Project><DefineConstants>D;A</DefineConstants><HintPath>../LIB/r.dll</HintPath></Project>"), ("/s/z", None), ("/s/q", "junk")], "path string, text string"))
    r = p.filter("path = '/s/x/X.csproj'").first()
    assert (r.hints, r.projects, r.defines, r.language) == (["/s/x/../lib/R.dll"], ["P.csproj"], ["A", "B", "C"], "9.0")
    m = projects.merged_projects(p).first()
    assert (m.defines, m.language, len(m.hints)) == (["A", "B", "C", "D"], "9.0", 2)
    assert projects.merged_projects(p.limit(0)).count() == 0
    sln = spark.createDataFrame([("/s/a.sln", 'x\r\nProject("{F}") = "X", "x\\X.csproj", "{1}"\r\nProject("{F}") = "Folder", "f", "{2}"\r\n')], "path string, text string")
    assert [x.project for x in projects.solution_projects(sln).collect()] == ["/s/x/X.csproj"]
    found = spark.createDataFrame([("/s/Library/l.csproj",), ("/s/m.csproj",)], "path string")
    assert [x.path for x in projects.discovered_projects(sln.limit(0), found).collect()] == ["/s/m.csproj"] and projects.discovered_projects(sln, found).first().path == "/s/x/X.csproj"
    assert projects.merged_symbols("2022.3.45f1", ["A", "UNITY_EDITOR"]) == ["UNITY_EDITOR", "UNITY_2022", "A"] and projects.merged_symbols(None, ["A"]) == ["A"]


def test_folders(tmp_path):
    deep = tmp_path / "r" / "Assets" / "b"
    deep.mkdir(parents=True)
    assert projects.assets_folder(str(tmp_path / "r")) == str(tmp_path / "r" / "Assets") and projects.assets_folder(str(deep)) == str(deep)
    (tmp_path / "r" / "x.sln").write_text("")
    assert projects.project_root(str(deep)) == str(tmp_path / "r")


def test_snapshot_round_trip(spark, tmp_path):
    types = spark.createDataFrame([("A::N.T", "T", "N", "A", 12, 8.5, None, "src/T.cs")], "type_id string, name string, namespace string, assembly string, line_count int, health double, lcom double, path string")
    edges = spark.createDataFrame([("T", "U", "FieldType", "A::N.T", None)], "from_type string, to_type string, kind string, from_id string, to_id string")
    for i, at in enumerate(("2024-02-01T00:00:00Z", "2024-01-01T00:00:00Z")):
        sinks.write(str(tmp_path / f"{i}.json"), sinks.snapshot_parts("/p", at, types, edges))
    (tmp_path / "2.json").write_text("null")
    (tmp_path / "no.txt").write_text("{}")
    whole = json.loads((tmp_path / "0.json").read_text())
    assert whole["typeMetrics"] == [{"typeId": "A::N.T", "typeName": "T", "namespace": "N", "assembly": "A", "lineCount": 12, "codeHealth": 8.5, "filePath": "src/T.cs"}]
    assert whole["dependencies"] == [{"fromType": "T", "toType": "U", "kind": "FieldType", "fromTypeId": "A::N.T"}]
    rows = projects.read_snapshots(spark, str(tmp_path))
    assert [str(r.analyzedAt)[:10] for r in rows.collect()] == ["2024-02-01", "2024-01-01"]
    back = projects.snapshot_types(rows).orderBy("at").collect()
    assert [(r.type_id, r.line_count, r.health, r.lcom, r.position) for r in back] == [("A::N.T", 12, 8.5, None, 0)] * 2


def test_sarif_document(spark, tmp_path):
    types = spark.createDataFrame([("1", "T", "/p/src/T.cs", 3, 4.0, 600, 2, None), ("2", "U", None, 1, 9.0, 1, 1, 0.5)], "type_id string, name string, path string, start_line int, health double, line_count int, method_count int, lcom double")
    methods = spark.createDataFrame([("1", "m", 30, 1, 2, 3, 4, 5), ("1", "m", 20, 6, 7, 8, 9, 10)], "type_id string, method string, start_line int, cog int, cyc int, nesting int, params int, lines int")
    found = spark.createDataFrame([("1", None, "GodClass", "Critical", "600 lines"), ("1", "m", "LongMethod", "Warning", "x"), ("2", None, "LowCohesion", "Warning", "y"), ("2", None, "Other", "Warning", "z")], "type_id string, method string, kind string, severity string, message string")
    sinks.write(str(tmp_path / "o.sarif"), sinks.sarif_parts(sinks.sarif_results(found, types, methods, "/p"), "/p"))
    run = json.loads((tmp_path / "o.sarif").read_text())["runs"][0]
    got = {r["ruleId"]: r for r in run["results"]}
    assert len(run["tool"]["driver"]["rules"]) == 16 and set(got) == {"CST001", "CST002", "CST006"} and run["originalUriBaseIds"]["%SRCROOT%"]["uri"] == "file:///p/"
    assert got["CST001"]["level"] == "error" and got["CST001"]["message"]["text"] == "T: 600 lines" and "locations" not in got["CST006"] and got["CST006"]["properties"]["lcom"] == 0.5
    place = got["CST002"]["locations"][0]["physicalLocation"]
    assert place == {"artifactLocation": {"uri": "src/T.cs", "uriBaseId": "%SRCROOT%"}, "region": {"startLine": 20}} and got["CST002"]["properties"]["cognitiveComplexity"] == 6


def test_status_line_formats_and_texts(spark, tmp_path):
    t = spark.createDataFrame([(9.0, 70.0), (4.0, None)], "health double, avg_mi double")
    f = spark.createDataFrame([("Warning",), ("Critical",), ("Warning",)], "severity string")
    line = sinks.status_line(sinks.status_summary(t, f, cycles=2)).first().line
    assert line == "\x1b[33mCH:6.5\x1b[0m/\x1b[31m4.0\x1b[0m \x1b[31mMI:35\x1b[0m \x1b[33m2smells\x1b[0m \x1b[31m\U0001f5341\x1b[0m \x1b[31m♻2\x1b[0m"
    assert sinks.status_line(sinks.status_summary(t.limit(0), f.limit(0))).first().line == ""
    assert [sinks.output_format(*x) for x in ((None, None), ("JSON", "x.html"), (None, "a.SARIF"), (None, "a.htm"), (None, "a.x"))] == ["html", "json", "sarif", "html", "json"]
    with pytest.raises(ValueError):
        sinks.output_format("xml", None)
    assert sinks.options(["a", "-p", "x", "--help", "-o"]) == {"-p": "x", "--help": "true"}
    assert sinks.html_page("<title>{{PROJECT}}</title>{{DATA}}", '"</script>"', "<p>") == '<title>&lt;p&gt;</title>"<\\/script>"'
    assert "  Improved:  2" in sinks.diff_text({"Improved": 2}, ["T"], [], "a", "b") and "No hotspots" in sinks.hotspot_text([], "p", "1y")
    assert "CodeHealth delta:  -0.3" in sinks.trend_text({"snapshots": 2, "health_delta": -0.3, "smell_delta": 0}, [])
    calls = []
    make = lambda: calls.append(1) or f"v{len(calls)}"
    path = str(tmp_path / "cache")
    assert [sinks.cached(path, 60, make), sinks.cached(path, 60, make), sinks.cached(path, -1, make)] == ["v1", "v1", "v2"]
    assert sinks.cached(path, -1, lambda: 1 / 0) == "v2"
    assert sinks.rules_catalogue(spark).count() == 16 and sinks.metrics_catalogue(spark).count() == 21 and sinks.schema_catalogue(spark, code.TYPE).count() == 23


def test_streamed_change_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("src/a.cs\n\nSRC/A.cs\n")
    q = changes.change_counts(changes.read(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    (tmp_path / "in" / "2.txt").write_text("src/a.cs\nb.cs\n")
    q.processAllAvailable()
    q.stop()
    assert {(r.path_key, r.path, r.changes) for r in spark.table("counts").collect()} == {("src/a.cs", "SRC/A.cs", 3), ("b.cs", "b.cs", 1)}
    assert changes.windowed_counts(spark.createDataFrame([("a",), (" A ",)], "line string").withColumn("seen", F.lit("2024-01-01").cast("timestamp"))).first().changes == 2


def test_methods_parsed_by_themselves_are_what_they_are_in_their_file(monkeypatch):
    text = """using System; namespace A { public class K : B {
  int f; public static int S(List<int> a) { if (a == null || f > 1) { throw new Exception("}"); } return this.f; }
  public K(int a) { f = a; }
  public void M() { c.Bind<I>().To<K>().AsSingle(); Action d = () => { f += x; }; int x = 1; }
  protected override async Task Z(X ct) { try { await Foo(ct); } catch (Exception e) { throw new Y("a"); } } // }
  public int Broken() { int y = ; return 1 }
  public class Inner { public int T([Inject] Foo p) { try { } catch { } return '}'; } } } }"""
    whole = code.methods_in
    monkeypatch.setattr(code, "methods_in", lambda text: [])
    plain = code.types_of("x", text)
    monkeypatch.setattr(code, "methods_in", whole)
    assert code.types_of("x", text) == plain and len(plain[0]) == 2 and len(plain[1]) == 2
    assert sum(n.kind == "Cut" for n in code._unit(text, frozenset())[1].below()) == 4  # S, M, Z, T; the damaged one isn't


def test_equal_methods_are_parsed_once(monkeypatch):
    done = []
    parsed = code._parsed
    monkeypatch.setattr(code, "_PARTS", {})
    monkeypatch.setattr(code, "_parsed", lambda text: done.append(text) or parsed(text))
    for i in range(50):
        (row,) = code.types_of("x", f"class C{i} {{\n\n  public int M(int a) {{ try {{ }} catch {{ }} return a; }} }}")[0]
        assert row["members"][0]["start_line"] == 3 and row["occurrences"][0]["message"] == "catch-all at line 3"
    assert len(done) == 1


def test_edges_read_the_types_once(spark, tmp_path):
    files = spark.createDataFrame([(f"{i}.cs", f"class T{i} {{ T{i + 1} n; }}") for i in range(5)], "path string, text string")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    types = code.parse_files(files.coalesce(1).mapInArrow(count, "path string, text string"))
    assert {(r.from_type, r.to_type) for r in dependencies.build(types).collect()} == {(f"T{i}", f"T{i + 1}") for i in range(4)}
    assert seen.value == 5
