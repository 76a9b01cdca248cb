import math
import random

import pytest
from pyspark.sql import functions as F

from codestrata import plans
from codestrata.functions import identity as names
from codestrata.functions.rounding import half_even
from codestrata.functions.scores import HEALTH_PARTS, interpolate, maintainability
from codestrata.operators import agreement, edges, graph, metrics, resolve, rollup, rules, sketch, snapshots


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_half_even(spark):
    assert [one(spark, half_even(F.lit(x), d)) for x, d in ((2.5, 0), (3.5, 0), (0.125, 2), (-2.5, 0))] == [2.0, 4.0, 0.12, -2.0]


@pytest.mark.parametrize(("x", "want"), [(0, 10), (5, 10), (7.5, 7.5), (10, 5), (17.5, 3), (25, 1), (99, 1)])
def test_interpolate(spark, x, want):
    assert one(spark, interpolate(F.lit(float(x)), *HEALTH_PARTS["avg_cog"][1:])) == want


def test_maintainability(spark):
    assert one(spark, maintainability(F.lit(0.0), F.lit(1), F.lit(1))) == 100
    assert one(spark, maintainability(F.lit(1e9), F.lit(90), F.lit(10000))) == 0
    want = (171 - 5.2 * math.log(100) - 0.23 * 3 - 16.2 * math.log(10)) * 100 / 171
    assert abs(one(spark, maintainability(F.lit(100.0), F.lit(3), F.lit(10))) - want) < 1e-9


METHOD = {"type_id": "T", "method": "m", "lines": 1, "cog": 0, "cyc": 1, "params": 0, "nesting": 0, "mi": 100.0}


@pytest.mark.parametrize(
    ("change", "want"),
    [({}, []), ({"lines": 79}, []), ({"lines": 80}, [("LongMethod", "Warning")]), ({"lines": 150}, [("LongMethod", "Critical")]), ({"cog": 14}, []), ({"cog": 15}, [("HighComplexity", "Warning")]), ({"cog": 25}, [("LongMethod", "Warning")]), ({"cog": 40}, [("LongMethod", "Critical")]),
     ({"params": 5}, []), ({"params": 6}, [("ExcessiveParameters", "Warning")]), ({"cyc": 15}, [("HighComplexity", "Warning")]), ({"nesting": 3}, []), ({"nesting": 4}, [("DeepNesting", "Warning")]), ({"nesting": 6}, [("DeepNesting", "Critical")]),
     ({"mi": 20.0}, []), ({"mi": 19.9}, [("LowMaintainability", "Warning")]), ({"mi": 9.9}, [("LowMaintainability", "Critical")])],
)
def test_method_rules(spark, change, want):
    rows = rules.method_findings(spark.createDataFrame([METHOD | change])).collect()
    assert [(r.kind, r.severity) for r in rows] == want


@pytest.mark.parametrize(
    ("change", "want"),
    [({}, []), ({"line_count": 499}, []), ({"line_count": 500}, [("GodClass", "Warning")]), ({"line_count": 1000}, [("GodClass", "Critical")]), ({"method_count": 20}, [("GodClass", "Warning")]), ({"lcom": 0.8}, [("LowCohesion", "Warning")]),
     ({"cbo": 13}, []), ({"cbo": 14}, [("HighCoupling", "Warning")]), ({"cbo": 25}, [("HighCoupling", "Critical")]), ({"dit": 5}, []), ({"dit": 6}, [("DeepInheritance", "Warning")])],
)
def test_type_rules(spark, change, want):
    row = {"type_id": "T", "line_count": 1, "method_count": 1, "lcom": None, "cbo": None, "dit": None} | change
    df = spark.createDataFrame([row], "type_id string, line_count int, method_count int, lcom double, cbo int, dit int")
    assert [(r.kind, r.severity) for r in rules.type_findings(df).collect()] == want


def edge_rows(spark, *pairs):
    return spark.createDataFrame([(a, b, "FieldType") for a, b in pairs], "from_id string, to_id string, kind string")


def test_coupling_counts_distinct_known_pairs(spark):
    e = edge_rows(spark, ("A", "B"), ("A", "B"), ("A", "C"), ("B", "A"), ("A", "A"), ("A", None), ("A", "Unknown"))
    t = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "type_id string")
    got = {r.type_id: (r.ca, r.ce, r.instability) for r in edges.coupling(e, t).collect()}
    assert got == {"A": (1, 2, 0.6667), "B": (1, 1, 0.5), "C": (1, 0, 0.0), "D": (0, 0, None)}


def ranks(spark, pairs, ids):
    e = spark.createDataFrame(pairs or [("", "")], "src string, dst string").filter("src <> ''")
    return {r.id: r["rank"] for r in graph.rank(e, spark.createDataFrame([(i,) for i in ids], "id string")).collect()}


def test_rank(spark):
    star = ranks(spark, [("A", "B"), ("A", "C"), ("A", "D")], "ABCD")
    assert abs(sum(star.values()) - 1) < 1e-9 and star["B"] > star["A"] and abs(star["B"] - star["D"]) < 1e-9
    ring = ranks(spark, [(a, b) for a in "ABC" for b in "ABC"], "ABC")
    assert all(abs(x - 1 / 3) < 1e-6 for x in ring.values())


@pytest.mark.parametrize(("pairs", "want"), [
    ([("a", "b"), ("b", "a")], {"a": "a", "b": "a"}), ([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], {"a": "a", "b": "a", "c": "a"}),
    ([("a", "a"), ("a", "b")], {}), ([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c")], {"a": "a", "b": "a", "c": "c", "d": "c"}),
])
def test_strong_components(spark, pairs, want):
    got = graph.strong_components(spark.createDataFrame(pairs, "src string, dst string"))
    assert {r.id: r.component for r in got.collect()} == want


def order_tables(spark, folder, orders, parts):
    """Tables whose edges are the neighbouring parts of each order."""
    lines = [(o, i + 1, p, 1, 1.0, 1.0) for o, ps in enumerate(orders) for i, p in enumerate(ps)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(p, f"n{p}", f"Brand#{p % 3}", f"type {p % 4}", 1) for p in range(parts)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    return [(a, b) for ps in orders for a, b in zip(ps, ps[1:], strict=False)]


def test_cycles_over_all_edges_against_brute_force(spark, tmp_path):
    rng = random.Random(7)
    pairs = order_tables(spark, tmp_path, [[rng.randrange(60) for _ in range(rng.randrange(2, 4))] for _ in range(45)], 60)
    reach = {a: {b for x, b in pairs if x == a} for a in range(60)}
    for k in range(60):
        for a in range(60):
            if k in reach[a]:
                reach[a] = reach[a] | reach[k]
    want = {}
    for a in range(60):
        same = [b for b in range(60) if b != a and b in reach[a] and a in reach[b]]
        if same:
            want[a] = min(a, *same)
    assert want and any(a % 10 != b % 10 for a, b in want.items())
    assert {r.id: r.component for r in plans.QUERIES["cycles"](spark, str(tmp_path)).collect()} == want


def test_resolution_levels(spark):
    known = spark.createDataFrame(
        [("1", "A.B.X", "X"), ("2", "A.X", "X"), ("3", "C.Y", "Y"), ("4", "D.Z", "Z"), ("5", "E.Z", "Z"), ("6", "A.T.X", "X"), ("7", "A.T.U.X", "X"), ("8", "G.L", "L"), ("9", "W.W", "W"), ("10", "W.W", "W")],
        "type_id string, qualified string, simple string",
    )
    refs = spark.createDataFrame(
        [("q", "A.X", "Q", "Q.R"), ("inner", "X", "A.B", "A.B.R"), ("outer", "X", "A.K", "A.K.R"), ("simple", "Y", "Q", "Q.R"), ("ambiguous", "Z", "Q", "Q.R"), ("near", "Z", "E", "E.R"), ("within", "X", "A", "A.T.R"),
         ("deeper", "X", "A", "A.T.U.R"), ("normal", " global::L<int>[]? ", "Q", "Q.R"), ("none", "Y", "", "R"), ("blank", " ", "Q", "Q.R"), ("null", None, "Q", "Q.R"), ("twice", "W.W", "Q", "Q.R")],
        "ref_id string, name string, namespace string, qualified string",
    )
    got = {r.ref_id: r.type_id for r in resolve.resolve(refs, known).collect()}
    # "outer" finds nothing: namespaces around its own are not looked at, and the simple name is that of several types.
    assert got == {"q": "2", "inner": "1", "simple": "3", "near": "5", "within": "6", "deeper": "7", "normal": "8", "none": "3"}


def test_reclassify(spark):
    t = spark.createDataFrame([("1", "P", "IX", ["IY"]), ("2", "P", "Base", []), ("3", "Q", "IX", [])], "type_id string, assembly string, base string, interfaces array<string>")
    i = spark.createDataFrame([("P", "IX")], "assembly string, simple string")
    assert {r.type_id: (r.base, r.interfaces) for r in resolve.reclassify_bases(t, i).collect()} == {"1": (None, ["IX", "IY"]), "2": ("Base", []), "3": ("IX", [])}


@pytest.mark.parametrize(("name", "arity"), [("A", 0), ("A<B>", 1), ("A<B,C>", 2), ("A<B<C,D>,E>", 2), (" global::A<B,C>[]? ", 2), ("A<>", 0), (None, 0)])
def test_arity(spark, name, arity):
    assert one(spark, names.generic_arity(F.lit(name))) == arity


def test_names(spark):
    assert one(spark, names.normalized_reference(F.lit(" global::A.B[]? "))) == "A.B"
    assert one(spark, names.without_generics(F.lit(" global::A.C<B>? "))) == "A.C" and one(spark, names.normalized_reference(F.lit(None))) == ""
    assert one(spark, names.containing_prefixes(F.lit("a.b.c"))) == ["a.b", "a"]
    assert one(spark, names.containing_prefixes(F.lit("n.m.T.U.V"), F.lit("n.m"))) == ["n.m.T.U", "n.m.T"] and one(spark, names.containing_prefixes(F.lit("n.m.T"), F.lit("n.m"))) == []
    assert one(spark, names.fallback_type_id(F.lit("a"), F.lit("n"), F.lit("T<A,B>"))) == "a::n.T`2" and one(spark, names.fallback_qualified(F.lit(""), F.lit("T<A>"))) == "T"
    assert one(spark, names.type_names(F.lit("(int a, Foo b)"))) == ["(int a, Foo b)"] and one(spark, names.type_names(F.lit("Map<A,B>[]"))) == ["Map", "A"] and one(spark, names.type_names(F.lit("A<B?>?"))) == ["A", "B"]
    assert one(spark, names.type_names(F.lit("Map<Key, List<Item>>"))) == ["Map", "Key", "List", "Item"]
    assert one(spark, names.relative_path(F.lit("/p/q/"), F.lit("/p/q/r/s.cs"))) == "r/s.cs"
    assert one(spark, names.html_escaped(F.lit("<a href='x'>&\""))) == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;"


def test_bloom(spark):
    f = spark.createDataFrame([("alpha",), ("beta",)], "s string").agg(sketch.union(sketch.bits(F.col("s"))).alias("f"))
    got = f.select(sketch.might_contain(F.col("f"), F.lit("alpha")).alias("a"), sketch.might_contain(F.col("f"), F.lit("gamma")).alias("g"), sketch.similarity(F.col("f"), F.col("f")).alias("s"), sketch.similarity(F.array(), F.array()).alias("e")).first()
    assert (got.a, got.g, got.s, got.e) == (True, False, 1.0, 1.0)


def test_diff_status(spark):
    cols = "type_id string, " + ", ".join(f"{m} double" for m in snapshots.DIFFED)
    base = dict.fromkeys(snapshots.DIFFED, 5.0)
    b = spark.createDataFrame([{"type_id": t} | base for t in ("same", "worse", "better", "mixed", "gone")], cols)
    a = spark.createDataFrame([{"type_id": t} | base | c for t, c in (("same", {"health": 5.00005}), ("worse", {"health": 4.0}), ("better", {"line_count": 4.0}), ("mixed", {"health": 6.0, "max_cog": 6.0}), ("new", {}))], cols)
    b = b.unionByName(b.filter("type_id = 'same'").withColumn("health", F.lit(9.0)))  # of two rows of an id the first counts
    assert snapshots.type_diff(b, a.unionByName(a)).count() == 6
    assert {r.metric for r in snapshots.type_deltas(b.withColumn("lcom", F.lit(0.5)).withColumn("cbo", F.lit(1)), a.withColumn("lcom", F.lit(0.75))).collect()} == {*snapshots.DIFFED, "lcom"}
    got = {r.type_id: r.status for r in snapshots.type_diff(b, a).collect()}
    assert got == {"same": "Unchanged", "worse": "Degraded", "better": "Improved", "mixed": "Degraded", "gone": "Removed", "new": "Added"}


def test_hotspot_falls_back_to_the_file_name(spark):
    t = spark.createDataFrame([("1", "src/A.cs", 2.0), ("2", "x/B.cs", 5.0), ("3", "x/C.cs", 1.0)], "type_id string, path string, health double")
    log = spark.createDataFrame([(" src/a.cs", 1), ("SRC/A.cs", 2), ("", 3), ("y/b.cs", 4)], "line string, at int")
    assert [(r.type_id, r.changes, r.score) for r in snapshots.hotspots(t, snapshots.change_counts(log)).collect()] == [("1", 2, 16.0), ("2", 1, 5.0)]


def test_trend_of_nothing(spark):
    empty = spark.createDataFrame([], "at long, avg_health double, smells long")
    r = snapshots.trend(empty).first()
    assert (r.snapshots, r.health_delta, r.smell_delta) == (0, 0.0, 0)


def test_rollup(spark):
    t = spark.createDataFrame([("1", "a.b", 3.0), ("2", "a.c", 8.0), ("3", "a", 6.0)], "type_id string, namespace string, health double")
    got = {r.prefix: (r.types, r.min_health, r.below_4) for r in rollup.namespace_tree(t).collect()}
    assert got == {"a": (3, 3.0, 1), "a.b": (1, 3.0, 1), "a.c": (1, 8.0, 0)}
    names_ = spark.createDataFrame([("a.b.x",), ("a.b.y",)], "name string")
    assert [r.prefix for r in rollup.common_prefix(names_).collect()] == ["a.b."]
    assert rollup.common_prefix(names_.limit(1)).count() == 0


def test_agreement(spark):
    p = spark.createDataFrame([(1, 1), (2, 3), (3, 3), (9, 5)], "a int, b int")
    r = agreement.agreement(p).first()
    assert (r.n, r.exact, r.within_1, r.mae, r.max_delta) == (4, 50.0, 75.0, 1.25, 4) and r.spearman == 0.949
    assert agreement.agreement(spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")).first().spearman == 1.0


def test_nearest_lines(spark):
    ours = spark.createDataFrame([("k", 10, 1), ("k", 12, 2), ("k", 90, 3), ("z", 1, 4)], "key string, line long, a long")
    theirs = spark.createDataFrame([("k", 11, 7), ("k", 14, 8)], "key string, line long, b long")
    assert sorted((r.key, r.line, r.b) for r in agreement.nearest_lines(ours, theirs).collect()) == [("k", 10, 7), ("k", 12, 8), ("k", 90, 0), ("z", 1, 0)]


def test_metrics_of_members_with_nulls(spark):
    t = spark.createDataFrame([("T", "T", "n", "a", "class", 10), ("E", "E", "n", "a", "enum", 3), ("U", "U", "n", "a", "struct", 1)], "type_id string, name string, namespace string, assembly string, kind string, line_count int")
    rows = [("T", "m", 1, 4, 6, 0, 2, 3, None), ("T", "n", 2, 2, None, None, 6, 3, 0.0), ("T", "f", 3, None, 4, 9, 9, 0, None), ("E", "x", 1, 1, 1, 1, 1, 1, 1.0)]
    m = spark.createDataFrame(rows, "type_id string, method string, start_line int, cog int, cyc int, nesting int, params int, lines int, volume double")
    got = {r.type_id: r for r in metrics.type_metrics(t, m).collect()}
    assert set(got) == {"T", "U"} and (got["U"].method_count, got["U"].avg_mi, got["U"].wmc, got["U"].health) == (0, None, 0, 10.0)
    r = got["T"]
    assert (r.method_count, r.avg_cog, r.avg_cyc, r.max_cyc, r.max_nesting, r.many_params, r.wmc, r.avg_mi, r.min_mi) == (2, 3.0, 3.5, 6, 0, 1, 10, 100.0, 100.0)
    assert {(r.method, r.cyc, r.nesting, r.mi) for r in metrics.method_metrics(m.filter("type_id = 'T'")).collect()} == {("m", 6, 0, None), ("n", 1, 0, 100.0)}


def test_base_depth_of_long_chains_external_bases_and_circles(spark):
    rows = [(f"c{i:04d}", f"c{i - 1:04d}" if i else None) for i in range(1500)] + [("x", "outside"), ("y", "x"), ("p", "q"), ("q", "p"), ("r", "p"), ("y", "x")]
    got = {r.id: r.depth for r in graph.base_depth(spark.createDataFrame(rows, "id string, base string")).collect()}
    assert got == {f"c{i:04d}": i for i in range(1500)} | {"x": 1, "y": 2, "p": None, "q": None, "r": None}
    assert graph.base_depth(spark.createDataFrame([], "id string, base string")).count() == 0


def test_rank_against_a_loop(spark):
    rng = random.Random(5)
    pairs = {(rng.randrange(30), rng.randrange(25)) for _ in range(70)}
    links = [(a, b) for a, b in pairs if a != b]
    r = dict.fromkeys(range(30), 1 / 30)
    for _ in range(100):
        lost = sum(r[i] for i in r if not any(a == i for a, _ in links))
        now = {i: 0.15 / 30 + 0.85 * (sum(r[a] / sum(x == a for x, _ in links) for a, b in links if b == i) + lost / 30) for i in r}
        moved, r = sum(abs(now[i] - r[i]) for i in r), now
        if moved < 1e-6:
            break
    got = graph.rank(spark.createDataFrame(list(pairs), "src long, dst long"), spark.range(30))
    assert all(abs(x["rank"] - r[x.id]) < 1e-9 for x in got.collect())


def test_agreement_of_nontrivial_pairs(spark):
    p = spark.createDataFrame([("x", 0, 0), ("x", 1, 2), ("x", 5, 4), ("x", None, 4), ("y", 0, 0)], "t string, a int, b int")
    assert {r.t: r.n for r in agreement.agreement(p, "t", nontrivial=0).collect()} == {"x": 2}


def test_nearest_lines_against_a_loop(spark):
    rng = random.Random(3)
    ours = [("k", rng.randrange(60), i) for i in range(40)]
    theirs = [("k", rng.randrange(60), i) for i in range(30)]
    free, want = sorted((x, b) for _, x, b in theirs), []
    for line, a in sorted((x, a) for _, x, a in ours):
        best = min(free, key=lambda f: (abs(f[0] - line), f), default=None)
        b = 0
        if best and abs(best[0] - line) <= 5:
            free.remove(best)
            b = best[1]
        want.append((line, a, b))
    got = agreement.nearest_lines(spark.createDataFrame(ours, "key string, line long, a long"), spark.createDataFrame(theirs, "key string, line long, b long"))
    assert sorted((r.line, r.a, r.b) for r in got.collect()) == sorted(want)


def test_edges_around_visible_namespaces(spark):
    t = spark.createDataFrame([("1", "a.b.c"), ("2", "a.b"), ("3", "a.d"), ("4", "z")], "type_id string, namespace string")
    e = edge_rows(spark, ("1", "3"), ("2", "3"), ("1", "2"), ("4", "1"))
    seen = spark.createDataFrame([("a.b",), ("a.d",)], "prefix string")
    assert [(r.from_group, r.to_group, r.n) for r in edges.visible_rollup(e, t, seen).collect()] == [("a.b", "a.d", 2)]
    assert sorted((r.from_id, r.to_id) for r in edges.incident(e, spark.createDataFrame([("2",), ("2",)], "type_id string")).collect()) == [("1", "2"), ("2", "3")]


def test_nearest_lines_takes_no_group_as_a_whole(spark):
    rows = spark.createDataFrame([("k", i, 1) for i in range(100)], "key string, line long, v long")
    got = agreement.nearest_lines(rows.withColumnRenamed("v", "a"), rows.withColumnRenamed("v", "b"))
    assert "CoGroup" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.line, r.b) for r in got.collect()) == [(i, 1) for i in range(100)]


def test_smell_diff_reads_each_side_once(spark):
    seen = [spark.sparkContext.accumulator(0) for _ in range(2)]

    def counted(n, rows):
        def count(batches):
            for b in batches:
                seen[n].add(b.num_rows)
                yield b

        schema = "type_id string, kind string, method string"
        return spark.createDataFrame(rows, schema).coalesce(1).mapInArrow(count, schema)

    got = snapshots.smell_diff(counted(0, [("t", "K", None), ("t", "L", "m"), (None, "K", "m")]), counted(1, [("t", "L", "m"), ("t", "L", "n"), ("t", "L", "n"), (None, "K", "m")]))
    assert sorted(map(tuple, got.collect())) == [("t", "K", "", "Resolved"), ("t", "L", "n", "Added")]
    assert [s.value for s in seen] == [3, 4]
