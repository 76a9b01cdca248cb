"""Registered queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identity as names
from ..functions.rounding import half_even, mean
from ..functions.scores import bucket, halstead
from ..operators import agreement, edges, graph, metrics, resolve, rollup, rules, sketch, snapshots
from .. import sinks
from ..operators import dependencies
from ..sources import code, projects
from . import fixtures as fx
from . import source_fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_MM = "WITH " + fx.SQL
_TM = f"{_MM}, type_metrics AS ({fx.type_metrics_sql('method_metrics')})"


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _types(s: SparkSession, d: str) -> DataFrame:
    return metrics.type_metrics(fx.types(s, d), fx.methods(s, d))


# Metrics

@query(f"{_MM} SELECT type_id, method, start_line, cog, cyc, nesting, params, lines, mi FROM method_metrics")
def method_metrics(s, d):
    return metrics.method_metrics(fx.methods(s, d))


@query(f"{_TM} SELECT * FROM type_metrics")
def type_metrics(s, d):
    return _types(s, d)


@query(f"{_TM} SELECT type_id, health, avg_cog, line_count FROM type_metrics ORDER BY health, type_id LIMIT 20")
def type_health_worst(s, d):
    return _types(s, d).select("type_id", "health", "avg_cog", "line_count").orderBy("health", "type_id").limit(20)


@query(f"""{_TM} SELECT assembly, round_even(sum(CAST(round_even(health * 10, 0) AS BIGINT))::DOUBLE / count(*) / 10, 2) AS avg_health, min(health) AS min_health, count(*) FILTER (health < 4) AS unhealthy,
  CAST(sum(method_count) AS BIGINT) AS methods, coalesce(round_even(sum(CAST(round_even(avg_cog * 10, 0) AS BIGINT) * method_count)::DOUBLE / nullif(sum(method_count), 0) / 10, 2), 0) AS avg_cog FROM type_metrics GROUP BY assembly""")
def assembly_health(s, d):
    return metrics.assembly_health(_types(s, d))


@query(f"""{_MM}, c AS (
  SELECT assembly, count(*) AS types, count(*) FILTER (kind = 'class') AS classs, count(*) FILTER (kind = 'interface') AS interfaces, count(*) FILTER (kind = 'struct') AS structs, count(*) FILTER (kind = 'enum') AS enums,
    count(*) FILTER (is_abstract) AS abstract_types, count(*) FILTER (is_sealed) AS sealed_types, string_agg(DISTINCT namespace, ',' ORDER BY namespace) AS namespaces,
    round_even(count(*) FILTER ((kind = 'class' AND is_abstract) OR kind = 'interface')::DOUBLE / count(*), 4) AS abstractness FROM types GROUP BY assembly),
  i AS (SELECT assembly, round_even(coalesce(sum(ce)::DOUBLE / nullif(sum(ca) + sum(ce), 0), 0), 4) AS instability FROM coupling JOIN types USING (type_id) GROUP BY assembly),
  r AS (SELECT a.assembly, count(*) AS n FROM pairs JOIN types a ON a.type_id = from_id JOIN types b ON b.type_id = to_id WHERE a.assembly = b.assembly GROUP BY 1)
  SELECT c.*, instability, round_even(abs(abstractness + instability - 1), 4) AS distance, round_even(CASE WHEN types > 1 THEN (coalesce(n, 0) + 1)::DOUBLE / types END, 4) AS cohesion FROM c LEFT JOIN i USING (assembly) LEFT JOIN r USING (assembly)""")
def assembly_metrics(s, d):
    t, e = fx.types(s, d), fx.edges(s, d)
    return metrics.assembly_metrics(t, e, edges.coupling(e, t))


@query(f"{_TM} SELECT type_id, health, CASE WHEN health >= 9 THEN 'excellent' WHEN health >= 7 THEN 'good' WHEN health >= 4 THEN 'fair' WHEN health >= 2 THEN 'poor' ELSE 'critical' END AS colour, CASE WHEN wmc <= 100 THEN 'Good' WHEN wmc <= 300 THEN 'Warning' ELSE 'Poor' END AS wmc_rating, CASE WHEN avg_mi >= 60 THEN 'Good' WHEN avg_mi >= 20 THEN 'Warning' ELSE 'Poor' END AS mi_rating FROM type_metrics")
def ratings(s, d):
    return _types(s, d).select(
        "type_id", "health", bucket(F.col("health"), [(9, "excellent"), (7, "good"), (4, "fair"), (2, "poor")], "critical").alias("colour"),
        snapshots.rating(F.col("wmc"), 100, 300).alias("wmc_rating"), snapshots.rating(F.col("avg_mi"), 60, 20, True).alias("mi_rating"),
    )


_TOKENS = """tokens AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z \\t\\r\\n]')) AS t FROM documents)"""


@query(f"""WITH {_TOKENS}, c AS (
  SELECT doc_id, count(DISTINCT t) FILTER (NOT regexp_matches(t, '^[A-Za-z]')) AS n1, count(DISTINCT t) FILTER (regexp_matches(t, '^[A-Za-z]')) AS n2,
    count(*) FILTER (NOT regexp_matches(t, '^[A-Za-z]')) AS total1, count(*) FILTER (regexp_matches(t, '^[A-Za-z]')) AS total2 FROM tokens GROUP BY doc_id)
  SELECT doc_id, n1, n2, total1, total2, round_even(CASE WHEN n1 + n2 > 0 THEN (total1 + total2) * log2((n1 + n2)::DOUBLE) ELSE 0 END, 1) AS volume,
    round_even(CASE WHEN n2 > 0 THEN n1 / 2.0::DOUBLE * total2 / n2 ELSE 0 END, 2) AS difficulty FROM c""")
def halstead_tokens(s, d):
    t = fx.read(s, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+|[^A-Za-z \\t\\r\\n]"), F.lit(0))).alias("t"))
    word = F.col("t").rlike("^[A-Za-z]")
    c = t.groupBy("doc_id").agg(F.count_distinct(F.when(~word, F.col("t"))).alias("n1"), F.count_distinct(F.when(word, F.col("t"))).alias("n2"), F.count_if(~word).alias("total1"), F.count_if(word).alias("total2"))
    h = halstead(F.col("n1"), F.col("n2"), F.col("total1"), F.col("total2"))
    return c.select("*", half_even(h["volume"], 1).alias("volume"), half_even(h["difficulty"], 2).alias("difficulty"))


# Rules

def _rule(cond, kind, critical, message, source):
    method = "method" if source == "method_metrics" else "CAST(NULL AS VARCHAR)"
    return f"SELECT type_id, {method} AS method, '{kind}' AS kind, CASE WHEN {critical} THEN 'Critical' ELSE 'Warning' END AS severity, {message} AS message FROM {source} WHERE {cond}"


_FOUND = " UNION ALL ".join([
    _rule("line_count >= 500 OR method_count >= 20", "GodClass", "line_count >= 1000", "concat_ws(', ', CASE WHEN line_count >= 500 THEN line_count || ' lines' END, CASE WHEN method_count >= 20 THEN method_count || ' methods' END)", "full_types"),
    _rule("lcom >= 0.8", "LowCohesion", "false", "'methods share few fields'", "full_types"),
    _rule("cbo >= 14", "HighCoupling", "cbo >= 25", "cbo || ' types'", "full_types"),
    _rule("dit >= 6", "DeepInheritance", "false", "'depth ' || dit", "full_types"),
    _rule("lines >= 80 OR cog >= 25", "LongMethod", "lines >= 150 OR cog >= 40", "concat_ws(', ', CASE WHEN lines >= 80 THEN lines || ' lines' END, CASE WHEN cog >= 25 THEN 'cognitive ' || cog END)", "method_metrics"),
    _rule("params > 5", "ExcessiveParameters", "false", "params || ' parameters'", "method_metrics"),
    _rule("cyc >= 15 OR (cog >= 15 AND cog < 25)", "HighComplexity", "false", "concat_ws(', ', CASE WHEN cyc >= 15 THEN 'cyclomatic ' || cyc END, CASE WHEN cog >= 15 AND cog < 25 THEN 'cognitive ' || cog END)", "method_metrics"),
    _rule("nesting >= 4", "DeepNesting", "nesting >= 6", "'depth ' || nesting", "method_metrics"),
    _rule("mi < 20", "LowMaintainability", "mi < 10", "'index ' || CAST(round_even(mi, 0) AS INTEGER)", "method_metrics"),
])
_FULL = f"{_TM}, full_types AS (SELECT m.*, (m.line_count % 11)::DOUBLE / 10 AS lcom, CAST(ca + ce AS BIGINT) AS cbo, CAST(m.line_count // 22 % 9 AS INTEGER) AS dit FROM type_metrics m JOIN coupling USING (type_id)), findings AS ({_FOUND})"


def _with_coupling(s, d, type_rows):
    return type_rows.join(edges.coupling(fx.edges(s, d), fx.types(s, d)), "type_id").withColumns({
        "lcom": (F.col("line_count") % 11).cast("double") / 10, "cbo": F.col("ca") + F.col("ce"), "dit": F.expr("CAST(line_count DIV 22 % 9 AS INT)"),
    })


def _findings(s, d):
    return rules.findings(_with_coupling(s, d, _types(s, d)), metrics.method_metrics(fx.methods(s, d)))


@query(f"{_FULL} SELECT * FROM findings")
def smells(s, d):
    return _findings(s, d)


@query(f"{_FULL} SELECT kind, severity, count(*) AS n FROM findings GROUP BY kind, severity")
def smell_counts(s, d):
    return _findings(s, d).groupBy("kind", "severity").agg(F.count("*").alias("n"))


@query(f"{_FULL} SELECT count(DISTINCT type_id) AS types, count(*) FILTER (severity = 'Critical') AS criticals, count(*) FILTER (severity = 'Warning') AS warnings, count(*) FILTER (kind = 'GodClass') AS god_classes, count(*) FILTER (kind = 'LongMethod') AS long_methods, count(*) FILTER (kind = 'HighCoupling') AS coupled, count(*) FILTER (kind = 'LowMaintainability') AS unmaintainable FROM findings")
def audit(s, d):
    n = lambda c, v: F.count_if(F.col(c) == v)
    return _findings(s, d).agg(
        F.count_distinct("type_id").alias("types"), n("severity", "Critical").alias("criticals"), n("severity", "Warning").alias("warnings"), n("kind", "GodClass").alias("god_classes"),
        n("kind", "LongMethod").alias("long_methods"), n("kind", "HighCoupling").alias("coupled"), n("kind", "LowMaintainability").alias("unmaintainable"),
    )


@query(f"{_FULL} SELECT type_id, kind, message FROM findings WHERE severity = 'Critical' AND method IS NULL")
def critical_types(s, d):
    return _findings(s, d).filter("severity = 'Critical' AND method IS NULL").select("type_id", "kind", "message")


# Edges

@query(f"{_MM} SELECT DISTINCT from_id, to_id, kind FROM edges WHERE from_id <> to_id")
def distinct_edges(s, d):
    return edges.distinct_edges(fx.edges(s, d).select("from_id", "to_id", "kind"))


@query(f"{_MM} SELECT * FROM coupling")
def coupling(s, d):
    return edges.coupling(fx.edges(s, d), fx.types(s, d))


@query(f"{_MM} SELECT to_id AS type_id, count(*) AS noc FROM (SELECT DISTINCT from_id, to_id, kind FROM edges WHERE from_id <> to_id) WHERE kind = 'Inheritance' OR kind = 'InterfaceImpl' GROUP BY 1")
def children(s, d):
    e = edges.distinct_edges(fx.edges(s, d).select("from_id", "to_id", "kind"))
    return edges.children(e.withColumn("kind", F.when(F.col("kind") == "InterfaceImpl", "Inheritance").otherwise(F.col("kind"))))


@query(f"{_MM} SELECT type_id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(1 - o) AS BIGINT) AS in_degree FROM (SELECT from_id AS type_id, 1 AS o FROM edges UNION ALL SELECT to_id, 0 FROM edges) GROUP BY 1")
def raw_degree(s, d):
    return edges.raw_degree(fx.edges(s, d))


@query(f"{_MM} SELECT least(from_id, to_id) AS a, greatest(from_id, to_id) AS b, count(*) AS n FROM edges WHERE from_id <> to_id GROUP BY 1, 2")
def edge_multiplicity(s, d):
    return edges.multiplicity(fx.edges(s, d))


_MATRIX = "matrix AS (SELECT a.assembly AS from_group, b.assembly AS to_group, count(*) AS n FROM edges JOIN types a ON a.type_id = from_id JOIN types b ON b.type_id = to_id WHERE a.assembly <> b.assembly GROUP BY 1, 2)"


@query(f"{_MM}, {_MATRIX} SELECT * FROM matrix")
def assembly_matrix(s, d):
    return edges.rolled_up(fx.edges(s, d), fx.types(s, d), "assembly")


@query(f"{_MM}, {_MATRIX} SELECT assembly, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, round_even(coalesce(ce, 0)::DOUBLE / (coalesce(ca, 0) + coalesce(ce, 0)), 4) AS instability FROM (SELECT from_group AS assembly, count(*) AS ce FROM matrix GROUP BY 1) FULL JOIN (SELECT to_group AS assembly, count(*) AS ca FROM matrix GROUP BY 1) USING (assembly) ORDER BY instability DESC, assembly")
def assembly_coupling(s, d):
    return edges.group_coupling(edges.rolled_up(fx.edges(s, d), fx.types(s, d), "assembly")).orderBy(F.desc("instability"), "assembly")


@query(f"{_MM} SELECT a.namespace AS from_group, b.namespace AS to_group, count(*) AS n FROM edges JOIN types a ON a.type_id = from_id JOIN types b ON b.type_id = to_id WHERE a.namespace <> b.namespace GROUP BY 1, 2")
def meta_edges(s, d):
    return edges.rolled_up(fx.edges(s, d), fx.types(s, d), "namespace")


@query(f"{_MM}, e AS (SELECT *, from_id || '>' || to_id || '>' || kind AS edge_id FROM edges) SELECT assembly, count(DISTINCT edge_id) AS n_edges FROM (SELECT assembly, edge_id FROM e JOIN types ON type_id = from_id UNION ALL SELECT assembly, edge_id FROM e JOIN types ON type_id = to_id) GROUP BY assembly")
def assembly_edges(s, d):
    return edges.touching(fx.edges(s, d).withColumn("edge_id", F.concat_ws(">", "from_id", "to_id", "kind")), fx.types(s, d))


@query(f"{_MM}, m AS (SELECT type_id FROM types WHERE contains(lower(name || ' ' || namespace || ' ' || assembly), 't77')) SELECT type_id FROM m UNION SELECT to_id FROM edges WHERE from_id IN (FROM m) UNION SELECT from_id FROM edges WHERE to_id IN (FROM m)")
def search_around(s, d):
    hit = fx.types(s, d).filter(F.contains(F.lower(F.concat_ws(" ", "name", "namespace", "assembly")), F.lit("t77"))).select("type_id")
    return edges.around(fx.edges(s, d), hit)


@query(f"{_MM} SELECT from_id, to_id, kind FROM edges WHERE kind IN ('Inheritance', 'InterfaceImpl', 'FieldType') AND (l_partkey = 42 OR to_key = 42)")
def neighbourhood(s, d):
    return fx.edges(s, d).filter("kind IN ('Inheritance', 'InterfaceImpl', 'FieldType') AND (l_partkey = 42 OR to_key = 42)").select("from_id", "to_id", "kind")


# Graph

@query(f"""{_MM.replace('WITH ', 'WITH RECURSIVE ', 1)}, v AS (SELECT p_partkey AS id, count(*) OVER () AS n FROM part),
  l AS (SELECT *, count(*) OVER (PARTITION BY src) AS deg FROM (SELECT DISTINCT l_partkey AS src, to_key AS dst FROM edges WHERE l_partkey <> to_key)),
  pr(i, id, rank, moved) AS (
    SELECT 0, id, 1.0::DOUBLE / n, 1.0::DOUBLE FROM v
    UNION ALL
    SELECT i, id, rank, sum(abs(rank - old)) OVER () FROM (
      SELECT x.i + 1 AS i, x.id, 0.15::DOUBLE / x.n + 0.85::DOUBLE * (coalesce(f.flow, 0) + x.lost / x.n) AS rank, x.rank AS old
      FROM (SELECT pr.i, pr.id, pr.rank, pr.moved, v.n, (SELECT coalesce(sum(rank), 0) FROM pr WHERE id NOT IN (SELECT src FROM l)) AS lost FROM pr JOIN v USING (id)) x
      LEFT JOIN (SELECT dst, sum(rank / deg) AS flow FROM l JOIN pr ON pr.id = src GROUP BY dst) f ON f.dst = x.id WHERE x.i < 100 AND x.moved >= 1e-6))
  SELECT id, round_even(rank / (SELECT sum(rank) FROM pr WHERE i = (SELECT max(i) FROM pr)), 6) AS rank FROM pr WHERE i = (SELECT max(i) FROM pr)""")
def type_rank(s, d):
    e = fx.edges(s, d).select(F.col("l_partkey").alias("src"), F.col("to_key").alias("dst"))
    r = graph.rank(e, fx.read(s, d, "part").select(F.col("p_partkey").alias("id")))
    return r.select("id", half_even(F.col("rank"), 6).alias("rank"))


@query()
def cycles(s, d):
    """Cycles over all edges. SQL would have to hold every pair that reaches each other."""
    return graph.strong_components(fx.edges(s, d).select(F.col("l_partkey").alias("src"), F.col("to_key").alias("dst")))


@query("WITH RECURSIVE c(id, depth) AS (SELECT p_partkey, CASE WHEN p_partkey = 0 THEN 0 ELSE 1 END FROM part WHERE p_partkey = 0 OR p_partkey % 10 = 9 UNION ALL SELECT p.p_partkey, depth + 1 FROM part p JOIN c ON c.id = p.p_partkey // 3 WHERE p.p_partkey > 0 AND p.p_partkey % 10 <> 9) SELECT id, depth FROM c")
def base_depth(s, d):
    return graph.base_depth(fx.read(s, d, "part").selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 10 = 9 THEN -1 WHEN p_partkey > 0 THEN p_partkey DIV 3 END AS base"))


# Roll-ups

_PREFIXED = "prefixed AS (SELECT *, 'Brand' AS prefix FROM type_metrics UNION ALL SELECT *, namespace FROM type_metrics)"


@query(f"{_TM}, {_PREFIXED} SELECT prefix, count(*) AS types, min(health) AS min_health, max(health) AS max_health, round_even(sum(CAST(round_even(health * 10, 0) AS BIGINT))::DOUBLE / count(*) / 10, 2) AS avg_health, count(*) FILTER (health < 7) AS below_7, count(*) FILTER (health < 4) AS below_4 FROM prefixed GROUP BY prefix")
def namespace_tree(s, d):
    return rollup.namespace_tree(_types(s, d))


@query(f"{_TM}, {_PREFIXED} SELECT prefix, CAST(row_number() OVER (PARTITION BY prefix ORDER BY health, type_id) AS INTEGER) AS place, type_id, health FROM prefixed QUALIFY place <= 5")
def namespace_worst(s, d):
    return rollup.worst(_types(s, d))


@query(f"{_MM} SELECT namespace, CAST(sum(n) AS BIGINT) AS types, first(assembly ORDER BY n DESC, assembly) AS assembly FROM (SELECT namespace, assembly, count(*) AS n FROM types GROUP BY 1, 2) GROUP BY namespace")
def namespace_assembly(s, d):
    return rollup.dominant_assembly(fx.types(s, d))


@query(f"""{_MM}, n AS (SELECT DISTINCT namespace || '.' || name AS x FROM types), c AS (SELECT array_to_string(string_split(x, '.')[1:i], '.') || '.' AS prefix FROM (SELECT min(x) AS x FROM n), unnest(range(1, 9)) t(i) WHERE i <= len(string_split(x, '.')))
  SELECT prefix FROM c WHERE (SELECT count(*) FROM n) >= 2 AND (SELECT bool_and(starts_with(n.x, c.prefix)) FROM n) ORDER BY length(prefix) DESC LIMIT 1""")
def common_prefix(s, d):
    return rollup.common_prefix(fx.types(s, d).select(F.concat_ws(".", "namespace", "name").alias("name")))


@query(f"{_TM} SELECT type_id, method_count, max_cog, health FROM type_metrics ORDER BY max_cog DESC, wmc DESC, line_count DESC, type_id LIMIT 20")
def panel_complex(s, d):
    return _types(s, d).orderBy(F.desc("max_cog"), F.desc("wmc"), F.desc("line_count"), "type_id").limit(20).select("type_id", "method_count", "max_cog", "health")


@query(f"{_TM} SELECT avg(x) AS mean_of_means FROM (SELECT round_even(sum(CAST(round_even(health * 10, 0) AS BIGINT))::DOUBLE / count(*) / 10, 2) AS x FROM type_metrics GROUP BY assembly)".replace("avg(x)", "round_even(avg(x), 2)"))
def project_mean(s, d):
    hundredths = F.sum(F.rint(F.col("avg_health") * 100).cast("long"))
    return metrics.assembly_health(_types(s, d)).agg((F.rint(mean(hundredths, F.count("avg_health"))) / 100).alias("mean_of_means"))


@query("SELECT CAST(floor(s_acctbal / 500) AS BIGINT) AS x, CAST(s_nationkey // 5 AS BIGINT) AS y, count(*) AS n, min(s_suppkey) AS least FROM supplier GROUP BY 1, 2")
def grid_clusters(s, d):
    return fx.read(s, d, "supplier").groupBy(F.floor(F.col("s_acctbal") / 500).alias("x"), F.floor(F.col("s_nationkey") / 5).alias("y")).agg(F.count("*").alias("n"), F.min("s_suppkey").alias("least"))


# Snapshots

def _side_sql(name, op):
    when = f"l_shipdate {op} TIMESTAMP '{fx.DAY}'"
    return f"{name} AS (FROM ({fx.type_metrics_sql(f'(SELECT * FROM method_metrics WHERE {when})', f' AND {when}')}) WHERE type_id IN (SELECT type_id FROM members WHERE {when}))"


_BEFORE = f"{_side_sql('before_', '<')}, {_side_sql('after_', '>=')}"


def _sides(s, d):
    """Types that have members before and after a day, by what they had then."""
    t = fx.types(s, d)
    found = [fx.methods(s, d, f"l_shipdate {op} TIMESTAMP'{fx.DAY}'") for op in ("<", ">=")]
    return tuple(metrics.type_metrics(t, m).join(m.select("type_id").distinct(), "type_id", "left_semi") for m in found)


def _unpivot(side, name):
    return " UNION ALL ".join(f"SELECT type_id, '{m}' AS metric, CAST({m} AS DOUBLE) AS {name} FROM {side} WHERE {m} IS NOT NULL" for m in snapshots.DIFFED)


_DELTAS = f"{_MM}, {_BEFORE}, deltas AS (SELECT type_id, metric, before, after, round_even(after - before, 4) AS delta FROM ({_unpivot('before_', 'before')}) JOIN ({_unpivot('after_', 'after')}) USING (type_id, metric))"


@query(f"{_DELTAS} SELECT * FROM deltas")
def diff_metrics(s, d):
    return snapshots.type_deltas(*_sides(s, d))


_DIFF = f"""{_DELTAS}, c AS (SELECT type_id, bool_or(CASE WHEN metric IN ('health', 'avg_mi', 'min_mi') THEN delta < 0 ELSE delta > 0 END) AS worse, CAST(count(*) AS BIGINT) AS n FROM deltas WHERE abs(delta) > 1e-4 GROUP BY 1),
  diffed AS (SELECT coalesce(b.type_id, a.type_id) AS type_id, CASE WHEN b.type_id IS NULL THEN 'Added' WHEN a.type_id IS NULL THEN 'Removed' WHEN worse THEN 'Degraded' WHEN NOT worse THEN 'Improved' ELSE 'Unchanged' END AS status, coalesce(n, 0) AS n_changed
  FROM before_ b FULL JOIN after_ a ON a.type_id = b.type_id LEFT JOIN c ON c.type_id = a.type_id AND c.type_id = b.type_id)"""


def _diff(s, d):
    b, a = _sides(s, d)
    return snapshots.type_diff(b, a).withColumn("n_changed", F.col("n_changed").cast("long"))


@query(f"{_DIFF} SELECT * FROM diffed")
def diff_types(s, d):
    return _diff(s, d)


@query(f"{_DIFF} SELECT status, count(*) AS n FROM diffed GROUP BY status")
def diff_summary(s, d):
    return _diff(s, d).groupBy("status").agg(F.count("*").alias("n"))


_ONE = "SELECT type_id, method, params, cog, cyc FROM method_metrics WHERE l_shipdate {} TIMESTAMP '" + fx.DAY + "' QUALIFY row_number() OVER (PARTITION BY type_id, method, params ORDER BY start_line, cog, cyc, lines) = 1"


@query(f"{_MM} SELECT type_id, method, params, a.cog - b.cog AS d_cog, a.cyc - b.cyc AS d_cyc FROM ({_ONE.format('<')}) b JOIN ({_ONE.format('>=')}) a USING (type_id, method, params)")
def diff_methods(s, d):
    return snapshots.method_diff(*(metrics.method_metrics(fx.methods(s, d, f"l_shipdate {op} TIMESTAMP'{fx.DAY}'")) for op in ("<", ">=")))


def _smelly(side, op):
    types = f"(SELECT m.*, (m.line_count % 11)::DOUBLE / 10 AS lcom, CAST(ca + ce AS BIGINT) AS cbo, CAST(m.line_count // 22 % 9 AS INTEGER) AS dit FROM {side} m JOIN coupling USING (type_id))"
    methods = f"(SELECT * FROM method_metrics WHERE l_shipdate {op} TIMESTAMP '{fx.DAY}')"
    return f"SELECT DISTINCT type_id, kind, coalesce(method, '') AS method FROM ({_FOUND.replace('FROM full_types', 'FROM ' + types).replace('FROM method_metrics', 'FROM ' + methods)})"


@query(f"{_MM}, {_BEFORE}, b AS ({_smelly('before_', '<')}), a AS ({_smelly('after_', '>=')}) SELECT *, 'Added' AS change FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'Resolved' FROM (FROM b EXCEPT FROM a)")
def diff_smells(s, d):
    found = [rules.findings(_with_coupling(s, d, t), metrics.method_metrics(fx.methods(s, d, f"l_shipdate {op} TIMESTAMP'{fx.DAY}'"))) for t, op in zip(_sides(s, d), ("<", ">="), strict=True)]
    return snapshots.smell_diff(*found)


_LOG = "log AS (SELECT CASE WHEN event_id % 2 = 0 THEN ' src/file_' || user_id || '.cs' ELSE 'SRC/File_' || user_id || '.cs ' END AS line, event_id AS seq FROM events), counts AS (SELECT lower(trim(line)) AS path_key, first(trim(line) ORDER BY seq) AS path, count(*) AS changes FROM log GROUP BY 1)"


def _log(s, d):
    return snapshots.change_counts(fx.read(s, d, "events").selectExpr("CASE WHEN event_id % 2 = 0 THEN concat(' src/file_', user_id, '.cs') ELSE concat('SRC/File_', user_id, '.cs ') END AS line", "event_id AS at"))


@query(f"WITH {_LOG} SELECT path_key, path, changes FROM counts ORDER BY changes DESC, path_key")
def change_frequency(s, d):
    return _log(s, d).orderBy(F.desc("changes"), "path_key")


@query(f"{_TM}, {_LOG} SELECT type_id, changes, health, round_even(changes * (10 - health), 1) AS score FROM type_metrics JOIN types USING (type_id) JOIN counts ON counts.path_key = lower(types.path) ORDER BY score DESC, type_id LIMIT 20")
def hotspots(s, d):
    return snapshots.hotspots(_types(s, d).join(fx.types(s, d).select("type_id", "path"), "type_id"), _log(s, d))


_YEARLY = fx.type_metrics_sql("y_methods").replace("FROM types t", "FROM y_types t").replace("FROM members w", "FROM y_members w")
_YEARS = f"""{_MM}, y_members AS (SELECT year(l_shipdate) || '|' || type_id AS type_id, * EXCLUDE (type_id) FROM members), y_methods AS (SELECT year(l_shipdate) || '|' || type_id AS type_id, * EXCLUDE (type_id) FROM method_metrics),
  y_types AS (SELECT DISTINCT m.type_id, name, namespace, assembly, kind, line_count FROM y_members m JOIN types t ON t.type_id = split_part(m.type_id, '|', 2)),
  y_smells AS (SELECT type_id, count(*) FILTER (lines >= 80 OR cog >= 25) + count(*) FILTER (params > 5) + count(*) FILTER (cyc >= 15 OR (cog >= 15 AND cog < 25)) + count(*) FILTER (nesting >= 4) + count(*) FILTER (mi < 20) AS smells FROM y_methods GROUP BY 1),
  scored AS (SELECT CAST(split_part(type_id, '|', 1) AS BIGINT) AS "at", health, avg_cog, coalesce(smells, 0) AS smells FROM ({_YEARLY}) LEFT JOIN y_smells USING (type_id)),
  snaps AS (SELECT "at", count(*) AS types, round_even(sum(CAST(round_even(health * 10, 0) AS BIGINT))::DOUBLE / count(*) / 10, 2) AS avg_health, min(health) AS min_health, CAST(sum(smells) AS BIGINT) AS smells, count(*) FILTER (health < 4) AS unhealthy, round_even(sum(CAST(round_even(avg_cog * 10, 0) AS BIGINT))::DOUBLE / count(*) / 10, 2) AS avg_cog FROM scored GROUP BY "at")"""


def _yearly(s, d):
    """A snapshot for each year: the types that have members of it, by what these are."""
    m = fx.methods(s, d).withColumns({"plain": F.col("type_id"), "type_id": F.concat_ws("|", F.year("l_shipdate"), "type_id")})
    t = fx.types(s, d).withColumnRenamed("type_id", "plain").join(m.select("plain", "type_id").distinct(), "plain")
    smells = rules.method_findings(metrics.method_metrics(m)).groupBy("type_id").agg(F.count("*").alias("smells"))
    rows = metrics.type_metrics(t, m).join(smells, "type_id", "left")
    return snapshots.snapshot_summary(rows.select(F.substring_index("type_id", "|", 1).cast("long").alias("at"), "health", "avg_cog", F.coalesce("smells", F.lit(0)).alias("smells")))


@query(f"{_YEARS} SELECT * FROM snaps ORDER BY \"at\"")
def trend_snapshots(s, d):
    return _yearly(s, d).orderBy("at")


@query(f"{_YEARS} SELECT count(*) AS snapshots, round_even(max_by(avg_health, \"at\") - min_by(avg_health, \"at\"), 1) AS health_delta, max_by(smells, \"at\") - min_by(smells, \"at\") AS smell_delta FROM snaps")
def trend_summary(s, d):
    return snapshots.trend(_yearly(s, d))


@query(f"{_YEARS} SELECT \"at\", avg_health, round_even(avg_health - lag(avg_health) OVER (ORDER BY \"at\"), 2) AS step FROM snaps")
def trend_steps(s, d):
    return snapshots.steps(_yearly(s, d))


@query(f"{_FULL}, f AS (SELECT count(*) FILTER (severity = 'Warning') AS warnings, count(*) FILTER (severity = 'Critical') AS criticals FROM findings) SELECT round_even(sum(CAST(round_even(health * 10, 0) AS BIGINT))::DOUBLE / count(*) / 10, 1) AS avg_health, min(health) AS min_health, round_even(sum(CAST(round_even(coalesce(avg_mi, 0) * 10, 0) AS BIGINT))::DOUBLE / count(*) / 10, 1) AS avg_mi, max(warnings) AS warnings, max(criticals) AS criticals FROM type_metrics, f")
def status_summary(s, d):
    t = _types(s, d).agg(*[half_even(F.sum(F.rint(F.coalesce(c, F.lit(0.0)) * 10).cast("long")).cast("double") / F.count("*") / 10.0, 1).alias(f"avg_{n}") for c, n in (("health", "health"), ("avg_mi", "mi"))], F.min("health").alias("min_health"))
    f = _findings(s, d).agg(F.count_if(F.col("severity") == "Warning").alias("warnings"), F.count_if(F.col("severity") == "Critical").alias("criticals"))
    return t.crossJoin(f).select("avg_health", "min_health", "avg_mi", "warnings", "criticals")


# Sketches

def _bloom(c, m):
    return f"list_reduce(list_prepend(0, list_transform(list_filter(string_split({c}, ''), lambda c: c <> ''), lambda c: ord(c))), lambda h, c: (h * {m} + c) % 128)"


_BITS = "list_sort(list_distinct([{}]))".format(", ".join(f"CAST({_bloom('x', m)} AS INTEGER)" for m in sketch.MULTIPLIERS))


@query(f"SELECT p_partkey, array_to_string({_BITS.replace(chr(120) + ',', 'p_name,')}, ',') AS bits FROM part")
def bloom_bits(s, d):
    return fx.read(s, d, "part").select("p_partkey", F.array_join(sketch.bits(F.col("p_name")).cast("array<string>"), ",").alias("bits"))


@query(f"WITH b AS (SELECT p_brand, p_type, {_BITS.replace(chr(120) + ',', 'p_name,')} AS bits FROM part), g AS (SELECT p_brand, p_type, list_sort(list_distinct(flatten(list(bits)))) AS f FROM b GROUP BY p_brand, p_type) SELECT a.p_type, a.p_brand AS a, z.p_brand AS b, CAST(len(a.f) AS INTEGER) AS a_bits, round_even(len(list_intersect(a.f, z.f))::DOUBLE / greatest(len(a.f), len(z.f)), 6) AS similarity FROM g a JOIN g z ON a.p_type = z.p_type AND a.p_brand < z.p_brand")
def bloom_similarity(s, d):
    g = fx.read(s, d, "part").groupBy("p_brand", "p_type").agg(sketch.union(sketch.bits(F.col("p_name"))).alias("f"))
    b = g.select("p_type", F.col("p_brand").alias("b"), F.col("f").alias("g"))
    return g.join(b, "p_type").filter(F.col("p_brand") < F.col("b")).select("p_type", F.col("p_brand").alias("a"), "b", F.size("f").alias("a_bits"), half_even(sketch.similarity(F.col("f"), F.col("g")), 6).alias("similarity"))


@query("SELECT event_id, array_to_string(list_sort(list_distinct([CAST((user_id * m + 2654435769) % 128 AS INTEGER) FOR m IN [31, 37, 41]])), ',') AS bits FROM events")
def bloom_numbers(s, d):
    return fx.read(s, d, "events").select("event_id", F.array_join(sketch.number_bits(F.col("user_id")).cast("array<string>"), ",").alias("bits"))


# Agreement

_PAIRS = "pairs AS (SELECT l_returnflag AS tool, l_linenumber AS a, CAST(round_even(l_tax * 100, 0) AS INTEGER) AS b FROM lineitem)"


@query(f"""WITH {_PAIRS}, r AS (SELECT *, rank() OVER (PARTITION BY tool ORDER BY a) + (count(*) OVER (PARTITION BY tool, a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY tool ORDER BY b) + (count(*) OVER (PARTITION BY tool, b) - 1) / 2.0::DOUBLE AS rb FROM pairs)
  SELECT tool, count(*) AS n, round_even(count(*) FILTER (a = b)::DOUBLE / count(*) * 100, 1) AS exact, round_even(count(*) FILTER (abs(a - b) <= 1)::DOUBLE / count(*) * 100, 1) AS within_1, round_even(sum(abs(a - b))::DOUBLE / count(*), 2) AS mae, max(abs(a - b)) AS max_delta,
  round_even(corr(a, b), 3) AS pearson, round_even(corr(ra, rb), 3) AS spearman FROM r GROUP BY tool""")
def agreement_stats(s, d):
    p = fx.read(s, d, "lineitem").select(F.col("l_returnflag").alias("tool"), F.col("l_linenumber").alias("a"), F.rint(F.col("l_tax") * 100).cast("int").alias("b"))
    return agreement.agreement(p, "tool")


@query("WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus <> 'F') SELECT (SELECT count(*) FROM a JOIN b USING (k)) AS matched, (SELECT count(*) FROM a ANTI JOIN b USING (k)) AS only_ours, (SELECT count(*) FROM b ANTI JOIN a USING (k)) AS only_theirs")
def cross_tool_match(s, d):
    o = fx.read(s, d, "orders")
    a, b = (o.filter(F.col("o_orderstatus") == "F" if x else F.col("o_orderstatus") != "F").select("o_custkey").distinct() for x in (True, False))
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "o_custkey", "full")
    return both.agg(F.count_if(F.expr("a = 1 AND b = 1")).alias("matched"), F.count_if(F.col("b").isNull()).alias("only_ours"), F.count_if(F.col("a").isNull()).alias("only_theirs"))


@query("SELECT l_orderkey, l_partkey, l_linenumber - CAST(round_even(l_tax * 100, 0) AS INTEGER) AS delta FROM lineitem ORDER BY abs(delta) DESC, l_orderkey, l_partkey, delta LIMIT 20")
def top_divergences(s, d):
    p = fx.read(s, d, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_linenumber") - F.rint(F.col("l_tax") * 100).cast("int")).alias("delta"))
    return p.orderBy(F.desc(F.abs("delta")), "l_orderkey", "l_partkey", "delta").limit(20)


@query()
def nearest_line_match(s, d):
    li = fx.read(s, d, "lineitem").select(F.concat(F.lit("T"), F.col("l_partkey")).alias("key"), F.col("l_orderkey").alias("line"), F.col("l_linenumber").cast("long").alias("v"), "l_returnflag")
    return agreement.nearest_lines(li.filter("l_returnflag = 'A'").select("key", "line", F.col("v").alias("a")), li.filter("l_returnflag <> 'A'").select("key", "line", F.col("v").alias("b")))


# Identity

_REF = "'global::' || p_type || '<' || p_brand || ',List<' || p_name || '>>[]'"


@query(f"""SELECT p_partkey, p_type AS plain, p_type || '::' || p_brand AS type_id, split_part(url_, '.', -1) AS label, regexp_replace(replace('C:\\src\\' || p_name || '\\', '\\', '/'), '/+$', '') AS path,
  replace(replace('<' || p_name || '>&', '&', '&amp;'), '<', '&lt;').replace('>', '&gt;') AS safe, len(string_split(regexp_replace(CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'B<C,D>' ELSE 'B<C,D>,E' END, '<[^<>]*>', '', 'g'), ',')) - CAST(p_partkey % 3 = 0 AS INTEGER) AS arity, md5(p_name) AS cache_key FROM (SELECT *, 'Brand.' || substr(p_brand, 7) || '.T' || p_partkey AS url_ FROM part)""")
def identity_strings(s, d):
    p = fx.read(s, d, "part")
    generic = F.expr("CASE p_partkey % 3 WHEN 0 THEN ' A?' WHEN 1 THEN 'global::A<B<C,D>>' ELSE 'A<B<C,D>,E>[]' END")
    return p.select(
        "p_partkey", names.without_generics(F.concat(F.lit(" global::"), "p_type", F.lit("<"), "p_brand", F.lit(">? "))).alias("plain"), names.type_id(F.col("p_type"), F.col("p_brand")).alias("type_id"),
        names.label(F.expr("concat('Brand.', substr(p_brand, 7), '.T', p_partkey)")).alias("label"), names.normalized_path(F.concat(F.lit("C:\\src\\"), "p_name", F.lit("\\"))).alias("path"),
        names.html_escaped(F.concat(F.lit("<"), "p_name", F.lit(">&"))).alias("safe"), names.generic_arity(generic).alias("arity"), F.md5("p_name").alias("cache_key"),
    )


_REFS = """refs AS (SELECT DISTINCT l_partkey, to_key FROM edges), r AS (
  SELECT l_partkey || '>' || to_key AS ref_id, a.namespace, CASE l_partkey % 4 WHEN 0 THEN b.namespace || '.' || b.name WHEN 1 THEN 'global::' || b.name || '[]' WHEN 2 THEN 'N' || to_key % 7 ELSE b.name || '<X>' END AS name
  FROM refs JOIN types a ON a.p_partkey = l_partkey JOIN types b ON b.p_partkey = to_key),
  known AS (SELECT type_id, namespace || '.' || name AS qualified, name AS simple FROM types UNION ALL SELECT type_id || '+N', namespace || '.N' || p_partkey % 7, 'N' || p_partkey % 7 FROM types),
  uq AS (SELECT qualified AS key, min(type_id) AS type_id FROM known GROUP BY 1 HAVING count(*) = 1), us AS (SELECT simple AS key, min(type_id) AS type_id FROM known GROUP BY 1 HAVING count(*) = 1),
  plain AS (SELECT *, regexp_replace(regexp_replace(name, '^global::', ''), '\\[\\]$', '') AS x FROM r)"""


@query(f"{_MM}, {_REFS} SELECT ref_id, coalesce(q.type_id, n.type_id, u.type_id) AS type_id FROM plain LEFT JOIN uq q ON q.key = x LEFT JOIN uq n ON n.key = namespace || '.' || x LEFT JOIN us u ON u.key = split_part(x, '<', 1) WHERE coalesce(q.type_id, n.type_id, u.type_id) IS NOT NULL")
def reference_resolution(s, d):
    """Names that are qualified, simple, with arguments, and ambiguous (N0 to N6, of which only some are alone in their namespace)."""
    t = fx.types(s, d)
    nested = t.select(F.concat("type_id", F.lit("+N")).alias("type_id"), F.expr("concat(namespace, '.N', p_partkey % 7)").alias("qualified"), F.expr("concat('N', p_partkey % 7)").alias("simple"))
    known = t.select("type_id", F.concat_ws(".", "namespace", "name").alias("qualified"), F.col("name").alias("simple")).unionByName(nested)
    e = fx.edges(s, d).select("l_partkey", "to_key").distinct()
    a = t.select(F.col("p_partkey").alias("l_partkey"), "namespace", F.concat_ws(".", "namespace", "name").alias("qualified"))
    b = t.select(F.col("p_partkey").alias("to_key"), F.concat_ws(".", "namespace", "name").alias("full"), F.col("name").alias("plain"))
    name = F.expr("CASE l_partkey % 4 WHEN 0 THEN full WHEN 1 THEN concat('global::', plain, '[]') WHEN 2 THEN concat('N', to_key % 7) ELSE concat(plain, '<X>') END")
    refs = e.join(a, "l_partkey").join(b, "to_key").select(F.concat_ws(">", "l_partkey", "to_key").alias("ref_id"), name.alias("name"), "namespace", "qualified")
    return resolve.resolve(refs, known)


@query("SELECT p_type || '::' || p_brand AS type_id, count(*) AS parts, CAST(sum(p_size) AS BIGINT) AS line_count, first(p_name ORDER BY p_partkey) AS base, array_to_string(list(p_partkey ORDER BY p_partkey), ',') AS members FROM part GROUP BY 1")
def partial_types(s, d):
    parts = fx.read(s, d, "part").select(F.concat_ws("::", "p_type", "p_brand").alias("type_id"), F.format_string("f%09d", "p_partkey").alias("file"), F.lit(1).alias("line"), F.col("p_size").alias("line_count"), F.col("p_name").alias("base"), F.array("p_name").alias("interfaces"), F.array(F.col("p_partkey").cast("string")).alias("members"))
    return resolve.merge_partials(parts).select("type_id", "parts", "line_count", "base", F.array_join("members", ",").alias("members"))


@query("SELECT name, count(*) AS n FROM (SELECT 'Game.' || p_type AS name FROM part) WHERE lower(name) LIKE '%.' || (SELECT lower(min(p_type)) FROM part) OR starts_with(lower(name), 'game.eco') GROUP BY name")
def assembly_filter(s, d):
    assemblies = fx.read(s, d, "part").select(F.concat(F.lit("Game."), "p_type").alias("name"))
    least = fx.read(s, d, "part").agg(F.min("p_type")).first()[0]
    return projects.by_name(assemblies, least.upper()).unionByName(projects.by_prefix(assemblies, "GAME.Eco").filter(F.lower("name") != f"game.{least.lower()}")).groupBy("name").agg(F.count("*").alias("n"))


# Source code

_SRC = "WITH " + source_fixture.SQL


def _parsed(s, d):
    return code.parse_files(source_fixture.files(s, d))


@query(f"""{_SRC} SELECT type_id, method, cog, cyc, nesting, params, lines, start_line, n1, n2, total1, total2, round_even((total1 + total2) * log2((n1 + n2)::DOUBLE), 4) AS volume,
  round_even(CASE WHEN n2 > 0 THEN n1 / 2.0::DOUBLE * total2 / n2 ELSE 0 END, 4) AS difficulty FROM src_methods""")
def source_methods(s, d):
    m = code.members_of(_parsed(s, d)).filter("member_kind = 'Method'")
    return m.select("type_id", "method", "cog", "cyc", "nesting", "params", "lines", "start_line", "n1", "n2", "total1", "total2", half_even(F.col("volume"), 4).alias("volume"), half_even(F.col("difficulty"), 4).alias("difficulty"))


_SRC_TYPES = f"""{_SRC}, m AS (SELECT p, count(*) AS n, sum(lines) AS lines, max(a) AS a, sum(s) AS used FROM src_methods GROUP BY p)
  SELECT type_id, 'class' AS kind, namespace, CASE WHEN p > 0 THEN 'T' || p // 3 END AS base, false AS is_nested, CAST(4 + CASE WHEN inner_ THEN 2 ELSE 0 END + coalesce(lines, 0) AS INTEGER) AS line_count, 2 AS start_line,
    CASE WHEN n > 1 THEN round_even(greatest(0.0::DOUBLE, (used::DOUBLE / 3 - n) / (1.0::DOUBLE - n)), 2) END AS lcom,
    len(list_distinct(list_filter([CASE WHEN p > 0 THEN 'T' || p // 3 END, 'T' || following, CASE WHEN a > 0 THEN 'Func' END], lambda x: x IS NOT NULL AND x <> name))) AS cbo,
    coalesce(n, 0) AS rfc, CAST(p > 0 AS INTEGER) AS dit FROM src_parts LEFT JOIN m USING (p)
  UNION ALL SELECT type_id || '+Inner', 'class', namespace, NULL, true, 1, 5, NULL, 1, 0, 0 FROM src_parts WHERE inner_ UNION ALL SELECT type_id || '+Other', 'class', namespace, NULL, true, 1, 6, NULL, 0, 0, 0 FROM src_parts WHERE inner_"""


@query(_SRC_TYPES)
def source_types(s, d):
    return _parsed(s, d).select("type_id", "kind", "namespace", "base", "is_nested", "line_count", "start_line", "lcom", "cbo", "rfc", "dit")


@query(f"""{_SRC} SELECT a.type_id AS from_id, b.type_id AS to_id, 'Inheritance' AS kind FROM src_parts a JOIN src_parts b ON a.p > 0 AND b.p = a.p // 3
  UNION ALL SELECT a.type_id, b.type_id, 'FieldType' FROM src_parts a JOIN src_parts b ON b.p = a.following AND b.p <> a.p UNION ALL SELECT type_id || '+Inner', type_id || '+Other', 'FieldType' FROM src_parts WHERE inner_""")
def source_edges(s, d):
    return dependencies.build(_parsed(s, d)).select("from_id", "to_id", "kind")


@query(f"""{_SRC} SELECT type_id, method, 'CatchAllException' AS kind, 'Warning' AS severity FROM src_methods WHERE r = 1 UNION ALL SELECT type_id, method, 'ClosureCapture', 'Warning' FROM src_methods WHERE a = 1""")
def source_findings(s, d):
    return rules.occurrence_findings(code.occurrences_of(_parsed(s, d))).select("type_id", "method", "kind", "severity")


@query("SELECT 'I' || p_partkey AS service, 'T' || p_partkey AS implementation, 'Zenject' AS container, CASE p_partkey % 3 WHEN 0 THEN 'Singleton' WHEN 1 THEN 'Transient' ELSE 'Scoped' END AS lifetime, 1 AS line FROM part UNION ALL SELECT 'T' || p_partkey, 'T' || p_partkey, 'VContainer', 'Scoped', 1 FROM part")
def source_registrations(s, d):
    text = F.expr("concat('class C { void Install() { c.Bind<I', p_partkey, '>().To<T', p_partkey, '>().', CASE p_partkey % 3 WHEN 0 THEN 'AsSingle' WHEN 1 THEN 'AsTransient' ELSE 'AsCached' END, '(); b.Register<T', p_partkey, '>(Lifetime.Scoped); } }')")
    files = fx.read(s, d, "part").select(F.concat(F.lit("C"), "p_partkey").alias("path"), text.alias("text")).repartition(s.sparkContext.defaultParallelism, "path")  # parsing takes long for so few bytes
    return code.registrations(files).select("service", "implementation", "container", "lifetime", "line")


@query(f"{_FULL}, r AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {chr(39)}{sinks.rule_id(i)}{chr(39)})' for i, (k, _) in enumerate(sinks.RULES))}) t(kind, rule)) SELECT rule, CASE WHEN severity = 'Critical' THEN 'error' ELSE 'warning' END AS level, t.name || coalesce('.' || f.method, '') || ': ' || message AS text, CASE WHEN f.method IS NULL THEN 1 ELSE (SELECT min(start_line) FROM method_metrics m WHERE m.type_id = f.type_id AND m.method = f.method) END AS line, t.path AS uri FROM findings f JOIN r USING (kind) JOIN types t USING (type_id) WHERE t.type_id IN (SELECT type_id FROM type_metrics)")
def sarif(s, d):
    t = _types(s, d).join(fx.types(s, d).select("type_id", "path"), "type_id").withColumns({"start_line": F.lit(1), "lcom": (F.col("line_count") % 11).cast("double") / 10})
    out = sinks.sarif_results(_findings(s, d), t, metrics.method_metrics(fx.methods(s, d)), "")
    got = lambda p: F.get_json_object("json", p)
    return out.select(
        got("$.ruleId").alias("rule"), got("$.level").alias("level"), got("$.message.text").alias("text"), got("$.locations[0].physicalLocation.region.startLine").cast("int").alias("line"),
        got("$.locations[0].physicalLocation.artifactLocation.uri").alias("uri"),
    )


@query("""WITH e AS (SELECT 'N' || n_nationkey AS name, 'N' || (n_nationkey // 5 * 5 + (n_nationkey + 1) % 5) AS other FROM nation)
  SELECT name, CASE WHEN CAST(substr(name, 2) AS INTEGER) % 2 = 0 THEN other ELSE other || ',X' END AS references, CASE WHEN CAST(substr(name, 2) AS INTEGER) % 3 = 0 THEN 'GUID:none' ELSE '' END AS unresolved FROM e""")
def assembly_definitions(s, d):
    return _definitions(s, d).select("name", F.array_join("references", ",").alias("references"), F.array_join("unresolved", ",").alias("unresolved"))


def _definitions(s, d):
    n = fx.read(s, d, "nation").withColumn("other", F.expr("n_nationkey div 5 * 5 + (n_nationkey + 1) % 5"))
    path = F.concat(F.lit("/a/N"), "n_nationkey", F.lit("/N.asmdef"))
    refs = F.expr("array_compact(array(concat('GUID:G', other), if(n_nationkey % 2 = 1, 'X', null), if(n_nationkey % 3 = 0, 'GUID:none', null)))")
    files = n.select(path.alias("path"), F.to_json(F.struct(F.concat(F.lit("N"), "n_nationkey").alias("name"), refs.alias("references"))).alias("text"))
    metas = n.select(F.concat(path, F.lit(".meta")).alias("path"), F.concat(F.lit("version: 2\nGuid: g"), "n_nationkey", F.lit("\n")).alias("text"))
    return projects.assembly_definitions(files, metas)


@query("SELECT 'Assembly' AS level, 'N' || CASE WHEN n_nationkey // 5 * 5 = 5 THEN '5' ELSE CAST(n_nationkey // 5 * 5 AS VARCHAR) END AS component, CAST(count(*) OVER (PARTITION BY n_nationkey // 5) AS BIGINT) AS size, 'N' || n_nationkey AS member FROM nation")
def assembly_cycles(s, d):
    return dependencies.all_cycles(fx.edges(s, d).limit(0).select(F.col("from_id").alias("from_type"), F.col("to_id").alias("to_type")), _definitions(s, d))


@query(f"{_TM} SELECT type_id, health, max_cog FROM type_metrics ORDER BY health NULLS LAST, max_cog DESC, type_id LIMIT 10")
def panel_types(s, d):
    return rollup.panel(_types(s, d), "health", 10).select("type_id", "health", "max_cog")


@query(f"{_MM} SELECT type_id, method, cog, cyc, lines, start_line FROM method_metrics ORDER BY cog DESC, cyc DESC, lines DESC, type_id, method, start_line LIMIT 20")
def panel_methods(s, d):
    return rollup.method_panel(metrics.method_metrics(fx.methods(s, d)), "cog", 20).select("type_id", "method", "cog", "cyc", "lines", "start_line")


@query(f"{_MM} SELECT DISTINCT from_id, to_id, kind FROM edges WHERE contains(lower(from_id), 't77') OR contains(lower(to_id), 't77') OR contains(lower(kind), 't77')")
def search_edges(s, d):
    return edges.matching(fx.edges(s, d).select("from_id", "to_id", "kind"), "T77").distinct()
