"""The canonical relations, bound to the driver's tables by integer derivations that Spark and SQL make alike.

types (part), methods (lineitem by part), edges (neighbouring parts of an order), bases (a tree over parts),
change log (events by user), snapshots (line items before and after a day, or by year).
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = ("Inheritance", "InterfaceImpl", "FieldType", "PropertyType", "ConstructorParam", "MethodParam", "ReturnType", "EventType", "GenericConstraint", "DIRegistration")
DAY = "1998-07-01"
_ID = "concat(p_type, '::Brand.', substr(p_brand, 7), '.T', p_partkey)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr(
        f"{_ID} AS type_id", "p_partkey", "concat('T', p_partkey) AS name", "concat('Brand.', substr(p_brand, 7)) AS namespace", "p_type AS assembly",
        "CASE p_partkey % 10 WHEN 0 THEN 'interface' WHEN 1 THEN 'enum' WHEN 2 THEN 'struct' WHEN 3 THEN 'record' WHEN 4 THEN 'delegate' ELSE 'class' END AS kind",
        "p_size % 2 = 0 AS is_public", "p_size % 5 = 0 AS is_sealed", "p_size % 7 = 0 AS is_abstract", "p_size * 22 AS line_count",
        "concat('src/File_', p_partkey % 150, '.cs') AS path",
    )


def line_methods(lines: DataFrame) -> DataFrame:
    q = "CAST(l_quantity AS INT)"
    return lines.selectExpr(
        "l_partkey", "concat('m', l_linenumber) AS method", "CAST(l_orderkey AS INT) AS start_line", f"CASE WHEN l_orderkey % 11 <> 0 THEN ({q} * {q}) DIV 60 END AS cog",
        "CASE WHEN l_orderkey % 13 <> 0 THEN CAST(l_orderkey % 20 + 1 AS INT) END AS cyc", "CASE WHEN l_orderkey % 17 <> 0 THEN l_linenumber END AS nesting",
        "CAST(rint(l_discount * 100) AS INT) AS params", "CAST(floor(l_extendedprice / 400) AS INT) AS lines", "CASE WHEN l_orderkey % 19 <> 0 THEN l_extendedprice END AS volume", "l_shipdate",
    ).withColumn("cog", F.col("cog").cast("int"))


def methods(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    ids = types(spark, sf_dir).select("type_id", "p_partkey")
    return line_methods(read(spark, sf_dir, "lineitem").filter(where)).join(ids, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey", "l_partkey")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part to the next part of the order, and the kind by line number."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    kinds = F.array(*[F.lit(k) for k in KINDS])
    pairs = read(spark, sf_dir, "lineitem").select("l_partkey", F.lead("l_partkey").over(w).alias("to_key"), F.element_at(kinds, F.col("l_linenumber") % 10 + 1).alias("kind")).filter("to_key IS NOT NULL")
    ids = types(spark, sf_dir).select("p_partkey", "type_id")
    return (
        pairs.join(ids.select(F.col("p_partkey").alias("l_partkey"), F.col("type_id").alias("from_id")), "l_partkey")
        .join(ids.select(F.col("p_partkey").alias("to_key"), F.col("type_id").alias("to_id")), "to_key")
        .select("from_id", "to_id", "kind", "l_partkey", "to_key")
    )


_KINDS_SQL = ", ".join(f"'{k}'" for k in KINDS)
SQL = f"""
types AS (
  SELECT p_type || '::Brand.' || substr(p_brand, 7) || '.T' || p_partkey AS type_id, p_partkey, 'T' || p_partkey AS name, 'Brand.' || substr(p_brand, 7) AS namespace, p_type AS assembly,
    CASE p_partkey % 10 WHEN 0 THEN 'interface' WHEN 1 THEN 'enum' WHEN 2 THEN 'struct' WHEN 3 THEN 'record' WHEN 4 THEN 'delegate' ELSE 'class' END AS kind,
    p_size % 2 = 0 AS is_public, p_size % 5 = 0 AS is_sealed, p_size % 7 = 0 AS is_abstract, p_size * 22 AS line_count, 'src/File_' || p_partkey % 150 || '.cs' AS path FROM part),
lines_ AS (
  SELECT l_partkey, 'm' || l_linenumber AS method, CAST(l_orderkey AS INTEGER) AS start_line, CASE WHEN l_orderkey % 11 <> 0 THEN CAST((CAST(floor(l_quantity) AS INTEGER) * CAST(floor(l_quantity) AS INTEGER)) // 60 AS INTEGER) END AS cog,
    CASE WHEN l_orderkey % 13 <> 0 THEN CAST(l_orderkey % 20 + 1 AS INTEGER) END AS cyc, CASE WHEN l_orderkey % 17 <> 0 THEN l_linenumber END AS nesting, CAST(round_even(l_discount * 100, 0) AS INTEGER) AS params, CAST(floor(l_extendedprice / 400) AS INTEGER) AS lines,
    CASE WHEN l_orderkey % 19 <> 0 THEN l_extendedprice END AS volume, l_shipdate FROM lineitem),
methods AS (SELECT type_id, m.* EXCLUDE (l_partkey) FROM lines_ m JOIN types ON l_partkey = p_partkey),
members AS (SELECT * FROM methods),
method_metrics AS (
  SELECT * REPLACE (coalesce(cyc, 1) AS cyc, coalesce(nesting, 0) AS nesting), round_even(CASE WHEN volume IS NULL THEN NULL WHEN volume <= 0 THEN 100.0 ELSE greatest(0.0, (171.0::DOUBLE - 5.2::DOUBLE * ln(volume) - 0.23::DOUBLE * coalesce(cyc, 1) - 16.2::DOUBLE * ln(greatest(lines, 1)::DOUBLE)) * 100 / 171) END, 1) AS mi FROM methods WHERE cog IS NOT NULL),
edges AS (
  SELECT a.type_id AS from_id, b.type_id AS to_id, [{_KINDS_SQL}][l_linenumber % 10 + 1] AS kind, l_partkey, to_key
  FROM (SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS to_key FROM lineitem) l
  JOIN types a ON a.p_partkey = l_partkey JOIN types b ON b.p_partkey = to_key),
pairs AS (SELECT DISTINCT from_id, to_id FROM edges WHERE from_id <> to_id),
coupling AS (
  SELECT type_id, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, round_even(coalesce(ce, 0)::DOUBLE / nullif(coalesce(ca, 0) + coalesce(ce, 0), 0), 4) AS instability
  FROM types LEFT JOIN (SELECT from_id AS type_id, count(*) AS ce FROM pairs GROUP BY 1) USING (type_id) LEFT JOIN (SELECT to_id AS type_id, count(*) AS ca FROM pairs GROUP BY 1) USING (type_id))"""


def _interpolated(x: str, ten: float, five: float, one: float) -> str:
    return f"(CASE WHEN {x} <= {ten} THEN 10.0::DOUBLE WHEN {x} >= {one} THEN 1.0::DOUBLE WHEN {x} <= {five} THEN 10.0::DOUBLE - 5.0::DOUBLE * ({x}::DOUBLE - {ten}) / ({five} - {ten})::DOUBLE ELSE 5.0::DOUBLE - 4.0::DOUBLE * ({x}::DOUBLE - {five}) / ({one} - {five})::DOUBLE END)"


def type_metrics_sql(source: str, side: str = "") -> str:
    """A query of the metrics of types, from a relation of method metrics; ``side`` limits the members that are summed likewise."""
    health = " + ".join(
        f"{w}::DOUBLE * {_interpolated(x, *p)}"
        for x, w, p in (("avg_cog_", 0.25, (5, 10, 25)), ("max_cog", 0.20, (10, 15, 40)), ("line_count", 0.15, (200, 300, 800)), ("method_count", 0.10, (10, 15, 40)), ("max_nesting", 0.15, (3, 4, 7)), ("many_params", 0.15, (0, 1, 4)))
    )
    return f"""SELECT type_id, name, namespace, assembly, kind, line_count, method_count, round_even(avg_cog_, 1) AS avg_cog, max_cog, avg_cyc, max_cyc, max_nesting, many_params, wmc, avg_mi, min_mi, round_even({health}, 1) AS health
  FROM (SELECT t.type_id, name, namespace, assembly, kind, line_count, count(m.type_id) AS method_count, coalesce(sum(cog)::DOUBLE / nullif(count(m.type_id), 0), 0) AS avg_cog_,
    coalesce(max(cog), 0) AS max_cog, round_even(coalesce(sum(cyc)::DOUBLE / nullif(count(m.type_id), 0), 0), 1) AS avg_cyc, coalesce(max(cyc), 0) AS max_cyc, coalesce(max(nesting), 0) AS max_nesting,
    count(*) FILTER (params > 4) AS many_params, coalesce((SELECT CAST(sum(w.cyc) AS BIGINT) FROM members w WHERE w.type_id = t.type_id{side}), 0) AS wmc, round_even(sum(CAST(round_even(mi * 10, 0) AS BIGINT))::DOUBLE / nullif(count(mi), 0) / 10, 1) AS avg_mi, min(mi) AS min_mi
    FROM types t LEFT JOIN {source} m ON m.type_id = t.type_id WHERE kind NOT IN ('enum', 'delegate') GROUP BY t.type_id, name, namespace, assembly, kind, line_count)"""
