"""Source files made from the driver's tables: a class for each part, with a method for each of its line items.

What a method holds follows from its line item, so that SQL can say what the measures of the text must be.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fixtures import read

_ORDER = ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
#: What a line item gives to its method: nested conditions, loops, a catch, a lambda, a use of a field.
_PARTS = "l_linenumber % 4 AS d, CAST(l_quantity AS INT) % 3 AS f, CAST(l_returnflag = 'R' AS INT) AS r, CAST(l_returnflag = 'A' AS INT) AS a, CAST(l_linenumber % 2 = 0 AS INT) AS s"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text, assembly)."""
    n = read(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] + 1
    number = F.row_number().over(Window.partitionBy("l_partkey").orderBy(*_ORDER)) - 1
    lines = read(spark, sf_dir, "lineitem").withColumn("k", number).selectExpr("l_partkey", "k", *_PARTS.split(", "))
    text = F.expr("""concat('  public int m', k, '(int a, int b) {\\n',
        concat_ws('', transform(filter(array(0, 1, 2), j -> j < d), j -> concat('    if (a > ', j, ' && b > ', j, ') {\\n'))), repeat('    }\\n', d),
        repeat('    for (int i = 0; i < a; i++) { b += i; }\\n', f), if(r = 1, '    try { b++; } catch (Exception e) { b--; }\\n', ''),
        if(a = 1, '    Func<int> g = () => a + b;\\n', ''), if(s = 1, '    f0 += a;\\n', ''), '    return b;\\n  }\\n')""")
    bodies = lines.withColumn("t", text).groupBy("l_partkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "").alias("bodies"))
    parts = read(spark, sf_dir, "part").join(bodies, F.col("p_partkey") == F.col("l_partkey"), "left")
    return parts.select(
        F.expr("concat('src/T', p_partkey, '.cs')").alias("path"),
        F.expr(f"""concat('namespace Brand.B', substr(p_brand, 7), ';\\npublic class T', p_partkey, if(p_partkey > 0, concat(' : T', p_partkey div 3), ''), ' {{\\n  int f0, f1;\\n  T', (p_partkey + 1) % {n}, ' next;\\n',
            if(p_partkey % 5 = 0, '  class Inner {{ Other o; }}\\n  class Other {{ }}\\n', ''), coalesce(bodies, ''), '}}\\n')""").alias("text"),
        F.col("p_type").alias("assembly"),
    ).repartition(spark.sparkContext.defaultParallelism, "path")  # parsing takes long for so few bytes


SQL = """
src_lines AS (
  SELECT l_partkey AS p, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) - 1 AS k,
    l_linenumber % 4 AS d, CAST(floor(l_quantity) AS INTEGER) % 3 AS f, CAST(l_returnflag = 'R' AS INTEGER) AS r, CAST(l_returnflag = 'A' AS INTEGER) AS a, CAST(l_linenumber % 2 = 0 AS INTEGER) AS s
  FROM lineitem),
src_parts AS (
  SELECT p_partkey AS p, p_type AS assembly, 'Brand.B' || substr(p_brand, 7) AS namespace, 'T' || p_partkey AS name, (p_partkey + 1) % (SELECT max(p_partkey) + 1 FROM part) AS following,
    p_partkey % 5 = 0 AS inner_, p_type || '::Brand.B' || substr(p_brand, 7) || '.T' || p_partkey AS type_id FROM part),
src_methods AS (
  SELECT type_id, p, k, 'm' || k AS method, 2 * d + d * (d - 1) // 2 + f + r AS cog, 1 + 2 * d + f + r AS cyc, greatest(d, CAST(f + r + a > 0 AS INTEGER)) AS nesting, 2 AS params, 3 + 2 * d + f + r + a + s AS lines,
    CAST(CASE WHEN inner_ THEN 7 ELSE 5 END + coalesce(sum(3 + 2 * d + f + r + a + s) OVER (PARTITION BY p ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start_line,
    4 * d + 5 * f + 4 * r + 5 * a + s + 1 AS total1, 2 * d + 2 * f + r + a AS total2, r, a, s,
    1 + 2 * least(d, 1) + CAST(d + a > 0 AS INTEGER) + least(f, 1) + 2 * CAST(f + a > 0 AS INTEGER) + CAST(f + r > 0 AS INTEGER) + CAST(f + s > 0 AS INTEGER) + 3 * r + 2 * a AS n1,
    greatest(d, least(f, 1)) + least(f, 1) + r + a AS n2
  FROM src_lines JOIN src_parts USING (p))"""
