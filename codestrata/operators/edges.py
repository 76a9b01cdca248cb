"""Dependency edges (from_id, to_id, kind): coupling, degrees, matrices."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import half_even


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.filter("from_id <> to_id").distinct()


def coupling(edges: DataFrame, types: DataFrame) -> DataFrame:
    """Afferent and efferent coupling over distinct pairs of known types, and instability (null for isolated types)."""
    known = types.select("type_id")
    pairs = (
        edges.filter("from_id <> to_id").select("from_id", "to_id").distinct()
        .join(known.withColumnRenamed("type_id", "from_id"), "from_id", "left_semi")
        .join(known.withColumnRenamed("type_id", "to_id"), "to_id", "left_semi")
    )
    ends = pairs.select(F.explode(F.array(F.struct(F.col("from_id").alias("type_id"), F.lit(1).alias("ce"), F.lit(0).alias("ca")), F.struct(F.col("to_id").alias("type_id"), F.lit(0).alias("ce"), F.lit(1).alias("ca")))).alias("e"))
    sums = ends.groupBy("e.type_id").agg(F.sum("e.ca").alias("ca"), F.sum("e.ce").alias("ce"))
    both = known.join(sums, "type_id", "left").select("type_id", F.coalesce("ca", F.lit(0)).alias("ca"), F.coalesce("ce", F.lit(0)).alias("ce"))
    return both.withColumn("instability", half_even(F.col("ce") / F.nullif(F.col("ca") + F.col("ce"), F.lit(0)), 4))


def children(edges: DataFrame) -> DataFrame:
    return edges.filter("kind = 'Inheritance'").groupBy(F.col("to_id").alias("type_id")).agg(F.count("*").alias("noc"))


def raw_degree(edges: DataFrame) -> DataFrame:
    """Edges in and out of each type, parallel ones counted."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("from_id").alias("id"), F.lit(1).alias("o")), F.struct(F.col("to_id").alias("id"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy(F.col("e.id").alias("type_id")).agg(F.sum("e.o").alias("out_degree"), F.sum(1 - F.col("e.o")).alias("in_degree"))


def multiplicity(edges: DataFrame) -> DataFrame:
    pair = edges.filter("from_id <> to_id").select(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b"))
    return pair.groupBy("a", "b").agg(F.count("*").alias("n"))


def rolled_up(edges: DataFrame, types: DataFrame, by: str) -> DataFrame:
    """Edges between the groups that column ``by`` puts their ends in, counted; those inside a group go."""
    of = types.select("type_id", F.col(by).alias("g"))
    return (
        edges.join(of.select(F.col("type_id").alias("from_id"), F.col("g").alias("from_group")), "from_id")
        .join(of.select(F.col("type_id").alias("to_id"), F.col("g").alias("to_group")), "to_id")
        .filter("from_group <> to_group").groupBy("from_group", "to_group").agg(F.count("*").alias("n"))
    )


def group_coupling(matrix: DataFrame) -> DataFrame:
    """Peers of each group by direction, and instability, 0 for none."""
    out = matrix.groupBy(F.col("from_group").alias("assembly")).agg(F.count("*").alias("ce"))
    into = matrix.groupBy(F.col("to_group").alias("assembly")).agg(F.count("*").alias("ca"))
    both = out.join(into, "assembly", "full").select("assembly", F.coalesce("ca", F.lit(0)).alias("ca"), F.coalesce("ce", F.lit(0)).alias("ce"))
    return both.withColumn("instability", half_even(F.col("ce") / (F.col("ca") + F.col("ce")), 4))


def touching(edges: DataFrame, types: DataFrame) -> DataFrame:
    """(assembly, edges that touch it at either end): two equi-joins, never a nested loop."""
    of = types.select("type_id", "assembly")
    ends = edges.select("edge_id", F.explode(F.array("from_id", "to_id")).alias("type_id"))
    return ends.join(of, "type_id").select("assembly", "edge_id").distinct().groupBy("assembly").agg(F.count("*").alias("n_edges"))


def around(edges: DataFrame, matched: DataFrame) -> DataFrame:
    """Matched types (type_id), and those at the other end of their edges."""
    near = edges.join(matched.withColumnRenamed("type_id", "from_id"), "from_id", "left_semi").select(F.col("to_id").alias("type_id")).union(
        edges.join(matched.withColumnRenamed("type_id", "to_id"), "to_id", "left_semi").select(F.col("from_id").alias("type_id"))
    )
    return matched.select("type_id").union(near).distinct()


def matching(edges: DataFrame, text: str) -> DataFrame:
    """Edges that have a text in one of their ends or their kind, whatever its case."""
    wanted = F.lit(text.lower())
    return edges.filter(F.contains(F.lower("from_id"), wanted) | F.contains(F.lower("to_id"), wanted) | F.contains(F.lower("kind"), wanted))


def incident(edges: DataFrame, matched: DataFrame) -> DataFrame:
    """Edges that touch one of the matched types (type_id) at either end, each once."""
    m = matched.select("type_id").distinct()
    ends = edges.withColumn("_at", F.explode(F.array_distinct(F.array("from_id", "to_id")))).join(m.withColumnRenamed("type_id", "_at"), "_at", "left_semi")
    return ends.drop("_at").distinct()


def visible_rollup(edges: DataFrame, types: DataFrame, visible: DataFrame) -> DataFrame:
    """Edges between the nearest visible ancestors (prefix) of the namespaces of their ends, counted; pairs of one ancestor and ends without one go.

    A namespace is joined by its prefixes, so it takes an equi-join.
    """
    parts = F.split("namespace", "\\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    shown = types.select("namespace").distinct().withColumn("prefix", F.explode(above)).join(visible.select("prefix").distinct(), "prefix", "left_semi")
    nearest = shown.groupBy("namespace").agg(F.max_by("prefix", F.length("prefix")).alias("shown"))
    return rolled_up(edges, types.join(nearest, "namespace"), "shown")
