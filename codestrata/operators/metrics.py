"""Metrics of methods, types and assemblies. Relations are those of plans.fixtures; every function is lazy."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import half_even, mean
from ..functions.scores import health, maintainability


def method_metrics(methods: DataFrame) -> DataFrame:
    """One row for each method that has a cognitive complexity; members of other kinds have no row.

    A missing cyclomatic complexity is 1, a missing nesting 0, and maintainability is null without a volume. Columns
    ``member_kind``, ``difficulty``, ``effort`` and ``bugs`` are used where they are there.
    """
    has = set(methods.columns)
    rows = methods.filter("cog IS NOT NULL" + (" AND member_kind = 'Method'" if "member_kind" in has else ""))
    cyc, lines = F.coalesce("cyc", F.lit(1)), F.coalesce("lines", F.lit(0))
    mi = half_even(maintainability(F.col("volume"), cyc, lines), 1)
    more = [half_even(F.col(c), d).alias(c) for c, d in (("difficulty", 2), ("effort", 1), ("bugs", 4)) if c in has]
    return rows.select("type_id", "method", "start_line", "cog", cyc.alias("cyc"), F.coalesce("nesting", F.lit(0)).alias("nesting"), "params", lines.alias("lines"), mi.alias("mi"), *more)


def weighted_methods(members: DataFrame) -> DataFrame:
    """(type_id, wmc): cyclomatic complexities of all members that have one, whatever their kind, added up."""
    return members.groupBy("type_id").agg(F.coalesce(F.sum("cyc"), F.lit(0)).alias("wmc"))


def type_metrics(types: DataFrame, methods: DataFrame) -> DataFrame:
    """One row for each type but enums and delegates; zeros and null maintainability without methods.

    Means of maintainability are over the methods that have one. The methods are read once: what is summed over
    all members and what over those with a cognitive complexity are conditional sums of one aggregation.
    """
    has = set(methods.columns)
    counted = F.col("cog").isNotNull()
    if "member_kind" in has:
        counted = counted & (F.col("member_kind") == "Method")
    cyc = F.coalesce("cyc", F.lit(1))
    mi = half_even(maintainability(F.col("volume"), cyc, F.coalesce("lines", F.lit(0))), 1)
    of = lambda c: F.when(counted, c)
    m = methods.groupBy("type_id").agg(
        F.count_if(counted).alias("method_count"), F.sum(of(F.col("cog"))).alias("sum_cog"), F.max(of(F.col("cog"))).alias("max_cog"),
        F.sum(of(cyc)).alias("sum_cyc"), F.max(of(cyc)).alias("max_cyc"), F.max(of(F.coalesce("nesting", F.lit(0)))).alias("max_nesting"),
        F.count_if(counted & (F.col("params") > 4)).alias("many_params"), F.sum("cyc").alias("wmc"),
        F.sum(of(F.rint(mi * 10).cast("long"))).alias("sum_mi"), F.count(of(mi)).alias("n_mi"), F.min(of(mi)).alias("min_mi"),
    )
    joined = types.filter(~F.col("kind").isin("enum", "delegate")).join(m, "type_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    n = F.nullif(F.col("method_count"), F.lit(0))
    avg_cog = F.coalesce(mean(F.col("sum_cog"), n), F.lit(0.0))
    score = health(avg_cog=avg_cog, max_cog=zero("max_cog"), line_count=F.col("line_count"), method_count=zero("method_count"), max_nesting=zero("max_nesting"), many_params=zero("many_params"))
    return joined.select(
        "type_id", "name", "namespace", "assembly", "kind", "line_count",
        zero("method_count").alias("method_count"), half_even(avg_cog, 1).alias("avg_cog"), zero("max_cog").alias("max_cog"),
        half_even(F.coalesce(mean(F.col("sum_cyc"), n), F.lit(0.0)), 1).alias("avg_cyc"), zero("max_cyc").alias("max_cyc"),
        zero("max_nesting").alias("max_nesting"), zero("many_params").alias("many_params"), zero("wmc").alias("wmc"),
        half_even(mean(F.col("sum_mi"), F.nullif(F.col("n_mi"), F.lit(0))) / 10.0, 1).alias("avg_mi"), F.col("min_mi"), half_even(score, 1).alias("health"),
    )


def assembly_health(type_rows: DataFrame) -> DataFrame:
    """Mean and least health, types below 4, methods, and the mean complexity weighted by methods."""
    t = F.rint(F.col("health") * 10).cast("long")
    c = F.rint(F.col("avg_cog") * 10).cast("long") * F.col("method_count")
    return type_rows.groupBy("assembly").agg(
        half_even(mean(F.sum(t), F.count("*")) / 10.0, 2).alias("avg_health"), F.min("health").alias("min_health"),
        F.count_if(F.col("health") < 4).alias("unhealthy"), F.sum("method_count").alias("methods"),
        F.coalesce(half_even(mean(F.sum(c), F.nullif(F.sum("method_count"), F.lit(0))) / 10.0, 2), F.lit(0.0)).alias("avg_cog"),
    )


def assembly_metrics(types: DataFrame, edges: DataFrame, coupling: DataFrame) -> DataFrame:
    """Counts, abstractness, instability, distance from the main sequence, relational cohesion."""
    counts = types.groupBy("assembly").agg(
        F.count("*").alias("types"), *[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("class", "interface", "struct", "enum")],
        F.count_if("is_abstract").alias("abstract_types"), F.count_if("is_sealed").alias("sealed_types"),
        F.array_join(F.array_sort(F.collect_set("namespace")), ",").alias("namespaces"),
        half_even(mean(F.count_if(((F.col("kind") == "class") & F.col("is_abstract")) | (F.col("kind") == "interface")), F.count("*")), 4).alias("abstractness"),
    )
    of = types.select("type_id", "assembly")
    i = coupling.join(of, "type_id").groupBy("assembly").agg(F.sum("ca").alias("ca"), F.sum("ce").alias("ce"))
    pairs = edges.filter("from_id <> to_id").select("from_id", "to_id").distinct()
    inside = (
        pairs.join(of.select(F.col("type_id").alias("from_id"), "assembly"), "from_id")
        .join(of.select(F.col("type_id").alias("to_id"), F.col("assembly").alias("other")), "to_id")
        .filter("assembly = other").groupBy("assembly").agg(F.count("*").alias("inside"))
    )
    instability = F.coalesce(F.col("ce") / F.nullif(F.col("ca") + F.col("ce"), F.lit(0)), F.lit(0.0))
    out = counts.join(i, "assembly", "left").join(inside, "assembly", "left")
    return out.select(
        *counts.columns, half_even(instability, 4).alias("instability"),
        half_even(F.abs(F.col("abstractness") + half_even(instability, 4) - 1.0), 4).alias("distance"),
        half_even(F.when(F.col("types") > 1, (F.coalesce("inside", F.lit(0)) + 1) / F.col("types")), 4).alias("cohesion"),
    )
