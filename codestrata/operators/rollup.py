"""Roll-ups along dotted namespaces."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import half_even, mean


def with_prefixes(rows: DataFrame, column: str, name: str = "prefix") -> DataFrame:
    """A row for each dotted prefix of a column, itself included."""
    parts = F.split(column, "\\.")
    all_ = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    return rows.withColumn(name, F.explode(all_))


def namespace_tree(types: DataFrame) -> DataFrame:
    """For each namespace and its ancestors: types below, least, greatest and mean health, types below 7 and 4."""
    t = F.rint(F.col("health") * 10).cast("long")
    return with_prefixes(types, "namespace").groupBy("prefix").agg(
        F.count("*").alias("types"), F.min("health").alias("min_health"), F.max("health").alias("max_health"),
        half_even(mean(F.sum(t), F.count("*")) / 10.0, 2).alias("avg_health"),
        F.count_if(F.col("health") < 7).alias("below_7"), F.count_if(F.col("health") < 4).alias("below_4"),
    )


def worst(types: DataFrame, n: int = 5) -> DataFrame:
    """The n types of least health in each namespace and its ancestors."""
    w = Window.partitionBy("prefix").orderBy("health", "type_id")
    return with_prefixes(types, "namespace").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("prefix", "place", "type_id", "health")


def dominant_assembly(types: DataFrame) -> DataFrame:
    """Types of each namespace, and the assembly that holds most of them (the least name of equals)."""
    each = types.groupBy("namespace", "assembly").agg(F.count("*").alias("n"))
    w = Window.partitionBy("namespace").orderBy(F.desc("n"), "assembly")
    return each.withColumn("types", F.sum("n").over(Window.partitionBy("namespace"))).withColumn("k", F.row_number().over(w)).filter("k = 1").select("namespace", "types", "assembly")


def common_prefix(names: DataFrame) -> DataFrame:
    """The longest dotted prefix of all of at least two names, with its full stop; no row without one."""
    whole = names.select("name").distinct()
    n = whole.agg(F.count("*").alias("n"))
    found = with_prefixes(whole, "name").groupBy("prefix").agg(F.count("*").alias("c"))
    return found.crossJoin(n).filter("c = n AND n >= 2").agg(F.max_by("prefix", F.length("prefix")).alias("p")).filter("p IS NOT NULL").select(F.concat("p", F.lit(".")).alias("prefix"))


#: Keys of the panels of worst types and methods: column, whether low values come first, what null counts as.
TYPE_KEYS = {"health": ("health", True, None), "cog": ("max_cog", False, None), "cyc": ("max_cyc", False, None), "loc": ("line_count", False, None), "nest": ("max_nesting", False, None), "cbo": ("cbo", False, None), "mi": ("avg_mi", True, 100.0), "smells": ("smells", False, 0)}


def _key(name: str, low_first: bool, instead: float | None) -> Column:
    c = F.col(name) if instead is None else F.coalesce(F.col(name), F.lit(instead))
    return c.asc_nulls_last() if low_first else c.desc_nulls_last()


def panel(types: DataFrame, key: str = "health", n: int = 20) -> DataFrame:
    """The n types that are worst by a key (health, cog, cyc, loc, nest, cbo, mi, smells); ties by cognitive complexity and id, nulls last."""
    return types.orderBy(_key(*TYPE_KEYS[key]), F.desc_nulls_last("max_cog"), "type_id").limit(n)


def method_panel(methods: DataFrame, key: str = "cog", n: int = 20) -> DataFrame:
    """The n methods that are worst by a column; ties by complexities, lines and name."""
    first = F.coalesce("mi", F.lit(100.0)).asc() if key == "mi" else F.desc_nulls_last(key)
    return methods.orderBy(first, F.desc("cog"), F.desc("cyc"), F.desc("lines"), "type_id", "method", "start_line").limit(n)
