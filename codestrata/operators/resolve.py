"""Resolving type references, and merging the parts of partial types."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import containing_prefixes, normalized_reference, without_generics


def resolve(references: DataFrame, known: DataFrame) -> DataFrame:
    """(ref_id, type_id) of references (ref_id, name, and namespace and qualified name of the type they stand in).

    known: (type_id, qualified, simple). Levels in order: the normalized name as a qualified one; inside each type around the
    reference, innermost first; inside its namespace; the simple name without generic arguments. A level finds a type only if
    its key names one type alone. All levels are one equi-join; the least level wins. Namespaces around that of the reference
    are not looked at. A blank name finds nothing.
    """
    keys = known.select("type_id", F.explode(F.array(F.struct(F.lit("q").alias("by"), F.col("qualified").alias("key")), F.struct(F.lit("s").alias("by"), F.col("simple").alias("key")))).alias("k"))
    unique = keys.groupBy("k.by", "k.key").agg(F.count("*").alias("n"), F.min("type_id").alias("type_id")).filter("n = 1")
    name = normalized_reference(F.col("name"))
    own = F.when(F.length("namespace") > 0, F.array(F.col("namespace"))).otherwise(F.array().cast("array<string>"))
    around = F.concat(containing_prefixes(F.col("qualified"), F.col("namespace")), own)
    inner = F.transform(around, lambda p, i: F.struct((i + 1).alias("level"), F.lit("q").alias("by"), F.concat(p, F.lit("."), name).alias("key")))
    one = lambda level, by, key: F.struct(F.lit(level).alias("level"), F.lit(by).alias("by"), key.alias("key"))
    steps = F.concat(F.array(one(0, "q", name)), inner, F.array(one(1_000_000, "s", without_generics(F.col("name")))))
    wanted = references.filter(name != "").select("ref_id", F.explode(steps).alias("c")).select("ref_id", "c.*")
    return wanted.join(unique.select("by", "key", "type_id"), ["by", "key"]).groupBy("ref_id").agg(F.min_by("type_id", "level").alias("type_id"))


def reclassify_bases(types: DataFrame, interfaces: DataFrame) -> DataFrame:
    """A first base that names an interface of the same assembly moves to the interfaces."""
    i = interfaces.select("assembly", F.col("simple").alias("base")).distinct().withColumn("is_interface", F.lit(True))
    j = types.join(i, ["assembly", "base"], "left")
    return j.select("type_id", "assembly", F.when(F.col("is_interface").isNull(), F.col("base")).alias("base"), F.when(F.col("is_interface"), F.concat(F.array("base"), "interfaces")).otherwise(F.col("interfaces")).alias("interfaces"))


def merge_partials(parts: DataFrame) -> DataFrame:
    """One row for each type id: lines added up, the first base in order of file and line, interfaces and members in that order."""
    p = F.struct("file", "line")
    ordered = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("file", "line", F.col(c).alias("x")))), lambda s: s["x"]))
    return parts.groupBy("type_id").agg(
        F.count("*").alias("parts"), F.sum("line_count").alias("line_count"), F.min_by("base", F.when(F.col("base").isNotNull(), p)).alias("base"),
        F.array_distinct(ordered("interfaces")).alias("interfaces"), ordered("members").alias("members"), F.min_by("file", p).alias("file"),
    )
