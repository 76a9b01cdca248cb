"""Dependency edges from parsed types, cycles among them, and what they add to the metrics of types."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity as names
from ..functions.rounding import half_even
from ..functions.shared import checkpoint
from . import edges as edge_ops
from . import graph, resolve

_KEYWORDS = ("class", "struct", "notnull", "unmanaged", "new()")
_OF_MEMBER = {"Field": "FieldType", "Property": "PropertyType", "Method": "ReturnType", "Event": "EventType", "Indexer": "PropertyType"}


def _named(kind: Column, text: Column) -> Column:
    return F.struct(kind.alias("kind"), text.alias("text"))


def resolved_bases(types: DataFrame) -> DataFrame:
    """Parsed types, a first base that names an interface of the same assembly moved to the interfaces."""
    simple = lambda c: F.substring_index(c, "<", 1)
    known = types.filter("kind = 'interface'").select(F.col("assembly").alias("_assembly"), simple("name").alias("_interface")).distinct()
    found = types.join(known, F.col("assembly").eqNullSafe(F.col("_assembly")) & (simple("base") == F.col("_interface")) & ~F.col("kind").isin("enum", "delegate", "interface"), "left")
    moves = F.col("_interface").isNotNull()
    columns = {"base": F.when(~moves, F.col("base")), "interfaces": F.when(moves, F.concat(F.array("base"), "interfaces")).otherwise(F.col("interfaces"))}
    return found.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in types.columns])


def merged_partials(types: DataFrame) -> DataFrame:
    """Parsed types, the parts of one id made one row: what the first in order of file and line is, with the lines of all, the
    first base, all interfaces once, all members and constructor parameters, and the first attributes and constraints of a name."""
    part = F.struct("path", "start_line")
    gathered = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("path", "start_line", "_n", F.struct(F.col(c).alias("x")).alias("_x"))), lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).when(a["start_line"] < b["start_line"], -1).when(a["start_line"] > b["start_line"], 1).otherwise(0)), lambda s: s["_x"]["x"]))

    def first_of(items: Column, key: str) -> Column:
        names_ = F.transform(items, lambda i: i[key])
        return F.filter(items, lambda i, n: F.array_position(names_, i[key]) == n + 1)

    lists = ("interfaces", "members", "constructor_params", "attributes", "constraints")
    plain = [c for c in types.columns if c not in (*lists, "type_id", "line_count", "base")]
    merged = types.withColumn("_n", F.monotonically_increasing_id()).groupBy("type_id").agg(
        *[F.min_by(c, part).alias(c) for c in plain], F.sum("line_count").cast("int").alias("line_count"),
        F.min_by("base", F.when(F.col("base").isNotNull(), part)).alias("base"), *[gathered(c).alias(c) for c in lists],
    )
    columns = {"interfaces": F.array_distinct("interfaces"), "attributes": first_of(F.col("attributes"), "name"), "constraints": first_of(F.col("constraints"), "parameter")}
    return merged.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in types.columns])


def _uses() -> Column:
    """Of each type what it names, each once, as "kind:text": bases, interfaces, members by their kind, parameters, constructor
    parameters and constraints. Constraints that are keywords name no type."""
    one = lambda kind, texts: F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t: _named(F.lit(kind), t))
    member_kind = lambda m: F.coalesce(F.create_map(*[F.lit(x) for p in _OF_MEMBER.items() for x in p])[m["member_kind"]], F.lit("FieldType"))
    limits = F.flatten(F.transform("constraints", lambda c: c["limits"]))
    wanted = F.concat(
        one("Inheritance", F.array_compact(F.array("base"))), one("InterfaceImpl", F.col("interfaces")),
        F.transform("members", lambda m: _named(member_kind(m), m["type"])),
        F.flatten(F.transform("members", lambda m: F.transform(m["parameters"], lambda p: _named(F.lit("MethodParam"), p["type"])))),
        one("ConstructorParam", F.col("constructor_params")),
        F.filter(one("GenericConstraint", F.transform(limits, lambda c: F.regexp_replace(c, "\\?+\\z", ""))), lambda s: ~s["text"].isin(*_KEYWORDS)),
    )
    return F.array_distinct(F.transform(wanted, lambda w: F.concat(w["kind"], F.lit(":"), w["text"])))


def references(types: DataFrame) -> DataFrame:
    """(from_id, from_name, namespace, qualified, kind, name): every type that a type names, once for each kind.

    What a type names is one array of each row (``uses`` where it is there), so the types are read once.
    """
    uses = F.col("uses") if "uses" in types.columns else _uses()
    rows = types.select(F.col("type_id").alias("from_id"), F.col("name").alias("from_name"), "namespace", "qualified", F.explode(uses).alias("u"))
    each = rows.select("from_id", "from_name", "namespace", "qualified", F.substring_index("u", ":", 1).alias("kind"), F.explode(names.type_names(F.expr("substr(u, locate(':', u) + 1)"))).alias("name"))
    return each.distinct()


def build(types: DataFrame) -> DataFrame:
    """Edges (from_type, to_type, kind, from_id, to_id) between known types, without loops, each once.

    A name is resolved once for each type that uses it, whatever kinds of use it has. The types are read once, while the result is
    planned: their names and what they name go to the shared folder, from where all that follows takes them.
    """
    types = checkpoint(types.select("type_id", "name", "namespace", "qualified", _uses().alias("uses")))
    used = references(types)
    known = types.select("type_id", "qualified", names.without_generics(F.col("name")).alias("simple"))
    wanted = used.select(F.struct("from_id", "name").alias("ref_id"), "name", "namespace", "qualified").distinct()
    found = resolve.resolve(wanted, known).select(F.col("ref_id.from_id").alias("from_id"), F.col("ref_id.name").alias("name"), F.col("type_id").alias("to_id"))
    target = types.select(F.col("type_id").alias("to_id"), F.col("name").alias("to_type"))
    joined = used.join(found, ["from_id", "name"]).filter("from_id <> to_id").join(target, "to_id")
    return joined.select(F.col("from_name").alias("from_type"), "to_type", "kind", "from_id", "to_id").distinct()


def with_registrations(edges: DataFrame, registrations: DataFrame) -> DataFrame:
    """Edges, and one for each registration with a container, which has no ids; these are not made distinct."""
    nothing = F.lit(None).cast("string")
    return edges.unionByName(registrations.select(F.col("service").alias("from_type"), F.col("implementation").alias("to_type"), F.lit("DIRegistration").alias("kind"), nothing.alias("from_id"), nothing.alias("to_id")))


def type_cycles(edges: DataFrame) -> DataFrame:
    """(component, size, member): cycles among the simple names of types (from_type, to_type)."""
    return _sized(graph.strong_components(edges.select(F.col("from_type").alias("src"), F.col("to_type").alias("dst"))))


def id_cycles(edges: DataFrame) -> DataFrame:
    """As type_cycles(), among the ids of types."""
    return _sized(graph.strong_components(edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL")))


def assembly_cycles(assemblies: DataFrame) -> DataFrame:
    """As type_cycles(), among the declared references of assemblies (name, references) to each other."""
    pairs = assemblies.select(F.col("name").alias("src"), F.explode("references").alias("dst"))
    return _sized(graph.strong_components(pairs.join(assemblies.select(F.col("name").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")))


def _sized(found: DataFrame) -> DataFrame:
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    return found.join(sizes, "component").select("component", "size", F.col("id").alias("member"))


def all_cycles(edges: DataFrame, assemblies: DataFrame) -> DataFrame:
    """(level, component, size, member), largest components first, members in order."""
    both = type_cycles(edges).withColumn("level", F.lit("Type")).unionByName(assembly_cycles(assemblies).withColumn("level", F.lit("Assembly")))
    return both.select("level", "component", "size", "member").orderBy(F.desc("size"), "level", "component", "member")


def with_coupling(type_rows: DataFrame, edges: DataFrame, types: DataFrame) -> DataFrame:
    """Type metrics with ca, ce and instability (two decimals); null for types that no edge can reach, as unknown ones."""
    found = edge_ops.coupling(edges, types).select("type_id", "ca", "ce", half_even(F.col("instability"), 2).alias("instability"))
    return type_rows.join(found, "type_id", "left")


def with_ranks(type_rows: DataFrame, edges: DataFrame, types: DataFrame) -> DataFrame:
    """Type metrics with the number of children (0 without any) and the rank (six decimals, null for none)."""
    ranks = graph.rank(edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")), types.select(F.col("type_id").alias("id")))
    return (
        type_rows.join(edge_ops.children(edges), "type_id", "left").withColumn("noc", F.coalesce("noc", F.lit(0)))
        .join(ranks.withColumnRenamed("id", "type_id"), "type_id", "left")
        .withColumn("type_rank", F.when(F.col("rank") > 0, half_even(F.col("rank"), 6))).drop("rank")
    )


def syntactic_depth(kind: Column, base: Column) -> Column:
    """Depth of inheritance where only one type is known: 1 for a class with a base."""
    return F.when(kind.isin("interface", "struct", "record struct"), 0).when(base.isNotNull(), 1).otherwise(0)


def analysis_level(failed: Column, total: Column, level: Column) -> Column:
    """A level falls back to SyntaxOnly when more than half of the references failed."""
    return F.when((total > 0) & (failed / total > 0.5), "SyntaxOnly").otherwise(level)
