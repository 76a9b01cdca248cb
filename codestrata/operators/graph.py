"""Iterative graph operators: rank, strongly connected components, depth of base chains."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import checkpoint


def rank(edges: DataFrame, vertices: DataFrame, damping: float = 0.85, most: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """PageRank over distinct edges (src, dst) between different known vertices (id); the ranks add up to 1.

    The mass of vertices without successors is spread evenly. With a tolerance, rounds end when ranks move by less in sum. A round
    is one join and one aggregation over the round before it, which was written to the shared folder, and one sum over what it
    wrote itself. These jobs run while the result is planned.
    """
    nodes = checkpoint(vertices.select("id").distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    pairs = edges.filter("src <> dst").select("src", "dst").distinct()
    known = pairs.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi")
    degrees = checkpoint(known.groupBy("src").agg(F.count("*").alias("out")))
    links = checkpoint(known.join(degrees, "src"))
    start = nodes.join(degrees.withColumnRenamed("src", "id"), "id", "left").select("id", F.col("out").isNull().alias("sink"), F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("moved"))
    now = checkpoint(start)

    def sums(state: DataFrame):
        return state.agg(F.coalesce(F.sum(F.when(F.col("sink"), F.col("rank"))), F.lit(0.0)).alias("lost"), F.sum("moved").alias("moved"), F.sum("rank").alias("total")).first()

    of = sums(now)
    for _ in range(most):
        flow = links.join(now.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("out")).alias("flow"))
        rank_ = (1 - damping) / n + damping * (F.coalesce("flow", F.lit(0.0)) + of["lost"] / n)
        now = checkpoint(now.join(flow, "id", "left").select("id", "sink", rank_.alias("rank"), F.abs(rank_ - F.col("rank")).alias("moved")))
        of = sums(now)
        if tolerance is not None and of["moved"] < tolerance:
            break
    return now.select("id", (F.col("rank") / of["total"]).alias("rank"))


def _reach(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Least label that reaches each vertex along the edges; labels is (id, label)."""
    while True:
        pushed = edges.join(labels.select(F.col("id").alias("src"), "label"), "src").select(F.col("dst").alias("id"), "label")
        after = checkpoint(labels.unionByName(pushed).groupBy("id").agg(F.min("label").alias("label")))
        if not after.join(labels.withColumnRenamed("label", "old"), "id").filter("label < old").limit(1).count():
            return after
        labels = after


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of vertices in strongly connected components of more than one vertex; named by the least id.

    Colouring: the least id that reaches a vertex is its colour; what reaches that id backwards inside its colour
    is a component, leaves the graph, and the rest goes on.
    """
    rest = checkpoint(edges.filter("src <> dst").select("src", "dst").distinct())
    done = None
    while True:
        # Vertices without a way in or out are in no cycle; dropping them first keeps chains from costing a round each.
        while True:
            n = rest.count()
            rest = checkpoint(
                rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            )
            if rest.count() == n:
                break
        if not n:
            return done if done is not None else rest.select(F.col("src").alias("id"), F.col("dst").alias("component"))
        vertices = rest.select(F.col("src").alias("id")).union(rest.select("dst")).distinct()
        colour = _reach(rest, vertices.withColumn("label", F.col("id")))
        inside = checkpoint(
            rest.join(colour.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst").filter("a = b").select("src", "dst", "a")
        )
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        found = colour.filter("id = label")
        while True:
            more = back.join(found.select(F.col("id").alias("src"), "label"), "src").select(F.col("dst").alias("id"), "label")
            after = checkpoint(found.unionByName(more).distinct())
            if after.count() == found.count():
                break
            found = after
        sizes = found.groupBy("label").agg(F.count("*").alias("n")).filter("n > 1")
        part = found.join(sizes, "label", "left_semi").select("id", F.col("label").alias("component"))
        done = checkpoint(part if done is None else done.unionByName(part))
        gone = found.select("id")
        rest = checkpoint(rest.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"))


def base_depth(bases: DataFrame) -> DataFrame:
    """(id, depth): length of the chain of bases (id, base) above each type.

    A base outside the table counts as one level, as what is above it isn't known. Types of a chain that leads into a circle have
    null. Of several rows of an id the least base counts. Every round doubles how far a type sees, so chains of any length take
    rounds by their logarithm.
    """
    one = bases.groupBy("id").agg(F.min("base").alias("base"))
    known = one.select(F.col("id").alias("base"), F.lit(True).alias("there"))
    state = checkpoint(
        one.join(known, "base", "left").select("id", F.when(F.col("there"), F.col("base")).alias("to"), F.when(F.col("base").isNull(), 0).otherwise(1).alias("depth"))
    )
    rounds = max(1, state.count()).bit_length() + 1
    for _ in range(rounds):
        if not state.filter("to IS NOT NULL").limit(1).count():
            break
        ahead = state.select(F.col("id").alias("to"), F.col("to").alias("further"), F.col("depth").alias("more"))
        state = checkpoint(state.join(ahead, "to", "left").select("id", F.col("further").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    return state.select("id", F.when(F.col("to").isNull(), F.col("depth")).alias("depth"))
