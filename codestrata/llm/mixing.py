"""Mixing sources to target weights by systematic sampling.

Every document has an expected number of copies; within its source these are added up in document order, one random
offset is added to all sums, and a document is emitted once for each integer that its own step crosses. A source so
gets its target number of documents to within one, and a document its expectation to within one.

A source of n documents with a target of T has the step T / n. The sum up to document i is (offset + (i T) / n), whose whole
part is computed from integers of up to 38 digits (T and the offset in millionths of a document), so no step is rounded, no
error adds up over a source, and no source is too small for its share to count.

Only keys (source, id, hashes) are ranked: they are sorted by range over all tasks, counted for each task and source, and
prefix sums run over these few counts and then inside each task. A source that holds most documents so spreads over many
tasks. The texts are moved once, to be joined with their number of copies.

Defined results
* null ``source``: a source of its own; null ``text``: counted as a document, emitted like any other;
* null ``doc_id``: comes first in its source; equal ids (repeated rows) follow each other in the order of the MD5 of their
  text; ids of any type that can be ordered;
* rows that are alike in every column stand for each other, so a group of them is one key with a count;
* empty text: a document like any other; an empty table gives an empty one; a source without a weight in ``weights``
  goes, as does one whose weight is not positive or is null; columns of any name are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, fresh, table

MILLION = 1_000_000
#: The random offset, drawn once (in millionths).
OFFSET = 618_034
#: Rows of a group of equal rows that are emitted by one task.
CHUNK = 4096


def _up_to(place: str, target: str, rows: str, offset: int) -> Column:
    """Integers that the sum has passed before the document at a place of its source: floor((offset rows + place target) / (rows million))."""
    n = f"CAST(`{rows}` AS DECIMAL(15,0))"
    return F.expr(f"({n} * CAST({offset} AS DECIMAL(7,0)) + CAST({place} AS DECIMAL(15,0)) * CAST(`{target}` AS DECIMAL(20,0))) DIV ({n} * CAST({MILLION} AS DECIMAL(7,0)))")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, offset: int = OFFSET, copy_column: str | None = None) -> DataFrame:
    """The emitted documents with the columns they came with, and with the number of the copy if ``copy_column`` is given.

    The mixture has as many documents as the input. A source's share follows ``weights``, or without them the square
    root of its share of documents, which lifts small sources and damps large ones.
    """
    s, i, d, h, c, part, base, n, target, start, copies, name, s2, p2, h2, d2 = fresh(
        docs, "_source", "_id", "_digest", "_hash", "_count", "_part", "_base", "_rows", "_target", "_start", "_copies", copy_column or "_copy",
        "_source_of", "_part_of", "_hash_of", "_digest_of",
    )
    plain = [F.to_json(F.struct(F.col(f"`{x}`"))) if "map<" in kind else F.col(f"`{x}`") for x, kind in docs.dtypes]
    hashed = docs.withColumns({d: F.coalesce(F.md5("text"), F.lit("")), h: F.xxhash64(*plain)})
    keys = hashed.groupBy(F.col("source").alias(s), F.col("doc_id").alias(i), d, h).agg(F.count("*").alias(c))
    keys = checkpoint(keys.repartitionByRange(s, i, d, h).withColumn(part, F.spark_partition_id()))

    blocks = keys.groupBy(s, part).agg(F.sum(c).alias(n))
    if weights is None:
        weight = F.sqrt(n)
    else:
        given = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))]) if weights else F.create_map().cast("map<string,double>")
        weight = given[F.col(s)]
    sizes = blocks.groupBy(s).agg(F.sum(n).alias(n)).select(n, F.when(weight > 0, weight).alias("w"))
    total = sizes.agg(F.sum(n).alias("rows"), F.sum("w").alias("weight")).first()
    if not total["rows"] or total["weight"] is None:
        return docs.limit(0).withColumns({copy_column: F.lit(0)} if copy_column else {})

    whole = Window.partitionBy(s)
    bases = blocks.withColumns({
        base: F.coalesce(F.sum(n).over(whole.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), n: F.sum(n).over(whole),
    })
    bases = bases.filter(weight > 0).select(F.col(s).alias(s2), F.col(part).alias(p2), base, n, F.floor(weight / total["weight"] * total["rows"] * MILLION).alias(target))
    inside = Window.partitionBy(part, s).orderBy(i, d, h).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        keys.withColumn(start, F.coalesce(F.sum(c).over(inside), F.lit(0)))
        .join(bases, F.col(s).eqNullSafe(F.col(s2)) & (F.col(part) == F.col(p2)))
        .withColumn(start, F.col(start) + F.col(base))
        .withColumn(copies, _up_to(f"`{start}` + `{c}`", target, n, offset) - _up_to(f"`{start}`", target, n, offset))
        .filter(F.col(copies) > 0)
        .select(F.col(h).alias(h2), F.col(d).alias(d2), c, start, n, target, copies)
    )
    found = hashed.join(placed, (F.col(h) == F.col(h2)) & (F.col(d) == F.col(d2)))
    out = found.filter(F.col(c) == 1)
    if keys.filter(F.col(c) > 1).limit(1).count():
        # One row stands for each group of equal ones; the places of a large group are dealt out again in chunks.
        groups = found.filter(F.col(c) > 1).dropDuplicates([h, d])
        chunks = groups.withColumn(part, F.explode(F.sequence(F.lit(0), F.col(c) - 1, F.lit(CHUNK)))).repartition(h, part)
        each = chunks.withColumn(start, F.explode(F.sequence(F.col(start) + F.col(part), F.col(start) + F.least(F.col(part) + CHUNK, F.col(c)) - 1)))
        each = each.withColumn(copies, _up_to(f"`{start}` + 1", target, n, offset) - _up_to(f"`{start}`", target, n, offset))
        out = out.unionByName(each.drop(part).filter(F.col(copies) > 0))
    out = out.withColumn(name, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return out.select(*[F.col(f"`{x}`") for x in docs.columns], *([F.col(name).alias(copy_column)] if copy_column else []))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix_sources(docs, copy_column="copy")


QUERIES = {"op5_source_mixing": op5}
ORACLE_SQL = {
    "op5_source_mixing": f"""
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
targets AS (
  SELECT source, CAST(n AS HUGEINT) AS n, CAST(floor(sqrt(n) / (SELECT sum(sqrt(n)) FROM sizes) * (SELECT sum(n) FROM sizes) * {MILLION}) AS HUGEINT) AS t
  FROM sizes),
places AS (
  SELECT d.*, n, t, CAST(row_number() OVER (PARTITION BY d.source ORDER BY doc_id NULLS FIRST, coalesce(md5(text), '')) AS HUGEINT) AS i
  FROM documents d JOIN targets s ON d.source IS NOT DISTINCT FROM s.source),
counts AS (SELECT *, ({OFFSET} * n + i * t) // (n * {MILLION}) - ({OFFSET} * n + (i - 1) * t) // (n * {MILLION}) AS copies FROM places)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, CAST(copies AS BIGINT) + 1)) AS INTEGER) AS copy
FROM counts WHERE copies > 0"""
}
