"""Agreement of two scores of the same things."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import half_even, mean


def agreement(pairs: DataFrame, *by: str, nontrivial: float | None = None) -> DataFrame:
    """For columns a and b: share equal, share within 1, mean and greatest difference, Pearson and Spearman correlation.

    Spearman's takes average ranks of ties; a correlation that is undefined counts as 1. With ``nontrivial``, only pairs of which one
    exceeds it count. Null values are left out.
    """
    pairs = pairs.filter("a IS NOT NULL AND b IS NOT NULL")
    if nontrivial is not None:
        pairs = pairs.filter((F.col("a") > nontrivial) | (F.col("b") > nontrivial))
    d = F.abs(F.col("a") - F.col("b"))

    def ranks(c: str, name: str) -> DataFrame:
        """Average rank of each value: prefix sums over the counts of distinct values, not over the rows."""
        counts = pairs.groupBy(*by, c).agg(F.count("*").alias("_n"))
        order = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy(c).rowsBetween(Window.unboundedPreceding, 0)
        return counts.select(*by, c, (F.sum("_n").over(order) - (F.col("_n") - 1) / 2.0).alias(name))

    def correlation(x: str, y: str) -> Column:
        r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
        return half_even(F.coalesce(r, F.lit(1.0)), 3)

    n = F.count("*")
    return pairs.join(ranks("a", "ra"), [*by, "a"]).join(ranks("b", "rb"), [*by, "b"]).groupBy(*by).agg(
        n.alias("n"), half_even(mean(F.count_if(d == 0), n) * 100, 1).alias("exact"), half_even(mean(F.count_if(d <= 1), n) * 100, 1).alias("within_1"),
        half_even(mean(F.sum(d), n), 2).alias("mae"), F.max(d).alias("max_delta"),
        correlation("a", "b").alias("pearson"),
        correlation("ra", "rb").alias("spearman"),
    )


def nearest_lines(ours: DataFrame, theirs: DataFrame, reach: int = 5) -> DataFrame:
    """Greedy one-to-one match of equal keys by nearest line, at most ``reach`` off, in the order of our lines.

    ours: (key, line, a); theirs: (key, line, b). Rows of ours without a match get b = 0; of two lines equally near the lesser
    one is taken, and of several rows of a line the one of least b. One pass over the rows in order of key and line, which holds
    those within ``reach`` of a line, whatever the number and size of keys.
    """
    from bisect import bisect_left

    import pyarrow as pa

    schema = pa.schema([("key", pa.string()), ("line", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        out: list[tuple] = []
        free: list[tuple] = []  # theirs
        open_: list[tuple] = []  # ours, whose near lines may still come

        def settle(before: int | None) -> None:
            done = 0
            for line, a in open_:
                if before is not None and line + reach >= before:
                    break
                done += 1
                if free and free[0][0] < line - reach:
                    del free[: bisect_left(free, (line - reach,))]
                at = bisect_left(free, (line,))
                if at > 0 and (at == len(free) or line - free[at - 1][0] <= free[at][0] - line):
                    at = bisect_left(free, (free[at - 1][0],))
                out.append((key, line, a, free.pop(at)[1] if at < len(free) and abs(free[at][0] - line) <= reach else 0))
            del open_[:done]

        key, begun = None, False
        for batch in batches:
            for k, line, side, v in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k != key or not begun:
                    settle(None)
                    free.clear()
                    key, begun = k, True
                elif open_:
                    settle(line)
                elif free and free[0][0] < line - reach:
                    del free[: bisect_left(free, (line - reach,))]
                (open_ if side else free).append((line, v))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out.clear()
        settle(None)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    sides = [rows.select("key", F.col("line").cast("long").alias("line"), F.lit(n).alias("side"), F.col(c).cast("long").alias("v")) for n, (rows, c) in enumerate(((theirs, "b"), (ours, "a")))]
    rows = sides[0].unionByName(sides[1]).repartition("key").sortWithinPartitions("key", "line", "side", "v")
    return rows.mapInArrow(run, "key string, line long, a long, b long")
