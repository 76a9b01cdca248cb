"""Quality rules whose cutoffs come from the data: fences at gaps in quantile sketches of each language and source.

A sketch is a histogram over cells that grow by ``GROWTH``, so that a quantile is known to that factor from a bounded number
of counts, whatever the values. Merging two of them adds counts: partial aggregation, language sketches made of source sketches and
corpus sketches made of those all agree exactly with one pass over every row, and a lost executor's part can be made again bit for
bit. The shares of a group's cells are drawn towards those of its language, and these towards the corpus, by ``PRIOR`` documents'
worth; how much that matters falls with the size of the group, without any size at which it switches.

Documents of a kind lie together in a sketch, around its median. From there outwards, cells that hold a share of ``DENSE`` at
least are of the same kind as long as no more than ``GAP`` cells lie between two of them. Where more do, other documents begin:
the fence is the first such cell beyond the gap, and what lies there or further out is rejected. What lies in the gap stays, as
do all documents of a group without one. So no fence is a fixed number, and none follows from the spread of a feature that most
documents do not show at all.

Defined results
* null, empty or blank text: no words, so the document is rejected and does not enter any sketch;
* null ``lang`` or ``source``: a group of its own, like any other value;
* a value in the cell of a fence is rejected; repeated rows are judged alike, each by itself; columns of any name are kept; an
  empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import checkpoint, fresh, table

#: feature -> whether low values are rejected, whether high ones are.
FEATURES: dict[str, tuple[bool, bool]] = {
    "word_length": (True, True), "symbols": (False, True), "capitals": (False, True), "distinct_words": (True, False), "repeated_lines": (False, True),
}
GROWTH, CELLS = 1.15, 160
PRIOR, DENSE, GAP = 100, 0.006, 4
#: Shares are counted in this many parts, so that adding them up is exact.
_WHOLE = 1_000_000_000_000
#: Limits of more groups than these are joined by a shuffle instead of being sent to every task.
SENT = 100_000
_WORD = "[^ \\t\\n\\r]+"
_SYMBOL = "[#$%&*|!<>{}=~^@+]"


def features(text: Column) -> dict[str, Column]:
    """Integer features of a text: word_length in tenths of a character, symbols, capitals and distinct words in thousandths.

    repeated_lines is how often a line occurs on average, in hundredths: 100 without repeated ones.

    distinct_words is taken over windows' worth of words: the share of distinct words among the words, scaled by the
    square root of their number over 100 for longer texts, since long texts repeat words whatever their quality.
    """
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    lines = F.split(text, "\n")
    n, chars = F.size(words), F.char_length(text)
    distinct = F.size(F.array_distinct(words))
    return {
        "n_words": n,
        "word_length": F.floor(10 * chars / n).cast("int"),
        "symbols": F.floor(1000 * F.regexp_count(text, F.lit(_SYMBOL)) / chars).cast("int"),
        "capitals": F.floor(1000 * F.regexp_count(text, F.lit("[A-Z]")) / chars).cast("int"),
        "distinct_words": F.floor(1000 * distinct / n * F.sqrt(F.greatest(n, F.lit(100)) / 100)).cast("int"),
        "repeated_lines": F.floor(100 * F.size(lines) / F.size(F.array_distinct(lines))).cast("int"),
    }


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The documents that have words: columns ``keep``, and the features in a struct under a free name, the last."""
    (m,) = fresh(docs, "_measures")
    has_words = F.col("text").rlike("[^ \\t\\n\\r]")
    f = features(F.col("text"))
    return docs.filter(has_words).select(*keep, F.struct(*[c.alias(k) for k, c in f.items()]).alias(m))


def cell(value: Column) -> Column:
    """The sketch's cell of a value."""
    return F.least(F.floor(F.log(value + F.lit(1.0)) / F.lit(_log(GROWTH))), F.lit(CELLS)).cast("int")


def _log(x: float) -> float:
    import math

    return math.log(x)


def thresholds(measures: DataFrame, m: str) -> DataFrame:
    """(lang, source, low_<feature>, high_<feature>) of each group of measured documents; null where nothing is rejected.

    low is the last rejected cell, high the first.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), cell(F.col(m)[k]).alias("cell")) for k in FEATURES]))
    sketch = checkpoint(measures.select("lang", "source", cells.alias("c")).groupBy("lang", "source", "c.feature", "c.cell").agg(F.count("*").alias("n")))
    group = Window.partitionBy("lang", "source", "feature")
    of = sketch.groupBy("lang", "source", "feature").agg(F.sum("n").alias("n0"))
    grid = of.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(CELLS))))

    def counts(keys: list[str], c: str) -> DataFrame:
        return sketch.groupBy(*[F.col(k).alias(f"{k}_") for k in keys], F.col("feature").alias("feature_"), F.col("cell").alias("cell_")).agg(F.sum("n").alias(c))

    def totals(keys: list[str], n: str) -> DataFrame:
        return of.groupBy(*[F.col(k).alias(f"{k}_") for k in keys], F.col("feature").alias("feature_")).agg(F.sum("n0").alias(n))

    def joined(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
        on = [F.col(x[:-1]).eqNullSafe(F.col(x)) for x in right.columns if x.endswith("_")]
        return left.join(right, on, how).drop(*[x for x in right.columns if x.endswith("_")])

    both = ["lang", "source"]
    for keys, c in ((both, "c0"), (both[:1], "c1"), ([], "c2")):
        grid = joined(grid, counts(keys, c))
    for keys, n in ((both[:1], "n1"), ([], "n2")):
        grid = joined(grid, totals(keys, n))
    got = lambda c: F.coalesce(c, F.lit(0))
    shared = (got("c1") + PRIOR * (got("c2") / F.col("n2"))) / (F.col("n1") + PRIOR)
    share = F.floor((got("c0") + PRIOR * shared) / (F.col("n0") + PRIOR) * _WHOLE).cast("long").alias("share")
    shares = grid.select("lang", "source", "feature", "cell", share)
    up_to = group.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    ranked = shares.withColumns({"below": F.sum("share").over(up_to), "all": F.sum("share").over(group)})
    middle = F.min(F.when(F.col("below") * 2 >= F.col("all"), F.col("cell"))).over(group)
    dense = ranked.withColumn("middle", middle).filter(F.col("share") >= int(DENSE * _WHOLE))
    order = group.orderBy("cell")
    near = dense.withColumns({"before": F.greatest(F.lag("cell").over(order), "middle"), "after": F.least(F.lead("cell").over(order), "middle")})
    high = F.min(F.when((F.col("cell") > F.col("middle")) & (F.col("cell") - F.col("before") > GAP), F.col("cell")))
    low = F.max(F.when((F.col("cell") < F.col("middle")) & (F.col("after") - F.col("cell") > GAP), F.col("cell")))
    fences = near.groupBy("lang", "source", "feature").agg(low.alias("low"), high.alias("high"))
    whole = of.select("lang", "source").distinct()
    wide = fences.groupBy(F.col("lang").alias("lang_"), F.col("source").alias("source_")).agg(
        *[F.max(F.when(F.col("feature") == k, F.col(side))).alias(f"{side}_{k}") for k in FEATURES for side in ("low", "high")]
    )
    return checkpoint(joined(whole, wide))


def passing(measures: DataFrame, m: str, limits: DataFrame) -> DataFrame:
    """The measured documents inside every fence of their language and source."""
    s, t = fresh(measures, "_lang_of", "_source_of")
    names = [c for c in limits.columns if c not in ("lang", "source")]
    free = dict(zip(names, fresh(measures, *[f"_{n}" for n in names]), strict=True))
    limits = limits.select(F.col("lang").alias(s), F.col("source").alias(t), *[F.col(n).alias(f) for n, f in free.items()])
    if limits.count() <= SENT:
        limits = F.broadcast(limits)
    joined = measures.join(limits, F.col("lang").eqNullSafe(F.col(s)) & F.col("source").eqNullSafe(F.col(t)))
    good = F.lit(True)
    for k, (low, high) in FEATURES.items():
        c = cell(F.col(m)[k])
        if low:
            good = good & ~F.coalesce(c <= F.col(free[f"low_{k}"]), F.lit(False))
        if high:
            good = good & ~F.coalesce(c >= F.col(free[f"high_{k}"]), F.lit(False))
    return joined.filter(good).select(*[F.col(f"`{c}`") for c in measures.columns])


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with. They are read twice, and neither moved nor written."""
    keyed = measured(docs, ["lang", "source"])
    limits = thresholds(keyed, keyed.columns[-1])
    rows = measured(docs, docs.columns)
    return passing(rows, rows.columns[-1], limits).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpoint(measured(table(spark, sf_dir, "documents"), ["doc_id", "lang", "source"]))
    m = rows.columns[-1]
    return passing(rows, m, thresholds(rows, m)).select("doc_id", "lang", "source", f"{m}.*")


def _sql() -> str:
    words = r"regexp_extract_all(text, '[^ \t\n\r]+')"
    names = list(FEATURES)
    at = lambda k: f"least(floor(ln({k} + 1.0::DOUBLE) / {_log(GROWTH)!r}::DOUBLE), {CELLS})"
    tests = [f"NOT coalesce({at('m.' + k)} <= low_{k}, false)" for k in names if FEATURES[k][0]] + [f"NOT coalesce({at('m.' + k)} >= high_{k}, false)" for k in names if FEATURES[k][1]]
    same = "a.lang IS NOT DISTINCT FROM b.lang AND a.source IS NOT DISTINCT FROM b.source"
    return rf"""
WITH cut AS (
  SELECT doc_id, lang, source, text, {words} AS words, string_split(text, chr(10)) AS lines FROM documents
  WHERE regexp_matches(text, '[^ \t\n\r]')),
m AS (
  SELECT doc_id, lang, source, CAST(len(words) AS INTEGER) AS n_words,
    CAST(floor(10 * length(text) / len(words)) AS INTEGER) AS word_length,
    CAST(floor(1000 * len(regexp_extract_all(text, '{_SYMBOL}')) / length(text)) AS INTEGER) AS symbols,
    CAST(floor(1000 * len(regexp_extract_all(text, '[A-Z]')) / length(text)) AS INTEGER) AS capitals,
    CAST(floor(1000 * len(list_distinct(words)) / len(words) * sqrt(greatest(len(words), 100) / 100)) AS INTEGER) AS distinct_words,
    CAST(floor(100 * len(lines) / len(list_distinct(lines))) AS INTEGER) AS repeated_lines
  FROM cut),
cells AS ({' UNION ALL '.join(f"SELECT lang, source, '{k}' AS feature, CAST({at(k)} AS INTEGER) AS cell FROM m" for k in names)}),
c0 AS (SELECT lang, source, feature, cell, count(*) AS c FROM cells GROUP BY ALL),
c1 AS (SELECT lang, feature, cell, sum(c) AS c FROM c0 GROUP BY ALL), c2 AS (SELECT feature, cell, sum(c) AS c FROM c0 GROUP BY ALL),
n0 AS (SELECT lang, source, feature, sum(c) AS n FROM c0 GROUP BY ALL), n1 AS (SELECT lang, feature, sum(c) AS n FROM c0 GROUP BY ALL), n2 AS (SELECT feature, sum(c) AS n FROM c0 GROUP BY ALL),
grid AS (SELECT lang, source, feature, n AS n0, CAST(unnest(range({CELLS + 1})) AS INTEGER) AS cell FROM n0),
shares AS (
  SELECT a.lang, a.source, a.feature, a.cell, CAST(floor((coalesce(b.c, 0) + {PRIOR} * ((coalesce(l.c, 0) + {PRIOR} * (coalesce(w.c, 0)::DOUBLE / n2.n::DOUBLE)) / (n1.n + {PRIOR})::DOUBLE)) / (n0 + {PRIOR})::DOUBLE * {_WHOLE}) AS BIGINT) AS share
  FROM grid a LEFT JOIN c0 b ON {same} AND a.feature = b.feature AND a.cell = b.cell LEFT JOIN c1 l ON a.lang IS NOT DISTINCT FROM l.lang AND a.feature = l.feature AND a.cell = l.cell
    LEFT JOIN c2 w ON a.feature = w.feature AND a.cell = w.cell JOIN n1 ON a.lang IS NOT DISTINCT FROM n1.lang AND a.feature = n1.feature JOIN n2 ON a.feature = n2.feature),
ranked AS (SELECT *, sum(share) OVER (PARTITION BY lang, source, feature ORDER BY cell) AS below, sum(share) OVER (PARTITION BY lang, source, feature) AS whole FROM shares),
dense AS (SELECT * FROM (SELECT *, min(cell) FILTER (below * 2 >= whole) OVER (PARTITION BY lang, source, feature) AS middle FROM ranked) WHERE share >= {int(DENSE * _WHOLE)}),
near AS (SELECT *, greatest(lag(cell) OVER g, middle) AS before, least(lead(cell) OVER g, middle) AS after FROM dense WINDOW g AS (PARTITION BY lang, source, feature ORDER BY cell)),
fences AS (
  SELECT lang, source, {', '.join(f"max(cell) FILTER (feature = '{k}' AND cell < middle AND after - cell > {GAP}) AS low_{k}, min(cell) FILTER (feature = '{k}' AND cell > middle AND cell - before > {GAP}) AS high_{k}" for k in names)}
  FROM near GROUP BY lang, source)
SELECT m.doc_id, m.lang, m.source, m.n_words, {', '.join('m.' + k for k in names)}
FROM m LEFT JOIN fences t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source
WHERE {' AND '.join(tests)}"""


QUERIES = {"op10_quality_rules": op10}
ORACLE_SQL = {"op10_quality_rules": _sql()}
