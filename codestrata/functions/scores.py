"""Scalar formulas over metrics, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def halstead(n1: Column, n2: Column, total1: Column, total2: Column) -> dict[str, Column]:
    """Volume, difficulty, effort and estimated bugs from distinct and total operators (1) and operands (2)."""
    volume = F.when(n1 + n2 > 0, (total1 + total2) * F.log2((n1 + n2).cast("double"))).otherwise(0.0)
    difficulty = F.when(n2 > 0, n1 / 2.0 * total2 / n2).otherwise(0.0)
    effort = difficulty * volume
    return {"volume": volume, "difficulty": difficulty, "effort": effort, "bugs": F.pow(effort, F.lit(2.0 / 3.0)) / 3000.0}


def maintainability(volume: Column, cyclomatic: Column, lines: Column) -> Column:
    """0 at least, 100 for code without volume; nothing bounds it above."""
    raw = (171.0 - 5.2 * F.log(volume) - 0.23 * cyclomatic - 16.2 * F.log(F.greatest(lines, F.lit(1)).cast("double"))) * 100.0 / 171.0
    return F.when(volume.isNull(), None).when(volume <= 0, 100.0).otherwise(F.greatest(F.lit(0.0), raw))


def interpolate(x: Column, ten: float, five: float, one: float) -> Column:
    """10 up to ``ten``, falling to 5 at ``five`` and to 1 at ``one`` in two straight pieces, 1 beyond."""
    return (
        F.when(x <= ten, 10.0)
        .when(x >= one, 1.0)
        .when(x <= five, 10.0 - 5.0 * (x - ten) / (five - ten))
        .otherwise(5.0 - 4.0 * (x - five) / (one - five))
    )


#: weight, and the points of the interpolation, of each part of the health score.
HEALTH_PARTS = {
    "avg_cog": (0.25, 5, 10, 25), "max_cog": (0.20, 10, 15, 40), "line_count": (0.15, 200, 300, 800),
    "method_count": (0.10, 10, 15, 40), "max_nesting": (0.15, 3, 4, 7), "many_params": (0.15, 0, 1, 4),
}


def health(**parts: Column) -> Column:
    """Weighted mean of the interpolated parts, 1 to 10."""
    return sum((interpolate(parts[k].cast("double"), *points) * w for k, (w, *points) in HEALTH_PARTS.items()), F.lit(0.0))


def bucket(x: Column, limits: list[tuple[float, str]], other: str) -> Column:
    """The label of the first limit that x reaches."""
    out = F.when(x.isNull(), None)
    for limit, label in limits:
        out = out.when(x >= limit, label)
    return out.otherwise(other)
