"""Running sums and maxima along an axis in two levels, so that no task holds the whole axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

#: Rows that a span is meant to hold, the number of spans at most, and rows sampled for each.
SPAN_ROWS, MOST_SPANS, OVERSAMPLE = 10_000, 4096, 32


def span_bounds(rows: DataFrame, order: list[str], spans: int) -> list[Row]:
    """Ascending keys that cut the rows into about ``spans`` spans of equal rows, from a sample of OVERSAMPLE rows a span."""
    if spans < 2:
        return []
    sample = sorted(rows.select(*order).orderBy(F.rand(7)).limit(spans * OVERSAMPLE).collect())
    return sorted(set(sample[OVERSAMPLE // 2 :: OVERSAMPLE]))


def span_of(rows: DataFrame, order: list[str], bounds: list[Row]) -> Column:
    """How many of the bounds are not above the row's key, by binary search."""
    if not bounds:
        return F.lit(0)
    kinds = [rows.schema[c].dataType for c in order]
    table = F.array(*(F.struct(*(F.lit(v).cast(k).alias(c) for c, v, k in zip(order, b, kinds, strict=True))) for b in bounds))
    key = F.struct(*order)
    steps = F.array(*(F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.coalesce(F.get(table, at + step - 1) <= key, F.lit(False)), step).otherwise(0))


def running(rows: DataFrame, axis: str, order: list[str], totals: dict[str, tuple[str, Column]], span_rows: int = SPAN_ROWS) -> DataFrame:
    """Adds for each name the "sum" or "max" of a column over all rows up to each one by ``order``, whose first column is the ascending ``axis``.

    The order is cut into spans of about ``span_rows`` rows, however they lie along the axis: totals run within each, and what lies before a span is added from a table of one row a span.
    The bounds come from a sample, which decides how even spans are and nothing else. Nulls in ``order`` are not allowed.
    """
    if order[0] != axis:
        raise ValueError("the order begins with the axis")
    spans = min(MOST_SPANS, -(-rows.count() // span_rows))
    rows = rows.withColumn("__span", span_of(rows, order, span_bounds(rows, order, spans)))
    make = {"sum": F.sum, "max": F.max}
    sums = rows.groupBy("__span").agg(*(make[kind](c).alias(f"__{n}") for n, (kind, c) in totals.items()))
    earlier = Window.partitionBy(F.lit(0)).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("__span", *(make[kind](f"__{n}").over(earlier).alias(f"__{n}") for n, (kind, _) in totals.items()))
    inside = Window.partitionBy("__span").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(F.broadcast(before), "__span")  # MOST_SPANS rows at most
    here = {n: make[kind](c).over(inside) for n, (kind, c) in totals.items()}
    added = {n: here[n] + F.coalesce(f"__{n}", F.lit(0)) if kind == "sum" else F.greatest(here[n], f"__{n}") for n, (kind, _) in totals.items()}
    return rows.withColumns(added).drop("__span", *(f"__{n}" for n in totals))
