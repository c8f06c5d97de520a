"""Running state along a source, in two steps: a summary of each page range, then windows within ranges.

A plain window over a source sorts all its rows in one task. Sums, minima and "the last one seen" can be
summed up a range of pages at a time, so only one row a range is ordered along the source, and rows
are sorted within their range only: a source with a third of all rows is spread over its ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pages of one range.
PAGES = 64


def running(df: DataFrame, out: dict[str, tuple[str, Column]], order: tuple[str, ...] = ("page_number", "pos"), *, inclusive: bool = True, keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """``df`` with columns of running values along ``order`` (whose first column is a number of pages).

    ``out``: name -> (kind, value) with kind ``sum``, ``min``, ``max`` or ``last`` (the last value that isn't
    null, up to this row). Without ``inclusive`` a row's own value isn't part. Rows without a page come first,
    as in an ascending sort. A sum over nothing is 0, other kinds give null.
    """
    page = order[0]
    names = {n: f"__run_v_{n}" for n in out}
    x = df.withColumn("__run_range", F.coalesce(F.floor(F.col(page) / PAGES), F.lit(-1 << 40)))
    for n, (_, value) in out.items():
        x = x.withColumn(names[n], value)

    def whole(n: str, kind: str) -> Column:
        v = F.col(names[n])
        if kind == "last":
            return F.max_by(v, F.when(v.isNotNull(), F.struct(*order)))
        return {"sum": F.sum, "min": F.min, "max": F.max}[kind](v)

    parts = x.groupBy(*keys, "__run_range").agg(*[whole(n, k).alias(f"__run_p_{n}") for n, (k, _) in out.items()])
    earlier = Window.partitionBy(*keys).orderBy("__run_range").rowsBetween(Window.unboundedPreceding, -1)
    over = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    parts = parts.select(*[F.col(k).alias(f"__run_k_{k}") for k in keys], F.col("__run_range").alias("__run_at"), *[over[k](F.col(f"__run_p_{n}")).over(earlier).alias(f"__run_p_{n}") for n, (k, _) in out.items()])
    within = Window.partitionBy(*keys, "__run_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    x = x.select("*", *[over[k](F.col(names[n])).over(within).alias(f"__run_w_{n}") for n, (k, _) in out.items()])
    same = F.col("__run_range") == F.col("__run_at")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__run_k_{k}"))
    x = x.join(parts, same)

    def both(n: str, kind: str) -> Column:
        a, b = F.col(f"__run_p_{n}"), F.col(f"__run_w_{n}")
        if kind == "sum":
            return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        return F.coalesce(b, a) if kind == "last" else {"min": F.least, "max": F.greatest}[kind](a, b)

    return x.select(*df.columns, *[both(n, k).alias(n) for n, (k, _) in out.items()])
