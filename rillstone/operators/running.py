"""Running sums, maxima, minima, last and next values, and values of neighbours, over sequences too long for one task.

``block`` is a column that never falls along the order (an hour, a range of ids).  Values run within (key, block); each block's
total is carried on over the few blocks of a key; both are put together.  A key with a third of all rows is thus the work
of as many tasks as it has blocks.  Without a block the key's rows are one window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TOTALS = {"sum": F.sum, "max": F.max, "min": F.min}


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, kind: str, out: str, block: str | None = None) -> DataFrame:
    """df with ``out``: the sum, max, min or last non-null value up to and with each row, by the order within the keys."""
    rows = df.withColumn("__v", value)
    if block is None:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = F.last("__v", ignorenulls=True) if kind == "last" else _TOTALS[kind]("__v")
        return rows.withColumn(out, found.over(upto)).drop("__v")
    within = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if kind == "last":
        rows = rows.withColumn("__local", F.last("__v", ignorenulls=True).over(within))
        total = F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(*order)))
    else:
        rows = rows.withColumn("__local", _TOTALS[kind]("__v").over(within))
        total = _TOTALS[kind]("__v")
    totals = rows.groupBy(*keys, block).agg(total.alias("__total"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last("__total", ignorenulls=True) if kind == "last" else _TOTALS[kind]("__total")
    totals = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(block).alias("__b"), carried.over(before).alias("__carried"))
    met = F.col(block).eqNullSafe(F.col("__b"))
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    both = {
        "sum": F.coalesce(F.col("__carried") + F.col("__local"), F.col("__local"), F.col("__carried")), "max": F.greatest("__carried", "__local"),
        "min": F.least("__carried", "__local"), "last": F.coalesce("__local", "__carried"),
    }[kind]
    return rows.join(totals, met).withColumn(out, both).drop("__v", "__local", "__carried", "__b", *[f"__k{i}" for i in range(len(keys))])


def nearby(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, kind: str, out: str, block: str | None = None) -> DataFrame:
    """df with ``out``: the value of the row ``before`` or ``after``, or the first non-null value ``ahead`` (the row's own included), by the order within the keys.

    With a block the value is looked up within it first; what each block has to offer the others goes on over the few blocks of a key."""
    # the value in a struct, so that a neighbour's null differs from no neighbour
    rows = df.withColumn("__v", F.when(value.isNotNull(), F.struct(value.alias("v"))) if kind == "ahead" else F.struct(value.alias("v")))

    def found(w, v: str) -> Column:
        if kind == "ahead":
            return F.first(v, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
        return (F.lag if kind == "before" else F.lead)(v).over(w)

    if block is None:
        rows = rows.withColumn(out, found(Window.partitionBy(*keys).orderBy(*order), "__v"))
        return rows.withColumn(out, F.col(f"{out}.v")).drop("__v")
    rows = rows.withColumn("__local", found(Window.partitionBy(*keys, block).orderBy(*order), "__v"))
    place = F.struct(*order)
    offer = {"before": F.max_by("__v", place), "after": F.min_by("__v", place), "ahead": F.min_by("__v", F.when(F.col("__v").isNotNull(), place))}[kind]
    offers = rows.groupBy(*keys, block).agg(offer.alias("__offer"))
    over = Window.partitionBy(*keys).orderBy(block)
    carried = F.first("__offer", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)) if kind == "ahead" else (F.lag if kind == "before" else F.lead)("__offer").over(over)
    offers = offers.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(block).alias("__b"), carried.alias("__carried"))
    met = F.col(block).eqNullSafe(F.col("__b"))
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(offers, met).withColumn(out, F.coalesce("__local", "__carried")["v"]).drop("__v", "__local", "__carried", "__b", *[f"__k{i}" for i in range(len(keys))])
