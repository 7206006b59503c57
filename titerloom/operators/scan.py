"""Running aggregates over a long order, dealt out in slices.

A window over all rows of a key is one task's work, however many they are. Here a slice of the order
is: aggregates run within slices, those of whole slices run over the slices, of which there are
few, and both meet by a join.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places in the order that a slice takes.
SLICE = 100_000


class Running(NamedTuple):
    """kind: sum; low, the least that the sum has been; last, the last value that isn't null. before: of
    the rows before each, without itself."""

    name: str
    kind: str
    value: Column
    before: bool = False


def running(rows: DataFrame, keys: list[str], place: str, wanted: list[Running], size: int | None = None) -> DataFrame:
    """rows with the wanted aggregates over each key in the order of place, whole numbers that are
    different within a key. Keys may be null. rows are read twice: write them first if they are dear."""
    first, lanes = Window.unboundedPreceding, Window.partitionBy(*keys, "__slice").orderBy(place)
    to, until = lanes.rowsBetween(first, 0), lanes.rowsBetween(first, -1)
    cut = rows.withColumn("__slice", F.floor(F.col(place) / F.lit(size or SLICE))).withColumns({f"__v{k}": w.value for k, w in enumerate(wanted)})
    sums = {f"__s{k}": F.sum(f"__v{k}").over(to) for k, w in enumerate(wanted) if w.kind == "low"}
    local = cut.withColumns(sums) if sums else cut
    column = lambda k, w: f"__s{k}" if w.kind == "low" else f"__v{k}"
    of = {"sum": F.sum, "low": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
    local = local.withColumns({f"__l{k}": of[w.kind](column(k, w)).over(until if w.before else to) for k, w in enumerate(wanted)})
    parts = []
    for k, w in enumerate(wanted):
        last = F.max_by(f"__v{k}", F.when(F.col(f"__v{k}").isNotNull(), F.col(place)))
        parts += [(last if w.kind == "last" else F.sum(f"__v{k}")).alias(f"__t{k}")] + ([F.min(f"__s{k}").alias(f"__m{k}")] if w.kind == "low" else [])
    totals = local.groupBy(*keys, "__slice").agg(*parts)
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(first, -1)
    carried = totals.withColumns({f"__c{k}": (F.sum if w.kind != "last" else of["last"])(f"__t{k}").over(earlier) for k, w in enumerate(wanted)})
    deep = {f"__d{k}": F.min(F.coalesce(F.col(f"__c{k}"), F.lit(0)) + F.col(f"__m{k}")).over(earlier) for k, w in enumerate(wanted) if w.kind == "low"}
    carried = carried.withColumns(deep) if deep else carried
    names = [f"__c{k}" for k in range(len(wanted))] + list(deep)
    carried = carried.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__slice").alias("__of"), *names)
    same = F.col("__slice") == F.col("__of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    out = {}
    for k, w in enumerate(wanted):
        here, carry, zero = F.col(f"__l{k}"), F.col(f"__c{k}"), F.lit(0)
        if w.kind == "sum":
            out[w.name] = F.coalesce(carry, zero) + F.coalesce(here, zero)
        elif w.kind == "low":
            out[w.name] = F.least(F.col(f"__d{k}"), F.coalesce(carry, zero) + here)
        else:
            out[w.name] = F.coalesce(here, carry)
    return local.join(carried, same).select(*rows.columns, *[c.alias(n) for n, c in out.items()])
