"""Order statistics of latency and load reports.

The values of all groups are numbered in one order (group, value) along range
partitions, so a group's statistics are the values at known places of it: no
group is gathered or sorted in one task, however many samples it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators.dense import with_dense_ids


def nearest_rank(n: Column, fraction: float) -> Column:
    """Place ``round((n - 1) * fraction)`` among n sorted values, rounding half to even."""
    return F.rint((n - 1) * F.lit(fraction)).cast("long")


def order_statistics(rows: DataFrame, keys: list[str], value: str, fractions: dict[str, float] | None = None) -> DataFrame:
    """A row a group: the keys, ``samples`` (values that aren't null), ``median`` (mean of the middle two), ``max``, and
    the nearest-rank percentiles named in ``fractions``.  Null keys are a group; a group without values has nulls."""
    wanted = fractions or {}
    named = rows.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(value).cast("double").alias("_v"))
    if not keys:
        named = named.withColumn("_k0", F.lit(0))
    group = [c for c in named.columns if c != "_v"]
    placed = with_dense_ids(named.where("_v is not null"), [*group, "_v"], "_pos")
    spans = placed.groupBy(*group).agg(F.count("*").alias("_n"), F.min("_pos").alias("_start"))
    on = [F.col(f"p.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group]
    place = F.col("_pos") - F.col("_start")
    places = {"_low": F.floor((F.col("_n") - 1) / 2), "_high": F.floor(F.col("_n") / 2)} | {name: nearest_rank(F.col("_n"), f) for name, f in wanted.items()}
    at = placed.alias("p").join(spans.alias("s"), on).where(F.array_contains(F.array(*(p.cast("long") for p in places.values())), place))
    picked = at.groupBy(*(F.col(f"s.{g}").alias(g) for g in group)).agg(*(F.max(F.when(place == p, F.col("_v"))).alias(name) for name, p in places.items()))
    totals = named.groupBy(*group).agg(F.count("_v").alias("samples"), F.max("_v").alias("max"))
    same = [F.col(f"t.{g}").eqNullSafe(F.col(f"q.{g}")) for g in group]
    joined = totals.alias("t").join(picked.alias("q"), same, "left")
    return joined.select(*(F.col(f"t.{g}").alias(k) for g, k in zip(group, keys)), "samples", ((F.col("_low") + F.col("_high")) / 2).alias("median"), *wanted, "max")


def latency_summary(rows: DataFrame, keys: list[str], value: str, digits: int = 3) -> DataFrame:
    """Samples, median, p95, p99 and maximum in milliseconds, rounded half to even."""
    found = order_statistics(rows, keys, value, {"p95": 0.95, "p99": 0.99})
    return found.select(*keys, "samples", *(F.bround(c, digits).alias(f"{c}_ms") for c in ("median", "p95", "p99", "max")))
