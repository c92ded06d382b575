"""Running sums that no single task has to hold: two levels of prefix sums over quantile buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillframe.sources.durable import durable


def with_running(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], buckets: int = 64, descending: bool = True) -> DataFrame:
    """Adds run_<v> (sum of v up to and with the row, in `order`) and total_<v> for each value, per key.

    Rows must be unique in (keys, order). Buckets are cut at approximate quantiles; any monotone cut gives the
    same sums, so the approximation never shows. Approximate quantiles depend on the order in which partitions arrive, so
    the cuts are written once: rows and totals must fall into the same buckets. Keys must not be null. A window sorts one
    bucket, and the buckets' totals (at most `buckets` + 1 rows a key) make a second, small one.
    """
    keys = list(keys)
    base = durable(df if keys else df.withColumn("__all", F.lit(0)), "running-rows")
    by = keys or ["__all"]
    cuts = base.groupBy(*by).agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 1000).alias("__cuts"))
    cuts = durable(cuts, "running-cuts")
    placed = base.join(cuts, by).withColumn("__b", F.size(F.filter("__cuts", lambda x: x < F.col(order)))).drop("__cuts")
    sign = -1 if descending else 1
    totals = placed.groupBy(*by, "__b").agg(*(F.sum(v).alias(f"__t_{v}") for v in values))
    before = W.partitionBy(*by).orderBy(sign * F.col("__b")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    totals = totals.select(*by, "__b", *(F.coalesce(F.sum(f"__t_{v}").over(before), F.lit(0)).alias(f"__o_{v}") for v in values), *(F.sum(f"__t_{v}").over(whole).alias(f"total_{v}") for v in values))
    inside = W.partitionBy(*by, "__b").orderBy(F.col(order).desc() if descending else F.col(order).asc()).rowsBetween(W.unboundedPreceding, 0)
    summed = placed.select("*", *(F.sum(v).over(inside).alias(f"__r_{v}") for v in values))
    joined = summed.join(totals, [*by, "__b"])
    out = joined.withColumns({f"run_{v}": F.col(f"__r_{v}") + F.col(f"__o_{v}") for v in values})
    return out.drop("__b", "__all", *(f"__r_{v}" for v in values), *(f"__o_{v}" for v in values))

