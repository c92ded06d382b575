"""Policy search: grids evaluated in one job, frontiers, joint top-k and coordinate search."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A grid is a parameter, so that it may always be broadcast.
MOST_POINTS = 10_000


def grid(spark: SparkSession, axes: Mapping[str, Sequence[float]]) -> DataFrame:
    """(gid, axes...): the product of the axes in order."""
    points = [(i, *p) for i, p in enumerate(product(*axes.values()))]
    if len(points) > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} grid points")
    return spark.createDataFrame(points, "gid int, " + ", ".join(f"{a} double" for a in axes))


def over_grid(df: DataFrame, points: DataFrame) -> DataFrame:
    """Every row at every grid point; the grid is bounded by MOST_POINTS."""
    return df.join(F.broadcast(points))


def best(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row a key under an order over several columns."""
    spec = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    return df.withColumn("__r", F.row_number().over(spec.orderBy(*order))).where("__r = 1").drop("__r")


def frontier(policies: DataFrame, budgets: Sequence[float], cost: str, objective: str, policy: str) -> DataFrame:
    """(budget, policy, cost, objective): for each loss budget the cheapest policy within it of the best objective."""
    top = policies.agg(F.max(objective).alias("__best"))
    rows = policies.join(F.broadcast(top)).withColumn("budget", F.explode(F.array(*(F.lit(b) for b in budgets))))
    fit = rows.where(F.col(objective) >= F.col("__best") - F.col("budget"))
    return best(fit, ["budget"], F.col(cost), F.col(objective).desc(), F.col(policy)).select("budget", policy, cost, objective)


def joint_top(left: DataFrame, right: DataFrame, value: str, name: str, k: int, eligible: Column | None = None) -> DataFrame:
    """(left, right, joint): pairs of the k best of both sides, k a small parameter."""
    top = lambda d: d.orderBy(F.col(value).desc(), name).limit(k)
    a = top(left).select(F.col(name).alias("left"), F.col(value).alias("__a"))
    b = top(right).select(F.col(name).alias("right"), F.col(value).alias("__b"))
    pairs = a.join(F.broadcast(b)).withColumn("joint", F.round((F.col("__a") + F.col("__b")) / 2, 9))
    return (pairs if eligible is None else pairs.where(eligible)).select("left", "right", "joint")


def coordinate_search(start: Mapping[str, float], axes: Mapping[str, Sequence[float]], score: Callable[[list[dict]], list[float]], passes: int = 2) -> tuple[dict, float, list]:
    """Best point, its score and the trace; `score` rates all candidates of a coordinate in one job."""
    point, trace, top = dict(start), [], float("-inf")
    for _ in range(passes):
        for axis, values in axes.items():
            trials = [{**point, axis: v} for v in values]
            scores = score(trials)
            i = max(range(len(trials)), key=lambda j: (scores[j], -j))
            if scores[i] > top:
                point, top = trials[i], scores[i]
            trace.append((axis, point[axis], top))
    return point, top, trace


def hard_gates(candidates: DataFrame, baseline: Mapping[str, float], most: Mapping[str, float], objective: str) -> DataFrame:
    """Adds passes: no metric exceeds the baseline by more than allowed, and the objective improves."""
    ok = F.col(objective) > baseline[objective]
    for metric, slack in most.items():
        ok = ok & (F.col(metric) - baseline[metric] <= slack)
    return candidates.withColumn("passes", ok)
