"""Joins with contracts: order, uniqueness, fallbacks and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.operators import guards


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    guards.unique(left, [key])
    guards.unique(right, [key])
    guards.same_keys(left, right, key)
    return left.join(right, key)


def lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left rows with multiplicity and the right columns; a key that is missing on the right is fatal."""
    guards.unique(right, [key])
    if left.join(right.select(key), key, "left_anti").limit(1).count():
        raise guards.GuardError(f"lookup misses values of {key}")
    return left.join(right, key)


def mapped(left: DataFrame, right: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """Left rows with the right value, or the default where there is none."""
    return left.join(right.select(key, F.col(value).alias("__v")), key, "left").withColumn(value, F.coalesce("__v", default)).drop("__v")


def aligned(left: DataFrame, right: DataFrame, index: str, check: Sequence[str]) -> DataFrame:
    """Row-by-row join on an explicit index, fatal where a check column differs or a row has no partner."""
    other = right.select(index, *(F.col(c).alias(f"__{c}") for c in check), *(c for c in right.columns if c not in (index, *check) and c not in left.columns))
    joined = left.join(other.withColumn("__there", F.lit(True)), index, "full")
    ok = F.col("__there").isNotNull()
    for c in check:
        ok = ok & F.col(c).eqNullSafe(F.col(f"__{c}"))
    guards.expect(joined, ok, "rows are not aligned")
    return joined.drop("__there", *(f"__{c}" for c in check))


def replaced(frame: DataFrame, cache: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """`frame` with columns taken from a cache with the same keys: {column of frame: column of cache}."""
    other = cache.select(key, *(F.col(v).alias(f"__{k}") for k, v in columns.items()))
    return one_to_one(frame.drop(*columns), other, key).withColumnsRenamed({f"__{k}": k for k in columns})


def unique_key_join(left: DataFrame, right: DataFrame, key: Column, right_key: Column) -> DataFrame:
    """Accept exactly one right row a key: ambiguous keys match nothing."""
    counted = right.withColumn("__k", right_key)
    single = counted.groupBy("__k").agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").select("__k")
    return left.withColumn("__k", key).join(counted.join(single, "__k"), "__k").drop("__k")


def policy_join(rows: DataFrame, policy: DataFrame, key: str, detail: str, values: Sequence[str], wildcard: str = "*") -> DataFrame:
    """Values of (key, detail) or else of (key, wildcard); a row without either is fatal when checked by the caller."""
    exact = policy.where(F.col(detail) != wildcard).select(key, detail, *(F.col(v).alias(f"__e_{v}") for v in values))
    general = policy.where(F.col(detail) == wildcard).select(key, *(F.col(v).alias(f"__g_{v}") for v in values))
    joined = rows.join(exact, [key, detail], "left").join(general, key, "left")
    return joined.withColumns({v: F.coalesce(f"__e_{v}", f"__g_{v}") for v in values}).drop(*(f"__e_{v}" for v in values), *(f"__g_{v}" for v in values))


def stem(path: Column) -> Column:
    """Last path component without its extension."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def by_id_or_stem(sample: DataFrame, results: DataFrame, sample_id: str, result_id: str) -> DataFrame:
    """Sample rows with results by exact id, else by the id's stem."""
    values = [c for c in results.columns if c != result_id]
    first = results.select(F.col(result_id).alias("__id"), *(F.col(v).alias(f"__a_{v}") for v in values))
    second = results.select(F.col(result_id).alias("__st"), *(F.col(v).alias(f"__b_{v}") for v in values))
    joined = sample.withColumn("__stem", stem(F.col(sample_id))).join(first, F.col(sample_id) == F.col("__id"), "left").join(second, F.col("__stem") == F.col("__st"), "left")
    found = F.col("__id").isNotNull()
    picked = joined.withColumns({v: F.when(found, F.col(f"__a_{v}")).otherwise(F.col(f"__b_{v}")) for v in values})
    return picked.withColumn("matched", found | F.col("__st").isNotNull()).select(*sample.columns, *values, "matched")


def overlap(left: DataFrame, right: DataFrame, left_cols: Sequence[str], right_cols: Sequence[str]) -> DataFrame:
    """(n_overlap): distinct values that any left column shares with any right column."""
    pool = lambda df, cols: df.select(F.explode(F.array(*(F.col(c).cast("string") for c in cols))).alias("v")).where("v is not null and v <> ''").distinct()
    return pool(left, left_cols).join(pool(right, right_cols), "v", "left_semi").agg(F.count(F.lit(1)).alias("n_overlap"))


def with_group_match(df: DataFrame, group: str, match: Column) -> DataFrame:
    """Rows whose group has a row that matches."""
    return df.join(df.where(match).select(group).distinct(), group, "left_semi")


def opposite_pairs(df: DataFrame, mode: str, group: str, label: str) -> DataFrame:
    """For each (mode, group) target: its rows, and all rows of the mode with another label than the group's first.

    The rows of opposite labels are counted per score by the caller's metrics; targets are few, rows are not.
    """
    targets = df.groupBy(mode, group).agg(F.min(label).alias("__first"))
    own = df.select(*df.columns, F.col(group).alias("target"))
    others = df.join(targets.select(mode, F.col(group).alias("target"), F.col("__first")), mode).where((F.col(label) != F.col("__first")) & (F.col(group) != F.col("target"))).drop("__first")
    return own.unionByName(others)
