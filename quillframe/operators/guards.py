"""Fail-closed checks: each raises before bad data goes on, and returns its input otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GuardError(ValueError):
    """A contract on data, metadata or a path does not hold."""


def expect(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """Every row satisfies `ok`; null counts as no."""
    bad = df.where(~F.coalesce(ok, F.lit(False))).limit(1).count()
    if bad:
        raise GuardError(message)
    return df


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise GuardError(f"missing columns: {missing}")
    return df


def unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        raise GuardError(f"{list(keys)} is not unique")
    return df


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """No null, blank or textual "nan" in these columns."""
    ok = F.lit(True)
    for c in columns:
        text = F.lower(F.trim(F.col(c).cast("string")))
        ok = ok & text.isNotNull() & ~text.isin("", "nan")
    return expect(df, ok, f"incomplete provenance in {list(columns)}")


def approved(df: DataFrame, column: str = "allowed") -> DataFrame:
    kept = df.where(F.upper(F.trim(F.col(column))) == "YES")
    if not kept.limit(1).count():
        raise GuardError("no approved rows")
    return kept


def fresh(expected: Mapping, actual: Mapping) -> None:
    """Cache metadata is exactly what is expected; lists what differs."""
    if stale := sorted(k for k in {*expected, *actual} if expected.get(k) != actual.get(k)):
        raise GuardError(f"stale cache: {stale}")


def not_protected(path: str, marks: Sequence[str] = ("final_holdout",)) -> str:
    if any(m in str(path).lower() for m in marks):
        raise GuardError(f"{path} is protected")
    return path


def group_disjoint(df: DataFrame, group: str, split: str) -> DataFrame:
    shared = df.groupBy(group).agg(F.count_distinct(split).alias("n")).where("n > 1").limit(1).count()
    if shared:
        raise GuardError(f"groups of {group} lie in several splits")
    return df


def parents_disjoint(df: DataFrame, parents: Sequence[str], split: str) -> DataFrame:
    """No original or derived row's parent lies in two splits; all parents of a row count."""
    rows = df.select(split, F.explode(F.array(*(F.col(p).cast("string") for p in parents))).alias("parent")).where("parent is not null and parent <> ''")
    return group_disjoint(rows, "parent", split)


def role_only(df: DataFrame, column: str = "data_role", roles: Sequence[str] = ("train", "training")) -> DataFrame:
    return expect(df, F.lower(F.col(column)).isin(*roles), f"rows outside the roles {list(roles)}")


def dense_index(df: DataFrame, column: str) -> DataFrame:
    """The column is exactly 0..n-1."""
    n, distinct, low, high = df.agg(F.count(F.lit(1)), F.count_distinct(column), F.min(column), F.max(column)).first()
    if n and not (distinct == n and low == 0 and high == n - 1):
        raise GuardError(f"{column} is not a dense index")
    return df


def same_keys(left: DataFrame, right: DataFrame, key: str) -> None:
    for a, b in ((left, right), (right, left)):
        if a.join(b.select(key), key, "left_anti").limit(1).count():
            raise GuardError(f"sets of {key} differ")


def frozen(actual: DataFrame, expected: DataFrame, key: str, sha: str) -> None:
    """Every expected artifact is there with its digest."""
    other = actual.select(key, F.col(sha).alias("__sha"))
    bad = expected.join(other, key, "left").where(~F.col(sha).eqNullSafe(F.col("__sha"))).limit(1).count()
    if bad:
        raise GuardError("artifacts differ from their frozen digests")


def calibration_only(df: DataFrame, fold: str = "calibration_fold", path: str | None = None) -> DataFrame:
    if df.select(fold).where(F.col(fold).isNotNull()).distinct().limit(2).count() < 2:
        raise GuardError("calibration needs at least two folds")
    if path and df.where(F.regexp_like(F.col(path), F.lit("(?i)final|holdout"))).limit(1).count():
        raise GuardError("hold-out rows in calibration data")
    return df
