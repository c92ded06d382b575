"""Manifest-level operators: projection contracts, header synonyms, file checks, label truth."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.operators import guards


def project(df: DataFrame, columns: Sequence[str], optional: Mapping[str, object] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """The columns in order; optional ones that are missing get their default, any other missing one is fatal."""
    for name, default in (optional or {}).items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default))
    out = guards.require_columns(df, columns).select(*columns)
    return out.orderBy(*order) if order else out


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows; columns in first-seen order, null where a frame has none."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def resolve_columns(df: DataFrame, heads: Sequence[str], suffixes: Sequence[str] = ("", "_prob", "_score")) -> dict[str, str]:
    """{head: column}: a column that is a head's name in any case, with a suffix or without; else the only one that holds it.

    The first match wins; heads without a column are left out, and their metrics count as 0.5.
    """
    lower = {c.lower(): c for c in reversed(df.columns)}
    out = {}
    for h in heads:
        exact = next((lower[h.lower() + s] for s in suffixes if h.lower() + s in lower), None)
        partly = [c for c in df.columns if h.lower() in c.lower()]
        if exact or len(partly) == 1:
            out[h] = exact or partly[0]
    return out


def existing_only(df: DataFrame, path: str, files: DataFrame) -> DataFrame:
    """Rows whose file is in a listing; recipes, which have no file of their own, stay."""
    from quillframe.functions.manifest import is_recipe

    plain = df.where(~is_recipe(F.col(path)))
    there = files.select(F.regexp_replace("path", "^file:/+", "/").alias("__p")).distinct()
    return plain.join(there, F.col(path) == F.col("__p"), "left_semi").unionByName(df.where(is_recipe(F.col(path))))


#: (voice present, music present) -> expected file, voice and music labels of a wholly synthetic corpus.
SYNTHETIC_TRUTH = {(1, 0): (1, 1, 0), (0, 1): (1, 0, 1), (1, 1): (1, 1, 1)}


def label_errors(df: DataFrame, truth: Mapping[tuple[int, int], tuple[int, int, int]] = SYNTHETIC_TRUTH) -> DataFrame:
    """Rows whose five labels do not stand in the truth table."""
    ok = F.lit(False)
    for (vp, mp), (f, v, m) in truth.items():
        row = (F.col("voice_present") == vp) & (F.col("music_present") == mp) & (F.col("file_fake") == f) & (F.col("voice_fake") == v) & (F.col("music_fake") == m)
        ok = ok | F.coalesce(row, F.lit(False))
    return df.where(~ok)


def rewrite_paths(df: DataFrame, path: str, moved: DataFrame) -> DataFrame:
    """Paths, and both sides of recipes, replaced by `moved` (path, address) where it has them."""
    from quillframe.functions.manifest import build_recipe, parse_recipe

    rows = df.withColumn("__r", parse_recipe(F.col(path)))
    left = moved.select(F.col("path").alias("__lp"), F.col("address").alias("__la"))
    right = moved.select(F.col("path").alias("__rp"), F.col("address").alias("__ra"))
    joined = rows.join(left, F.col("__r.left") == F.col("__lp"), "left").join(right, F.col("__r.right") == F.col("__rp"), "left")
    new = F.col("__r").withField("left", F.coalesce("__la", F.col("__r.left"))).withField("right", F.coalesce("__ra", F.col("__r.right")))
    return joined.withColumn(path, build_recipe(new)).drop("__r", "__lp", "__la", "__rp", "__ra")
