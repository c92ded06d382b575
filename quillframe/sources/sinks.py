"""Sinks: reports, caches with freshness proof, atomic publication, content addresses, submissions."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.operators import guards

SUBMISSION = ("id", "FILE_FAKE_PROB", "VOICE_FAKE_PROB", "MUSIC_FAKE_PROB", "VOICE_PRESENT_PROB", "MUSIC_PRESENT_PROB")


def write_csv(df: DataFrame, path: str, mode: str = "error", single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    write_csv(df, path, "append")


def write_report(spark: SparkSession, report: Mapping, path: str, once: bool = False) -> None:
    """A nested report as one JSON document; with `once`, an existing report is never replaced."""
    text = json.dumps(report, indent=2, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("error" if once else "overwrite").text(path)


def report_row(df: DataFrame, *columns: Column | str) -> DataFrame:
    """(report): each row's columns as JSON."""
    return df.select(F.to_json(F.struct(*(columns or ("*",)))).alias("report"))


def save_cache(df: DataFrame, path: str, meta: Mapping[str, str]) -> None:
    """Rows first, their metadata last: without it the cache does not count."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    write_report(df.sparkSession, meta, f"{path}/meta")


def load_cache(spark: SparkSession, path: str, expected: Mapping[str, str]) -> DataFrame:
    """The rows of a cache whose metadata is exactly as expected."""
    text = "\n".join(r["value"] for r in spark.read.text(f"{path}/meta", wholetext=True).collect())
    guards.fresh(dict(expected), json.loads(text))
    return spark.read.parquet(f"{path}/rows")


def publish(df: DataFrame, path: str) -> None:
    """All or nothing: written beside the target, then renamed over it; the old version comes back if that fails."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target, staged, old = (jvm.org.apache.hadoop.fs.Path(path + s) for s in ("", ".staged", ".old"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(path + ".staged")
    fs.delete(old, True)
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"cannot replace {path}")
    if not fs.rename(staged, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"cannot publish {path}")
    fs.delete(old, True)


def content_addresses(df: DataFrame, path: str, content: str) -> DataFrame:
    """(path, sha, address): where each payload belongs in a content-addressed store."""
    sha = F.sha2(F.col(content), 256)
    return df.select(F.col(path).alias("path"), sha.alias("sha"), F.concat(sha, F.regexp_extract(path, r"(\.[^./]*)$", 1)).alias("address"))


def submission(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """The six columns in order, complete and within the unit interval."""
    out = df.select(*(F.col(columns.get(c, c)).alias(c) for c in SUBMISSION))
    ok = F.col("id").isNotNull()
    for c in SUBMISSION[1:]:
        ok = ok & F.col(c).between(0, 1)
    return guards.expect(out, ok, "submission is incomplete or out of range")


def write_submission(df: DataFrame, columns: Mapping[str, str], paths: Sequence[str]) -> None:
    for p in paths:
        write_csv(submission(df, columns), p, "overwrite", single=True)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
