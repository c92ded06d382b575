"""Shared pieces: text expressions, let-bindings, and tables in the cluster's shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.sources.durable import durable, new_path, shared_dir  # noqa: F401


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space, as a character class body.
SPACE = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and hand it to `body`.

    The optimiser inlines projected columns into lambdas that use them, which evaluates them once
    per array element; a lambda variable stays bound.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else untouched; plain ASCII texts take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, separators: str) -> Column:
    """Maximal runs of characters outside the class body `separators`; none for null or empty text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{separators}]+", -1), "")


def broadcast_if(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Broadcast only what was counted and is at most `most` rows; else leave the choice to the planner."""
    return F.broadcast(df) if rows <= most else df


#: Most bytes, as Spark's plan puts them once a table is written, that are broadcast.
MAX_BROADCAST_BYTES = 64 << 20


def broadcast_small(df: DataFrame, most: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast `df` if its rows, summed over all columns, take at most `most` bytes; else leave the choice to the planner."""
    width = F.lit(16)
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        width = width + (F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + 16 if kind in ("string", "binary") else F.coalesce(F.octet_length(F.to_json(F.struct(f"`{f.name}`"))), F.lit(0)) if kind in ("array", "struct", "map") else F.lit(8))
    size = df.agg(F.coalesce(F.sum(width.cast("bigint")), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= most else df


@contextmanager
def batches_of(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs started inside send Python batches of about `most` bytes, whatever the number of rows; results do not change."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
