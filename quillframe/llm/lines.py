"""Line keys and their exact tables: what line dedup and substring dedup have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(SPACES)))


def digest(key: Column) -> Column:
    """16 bytes that stand for a key: the first half of its SHA-256."""
    return F.unhex(F.substring(F.sha2(key, 256), 1, 32))


def exploded_lines(docs: DataFrame, least: int, *keep: str) -> DataFrame:
    """(keep..., pos, digest) of every line whose key has at least `least` code points.

    Keys are made before lines become rows, once each: a filter on them would otherwise make them again.
    """
    keys = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1), line_key)
    keyed = docs.select(*keep, F.posexplode(keys).alias("pos", "key"))
    return keyed.where(F.char_length("key") >= least).select(*keep, "pos", digest(F.col("key")).alias("digest"))
