"""Exact and near duplicates: content hashes, similarity in blocks, groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillframe.operators.graph import components

BLOCK = 1024


def exact_groups(df: DataFrame, key: str, content: str) -> DataFrame:
    """(sha, n, members) of contents that more than one row has; members are keys in order."""
    hashed = df.select(F.col(key), F.sha2(F.col(content), 256).alias("sha"))
    twice = hashed.groupBy("sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return hashed.join(twice, "sha").groupBy("sha", "n").agg(F.array_join(F.transform(F.sort_array(F.collect_list(key)), lambda x: x.cast("string")), ",").alias("members"))


def keep_first(df: DataFrame, by: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in a stated order."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def uniqueness(df: DataFrame, keys: Sequence[str], content: str) -> DataFrame:
    """(keys, n, n_unique, ratio) of content hashes: hashes meet once each, however many copies there are."""
    each = df.groupBy(*keys, F.sha2(F.col(content), 256).alias("sha")).agg(F.count(F.lit(1)).alias("m"))
    return each.groupBy(*keys).agg(F.sum("m").alias("n"), F.count("sha").alias("n_unique")).withColumn("ratio", F.round(F.col("n_unique") / F.col("n"), 9))


def _tiles(df: DataFrame, key: str, vector: str, label: str | None, block: int, symmetric: bool) -> DataFrame:
    blocks = max(1, -(-df.count() // block))
    own = F.pmod(F.xxhash64(F.lit("tile"), key), F.lit(blocks)).cast("int")
    cols = [F.col(key).cast("bigint").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"), (F.col(label).cast("string") if label else F.lit(None).cast("string")).alias("l")]
    rows = df.select(*cols, own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    if symmetric:
        return rows.select("id", "v", "l", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return rows.select("id", "v", "l", "own", F.col("own").alias("i"), F.col("other").alias("j"))


def _whole(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows that can be compared: a key, and a vector without nulls."""
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(F.exists(vector, lambda x: x.isNull()), F.lit(True)))


def _matrix(part: pa.Table) -> np.ndarray:
    v = part.column("v").combine_chunks()
    sizes = np.diff(v.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors differ in length")
    return v.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def similar_pairs(df: DataFrame, key: str, vector: str, threshold: float, label: str | None = None, block: int = BLOCK, digits: int = 6) -> DataFrame:
    """(a, b, similarity), a < b, of unit vectors whose rounded inner product reaches the threshold.

    Exact: every pair of blocks is one task's matrix product; with `label`, pairs of equal labels do not count.
    Rows with a null key, a null vector or a null in it have no pair; vectors of different lengths are an error.
    """
    df = _whole(df, key, vector)

    def pairs(part: pa.Table) -> pa.Table:
        i, j = part.column("i")[0].as_py(), part.column("j")[0].as_py()
        own, ids, labels, m = part.column("own").to_numpy(), part.column("id").to_numpy(), np.array(part.column("l").to_pylist(), object), _matrix(part)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        s = np.round(m[left] @ m[right].T, digits)
        x, y = np.nonzero(s >= threshold)
        value, x, y = s[x, y], left[x], right[y]
        keep = ids[x] < ids[y] if i == j else ids[x] != ids[y]
        if label:
            keep &= labels[x] != labels[y]
        x, y, value = x[keep], y[keep], value[keep]
        return pa.table({"a": pa.array(np.minimum(ids[x], ids[y])), "b": pa.array(np.maximum(ids[x], ids[y])), "similarity": pa.array(value)})

    return _tiles(df, key, vector, label, block, True).groupBy("i", "j").applyInArrow(pairs, "a bigint, b bigint, similarity double")


def nearest_neighbours(left: DataFrame, right: DataFrame, key: str, vector: str, block: int = BLOCK, digits: int = 6) -> DataFrame:
    """(id, neighbour, similarity): the most similar row of `right` for each of `left`; ties to the smaller key, never the row itself.

    Rows with a null key, a null vector or a null in it neither ask nor answer; vectors of different lengths are an error.
    """
    left, right = _whole(left, key, vector), _whole(right, key, vector)
    n_left, n_right = max(1, -(-left.count() // block)), max(1, -(-right.count() // block))
    tile = lambda n: F.pmod(F.xxhash64(F.lit("tile"), key), F.lit(n)).cast("int")
    cols = [F.col(key).cast("bigint").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v")]
    a = left.select(*cols, F.lit(0).alias("side"), tile(n_left).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))).alias("j"))
    b = right.select(*cols, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))).alias("i"), tile(n_right).alias("j"))

    def best(part: pa.Table) -> pa.Table:
        side, ids, m = part.column("side").to_numpy(), part.column("id").to_numpy(), _matrix(part)
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        y = y[np.argsort(ids[y], kind="stable")]
        none = pa.table({"id": pa.array([], pa.int64()), "neighbour": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        if not len(x) or not len(y):
            return none
        s = np.round(m[x] @ m[y].T, digits)
        s[ids[x][:, None] == ids[y][None, :]] = -np.inf
        k = s.argmax(axis=1)
        top = s[np.arange(len(x)), k]
        ok = np.isfinite(top)
        return pa.table({"id": pa.array(ids[x][ok]), "neighbour": pa.array(ids[y[k]][ok]), "similarity": pa.array(top[ok])})

    each = a.unionByName(b).groupBy("i", "j").applyInArrow(best, "id bigint, neighbour bigint, similarity double")
    top = F.max(F.struct(F.col("similarity").alias("s"), (-F.col("neighbour")).alias("n")))
    return each.groupBy("id").agg(top.alias("t")).select("id", (-F.col("t.n")).alias("neighbour"), F.col("t.s").alias("similarity"))


def duplicate_groups(edges: DataFrame, prefix: str = "near::") -> DataFrame:
    """(node, group_id, size): components of accepted pairs, named by a hash of their sorted members."""
    found = components(edges)
    named = found.groupBy("component").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("node")), lambda x: x.cast("string")), "\n"), 256).alias("h"), F.count(F.lit(1)).alias("size"))
    return found.join(named, "component").select("node", F.concat(F.lit(prefix), F.substring("h", 1, 20)).alias("group_id"), "size")
