"""Deterministic pair recipes: mixes, partial replacements, stepping and in-group pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillframe.functions.hashing import hashed_index, order_key
from quillframe.operators import guards

#: (name, voice is fake, music is fake).
CLASSES = (("RR", 0, 0), ("RF", 0, 1), ("FR", 1, 0), ("FF", 1, 1))


def pool(df: DataFrame, key: str, label: str, seed: int = 0) -> DataFrame:
    """(label, idx, n, key): each class in hashed order, numbered from 0 (slices of the digest keep windows small)."""
    rows = df.select(F.col(label).cast("int").alias("label"), F.col(key).alias("key"), order_key(seed, key).alias("__o")).withColumn("__s", F.substring("__o", 1, 2))
    sizes = rows.groupBy("label", "__s").agg(F.count(F.lit(1)).alias("__m"))
    order = W.partitionBy("label").orderBy("__s").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumns({"__b": F.coalesce(F.sum("__m").over(order), F.lit(0)), "n": F.sum("__m").over(W.partitionBy("label"))})
    rank = F.row_number().over(W.partitionBy("label", "__s").orderBy("__o", "key"))
    return rows.withColumn("__r", rank).join(sizes.drop("__m"), ["label", "__s"]).select("label", (F.col("__r") - 1 + F.col("__b")).cast("bigint").alias("idx"), "n", "key")


def _recipes(spark, n: int, classes: Sequence[tuple[str, int, int]] = CLASSES) -> DataFrame:
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(a).alias("va"), F.lit(b).alias("vb"), F.lit(i).alias("c")) for i, (k, a, b) in enumerate(classes)))
    return spark.range(n).select(F.col("id").alias("i"), F.inline(kinds))


def _picked(recipes: DataFrame, left: DataFrame, right: DataFrame, pick_left, pick_right) -> DataFrame:
    sizes = lambda p, on, as_: p.groupBy("label").agg(F.max("n").alias(as_)).withColumnRenamed("label", on)
    r = recipes.join(F.broadcast(sizes(left, "va", "na")), "va").join(F.broadcast(sizes(right, "vb", "nb")), "vb")
    r = r.withColumns({"ia": pick_left(F.col("na")), "ib": pick_right(F.col("nb"))})
    a = left.select(F.col("label").alias("va"), F.col("idx").alias("ia"), F.col("key").alias("left"))
    b = right.select(F.col("label").alias("vb"), F.col("idx").alias("ib"), F.col("key").alias("right"))
    return r.join(a, ["va", "ia"]).join(b, ["vb", "ib"])


def mixes(left: DataFrame, right: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(i, kind, left, right, labels): n random pairs a class combination, from one split."""
    spark = left.sparkSession
    out = _picked(_recipes(spark, n), left, right, lambda m: hashed_index(f"{seed}:l", m, "kind", "i"), lambda m: hashed_index(f"{seed}:r", m, "kind", "i"))
    return out.select("i", "kind", "left", "right", F.greatest("va", "vb").alias("file_fake"), F.col("va").alias("voice_fake"), F.col("vb").alias("music_fake"))


def stepping(left: DataFrame, right: DataFrame, n: int) -> DataFrame:
    """Pairs at coprime strides: left (7 i + c) mod n_l, right (11 i + 3 c) mod n_r for class number c."""
    out = _picked(_recipes(left.sparkSession, n), left, right, lambda m: (F.col("i") * 7 + F.col("c")) % m, lambda m: (F.col("i") * 11 + 3 * F.col("c")) % m)
    return out.select("i", "kind", "left", "right")


def real_fake_pairs(df: DataFrame, key: str, group: str, label: str) -> DataFrame:
    """(group, real, fake): in each group with both labels, the i-th fake with real i mod n_real, in key order.

    Every fake gets one real, so a large group does not make all its pairs.
    """
    rank = F.row_number().over(W.partitionBy(group, label).orderBy(key)) - 1
    n = F.count(F.lit(1)).over(W.partitionBy(group, label))
    rows = df.select(F.col(group).alias("group"), F.col(key).alias("key"), F.col(label).alias("label"), rank.alias("i"), n.alias("n"))
    real = rows.where("label = 0").select("group", F.col("key").alias("real"), F.col("i").alias("j"), F.col("n").alias("m"))
    sizes = real.groupBy("group").agg(F.max("m").alias("m"))
    fake = rows.where("label = 1").select("group", F.col("key").alias("fake"), "i").join(sizes, "group").withColumn("j", (F.col("i") % F.col("m")).cast("int"))
    return fake.join(real.drop("m"), ["group", "j"]).select("group", "real", "fake")


def cyclic(values: Sequence, i: Column, offset: int = 0) -> Column:
    """The (i + offset)-th of a short list, round and round."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(i + offset, F.lit(len(values))) + 1).cast("int"))


RATIOS, POSITIONS, FADES = (0.1, 0.2, 0.35, 0.5), ("start", "middle", "end"), (0.0, 0.02, 0.05)


def partial_recipes(real: DataFrame, fake: DataFrame, n: int, component: str = "voice", role: str | None = "data_role") -> DataFrame:
    """(i, path, ratio, position, fade, labels): TRAIN-only recipes that replace a part of a real item by a fake one."""
    if role:
        for frame in (real, fake):
            if role in frame.columns:
                guards.role_only(frame, role)
    a, b = (p.select("idx", "n", "key") for p in (real, fake))
    sizes = a.agg(F.max("n").alias("na")).join(b.agg(F.max("n").alias("nb")))
    rows = real.sparkSession.range(n).select(F.col("id").alias("i")).join(F.broadcast(sizes))
    rows = rows.withColumns({"ia": F.col("i") % F.col("na"), "ib": (F.col("i") * 5 + 1) % F.col("nb")})
    rows = rows.join(a.select(F.col("idx").alias("ia"), F.col("key").alias("real")), "ia").join(b.select(F.col("idx").alias("ib"), F.col("key").alias("fake")), "ib")
    path = F.concat(F.lit(f"PARTIAL::{component}::"), F.col("real").cast("string"), F.lit("|"), F.col("fake").cast("string"))
    voice = component == "voice"
    labels = {"file_fake": 1, "voice_fake": int(voice), "music_fake": int(not voice), "voice_present": int(voice), "music_present": int(not voice)}
    return rows.select("i", path.alias("path"), cyclic(RATIOS, F.col("i")).alias("ratio"), cyclic(POSITIONS, F.col("i"), 1).alias("position"), cyclic(FADES, F.col("i"), 2).alias("fade"), *(F.lit(v).alias(k) for k, v in labels.items()))
