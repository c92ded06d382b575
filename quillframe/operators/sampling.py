"""Balanced, weighted and bootstrap samples, ordered by hashes instead of random streams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillframe.functions.hashing import hashed_index, order_key
from quillframe.operators.prefix import with_running


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return df.orderBy(order_key(seed, key), key)


def balanced_subset(df: DataFrame, key: str, classes: Sequence[str], limit: int, seed: int = 0) -> DataFrame:
    """Equal shares of every label combination, then filled from the rest in hashed order up to `limit`."""
    groups = df.select(*classes).distinct().count()
    share = max(1, limit // max(1, groups))
    rank = F.row_number().over(W.partitionBy(*classes).orderBy(order_key(seed, key), key))
    ranked = df.withColumns({"__first": rank <= share, "__o": order_key(seed, key)})
    return ranked.orderBy(F.col("__first").desc(), "__o", key).limit(limit).drop("__first", "__o")


#: Buckets of sampling mass: (name, share, whether labels are balanced).
BUCKETS = (("component", 0.4, True), ("mixed", 0.4, True), ("other", 0.2, False))


def balanced_weights(df: DataFrame, bucket: str, label: str, domain: str, buckets: Sequence[tuple[str, float, bool]] = BUCKETS) -> DataFrame:
    """Adds weight: a bucket's share over its labels, then their domains, then rows; normalised to 1.

    All figures come from counts a (bucket, label, domain), which are joined back; no window holds rows.
    """
    share, by_label = F.lit(0.0), F.lit(None)
    for name, f, balanced in buckets:
        share = F.when(F.col(bucket) == name, F.lit(f)).otherwise(share)
        by_label = F.when(F.col(bucket) == name, F.col(label).cast("string") if balanced else F.lit("")).otherwise(by_label)
    rows = df.withColumns({"__l": F.coalesce(by_label, F.lit("")), "__f": share})
    cells = rows.groupBy(bucket, "__l", domain, "__f").agg(F.count(F.lit(1)).alias("__n"))
    domains = cells.groupBy(bucket, "__l").agg(F.count(F.lit(1)).alias("__d"))
    labels = domains.groupBy(bucket).agg(F.count(F.lit(1)).alias("__k"))
    sized = cells.join(domains, [bucket, "__l"]).join(labels, bucket).withColumn("__w", F.col("__f") / F.col("__k") / F.col("__d") / F.col("__n"))
    total = sized.agg(F.sum(F.col("__w") * F.col("__n")).alias("__t"))
    sized = sized.join(F.broadcast(total)).select(bucket, "__l", domain, (F.col("__w") / F.col("__t")).alias("weight"))
    return rows.join(sized, [bucket, "__l", domain]).drop("__l", "__f")


def hardness_weights(df: DataFrame, weight: str, label: str, probability: str, strength: float = 2.0) -> DataFrame:
    """Adds hard_weight: weights times 1 + strength x distance from the label, normalised; a missing probability counts as right."""
    p = F.least(F.greatest(F.coalesce(F.col(probability), F.col(label).cast("double")), F.lit(0.0)), F.lit(1.0))
    raw = F.col(weight) * (1 + strength * F.when(F.col(label) > 0.5, 1 - p).otherwise(p))
    scored = df.withColumn("__raw", raw)
    total = scored.agg(F.sum("__raw").alias("__t"))
    return scored.join(F.broadcast(total)).withColumn("hard_weight", F.col("__raw") / F.col("__t")).drop("__raw", "__t")


def capped_negatives(df: DataFrame, key: str, label: str, least: int = 400, share: int = 4, seed: int = 0) -> DataFrame:
    """All positives, and at most max(least, positives / share) negatives in hashed order."""
    positives = df.where(F.col(label) == 1)
    n = max(least, positives.count() // share)
    return positives.unionByName(df.where(F.col(label) == 0).orderBy(order_key(seed, key), key).limit(n))


def weighted_draws(df: DataFrame, key: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """(draw, key): n draws with replacement by inverse distribution over rows in key order.

    Cumulative weights come from two-level prefix sums. Draws and rows meet by a range bucket of the unit
    interval that both cover, so the range join is an equi-join.
    """
    cells = 1024
    mass = with_running(df.select(key, F.col(weight).alias("__w")), [], key, ["__w"], descending=False)
    upto, total = F.col("run___w"), F.col("total___w")
    spans = mass.select(key, ((upto - F.col("__w")) / total).alias("lo"), (upto / total).alias("hi"))
    spans = spans.withColumn("c", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1).cast("bigint")))))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), ((hashed_index(seed, 1 << 30, F.col("id")) + 0.5) / float(1 << 30)).alias("u"))
    draws = draws.withColumn("c", F.floor(F.col("u") * cells))
    return draws.join(spans, "c").where("u >= lo and u < hi").select("draw", key)


def bootstrap_indices(spark, n: int, replicates: int, seed: int = 0) -> DataFrame:
    """(b, i, row_index): paired resamples of 0..n-1 with replacement, n a replicate."""
    grid = spark.range(replicates * n).select((F.col("id") / n).cast("bigint").alias("b"), (F.col("id") % n).alias("i"))
    return grid.withColumn("row_index", hashed_index(seed, n, "b", "i"))


def bootstrap_counts(df: DataFrame, index: str, n: int, replicates: int, seed: int = 0) -> DataFrame:
    """`df` rows with (b, times): how often each replicate drew them."""
    drawn = bootstrap_indices(df.sparkSession, n, replicates, seed).groupBy("b", "row_index").agg(F.count(F.lit(1)).alias("times"))
    return df.join(drawn, F.col(index) == F.col("row_index")).drop("row_index")


def folds(key: str, k: int = 3, seed: int = 0) -> Column:
    return hashed_index(seed, k, key)


def out_of_fold_logistic(df: DataFrame, key: str, features: Sequence[str], label: str, fold: str, out: str = "oof") -> DataFrame:
    """(key, fold, out): logistic regression fitted on the other folds, for each fold; folds are few."""
    from functools import reduce

    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ready = VectorAssembler(inputCols=list(features), outputCol="__x").transform(df.withColumn(label, F.col(label).cast("double")))
    fit = LogisticRegression(featuresCol="__x", labelCol=label, probabilityCol="__p", predictionCol="__y", rawPredictionCol="__r", standardization=True, regParam=0.01)
    parts = []
    for f in sorted(r[0] for r in df.select(fold).distinct().collect()):
        model = fit.fit(ready.where(F.col(fold) != f))
        parts.append(model.transform(ready.where(F.col(fold) == f)).select(key, fold, vector_to_array("__p")[1].alias(out)))
    return reduce(DataFrame.unionByName, parts)


def paired_batches(df: DataFrame, key: str, group: str, label: str, weight: str, batch: int, n_batches: int, seed: int = 0) -> DataFrame:
    """(batch, key): a quarter of each batch are real/fake pairs of one group, the rest weighted draws."""
    from quillframe.operators.pairing import real_fake_pairs

    pairs = real_fake_pairs(df, key, group, label).orderBy(order_key(seed, "real", "fake")).limit(n_batches * max(1, batch // 8))
    # At most n_batches x batch / 8 pairs: one window may number them.
    turn = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(order_key(seed, "real", "fake"))) - 1
    numbered = pairs.withColumn("batch", (turn % n_batches).cast("bigint"))
    paired = numbered.select("batch", F.explode(F.array("real", "fake")).alias(key))
    rest = batch - 2 * max(1, batch // 8)
    drawn = weighted_draws(df, key, weight, rest * n_batches, seed).select((F.col("draw") % n_batches).alias("batch"), key)
    return paired.unionByName(drawn)


def class_shares(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """One row of counts of named conditions."""
    return df.agg(*(F.count_if(c).alias(k) for k, c in conditions.items()))


