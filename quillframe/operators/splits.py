"""Leakage-safe splits: whole groups, hashed order, held-out domains."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W



def _cuts(fractions: Mapping[str, float], position: Column) -> Column:
    total, upto, out = sum(fractions.values()), 0.0, None
    cuts = []
    for name, f in fractions.items():
        upto += f / total
        cuts.append((name, upto))
    out = F.lit(cuts[-1][0])
    for name, edge in reversed(cuts[:-1]):
        out = F.when(position < F.lit(edge), F.lit(name)).otherwise(out)
    return out


def group_partition(df: DataFrame, group: str, fractions: Mapping[str, float], seed: int | Column = 0, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, group, part): groups in hashed order, the i-th of n at (i + 0.5) / n; a position at a cut belongs to the next part."""
    groups = df.select(*keys, group).distinct().withColumn("__o", F.md5(F.concat_ws(":", seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed)), F.col(group).cast("string"))))
    ranked = _ranked(groups, keys)
    position = (F.col("__i") - 1 + 0.5) / F.col("__n")
    return ranked.select(*keys, group, _cuts(fractions, position).alias("part"))


def _ranked(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds __i (rank by the digest __o) and __n: ranks within 256 slices of the digest, then slice offsets."""
    sliced = groups.withColumn("__s", F.conv(F.substring("__o", 1, 2), 16, 10).cast("int"))
    sizes = sliced.groupBy(*keys, "__s").agg(F.count(F.lit(1)).alias("__m"))
    slices = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    sizes = sizes.withColumns({"__before": F.coalesce(F.sum("__m").over(slices.orderBy("__s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "__n": F.sum("__m").over(slices)})
    inside = F.row_number().over(W.partitionBy(*keys, "__s").orderBy("__o"))
    return sliced.withColumn("__r", inside).join(sizes.drop("__m"), [*keys, "__s"]).withColumn("__i", F.col("__r") + F.col("__before"))


def held_out(df: DataFrame, group: str, match: Column) -> tuple[DataFrame, DataFrame]:
    """(seen, unseen): unseen has every row of the groups in which some row matches."""
    groups = df.where(match).select(group).distinct()
    return df.join(groups, group, "left_anti"), df.join(groups, group, "left_semi")


def metric_complete(df: DataFrame, keys: Sequence[str], labels: Mapping[str, Column | None]) -> DataFrame:
    """(keys, complete): every label has both classes among the rows where its condition holds."""
    ok = F.lit(True)
    for label, present in labels.items():
        ok = ok & (F.count_distinct(F.when(F.lit(True) if present is None else present, F.col(label))) == 2)
    return df.groupBy(*keys).agg(ok.alias("complete"))


def first_complete_attempt(df: DataFrame, group: str, fractions: Mapping[str, float], labels: Mapping[str, Column | None], attempts: int = 200) -> DataFrame:
    """(attempt): the smallest seed whose parts are all metric-complete, all tried in one query."""
    groups = df.select(group).distinct().withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    parts = group_partition(groups, group, fractions, F.col("attempt"), ["attempt"])
    each = metric_complete(df.join(parts, group), ["attempt", "part"], labels)
    whole = each.groupBy("attempt").agg(F.bool_and("complete").alias("ok"), F.count(F.lit(1)).alias("n")).where(f"ok and n = {len(fractions)}")
    return whole.agg(F.min("attempt").cast("bigint").alias("attempt"))


def first_entities(df: DataFrame, entity: str, k: int) -> DataFrame:
    """Rows of the k smallest distinct entities."""
    return df.join(df.select(entity).distinct().orderBy(entity).limit(k), entity, "left_semi")


def capped(df: DataFrame, group: str, order: Sequence[str], cap: int, limit: int) -> DataFrame:
    """At most `cap` rows a group in order, then the first `limit` of all."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return df.withColumn("__r", rank).where(F.col("__r") <= cap).drop("__r").orderBy(*order).limit(limit)


def round_robin(df: DataFrame, genre: str, artist: str, order: str, cap: int, limit: int) -> DataFrame:
    """Turn by turn through the genres, at most `cap` rows an artist."""
    by_artist = F.row_number().over(W.partitionBy(artist).orderBy(order))
    turn = F.row_number().over(W.partitionBy(genre).orderBy(order))
    return df.withColumn("__a", by_artist).where(F.col("__a") <= cap).withColumn("turn", turn).drop("__a").orderBy("turn", genre).limit(limit)


def disjoint_pick(df: DataFrame, generators: Sequence[str], generator: str, identity: str, n: int) -> DataFrame:
    """Each generator in turn takes its n smallest identities that none before it took; generators are a short parameter."""
    from quillframe.sources.durable import durable

    taken = None
    for g in generators:
        own = df.where(F.col(generator) == g).select(F.lit(g).alias("generator"), F.col(identity).alias("identity")).distinct()
        if taken is not None:
            own = own.join(taken.select("identity"), "identity", "left_anti").select("generator", "identity")
        picked = own.orderBy("identity").limit(n)
        taken = durable(picked if taken is None else taken.unionByName(picked), "disjoint-pick")
    return taken


def domain_holdout(df: DataFrame, source: str, generator: str, group: str, sources: Sequence[str], generators: Sequence[str]) -> DataFrame:
    """Adds fold: "source", "generator" or "train"; training rows whose group is contaminated are dropped."""
    fold = F.when(F.col(source).isin(*sources), "source").when(F.col(generator).isin(*generators), "generator").otherwise("train")
    marked = df.withColumn("fold", fold)
    held = marked.where("fold <> 'train'").select(group).distinct()
    return marked.where("fold <> 'train'").unionByName(marked.where("fold = 'train'").join(held, group, "left_anti").select(marked.columns))


