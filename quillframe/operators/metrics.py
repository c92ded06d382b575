"""Ranking metrics grouped by any keys: equal error rate, AUC, composites, distributions and distances.

Equal error rate: over all distinct scores from high to low, the first point where false positive and
false negative rates are closest; their mean, without interpolation; 0.5 if a class is missing. AUC
counts ties half; 0.5 if a class is missing. Rows with a null or non-finite score do not count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillframe.functions.scores import is_finite
from quillframe.operators.prefix import with_running

DIGITS = 9


def rank_metrics(df: DataFrame, keys: Sequence[str], label: str, score: str, digits: int = DIGITS) -> DataFrame:
    """(keys, n, n_pos, eer, threshold, auc); keys must not be null."""
    keys = list(keys)
    rows = df.select(*keys, F.col(label).cast("int").alias("y"), F.col(score).cast("double").alias("s"))
    finite = is_finite(F.col("s"))
    sizes = rows.groupBy(*keys).agg(F.count_if(finite).alias("n"), F.count_if(finite & (F.col("y") == 1)).alias("n_pos"))
    points = rows.where(finite).groupBy(*keys, "s").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg"))
    roc = with_running(points, keys, "s", ["pos", "neg"])
    fpr, fnr = F.col("run_neg") / F.col("total_neg"), 1 - F.col("run_pos") / F.col("total_pos")
    both = roc.where("total_pos > 0 and total_neg > 0").withColumns({"fpr": fpr, "fnr": fnr})
    best = F.min(F.struct(F.abs(F.col("fpr") - F.col("fnr")).alias("d"), (-F.col("s")).alias("o"), ((F.col("fpr") + F.col("fnr")) / 2).alias("eer"), F.col("s").alias("t")))
    area = F.sum(F.col("pos") * (F.col("total_neg") - F.col("run_neg") + F.col("neg") / 2)) / (F.max("total_pos") * F.max("total_neg"))
    found = both.groupBy(*keys).agg(best.alias("b"), area.alias("a")).select(*keys, F.col("b.eer").alias("e"), F.col("b.t").alias("threshold"), "a")
    joined = _join_all(sizes, found, keys)
    return joined.select(*keys, "n", "n_pos", F.round(F.coalesce("e", F.lit(0.5)), digits).alias("eer"), "threshold", F.round(F.coalesce("a", F.lit(0.5)), digits).alias("auc"))


def _join_all(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on the keys; of two one-row frames if there are none."""
    if keys:
        return left.join(right, list(keys), "left")
    return left.withColumn("__k", F.lit(0)).join(right.withColumn("__k", F.lit(0)), "__k", "left").drop("__k")


#: Heads: name -> (label, score, presence column or None). Component heads count present rows only.
HEADS = {
    "file": ("y_file", "file_fake", None),
    "voice": ("y_voice", "voice_fake", "y_vp"),
    "music": ("y_music", "music_fake", "y_mp"),
    "vp": ("y_vp", "voice_present", None),
    "mp": ("y_mp", "music_present", None),
}


def composite(df: DataFrame, keys: Sequence[str], heads: Mapping = HEADS, digits: int = DIGITS) -> DataFrame:
    """(keys, file_eer, voice_eer, music_eer, voice_auc, music_auc, ads, cps, total) in one pass over long rows."""
    keys = list(keys)
    rows = F.array(*(F.struct(F.lit(h).alias("head"), F.col(y).cast("int").alias("y"), F.col(s).cast("double").alias("s"), (F.lit(1) if p is None else F.col(p).cast("int")).alias("p")) for h, (y, s, p) in heads.items()))
    long = df.select(*keys, F.inline(rows)).where("p = 1")
    each = rank_metrics(long, [*keys, "head"], "y", "s", digits=15)
    pick = lambda head, m: F.coalesce(F.max(F.when(F.col("head") == head, F.col(m))), F.lit(0.5))
    wide = each.groupBy(*keys).agg(pick("file", "eer").alias("file_eer"), pick("voice", "eer").alias("voice_eer"), pick("music", "eer").alias("music_eer"), pick("vp", "auc").alias("voice_auc"), pick("mp", "auc").alias("music_auc"))
    ads = 0.5 * (1 - F.col("file_eer")) + 0.2 * (1 - F.col("voice_eer")) + 0.3 * (1 - F.col("music_eer"))
    cps = 0.5 * (F.col("voice_auc") + F.col("music_auc"))
    out = wide.withColumns({"ads": ads, "cps": cps, "total": 0.9 * ads + 0.1 * cps})
    return out.select(*keys, *(F.round(c, digits).alias(c) for c in ("file_eer", "voice_eer", "music_eer", "voice_auc", "music_auc", "ads", "cps", "total")))


def robust(df: DataFrame, keys: Sequence[str], value: str, mean_weight: float = 0.7, worst_weight: float = 0.3, digits: int = DIGITS) -> DataFrame:
    """(keys, objective): weighted mean and minimum of a per-fold value."""
    return df.groupBy(*keys).agg(F.round(mean_weight * F.avg(value) + worst_weight * F.min(value), digits).alias("objective"))


def domain_summary(df: DataFrame, keys: Sequence[str], domain: str, unseen: str, digits: int = DIGITS) -> DataFrame:
    """Summary and robust objective over domains; columns total and ads, one row a domain."""
    agg = df.groupBy(*keys).agg(
        F.avg("total").alias("mean_total"), F.min("total").alias("worst_total"), F.max(F.when(F.col(domain) == unseen, F.col("total"))).alias("unseen"), F.avg("ads").alias("mean_ads")
    )
    agg = agg.withColumn("unseen_total", F.coalesce("unseen", "mean_total")).drop("unseen")
    objective = 0.35 * F.col("mean_total") + 0.25 * F.col("worst_total") + 0.2 * F.col("unseen_total") + 0.2 * F.col("mean_ads")
    checkpoint = 0.55 * F.col("mean_total") + 0.25 * F.col("worst_total") + 0.2 * F.col("unseen_total")
    out = agg.withColumns({"robust_objective": objective, "checkpoint_score": checkpoint})
    return out.select(*keys, *(F.round(c, digits).alias(c) for c in ("mean_total", "worst_total", "unseen_total", "mean_ads", "robust_objective", "checkpoint_score")))


def threshold_stats(df: DataFrame, keys: Sequence[str], label: str, score: str, threshold: Column | float = 0.5, digits: int = DIGITS) -> DataFrame:
    """Confusion counts and rates at a threshold."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    y, p = F.col(label) == 1, F.col(score) >= t
    agg = df.groupBy(*keys).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    rate = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b)), digits)
    right = F.round((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), digits)
    return agg.select(*keys, "tp", "fp", "fn", "tn", rate("tp", "fn").alias("recall"), rate("fn", "tp").alias("fnr"), rate("tn", "fp").alias("specificity"), right.alias("accuracy"))


def breakdown(df: DataFrame, dimensions: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """One block of rows a dimension, by grouping sets: (dimension, value, measures)."""
    names = list(dimensions)
    grouped = df.groupingSets([[F.col(d)] for d in names], *(F.col(d) for d in names)).agg(F.grouping_id().alias("__g"), *(c.alias(k) for k, c in measures.items()))
    which, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    full = (1 << len(names)) - 1
    for i, d in enumerate(names):
        own = F.col("__g") == full ^ (1 << (len(names) - 1 - i))
        which = F.when(own, F.lit(d)).otherwise(which)
        value = F.when(own, F.coalesce(F.col(d).cast("string"), F.lit("NULL"))).otherwise(value)
    return grouped.select(which.alias("dimension"), value.alias("value"), *measures)


def quantile_report(df: DataFrame, keys: Sequence[str], column: str, digits: int = DIGITS) -> DataFrame:
    """Count, mean, population deviation, exact linear quantiles."""
    q = F.percentile(column, F.array(*(F.lit(x) for x in (0.05, 0.5, 0.95, 0.99))))
    agg = df.groupBy(*keys).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.min(column).alias("least"), F.max(column).alias("most"), q.alias("q"))
    cols = {"mean": F.col("mean"), "std": F.col("std"), "least": F.col("least"), "most": F.col("most"), "p05": F.col("q")[0], "median": F.col("q")[1], "p95": F.col("q")[2], "p99": F.col("q")[3]}
    return agg.select(*keys, "n", *(F.round(c, digits).alias(k) for k, c in cols.items()))


def distribution(df: DataFrame, keys: Sequence[str], value: str, lower_is_better: bool = False, digits: int = DIGITS) -> DataFrame:
    """Mean, median, tails and share of strict wins of replicate differences."""
    win = F.col(value) < 0 if lower_is_better else F.col(value) > 0
    q = F.percentile(value, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    agg = df.groupBy(*keys).agg(F.avg(value).alias("mean"), q.alias("q"), F.avg(win.cast("double")).alias("win_rate"))
    return agg.select(*keys, *(F.round(c, digits).alias(k) for k, c in {"mean": F.col("mean"), "median": F.col("q")[1], "p05": F.col("q")[0], "p95": F.col("q")[2], "win_rate": F.col("win_rate")}.items()))


def ks_statistic(df: DataFrame, keys: Sequence[str], side: Column, value: str, digits: int = DIGITS) -> DataFrame:
    """(keys, n_a, n_b, ks): greatest distance of the distributions of `value` where `side` is true and false."""
    points = df.where(F.col(value).isNotNull() & side.isNotNull()).groupBy(*keys, value).agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b"))
    run = with_running(points, keys, value, ["a", "b"], descending=False)
    gap = F.max(F.abs(F.try_divide(F.col("run_a").cast("double"), F.col("total_a")) - F.try_divide(F.col("run_b").cast("double"), F.col("total_b"))))
    return run.groupBy(*keys).agg(F.max("total_a").alias("n_a"), F.max("total_b").alias("n_b"), F.round(gap, digits).alias("ks"))


def column_diff(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str], digits: int = DIGITS) -> DataFrame:
    """(column, n, mean_abs, max_abs, exact): how two versions of the same columns differ, row by row of `key`.

    n counts the rows that both have; a row that only one of them has makes no column exact.
    """
    pairs = left.withColumn("__l", F.lit(True)).alias("l").join(right.withColumn("__r", F.lit(True)).alias("r"), F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}")), "full")
    pairs = pairs.withColumn("__both", F.coalesce(F.col("l.__l") & F.col("r.__r"), F.lit(False)))
    rows = F.array(*(F.struct(F.col("__both").alias("both"), F.lit(c).alias("column"), F.col(f"l.{c}").cast("double").alias("a"), F.col(f"r.{c}").cast("double").alias("b")) for c in columns))
    gap = F.abs(F.col("a") - F.col("b"))
    return pairs.select(F.inline(rows)).groupBy("column").agg(F.count_if("both").alias("n"), F.round(F.avg(F.when(F.col("both"), gap)), digits).alias("mean_abs"), F.round(F.max(F.when(F.col("both"), gap)), digits).alias("max_abs"), F.bool_and(F.col("both") & F.col("a").eqNullSafe(F.col("b"))).alias("exact"))


def frame_hash(df: DataFrame, keys: Sequence[str], line: Column, order: Sequence[str], block: Column) -> DataFrame:
    """Identity of an ordered selection: SHA-256 over block digests in block order.

    Blocks (a monotone function of the order) keep every collected list bounded; their digests are hashed in turn.
    """
    parts = df.select(*keys, block.alias("__block"), F.struct(*order, line.alias("__line")).alias("x"))
    blocks = parts.groupBy(*keys, "__block").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["__line"]), "\n"), 256).alias("d"), F.count(F.lit(1)).alias("m"))
    return blocks.groupBy(*keys).agg(F.sum("m").alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__block", "d"))), lambda x: x["d"]), "\n"), 256).alias("digest"))


def no_regression(df: DataFrame, keys: Sequence[str], domain: str, value: str, baseline: Mapping[str, str], lower_is_better: bool, slack: float = 1e-12) -> DataFrame:
    """(keys, ok): whether each candidate is nowhere worse than the baseline's value in the same domain."""
    match = F.lit(True)
    for k, v in baseline.items():
        match = match & (F.col(k) == v)
    base = df.where(match).select(domain, F.col(value).alias("__base"))
    fine = F.col(value) <= F.col("__base") + slack if lower_is_better else F.col(value) >= F.col("__base") - slack
    return df.join(base, domain).groupBy(*keys).agg(F.bool_and(fine).alias("ok"))


def rank_in(keys: Sequence[str], *order: Column) -> Column:
    return F.row_number().over(W.partitionBy(*keys).orderBy(*order))


#: Weights of the six terms of the precommitted objective.
OBJECTIVE = {"mean_total": 0.25, "worst_total": 0.15, "unseen_voice": 0.15, "unseen_music": 0.15, "calibration_old": 0.15, "calibration_new": 0.15}


def precommitted_objective(terms: Mapping[str, Column], weights: Mapping[str, float] = OBJECTIVE) -> Column:
    """Weighted sum of the terms; unseen_voice and unseen_music are 1 - error rate on the unseen domain."""
    if set(terms) != set(weights):
        raise ValueError(f"the objective needs exactly {sorted(weights)}")
    out = F.lit(0.0)
    for k, w in weights.items():
        out = out + w * terms[k]
    return out


def checkpoint_score(eer: Column, auc: Column) -> Column:
    """A component's responsibility-aware score."""
    return 0.8 * (1 - eer) + 0.2 * auc
