"""Segment scores to item scores: expressions over arrays of doubles. Empty arrays give null."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.functions.scores import clamp, logit, sigmoid


def array_mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(xs), F.lit(0))


def top(xs: Column, k: int) -> Column:
    return F.slice(F.sort_array(xs, asc=False), 1, k)


def median(xs: Column) -> Column:
    s, n = F.sort_array(xs), F.size(xs)
    half = (n / 2).cast("int")
    return F.when(n % 2 == 1, F.get(s, half)).otherwise((F.get(s, half - 1) + F.get(s, half)) / 2)


def _in_logits(xs: Column) -> Column:
    """The mean taken in the log-odds domain."""
    return sigmoid(array_mean(F.transform(xs, lambda x: logit(clamp(x)))))


def _without_extremes(xs: Column) -> Column:
    inner = F.slice(F.sort_array(xs), F.lit(2), F.greatest(F.size(xs) - 2, F.lit(0)))
    return array_mean(F.when(F.size(xs) > 2, inner).otherwise(xs))


def _any_of(xs: Column) -> Column:
    """One minus the chance that no segment fires."""
    return 1 - F.aggregate(xs, F.lit(1.0), lambda rest, x: rest * (1 - clamp(x, 0.0, 1.0)))


def _by_distance_from_half(xs: Column) -> Column:
    weight = lambda x: F.abs(x - 0.5) + 0.1
    sums = F.aggregate(xs, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")), lambda a, x: F.struct((a["s"] + x * weight(x)).alias("s"), (a["w"] + weight(x)).alias("w")))
    return sums["s"] / sums["w"]


#: Name -> expression of (scores, k).
METHODS: dict[str, Callable[[Column, int], Column]] = {
    "attention": lambda xs, k: _by_distance_from_half(xs),
    "logit_mean": lambda xs, k: _in_logits(xs),
    "logit_topk_mean": lambda xs, k: _in_logits(top(xs, k)),
    "max": lambda xs, k: F.array_max(xs),
    "mean": lambda xs, k: array_mean(xs),
    "median": lambda xs, k: median(xs),
    "noisy_or": lambda xs, k: _any_of(xs),
    "topk_mean": lambda xs, k: array_mean(top(xs, k)),
    "trimmed_mean": lambda xs, k: _without_extremes(xs),
}
#: A family with a parameter: a blend of maximum and mean, with the share of the maximum in its name.
BLEND = re.compile(r"max_mean_(?P<share>\d*\.?\d+)")


def known_method(name: str) -> bool:
    found = BLEND.fullmatch(name)
    return name in METHODS or bool(found) and float(found["share"]) <= 1


def aggregator(method: str, xs: Column, top_k: int = 2) -> Column:
    """Any of METHODS, or max_mean_<share of the maximum, 0 to 1>."""
    if not known_method(method):
        raise ValueError(f"no such aggregation: {method}; known are {', '.join(METHODS)} and max_mean_<share>")
    if method in METHODS:
        return METHODS[method](xs, top_k)
    share = float(BLEND.fullmatch(method)["share"])
    return share * F.array_max(xs) + (1 - share) * array_mean(xs)


#: What each head may be aggregated by; the first is its default.
ALLOWED = {
    "file_fake": ("topk_mean", "max", "mean", "logit_topk_mean", "noisy_or"),
    "voice_fake": ("topk_mean", "max", "mean", "logit_topk_mean", "logit_mean", "median", "trimmed_mean", "max_mean_0.25", "max_mean_0.5", "max_mean_0.75"),
    "music_fake": ("topk_mean", "max", "mean", "logit_topk_mean"),
    "voice_present": ("mean", "max", "noisy_or"),
    "music_present": ("mean", "max", "noisy_or"),
}


def head_aggregator(head: str, xs: Column, config: dict | None = None) -> Column:
    choice = (config or {}).get(f"{head}_aggregation")
    if choice is not None and choice not in ALLOWED[head]:
        raise ValueError(f"{head} takes {ALLOWED[head]}, not {choice}")
    return aggregator(choice or ALLOWED[head][0], xs)
