import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.operators import metrics
from quillframe.operators.prefix import with_running


def roc_eer(y, s):
    """Independent definition: first point of the descending ROC with the least gap."""
    y, s = np.asarray(y), np.asarray(s, float)
    best = None
    for t in sorted(set(s), reverse=True):
        fpr, fnr = (s[y == 0] >= t).mean(), (s[y == 1] < t).mean()
        if best is None or abs(fpr - fnr) < best[0] - 1e-12:
            best = (abs(fpr - fnr), (fpr + fnr) / 2)
    return best[1]


def pair_auc(y, s):
    p, n = [a for a, b in zip(s, y, strict=True) if b], [a for a, b in zip(s, y, strict=True) if not b]
    return sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n))


def frame(spark, y, s, g=0):
    return spark.createDataFrame([(g, int(a), None if b is None else float(b)) for a, b in zip(y, s, strict=True)], "g int, y int, s double")


def test_eer_and_auc_with_ties(spark):
    y, s = [1, 0, 0, 1, 0, 1, 1, 0, 0, 1, 0], [0.6, 0.6, 0.1, 0.95, 0.3, 0.3, 0.7, 0.2, 0.85, 0.4, 0.4]
    r = metrics.rank_metrics(frame(spark, y, s), ["g"], "y", "s").first()
    assert r.eer == pytest.approx(roc_eer(y, s)) and r.auc == pytest.approx(pair_auc(y, s))


def test_random_against_definition(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for g in range(6):
        y, s = rng.integers(0, 2, 300), np.round(rng.random(300), 2)
        want[g] = (roc_eer(y, s), pair_auc(y.tolist(), s.tolist()))
        rows += [(g, int(a), float(b)) for a, b in zip(y, s, strict=True)]
    df = spark.createDataFrame(rows, "g int, y int, s double")
    for r in metrics.rank_metrics(df, ["g"], "y", "s").collect():
        assert (r.eer, r.auc) == pytest.approx(want[r.g], abs=1e-9)


def test_one_class_and_nonfinite(spark):
    df = frame(spark, [1, 1, 0], [0.2, 0.3, float("nan")])
    r = metrics.rank_metrics(df, ["g"], "y", "s").first()
    assert (r.eer, r.auc, r.n) == (0.5, 0.5, 2)


def test_running_sums_do_not_depend_on_buckets(spark):
    df = spark.range(500).select(F.lit("k").alias("k"), F.col("id").alias("s"), (F.col("id") % 7).alias("v"))
    for buckets in (2, 16, 64):
        got = {r.s: r.run_v for r in with_running(df, ["k"], "s", ["v"], buckets).collect()}
        assert all(got[s] == sum(i % 7 for i in range(s, 500)) for s in (0, 3, 250, 499))


def test_running_sums_whose_cuts_differ_between_evaluations(spark, monkeypatch):
    # Approximate quantiles depend on the order in which executors' partitions arrive: here they are as unlike as can be.
    monkeypatch.setattr(F, "percentile_approx", lambda order, *_: F.array(F.expr("cast(java_method('java.lang.Math', 'random') as double) * 100")))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        rows = with_running(spark.range(100).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("s"), F.lit(1).alias("v")), ["k"], "s", ["v"], descending=False).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert sorted((r.s, r.run_v, r.total_v) for r in rows) == [(float(i), i + 1, 100) for i in range(100)]


def test_conditional_component_error(spark):
    rows = [(1, 1, 0, 1, 0, 0.9, 0.8, 0.1, 0.9, 0.2), (0, 0, 0, 1, 1, 0.2, 0.3, 0.2, 0.8, 0.7), (1, 1, 1, 0, 1, 0.8, 0.0, 0.9, 0.1, 0.9), (0, 0, 0, 0, 0, 0.1, 0.99, 0.95, 0.2, 0.1)]
    cols = ["y_file", "y_voice", "y_music", "y_vp", "y_mp", "file_fake", "voice_fake", "music_fake", "voice_present", "music_present"]
    r = metrics.composite(spark.createDataFrame(rows, cols).withColumn("k", F.lit(1)), ["k"]).first()
    assert r.file_eer == 0 and r.voice_eer == 0 and r.music_eer == 0 and r.total == pytest.approx(1.0)
