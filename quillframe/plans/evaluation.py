"""Queries over scores: metrics, breakdowns, fusion, search, bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions import scores
from quillframe.functions.hashing import hashed_index
from quillframe.operators import joins, metrics, sampling, search
from quillframe.plans.base import FEATURES, RAW_HEADS, features, labelled, query, sql_composite, sql_index, sql_rank, sql_uniform, table

_BY_LANG = "s as (select lang, quality y, n_chars::double s from lab)"


@query(f"with {FEATURES}, {_BY_LANG} select lang, n, n_pos, eer from {sql_rank('s', ['lang'])}")
def q01_eer_by_lang(spark, sf_dir):
    return metrics.rank_metrics(labelled(spark, sf_dir), ["lang"], "quality", "n_chars").select("lang", "n", "n_pos", "eer")


@query(f"with {FEATURES}, {_BY_LANG} select lang, n, auc from {sql_rank('s', ['lang'])}")
def q02_auc_by_lang(spark, sf_dir):
    return metrics.rank_metrics(labelled(spark, sf_dir), ["lang"], "quality", "n_chars").select("lang", "n", "auc")


@query(f"with {FEATURES} select * from {sql_composite('features', ['lang'], RAW_HEADS)}")
def q03_composite(spark, sf_dir):
    return metrics.composite(features(spark, sf_dir), ["lang"], RAW_HEADS)


@query(
    f"""with {FEATURES}, s as (select lang, y_file y, df s from features), e as (select * from {sql_rank("s", ["lang"])}),
c as (select s.lang, count(*) filter (y = 1 and s >= threshold) tp, count(*) filter (y = 0 and s >= threshold) fp, count(*) filter (y = 1 and s < threshold) fn, count(*) filter (y = 0 and s < threshold) tn from s join e using (lang) group by s.lang)
select lang, eer, threshold, tp, fp, fn, tn, round(tp::double / (tp + fn), 9) recall, round(fn::double / (tp + fn), 9) fnr, round(tn::double / nullif(tn + fp, 0), 9) specificity, round((tp + tn)::double / (tp + fp + fn + tn), 9) accuracy
from c join e using (lang)"""
)
def q04_operating_point(spark, sf_dir):
    rows = features(spark, sf_dir)
    point = metrics.rank_metrics(rows, ["lang"], "y_file", "df").select("lang", "eer", "threshold")
    return metrics.threshold_stats(rows.join(point, "lang"), ["lang"], "y_file", "df", F.col("threshold")).join(point, "lang")


_BUCKET = "case when n_chars <= 500 then 'short' when n_chars <= 2000 then 'middle' else 'long' end"


@query(
    f"""with {FEATURES}, f as (select *, {_BUCKET} bucket from features)
select case when grouping(lang) = 0 then 'lang' when grouping(source) = 0 then 'source' else 'bucket' end as dimension, coalesce(lang, source, bucket) as value,
  count(*) n, count(*) filter (y_file = 0 and df >= 0.5e0) fp, count(*) filter (y_file = 1 and df < 0.5e0) fn, round(avg(df), 9) mean_score
from f group by grouping sets ((lang), (source), (bucket))"""
)
def q05_error_breakdown(spark, sf_dir):
    bucket = F.when(F.col("n_chars") <= 500, "short").when(F.col("n_chars") <= 2000, "middle").otherwise("long")
    high = F.col("df") >= 0.5
    measures = {"n": F.count(F.lit(1)), "fp": F.count_if((F.col("y_file") == 0) & high), "fn": F.count_if((F.col("y_file") == 1) & ~high), "mean_score": F.round(F.avg("df"), 9)}
    return metrics.breakdown(features(spark, sf_dir).withColumn("bucket", bucket), ["lang", "source", "bucket"], measures)


@query(f"with {FEATURES}, c as (select * from {sql_composite('features', ['fold'], RAW_HEADS, 15)}) select 'all' scope, round(0.7e0 * avg(total) + 0.3e0 * min(total), 9) objective from c")
def q06_fold_robust_score(spark, sf_dir):
    folds = metrics.composite(features(spark, sf_dir), ["fold"], RAW_HEADS, digits=15)
    return metrics.robust(folds.withColumn("scope", F.lit("all")), ["scope"], "total")


@query(
    f"""with {FEATURES}, c as (select * from {sql_composite("features", ["domain"], RAW_HEADS, 15)}),
a as (select avg(total) m, min(total) w, max(case when domain = 'val_b' then total end) u, avg(ads) s from c)
select 'all' scope, round(m, 9) mean_total, round(w, 9) worst_total, round(u, 9) unseen_total, round(s, 9) mean_ads, round(0.35e0 * m + 0.25e0 * w + 0.2e0 * u + 0.2e0 * s, 9) robust_objective, round(0.55e0 * m + 0.25e0 * w + 0.2e0 * u, 9) checkpoint_score from a"""
)
def q07_domain_summary(spark, sf_dir):
    each = metrics.composite(features(spark, sf_dir), ["domain"], RAW_HEADS, digits=15).withColumn("scope", F.lit("all"))
    return metrics.domain_summary(each, ["scope"], "domain", "val_b")


_E = 1e-6
_CL = lambda x: f"least(greatest({x}, {_E!r}::double), {1 - _E!r}::double)"


def _logit(x: str) -> str:
    return f"ln({x} / (1 - {x}))"


_BLENDS = {
    "probability": "(1 - 0.3e0) * b + 0.3e0 * c",
    "logit": f"1 / (1 + exp(-least(greatest((1 - 0.3e0) * {_logit('b')} + 0.3e0 * {_logit('c')}, -40e0), 40e0)))",
    "max": "greatest(b, c)",
    "rank": "(1 - 0.3e0) * rb + 0.3e0 * rc",
}


@query(
    f"""with {FEATURES}, x as (select doc_id, {_CL("vf")} b, {_CL("mf")} c,
  (rank() over (order by vf) + (count(*) over (partition by vf) - 1) / 2e0) / (count(*) over () + 1) rb, (rank() over (order by mf) + (count(*) over (partition by mf) - 1) / 2e0) / (count(*) over () + 1) rc from features)
select doc_id, {", ".join(f"round({_CL(v)}, 9) blend_{k}" for k, v in _BLENDS.items())}, round(b, 9) blend_none from x"""
)
def q52_blend_methods(spark, sf_dir):
    rows = features(spark, sf_dir).select("doc_id", "vf", "mf")
    rows = scores.with_rank_probability(scores.with_rank_probability(rows, "vf", "rb"), "mf", "rc")
    b, c = F.col("vf"), F.col("mf")
    blends = {k: scores.blend(b, c, 0.3, k, F.col("rb"), F.col("rc")) for k in ("probability", "logit", "max", "rank")}
    return rows.select("doc_id", *(F.round(v, 9).alias(f"blend_{k}") for k, v in blends.items()), F.round(scores.blend(b, c, 0.0, "rank"), 9).alias("blend_none"))


#: Weights of the fusion queries; the costly detector has a say in components here.
POLICY = {"w_df_voice_component": 0.2, "w_df_music_component": 0.1}


def _sql_fused(mode: str, used: str = "true", extra: str = "", wdf: str = "0.5e0") -> str:
    """(features columns kept, file_fake, ...) of fused heads; NaN does not occur in features."""
    detector = {
        "legacy": "0.5e0 * vfile + 0.3e0 * mfile + 0.2e0 * (1 - (1 - v) * (1 - m))",
        "presence_weighted": "0.5e0 * p * vfile + 0.3e0 * q * mfile + 0.2e0 * (1 - (1 - p * v) * (1 - q * m))",
        "presence_component_or": "1 - (1 - p * v) * (1 - q * m)",
    }[mode]
    return f"""(select * exclude (v, m, p, q, d), {_CL(f"{wdf} * d + (1 - {wdf}) * ({detector})")} file_fake, {_CL("v")} voice_fake, {_CL("m")} music_fake, {_CL("p")} voice_present, {_CL("q")} music_present from (
  select *, wv * d + (1 - wv) * vf v, wm * d + (1 - wm) * mf m, 0.6e0 * vp_panns + 0.4e0 * vp_model p, 0.6e0 * mp_panns + 0.4e0 * mp_model q from (
    select *, case when {used} then df else 0.5e0 end d, case when {used} then 0.2e0 else 0e0 end wv, case when {used} then 0.1e0 else 0e0 end wm{extra} from features)))"""


@query(" union all ".join(f"select doc_id, '{m}' as mode, round(file_fake, 9) file_fake, round(voice_fake, 9) voice_fake, round(music_fake, 9) music_fake, round(voice_present, 9) voice_present, round(music_present, 9) music_present from (with {FEATURES} select * from {_sql_fused(m)})" for m in scores.MODES))
def q53_fusion_modes(spark, sf_dir):
    rows = features(spark, sf_dir)
    modes = F.array(*(F.struct(F.lit(m).alias("mode"), *(F.round(c, 9).alias(k) for k, c in scores.fuse({**POLICY, "file_fusion_mode": m}).items())) for m in scores.MODES))
    return rows.select("doc_id", F.inline(modes))


_GATES = {
    "off": "true",
    "voice_presence": "vp_model >= 0.8e0",
    "any_presence": "greatest(vp_model, mp_model) >= 0.8e0",
    "specialist_uncertainty": "(0.5e0 * vfile + 0.5e0 * mfile > 0.2e0 and 0.5e0 * vfile + 0.5e0 * mfile < 0.8e0)",
    "presence_or_uncertainty": "greatest(vp_model, mp_model) >= 0.8e0 or (0.5e0 * vfile + 0.5e0 * mfile > 0.2e0 and 0.5e0 * vfile + 0.5e0 * mfile < 0.8e0)",
}


@query(f"with {FEATURES} " + " union all ".join(f"select '{k}' as policy, count(*) n, count(*) filter ({v}) executed, round(avg(case when {v} then df else 0.5e0 end), 9) mean_df from features" for k, v in _GATES.items()))
def q54_gate_policies(spark, sf_dir):
    rows = F.array(*(F.struct(F.lit(p).alias("policy"), scores.gate(p).alias("ran")) for p in _GATES))
    long = features(spark, sf_dir).select("df", F.inline(rows))
    return long.groupBy("policy").agg(F.count(F.lit(1)).alias("n"), F.count_if("ran").alias("executed"), F.round(F.avg(F.when(F.col("ran"), F.col("df")).otherwise(0.5)), 9).alias("mean_df"))


_SPREAD = "greatest(df_primary, vf, mf) - least(df_primary, vf, mf) >= 0.3e0"
_UNSURE = f"(df_primary > 0.25e0 and df_primary < 0.75e0) or (vf > 0.3e0 and vf < 0.7e0) or (mf > 0.3e0 and mf < 0.7e0) or {_SPREAD}"


@query(
    f"""with {FEATURES}, u as (select *, duration_sec >= 12e0 and df_primary > 0.25e0 and df_primary < 0.75e0 one, duration_sec >= 12e0 and ({_UNSURE}) anyone from features)
select doc_id, one, anyone, round(case when one and df_second is not null then (df_primary + df_second) / 2e0 else df_primary end, 9) mean_score,
  round(case when anyone and df_second is not null then greatest(df_primary, df_second) else df_primary end, 9) max_score,
  round(case when anyone and df_second is not null then 1 / (1 + exp(-(({_logit(_CL("df_primary"))}) + ({_logit(_CL("df_second"))})) / 2)) else df_primary end, 9) logit_score from u"""
)
def q55_second_crop(spark, sf_dir):
    one, anyone = scores.second_crop(), scores.second_crop("any_uncertain_disagreement")
    merged = {"mean_score": scores.with_second_crop(one, "mean"), "max_score": scores.with_second_crop(anyone, "max"), "logit_score": scores.with_second_crop(anyone, "logit_mean")}
    return features(spark, sf_dir).select("doc_id", one.alias("one"), anyone.alias("anyone"), *(F.round(c, 9).alias(k) for k, c in merged.items()))


HEADS = metrics.HEADS
_WDF = (0.0, 0.25, 0.5, 0.75)
_MODE_IDS = dict(enumerate(scores.MODES))


def _sql_grid() -> str:
    parts = " union all ".join(f"select '{m}:{w}' as policy, fold, y_file, y_voice, y_music, y_vp, y_mp, file_fake, voice_fake, music_fake, voice_present, music_present from {_sql_fused(m, wdf=f'{w}::double')}" for m in scores.MODES for w in _WDF)
    return f"with {FEATURES}, g as ({parts}), c as (select * from {sql_composite('g', ['policy', 'fold'], HEADS, 15)}), o as (select policy, round(0.7e0 * avg(total) + 0.3e0 * min(total), 9) objective from c group by policy)"


def grid_objective(spark, sf_dir):
    """(policy, objective) of all fusion modes and detector weights in one job."""
    points = spark.createDataFrame([(f"{m}:{w}", m, w) for m in scores.MODES for w in _WDF], "policy string, mode string, w double")
    rows = search.over_grid(features(spark, sf_dir), points)
    heads = scores.with_fused(rows, {**POLICY, "file_fusion_mode": F.col("mode"), "w_df_arena": F.col("w")})
    return metrics.robust(metrics.composite(heads, ["policy", "fold"], digits=15), ["policy"], "total")


@query(_sql_grid() + " select policy, objective, (row_number() over (order by objective desc, policy))::bigint place from o")
def q56_grid_objective(spark, sf_dir):
    from pyspark.sql import Window as W

    return grid_objective(spark, sf_dir).withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("objective"), "policy")).cast("bigint"))


_THRESHOLDS = (0.3, 0.5, 0.6, 0.7, 0.8)


def gate_objectives(spark, sf_dir):
    """(policy, fraction, objective) of presence gates at several thresholds, and of no gate."""
    points = spark.createDataFrame([("off", -1.0), *((f"vp{t}", t) for t in _THRESHOLDS)], "policy string, least double")
    rows = search.over_grid(features(spark, sf_dir), points).withColumn("ran", F.col("vp_model") >= F.col("least"))
    long = scores.with_fused(rows, POLICY, F.col("ran"))
    cost = long.groupBy("policy").agg(F.round(F.avg(F.col("ran").cast("double")), 9).alias("fraction"))
    return metrics.robust(metrics.composite(long, ["policy", "fold"], digits=15), ["policy"], "total").join(cost, "policy")


_GATED = " union all ".join(
    f"select '{k}' as policy, {v} ran, fold, y_file, y_voice, y_music, y_vp, y_mp, file_fake, voice_fake, music_fake, voice_present, music_present from {_sql_fused('legacy', v)}" for k, v in {"off": "true", **{f"vp{t}": f"vp_model >= {t}::double" for t in _THRESHOLDS}}.items()
)


@query(
    f"""with {FEATURES}, g as ({_GATED}), c as (select * from {sql_composite("g", ["policy", "fold"], HEADS, 15)}), o as (select policy, round(0.7e0 * avg(total) + 0.3e0 * min(total), 9) objective from c group by policy),
k as (select policy, round(avg(ran::int), 9) fraction from g group by policy), b as (select unnest([0.0e0, 0.005e0, 0.01e0, 0.05e0]) budget),
f as (select budget, policy, fraction, objective, row_number() over (partition by budget order by fraction, objective desc, policy) rn from o join k using (policy) cross join b where objective >= (select max(objective) from o) - budget)
select budget, policy, fraction, objective from f where rn = 1"""
)
def q57_frontier(spark, sf_dir):
    return search.frontier(gate_objectives(spark, sf_dir), (0.0, 0.005, 0.01, 0.05), "fraction", "objective", "policy")


@query(
    _sql_grid()
    + ", l as (select policy, objective from o where policy like 'legacy%' order by objective desc, policy limit 5), p as (select policy, objective from o where policy not like 'legacy%' order by objective desc, policy limit 5)"
    + ' select l.policy as "left", p.policy as "right", round((l.objective + p.objective) / 2, 9) joint from l, p'
)
def q58_top5_joint(spark, sf_dir):
    from quillframe.sources.durable import durable

    rated = durable(grid_objective(spark, sf_dir), "grid-objective")
    legacy = F.col("policy").startswith("legacy")
    return search.joint_top(rated.where(legacy), rated.where(~legacy), "objective", "policy", 5)


_PER_DOMAIN = " union all ".join(f"select '{m}' as policy, domain, y_file, y_voice, y_music, y_vp, y_mp, file_fake, voice_fake, music_fake, voice_present, music_present from {_sql_fused(m)}" for m in scores.MODES)


@query(
    f"""with {FEATURES}, g as ({_PER_DOMAIN}), c as (select * from {sql_composite("g", ["policy", "domain"], HEADS)}), b as (select domain, total, file_eer from c where policy = 'legacy')
select policy, bool_and(c.total >= b.total - 1e-12) total_ok, bool_and(c.file_eer <= b.file_eer + 1e-12) file_ok from c join b using (domain) group by policy"""
)
def q59_no_regression(spark, sf_dir):
    from quillframe.sources.durable import durable

    points = spark.createDataFrame([(m,) for m in scores.MODES], "policy string")
    rows = scores.with_fused(search.over_grid(features(spark, sf_dir), points), {**POLICY, "file_fusion_mode": F.col("policy")})
    each = durable(metrics.composite(rows, ["policy", "domain"]), "no-regression")
    total = metrics.no_regression(each, ["policy"], "domain", "total", {"policy": "legacy"}, False).withColumnRenamed("ok", "total_ok")
    return total.join(metrics.no_regression(each, ["policy"], "domain", "file_eer", {"policy": "legacy"}, True).withColumnRenamed("ok", "file_ok"), "policy")


REPLICATES = 50


def _weighted_eer(df, keys, label, score):
    """Equal error rate of rows that count `times`."""
    from quillframe.operators.prefix import with_running

    points = df.groupBy(*keys, score).agg(F.sum(F.when(F.col(label) == 1, F.col("times")).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) != 1, F.col("times")).otherwise(0)).alias("neg"))
    roc = with_running(points, keys, score, ["pos", "neg"], buckets=2)
    fpr, fnr = F.col("run_neg") / F.col("total_neg"), 1 - F.col("run_pos") / F.col("total_pos")
    best = F.min(F.struct(F.abs(fpr - fnr).alias("d"), (-F.col(score)).alias("o"), ((fpr + fnr) / 2).alias("e")))
    return roc.where("total_pos > 0 and total_neg > 0").groupBy(*keys).agg(best["e"].alias("eer"))


def _boot(score: str) -> str:
    return f"(select b, eer from {sql_rank(f'(select b, y_file y, {score} s from boot)', ['b'], 15)})"


@query(
    f"""with {FEATURES}, rows_ as (select *, row_number() over (order by doc_id) - 1 ri, count(*) over () n from features),
idx as (select b, i, {sql_index("boot", "(select max(n) from rows_)", "b", "i")} ri from range({REPLICATES}) t(b), range((select max(n) from rows_)) u(i)),
boot as (select idx.b, r.y_file, r.df, r.vfile from idx join rows_ r using (ri)), d as (select x.b, y.eer - x.eer gain from {_boot("df")} x join {_boot("vfile")} y using (b))
select 'df_vs_vfile' as pair, round(avg(gain), 9) mean, round(median(gain), 9) median, round(quantile_cont(gain, 0.05), 9) p05, round(quantile_cont(gain, 0.95), 9) p95, round(avg((gain > 0)::int), 9) win_rate from d"""
)
def q60_bootstrap_distribution(spark, sf_dir):
    from quillframe.sources.durable import durable

    rows = features(spark, sf_dir).select("doc_id", "y_file", "df", "vfile")
    rows = durable(rows.withColumn("one", F.lit(1)), "bootstrap-rows")
    from quillframe.operators.prefix import with_running

    numbered = with_running(rows, [], "doc_id", ["one"], descending=False).select("doc_id", "y_file", "df", "vfile", (F.col("run_one") - 1).alias("ri"))
    drawn = durable(sampling.bootstrap_counts(numbered, "ri", rows.count(), REPLICATES, "boot"), "bootstrap-draws")
    base, other = _weighted_eer(drawn, ["b"], "y_file", "df"), _weighted_eer(drawn, ["b"], "y_file", "vfile").withColumnRenamed("eer", "eer2")
    gain = base.join(other, "b").select(F.lit("df_vs_vfile").alias("pair"), (F.round("eer2", 15) - F.round("eer", 15)).alias("gain"))
    return metrics.distribution(gain, ["pair"], "gain")


@query(
    f"""with p as (select event_type, value s, count(*) filter (user_id % 2 = 0) a, count(*) filter (user_id % 2 <> 0) b from events where value is not null group by 1, 2),
r as (select *, sum(a) over (partition by event_type order by s rows unbounded preceding)::double ca, sum(b) over (partition by event_type order by s rows unbounded preceding)::double cb, sum(a) over (partition by event_type)::bigint ta, sum(b) over (partition by event_type)::bigint tb from p)
select event_type, max(ta) n_a, max(tb) n_b, round(max(abs(ca / ta - cb / tb)), 9) ks from r group by event_type"""
)
def q61_ks_statistic(spark, sf_dir):
    return metrics.ks_statistic(table(spark, sf_dir, "events"), ["event_type"], F.col("user_id") % 2 == 0, "value")


@query(
    """with l as (select l_orderkey * 10 + l_linenumber k, l_extendedprice, l_discount, l_tax, l_quantity from lineitem),
r as (select k, round(l_extendedprice, 0) l_extendedprice, l_discount, l_tax + 0.01e0 l_tax, l_quantity from l)
select unnest(['l_extendedprice', 'l_discount', 'l_tax']) as "column", count(*) n, unnest([round(avg(abs(l.l_extendedprice - r.l_extendedprice)), 6), round(avg(abs(l.l_discount - r.l_discount)), 6), round(avg(abs(l.l_tax - r.l_tax)), 6)]) mean_abs,
  unnest([round(max(abs(l.l_extendedprice - r.l_extendedprice)), 6), round(max(abs(l.l_discount - r.l_discount)), 6), round(max(abs(l.l_tax - r.l_tax)), 6)]) max_abs,
  unnest([bool_and(l.l_extendedprice = r.l_extendedprice), bool_and(l.l_discount = r.l_discount), bool_and(l.l_tax = r.l_tax)]) exact from l join r using (k)"""
)
def q62_column_diff(spark, sf_dir):
    left = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_extendedprice", "l_discount", "l_tax")
    right = left.withColumns({"l_extendedprice": F.round("l_extendedprice", 0), "l_tax": F.col("l_tax") + 0.01})
    return metrics.column_diff(left, right, "k", ["l_extendedprice", "l_discount", "l_tax"], digits=6)


@query(
    """with b as (select o_orderpriority, o_orderkey // 4096 blk, sha256(string_agg(o_orderkey || ',' || o_custkey || ',' || o_orderstatus, chr(10) order by o_orderkey)) d, count(*) m from orders group by 1, 2)
select o_orderpriority, sum(m)::bigint n, sha256(string_agg(d, chr(10) order by blk)) digest from b group by 1"""
)
def q63_frame_hash(spark, sf_dir):
    line = F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus")
    return metrics.frame_hash(table(spark, sf_dir, "orders"), ["o_orderpriority"], line, ["o_orderkey"], F.floor(F.col("o_orderkey") / 4096).cast("bigint"))


@query(
    """select l_returnflag, count(l_extendedprice) n, round(avg(l_extendedprice), 6) mean, round(stddev_pop(l_extendedprice), 6) std, round(min(l_extendedprice), 6) least, round(max(l_extendedprice), 6) most,
round(quantile_cont(l_extendedprice, 0.05), 6) p05, round(median(l_extendedprice), 6) median, round(quantile_cont(l_extendedprice, 0.95), 6) p95, round(quantile_cont(l_extendedprice, 0.99), 6) p99 from lineitem group by 1"""
)
def q66_quantile_report(spark, sf_dir):
    return metrics.quantile_report(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", digits=6)


_OPP = f"""with {FEATURES}, t as (select lang, source, min(quality) first from lab group by 1, 2),
e as (select t.lang, t.source target, f.quality y, f.vf s from t join features f on f.lang = t.lang and (f.source = t.source or f.quality <> t.first))"""


@query(f"{_OPP} select lang, target, n, n_pos, eer, auc from {sql_rank('e', ['lang', 'target'])}")
def q72_opposite_class_pairing(spark, sf_dir):
    pairs = joins.opposite_pairs(features(spark, sf_dir).select("lang", "source", "quality", "vf"), "lang", "source", "quality")
    return metrics.rank_metrics(pairs, ["lang", "target"], "quality", "vf").select("lang", "target", "n", "n_pos", "eer", "auc")


@query(
    f"""with {FEATURES}, v as (select *, 0.7e0 * (1 - abs(vf - y_voice)) quality_ from features), a as (select source, lang, avg(quality_) q from v group by 1, 2)
select source, round(0.6e0 * avg(q) + 0.4e0 * min(q), 9) objective from a group by 1"""
)
def q82_selection_robust(spark, sf_dir):
    each = features(spark, sf_dir).withColumn("q", 0.7 * (1 - F.abs(F.col("vf") - F.col("y_voice")))).groupBy("source", "lang").agg(F.avg("q").alias("q"))
    return metrics.robust(each, ["source"], "q", 0.6, 0.4)


@query(
    f"""with {FEATURES}, m as (select source, avg(abs(df - y_file)) file_eer, avg(abs(vf - y_voice)) voice_eer, 1 - avg(abs(df - y_file)) / 2 robust from features group by 1), b as (select * from m where source = 'src0')
select m.source, round(m.robust, 9) robust, m.robust > b.robust and m.file_eer - b.file_eer <= 0.02e0 and m.voice_eer - b.voice_eer <= 0.01e0 passes from m, b where m.source <> 'src0'"""
)
def q83_hard_gates(spark, sf_dir):
    each = features(spark, sf_dir).groupBy("source").agg(F.avg(F.abs(F.col("df") - F.col("y_file"))).alias("file_eer"), F.avg(F.abs(F.col("vf") - F.col("y_voice"))).alias("voice_eer"))
    each = each.withColumn("robust", 1 - F.col("file_eer") / 2)
    base = each.where("source = 'src0'").first()
    if base is None:
        return each.select("source", "robust", F.lit(True).alias("passes")).limit(0)
    rated = search.hard_gates(each.where("source <> 'src0'"), base.asDict(), {"file_eer": 0.02, "voice_eer": 0.01}, "robust")
    return rated.select("source", F.round("robust", 9).alias("robust"), "passes")


@query(
    f"""with {FEATURES}, x as (select lang, greatest(y_vp, 0) m, y_file y, {_CL("df")} p from features)
select lang, round(sum(m * -(y * ln(p) + (1 - y) * ln(1 - p))) / greatest(sum(m), 1), 9) loss from x group by lang"""
)
def q84_masked_loss(spark, sf_dir):
    p, y, m = scores.clamp(F.col("df")), F.col("y_file"), F.col("y_vp")
    loss = F.sum(m * -(y * F.log(p) + (1 - y) * F.log(1 - p))) / F.greatest(F.sum(m), F.lit(1))
    return features(spark, sf_dir).groupBy("lang").agg(F.round(loss, 9).alias("loss"))


@query(
    f"""with {FEATURES}, g as (select source, avg(case when y_file = 0 then vf end) r, avg(case when y_file = 1 then vf end) f from features group by 1)
select source, round(greatest(0e0, r - f + 0.2e0), 9) hinge from g where r is not null and f is not null"""
)
def q85_pair_margin(spark, sf_dir):
    g = features(spark, sf_dir).groupBy("source").agg(F.avg(F.when(F.col("y_file") == 0, F.col("vf"))).alias("r"), F.avg(F.when(F.col("y_file") == 1, F.col("vf"))).alias("f"))
    return g.where("r is not null and f is not null").select("source", F.round(F.greatest(F.lit(0.0), F.col("r") - F.col("f") + 0.2), 9).alias("hinge"))


@query(f"with {FEATURES}, x as (select doc_id, vf * 4 - 2 a, mf * 4 - 2 b from features) select doc_id, round(exp(a - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 9) p from x")
def q86_softmax(spark, sf_dir):
    return features(spark, sf_dir).select("doc_id", F.round(scores.softmax_first(F.col("vf") * 4 - 2, F.col("mf") * 4 - 2), 9).alias("p"))


@query(
    """with w as (select date_trunc('day', ts) d, event_type = 'click' y, (user_id % 100) / 100e0 >= 0.5e0 p from events)
select strftime(d, '%Y-%m-%d') as "day", count(*) filter (y and p) tp, count(*) filter (not y and p) fp, count(*) filter (y and not p) fn, count(*) filter (not y and not p) tn from w group by d"""
)
def x1_tumbling_window_counts(spark, sf_dir):
    from quillframe.streaming.windows import threshold_counts

    out = threshold_counts(table(spark, sf_dir, "events"), "ts", F.col("event_type") == "click", F.col("user_id") % 100 / F.lit(100.0))
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "tp", "fp", "fn", "tn")


@query(None)
def q79_oof_logistic(spark, sf_dir):
    return sampling.out_of_fold_logistic(features(spark, sf_dir).withColumn("fold", hashed_index("fold", 3, "doc_id")), "doc_id", ["df", "vf", "mf", "vfile", "mfile"], "y_file", "fold")


@query(
    f"""with {FEATURES}, t as (select *, {sql_uniform("cut")} r from features) select domain, count(*) n, count(*) filter (df > 0.2e0 and df < 0.6e0) uncertain, round(avg(case when df > 0.2e0 and df < 0.6e0 then vf end), 9) mean_vf from t group by domain"""
)
def q87_uncertainty_band(spark, sf_dir):
    band = (F.col("df") > 0.2) & (F.col("df") < 0.6)
    return features(spark, sf_dir).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count_if(band).alias("uncertain"), F.round(F.avg(F.when(band, F.col("vf"))), 9).alias("mean_vf"))


