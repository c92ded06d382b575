"""Queries over signals: embeddings are short waves of 64 samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions import aggregators, scoring, signal
from quillframe.plans.base import query, table

_W = "w as (select vec_id, list_transform(embedding, lambda x: x::double) x from embeddings)"


def waves(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", signal.doubles(F.col("embedding")).alias("x"))


def _sql_power(x: str) -> str:
    return f"list_sum(list_transform({x}, lambda z: z * z)) / len({x})"


@query(f"with {_W}, s as (select vec_id, x, unnest([0, 12, 24, 36, 48]) st, unnest([0, 1, 2, 3, 4]) i from w) select vec_id, i::int seg_idx, round(list_sum(x[st + 1:st + 16]), 9) total, round({_sql_power('x[st + 1:st + 16]')}, 9) energy from s")
def q36_segments_uniform5(spark, sf_dir):
    rows = waves(spark, sf_dir).select("vec_id", F.posexplode(signal.segments(F.col("x"), 16)).alias("seg_idx", "s"))
    return rows.select("vec_id", "seg_idx", F.round(signal.total(F.col("s")), 9).alias("total"), F.round(signal.power(F.col("s")), 9).alias("energy"))


@query(f"with {_W}, s as (select vec_id, x, unnest([0, 10, 20, 30, 40, 48]) st, unnest(range(6)) i from w) select vec_id, i::int seg_idx, round(list_sum(x[st + 1:st + 16]), 9) total from s")
def q37_sliding_segments(spark, sf_dir):
    rows = waves(spark, sf_dir).select("vec_id", F.posexplode(signal.segments(F.col("x"), 16, "sliding", 10)).alias("seg_idx", "s"))
    return rows.select("vec_id", "seg_idx", F.round(signal.total(F.col("s")), 9).alias("total"))


@query(
    f"""with {_W}, e as (select vec_id, unnest([0, 1, 2, 3, 4]) i, x, unnest([0, 12, 24, 36, 48]) st from w), r as (select vec_id, i, row_number() over (partition by vec_id order by {_sql_power("x[st + 1:st + 16]")} desc, i desc) k from e)
select vec_id, string_agg(i::varchar, ',' order by i) filter (k <= case vec_id % 3 when 0 then 1 when 1 then 2 else 3 end) high, case vec_id % 3 when 0 then '0' when 1 then '0,4' else '0,2,4' end uniform, case vec_id % 3 when 0 then '2' when 1 then '1,3' else '0,2,4' end centred from r group by vec_id"""
)
def q38_high_energy_select(spark, sf_dir):
    energies = F.transform(signal.segments(F.col("x"), 16), signal.power)
    rows = waves(spark, sf_dir).select("vec_id", energies.alias("e"), signal.crops_for((F.col("vec_id") % 3) * 13 + 1).alias("n"))
    chosen = lambda p: F.array_join(F.transform(signal.select_segments(F.col("e"), F.col("n"), p), lambda x: x.cast("string")), ",")
    return rows.select("vec_id", chosen("high_energy").alias("high"), chosen("uniform").alias("uniform"), chosen("centered").alias("centred"))


@query(None)
def q105_energy_diverse(spark, sf_dir):
    energies = F.transform(signal.segments(F.col("x"), 16), signal.power)
    return waves(spark, sf_dir).select("vec_id", F.array_join(F.transform(signal.select_segments(energies, F.lit(3), "energy_diverse"), lambda x: x.cast("string")), ",").alias("chosen"))


_STATS = f"{_W}, t as (select vec_id, len(x) / 100e0 duration, list_max(list_transform(x, lambda z: abs(z))) peak, sqrt({_sql_power('x')}) rms, list_sum(x) / len(x) dc, len(list_filter(x, lambda z: abs(z) >= 0.999e0)) / len(x)::double clipping from w)"


@query(f"with {_STATS} select vec_id, round(duration, 9) duration, round(peak, 9) peak, round(rms, 9) rms, round(dc, 9) dc, round(clipping, 9) clipping from t")
def q39_audio_stats(spark, sf_dir):
    return waves(spark, sf_dir).select("vec_id", signal.stats(F.col("x"), 100).alias("s")).select("vec_id", *(F.round(f"s.{c}", 9).alias(c) for c in ("duration", "peak", "rms", "dc", "clipping")))


@query(f"with {_STATS} select vec_id, array_to_string(list_filter([case when duration < 0.7e0 then 'too_short' end, case when 20 * log10(rms) < -18.07e0 then 'too_quiet' end, case when clipping > 0.05e0 then 'clipped' end], lambda r: r is not null), ',') errors, rms < 0.008e0 silent from t")
def q40_quality_errors(spark, sf_dir):
    rows = waves(spark, sf_dir).select("vec_id", "x", signal.stats(F.col("x"), 100).alias("s"))
    return rows.select("vec_id", F.array_join(signal.quality_errors(F.col("s"), 0.7, -18.07), ",").alias("errors"), signal.silent(F.col("x")).alias("silent"))


_PAIR = f"{_W}, p as (select a.vec_id, a.x v, b.x m from w a join w b on b.vec_id = a.vec_id + 1), g as (select vec_id, v, list_transform(m, lambda z: z * sqrt(({_sql_power('v')} + 1e-9) / (2e0 * ({_sql_power('m')} + 1e-9)))) m from p)"


def _pairs(spark, sf_dir):
    w = waves(spark, sf_dir)
    left = w.select("vec_id", F.col("x").alias("v"))
    return left.join(w.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("m")), "vec_id")


def _cap(x: str) -> str:
    return f"(case when list_max(list_transform({x}, lambda z: abs(z))) > 0.999e0 then list_transform({x}, lambda z: z * (0.999e0 / list_max(list_transform({x}, lambda z: abs(z))))) else {x} end)"


_LAYOUTS = {
    "simultaneous": "list_transform(range(1, 65), lambda i: v[i] + m[i])",
    "voice_then_music": "list_concat(v, list_transform(range(8), lambda i: 0e0), m)",
    "music_then_voice": "list_concat(m, list_transform(range(8), lambda i: 0e0), v)",
    "partial_overlap": "list_transform(range(1, 97), lambda i: coalesce(v[i], 0e0) + case when i > 32 then coalesce(m[i - 32], 0e0) else 0e0 end)",
    "crossfade": "list_transform(range(1, 113), lambda i: case when i <= 48 then v[i] when i <= 64 then v[i] * (1 - (i - 49) / 15e0) + m[i - 48] * ((i - 49) / 15e0) else m[i - 48] end)",
}


@query(f"with {_PAIR} " + " union all ".join(f"select vec_id, '{k}' as mode, len(o)::int n, round(list_sum(list_transform(o, lambda z: z * z)), 8) energy, round(list_sum(o), 8) total from (select vec_id, {_cap(v)} o from g)" for k, v in _LAYOUTS.items()))
def q41_mix_render(spark, sf_dir):
    snr = 10 * 0.30102999566398119521
    made = F.array(*(F.struct(F.lit(m).alias("mode"), signal.mix(F.col("v"), F.col("m"), m, snr, rate=16, fade_sec=1.0, gap_sec=0.5).alias("o")) for m in signal.MIXES))
    rows = _pairs(spark, sf_dir).select("vec_id", F.inline(made))
    return rows.select("vec_id", "mode", F.size("o").alias("n"), F.round(F.size("o") * signal.power(F.col("o")), 8).alias("energy"), F.round(signal.total(F.col("o")), 8).alias("total"))


def _sql_partial(start: int, size: int, fade: int) -> str:
    k = f"(i - 1 - {start})"
    own = f"m[{k} % 64 + 1]"
    step = max(1, fade - 1)
    up, down = f"({k} / {step}e0)", f"(({k} - {size - fade}) / {step}e0)"
    inside = f"case when {k} < {fade} then v[i] * (1 - {up}) + {own} * {up} when {k} >= {size - fade} then {own} * (1 - {down}) + v[i] * {down} else {own} end"
    return f"list_transform(range(1, 65), lambda i: least(greatest(case when {k} >= 0 and {k} < {size} then {inside} else v[i] end, -1e0), 1e0))"


_PARTIALS = {"start": (0, 16, 0), "middle": (24, 16, 4), "end": (48, 16, 0)}


@query(f"with {_PAIR.replace(', g as', ', unused as')} " + " union all ".join(f"select vec_id, '{k}' as position, round(list_sum(list_transform(o, lambda z: z * z)), 8) energy, round(list_sum(o), 8) total from (select vec_id, {_sql_partial(*v)} o from p)" for k, v in _PARTIALS.items()))
def q42_partial_render(spark, sf_dir):
    made = F.array(*(F.struct(F.lit(p).alias("position"), signal.partial(F.col("v"), F.col("m"), 0.25, p, 0.25, 16).alias("o")) for p in _PARTIALS))
    rows = _pairs(spark, sf_dir).select("vec_id", F.inline(made))
    return rows.select("vec_id", "position", F.round(F.size("o") * signal.power(F.col("o")), 8).alias("energy"), F.round(signal.total(F.col("o")), 8).alias("total"))


_D = "(1 + ln(87.6e0))"
_MU = "sign(q) * (1 / 255e0) * (pow(256e0, abs(q)) - 1)"
_AQ = f"round_even((sign(x) * case when abs(x) < 1 / 87.6e0 then 87.6e0 * abs(x) / {_D} else (1 + ln(87.6e0 * greatest(abs(x), 1e-12::double))) / {_D} end + 1) * 127.5e0, 0) / 127.5e0 - 1"
_AD = f"sign(q) * case when abs(q) < 1 / {_D} then abs(q) * {_D} / 87.6e0 else exp(abs(q) * {_D} - 1) / 87.6e0 end"


@query(
    f"""with {_W}, u as (select vec_id, unnest(x) x from w), a as (select vec_id, x, round_even(x * 127e0, 0) / 127e0 lin, round_even((sign(x) * ln(1 + 255e0 * abs(x)) / ln(256e0) + 1) * 127.5e0, 0) / 127.5e0 - 1 mq, {_AQ} aq from u)
select vec_id, round(sum(abs(lin)), 8) linear, round(sum(abs({_MU.replace("q", "mq").replace("sqrt", "sqrt")})), 8) mu, round(sum(abs({_AD.replace("(q)", "(aq)")})), 8) a from a group by vec_id"""
)
def q43_quantise_mulaw_alaw(spark, sf_dir):
    size = lambda xs: F.round(F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.abs(x)), 8)
    x = F.col("x")
    return waves(spark, sf_dir).select("vec_id", size(signal.quantise(x, 8)).alias("linear"), size(signal.mu_law(x)).alias("mu"), size(signal.a_law(x)).alias("a"))


_P = f"{_W}, p as (select vec_id, list_transform(range(1, 5), lambda i: 1 / (1 + exp(-8 * x[i]))) p from w)"
_C = "list_transform({0}, lambda z: least(greatest(z, 1e-6::double), 1 - 1e-6::double))"


def _sql_mean(xs: str) -> str:
    return f"(list_sum({xs}) / len({xs}))"


def _sql_sig(xs: str) -> str:
    logits = f"list_transform({_C.format(xs)}, lambda z: ln(z / (1 - z)))"
    return f"(1 / (1 + exp(-{_sql_mean(logits)})))"


_TOP2 = "list_reverse_sort(p)[1:2]"
AGGREGATES = {
    "mean": _sql_mean("p"), "max": "list_max(p)", "topk_mean": _sql_mean(_TOP2), "logit_topk_mean": _sql_sig(_TOP2), "logit_mean": _sql_sig("p"), "median": "((list_sort(p)[2] + list_sort(p)[3]) / 2)",
    "trimmed_mean": _sql_mean("list_sort(p)[2:3]"), "max_mean_0.25": f"(0.25e0 * list_max(p) + 0.75e0 * {_sql_mean('p')})", "noisy_or": "(1 - list_product(list_transform(p, lambda z: 1 - z)))",
    "attention": "(list_sum(list_transform(p, lambda z: z * (abs(z - 0.5e0) + 0.1e0))) / list_sum(list_transform(p, lambda z: abs(z - 0.5e0) + 0.1e0)))",
}


def _register(number: int, method: str) -> None:
    name = f"q{number}_aggregate_{method.replace('.', '')}"

    def run(spark, sf_dir):
        p = F.transform(F.slice("x", 1, 4), lambda x: 1 / (1 + F.exp(-8 * x)))
        return waves(spark, sf_dir).select("vec_id", p.alias("p")).select("vec_id", F.round(aggregators.aggregator(method, F.col("p")), 9).alias("score"))

    run.__name__ = name
    query(f"with {_P} select vec_id, round({AGGREGATES[method]}, 9) score from p")(run)


for _i, _m in enumerate(AGGREGATES):
    _register(44 + _i if _i < 8 else 98 + _i, _m)


@query(None)
def q77_udtf_segments(spark, sf_dir):
    from pyspark.sql.functions import udtf

    @udtf(returnType="vec_id: bigint, seg_idx: int, energy: double")
    class Segments:
        def eval(self, vec_id: int, x: list, length: int):
            for k, p in enumerate((0, 0.25, 0.5, 0.75, 1.0)):
                at = int((len(x) - length) * p)
                yield vec_id, k, round(sum(v * v for v in x[at : at + length]) / length, 9)

    spark.udtf.register("segments_of", Segments)
    waves(spark, sf_dir).createOrReplaceTempView("waves_for_segments")
    return spark.sql("select s.* from waves_for_segments w, lateral segments_of(w.vec_id, w.x, 16) s")


@query(None)
def q78_arrow_scorer(spark, sf_dir):
    rows = scoring.segment_rows(waves(spark, sf_dir), "vec_id", signal.segments(F.col("x"), 16))
    scored = rows.withColumn("score", scoring.segment_scorer()(F.col("samples")))
    return scored.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("seg_idx", "score"))).alias("s")).select("vec_id", F.round(aggregators.head_aggregator("file_fake", F.col("s.score")), 9).alias("file_fake"))


@query(
    f"""with {_W}, c as (select vec_id, x, list_transform(range(0, 65), lambda i: coalesce(list_sum(list_transform(x[1:i], lambda z: z * z)), 0e0)) s from w),
e as (select vec_id, unnest([0, 8, 16, 24, 32, 40, 44]) st, s from c), f as (select vec_id, st, round(s[st + 21] - s[st + 1], 12) en from e), b as (select vec_id, st best from (select *, row_number() over (partition by vec_id order by en desc, st) r from f) where r = 1)
select b.vec_id, b.best, max_by(f.st, (f.en, f.st)) filter (abs(f.st - b.best) >= 24) as "second" from b join f using (vec_id) group by 1, 2"""
)
def q106_best_and_second_window(spark, sf_dir):
    windows = F.transform(signal.window_energies(F.col("x"), 20, 8), lambda w: F.struct(F.round(w["energy"], 12).alias("energy"), w["start"].alias("start")))
    return waves(spark, sf_dir).select("vec_id", signal.best_and_second(windows, 20, 24).alias("b")).select("vec_id", "b.best", "b.second")


@query(
    f"""with {_W}, p as (select a.vec_id, a.x a, b.x b from w a join w b on b.vec_id = a.vec_id + 1), m as (select vec_id, a, b, list_sum(a) / 64 ma, list_sum(b) / 64 mb from p), c as (select vec_id, list_transform(a, lambda z: z - ma) a, list_transform(b, lambda z: z - mb) b from m)
select vec_id, round(list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b))), 8) corr from c"""
)
def q107_wave_correlation(spark, sf_dir):
    w = waves(spark, sf_dir)
    pairs = w.join(w.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    return pairs.select("vec_id", F.round(signal.correlation(F.col("x"), F.col("y")), 8).alias("corr"))


@query(f"with {_W} select vec_id, round(list_sum(list_transform(range(1, 64), lambda i: case when sign(x[i]) <> sign(x[i + 1]) then 1e0 else 0e0 end)) / 63, 9) rate, round(list_sum(list_concat(x[1:8], x[29:36], x[57:64])), 9) sampled from w")
def q108_crossings_and_partial_read(spark, sf_dir):
    x = F.col("x")
    parts = F.concat(F.slice(x, 1, 8), F.slice(x, 29, 8), F.slice(x, 57, 8))
    return waves(spark, sf_dir).select("vec_id", F.round(signal.crossings(x), 9).alias("rate"), F.round(signal.total(parts), 9).alias("sampled"))


@query(f"with {_W} select vec_id, round(list_sum(x[17:48]), 9) trimmed, round(list_sum(x) + list_sum(x[1:36]), 9) repeated, 100 as n from w")
def q109_pad_or_trim(spark, sf_dir):
    x = F.col("x")
    repeated = signal.pad_or_trim(x, 100, "repeat")
    return waves(spark, sf_dir).select("vec_id", F.round(signal.total(signal.pad_or_trim(x, 32)), 9).alias("trimmed"), F.round(signal.total(repeated), 9).alias("repeated"), F.size(repeated).alias("n"))


@query(None)
def q110_fingerprints(spark, sf_dir):
    grid, features = scoring.spectral_fingerprint(8, 8), scoring.acoustic_features(64)
    rows = waves(spark, sf_dir).select("vec_id", grid(F.col("x")).alias("g"), features(F.col("x")).alias("f"))
    return rows.select("vec_id", F.size("g").alias("n"), F.round("f.centroid", 6).alias("centroid"), F.round("f.flatness", 6).alias("flatness"))


@query(None)
def q111_channel_effects(spark, sf_dir):
    x = F.col("x")
    low, down, worn = scoring.filtered("low", 0, 8, 64), scoring.resampled(64, 32), scoring.augmented("channel", 64, 3)
    return waves(spark, sf_dir).select("vec_id", F.size(low(x)).alias("n_low"), F.size(down(x)).alias("n_down"), F.size(worn(x, F.col("vec_id").cast("string"))).alias("n_worn"))
