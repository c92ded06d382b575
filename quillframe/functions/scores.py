"""Score arithmetic: sanitising, logits, blending, fusion and gates, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-6


def clamp(x: Column, low: float = EPS, high: float = 1 - EPS) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def sanitise(x: Column) -> Column:
    """Null and NaN become 0.5, infinities the ends of the unit interval."""
    inf = F.lit(float("inf"))
    return F.when(x.isNull() | F.isnan(x), F.lit(0.5)).when(x == inf, F.lit(1.0)).when(x == -inf, F.lit(0.0)).otherwise(x)


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax_first(a: Column, b: Column) -> Column:
    """Probability of the first of two classes from their logits, without overflow."""
    top = F.greatest(a, b)
    return F.exp(a - top) / (F.exp(a - top) + F.exp(b - top))


def noisy_or(a: Column, b: Column) -> Column:
    return 1 - (1 - a) * (1 - b)


def gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def with_rank_probability(df: DataFrame, column: str, out: str, buckets: int = 64) -> DataFrame:
    """Adds the tie-averaged rank / (n + 1) of a column over the whole frame; needs a value in every row."""
    from quillframe.operators.prefix import with_running

    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    ranked = with_running(counts, [], column, ["__n"], buckets=buckets, descending=False)
    share = (F.col("run___n") - (F.col("__n") - 1) / 2) / (F.col("total___n") + 1)
    return df.join(ranked.select(column, share.alias(out)), column)


def blend(base: Column, candidate: Column, alpha: float, method: str = "probability", base_rank: Column | None = None, candidate_rank: Column | None = None) -> Column:
    """Convex blend of two scores in probability, logit or rank space, or their maximum; alpha 0 is the clamped base."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be in [0, 1]")
    if method not in ("probability", "logit", "rank", "max"):
        raise ValueError(f"unsupported blend method: {method}")
    b, c = clamp(base), clamp(candidate)
    if alpha == 0:
        return b
    if method == "probability":
        out = (1 - alpha) * b + alpha * c
    elif method == "logit":
        out = sigmoid(clamp((1 - alpha) * logit(b) + alpha * logit(c), -40.0, 40.0))
    elif method == "max":
        out = F.greatest(b, c)
    else:
        if base_rank is None or candidate_rank is None:
            raise ValueError("rank blending needs rank columns")
        out = (1 - alpha) * base_rank + alpha * candidate_rank
    return clamp(out)


#: Fusion weights where a policy names none.
WEIGHTS = {
    "w_panns_presence": 0.6,
    "w_df_component": 0.0,
    "w_voice_file": 0.5,
    "w_music_file": 0.3,
    "w_prob_or": 0.2,
    "w_df_arena": 0.5,
    "file_fusion_mode": "legacy",
}
MODES = ("legacy", "presence_weighted", "presence_component_or")


def fuse(weights: Mapping | None = None, used: Column | None = None, prefix: str = "", **replaced: Column) -> dict[str, Column]:
    """The five fused heads from detector and specialist scores.

    Columns: df, vf, mf, vfile, mfile, vp_model, mp_model, vp_panns, mp_panns (`prefix` before all but df and
    *_panns). Weights and the mode may be columns, as in a grid. `used`: where the costly detector ran; elsewhere its
    score is 0.5 and it has no say in components. Presence may weigh on the file head only. `replaced` gives
    scores in place of columns.
    """
    w = {**WEIGHTS, **(weights or {})}
    mode = w["file_fusion_mode"]
    if not isinstance(mode, Column) and mode not in MODES:
        raise ValueError(f"unsupported file fusion mode: {mode}")
    bare = ("df", "vp_panns", "mp_panns")
    v = {k: sanitise(replaced.get(k, F.col(k if k in bare else prefix + k))) for k in INPUTS}
    parts = _components(v, w, used)
    return _heads(v, parts, w)


#: Scores that fusion reads.
INPUTS = ("df", "vf", "mf", "vfile", "mfile", "vp_model", "mp_model", "vp_panns", "mp_panns")


def _weight(w: Mapping, name: str) -> Column:
    return x if isinstance(x := w[name], Column) else F.lit(float(x))


def _components(v: Mapping[str, Column], w: Mapping, used: Column | None) -> dict[str, Column]:
    ran = F.lit(True) if used is None else used
    df = F.when(ran, v["df"]).otherwise(F.lit(0.5))
    share = {c: F.when(ran, _weight(w, k if (k := f"w_df_{c}_component") in w else "w_df_component")).otherwise(F.lit(0.0)) for c in ("voice", "music")}
    p = _weight(w, "w_panns_presence")
    return {
        "ran_df": df,
        "voice": share["voice"] * df + (1 - share["voice"]) * v["vf"],
        "music": share["music"] * df + (1 - share["music"]) * v["mf"],
        "voice_present": p * v["vp_panns"] + (1 - p) * v["vp_model"],
        "music_present": p * v["mp_panns"] + (1 - p) * v["mp_model"],
    }


def _heads(v: Mapping[str, Column], c: Mapping[str, Column], w: Mapping) -> dict[str, Column]:
    wv, wm, wo = (_weight(w, k) for k in ("w_voice_file", "w_music_file", "w_prob_or"))
    risk = noisy_or(c["voice_present"] * c["voice"], c["music_present"] * c["music"])
    detectors = {
        "legacy": wv * v["vfile"] + wm * v["mfile"] + wo * noisy_or(c["voice"], c["music"]),
        "presence_weighted": wv * c["voice_present"] * v["vfile"] + wm * c["music_present"] * v["mfile"] + wo * risk,
        "presence_component_or": risk,
    }
    mode = w["file_fusion_mode"]
    if isinstance(mode, Column):
        detector = F.lit(None).cast("double")
        for m, x in detectors.items():
            detector = F.when(mode == m, x).otherwise(detector)
    else:
        detector = detectors[mode]
    a = _weight(w, "w_df_arena")
    heads = {"file_fake": a * c["ran_df"] + (1 - a) * detector, "voice_fake": c["voice"], "music_fake": c["music"], "voice_present": c["voice_present"], "music_present": c["music_present"]}
    return {k: clamp(x) for k, x in heads.items()}


def with_fused(df: DataFrame, weights: Mapping | None = None, used: Column | None = None) -> DataFrame:
    """`df` with the five heads of fuse(), in steps: what several heads need is computed once a row."""
    w = {**WEIGHTS, **(weights or {})}
    clean = df.withColumns({f"__{k}": sanitise(F.col(k)) for k in INPUTS})
    v = {k: F.col(f"__{k}") for k in INPUTS}
    parts = _components(v, w, used)
    stepped = clean.withColumns({f"__c_{k}": c for k, c in parts.items()})
    heads = _heads(v, {k: F.col(f"__c_{k}") for k in parts}, w)
    return stepped.withColumns(heads).drop(*(f"__{k}" for k in INPUTS), *(f"__c_{k}" for k in parts))


def gate(policy: str = "off", voice_threshold: float = 0.8, presence_threshold: float = 0.8, low: float = 0.2, high: float = 0.8, prefix: str = "") -> Column:
    """Rows that deserve the costly detector, from cheap scores only."""
    vp, mp, vfile, mfile = (F.col(prefix + c) for c in ("vp_model", "mp_model", "vfile", "mfile"))
    middle = 0.5 * vfile + 0.5 * mfile
    uncertain = (middle > low) & (middle < high)
    present = F.greatest(vp, mp) >= presence_threshold
    table = {"off": F.lit(True), "voice_presence": vp >= voice_threshold, "any_presence": present, "specialist_uncertainty": uncertain, "presence_or_uncertainty": present | uncertain}
    if policy not in table:
        raise ValueError(f"unsupported gate policy: {policy}")
    return table[policy]


def second_crop(trigger: str = "primary", low: float = 0.25, high: float = 0.75, least_sec: float = 12.0, component_low: float = 0.3, component_high: float = 0.7, spread: float = 0.3, prefix: str = "") -> Column:
    """Where a second crop of the costly detector is worth it; columns duration_sec, df_primary, vf, mf."""
    primary, vf, mf = F.col("df_primary"), F.col(prefix + "vf"), F.col(prefix + "mf")
    unsure = (primary > low) & (primary < high)
    if trigger == "any_uncertain_disagreement":
        either = ((vf > component_low) & (vf < component_high)) | ((mf > component_low) & (mf < component_high))
        unsure = unsure | either | (F.greatest(primary, vf, mf) - F.least(primary, vf, mf) >= spread)
    elif trigger != "primary":
        raise ValueError(f"unsupported trigger: {trigger}")
    return (F.col("duration_sec") >= least_sec) & unsure


def with_second_crop(use: Column, aggregation: str = "mean") -> Column:
    """The detector's score where a finite second crop may be merged."""
    a, b = F.col("df_primary"), F.col("df_second")
    merged = {"max": F.greatest(a, b), "logit_mean": sigmoid((logit(clamp(a)) + logit(clamp(b))) / 2), "mean": (a + b) / 2.0}
    if aggregation not in merged:
        raise ValueError(f"unsupported aggregation: {aggregation}")
    return F.when(use & is_finite(b), merged[aggregation]).otherwise(a)


