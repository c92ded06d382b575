"""The slot for per-segment models: an Arrow function with one lazily loaded model a worker, and gated use of costly ones."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOADED: dict[str, object] = {}


def stand_in(batch: np.ndarray) -> np.ndarray:
    """A deterministic score from a segment's energy and sign changes."""
    power = (batch**2).mean(axis=1)
    turns = (np.signbit(batch[:, 1:]) != np.signbit(batch[:, :-1])).mean(axis=1) if batch.shape[1] > 1 else np.zeros(len(batch))
    return 1 / (1 + np.exp(-(4 * turns - 2 + power)))


def segment_scorer(load: Callable[[], Callable[[np.ndarray], np.ndarray]] = lambda: stand_in, name: str = "stand-in") -> Callable[[Column], Column]:
    """A column function from segments to scores; `load` runs once a worker.

    Segments of different lengths are scored length by length. A null or empty segment, or one with a null sample, has a null score.
    """

    @F.arrow_udf("double")
    def score(xs: pa.Array) -> pa.Array:
        model = _LOADED.setdefault(name, None) or _LOADED.__setitem__(name, load()) or _LOADED[name]
        rows = [None if x is None or not len(x) or None in x else np.asarray(x, float) for x in xs.to_pylist()]
        sizes = np.array([0 if r is None else len(r) for r in rows])
        out = np.full(len(rows), np.nan)
        for size in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == size)
            out[at] = np.round(model(np.stack([rows[k] for k in at])), 9)
        return pa.array(out, mask=sizes == 0)

    return score


def gated(df: DataFrame, key: str, gate: Column, scored: Callable[[DataFrame], DataFrame], out: str, default: float = 0.5) -> DataFrame:
    """Run a costly scorer on gated rows only: `scored` adds `out` to them; the others get the default and used = false."""
    some = scored(df.where(F.coalesce(gate, F.lit(False)))).select(key, F.col(out).alias("__s"))
    joined = df.join(some.withColumn("__u", F.lit(True)), key, "left")
    return joined.withColumns({out: F.coalesce("__s", F.lit(default)), "used": F.coalesce("__u", F.lit(False))}).drop("__s", "__u")


def segment_rows(df: DataFrame, key: str, segments: Column) -> DataFrame:
    """(key, seg_idx, samples): early explosion, late grouping."""
    return df.select(key, F.posexplode(segments).alias("seg_idx", "samples"))


def spectral_fingerprint(bands: int = 32, frames: int = 96) -> Callable[[Column], Column]:
    """A column function from signals to unit-norm log-spectrogram grids of bands x frames."""

    @F.arrow_udf("array<float>")
    def grid(xs: pa.Array) -> pa.Array:
        out = []
        for x in xs.to_pylist():
            x = np.asarray(x or [0.0], float)
            peak = np.abs(x).max()
            x = x / peak if peak > 0 else x
            size = max(4, min(512, 1 << int(np.log2(max(4, len(x) // 4)))))
            x = np.pad(x, (0, max(0, size - len(x))))
            frames_ = np.lib.stride_tricks.sliding_window_view(x, size)[:: max(1, size // 4)] * np.hanning(size)
            spec = np.log1p(np.abs(np.fft.rfft(frames_, axis=1)))
            at = np.linspace(0, spec.shape[1] - 1, bands)
            spec = np.stack([np.interp(at, np.arange(spec.shape[1]), row) for row in spec])
            at = np.linspace(0, len(spec) - 1, frames)
            spec = np.stack([np.interp(at, np.arange(len(spec)), col) for col in spec.T])
            z = (spec - spec.mean()) / (spec.std() + 1e-9)
            out.append((z / (np.linalg.norm(z) + 1e-12)).ravel().astype(np.float32))
        return pa.array(out, pa.list_(pa.float32()))

    return grid


def acoustic_features(rate: int) -> Callable[[Column], Column]:
    """A column function from signals to struct(centroid, bandwidth, rolloff85, flatness, crossings)."""

    @F.arrow_udf("struct<centroid:double,bandwidth:double,rolloff85:double,flatness:double,crossings:double>")
    def features(xs: pa.Array) -> pa.Array:
        rows = []
        for x in xs.to_pylist():
            x = np.asarray(x or [0.0], float)
            p = np.abs(np.fft.rfft(x)) ** 2 + 1e-12
            f = np.fft.rfftfreq(len(x), 1 / rate)
            c = (f * p).sum() / p.sum()
            rows.append({"centroid": c, "bandwidth": np.sqrt(((f - c) ** 2 * p).sum() / p.sum()), "rolloff85": f[np.searchsorted(np.cumsum(p), 0.85 * p.sum())], "flatness": np.exp(np.log(p).mean()) / p.mean(), "crossings": (np.signbit(x[1:]) != np.signbit(x[:-1])).mean() if len(x) > 1 else 0.0})
        return pa.array(rows, pa.struct([(k, pa.float64()) for k in ("centroid", "bandwidth", "rolloff85", "flatness", "crossings")]))

    return features


def filtered(kind: str, low: float, high: float, rate: int) -> Callable[[Column], Column]:
    """A column function for low-, high- or band-pass filtering in the frequency domain, with half-octave slopes."""
    if kind not in ("low", "high", "band"):
        raise ValueError(f"unsupported filter: {kind}")

    @F.arrow_udf("array<double>")
    def run(xs: pa.Array) -> pa.Array:
        out = []
        for x in xs.to_pylist():
            x = np.asarray(x or [], float)
            if len(x):
                f = np.fft.rfftfreq(len(x), 1 / rate)
                gain = np.ones(len(f))
                if kind in ("low", "band"):
                    gain /= np.sqrt(1 + (f / high) ** 8)
                if kind in ("high", "band"):
                    gain *= np.where(f > 0, 1 / np.sqrt(1 + (low / np.maximum(f, 1e-9)) ** 8), 0.0)
                x = np.fft.irfft(np.fft.rfft(x) * gain, len(x))
            out.append(x)
        return pa.array(out, pa.list_(pa.float64()))

    return run


def resampled(source: int, target: int) -> Callable[[Column], Column]:
    """A column function that changes the sampling rate in the frequency domain."""

    @F.arrow_udf("array<double>")
    def run(xs: pa.Array) -> pa.Array:
        out = []
        for x in xs.to_pylist():
            x = np.asarray(x or [], float)
            n = round(len(x) * target / source)
            if len(x) and n:
                spec = np.fft.rfft(x)
                x = np.fft.irfft(np.r_[spec, np.zeros(max(0, n // 2 + 1 - len(spec)))][: n // 2 + 1], n) * n / len(x)
            out.append(x)
        return pa.array(out, pa.list_(pa.float64()))

    return run


def augmented(profile: str, rate: int, seed: int = 0) -> Callable[[Column, Column], Column]:
    """A column function (signal, key) for seeded gain, noise, dropout and companding; profiles baseline and channel."""
    if profile not in ("baseline", "channel"):
        raise ValueError(f"unsupported profile: {profile}")

    @F.arrow_udf("array<double>")
    def run(xs: pa.Array, keys: pa.Array) -> pa.Array:
        import zlib

        out = []
        for x, key in zip(xs.to_pylist(), keys.to_pylist(), strict=True):
            rng = np.random.default_rng(zlib.crc32(f"{seed}:{key}".encode()))
            x = np.asarray(x or [], float) * 10 ** (rng.uniform(-6, 6) / 20)
            x = x + rng.normal(0, 1, len(x)) * (np.sqrt((x**2).mean()) if len(x) else 0) * 10 ** (-rng.uniform(15, 35) / 20)
            if profile == "channel" and len(x):
                at, n = rng.integers(0, len(x)), max(1, int(0.02 * len(x)))
                x[at : at + n] = 0
                y = np.sign(x) * np.log1p(255 * np.minimum(1, np.abs(x))) / np.log1p(255)
                y = np.round((y + 1) * 127.5) / 127.5 - 1
                x = np.sign(y) * ((256.0 ** np.abs(y)) - 1) / 255
            out.append(np.clip(x, -1, 1))
        return pa.array(out, pa.list_(pa.float64()))

    return run
