"""Signals as arrays of doubles: segmentation, selection, statistics, rendering and quantising."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate once a row, for use inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def doubles(xs: Column) -> Column:
    return F.transform(xs, lambda x: x.cast("double"))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def power(xs: Column) -> Column:
    """Mean of squares."""
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x * x) / F.size(xs)


def rms(xs: Column) -> Column:
    return F.sqrt(power(xs))


def silent(xs: Column, threshold: float = 0.008) -> Column:
    return rms(xs) < threshold


def zeros(n: Column | int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def tiled(xs: Column, n: int) -> Column:
    """The signal over and over, cut to n samples."""
    return F.slice(F.flatten(F.array_repeat(xs, (F.ceil(F.lit(n) / F.size(xs))).cast("int"))), 1, n)


def pad_or_trim(xs: Column, n: int, mode: str = "constant") -> Column:
    """n samples: the middle of longer signals; shorter ones end in zeros, or are repeated."""
    short = tiled(xs, n) if mode == "repeat" else F.concat(xs, zeros(F.greatest(F.lit(n) - F.size(xs), F.lit(0))))
    start = F.greatest(((F.size(xs) - n) / 2).cast("int"), F.lit(0))
    return F.when(F.size(xs) > n, F.slice(xs, start + 1, n)).otherwise(short)


POSITIONS = {"uniform5": (0, 0.25, 0.5, 0.75, 1.0), "uniform3": (0, 0.5, 1.0)}


def segment_starts(n: Column, length: int, strategy: str = "uniform5", hop: int | None = None) -> Column:
    """Starts of the segments of a signal of n > length samples."""
    room = n - length
    if strategy in POSITIONS:
        return F.array(*(F.floor(room * F.lit(float(p))).cast("int") for p in POSITIONS[strategy]))
    if strategy == "center":
        return F.array((room / 2).cast("int"))
    if strategy == "start_end":
        return F.array(F.lit(0), room)
    if strategy == "sliding":
        step = hop or length // 2
        regular = F.sequence(F.lit(0), room, F.lit(step))
        # The last window is right-aligned; it is appended unless the next regular start would be just there.
        after = (F.floor(room / step) + 1).cast("int") * step
        return F.when(after == room, regular).otherwise(F.concat(regular, F.array(room)))
    raise ValueError(f"unsupported segment strategy: {strategy}")


def segments(xs: Column, length: int, strategy: str = "uniform5", hop: int | None = None) -> Column:
    """array of segments; a signal no longer than one segment is padded to it."""
    cut = F.transform(segment_starts(F.size(xs), length, strategy, hop), lambda s: F.slice(xs, s + 1, length))
    return F.when(F.size(xs) <= length, F.array(pad_or_trim(xs, length))).otherwise(cut)


def crops_for(seconds: Column) -> Column:
    return F.when(seconds <= 8, 1).when(seconds <= 25, 2).otherwise(3)


def select_segments(energies: Column, count: Column, policy: str = "high_energy") -> Column:
    """Indices of the chosen of n segments, in order. Equal energies: the later segment is preferred."""
    n = F.size(energies)
    count = F.least(count, n)
    ranked = F.transform(F.sort_array(F.transform(energies, lambda e, i: F.struct(e.alias("e"), i.alias("i"))), asc=False), lambda x: x["i"])
    if policy == "high_energy":
        return F.sort_array(F.slice(ranked, F.lit(1), count))
    if policy == "uniform":
        at = lambda k: F.when(count > 1, F.bround((n - 1) * k / F.greatest(count - 1, F.lit(1)), 0)).otherwise(F.lit(0.0)).cast("int")
        return F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), count - 1), at)))
    if policy == "centered":
        chosen = F.when(count == 1, F.array(F.lit(2))).when(count == 2, F.array(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(0), F.lit(2), F.lit(4)))
        return F.transform(chosen, lambda k: F.least(k, n - 1))
    if policy == "energy_diverse":
        gap = F.when(n >= 5, 2).otherwise(1)
        none = F.array().cast("array<int>")
        apart = F.aggregate(ranked, none, lambda acc, i: F.when((F.size(acc) < count) & F.forall(acc, lambda j: F.abs(i - j) >= gap), F.concat(acc, F.array(i))).otherwise(acc))
        filled = let(apart, lambda a: F.concat(a, F.slice(F.array_except(ranked, a), F.lit(1), F.greatest(count - F.size(a), F.lit(0)))))
        return F.sort_array(filled)
    raise ValueError(f"unsupported selection policy: {policy}")


def window_energies(xs: Column, length: int, hop: int) -> Column:
    """array of (energy, start) of windows every `hop` samples and of the last one, by prefix sums."""
    sums = F.aggregate(xs, F.struct(F.lit(0.0).alias("t"), F.array(F.lit(0.0)).alias("s")), lambda a, x: F.struct((a["t"] + x * x).alias("t"), F.concat(a["s"], F.array(a["t"] + x * x)).alias("s")))["s"]
    room = F.size(xs) - length
    regular = F.sequence(F.lit(0), room, F.lit(hop))
    starts = F.when(F.element_at(regular, -1) == room, regular).otherwise(F.concat(regular, F.array(room)))
    return let(sums, lambda s: F.transform(starts, lambda p: F.struct((F.get(s, p + length) - F.get(s, p)).alias("energy"), p.alias("start"))))


def best_and_second(windows: Column, length: int, apart: int) -> Column:
    """struct(best, second): the strongest window's start (first of equals), and the strongest one at least max(length / 2, apart) away."""
    first = F.sort_array(F.transform(windows, lambda w: F.struct((-w["energy"]).alias("e"), w["start"].alias("s"))))[0]["s"]
    gap = max(length // 2, apart)

    def pick(b: Column) -> Column:
        far = F.filter(windows, lambda w: F.abs(w["start"] - b) >= gap)
        return F.struct(b.alias("best"), F.array_max(far)["start"].alias("second"))

    return let(first, pick)


def stats(xs: Column, rate: int) -> Column:
    """struct(duration, peak, rms, dc, clipping)."""
    n = F.size(xs)
    peak = F.array_max(F.transform(xs, lambda x: F.abs(x)))
    return F.struct((n / rate).alias("duration"), peak.alias("peak"), rms(xs).alias("rms"), (total(xs) / n).alias("dc"), (F.size(F.filter(xs, lambda x: F.abs(x) >= 0.999)) / n).alias("clipping"))


def quality_errors(s: Column, least_sec: float = 0.5, least_db: float = -60.0, most_clipping: float = 0.05) -> Column:
    """Reasons to reject a signal with these stats."""
    db = F.when(s["rms"] > 0, 20 * F.log10(s["rms"])).otherwise(F.lit(-math.inf))
    reasons = F.array(F.when(s["duration"] < least_sec, "too_short"), F.when(db < least_db, "too_quiet"), F.when(s["clipping"] > most_clipping, "clipped"))
    return F.filter(reasons, lambda r: r.isNotNull())


def ramp(n: Column, up: bool = True) -> Column:
    """n values from 0 to 1 (or back), both ends included; one value is the start."""
    step = lambda k: F.when(n > 1, k / F.greatest(n - 1, F.lit(1))).otherwise(F.lit(0.0))
    rising = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), step)).otherwise(F.array().cast("array<double>"))
    return rising if up else F.transform(rising, lambda x: 1 - x)


def added(a: Column, b: Column) -> Column:
    """Sum of two signals; the shorter one ends in silence."""
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


MIXES = ("simultaneous", "voice_then_music", "music_then_voice", "partial_overlap", "crossfade")


def mix(voice: Column, music: Column, mode: str = "simultaneous", snr_db: float = 0.0, rate: int = 16000, fade_sec: float = 0.25, overlap: float = 0.5, gap_sec: float = 0.0, voice_db: float = 0.0, music_db: float = 0.0) -> Column:
    """Two signals laid out together at a signal-to-noise ratio, with the peak limited to 0.999."""
    if mode not in MIXES:
        raise ValueError(f"unsupported mix mode: {mode}")
    v = F.transform(voice, lambda x: x * F.lit(10.0 ** (voice_db / 20)))
    m = F.transform(music, lambda x: x * F.lit(10.0 ** (music_db / 20)))

    def laid(v: Column, m: Column) -> Column:
        if mode == "simultaneous":
            return added(v, m)
        if mode in ("voice_then_music", "music_then_voice"):
            gap = zeros(max(0, round(gap_sec * rate)))
            return F.concat(v, gap, m) if mode == "voice_then_music" else F.concat(m, gap, v)
        if mode == "partial_overlap":
            offset = F.greatest(F.size(v) - F.bround(F.least(F.size(v), F.size(m)) * F.lit(min(1.0, max(0.0, overlap))), 0).cast("int"), F.lit(0))
            return added(v, F.concat(zeros(offset), m))
        fade = F.least(F.lit(max(1, round(fade_sec * rate))), F.size(v), F.size(m))
        over = F.zip_with(
            F.zip_with(F.slice(v, F.size(v) - fade + 1, fade), ramp(fade, False), lambda x, r: x * r), F.zip_with(F.slice(m, F.lit(1), fade), ramp(fade), lambda x, r: x * r), lambda x, y: x + y
        )
        rest = F.slice(m, fade + 1, F.greatest(F.size(m) - fade, F.lit(0)))
        return F.concat(F.slice(v, F.lit(1), F.greatest(F.size(v) - fade, F.lit(0))), over, rest)

    def scaled(v: Column) -> Column:
        def levelled(m: Column) -> Column:
            factor = F.sqrt((power(v) + 1e-9) / (F.lit(10.0 ** (snr_db / 10)) * (power(m) + 1e-9)))
            return let(factor, lambda f: let(F.transform(m, lambda x: x * f), lambda q: laid(v, q)))

        return let(m, levelled)

    def limited(out: Column) -> Column:
        return let(F.array_max(F.transform(out, lambda x: F.abs(x))), lambda p: F.when(p > 0.999, F.transform(out, lambda x: x * (0.999 / p))).otherwise(out))

    return let(let(v, scaled), limited)


def partial(real: Column, fake: Column, ratio: float = 0.2, position: str = "middle", fade_sec: float = 0.02, rate: int = 16000) -> Column:
    """One region of `real` replaced by (repeated) `fake`, cross-faded at both ends."""
    if position not in ("start", "middle", "end"):
        raise ValueError(f"unsupported position: {position}")
    n = F.size(real)
    size = F.greatest(F.lit(1), F.least(n, F.bround(n * F.lit(min(1.0, max(0.0, ratio))), 0).cast("int")))
    start = {"start": F.lit(0), "end": n - size, "middle": ((n - size) / 2).cast("int")}[position]

    def done(p: Column) -> Column:
        size, start = p["size"], p["start"]
        fade = F.least(F.lit(round(fade_sec * rate)), (size / 2).cast("int"), start, n - (start + size))

        def value(x: Column, i: Column) -> Column:
            k = i - start
            own = F.get(fake, k % F.size(fake))
            step = F.greatest(fade - 1, F.lit(1))
            up = F.when(fade > 1, k / step).otherwise(F.lit(0.0))
            down = F.when(fade > 1, (k - (size - fade)) / step).otherwise(F.lit(0.0))
            inside = F.when(k < fade, x * (1 - up) + own * up).when(k >= size - fade, own * (1 - down) + x * down).otherwise(own)
            return F.least(F.greatest(F.when((k >= 0) & (k < size), inside).otherwise(x), F.lit(-1.0)), F.lit(1.0))

        return F.transform(real, value)

    return let(F.struct(size.alias("size"), start.alias("start")), done)


def _unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))


def quantise(xs: Column, bits: int = 8) -> Column:
    """Signed linear levels around an exact zero, rounding half to even."""
    most = float((1 << (bits - 1)) - 1)
    if most < 1:
        raise ValueError("quantising needs at least 2 bits")
    return F.transform(xs, lambda x: _unit(F.bround(_unit(x) * most, 0) / most))


def mu_law(xs: Column, mu: int = 255) -> Column:
    def value(x: Column) -> Column:
        x = _unit(x)
        q = _unit(F.bround((F.signum(x) * F.log1p(mu * F.abs(x)) / math.log1p(mu) + 1) * 127.5, 0) / 127.5 - 1)
        return F.signum(q) * (1 / mu) * (F.pow(F.lit(1.0 + mu), F.abs(q)) - 1)

    return F.transform(xs, value)


def a_law(xs: Column, a: float = 87.6) -> Column:
    d = 1 + math.log(a)

    def value(x: Column) -> Column:
        x = _unit(x)
        m = F.abs(x)
        c = F.when(m < 1 / a, a * m / d).otherwise((1 + F.log(a * F.greatest(m, F.lit(1e-12)))) / d)
        q = F.bround((F.signum(x) * c + 1) * 127.5, 0) / 127.5 - 1
        g = F.abs(q)
        return F.signum(q) * F.when(g < 1 / d, g * d / a).otherwise(F.exp(g * d - 1) / a)

    return F.transform(xs, value)


def inner(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def correlation(a: Column, b: Column, tolerance: float = 0.001) -> Column:
    """Normalised correlation over the common length; 0 where lengths differ by more than the tolerance or a side is silent."""
    n = F.least(F.size(a), F.size(b))
    close = F.abs(F.size(a) - F.size(b)) <= tolerance * F.greatest(F.size(a), F.size(b))
    centred = lambda xs: let(F.slice(xs, F.lit(1), n), lambda s: let(total(s) / F.size(s), lambda m: F.transform(s, lambda x: x - m)))
    ratio = let(centred(a), lambda x: let(centred(b), lambda y: F.try_divide(inner(x, y), F.sqrt(inner(x, x)) * F.sqrt(inner(y, y)))))
    return F.when(close, F.coalesce(ratio, F.lit(0.0))).otherwise(F.lit(0.0))


def crossings(xs: Column) -> Column:
    """Share of neighbours with different signs."""
    pairs = F.zip_with(F.slice(xs, F.lit(1), F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0))), lambda x, y: F.when(F.signum(x) != F.signum(y), 1.0).otherwise(0.0))
    return total(pairs) / F.greatest(F.size(xs) - 1, F.lit(1))




def limit_segments(energies: Column, most: int | None) -> Column:
    """Indices of the `most` strongest segments in order; all of them without a limit."""
    every = F.sequence(F.lit(0), F.size(energies) - 1)
    if not most or most <= 0:
        return every
    return F.when(F.size(energies) <= most, every).otherwise(select_segments(energies, F.lit(most)))


def separated(xs: Column, separator: Callable[[Column], Column] | None = None) -> Column:
    """The signal's stems by a pluggable separator; the signal itself by default."""
    return xs if separator is None else separator(xs)
