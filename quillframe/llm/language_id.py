"""Language identification in two steps: family first, then one-versus-one linear SVMs within the family.

Features are hashed byte trigrams of the lower-cased text with ASCII other than letters made
spaces, as shares of all trigrams; a linear model over them is a sum over the bytes of the whole
text, whatever its length. Families are told apart by one-versus-rest SVMs, the languages of a
family by an SVM for each pair whose votes add up. All SVMs are trained on the driver by dual
coordinate descent from at most about `per_lang` documents for each language that has any,
chosen by a hash of doc_id (the bound is a parameter); everything is predicted.

Null text or text without a letter is "und" with score 0; so is everything if nothing was learned.
The score is the family's share times the language's share within it. Ties go to the first language
in alphabetical order. Rows are judged one by one: repeats get equal results. Other columns are
kept, but for those named like an output.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Language -> family; a language that is not listed is a family of its own.
FAMILIES = {
    **dict.fromkeys(("da", "de", "en", "is", "nl", "no", "sv"), "germanic"),
    **dict.fromkeys(("ca", "es", "fr", "gl", "it", "pt", "ro"), "romance"),
    **dict.fromkeys(("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"), "slavic"),
}
BITS = 15
PER_LANG = 600
CHUNK = 1 << 21

_MAP = np.full(256, 32, np.uint32)
_MAP[128:] = np.arange(128, 256)
_MAP[97:123] = np.arange(97, 123)
_MAP[65:91] = np.arange(97, 123)
_SPACES = (32 * 0x9E3779B1 + 32 * 0x85EBCA6B + 32 * 0xC2B2AE35) & 0xFFFFFFFF


def _codes(data: np.ndarray) -> np.ndarray:
    """Feature of the trigram that starts at each byte but the last two; 1 << BITS for three spaces."""
    m = _MAP[data]
    mixed = m[:-2] * np.uint32(0x9E3779B1) + m[1:-1] * np.uint32(0x85EBCA6B) + m[2:] * np.uint32(0xC2B2AE35)
    codes = (mixed >> np.uint32(32 - BITS)).astype(np.int32)
    codes[mixed == np.uint32(_SPACES)] = 1 << BITS
    return codes


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n + 1 offsets; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _chunks(data: np.ndarray, ends: np.ndarray):
    """(first position, feature codes) of stretches of the data; trigrams that would leave their text count as spaces."""
    cut = np.unique(np.concatenate([ends[1:] - 1, ends[1:] - 2]))
    cut = cut[cut >= 0]
    for at in range(0, max(0, len(data) - 2), CHUNK):
        codes = _codes(data[at : at + CHUNK + 2])
        inside = cut[(cut >= at) & (cut < at + len(codes))] - at
        codes[inside] = 1 << BITS
        yield at, codes


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    families: list[str] = field(default_factory=list)
    family_of: list[int] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    #: One row a family (none if there is one only), then one a pair; the last column is for spaces and 0.
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, (1 << BITS) + 1), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    slope: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margins(self, texts: pa.Array) -> np.ndarray:
        data, ends = _buffers(texts)
        sums, counts = np.zeros((len(self.weights), len(texts))), np.zeros(len(texts))
        for at, codes in _chunks(data, ends):
            lo, hi = np.searchsorted(ends, at, "right") - 1, np.searchsorted(ends, at + len(codes), "left")
            edges = np.clip(ends[lo : hi + 1] - at, 0, len(codes))
            total = np.r_[0, np.cumsum(codes != 1 << BITS)]
            counts[lo:hi] += np.diff(total[edges])
            for m, w in enumerate(self.weights):
                total = np.r_[0.0, np.cumsum(w[codes], dtype=np.float64)]
                sums[m, lo:hi] += np.diff(total[edges])
        return (sums / np.maximum(counts, 1) + self.bias[:, None]) * self.slope[:, None]

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and its score."""
        margins, n, f = self.margins(texts), len(texts), len(self.families)
        if f > 1:
            e = np.exp(margins[:f] - margins[:f].max(axis=0))
            family_share = e / e.sum(axis=0)
        else:
            family_share = np.ones((1, n))
        votes = np.zeros((len(self.langs), n))
        size = np.bincount(self.family_of, minlength=f)
        for row, (a, b) in zip(margins[f if f > 1 else 0 :], self.pairs, strict=True):
            share = 1 / (1 + np.exp(-np.clip(row, -50, 50)))
            votes[a] += share
            votes[b] += 1 - share
        best, score, family = np.zeros(n, int), np.zeros(n), family_share.argmax(axis=0)
        for k in range(f):
            own = [i for i, x in enumerate(self.family_of) if x == k]
            of = family == k
            if size[k] == 1:
                best[of], score[of] = own[0], family_share[k][of]
            else:
                v = votes[own][:, of]
                best[of] = np.array(own)[v.argmax(axis=0)]
                score[of] = family_share[k][of] * v.max(axis=0) / (size[k] - 1)
        return best, np.clip(score, 0, 1)


def _svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, scale: float, cost: float = 10.0, epochs: int = 12) -> tuple[np.ndarray, float, float]:
    """Weights, bias and slope of a linear SVM with squared hinge loss, by dual coordinate descent."""
    w, alpha, rng = np.zeros((1 << BITS) + 2), np.zeros(len(rows)), np.random.default_rng(7)
    xs = [(np.r_[i, (1 << BITS) + 1], np.r_[v * scale, 1.0]) for i, v in rows]
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    diagonal = 1 / (2 * cost * weight)
    norms = np.array([v @ v for _, v in xs]) + diagonal
    for _ in range(epochs):
        for k in rng.permutation(len(xs)):
            i, v = xs[k]
            g = y[k] * (w[i] @ v) - 1 + diagonal[k] * alpha[k]
            new = max(0.0, alpha[k] - g / norms[k])
            w[i] += (new - alpha[k]) * y[k] * v
            alpha[k] = new
    margin = np.array([w[i] @ v for i, v in xs])
    w[1 << BITS] = 0
    return (w[:-1] * scale).astype(np.float32), float(w[-1]), 3 / max(1e-9, float(np.abs(margin).mean()))


def _sparse(texts: pa.Array) -> tuple[list[bytes], list[bytes]]:
    index, value = [], []
    for text in texts:
        data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
        total = np.zeros((1 << BITS) + 1, np.int64)
        for _, codes in _chunks(data, np.array([0, len(data)])):
            total += np.bincount(codes, minlength=(1 << BITS) + 1)
        at = np.flatnonzero(total[:-1])
        index.append(at.astype(np.uint16).tobytes())
        value.append((total[at] / max(1, total[at].sum())).astype(np.float32).tobytes())
    return index, value


def training_sample(labelled: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """At most about `per_lang` rows (doc_id, text, lang) a language by a hash of doc_id; at least one of each language."""
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 20))).alias("least"))
    drawn = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 20))
    kept = (drawn < F.least(F.lit(1.0), per_lang / F.col("n")) * (1 << 20)) | (drawn == F.col("least"))
    return labelled.join(F.broadcast(counts), "lang").where(kept).select("doc_id", "text", "lang")


def train(labelled: DataFrame, per_lang: int = PER_LANG, families: dict[str, str] = FAMILIES) -> Model:
    """Learn from (doc_id, text, lang); rows with null text or lang do not count."""

    def features(batches):
        for batch in batches:
            index, value = _sparse(batch.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.string()), "lang": batch.column("lang"), "i": pa.array(index, pa.binary()), "v": pa.array(value, pa.binary())})

    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sample = training_sample(known, per_lang).mapInArrow(features, "doc_id string, lang string, i binary, v binary").toArrow().to_pylist()
    sample.sort(key=lambda r: (r["lang"], r["doc_id"] or "", r["i"]))
    rows = [(np.frombuffer(r["i"], np.uint16).astype(np.int64), np.frombuffer(r["v"], np.float32).astype(float)) for r in sample]
    model = Model(langs=sorted({r["lang"] for r in sample}))
    if not rows:
        return model
    of = [families.get(x, x) for x in model.langs]
    model.families = sorted(set(of))
    model.family_of = [model.families.index(x) for x in of]
    lang = np.array([model.langs.index(r["lang"]) for r in sample])
    family = np.array(model.family_of)[lang]
    scale = 1 / max(1e-9, float(np.mean([np.sqrt(v @ v) for _, v in rows])))
    fits = [_svm(rows, np.where(family == k, 1.0, -1.0), scale) for k in range(len(model.families))] if len(model.families) > 1 else []
    for a, b in combinations(range(len(model.langs)), 2):
        if model.family_of[a] == model.family_of[b]:
            use = np.flatnonzero((lang == a) | (lang == b))
            model.pairs.append((a, b))
            fits.append(_svm([rows[i] for i in use], np.where(lang[use] == a, 1.0, -1.0), scale))
    if fits:
        model.weights, model.bias, model.slope = (np.array(x) for x in zip(*fits, strict=True))
    return model


def predicted(model: Model, text: Column, spark) -> Column:
    """struct(lang_pred, score) of a text column."""
    if not model.langs:
        return F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def judge(texts: pa.Array) -> pa.Array:
        m = shared.value
        best, score = m.predict(texts)
        return pa.StructArray.from_arrays([pa.array(m.langs, pa.string()).take(pa.array(best)), pa.array(score)], ["lang_pred", "score"])

    und = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return F.when(F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False)), judge(F.coalesce(text, F.lit("")))).otherwise(und)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred and score."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "__p")]
    return docs.select(*(F.col(f"`{c}`") for c in kept), predicted(model, F.col("text"), docs.sparkSession).alias("__p")).select(*(F.col(f"`{c}`") for c in kept), "__p.lang_pred", "__p.score")


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
