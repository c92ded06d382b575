"""Quality rules with risk-controlled cutoffs.

Each rule rejects a document whose measure exceeds a cutoff. Cutoffs are not guessed: for each
stratum (a language) and rule, candidate cutoffs are tried from lenient to strict on the labelled
good documents; a cutoff is certified if the exact binomial probability of seeing at most as many
false rejections, were the true rate `alpha / rules`, is at most `delta / (strata x rules)`. Within
a stratum and rule the candidates are tested in that fixed order up to the first failure, which
needs no further correction; over strata and rules Bonferroni's correction holds. So with
probability 1 - delta, in every stratum all rules together reject at most the share `alpha` of good
documents. A stratum or rule without enough labels certifies nothing and rejects nothing.

Null text counts as empty; a document without words has measures of 0 and fails the base rule.
Repeated label rows of a document count once, as good only if all of them are; good documents with equal texts in a
stratum count as one trial. A null language is
the stratum "und". Repeated documents are each judged. Input columns whose names are taken by
outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACE, broadcast_if, durable, let, split_words

#: Measure name -> candidate cutoffs from lenient to strict. A document with a greater measure is rejected.
CUTOFFS = {
    "symbol_ratio": (1.0, 0.8, 0.6, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05),
    "caps_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "dup_line_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "repeat_ratio": (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15),
}
ALPHA, DELTA = 0.05, 0.1
WINDOW = 8
MAX_BROADCAST_STRATA = 100_000


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Number of words inside windows of `width` words that occur more than once in the array.

    Distinct window hashes prove that no window repeats; else the windows themselves are compared.
    """

    def covered(ws: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(ws) - (width - 1)), lambda i: F.struct(F.array_join(F.slice(ws, i, width), " ").alias("g"), i.alias("p")))

        def places(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: F.coalesce(x["g"] == F.get(s, j - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get(s, j + 1)["g"], F.lit(False)))
            return F.sort_array(F.transform(twice, lambda x: x["p"]))

        steps = lambda p: F.transform(p, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - x, F.lit(width))))
        return let(F.sort_array(grams), lambda s: let(places(s), lambda p: F.aggregate(steps(p), F.lit(0), lambda a, x: a + x)))

    def counted(ws: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(ws) - (width - 1)), lambda i: F.xxhash64(F.slice(ws, i, width)))
        distinct = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
        return F.when(F.size(ws) <= width, F.lit(0)).when(distinct, F.lit(0)).otherwise(covered(ws))

    return let(words, counted)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Base counts and the measures that rules compare, added to the columns of `docs` without its text."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    new = {
        "n_words": F.size(split_words(t, SPACE)),
        "word_chars": F.char_length(F.regexp_replace(t, f"[{SPACE}]+", "")),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")),
        "__lines": let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))),
        "n_repeat_words": repeated_words(split_words(t, SPACE)),
        "n_caps": F.char_length(t) - F.char_length(F.regexp_replace(t, "[A-Z]+", "")),
    }
    kept = [c for c in docs.columns if c not in (text, *new, "n_lines", "n_dup_lines", *CUTOFFS)]
    counts = docs.select(*(F.col(f"`{c}`") for c in kept), *(c.cast("bigint").alias(k) if k != "__lines" else c.alias(k) for k, c in new.items()))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return (
        counts.withColumns({"n_lines": F.col("__lines.n").cast("bigint"), "n_dup_lines": F.col("__lines.dup").cast("bigint")})
        .drop("__lines")
        .withColumns({"symbol_ratio": share("n_symbols", "n_words"), "caps_ratio": share("n_caps", "word_chars"), "dup_line_ratio": share("n_dup_lines", "n_lines"), "repeat_ratio": share("n_repeat_words", "n_words")})
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _ln_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 8, carried back; good to 13 digits."""
    z = x + 8.0
    low = F.lit(0.0)
    for i in range(8):
        low = low + F.log(x + float(i))
    tail = 1.0 / (12.0 * z) - 1.0 / (360.0 * F.pow(z, 3)) + 1.0 / (1260.0 * F.pow(z, 5)) - 1.0 / (1680.0 * F.pow(z, 7))
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + tail - low


def binomial_tail(n: Column, r: Column, rate: float) -> Column:
    """P(X <= r) for X ~ Binomial(n, rate) where r < n x rate; 1 beyond, where it is never small.

    The terms below r fall at least geometrically; those that lie 40 standard deviations below add less than 1e-300.
    """
    n, r = n.cast("double"), r.cast("double")
    top = _ln_gamma(n + 1) - _ln_gamma(r + 1) - _ln_gamma(n - r + 1) + r * F.log(F.lit(rate)) + (n - r) * F.log(F.lit(1 - rate))
    terms = F.least(r, 40 * F.sqrt(n) + 50).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * (r - k + 1) * (1 - rate) / ((n - r + k) * rate)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    below = F.when(terms > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), start, step)["sum"]).otherwise(1.0)
    return F.when(r < n * rate, F.exp(top) * below).otherwise(1.0)


def certified_cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "stratum", cutoffs: dict = CUTOFFS, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, one column a rule): the strictest certified cutoff, null where none is.

    measured: doc_id, stratum, text_hash and the measures. All labelled good documents count; equal texts of a stratum are one
    trial, since copies fail together and the bound is on independent ones. The result has a row a stratum.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    rejects = [F.sum((F.col(m) > c).cast("bigint")).alias(f"{m}__{i}") for m, cs in cutoffs.items() for i, c in enumerate(cs)]
    trials = measured.join(good, "doc_id", "left_semi").groupBy(stratum, "text_hash").agg(*(F.max(m).alias(m) for m in cutoffs))
    counted = trials.groupBy(stratum).agg(F.count(F.lit(1)).alias("n_good"), *rejects)
    tried = F.array(*(F.struct(F.lit(m).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), F.col(f"{m}__{i}").alias("r")) for m, cs in cutoffs.items() for i, c in enumerate(cs)))
    tests = counted.withColumn("n_strata", F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))).select(stratum, "n_good", "n_strata", F.inline(tried))
    level = F.lit(delta) / (F.col("n_strata") * len(cutoffs))
    passed = tests.withColumn("ok", binomial_tail(F.col("n_good"), F.col("r"), alpha / len(cutoffs)) <= level)
    in_order = W.partitionBy(stratum, "rule").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    walked = passed.withColumn("ok", F.min(F.col("ok").cast("int")).over(in_order) == 1)
    return walked.groupBy(stratum).agg(*(F.min(F.when(F.col("ok") & (F.col("rule") == m), F.col("cutoff"))).alias(f"cut_{m}") for m in cutoffs))


def apply_rules(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", cutoffs: dict = CUTOFFS, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """All documents with counts, measures, base_failed, each rule's cutoff and `kept`."""
    taken = ("stratum", "base_failed", "kept", "text_hash")
    docs = docs.drop(*taken).withColumn("text_hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    measured = durable(measures(docs, text).withColumn("stratum", F.coalesce(F.col(lang), F.lit("und"))), "quality-measures")
    cuts = certified_cutoffs(measured, labels, "stratum", cutoffs, alpha, delta)
    cuts = durable(cuts, "quality-cutoffs")
    joined = measured.join(broadcast_if(cuts, cuts.count(), MAX_BROADCAST_STRATA), "stratum", "left")
    rejected = F.lit(False)
    for m in cutoffs:
        rejected = rejected | F.coalesce(F.col(m) > F.col(f"cut_{m}"), F.lit(False))
    return joined.drop("text_hash").withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected)
