"""Benchmark decontamination by a distributed positional inverted index.

Postings (term, document, position) are kept for the rarest terms of the benchmark. An item's
occurrence at a document position has one alignment, position minus offset: lists of the `anchors`
rarest terms of each item window are shifted by their offsets and intersected on (document, item,
alignment). What survives is compared word for word with the document (exact phrase), or, for
proximity matches, reported when all of a window's rare terms lie within a span.

Scale: benchmark tables are broadcast up to MAX_BROADCAST rows and joined by shuffle beyond. The
corpus is read three times and shuffled at most once, as texts against the surviving candidates;
where those are few they are broadcast instead. No group of rows ever meets in one task: postings
meet by (document, item, alignment).

Nulls and odd rows: null or wordless texts have no words and are never contaminated; null or
wordless items never match and are not counted. Items with fewer words than `width` are one window.
An item_id counts once, however many rows or texts it has; repeated documents each get a row. A null doc_id is a document like
others. Input columns that clash with outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import ascii_lower, broadcast_if, durable, let, split_words

#: Separators: all ASCII but digits and letters.
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
WIDTH, ANCHORS = 13, 3
MAX_BROADCAST = 2_000_000


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(text), SEPARATORS)


def _items(benchmark: DataFrame, item: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Distinct word sequences (uid, words), and (uid, item_ids) of the items that have them."""
    rows = benchmark.select(F.col(item).cast("string").alias("item_id"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    rows = rows.withColumn("uid", F.sha2(F.array_join("words", " "), 256))
    return rows.groupBy("uid").agg(F.first("words").alias("words"), F.collect_set("item_id").alias("item_ids")), rows


class PositionalIndex:
    """Postings of corpus tokens, restricted to given terms; `docs` has columns doc_id and text."""

    def __init__(self, docs: DataFrame):
        self.docs = docs

    def frequencies(self, terms: DataFrame, n_terms: int) -> DataFrame:
        """(term, freq) over the whole corpus for the given terms that occur in it."""
        tokens = self.docs.select(F.explode(words_of(F.col("text"))).alias("term"))
        return tokens.join(broadcast_if(terms, n_terms, MAX_BROADCAST), "term").groupBy("term").agg(F.count(F.lit(1)).alias("freq"))

    def postings(self, anchors: DataFrame, n_anchors: int) -> DataFrame:
        """Postings of the terms in `anchors`, with all its columns: (doc_id, pos, ...)."""
        tokens = self.docs.select("doc_id", F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
        return tokens.join(broadcast_if(anchors, n_anchors, MAX_BROADCAST), "term")


def _windows(items: DataFrame, freqs: DataFrame, width: int, anchors: int) -> DataFrame:
    """(uid, w, len, offsets): each window of an item whose terms all occur, with the offsets of its rarest terms."""
    n = F.size("words")
    length = F.least(n, F.lit(width))
    spans = items.select("uid", "words", length.alias("len"), F.explode(F.sequence(F.lit(0), n - length)).alias("w"))
    terms = spans.select("uid", "w", "len", F.posexplode(F.slice("words", F.col("w") + 1, F.col("len"))).alias("o", "term"))
    rated = terms.join(freqs, "term", "left").withColumn("o", F.col("o") + F.col("w"))
    order = W.partitionBy("uid", "w").orderBy(F.col("freq").asc_nulls_first(), "o")
    rated = rated.withColumns({"k": F.row_number().over(order), "all": F.min(F.coalesce("freq", F.lit(0))).over(W.partitionBy("uid", "w"))})
    return rated.where(f"`all` > 0 and k <= {anchors}").groupBy("uid", "w", "len").agg(F.sort_array(F.collect_list("o")).alias("offsets"))


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, anchors: int = ANCHORS, item: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Candidate windows per document, and the items.

    First: (doc_id, cands: array of (uid, start, len, wtext)), a superset of the exact matches. Second: (uid, item_ids).
    """
    index = PositionalIndex(docs)
    items, _ = _items(benchmark, item, item_text)
    items = durable(items, "decontam-items")
    vocabulary = items.select(F.explode("words").alias("term")).distinct()
    freqs = durable(index.frequencies(vocabulary, vocabulary.count()), "decontam-freqs")
    windows = durable(_windows(items, freqs, width, anchors), "decontam-windows")
    anchor_rows = (
        windows.select("uid", F.explode("offsets").alias("o")).distinct().join(items.select("uid", "words"), "uid").select("uid", "o", F.element_at("words", F.col("o") + 1).alias("term"))
    )
    anchor_rows = durable(anchor_rows, "decontam-anchors")
    postings = index.postings(anchor_rows, anchor_rows.count())
    aligned = postings.groupBy("doc_id", "uid", (F.col("pos") - F.col("o")).alias("diag")).agg(F.collect_set("o").alias("seen"))
    # Shorter items have fewer anchors than others: the least number that any window of the item has.
    per_item = windows.groupBy("uid").agg(F.min(F.size("offsets")).alias("least"), F.collect_list(F.struct("w", "len", "offsets")).alias("wins")).join(items, "uid")
    n_items = per_item.count()
    lined = aligned.join(broadcast_if(per_item, n_items, MAX_BROADCAST // 100), "uid").where("size(seen) >= least")
    fit = F.filter("wins", lambda x: (x["w"] + F.col("diag") >= 0) & (F.size(F.array_except(x["offsets"], F.col("seen"))) == 0))
    named = F.transform(
        fit,
        lambda x: F.struct(F.col("uid").alias("uid"), (x["w"] + F.col("diag")).alias("start"), x["len"].alias("len"), F.array_join(F.slice("words", x["w"] + 1, x["len"]), " ").alias("wtext")),
    )
    cands = lined.select("doc_id", named.alias("c")).where("size(c) > 0").groupBy("doc_id").agg(F.flatten(F.collect_list("c")).alias("cands"))
    return cands, items.select("uid", "item_ids")


def _covered(spans: Column) -> Column:
    """Positions inside any of the (start, len) spans."""

    def over(s: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

        def step(a: Column, x: Column) -> Column:
            end = F.greatest(a["end"], x["start"] + x["len"])
            return F.struct((a["n"] + end - F.least(end, F.greatest(a["end"], x["start"]))).alias("n"), end.alias("end"))

        return F.aggregate(s, start, step)["n"]

    return let(F.sort_array(F.array_distinct(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["len"].alias("len"))))), over)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, anchors: int = ANCHORS, share: int = 20) -> DataFrame:
    """A row per document: its columns without text, n_words, n_hit, n_items, item_ids, spans and contaminated.

    contaminated: some word is hit, and at least one word in `share` is. spans: (start, len, uid) of exact matches, in words.
    """
    out = ("n_words", "n_hit", "n_items", "item_ids", "spans", "contaminated", "cands")
    docs = docs.drop(*out)
    cands, items = matches(docs.select("doc_id", "text"), benchmark, width, anchors)
    cands = durable(cands, "decontam-candidates")
    cands = cands.withColumnRenamed("doc_id", "__id")
    # Windows are some 150 bytes each: the bound is on their number, not on that of documents.
    n_windows = cands.agg(F.coalesce(F.sum(F.size("cands")), F.lit(0))).first()[0]
    joined = docs.join(broadcast_if(cands, n_windows, MAX_BROADCAST // 4), docs["doc_id"].eqNullSafe(cands["__id"]), "left").drop("__id")

    def verified(ws: Column) -> Column:
        exact = F.filter(F.coalesce(F.col("cands"), F.array().cast(cands.schema["cands"].dataType)), lambda c: F.array_join(F.slice(ws, c["start"] + 1, c["len"]), " ") == c["wtext"])
        return F.struct(F.size(ws).cast("bigint").alias("n_words"), F.transform(exact, lambda c: F.struct(c["start"].alias("start"), c["len"].alias("len"), c["uid"].alias("uid"))).alias("spans"))

    checked = joined.withColumn("__v", let(words_of(F.col("text")), verified)).drop("text", "cands")
    # Written once: what follows reads it twice, and filters would have texts cut into words anew.
    checked = checked.withColumns({"n_words": F.col("__v.n_words"), "spans": F.col("__v.spans"), "__row": F.monotonically_increasing_id()}).drop("__v")
    checked = durable(checked, "decontam-checked")
    checked = checked.withColumns({"n_hit": _covered(F.col("spans")).cast("bigint"), "__uids": F.array_distinct(F.transform("spans", lambda x: x["uid"]))})
    # Item ids of the distinct sequences: few documents have any, only they are exploded.
    none = checked.where("size(__uids) = 0").drop("__row").withColumn("item_ids", F.array().cast("array<string>"))
    some = checked.where("size(__uids) > 0")
    ids = some.select("__row", F.explode("__uids").alias("uid")).join(broadcast_if(items, items.count(), MAX_BROADCAST // 100), "uid")
    ids = ids.groupBy("__row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    some = some.join(ids, "__row").drop("__row")
    both = none.unionByName(some).drop("__uids")
    return both.withColumns({"n_items": F.size("item_ids").cast("bigint"), "contaminated": (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))})


def proximity_matches(docs: DataFrame, benchmark: DataFrame, span: int = 30, width: int = WIDTH, anchors: int = ANCHORS) -> DataFrame:
    """(doc_id, uid, w, first_pos, last_pos): windows whose rarest terms all stand within `span` words, in any order.

    For each posting of a window's rarest term, the nearest posting of every other anchor in the document counts.
    """
    index = PositionalIndex(docs.select("doc_id", "text"))
    items, _ = _items(benchmark, "item_id", "text")
    items = durable(items, "proximity-items")
    vocabulary = items.select(F.explode("words").alias("term")).distinct()
    freqs = durable(index.frequencies(vocabulary, vocabulary.count()), "proximity-freqs")
    windows = _windows(items, freqs, width, anchors).join(items, "uid")
    terms = windows.select("uid", "w", F.array_distinct(F.transform("offsets", lambda o: F.element_at("words", o + 1))).alias("terms"))
    rows = durable(terms.select("uid", "w", F.size("terms").alias("k"), F.explode("terms").alias("term")), "proximity-terms")
    placed = index.postings(rows, rows.count())
    # Buckets of `span` words: terms within a span lie in one bucket or in two that touch.
    bucketed = placed.withColumn("b", F.explode(F.array((F.col("pos") / span).cast("int"), (F.col("pos") / span).cast("int") - 1)))
    near = bucketed.groupBy("doc_id", "uid", "w", "k", "b").agg(F.collect_set(F.struct("pos", "term")).alias("ps"))
    near = near.where("size(array_distinct(transform(ps, x -> x.term))) = k").withColumn("ps", F.sort_array("ps"))
    tight = F.filter(
        F.transform("ps", lambda p: F.struct(p["pos"].alias("a"), F.filter("ps", lambda q: (q["pos"] >= p["pos"]) & (q["pos"] < p["pos"] + span)).alias("q"))),
        lambda x: F.size(F.array_distinct(F.transform(x["q"], lambda q: q["term"]))) == F.col("k"),
    )
    found = near.select("doc_id", "uid", "w", F.explode(tight).alias("x"))
    return found.select("doc_id", "uid", "w", F.col("x.a").alias("first_pos"), F.array_max(F.transform("x.q", lambda q: q["pos"])).alias("last_pos")).distinct()
