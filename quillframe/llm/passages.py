"""Removal of passages of at least `words` words that an earlier document has too, wherever lines begin and end.

Words are runs of characters other than ASCII white space, A-Z lower-cased. A window is `words` words in a row; the smallest
(doc_id, hash of the text) that has it is its first holder. A word is shared if it lies in a window that another document has
too, and removed if it lies in one whose first holder is another document: the first holder keeps all of it.

1. Segments. The smallest hash of a window's 8-word shingles is its anchor; windows in a row with the same anchor make a
   segment, known by anchor and a 128-bit BLAKE2b digest of its words. Equal windows have equal anchors, so only segments
   whose anchor two documents have can hold a shared window. Others go no further: anchors are counted first, by themselves.
2. Windows. Where such an anchor has one kind of segment, all of its windows have the holders of the segment. Where it has
   several, one copy of each kind is cut into windows, which are grouped by digest over the cluster.
3. Removal. The windows of a text are merged to spans of its words and cut out.

Words are told apart by 64-bit hashes, and so are the documents of an anchor. Null and empty texts have no words, a null doc_id
ranks first, equal rows are one document, and repeats within a document stay. Other columns of the input are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import broadcast_if, durable
from .shingles import mix, sliced, words_of

WORDS, GRAM = 51, 8
SLICE_BYTES = 4 << 20
MAX_BROADCAST_BYTES = 48 << 20
_SEGMENT = pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("fp", pa.int64()), ("digest", pa.binary())])


def _segments(hashes: np.ndarray, of: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor) of all segments, as indexes into the words."""
    n = len(hashes) - words + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    least, size = hashes, 1
    while size < GRAM:
        least = mix(least[:-size] + least[size:] * np.uint64(2 * size + 3))
        size *= 2
    span, size = words - GRAM + 1, 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    valid = of[:n] == of[words - 1 :]
    # Windows across the end of a text are not valid, so that a segment never goes on in the next text.
    other = least[1:] != least[:-1]
    lo = np.flatnonzero(valid & np.r_[True, other | ~valid[:-1]])
    hi = np.flatnonzero(valid & np.r_[other | ~valid[1:], True])
    return lo, hi, least[lo].view(np.int64)


def _digest(view: memoryview, first: int, last: int) -> bytes:
    return blake2b(view[8 * first : 8 * last], digest_size=16).digest()


def _owned(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = pa.StructArray.from_arrays([batch.column(c) for c in names], names)
        yield pa.RecordBatch.from_arrays([batch.column("text"), own], names=["text", "own"])


def _segment_rows(docs: DataFrame, words: int) -> DataFrame:
    """(doc: struct of doc_id and version, lo, hi, fp, digest) of every segment."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, data, ends in sliced(_owned(batches, "doc_id", "version"), SLICE_BYTES, 1 << 20, "own"):
            hashes, of = words_of(data, ends)
            lo, hi, fp = _segments(hashes, of, words)
            view = memoryview(hashes.tobytes())
            digests = [_digest(view, a, b + words) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            text = of[lo]
            begin = np.searchsorted(of, text)
            values = pa.StructArray.from_arrays([pa.array((lo - begin).astype(np.int32)), pa.array((hi - begin).astype(np.int32)), pa.array(fp), pa.array(digests, pa.binary())], fields=list(_SEGMENT))
            cuts = pa.array(np.searchsorted(text, np.arange(len(own) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([*own.flatten(), pa.ListArray.from_arrays(cuts, values)], names=["doc_id", "version", "segments"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.mapInArrow(scan, f"doc_id {kind}, version bigint, segments array<struct<lo:int,hi:int,fp:bigint,digest:binary>>")
    return made.select(F.struct("doc_id", "version").alias("doc"), F.inline("segments"))


def _shared_segments(docs: DataFrame, words: int) -> DataFrame:
    """The segments whose anchor another document has too."""
    rows = durable(_segment_rows(docs, words), "passage-segments")
    one = F.xxhash64("doc.doc_id", "doc.version")
    anchors = rows.groupBy("fp").agg(F.min(one).alias("a"), F.max(one).alias("b")).where("a <> b").select("fp")
    anchors = durable(anchors, "passage-anchors")
    return durable(rows.join(broadcast_if(anchors, 16 * anchors.count(), MAX_BROADCAST_BYTES), "fp", "left_semi"), "passage-anchored")


def _wanted(kinds: DataFrame) -> DataFrame:
    """(rank, doc, want): the kinds whose copies a document holds; ranks are in the order of documents."""
    kind = F.struct("kind", "lo", "hi", (~F.col("first").eqNullSafe(F.col("last"))).alias("others"))
    found = kinds.groupBy(F.col("first").alias("doc")).agg(F.collect_list(kind).alias("want"))
    return durable(found.orderBy("doc").select(F.monotonically_increasing_id().alias("rank"), "doc", "want"), "passage-wanted")


def _window_rows(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(kind, holder, at, window) of each window of one copy of these kinds; holder is twice the rank, one more if others hold the kind."""
    size = wanted.agg(F.coalesce(F.sum(48 + 40 * F.size("want")), F.lit(0))).first()[0]
    held = F.transform("want", lambda x: F.struct(x["kind"], (2 * F.col("rank") + x["others"].cast("bigint")).alias("holder"), x["lo"], x["hi"]))
    wanted = wanted.select(F.col("doc.doc_id").alias("__id"), F.col("doc.version").alias("__version"), held.alias("want"))
    same = docs["doc_id"].eqNullSafe(wanted["__id"]) & (docs["version"] == wanted["__version"])
    joined = docs.join(broadcast_if(wanted, size, MAX_BROADCAST_BYTES), same).select("text", "want")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for want, data, ends in sliced(batches, SLICE_BYTES, 1 << 20, "want"):
            hashes, of = words_of(data, ends)
            view = memoryview(hashes.tobytes())
            values = want.flatten()
            text = np.repeat(np.arange(len(want)), np.diff(want.offsets.to_numpy()))
            lo, hi = (values.field(k).to_numpy().astype(np.int64) for k in ("lo", "hi"))
            begin, counts = np.searchsorted(of, text) + lo, hi - lo + 1
            for some in range(0, len(lo), 2048):
                part = counts[some : some + 2048]
                which = np.repeat(np.arange(some, some + len(part)), part)
                at = np.arange(len(which)) - np.repeat(np.cumsum(part) - part, part)
                windows = [_digest(view, a, a + words) for a in (begin[which] + at).tolist()]
                own = [values.field(k).take(pa.array(which)) for k in ("kind", "holder")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(at, pa.int32()), pa.array(windows, pa.binary())], names=["kind", "holder", "at", "window"])

    return joined.mapInArrow(cut, "kind bigint, holder bigint, at int, window binary")


def shared_runs(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, version, runs: array of (a, b, later, keeper)): words a to b, from 0, that another document has too."""
    if words < 2 * GRAM:
        raise ValueError(f"words must be at least {2 * GRAM}")
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("version"))
    rows = _shared_segments(docs, words)
    # The first copy is that of the first holder.
    kinds = rows.groupBy("fp", "digest").agg(F.min(F.struct("doc", "lo", "hi")).alias("copy"), F.max("doc").alias("last"))
    kinds = durable(kinds.select("fp", "digest", F.col("copy.doc").alias("first"), "last", "copy.lo", "copy.hi"), "passage-kinds")
    # A table of its own: then Spark may split a hot anchor's kinds where they are joined by a shuffle.
    several = durable(kinds.groupBy("fp").agg(F.count(F.lit(1)).alias("n_kinds")).where("n_kinds > 1"), "passage-several")
    kinds = kinds.join(broadcast_if(several, 24 * several.count(), MAX_BROADCAST_BYTES), "fp", "left")
    kinds = durable(kinds.withColumn("kind", F.monotonically_increasing_id()), "passage-shared")
    whole = kinds.where("n_kinds is null").select("fp", "digest", F.lit(0).alias("a"), (F.col("hi") - F.col("lo")).alias("b"), "first")
    wanted = _wanted(kinds.where("n_kinds > 1"))
    windows = durable(_window_rows(docs, wanted, words), "passage-windows")
    holders = windows.groupBy("window").agg(F.min("holder").alias("least"), F.max("holder").alias("most"))
    rank = F.shiftright("least", 1)
    first = durable(holders.where((rank != F.shiftright("most", 1)) | (F.col("most") % 2 == 1)).select("window", rank.alias("rank")), "passage-first")
    order = W.partitionBy("kind", "rank").orderBy("at")
    # Equal rows are cut side by side, so a window may come more than once.
    partly = windows.join(first, "window").select("kind", "rank", "at", (F.col("at") - F.dense_rank().over(order)).alias("k"))
    partly = partly.groupBy("kind", "rank", "k").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    partly = partly.join(kinds.select("kind", "fp", "digest"), "kind").join(wanted.select("rank", F.col("doc").alias("first")), "rank")
    runs = durable(whole.unionByName(partly.select("fp", "digest", "a", "b", "first")), "passage-runs")
    found = rows.join(runs, ["fp", "digest"])
    later = ~F.col("first").eqNullSafe(F.col("doc"))
    run = F.struct((F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b") + words - 1).alias("b"), later.alias("later"), F.col("first.doc_id").alias("keeper"))
    return found.groupBy("doc").agg(F.sort_array(F.collect_set(run)).alias("runs")).select("doc.doc_id", "doc.version", "runs")


def remove_passages(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """A row per document: doc_id, n_words, n_shared_words, n_removed_words, kept_text and removed: array of (start, length, keeper).

    Offsets are code points of the original text; the keeper is the first holder of a span's first window. Spans go from a word's
    start to a word's end; the white space around them stays.
    """
    runs = durable(shared_runs(docs, words), "passage-marks")
    size = runs.agg(F.coalesce(F.sum(48 + 40 * F.size("runs")), F.lit(0))).first()[0]
    runs = runs.select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), "runs")
    base = docs.select("doc_id", "text", F.xxhash64("text").alias("version"))
    joined = base.join(broadcast_if(runs, size, MAX_BROADCAST_BYTES), base["doc_id"].eqNullSafe(runs["__id"]) & (base["version"] == runs["__version"]), "left")
    keeper = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {keeper}, n_words bigint, n_shared_words bigint, n_removed_words bigint, kept_text string, removed array<struct<start:int,length:int,keeper:{keeper}>>"

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile("[^\x20\x09-\x0d]+")
        kinds = {"kept_text": pa.string(), "removed": pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("keeper", pa_keeper)]))}
        for batch in batches:
            out = {"n_words": [], "n_shared_words": [], "n_removed_words": [], "kept_text": [], "removed": []}
            for text, found in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                text = text or ""
                if not found:
                    row = (len(word.findall(text)), 0, 0, text, [])
                else:
                    at = [m.span() for m in word.finditer(text)]
                    shared = sum(b - a + 1 for a, b, _ in _merged(found))
                    gone = _merged([r for r in found if r["later"]])
                    spans = [{"start": at[a][0], "length": at[b][1] - at[a][0], "keeper": k} for a, b, k in gone]
                    edges = [0, *(x for s in spans for x in (s["start"], s["start"] + s["length"])), len(text)]
                    kept = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    row = (len(at), shared, sum(b - a + 1 for a, b, _ in gone), kept, spans)
                for values, value in zip(out.values(), row, strict=True):
                    values.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items())], names=["doc_id", *out])

    from pyspark.sql.pandas.types import to_arrow_type

    pa_keeper = to_arrow_type(docs.schema["doc_id"].dataType)
    return joined.select("doc_id", "text", "runs").mapInArrow(rewrite, schema)


def _merged(runs: list[dict]) -> list[tuple]:
    """(a, b, keeper) of runs that are in order, those that meet as one."""
    out: list[list] = []
    for r in runs:
        if out and r["a"] <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], r["b"])
        else:
            out.append([r["a"], r["b"], r["keeper"]])
    return [tuple(x) for x in out]
