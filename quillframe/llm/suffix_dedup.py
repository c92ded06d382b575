"""Exact removal of every byte covered by a `width`-byte string that starts more than once in the corpus.

1. Anchors. In each window of `width` bytes the smallest hash of its 50-byte substrings marks an anchor;
   windows in a row with the same anchor make a segment. Equal windows have equal anchors, so
   only segments whose anchor hash occurs twice in the corpus can hold a repeated window.
2. Counts. Segments are known by anchor hash and a 128-bit BLAKE2b digest of their bytes. A segment that occurs twice is
   repeated as a whole. One that occurs once, but whose anchor occurs again, may be repeated in part: the bytes of these
   and of the other segments of their anchor are gathered, one copy each.
3. Suffix arrays. Anchors are dealt to shards of about `shard_bytes`; each shard builds a
   suffix array by induced sorting, and permuted common prefixes tell which windows occur again.
   An anchor with more than `group_bytes` of different segments is counted by window digests (SHA-256) instead, in
   a distributed group-by, so that no task grows with it.
4. Removal. Repeated windows of a text are merged to spans; the rest is joined.

Texts go through Python in slices of SLICE_BYTES, so that memory follows neither batches nor rows. Rows are
texts, told apart by two 64-bit hashes; equal texts share all work. Strings are judged on the
input. Null and empty texts have no bytes; a repeated row is an occurrence of its own, so both
copies lose what they share; null doc_ids are kept as they are. Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import broadcast_if, durable
from .shingles import sliced
from .suffix_array import repeated_windows

WIDTH, GRAM = 200, 50
SHARD_BYTES, GROUP_BYTES, SLICE_BYTES = 1 << 20, 2 << 20, 4 << 20
STRETCH = 1 << 19
#: Rows of 8 or 16 bytes, and bytes of wider rows, that are broadcast at most.
MAX_HASHES, MAX_BYTES = 2_000_000, 48 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIXER = np.uint64(0xBF58476D1CE4E5B9)
_POSITION_BITS = 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = pow(int(_BASE), -1, 2**64)
_UP, _DOWN = _powers(int(_BASE), STRETCH + 4096), _powers(_INVERSE, STRETCH + 4096)
#: A random odd-ball for each byte, so that the polynomial does not see the bytes' own pattern.
_BYTES = np.random.default_rng(20240229).integers(1, 2**64, 256, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIXER
    return x ^ (x >> np.uint64(29))


def segments(data: np.ndarray, ends: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window start, last window start, anchor hash) of all segments of concatenated texts.

    ends: ends of the texts. A segment's content is data[first : last + width].
    """
    out: list[tuple[np.ndarray, ...]] = []
    span = width - gram + 1
    # Windows that start in a stretch are handled with it; a run that meets the stretch's end is cut there for all copies alike only
    # if stretches follow the text, so each text has its own.
    begins = np.r_[0, ends[:-1]]
    groups, group = [], [0, 0]
    for a, b in zip(begins, ends, strict=True):
        if b - a > STRETCH - 4096:
            if group[1] > group[0]:
                groups.append((*group, False))
            groups.append((int(a), int(b), True))
            group = [int(b), int(b)]
        elif b - group[0] > STRETCH - 4096:
            groups.append((*group, False))
            group = [int(a), int(b)]
        else:
            group[1] = int(b)
    if group[1] > group[0]:
        groups.append((*group, False))
    for a, b, long in groups:
        step = STRETCH - 8192
        for lo in range(a, b, step) if long else (a,):
            hi = min(b, lo + step + width - 1) if long else b
            part = data[lo:hi]
            n = len(part) - width + 1
            if n <= 0:
                continue
            total = np.r_[np.uint64(0), np.cumsum(_BYTES[part] * _UP[: len(part)], dtype=np.uint64)]
            hashes = _mix((total[gram:] - total[:-gram]) * _DOWN[: len(total) - gram])
            least = (hashes >> np.uint64(_POSITION_BITS) << np.uint64(_POSITION_BITS)) | np.arange(len(hashes), dtype=np.uint64)
            size = 1
            while size * 2 <= span:
                least = np.minimum(least[:-size], least[size:])
                size *= 2
            if size < span:
                least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
            anchor = (least & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
            start = np.arange(n)
            # The end of the text that each window starts in; a window beyond it is none.
            limit = ends[np.searchsorted(ends, start + lo, "right")] - lo
            valid = start + width <= limit
            edge = np.flatnonzero(valid & np.r_[True, (anchor[1:] != anchor[:-1]) | ~valid[:-1]])
            if not len(edge):
                continue
            stop = np.flatnonzero(valid & np.r_[(anchor[1:] != anchor[:-1]) | ~valid[1:], True])
            out.append((edge + lo, stop + lo, hashes[anchor[edge]]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _binary(data: bytes | np.ndarray, ends: np.ndarray) -> pa.Array:
    """An array of binary values that follow each other in `data`."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _anchors(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """(ha, hb, segs: array of (lo, hi, fp, sd)) of every text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, data, ends in sliced(_paired(batches, "ha", "hb"), SLICE_BYTES, 1 << 20, "own"):
            lo, hi, fp = segments(data, ends[1:], width, gram)
            view = memoryview(data)
            digests = b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip(lo.tolist(), (hi + width).tolist(), strict=True)])
            row = np.searchsorted(ends, lo, "right") - 1
            cuts = np.searchsorted(row, np.arange(len(own) + 1))
            sd = _binary(digests, np.arange(16, 16 * len(lo) + 1, 16))
            values = pa.StructArray.from_arrays([pa.array((lo - ends[row]).astype(np.int32)), pa.array((hi - ends[row]).astype(np.int32)), pa.array(fp.view(np.int64)), sd], ["lo", "hi", "fp", "sd"])
            yield pa.RecordBatch.from_arrays([*own.flatten(), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)], names=["ha", "hb", "segs"])

    return texts.select("ha", "hb", "text").mapInArrow(scan, "ha bigint, hb bigint, segs array<struct<lo:int,hi:int,fp:bigint,sd:binary>>")


def _paired(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[pa.RecordBatch]:
    """Batches of text and `own`, a struct of the named columns."""
    for batch in batches:
        own = pa.StructArray.from_arrays([batch.column(c) for c in names], names)
        yield pa.RecordBatch.from_arrays([batch.column("text"), own], names=["text", "own"])


def _rows(anchors: DataFrame) -> DataFrame:
    return anchors.select("ha", "hb", F.inline("segs"))


def _bytes_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, sd, seg): the content of each wanted segment (fp, sd, ha, hb, lo, n), once."""
    per_text = durable(wanted.groupBy("ha", "hb").agg(F.collect_list(F.struct("fp", "lo", "n")).alias("want")), "suffix-wanted")
    size = per_text.agg(F.coalesce(F.sum(48 + 24 * F.size("want")), F.lit(0))).first()[0]
    joined = texts.join(broadcast_if(per_text, size, MAX_BYTES), ["ha", "hb"]).select("text", "want")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for want, data, ends in sliced(batches, SLICE_BYTES, 1 << 20, "want"):
            fp, lo, n = (want.flatten().field(k).to_numpy() for k in range(3))
            text = np.repeat(np.arange(len(want)), np.diff(want.offsets.to_numpy()))
            at = ends[text] + lo
            for some in range(0, len(at), 16_384):
                seen: dict[tuple[int, bytes], bytes] = {}
                for f, a, k in zip(fp[some : some + 16_384].tolist(), at[some : some + 16_384].tolist(), n[some : some + 16_384].tolist(), strict=True):
                    seg = data[a : a + k].tobytes()
                    seen[f, blake2b(seg, digest_size=16).digest()] = seg
                fps, sds = zip(*seen, strict=True)
                yield pa.RecordBatch.from_pydict({"fp": pa.array(fps, pa.int64()), "sd": pa.array(sds, pa.binary()), "seg": pa.array(seen.values(), pa.binary())})

    cut_out = joined.mapInArrow(cut, "fp bigint, sd binary, seg binary")
    return cut_out.groupBy("fp", "sd").agg(F.min("seg").alias("seg"))


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the runs of True."""
    edges = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


def _sorted_shards(segs: DataFrame, shards: int, width: int) -> DataFrame:
    """(fp, sd, runs) of the segments with a repeated window, from a suffix array a shard."""

    def sort(part: pa.Table) -> pa.Table:
        content = part.column("seg").to_pylist()
        runs = [_runs(m) for m in repeated_windows(content, width)]
        keep = [k for k, r in enumerate(runs) if r]
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        own = part.select(["fp", "sd"]).take(pa.array(keep, pa.int64()))
        return own.append_column("runs", pa.array([[{"first": a, "last": b} for a, b in runs[k]] for k in keep], kind))

    dealt = segs.withColumn("shard", F.pmod(F.xxhash64("fp"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(sort, "fp bigint, sd binary, runs array<struct<first:int,last:int>>")


def _counted_windows(segs: DataFrame, width: int) -> DataFrame:
    """The same for anchors with too many different segments: windows grouped by digest over the cluster."""
    starts = F.explode(F.sequence(F.lit(0), F.octet_length("seg") - width))
    rows = segs.select("fp", "sd", "seg", starts.alias("at")).select("fp", "sd", "at", F.unhex(F.sha2(F.expr(f"substring(seg, at + 1, {width})"), 256)).alias("w"))
    twice = rows.groupBy("w").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("w")
    found = rows.join(twice, "w").groupBy("fp", "sd").agg(F.collect_list(F.struct(F.col("at").alias("first"), F.col("at").alias("last"))).alias("runs"))
    return found


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(ha, hb, spans): byte spans (start, stop) to remove from the texts with these hashes, in order and apart."""
    texts = docs.select(text_hashes()[0].alias("ha"), text_hashes()[1].alias("hb"), "text").where("text is not null")
    anchors = durable(_anchors(texts, width, gram), "suffix-anchors")
    # Most anchors occur once: counting the bare hashes first keeps their segments out of the wider shuffles.
    twice = durable(_rows(anchors).groupBy("fp").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("fp"), "suffix-anchors-twice")
    rows = _rows(anchors).join(broadcast_if(twice, twice.count(), MAX_HASHES), "fp")
    per_segment = rows.groupBy("fp", "sd").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("ha", "hb", "lo", "hi")).alias("at"))
    by_segment = durable(per_segment.withColumn("size", F.col("at.hi") - F.col("at.lo") + width), "suffix-segments")
    by_anchor = by_segment.groupBy("fp").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum((F.col("c") == 1).cast("bigint")).alias("singles"), F.sum("size").alias("bytes"))
    mixed = durable(by_anchor.where("total > 1 and singles > 0").select("fp", "bytes"), "suffix-mixed")
    figures = mixed.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    wanted = by_segment.join(broadcast_if(mixed, figures[0], MAX_HASHES), "fp")
    wanted = wanted.select("fp", "sd", "bytes", "at.ha", "at.hb", "at.lo", F.col("size").alias("n"))
    content = _bytes_of(texts, wanted).join(broadcast_if(mixed, figures[0], MAX_HASHES), "fp")
    content = durable(content, "suffix-content")
    shards = max(1, -(-int(figures[1]) // shard_bytes))
    partly = _sorted_shards(content.where(F.col("bytes") <= group_bytes), shards, width)
    if mixed.where(F.col("bytes") > group_bytes).limit(1).count():
        partly = partly.unionByName(_counted_windows(content.where(F.col("bytes") > group_bytes), width))
    runs = F.array(F.struct(F.lit(0).alias("first"), (F.col("at.hi") - F.col("at.lo")).alias("last")))
    whole = by_segment.where("c > 1").select("fp", "sd", runs.alias("runs"))
    partly = partly.join(by_segment.where("c = 1").select("fp", "sd"), ["fp", "sd"], "left_semi")
    repeated = durable(whole.unionByName(partly), "suffix-repeated")
    # Never broadcast: this table follows the corpus closely, so the plan is the same at every size.
    found = _rows(anchors).join(repeated, ["fp", "sd"])
    spans = F.transform("runs", lambda r: F.struct((F.col("lo") + r["first"]).alias("start"), (F.col("lo") + r["last"] + width).alias("stop")))
    # Equal texts send equal spans, which count once. Spans that meet are merged before they are gathered.
    each = found.select("ha", "hb", F.explode(spans).alias("s")).select("ha", "hb", "s.start", "s.stop").distinct()
    order = W.partitionBy("ha", "hb").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    islands = each.withColumn("__new", F.when(before >= F.col("start"), 0).otherwise(1)).withColumn("__k", F.sum("__new").over(order))
    merged = islands.groupBy("ha", "hb", "__k").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return merged.groupBy("ha", "hb").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def text_hashes() -> tuple[Column, Column]:
    return F.xxhash64("text"), F.xxhash64(F.lit(1), "text")


def remove_repeated_strings(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, spans (byte offsets of the input) and kept (bytes)."""
    docs = docs.select("doc_id", "text")
    spans = durable(repeated_spans(docs, width, gram, shard_bytes, group_bytes), "suffix-spans")
    size = spans.agg(F.coalesce(F.sum(48 + 16 * F.size("spans")), F.lit(0))).first()[0]
    keyed = docs.withColumns({"ha": text_hashes()[0], "hb": text_hashes()[1]})
    joined = keyed.join(broadcast_if(spans, size, MAX_BYTES), ["ha", "hb"], "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    pairs = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, data, ends in sliced(_paired(batches, "doc_id", "spans"), SLICE_BYTES, 1 << 20, "own"):
            ids, gone = own.flatten()
            gone = gone.fill_null([]) if gone.null_count else gone
            inner = gone.flatten()
            first, last = inner.field(0).to_numpy(), inner.field(1).to_numpy()
            counts = np.diff(gone.offsets.to_numpy())
            text = np.repeat(np.arange(len(own)), counts)
            edge = np.zeros(len(data) + 1, np.int32)
            np.add.at(edge, ends[text] + first, 1)
            np.add.at(edge, ends[text] + last, -1)
            kept = np.cumsum(edge[:-1]) == 0
            left = np.r_[0, np.cumsum(kept)][ends]
            size = np.diff(ends)
            out = [ids, gone.cast(pairs), pa.array(size), pa.array(size - np.diff(left)), pa.array(counts.astype(np.int64)), _binary(data[kept].tobytes(), left[1:])]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "spans", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(cut, f"doc_id {kind}, spans array<struct<start:int,stop:int>>, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
