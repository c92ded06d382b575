"""Conflict-constrained best-fit packing of documents into token bins.

Documents are dealt by hash into shards of about `per_shard` rows; each shard packs on its own, so
memory and time of a task are bounded and shards are independent. A document longer than a bin is
cut: full pieces fill bins of their own, the rest is packed. Within a shard, rests are taken from
long to short; bins are kept in order of residual space, each with a bitmap of its sources and one
of its duplicate clusters. The search starts at the tightest bin that has room and goes on to its
successors until one shares neither source nor cluster; if there is none, a bin is opened. No limit
is set on that search.

A cluster is the hash of the text with case and white space normalised unless a column is named;
a null source or cluster conflicts with nothing. Null, empty and wordless documents have one row
with no bin. Repeated rows are copies: they never share a bin. Ties in length go by doc_id.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, split_words

CAPACITY, PER_SHARD = 2048, 2048


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for each (size, source, cluster) in the given order; source or cluster -1 conflicts with nothing."""
    bins: list[tuple[int, int]] = []  # (residual, bin) in order
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for size, source, cluster in items:
        s, c = 0 if source < 0 else 1 << source, 0 if cluster < 0 else 1 << cluster
        at = bisect_left(bins, (size, -1))
        while at < len(bins) and (sources[bins[at][1]] & s or clusters[bins[at][1]] & c):
            at += 1
        if at < len(bins):
            room, b = bins.pop(at)
        else:
            room, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        out.append((b, capacity - room))
        sources[b] |= s
        clusters[b] |= c
        if room > size:
            insort(bins, (room - size, b))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, per_shard: int = PER_SHARD, cluster: str | None = None, by_source: bool = True) -> DataFrame:
    """A row per piece: doc_id, source, piece, start, n_tokens, bin_id, bin_offset. Tokens are words here.

    bin_id is null for documents without tokens. Pieces of a document follow each other from 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = split_words(text, SPACE)
    kind = docs.schema["doc_id"].dataType.simpleString()
    group = F.xxhash64(F.array_join(split_words(ascii_lower(text), SPACE), " ")) if cluster is None else F.when(F.col(cluster).isNotNull(), F.xxhash64(cluster))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.size(words).cast("bigint").alias("n"), group.alias("cluster"), F.xxhash64("doc_id", "text").alias("__h"))
    shards = max(1, -(-docs.count() // per_shard))
    schema = f"doc_id {kind}, source string, piece bigint, start bigint, n_tokens bigint, bin_id bigint, bin_offset bigint"

    def packed(part: pa.Table) -> pa.Table:
        shard = part.column("shard")[0].as_py()
        rest = sorted(part.select(["doc_id", "source", "n", "cluster"]).to_pylist(), key=lambda r: (-(r["n"] % capacity), r["doc_id"] is None, r["doc_id"], r["n"], r["cluster"] or 0))
        number = {None: -1}
        names = {None: -1}
        for r in rest:
            number.setdefault(r["cluster"], len(number) - 1)
            names.setdefault(r["source"], len(names) - 1)
        short = [r for r in rest if r["n"] % capacity]
        places = best_fit([(r["n"] % capacity, names[r["source"]] if by_source else -1, number[r["cluster"]]) for r in short], capacity)
        used = 1 + max((b for b, _ in places), default=-1)
        out = {k: [] for k in ("doc_id", "source", "piece", "start", "n_tokens", "bin_id", "bin_offset")}

        def add(r: dict, piece: int, n: int, b: int | None, offset: int | None) -> None:
            for k, v in zip(out, (r["doc_id"], r["source"], piece, piece * capacity, n, None if b is None else (shard << 32) + b, offset), strict=True):
                out[k].append(v)

        for r in rest:
            for piece in range(r["n"] // capacity):
                add(r, piece, capacity, used, 0)
                used += 1
            if not r["n"]:
                add(r, 0, 0, None, None)
        for r, (b, offset) in zip(short, places, strict=True):
            add(r, r["n"] // capacity, r["n"] % capacity, b, offset)
        types = [part.schema.field("doc_id").type, pa.string()] + [pa.int64()] * 5
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    sharded = rows.withColumn("shard", F.pmod("__h", F.lit(shards))).drop("__h")
    return sharded.groupBy("shard").applyInArrow(packed, schema)
