"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

State of a `LineIndex`, as tables in the shared folder:
- references (digest, doc_id, n): how many lines of a document have a key. Exact. An insertion appends rows, a deletion
  appends the same rows with negative n; readers add them up.
- owners (digest, owner, n_refs): per key that at least two documents hold, the smallest doc_id. Exact.
- filters (shard, filter): cuckoo filters of the owned keys, one a shard of the key space.

A line is first looked up in its shard's filter; only possible hits reach the exact join with
`owners`, which removes false positives. Filters are broadcast while they take at most
`max_filter_bytes`; beyond, lines are sent to their shard's filter by a shuffle. insert() and delete() produce a
new state from the old one, so that a document that is deleted gives its lines back to the next owner. They count
only the keys concerned anew, put and remove single fingerprints, and write only the filters of shards in which some key
got or lost its owner; a filter that is too full is built anew from its shard's owners.

A key's rows are pre-aggregated before they shuffle, so a line that a third of all documents share
costs a row a map task. Null or empty text: one empty line, which is too short to be dropped. A null
doc_id owns nothing and loses nothing. Rows that repeat a doc_id are one document as owners; each loses its own lines,
told apart by the hash of its text. Other input columns are carried, but for those named like an output. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, durable, let
from .cuckoo import CuckooFilter, built
from .lines import exploded_lines

LEAST_CHARS = 10
KEYS_PER_SHARD = 1_000_000
MAX_FILTER_BYTES = 64 << 20
#: Most bytes of dropped lines that are broadcast instead of shuffling texts to them.
MAX_BROADCAST_BYTES = 48 << 20


def _hashes(digests: pa.Array) -> np.ndarray:
    """The first eight bytes of each 16-byte digest."""
    data = digests.cast(pa.binary()) if digests.type != pa.binary() else digests
    return np.frombuffer(b"".join(x[:8] for x in data.to_pylist()), np.uint64) if len(data) else np.zeros(0, np.uint64)


def shard_of(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


def _owned(references: DataFrame) -> DataFrame:
    """(digest, owner, n_refs) of the keys that at least two documents hold."""
    held = references.groupBy("digest", "doc_id").agg(F.sum("n").alias("n")).where("n > 0")
    per_key = held.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_refs"))
    return per_key.where("n_docs > 1").select("digest", "owner", "n_refs")


class LineIndex:
    def __init__(self, references: DataFrame, owners: DataFrame, filters: DataFrame, shards: int):
        self.references, self.owners, self.filters, self.shards = references, owners, filters, shards

    @staticmethod
    def _lines(docs: DataFrame, least: int) -> DataFrame:
        return exploded_lines(docs.where("doc_id is not null").withColumn("version", F.xxhash64("text")), least, "doc_id", "version")

    @staticmethod
    def _counted(lines: DataFrame) -> DataFrame:
        return lines.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))

    @classmethod
    def of(cls, lines: DataFrame, keys_per_shard: int = KEYS_PER_SHARD) -> LineIndex:
        """An index of lines (doc_id, digest), with the table of references, for insert() and delete()."""
        references = durable(cls._counted(lines), "line-references")
        owners = durable(_owned(references), "line-owners")
        shards = max(1, -(-owners.count() // keys_per_shard))

        def build(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: dict[int, list[np.ndarray]] = {}
            for batch in groups:
                shard, hashes = batch.column("shard").to_numpy(), _hashes(batch.column("digest"))
                for s in np.unique(shard):
                    parts.setdefault(int(s), []).append(hashes[shard == s])
            for s, hs in parts.items():
                yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "filter": pa.array([built(np.concatenate(hs)).to_bytes()], pa.binary())})

        rows = owners.select(shard_of(shards).alias("shard"), "digest").repartition(shards, "shard")
        filters = durable(rows.mapInArrow(build, "shard int, filter binary"), "line-filters")
        return cls(references, owners, filters, shards)

    @classmethod
    def incremental(cls, docs: DataFrame, least: int = LEAST_CHARS, keys_per_shard: int = KEYS_PER_SHARD) -> LineIndex:
        """An index of the lines of documents."""
        return cls.of(cls._lines(docs, least), keys_per_shard)

    def insert(self, docs: DataFrame, least: int = LEAST_CHARS) -> LineIndex:
        """The index with the lines of more documents."""
        return self._changed(durable(self._counted(self._lines(docs, least)), "line-inserted"))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The index without the documents named in the column doc_id."""
        held = self.references.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
        gone = held.groupBy("digest", "doc_id").agg((-F.sum("n")).alias("n")).where("n <> 0")
        return self._changed(durable(gone, "line-deleted"))

    def _changed(self, delta: DataFrame) -> LineIndex:
        references = self.references.unionByName(delta)
        keys = durable(delta.select("digest").distinct(), "line-keys")
        now = durable(_owned(references.join(keys, "digest", "left_semi")), "line-owners")
        owners = self.owners.join(keys, "digest", "left_anti").unionByName(now)
        before = self.owners.join(keys, "digest", "left_semi").select("digest", F.lit(-1).alias("turn"))
        turns = before.unionByName(now.select("digest", F.lit(1).alias("turn"))).groupBy("digest").agg(F.sum("turn").alias("turn")).where("turn <> 0")
        turns = durable(turns.select(shard_of(self.shards).alias("shard"), "digest", "turn"), "line-turns")
        touched = durable(turns.select("shard").distinct(), "line-shards")
        full = -1

        def update(left: pa.Table, right: pa.Table) -> pa.Table:
            shard = (left if left.num_rows else right).column("shard")[0].as_py()
            held = CuckooFilter.from_bytes(right.column("filter")[0].as_py()) if right.num_rows else CuckooFilter.for_keys(1)
            turn, hashes = left.column("turn").to_numpy(), _hashes(left.column("digest").combine_chunks())
            held.delete(hashes[turn < 0])
            ok = held.insert(hashes[turn > 0])
            return pa.table({"shard": pa.array([shard if ok else full - shard], pa.int32()), "filter": pa.array([held.to_bytes() if ok else b""], pa.binary())})

        old = self.filters.join(touched, "shard", "left_semi")
        new = durable(turns.groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(update, "shard int, filter binary"), "line-filters")
        filters = self.filters.join(touched, "shard", "left_anti").unionByName(new.where("shard >= 0"))
        # A shard that has become too full gets a larger filter from its owners.
        rebuilt = new.where("shard < 0").select((full - F.col("shard")).cast("int").alias("shard"))
        if rebuilt.limit(1).count():
            rows = owners.select(shard_of(self.shards).alias("shard"), "digest").join(rebuilt, "shard", "left_semi")

            def build(part: pa.Table) -> pa.Table:
                return pa.table({"shard": part.column("shard")[:1], "filter": pa.array([built(_hashes(part.column("digest").combine_chunks())).to_bytes()], pa.binary())})

            filters = filters.unionByName(durable(rows.groupBy("shard").applyInArrow(build, "shard int, filter binary"), "line-filters"))
        return LineIndex(references, owners, filters, self.shards)

    def possible(self, lines: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
        """The rows of `lines` (with a column digest) that their shard's filter may hold."""
        size = self.filters.agg(F.coalesce(F.sum(F.octet_length("filter")), F.lit(0))).first()[0]
        schema = lines.schema
        sharded = lines.withColumn("__shard", shard_of(self.shards))
        if size <= max_filter_bytes:
            held = {r["shard"]: bytes(r["filter"]) for r in self.filters.collect()}
            shared = lines.sparkSession.sparkContext.broadcast(held)

            def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                filters = {s: CuckooFilter.from_bytes(x) for s, x in shared.value.items()}
                for batch in batches:
                    shard, hashes = batch.column("__shard").to_numpy(), _hashes(batch.column("digest"))
                    hit = np.zeros(len(shard), bool)
                    for s in np.unique(shard):
                        if int(s) in filters:
                            of = shard == s
                            hit[of] = filters[int(s)].contains(hashes[of])
                    yield batch.filter(pa.array(hit)).select([f.name for f in schema])

            return sharded.mapInArrow(probe, schema)
        # Too large to broadcast: each shard's filter travels to its lines, once a salted part of the shard.
        parts = 8
        salted = sharded.withColumn("__part", F.pmod(F.hash(*lines.columns), F.lit(parts)))
        spread = self.filters.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumnRenamed("shard", "__shard")

        def cogrouped(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = left.select([f.name for f in schema])
            if not right.num_rows or not left.num_rows:
                return rows.slice(0, 0)
            held = CuckooFilter.from_bytes(right.column("filter")[0].as_py())
            return rows.filter(pa.array(held.contains(_hashes(left.column("digest").combine_chunks()))))

        return salted.groupBy("__shard", "__part").cogroup(spread.groupBy("__shard", "__part")).applyInArrow(cogrouped, schema)

    def repeated(self, lines: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
        """(doc_id, version, pos) of the lines (doc_id, version, pos, digest) to drop: an owned key outside its owner."""
        hits = self.possible(lines, max_filter_bytes)
        return hits.join(self.owners, "digest").where("doc_id > owner").select("doc_id", "version", "pos")


def drop_repeated_lines(docs: DataFrame, index: LineIndex | None = None, least: int = LEAST_CHARS, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """`docs` with kept text in `text`, and n_lines and n_dropped."""
    docs = docs.drop("n_lines", "n_dropped")
    lines = durable(LineIndex._lines(docs, least), "line-digests")
    index = index or LineIndex.of(lines)
    gone = durable(index.repeated(lines, max_filter_bytes).distinct(), "line-drops")
    drops = durable(gone.groupBy("doc_id", "version").agg(F.collect_list("pos").alias("__drop")), "line-drops-by-text")
    size = drops.agg(F.coalesce(F.sum(48 + 4 * F.size("__drop")), F.lit(0))).first()[0]
    drops = drops.select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), "__drop")
    same = (docs["doc_id"] == drops["__id"]) & (F.xxhash64(docs["text"]) == drops["__version"])
    joined = docs.join(broadcast_if(drops, size, MAX_BROADCAST_BYTES), same, "left").drop("__id", "__version")
    left = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("__drop"))
    kept = let(F.split("text", "\n", -1), lambda x: F.array_join(F.transform(left(x), lambda i: F.get(x, i)), "\n"))
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("bigint")
    n_dropped = F.coalesce(F.size("__drop"), F.lit(0)).cast("bigint")
    rows = joined.withColumns({"n_lines": n_lines, "n_dropped": F.when(F.col("__drop").isNull(), F.lit(0)).otherwise(n_dropped).cast("bigint")})
    # Texts that lose nothing are passed on as they are.
    return rows.withColumn("text", F.when(F.col("__drop").isNull(), F.col("text")).otherwise(kept)).drop("__drop")
