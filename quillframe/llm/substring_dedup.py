"""Substring dedup by line or paragraph hashing.

Units are lines (or paragraphs, split at blank lines). A unit's key is its text with runs of white
space made one space, ends stripped and A-Z lower-cased; keys of fewer than `least_words` words are
left alone. Digests are grouped over the whole corpus; the occurrence that ranks first (by `rank`
columns, then doc_id, then position) stays and every other one is removed, also within a document.
Each removed unit is reported with its original character offsets.

A digest's rows are pre-aggregated to its first occurrence before they shuffle; the join that marks
the others is an inner join against one row a digest, whose large partitions Spark may split.

What it does not find: a passage inside longer units that differ elsewhere (op4 and `passages` find those), and units of fewer than
`least_words` words, which are headings and list items as a rule.

Null and empty texts have no unit. A null doc_id ranks first. Documents that repeat a doc_id are told
apart by the hash of their text; equal rows are one document. Other columns of the input are not used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, broadcast_if, durable, let, split_words
from .lines import digest

LEAST_WORDS = 8
#: Most bytes of removed units that are broadcast instead of shuffling texts to them.
MAX_BROADCAST_BYTES = 48 << 20
#: Separators of units. A paragraph ends at a line of white space.
SPLIT = {"line": "\n", "paragraph": "\n[\\x20\\x09\\x0B-\\x0D]*\n"}


def unit_rows(docs: DataFrame, unit: str = "line", least_words: int = LEAST_WORDS, rank: tuple[str, ...] = ()) -> DataFrame:
    """(rank..., doc_id, version, pos, digest, n_words) of every unit that counts."""
    pieces = F.split(F.coalesce(F.col("text"), F.lit("")), SPLIT[unit], -1)
    keyed = lambda u: let(split_words(u, SPACE), lambda ws: F.struct(ascii_lower(F.array_join(ws, " ")).alias("key"), F.size(ws).alias("n")))
    rows = docs.select(*rank, "doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.transform(pieces, keyed)).alias("pos", "u")).where(F.col("u.n") >= least_words)
    return rows.select(*rank, "doc_id", "version", "pos", digest(F.col("u.key")).alias("digest"), F.col("u.n").alias("n_words"))


def repeated_units(docs: DataFrame, unit: str = "line", least_words: int = LEAST_WORDS, rank: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, version, pos, n_words, keeper): every unit but the first-ranked of its digest; keeper is that one's doc_id."""
    if unit not in SPLIT:
        raise ValueError(f"unit must be one of {sorted(SPLIT)}")
    rows = durable(unit_rows(docs, unit, least_words, rank), "units")
    first = F.struct(*rank, "doc_id", "version", "pos")
    per_key = rows.groupBy("digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    # A table of its own: then the join shuffles both sides alone, and Spark may split a hot digest's rows.
    per_key = durable(per_key, "repeated-units")
    return rows.join(per_key, "digest").where(~first.eqNullSafe(F.col("first"))).select("doc_id", "version", "pos", "n_words", F.col("first.doc_id").alias("keeper")).distinct()


def remove_repeated(docs: DataFrame, unit: str = "line", least_words: int = LEAST_WORDS, rank: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: doc_id, n_units, n_removed, n_removed_words, n_removed_chars, kept_text and removed: array of (pos, start, length, keeper).

    Offsets are code points of the original text. Kept units are joined by the unit's separator.
    """
    removed = repeated_units(docs, unit, least_words, rank)
    gone = removed.groupBy("doc_id", "version").agg(F.sort_array(F.collect_list(F.struct("pos", "n_words", "keeper"))).alias("__gone"))
    gone = durable(gone, "removed-units")
    size = gone.agg(F.coalesce(F.sum(48 + 32 * F.size("__gone")), F.lit(0))).first()[0]
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), "__gone")
    base = docs.select("doc_id", "text", F.xxhash64("text").alias("version"))
    joined = base.join(broadcast_if(gone, size, MAX_BROADCAST_BYTES), base["doc_id"].eqNullSafe(gone["__id"]) & (base["version"] == gone["__version"]), "left")
    keeper = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {keeper}, n_units bigint, n_removed bigint, n_removed_words bigint, n_removed_chars bigint, kept_text string, removed array<struct<pos:int,start:int,length:int,keeper:{keeper}>>"

    def rewrite(batches):
        import re

        import pyarrow as pa

        blank = re.compile("\n[\x20\x09\x0b-\x0d]*\n")
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("start", pa.int32()), ("length", pa.int32()), ("keeper", pa_keeper)]))
        for batch in batches:
            ids, out = batch.column("doc_id"), {"n_units": [], "n_removed": [], "n_removed_words": [], "n_removed_chars": [], "kept_text": [], "removed": []}
            for text, drop in zip(batch.column("text").to_pylist(), batch.column("__gone").to_pylist(), strict=True):
                text = text or ""
                cuts = [(m.start(), m.end()) for m in (blank.finditer(text) if unit == "paragraph" else re.finditer("\n", text))]
                starts, ends = [0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(text)]
                out["n_removed_words"].append(sum(d["n_words"] for d in drop or ()))
                drop = {d["pos"]: d["keeper"] for d in drop or ()}
                out["n_removed_chars"].append(sum(ends[p] - starts[p] for p in drop))
                kept = [text[a:b] for k, (a, b) in enumerate(zip(starts, ends, strict=True)) if k not in drop]
                out["n_units"].append(len(starts))
                out["n_removed"].append(len(drop))
                out["kept_text"].append(("\n\n" if unit == "paragraph" else "\n").join(kept))
                out["removed"].append([{"pos": p, "start": starts[p], "length": ends[p] - starts[p], "keeper": k} for p, k in sorted(drop.items())])
            kinds = {"kept_text": pa.string(), "removed": kind}
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items())], names=["doc_id", *out])

    from pyspark.sql.pandas.types import to_arrow_type

    pa_keeper = to_arrow_type(docs.schema["doc_id"].dataType)
    return joined.select("doc_id", "text", "__gone").mapInArrow(rewrite, schema)
