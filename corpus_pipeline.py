"""From documents to packed training bins: language, lines, near-duplicates, benchmark passages, bins.

Every stage works on all documents that its predecessor kept. All but the last return the columns of
`documents`; a stage that changes texts sets n_chars anew. For the near-duplicate stage, rows that repeat a doc_id with
another text are documents of their own; equal documents count once, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import decontaminate, jaccard_join, language_id, line_dedup, packing
from quillframe.llm.common import durable, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near-duplicates share at least so many percent of their shingles of so many words.
WORDS, PERCENT = 5, 80
#: Batches for Python are bounded by bytes for the session, since stages are executed by whoever writes their results.
BATCH_BYTES = 2 << 20


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`lang` becomes the predicted language. Documents without any letter have none and go."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    judged = language_id.identify(docs.select(*COLUMNS), model).where("lang_pred <> 'und'")
    return judged.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; the documents stay."""
    done = line_dedup.drop_repeated_lines(docs.select(*COLUMNS))
    return done.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by word shingles, the one with the smallest doc_id (then hash of its text) stays.

    Rows with equal doc_id and text are one document; of their other columns, the smallest stay. A null doc_id ranks first.
    """
    docs = docs.select(*COLUMNS)
    name = F.struct("doc_id", F.xxhash64("text").alias("version"))
    found = jaccard_join.similar_documents(docs.select(name.alias("doc_id"), "text"), words=WORDS, percent=PERCENT)
    found = durable(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("component_id").alias("component_id")), "pipeline-components")
    keyed = docs.withColumn("__name", name)
    later = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__name"))
    kept = keyed.join(later, "__name", "left_anti")
    repeated = durable(found.where("n > 1").select(F.col("doc_id").alias("__name")), "pipeline-repeated")
    if repeated.limit(1).count():
        rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
        once = kept.join(repeated, "__name", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("__rest"))
        kept = kept.join(repeated, "__name", "left_anti").select(*COLUMNS).unionByName(once.select("doc_id", "text", "__rest.*"))
    return kept.select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least a twentieth is benchmark passages go."""
    judged = decontaminate.decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    bad = judged.where("contaminated").select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("__bad")), "left_anti").select(*COLUMNS)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack_bins),
]

#: Learning languages is not SQL; the whole run is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
