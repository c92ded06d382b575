"""Readers: CSV under both null policies, two-row headers, archives, listings, record texts, JSON, signals."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("wav", "flac", "mp3", "ogg", "m4a")


def read_csv(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None, blanks_are_null: bool = True) -> DataFrame:
    """A CSV with a header and a declared schema. Without blanks_are_null, blanks stay "" and NA stays text."""
    reader = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("enforceSchema", False)
    if not blanks_are_null:
        reader = reader.option("nullValue", "\u0000").option("emptyValue", "")
    df = reader.csv(path)
    df = df.select(*columns) if columns else df
    return df if blanks_are_null else df.fillna("")


def read_two_row_header(spark: SparkSession, path: str, index: str = "index") -> DataFrame:
    """A CSV whose first two lines name (set, subset) of each column; the names are joined by a dot."""
    import csv

    head = [next(csv.reader([r["value"]])) for r in spark.read.text(path).limit(2).collect()]
    names = [index, *(f"{a.strip()}.{b.strip()}" for a, b in zip(head[0][1:], head[1][1:], strict=True))]
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = spark.read.schema(schema).option("header", False).option("escape", '"').csv(path)
    first = F.col(f"`{index}`")
    second = F.col(f"`{names[1]}`")
    is_head = F.lit(False)
    for h in head:
        is_head = is_head | (F.coalesce(first, F.lit("")).eqNullSafe(F.lit(h[0])) & second.eqNullSafe(F.lit(h[1])))
    return rows.where(~F.coalesce(is_head, F.lit(False)))


def read_zip_members(spark: SparkSession, path: str, suffix: str = ".csv") -> DataFrame:
    """(archive, member, content) of the matching members in name order; one archive a task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def members(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in sorted(n for n in z.namelist() if n.endswith(suffix)):
                        yield pa.RecordBatch.from_pydict({"archive": pa.array([name]), "member": pa.array([m]), "content": pa.array([z.read(m)], pa.binary())})

    return files.mapInArrow(members, "archive string, member string, content binary")


def parse_csv(df: DataFrame, content: str, schema: str, separator: str = ",") -> DataFrame:
    """Rows of CSV payloads with a header line, one payload a row."""
    lines = df.select(*(c for c in df.columns if c != content), F.posexplode(F.split(F.trim(F.col(content).cast("string"), F.lit("\r\n")), "\r?\n")).alias("line_no", "line")).where("line_no > 0")
    return lines.select(*(c for c in df.columns if c != content), "line_no", F.from_csv("line", F.lit(schema), {"sep": separator}).alias("r")).select("*", "r.*").drop("r")


def list_files(spark: SparkSession, path: str, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(path, length) of the files below a folder by extension; contents are not read."""
    glob = "*.{" + ",".join(suffixes) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length").distinct()


def path_index(df: DataFrame, path: Column, part: int) -> DataFrame:
    """(part, n, first): files grouped by one component of their paths."""
    return df.select(F.get(F.split(path, "/"), F.lit(part)).alias("part"), path.alias("p")).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("first"))


def record_texts(df: DataFrame, key: str, text: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """(key, i, names...): every match of a pattern over consecutive lines, one group a name."""
    found = df.select(F.col(key), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("i", "m"))
    return found.select(key, "i", *(F.regexp_extract("m", pattern, g + 1).alias(n) for g, n in enumerate(names)))


def checksum_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(sha, path) from lines "<digest> <path>"; the path may hold spaces."""
    parts = F.split(F.col(column), " ", 2)
    return lines.where(F.size(parts) == 2).select(F.get(parts, F.lit(0)).alias("sha"), F.regexp_replace(F.get(parts, F.lit(1)), r"^[ *]+", "").alias("path"))


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_wav(spark: SparkSession, path: str, channel: str = "mean") -> DataFrame:
    """(path, rate, wave) of PCM WAV files with one of the channel policies mean, left, right, mid, side."""
    if channel not in ("mean", "left", "right", "mid", "side"):
        raise ValueError(f"unsupported channel policy: {channel}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path).select("path", "content")

    def decode(batches):
        import wave

        import numpy as np

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
                    raw = np.frombuffer(w.readframes(w.getnframes()), {1: np.uint8, 2: np.int16, 4: np.int32}[width]).astype(np.float64)
                raw = (raw - 128) / 128 if width == 1 else raw / float(1 << (8 * width - 1))
                raw = raw.reshape(-1, channels)
                left, right = raw[:, 0], raw[:, -1]
                out = {"mean": raw.mean(axis=1), "left": left, "right": right, "mid": (left + right) / 2, "side": (left - right) / 2}[channel]
                yield pa.RecordBatch.from_pydict({"path": pa.array([name]), "rate": pa.array([rate], pa.int32()), "wave": pa.array([out], pa.list_(pa.float64()))})

    return files.mapInArrow(decode, "path string, rate int, wave array<double>")


def procedural(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """n deterministic item rows: (item, kind, generation_seed, file_fake, voice_fake, music_fake, voice_present, music_present)."""
    kind = F.element_at(F.array(F.lit("voice"), F.lit("music"), F.lit("mix")), (F.col("id") % 3 + 1).cast("int"))
    voice, music = kind.isin("voice", "mix").cast("int"), kind.isin("music", "mix").cast("int")
    rows = spark.range(n).withColumn("kind", kind)
    return rows.select(
        F.format_string("%s_%06d", kind, F.col("id")).alias("item"), "kind", (F.col("id") * 1009 + seed).alias("generation_seed"), F.lit(1).alias("file_fake"), voice.alias("voice_fake"), music.alias("music_fake"), voice.alias("voice_present"), music.alias("music_present")
    )
