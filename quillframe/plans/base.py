"""Registry of queries, and the evaluation table that many of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions.hashing import hashed_index, uniform

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function under its name, with its DuckDB SQL if it has one."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with their documents' attributes; texts are not read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id")


def mixed_score(name: str, share: float, label) -> F.Column:
    return (1 - share) * uniform(name, "doc_id") + share * label


#: score -> (share of the label, label)
SCORES = {
    "df": (0.4, "y_file"), "vf": (0.3, "y_voice"), "mf": (0.3, "y_music"), "vfile": (0.2, "y_file"), "mfile": (0.2, "y_file"),
    "vp_model": (0.4, "y_vp"), "mp_model": (0.4, "y_mp"), "vp_panns": (0.5, "y_vp"), "mp_panns": (0.5, "y_mp"),
}
DOMAINS = ("val_a", "val_b", "val_c", "val_d")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per labelled document: five labels, nine scores, folds and domains, all derived from keys."""
    rows = labelled(spark, sf_dir).select(
        "doc_id", "lang", "source", "n_chars", "quality", "toxic", F.col("quality").alias("y_file"), F.col("toxic").alias("y_voice"), ((F.col("quality") + F.col("toxic")) % 2).alias("y_music"),
        F.col("lang").isin("en", "de").cast("int").alias("y_vp"), (F.col("n_chars") % 2).cast("int").alias("y_mp"),
    )
    scored = rows.withColumns({k: (1 - share) * uniform(k, "doc_id") + share * F.col(label) for k, (share, label) in SCORES.items()})
    return scored.withColumns(
        {
            "df_primary": F.col("df"),
            "df_second": F.when(uniform("has", "doc_id") < 0.3, F.lit(None)).otherwise(uniform("second", "doc_id")),
            "duration_sec": F.col("n_chars") / F.lit(100.0),
            "fold": hashed_index("fold", 3, "doc_id"),
            "domain": F.element_at(F.array(*map(F.lit, DOMAINS)), (hashed_index("domain", 4, "doc_id") + 1).cast("int")),
        }
    )


def sql_index(seed: str, n: str | int, *keys: str) -> str:
    key = " || ':' || ".join(f"({k})::varchar" for k in keys)
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::bigint % {n})"


def sql_uniform(name: str, key: str = "doc_id") -> str:
    return f"({sql_index(name, 1000, key)} / 1000e0)"


_SQL_SCORES = ", ".join(f"{1 - share!r}::double * {sql_uniform(k)} + {share!r}::double * {label} as {k}" for k, (share, label) in SCORES.items())
FEATURES = f"""
lab as (select l.doc_id, l.quality, l.toxic, d.lang, d.source, d.n_chars from labels l join documents d using (doc_id)),
lab2 as (select *, quality y_file, toxic y_voice, (quality + toxic) % 2 y_music, case when lang in ('en', 'de') then 1 else 0 end y_vp, (n_chars % 2)::int y_mp from lab),
features as (
  select *, df as df_primary from (
    select *, {_SQL_SCORES}, case when {sql_uniform("has")} < 0.3e0 then null else {sql_uniform("second")} end df_second, n_chars / 100e0 duration_sec,
      {sql_index("fold", 3, "doc_id")} fold, ['val_a', 'val_b', 'val_c', 'val_d'][{sql_index("domain", 4, "doc_id")} + 1] as domain
    from lab2))
"""


def sql_rank(rel: str, keys: list[str], digits: int = 9) -> str:
    """A subquery (keys, n, n_pos, eer, threshold, auc) over a relation with y and s."""
    k = ", ".join(keys) or "1"
    by = f"partition by {k}"
    named = "".join(f"{x}, " for x in keys)
    eq = " and ".join(f"z.{x} = b.{x}" for x in keys) or "true"
    zk = "".join(f"z.{x}, " for x in keys)
    return f"""(
with p as (select {named}s, count(*) filter (y = 1) pos, count(*) filter (y <> 1) neg from {rel} where s is not null and isfinite(s) group by {named}s),
r as (select *, sum(pos) over ({by} order by s desc rows unbounded preceding)::double tp, sum(neg) over ({by} order by s desc rows unbounded preceding)::double fp,
  sum(pos) over ({by})::double tpos, sum(neg) over ({by})::double tneg from p),
o as (select *, row_number() over ({by} order by abs(fp / tneg - (1 - tp / tpos)), s desc) rn from r where tpos > 0 and tneg > 0),
a as (select {named}sum(pos * (tneg - fp + neg / 2e0)) / (max(tpos) * max(tneg)) auc from r where tpos > 0 and tneg > 0 {("group by " + k) if keys else ""}),
b as (select o.*, a.auc from o join a on {" and ".join(f"o.{x} = a.{x}" for x in keys) or "true"} where rn = 1),
z as (select {named}count(*) filter (s is not null and isfinite(s)) n, count(*) filter (s is not null and isfinite(s) and y = 1) n_pos from {rel} {("group by " + k) if keys else ""})
select {zk}z.n, z.n_pos, round(coalesce((b.fp / b.tneg + (1 - b.tp / b.tpos)) / 2, 0.5e0), {digits}) eer, b.s threshold, round(coalesce(b.auc, 0.5e0), {digits}) auc from z left join b on {eq})"""


def sql_composite(rel: str, keys: list[str], heads: dict[str, tuple[str, str, str | None]], digits: int = 9) -> str:
    """A subquery (keys, file_eer, voice_eer, music_eer, voice_auc, music_auc, ads, cps, total)."""
    named = "".join(f"{x}, " for x in keys)
    long = " union all ".join(f"select {named}'{h}' head, {y} y, {s} s from {rel}" + (f" where {p} = 1" if p else "") for h, (y, s, p) in heads.items())
    pick = lambda h, m: f"coalesce(max(case when head = '{h}' then {m} end), 0.5e0)"
    group = f"group by {', '.join(keys)}" if keys else ""
    return f"""(
with long as ({long}), each as (select * from {sql_rank("long", [*keys, "head"], 15)}),
w as (select {named}{pick("file", "eer")} fe, {pick("voice", "eer")} ve, {pick("music", "eer")} me, {pick("vp", "auc")} va, {pick("mp", "auc")} ma from each {group}),
v as (select *, 0.5e0 * (1 - fe) + 0.2e0 * (1 - ve) + 0.3e0 * (1 - me) ads_, 0.5e0 * (va + ma) cps_ from w)
select {named}round(fe, {digits}) file_eer, round(ve, {digits}) voice_eer, round(me, {digits}) music_eer, round(va, {digits}) voice_auc, round(ma, {digits}) music_auc,
  round(ads_, {digits}) ads, round(cps_, {digits}) cps, round(0.9e0 * ads_ + 0.1e0 * cps_, {digits}) total from v)"""


#: Heads read straight from features, without fusion.
RAW_HEADS = {"file": ("y_file", "df", None), "voice": ("y_voice", "vf", "y_vp"), "music": ("y_music", "mf", "y_mp"), "vp": ("y_vp", "vp_model", None), "mp": ("y_mp", "mp_model", None)}
