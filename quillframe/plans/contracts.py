"""Queries over sources, sinks and contracts: tables that are written and read again, path rules, lookups, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions import manifest
from quillframe.functions.scoring import segment_scorer
from quillframe.operators import joins, manifests, sampling
from quillframe.plans.base import query, table
from quillframe.sources import readers, sinks
from quillframe.sources.durable import new_path

_PART = "p_partkey bigint, p_name string, p_brand string, p_size int"


@query("select p_partkey, p_name, p_brand, p_size from part")
def q112_csv_round_trip(spark, sf_dir):
    path = new_path(spark, "q112")
    sinks.write_csv(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size"), path)
    return readers.read_csv(spark, path, _PART)


@query("select c_custkey id, case when c_custkey % 3 = 0 then '' when c_custkey % 3 = 1 then 'NA' else c_name end as name from customer union all select c_custkey + 10000000, 'added, \"quoted\"' from customer")
def q113_csv_blanks_and_append(spark, sf_dir):
    path, customers = new_path(spark, "q113"), table(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, "NA").otherwise(F.col("c_name"))
    sinks.write_csv(customers.select(F.col("c_custkey").alias("id"), name.alias("name")), path)
    sinks.append_csv(customers.select((F.col("c_custkey") + 10_000_000).alias("id"), F.lit('added, "quoted"').alias("name")), path)
    return readers.read_csv(spark, path, "id bigint, name string", blanks_are_null=False)


@query("select o_orderkey, o_orderstatus, o_totalprice from orders")
def q114_cache_with_metadata(spark, sf_dir):
    path, meta = new_path(spark, "q114"), {"version": "1", "source": "orders"}
    sinks.save_cache(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path, meta)
    return sinks.load_cache(spark, path, meta)


@query("select s_suppkey, s_name, s_acctbal from supplier where s_suppkey % 2 = 0")
def q115_published_version(spark, sf_dir):
    """The second publication replaces the first as a whole."""
    path, suppliers = new_path(spark, "q115"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    sinks.publish(suppliers, path)
    sinks.publish(suppliers.where("s_suppkey % 2 = 0"), path)
    return spark.read.parquet(path)


@query("select '{\"p_partkey\":' || p_partkey || ',\"p_size\":' || p_size || '}' report from part")
def q116_report_rows(spark, sf_dir):
    return sinks.report_row(table(spark, sf_dir, "part"), "p_partkey", "p_size")


_PATHS = """p as (select p_partkey, case p_partkey % 10 when 0 then '/data/LibriSpeech/' || p_partkey || '/a.flac' when 1 then '/x/asvspoof2019/LA_' || p_partkey || '.wav' when 2 then '/x/ASVspoof2021/e' || p_partkey || '.wav'
  when 3 then '/w/wavefake/hifigan_' || p_partkey || '.wav' when 4 then '/m/mlaad/f' || p_partkey || '.wav' when 5 then '/f/fma_large/' || 'a' || p_partkey || '.mp3' when 6 then '/g/FakeMusicCaps/MusicGen/g' || p_partkey || '.wav'
  when 7 then '/g/fakemusiccaps/audioldm2/g' || p_partkey || '.wav' when 8 then '/c/common_voice/c' || p_partkey || '.mp3' else '/other/o' || p_partkey || '.wav' end path from part)"""


@query(
    f"""with {_PATHS} select p_partkey, case when p_partkey % 10 = 0 and p_partkey < 10000 then 'spk_' || p_partkey when p_partkey % 10 = 0 then 'libri_' || substr(md5(path), 1, 6) when p_partkey % 10 = 1 then 'asv2019' when p_partkey % 10 = 2 then case when contains(path, '2019') then 'asv2019' else 'asv2021' end
  when p_partkey % 10 = 3 then 'wavefake_' || substr(md5(path), 1, 4) when p_partkey % 10 = 4 then 'mlaad' when p_partkey % 10 = 5 then 'fma_' || substr('a' || p_partkey, 1, 3) when p_partkey % 10 = 6 then 'musicgen' when p_partkey % 10 = 7 then 'audioldm' when p_partkey % 10 = 8 then 'common_voice' else 'unknown' end speaker,
  ['LibriSpeech', 'ASV2019', case when contains(path, '19') then 'ASV2019' else 'ASV2021' end, 'HiFiGAN', 'MLAAD', 'FMA', 'MusicGen', 'AudioLDM2', 'unknown', 'unknown'][p_partkey % 10 + 1] generator from p"""
)
def q117_names_from_paths(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    path = lambda head, tail: F.concat(F.lit(head), k, F.lit(tail))
    made = [path("/data/LibriSpeech/", "/a.flac"), path("/x/asvspoof2019/LA_", ".wav"), path("/x/ASVspoof2021/e", ".wav"), path("/w/wavefake/hifigan_", ".wav"), path("/m/mlaad/f", ".wav"), path("/f/fma_large/a", ".mp3"), path("/g/FakeMusicCaps/MusicGen/g", ".wav"), path("/g/fakemusiccaps/audioldm2/g", ".wav"), path("/c/common_voice/c", ".mp3"), path("/other/o", ".wav")]
    rows = table(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*made), (F.col("p_partkey") % 10).cast("int")).alias("path"))
    return rows.select("p_partkey", manifest.speaker_from_path(F.col("path")).alias("speaker"), manifest.generator_from_path(F.col("path")).alias("generator"))


@query("select o_orderkey, coalesce(c_mktsegment, 'none') c_mktsegment from orders left join (select * from customer where c_custkey % 4 <> 0) on c_custkey = o_custkey")
def q118_mapped_with_default(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select("c_custkey", "c_mktsegment")
    return joins.mapped(orders, customers, "c_custkey", "c_mktsegment", F.lit("none")).select("o_orderkey", "c_mktsegment")


@query("select s_suppkey, row_number() over (order by md5('9:' || s_suppkey), s_suppkey) place from supplier")
def q119_shuffled_order(spark, sf_dir):
    """Places of the seeded shuffle, from the rows in its order."""
    rows = sampling.shuffled(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", 9)
    path = new_path(spark, "q119")
    rows.coalesce(1).write.parquet(path)
    return spark.read.parquet(path).coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1)


@query("select n_name as name from nation union select s_name from supplier union select n_name from nation")
def q120_union_distinct(spark, sf_dir):
    nations, suppliers = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    return nations.union(suppliers).union(nations).distinct()


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) k, coalesce(try_cast(case when event_id % 2 = 0 then event_type else '17' end as bigint), -1) kind, cast(value as varchar) is null missing, cast(trunc(value) as bigint) whole from events")
def q121_casts(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.coalesce(F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("17").try_cast("bigint"), F.lit(-1)).alias("kind"), F.col("value").cast("string").isNull().alias("missing"), F.col("value").cast("bigint").alias("whole"))


@query("select n_nationkey, r_name, len(r_name)::int width from nation join region on r_regionkey = n_regionkey")
def q122_maps(spark, sf_dir):
    """Keys and values of a map per row, looked up by key."""
    regions = table(spark, sf_dir, "region").select(F.map_from_arrays(F.array("r_regionkey"), F.array("r_name")).alias("m"), "r_regionkey")
    rows = table(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    found = F.element_at("m", F.col("n_regionkey"))
    return rows.select("n_nationkey", found.alias("r_name"), F.aggregate(F.map_values("m"), F.lit(0), lambda a, x: a + F.char_length(x)).alias("width"))


@query("select 'a' side, region_id, name from (select r_regionkey region_id, r_name as name from region) union all select 'b', n_regionkey, n_name from nation")
def q123_union_of_manifests(spark, sf_dir):
    a = table(spark, sf_dir, "region").select(F.lit("a").alias("side"), F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("name"))
    b = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("b").alias("side"), F.col("n_regionkey").alias("region_id"))
    return manifests.union_all([a, b])


_SCORES = "list_transform(embedding, lambda x: x::double)"


@query(
    f"""with v as (select vec_id, {_SCORES} x from embeddings), s as (select vec_id, list_sum(list_transform(x, lambda z: z * z)) / len(x) power,
  list_sum(list_transform(range(2, len(x) + 1), lambda i: case when (x[i] < 0) <> (x[i - 1] < 0) then 1e0 else 0e0 end)) / (len(x) - 1) turns from v) select vec_id, case when vec_id % 7 <> 0 then round(1 / (1 + exp(-(4 * turns - 2 + power))), 9) end score from s"""
)
def q124_scores_beside_nulls(spark, sf_dir):
    """The batch scorer's values; a row without a segment has none and changes nobody else's."""
    x = F.when(F.col("vec_id") % 7 != 0, F.transform("embedding", lambda z: z.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", segment_scorer()(x).alias("score"))
