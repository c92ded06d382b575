"""Queries over manifests: sources, rules, contracts between tables, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions import manifest
from quillframe.operators import joins, metrics
from quillframe.plans.base import FEATURES, labelled, query, sql_index, table
from quillframe.sources import readers, sinks

#: How a page's url is turned into a corpus path for the path rules.
_KINDS = ("librispeech/84", "ASVspoof2019/spoof", "wavefake/LJ001-0001_melgan", "fma/000123", "FakeMusicCaps/musicgen", "silence", "mlaad/bonafide", "other")


def _paths(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("page_id") % len(_KINDS) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/data/"), kind, F.lit("/"), F.regexp_replace("url", "[^A-Za-z0-9/._-]", "_")).alias("path"))


_PATHS = f"paths as (select page_id, '/data/' || {list(_KINDS)!r}[page_id % {len(_KINDS)} + 1] || '/' || regexp_replace(url, '[^A-Za-z0-9/._-]', '_', 'g') path from pages)"
_FMA = "(p like '%fma%' or (p like '%musiccaps%' and p not like '%fake%'))"


@query(
    f"""with {_PATHS}, l as (select page_id, lower(path) p from paths),
k as (select *, case when p like '%libri%' or p like '%common\\_voice%' escape '\\' then 'voice' when p like '%asvspoof%' or p like '%wavefake%' or p like '%mlaad%' then 'synthetic' when {_FMA} then 'music'
  when p like '%fakemusiccaps%' or (p like '%music%' and p like '%fake%') then 'fake_music' when p like '%silence%' then 'silence' else 'voice' end kind from l),
f as (select *, kind = 'synthetic' and not (p like '%bonafide%' or p like '%real%' or p like '%librispeech%') vf from k)
select page_id, (vf or kind = 'fake_music')::int file_fake, vf::int voice_fake, (kind = 'fake_music')::int music_fake, (kind in ('voice', 'synthetic'))::int voice_present, (kind in ('music', 'fake_music'))::int music_present from f"""
)
def q27_label_inference_from_path(spark, sf_dir):
    return _paths(spark, sf_dir).select("page_id", manifest.labels_from_path(F.col("path")).alias("l")).select("page_id", "l.*")


@query(
    f"""with {_PATHS}, x as (select page_id, path, case page_id % 5 when 0 then 'wavefake' when 1 then 'LibriTTS' when 2 then 'asvspoof' when 3 then 'fma_full' else null end source, regexp_extract(path, '([^/]*)$', 1) orig, 'spk_' || page_id % 7 spk, case when page_id % 11 = 0 then 'fixed_' || page_id else null end explicit from paths),
y as (select *, upper(regexp_extract(path, '(?i)(LJ[0-9]+-[0-9]+)', 1)) take, lower(coalesce(source, '')) s from x)
select page_id, case when explicit is not null then explicit when s like '%wavefake%' or take <> '' then 'wavefake::' || case when take <> '' then take else path end when s like '%libri%' then 'libri::' || spk when s like '%asvspoof%' then 'asvspoof::' || spk
  when s like '%gtzan%' or s like '%fma%' then 'gtzan::' || path else case when s = '' then 'unknown' else s end || '::' || path end group_id from y"""
)
def q28_group_id(spark, sf_dir):
    n = F.col("page_id")
    source = F.when(n % 5 == 0, "wavefake").when(n % 5 == 1, "LibriTTS").when(n % 5 == 2, "asvspoof").when(n % 5 == 3, "fma_full")
    explicit = F.when(n % 11 == 0, F.concat(F.lit("fixed_"), n))
    return _paths(spark, sf_dir).select("page_id", manifest.group_id(explicit, source, F.col("path"), F.concat(F.lit("spk_"), n % 7)).alias("group_id"))


_APPROVAL = ("YES", "no", "Rejected", "maybe", " yes ")


@query(f"select s_suppkey, case upper(trim({list(_APPROVAL)!r}[s_suppkey % 5 + 1])) when 'YES' then 'APPROVED' when 'NO' then 'REJECTED' when 'REJECTED' then 'REJECTED' else 'REVIEW_REQUIRED' end status from supplier")
def q29_status_mapping(spark, sf_dir):
    approval = F.element_at(F.array(*map(F.lit, _APPROVAL)), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", manifest.status(approval).alias("status"))


_LICENCES = ("https://creativecommons.org/licenses/by/4.0", "CC BY-NC-SA", "cc by-nd 4.0", "", "All rights reserved", "Creative Commons NoDerivatives")
_OPEN = (True, True, False, False, False, False)


@query(f"select s_suppkey, {[int(x) for x in _OPEN]!r}[s_suppkey % 6 + 1] = 1 as is_open from supplier")
def q30_license_predicate(spark, sf_dir):
    licence = F.element_at(F.array(*map(F.lit, _LICENCES)), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", manifest.open_licence(licence).alias("is_open"))


@query(
    """with p(r, n, licence) as (values (0, '*', 'general-0'), (0, 'KENYA', 'kenya'), (1, '*', 'general-1'), (2, '*', 'general-2'), (3, '*', 'general-3'), (4, '*', 'general-4'), (4, 'IRAN', 'iran'))
select s.s_suppkey, na.n_name, coalesce(e.licence, g.licence) licence from supplier s join nation na on s.s_nationkey = na.n_nationkey left join p e on e.r = na.n_regionkey and e.n = na.n_name and e.n <> '*' left join p g on g.r = na.n_regionkey and g.n = '*'"""
)
def q31_policy_join_wildcard(spark, sf_dir):
    policy = spark.createDataFrame([(0, "*", "general-0"), (0, "KENYA", "kenya"), (1, "*", "general-1"), (2, "*", "general-2"), (3, "*", "general-3"), (4, "*", "general-4"), (4, "IRAN", "iran")], "n_regionkey int, n_name string, licence string")
    nations = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return joins.policy_join(rows, policy, "n_regionkey", "n_name", ["licence"]).select("s_suppkey", "n_name", "licence")


@query("select o_orderkey, c_name, c_mktsegment from orders join customer on o_custkey = c_custkey")
def q32_lookup_in_order(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name", "c_mktsegment")
    return joins.lookup(orders, customers, "k").select("o_orderkey", "c_name", "c_mktsegment")


@query("select p_partkey id, p_brand, p_retailprice from part")
def q33_one_to_one_join(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    return joins.one_to_one(part.select("id", "p_brand"), part.select("id", "p_retailprice"), "id")


@query(
    """with r as (select case when c_custkey % 2 = 0 then 'c' || c_custkey else 'c' || c_custkey || '.wav' end rid, c_acctbal score from customer), s as (select 'c' || c_custkey || '.wav' sid from customer)
select s.sid, coalesce(a.score, b.score) score, a.rid is not null or b.rid is not null matched from s left join r a on a.rid = s.sid left join r b on a.rid is null and b.rid = regexp_replace(s.sid, '\\.[^.]*$', '')"""
)
def q34_exact_id_mapping(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    name = F.concat(F.lit("c"), F.col("c_custkey"))
    results = customers.select(F.when(F.col("c_custkey") % 2 == 0, name).otherwise(F.concat(name, F.lit(".wav"))).alias("rid"), F.col("c_acctbal").alias("score"))
    sample = customers.select(F.concat(name, F.lit(".wav")).alias("sid"))
    return joins.by_id_or_stem(sample, results, "sid", "rid")


@query("select p_partkey row_index, p_brand, p_size, round(p_retailprice * 2, 4) double_price from part")
def q35_positional_alignment(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    left = part.select(F.col("p_partkey").alias("row_index"), "p_brand", "p_size")
    right = part.select(F.col("p_partkey").alias("row_index"), "p_brand", F.round(F.col("p_retailprice") * 2, 4).alias("double_price"))
    return joins.aligned(left, right, "row_index", ["p_brand"]).select("row_index", "p_brand", "p_size", "double_price")


@query("""select json_extract_string(props, '$.k') as k, count(*) n, round(avg(value), 6) mean from events group by 1""")
def q73_json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


_RECORD = r"(\w+)[^\n]*\n([^\n]+)\n(\w+)"


@query(
    r"""with t as (select page_id, 'id' || page_id || ' x' || chr(10) || url || chr(10) || 'by' || chr(10) || 'again x' || chr(10) || upper(url) || chr(10) || 'nd' as txt from pages), m as (select page_id, unnest(regexp_extract_all(txt, '(\w+)[^\n]*\n([^\n]+)\n(\w+)', 0)) m, generate_subscripts(regexp_extract_all(txt, '(\w+)[^\n]*\n([^\n]+)\n(\w+)', 0), 1) - 1 i from t)
select page_id, i::int i, regexp_extract(m, '(\w+)[^\n]*\n([^\n]+)\n(\w+)', 1) track, regexp_extract(m, '(\w+)[^\n]*\n([^\n]+)\n(\w+)', 2) url, regexp_extract(m, '(\w+)[^\n]*\n([^\n]+)\n(\w+)', 3) licence from m"""
)
def q74_three_line_records(spark, sf_dir):
    n = F.lit("\n")
    text = F.concat(F.lit("id"), F.col("page_id"), F.lit(" x"), n, F.col("url"), n, F.lit("by"), n, F.lit("again x"), n, F.upper("url"), n, F.lit("nd"))
    return readers.record_texts(table(spark, sf_dir, "pages").select("page_id", text.alias("txt")), "page_id", "txt", _RECORD, ["track", "url", "licence"])


@query("select md5(url) sha, url || ' part ' || page_id path from pages")
def q75_checksum_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "pages").select(F.concat(F.md5("url"), F.lit("  "), F.col("url"), F.lit(" part "), F.col("page_id")).alias("value"))
    return readers.checksum_lines(lines)


@query("select string_split(url, '/')[4] part, count(*) n, min(url) first from pages group by 1")
def q95_path_index(spark, sf_dir):
    return readers.path_index(table(spark, sf_dir, "pages"), F.col("url"), 3)


@query("with i as (select id, ['voice', 'music', 'mix'][id % 3 + 1] kind from range(300) t(id)) select kind || '_' || lpad(id::varchar, 6, '0') item, kind, id * 1009 + 5 generation_seed, 1 file_fake, (kind <> 'music')::int voice_fake, (kind <> 'voice')::int music_fake, (kind <> 'music')::int voice_present, (kind <> 'voice')::int music_present from i")
def q96_procedural_source(spark, sf_dir):
    return readers.procedural(spark, 300, 5)


@query("select url path, sha256(html) sha, sha256(html) || coalesce(nullif(regexp_extract(url, '(\\.[^./]*)$', 1), ''), '') address from pages")
def q97_content_addresses(spark, sf_dir):
    return sinks.content_addresses(table(spark, sf_dir, "pages"), "url", "html")


@query(f"with {FEATURES} select 'doc_' || doc_id id, {sql_index('p', 1000, 'doc_id')} / 1000e0 FILE_FAKE_PROB, quality::double VOICE_FAKE_PROB, toxic::double MUSIC_FAKE_PROB, 0.5e0 VOICE_PRESENT_PROB, 1e0 MUSIC_PRESENT_PROB from lab")
def q98_submission(spark, sf_dir):
    from quillframe.functions.hashing import uniform

    rows = labelled(spark, sf_dir).select(
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("id"), uniform("p", "doc_id").alias("FILE_FAKE_PROB"), F.col("quality").cast("double").alias("VOICE_FAKE_PROB"), F.col("toxic").cast("double").alias("MUSIC_FAKE_PROB"), F.lit(0.5).alias("VOICE_PRESENT_PROB"), F.lit(1.0).alias("MUSIC_PRESENT_PROB")
    )
    return sinks.submission(rows, {})


@query(
    """with n as (select p_partkey, regexp_replace(lower(p_name || ' no. ' || p_partkey), '[^a-z0-9]', '', 'g') k from part), o as (select p_partkey rid, upper(p_name) || ' (No ' || p_partkey || ')' t from part), r as (select * from o union all select * from o where rid % 3 = 0), u as (select regexp_replace(lower(t), '[^a-z0-9]', '', 'g') k, min(rid) rid from r group by 1 having count(*) = 1)
select p_partkey, rid from n join u using (k)"""
)
def q99_unique_title_join(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    titles = part.select(F.col("p_partkey").alias("rid"), F.concat(F.upper("p_name"), F.lit(" (No "), "p_partkey", F.lit(")")).alias("t"))
    right = titles.unionByName(titles.where("rid % 3 = 0"))  # titles that two rows have match nothing
    own = F.concat("p_name", F.lit(" no. "), "p_partkey")
    return joins.unique_key_join(part.select("p_partkey", "p_name"), right, manifest.normalised_title(own), manifest.normalised_title(F.col("t"))).select("p_partkey", "rid")


@query(
    """with r as (select case when page_id % 3 = 0 then 'MIX::a' || page_id || '|b' || page_id when page_id % 3 = 1 then 'PARTIAL::voice::a' || page_id || '|b' || page_id else 'p' || page_id end path, page_id from pages)
select page_id, case page_id % 3 when 0 then 'mix' when 1 then 'partial' else 'plain' end kind, case when page_id % 3 = 1 then 'voice' end component, case when page_id % 3 = 2 then 'p' else 'a' end || page_id as "left", case when page_id % 3 <> 2 then 'b' || page_id end as "right",
  replace(path, 'b', 'moved/b') rewritten, page_id % 3 < 2 derived from r"""
)
def q100_recipe_paths(spark, sf_dir):
    n = F.col("page_id")
    pair = F.concat(F.lit("a"), n, F.lit("|b"), n)
    path = F.when(n % 3 == 0, F.concat(F.lit("MIX::"), pair)).when(n % 3 == 1, F.concat(F.lit("PARTIAL::voice::"), pair)).otherwise(F.concat(F.lit("p"), n))
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("r", manifest.parse_recipe(F.col("path")))
    moved = F.col("r").withField("right", F.concat(F.lit("moved/"), F.col("r.right")))
    return rows.select("page_id", "r.*", manifest.build_recipe(moved).alias("rewritten"), manifest.is_recipe(F.col("path")).alias("derived"))


@query("select lang, count(*) n, round(avg(n_chars), 6) mean, max(n_chars) most, case when max(n_chars) <= 4000 then '<=4000' when max(n_chars) <= 16000 then '(4000,16000]' else '>16000' end bucket from documents group by 1")
def q101_bucketed_report(spark, sf_dir):
    agg = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.max("n_chars").alias("most"))
    return agg.withColumn("bucket", manifest.right_closed(F.col("most"), [4000, 16000], ["<=4000", "(4000,16000]", ">16000"], "none"))


@query("select n_regionkey, count(*) n, string_agg(n_name, ',' order by n_name) names, count(distinct n_name) = 5 complete from nation group by 1")
def q102_set_aggregate(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("names"), (F.count_distinct("n_name") == 5).alias("complete"))


@query(f"with {FEATURES} select source, string_agg(quality || ':' || n, ',' order by quality) counts from (select source, quality, count(*) n from lab group by 1, 2) group by 1")
def q103_nested_counts(spark, sf_dir):
    each = labelled(spark, sf_dir).groupBy("source", "quality").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("quality", "n"))), lambda x: F.concat_ws(":", x["quality"], x["n"])), ",").alias("counts"))


@query("select o_orderpriority, o_orderstatus, o_orderkey from (select *, row_number() over (partition by o_orderpriority order by o_orderstatus, o_totalprice desc, o_orderkey) r from orders) where r <= 10")
def q104_mixed_sort_top(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", "o_orderkey", "o_totalprice")
    ranked = orders.withColumn("r", metrics.rank_in(["o_orderpriority"], F.col("o_orderstatus"), F.desc("o_totalprice"), F.col("o_orderkey")))
    return ranked.where("r <= 10").select("o_orderpriority", "o_orderstatus", "o_orderkey")
