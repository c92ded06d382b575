"""Queries over items: duplicates, splits, sampling, pairing, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions.hashing import hashed_index
from quillframe.operators import dedup, joins, metrics, pairing, sampling, search, splits
from quillframe.plans.base import FEATURES, features, labelled, query, sql_index, sql_rank, sql_uniform, table


@query("select sha256(text) sha, count(*) n, string_agg(doc_id::varchar, ',' order by doc_id) members from documents group by 1 having count(*) > 1")
def q08_exact_duplicates(spark, sf_dir):
    return dedup.exact_groups(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("select doc_id, lang, source from (select *, row_number() over (partition by sha256(text) order by doc_id) r from documents) where r = 1")
def q09_dedup_keep_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("sha"))
    return dedup.keep_first(docs, ["sha"], ["doc_id"]).select("doc_id", "lang", "source")


@query("select source, count(*) n, count(distinct sha256(text)) n_unique, round(count(distinct sha256(text))::double / count(*), 9) ratio from documents group by 1")
def q10_uniqueness_ratio(spark, sf_dir):
    return dedup.uniqueness(table(spark, sf_dir, "documents"), ["source"], "text")


_V = "v as (select vec_id, label, list_transform(embedding, lambda x: x::double) e from embeddings)"


@query(f"with {_V} select a.vec_id a, b.vec_id b, round(list_inner_product(a.e, b.e), 6) similarity from v a join v b on a.vec_id < b.vec_id and a.label <> b.label where round(list_inner_product(a.e, b.e), 6) >= 0.45")
def q11_near_duplicate_pairs(spark, sf_dir):
    return dedup.similar_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.45, label="label")


@query(f"with {_V}, s as (select a.vec_id id, b.vec_id neighbour, round(list_inner_product(a.e, b.e), 6) similarity from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id) select id, neighbour, similarity from (select *, row_number() over (partition by id order by similarity desc, neighbour) r from s) where r = 1")
def q12_nearest_neighbour(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return dedup.nearest_neighbours(vectors.where("vec_id % 50 = 0"), vectors, "vec_id", "embedding")


@query(
    f"""with recursive {_V}, p as (select a.vec_id a, b.vec_id b from v a join v b on a.vec_id < b.vec_id where round(list_inner_product(a.e, b.e), 6) >= 0.42), e as (select a, b from p union select b, a from p),
c as (select a node, a root from e union select e.b, c.root from c join e on c.node = e.a), m as (select node, min(root) comp from c group by node),
g as (select comp, substr(sha256(string_agg(node::varchar, chr(10) order by node)), 1, 20) h, count(*) size from m group by comp) select node, 'near::' || h group_id, size from m join g using (comp)"""
)
def q13_duplicate_components(spark, sf_dir):
    return dedup.duplicate_groups(dedup.similar_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.42))


PARTS = {"train": 0.7, "val": 0.2, "test": 0.1}
_PART = f"""(select grp, case when pos < {0.7 / sum(PARTS.values())!r}::double then 'train' when pos < {(0.7 + 0.2) / 1.0!r}::double then 'val' else 'test' end part from (
  select grp, (row_number() over (order by md5('7:' || grp)) - 1 + 0.5e0) / count(*) over () pos from (select distinct doc_id // 4 grp from documents)))"""


@query(f"select d.doc_id, d.doc_id // 4 grp, p.part from documents d join {_PART} p on d.doc_id // 4 = p.grp")
def q14_group_partition(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 4).alias("grp"))
    return docs.join(splits.group_partition(docs, "grp", PARTS, 7), "grp").select("doc_id", "grp", "part")


@query(
    f"""with p as (select d.doc_id, d.text, p.part from documents d join {_PART} p on d.doc_id // 4 = p.grp)
select count(*)::bigint n_overlap from (select distinct sha256(text) h from p where part = 'train') semi join (select distinct sha256(text) h from p where part <> 'train') using (h)"""
)
def q15_leakage_audit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 4).alias("grp"), F.sha2("text", 256).alias("sha"))
    parted = docs.join(splits.group_partition(docs.select("grp"), "grp", PARTS, 7), "grp")
    return joins.overlap(parted.where("part = 'train'"), parted.where("part <> 'train'"), ["sha"], ["sha"])


@query(
    """with u as (select distinct lang g from documents where source in ('src3', 'src7') and n_chars > 3000)
select d.doc_id, case when g is null then 'seen' else 'unseen' end side from documents d left join u on d.lang = u.g"""
)
def q16_heldout_source_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    seen, unseen = splits.held_out(docs, "lang", F.col("source").isin("src3", "src7") & (F.col("n_chars") > 3000))
    return seen.select("doc_id", F.lit("seen").alias("side")).unionByName(unseen.select("doc_id", F.lit("unseen").alias("side")))


@query(
    """with b as (select distinct lower(trim(l)) k from (select unnest(string_split(text, chr(10))) l from benchmark) where length(trim(l)) > 20),
d as (select doc_id, lower(trim(unnest(string_split(text, chr(10))))) k from documents) select doc_id, count(*) n_lines from d semi join b using (k) group by doc_id"""
)
def q17_contamination_vs_protected(spark, sf_dir):
    lines = lambda name, *keep: table(spark, sf_dir, name).select(*keep, F.explode(F.split("text", "\n", -1)).alias("l")).select(*keep, F.lower(F.trim("l")).alias("k"))
    protected = lines("benchmark").where(F.length("k") > 20).distinct()
    return lines("documents", "doc_id").join(protected, "k", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query(
    f"""with {FEATURES}, g as (select count(*) c from (select distinct quality, toxic from lab)),
r as (select doc_id, quality, toxic, row_number() over (partition by quality, toxic order by md5('3:' || doc_id), doc_id) <= greatest(1, 60 // (select c from g)) f, md5('3:' || doc_id) o from lab) select doc_id, quality, toxic from r order by f desc, o, doc_id limit 60"""
)
def q18_balanced_subset(spark, sf_dir):
    return sampling.balanced_subset(labelled(spark, sf_dir).select("doc_id", "quality", "toxic"), "doc_id", ["quality", "toxic"], 60, 3)


_WEIGHTS = f"""{FEATURES}, k as (select *, case when n_chars % 5 = 0 then 'other' when n_chars % 2 = 0 then 'mixed' else 'component' end bucket from features),
k2 as (select *, case when bucket = 'other' then '' else quality::varchar end l, case when bucket = 'other' then 0.2e0 else 0.4e0 end f from k),
c as (select bucket, l, source, f, count(*) n from k2 group by 1, 2, 3, 4), d as (select bucket, l, count(*) d from c group by 1, 2), e as (select bucket, count(*) k from d group by 1),
w as (select c.*, f / e.k / d.d / n w from c join d using (bucket, l) join e using (bucket)), t as (select sum(w * n) t from w),
weighted as (select k2.*, w.w / (select t from t) weight from k2 join w using (bucket, l, source))"""


def _weighted(spark, sf_dir):
    bucket = F.when(F.col("n_chars") % 5 == 0, "other").when(F.col("n_chars") % 2 == 0, "mixed").otherwise("component")
    return sampling.balanced_weights(features(spark, sf_dir).withColumn("bucket", bucket), "bucket", "quality", "source")


@query(f"with {_WEIGHTS} select doc_id, bucket, round(weight, 12) weight from weighted")
def q19_sampling_weights(spark, sf_dir):
    return _weighted(spark, sf_dir).select("doc_id", "bucket", F.round("weight", 12).alias("weight"))


@query(f"with {_WEIGHTS}, h as (select doc_id, weight * (1 + 2e0 * case when y_voice > 0.5 then 1 - least(greatest(vf, 0e0), 1e0) else least(greatest(vf, 0e0), 1e0) end) raw from weighted) select doc_id, round(raw / (select sum(raw) from h), 12) hard_weight from h")
def q20_hardness_reweight(spark, sf_dir):
    return sampling.hardness_weights(_weighted(spark, sf_dir), "weight", "y_voice", "vf").select("doc_id", F.round("hard_weight", 12).alias("hard_weight"))


@query(f"with {FEATURES} select doc_id, toxic from lab where toxic = 1 union all (select doc_id, toxic from lab where toxic = 0 order by md5('5:' || doc_id), doc_id limit (select greatest(40, count(*) // 4) from lab where toxic = 1))")
def q21_capped_negatives(spark, sf_dir):
    return sampling.capped_negatives(labelled(spark, sf_dir).select("doc_id", "toxic"), "doc_id", "toxic", least=40, seed=5)


@query("select doc_id, source from (select *, row_number() over (partition by source order by doc_id) r from documents) where r <= 3 order by doc_id limit 40")
def q22_artist_cap(spark, sf_dir):
    return splits.capped(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"], 3, 40)


@query("select doc_id, source from documents semi join (select distinct source from documents order by source limit 5) using (source)")
def q23_first_k_entities(spark, sf_dir):
    return splits.first_entities(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 5)


def _sql_pool(seed: str, label: str) -> str:
    return f"(select {label} as label, doc_id as key, row_number() over (partition by {label} order by md5('{seed}:' || doc_id), doc_id) - 1 idx, count(*) over (partition by {label}) n from lab)"


_KINDS = "(values ('RR', 0, 0, 0), ('RF', 0, 1, 1), ('FR', 1, 0, 2), ('FF', 1, 1, 3)) k(kind, va, vb, c)"


@query(
    f"""with {FEATURES}, a as {_sql_pool("1", "quality")}, b as {_sql_pool("2", "toxic")}, r as (select * from range(25) t(i), {_KINDS}),
s as (select r.*, {sql_index("9:l", "(select max(n) from a where a.label = r.va)", "kind", "i")} ia, {sql_index("9:r", "(select max(n) from b where b.label = r.vb)", "kind", "i")} ib from r)
select i, kind, a.key as "left", b.key as "right", greatest(va, vb) file_fake, va voice_fake, vb music_fake from s join a on a.label = va and a.idx = ia join b on b.label = vb and b.idx = ib"""
)
def q24_pair_mix(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return pairing.mixes(pairing.pool(rows, "doc_id", "quality", 1), pairing.pool(rows, "doc_id", "toxic", 2), 25, 9)


@query(
    f"""with {FEATURES}, a as {_sql_pool("1", "quality")}, b as {_sql_pool("2", "toxic")}, r as (select * from range(25) t(i), {_KINDS}),
s as (select r.*, (i * 7 + c) % (select max(n) from a where a.label = r.va) ia, (i * 11 + 3 * c) % (select max(n) from b where b.label = r.vb) ib from r)
select i, kind, a.key as "left", b.key as "right" from s join a on a.label = va and a.idx = ia join b on b.label = vb and b.idx = ib"""
)
def q25_stepping_pairs(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return pairing.stepping(pairing.pool(rows, "doc_id", "quality", 1), pairing.pool(rows, "doc_id", "toxic", 2), 25)


@query(
    f"""with {FEATURES}, r as (select source, doc_id, toxic, row_number() over (partition by source, toxic order by doc_id) - 1 i, count(*) over (partition by source, toxic) n from lab)
select f.source as "group", x.doc_id as real, f.doc_id as fake from r f join r x on f.toxic = 1 and x.toxic = 0 and f.source = x.source and f.i % x.n = x.i"""
)
def q26_real_fake_pairs_in_group(spark, sf_dir):
    return pairing.real_fake_pairs(labelled(spark, sf_dir), "doc_id", "source", "toxic")


@query(
    f"""with {FEATURES}, a as (select key, idx, n from {_sql_pool("1", "quality")} where label = 1), b as (select key, idx, n from {_sql_pool("2", "toxic")} where label = 1),
s as (select i, i % (select max(n) from a) ia, (i * 5 + 1) % (select max(n) from b) ib from range(40) t(i))
select i, 'PARTIAL::voice::' || a.key || '|' || b.key path, [0.1e0, 0.2e0, 0.35e0, 0.5e0][i % 4 + 1] ratio, ['start', 'middle', 'end'][(i + 1) % 3 + 1] as position, [0e0, 0.02e0, 0.05e0][(i + 2) % 3 + 1] fade,
  1 file_fake, 1 voice_fake, 0 music_fake, 1 voice_present, 0 music_present from s join a on a.idx = ia join b on b.idx = ib"""
)
def q88_partial_recipes(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return pairing.partial_recipes(pairing.pool(rows, "doc_id", "quality", 1).where("label = 1"), pairing.pool(rows, "doc_id", "toxic", 2).where("label = 1"), 40, role=None)


@query("select lang, source, coalesce(quality, -1) quality, count(*) n from documents left join labels using (doc_id) group by all")
def q64_provenance_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("lang", "source", F.coalesce("quality", F.lit(-1)).alias("quality")).agg(F.count(F.lit(1)).alias("n"))


@query("select lang, count(distinct source) n_sources, count(distinct sha256(text)) n_texts, string_agg(distinct source, ',' order by source) sources from documents group by 1")
def q65_diversity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "source", F.sha2("text", 256).alias("sha"))
    return docs.groupBy("lang").agg(F.count_distinct("source").alias("n_sources"), F.count_distinct("sha").alias("n_texts"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query(f"with {FEATURES} select count(*) filter (quality = 0 and toxic = 0) rr, count(*) filter (quality = 0 and toxic = 1) rf, count(*) filter (quality = 1 and toxic = 0) fr, count(*) filter (quality = 1 and toxic = 1) ff from lab")
def q67_class_balance(spark, sf_dir):
    pair = lambda a, b: (F.col("quality") == a) & (F.col("toxic") == b)
    return sampling.class_shares(labelled(spark, sf_dir), {"rr": pair(0, 0), "rf": pair(0, 1), "fr": pair(1, 0), "ff": pair(1, 1)})


@query("select doc_id, lang, 'none' quality from documents union all select doc_id, 'none', quality::varchar from labels")
def q68_union_by_name(spark, sf_dir):
    union = table(spark, sf_dir, "documents").select("doc_id", "lang").unionByName(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string")), allowMissingColumns=True)
    return union.fillna("none")


@query("select distinct o_custkey k from orders intersect select c_custkey from customer where c_acctbal > 0")
def q69_intersect(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey"))


@query("select c_custkey k from customer except select o_custkey from orders")
def q70_except(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").select("o_custkey"))


@query("select (select count(*) from (select doc_id from labels except select doc_id from documents)) = 0 covered, (select count(*) from (select doc_id from documents except select doc_id from labels)) = 0 complete")
def q71_set_equality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    missing = lambda a, b, name: a.join(b, "doc_id", "left_anti").agg((F.count(F.lit(1)) == 0).alias(name))
    return missing(labels, docs, "covered").join(F.broadcast(missing(docs, labels, "complete")))


_COMPLETE = f"""with {FEATURES}, g as (select distinct source from lab), p as (
  select a attempt, source, (row_number() over (partition by a order by md5(a || ':' || source)) - 1 + 0.5e0) / count(*) over (partition by a) pos from g, range(20) t(a)),
q as (select p.attempt, case when pos < 0.7e0 then 'train' when pos < {0.7 / 1.0 + 0.2 / 1.0!r}::double then 'val' else 'test' end part, l.* from p join lab l using (source)),
m as (select attempt, part, count(distinct quality) = 2 and count(distinct toxic) = 2 ok from q group by 1, 2)"""


@query(f"{_COMPLETE} select min(attempt)::bigint attempt from (select attempt from m group by attempt having bool_and(ok) and count(*) = 3)")
def q76_attempt_search(spark, sf_dir):
    return splits.first_complete_attempt(labelled(spark, sf_dir).select("source", "quality", "toxic"), "source", PARTS, {"quality": None, "toxic": None}, 20)


@query(None)
def q80_greedy_disjoint(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", F.floor(F.col("doc_id") / 3).alias("family"))
    return splits.disjoint_pick(docs, ["en", "fr", "de", "es"], "lang", "family", 12)


@query(
    """with a as (select doc_id, lang, source, row_number() over (partition by source order by doc_id) r from documents), t as (select *, (row_number() over (partition by lang order by doc_id))::int turn from a where r <= 4)
select doc_id, lang, source, turn from t order by turn, lang limit 30"""
)
def q81_round_robin(spark, sf_dir):
    return splits.round_robin(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "lang", "source", "doc_id", 4, 30)


@query(
    f"""with {FEATURES}, w as (select doc_id, n_chars::double w from lab), c as (select doc_id, sum(w) over (order by doc_id) / sum(w) over () hi, w / sum(w) over () sh from w),
d as (select i draw, ({sql_index("11", 1 << 30, "i")} + 0.5e0) / {float(1 << 30)!r}::double u from range(200) t(i)) select draw, doc_id from d join c on u >= (hi - sh) and u < hi"""
)
def q89_weighted_draws(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("doc_id", F.col("n_chars").cast("double").alias("w"))
    return sampling.weighted_draws(rows, "doc_id", "w", 200, 11)


@query(
    """with m as (select *, case when source in ('src1', 'src2') then 'source' when lang = 'es' then 'generator' else 'train' end fold, doc_id // 4 grp from documents), h as (select distinct grp from m where fold <> 'train')
select doc_id, fold from m where fold <> 'train' union all select doc_id, fold from m anti join h using (grp) where fold = 'train'"""
)
def q90_domain_holdout(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.floor(F.col("doc_id") / 4).alias("grp"))
    return splits.domain_holdout(docs, "source", "lang", "grp", ["src1", "src2"], ["es"]).select("doc_id", "fold")


@query(f"with {FEATURES}, h as (select doc_id, toxic, case when toxic = 1 then 1 - vf else vf end hardness, case when toxic = 0 and vf >= 0.5e0 then 'FP' when toxic = 1 and vf < 0.5e0 then 'FN' else 'ok' end kind from features) select doc_id, toxic, kind, round(hardness, 9) hardness from (select *, row_number() over (partition by toxic order by hardness desc, doc_id) r from h) where r <= 20")
def q91_hard_examples(spark, sf_dir):
    toxic, vf = F.col("toxic"), F.col("vf")
    kind = F.when((toxic == 0) & (vf >= 0.5), "FP").when((toxic == 1) & (vf < 0.5), "FN").otherwise("ok")
    rows = features(spark, sf_dir).select("doc_id", "toxic", kind.alias("kind"), F.when(toxic == 1, 1 - vf).otherwise(vf).alias("h"))
    ranked = rows.withColumn("r", metrics.rank_in(["toxic"], F.desc("h"), F.col("doc_id"))).where("r <= 20")
    return ranked.select("doc_id", "toxic", "kind", F.round("h", 9).alias("hardness"))


@query(f"with {FEATURES}, c as (select source, lang, count(*) n, avg(df) m from features group by 1, 2) select lang, source, round(m, 9) m from (select *, row_number() over (partition by lang order by m desc, n desc, source) r from c) where r = 1")
def q92_lexicographic_best(spark, sf_dir):
    cells = features(spark, sf_dir).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.avg("df").alias("m"))
    return search.best(cells, ["lang"], F.desc("m"), F.desc("n"), F.col("source")).select("lang", "source", F.round("m", 9).alias("m"))


@query(f"with {FEATURES} select doc_id, {sql_index('fold', 5, 'doc_id')} fold, round({sql_uniform('fold5')}, 3) u from lab")
def q93_hashed_folds(spark, sf_dir):
    from quillframe.functions.hashing import uniform

    return labelled(spark, sf_dir).select("doc_id", hashed_index("fold", 5, "doc_id").alias("fold"), F.round(uniform("fold5", "doc_id"), 3).alias("u"))


@query(f"with {FEATURES}, s as (select lang, toxic y, vf s from features) select lang, n, n_pos, eer, auc from {sql_rank('s', ['lang'])}")
def q94_component_head_metrics(spark, sf_dir):
    return metrics.rank_metrics(features(spark, sf_dir), ["lang"], "toxic", "vf").select("lang", "n", "n_pos", "eer", "auc")
