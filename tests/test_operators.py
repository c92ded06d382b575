import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.functions import aggregators, manifest, scores, signal
from quillframe.operators import dedup, guards, joins, pairing, sampling, search, splits
from quillframe.sources import readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("method", "want"), [("topk_mean", 0.65), ("max", 0.9), ("mean", 1.4 / 3), ("median", 0.4), ("trimmed_mean", 0.4)])
def test_aggregators(spark, method, want):
    assert one(spark, aggregators.aggregator(method, F.array(F.lit(0.1), F.lit(0.4), F.lit(0.9)))) == pytest.approx(want)


def test_unknown_aggregator_is_fatal(spark):
    with pytest.raises(ValueError):
        aggregators.aggregator("best", F.array())
    with pytest.raises(ValueError):
        aggregators.head_aggregator("voice_present", F.array(), {"voice_present_aggregation": "median"})


def test_alpha_zero_is_the_base(spark):
    df = spark.createDataFrame([(0.2, 0.9), (1.0, 0.1)], "b double, c double")
    for method in ("probability", "logit", "max", "rank"):
        assert [r[0] for r in df.select(scores.blend(F.col("b"), F.col("c"), 0.0, method)).collect()] == [0.2, 1 - 1e-6]


def test_fusion_clamps_and_ignores_what_did_not_run(spark):
    row = spark.createDataFrame([(2.0, -1.0, 3.0, 2.0, -1.0, float("nan"), 3.0, 0.5, 0.5)], "df double, vf double, mf double, vfile double, mfile double, vp_model double, mp_model double, vp_panns double, mp_panns double")
    out = scores.with_fused(row).first()
    assert all(1e-6 <= out[h] <= 1 - 1e-6 for h in ("file_fake", "voice_fake", "music_fake", "voice_present", "music_present"))
    plain = {"df": 0.99, "vf": 0.3, "mf": 0.1, "vfile": 0.2, "mfile": 0.2, "vp_model": 0.5, "mp_model": 0.5, "vp_panns": 0.5, "mp_panns": 0.5}
    skipped = scores.with_fused(spark.createDataFrame([tuple(plain.values())], list(plain)), {"w_df_voice_component": 0.9}, F.lit(False)).first()
    assert skipped.voice_fake == pytest.approx(0.3)


def test_mixed_and_partial_labels(spark):
    for v, m in ((0, 0), (0, 1), (1, 0), (1, 1)):
        assert one(spark, manifest.mixed_labels(F.lit(v), F.lit(m))) == [v | m, v, m, 1, 1]
    assert one(spark, manifest.partial_labels(F.lit("voice"))) == [1, 1, 0, 1, 0]
    assert one(spark, manifest.partial_labels(F.lit("music"))) == [1, 0, 1, 0, 1]


def test_group_ids_and_licences(spark):
    none = F.lit(None).cast("string")
    for name in ("wavefake_ajay_LJ019-0320_WF1", "wavefake_ajay_LJ019-0320_WF7"):
        assert one(spark, manifest.group_id(none, F.lit("x"), F.lit(name), F.lit("s"))) == "wavefake::LJ019-0320"
    for text, want in (("https://creativecommons.org/licenses/by/4.0", True), ("CC BY-NC-SA", True), ("cc by-nd", False), ("", False)):
        assert one(spark, manifest.open_licence(F.lit(text))) is want


def test_titles_fold_accents(spark):
    df = spark.createDataFrame([("Café - Été 1",), ("plain A",), (None,)], "t string")
    assert [r[0] for r in df.select(manifest.normalised_title(F.col("t"))).collect()] == ["cafeete1", "plaina", None]


def test_segment_counts(spark):
    for n, want in ((7, 1), (20, 2), (40, 3)):
        assert one(spark, signal.crops_for(F.lit(n))) == want
    wave = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: i.cast("double"))
    assert [s[0] for s in one(spark, signal.segments(wave, 8, "sliding", 4))] == [0.0, 4.0, 8.0, 12.0, 12.0]
    assert len(one(spark, signal.segments(wave, 40))) == 1


@pytest.mark.parametrize(("mode", "size"), [("simultaneous", 16), ("voice_then_music", 24), ("music_then_voice", 24), ("partial_overlap", 20), ("crossfade", 20)])
def test_mix_lengths(spark, mode, size):
    v, m = F.array_repeat(F.lit(0.5), 16), F.array_repeat(F.lit(0.2), 8)
    assert len(one(spark, signal.mix(v, m, mode, rate=16, fade_sec=0.25))) == size


def test_quantisers_keep_zero(spark):
    xs = F.array(*(F.lit(x) for x in (-1.0, -0.3, 0.0, 0.3, 1.0)))
    q = one(spark, signal.quantise(xs, 4))
    assert q[2] == 0 and q[0] == -1 and q[4] == 1 and q[1] == -q[3]


def test_fingerprint_like_similarity(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>")
    s = np.round(v @ v.T, 6)
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if s[i, j] >= 0.5}
    assert {(r.a, r.b) for r in dedup.similar_pairs(df, "id", "v", 0.5, block=7).collect()} == want
    near = {r.id: r.neighbour for r in dedup.nearest_neighbours(df, df, "id", "v", block=9).collect()}
    np.fill_diagonal(s, -9)
    assert near == {i: int(s[i].argmax()) for i in range(40)}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a bigint, b bigint")
    groups = {}
    for r in dedup.duplicate_groups(edges).collect():
        groups.setdefault(r.group_id, set()).add(r.node)
    assert sorted(map(len, groups.values())) == [2, 31]


def test_partition_is_disjoint_and_sized(spark):
    df = spark.range(400).select(F.floor(F.col("id") / 4).alias("g"))
    parts = {r.part: r["count"] for r in splits.group_partition(df, "g", {"a": 0.7, "b": 0.2, "c": 0.1}, 3).groupBy("part").count().collect()}
    assert parts == {"a": 70, "b": 20, "c": 10}


def test_sampler_mass(spark):
    rows = [("component", i % 2, f"d{i % 3}") for i in range(4)] + [("mixed", 0, "d1")] * 3 + [("other", 0, "d2")] * 3
    out = sampling.balanced_weights(spark.createDataFrame(rows, "bucket string, label int, domain string"), "bucket", "label", "domain")
    mass = {r.bucket: r.m for r in out.groupBy("bucket").agg(F.sum("weight").alias("m")).collect()}
    assert mass == pytest.approx({"component": 0.4, "mixed": 0.4, "other": 0.2})


def test_weighted_draws_follow_weights(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 3.0)], "k bigint, w double")
    got = [r.k for r in sampling.weighted_draws(df, "k", "w", 2000, 1).collect()]
    assert len(got) == 2000 and 1 not in got and 0.7 < got.count(2) / 2000 < 0.8


def test_bootstrap_is_paired_and_whole(spark):
    rows = sampling.bootstrap_indices(spark, 20, 5).collect()
    assert len(rows) == 100 and {r.b for r in rows} == set(range(5)) and all(0 <= r.row_index < 20 for r in rows)


def test_pairs_use_every_class(spark):
    df = spark.range(40).select(F.col("id").alias("k"), (F.col("id") % 2).alias("y"))
    pool = pairing.pool(df, "k", "y")
    kinds = {r.kind: r["count"] for r in pairing.mixes(pool, pool, 6).groupBy("kind").count().collect()}
    assert kinds == {"RR": 6, "RF": 6, "FR": 6, "FF": 6}
    with pytest.raises(guards.GuardError):
        train = pool.withColumn("data_role", F.lit("val"))
        pairing.partial_recipes(train, train, 3)


def test_coordinate_search_finds_the_peak():
    score = lambda trials: [-((t["a"] - 2) ** 2) - (t["b"] - 1) ** 2 for t in trials]
    point, top, trace = search.coordinate_search({"a": 0, "b": 0}, {"a": range(5), "b": range(5)}, score)
    assert point == {"a": 2, "b": 1} and top == 0 and len(trace) == 4


def test_guards_fail_closed(spark):
    df = spark.createDataFrame([(1, "a", "train", "YES"), (1, "b", "val", "NO"), (2, None, "train", "x")], "g int, p string, split string, ok string")
    for bad in (
        lambda: guards.unique(df, ["g"]), lambda: guards.complete(df, ["p"]), lambda: guards.group_disjoint(df, "g", "split"), lambda: guards.role_only(df, "split"), lambda: guards.require_columns(df, ["zz"]),
        lambda: guards.fresh({"a": 1}, {"a": 2}), lambda: guards.not_protected("/x/final_holdout.csv"), lambda: guards.dense_index(df, "g"), lambda: guards.approved(df.where("g = 2"), "ok"),
        lambda: guards.same_keys(df, df.where("g = 1"), "g"), lambda: guards.calibration_only(df.where("g = 2"), "split"), lambda: guards.frozen(df, df.withColumn("p", F.lit("z")), "g", "p"),
        lambda: guards.parents_disjoint(df, ["g"], "split"),
    ):
        with pytest.raises(guards.GuardError):
            bad()
    assert guards.approved(df, "ok").count() == 1
    for key in ("a", "b", "c"):
        with pytest.raises(guards.GuardError):
            guards.fresh({"a": 1, "b": 2, "c": 3}, {"a": 1, "b": 2, "c": 3, key: 0})


def test_contract_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    with pytest.raises(guards.GuardError):
        joins.one_to_one(a, a.where("k = 1"), "k")
    with pytest.raises(guards.GuardError):
        joins.lookup(a, a.where("k = 1").withColumnRenamed("v", "w"), "k")
    with pytest.raises(guards.GuardError):
        joins.aligned(a, a.withColumn("v", F.lit("z")), "k", ["v"])
    got = joins.by_id_or_stem(spark.createDataFrame([("A.wav",), ("B",)], "sid string"), spark.createDataFrame([("B", 1), ("A", 2)], "rid string, s int"), "sid", "rid")
    assert {(r.sid, r.s, r.matched) for r in got.collect()} == {("A.wav", 2, True), ("B", 1, True)}


def test_sources_and_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/t.csv"
    (tmp_path / "t.csv").write_text("a,b\nNA,1\n,2\n")
    assert [r.a for r in readers.read_csv(spark, path, "a string, b int", blanks_are_null=False).collect()] == ["NA", ""]
    assert [r.a for r in readers.read_csv(spark, path, "a string, b int").collect()] == ["NA", None]
    (tmp_path / "h.csv").write_text(",set,set,track\n,split,subset,title\n1,training,small,x\n2,test,large,y\n")
    two = readers.read_two_row_header(spark, f"file://{tmp_path}/h.csv", "id")
    assert two.columns == ["id", "set.split", "set.subset", "track.title"] and two.count() == 2
    import zipfile

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("b.csv", "k,v\n1,x\n2,y\n")
    rows = readers.parse_csv(readers.read_zip_members(spark, f"file://{tmp_path}/z.zip"), "content", "k int, v string").collect()
    assert [(r.k, r.v) for r in rows] == [(1, "x"), (2, "y")]
    import wave

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(np.array([16384, 0, -16384, 0], np.int16).tobytes())
    wav = readers.read_wav(spark, f"file://{tmp_path}").first()
    assert wav.rate == 8000 and wav.wave == [0.25, -0.25]
    assert readers.list_files(spark, f"file://{tmp_path}").count() == 1
    df = spark.range(3)
    sinks.save_cache(df, f"file://{tmp_path}/cache", {"v": "1"})
    assert sinks.load_cache(spark, f"file://{tmp_path}/cache", {"v": "1"}).count() == 3
    with pytest.raises(guards.GuardError):
        sinks.load_cache(spark, f"file://{tmp_path}/cache", {"v": "2"})
    for n in (2, 5):
        sinks.publish(spark.range(n), f"file://{tmp_path}/pub")
        assert spark.read.parquet(f"file://{tmp_path}/pub").count() == n
    sinks.write_report(spark, {"a": [1]}, f"file://{tmp_path}/rep", once=True)
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_report(spark, {"a": [1]}, f"file://{tmp_path}/rep", once=True)


def test_stream_equals_batch(spark, tmp_path):
    from quillframe.streaming.windows import read_events, run_to_table, threshold_counts

    events = spark.range(200).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), (F.col("id") % 2).alias("y"), (F.col("id") % 10 / 10.0).alias("s"))
    events.write.parquet(f"file://{tmp_path}/ev")
    count = lambda df: threshold_counts(df, "ts", F.col("y") == 1, F.col("s"))
    run_to_table(count(read_events(spark, f"file://{tmp_path}/ev", events.schema)), "counts").awaitTermination()
    assert sorted(map(str, spark.table("counts").collect())) == sorted(map(str, count(events).collect()))


def test_manifest_operators(spark):
    from quillframe.operators import manifests, metrics

    df = spark.createDataFrame([("a", 1), ("MIX::a|b", 2), ("gone", 3)], "path string, n int")
    assert manifests.project(df, ["n", "path", "x"], {"x": 0}, ["n"]).columns == ["n", "path", "x"]
    with pytest.raises(guards.GuardError):
        manifests.project(df, ["zz"])
    assert manifests.union_all([df, df.select("path")]).where("n is null").count() == 3
    assert manifests.resolve_columns(spark.createDataFrame([(1, 2, 3)], "FILE_FAKE int, voice_fake_prob int, my_music_fake_x int"), ["file_fake", "voice_fake", "music_fake", "none"]) == {"file_fake": "FILE_FAKE", "voice_fake": "voice_fake_prob", "music_fake": "my_music_fake_x"}
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    assert {r.n for r in manifests.existing_only(df, "path", files).collect()} == {1, 2}
    moved = spark.createDataFrame([("a", "A"), ("b", "B")], "path string, address string")
    assert {r.path for r in manifests.rewrite_paths(df, "path", moved).collect()} == {"A", "MIX::A|B", "gone"}
    assert manifests.label_errors(readers.procedural(spark, 30)).count() == 0
    assert manifests.label_errors(readers.procedural(spark, 30).withColumn("file_fake", F.lit(0))).count() == 30
    with pytest.raises(ValueError):
        metrics.precommitted_objective({"mean_total": F.lit(1.0)})
    assert one(spark, metrics.precommitted_objective({k: F.lit(1.0) for k in metrics.OBJECTIVE})) == pytest.approx(1.0)


def test_selection_policies(spark):
    e = F.array(*(F.lit(x) for x in (0.9, 0.8, 0.1, 0.7, 0.2)))
    assert one(spark, signal.select_segments(e, F.lit(2), "energy_diverse")) == [0, 3]
    assert one(spark, signal.limit_segments(e, 2)) == [0, 1] and one(spark, signal.limit_segments(e, None)) == [0, 1, 2, 3, 4]


def test_replaced_columns_and_gate(spark):
    from quillframe.functions import scoring

    df = spark.createDataFrame([(1, 0.1), (2, 0.9)], "k int, s double")
    assert {r.k: r.s for r in joins.replaced(df, df.withColumn("t", F.col("s") * 10), "k", {"s": "t"}).collect()} == {1: 1.0, 2: 9.0}
    out = scoring.gated(df, "k", F.col("s") > 0.5, lambda d: d.withColumn("heavy", F.lit(0.7)), "heavy").collect()
    assert {(r.k, r.heavy, r.used) for r in out} == {(1, 0.5, False), (2, 0.7, True)}


def test_paired_batches(spark):
    df = spark.range(80).select(F.col("id").alias("k"), (F.col("id") % 8).alias("g"), (F.floor(F.col("id") / 8) % 2).cast("int").alias("y"), F.lit(1.0).alias("w"))
    sizes = {r.batch: r["count"] for r in sampling.paired_batches(df, "k", "g", "y", "w", 16, 3).groupBy("batch").count().collect()}
    assert sizes == {0: 16, 1: 16, 2: 16}


def test_scorer_and_similarity_beside_nulls(spark):
    from quillframe.functions.scoring import segment_scorer
    from quillframe.operators import dedup

    rows = [(1, [0.6, 0.8]), (2, None), (3, [0.8, 0.6]), (4, [1.0, None]), (5, [0.6, 0.8]), (None, [0.6, 0.8])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").coalesce(1)
    scores = {r.id: r.s for r in df.select("id", segment_scorer()("v").alias("s")).collect()}
    alone = spark.createDataFrame(rows[:1], df.schema).select(segment_scorer()("v").alias("s")).first().s
    assert scores[1] == scores[5] == alone and scores[2] is None and scores[4] is None
    assert sorted((r.a, r.b) for r in dedup.similar_pairs(df, "id", "v", 0.9).collect()) == [(1, 3), (1, 5), (3, 5)]
    assert sorted((r.id, r.neighbour) for r in dedup.nearest_neighbours(df, df, "id", "v").collect()) == [(1, 5), (3, 1), (5, 1)]


def test_column_diff_counts_rows_of_one_side(spark):
    from quillframe.operators import metrics

    a, b = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, x double"), spark.createDataFrame([(1, 1.0)], "k int, x double")
    assert [tuple(r) for r in metrics.column_diff(a, b, "k", ["x"]).collect()] == [("x", 1, 0.0, 0.0, False)]
    assert metrics.column_diff(a, a, "k", ["x"]).first().exact


def test_unknown_aggregations(spark):
    import pytest

    from quillframe.functions import aggregators
    from pyspark.sql import functions as F

    for name in ("max_mean_1.5", "max_mean_", "sum"):
        with pytest.raises(ValueError):
            aggregators.aggregator(name, F.array(F.lit(1.0)))
