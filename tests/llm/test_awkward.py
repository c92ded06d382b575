"""Null keys, repeated rows and clashing columns: every operator gives each row its defined result."""

import pytest
from pyspark.sql import functions as F

from quillframe.llm import decontaminate, jaccard_join, language_id, line_dedup, packing, quality_rules, substring_dedup, suffix_dedup, training_order

LONG = " ".join(f"word{i}" for i in range(60))


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(None, LONG, "en", None), (None, LONG, None, "s"), (1, LONG, "en", "s"), (1, LONG, "en", "s"), (2, None, None, None), (3, LONG + " tail", "fr", "s"), (4, "", "fr", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    clash = ("n_lines", "n_dropped", "score", "lang_pred", "n_words", "n_hit", "cands", "stratum", "kept", "n_bytes", "bin_id", "component_id", "sig", "shard", "version", "pos")
    return df.withColumns({c: F.lit("clash") for c in clash}).cache()


def test_each_row_has_a_result(spark, awkward, tmp_path):
    df, n = awkward, awkward.count()
    bench = spark.createDataFrame([(None, LONG), (1, None), (2, LONG[:200])], "item_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None)], "doc_id bigint, quality int")
    assert decontaminate.decontaminate(df, bench).count() == n
    assert {r.contaminated for r in decontaminate.decontaminate(df, bench).where("n_words = 0").collect()} == {False}
    assert line_dedup.drop_repeated_lines(df).count() == n
    assert quality_rules.apply_rules(df, labels).count() == n
    assert language_id.identify(df, language_id.train(df.select("doc_id", "text", "lang"))).count() == n
    comps = jaccard_join.similar_documents(df).collect()
    assert len(comps) == n and {(r.doc_id, r.component_id) for r in comps} == {(None, None), (1, 1), (2, 2), (3, 1), (4, 4)}
    packed = packing.pack(df).collect()
    assert len(packed) == n and len({r.bin_id for r in packed if r.n_tokens == 60}) == 4
    kept = {(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeated_strings(df).collect()}
    size = len(LONG)
    assert kept == {(None, size, size), (1, size, size), (2, 0, 0), (3, size + 5, size), (4, 0, 0)}
    units = substring_dedup.remove_repeated(df).collect()
    # The null document ranks first; both rows of document 1 lose their line alike.
    assert len(units) == n and sorted((r.doc_id or 0, r.n_removed) for r in units) == [(0, 0), (0, 0), (1, 1), (1, 1), (2, 0), (3, 0), (4, 0)]
    made = training_order.materialise(df, f"file://{tmp_path}/s", seq_len=64).collect()
    assert sorted(r.slot for r in made) == list(range(len(made)))
