"""The pipeline against a brute-force version of its stages on a small corpus."""

import re
from collections import defaultdict

from test_llm import brute_components, brute_contamination

import corpus_pipeline
from quillframe.llm import language_id


def test_pipeline(spark, tmp_path):
    from test_llm import texts

    rows = [(i, t, ("en", "fr")[i % 2], f"s{i % 5}", len(t or "")) for i, t in enumerate(texts(11, 50))]
    source = next(t for _, t, *_ in rows if t and len(t.split()) > 60)
    items = [(1, " ".join(source.split()[20:50]))]
    rows.append((900, "Some words of an own kind before it: " + items[0][1], "en", "s1", 1))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")

    model = language_id.train(docs.where(~language_id.held_out(docs["doc_id"])).select("doc_id", "text", "lang"))
    assert model.langs == ["en", "fr"]
    left = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t, *_ in left:
        for x in t.split("\n"):
            holders[key(x)].add(i)
    left = [(i, "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or min(holders[key(x)]) == i), *rest) for i, t, *rest in left]
    comps = brute_components(left, 5, 80)
    left = [r for r in left if comps[r[0]][1] == r[0]]
    bad = brute_contamination(left, items)
    left = [r for r in left if not bad[r[0]][4]]

    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    n = defaultdict(int)
    for r in out:
        n[r.doc_id] += r.n_tokens
    assert dict(n) == {i: len(t.split()) for i, t, *_ in left} and 900 not in n
    assert len(corpus_pipeline.STAGES) == 5


def test_near_duplicates_at_five_words_and_four_fifths(spark, tmp_path):
    import random

    r = random.Random(3)
    word = lambda: f"w{r.randrange(5000)}"
    rows = []
    for k in range(12):
        base = [word() for _ in range(r.choice((40, 100, 300)))]
        rows.append((10 * k, " ".join(base)))
        # Copies with a tenth to a third of text appended, and with single words edited.
        for j, share in enumerate((0.12, 0.2, 0.24, 0.26, 0.35)):
            rows.append((10 * k + 1 + j, " ".join(base + [word() for _ in range(int(share * len(base)))])))
        for j, edits in enumerate((1, 3)):
            ws = list(base)
            for _ in range(edits):
                ws[r.randrange(len(ws))] = "new"
            rows.append((10 * k + 7 + j, " ".join(ws)))
    rows += [(200 + k, t) for k, t in enumerate(["", "one", "one", "one two", "a b c d e", "A B C D E", "a b c d e f"])]
    grams = {i: {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} or ({tuple(ws)} if ws else set()) for i, t in rows for ws in [t.lower().split()]}
    root = {i: i for i in grams}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(grams):
        for b in sorted(grams):
            if a < b and grams[a] and 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {i for i in grams if find(i) == i}
    assert 1 not in kept and 5 in kept


def test_predicted_language_is_written(spark):
    say = {"en": "the cat and the dog were walking with their friends", "fr": "le chat et le chien se promenaient avec leurs amis"}
    rows = [(i, f"{say[x]} {i}", x, "s", 1) for i in range(60) for x in [("en", "fr")[i % 2]]]
    rows += [(100, say["fr"], None, "s", 1), (101, "12 34", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert got == {i: x for i, _, x, *_ in rows[:60]} | {100: "fr"}


def test_near_duplicates_among_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(None, long + " x", "en", "s", 1), (None, "alone", "en", "s", 1), (1, long, "en", "s", 1), (1, long, "de", "s", 1), (1, "other words", "en", "s", 1), (2, long.upper(), "en", "s", 1), (3, None, "en", "s", 1), (4, "", "en", "s", 1), (5, "other words", None, "s", 1), (6, "new", "fr", "s", 1), (6, "new", "fr", "s", 1)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, n_shingles string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == list(corpus_pipeline.COLUMNS)
    assert sorted((r.doc_id or 0, r.text or "", r.lang) for r in got.collect()) == [(0, "alone", "en"), (0, long + " x", "en"), (1, "other words", "en"), (3, "", "en"), (4, "", "en"), (6, "new", "fr")]


def test_stages_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, f"file://{tmp_path}").count() == 0
