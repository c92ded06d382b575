"""Operators against brute force on small, awkward tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.llm import (
    cuckoo, decontaminate, jaccard_join, language_id, line_dedup, packing, passages, quality_rules, shingles, substring_dedup, suffix_array, suffix_dedup, training_order, url_filter,
)

WORDS = "alpha beta gamma delta the of and river stone mountain Ünder été naïve".split()


def texts(seed=1, n=60):
    r = random.Random(seed)
    sentence = lambda k: " ".join(r.choice(WORDS) for _ in range(k))
    shared = [sentence(70) for _ in range(3)]
    out = []
    for i in range(n):
        lines = [sentence(r.randint(0, 30)) for _ in range(r.randint(0, 6))]
        if i % 4 == 0:
            lines.insert(r.randint(0, len(lines)), shared[i % 3].upper() if i % 8 == 0 else "  " + shared[i % 3] + "\t")
        out.append("\n".join(lines))
    out += [out[0], out[4], out[4], "", "   \n\t", None, "one", "ONE", "two words", sentence(4000), "\n" * 30, "é" * 500]
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, t, WORDS[i % 3] if i % 5 else None, f"s{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts())]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").cache()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def empty(df):
    return df.limit(0)


def test_url_rules_and_listing(spark):
    urls = ["http://A.Example.org/es/1", "https://example.org/en/12", "https://example.org/en/2", "http://x.com/fr/", "http://x.com/de/1#a", "ftp://www.q.net/p/?x=1", "http://q.net/p", "nonsense", None, "", "http://q.net", "http://xorg/", "http://Q.NET/p.html"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, url_filter.repeated_urls(pages)).collect()}
    assert len(got) == len(urls)
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[1][2:] == ("example.org/en/1", "block") and got[2][2:] == ("org/", "allow")
    assert got[3][2:] == ("com/fr/", "allow") and got[4][2:] == ("com/de/", "block")
    assert got[5] == ("www.q.net", "/p/", None, "block") and got[6][3] == got[12][3] == "block"
    assert got[7] == got[8] == got[9] == ("", "", None, "allow") and got[10] == ("q.net", "", None, "allow") and got[11][2] is None
    assert url_filter.filter_urls(empty(pages), url_filter.repeated_urls(empty(pages))).count() == 0


def test_bloom_false_positives_are_removed(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h"), "id", F.lit("/p")).alias("canonical_url"))
    pages = spark.range(6000).select("id", F.concat(F.lit("http://h"), "id", F.lit("/p")).alias("url"))
    out = url_filter.filter_urls(pages, keys, rules=(), bits_per_key=2, max_blocks=4)
    assert {r.id for r in out.where("verdict = 'block'").collect()} == set(range(3000))


def test_line_dedup(corpus):
    rows, df = corpus
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    owner, docs = {}, defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            docs[key(x)].add(i)
    owner = {k: min(v) for k, v in docs.items() if len(v) > 1 and len(k) >= 10}
    got = by_id(line_dedup.drop_repeated_lines(df))
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if owner.get(key(x), i) == i]
        assert (got[i].n_lines, got[i].n_dropped, got[i].text or "") == (len(lines), len(lines) - len(kept), "\n".join(kept))
    wide = by_id(line_dedup.drop_repeated_lines(df, max_filter_bytes=0))
    assert {i: r.text for i, r in wide.items()} == {i: r.text for i, r in got.items()}
    assert line_dedup.drop_repeated_lines(empty(df)).count() == 0


def test_line_index_is_reversible(corpus):
    _, df = corpus
    half, rest = df.where("doc_id % 2 = 0"), df.where("doc_id % 2 = 1")
    rows = lambda index: {tuple(r) for r in index.owners.collect()}
    drops = lambda index, docs: {(r.doc_id, r.pos) for r in index.repeated(line_dedup.LineIndex._lines(docs, 10)).collect()}
    index, whole = line_dedup.LineIndex.incremental(half), line_dedup.LineIndex.incremental(df)
    more = index.insert(rest)
    assert rows(more) == rows(whole) != rows(index) and drops(more, df) == drops(whole, df)
    left = more.delete(rest)
    assert rows(left) == rows(index) and drops(left, half) == drops(index, half)
    assert rows(left.insert(rest)) == rows(whole)


def test_line_index_changes_only_the_shards_concerned(spark):
    line = lambda k: f"a shared line with number {k}"
    rows = [(d, "\n".join(line(k) for k in range(60))) for d in (1, 2)] + [(3, line(7)), (4, line(1000) + "\n" + line(7))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    index = line_dedup.LineIndex.incremental(df, keys_per_shard=8)
    held = lambda x: {r.shard: bytes(r.filter) for r in x.filters.collect()}
    assert index.shards > 4
    gone = index.delete(spark.createDataFrame([(3,), (4,)], "doc_id bigint"))
    assert held(gone) == held(index)
    more = gone.insert(spark.createDataFrame([(9, line(1000)), (10, line(1000))], "doc_id bigint, text string"))
    changed = {s for s, x in held(more).items() if held(index).get(s) != x}
    assert len(changed) == 1 and set(held(index)) <= set(held(more))
    # So many keys that every filter has to grow.
    wide = more.insert(spark.createDataFrame([(d, "\n".join(line(k) for k in range(2000, 2400))) for d in (20, 21)], "doc_id bigint, text string"))
    assert wide.possible(line_dedup.LineIndex._lines(df.where("doc_id = 1"), 10)).count() == 60
    new = line_dedup.LineIndex._lines(spark.createDataFrame([(30, "\n".join(line(k) for k in range(2000, 2400)))], "doc_id bigint, text string"), 10)
    assert wide.repeated(new).count() == 400


def test_line_dedup_builds_an_index_with_references(corpus, monkeypatch):
    _, df = corpus
    made, probe = [], line_dedup.LineIndex.repeated
    monkeypatch.setattr(line_dedup.LineIndex, "repeated", lambda index, *a: made.append(index) or probe(index, *a))
    line_dedup.drop_repeated_lines(df)
    lines = line_dedup.LineIndex._lines(df, 10)
    assert made[0].references.agg({"n": "sum"}).first()[0] == lines.count()


def test_line_dedup_of_rows_that_repeat_an_id(spark):
    same, own = "a line that two documents share", "a line that nobody else has"
    rows = [(1, same), (2, same), (2, own), (2, f"{own}\n{same}"), (None, same), (3, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_repeated_lines(df).where("doc_id < 3 or doc_id is null").collect())
    assert got == [(0, 1, 0, same), (1, 1, 0, same), (2, 1, 0, own), (2, 1, 1, ""), (2, 2, 1, own)]


def test_cuckoo_filter():
    r = np.random.default_rng(1)
    keys = r.integers(0, 2**63, 5000).astype(np.uint64)
    f = cuckoo.built(keys)
    assert f.contains(keys).all() and f.contains(r.integers(0, 2**63, 20000).astype(np.uint64)).mean() < 0.01
    f = cuckoo.CuckooFilter.from_bytes(f.to_bytes())
    f.delete(keys[:1000])
    assert f.contains(keys[1000:]).all() and f.contains(keys[:1000]).mean() < 0.05


@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_substring_dedup(corpus, unit):
    rows, df = corpus
    cut = "\n" if unit == "line" else "\n[ \t\x0b\x0c\r]*\n"
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), " ".join(w for w in re.split("[ \t\n\x0b\x0c\r]+", x) if w))
    seen, want = set(), {}
    for i, t, *_ in rows:
        kept, gone, at = [], [], 0
        for m in [*re.finditer(cut, t or ""), None]:
            x = (t or "")[at : m.start() if m else None]
            k = key(x)
            if len(k.split(" ")) >= 8 and k in seen:
                gone.append((at, len(x)))
            else:
                kept.append(x)
                seen |= {k} if len(k.split(" ")) >= 8 else set()
            at = m.end() if m else 0
        want[i] = (("\n" if unit == "line" else "\n\n").join(kept), gone)
    # Equal texts under different ids are different documents.
    got = by_id(substring_dedup.remove_repeated(df, unit))
    for i, (kept, gone) in want.items():
        assert got[i].kept_text == kept and [(x.start, x.length) for x in got[i].removed] == gone
        assert got[i].n_removed == len(gone) and got[i].n_removed_chars == sum(n for _, n in gone)


def brute_passages(rows, width):
    """(n_words, n_shared_words, n_removed_words, kept_text, removed) by position in `rows`; equal rows are one document."""
    rank = lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][1] or "")
    cut = [[(m[0].translate({c: c + 32 for c in range(65, 91)}), *m.span()) for m in re.finditer("[^ \t\n\x0b\x0c\r]+", t or "")] for _, t in rows]
    window = lambda i, k: tuple(w for w, *_ in cut[i][k : k + width])
    holders = defaultdict(set)
    for i, ws in enumerate(cut):
        for k in range(len(ws) - width + 1):
            holders[window(i, k)].add(rank(i))
    out = []
    for i, ws in enumerate(cut):
        shared, gone, keeper = set(), set(), {}
        for k in range(len(ws) - width + 1):
            held = holders[window(i, k)]
            if len(held) > 1:
                shared |= set(range(k, k + width))
            if len({x[:2] for x in held}) > 1 and min(held)[:2] != rank(i)[:2]:
                gone |= set(range(k, k + width))
                keeper[k] = min(held)[1] if min(held)[0] else None
        spans = []
        for k in sorted(gone):
            if k - 1 in gone:
                spans[-1][1] = k
            else:
                spans.append([k, k])
        spans = [(ws[a][1], ws[b][2] - ws[a][1], keeper[a]) for a, b in spans]
        text, at = "", 0
        for a, n, _ in spans:
            text, at = text + (rows[i][1] or "")[at:a], a + n
        out.append((len(ws), len(shared), len(gone), text + (rows[i][1] or "")[at:], spans))
    return out


@pytest.mark.parametrize("width", [51, 16])
def test_passages(spark, width):
    r = random.Random(7)
    some = lambda k: " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(k))
    passage, edited = some(60), some(120).split(" ")
    rows = [(10 + i, f"{some(r.randint(0, 40))} {passage if i % 2 else passage.upper().replace(' ', chr(10))} {some(r.randint(0, 40))}") for i in range(6)]
    # One word more or less than a window, edits within a copy, passages at the ends, twice in a text, and one word over and over.
    rows += [(20, some(30) + "\n" + " ".join(edited)), (21, " ".join([*edited[:60], "other", *edited[60:]])), (22, " ".join(edited[5:56])), (23, some(3) + " " + " ".join(edited[64:114])), (24, passage), (25, f"{passage}\t{some(9)}\n{passage}")]
    rows += [(30, "ab " * 200), (31, "ab " * 60), (32, some(300) + " cd" * 90), (33, f"{passage} {passage}"), (40, " ".join(f"w{i}" for i in range(300))), (41, " ".join(f"w{i}" for i in range(100, 400)))]
    rows += [(None, "é " + passage), (50, None), (51, ""), (52, " \n\t"), (53, "one"), (54, rows[0][1]), rows[1], (55, some(4000) + " " + passage)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, runs string")
    want = Counter((i, w, s, g, kept, str(spans)) for (i, _), (w, s, g, kept, spans) in zip(rows, brute_passages(rows, width), strict=True))
    got = passages.remove_passages(df, width).collect()
    assert Counter((x.doc_id, x.n_words, x.n_shared_words, x.n_removed_words, x.kept_text, str([tuple(s) for s in x.removed])) for x in got) == want
    assert passages.remove_passages(empty(df), width).count() == 0


def test_passages_within_lines_are_found(spark):
    """Lines that differ share no line digest, whatever they have in common (F1 of FINDINGS_r03)."""
    passage = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(i, f"start {i} {passage} {i} end") for i in range(3)] + [(9, "nothing in common")], "doc_id bigint, text string")
    assert {x.n_removed for x in substring_dedup.remove_repeated(df).collect()} == {0}
    got = by_id(passages.remove_passages(df))
    assert [got[i].n_shared_words for i in (0, 1, 2, 9)] == [60, 60, 60, 0] and [got[i].n_removed_words for i in (0, 1, 2, 9)] == [0, 60, 60, 0]
    assert got[2].kept_text == "start 2  2 end"
    # Texts under the same id are told apart.
    twice = spark.createDataFrame([("a", f"one {passage}"), ("a", f"other {passage}"), ("b", passage)], "doc_id string, text string")
    got = passages.remove_passages(twice).collect()
    assert [x.n_shared_words for x in got] == [60] * 3 and sorted((x.doc_id, x.n_removed_words) for x in got) == [("a", 0), ("a", 60), ("b", 60)]


def test_planted_passages_and_what_goes_on(spark):
    """Passages set into prose are caught, other documents left alone, and only segments whose anchor two documents have go on (F1 of FINDINGS_r03)."""
    r = random.Random(3)
    some = lambda k: " ".join(f"w{r.randrange(5000)}" for _ in range(k))
    planted = [some(r.randint(51, 90)) for _ in range(4)]
    rows = [(i, f"{some(r.randint(60, 120))} {planted[i % 4]} {some(r.randint(60, 120))}" if i < 12 else some(200)) for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = by_id(passages.remove_passages(df))
    size = lambda i: len(planted[i % 4].split()) if i < 12 else 0
    assert [got[i].n_shared_words for i in range(24)] == [size(i) for i in range(24)]
    assert [got[i].n_removed_words for i in range(24)] == [size(i) if i > 3 else 0 for i in range(24)]
    docs = df.select("*", F.xxhash64("text").alias("version"))
    every = passages._segment_rows(docs, passages.WORDS).collect()
    holders = defaultdict(set)
    for x in every:
        holders[x.fp].add(x.doc)
    want = Counter(x for x in every if len(holders[x.fp]) > 1)
    assert Counter(passages._shared_segments(docs, passages.WORDS).select("doc", "lo", "hi", "fp", "digest").collect()) == want and 0 < sum(want.values()) < len(every)
    # Ranks follow the order of documents, a null doc_id first.
    kinds = spark.createDataFrame([(k, 0, 5, (i, 7), (j, 7)) for k, i, j in [(1, 9, 9), (2, None, 4), (3, 4, 9), (4, 9, 10)]], "kind bigint, lo int, hi int, first struct<doc_id:bigint,version:bigint>, last struct<doc_id:bigint,version:bigint>")
    ranked = [(x.doc.doc_id, sorted((w.kind, w.others) for w in x.want)) for x in sorted(passages._wanted(kinds).collect(), key=lambda x: x.rank)]
    assert ranked == [(None, [(2, True)]), (4, [(3, True)]), (9, [(1, False), (4, True)])]


def brute_strings(rows, width):
    c = Counter(b[k : k + width] for _, t, *_ in rows for b in [(t or "").encode()] for k in range(len(b) - width + 1))
    out = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if c[b[k : k + width]] > 1:
                gone[k : k + width] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("width", "gram", "group"), [(200, 50, 8 << 20), (60, 20, 8 << 20), (60, 20, 100)])
def test_suffix_dedup(corpus, width, gram, group):
    rows, df = corpus
    got = by_id(suffix_dedup.remove_repeated_strings(df, width, gram, shard_bytes=4000, group_bytes=group))
    want = brute_strings(rows, width)
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for i, r in got.items()} == want


def test_suffix_dedup_of_long_texts(spark, monkeypatch):
    r = random.Random(12)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 40_000)
    noise = lambda n: bytes(r.choices(b"abcdefgh \n", k=n)).decode()
    shared = noise(50_000)
    rows = [(1, noise(90_000) + shared + noise(3000)), (2, noise(77) + shared), (3, noise(60_000) + shared[100:299]), (4, shared[41_000:41_200]), (5, "ß" * 70_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    data = np.frombuffer(rows[0][1].encode(), np.uint8)
    assert len(suffix_dedup.segments(data, np.array([len(data)]))[0]) > 100
    got = by_id(suffix_dedup.remove_repeated_strings(df, shard_bytes=20_000))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for i, r in got.items()} == brute_strings(rows, 200)


def test_suffix_dedup_empty(corpus):
    assert suffix_dedup.remove_repeated_strings(empty(corpus[1])).count() == 0


def test_suffix_array_and_prefixes():
    r = random.Random(2)
    for most in (2048, 1):
        suffix_array.MOST_BUCKETS = most
        for _ in range(150):
            t = [r.randrange(r.choice([1, 2, 3, 200])) for _ in range(r.randint(1, 50))]
            assert suffix_array.suffix_array(np.array(t)).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
    suffix_array.MOST_BUCKETS = 2048


def test_language_id(spark):
    parts = {"en": "the and of th ing tion ough", "de": "der und die sch ung ein ich", "es": "el que los ción mente ar", "fr": "le des eau oux que est ment", "ru": "что это как был она"}
    r, rows = random.Random(3), []
    for lang, p in parts.items():
        rows += [(len(rows) + k, " ".join(r.choice(p.split()) + r.choice(p.split()) for _ in range(r.randint(3, 60))), lang) for k in range(80)]
    rows += [(10_000, None, "en"), (10_001, "", "en"), (10_002, "12 34 !!", None), (10_003, "the and of " * 30_000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train(df.where(~language_id.held_out(F.col("doc_id"))))
    got = by_id(language_id.identify(df.withColumn("score", F.lit("clash")), model))
    assert all(0 <= x.score <= 1 for x in got.values()) and [got[i].lang_pred for i in range(10_000, 10_004)] == ["und", "und", "und", "en"]
    test = [r for r in language_id.identify(df.where(language_id.held_out(F.col("doc_id")) & (F.col("doc_id") < 10_000)), model).collect()]
    assert len(test) > 50
    assert np.mean([x.lang_pred == x.lang for x in test]) > 0.95
    assert {x.lang_pred for x in language_id.identify(df, language_id.train(empty(df))).collect()} == {"und"}


def brute_components(rows, words=3, percent=90):
    sets = {}
    for i, t, *_ in rows:
        ws = [w for w in re.split("[ \t\n\x0b\x0c\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        sets[i] = {tuple(ws[k : k + words]) for k in range(len(ws) - words + 1)} if len(ws) >= words else {tuple(ws)} if ws else set()
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("words", "percent", "close", "room", "turns"), [(3, 90, 16, 4, 6), (5, 80, 2, 0, 2), (5, 80, 0, 0, 1)])
def test_jaccard_join(spark, corpus, words, percent, close, room, turns):
    r = random.Random(8)
    rows = [x[:2] for x in corpus[0]]
    base = [r.choice("abcdefghij") + str(r.randrange(200)) for _ in range(200)]
    for k in range(30):
        ws = list(base)
        for _ in range(r.randint(0, 6)):
            ws[r.randrange(200)] = f"new{k}"
        rows.append((1000 + k, " ".join(ws)))
    # A chain whose ends are not similar, and sets that share much without any link.
    rows += [(2000 + k, " ".join(base[5 * k : 100 + 5 * k])) for k in range(20)]
    df = spark.createDataFrame([(*x, "n") for x in rows], "doc_id bigint, text string, n_shingles string")
    want = brute_components(rows, words, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(df, words, percent, close=close, room=room, turns=turns).collect()}
    assert got == want
    assert 1 < len({c for i, (_, c) in got.items() if i >= 1000}) < 30
    assert jaccard_join.similar_documents(empty(df)).count() == 0
    blank = spark.createDataFrame([(1, ""), (2, None), (3, " \n")], "doc_id bigint, text string")
    assert sorted(map(tuple, jaccard_join.similar_documents(blank).collect())) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_jaccard_join_of_long_and_repeated_texts(spark, monkeypatch):
    r = random.Random(5)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(300_000))
    rows = [("b", long), ("a", long + " tail"), ("c", "x y z"), ("c", "x y z"), ("c", long.upper()), (None, long), ("d", "X  Y\tz"), ("e", "é " * 9)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    got = sorted((r.doc_id or "", r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(df).collect())
    n = 300_000 - 4
    assert got == [("", n, None), ("a", n + 1, "a"), ("b", n, "a"), ("c", 1, "c"), ("c", 1, "c"), ("c", n, "a"), ("d", 1, "c"), ("e", 1, "e")]


def test_token_orders_are_the_same_for_every_set(spark):
    r = random.Random(11)
    rows = [(bytes([k]), 20, r.sample(range(10**6, 10**6 + 30), 20), *[0] * len(jaccard_join.MARKS)) for k in range(12)]
    sets = spark.createDataFrame(rows, "node binary, n bigint, tokens array<bigint>, " + ", ".join(f"{m} bigint" for m in jaccard_join.MARKS))
    got = jaccard_join.prefixes(sets, 1, 3).collect()
    assert len(got) == 12 and all(len(x[f"p{k}"]) == 20 for x in got for k in range(3))
    for order in range(3):
        for x in got:
            for y in got:
                both = set(x[f"p{order}"]) & set(y[f"p{order}"])
                assert [t for t in x[f"p{order}"] if t in both] == [t for t in y[f"p{order}"] if t in both]


def test_jaccard_join_of_pairs_about_the_threshold(spark):
    # Copies that share few of the prefix tokens that they may: 61 words, one or two of them other ones.
    r = random.Random(12)
    rows = []
    for _ in range(60):
        base = [f"w{r.randrange(10**6)}" for _ in range(61)]
        for _ in range(4):
            ws = list(base)
            for at in r.sample(range(61), r.randint(0, 2)):
                ws[at] = f"n{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(ws)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.similar_documents(df, 3, 90).collect()}
    assert got == brute_components(rows)


def test_words_across_stretches(monkeypatch):
    r = random.Random(6)
    text = "".join(r.choice("ab Ä\n\u3000") for _ in range(5000)).encode()
    ends = np.array([0, 0, 700, 701, 2500, len(text)])
    whole = shingles.words_of(np.frombuffer(text, np.uint8), ends)
    monkeypatch.setattr(shingles, "STRETCH", 64)
    pieces = shingles.words_of(np.frombuffer(text, np.uint8), ends)
    assert all((a == b).all() for a, b in zip(whole, pieces, strict=True))
    words = [(w, k) for k in range(5) for w in re.split(rb"[ \t\n\x0b\x0c\r]+", text[ends[k] : ends[k + 1]]) if w]
    assert [k for _, k in words] == whole[1].tolist()
    names = {}
    assert all(names.setdefault(w, h) == h for (w, _), h in zip(words, whole[0].tolist(), strict=True)) and len(set(names.values())) == len(names)


def test_sets_take_little_memory():
    import tracemalloc

    r = random.Random(3)
    texts = [" ".join(f"{r.randrange(10**7)}" for _ in range(400)) for _ in range(1300)]
    data, ends = np.frombuffer("".join(texts).encode(), np.uint8), np.r_[0, np.cumsum([len(x) for x in texts])]
    tracemalloc.start()
    shingles.token_sets(data, ends, 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 71 MB before, for 4 MB of text; two tasks share an executor.
    assert 4e6 < len(data) < 4.3e6 and most < 45e6


def test_words_of_opposite_letters():
    # Thue-Morse words and their opposites have the same sum under powers of any odd number modulo 2^64.
    bits = [0]
    for _ in range(13):
        bits += [1 - b for b in bits]
    words = ["".join("ab"[b ^ flip] for b in bits[: 1 << k]) for k in range(1, 14) for flip in (0, 1)]
    text = " ".join([*words, "x" * 70_000, "x" * 70_001, "x" * 69_999 + "y"]).encode()
    hashes, _ = shingles.words_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert len(hashes) == len(set(hashes.tolist())) == len(words) + 3


def test_jaccard_join_of_odd_rows(spark):
    # Words beside white space of other kinds, letters without an ASCII lower case, edits about the threshold and opposite words.
    r = random.Random(13)
    words = [*(f"w{k}" for k in range(120)), "É", "é", "İ", "ß", "a\u00a0b", "\x85", "\x1c", "\x00", "A", "a", "aB", "日本"]
    rows, bases = [], []
    for k in range(250):
        ws = list(r.choice(bases)) if bases and r.random() < 0.6 else r.choices(words, k=r.choice([0, 1, 2, 3, 12, 32, 80]))
        for _ in range(r.choice([0, 1, 1, 2]) if len(ws) > 3 else 0):
            ws[r.randrange(len(ws))] = r.choice(words)
        bases.append(ws)
        rows.append((7 * k - 900, "".join((w.title() if r.random() < 0.1 and w.isascii() else w) + r.choice(" \t\n\x0b\x0c\r") for w in ws) or None))
    bits = [0]
    for _ in range(12):
        bits += [1 - b for b in bits]
    rows += [(5000 + flip, "".join("ab"[b ^ flip] for b in bits)) for flip in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.similar_documents(df, 3, 90).collect()}
    assert got == brute_components(rows)


def brute_contamination(rows, items):
    words = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    wins = defaultdict(set)
    for k, t in items:
        ws = words(t)
        n = min(13, len(ws))
        for i in range(len(ws) - n + 1 if n else 0):
            wins[tuple(ws[i : i + n])].add(str(k))
    out = {}
    for i, t, *_ in rows:
        ws, hit, found = words(t), set(), set()
        for n in {len(w) for w in wins}:
            for k in range(len(ws) - n + 1):
                if own := wins.get(tuple(ws[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        out[i] = (len(ws), len(hit), len(found), sorted(found), bool(hit) and 20 * len(hit) >= len(ws))
    return out


def test_decontamination(spark, corpus):
    rows, df = corpus
    t = rows[4][1].split()
    items = [(1, " ".join(t[3:30])), (2, " ".join(t[3:30]).upper()), (10, "one"), (11, "two, words!"), (12, None), (13, "..."), (14, "never seen words at all here"), (15, " ".join(WORDS[:5] * 4)), (15, " ".join(rows[8][1].split()[:14]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = by_id(decontaminate.decontaminate(df.withColumn("spans", F.lit(1)), bench))
    want = brute_contamination(rows, items)
    assert {i: (r.n_words, r.n_hit, r.n_items, r.item_ids, r.contaminated) for i, r in got.items()} == want and any(x[4] for x in want.values())
    assert decontaminate.decontaminate(df, empty(bench)).where("n_hit > 0 or contaminated").count() == 0
    more = spark.createDataFrame([("a", rows[4][1]), ("a", rows[8][1]), ("b", f"{rows[4][1]} {rows[8][1]}")], "item_id string, text string")
    assert by_id(decontaminate.decontaminate(df.where("doc_id = 4"), more))[4].item_ids == ["a", "b"]
    near = decontaminate.proximity_matches(df, bench.where("item_id = 11"), span=5).select("doc_id").distinct().collect()
    assert {r.doc_id for r in near} == {i for i, x in want.items() if "11" in x[3]}


def test_packing(corpus):
    rows, df = corpus
    for kw in ({}, {"by_source": False}):
        out = packing.pack(df, capacity=64, per_shard=20, **kw).collect()
        n = {i: len((t or "").split()) for i, t, *_ in rows}
        total, bins = Counter(), defaultdict(list)
        for r in out:
            total[r.doc_id] += r.n_tokens
            if r.bin_id is not None:
                bins[r.bin_id].append(r)
        assert dict(total) == n
        digest = {i: re.sub(r"\s+", " ", (t or "").lower()).strip() for i, t, *_ in rows}
        for b in bins.values():
            spans = sorted((r.bin_offset, r.bin_offset + r.n_tokens) for r in b)
            assert spans[0][0] == 0 and spans[-1][1] <= 64 and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
            assert len({digest[r.doc_id] for r in b}) == len(b)
            if not kw:
                known = [r.source for r in b if r.source]
                assert len(set(known)) == len(known)
    assert packing.pack(empty(df)).count() == 0


def test_best_fit_equals_plain_search():
    r = random.Random(4)
    for _ in range(200):
        items = sorted(((r.randint(1, 40), r.randint(-1, 4), r.randint(-1, 9)) for _ in range(60)), reverse=True)
        bins, want = [], []
        for size, s, c in items:
            fit = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= size and not (s >= 0 and s in b["s"]) and not (c >= 0 and c in b["c"])]
            if fit:
                _, k = min(fit)
            else:
                k = len(bins)
                bins.append({"room": 50, "s": set(), "c": set()})
            want.append((k, 50 - bins[k]["room"]))
            bins[k]["room"] -= size
            bins[k]["s"].add(s)
            bins[k]["c"].add(c)
        assert packing.best_fit(items, 50) == want


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 17, 1000, 4097):
        p = training_order.Permutation(n, 5)
        s = p.slots(np.arange(n))
        assert sorted(s.tolist()) == list(range(n)) and (p.indices(s) == np.arange(n)).all()
    assert (training_order.Permutation(1000, 5).slots(np.arange(1000)) != training_order.Permutation(1000, 6).slots(np.arange(1000))).any()


def test_training_order_round_trip(corpus, tmp_path):
    rows, df = corpus
    out = f"file://{tmp_path}/shards"
    made = training_order.materialise(df, out, key=9, seq_len=32, per_shard=10).collect()
    ids = training_order.read_slots(out, 0, 10**6)
    assert len(ids) == len(made) and sorted(r.slot for r in made) == list(range(len(made)))
    assert all(hashlib.sha256(ids[r.slot].tobytes()).hexdigest() == r.sha256 for r in made)
    assert (training_order.read_slots(out, 7, 9) == ids[7:16]).all()
    stream = np.concatenate([ids[r.slot][: r.n_tokens] for r in sorted(made, key=lambda r: r.seq)])
    coder = training_order.Tokenizer(open(training_order.RANKS, "rb").read())
    ends = np.flatnonzero(stream == coder.end)
    docs = [coder.coder.decode(x[x != coder.end].tolist()) for x in np.split(stream, ends)]
    assert sorted(d for d in docs if d) == sorted(t for _, t, *_ in rows if t)
    assert training_order.materialise(empty(df), f"file://{tmp_path}/none").count() == 0


ODD = ["It's  a test,  isn't it? 12,5 % of_x\n\n  end ", "Élan à côté: ½ ² x̂ 日本 ok", "\x1c odd\xa0space × ÷", "", " lead", "trail ", "a\n b", "a \nb", "one two\nthree four", " ", "\n", "x", "a\u2028 b c", "\x00 zero \x00", "twice twice twice", "end. end, end; end! end!! end? it's. a1. née, née née. .. . x", "don't, stop: no's."]


def test_fast_tokenizer_equals_the_slow_one(monkeypatch):
    ranks = open(training_order.RANKS, "rb").read()
    t, counter = training_order.Tokenizer(ranks), training_order.Tokenizer(ranks, counts=True)
    for memo in (10**6, 0):
        monkeypatch.setattr(training_order, "MEMO", memo)
        for given in (ODD, ODD[::-1], ["the same"] * 3, [""], [x or "" for x in texts(4, 20)]):
            ids, offsets = t.encode(given)
            want = [[*t.coder.encode_ordinary(x), t.end] if x else [] for x in given]
            assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == want
            assert counter.count(given) == sum(map(len, want))


def test_counted_words_are_not_encoded_again(monkeypatch):
    t = training_order.Tokenizer(open(training_order.RANKS, "rb").read())
    given = [f"first {' '.join(f'w{k * j}' for j in range(50))} {'long' * 9}" for k in range(9)]
    want = [x for text in given for x in (*t.coder.encode_ordinary(text), t.end)]
    asked, encode = [], t._ids
    monkeypatch.setattr(t, "_ids", lambda text: asked.append(text) or encode(text))
    assert t.count(given) == len(want)
    asked.clear()
    # Both passes use what the other has learned; before, each had ids or numbers of its own.
    assert t.encode(given)[0].tolist() == want and set(asked) == {"first"}
    # Keys that share a hash are still told apart.
    monkeypatch.setattr(training_order, "_hashes", lambda keys: np.zeros(keys.shape[1], np.uint64))
    t._forget()
    assert t.encode(given)[0].tolist() == want


def test_shards_are_written_without_the_tokenizer_and_in_small_batches(corpus, tmp_path, monkeypatch):
    _, df = corpus
    conf, run, passes = df.sparkSession.conf, type(df).mapInArrow, []
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, sizes, read = conf.get(name), [], type(df).collect
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: passes.append(f) or run(self, f, schema))
    monkeypatch.setattr(type(df), "collect", lambda self: sizes.append(conf.get(name)) or read(self))
    monkeypatch.setattr(training_order, "durable", lambda made, _: sizes.append(conf.get(name)))
    training_order.materialise(df, f"file://{tmp_path}/s", seq_len=32)
    assert sizes == [str(training_order.BATCH_BYTES)] * 2 and conf.get(name) == before
    # What a worker has learned, hundreds of megabytes on large inputs, is let go once shards are written.
    training_order._tokenizer(open(training_order.RANKS, "rb").read())
    assert not list(passes[-1](iter([]))) and not training_order._HELD


@pytest.mark.parametrize("room", [None, 2])
def test_entries_are_not_copied_for_every_slice(monkeypatch, room):
    if room:
        monkeypatch.setattr(training_order, "ROOM", room)
    t = training_order.Tokenizer(open(training_order.RANKS, "rb").read())
    held = [t.keys, t.size, t.begin, t.pool]
    for k in range(5):
        given = [*ODD, " ".join(f"w{k * j}" for j in range(40)), "first"]
        ids, offsets = t.encode(given)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [[*t.coder.encode_ordinary(x), t.end] if x else [] for x in given]
    # Before, each slice made new arrays; now only one that is too short is copied.
    assert all(x is y for x, y in zip(held, [t.keys, t.size, t.begin, t.pool], strict=True)) == (room is None)


def brute_repeats(text):
    ws = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text or "") if w]
    grams = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    return len({k for i in range(len(ws) - 7) if grams[tuple(ws[i : i + 8])] > 1 for k in range(i, i + 8)})


def test_quality_measures(spark, corpus):
    rows, df = corpus
    more = [(500, "a b c d e f g h " * 5), (501, " ".join(map(str, range(50))) + " x " + " ".join(map(str, range(12)))), (502, "# $ |\n# $ |\n\n  \n# $ |")]
    df = df.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(*x, None) for x in more], "doc_id bigint, text string, lang string"))
    got = by_id(quality_rules.measures(df))
    for i, t in [x[:2] for x in rows] + more:
        lines = [x for x in (t or "").split("\n") if re.search("[^ \t\n\x0b\x0c\r]", x)]
        want = (len([w for w in re.split("[ \t\n\x0b\x0c\r]+", t or "") if w]), len(re.sub("[ \t\n\x0b\x0c\r]", "", t or "")), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), brute_repeats(t))
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want


def test_binomial_tail(spark):
    from math import comb

    cases = [(10, 0), (10, 1), (200, 1), (500, 3), (2000, 10), (40, 39)]
    df = spark.createDataFrame(cases, "n bigint, r bigint").select("n", "r", quality_rules.binomial_tail(F.col("n"), F.col("r"), 0.0125).alias("p"))
    for x in df.collect():
        exact = sum(comb(x.n, k) * 0.0125**k * 0.9875 ** (x.n - k) for k in range(x.r + 1))
        assert x.p == (pytest.approx(exact, rel=1e-9) if x.r < x.n * 0.0125 else 1.0)


def test_certified_cutoffs_keep_good_documents(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(3000):
        good = r.random() < 0.8
        ws = [r.choice(WORDS) + str(r.randrange(10**6)) for _ in range(40)]
        rows.append((i, " ".join(w if good or r.random() < 0.3 else w + "###" for w in ws), "en"))
        labels.append((i, int(good)))
    df, lab = spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int")
    out = by_id(quality_rules.apply_rules(df, lab))
    good = [out[i].kept for i, q in labels if q]
    bad = [out[i].kept for i, q in labels if not q]
    assert np.mean(good) >= 0.95 and np.mean(bad) < 0.05
    assert quality_rules.apply_rules(df, empty(lab)).where("not kept").count() == 0 and quality_rules.apply_rules(empty(df), lab).count() == 0


def test_every_language_is_learned(spark):
    rows = [(2 * i + k, f"text of language {i}", f"l{i:03}") for i in range(230) for k in (0, 1)]
    labelled = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {r.lang for r in language_id.training_sample(labelled).collect()} == {x for *_, x in rows}
    assert {r.lang for r in language_id.training_sample(labelled, per_lang=0).collect()} == {x for *_, x in rows}
