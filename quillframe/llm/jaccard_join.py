"""Exact Jaccard join of word shingle sets by prefix filters under several global token orders.

Sets: hashed shingles of `words` words of the lower-cased text. The orders rank tokens by their number of documents,
rare ones first, with different ties. Two sets whose similarity is at least t share a token among the first
n - ceil(t n) + 1 tokens of each, under every order; a pair that lacks one under any order is never verified.

1. Repeated tokens. Each slice of documents sends its tokens to buckets of the token space, in blobs, a token once a
   slice; a bucket answers which of them it got twice. A set of which less than the share t is repeated has no partner
   and goes. Tokens are 32 bits within a bucket here: a collision only keeps a set that could have gone.
2. Orders. Of the sets that are left, one a class of equal sets, tokens are counted exactly, and each set's prefixes
   are cut under every order. Tokens that occur once come first and make no candidate.
3. Candidates. Sets that share a prefix token under the first order are a list. A list of few sets that are not connected
   yet gives all pairs across components, which closes it. Of a longer one, members are first compared with two
   pivots, of its largest component and of the rest; what gets connected needs no comparison with each other. Once all
   pairs across components that remain are at most `room` for each member of a list at the start, or a turn leaves
   over half of them, or after `turns` turns, all are made. Pairs whose sizes or marks (512 parities of tokens by hash)
   show that too many tokens differ are left out within the join, so that it makes hardly more rows than there are links
   between components; it still compares them. No pair that could be similar is left out.
4. Intersection and verification. Pairs that also share a token under the other orders get both sets and are compared
   exactly. Components grow over verified links only.

Results: exact but for collisions of 64-bit shingle hashes. Null, empty and wordless texts have an empty set and are
linked with nothing; fewer words than a shingle are one shingle. A null doc_id is never linked and has a null
component. Rows are judged by their own text: rows that repeat a doc_id with other texts get each their set's component.
Other columns are not used. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.operators.graph import components

from .common import batches_of, broadcast_small, durable
from .shingles import mix, sliced, token_sets

WORDS, PERCENT, ORDERS = 5, 80, 3
SLICE_BYTES, BUCKET_BYTES, BATCH_BYTES = 4 << 20, 8 << 20, 2 << 20
#: A list with at most so many sets beside its largest component is closed at once; pairs a member for closing all; most turns.
CLOSE, ROOM, TURNS = 16, 4, 6
_MANY = 0xFFFF
#: Each set's parity of tokens per bit, 64 bits a column; two sets differ in at least as many tokens as bits.
MARKS = tuple(f"m{k}" for k in range(8))


def _requests(docs: DataFrame, words: int, buckets: int) -> DataFrame:
    """Rows for buckets: (bucket, slice, tokens, refs), and one a slice with what is known of its documents."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # The scan gives each partition the same rows in the same order again, so that a lost task repeats its slices.
        at = TaskContext.get().partitionId() << 32
        for ids, data, ends in sliced(batches, SLICE_BYTES, _MANY):
            token, ref, sizes, names = token_sets(data, ends, words)
            first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
            count = np.diff(np.r_[first, len(token)])
            local = np.bincount(ref[np.repeat(count > 1, count)], minlength=len(ids)).astype(np.uint32)
            one, mark = token[first], np.where(count > 1, _MANY, ref[first]).astype(np.uint16)
            del token, ref, first, count
            # Tokens are in order, and so are their buckets.
            bucket = ((one >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            start = np.flatnonzero(np.diff(bucket, prepend=-1))
            to, stop = bucket[start], np.r_[start[1:], len(one)][: len(start)]
            low = one.astype(np.uint32)
            n = len(to)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*to.tolist(), -1 - at % buckets], pa.int32()),
                    pa.array([at] * (n + 1), pa.int64()),
                    pa.array([*(low[a:b].tobytes() for a, b in zip(start, stop, strict=True)), local.tobytes()], pa.binary()),
                    pa.array([*(mark[a:b].tobytes() for a, b in zip(start, stop, strict=True)), b""], pa.binary()),
                    pa.concat_arrays([pa.nulls(n, pa.list_(ids.type)), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]),
                    pa.array([None] * n + [sizes.astype(np.uint32).tobytes()], pa.binary()),
                    pa.array([None] * n + [names], pa.binary()),
                ],
                names=["bucket", "slice", "a", "b", "ids", "sizes", "names"],
            )
            at += 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"bucket int, slice bigint, a binary, b binary, ids array<{kind}>, sizes binary, names binary")


def _answer(part: pa.Table) -> pa.Table:
    """For each slice, its documents and their numbers of tokens that this bucket got more than once."""
    out = part.select(["slice", "a", "b", "ids", "sizes", "names"])
    if part.column("bucket")[0].as_py() < 0:
        return out
    tokens = [np.frombuffer(x.as_py(), np.uint32) for x in part.column("a")]
    refs = [np.frombuffer(x.as_py(), np.uint16) for x in part.column("b")]
    token, ref = np.concatenate(tokens), np.concatenate(refs)
    order = np.argsort(token, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(token[order]) != 0])
    count = np.diff(np.r_[first, len(token)])
    twice = np.empty(len(token), bool)
    twice[order] = np.repeat((count > 1) | np.logical_or.reduceat((ref == _MANY)[order], first), count)
    twice &= ref != _MANY
    ends = np.cumsum([len(x) for x in tokens])
    who, many = [], []
    for start, stop in zip(np.r_[0, ends[:-1]], ends, strict=True):
        n = np.bincount(ref[start:stop][twice[start:stop]])
        at = np.flatnonzero(n)
        who.append(at.astype(np.uint16).tobytes())
        many.append(n[at].astype(np.uint32).tobytes())
    return out.set_column(1, "a", pa.array(many, pa.binary())).set_column(2, "b", pa.array(who, pa.binary()))


def _gathered(percent: int, kind: pa.DataType):
    def gather(part: pa.Table) -> pa.Table:
        own = next(r for r in part.to_pylist() if r["ids"] is not None)
        n = np.frombuffer(own["sizes"], np.uint32).astype(np.int64)
        shared = np.frombuffer(own["a"], np.uint32).astype(np.int64)
        for many, who, sizes in zip(part.column("a"), part.column("b"), part.column("sizes"), strict=True):
            if not sizes.is_valid:
                shared[np.frombuffer(who.as_py(), np.uint16)] += np.frombuffer(many.as_py(), np.uint32)
        names = [own["names"][k : k + 16] for k in range(0, 16 * len(n), 16)]
        return pa.table({"doc_id": pa.array(own["ids"], kind), "n_shingles": pa.array(n), "node": pa.array(names, pa.binary()), "stays": pa.array((n > 0) & (100 * shared >= percent * n))})

    return gather


def judged_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, node, stays) of every row: the set's size and name, and whether it may have a partner."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    name = docs.schema["doc_id"].dataType.simpleString()
    kind = StructType.fromDDL(f"doc_id {name}")["doc_id"].dataType  # as Spark reads the name again, with nulls anywhere
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    answers = _requests(docs, words, buckets).groupBy("bucket").applyInArrow(_answer, f"slice bigint, a binary, b binary, ids array<{name}>, sizes binary, names binary")
    return answers.groupBy("slice").applyInArrow(_gathered(percent, to_arrow_type(kind)), f"doc_id {name}, n_shingles bigint, node binary, stays boolean")


def _sets_of(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(node, n, tokens) of the classes that stay, one row each."""
    reps = classes.where("stays").select("node", F.col("rep").alias("__rep"))
    texts = docs.join(broadcast_small(reps), docs["doc_id"] == reps["__rep"]).select("node", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, data, ends in sliced(batches, SLICE_BYTES, _MANY, "node"):
            token, ref, sizes, names = token_sets(data, ends, words)
            order = np.argsort(ref, kind="stable")
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(token[order].view(np.int64)))
            # Rows that repeat a doc_id may have other texts.
            same = pa.array([x.as_py() == names[16 * k : 16 * k + 16] for k, x in enumerate(nodes)], pa.bool_())
            marks = [pa.array(m) for m in _parities(token[order], sizes)]
            yield pa.RecordBatch.from_arrays([nodes, pa.array(sizes), lists, *marks], names=["node", "n", "tokens", *MARKS]).filter(same)

    columns = ", ".join(f"{m} bigint" for m in MARKS)
    return texts.mapInArrow(build, f"node binary, n bigint, tokens array<bigint>, {columns}").dropDuplicates(["node"])


def _parities(token: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """One int64 array a column of MARKS: which bits an odd number of a set's tokens fall on. Sets follow each other."""
    sizes = np.asarray(sizes, np.int64)
    full = sizes > 0
    starts = (np.cumsum(sizes) - sizes)[full]
    place = mix(token) >> np.uint64(55)
    bit = np.uint64(1) << (place & np.uint64(63))
    out = []
    for k in range(len(MARKS)):
        column = np.zeros(len(sizes), np.uint64)
        if len(starts):
            column[full] = np.bitwise_xor.reduceat(np.where(place >> np.uint64(6) == k, bit, np.uint64(0)), starts)
        out.append(column.view(np.int64))
    return out


def _least_overlap(n: Column, percent: int) -> Column:
    """Tokens that a set of n shares at least with a similar one."""
    return F.ceil(n * percent / 100 - F.lit(1e-9))


def _by_rank(order: int):
    """What a token is sorted by: number of documents, then token; in the others its magnitude, then a hash of their own."""

    # One parameter only: F.transform would hand a second one the token's place in the array, which is no global order.
    def rank(x: Column) -> Column:
        if order == 0:
            return F.struct(x["df"].alias("df"), x["token"].alias("by"), x["token"].alias("token"))
        return F.struct(F.floor(F.log2(x["df"])).alias("df"), F.xxhash64(F.lit(order), x["token"]).alias("by"), x["token"].alias("token"))

    return rank


def prefixes(sets: DataFrame, percent: int, orders: int) -> DataFrame:
    """(node, n, p0, p1, ...): the repeated tokens of each set's prefix under every order; sets without any are left out."""
    tokens = sets.select("node", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = tokens.join(counts, "token").groupBy("node").agg(F.collect_list(F.struct(F.col("df").cast("int").alias("df"), "token")).alias("k"))
    shared = shared.join(sets.select("node", "n", *MARKS), "node")
    length = (F.size("k") - _least_overlap(F.col("n"), percent) + 1).cast("int")
    ranked = [F.slice(F.sort_array(F.transform("k", _by_rank(order))), F.lit(1), length)["token"].alias(f"p{order}") for order in range(orders)]
    return shared.where(length > 0).select("node", "n", *MARKS, *ranked)


def _may_match(x: str, y: str, percent: int) -> Column:
    """Whether sizes and marks of two sets leave room for the similarity: similar sets differ in few tokens."""
    a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
    apart = sum(F.bit_count(F.col(f"{x}.{m}").bitwiseXOR(F.col(f"{y}.{m}"))) for m in MARKS)
    return (100 * a >= percent * b) & (100 * b >= percent * a) & ((100 + percent) * apart <= (100 - percent) * (a + b))


def _verified(pairs: DataFrame, prefix: DataFrame, sets: DataFrame, percent: int, orders: int) -> DataFrame:
    """(a, b) of the pairs that pass every order's filter and are similar."""
    for side in ("a", "b"):
        own = prefix.select(F.col("node").alias(side), *(F.col(f"p{k}").alias(f"{side}{k}") for k in range(1, orders)))
        pairs = pairs.join(own, side)
    for k in range(1, orders):
        pairs = pairs.where(F.arrays_overlap(f"a{k}", f"b{k}"))
    met = durable(pairs.select("a", "b"), "jaccard-candidates")
    for side in ("a", "b"):
        met = met.join(sets.select(F.col("node").alias(side), F.col("tokens").alias(f"t{side}")), side)
    common = F.size(F.array_intersect("ta", "tb"))
    scored = met.select("a", "b", common.alias("c"), (F.size("ta") + F.size("tb")).alias("n"))
    return scored.where(100 * F.col("c") >= percent * (F.col("n") - F.col("c"))).select("a", "b")


def _stars(members: DataFrame, percent: int, turn: int) -> DataFrame:
    """(a, b): the members of each list with its two pivots, where components differ.

    At first, lists of the same members get the same pivots, whose pairs are then verified once. What these leave apart
    meets other pivots in every turn and list: members whose similarities lie about the threshold are linked to some only.
    """
    by = F.xxhash64("node") if turn == 0 else F.xxhash64(F.lit(turn), "token", "node")
    first = lambda where: F.min(F.when(where, F.struct(by.alias("h"), "node", "n", "comp", *MARKS)))
    pivots = members.groupBy("token").agg(first(F.expr("comp = main")).alias("u"), first(F.expr("comp <> main")).alias("v"))
    pivots = pivots.select("token", F.explode(F.array("u", "v")).alias("pivot"))
    pivots = pivots.where("pivot is not null").select("token", "pivot.*").alias("p")
    met = members.alias("x").join(pivots, (F.col("x.token") == F.col("p.token")) & (F.col("x.comp") != F.col("p.comp")) & _may_match("x", "p", percent))
    return met.select(F.col("x.node").alias("a"), F.col("p.node").alias("b"))


def links(prefix: DataFrame, sets: DataFrame, percent: int, orders: int = ORDERS, close: int = CLOSE, room: int = ROOM, turns: int = TURNS) -> DataFrame:
    """(a, b): verified links that connect exactly what similarity connects."""
    found = prefix.sparkSession.createDataFrame([], "a binary, b binary")
    lists = prefix.select(F.explode("p0").alias("token"), "node", "n", F.col("node").alias("comp"), *MARKS)
    left = 0
    for turn in range(turns + 1):
        # At first, groups of copies are still apart: all pairs of a list would be quadratic in them, pivots are not.
        most = close if turn else min(close, 2)
        lists = durable(lists, "jaccard-lists")
        # A prefix token of a few sets only is the rule: their components are counted before lists are.
        per = lists.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("token")
        per = per.agg(F.sum("c").alias("m"), F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
        per = durable(per.select("token", "m", F.col("top.comp").alias("main"), (F.col("m") - F.col("top.c")).alias("rest")), "jaccard-open-lists")
        open_ = per.agg(F.coalesce(F.sum(F.when(F.col("rest") > most, F.col("rest") * F.col("m"))), F.lit(0)).alias("pairs")).first()
        budget = room * lists.count() if turn == 0 else budget
        # A turn of pivots that leaves over half of the pairs would not be followed by a better one.
        stuck = turn > 1 and 2 * open_["pairs"] > left
        last = turn == turns or stuck or open_["pairs"] <= (budget if turn else 0)
        left = open_["pairs"]
        members = durable(lists.join(per.drop("m"), "token"), "jaccard-members")
        few, many = members if last else members.where(F.col("rest") <= most), members.where(F.col("rest") > most)
        x, y = few.where("comp <> main").alias("x"), few.alias("y")
        # Each pair across components once: of two that both are beside the main one, the smaller node asks.
        ask = (F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
        all_pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & ask & _may_match("x", "y", percent)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        pairs = all_pairs
        if not last:
            pairs = pairs.unionByName(_stars(many, percent, turn))
        pairs = durable(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jaccard-pairs")
        new = durable(_verified(pairs, prefix, sets, percent, orders), "jaccard-links")
        found = found.unionByName(new)
        if last:
            return found
        named = components(found).withColumnRenamed("component", "__comp")
        lists = many.join(named, "node", "left").select("token", "node", "n", F.coalesce("__comp", "node").alias("comp"), *MARKS)
    return found


def similar_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, orders: int = ORDERS, close: int = CLOSE, room: int = ROOM, turns: int = TURNS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs`; component_id is the smallest doc_id reachable by links."""
    docs = docs.select("doc_id", "text")
    with batches_of(docs.sparkSession, BATCH_BYTES):
        rows = durable(judged_sets(docs, words, percent), "jaccard-rows")
    known = rows.where("n_shingles > 0 and doc_id is not null")
    classes = durable(known.groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("stays").alias("stays"), F.first("n_shingles").alias("n")), "jaccard-classes")
    with batches_of(docs.sparkSession, BATCH_BYTES):
        sets = durable(_sets_of(docs, classes, words), "jaccard-sets")
    prefix = durable(prefixes(sets, percent, orders), "jaccard-prefixes")
    found = durable(components(links(prefix, sets, percent, orders, close, room, turns)), "jaccard-components")
    # A component is named by the smallest doc_id of its classes.
    names = found.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("name"))
    named = classes.join(found, "node", "left").join(names, "component", "left").select("node", F.coalesce("name", "rep").alias("component_id"))
    linked = known.select("doc_id", "n_shingles", "node").join(named, "node", "left").select("doc_id", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
