"""Token-ID output in training order.

Documents are tokenised into one stream a partition, each followed by an end-of-text id, and cut
into sequences of `seq_len` ids; a partition's last sequence is padded with that id. Sequence i of
n gets slot p(i): a keyed Feistel permutation of the next even power of two, walked along its cycle until it
falls below n, so that it is a bijection of 0..n-1 which any task can compute alone and invert.
Slots are dealt by range to shards of `per_shard` records. A shard is a file of fixed-stride
records in slot order: record r of shard s is slot s x per_shard + r, at byte r x stride. A run can
stop and go on at any slot by a seek.

The input is tokenised twice, to count sequences and to write them; that saves a copy of all ids on disk. Texts are
tokenised in slices, each chunk that is not known from before once. The input must the same partitions twice, as a scan of files does; a partition whose count differs
fails the job. Shard files are written under a name of their own by each attempt and renamed when
whole, so that retried and speculative tasks do no harm. Only counts a partition reach the driver.

Null and empty texts add nothing. Repeated rows are written as often as they occur. An empty table
has no shard. Columns other than doc_id and text are not used.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, durable, new_path
from .shingles import sliced

SEQ_LEN, PER_SHARD, ROUNDS, SLICE_BYTES = 1024, 16_384, 6, 1 << 20
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of a batch between the JVM and Python.
BATCH_BYTES = 4 << 20
#: How the vocabulary's texts are cut before merging (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks that are kept at most, but for those of one slice.
MEMO = 2_000_000
#: Entries that there is room for at first: MEMO and those of a slice.
ROOM = MEMO + (1 << 18)
#: Most bytes of a chunk whose key holds all of them and, in the last byte, their number.
KEY = 23
_NO_KEY = np.uint64(2**64 - 1)
_MASKS = np.array([[(1 << 8 * min(max(n - 8 * k, 0), 8)) - 1 for n in range(KEY + 1)] for k in range(3)], np.uint64)

class Tokenizer:
    """A byte-level BPE vocabulary of tiktoken ranks; the ids of recent chunks are kept, for counting and writing alike.

    PATTERN never joins what a single space between two other characters parts: the space goes to what
    follows. So a text is cut at such spaces and chunks are encoded on their own; those of a slice of texts that are not
    known yet are encoded in one call, joined by spaces, and told apart by the ids that begin with one. Texts in which
    white space stands beside a space, or at an end next to one, are encoded whole; so is each text's first chunk.

    Chunks of up to KEY bytes are looked up all at once by their bytes and length in three 64-bit numbers, in a hash table
    with linear probing that compares all three; longer ones are in a dict. Entry 0 is the end-of-text id, and a size of
    -1 marks a chunk that must not stand alone. With `counts`, only numbers of ids are kept.

    Arrays of entries are made at full length once, of which the system gives memory only to what is written: copies that
    grow with every slice would leave holes that take more than the entries. What lies beyond `n` entries and `used`
    ids of the pool is scratch.
    """

    def __init__(self, ranks: bytes, counts: bool = False):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.coder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.dtype = np.uint16 if self.end < 1 << 16 else np.uint32
        self.opens = np.zeros(self.end, bool)
        self.opens[[i for x, i in ranks.items() if x[:1] == b" "]] = True
        self.counts = counts
        self._forget()

    def _forget(self) -> None:
        self.slots, self.long, self.held = np.zeros(1 << 16, np.int32), {}, 0
        self.keys, self.size, self.begin, self.pool = np.empty((3, 0), np.uint64), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, self.dtype)
        self.n = self.used = 0
        self._room(ROOM, 4 * ROOM)
        self.keys[:, 0], self.size[0], self.begin[0], self.pool[0] = _NO_KEY, 1, 0, self.end
        self.n = self.used = 1

    def _room(self, entries: int, ids: int) -> None:
        """Make room for so many more entries and ids."""
        longer = lambda x, n: np.concatenate([x, np.empty((*x.shape[:-1], n), x.dtype)], axis=-1) if x.size else np.empty((*x.shape[:-1], n), x.dtype)
        if self.n + entries > len(self.size):
            more = max(entries, len(self.size))
            self.keys, self.size, self.begin = longer(self.keys, more), longer(self.size, more), longer(self.begin, more)
        if self.used + ids > len(self.pool):
            self.pool = longer(self.pool, max(ids, len(self.pool)))

    def _ids(self, text: str) -> np.ndarray:
        return self.coder.encode_to_numpy(text).astype(self.dtype)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, 0 if unknown."""
        last = len(self.slots) - 1
        at, out, todo = (_hashes(keys) & np.uint64(last)).astype(np.int64), np.zeros(keys.shape[1], np.int32), np.arange(keys.shape[1])
        while len(todo):
            e = self.slots[at[todo]]
            same = (self.keys[0][e] == keys[0][todo]) & (self.keys[1][e] == keys[1][todo]) & (self.keys[2][e] == keys[2][todo])
            out[todo[same]] = e[same]
            todo = todo[~same & (e > 0)]
            at[todo] = at[todo] + 1 & last
        return out

    def _place(self, entries: np.ndarray) -> None:
        """Put entries of different keys into the table."""
        last = len(self.slots) - 1
        at = (_hashes(self.keys[:, entries]) & np.uint64(last)).astype(np.int64)
        while len(entries):
            free = self.slots[at] == 0
            self.slots[at[free]] = entries[free]
            lost = self.slots[at] != entries
            entries, at = entries[lost], at[lost] + 1 & last

    def _learn(self, chunks: list[str], keys: np.ndarray) -> np.ndarray:
        """Make an entry for each of these chunks, all different and not known yet."""
        alone = np.array([bool(c) and not c[0].isspace() and not c[-1].isspace() for c in chunks], bool)
        size = np.full(len(chunks), -1, np.int32)
        ids = np.zeros(0, self.dtype)
        if alone.any():
            ids = self._ids(" " + " ".join(c for c, x in zip(chunks, alone.tolist(), strict=True) if x))
            begin = np.flatnonzero(self.opens[ids])
            if len(begin) != alone.sum():
                raise RuntimeError("the vocabulary joins what single spaces part")
            size[alone] = np.diff(np.r_[begin, len(ids)])
        n, many = self.n, np.maximum(size, 0)
        self._room(len(chunks), len(ids))
        self.n += len(chunks)
        self.begin[n : self.n] = self.used + np.cumsum(many) - many
        self.keys[:, n : self.n], self.size[n : self.n] = keys, size
        if not self.counts:
            self.pool[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
        entries = np.arange(n, self.n, dtype=np.int32)
        if 2 * self.n > len(self.slots):
            self.slots = np.zeros(1 << (4 * self.n).bit_length(), np.int32)
            n = 1
        keyed = np.arange(n, self.n, dtype=np.int32)
        self._place(keyed[self.keys[2][keyed] != _NO_KEY])
        return entries

    def _entries(self, data: np.ndarray, raw: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The entry of each chunk; those that are not known are learned."""
        size = stops - starts
        at = np.flatnonzero(size <= KEY)
        whole = np.concatenate([data, np.zeros(24, np.uint8)])
        eight = np.ndarray(len(whole) - 7, "<u8", whole, strides=(1,))
        keys = np.stack([eight[starts[at] + 8 * k] & _MASKS[k][size[at]] for k in range(3)])
        keys[2] |= size[at].astype(np.uint64) << np.uint64(56)
        out = np.zeros(len(starts), np.int32)
        out[at] = found = self._find(keys)
        while len(new := np.flatnonzero(found == 0)):
            # Different keys with the same hash are learned one after the other.
            new = new[np.unique(_hashes(keys[:, new]), return_index=True)[1]]
            self._learn([raw[a:b].decode() for a, b in zip(starts[at[new]].tolist(), stops[at[new]].tolist(), strict=True)], keys[:, new])
            left = np.flatnonzero(found == 0)
            found[left] = self._find(keys[:, left])
        out[at] = found
        at = np.flatnonzero(size > KEY)
        if len(at):
            chunks = [raw[a:b] for a, b in zip(starts[at].tolist(), stops[at].tolist(), strict=True)]
            new = list(dict.fromkeys(c for c in chunks if c not in self.long))
            if new:
                self.long.update(zip(new, self._learn([c.decode() for c in new], np.full((3, len(new)), _NO_KEY)).tolist(), strict=True))
                self.held += sum(map(len, new))
            out[at] = [self.long[c] for c in chunks]
        return out

    def _cut(self, data: np.ndarray, ends: np.ndarray):
        """Of the texts that are not empty: their numbers, the entries of all chunks, which are first, the text of each, which texts are whole, and the ids of first chunks or whole texts."""
        if self.n > MEMO or self.held > 32 * MEMO:
            self._forget()
        texts = np.flatnonzero(np.diff(ends))
        begin, end = ends[texts], ends[texts + 1]
        blank = np.flatnonzero(data == 32)
        n = np.searchsorted(blank, end) - np.searchsorted(blank, begin) + 1
        first, last = np.zeros(len(blank) + len(texts), bool), np.zeros(len(blank) + len(texts), bool)
        first[np.cumsum(n) - n] = last[np.cumsum(n) - 1] = True
        starts, stops = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        starts[first], starts[~first], stops[last], stops[~last] = begin, blank + 1, end, blank
        raw, entry, of = data.tobytes(), np.zeros(len(first), np.int64), np.repeat(np.arange(len(texts)), n)
        entry[~first] = self._entries(data, raw, starts[~first], stops[~first])
        whole, own = np.zeros(len(texts), bool), []
        whole[of[self.size[entry] < 0]] = True
        for k, (a, b, c) in enumerate(zip(begin.tolist(), stops[first].tolist(), end.tolist(), strict=True)):
            head = raw[a:b].decode()
            whole[k] |= not head or head[-1].isspace()
            own.append(self._ids(raw[a:c].decode() if whole[k] else head))
        return texts, entry, first, of, whole, own

    def counted(self, data: np.ndarray, ends: np.ndarray) -> int:
        """Ids of all texts, with an end for each that is not empty."""
        texts, entry, first, of, whole, own = self._cut(data, ends)
        return int(self.size[entry[~first & ~whole[of]]].sum(dtype=np.int64)) + sum(map(len, own)) + len(texts)

    def encoded(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each that is not empty followed by its end, and the n + 1 offsets."""
        texts, entry, first, of, whole, own = self._cut(data, ends)
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(len(ends), np.int64)
        mine = np.array([len(x) for x in own])
        self._room(len(own), int(mine.sum()))
        self.size[self.n : self.n + len(own)], self.begin[self.n : self.n + len(own)] = mine, self.used + np.cumsum(mine) - mine
        self.pool[self.used : self.used + int(mine.sum())] = np.concatenate(own)
        entry[first] = self.n + np.arange(len(texts))
        stay = first | ~whole[of]
        upto = np.cumsum(np.bincount(of[stay], minlength=len(texts)))
        entry = np.insert(entry[stay], upto, 0)
        n = self.size[entry]
        stop = np.cumsum(n)
        ids = self.pool[np.repeat(self.begin[entry] - (stop - n), n) + np.arange(stop[-1])]
        each = np.zeros(len(ends) - 1, np.int64)
        each[texts] = np.diff(stop[upto + np.arange(len(texts))], prepend=0)
        return ids, np.r_[0, np.cumsum(each)]

    def count(self, texts: list[str]) -> int:
        return self.counted(*_bytes(texts))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.encoded(*_bytes(texts))


def _bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(x) for x in data], dtype=np.int64)]


_HELD: dict[int, Tokenizer] = {}


def _tokenizer(ranks: bytes) -> Tokenizer:
    """The worker's tokenizer: what one task has learned serves the next, also of the other pass."""
    key = hash(ranks)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Tokenizer(ranks)
    return _HELD[key]


def _release() -> None:
    """Let the worker's tokenizer go: no task tokenises after the first shard is begun."""
    _HELD.clear()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(keys: np.ndarray) -> np.ndarray:
    return _mix(keys[0] + _mix(keys[1] + _mix(keys[2])))


class Permutation:
    """A keyed bijection of 0..n-1: a balanced Feistel network with cycle-walking."""

    def __init__(self, n: int, key: int, rounds: int = ROUNDS):
        self.n, self.half = n, np.uint64(max(1, -(-max(1, (n - 1).bit_length()) // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = _mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))

    def _network(self, x: np.ndarray, back: bool) -> np.ndarray:
        a, b = x >> self.half, x & self.mask
        for k in self.keys[::-1] if back else self.keys:
            if back:
                a, b = b ^ (_mix(a + k) & self.mask), a
            else:
                a, b = b, a ^ (_mix(b + k) & self.mask)
        return (a << self.half) | b

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._network(np.asarray(x, np.uint64), back)
        while (over := out >= self.n).any():
            out[over] = self._network(out[over], back)
        return out.astype(np.int64)

    def slots(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, False)

    def indices(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


def _sequences(batches: Iterator[pa.RecordBatch], coder: Tokenizer, seq_len: int) -> Iterator[tuple[np.ndarray, int, pa.Array]]:
    """(ids as rows of seq_len, real ids of the last row, doc_ids that start in each) of a partition's stream."""
    held, docs, at = np.zeros(0, coder.dtype), None, np.zeros(0, np.int64)

    def rows(ids: np.ndarray, names: pa.Array, where: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(where, np.arange(0, len(ids) + 1, seq_len)), pa.int32()), names)

    for keys, data, ends in sliced(batches, SLICE_BYTES, 1 << 20):
        ids, offsets = coder.encoded(data, ends)
        some = np.flatnonzero(np.diff(offsets))
        keys = keys.take(pa.array(some))
        docs = keys if docs is None else pa.concat_arrays([docs, keys])
        at = np.r_[at, len(held) + offsets[some]]
        held = np.r_[held, ids]
        full = len(held) // seq_len * seq_len
        if full:
            mine = int(np.searchsorted(at, full))
            yield held[:full].reshape(-1, seq_len), seq_len, rows(held[:full], docs.slice(0, mine), at[:mine])
            held, docs, at = held[full:], docs.slice(mine), at[mine:] - full
    if len(held):
        last = np.r_[held, np.full(seq_len - len(held), coder.end, coder.dtype)]
        yield last.reshape(1, -1), len(held), rows(last, docs, at)


def materialise(docs: DataFrame, out_dir: str, key: int = 2024, seq_len: int = SEQ_LEN, per_shard: int = PER_SHARD, ranks: str = RANKS) -> DataFrame:
    """Write the shards under `out_dir` (a URI that all executors reach) and return the manifest.

    A row per sequence: seq, slot, shard, record, n_tokens, doc_ids (those that start in it) and sha256 of the record.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    rows = docs.select("doc_id", "text")
    # Executors need not have the file: the vocabulary, some megabytes of fixed size, is sent to them.
    where, root = fs.FileSystem.from_uri(ranks if "://" in ranks else f"file://{ranks}")
    with where.open_input_stream(root) as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    coder = Tokenizer(vocabulary.value)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        mine = _tokenizer(vocabulary.value)
        total = sum(mine.counted(data, ends) for _, data, ends in sliced(batches, SLICE_BYTES, 1 << 20))
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "n": pa.array([-(-total // seq_len)], pa.int64())})

    with batches_of(docs.sparkSession, BATCH_BYTES):
        counts = dict(map(tuple, rows.mapInArrow(count, "part bigint, n bigint").collect()))
    first, n = {}, 0
    for part in sorted(counts):
        first[part] = n
        n += counts[part]
    order = Permutation(max(1, n), key)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), 0
        for ids, real, mine in _sequences(batches, _tokenizer(vocabulary.value), seq_len):
            seq = np.arange(len(ids)) + first.get(part, 0) + done
            done += len(ids)
            if done > counts.get(part, 0):
                raise RuntimeError(f"partition {part} changed between two reads")
            width = ids.itemsize * seq_len
            data = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.arange(0, width * len(ids) + 1, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])
            yield pa.RecordBatch.from_arrays([pa.array(seq), pa.array(order.slots(seq)), pa.array(np.full(len(ids), real, np.int32)), mine.cast(pa.list_(id_type)), data], names=["seq", "slot", "n_tokens", "doc_ids", "ids"])
        if done != counts.get(part, 0):
            raise RuntimeError(f"partition {part} changed between two reads")

    shards = max(1, -(-n // per_shard))
    placed = rows.mapInArrow(place, f"seq bigint, slot bigint, n_tokens int, doc_ids array<{kind}>, ids binary")
    dealt = placed.withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int"))
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        _release()
        where, root = fs.FileSystem.from_uri(out_dir)
        where.create_dir(root, recursive=True)
        shard, stream, name = None, None, ""

        def close() -> None:
            if stream is not None:
                stream.close()
                where.move(name, f"{root}/shard-{shard:06d}.bin")

        for batch in batches:
            slots, shas = batch.column("slot").to_numpy(), []
            for k, ids in enumerate(batch.column("ids")):
                if slots[k] // per_shard != shard:
                    close()
                    shard = int(slots[k] // per_shard)
                    name = f"{root}/.shard-{shard:06d}.{uuid.uuid4().hex}"
                    stream = where.open_output_stream(name)
                data = ids.as_buffer()
                stream.write(data)
                shas.append(hashlib.sha256(data).hexdigest())
            columns = {c: batch.column(c) for c in ("seq", "slot", "shard", "n_tokens", "doc_ids")}
            yield pa.RecordBatch.from_pydict(columns | {"record": pa.array(slots % per_shard), "sha256": pa.array(shas)})
        close()

    where, root = fs.FileSystem.from_uri(out_dir)
    where.create_dir(root, recursive=True)
    with where.open_output_stream(f"{root}/order.json") as f:
        f.write(json.dumps({"sequences": n, "seq_len": seq_len, "dtype": np.dtype(coder.dtype).name, "per_shard": per_shard, "key": key, "end": coder.end}).encode())
    schema = f"seq bigint, slot bigint, shard int, n_tokens int, doc_ids array<{kind}>, record bigint, sha256 string"
    with batches_of(docs.sparkSession, BATCH_BYTES):
        return durable(dealt.mapInArrow(write, schema), "training-order")


def read_slots(out_dir: str, start: int, count: int) -> np.ndarray:
    """The ids of `count` sequences from slot `start`, by seeks into the shards."""
    where, root = fs.FileSystem.from_uri(out_dir)
    with where.open_input_stream(f"{root}/order.json") as f:
        meta = json.loads(f.read())
    stride, out = meta["seq_len"] * np.dtype(meta["dtype"]).itemsize, []
    at, stop = start, min(start + count, meta["sequences"])
    while at < stop:
        shard, record = divmod(at, meta["per_shard"])
        upto = min(stop, (shard + 1) * meta["per_shard"])
        with where.open_input_file(f"{root}/shard-{shard:06d}.bin") as f:
            f.seek(record * stride)
            out.append(f.read((upto - at) * stride))
        at = upto
    return np.frombuffer(b"".join(out), meta["dtype"]).reshape(-1, meta["seq_len"])


def default_dir(spark) -> str:
    return new_path(spark, "training-shards")
