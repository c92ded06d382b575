"""Sets of hashed word shingles from the bytes of many texts at once, in whole NumPy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes that are hashed at a time; the numbers of a byte take some 80 bytes.
STRETCH = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _factors(place: np.ndarray) -> np.ndarray:
    return mix((place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


#: A random number for each of the first places in a word.
_FACTORS = _factors(np.arange(1 << 16))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A random number for each byte, the same for A-Z and a-z.
_BYTES = np.random.default_rng(20240229).integers(1, 2**64, 256, np.uint64)
_BYTES[65:91] = _BYTES[97:123]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n + 1 offsets; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliced(batches: Iterator[pa.RecordBatch], most_bytes: int, most_rows: int, key: str = "doc_id") -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(keys, bytes, offsets) of runs of rows with about `most_bytes` of text, so that memory follows neither batches nor rows."""
    for batch in batches:
        data, ends = buffers(batch.column("text"))
        at = 0
        while at < len(batch):
            stop = min(max(at + 1, int(np.searchsorted(ends, ends[at] + most_bytes, "right")) - 1), at + most_rows, len(batch))
            yield batch.column(key).slice(at, stop - at), data[ends[at] : ends[stop]], ends[at : stop + 1] - ends[at]
            at = stop


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word; words are runs of bytes other than ASCII white space, A-Z lower-cased."""
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    before, begun, hashes, starts = np.uint64(0), 0, [], []
    for at in range(0, len(data), STRETCH):
        part = data[at : at + STRETCH]
        n, blank = len(part), _SPACE[part]
        ahead = _SPACE[data[at + n]] if at + n < len(data) else True
        behind = _SPACE[data[at - 1]] if at else True
        start = np.flatnonzero(~blank & (np.r_[behind, blank[:-1]] | edge[at : at + n]))
        stop = np.flatnonzero(~blank & (np.r_[blank[1:], ahead] | edge[at + 1 : at + n + 1]))
        # Sums of the bytes' numbers times those of their places in the word: powers of one number, modulo 2^64, would
        # give words of two letters that are each other's opposite (Thue-Morse) the same sum.
        begin = np.full(n, begun)
        begin[start] = start + at
        np.maximum.accumulate(begin, out=begin)
        begun = int(begin[-1])
        place = np.arange(at, at + n) - begin
        factor = _FACTORS[place] if int(place.max()) < len(_FACTORS) else _factors(place)
        total = np.cumsum(_BYTES[part] * factor, dtype=np.uint64) + before
        hashes.append((np.where(start > 0, total[start - 1], before), total[stop]))
        starts.append(start + at)
        before = total[-1]
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    # A word's start and end may lie in different stretches.
    first, last = (np.concatenate([x[k] for x in hashes]) for k in range(2))
    del hashes
    of = [(np.searchsorted(ends, x, "right") - 1).astype(np.int32) for x in starts]
    return mix(last - first), np.concatenate(of)


def token_sets(data: np.ndarray, ends: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(tokens, text numbers, set sizes, 16 bytes a set that name it); tokens in order, each once a text.

    Arrays of all words are let go as soon as they have served: tasks run side by side in an executor's memory.
    """
    n = len(ends) - 1
    hashes, of = words_of(data, ends)
    count = np.bincount(of, minlength=n)
    step = lambda x, w, k: mix(x + w * np.uint64(2 * k + 3))
    tokens, texts = [], []
    if len(hashes) >= words:
        whole = hashes[: len(hashes) - words + 1]
        for k in range(1, words):
            whole = step(whole, hashes[k : len(hashes) - words + 1 + k], k)
        inside = of[: len(whole)] == of[words - 1 :]
        tokens.append(whole[inside])
        texts.append(of[: len(whole)][inside])
        del whole, inside
    first = np.r_[0, np.cumsum(count)[:-1]]
    for short in range(1, words):
        at = np.flatnonzero(count == short)
        x = hashes[first[at]]
        for k in range(1, short):
            x = step(x, hashes[first[at] + k], k)
        tokens.append(mix(x ^ np.uint64(short)))
        texts.append(at)
    del hashes, of
    token, text = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((tokens, np.uint64), (texts, np.int32)))
    text = text.astype(np.int32)
    del tokens, texts
    if (count[count > 0] < words).any():
        by_text = np.argsort(text, kind="stable")
        token, text = token[by_text], text[by_text]
        del by_text
    order = np.argsort(token, kind="stable")
    token, text = token[order], text[order]
    del order
    if len(token):
        once = np.r_[True, (token[1:] != token[:-1]) | (text[1:] != text[:-1])]
        token, text = token[once], text[once]
        del once
    sizes = np.bincount(text, minlength=n)
    full = np.flatnonzero(sizes)
    names = np.zeros((n, 2), np.uint64)
    if len(full):
        own = token[np.argsort(text.astype(np.uint16) if n < 1 << 16 else text, kind="stable")]
        begins = np.r_[0, np.cumsum(sizes[full])[:-1]]
        for k in (0, 1):
            names[full, k] = mix(np.add.reduceat(mix(own ^ np.uint64(0xA5A5A5A5 * (k + 1))), begins) + sizes[full].astype(np.uint64))
    return token, text, sizes, names.tobytes()
