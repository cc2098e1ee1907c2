"""Word shingles as 64-bit hashes, and the connected components of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

_K1, _K2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_XX = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]  # the constants of XXH64


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _K1
    x = (x ^ (x >> np.uint64(27))) * _K2
    return x ^ (x >> np.uint64(31))


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(words of each text, all words in order): lower-cased runs without white space. A null text has none."""
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(texts, ""))))
    n, flat = np.diff(np.asarray(lists.offsets)).astype(np.int64), lists.flatten()
    empty = np.asarray(pc.equal(flat, ""))  # an empty text gives one
    if empty.any():
        n -= np.bincount(np.repeat(np.arange(len(n)), n)[empty], minlength=len(n))
        flat = flat.filter(pa.array(~empty))
    return n, flat


def _turned(x: np.ndarray, k: int) -> np.ndarray:
    return x << np.uint64(k) | x >> np.uint64(64 - k)


def _short_hashes(data: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """XXH64 of the n < 32 bytes from each start, all at once; data has eight bytes more behind the last of them."""
    p1, p2, p3, p4, p5 = _XX
    at, out = start.copy(), p5 + n.astype(np.uint64)
    load = lambda own, kind: np.ndarray(len(data) - 7, kind, data, strides=(1,))[at[own]].astype(np.uint64)
    for k in range(8, 32, 8):
        own = np.flatnonzero(n >= k)
        out[own] = _turned(out[own] ^ _turned(load(own, "<u8") * p2, 31) * p1, 27) * p1 + p4
        at[own] += 8
    own = np.flatnonzero(n & 4)
    out[own] = _turned(out[own] ^ load(own, "<u4") * p1, 23) * p2 + p3
    at[own] += 4
    for k in range(3):
        own = np.flatnonzero(n & 3 > k)
        out[own] = _turned(out[own] ^ load(own, "<u1") * p5, 11) * p1
        at[own] += 1
    out = (out ^ out >> np.uint64(33)) * p2
    out = (out ^ out >> np.uint64(29)) * p3
    return out ^ out >> np.uint64(32)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash (XXH64) of each word; each distinct word is hashed once, long ones by the library and the others together."""
    import xxhash

    coded = words.dictionary_encode()
    own = coded.dictionary.cast(pa.large_binary())
    bounds = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
    start, n = bounds[:-1], np.diff(bounds)
    data = np.concatenate([np.frombuffer(own.buffers()[2] or b"", np.uint8), np.zeros(8, np.uint8)])
    out = np.empty(len(own), np.uint64)
    short = n < 32
    out[short] = _short_hashes(data, start[short], n[short])
    for k in np.flatnonzero(~short).tolist():
        out[k] = xxhash.xxh64_intdigest(data[start[k] : start[k] + n[k]])
    return out[np.asarray(coded.indices)]


def shingles_of(n: np.ndarray, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of each text, all shingle hashes in order) from the words of each text and the words' hashes.

    A shingle is a run of `size` words; a shorter text that has words is one shingle."""
    ends = np.cumsum(n)
    m = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    first = np.repeat(ends - n - (np.cumsum(m) - m), m) + np.arange(m.sum())
    length = np.repeat(np.minimum(n, size), m)
    out = length.astype(np.uint64)
    short = length < size
    for k in range(size):  # a polynomial in the words' hashes, spread once
        step = out * _STEP + h[np.minimum(first + k, len(h) - 1)] if len(h) else out
        out = np.where(short & (k >= length), out, step) if short.any() else step
    return m, mixed(out)


def shingle_hashes(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of each text, all shingle hashes in order) of the texts."""
    n, words = split_words(texts)
    return shingles_of(n, word_hashes(words), size)


def slices(n: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
    """The values of each text."""
    return np.split(values, np.cumsum(n)[:-1]) if len(n) else []


def connected_components(links: DataFrame) -> DataFrame:
    """(id, class_id) for every id in links (a, b): class_id is the smallest id that it is connected with.

    Labels fall to the smallest of a row's neighbours and then to that label's own label, so a chain of n needs about
    log n rounds. Each round's tables are written, which lets AQE split the links of a hub; the driver gets a count."""
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("class_id")), "labels")
    while True:
        told = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("class_id").alias("near"))
        fallen = labels.join(told, labels.id == told.a).select("id", F.least("class_id", "near").alias("class_id"), F.col("class_id").alias("was"))
        own = fallen.select(F.col("id").alias("of"), F.col("class_id").alias("its"))
        labels = materialize(fallen.join(own, fallen.class_id == own.of).select("id", F.col("its").alias("class_id"), "was"), "labels")
        if labels.where("class_id <> was").isEmpty():
            return labels.select("id", "class_id")
        labels = labels.drop("was")
