"""Substring dedup by compact windows.

For each of several hash functions a text's shingles get min-hash values. A compact window (l, c, r) stands for all
subsequences within [l, r] that contain c: the shingle at c is the least in each. These windows are the nodes of the Cartesian tree
over the values; those at least as wide as a passage are its top, O(n / width) of them. Two texts with a window of equal least
value share candidate passages; where the intervals of enough hash functions meet on one alignment, the texts are compared.

Windows of a value link to leaders, not to each other. So that no passage is lost by that, windows
carry a digest of all that a passage around the least shingle can hold. Windows with an equal digest are copies. Where a value has several
digests, documents meet by the least shingles of two hash functions on one run, whoever leads, and all that are near by samples are linked. Of the first hash function's windows every run of a passage's length in these windows is a row, and the documents of a run link to its first one. For near
passages a window also gives rows of the ends of stretches somewhat shorter than a passage, whatever lies between the ends. Rows carry
samples of what lies between and beside them, so those that are not like the first are linked to others that they are like.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, only, table, text_hash
from .segments import text_batches
from .shingles import _STEP, mixed, shingle_hashes

_LOW = np.uint64((1 << 20) - 1)
CONTEXT = 22  # the longer side of a window's least shingle has at least so many of a passage of 46


def _bounds(deep: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node of [begin, end): the last one before it that is no greater, or begin - 1, and the first one behind it that is less, or end.

    What lies between a node and its present guess is too great, so a guess that is itself too great gives way to its own guess."""
    out = []
    for step, too_great in ((-1, np.greater), (1, np.greater_equal)):
        guess = np.arange(len(deep)) + step
        todo = np.arange(len(deep))
        while len(todo):
            at = guess[todo]
            inside = (at >= begin[todo]) & (at < end[todo])
            todo, at = todo[inside], at[inside]
            wrong = too_great(deep[at], deep[todo])
            todo = todo[wrong]
            guess[todo] = guess[at[wrong]]
        out.append(guess)
    return out[0], out[1]


def compact_windows(shingles: np.ndarray, ends: np.ndarray, seed: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(value, l, c, r) of all compact windows of at least `width` shingles, l and r inclusive, over texts that end at `ends`.

    Ties go to the earlier shingle: the position is the value's low bits. A window is that wide exactly if its c is the
    least of some run of `width` shingles, so sliding minima give the tree's upper nodes, and the nearest lesser ones among these alone give
    their bounds: what bounds a node lies above it in the tree, so it is as wide."""
    n = len(shingles)
    none = np.empty(0, np.int64)
    if n < width:
        return none.astype(np.uint64), none, none, none
    value = mixed(shingles + np.uint64((seed + 1) * int(_STEP) & 2**64 - 1)) & ~_LOW
    packed = value | (np.arange(n, dtype=np.uint64) & _LOW)
    least, span = packed, 1
    while 2 * span <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: n - width + 1], least[width - span : width - span + n - width + 1])
    size = np.diff(ends, prepend=0)
    close = np.repeat(ends, size)[: n - width + 1]
    first = np.flatnonzero(np.arange(width, n + 1) <= close)
    least, close = least[first], close[first]
    at = first + ((least & _LOW).astype(np.int64) - first) % (1 << 20)
    new = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.empty(0, bool)
    # a center can leave a run's lead and return to it: the order of centers is that of positions
    c, once = np.unique(at[new], return_index=True)
    close = close[new][once]
    text = np.searchsorted(ends, close)  # the first of those that end there: the others are empty
    own = np.concatenate([[True], close[1:] != close[:-1]]) if len(c) else np.empty(0, bool)
    edges = np.append(np.flatnonzero(own), len(c))
    nodes = np.diff(edges)
    begin, end = np.repeat(edges[:-1], nodes), np.repeat(edges[1:], nodes)
    before, behind = _bounds(value[c], begin, end)
    left = np.where(before >= begin, c[before] + 1, close - size[text])
    right = np.where(behind < end, c[np.minimum(behind, len(c) - 1)], close) - 1
    return value[c], left, c, right


_WINDOW = np.dtype([("value", "<u8"), ("doc", "<i8"), ("l", "<u4"), ("c", "<u4"), ("r", "<u4"), ("around", "<u4"), ("before", "<u2"), ("after", "<u2"), ("k", "u1")])
_PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("k", "<i4"), ("start", "<i4"), ("stop", "<i4"), ("offset", "<i4")])
_EXACT, _CONTESTED = -1, -2  # k of pairs that share a run or its ends, and of rows (document, c, first, last start of a run, hash function) to be compared
_DIGESTED = 2  # so many hash functions' windows link to the first copy by their digest and give ends; the first gives runs
_END, _STEP_OF_ENDS = 3, 8  # shingles of an end, and how far apart a window's stretches begin
_SIDE = _STEP_OF_ENDS - 1  # so many shingles a stretch lacks for a passage
_SMALL = 64  # groups of at most so many stretches are compared many groups at once
_SAMPLES = 5  # shingles from either end, four apart, that tell one stretch from another
_APART, _OUTER, _INNER = 5, 8, 5  # samples beside and between two least shingles: how far apart, how many beside each, and from each inwards
_NEAR = 41  # shingles about two least ones that samples tell to agree, but for one change: at least so many in a passage of 46
_RUN = np.dtype([("run", "<u8"), ("key", "<i8"), ("at", "<i4")])
_STRETCH = np.dtype([*_RUN.descr, ("inner", "u1", (2 * _SAMPLES,)), ("sides", "u1", (2 * _SIDE,))])
_COMMON = np.dtype([*_RUN.descr, ("outer", "u1", (4 * _OUTER,)), ("between", "u1", (16,))])  # the last byte of `between` is how far apart
_LEADING = np.array([next((i for i in range(8) if not x >> (7 - i) & 1), 8) for x in range(256)], np.int8)  # of eight samples how many agree before the first that does not
# by those that agree behind a change and the number that agree before it: how many agree with one sample left out
_BEHIND = np.array([[next((i for i in range(8) if i > n and not x >> (7 - i) & 1), 8) if n < 8 and (x >> (7 - n) & 1 or n < 7 and x >> (6 - n) & 1) else n for n in range(9)] for x in range(256)], np.int8).ravel()
_PACKED = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("windows", T.BinaryType()), T.StructField("pairs", T.BinaryType())])
_RUNS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("runs", T.BinaryType()), T.StructField("ends", T.BinaryType()), T.StructField("commons", T.BinaryType())])
_MET = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("offset", T.IntegerType())])
_PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("offset", T.IntegerType())])
_PASSAGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("a_id", T.LongType()), T.StructField("b_id", T.LongType())] + [T.StructField(n, T.IntegerType()) for n in ("a_start", "a_end", "b_start", "b_end")] + [T.StructField("similarity", T.DoubleType())])


def _planes(w: np.ndarray) -> bytes:
    """The records byte by byte, so that mostly empty high bytes compress to nothing."""
    return np.ascontiguousarray(w.view(np.uint8).reshape(-1, _WINDOW.itemsize).T).tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(_WINDOW.itemsize, -1).T).view(_WINDOW)[:, 0]


def _runs(values: np.ndarray, length: int) -> np.ndarray:
    """A 16-bit hash of the run of `length` values that starts at each position; of a shorter one at the end."""
    power, out = np.uint64(1), np.zeros(len(values), np.uint64)
    for k in range(length):
        if k >= len(values):
            break
        out[: len(values) - k] += values[k:] * power
        power = np.uint64(int(power) * int(_STEP) & 2**64 - 1)
    return (mixed(out) >> np.uint64(48)).astype(np.uint16)


def _prefix(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of value * step**position before each position, step**-position), with which any range has a hash in one step."""
    n, inverse = len(values), pow(int(_STEP), -1, 2**64)
    power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _STEP, np.uint64)]))
    back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, inverse, np.uint64)]))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[:n], dtype=np.uint64)]), back


def _range_hashes(prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    sums, back = prefix
    return mixed((sums[stop] - sums[start]) * back[start] + (stop - start).astype(np.uint64))


def _windows_of(keys: np.ndarray, texts: pa.Array, hashes: int, width: int, size: int) -> np.ndarray:
    n, shingles = shingle_hashes(texts, size)
    prefix = _prefix(shingles)
    ends = np.cumsum(n)
    after, before = _runs(shingles, CONTEXT), _runs(shingles[::-1], CONTEXT)[::-1]
    out = []
    for k in range(hashes):
        _, left, c, right = compact_windows(shingles, ends, k, width)
        value = mixed(shingles[c] + np.uint64((k + 1) * int(_STEP) & 2**64 - 1))  # small ones, as they are least: spread once more
        w = np.zeros(len(c), _WINDOW)
        text = np.searchsorted(ends, c, "right")
        base = (ends - n)[text]
        w["value"], w["doc"], w["k"] = mixed(value + np.uint64(k)), keys[text], k
        w["l"], w["c"], w["r"] = left - base, c - base, right - base
        w["before"], w["after"] = before[c], after[c]
        start, stop = np.maximum(left, c - width + 1), np.minimum(right, c + width - 1) + 1
        w["around"] = mixed(_range_hashes(prefix, start, stop) + (c - start).astype(np.uint64)) >> np.uint64(32)
        out.append(w)
    return np.concatenate(out)


def _leaders(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(windows that share their value with another, those that lead a group, each window's leaders), as positions.

    Windows group by value, and within one by the shingles before and behind the centre and, last, by all around it. The leader has
    the least key. Every kind of window, by what is around it, so has one that leads it."""
    order = np.argsort(w["value"])
    v = w["value"][order]
    again = np.concatenate([[False], v[1:] == v[:-1]]) if len(w) else np.empty(0, bool)
    many = again | np.concatenate([again[1:], [False]]) if len(w) else again
    alone, s = order[~many], order[many]
    group = np.cumsum(~again[many]).astype(np.uint64)
    at = np.lexsort((w["c"][s], w["doc"][s], group))
    s, leads = s[at], []
    for side in (None, "before", "after", "around"):
        key = group << np.uint64(32) | (w[side][s].astype(np.uint64) if side else np.uint64(0))
        at = np.argsort(key, kind="stable") if side else np.arange(len(s))
        new = np.ones(len(s), bool)
        new[1:] = key[at[1:]] != key[at[:-1]]
        lead = np.empty(len(s), np.int64)
        lead[at] = s[at[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]] if len(s) else lead
        leads.append(lead)
    first = np.zeros(len(w), bool)
    first[alone] = True
    for lead in leads:
        first[lead] = True
    return s, np.flatnonzero(first), leads


def _linked(w: np.ndarray, s: np.ndarray, leads: list[np.ndarray], width: int) -> np.ndarray:
    """Pairs of windows with an equal value and different documents: each of s with its leaders. At most four a window,
    however large the group. Copies link by the first hash functions alone; the kinds of a value meet in met_in_runs."""
    leads = [*leads[:-1], np.where(w["k"][s] < _DIGESTED, leads[-1], leads[0])]
    a, b = np.tile(s, len(leads)), np.concatenate(leads)
    once = np.ones(len(a), bool)
    for j in range(1, len(leads)):  # often a window's leaders are one
        for i in range(j):
            once[j * len(s) : (j + 1) * len(s)] &= leads[j] != leads[i]
    doc = w["doc"]
    keep = once & (doc[a] != doc[b])
    a, b = a[keep], b[keep]
    swap = doc[a] < doc[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    offset = w["c"][a].astype(np.int64) - w["c"][b]
    start = np.maximum(w["l"][a].astype(np.int64), w["l"][b] + offset)
    stop = np.minimum(w["r"][a].astype(np.int64), w["r"][b] + offset) + 1
    wide = stop - start >= width
    a, b = a[wide], b[wide]
    out = np.zeros(len(a), _PAIR)
    exact = (w["k"][a] < _DIGESTED) & (w["around"][a] == w["around"][b])
    for name, x in (("a", doc[a]), ("b", doc[b]), ("k", np.where(exact, _EXACT, w["k"][a].astype(np.int32))), ("start", start[wide]), ("stop", stop[wide]), ("offset", offset[wide])):
        out[name] = x
    return out


def _contested(w: np.ndarray, s: np.ndarray, leads: list[np.ndarray], width: int) -> np.ndarray:
    """Of each value whose windows are not all copies of one: a window for each kind, with the range of the starts of its runs that
    hold the least shingle."""
    x = np.unique(leads[-1])
    _, of, kinds = np.unique(w["value"][x], return_inverse=True, return_counts=True)
    x = x[kinds[of] > 1] if len(x) else x
    out = np.zeros(len(x), _PAIR)
    c = w["c"][x].astype(np.int64)
    out["a"], out["b"], out["k"], out["offset"] = w["doc"][x], c, _CONTESTED, w["k"][x]
    out["start"], out["stop"] = np.maximum(w["l"][x], c - width + 1), np.minimum(c, w["r"][x].astype(np.int64) - width + 1)
    return out


def _rows(pairs: np.ndarray) -> dict:
    return {n: pa.array(np.ascontiguousarray(pairs[n])) for n in _PAIRS.names}


def packed_windows(docs: DataFrame, buckets: int, *, hashes: int, width: int, size: int, block_chars: int) -> DataFrame:
    """(bucket, windows, pairs): windows of (key, text) by hash bucket, a row a block of documents, and the pairs found within a block.

    Equal values within a block are linked there, and only the leaders of each group go on."""
    from pyspark.sql.pandas.types import to_arrow_schema

    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, size_held = to_arrow_schema(_PACKED), [], 0

        def flush() -> pa.RecordBatch:
            block = pa.Table.from_batches(held).combine_chunks()
            w = _windows_of(np.asarray(block.column("key")), block.column("text").combine_chunks(), hashes, width, size)
            s, first, leads = _leaders(w)
            pairs, w = _linked(w, s, leads, width), w[first]
            w = w[np.argsort(w["value"])]
            at = np.concatenate([[0], np.searchsorted(w["value"], edges), [len(w)]])
            share = np.linspace(0, len(pairs), buckets + 1).astype(int)
            rows = [{"bucket": k, "windows": _planes(w[at[k] : at[k + 1]]), "pairs": pairs[share[k] : share[k + 1]].tobytes()} for k in range(buckets)]
            return pa.RecordBatch.from_pylist([x for x in rows if x["windows"] or x["pairs"]], schema=schema)

        for batch in batches:
            for a, b in text_batches(batch.column(1), block_chars):
                held.append(batch.slice(a, b - a))
                size_held += held[-1].column(1).nbytes
                if size_held >= block_chars:
                    yield flush()
                    held, size_held = [], 0
        if held:
            yield flush()

    return docs.select("key", "text").mapInArrow(local, _PACKED)


def candidate_pairs(blocks: DataFrame, buckets: int, width: int) -> DataFrame:
    """(a, b, k, start, stop, offset): aligned shingle ranges of documents a > b that hash function k proposes, and the contested windows.

    There are thrice as many partitions as buckets, so that few tasks get more than one or two."""

    def across(batch: pa.Table) -> pa.Table:
        found = [np.frombuffer(x.as_py(), _PAIR) for x in batch.column("pairs")]
        w = np.concatenate([_unplaned(x.as_py()) for x in batch.column("windows")])
        s, _, leads = _leaders(w)
        return pa.table(_rows(np.concatenate([*found, _linked(w, s, leads, width), _contested(w, s, leads, width)])))

    return blocks.repartition(3 * buckets, "bucket").groupBy("bucket").applyInArrow(across, _PAIRS)


def _ends_of(prefix: tuple[np.ndarray, np.ndarray], base: np.ndarray, n: np.ndarray, c: np.ndarray, k: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(window, hash, start, length) of stretches about the least shingles c of texts of n shingles at `base`: hashes of their first and last shingles.

    A stretch is as much shorter than a passage as stretches lie apart, so a passage holds one; those longer by one meet
    stretches with a word more or less inside."""
    span = width - _STEP_OF_ENDS + 1
    out = []
    for i in range(0, span, _STEP_OF_ENDS):
        for length in (span, span + 1):
            start = c - i
            own = np.flatnonzero((start >= 0) & (start + length <= n))
            at = base[own] + start[own]
            head, tail = _range_hashes(prefix, at, at + _END), _range_hashes(prefix, at + length - _END, at + length)
            out.append((own, mixed(head * _STEP + tail + (k[own] * 64 + i + 1).astype(np.uint64)), start[own], np.full(len(own), length)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _buckets_of(rows: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """The rows of each bucket of run hashes."""
    rows = rows[np.argsort(rows["run"])]
    at = np.concatenate([[0], np.searchsorted(rows["run"], edges), [len(rows)]])
    return [rows[x:y].tobytes() for x, y in zip(at[:-1], at[1:])]


def _sides(shingles: np.ndarray, base: np.ndarray, n: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A byte for each of the shingles nearest before and behind [start, stop) of texts of n shingles at `base`, those next to it
    first; 0 beyond the text."""
    step = np.arange(_SIDE)
    place = np.concatenate([start[:, None] - 1 - step, stop[:, None] + step], axis=1)
    inside = (place >= 0) & (place < n[:, None])
    byte = mixed(shingles[np.where(inside, base[:, None] + place, 0)]) >> np.uint64(56)
    return np.where(inside, np.maximum(byte, np.uint64(1)), np.uint64(0)).astype(np.uint8)


def _firsts(rows: np.ndarray, *fields: str) -> np.ndarray:
    """For rows in the order of the fields: where the first row with the same values is."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for f in fields:
        differs = rows[f][1:] != rows[f][:-1]
        new[1:] |= differs.any(axis=1) if differs.ndim > 1 else differs
    return np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))


def _alike(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of the stretches can be one passage with this one: at most two samples between the ends differ, which is what a word does,
    and enough shingles beside the ends agree."""
    same = ((others["sides"] == one["sides"]) & (others["sides"] > 0)).T
    reach = np.zeros(same.shape[1], np.uint8)
    for side in (same[:_SIDE], same[_SIDE:]):
        on = side[0]
        reach += on
        for further in side[1:]:
            on = on & further
            reach += on
    return (reach >= _SIDE) & ((others["inner"] != one["inner"]).sum(axis=1) <= 2)


def _commons_of(text: np.ndarray, start: np.ndarray, stop: np.ndarray, c: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, window of a later hash function): those of one text that have a run in common, whose least shingles by both they hold.

    A run has one window of a hash function, so those of one function lie apart and in order."""
    found = []
    first, last = (text << 32) + start, (text << 32) + stop
    of = [x[np.argsort(first[x])] for x in (np.flatnonzero(k == f) for f in np.unique(k))]
    for i, x in enumerate(of):
        for y in of[i + 1 :]:
            own, at = _expand(np.searchsorted(last[y], first[x]), np.searchsorted(first[y], last[x], "right"))
            found.append((x[own], y[at]))
    return (np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def _commons(shingles: np.ndarray, base: np.ndarray, n: np.ndarray, x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """A row for each two (least shingle, hash function) of a run, in texts of n shingles at `base`: it meets those of other documents with the
    same two. Samples tell what lies beside and between them: a byte each, 0 beyond the text or behind the other one. Beside them
    each sample comes with the next further one, for texts with a word more or less."""
    rows = np.zeros(len(keys), _COMMON)
    low, high = np.minimum(x[0], y[0]), np.maximum(x[0], y[0])
    by = lambda c, k: mixed(shingles[base + c] + (k + 1).astype(np.uint64) * _STEP)
    rows["run"], rows["key"], rows["at"] = mixed(by(*x) * _STEP + by(*y) + (x[0] > y[0]).astype(np.uint64)), keys, low
    step = _APART * (1 + np.arange(_OUTER))
    outer = [*(low[:, None] - step - more for more in (0, 1)), *(high[:, None] + step + more for more in (0, 1))]
    place = np.concatenate([*outer, low[:, None] + step[:_INNER], high[:, None] - step[:_INNER]], axis=1)
    inside = (place >= 0) & (place < n[:, None])
    inside[:, 4 * _OUTER :] &= (place[:, 4 * _OUTER :] > low[:, None]) & (place[:, 4 * _OUTER :] < high[:, None])
    byte = np.where(inside, np.maximum(mixed(shingles[np.where(inside, base[:, None] + place, 0)]) >> np.uint64(56), np.uint64(1)), np.uint64(0)).astype(np.uint8)
    rows["outer"], rows["between"][:, :_INNER], rows["between"][:, 8 : 8 + _INNER] = np.split(byte, [4 * _OUTER, 4 * _OUTER + _INNER], axis=1)
    rows["between"][:, 15] = high - low
    return rows


def _near(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of the others can have one passage with this one about their two least shingles: at least _NEAR shingles agree but for one
    change, between the two or on one side. There one sample can differ, and behind it the texts can be a word apart."""
    x, y = np.atleast_2d(one["outer"]), others["outer"]
    turned = y.reshape(-1, 2, 2, _OUTER)[:, :, ::-1].reshape(-1, 4 * _OUTER)  # of each sample the next further one, and the other way
    same, shifted = (np.packbits((x == v) & (v > 0), axis=1) for v in (y, turned))
    reach = []
    for side in (0, 2):
        exact = _LEADING[same[:, side]]
        behind = [_BEHIND[bits.astype(np.int64) * 9 + exact] for bits in (same[:, side], shifted[:, side], shifted[:, side + 1])]
        reach.append((exact, np.maximum(np.maximum(behind[0], behind[1]), behind[2])))
    (left, left_once), (right, right_once) = reach
    within = others["between"]
    inner = _LEADING[np.packbits((within == np.atleast_2d(one["between"])) & (within > 0), axis=1)]
    apart, its = within[:, 15].astype(np.int16), one["between"][..., 15].astype(np.int16)
    least, more = np.minimum(apart, its), np.abs(apart - its)
    gap = np.maximum(least - _APART * (np.minimum(inner, _INNER).sum(axis=1, dtype=np.int16) + 2), 0)
    sides = np.where((gap > 0) | (more > 0), left + right, np.maximum(left_once + right, left + right_once))
    # what is more in one text is in neither's common part, nor are the shingles across its ends
    few = (4 * (more + 8) <= least + _APART * (sides + 2)) | (left == _OUTER) | (right == _OUTER)
    return few & (more <= 2 * _APART) & (gap <= 2 * _APART) & (least + _APART * (sides + 1) >= _NEAR)


def _groups(rows: np.ndarray, odd: np.ndarray, starts: np.ndarray, stops: np.ndarray, like: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int, Callable[[int, np.ndarray], np.ndarray]]]:
    """(start, stop, alike) of the groups [start, stop) of rows; alike tells which others of the group are like one, by positions in it.

    Small groups are compared many at once, large ones a row at a time when asked. Those small ones where no odd row is like another have no links and are left out."""
    small = stops - starts <= _SMALL
    lots = np.cumsum(np.where(small, (stops - starts) ** 2, 0)) // 250_000
    for lot in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(lots)) + 1):
        mine = lot[small[lot]]
        group, one = _expand(starts[mine], stops[mine])
        pair, other = _expand(starts[mine][group], stops[mine][group])
        told = like(rows[one[pair]], rows[other])
        linked = np.bincount(group[pair][told & odd[one[pair]] & (one[pair] != other)], minlength=len(mine)) > 0
        some = set(starts[mine[linked]].tolist())
        done = 0
        for k in lot.tolist():
            a, b = int(starts[k]), int(stops[k])
            if small[k]:
                square = told[done : done + (b - a) ** 2].reshape(b - a, b - a)
                done += (b - a) ** 2
                if a in some:
                    yield a, b, lambda i, js, square=square: square[i, js]
            else:
                yield a, b, lambda i, js, own=rows[a:b]: like(own[i], own[js])


def _met(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, row of a smaller key) of rows with an equal run, in order of run and key: each with the first. Rows of ends that are not alike with the first also meet:
    each is linked to a row that it is alike with, so that those which can be reached from each other are, by one link less than they are.

    Of equal stretches with equal sides one stands for all: they are copies, which their runs link. Rows of two least shingles meet the
    first only where they are near, and others with equal samples the one that stands for them."""
    first = _firsts(rows, "run")
    fields = rows.dtype.names[3:]
    like = _near if "outer" in fields else _alike
    if "outer" in fields and len(rows):
        with_first = np.ones(len(rows), bool)
        others = np.flatnonzero(first < np.arange(len(rows)))
        with_first[others] = like(rows[first[others]], rows[others])
    else:
        with_first = np.ones(len(rows), bool)
    own = np.flatnonzero(with_first & (rows["key"] > rows["key"][first]))
    yield own, first[own]
    if not fields or not len(rows):
        return
    if "outer" in fields:  # where all are near the first, there is nothing left to link
        some = np.zeros(len(rows), bool)
        some[first[~with_first]] = True
        kept = np.flatnonzero(some[first])
        for x, y in _met_beside(rows[kept], with_first[kept], like, fields):
            yield kept[x], kept[y]
    else:
        yield from _met_beside(rows, with_first, like, fields)


def _met_beside(rows: np.ndarray, with_first: np.ndarray, like: Callable[[np.ndarray, np.ndarray], np.ndarray], fields: tuple[str, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The links of _met beside those with the first."""
    if not len(rows):
        yield np.empty(0, np.int64), np.empty(0, np.int64)
        return
    samples = np.concatenate([rows[f] for f in fields], axis=1)
    samples = np.ascontiguousarray(samples).view(np.uint64)
    run = np.ascontiguousarray(rows["run"])
    order = np.lexsort((*samples.T, run))
    new = np.ones(len(rows), bool)
    new[1:] = (run[order][1:] != run[order][:-1]) | (samples[order][1:] != samples[order][:-1]).any(axis=1)
    kinds = np.sort(order[new])
    if "outer" in fields:
        stands = np.empty(len(rows), np.int64)
        stands[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        copy = np.flatnonzero(~with_first & (rows["key"] > rows["key"][stands]))
        yield copy, stands[copy]
    own = rows[kinds]
    head = _firsts(own, "run")
    odd = ~with_first[kinds] if "outer" in fields else ~like(own[head], own)
    odd[np.unique(head)] = False
    starts = np.unique(head[odd])
    stops = np.searchsorted(head, starts, "right")
    starts, stops = starts[stops - starts > 2], stops[stops - starts > 2]  # one beside the first has been compared with it
    links: list[tuple[int, int]] = []
    for start, stop, alike in _groups(own, odd, starts, stops, like):
        left = odd[start:stop]
        todo, rest = np.flatnonzero(~left), np.flatnonzero(left)
        while len(rest):
            if not len(todo):
                todo, rest = rest[:1], rest[1:]
            if len(rest) < len(todo):
                near = [alike(x, todo) for x in rest]
                met = np.array([n.any() for n in near], bool)
                links += [(start + int(todo[n.argmax()]), start + int(x)) for n, x in zip(near, rest) if n.any()]
                todo, rest = rest[met], rest[~met]
            else:
                met = alike(todo[-1], rest)
                links += [(start + int(todo[-1]), start + int(x)) for x in rest[met]]
                todo, rest = np.concatenate([todo[:-1], rest[met]]), rest[~met]
    x, y = kinds[np.array(links, np.int64).reshape(-1, 2).T]
    unlike = rows["key"][x] != rows["key"][y]
    x, y = x[unlike], y[unlike]
    later = rows["key"][x] > rows["key"][y]
    yield np.where(later, x, y), np.where(later, y, x)


def met_in_runs(texts: DataFrame, contested: DataFrame, buckets: int, width: int, size: int) -> DataFrame:
    """(a, b, k, start, stop, offset): documents that share, in contested windows, a run of `width` equal shingles or the ends of a
    stretch, each with the first that has it; of those that share ends, what is not alike with the first with others that it is alike with.
    Documents with a run whose least shingles by two hash functions are the same meet too: not the first alone, but all that are near each other.

    A run has one least shingle, so it lies in one window of a document. Rows go to buckets by their hash, a row of Spark's
    for a bucket and some hundred thousand of them, and meet there in order."""
    from pyspark.sql.pandas.types import to_arrow_schema

    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
    ranges = contested.groupBy(F.col("a").alias("key")).agg(F.collect_set(F.struct("start", "stop", F.col("b").alias("c"), F.col("offset").alias("k"))).alias("ranges"))
    given = texts.join(ranges, "key").select("key", "text", "ranges")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(_RUNS)
        held: tuple[list, ...] = ([], [], [])

        def flush() -> pa.RecordBatch:
            exact, ends, commons = (_buckets_of(np.concatenate(x), edges) for x in held)
            for x in held:
                x.clear()
            rows = [{"bucket": k, "runs": exact[k], "ends": ends[k], "commons": commons[k]} for k in range(buckets)]
            return pa.RecordBatch.from_pylist([x for x in rows if x["runs"] or x["ends"] or x["commons"]], schema=schema)

        for whole in batches:
            for x, y in text_batches(whole.column(1), 2_000_000):
                batch = whole.take(pa.array(np.arange(x, y)))
                n, shingles = shingle_hashes(batch.column(1), size)
                base, prefix = np.cumsum(n) - n, _prefix(shingles)
                lists, keys = batch.column(2), np.asarray(batch.column(0))
                text = np.repeat(np.arange(len(n)), np.diff(np.asarray(lists.offsets)))
                start, stop, c, k = (np.asarray(lists.flatten().field(f)).astype(np.int64) for f in ("start", "stop", "c", "k"))
                own, where = _expand(start, np.where(k == 0, stop + 1, start))
                first = base[text[own]] + where
                exact = np.zeros(len(own), _RUN)
                exact["run"], exact["key"], exact["at"] = _range_hashes(prefix, first, first + width), keys[text[own]], where
                x, y = _commons_of(text, start, stop, c, k)
                held[2].append(_commons(shingles, base[text[x]], n[text[x]], (c[x], k[x]), (c[y], k[y]), keys[text[x]]))
                text, c, k = (v[k < _DIGESTED] for v in (text, c, k))
                of, run, at, length = _ends_of(prefix, base[text], n[text], c, k, width)
                ends = np.zeros(len(of), _STRETCH)
                ends["run"], ends["key"], ends["at"] = run, keys[text[of]], at
                first = base[text[of]] + at
                step = _END + 4 * np.arange(_SAMPLES)
                ends["inner"] = mixed(shingles[np.concatenate([first[:, None] + step, (first + length)[:, None] - 1 - step], axis=1)]) >> np.uint64(56)
                ends["sides"] = _sides(shingles, base[text[of]], n[text[of]], at, at + length)
                held[0].append(exact)
                held[1].append(ends)
                if sum(len(x) for kind in held for x in kind) > 500_000:
                    yield flush()
        if held[0]:
            yield flush()

    def meet(batch: pa.Table) -> pa.Table:
        out = []
        for name, kind in (("runs", _RUN), ("ends", _STRETCH), ("commons", _COMMON)):
            rows = np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in batch.column(name)])
            rows = rows[np.lexsort([np.ascontiguousarray(rows[f]) for f in ("at", "key", "run")])]
            for x, y in _met(rows):
                at = rows["at"][x]
                out.append((rows["key"][x], rows["key"][y], at, at - rows["at"][y]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out)], names=_MET.names)

    found = given.mapInArrow(runs, _RUNS).repartition(3 * buckets, "bucket").groupBy("bucket").applyInArrow(meet, _MET)
    # a passage reaches less than its width beyond; what lies between the rows of one alignment is left to the verification
    spans = found.groupBy("a", "b", "offset").agg((F.min("at") - width).alias("start"), (F.max("at") + 2 * width).alias("stop"))
    return materialize(spans.select("a", "b", F.lit(_EXACT).alias("k"), "start", "stop", "offset"), "run-spans")


# --- verification ------------------------------------------------------------------------------------------------


def _expand(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range, position) of every position of the ranges [start, stop)."""
    n = np.maximum(stop - start, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n - start, n)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each of x is among the known values; ordered needles spare the search most of its cache misses."""
    if not len(x) or not len(known):
        return np.zeros(len(x), bool)
    order, known = np.argsort(x), np.sort(known)
    needles, out = x[order], np.empty(len(x), bool)
    out[order] = known[np.minimum(np.searchsorted(known, needles), len(known) - 1)] == needles
    return out


def _owned(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return mixed(h + (owner.astype(np.uint64) + np.uint64(1)) * _STEP)


def merged_ranges(pair: np.ndarray, start: np.ndarray, stop: np.ndarray, offset: np.ndarray, slack: int) -> tuple[np.ndarray, ...]:
    """(pair, start, stop, least offset, largest offset): overlapping ranges of a pair whose offsets lie within `slack` of a neighbour's are one."""
    order = np.lexsort((offset, pair))
    pair, start, stop, offset = pair[order], start[order], stop[order], offset[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (offset[1:] - offset[:-1] > slack)
    group = np.cumsum(new)
    order = np.lexsort((start, group))
    pair, start, stop, offset, group = pair[order], start[order], stop[order], offset[order], group[order]
    reach = np.maximum.accumulate(stop + (group << 32))
    new = np.ones(len(pair), bool)
    new[1:] = start[1:] + (group[1:] << 32) >= reach[:-1]
    at = np.flatnonzero(new)
    if not len(at):
        return pair, start, stop, offset, offset
    return pair[at], start[at], np.maximum.reduceat(stop, at), np.minimum.reduceat(offset, at), np.maximum.reduceat(offset, at)


def dense_segments(position: np.ndarray, miss: int, width: int) -> list[tuple[int, int]]:
    """Disjoint (first, last) indices of ascending positions: from the left, the longest stretches of at least `width`
    in which each position left out is made up for by `miss` others."""
    cut = np.flatnonzero(np.diff(position) > 1)
    first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(position) - 1]])
    hits = np.concatenate([[0], np.cumsum(last - first + 1)])
    gaps = np.concatenate([[0], np.cumsum(position[first[1:]] - position[last[:-1]] - 1)])
    begins, ends = hits[:-1] - miss * gaps, hits[1:] - miss * gaps
    # the farthest end that is worth a begin: the largest over the ends from each on only falls
    best = -np.maximum.accumulate(ends[::-1])[::-1]
    out, k = [], 0
    while k < len(first):
        far = int(np.searchsorted(best, -begins[k], "right")) - 1
        if position[last[far]] + 1 - position[first[k]] >= width:
            out.append((int(first[k]), int(last[far])))
            k = far
        k += 1
    return out


def verified_passages(flat: np.ndarray, a_base: np.ndarray, a_len: np.ndarray, b_base: np.ndarray, b_len: np.ndarray, ranges: tuple[np.ndarray, ...], width: int, threshold: float, slack: int = 10) -> list[tuple[int, int, int, int, int, float]]:
    """(pair, from, to, from, to, similarity), in shingles of a and b: near-equal passages within the proposed ranges
    (pair, start, stop, offset) of pairs whose shingles are slices of `flat`.

    Within a range the shingles of a that b has near the same place are cut to runs at gaps over `slack`; a run as wide as
    a passage is compared, as a set, with what b has from the first to the last of its shingles there. Where the whole run
    falls short, its stretches are compared that have few enough shingles that b lacks: at most one in 9, 17 and then 33."""
    pair, start, stop, offset = ranges
    start, stop = np.maximum(start, 0), np.minimum(stop, a_len[pair])
    pair, start, stop, least, most = merged_ranges(pair, start, stop, offset, slack)
    low, high = np.maximum(0, start - most - slack), np.minimum(b_len[pair], stop - least + slack)
    own, at = _expand(start, stop)
    there, place = _expand(low, high)
    hit = _among(_owned(flat[a_base[pair[own]] + at], own), _owned(flat[b_base[pair[there]] + place], there))
    own, at = own[hit], at[hit]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (at[1:] - at[:-1] > slack)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(own)]])[: len(first)] - 1
    out: list[tuple[int, int, int, int, int, float]] = []
    for miss in (8, 16, 32, 0):
        wide = (last > first) & (at[last] + 1 - at[first] >= width)
        first, last = first[wide], last[wide]
        of, begin, end = own[first], at[first], at[last] + 1
        if not len(of):
            break
        run, position = _expand(begin, end)
        mine = _owned(flat[a_base[pair[of[run]]] + position], run)
        other, place = _expand(np.maximum(low[of], begin - most[of] - slack), np.minimum(high[of], end - least[of] + slack))
        back = _among(_owned(flat[b_base[pair[of[other]]] + place], other), mine)
        other, place = other[back], place[back]
        many = np.bincount(other, minlength=len(of))
        upto = np.cumsum(many)
        some = many > 0
        b_begin, b_end = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
        b_begin[some], b_end[some] = place[(upto - many)[some]], place[upto[some] - 1] + 1
        other, place = _expand(b_begin, b_end)
        x, x_at = np.unique(mine, return_index=True)
        y, y_at = np.unique(_owned(flat[b_base[pair[of[other]]] + place], other), return_index=True)
        both = np.bincount(run[x_at][_among(x, y)], minlength=len(of))
        similar = both / np.maximum(np.bincount(run[x_at], minlength=len(of)) + np.bincount(other[y_at], minlength=len(of)) - both, 1)
        good = (similar >= threshold) & (b_end - b_begin >= width * threshold)
        out += zip(pair[of[good]].tolist(), begin[good].tolist(), end[good].tolist(), b_begin[good].tolist(), b_end[good].tolist(), similar[good].tolist())
        rest = [(f + i, f + j) for f, t in zip(first[~good].tolist(), last[~good].tolist()) for i, j in dense_segments(at[f : t + 1], miss, width)] if miss else []
        first, last = np.array([f for f, _ in rest], np.int64), np.array([t for _, t in rest], np.int64)
    kept, done = [], (-1, -1)
    for p, a, b, c, d, s in sorted(out):
        if p != done[0] or a >= done[1]:  # two alignments of one passage
            kept.append((p, a, b, c, d, s))
            done = p, b
    return kept


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text): one key for each distinct doc_id and text."""
    given = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_hash("text"), F.coalesce("text", F.lit("")).alias("text"))
    return given.select(F.xxhash64("doc_id", "text_hash").alias("key"), "doc_id", "text")


def shared_passages(docs: DataFrame, *, min_words: int = 50, threshold: float = 0.8, size: int = 5, hashes: int = 5, enough: int = 2, block_chars: int = 4_000_000, bucket_bytes: int = 8_000_000, group: int = 512) -> DataFrame:
    """(doc_id, other_doc_id, start_word, end_word, other_start, other_end, similarity): passages of at least min_words words
    (ends exclusive) of a document that recur in another with a smaller doc_id.

    A passage that many documents share links each of them with one of them, not with all. Documents that share a run of min_words
    words exactly are always proposed to the run's first. Near passages are proposed to the first window of an equal value, the first whose shingles
    before the least one are the same, and the first with the same ones behind it, by at least `enough` hash functions, and in any
    case to the first that has the same ends of a stretch of a passage, and where that is unlike to another that is alike. Documents with a run
    that has the same least shingles by two hash functions are linked wherever they are near, to the first or to another.
    A pair's shingles then have a Jaccard similarity of at least the threshold on the passage. Words are lower-cased
    runs without white space. Null and short texts have no passage; rows without doc_id are left out; rows that repeat a
    doc_id with another text are documents of their own, which link like others (with equal ids), and equal rows are one. An
    empty table gives no rows."""
    width = min_words - size + 1
    keyed = _keyed(docs)
    (total,) = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = max(8, -(-total // bucket_bytes))
    blocks = packed_windows(keyed, buckets, hashes=hashes, width=width, size=size, block_chars=block_chars)
    links = materialize(candidate_pairs(blocks, buckets, width), "window-links")
    texts = keyed.dropDuplicates(["key"])
    pairs = links.where(F.col("k") > _CONTESTED).unionByName(met_in_runs(texts, links.where(F.col("k") == _CONTESTED), buckets, width, size))
    # the interval join: hash functions whose ranges lie on about one alignment
    met = pairs.groupBy("a", "b").agg(F.count_distinct("k").alias("n"), F.min("k").alias("least"), F.collect_set(F.struct("start", "stop", "offset")).alias("ranges"))
    near = materialize(met.where((F.col("n") >= enough) | (F.col("least") == _EXACT)).drop("n", "least"), "passage-pairs")
    discard(links)
    groups = near.groupBy("b").agg(F.ceil(F.count("*") / group).alias("groups"))
    members = near.join(groups, "b").select(F.col("a").alias("key"), F.col("b").alias("pivot"), F.pmod(F.xxhash64("a"), F.col("groups")).alias("part"), "ranges")
    pivots = groups.select(F.col("b").alias("key"), F.col("b").alias("pivot"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part"), F.lit(None).cast(near.schema["ranges"].dataType).alias("ranges"))
    roles = materialize(members.unionByName(pivots), "passage-roles")
    # each text crosses once to its roles, however many it has: the copies of a row go first, on the same partitioning
    dealt = roles.join(texts, "key").select("pivot", "part", "key", "doc_id", "ranges", "text")
    dealt = dealt.repartition("pivot", "part").sortWithinPartitions("pivot", "part", F.col("ranges").isNotNull())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, pivot_id, pivot_shingles = None, None, np.empty(0, np.uint64)
        for whole in batches:
            for x, y in text_batches(whole.column(5), 4_000_000):
                batch = whole.slice(x, y - x)
                keys, ids, owners = (np.asarray(batch.column(n)) for n in ("key", "doc_id", "pivot"))
                n, shingles = shingle_hashes(batch.column(5), size)
                flat = np.concatenate([pivot_shingles, shingles])
                base = np.cumsum(n) - n + len(pivot_shingles)
                head = keys == owners
                # the row of each row's pivot: the last one before it, or that carried over
                lead = np.maximum.accumulate(np.where(head, np.arange(len(keys)), -1))
                rows = np.flatnonzero(~head)
                b_base = np.where(lead >= 0, base[lead], 0)[rows]
                b_len = np.where(lead >= 0, n[lead], len(pivot_shingles))[rows]
                b_key = np.where(lead >= 0, keys[lead], pivot if pivot is not None else 0)[rows]
                b_id = np.where(lead >= 0, ids[lead], pivot_id if pivot_id is not None else 0)[rows]
                assert (b_key == owners[rows]).all()
                lists = batch.column("ranges").take(pa.array(rows))
                count = np.diff(np.asarray(lists.offsets)).astype(np.int64)
                fields = [np.asarray(lists.flatten().field(f)).astype(np.int64) for f in ("start", "stop", "offset")]
                found = verified_passages(flat, base[rows], n[rows], b_base, b_len, (np.repeat(np.arange(len(rows)), count), *fields), width, threshold)
                if found:
                    p, a0, a1, b0, b1, s = (np.array(x) for x in zip(*found))
                    ends = [x.astype(np.int32) for x in (a0, a1 + size - 1, b0, b1 + size - 1)]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, (keys[rows][p], b_key[p], ids[rows][p], b_id[p], *ends, s))), names=_PASSAGES.names)
                if lead[-1] >= 0:
                    k = lead[-1]
                    pivot, pivot_id, pivot_shingles = keys[k], ids[k], flat[base[k] : base[k] + n[k]]

    found = dealt.mapInArrow(compare, _PASSAGES)
    swap = (F.col("a_id") < F.col("b_id")) | ((F.col("a_id") == F.col("b_id")) & (F.col("a") < F.col("b")))
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return found.select(
        pick("a_id", "b_id").alias("doc_id"), pick("b_id", "a_id").alias("other_doc_id"), pick("a_start", "b_start").alias("start_word"), pick("a_end", "b_end").alias("end_word"),
        pick("b_start", "a_start").alias("other_start"), pick("b_end", "a_end").alias("other_end"), "similarity",
    )


def both_ways(passages: DataFrame) -> DataFrame:
    """Each passage as one of either document, so that every document with a passage has a row, the first one too."""
    there = F.struct("doc_id", "other_doc_id", "start_word", "end_word", "other_start", "other_end", "similarity")
    back = F.struct(F.col("other_doc_id").alias("doc_id"), F.col("doc_id").alias("other_doc_id"), F.col("other_start").alias("start_word"), F.col("other_end").alias("end_word"), F.col("start_word").alias("other_start"), F.col("end_word").alias("other_end"), "similarity")
    return passages.select(F.explode(F.array(there, back)).alias("p")).select("p.*")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shared_passages of `documents` with its default parameters, for both documents of each pair."""
    return both_ways(shared_passages(only(table(spark, sf_dir, "documents"), "doc_id", "text")))
