"""Periodic runs of words, found in tiles whose size follows the period.

Periods come in octaves. For an octave a document is cut into tiles that overlap by a few of its periods, and each tile is solved by
itself: aligned blocks of half the least period that recur at a distance of the octave propose the period, and Z-functions at
a block's boundary tell how far to either side the words repeat, and whether a divisor of the period does as well. Fragments
of equal words then meet by document and period and are stitched. Documents up to a tile are cut and solved where they are read;
the tiles of longer ones are dealt to other tasks.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialize, only, table
from .segments import text_batches
from .shingles import _STEP, mixed

LEAST = 12  # words of a run
_WIDE = 2_000_000  # comparisons at once


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(words of each text, all words in order): runs without ASCII white space. A null text has none."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    n, flat = np.diff(np.asarray(lists.offsets)).astype(np.int64), lists.flatten()
    empty = np.asarray(pc.equal(flat, ""))  # an empty text gives one
    if empty.any():
        n -= np.bincount(np.repeat(np.arange(len(n)), n)[empty], minlength=len(n))
        flat = flat.filter(pa.array(~empty))
    return n, flat


def octaves(words: int) -> list[tuple[int, int, int]]:
    """(least period, end of periods, words of a block) of the octaves that a text of so many words can have.

    A run's words that equal those a period on are at least twice a block, so they hold an aligned one."""
    out = [(1, 8, 3)] if words >= LEAST else []
    low = 8
    while 2 * low <= words:
        out.append((low, 2 * low, low // 2))
        low *= 2
    return out


def reach(high: int) -> int:
    """Words that a tile of the octave has before a block; behind its start it has twice as many."""
    return max(high, 16)


def least_equal(period: int) -> int:
    """Words of a run that equal those a period on."""
    return max(period, LEAST - period)


def z_values(s: np.ndarray) -> list[int]:
    """For each position of s how many of its values from there on equal those from the begin; the first is not counted."""
    values, z = s.tolist(), [0] * len(s)
    left = right = 0
    for i in np.flatnonzero(s[1:] == s[0]).tolist() if len(s) else ():
        i += 1
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < len(values) and values[k] == values[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


class Boundary:
    """What lies to either side of a place in a text: how many words equal those a period on, up to the tile's reach."""

    def __init__(self, code: np.ndarray, begin: int, at: int, end: int, high: int):
        low, top = max(begin, at - reach(high)), min(end, at + high)
        self.ahead = z_values(code[at : min(end, at + 2 * reach(high))])
        before = code[low:at][::-1]
        self.back = z_values(np.concatenate([before, [-1], code[low:top][::-1]]))
        self.place = len(before) + 1 + top - at

    def forward(self, period: int) -> int:
        return self.ahead[period] if period < len(self.ahead) else 0

    def backward(self, period: int) -> int:
        k = self.place - period
        return self.back[k] if 0 < k < len(self.back) else 0


@functools.lru_cache(maxsize=100_000)
def prime_factors(n: int) -> tuple[int, ...]:
    out, k = [], 2
    while k * k <= n:
        if n % k == 0:
            out.append(k)
            while n % k == 0:
                n //= k
        k += 1
    return (*out, n) if n > 1 else tuple(out)


class Tiles:
    """Tiles one behind the other: `code` has their words, equal ones of a tile by equal numbers.

    Of tile k the words are [begin, end), word 0 of its document would be at origin, and blocks that start in [core, core_end) are its own."""

    def __init__(self, code: np.ndarray, begin: np.ndarray, end: np.ndarray, origin: np.ndarray, core: np.ndarray, core_end: np.ndarray):
        self.code, self.begin, self.end, self.origin, self.core, self.core_end = code, begin, end, origin, core, core_end
        owner = np.repeat(np.arange(len(begin), dtype=np.uint64), end - begin)
        self.grams = {1: mixed(code.astype(np.uint64) * _STEP + (owner + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))}

    def _grams(self, m: int) -> np.ndarray:
        """A hash of the m words from each place on; tiles share no words."""
        if m not in self.grams:
            half = self._grams(m // 2)
            both = mixed(half[: len(half) - m // 2] * _STEP + half[m // 2 :])
            if m % 2:
                one = self._grams(1)
                both = mixed(both[: len(one) - m + 1] * _STEP + one[m - 1 :])
            self.grams[m] = both
        return self.grams[m]

    def fragments(self, low: int, high: int, m: int) -> list[tuple[int, int, int, int]]:
        """(tile, period, start, stop) for periods in [low, high): stretches of words that equal those a period on, as far as the
        tile shows them, those too short for a run and those that a divisor of the period explains left out."""
        some = np.flatnonzero(self.end - self.begin >= max(2 * low, LEAST))
        first = self.origin[some] - (-(self.core[some] - self.origin[some]) // m) * m
        n = np.maximum(0, -(-(np.minimum(self.core_end[some], self.end[some] - m - low + 1) - first) // m))
        some, first, n = some[n > 0], first[n > 0], n[n > 0]
        if not len(some) or len(self.code) < m:
            return []
        tile = np.repeat(some, n)
        at = np.repeat(first - m * (np.cumsum(n) - n), n) + m * np.arange(n.sum())
        gram = self._grams(m)
        padded = np.concatenate([gram, np.zeros(m + high, np.uint64)])
        windows = np.lib.stride_tricks.sliding_window_view(padded, high - low)
        follows = np.concatenate([[False], tile[1:] == tile[:-1]])
        starts, stops = [], []
        step = max(1, _WIDE // (high - low))
        for a in range(0, len(at), step):
            b = min(a + step, len(at))
            x, y = max(a - 1, 0), min(b + 1, len(at))
            equal = windows[at[x:y] + low] == gram[at[x:y]][:, None]
            if not equal.any():
                continue
            linked = equal[1:] & equal[:-1] & follows[x + 1 : y, None]
            begins, ends = equal.copy(), equal
            begins[1:] &= ~linked
            ends = equal.copy()
            ends[:-1] &= ~linked
            for found, out in ((begins, starts), (ends, stops)):
                row, period = np.nonzero(found[a - x : b - x])
                out.append(np.stack([period + low, row + a]))
        if not starts:
            return []
        chains = [np.concatenate(x, axis=1) for x in (starts, stops)]
        chains = [x[:, np.lexsort((x[1], x[0]))] for x in chains]
        known: dict[int, Boundary] = {}

        def boundary(k: int) -> Boundary:
            if k not in known:
                known[k] = Boundary(self.code, int(self.begin[tile[k]]), int(at[k]), int(self.end[tile[k]]), high)
            return known[k]

        out = []
        for period, one, two in zip(chains[0][0].tolist(), chains[0][1].tolist(), chains[1][1].tolist()):
            here = boundary(one)
            back, ahead = here.backward(period), here.forward(period)
            if back + ahead < least_equal(period):
                continue
            if any(here.backward(d) >= back and here.forward(d) + d >= ahead + period for d in (period // f for f in prime_factors(period))):
                continue
            out.append((int(tile[one]), period, int(at[one]) - back, int(at[two]) + boundary(two).forward(period)))
        return out


_COLUMNS = "key long, doc_id long, n_words long, collapsed_sha256 string, text string, period long, start long, stop long, least long, above long, place long, core long, core_end long, codes binary"
_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]


def _batch(kinds: dict, rows: dict) -> pa.RecordBatch:
    n = len(next(iter(rows.values())))
    return pa.RecordBatch.from_arrays([(rows[c] if isinstance(rows[c], pa.Array) else pa.array(rows[c], kinds[c])) if c in rows else pa.nulls(n, kinds[c]) for c in _NAMES], names=_NAMES)


_KINDS = {c.split()[0]: {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in _COLUMNS.split(", ")}


def _tile_rows(key: int, code: np.ndarray, tile_words: int) -> Iterator[pa.RecordBatch]:
    """The tiles of one long document: octaves that fit well into tile_words share tiles, the larger ones have some of their own size."""
    shared = [o for o in octaves(len(code)) if 8 * o[1] <= tile_words]
    for group in ([shared] if shared else []) + [[o] for o in octaves(len(code)) if 8 * o[1] > tile_words]:
        high = group[-1][1]
        core = max(tile_words, 8 * high)
        for a in range(0, len(code), core):
            low, top = max(0, a - reach(high)), min(len(code), a + core + 2 * reach(high))
            row = {"key": [key], "least": [group[0][0]], "above": [high], "place": [low], "core": [a], "core_end": [min(a + core, len(code))], "codes": [code[low:top].astype(np.int32).tobytes()]}
            yield _batch(_KINDS, row)


def _first_pass(tile_words: int, batch_bytes: int):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in text_batches(whole.column("text"), batch_bytes):
                yield from documents(whole.slice(a, b - a))

    def documents(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, keys = batch.column("text"), batch.column("key").to_pylist()
        n, words = split(texts)
        code = np.asarray(words.dictionary_encode().indices).astype(np.int64)
        end = np.cumsum(n)
        begin = end - n
        long = n > tile_words
        for k in np.flatnonzero(long).tolist():
            yield from _tile_rows(keys[k], code[begin[k] : end[k]], tile_words)
        few = np.flatnonzero(~long & (n >= LEAST))
        inside = np.repeat(~long & (n >= LEAST), n)
        size = n[few]
        stop = np.cumsum(size)
        tiles = Tiles(code[inside], stop - size, stop, stop - size, stop - size, stop)
        found = [x for o in octaves(int(size.max()) if len(size) else 0) for x in tiles.fragments(*o)]
        opened = long.copy()
        if found:
            at, period, start, upto = (np.array(x, np.int64) for x in zip(*found))
            opened[few[at]] = True
            base = tiles.begin[at]
            yield _batch(_KINDS, {"key": [keys[k] for k in few[at].tolist()], "period": period, "start": start - base, "stop": upto - base})
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]).astype(np.int32)), words)
        joined = pc.binary_join(lists, " ")
        digests = [None if o else hashlib.sha256(x.as_buffer()).hexdigest() for o, x in zip(opened.tolist(), joined)]
        kept = texts.take(pa.array(np.arange(len(n)), mask=~opened))
        yield _batch(_KINDS, {"key": keys, "doc_id": batch.column("doc_id"), "n_words": n, "collapsed_sha256": digests, "text": kept})

    return solve


def _solve_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            code = np.frombuffer(row["codes"], np.int32).astype(np.int64)
            one = lambda x: np.array([x], np.int64)
            place = row["place"]
            tiles = Tiles(code, one(0), one(len(code)), one(-place), one(row["core"] - place), one(row["core_end"] - place))
            found = [x for o in octaves(2 * row["above"]) if row["least"] <= o[0] and o[1] <= row["above"] for x in tiles.fragments(*o)]
            if found:
                _, period, start, stop = (np.array(x, np.int64) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array([row["key"]] * len(found)), pa.array(period), pa.array(start + place), pa.array(stop + place)], names=["key", "period", "start", "stop"])


def stitched(fragments: DataFrame) -> DataFrame:
    """(key, start, length, period): the runs of fragments (key, period, start, stop) that touch or overlap; of equal ones that of the least period."""
    w = Window.partitionBy("key", "period").orderBy("start", "stop")
    so_far = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = fragments.withColumn("new", F.when(F.col("start") <= so_far, 0).otherwise(1)).withColumn("piece", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = marked.groupBy("key", "period", "piece").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    enough = whole.where(F.col("stop") - F.col("start") >= F.greatest(F.col("period"), LEAST - F.col("period")))
    return enough.groupBy("key", "start", (F.col("stop") + F.col("period") - F.col("start")).alias("length")).agg(F.min("period").alias("period"))


def periodic_runs(docs: DataFrame, *, tile_words: int = 1 << 17, batch_bytes: int = 4_000_000) -> DataFrame:
    """(doc_id, n_words, runs, collapsed, collapsed_sha256) for each row of (doc_id, text).

    runs are (start, length, period), by start and period: the longest stretches of words of a least period, at least 12 words and
    two periods long. collapsed is the text without the words that repeat in a run, joined by single spaces, for documents with
    runs; its digest is given for all. Null and empty texts have no words. Rows that repeat a doc_id, or are
    equal, are documents of their own. An empty table gives no rows."""
    spark = docs.sparkSession
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = materialize(keyed.mapInArrow(_first_pass(tile_words, batch_bytes), _COLUMNS), "runs-first")
    tiles = first.where("codes is not null").select("key", "least", "above", "place", "core", "core_end", "codes")
    dealt = tiles.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "least", "core").mapInArrow(_solve_tiles, "key long, period long, start long, stop long")
    fragments = first.where("period is not null").select("key", "period", "start", "stop").unionByName(dealt)
    runs = stitched(fragments).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("found"))
    runs = runs.select("key", F.transform("found", lambda r: F.struct(r.start.alias("start"), r.length.alias("length"), r.period.alias("period"))).alias("runs"))
    opened = first.where("text is not null").select("key", "doc_id", "n_words", "text").join(materialize(runs, "runs"), "key", "left")
    none = F.array().cast("array<struct<start:long,length:long,period:long>>")
    opened = opened.select("doc_id", "n_words", "text", F.coalesce("runs", none).alias("runs"))

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in text_batches(whole.column("text"), batch_bytes):
                batch = whole.slice(a, b - a)
                n, words = split(batch.column("text"))
                begin = np.cumsum(n) - n
                lists = batch.column("runs")
                flat = lists.flatten()
                base = np.repeat(begin, np.diff(np.asarray(lists.offsets)))
                start, length, period = (np.asarray(flat.field(c)) for c in ("start", "length", "period"))
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, base + start + period, 1)
                np.add.at(change, base + start + length, -1)
                keep = np.cumsum(change[:-1]) == 0
                left = np.add.reduceat(np.concatenate([keep, [False]]).astype(np.int64), begin) if len(n) else n
                left = np.where(n > 0, left, 0)
                kept = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left)]).astype(np.int32)), words.filter(pa.array(keep)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), lists, pc.binary_join(kept, " ")], names=["doc_id", "n_words", "runs", "collapsed"])

    shape = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    some = opened.mapInArrow(collapse, shape).withColumn("collapsed_sha256", F.sha2("collapsed", 256))
    plain = first.where("collapsed_sha256 is not null").select("doc_id", "n_words", none.alias("runs"), F.lit(None).cast("string").alias("collapsed"), "collapsed_sha256")
    return some.unionByName(plain)


def with_planted_tail(doc_id: Column, text: Column) -> Column:
    """The text; where ten divides the CRC of the doc_id, its words with a periodic tail, joined by single spaces."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.transform(words, lambda w, i: F.when(i >= a, F.get(words, (a + (i - a) % p).cast("int"))).otherwise(w))

    bound = F.transform(F.array(F.regexp_extract_all(text, F.lit(r"[^ \t-\r]+"), F.lit(0))), lambda words: F.when(F.size(words) > 0, F.array_join(tail(words), " ")).otherwise(""))
    return F.when(text.isNotNull() & (h % 10 == 0), F.get(bound, F.lit(0))).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """periodic_runs of `documents`, some with a planted tail: doc_id, n_runs, the longest run's start, length, period and
    exponent_milli, runs_sha256 and collapsed_sha256."""
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = periodic_runs(docs.select("doc_id", with_planted_tail(F.col("doc_id"), F.col("text")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    top = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"), F.sha2(listed, 256).alias("runs_sha256"), "collapsed_sha256")
    return top.select(
        "doc_id", "n_runs", (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
