"""MinHash near-dedup with BagMinHash signatures over multisets of five-word shingles.

An element of weight w owns the weight levels below w. Dyadic intervals of levels - (0,1], (1,2], (2,4], (4,8], ... -
each carry a Poisson process in time, of the interval's rate, whose points have a register and a level. A register's
signature is the time of its first point on an owned level, so two documents agree on it with probability equal to their
weighted Jaccard similarity. Points come in order of time, and an element stops at the latest register time so far.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_steps, fresh, materialize, only, recorded, table, text_hash
from .segments import text_batches
from .shingles import _STEP, connected_components, mixed, shingles_of, slices, split_words, word_hashes


def _steps(k: int) -> np.uint64:
    return np.uint64(k * int(_STEP) & 2**64 - 1)


def bag_min_hash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """(documents, registers) signature times for elements (doc, 64-bit hash, whole weight); inf for documents without any."""
    parts = []
    level, low = 0, 0
    while True:
        own = np.flatnonzero(weight > low)
        if not len(own):
            break
        width = max(1, low)
        parts.append((doc[own], mixed(element[own] + _steps(level)), weight[own] - low, np.full(len(own), width)))
        level, low = level + 1, max(1, 2 * low)
    times = np.full((n_docs, registers), np.inf)
    if not parts:
        return times
    d, seed, above, width = (np.concatenate(x) for x in zip(*parts))
    now = np.zeros(len(d))
    latest = np.full(n_docs, np.inf)
    step = 0
    while len(d):
        step += 1
        r = mixed(seed + _steps(2 * step))
        now = now - np.log(((r >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / width
        r = mixed(seed + _steps(2 * step + 1))
        register = ((r >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        lands = now < latest[d]
        hit = lands & (((r & np.uint64(0xFFFFFFFF)) * width.astype(np.uint64) >> np.uint64(32)).astype(np.int64) < above)
        np.minimum.at(times.reshape(-1), d[hit] * registers + register[hit], now[hit])
        some = np.flatnonzero(np.bincount(d, minlength=n_docs))
        latest[some] = times[some].max(axis=1)
        keep = now < latest[d]
        d, seed, above, width, now = d[keep], seed[keep], above[keep], width[keep], now[keep]
    return times


def bands(times: np.ndarray, rows: int) -> np.ndarray:
    """(documents, bands) keys: hashes of `rows` signature values each, with the band's number."""
    bits = times.view(np.uint64).reshape(len(times), -1, rows)
    key = np.arange(bits.shape[1], dtype=np.uint64)[None, :] + np.zeros((len(times), 1), np.uint64)
    for k in range(rows):
        key = mixed(key * _STEP + bits[:, :, k])
    return key.view(np.int64)


def shingle_lists(texts: pa.Array, size: int) -> list[np.ndarray]:
    n, words = split_words(texts)
    return slices(*shingles_of(n, word_hashes(words), size))


def counted(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles, return_counts=True)


def shingle_copies(shingles: np.ndarray) -> np.ndarray:
    """A hash for each copy of each shingle: what two of these sets share is what the multisets share."""
    h, n = counted(shingles)
    copy = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return mixed(np.repeat(h, n) + copy.astype(np.uint64) * _STEP)


def multiset_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1) if len(b[0]) else np.empty(0, np.int64)
    if not len(at):
        return 0.0
    shared = np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum()
    return float(shared / (a[1].sum() + b[1].sum() - shared))


_SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("key", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
_LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("similarity", T.DoubleType())])


def signed(docs: DataFrame, *, n_bands: int = 32, rows: int = 5, size: int = 5) -> DataFrame:
    """(doc_id, text_hash, key, bands): a 64-bit digest of the words and the band keys; both null for a text without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_batches(batch.column(2), 3_000_000):
                n, words = split_words(batch.column(2).slice(a, b - a))
                h = word_hashes(words)
                found = [counted(x) for x in slices(*shingles_of(n, h, size))]
                m = [len(x) for x, _ in found]
                times = bag_min_hash(np.repeat(np.arange(b - a), m), np.concatenate([x for x, _ in found]), np.concatenate([c for _, c in found]).astype(np.int64), b - a, n_bands * rows)
                digests = [int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) for x in slices(n, h)]
                empty = pa.array(n == 0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * n_bands, pa.int32()), pa.array(bands(times, rows).reshape(-1)), mask=empty)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.array(digests, np.int64), mask=n == 0), lists], names=_SIGNED.names)

    return docs.select(F.col("doc_id").cast("long"), text_hash("text"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(sign, _SIGNED)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, size: int, group: int = 256) -> DataFrame:
    """The pairs (member, pivot) with their similarity, where it reaches the threshold.

    A pivot's members are dealt to groups of about `group`, each with a copy of the pivot's text, so no task gets all
    members of a pivot that many share."""
    groups = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / group).alias("groups"))
    members = pairs.join(groups, "pivot").select(F.col("member").alias("key"), "pivot", F.pmod(F.xxhash64("member"), F.col("groups")).alias("part"))
    pivots = groups.select(F.col("pivot").alias("key"), "pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part"))
    roles = materialize(members.union(pivots), "near-roles")
    dealt = roles.join(texts, "key")

    def compare(batch: pa.Table) -> pa.Table:
        pivot = batch.column("pivot")[0].as_py()
        keys = batch.column("key").to_pylist()
        found = [counted(x) for x in shingle_lists(batch.column("text").combine_chunks(), size)]
        own = found[keys.index(pivot)]
        rows = [(i, s) for i, s in ((i, multiset_jaccard(own, x)) for i, x in zip(keys, found) if i != pivot) if s >= threshold]
        return pa.table({"a": pa.array([i for i, _ in rows], pa.int64()), "b": pa.array([pivot] * len(rows), pa.int64()), "similarity": pa.array([s for _, s in rows], pa.float64())})

    return dealt.groupBy("pivot", "part").applyInArrow(compare, _LINKS)


def shared_counts(one: list[np.ndarray], two: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """(len(one), len(two)): how many elements each two sets of 64-bit hashes share, by products of 0/1 matrices of so many columns."""
    sets = one + two
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    element = np.concatenate(sets)
    both = np.intersect1d(element[owner < len(one)], element[owner >= len(one)])
    at = np.minimum(np.searchsorted(both, element), max(len(both) - 1, 0))
    held = both[at] == element if len(both) else np.zeros(len(element), bool)
    order = np.argsort(at[held], kind="stable")
    owner, at = owner[held][order], at[held][order]
    out = np.zeros((len(one), len(two)), np.int64)
    for low in range(0, len(both), columns):
        a, b = np.searchsorted(at, [low, low + columns])
        m = np.zeros((len(sets), min(columns, len(both) - low)), np.float32)
        m[owner[a:b], at[a:b] - low] = 1
        out += (m[: len(one)] @ m[len(one) :].T).astype(np.int64)
    return out


def spanning_links(ids: list[int], parts: list[int], sides: list[bool], sets: list[np.ndarray], threshold: float) -> list[tuple[int, int, float]]:
    """Links (a, b, similarity) that join all parts with a pair of texts at the threshold, no two of them joining the same parts.

    Texts of one side are compared with each other, those of two sides across only; multisets come as sets of their elements' copies."""
    rows = [k for k, side in enumerate(sides) if not side]
    columns = [k for k, side in enumerate(sides) if side] or rows
    shared = shared_counts([sets[k] for k in rows], [sets[k] for k in columns])
    size = np.array([len(x) for x in sets], np.int64)
    either = size[rows][:, None] + size[columns][None, :] - shared
    similarity = shared / np.maximum(either, 1)
    part = np.array(parts, np.int64)
    root = {x: x for x in parts}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, j in np.argwhere((similarity >= threshold) & (part[rows][:, None] != part[columns][None, :])).tolist():
        a, b = rows[i], columns[j]
        x, y = find(parts[a]), find(parts[b])
        if x != y:
            root[x] = y
            out.append((ids[a], ids[b], float(similarity[i, j])))
    return out


def _across(left: DataFrame, texts: DataFrame, threshold: float, size: int, group: int = 256) -> DataFrame:
    """Links between the parts of each bucket, from (bucket, member, part): every two texts of different parts are compared.

    A bucket's members are dealt to tiles of about `group`, those of a large part to tiles of its own, and every two tiles
    meet in a task, except two of the same part. n texts cross some n / group times. Buckets of equal members count once."""
    counted = left.groupBy("bucket", "part").agg(F.count("*").alias("n"), F.min("member").alias("low"), F.max("member").alias("high"), *[F.expr(f"bit_xor(xxhash64(member, {k}))").alias(f"x{k}") for k in (1, 2)])
    counted = materialize(counted, "near-parts")
    mixed_ones = counted.groupBy("bucket").agg(
        F.count("*").alias("parts"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.expr("bit_xor(x1)").alias("x1"), F.expr("bit_xor(x2)").alias("x2"),
        F.coalesce(F.sum(F.when(F.col("n") < group, F.col("n"))), F.lit(0)).alias("small"),
    ).where("parts > 1")
    once = materialize(mixed_ones.groupBy("n", "low", "high", "x1", "x2").agg(F.min_by(F.struct("bucket", "small"), "bucket").alias("first")).select("first.*"), "near-mixed")
    large = F.col("n") >= group
    deal = counted.join(once, "bucket").select("bucket", "part", large.alias("large"), F.ceil(F.when(large, F.col("n")).otherwise(F.col("small")) / group).alias("tiles"))
    nr = F.pmod(F.xxhash64(F.when(F.col("large"), F.col("member")).otherwise(F.col("part"))), F.col("tiles"))
    owner = F.when(F.col("large"), F.col("part").cast("string")).otherwise(F.lit(""))
    dealt = materialize(left.join(deal, ["bucket", "part"]).select("bucket", "member", "part", owner.alias("owner"), F.concat_ws("/", owner, nr).alias("tile")), "near-tiles")
    tiles = materialize(dealt.select("bucket", "owner", "tile").distinct(), "near-tile-names")
    one, two = (tiles.select("bucket", F.col("owner").alias(f"owner_{k}"), F.col("tile").alias(k)) for k in ("one", "two"))
    meet = materialize(one.join(two, "bucket").where("one <= two and (owner_one <> owner_two or owner_one = '')").select("bucket", "one", "two"), "near-meet")
    first = dealt.join(meet, [dealt.bucket == meet.bucket, dealt.tile == meet.one]).select(meet.bucket, "one", "two", "member", "part", F.lit(False).alias("side"))
    second = dealt.join(meet.where("one <> two"), [dealt.bucket == meet.bucket, dealt.tile == meet.two]).select(meet.bucket, "one", "two", "member", "part", F.lit(True).alias("side"))
    roles = materialize(first.union(second).withColumnRenamed("member", "key"), "near-roles")

    def compare(batch: pa.Table) -> pa.Table:
        parts = batch.column("part").to_pylist()
        rows = []
        if len(set(parts)) > 1:
            sets = list(map(shingle_copies, shingle_lists(batch.column("text").combine_chunks(), size)))
            rows = spanning_links(batch.column("key").to_pylist(), parts, batch.column("side").to_pylist(), sets, threshold)
        return pa.table({"a": pa.array([a for a, _, _ in rows], pa.int64()), "b": pa.array([b for _, b, _ in rows], pa.int64()), "similarity": pa.array([s for _, _, s in rows], pa.float64())})

    return roles.join(texts, "key").groupBy("bucket", "one", "two").applyInArrow(compare, _LINKS)


def near_links(docs: DataFrame, distinct: DataFrame, *, threshold: float, size: int) -> DataFrame | None:
    """Verified links (a, b, similarity) among the keys of distinct texts (key, doc_id, text_hash, bands); None if no band is shared.

    In each shared bucket the smallest key is compared with every other. In buckets whose texts these links have not joined
    to one component, every two texts of different components are then compared, so no two texts at the threshold that share
    a bucket stay apart. A bucket of n texts in k components thus costs up to some n x n x (1 - 1/k) / 2 comparisons."""
    rows = distinct.select("key", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    left = materialize(rows.join(materialize(shared, "near-shared"), "bucket").select("bucket", F.col("key").alias("member")), "near-buckets")
    pivots = materialize(left.groupBy("bucket").agg(F.min("member").alias("pivot")), "near-pivots")
    pairs = materialize(left.join(pivots, "bucket").where("member > pivot").select("member", "pivot").distinct(), "near-pairs")
    if pairs.isEmpty():
        return None
    wanted = distinct.join(left.select(F.col("member").alias("key")).distinct(), "key").select("key", "doc_id", "text_hash")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash("text"), F.coalesce("text", F.lit("")).alias("text"))
    texts = materialize(given.join(wanted, ["doc_id", "text_hash"]).select("key", "text").dropDuplicates(["key"]), "near-texts")
    links = materialize(_verified(pairs, texts, threshold, size), "near-links")
    parts = connected_components(links).select(F.col("id").alias("member"), F.col("class_id"))
    left = materialize(left.join(parts, "member", "left").select("bucket", "member", F.coalesce("class_id", "member").alias("part")), "near-buckets")
    return links.unionByName(materialize(_across(left, texts, threshold, size), "near-links"))


def _classes(docs: DataFrame, *, threshold: float = 0.8, size: int = 5, n_bands: int = 32, rows: int = 5) -> DataFrame:
    """(doc_id, text_hash, n, class_id, chosen) of each distinct doc_id and text: n rows have it, and the class's row is among the chosen."""
    sign = materialize(signed(docs, n_bands=n_bands, rows=rows, size=size), "signed")
    per = materialize(sign.groupBy("doc_id", "text_hash", "key").agg(F.count("*").alias("n")), "near-rows")
    first = materialize(per.where("key is not null and doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("f")).select("key", "f.*"), "near-first")
    distinct = sign.where("bands is not null").join(first, ["key", "doc_id", "text_hash"]).select("key", "doc_id", "text_hash", "bands").dropDuplicates(["key"])
    links = near_links(only(docs, "doc_id", "text"), distinct, threshold=threshold, size=size)
    best = F.struct("doc_id", "text_hash")
    if links is None:
        classes = first.select("key", best.alias("best"))
    else:
        parts = connected_components(links)
        of = materialize(first.join(parts, F.col("key") == F.col("id"), "left").select("key", best.alias("own"), F.coalesce("class_id", "key").alias("part")), "near-parts")
        # a class's least row, where a large class is first summed by task
        least = of.groupBy("part").agg(F.min("own").alias("best"))
        classes = of.join(materialize(least, "near-least"), "part").select("key", "best")
    joined = per.join(materialize(classes, "near-classes"), "key", "left")
    alone = F.col("best").isNull()
    return joined.select(
        "doc_id", "text_hash", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("best.doc_id", "doc_id")).alias("class_id"),
        (alone | F.col("doc_id").isNull() | ((F.col("doc_id") == F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash")))).alias("chosen"), (~alone & F.col("doc_id").isNotNull()).alias("grouped"),
    )


def near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, class_id, keep) for each row of (doc_id, text): class_id is the smallest doc_id of its class.

    Texts with equal words are one class without comparison; different ones are linked where their shingle multisets
    have a Jaccard similarity of at least the threshold, and classes are the components of the links. One row of each
    class has keep. A text without words is alone in its class. Rows that repeat a doc_id with another text are judged by
    their own text, so one doc_id can be in several classes; equal rows are copies like any. A null doc_id is alone, with
    a null class, and kept. An empty table gives no rows.

    Parameters: threshold 0.8, size 5 (words a shingle), n_bands 32 of `rows` 5 values. A pair at the threshold shares no
    band with probability (1 - threshold^rows)^n_bands, 3e-6 by default."""
    rows = _classes(docs, **parameters)
    return rows.select("doc_id", "class_id", "chosen", "grouped", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("nr")).select("doc_id", "class_id", (F.col("chosen") & ((F.col("nr") == 1) | ~F.col("grouped"))).alias("keep"))


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that near_duplicates keeps: one document of each class, with the columns of docs, whatever they are named."""
    doc_id, hashed, n = fresh(docs, "doc_id", "text_hash", "n")
    with recorded() as steps:
        classes = _classes(docs, **parameters)
    rows = materialize(classes.where("not chosen or (grouped and n > 1)").select(F.col("doc_id").alias(doc_id), F.col("text_hash").alias(hashed), F.when(F.col("chosen"), F.col("n")).alias(n)), "near-dropped")
    drop_steps(steps)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    same = (F.col("doc_id").cast("long") == F.col(f"`{doc_id}`")) & (text_hash("text") == F.col(f"`{hashed}`"))
    kept = docs.join(rows, same, "left_anti").select(*columns)
    repeated = rows.where(F.col(f"`{n}`").isNotNull())
    if repeated.isEmpty():
        return kept
    return kept.union(docs.join(repeated, same).dropDuplicates([doc_id, hashed]).select(*columns))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates of `documents` with its default parameters: doc_id, class_id, keep of every row."""
    return near_duplicates(only(table(spark, sf_dir, "documents"), "doc_id", "text"))
