"""Embedding near-dedup by lattice hashing, without a lost link.

A random rotation cuts unit vectors into blocks of eight coordinates, one table a block, and a block's point is decoded to a
point of the E8 lattice. Vectors whose cosine reaches the threshold are at most d = sqrt(2 - 2 threshold) apart, so in one of T
blocks at most d / sqrt(T): the midpoint there lies within r = d / (2 sqrt(T)) of both. Each vector is registered in all lattice
cells of each table that a ball of radius r about its point may touch, its own and neighbouring ones; then the midpoint's cell has both.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, only, table
from .shingles import _STEP, connected_components, mixed

_REACH = 0.2  # r over the lattice's scale: cells other than the own one lie at a lattice vector of norm 2 or 4 up to 0.2247
_CODE = 64  # steps of a coordinate within a cell


def _lattice_vectors() -> np.ndarray:
    """The vectors of E8 with squared norm 2 and 4, one of each pair of opposites."""
    whole = [v for v in itertools.product((-2, -1, 0, 1, 2), repeat=8) if sum(x * x for x in v) in (2, 4) and sum(v) % 2 == 0]
    half = [v for v in itertools.product((-1.5, -0.5, 0.5, 1.5), repeat=8) if sum(x * x for x in v) in (2, 4) and sum(v) % 2 == 0]
    return np.array([v for v in [*whole, *half] if next(x for x in v if x) > 0], np.float64)


def decoded(y: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row of y."""

    def even(z: np.ndarray) -> np.ndarray:  # the nearest whole numbers with an even sum
        near = np.rint(z)
        odd = np.flatnonzero(near.sum(axis=1) % 2)
        if len(odd):
            off = z[odd] - near[odd]
            at = np.abs(off).argmax(axis=1)
            near[odd, at] += np.where(off[np.arange(len(odd)), at] >= 0, 1.0, -1.0)
        return near

    a, b = even(y), even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


class Lattice:
    """The tables for vectors of one length."""

    def __init__(self, dims: int, threshold: float, seed: int):
        self.dims, self.tables = dims, -(-dims // 8)
        size = 8 * self.tables
        self.rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))[0][:dims]
        self.apart = math.sqrt(max(0.0, 2 - 2 * threshold)) / math.sqrt(self.tables) + 1e-9
        self.scale = self.apart / 2 / _REACH
        v = _lattice_vectors()
        norm = np.sqrt((v * v).sum(axis=1))
        self.near, self.far = v[norm < 1.5], v[norm > 1.5]
        self.near_at, self.far_at = 1 - _REACH * math.sqrt(2) - 1e-7, 2 - _REACH * 2 - 1e-7

    def points(self, units: np.ndarray) -> np.ndarray:
        """(vectors, tables, 8): the blocks of the rotated vectors, in units of the lattice. Sums run in one order whatever the
        number of rows, so that a vector's point is the same wherever it is computed."""
        out = np.zeros((len(units), 8 * self.tables))
        for k in range(self.dims):
            out += units[:, k : k + 1] * self.rotation[k]
        return (out / self.scale).reshape(len(units), self.tables, 8)

    def cells(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of y, lattice point) for each cell that the ball of radius r about a row may touch, its own first."""
        own = decoded(y)
        rest = y - own
        rows, cells = [np.arange(len(y))], [own]
        deep = np.flatnonzero((rest * rest).sum(axis=1) >= (1 - _REACH - 1e-6) ** 2)
        for at, vectors, least in ((np.arange(len(y)), self.near, self.near_at), (deep, self.far, self.far_at)):
            for a in range(0, len(at), 8192):
                part = at[a : a + 8192]
                along = rest[part] @ vectors.T
                for sign in (1.0, -1.0):
                    row, which = np.nonzero(sign * along >= least)
                    rows.append(part[row])
                    cells.append(own[part[row]] + sign * vectors[which])
        return np.concatenate(rows), np.concatenate(cells)

    def bucket(self, group: np.ndarray, number: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """A 64-bit hash of (label, table, lattice point)."""
        key = mixed(group.astype(np.int64).view(np.uint64) * _STEP + number.astype(np.uint64) + np.uint64(self.dims << 32))
        twice = np.rint(2 * cell).astype(np.int64).view(np.uint64)
        for k in range(8):
            key = mixed(key * _STEP + twice[:, k])
        return key.view(np.int64)


@functools.lru_cache(maxsize=8)
def _lattice(dims: int, threshold: float, seed: int) -> Lattice:
    return Lattice(dims, threshold, seed)


def _units(lists: pa.ListArray, dims: int) -> np.ndarray:
    x = np.asarray(lists.flatten()).astype(np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _registrations(threshold: float, seed: int):
    def register(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 2048):
                batch = whole.slice(begin, 2048)
                sizes = np.diff(np.asarray(batch.column("embedding").offsets))
                for dims in np.unique(sizes).tolist():
                    own = batch.filter(pa.array(sizes == dims))
                    lattice = _lattice(dims, threshold, seed)
                    y = lattice.points(_units(own.column("embedding"), dims))
                    row, cell = lattice.cells(y.reshape(-1, 8))
                    offset = np.clip(np.rint((y.reshape(-1, 8)[row] - cell) * _CODE), -127, 127).astype(np.int8)
                    vector, number = row // lattice.tables, row % lattice.tables
                    bucket = lattice.bucket(np.asarray(own.column("label"))[vector], number, cell)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), own.column("key").take(pa.array(vector)), pa.array(np.ascontiguousarray(offset).view(np.int64)[:, 0])], names=["bucket", "key", "code"])

    return register


def _groups(batches: Iterator[pa.RecordBatch], column: str, rows: int = 200_000) -> Iterator[pa.Table]:
    """Tables of whole groups from sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        both = pa.Table.from_batches(held)
        keys = np.asarray(both.column(column))
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield both.slice(0, cut)
        held = both.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The registrations that have another within the blocks' distance in their bucket, by the coordinates' codes."""
    # each of 16 code differences is off by at most half a step
    least = (2 * _REACH + 8**0.5 / _CODE + 1e-6) ** 2 * _CODE**2
    for part in _groups(batches, "bucket"):
        bucket = np.asarray(part.column("bucket"))
        code = np.ascontiguousarray(np.asarray(part.column("code")).astype(np.int64)).view(np.int8).reshape(-1, 8).astype(np.int16)
        met = np.zeros(len(bucket), bool)
        first, step = np.arange(len(bucket)), 0
        while True:
            step += 1
            first = first[first + step < len(bucket)]
            first = first[bucket[first] == bucket[first + step]]
            if not len(first):
                break
            off = (code[first] - code[first + step]).astype(np.int32)
            near = first[(off * off).sum(axis=1) <= least]
            met[near] = met[near + step] = True
        yield pa.RecordBatch.from_arrays([pa.array(bucket[met]), pa.array(np.asarray(part.column("key"))[met])], names=["bucket", "key"])


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Those of the links a - b that join what earlier ones have not."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[q] = p
            out.append((x, y))
    return out


def vector_links(vectors: DataFrame, *, threshold: float = 0.98, seed: int = 1, small: int = 1024, tile: int = 512) -> tuple[DataFrame, DataFrame]:
    """(key, n) and (a, b) of distinct vectors (key, label, embedding, copies): rows in other vectors linked with each, and
    links that join all that links join.

    Vectors of a label and length are linked if their cosine reaches the threshold; all of these are found. Registrations
    without another near their block's point go first (in buckets up to `small`; larger ones are kept whole). Of the others' buckets the
    vectors are compared, dealt to tiles of about `tile`, every two tiles in a task of their own. A pair can meet in several buckets and
    counts where the midpoint of its closest block lies. A task returns a count for each vector, and fewer links than vectors."""
    spark = vectors.sparkSession
    rows = materialize(vectors.select("key", "label", "embedding").mapInArrow(_registrations(threshold, seed), "bucket long, key long, code long"), "vector-cells")
    sizes = materialize(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "vector-buckets")
    pruned = rows.join(sizes.where(F.col("n") <= small), "bucket").select("bucket", "key", "code")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pruned = pruned.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_close, "bucket long, key long")
    left = materialize(pruned.unionByName(rows.join(sizes.where(F.col("n") > small), "bucket").select("bucket", "key")), "vector-near")
    tiles = materialize(left.groupBy("bucket").agg(F.ceil(F.count("*") / tile).alias("tiles")), "vector-tiles")
    dealt = left.join(tiles, "bucket").withColumn("part", F.pmod(F.xxhash64("key"), F.col("tiles")))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("part")).alias("one"), F.greatest(t, F.col("part")).alias("two")))
    roles = materialize(dealt.select("bucket", "key", "part", F.explode(others).alias("pair")).select("bucket", "pair.*", "part", "key"), "vector-roles")

    def compare(group: pa.Table) -> pa.Table:
        keys, label, copies, part = (np.asarray(group.column(c)) for c in ("key", "label", "copies", "part"))
        order = np.argsort(keys)
        keys, label, copies, part = keys[order], label[order], copies[order], part[order]
        lists = group.column("embedding").combine_chunks().take(pa.array(order))
        sizes = np.diff(np.asarray(lists.offsets))
        bucket, one, two = (group.column(c)[0].as_py() for c in ("bucket", "one", "two"))
        count, links = np.zeros(len(keys), np.int64), [(np.empty(0, np.int64),) * 2]
        for dims in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == dims)
            lattice = _lattice(dims, threshold, seed)
            x = _units(lists.take(pa.array(own)), dims)
            like = x @ x.T >= threshold
            like &= label[own][:, None] == label[own][None, :]
            if one != two:
                like &= part[own][:, None] != part[own][None, :]
            a, b = np.nonzero(np.triu(like, 1))
            if not len(a):
                continue
            y = lattice.points(x)
            kept = []
            for k in range(0, len(a), 8192):
                p, q = a[k : k + 8192], b[k : k + 8192]
                closest = ((y[p] - y[q]) ** 2).sum(axis=2).argmin(axis=1)
                middle = decoded((y[p, closest] + y[q, closest]) / 2)
                kept.append(lattice.bucket(label[own[p]], closest, middle) == bucket)
            here = np.concatenate(kept)
            a, b = own[a[here]], own[b[here]]
            np.add.at(count, a, copies[b])
            np.add.at(count, b, copies[a])
            links.append((a, b))
        a, b = (np.concatenate(z) for z in zip(*links))
        joined = spanning(len(keys), a, b)
        some = np.flatnonzero(count)
        out_a = np.concatenate([keys[some], keys[[p for p, _ in joined]] if joined else keys[:0]])
        out_b = pa.array([None] * len(some) + keys[[q for _, q in joined]].tolist() if joined else [None] * len(some), pa.int64())
        return pa.table({"a": pa.array(out_a.astype(np.int64)), "b": out_b, "n": pa.array(np.concatenate([count[some], np.zeros(len(joined), np.int64)]))})

    met = roles.join(vectors.select("key", "label", "embedding", "copies"), "key")
    found = materialize(met.groupBy("bucket", "one", "two").applyInArrow(compare, "a long, b long, n long"), "vector-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    return counts, found.where("b is not null").select("a", "b")


def near_vectors(rows: DataFrame, *, threshold: float = 0.98, **parameters) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, label, embedding): the rows of the same label linked with it,
    and the smallest vec_id that links reach; kept where that is its own.

    Equal vectors are linked, and are one until the end, however many there are. A vector that is null, empty or zero, or has a component
    that is null, infinite or no number, a null label and a null vec_id link with nothing: such a row has no links and itself as
    component. Vectors of different length are not linked. Rows that repeat a vec_id are rows of their own, with
    equal ids. An empty table gives no rows."""
    known = rows.select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    valid = known.where(good)
    distinct = materialize(valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("key", F.monotonically_increasing_id()), "vectors")
    counts, links = vector_links(distinct, threshold=threshold, **parameters)
    parts = materialize(connected_components(links), "vector-parts")
    of = distinct.select("key", "least").join(parts, F.col("key") == F.col("id"), "left").select("key", "least", F.coalesce("class_id", "key").alias("part"))
    least = of.groupBy("part").agg(F.min("least").alias("component_id"))
    told = of.join(materialize(least, "vector-least"), "part").join(counts.withColumnRenamed("n", "linked"), "key", "left").select("key", "component_id", F.coalesce("linked", F.lit(0)).alias("linked"))
    by_vector = materialize(distinct.join(told, "key").select("label", "embedding", (F.col("linked") + F.col("copies") - 1).alias("n_links"), "component_id"), "vector-told")
    found = valid.join(by_vector, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = known.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_vectors of `embeddings` with its default parameters."""
    return near_vectors(only(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding"))
