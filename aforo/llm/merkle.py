"""Merkle manifest of a dataset that stores every few levels of its trees and computes the others anew.

Each language has a binary tree over its documents' digests, in doc_id order, and one more tree joins the languages' roots. A node
is the digest of its one or two children. Of a tree only the leaves and every `every`-th level above them are written; what lies
between is computed from the stored nodes below, a subtree of at most 2^every stored nodes at a time, and dropped again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, only, table

_PATH = "array<struct<side:int,digest:string>>"
_LEFT, _RIGHT, _NONE = 1, 2, 0


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(n_chars: Column) -> Column:
    """The digest of a document's record: each field as its UTF-8 length, a colon and its value, or `-` if null."""
    return F.sha2(F.concat(*map(_field, (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")))), 256)


def tree_key(lang: Column) -> Column:
    """The language's tree; the key of null comes first, and no language shares it."""
    return F.when(lang.isNull(), "-").otherwise(F.concat(F.lit("="), lang))


def positioned(rows: DataFrame, by: str, *order: str, per_part: int = 500_000) -> DataFrame:
    """Written rows with pos (the row's place among those of its `by`, from 0) and n_nodes (how many these are).

    Rows are dealt to ranges of the whole order, which their file and row number complete, so a `by` or an order value that many
    rows share is split as well. Each range tells how many rows of a `by` it has, and the sums of these are the offsets."""
    place = [F.col(by), *[F.col(c).asc_nulls_first() for c in order], "_file", "_row"]
    known = rows.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    parts = -(-rows.count() // per_part) or 1
    dealt = materialize(known.repartitionByRange(parts, *place).sortWithinPartitions(*place).drop("_file", "_row").withColumn("seq", F.monotonically_increasing_id()), "merkle-order")
    dealt = dealt.withColumn("part", F.shiftright("seq", 33))
    held = dealt.groupBy(by, "part").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    before = F.sum("n").over(Window.partitionBy(by).orderBy("part")) - F.col("n")
    held = held.select(by, "part", "first", before.alias("before"), F.sum("n").over(Window.partitionBy(by)).alias("n_nodes"))
    return dealt.join(held, [by, "part"]).withColumn("pos", F.col("seq") - F.col("first") + F.col("before")).drop("seq", "part", "first", "before")


def _height(n: int) -> int:
    """Levels from n nodes up to one."""
    return (n - 1).bit_length()


def _subtree(level: list[str], steps: int) -> list[list[str]]:
    """The given nodes and those of `steps` levels above them; a node without a neighbour is digested alone."""
    levels = [level]
    for _ in range(steps):
        level = [hashlib.sha256("".join(level[k : k + 2]).encode()).hexdigest() for k in range(0, len(level), 2)]
        levels.append(level)
    return levels


def _chunks(nodes: DataFrame, every: int, *more: str) -> DataFrame:
    """(tree, chunk, n_nodes, nodes): the aligned runs of 2^every nodes of a stored level, in order."""
    return nodes.groupBy("tree", F.shiftright("pos", every).alias("chunk")).agg(F.first("n_nodes").alias("n_nodes"), F.sort_array(F.collect_list(F.struct("pos", "digest", *more))).alias("nodes"))


def _stored_above(nodes: DataFrame, every: int) -> DataFrame:
    """The next stored level: the root of each aligned run of nodes, or the root itself again where a tree has ended."""

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = [min(every, _height(n)) for n in batch.column("n_nodes").to_pylist()]
            digests = [_subtree([x["digest"] for x in run], s)[-1][0] for run, s in zip(batch.column("nodes").to_pylist(), steps)]
            left = [-(-n >> s) for n, s in zip(batch.column("n_nodes").to_pylist(), steps)]
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("chunk"), pa.array(left, pa.int64()), pa.array(digests, pa.string())], names=["tree", "pos", "n_nodes", "digest"])

    return _chunks(nodes, every).mapInArrow(climb, "tree string, pos long, n_nodes long, digest string")


def _levels(leaves: DataFrame, every: int) -> list[DataFrame]:
    """The stored levels, from the leaves to the one with a single node for each tree."""
    out = [leaves]
    while (out[-1].agg(F.max("n_nodes")).first()[0] or 0) > 1:
        out.append(materialize(_stored_above(out[-1], every), "merkle-level"))
    return out


def _paths(nodes: DataFrame, above: DataFrame, every: int, *more: str) -> DataFrame:
    """(tree, pos, digest, path, subroot, root, more...) of each node of a stored level: the siblings on its way up.

    above has these for the roots of the aligned runs, by (tree, pos). A run's interior nodes are computed anew from the stored ones."""
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    schema = f"tree string, pos long, digest string, path {_PATH}, subroot string, root string" + "".join(f", {c} {kinds[c]}" for c in more)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 16):
                yield siblings(whole.slice(at, 16))

    def siblings(batch: pa.RecordBatch) -> pa.RecordBatch:
        known: list[str] = [""]
        rows: list[np.ndarray] = []
        sides: list[np.ndarray] = []
        sizes: list[int] = []
        lists = batch.column("nodes")
        flat = lists.flatten()
        own = flat.field("digest").to_pylist()
        ends = np.cumsum(np.diff(np.asarray(lists.offsets)))
        for n, end, begin, path in zip(batch.column("n_nodes").to_pylist(), ends.tolist(), [0, *ends.tolist()], batch.column("path").to_pylist()):
            count = end - begin
            levels = _subtree(own[begin:end], min(every, _height(n)))
            index, side = np.zeros((count, len(levels) - 1 + len(path)), np.int64), np.zeros((count, len(levels) - 1 + len(path)), np.int32)
            place = np.arange(count)
            for k, level in enumerate(levels[:-1]):
                other = (place >> k) ^ 1
                there = other < len(level)
                index[:, k] = np.where(there, len(known) + other, 0)
                side[:, k] = np.where(there, np.where(other & 1, _RIGHT, _LEFT), _NONE)
                known += level
            for k, step in enumerate(path, len(levels) - 1):
                index[:, k], side[:, k] = len(known), step["side"]
                known.append(step["digest"])
            rows.append(index.ravel())
            sides.append(side.ravel())
            sizes += [index.shape[1]] * count
        digests = pa.array(known, pa.string()).take(pa.array(np.concatenate(rows)))
        steps = pa.StructArray.from_arrays([pa.array(np.concatenate(sides)), digests], names=["side", "digest"])
        paths = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), steps)
        of = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(np.concatenate([[0], ends]))))
        shared = [batch.column(c).take(of) for c in ("tree", "subroot", "root")]
        return pa.RecordBatch.from_arrays([shared[0], flat.field("pos"), flat.field("digest"), paths, *shared[1:], *[flat.field(c) for c in more]], names=["tree", "pos", "digest", "path", "subroot", "root", *more])

    own = above.select("tree", F.col("pos").alias("chunk"), "path", "subroot", "root")
    return _chunks(nodes, every, *more).join(own, ["tree", "chunk"]).mapInArrow(walk, schema)


@dataclass
class Manifest:
    """The stored levels of the languages' trees and of the tree above them, each (tree, pos, n_nodes, digest), leaves first;
    the leaves also have doc_id and the digest `given` that is to be verified."""

    levels: list[DataFrame]
    top: list[DataFrame]
    every: int

    @property
    def subroots(self) -> DataFrame:
        """(tree, digest) of each language."""
        return self.levels[-1].select("tree", "digest")

    @property
    def root(self) -> DataFrame:
        """One row with the digest of all; none for an empty table."""
        return self.top[-1].select("digest")

    def proofs(self) -> DataFrame:
        """(doc_id, leaf, subroot, root, proof, given): for each document its siblings from the leaf to the root."""
        root = F.col("digest")
        above = self.top[-1].select("tree", "pos", F.lit(None).cast(_PATH).alias("path"), root.alias("subroot"), root.alias("root"))
        above = above.withColumn("path", F.coalesce("path", F.array().cast(_PATH)))
        for level in reversed(self.top[1:-1]):
            above = materialize(_paths(level, above, self.every), "merkle-paths")
        first = self.top[0]
        if len(self.top) > 1:
            found = materialize(_paths(first, above, self.every, "lang_tree"), "merkle-paths")
        else:
            found = above.join(first.select("tree", "lang_tree"), "tree")
            found = found.withColumn("digest", F.col("root"))
        above = found.select(F.col("lang_tree").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root")
        for level in reversed(self.levels[1:-1]):
            above = materialize(_paths(level, above, self.every), "merkle-paths")
        if len(self.levels) > 1:
            found = _paths(self.levels[0], above, self.every, "doc_id", "given")
        else:  # each language has one leaf
            found = above.join(self.levels[0].select("tree", "digest", "doc_id", "given"), "tree")
        return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.col("path").alias("proof"), "given")


def manifest(docs: DataFrame, given: Column | None = None, *, every: int = 8) -> Manifest:
    """The manifest of (doc_id, source, lang, n_chars, text); `given` is the digest to be verified in a document's place (its own if null).

    Null fields have a digest of their own, a null lang is a language, and null doc_ids come first. Rows of one language and
    doc_id are ordered by their digest, and equal ones are leaves like any. An empty table has no root."""
    own = leaf_digest(F.col("n_chars"))
    leaves = docs.select(tree_key(F.col("lang")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), own.alias("digest"), F.coalesce(F.lit(None).cast("string") if given is None else given, own).alias("given"))
    placed = positioned(materialize(leaves, "merkle-leaves"), "tree", "doc_id", "digest")
    levels = _levels(materialize(placed.select("tree", "pos", "n_nodes", "digest", "doc_id", "given"), "merkle-level"), every)
    subroots = materialize(levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("lang_tree"), "digest"), "merkle-subroots")
    top = positioned(subroots, "tree", "lang_tree").select("tree", "pos", "n_nodes", "digest", "lang_tree")
    return Manifest(levels, _levels(materialize(top, "merkle-level"), every), every)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf digest and its siblings give."""

    def step(got: Column, by: Column) -> Column:
        return F.sha2(F.when(by.side == _LEFT, F.concat(by.digest, got)).when(by.side == _RIGHT, F.concat(got, by.digest)).otherwise(got), 256)

    return F.aggregate(proof, start, step)


def siblings_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda p: p.digest), ""), 256)


def tampered_digest() -> Column:
    """The digest of a document with one character more, where 7 divides the CRC of its doc_id; else null."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf_digest(F.col("n_chars") + 1))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each row of `documents`: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, where some rows are tampered with.

    Nulls, ties, repeated rows and an empty table as in manifest()."""
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "source", "lang", "n_chars", "text")
    proofs = manifest(docs, tampered_digest()).proofs()
    found = proofs.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("proof")).alias("proof_sha256"), folded(F.col("given"), F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
