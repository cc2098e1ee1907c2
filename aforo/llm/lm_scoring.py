"""Stupid-backoff scores: n-gram count tables partitioned by hash, joined to the documents' n-grams, summed per document.

The rows of the relations are packed: a row of the exploded side has the distinct n-grams of one block of documents that
fall into one hash bucket, with their counts, as sorted arrays. Grouping by (order, bucket) sums these to the count table
and joins it back in the same step; what returns to a block is a count for each of its n-grams. So every n-gram crosses
the network once, in about six bytes. From order 3 on, an n-gram is exploded only where both (n-1)-grams within it reach the
model's least count: no other can, so nothing is lost. Blocks of text are files in the shared folder, which tasks read
by path, so texts are not shuffled."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, only, open_output, read_bytes, scratch_path, table
from .shingles import _STEP, mixed, word_hashes

def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, the words' 64-bit hashes in order); words are runs without space, tab, newline, vertical tab,
    form feed or carriage return."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    n, flat = np.diff(np.asarray(lists.offsets)).astype(np.int64), lists.flatten()
    empty = np.asarray(pc.equal(flat, ""))  # before a leading space, behind a trailing one, and of an empty text
    if empty.any():
        n -= np.bincount(np.repeat(np.arange(len(n)), n)[empty], minlength=len(n))
        flat = flat.filter(pa.array(~empty))
    return n, word_hashes(flat)


def ngram_hashes(tokens: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order the hashes of the n-grams that end at each token; where a text has fewer words before, 0."""
    out, position = [], np.arange(len(tokens)) - starts
    for n in range(1, order + 1):
        h = np.full(len(tokens), n, np.uint64)
        for k in range(n - 1, -1, -1):
            h = mixed(h * _STEP + np.roll(tokens, k))
        h |= np.uint64(1)  # 0 is for none
        out.append(np.where(position >= n - 1, h, np.uint64(0)))
    return out


def pack_sorted(values: np.ndarray) -> tuple[int, bytes]:
    """Differences of ascending 64-bit values in `size` bytes each. A larger difference is all ones there and follows,
    in 8 bytes, behind the others."""
    delta = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    size = 1
    while size < 8 and np.count_nonzero(delta >> np.uint64(8 * size)) * 64 > len(delta):
        size += 1
    mark = (1 << 8 * size) - 1
    over = delta >= np.uint64(mark) if size < 8 else np.zeros(len(delta), bool)
    head = np.where(over, np.uint64(mark), delta)
    return size, np.ascontiguousarray(head.view(np.uint8).reshape(-1, 8)[:, :size]).tobytes() + delta[over].tobytes()


def unpack_sorted(size: int, n: int, data: bytes) -> np.ndarray:
    full = np.zeros((n, 8), np.uint8)
    full[:, :size] = np.frombuffer(data, np.uint8, n * size).reshape(n, size)
    delta = full.view("<u8")[:, 0]
    if size < 8:
        delta[delta == np.uint64((1 << 8 * size) - 1)] = np.frombuffer(data, "<u8", -1, n * size)
    return np.cumsum(delta, dtype=np.uint64)


def _planes(counts: np.ndarray) -> bytes:
    """Byte by byte, so that the mostly empty high bytes compress to nothing."""
    return counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _counts(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8")[:, 0]


_BLOCKS = T.StructType([T.StructField("block", T.LongType()), T.StructField("path", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_bytes", T.LongType())])
_GRAMS = T.StructType([T.StructField("block", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("grams", T.BinaryType()), T.StructField("counts", T.BinaryType())])
_ANSWERS = T.StructType([T.StructField("block", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("counts", T.BinaryType())])
_SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_backoff", T.LongType()), T.StructField("log_score", T.DoubleType())])


def document_blocks(docs: DataFrame, folder: str, block_chars: int) -> DataFrame:
    """Whole documents in files of about block_chars characters (a longer document has its own); returns their list
    (block, path, n_words, n_bytes), written, so that a task that ran twice leaves a file that no row names."""
    import pyarrow.ipc as ipc

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, texts, size = TaskContext.get().partitionId() << 24, [], [], 0

        def row() -> pa.RecordBatch:
            nonlocal number, ids, texts, size
            url, held = f"{folder}/{uuid.uuid4().hex}.arrow", pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())})
            with open_output(url) as f, ipc.new_stream(f, held.schema, options=ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(held)
            told = [number], [url], [sum(len(t.encode().split()) for t in texts)], [sum(len(t.encode()) for t in texts)]
            number, ids, texts, size = number + 1, [], [], 0
            return pa.RecordBatch.from_arrays(list(map(pa.array, told)), names=_BLOCKS.names)

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                texts.append(t.as_py() or "")
                size += len(texts[-1]) + 16
                if size >= block_chars:
                    yield row()
        if ids:
            yield row()

    return materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, _BLOCKS), "lm-blocks")


def _read_block(url: str) -> tuple[pa.Array, pa.Array]:
    import pyarrow.ipc as ipc

    t = ipc.open_stream(read_bytes(url)).read_all()
    return t.column("doc_id").combine_chunks(), t.column("text").combine_chunks()


def _block_grams(texts: pa.Array, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    n, tokens = hashed_words(texts)
    return n, ngram_hashes(tokens, np.repeat(np.cumsum(n) - n, n), order)


def _block_counts(hashes: list[np.ndarray], answers: pa.Table, min_count: int) -> list[np.ndarray]:
    """For each order that the answers cover, the corpus count of the n-gram that ends at each token; 0 where it was not asked for."""
    got = sorted(zip(answers.column("n").to_pylist(), answers.column("bucket").to_pylist(), answers.column("counts").to_pylist()), key=lambda x: x[:2])
    out: list[np.ndarray] = []
    for n, h in enumerate(hashes, 1):
        found = [_counts(c) for m, _, c in got if m == n]
        asked = _asked(h, n, out, min_count)
        counts = np.zeros(len(h))
        if found:
            _, where = np.unique(h[asked], return_inverse=True)
            counts[asked] = np.concatenate(found)[where]
        out.append(counts)
    return out


def _asked(h: np.ndarray, n: int, counts: list[np.ndarray], min_count: int) -> np.ndarray:
    """Which n-grams can reach min_count: from order 3 on those whose first and last n-1 words do."""
    if n < 3:
        return h > 0
    often = counts[n - 2] >= min_count
    return (h > 0) & often & np.roll(often, 1)


def _cuts(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range of the 64-bit space begins in ascending hashes."""
    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(grams, edges), [len(grams)]])


def _packed(block: int, n: int, h: np.ndarray, buckets: int) -> list[dict]:
    grams, counts = np.unique(h, return_counts=True)
    at, rows = _cuts(grams, buckets), []
    for k in range(buckets):
        if at[k] < at[k + 1]:
            size, data = pack_sorted(grams[at[k] : at[k + 1]])
            rows.append({"block": block, "n": n, "bucket": k, "size": size, "grams": data, "counts": _planes(counts[at[k] : at[k + 1]])})
    return rows


def _joined(batch: pa.Table) -> pa.Table:
    """The count table of one (order, bucket), joined to the n-grams of each block in it."""
    own = [_counts(c) for c in batch.column("counts").to_pylist()]
    grams = [unpack_sorted(s, len(c), d) for s, c, d in zip(batch.column("size").to_pylist(), own, batch.column("grams").to_pylist())]
    known, where = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(where, weights=np.concatenate(own), minlength=len(known)).astype("<u8")[where]
    ends = np.cumsum([len(g) for g in grams])
    return pa.table({"block": batch.column("block"), "n": batch.column("n"), "bucket": batch.column("bucket"), "counts": pa.array([_planes(total[a:b]) for a, b in zip([0, *ends], ends)], pa.binary())})


def counted(blocks: DataFrame, order: int, buckets: int, min_count: int) -> DataFrame:
    """(block, n, bucket, counts): the corpus counts of each block's n-grams, in the order of their hashes.

    There are thrice as many partitions as keys, so that few tasks get more than one or two."""
    from pyspark.sql.pandas.types import to_arrow_schema

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for n, h in enumerate(_block_grams(_read_block(url)[1], min(order, 2))[1], 1):
                    yield pa.RecordBatch.from_pylist(_packed(block, n, h[h > 0], buckets), schema=to_arrow_schema(_GRAMS))

    def longer(n: int):
        def explode(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            hashes = _block_grams(_read_block(left.column("path")[0].as_py())[1], n)[1]
            counts = _block_counts(hashes[:-1], right, min_count)
            return pa.Table.from_pylist(_packed(key[0].as_py(), n, hashes[-1][_asked(hashes[-1], n, counts, min_count)], buckets), schema=to_arrow_schema(_GRAMS))

        return explode

    listed = blocks.select("block", "path")
    spread = listed.repartition(max(1, blocks.count()), "block")
    answers = materialize(spread.mapInArrow(first, _GRAMS).repartition(6 * buckets, "n", "bucket").groupBy("n", "bucket").applyInArrow(_joined, _ANSWERS), "lm-counts")
    for n in range(3, order + 1):
        grams = listed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(longer(n), _GRAMS)
        answers = answers.unionByName(materialize(grams.repartition(3 * buckets, "n", "bucket").groupBy("n", "bucket").applyInArrow(_joined, _ANSWERS), "lm-counts"))
    return answers


def stupid_backoff(docs: DataFrame, *, order: int = 3, alpha: float = 0.4, min_count: int = 2, block_chars: int = 6_000_000, bucket_bytes: int = 16_000_000) -> DataFrame:
    """(doc_id, n_words, n_backoff, log_score) for each row of (doc_id, text), by a model of all of them.

    Counts are over all rows. A word's score is count(n-gram) / count(its first n-1 words) for the longest n <= order whose
    count is at least min_count, times alpha for each order given up; a single word's is count / words of the corpus,
    whatever its count. min_count is 2, as every n-gram of a document has its own count: with 1 no word is ever backed off
    and a document's score says nothing of the others. log_score sums natural logarithms; n_backoff counts words scored below the order that their
    position allows. A null or empty text scores 0 with 0 words; repeated rows are counted and scored each; an empty table
    gives no rows. Hash buckets grow with the input, so a task gets a bounded part of the n-grams."""
    blocks = document_blocks(docs, scratch_path(docs.sparkSession, "lm-texts"), block_chars)
    total, size = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    answers = counted(blocks, order, max(8, -(-size // bucket_bytes)), min_count)

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = _read_block(left.column("path")[0].as_py())
        length, hashes = _block_grams(texts, order)
        counts = _block_counts(hashes, right, min_count)
        words = len(hashes[0])
        value, used = np.log(counts[0]) - np.log(total) if words else np.empty(0), np.ones(words, np.int64)
        for n in range(2, order + 1):
            seen = counts[n - 1] >= min_count
            context = np.roll(counts[n - 2], 1)  # the n-1 words before end one token earlier
            with np.errstate(divide="ignore", invalid="ignore"):
                value = np.where(seen, np.log(counts[n - 1]) - np.log(context), value + np.where(hashes[n - 1] > 0, np.log(alpha), 0.0))
            used = np.where(seen, n, used)
        possible = np.sum([h > 0 for h in hashes], axis=0) if words else used
        of = np.repeat(np.arange(len(ids)), length)
        return pa.table({"doc_id": ids, "n_words": pa.array(length), "n_backoff": pa.array(np.bincount(of, weights=used < possible, minlength=len(ids)).astype(np.int64)), "log_score": pa.array(np.bincount(of, weights=value, minlength=len(ids)))})

    return blocks.select("block", "path").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, _SCORES)


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stupid_backoff of `documents` by a trigram model of all of them, log_score to four digits."""
    scored = stupid_backoff(only(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return scored.select("doc_id", "n_words", "n_backoff", F.round("log_score", 4).alias("log_score"))
