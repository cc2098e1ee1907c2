"""Token-ID / binary output: patched frame-of-reference blocks.

One file holds consecutive documents. Layout, little-endian:
  magic "PFB1", u32 block size, u64 ids, u32 blocks, u32 documents
  documents x (i64 id, u8 has-id, u32 ids)            the document table, in order
  blocks x (u64 offset from the first block)            the index of block starts
  blocks, each: u32 minimum, u8 width, u16 exceptions, packed low bits, u16 positions, u32 high parts
A block keeps id - minimum. Its width is that of a percentile of these; what a larger value has above the width goes
to the exception list.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, only, open_output, read_bytes, scratch_path, table
from .segments import byte_batches, only_lone_spaces, split_at_spaces, utf8_sizes

MAGIC, BLOCK = b"PFB1", 512
_HEAD = struct.Struct("<4sIQII")
_tokenizers: dict[tuple[str, int], tuple] = {}


# --- the format -----------------------------------------------------------------------------------------------


def _pieces(w: int):
    """Where the bits of 8 values of w bits lie in their w bytes: (value, byte, left shift of the value against the byte)."""
    return [(i, k, i * w - 8 * k) for i in range(8) for k in range(i * w // 8, -(-(i + 1) * w // 8))]


def _packed(low: np.ndarray, w: int) -> np.ndarray:
    """(blocks, values) below 2**w as (blocks, bytes), value by value from the lowest bit."""
    v = low.reshape(-1, 8)
    out = np.zeros((len(v), w), np.uint8)
    for i, k, shift in _pieces(w):
        out[:, k] |= ((v[:, i] << np.uint32(shift)) if shift >= 0 else (v[:, i] >> np.uint32(-shift))).astype(np.uint8)
    return out.reshape(len(low), -1)


def _unpacked(raw: np.ndarray, w: int) -> np.ndarray:
    b = raw.reshape(-1, w).astype(np.uint32)
    out = np.zeros((len(b), 8), np.uint32)
    for i, k, shift in _pieces(w):
        out[:, i] |= (b[:, k] >> np.uint32(shift)) if shift >= 0 else (b[:, k] << np.uint32(-shift))
    return (out & np.uint32((1 << w) - 1)).reshape(len(raw), -1)


def pack_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = 0.9) -> list[bytes]:
    """The blocks of the ids; the last one is filled up with its own first id, which the count in the header cuts off."""
    if not len(ids):
        return []
    n = -(-len(ids) // block)
    full = np.concatenate([ids, np.full(n * block - len(ids), ids[(n - 1) * block], ids.dtype)]).astype(np.uint32).reshape(n, block)
    low = full.min(axis=1)
    rest = full - low[:, None]
    at = min(block - 1, int(np.ceil(percentile * block)) - 1)
    pivot = np.partition(rest, at, axis=1)[:, at]
    width = np.ceil(np.log2(pivot.astype(np.float64) + 1)).astype(np.uint8)
    out: list[bytes] = [b""] * n
    for w in np.unique(width):
        w = int(w)
        which = np.flatnonzero(width == w)
        for part in np.array_split(which, -(-len(which) // 2048)):
            r = rest[part]
            packed = _packed(r & np.uint32((1 << w) - 1), w) if w else None
            high = r >> np.uint32(w) if w < 32 else np.zeros_like(r)
            rows, where = np.nonzero(high)
            cut = np.searchsorted(rows, np.arange(len(part) + 1))
            where, high = where.astype("<u2"), high[rows, where].astype("<u4")
            for j, b in enumerate(part):
                x, y = cut[j], cut[j + 1]
                out[b] = struct.pack("<IBH", low[b], w, y - x) + (packed[j].tobytes() if w else b"") + where[x:y].tobytes() + high[x:y].tobytes()
    return out


def unpack_blocks(data: memoryview, starts: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The ids of the blocks that start at these offsets."""
    raw = np.frombuffer(data, np.uint8)
    n = len(starts)
    out = np.empty((n, block), np.uint32)
    if not n:
        return out.reshape(-1)
    head = raw[starts[:, None] + np.arange(7)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0]
    width = head[:, 4]
    odd = np.ascontiguousarray(head[:, 5:7]).view("<u2")[:, 0]
    for w in np.unique(width):
        w = int(w)
        which = np.flatnonzero(width == w)
        size = block * w // 8
        for part in np.array_split(which, -(-len(which) // 2048)):
            v = _unpacked(raw[starts[part][:, None] + 7 + np.arange(size)], w) if w else np.zeros((len(part), block), np.uint32)
            for j in np.flatnonzero(odd[part]):
                k, a = int(odd[part[j]]), int(starts[part[j]]) + 7 + size
                v[j, np.frombuffer(data, "<u2", k, a)] |= np.frombuffer(data, "<u4", k, a + 2 * k) << np.uint32(w)
            out[part] = v + low[part][:, None]
    return out.reshape(-1)


def encode_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK, percentile: float = 0.9) -> bytes:
    blocks = pack_blocks(ids, block, percentile)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks])])[: len(blocks)].astype("<u8")
    docs = np.zeros(len(doc_ids), np.dtype([("id", "<i8"), ("has", "u1"), ("n", "<u4")]))
    docs["id"], docs["has"], docs["n"] = [x or 0 for x in doc_ids], [x is not None for x in doc_ids], lengths
    return b"".join([_HEAD.pack(MAGIC, block, len(ids), len(blocks), len(doc_ids)), docs.tobytes(), starts.tobytes(), *blocks])


def decode_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, their numbers of ids, all ids)."""
    magic, block, n, blocks, docs = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    kind = np.dtype([("id", "<i8"), ("has", "u1"), ("n", "<u4")])
    listed = np.frombuffer(data, kind, docs, _HEAD.size)
    at = _HEAD.size + docs * kind.itemsize
    starts = np.frombuffer(data, "<u8", blocks, at).astype(np.int64)
    ids = unpack_blocks(memoryview(data)[at + 8 * blocks :], starts, block)[:n]
    if len(ids) != n or int(listed["n"].sum()) != n:
        raise ValueError("the token file's counts disagree")
    return [i if h else None for i, h in zip(listed["id"].tolist(), listed["has"].tolist())], listed["n"], ids


def read_document(data: bytes, ordinal: int) -> np.ndarray:
    """The ids of one document, decoding only the blocks that hold them."""
    _, block, n, blocks, docs = _HEAD.unpack_from(data)
    kind = np.dtype([("id", "<i8"), ("has", "u1"), ("n", "<u4")])
    ends = np.cumsum(np.frombuffer(data, kind, docs, _HEAD.size)["n"].astype(np.int64))
    b = int(ends[ordinal])
    a = int(ends[ordinal - 1]) if ordinal else 0
    at = _HEAD.size + docs * kind.itemsize
    starts = np.frombuffer(data, "<u8", blocks, at).astype(np.int64)
    first, last = a // block, -(-b // block)
    return unpack_blocks(memoryview(data)[at + 8 * blocks :], starts[first:last], block)[a - first * block : b - first * block]


# --- encoding ---------------------------------------------------------------------------------------------------


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Known:
    """Encodings of parts seen before, back to back in one array, and the number of each part: of those at a text's start
    (`first`) and of those behind a space (`later`). Number 0 is the end id alone. Emptied when the parts are many or long."""

    def __init__(self, end_id: int, max_parts: int = 1_000_000, max_chars: int = 20_000_000):
        self.end_id, self.max_parts, self.max_chars = end_id, max_parts, max_chars
        self.empty()

    def empty(self) -> None:
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}
        self.ids, self.cuts, self.chars = np.array([self.end_id], np.uint32), np.array([0, 1], np.int64), 0

    def add(self, where: dict[str, int], parts: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        where.update(zip(parts, range(len(self.cuts) - 1, len(self.cuts) - 1 + len(parts))))
        self.ids = np.concatenate([self.ids, ids])
        self.cuts = np.concatenate([self.cuts, self.cuts[-1] + np.cumsum(sizes)])
        self.chars += sum(map(len, parts))

    def trim(self) -> None:
        if self.chars > self.max_chars or len(self.cuts) > self.max_parts:
            self.empty()

    def sizes(self, numbers: np.ndarray) -> np.ndarray:
        return self.cuts[numbers + 1] - self.cuts[numbers]

    def joined(self, numbers: np.ndarray, sizes: np.ndarray, step: int = 200_000) -> np.ndarray:
        """The ids of these parts one behind the other."""
        out = [np.empty(0, np.uint32)]
        for a in range(0, len(numbers), step):
            n = sizes[a : a + step]
            ends = np.cumsum(n)
            out.append(self.ids[np.repeat(self.cuts[numbers[a : a + step]] - (ends - n), n) + np.arange(ends[-1])])
        return np.concatenate(out)


def _tokenizer(path: str, end_id: int):
    """The worker's tokenizer, which of its tokens begin with a space, and what it has encoded."""
    if (path, end_id) not in _tokenizers:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share out the cores
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        starts = np.zeros(t.get_vocab_size() + 1, bool)
        for token, number in t.get_vocab().items():
            starts[number] = token.startswith("Ġ")
        _tokenizers[path, end_id] = t, starts, _Known(end_id)
    return _tokenizers[path, end_id]


def _encoded(tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, how many each text has)."""
    found = [x.ids for a, b in byte_batches(utf8_sizes(texts), 500_000) for x in tokenizer.encode_batch_fast(texts[a:b], add_special_tokens=False)]
    return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))


def _encoded_words(tokenizer, starts: np.ndarray, words: list[str], run: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """_encoded of each word behind a space. Words without a space inside are encoded in runs, as a text of them: each
    begins with a token that holds the space, and no other token does."""
    ids, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
    runs = [words[i : i + run] for i in range(0, len(words), run)]
    for own, found in zip(runs, tokenizer.encode_batch_fast([" " + " ".join(r) for r in runs], add_special_tokens=False)):
        all_ids = np.array(found.ids, np.uint32)
        at = np.flatnonzero(starts[all_ids])
        n = np.diff(at, append=len(all_ids))
        if len(at) != len(own):
            all_ids, n = _encoded(tokenizer, [" " + w for w in own])
        ids.append(all_ids)
        sizes.append(n)
    return np.concatenate(ids), np.concatenate(sizes)


_MARKS = ".,!?;:"  # a letter before one of these always ends a pre-token, and a run of these up to a space is one


def _add_words(tokenizer, starts: np.ndarray, known: _Known, new: list[str]) -> None:
    """Encode parts behind a space that are not known. What ends in punctuation shares the encoding of its word with other endings."""
    later, first = known.later, known.first
    spaced, words, ended = [], set(), []
    for x in new:
        if " " in x:
            spaced.append(x)
        elif x[-1:] in _MARKS and (core := x.rstrip(_MARKS))[-1:].isalpha():
            ended.append((x, core, x[len(core) :]))
            if core not in later:
                words.add(core)
        else:
            words.add(x)
    known.add(later, spaced, *_encoded(tokenizer, [" " + x for x in spaced]))
    known.add(later, (listed := list(words)), *_encoded_words(tokenizer, starts, listed))
    tails = list({t for _, _, t in ended if t not in first})
    known.add(first, tails, *_encoded(tokenizer, tails))
    pairs = np.array([(later[c], first[t]) for _, c, t in ended], np.int64).reshape(-1, 2)
    sizes = known.sizes(pairs)
    known.add(later, [x for x, _, _ in ended], known.joined(pairs.ravel(), sizes.ravel()), sizes.sum(axis=1))


def _parts(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """(the parts of all texts, where each text's begin, with the end): cut at lone spaces."""
    plain = np.array([only_lone_spaces(t) for t in texts], bool)
    lists = pc.split_pattern(pa.array([t for t, ok in zip(texts, plain) if ok], pa.string()), " ")
    if not plain.all():
        odd = pa.array([split_at_spaces(t) for t, ok in zip(texts, plain) if not ok], pa.list_(pa.string()))
        place = np.empty(len(texts), np.int64)
        place[np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])] = np.arange(len(texts))
        lists = pa.concat_arrays([lists, odd]).take(pa.array(place))
    return lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _numbers(parts: pa.Array, where: dict[str, int], add) -> np.ndarray:
    """The number of each part; `add` is given the list of those that have none, each once."""
    coded = parts.dictionary_encode()
    unlike = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    add([x for x in unlike if x not in where])
    return np.fromiter(map(where.__getitem__, unlike), np.int64, len(unlike))[coded.indices.to_numpy()]


def encode_texts(texts: list[str], path: str, end_id: int, batch_bytes: int = 4_000_000) -> Iterator[bytes]:
    """For each text its ids as little-endian u32, with the end id; as the library encodes the whole text.

    Texts are cut at lone spaces, where the byte-level pre-tokenizer always starts a new word. Of a batch's parts only unlike
    ones are looked up, and the ids of all are put together at once."""
    tokenizer, starts, known = _tokenizer(path, end_id)
    for a, b in byte_batches(utf8_sizes(texts), batch_bytes):
        parts, cuts = _parts(texts[a:b])
        heads = np.zeros(len(parts), bool)
        heads[cuts[:-1]] = True
        numbers = np.zeros(len(parts) + b - a, np.int64)  # each text's parts, and 0 for its end
        inside = np.ones(len(numbers), bool)
        inside[cuts[1:] + np.arange(b - a)] = False
        own = np.empty(len(parts), np.int64)
        own[heads] = _numbers(parts.filter(pa.array(heads)), known.first, lambda new: known.add(known.first, new, *_encoded(tokenizer, new)))
        own[~heads] = _numbers(parts.filter(pa.array(~heads)), known.later, lambda new: _add_words(tokenizer, starts, known, new))
        numbers[inside] = own
        sizes = known.sizes(numbers)
        raw = known.joined(numbers, sizes).astype("<u4", copy=False).tobytes()
        ends = 4 * np.cumsum(sizes)[cuts[1:] + np.arange(b - a)]
        for x, y in zip([0, *ends[:-1].tolist()], ends.tolist()):
            yield raw[x:y]
        known.trim()


_MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("n_ids", T.LongType()), T.StructField("n_docs", T.LongType()), T.StructField("n_bytes", T.LongType())])


def write_token_files(docs: DataFrame, folder: str, *, tokenizer_path: str | None = None, end_id: int = 2, ids_per_file: int = 4_000_000, block: int = BLOCK, percentile: float = 0.9, range_bytes: int = 128_000_000) -> DataFrame:
    """Encode and write every document in ascending doc_id order; returns the manifest (path, part, seq, n_ids, n_docs, n_bytes).

    The rows are range-partitioned by doc_id and the text's beginning, so file order (part, seq) is document order; where the session's
    shuffle partitions would hold more than range_bytes of text each, there are as many more as that takes. A file's name has a random
    part: a task that runs twice leaves a file that no manifest names. A null text is empty (the end id alone); a null
    doc_id sorts first; rows with equal doc_id are ordered by text; an empty table gives an empty manifest."""
    path = tokenizer_path or default_tokenizer()
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # the first characters never contradict the order of whole texts, so rows that share a doc_id can lie in several ranges
    keys = [F.col("doc_id"), F.substring("text", 1, 32)]
    given = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    needed = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // range_bytes)
    ordered = (rows.repartitionByRange(needed, *keys) if needed > given else rows.repartitionByRange(*keys)).sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        sizes: list[int] = []
        held: list[bytes] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, sizes, held, total, seq
            ids = np.frombuffer(b"".join(held), "<u4")
            data = encode_file(keys, np.array(sizes, np.uint32), ids, block, percentile)
            url = f"{folder}/part-{part:06d}-{seq:04d}-{uuid.uuid4().hex[:12]}.pfb"
            with open_output(url) as f:
                f.write(data)
            row = pa.RecordBatch.from_pydict({"path": [url], "part": [part], "seq": [seq], "n_ids": [len(ids)], "n_docs": [len(keys)], "n_bytes": [len(data)]}, schema=_arrow(_MANIFEST))
            keys, sizes, held, total, seq = [], [], [], 0, seq + 1
            return row

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for key, enc in zip(batch.column(0).to_pylist(), encode_texts(texts, path, end_id)):
                keys.append(key)
                sizes.append(len(enc) // 4)
                held.append(enc)
                total += len(enc) // 4
                if total >= ids_per_file:
                    yield flush()
        if keys:
            yield flush()

    return materialize(ordered.mapInArrow(write, _MANIFEST), "token-manifest")


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


_DIGEST = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of a manifest.

    start counts the ids of all documents before it. Only the manifest, a row a file, is ordered as a whole."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", before.alias("before")).repartition(max(1, manifest.count()), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, sizes, ids = decode_file(read_bytes(url))
                ends = np.cumsum(sizes.astype(np.int64))
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start + ends - sizes, pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())], names=_DIGEST.names)

    return files.mapInArrow(read, _DIGEST)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_token_files of the files that write_token_files makes of `documents`. Rows that repeat a doc_id, null included, are ordered
    by text; of these only such as begin with the same 32 characters need lie in one range."""
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    return read_token_files(write_token_files(docs, scratch_path(spark, "token-files")))
