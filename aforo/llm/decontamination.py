"""Benchmark decontamination on a distributed positional inverted index.

The training texts are indexed in shards of whole documents: a shard has, for each term, the ascending positions of its
tokens. Test phrases are a table, too; each goes, by its rarest term in the corpus, to the shards that have this term. There the
offset-adjusted lists of its terms are intersected. Postings are never regrouped by term across shards, so a frequent term is no
hot key, and nothing of either side passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, only, table

GAP = 64  # positions left free between documents: no phrase or neighbourhood spans two
_WORD_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, then runs of ASCII letters and digits and of all other characters from U+0080 on."""
    return text.encode().lower().translate(_WORD_BYTES).split()


# --- the index ---------------------------------------------------------------------------------------------------

_INDEX = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("shard", T.LongType()), T.StructField("term", T.BinaryType()), T.StructField("n", T.LongType()),
    T.StructField("postings", T.BinaryType()), T.StructField("doc_ids", T.BinaryType()), T.StructField("n_words", T.BinaryType()),
])


def _binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte strings that are consecutive slices of one buffer, without a loop."""
    offsets = np.concatenate([[0], ends * values.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _shard(number: int, keys: list[int | None], lengths: list[int], terms: dict[bytes, int], codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_INDEX)
    n = np.array(lengths, np.int64)
    starts = np.cumsum(n + GAP) - n - GAP
    code = np.concatenate(codes) if codes else np.empty(0, np.int32)
    positions = (np.arange(len(code), dtype=np.int64) + np.repeat(np.arange(len(n)) * GAP, n)).astype(np.uint32)
    order = np.argsort(code, kind="stable")
    counts = np.bincount(code, minlength=len(terms))
    ends = np.cumsum(counts)
    listed = positions[order]
    delta = np.empty_like(listed)
    if len(listed):
        delta[0] = listed[0]
        delta[1:] = listed[1:] - listed[:-1]
        delta[ends[:-1]] = listed[ends[:-1]]  # each list starts from 0
    has = np.array([k is not None for k in keys], np.uint8)
    docs = np.array([k or 0 for k in keys], np.int64)
    yield pa.RecordBatch.from_pydict({"kind": ["docs"], "shard": [number], "term": [None], "n": [len(keys)], "postings": [has.tobytes()], "doc_ids": [docs.tobytes()], "n_words": [n.astype(np.uint32).tobytes()]}, schema=schema)
    k = len(terms)
    none = pa.nulls(k, pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(["term"]).take(pa.array(np.zeros(k, np.int32))), pa.array(np.full(k, number)), pa.array(list(terms), pa.binary()), pa.array(counts.astype(np.int64)), _binaries(delta, ends), none, none], schema=schema)


def build_index(docs: DataFrame, *, shard_words: int = 1_000_000) -> DataFrame:
    """The index of (doc_id, text) rows as a written table: a `docs` row and a row a term for each shard.

    Null texts have no words; a null doc_id is kept; rows that repeat a doc_id are indexed each. A shard ends after
    shard_words words or documents, or with the one document that exceeds them: a task holds one shard."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, size = TaskContext.get().partitionId() << 16, 0
        keys: list[int | None] = []
        lengths: list[int] = []
        terms: dict[bytes, int] = {}
        codes: list[np.ndarray] = []
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = words_of(text.as_py() or "")
                for x in w:
                    if x not in terms:
                        terms[x] = len(terms)
                codes.append(np.fromiter(map(terms.__getitem__, w), np.int32, len(w)))
                keys.append(key)
                lengths.append(len(w))
                size += len(w)
                if max(size, len(keys)) >= shard_words:
                    yield from _shard(number, keys, lengths, terms, codes)
                    number, size, keys, lengths, terms, codes = number + 1, 0, [], [], {}, []
        if keys:
            yield from _shard(number, keys, lengths, terms, codes)

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    return materialize(narrow.mapInArrow(index, _INDEX), "postings", "kind")


def indexed_documents(index: DataFrame) -> DataFrame:
    """(ordinal, doc_id, n_words) of every indexed row."""
    schema = T.StructType([T.StructField("ordinal", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, docs, has, n in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(docs, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((shard << 24) + np.arange(len(ids))), pa.array(ids, mask=np.frombuffer(has, np.uint8) == 0), pa.array(np.frombuffer(n, np.uint32).astype(np.int64))], names=schema.names)

    return index.where("kind = 'docs'").select("shard", "doc_ids", "postings", "n_words").mapInArrow(rows, schema)


# --- queries -----------------------------------------------------------------------------------------------------


class Phrases:
    """The phrases and the proximity sets of terms that one shard is asked for."""

    def __init__(self, phrases: list[tuple[list[bytes], list[str]]], near: list[tuple[list[bytes], list[str]]]):
        self.terms: dict[bytes, int] = {}
        for words, _ in phrases + near:
            for w in words:
                self.terms.setdefault(w, len(self.terms))
        self.length = np.array([len(p) for p, _ in phrases], np.int64)
        self.codes = np.full((len(phrases), int(self.length.max(initial=0))), -1, np.int64)
        for row, (p, _) in enumerate(phrases):
            self.codes[row, : len(p)] = [self.terms[w] for w in p]
        self.owners = [items for _, items in phrases]
        self.near = [([self.terms[w] for w in words], items) for words, items in near]


def _lists(terms: list[bytes], postings: list[bytes], wanted: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(how many positions each wanted term has, all keys term << 32 | position in order)."""
    counts = np.zeros(len(wanted), np.int64)
    got: list[tuple[int, np.ndarray]] = []
    for t, p in zip(terms, postings):
        if (c := wanted.get(t)) is not None:
            d = np.frombuffer(p, np.uint32)
            counts[c] = len(d)
            got.append((c, np.cumsum(d, dtype=np.int64) | c << 32))
    got.sort(key=lambda x: x[0])
    return counts, np.concatenate([x for _, x in got]) if got else np.empty(0, np.int64)


def intersect(phrases: Phrases, counts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, first position) of every occurrence: the positions of its rarest term, moved back by that term's offset,
    that the lists of the other terms, rarest first, all hold at theirs."""
    if not len(phrases.length) or not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    begins = np.concatenate([[0], np.cumsum(counts)])
    there = phrases.codes >= 0
    held = np.where(there, counts[phrases.codes], np.iinfo(np.int64).max)
    order = np.argsort(held, axis=1, kind="stable")
    rarest = order[:, 0]
    first = phrases.codes[np.arange(len(rarest)), rarest]
    n = np.where((held > 0).all(axis=1), counts[first], 0)
    phrase = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n)
    position = (keys[begins[first[phrase]] + inside] & 0xFFFFFFFF) - rarest[phrase]
    keep = position >= 0
    phrase, position = phrase[keep], position[keep]
    for step in range(1, phrases.codes.shape[1]):
        offset = order[phrase, step]
        active = step < phrases.length[phrase]
        want = phrases.codes[phrase, offset] << 32 | position + offset
        found = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        keep = ~active | (keys[found] == want)
        phrase, position = phrase[keep], position[keep]
    return phrase, position


def neighbours(phrases: Phrases, counts: np.ndarray, keys: np.ndarray, starts: np.ndarray, span: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """(items, positions) of each proximity set: where its first term has each other one within `span` words in the same document."""
    begins = np.concatenate([[0], np.cumsum(counts)])
    for codes, items in phrases.near:
        at = keys[begins[codes[0]] : begins[codes[0] + 1]] & 0xFFFFFFFF
        for c in codes[1:]:
            own = keys[begins[c] : begins[c + 1]] & 0xFFFFFFFF
            if not len(own):
                at = at[:0]
                break
            left = np.searchsorted(own, at - span)
            at = at[(left < len(own)) & (own[np.minimum(left, len(own) - 1)] <= at + span)]
        if len(at):
            yield items, at


_MATCHES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ordinal", T.LongType()), T.StructField("item", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType())))])


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])
    return np.stack([starts[new], ends[last]], axis=1).tolist()


_WINDOWS = T.StructType([T.StructField("item", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("terms", T.ArrayType(T.BinaryType()))])


def item_terms(items: DataFrame, window: int) -> DataFrame:
    """(item, kind, terms): the windows of each item's words, and under kind `near` its distinct words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(_WINDOWS)
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words_of(text)
                found = [{"item": item, "kind": "phrase", "terms": x} for x in {tuple(w[k : k + window]) for k in range(max(1, len(w) - window + 1) if w else 0)}]
                yield pa.RecordBatch.from_pylist(found + [{"item": item, "kind": "near", "terms": sorted(set(w))}] * bool(w), schema=schema)

    given = items.where("item_id is not null").select(F.col("item_id").cast("string"), F.coalesce(F.col("text"), F.lit("")))
    return given.mapInArrow(cut, _WINDOWS)


def asked(index: DataFrame, items: DataFrame, *, window: int, span: int, near_terms: int) -> DataFrame:
    """(anchor, kind, terms, items): every phrase and proximity set that can occur, and its rarest term over the whole corpus.

    A phrase with a term that the corpus lacks is left out; a proximity set has the item's near_terms rarest words of those
    the corpus has, ties by the words' bytes, rarest first."""
    cut = materialize(item_terms(items, window).where("kind = 'phrase'" if not span else "true"), "test-windows")
    wanted = cut.select(F.explode("terms").alias("term")).distinct()
    counts = materialize(index.where("kind = 'term'").join(wanted, "term").groupBy("term").agg(F.sum("n").alias("n")), "test-terms")
    phrases = cut.where("kind = 'phrase'").groupBy("terms").agg(F.array_sort(F.collect_set("item")).alias("items"))
    each = phrases.select("terms", "items", F.explode("terms").alias("term")).join(counts, "term")
    phrases = each.groupBy("terms").agg(F.count("*").alias("found"), F.min(F.struct("n", "term"))["term"].alias("anchor"), F.any_value("items").alias("items")).where(F.col("found") == F.size("terms"))
    phrases = phrases.select("anchor", F.lit("phrase").alias("kind"), "terms", "items")
    if not span:
        return materialize(phrases, "test-phrases")
    rare = cut.where("kind = 'near'").select("item", F.explode("terms").alias("term")).join(counts, "term").groupBy("item").agg(F.slice(F.array_sort(F.collect_set(F.struct("n", "term"))), 1, near_terms).alias("rare"))
    sets = rare.where(F.size("rare") > 1).select(F.transform("rare", lambda x: x["term"]).alias("terms"), "item").groupBy("terms").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return materialize(phrases.unionByName(sets.select(F.col("terms")[0].alias("anchor"), F.lit("near").alias("kind"), "terms", "items")), "test-phrases")


def matches(index: DataFrame, items: DataFrame, *, window: int = 10, span: int = 32, near_terms: int = 5) -> DataFrame:
    """(doc_id, ordinal, item, kind, spans) for the items' phrases in the index.

    kind `phrase`: an exact occurrence of `window` consecutive item words (of a shorter item, all its words); spans are the
    merged word ranges [from, to). kind `near`: of the item's distinct words that occur in the corpus, the near_terms rarest,
    or all if fewer but at least two: places of the rarest within `span` words of which each other one lies, in the same
    document. Rarity is counted over the whole corpus, so a match does not depend on how it is sharded. ordinal tells rows
    of equal doc_id apart. An item without an id or without words matches nothing. span 0 leaves proximity out; it must not exceed
    the gap between documents."""
    if not (0 <= span <= GAP and 0 < window <= GAP):
        raise ValueError(f"window and span must lie within {GAP}")
    queries = asked(index, items, window=window, span=span, near_terms=near_terms)
    wanted = queries.select(F.explode("terms").alias("term")).distinct()
    lists = index.where("kind = 'term'").select("shard", "term", "postings").join(wanted, "term", "left_semi").withColumn("kind", F.lit("term"))
    docs = index.where("kind = 'docs'").select("shard", F.lit(None).cast("binary").alias("term"), F.col("n_words").alias("postings"), F.lit("words").alias("kind"), "doc_ids", F.col("postings").alias("has"))
    both = lists.unionByName(docs, allowMissingColumns=True)
    # an anchor's phrases go to a shard as one row: as many rows as the shard has anchors
    anchored = queries.groupBy("anchor").agg(F.collect_list(F.struct("kind", "terms", "items")).alias("queries"))
    there = index.where("kind = 'term'").select(F.col("shard").alias("to_shard"), F.col("term").alias("anchor"))
    routed = there.join(anchored, "anchor").select("to_shard", "queries")

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        sent = [q for row in right.column("queries").to_pylist() for q in row]
        p = Phrases(*([(q["terms"], q["items"]) for q in sent if q["kind"] == kind] for kind in ("phrase", "near")))
        kinds = left.column("kind").to_pylist()
        head = kinds.index("words")
        n = np.frombuffer(left.column("postings")[head].as_py(), np.uint32).astype(np.int64)
        ids = np.frombuffer(left.column("doc_ids")[head].as_py(), np.int64)
        has = np.frombuffer(left.column("has")[head].as_py(), np.uint8)
        starts = np.cumsum(n + GAP) - n - GAP
        listed = left.filter(pa.array([k == "term" for k in kinds]))
        counts, keys = _lists(listed.column("term").to_pylist(), listed.column("postings").to_pylist(), p.terms)
        phrase, position = intersect(p, counts, keys)
        hits: dict[tuple[int, str, str], list[tuple[int, int]]] = {}
        doc = np.searchsorted(starts, position, "right") - 1
        for d, x, a in zip(doc.tolist(), phrase.tolist(), (position - starts[doc]).tolist()):
            for item in p.owners[x]:
                hits.setdefault((d, item, "phrase"), []).append((a, a + int(p.length[x])))
        for owners, at in neighbours(p, counts, keys, starts, span) if span else ():
            doc = np.searchsorted(starts, at, "right") - 1
            for d, a in zip(doc.tolist(), (at - starts[doc]).tolist()):
                for item in owners:
                    hits.setdefault((d, item, "near"), []).append((max(0, a - span), min(int(n[d]), a + span + 1)))
        base = left.column("shard")[head].as_py() << 24
        rows = [{"doc_id": int(ids[d]) if has[d] else None, "ordinal": base + d, "item": item, "kind": kind, "spans": _merged(*np.array(s).T)} for (d, item, kind), s in hits.items()]
        return pa.Table.from_pylist(rows, schema=to_arrow_schema(_MATCHES))

    return both.groupBy("shard").cogroup(routed.groupBy("to_shard")).applyInArrow(search, _MATCHES)


def contamination(docs: DataFrame, items: DataFrame, *, window: int = 10, span: int = 32, near_terms: int = 5) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    n_hit counts the words inside any phrase match, n_items the items with one, items_sha256 digests their ids as sorted
    strings; n_near the items with a proximity match. A null text has no words; rows that repeat a doc_id each give a
    row; items without an id or words match nothing; empty tables give no rows or no hits; other columns play no part."""
    index = build_index(docs)
    found = matches(index, items, window=window, span=span, near_terms=near_terms)
    per = found.groupBy("ordinal").agg(
        F.array_sort(F.flatten(F.collect_list(F.when(F.col("kind") == "phrase", F.col("spans"))))).alias("spans"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "phrase", F.col("item")))).alias("items"),
        F.count_distinct(F.when(F.col("kind") == "near", F.col("item"))).alias("n_near"),
    )
    # spans in order of their starts: each adds what lies beyond all before
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")), lambda a, s: F.struct(F.greatest(a["upto"], s[1]).alias("upto"), (a["n"] + F.greatest(F.lit(0), s[1] - F.greatest(a["upto"], s[0]))).alias("n")))["n"]
    per = per.select("ordinal", covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "n_near")
    listed = indexed_documents(index)
    zero = F.lit(0).cast("long")
    return listed.join(per, "ordinal", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", zero) > 0).alias("contaminated"), F.coalesce("n_near", zero).alias("n_near"),
    )


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contamination of `documents` by the items of `benchmark`: windows of 10 words, and 5 terms within 32 words."""
    return contamination(only(table(spark, sf_dir, "documents"), "doc_id", "text"), only(table(spark, sf_dir, "benchmark"), "item_id", "text"))
