"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import only, table
from .segments import BoundedCache, byte_batches, split_at_spaces, utf8_sizes

_models: dict[str, tuple[object, BoundedCache, bool]] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _model(path: str):
    """The worker's model, its cache of part lengths, and whether cutting at lone spaces is safe for it."""
    if path not in _models:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        crossing = any("▁" in m.id_to_piece(i).lstrip("▁") for i in range(m.vocab_size()))
        # the mark stands for a space, a part gets one in front, and spaces stay as they are
        plain = m.encode("a b") == m.encode("a") + m.encode("b") and len(m.encode("a   b")) != len(m.encode("a b"))
        _models[path] = m, BoundedCache(), plain and not crossing
    return _models[path]


def count_tokens(texts: list[str], model_path: str) -> list[int]:
    """Tokens of each text as the library gives them for the whole text."""
    model, cache, safe = _model(model_path)
    if not safe:
        return [len(x) for a, b in byte_batches(utf8_sizes(texts)) for x in model.encode(texts[a:b], num_threads=1)]
    out: list[int] = []
    for a, b in byte_batches(utf8_sizes(texts)):
        parts = [split_at_spaces(t) if t else [] for t in texts[a:b]]
        new = [x for x in set().union(*parts) if x not in cache]
        cache.add(new, list(map(len, model.encode(new, num_threads=1))))
        get = cache.__getitem__
        out += [sum(map(get, p)) for p in parts]
        cache.trim()
    return out


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows each give a row; an empty table gives none;
    a null id is kept. Long texts are cut at spaces that no piece crosses, so memory stays bounded by a part;
    batches within a task have about equal bytes. Other columns play no part."""
    path = model_path or default_model()
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.binary_length(text), pa.int64()), pa.array(count_tokens(text.to_pylist(), path), pa.int64())], names=schema.names)

    narrow = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    return narrow.mapInArrow(lengths, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token_counts of `documents` with the default model and limit."""
    return token_counts(only(table(spark, sf_dir, "documents"), "doc_id", "text"))
