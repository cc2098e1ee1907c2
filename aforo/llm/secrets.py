"""Secret scans with corpus-wide ownership frequency.

Candidates are found in one pass. Their hashes are then counted over the corpus by distinct repository and owner: a value
that many owners have is a copied example, one that few have looks like a live credential of theirs."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, table

KINDS = ("assign", "access", "hex", "owned")
_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# a run's first character has none of its kind in front, so each run is tried once
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, secret) of the base kinds, by start and then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def opaque_spans(text: str, taken: list[tuple[int, int, int, str]], least: float) -> list[tuple[int, int, int, str]]:
    """Long tokens of letters and digits with high entropy that no base span overlaps: secrets only if their owners say so."""
    found = []
    starts, reach = [a for a, _, _, _ in taken], [0, *accumulate((b for _, _, b, _ in taken), max)]
    for m in _OPAQUE.finditer(text):
        v = m[0]
        # of the base spans that start before its end, the farthest reaches into it
        if any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and reach[bisect_left(starts, m.end())] <= m.start() and entropy(v) >= least:
            found.append((m.start(), 3, m.end(), v))
    return found


_CANDIDATE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("hash", T.BinaryType())])
_FOUND = T.StructType([
    T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("repository", T.StringType()), T.StructField("owner", T.StringType()),
    T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()), T.StructField("base_sha256", T.StringType()), T.StructField("base", T.StringType()),
    T.StructField("candidates", T.ArrayType(_CANDIDATE)),
])


def scanned(docs: DataFrame, *, least_entropy: float = 3.5) -> DataFrame:
    """Base counts and all candidates of each row of (doc_id, text, repository, owner). Values leave a task as hashes only."""
    from pyspark.sql.pandas.types import to_arrow_schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        schema, row = to_arrow_schema(_FOUND), TaskContext.get().partitionId() << 36
        for batch in batches:
            out = []
            for doc_id, text, repository, owner in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                t = text.as_py() or ""
                base = base_spans(t)
                told = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in base)
                n = Counter(k for _, k, _, _ in base)
                every = [{"start": a, "kind": k, "end": b, "hash": hashlib.blake2b(v.encode(), digest_size=16).digest()} for a, k, b, v in base + opaque_spans(t, base, least_entropy)]
                out.append({"row": row, "doc_id": doc_id, "repository": repository, "owner": owner, "n_assign": n[0], "n_access": n[1], "n_hex": n[2], "base_sha256": hashlib.sha256(told.encode()).hexdigest(), "base": told, "candidates": every})
                row += 1
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text", "repository", "owner").mapInArrow(scan, _FOUND)


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_repositories, n_owners, n_seen) of each candidate. A null repository or owner is one of its own. Rows are
    first summed by (hash, repository, owner) where they are read, so a value that all documents have stays small."""
    each = found.select(F.explode("candidates.hash").alias("hash"), F.coalesce("repository", F.lit("\0")).alias("repository"), F.coalesce("owner", F.lit("\0")).alias("owner"))
    by_owner = each.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n")).groupBy("hash", "owner").agg(F.count("*").alias("r"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("r").alias("n_repositories"), F.count("*").alias("n_owners"), F.sum("n").alias("n_seen"))


def scan_secrets(docs: DataFrame, *, wide_owners: int = 3, wide_repositories: int = 5, least_entropy: float = 3.5) -> DataFrame:
    """Per row of (doc_id, text, repository, owner): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_shared, n_specific.

    A candidate of at least wide_owners owners or wide_repositories repositories is shared (a copied example), others are
    specific. spans has every base span, and the opaque tokens that are specific. A null text is empty; rows that
    repeat a doc_id each give a row; an empty table gives none. An owner's repositories are distinct from another's."""
    found = materialize(scanned(docs, least_entropy=least_entropy), "secrets")
    known = materialize(ownership(found), "secret-owners")
    each = materialize(found.select("row", F.explode("candidates").alias("c")).select("row", "c.*"), "secret-candidates")
    wide = (F.col("n_owners") >= wide_owners) | (F.col("n_repositories") >= wide_repositories)
    told = each.join(known, "hash").select("row", "start", "kind", "end", wide.alias("shared"))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    span = F.struct("start", "kind", F.concat_ws(":", name, "start", "end").alias("told"))
    per = told.groupBy("row").agg(
        F.transform(F.sort_array(F.collect_list(F.when((F.col("kind") < 3) | ~F.col("shared"), span))), lambda s: s["told"]).alias("spans"),
        F.count_if("shared").alias("n_shared"), F.count_if(~F.col("shared")).alias("n_specific"),
    )
    zero = F.lit(0).cast("long")
    return found.drop("candidates").join(per, "row", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(F.concat_ws(",", "spans"), "base").alias("spans"), F.coalesce("n_shared", zero).alias("n_shared"), F.coalesce("n_specific", zero).alias("n_specific"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_secrets of `documents`. The table names no owners, so a source stands in for the owner, and a source's documents in
    one language for a repository of its."""
    docs = table(spark, sf_dir, "documents")
    return scan_secrets(docs.select("doc_id", "text", F.concat_ws("/", "source", "lang").alias("repository"), F.col("source").alias("owner")))
