"""Helpers shared by the training-data operators."""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH_KEY = "spark.checkpoint.dir"
_recording: ContextVar[tuple[list[str], ...]] = ContextVar("recording", default=())
_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session's spark.checkpoint.dir names it.

    Where the setting is absent a local session (tests) gets a temporary folder, made once and kept in the session; on a
    cluster that is an error, as its executors would not share it."""
    found = spark.conf.get(_SCRATCH_KEY, None)
    if found is None:
        found = spark.conf.get("aforo.scratch.dir", None)
    if found is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {_SCRATCH_KEY} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-aforo-")
        spark.conf.set("aforo.scratch.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return posixpath.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage so that a lost executor
    recomputes at most the current step, and lets AQE see real sizes and split skewed join keys. The step's shuffle files go
    once it is written, as nothing reads them any more."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(_CLEANUP_KEY, None)
    spark.conf.set(_CLEANUP_KEY, "true")
    try:
        writer.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP_KEY)
        else:
            spark.conf.set(_CLEANUP_KEY, before)
    for paths in _recording.get():
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables that materialize() writes within, for drop_steps()."""
    paths: list[str] = []
    token = _recording.set((*_recording.get(), paths))
    try:
        yield paths
    finally:
        _recording.reset(token)


def drop_steps(paths: list[str]) -> None:
    """Delete recorded tables once a written table holds all that is still needed of them, so that disk follows the largest step
    and not the sum of all. One that is gone already is passed over."""
    for path in paths:
        where, local = _resolve(path)
        if where.get_file_info(local).type.name != "NotFound":
            where.delete_dir(local)
    paths.clear()


def discard(written: DataFrame) -> None:
    """Delete the files of a table of materialize() once another written table holds all that is still needed of it."""
    for path in {posixpath.dirname(f) for f in written.inputFiles()}:
        where, local = _resolve(path)
        where.delete_dir(local)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, so that extra or clashing columns of the input play no part."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be none of df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def text_hash(column: str):
    """A 64-bit hash of a text, null as empty: with the doc_id it tells rows apart whose doc_id repeats."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit(""))).alias("text_hash")


def open_output(url: str):
    """A binary stream for writing at a URL on any file system that pyarrow knows (file, hdfs, s3, gs)."""
    from pyarrow import fs

    where, path = _resolve(url)
    where.create_dir(posixpath.dirname(path), recursive=True)
    assert isinstance(where, fs.FileSystem)
    return where.open_output_stream(path)


def read_bytes(url: str) -> bytes:
    where, path = _resolve(url)
    with where.open_input_stream(path) as f:
        return f.read()


def _resolve(url: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(url if "://" in url else "file://" + url.removeprefix("file:"))
