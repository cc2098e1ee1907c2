"""Delimited sources: dialects by file, strict scans with every column as text, and dataset sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..operators.headers import raw_header, require, template_header


#: The byte-order mark that spreadsheets take for a sign of UTF-8.
BOM = "\ufeff"


class EmptyCsvError(ValueError):
    """The file has no rows or no columns."""


def dialects(spark: SparkSession, path: str) -> DataFrame:
    """(archivo, ruta, codificacion, separador, encabezado, n_lineas, con_saltos) of each *.csv whose name does not start with ~ . or $.

    A file with a byte sequence that is not UTF-8 anywhere is ISO-8859-1; the separator is ';' where the first line that is
    not blank has more of these than commas. Lines are read as text in splits, so a large file is no single task. con_saltos: a line has an odd number of quotes, so some
    quoted value may go on in the next line."""
    # Spark's own listing skips names that begin with "." or "_"
    lines = spark.read.option("pathGlobFilter", "*.csv").text(path).select(F.col("_metadata.file_name").alias("archivo"), F.col("_metadata.file_path").alias("ruta"), F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("en"), "value")
    full = lines.where(~F.col("archivo").rlike(r"^[~.$]"))
    per = full.groupBy("archivo", "ruta").agg(
        F.bool_or(~F.is_valid_utf8("value")).alias("latin"), F.min_by("value", F.when(F.trim("value") != "", F.col("en"))).alias("primera"), F.count_if(F.trim("value") != "").alias("n_lineas"),
        F.bool_or((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1).alias("con_saltos"),
    )
    first = F.regexp_replace("primera", "^﻿", "")
    count = lambda c: F.length(first) - F.length(F.replace(first, F.lit(c), F.lit("")))
    return per.select("archivo", "ruta", F.when(F.col("latin"), "ISO-8859-1").otherwise("UTF-8").alias("codificacion"), F.when(count(";") > count(","), ";").otherwise(",").alias("separador"), first.alias("encabezado"), "n_lineas", "con_saltos")


def _scan(spark: SparkSession, paths: list[str], encoding: str, separator: str, breaks: bool, tag: bool) -> DataFrame:
    # a file is one task only where a value holds a line break
    df = spark.read.csv(paths, header=True, sep=separator, encoding=encoding, multiLine=breaks, escape='"', mode="FAILFAST", nullValue=None)
    tagged = [F.col("_metadata.file_name").alias("ARCHIVO_ORIGEN")] if tag else []
    # columns that folder names tell may be numbers
    texts = [F.when(~F.col(f"`{c}`").isin(S.NA_TOKENS), F.col(f"`{c}`")).alias(c) if kind == "string" else F.col(f"`{c}`") for c, kind in df.dtypes]
    return df.select(*texts, *tagged)


def scan_csv(spark: SparkSession, path: str, *, tag: bool = False) -> DataFrame:
    """One file, all columns text, NA tokens null. A missing path is Spark's error, a file without rows EmptyCsvError."""
    found = sorted((r for r in dialects(spark, path).collect() if r.n_lineas > 1), key=lambda r: r.archivo)
    if not found:
        raise EmptyCsvError(f"El archivo CSV está vacío: {path}")
    return _scan(spark, [path], found[0].codificacion, found[0].separador, any(r.con_saltos for r in found), tag)


def scan_directory(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    """All files of a folder in one relation with ARCHIVO_ORIGEN, and the names of empty files that were left out.

    Files are read together by dialect and header; the driver holds a row a file."""
    found = sorted(dialects(spark, folder).collect(), key=lambda r: r.archivo.lower())
    used = [r for r in found if r.n_lineas > 1]
    if not used:
        raise EmptyCsvError(f"No hay archivos CSV con datos en {folder}")
    groups: dict[tuple, list[str]] = {}
    for r in used:
        groups.setdefault((r.codificacion, r.separador, r.con_saltos, r.encabezado), []).append(r.ruta)
    parts = []
    for (encoding, separator, breaks, _), paths in groups.items():
        part = raw_header(_scan(spark, paths, encoding, separator, breaks, True))
        parts.append(require(part, S.RAW_REQUIRED, ", ".join(p.rsplit("/", 1)[-1] for p in paths)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), [r.archivo for r in found if r.n_lineas < 2]


def numbered(df: DataFrame, name: str = "fila") -> DataFrame:
    """A scan of files with each row's number in its file: 2 for the first one below the header, and one more for each record,
    so a quoted value may span lines. Rows are numbered within their split; what lies before a split is a sum over one row a split."""
    split = df.withColumns({"_archivo": F.col("_metadata.file_path"), "_desde": F.col("_metadata.file_block_start"), "_n": F.monotonically_increasing_id()})
    sizes = split.groupBy("_archivo", "_desde").agg(F.count("*").alias("_filas"), F.min("_n").alias("_primera"))
    before = F.sum("_filas").over(Window.partitionBy("_archivo").orderBy("_desde")) - F.col("_filas")
    joined = split.join(sizes.select("_archivo", "_desde", "_primera", before.alias("_antes")), ["_archivo", "_desde"])
    return joined.withColumn(name, F.col("_n") - F.col("_primera") + F.col("_antes") + 2).drop("_archivo", "_desde", "_n", "_primera", "_antes")


def scan_template(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """An uploaded template with canonical names, and its warnings. Unless it has a column fila, that is the row's number in its file."""
    df = scan_csv(spark, path)
    return template_header(df if "fila" in df.columns else numbered(df))


def write_dataset(df: DataFrame, path: str, *, format: str = "parquet") -> None:
    """Parquet by year, so that splits by target year prune to two folders; or CSV for exchange. Rebalanced, so a year with
    most of the rows is written by several tasks. Each CSV file begins with a byte-order mark, ahead of its first column's name."""
    if format == "csv":
        df.toDF(BOM + df.columns[0], *df.columns[1:]).write.csv(path, header=True)
    else:
        df.hint("rebalance", "anio").write.partitionBy("anio").parquet(path)


def scan_dataset(spark: SparkSession, path: str, *, format: str = "parquet", schema=None) -> DataFrame:
    """A written dataset; with its schema, so that identifiers keep their leading zeros."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.csv(path, header=True) if format == "csv" else reader.parquet(path)


def write_metadata(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.json(path)


def read_metadata(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read if schema is None else spark.read.schema(schema)).json(path)


def write_reports(reports: dict[str, DataFrame], folder: str) -> None:
    """Each report (metrics, a confusion matrix, importances: some rows a model) as CSV in a folder of its name."""
    for name, df in reports.items():
        write_dataset(df.coalesce(1), f"{folder}/{name}", format="csv")


def read_report(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A report as write_reports wrote it, with the types of its schema."""
    return scan_dataset(spark, f"{folder}/{name}", format="csv", schema=schema)
