"""Row-level checks of uploaded templates and of scoring requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .clean import parse_number


def missing_columns(names: list[str]) -> list[str]:
    missing = [c for c in S.TEMPLATE_REQUIRED if c not in names]
    return ["Faltan columnas obligatorias: " + ", ".join(missing)] if missing else []


def _blank(c: str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)\s+", " ")) == ""


def _errors(df: DataFrame, checks: list[tuple[str, Column, str]]) -> DataFrame:
    """(fila, campo, mensaje) for each check that fails; one pass over the rows."""
    found = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(c).alias("campo"), F.lit(m).alias("mensaje"))) for c, bad, m in checks]))
    return df.select("fila", F.explode(found).alias("e")).select("fila", "e.*")


def required_errors(df: DataFrame) -> DataFrame:
    return _errors(df, [(c, _blank(c), f"el campo {c} es obligatorio.") for c in S.TEMPLATE_REQUIRED])


def period_errors(df: DataFrame) -> DataFrame:
    """Year 1900-2100 and month 1-12, each truncated to a whole number; a blank or unreadable one fails."""
    whole = lambda c: F.floor(parse_number(F.col(c)))
    outside = lambda c, a, b: F.coalesce(~whole(c).between(a, b), F.lit(True))
    return _errors(df, [("anio", outside("anio", 1900, 2100), "año inválido."), ("mes", outside("mes", 1, 12), "mes inválido.")])


def numeric_errors(df: DataFrame) -> DataFrame:
    return _errors(df, [(c, F.coalesce(parse_number(F.col(c)) < 0, F.lit(True)), f"{c} debe ser numérico no negativo.") for c in S.TEMPLATE_MEASURES])


def _keyed(df: DataFrame) -> DataFrame:
    text = lambda c: F.trim(F.regexp_replace(F.col(c), r"(?U)\s+", " "))
    return df.select("fila", text("codigo_ipress").alias("codigo_ipress"), parse_number(F.col("anio")).cast("long").alias("anio"), parse_number(F.col("mes")).cast("long").alias("mes"), F.upper(text("servicio_hospitalizacion")).alias("servicio_hospitalizacion"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """All rows whose key occurs more than once; missing keys are equal. Counts are joined back, so that a key with very
    many rows is one that AQE can split."""
    keyed = _keyed(df).alias("k")
    twice = duplicate_keys(df).alias("d")
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"d.{c}")) for c in S.TEMPLATE_KEY]
    return keyed.join(twice, same).select("k.*")


def duplicate_keys(df: DataFrame) -> DataFrame:
    return _keyed(df).groupBy(*S.TEMPLATE_KEY).agg(F.count("*").alias("n")).where("n > 1").drop("n")


def all_errors(df: DataFrame) -> DataFrame:
    doubled = duplicate_rows(df).select("fila", F.lit("clave").alias("campo"), F.lit(S.DUPLICATE_MESSAGE).alias("mensaje"))
    return required_errors(df).unionByName(period_errors(df)).unionByName(numeric_errors(df)).unionByName(doubled)


def validation_summary(df: DataFrame) -> DataFrame:
    """One row: rows, valid rows, errors, rows in duplicates and distinct duplicate keys. A row can have several errors."""
    rows = df.agg(F.count("*").alias("registros"))
    bad = all_errors(df).agg(F.count("*").alias("n_errores"), F.count_distinct("fila").alias("n_invalidos"), F.count_distinct(F.when(F.col("campo") == "clave", F.col("fila"))).alias("n_duplicados"))
    keys = duplicate_keys(df).agg(F.count("*").alias("n_claves_duplicadas"))
    return rows.crossJoin(F.broadcast(bad)).crossJoin(F.broadcast(keys)).withColumn("registros_validos", F.col("registros") - F.col("n_invalidos"))


def input_violations(df: DataFrame) -> DataFrame:
    """(fila, campo, mensaje) of typed scoring requests: year and month ranges, empty texts, negative measures."""
    texts = ["ubigeo", "departamento", "provincia", "distrito", "sector", "categoria_ipress", "codigo_ipress", "id_hospitalizacion", "servicio_hospitalizacion"]
    outside = lambda c, a, b: F.coalesce(~F.col(c).between(a, b), F.lit(True))
    checks = [("anio", outside("anio", 1900, 2100), "fuera de rango"), ("mes", outside("mes", 1, 12), "fuera de rango")]
    checks += [(c, F.coalesce(F.col(c) == "", F.lit(True)), "vacío") for c in texts] + [(c, F.coalesce(F.col(c) < 0, F.lit(True)), "negativo") for c in S.MEASURES]
    return _errors(df, checks)
