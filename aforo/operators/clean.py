"""Cleaning of the raw monthly table: every column arrives as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.indicators import days_in_month

#: The characters that Unicode calls white space.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def clean_text(c: Column) -> Column:
    """Upper case with white space of any kind trimmed and collapsed; null becomes empty."""
    flat = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")
    return F.upper(F.trim(flat))


def parse_number(c: Column) -> Column:
    """A plain decimal number; anything else, NaN and suffixed literals included, is null."""
    t = F.btrim(c, F.lit(WHITE))
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def clean_measure(c: Column) -> Column:
    """Commas go, so '3,5' is 35; what does not parse, and what is negative, becomes 0."""
    return F.greatest(F.coalesce(parse_number(F.replace(c, F.lit(","), F.lit(""))), F.lit(0.0)), F.lit(0.0))


def drop_exact_copies(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def clean_texts(df: DataFrame, columns: Sequence[str] = S.RAW_TEXTS) -> DataFrame:
    return df.withColumns({c: clean_text(F.col(c)) for c in columns})


def filter_services(df: DataFrame) -> DataFrame:
    """Rows with a service and without a sentinel id; expects cleaned texts."""
    return df.where((F.col("HOSPITALIZACION") != "") & ~F.col("ID_HOSPITALIZACION").isin(S.SENTINEL_IDS))


def clean_periods(df: DataFrame) -> DataFrame:
    """Year and month as whole numbers; rows where one does not parse, or the month is outside 1-12, go."""
    both = df.withColumns({c: parse_number(F.col(c)) for c in ("ANHO", "MES")})
    return both.where(F.col("ANHO").isNotNull() & F.col("MES").between(1, 12)).withColumns({c: F.col(c).cast("int") for c in ("ANHO", "MES")})


def clean_measures(df: DataFrame, columns: Sequence[str] = S.RAW_MEASURES) -> DataFrame:
    return df.withColumns({c: clean_measure(F.col(c)) for c in columns})


def clean_records(df: DataFrame) -> DataFrame:
    return clean_unlike(drop_exact_copies(df))


def clean_unlike(df: DataFrame) -> DataFrame:
    """clean_records of rows that have no exact copies."""
    return df.transform(clean_texts).transform(filter_services).transform(clean_periods).transform(clean_measures)


def filter_scope(df: DataFrame, department: str = "LIMA", province: str = "LIMA", sectors: Sequence[str] = S.PUBLIC_SECTORS, strict: bool = False) -> DataFrame:
    """The public facilities of one province; strict raises where none is left."""
    kept = df.where((F.col("DEPARTAMENTO") == department) & (F.col("PROVINCIA") == province) & F.col("SECTOR").isin(list(sectors)))
    if strict and kept.isEmpty():
        raise ValueError("No quedaron registros después de aplicar los filtros.")
    return kept


def public_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in S.PUBLIC_NAMES.items() if a in df.columns})


def project_output(df: DataFrame) -> DataFrame:
    return df.select(*S.OUTPUT)


def to_bed_days(df: DataFrame) -> DataFrame:
    """Template uploads state physical beds: times the days of the month. They also get the default sector, id and deaths."""
    days = days_in_month(F.col("anio"), F.col("mes"))
    return df.withColumns({
        "total_camas_disponibles": F.when(F.col("formato") == "FORMATO_INTERNO", F.col("total_camas_disponibles") * days).otherwise(F.col("total_camas_disponibles")),
        "sector": F.coalesce("sector", F.lit("MINSA")), "id_hospitalizacion": F.coalesce("id_hospitalizacion", "servicio_hospitalizacion"), "total_fallecidos": F.coalesce("total_fallecidos", F.lit(0.0)),
    })
