"""Ratio indicators and calendar expressions, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import INDICATORS


def safe_ratio(numerator: Column, denominator: Column, if_zero: Column | None = None) -> Column:
    """numerator / denominator; if_zero (0.0) where the denominator is 0; null where either is null."""
    return F.when(denominator != 0, numerator / denominator).when(denominator == 0, F.lit(0.0) if if_zero is None else if_zero)


def days_in_month(year: Column, month: Column) -> Column:
    """Days of the month; an invalid month is an error under ANSI mode."""
    return F.day(F.last_day(F.make_date(year, month, F.lit(1))))


def month_ordinal(year: Column, month: Column) -> Column:
    return year * 12 + month - 1


def period(year: Column, month: Column) -> Column:
    return F.format_string("%04d-%02d", year, month)


def next_period(year: Column, month: Column) -> Column:
    return F.date_format(F.add_months(F.make_date(year, month, F.lit(1)), 1), "yyyy-MM")


def with_indicators(df: DataFrame) -> DataFrame:
    """df with the eight indicator columns; where there are no beds the pressure is the admissions themselves."""
    c = F.col
    capacity = c("total_camas") * days_in_month(c("anio"), c("mes"))
    values = [
        days_in_month(c("anio"), c("mes")), safe_ratio(c("total_estancias"), c("total_egresos")), safe_ratio(c("total_fallecidos"), c("total_egresos")),
        safe_ratio(c("total_camas_disponibles"), capacity), safe_ratio(c("total_pacientes_camas"), capacity), safe_ratio(c("total_ingresos"), c("total_camas"), c("total_ingresos")),
        safe_ratio(c("total_egresos"), c("total_camas")), c("total_ingresos") - c("total_egresos"),
    ]
    return df.withColumns(dict(zip(INDICATORS, values)))


def with_calendar(df: DataFrame) -> DataFrame:
    month = F.col("mes")
    angle = 2 * F.pi() * month / 12
    return df.withColumns({"trimestre": F.floor((month - 1) / 3).cast("int") + 1, "semestre": F.floor((month - 1) / 6).cast("int") + 1, "mes_sin": F.sin(angle), "mes_cos": F.cos(angle), "es_fin_de_anio": (month == 12).cast("int")})


def one_decimal(value: Column) -> Column:
    """Half-up to one decimal by arithmetic, so that engines agree on the text."""
    return F.when(value.isNotNull(), F.format_string("%.1f", F.floor(value * 10 + 0.5) / 10))


def occupancy_text(ratio: Column) -> Column:
    return F.coalesce(F.concat(one_decimal(ratio * 100), F.lit("%")), F.lit("Sin dato"))
