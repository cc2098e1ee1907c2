"""Risk labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..sources.scratch import written
from .rollup import pressure_percentiles


NO_PERCENTILES = "No existen valores válidos de presion_ingresos_camas para calcular los percentiles."


def with_current_risk(df: DataFrame, percentiles: DataFrame | tuple[float, float] | None = None, *, strict: bool = False) -> DataFrame:
    """df with nivel_riesgo_actual and its code, by fixed thresholds and the pressure's global percentiles.

    The percentiles are one row, attached without a collect; given ones are used as they are. Where they are to be found first, df
    is written, so that it is computed once. NaN counts as missing. strict: without percentiles any row is an error, when it is computed."""
    if percentiles is None:
        df = written(df, "indicators")
        percentiles = pressure_percentiles(df, stored=True)
    if isinstance(percentiles, tuple):
        joined = df.withColumns({"_p50": F.lit(float(percentiles[0])), "_p75": F.lit(float(percentiles[1]))})
    else:
        row = percentiles.select(F.col("presion_ingresos_camas_percentil_50").alias("_p50"), F.col("presion_ingresos_camas_percentil_75").alias("_p75"))
        joined = df.crossJoin(F.broadcast(row))
    known = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double"))
    occupancy, ratio, pressure = known("ocupacion_estimada"), known("ratio_camas_disponibles"), known("presion_ingresos_camas")
    level = F.when((occupancy >= 0.85) | (ratio <= 0.10) | (pressure >= F.col("_p75")), "alto").when((occupancy >= 0.70) | (ratio <= 0.20) | (pressure >= F.col("_p50")), "medio").otherwise("bajo")
    if strict:
        level = F.when(F.col("_p50").isNull() | F.col("_p75").isNull(), F.raise_error(F.lit(NO_PERCENTILES))).otherwise(level)
    return joined.withColumn("nivel_riesgo_actual", level).withColumn("nivel_riesgo_actual_codificado", risk_code("nivel_riesgo_actual")).drop("_p50", "_p75")


def risk_code(column: str):
    out = None
    for name, code in S.RISK_CODES.items():
        out = F.when(F.col(column) == name, code) if out is None else out.when(F.col(column) == name, code)
    return out
