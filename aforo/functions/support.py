"""Decision support: rules, scores and texts as expressions over indicator columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .indicators import one_decimal


def _number(name: str) -> Column:
    """A missing or non-numeric indicator counts as 0.0 here (the factor texts skip it instead)."""
    return F.coalesce(F.col(name).try_cast("double"), F.lit(0.0))


def normalized_risk(risk: Column) -> Column:
    return F.lower(F.trim(F.coalesce(risk, F.lit(""))))


def risk_index(risk: Column, confidence: Column) -> Column:
    c = F.greatest(F.lit(0.0), F.least(confidence.cast("double"), F.lit(1.0)))
    return (
        F.when(F.lower(risk) == "bajo", F.greatest(F.lit(0.0), F.least(F.lit(0.33), (1.0 - c) * 0.33)))
        .when(F.lower(risk) == "medio", F.greatest(F.lit(0.33), F.least(F.lit(0.66), c * 0.33 + 0.33)))
        .when(F.lower(risk) == "alto", F.greatest(F.lit(0.66), F.least(F.lit(1.0), c * 0.34 + 0.66)))
        .otherwise(0.0)
    )


def main_cause(risk: Column) -> Column:
    n = _number
    rules = [
        (n("ocupacion_estimada") >= 0.90, S.CAUSE_OCCUPANCY), (n("ratio_camas_disponibles") <= 0.10, S.CAUSE_CAPACITY), (n("diferencia_ingresos_egresos") > 0, S.CAUSE_DEMAND),
        (n("promedio_estancia") > 7, S.CAUSE_STAY), (n("presion_ingresos_camas") > 1, S.CAUSE_PRESSURE), (n("rotacion_camas") < 1, S.CAUSE_ROTATION), (normalized_risk(risk) == "bajo", S.CAUSE_CONTROLLED),
    ]
    out = F.when(*[rules[0][0], F.lit(rules[0][1])])
    for holds, name in rules[1:]:
        out = out.when(holds, name)
    return out.otherwise(S.CAUSE_MIXED)


def gap_score(risk: Column) -> Column:
    n, r, occupancy = _number, normalized_risk(risk), _number("ocupacion_estimada")
    points = lambda holds, p: F.when(holds, p).otherwise(0)
    total = F.when(r == "alto", 30).when(r == "medio", 15).otherwise(0) + F.when(occupancy >= 0.90, 25).when(occupancy >= 0.80, 15).otherwise(0)
    for holds, p in ((n("presion_ingresos_camas") > 1, 15), (n("diferencia_ingresos_egresos") > 0, 10), (n("promedio_estancia") > 7, 10), (n("rotacion_camas") < 1, 5), (n("ratio_camas_disponibles") <= 0.10, 10)):
        total = total + points(holds, p)
    return F.least(total, F.lit(100))


def gap_level(score: Column) -> Column:
    return F.when(score >= 70, S.GAP_LEVELS[0]).when(score >= 40, S.GAP_LEVELS[1]).otherwise(S.GAP_LEVELS[2])


def indicator_map() -> Column:
    return F.create_map(*[x for c in S.SUPPORT_INDICATORS for x in (F.lit(c), _number(c))])


def diagnosis(risk: Column, cause: Column) -> Column:
    a, b, c = S.DIAGNOSIS
    told = F.when(F.coalesce(risk, F.lit("")) == "", "sin datos").otherwise(risk)
    return F.concat(F.lit(a), F.upper(told), F.lit(b), F.lower(cause), F.lit(c))


def recommendations(cause: Column) -> Column:
    texts = lambda xs: F.array(*map(F.lit, xs))
    out = None
    for name, xs in S.RECOMMENDATIONS.items():
        out = F.when(cause == name, texts(xs)) if out is None else out.when(cause == name, texts(xs))
    return out.otherwise(texts(S.OTHER_RECOMMENDATIONS))


def model_text(risk: Column, confidence: Column, model: str) -> Column:
    a, b, c, d = S.MODEL_TEXT
    return F.concat(F.lit(a + model + b), F.upper(risk), F.lit(c), one_decimal(confidence * 100), F.lit("%" + d))


def with_traffic_light(df: DataFrame, risk: str) -> DataFrame:
    r = normalized_risk(F.col(risk))
    pick = lambda k: F.when(r == "alto", S.LIGHTS["alto"][k]).when(r == "medio", S.LIGHTS["medio"][k]).otherwise(S.LIGHTS["bajo"][k])
    return df.withColumns({"color_semaforo": pick(0), "interpretacion_riesgo": pick(1), "recomendacion_riesgo": pick(2)})


def occupancy_band(ratio: Column) -> Column:
    none, over, high, moderate, low = S.BANDS
    return F.when(ratio.isNull(), none).when(ratio >= 1.0, over).when(ratio >= 0.85, high).when(ratio >= 0.70, moderate).otherwise(low)


def risk_factors(risk: Column) -> Column:
    """The ordered explanations that apply; a missing indicator skips its rule."""
    f, r, c = S.FACTORS, normalized_risk(risk), F.col
    occupancy, pressure = c("ocupacion_estimada"), c("presion_ingresos_camas")
    return F.array_compact(F.array(
        F.when(occupancy >= 1.0, f["over"]).when(occupancy >= 0.85, f["high"]).when(occupancy >= 0.70, f["moderate"]).when(occupancy.isNotNull(), f["low"]),
        F.when((c("total_camas_disponibles") > 0) & (c("total_pacientes_camas") > c("total_camas_disponibles")), f["patients"]),
        F.when((c("promedio_estancia") > 7) | ((c("total_estancias") > 0) & r.isin("medio", "alto")), f["stays"]),
        F.when(pressure >= 1, f["pressure"]).when(pressure.isNotNull() & (r == "medio"), f["review"]),
        F.lit(f["model"]),
    ))


def with_support(df: DataFrame, risk: str, confidence: str, model: str) -> DataFrame:
    r, c = F.col(risk), F.col(confidence)
    df = df.withColumns({"indicadores_calculados": indicator_map(), "causa_principal_riesgo": main_cause(r), "brecha_operativa": gap_score(r)})
    cause = F.col("causa_principal_riesgo")
    return df.withColumns({"nivel_brecha_operativa": gap_level(F.col("brecha_operativa")), "diagnostico_operativo": diagnosis(r, cause), "recomendaciones_operativas": recommendations(cause), "interpretacion_modelo": model_text(r, c, model), "confianza_prediccion": c})
