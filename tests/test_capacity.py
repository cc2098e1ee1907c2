"""Unit tests of the capacity engine on small frames."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from aforo import schema as S
from aforo.functions import indicators as I
from aforo.functions import support as D
from aforo.operators import clean, evaluation, headers, quality, risk, rollup, temporal
from aforo.sources import delimited

RAW = {"ANHO": "2020", "MES": "1", "UBIGEO": "150101", "DEPARTAMENTO": "LIMA", "PROVINCIA": "LIMA", "DISTRITO": "LIMA", "SECTOR": "MINSA", "CATEGORIA": "III-1", "CO_IPRESS": "00000001", "RAZON_SOC": "IPRESS PRUEBA", "ID_HOSPITALIZACION": "241500", "HOSPITALIZACION": "HOSPITALIZACION GENERAL", "NRO_TOTAL_HOSPIT_ING": "10", "NRO_TOTAL_HOSPIT_EGR": "8", "NRO_TOTAL_ESTANCIAS": "40", "NRO_TOTAL_PACIENTES_CAMAS": "100", "NRO_TOTAL_CAMAS": "10", "NRO_TOTAL_CAMAS_DISPONIB": "310", "NRO_TOTAL_FALLECIDOS": "0"}


def rows(spark, dicts, schema):
    names = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple(d.get(n) for n in names) for d in dicts], schema)


def raw(spark, *changes):
    return rows(spark, [{**RAW, "ARCHIVO_ORIGEN": "a.csv", **c} for c in changes], ", ".join(f"{c} string" for c in [*RAW, "ARCHIVO_ORIGEN"]))


def write_csv(folder, name, *changes, sep=",", encoding="utf-8-sig", rename=None):
    names = [(rename or {}).get(c, c) for c in RAW]
    lines = [sep.join(names)] + [sep.join(f'"{({**RAW, **c})[n]}"' for n in RAW) for c in changes]
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding=encoding) as f:
        f.write("\n".join(lines) + "\n")


def test_csv_directory_reads_dialects_aliases_and_skips_empty_files(spark, tmp_path):
    write_csv(tmp_path, "a.csv", {}, {"RAZON_SOC": "NA"})
    write_csv(tmp_path, "b.csv", {"DISTRITO": "JESÚS\nMARÍA"}, sep=";", encoding="latin1", rename={"NRO_TOTAL_CAMAS_DISPONIB": "DIAS_CAMA_DISPONIBLE"})
    write_csv(tmp_path, "solo.csv")
    (tmp_path / "~c.csv").write_text("x")
    (tmp_path / "$d.csv").write_text("x")
    (tmp_path / "nota.txt").write_text("x")
    df, empty = delimited.scan_directory(spark, str(tmp_path))
    got = {(r.ARCHIVO_ORIGEN, r.DISTRITO, r.RAZON_SOC, r.NRO_TOTAL_CAMAS_DISPONIB) for r in df.collect()}
    assert got == {("a.csv", "LIMA", "IPRESS PRUEBA", "310"), ("a.csv", "LIMA", None, "310"), ("b.csv", "JESÚS\nMARÍA", "IPRESS PRUEBA", "310")}
    assert empty == ["solo.csv"]


def test_empty_csv_and_missing_columns_are_errors(spark, tmp_path):
    write_csv(tmp_path / "e", "a.csv")
    with pytest.raises(delimited.EmptyCsvError):
        delimited.scan_csv(spark, str(tmp_path / "e" / "a.csv"))
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.csv").write_text("ANHO,MES\n2020,1\n")
    with pytest.raises(ValueError, match="a.csv.*CO_IPRESS"):
        delimited.scan_directory(spark, str(tmp_path / "m"))


def test_headers(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Código RENIPRESS", "codigo-ipress", " Año "])
    out, warnings = headers.template_header(df)
    assert out.columns == ["codigo_ipress", "ano"] and out.first()[0] == 1 and len(warnings) == 1
    assert headers.detect_format(RAW) == headers.D1
    assert headers.detect_format(S.TEMPLATE_REQUIRED) == headers.INTERNAL
    assert headers.detect_format(["x"]) == headers.UNKNOWN


def test_cleaning(spark):
    df = raw(spark, {}, {}, {"DEPARTAMENTO": " lima  "}, {"HOSPITALIZACION": "  "}, {"ID_HOSPITALIZACION": "NE_0001"}, {"MES": "13"}, {"ANHO": "x"}, {"ANHO": "2021.0", "NRO_TOTAL_HOSPIT_ING": "1,234", "NRO_TOTAL_HOSPIT_EGR": "-3", "NRO_TOTAL_CAMAS": "1.5d", "NRO_TOTAL_FALLECIDOS": "nan"})
    got = clean.clean_records(df).collect()
    assert len(got) == 3 and {r.DEPARTAMENTO for r in got} == {"LIMA"}
    odd = next(r for r in got if r.ANHO == 2021)
    assert (odd.NRO_TOTAL_HOSPIT_ING, odd.NRO_TOTAL_HOSPIT_EGR, odd.NRO_TOTAL_CAMAS, odd.NRO_TOTAL_FALLECIDOS) == (1234.0, 0.0, 0.0, 0.0)
    rolled = rollup.monthly_rollup(clean.filter_scope(clean.clean_records(df)))
    assert rolled.where("ANHO = 2020").first().NRO_TOTAL_HOSPIT_ING == 20.0
    with pytest.raises(ValueError):
        clean.filter_scope(clean.clean_records(df), department="CUSCO", strict=True)


def test_indicators_and_zero_divisions(spark):
    schema = "anio int, mes int, total_ingresos double, total_egresos double, total_estancias double, total_pacientes_camas double, total_camas double, total_camas_disponibles double, total_fallecidos double"
    df = rows(spark, [dict(anio=2024, mes=12, total_ingresos=90.0, total_egresos=0.0, total_estancias=5.0, total_pacientes_camas=3720.0, total_camas=120.0, total_camas_disponibles=3720.0, total_fallecidos=1.0), dict(anio=2023, mes=2, total_ingresos=7.0, total_egresos=2.0, total_estancias=4.0, total_pacientes_camas=1.0, total_camas=0.0, total_camas_disponibles=0.0, total_fallecidos=0.0)], schema)
    a, b = sorted(I.with_indicators(df).collect(), key=lambda r: -r.anio)
    assert (a.dias_mes, a.promedio_estancia, a.ocupacion_estimada, a.presion_ingresos_camas) == (31, 0.0, 1.0, 0.75)
    assert (b.dias_mes, b.presion_ingresos_camas, b.ratio_camas_disponibles, b.rotacion_camas) == (28, 7.0, 0.0, 0.0)
    assert spark.range(1).select(I.next_period(F.lit(2024), F.lit(12)).alias("p")).first().p == "2025-01"


def series(spark, months, values=None):
    values = values or [10.0 * m for m in months]
    data = [("A", "S", 2024, m, 0.4, 0.2, v, v, v) for m, v in zip(months, values)]
    return spark.createDataFrame(data, "codigo_ipress string, servicio_hospitalizacion string, anio int, mes int, ocupacion_estimada double, presion_ingresos_camas double, total_ingresos double, total_egresos double, total_estancias double")


def test_gap_aware_features(spark):
    got = {r.mes: r for r in temporal.with_temporal(series(spark, [1, 3, 4], [10.0, 20.0, 60.0])).collect()}
    assert [got[m].promedio_movil_3m_ingresos for m in (1, 3, 4)] == [10.0, 20.0, 40.0]
    assert [got[m].tendencia_ingresos_1m for m in (1, 3, 4)] == [0.0, 0.0, 40.0]
    full = {r.mes: r for r in temporal.with_history_flag(temporal.with_temporal(series(spark, [1, 2, 3]))).collect()}
    assert full[2].promedio_movil_3m_ingresos == 15.0 and full[3].historial_completo and not full[2].historial_completo


def test_one_exchange_for_all_temporal_features(spark):
    plan = temporal.with_temporal(series(spark, [1, 2, 3]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_future_target_needs_the_next_month(spark):
    df = series(spark, [1, 2, 4]).withColumn("nivel_riesgo_actual", F.when(F.col("mes") == 2, "medio").otherwise("bajo")).withColumn("nivel_riesgo_actual_codificado", risk.risk_code("nivel_riesgo_actual"))
    got = temporal.with_future_target(df).collect()
    assert [(r.periodo_actual, r.periodo_predicho, r.nivel_riesgo_siguiente_mes) for r in got] == [("2024-01", "2024-02", "medio")]
    assert temporal.next_month_join(df).count() == 1
    with pytest.raises(ValueError):
        temporal.check_periods(series(spark, [1, 1]))


def test_current_risk_with_nan_and_given_percentiles(spark):
    df = spark.createDataFrame([(float("nan"), 0.5, 0.1), (0.86, 0.5, 0.1), (0.1, 0.15, 0.1), (0.1, 0.5, 2.0)], "ocupacion_estimada double, ratio_camas_disponibles double, presion_ingresos_camas double")
    assert [r.nivel_riesgo_actual for r in risk.with_current_risk(df, (1.0, 2.0)).collect()] == ["bajo", "alto", "medio", "alto"]
    p = rollup.pressure_percentiles(spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (float("inf"),)], "presion_ingresos_camas double")).first()
    assert (p[0], p[1], p[2]) == (1.5, 1.75, 2)


TEMPLATE = {"codigo_renipress": "00006207", "anio": "2026", "mes": "3", "servicio_hospitalario": "Medicina", "ingresos": "80", "egresos": "75", "estancias": "350", "pacientes_cama": "704", "camas_totales": "100", "camas_disponibles_habilitadas": "715"}


def template(spark, *changes):
    df = rows(spark, [{**TEMPLATE, **c} for c in changes], ", ".join(f"{c} string" for c in TEMPLATE))
    return headers.template_header(df)[0].withColumn("fila", F.monotonically_increasing_id())


def test_template_validation(spark):
    assert quality.validation_summary(template(spark, {})).first().registros_validos == 1
    twice = quality.validation_summary(template(spark, {}, {"servicio_hospitalario": " medicina"})).first()
    assert (twice.registros_validos, twice.n_duplicados, twice.n_claves_duplicadas) == (0, 2, 1)
    bad = quality.all_errors(template(spark, {"anio": None, "mes": "13", "ingresos": "-1"}))
    assert {(r.campo) for r in bad.collect()} == {"anio", "mes", "total_ingresos"} and bad.where("campo = 'anio'").count() == 2
    assert quality.missing_columns(["anio"])


SUPPORT = {"ocupacion_estimada": 0.91, "presion_ingresos_camas": 1.2, "promedio_estancia": 8.0, "rotacion_camas": 0.8, "diferencia_ingresos_egresos": 5.0, "ratio_camas_disponibles": 0.08, "total_ingresos": 90.0, "total_egresos": 85.0, "total_camas": 75.0, "total_camas_disponibles": 210.0}


def test_decision_support(spark):
    schema = ", ".join(f"{c} double" for c in SUPPORT) + ", nivel string, c double"
    df = rows(spark, [{**SUPPORT, "nivel": "alto", "c": 0.9}, {**SUPPORT, "nivel": "medio", "c": 0.5, "ocupacion_estimada": 0.75, "ratio_camas_disponibles": 0.5}, {"nivel": "bajo", "c": 0.1}], schema)
    a, b, c = D.with_support(df, "nivel", "c", "Modelo").collect()
    assert (a.causa_principal_riesgo, a.brecha_operativa, a.nivel_brecha_operativa) == ("Ocupación crítica", 100, "Brecha crítica")
    assert b.causa_principal_riesgo == "Demanda supera egresos" and len(b.recomendaciones_operativas) == 3
    assert c.causa_principal_riesgo == "Capacidad disponible limitada" and c.indicadores_calculados["total_camas"] == 0.0
    text = spark.createDataFrame([(0.85,), (1.37,), (1.4,), (None,)], "r double").select(I.occupancy_text(F.col("r")).alias("t"))
    assert [r.t for r in text.collect()] == ["85.0%", "137.0%", "140.0%", "Sin dato"]


def test_risk_factors_skip_missing(spark):
    schema = "ocupacion_estimada double, total_pacientes_camas double, total_camas_disponibles double, total_estancias double, promedio_estancia double, presion_ingresos_camas double, nivel string"
    df = spark.createDataFrame([(1.05, 1050.0, 1000.0, None, 8.0, 1.2, "alto"), (None, None, None, None, None, None, "medio")], schema)
    a, b = [r.f for r in df.select(D.risk_factors(F.col("nivel")).alias("f")).collect()]
    assert a == [S.FACTORS[k] for k in ("over", "patients", "stays", "pressure", "model")] and b == [S.FACTORS["model"]]


def test_metrics_reproduce_the_published_matrix(spark):
    matrix = [[652, 161, 13], [129, 760, 175], [59, 503, 2510]]
    counts = spark.createDataFrame([("m", y, p, matrix[y][p]) for y in range(3) for p in range(3)], "modelo string, y int, yhat int, n long")
    m = evaluation.classification_metrics(counts).first()
    want = {"accuracy": 0.7904070939, "balanced_accuracy": 0.7735630843, "precision_macro": 0.7467390320, "specificity_macro": 0.8949102630, "f1_macro": 0.7545542974}
    assert all(abs(m[k] - v) < 1e-9 for k, v in want.items())


def test_auc_counts_ties_half_and_is_null_without_a_class(spark):
    scored = spark.createDataFrame([("m", 0, 0.5, 0.2, 0.3), ("m", 1, 0.5, 0.4, 0.1), ("m", 2, 0.1, 0.2, 0.7)], "modelo string, y int, p0 double, p1 double, p2 double")
    assert abs(evaluation.roc_auc_ovr(scored).first()[1] - (0.75 + 1 + 1) / 3) < 1e-12
    assert evaluation.roc_auc_ovr(scored.where("y < 2")).first()[1] is None


def test_stratified_sizes_of_the_published_classes(spark):
    df = spark.range(46309).select(F.when(F.col("id") < 8187, 0).when(F.col("id") < 18498, 1).otherwise(2).alias(evaluation.TARGET))
    assert {r.clase: r.n_test for r in evaluation.stratified_sizes(df).collect()} == {0: 1638, 1: 2062, 2: 5562}


def test_predictors_never_leak():
    assert not set(S.PREDICTORS) & set(S.NEVER_PREDICTORS) and len(S.PREDICTORS) == 37 and len(S.OUTPUT) == 48


def test_history_rules(spark):
    now, past = series(spark, [6]), series(spark, [4, 5, 5, 7])
    assert {r.motivo for r in temporal.history_violations(now, past).collect()} == {"posterior", "duplicado"}
    got = temporal.score_rows(now, series(spark, [4, 5, 9])).first()
    assert got.historial_completo and got.promedio_movil_3m_ingresos == 50.0


def test_upsert_takes_the_latest(spark):
    old = spark.createDataFrame([("a", "2024-01", "x"), ("b", "2024-05", "y")], "indicador_id string, fecha string, nivel string")
    new = spark.createDataFrame([("a", "2024-01", "z"), ("b", "2024-02", "w")], "indicador_id string, fecha string, nivel string")
    assert {r.indicador_id: r.nivel for r in rollup.prediction_upsert(old, new).collect()} == {"a": "z", "b": "y"}


def test_white_space_of_any_kind_is_trimmed_and_collapsed(spark):
    values = ["a b", " a  b ", "　a  b\t", "a\x0bb ", "", "  ", None, "á\u0085é", "a\x1cb", "a\x7fb"]
    got = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").select("k", clean.clean_text(F.col("v")).alias("t"), clean.parse_number(F.concat(F.lit(" "), F.lit("1.5"), F.lit("\t　"))).alias("n")).orderBy("k").collect()
    assert [r.t for r in got] == ["A B", "A B", "A B", "A B", "", "", "", "Á É", "A\x1cB", "A\x7fB"]
    assert {r.n for r in got} == {1.5}


def test_exact_percentiles_equal_those_of_one_reducer(spark):
    rng = np.random.default_rng(7)
    inf, nan = float("inf"), float("nan")
    rows = [("many", float(x)) for x in np.concatenate([rng.exponential(5, 500), rng.normal(0, 3, 500).round(1)])] + [("many", None), ("none", None), ("one", 2.5)]
    rows += [("ends", x) for x in (1.0, 2.0, -1.0, -inf, inf)] + [("zero", x) for x in (1.0, nan, 3.0, 0.0, -0.0)]
    df, shares = spark.createDataFrame(rows, "g string, v double"), [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    # values compare as numbers: the percentile function keeps the sign of a zero, grouping does not
    got = {r.g: (r.n, r.p) for r in rollup.exact_percentiles(df, F.col("v"), shares, "g").collect()}
    want = df.groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", shares).alias("p")).where("n > 0").collect()
    assert got.keys() == {r.g for r in want}
    for r in want:
        n, p = got[r.g]
        assert n == r.n and p == pytest.approx(r.p, rel=0, abs=0, nan_ok=True)
    (empty,) = rollup.exact_percentiles(df.where("false"), F.col("v"), shares).collect()
    assert (empty.n, empty.p) == (0, [])
