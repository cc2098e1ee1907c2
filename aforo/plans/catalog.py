"""Every registered query of the capacity engine, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import indicators as I
from ..functions import support as D
from ..operators import clean, evaluation, headers, learning, quality, risk, rollup, temporal
from ..sources import delimited
from ..sources.scratch import scratch
from . import panel as P
from .sql_views import NUM, PRD, REQ, over

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_ID = ["codigo_ipress", "servicio_hospitalizacion", "anio", "mes"]
_IDS = ", ".join(_ID)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in columns})  # no negative zeros


def _round(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


# --- sources and headers ------------------------------------------------------------------------------------------


def _written(spark: SparkSession, sf_dir: str) -> str:
    """The raw table as delimited files in two dialects, one with the aliased column."""
    folder = scratch(spark, "csv")
    raw = P.raw(spark, sf_dir).drop("ARCHIVO_ORIGEN")
    years = F.col("ANHO").try_cast("int") < 1998
    raw.where(years).write.csv(folder + "/a", header=True, sep=";", encoding="ISO-8859-1")
    raw.where(~years | years.isNull()).withColumnRenamed("NRO_TOTAL_CAMAS_DISPONIB", "dias cama disponible").write.csv(folder + "/b", header=True)
    return folder


@query("dialect_detect", over("raw", select="SELECT CASE WHEN y < 1998 THEN ';' ELSE ',' END AS separador, 'UTF-8' AS codificacion, count(*) AS n_filas FROM (SELECT coalesce(TRY_CAST(ANHO AS INTEGER), 9999) AS y FROM raw) GROUP BY 1"))
def dialect_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of values by dialect; the files of either have no byte beyond ASCII."""
    return delimited.dialects(spark, _written(spark, sf_dir) + "/*").groupBy("separador", "codificacion").agg(F.sum(F.col("n_lineas") - 1).alias("n_filas"))


@query("scan_csv", over("raw", select="SELECT ANHO, count(*) AS n FROM raw GROUP BY ANHO"))
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _written(spark, sf_dir)
    both = delimited.scan_csv(spark, folder + "/a").select("ANHO").union(delimited.scan_csv(spark, folder + "/b").select("ANHO"))
    return both.groupBy("ANHO").agg(F.count("*").alias("n"))


@query("scan_csv_dir", over("raw", select="SELECT ANHO, count(*) AS n, count(NRO_TOTAL_CAMAS_DISPONIB) AS con_camas, count(*) AS con_archivo FROM raw GROUP BY ANHO"))
def scan_csv_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited.scan_directory(spark, _written(spark, sf_dir) + "/*")[0].groupBy("ANHO").agg(F.count("*").alias("n"), F.count("NRO_TOTAL_CAMAS_DISPONIB").alias("con_camas"), F.count("ARCHIVO_ORIGEN").alias("con_archivo"))


@query("scan_dataset", over("fut", select="SELECT anio, count(*) AS n, min(codigo_ipress) AS primero FROM fut GROUP BY anio"))
def scan_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "dataset")
    full = P.training(spark, sf_dir).select("codigo_ipress", "mes", "periodo_predicho", "nivel_riesgo_siguiente_mes", "anio")
    delimited.write_dataset(full, path)
    return delimited.scan_dataset(spark, path, schema=full.schema).groupBy("anio").agg(F.count("*").alias("n"), F.min("codigo_ipress").alias("primero"))


_RAW_ALL = ", ".join([*S.RAW_KEYS, *S.RAW_MEASURES])


@query("header_raw", over("raw", select=f"SELECT {_RAW_ALL} FROM raw"))
def header_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = P.raw(spark, sf_dir)
    loose = raw.withColumnRenamed("NRO_TOTAL_CAMAS_DISPONIB", "dias  cama disponible").toDF(*[f" {c.lower()} " for c in raw.columns[:-3]], " dias  cama disponible ", *raw.columns[-2:])
    return headers.raw_header(loose).select(*S.RAW_KEYS, *S.RAW_MEASURES)


@query("header_template", over("tpl", select=f"SELECT fila, {', '.join(S.TEMPLATE_REQUIRED)} FROM tpl"))
def header_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = {v: k for k, v in S.TEMPLATE_ALIASES.items()}
    t = P.template(spark, sf_dir)
    return headers.template_header(t.toDF(*[back.get(c, c).replace("_", " ").title() for c in t.columns]))[0].select("fila", *S.TEMPLATE_REQUIRED)


@query("header_dups", over("tpl", select="SELECT fila, total_ingresos, anio AS ano, CAST(1 AS INTEGER) AS advertencias FROM tpl"))
def header_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.template(spark, sf_dir).select("fila", "total_ingresos", F.col("total_egresos").alias("Ingresos"), F.col("anio").alias("AÑO"))
    df, warnings = headers.template_header(t)
    return df.withColumn("advertencias", F.lit(len(warnings)))


@query("detect_format", over("raw", select=f"SELECT '{headers.D1}' AS formato, count(*) AS n_filas FROM raw"))
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = delimited.dialects(spark, _written(spark, sf_dir) + "/*")
    return found.withColumn("formato", headers.format_of(F.col("encabezado"), F.col("separador"))).groupBy("formato").agg(F.sum(F.col("n_lineas") - 1).alias("n_filas"))


@query("rename", over("rol", select=f"SELECT {', '.join(f'{a} AS {b}' for a, b in S.PUBLIC_NAMES.items())} FROM rol"))
def rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.public_names(_rolled(spark, sf_dir))


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_records(P.raw(spark, sf_dir))


def _rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.monthly_rollup(clean.filter_scope(_cleaned(spark, sf_dir)))


# --- cleaning -----------------------------------------------------------------------------------------------------


@query("dedup_exact", over("raw", select=f"SELECT DISTINCT {_RAW_ALL} FROM raw"))
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_exact_copies(P.raw(spark, sf_dir)).select(*S.RAW_KEYS, *S.RAW_MEASURES)


@query("clean_text", over("txt", select=f"SELECT {', '.join(S.RAW_TEXTS)}, count(*) AS n FROM txt GROUP BY ALL"))
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.frequencies(clean.clean_texts(clean.drop_exact_copies(P.raw(spark, sf_dir))), *S.RAW_TEXTS)


@query("filter_service", over("svc", select="SELECT ID_HOSPITALIZACION, HOSPITALIZACION, count(*) AS n FROM svc GROUP BY ALL"))
def filter_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.frequencies(clean.filter_services(clean.clean_texts(clean.drop_exact_copies(P.raw(spark, sf_dir)))), "ID_HOSPITALIZACION", "HOSPITALIZACION")


@query("clean_period", over("per", select="SELECT ANHO, MES, count(*) AS n FROM per GROUP BY ALL"))
def clean_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.frequencies(_cleaned(spark, sf_dir), "ANHO", "MES")


@query("clean_numeric", over("cln", select=f"SELECT {', '.join(S.RAW_MEASURES)}, count(*) AS n FROM cln GROUP BY ALL"))
def clean_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.frequencies(_cleaned(spark, sf_dir), *S.RAW_MEASURES)


@query("filter_scope", over("sco", select="SELECT SECTOR, CO_IPRESS, count(*) AS n FROM sco GROUP BY ALL"))
def filter_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.frequencies(clean.filter_scope(_cleaned(spark, sf_dir)), "SECTOR", "CO_IPRESS")


_BED_SQL = f"SELECT {_IDS}, sector, id_hospitalizacion, total_fallecidos, CASE WHEN l = 0 THEN total_camas_disponibles * day(last_day(make_date(anio, mes, 1))) ELSE total_camas_disponibles END AS total_camas_disponibles FROM (SELECT {_IDS}, CAST(codigo_ipress AS BIGINT) % 2 AS l, CASE WHEN CAST(codigo_ipress AS BIGINT) % 2 = 0 THEN 'MINSA' ELSE sector END AS sector, id_hospitalizacion, CASE WHEN CAST(codigo_ipress AS BIGINT) % 2 = 0 THEN 0.0 ELSE total_fallecidos END AS total_fallecidos, total_camas_disponibles FROM panel)"


@query("to_bed_days", over("panel", select=_BED_SQL))
def to_bed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    internal = F.col("codigo_ipress").cast("long") % 2 == 0
    p = P.panel(spark, sf_dir).withColumn("formato", F.when(internal, headers.INTERNAL).otherwise(headers.D1))
    p = p.withColumns({c: F.when(~internal, F.col(c)) for c in ("sector", "id_hospitalizacion", "total_fallecidos")})
    return clean.to_bed_days(p).select(*_ID, "sector", "id_hospitalizacion", "total_fallecidos", "total_camas_disponibles")


@query("union_sources", over("panel", select=f"SELECT {_IDS}, sector, CAST(NULL AS DOUBLE) AS total_ingresos FROM panel WHERE anio < 1998 UNION ALL SELECT {_IDS}, NULL, total_ingresos FROM panel WHERE anio >= 1998"))
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.panel(spark, sf_dir)
    return p.where("anio < 1998").select(*_ID, "sector").unionByName(p.where("anio >= 1998").select(*_ID, "total_ingresos"), allowMissingColumns=True)


# --- indicators, roll-ups -----------------------------------------------------------------------------------------

_FLOATS = [c for c in S.INDICATORS if c != "dias_mes"]


@query("indicators", over("ind", select=f"SELECT {_IDS}, dias_mes, {_round(*_FLOATS)} FROM ind"))
def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.indicators(spark, sf_dir).select(*_ID, *S.INDICATORS), *_FLOATS)


@query("calendar_features", over("tmp", select=f"SELECT {_IDS}, trimestre, semestre, {_round('mes_sin', 'mes_cos')}, es_fin_de_anio FROM tmp"))
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(I.with_calendar(P.panel(spark, sf_dir)).select(*_ID, *S.CALENDAR), "mes_sin", "mes_cos")


@query("next_period", over("panel", select=f"SELECT {_IDS}, strftime(make_date(anio, mes, 1) + INTERVAL 1 MONTH, '%Y-%m') AS periodo_siguiente, printf('%04d-%02d', anio, mes) AS periodo FROM panel"))
def next_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.panel(spark, sf_dir).select(*_ID, I.next_period(F.col("anio"), F.col("mes")).alias("periodo_siguiente"), I.period(F.col("anio"), F.col("mes")).alias("periodo"))


@query("occupancy_text", over("ind", select=f"SELECT {_IDS}, CASE WHEN total_camas = 0 THEN 'Sin dato' ELSE printf('%.1f%%', floor(ocupacion_estimada * 100 * 10 + 0.5) / 10) END AS texto FROM ind"))
def occupancy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.indicators(spark, sf_dir).select(*_ID, I.occupancy_text(F.when(F.col("total_camas") != 0, F.col("ocupacion_estimada"))).alias("texto"))


@query("monthly_rollup", over("rol", select="SELECT * FROM rol"))
def monthly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(spark, sf_dir)


_CAP = "coalesce((max({0}) - min({0})) / nullif(max({0}), 0) > 0.2, false)".format
_CAP_SQL = f"SELECT codigo_ipress, anio, mes, 'TODOS' AS servicio_hospitalizacion, {', '.join(f'sum({c}) AS {c}' for c in ('total_ingresos', 'total_egresos', 'total_estancias', 'total_pacientes_camas', 'total_fallecidos'))}, max(total_camas) AS total_camas, max(total_camas_disponibles) AS total_camas_disponibles, {_CAP('total_camas')} OR {_CAP('total_camas_disponibles')} AS capacidad_difiere FROM (SELECT DISTINCT * FROM panel) GROUP BY codigo_ipress, anio, mes"


@query("rollup_max_capacity", over("panel", select=_CAP_SQL))
def rollup_max_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.panel(spark, sf_dir)
    return rollup.rollup_max_capacity(p.unionByName(p.where("mes = 3")).withColumn("id", F.col("servicio_hospitalizacion")).withColumn("servicio_hospitalizacion", F.lit("TODOS")))


@query("pressure_percentiles", over("pct", select="SELECT p50 AS presion_ingresos_camas_percentil_50, p75 AS presion_ingresos_camas_percentil_75, n AS cantidad_valores_validos FROM pct"))
def pressure_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.pressure_percentiles(P.indicators(spark, sf_dir))


_STATS = "count({0}) AS n, round(avg({0}), 6) AS media, round(stddev_samp({0}), 6) AS desviacion, round(min({0}), 6) AS minimo, round(quantile_cont({0}, 0.25), 6) AS p25, round(quantile_cont({0}, 0.5), 6) AS p50, round(quantile_cont({0}, 0.75), 6) AS p75, round(max({0}), 6) AS maximo".format


@query("describe_indicators", over("ind", select=" UNION ALL ".join(f"SELECT '{c}' AS indicador, {_STATS(c)} FROM ind" for c in ("ocupacion_estimada", "ratio_camas_disponibles", "presion_ingresos_camas"))))
def describe_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rollup.describe_indicators(P.indicators(spark, sf_dir)), "media", "desviacion", "minimo", "p25", "p50", "p75", "maximo")


@query("anomaly_counts", over("ind", select="SELECT count(*) FILTER (WHERE ratio_camas_disponibles > 1.5) AS ratio_mayor_1_5, count(*) FILTER (WHERE total_camas = 0 AND total_ingresos > 0) AS sin_camas_con_ingresos FROM ind"))
def anomaly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.anomaly_counts(P.indicators(spark, sf_dir))


@query("risk_distribution", over("fut", select="SELECT nivel_riesgo_actual, nivel_riesgo_siguiente_mes, count(*) AS n FROM fut GROUP BY ALL"))
def risk_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.frequencies(P.training(spark, sf_dir), "nivel_riesgo_actual", "nivel_riesgo_siguiente_mes")


@query("complete_years", over("fut", select="SELECT CAST(substr(periodo_predicho, 1, 4) AS INTEGER) AS anio_objetivo, count(DISTINCT periodo_predicho) AS n_meses FROM fut GROUP BY ALL"))
def complete_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.complete_years(P.training(spark, sf_dir))


@query("test_year", over("yr", select="SELECT anio_prueba FROM yr"))
def test_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.test_year(P.training(spark, sf_dir))


_META = "SELECT a.*, b.*, registros_antes - registros_despues AS registros_eliminados FROM (SELECT count(*) AS registros_antes, count(DISTINCT archivo_origen) AS n_archivos, count(DISTINCT anio) AS n_anios FROM ind) a, (SELECT count(*) AS registros_despues, min(periodo_actual) AS primer_periodo, max(periodo_actual) AS ultimo_periodo, count(DISTINCT periodo_actual) AS n_periodos FROM fut) b"


@query("dataset_metadata", over("fut", select=_META))
def dataset_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.dataset_metadata(P.indicators(spark, sf_dir), P.training(spark, sf_dir)).withColumn("n_anios", F.size("anios").cast("long")).drop("anios")


@query("stage_counts", over("rol", select="SELECT 'crudo' AS etapa, count(*) AS registros FROM raw UNION ALL SELECT 'limpio', count(*) FROM cln UNION ALL SELECT 'filtrado', count(*) FROM sco UNION ALL SELECT 'consolidado', count(*) FROM rol"))
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # counted after the copies are gone too, so that texts are cleaned for unlike rows only and not for the filters of all rows
    found = rollup.stage_counts(P.raw(spark, sf_dir), "crudo", unicos=clean.drop_exact_copies, limpio=clean.clean_unlike, filtrado=clean.filter_scope, consolidado=rollup.monthly_rollup)
    return found.where("etapa <> 'unicos'")


# --- series -------------------------------------------------------------------------------------------------------

_MEANS, _TRENDS = list(S.MEANS_3M.values()), list(S.TRENDS_1M.values())


@query("duplicate_periods", over("rol", select="SELECT CO_IPRESS AS codigo_ipress, HOSPITALIZACION AS servicio_hospitalizacion, ANHO AS anio, MES AS mes, count(*) AS n FROM rol GROUP BY ALL HAVING count(*) > 1"))
def duplicate_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.duplicate_periods(clean.public_names(_rolled(spark, sf_dir)))


@query("moving_avg_3m", over("tmp", select=f"SELECT {_IDS}, {_round(*_MEANS)} FROM tmp"))
def moving_avg_3m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(temporal.with_moving_means(P.indicators(spark, sf_dir)).select(*_ID, *_MEANS), *_MEANS)


@query("trend_1m", over("tmp", select=f"SELECT {_IDS}, {_round(*_TRENDS)} FROM tmp"))
def trend_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(temporal.with_trends(P.indicators(spark, sf_dir)).select(*_ID, *_TRENDS), *_TRENDS)


@query("temporal_features", over("tmp", select=f"SELECT {_IDS}, trimestre, semestre, es_fin_de_anio, {_round('mes_sin', 'mes_cos', *_MEANS, *_TRENDS)} FROM tmp"))
def temporal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(temporal.with_temporal(P.indicators(spark, sf_dir)).select(*_ID, *S.TEMPORAL), "mes_sin", "mes_cos", *_MEANS, *_TRENDS)


@query("history_complete", over("tmp", select=f"SELECT {_IDS}, historial_completo FROM tmp"))
def history_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.with_history_flag(P.panel(spark, sf_dir)).select(*_ID, "historial_completo")


_PAST = "ord < 1997 * 12 AND ord >= 1996 * 12 - 2"
_VIOLATIONS = """SELECT DISTINCT codigo_ipress, servicio_hospitalizacion, motivo FROM (
  SELECT h.codigo_ipress, h.servicio_hospitalizacion, 'posterior' AS motivo FROM h JOIN tmp c ON c.codigo_ipress = h.codigo_ipress AND c.servicio_hospitalizacion = h.servicio_hospitalizacion AND c.anio = 1996 AND c.mes = 12 WHERE h.ord >= c.ord
  UNION ALL SELECT codigo_ipress, servicio_hospitalizacion, 'duplicado' FROM h GROUP BY codigo_ipress, servicio_hospitalizacion, ord HAVING count(*) > 1
  UNION ALL SELECT codigo_ipress, servicio_hospitalizacion, 'demasiados' FROM h GROUP BY codigo_ipress, servicio_hospitalizacion HAVING count(*) > 12
  UNION ALL SELECT codigo_ipress, servicio_hospitalizacion, 'ajena' FROM h WHERE NOT EXISTS (SELECT 1 FROM tmp c WHERE c.codigo_ipress = h.codigo_ipress AND c.servicio_hospitalizacion = h.servicio_hospitalizacion AND c.anio = 1996 AND c.mes = 12))"""


@query("history_violations", over("tmp", select="SELECT 1").removesuffix("SELECT 1").rstrip() + f", h AS (SELECT codigo_ipress, servicio_hospitalizacion, ord FROM tmp WHERE {_PAST} UNION ALL SELECT codigo_ipress, servicio_hospitalizacion, ord FROM tmp WHERE {_PAST} AND mes = 5) " + _VIOLATIONS)
def history_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.panel(spark, sf_dir)
    past = p.where((temporal.ordinal() < 1997 * 12) & (temporal.ordinal() >= 1996 * 12 - 2))
    return temporal.history_violations(p.where("anio = 1996 and mes = 12"), past.unionByName(past.where("mes = 5")))


@query("future_target", over("fut", select=f"SELECT {_IDS}, periodo_actual, periodo_predicho, nivel_riesgo_actual, nivel_riesgo_siguiente_mes, nivel_riesgo_siguiente_mes_codificado FROM fut"))
def future_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.with_future_target(P.labelled(spark, sf_dir)).select(*_ID, "periodo_actual", "periodo_predicho", "nivel_riesgo_actual", "nivel_riesgo_siguiente_mes", "nivel_riesgo_siguiente_mes_codificado")


@query("next_month_join", over("fut", select=f"SELECT {_IDS}, nivel_riesgo_siguiente_mes FROM fut"))
def next_month_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.next_month_join(P.labelled(spark, sf_dir)).select(*_ID, "nivel_riesgo_siguiente_mes")


@query("project_output", over("fut", select=f"SELECT {', '.join(c for c in S.OUTPUT if c not in [*_FLOATS, 'mes_sin', 'mes_cos', *_MEANS, *_TRENDS])}, {_round(*_FLOATS, 'mes_sin', 'mes_cos', *_MEANS, *_TRENDS)} FROM fut"))
def project_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(clean.project_output(P.training(spark, sf_dir)), *_FLOATS, "mes_sin", "mes_cos", *_MEANS, *_TRENDS)


@query("score_with_history", over("tmp", select=f"SELECT {_IDS}, historial_completo, {_round(*_MEANS, *_TRENDS)} FROM tmp"))
def score_with_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every month of every series as a request, with the whole panel as history."""
    p = P.indicators(spark, sf_dir)
    return _rounded(temporal.score_rows(p, p).select(*_ID, "historial_completo", *_MEANS, *_TRENDS), *_MEANS, *_TRENDS)


@query("risk_current", over("rsk", select=f"SELECT {_IDS}, nivel_riesgo_actual, nivel_riesgo_actual_codificado FROM rsk"))
def risk_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.labelled(spark, sf_dir).select(*_ID, "nivel_riesgo_actual", "nivel_riesgo_actual_codificado")


# --- checks -------------------------------------------------------------------------------------------------------


@query("validate_schema", over("tpl", select="SELECT count(*) AS registros, 'Faltan columnas obligatorias: mes, total_camas' AS error, 0 AS registros_validos FROM tpl"))
def validate_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.template(spark, sf_dir).drop("mes", "total_camas")
    return t.agg(F.count("*").alias("registros")).withColumns({"error": F.lit(quality.missing_columns(t.columns)[0]), "registros_validos": F.lit(0)})


@query("validate_required", over("req", select="SELECT * FROM req"))
def validate_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.required_errors(P.template(spark, sf_dir))


@query("validate_period", over("prd", select="SELECT * FROM prd"))
def validate_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.period_errors(P.template(spark, sf_dir))


@query("validate_numeric", over("num", select="SELECT * FROM num"))
def validate_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.numeric_errors(P.template(spark, sf_dir))


@query("validate_duplicates", over("clv", select="SELECT fila, codigo_ipress, anio, mes, servicio_hospitalizacion FROM clv WHERE veces > 1"))
def validate_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_rows(P.template(spark, sf_dir))


@query("duplicate_keys", over("clv", select="SELECT DISTINCT codigo_ipress, anio, mes, servicio_hospitalizacion FROM clv WHERE veces > 1"))
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_keys(P.template(spark, sf_dir))


_SUMMARY = """SELECT registros, n_errores, n_invalidos, n_duplicados, n_claves_duplicadas, registros - n_invalidos AS registros_validos FROM (SELECT count(*) AS registros FROM tpl),
  (SELECT count(*) AS n_errores, count(DISTINCT fila) AS n_invalidos, count(DISTINCT CASE WHEN campo = 'clave' THEN fila END) AS n_duplicados FROM (SELECT fila, campo FROM req UNION ALL SELECT fila, campo FROM prd UNION ALL SELECT fila, campo FROM num UNION ALL SELECT fila, 'clave' FROM clv WHERE veces > 1)),
  (SELECT count(*) AS n_claves_duplicadas FROM (SELECT DISTINCT codigo_ipress, anio, mes, servicio_hospitalizacion FROM clv WHERE veces > 1))"""


@query("validation_summary", over("req", "prd", "num", "clv", select=_SUMMARY))
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.validation_summary(P.template(spark, sf_dir))


@query("input_violations", over("panel", select="SELECT codigo_ipress || '|' || anio || '|' || mes || '|' || servicio_hospitalizacion AS fila, campo, mensaje FROM (SELECT *, 'distrito' AS campo, 'vacío' AS mensaje FROM panel WHERE mes = 4 UNION ALL SELECT *, 'total_camas', 'negativo' FROM panel WHERE total_camas = 0 UNION ALL SELECT *, 'anio', 'fuera de rango' FROM panel WHERE anio = 1999)"))
def input_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.panel(spark, sf_dir).withColumn("fila", F.concat_ws("|", "codigo_ipress", "anio", "mes", "servicio_hospitalizacion"))
    return quality.input_violations(p.withColumns({"distrito": F.when(F.col("mes") == 4, "").otherwise(F.col("distrito")), "total_camas": F.when(F.col("total_camas") == 0, -1.0).otherwise(F.col("total_camas")), "anio": F.when(F.col("anio") == 1999, 1899).otherwise(F.col("anio"))}))


_LATEST = over("rsk", select="SELECT indicador_id, fecha, nivel FROM (SELECT codigo_ipress || servicio_hospitalizacion AS indicador_id, printf('%04d-%02d', anio, mes) AS fecha, upper(nivel_riesgo_actual) AS nivel, row_number() OVER (PARTITION BY codigo_ipress, servicio_hospitalizacion ORDER BY anio DESC, mes DESC) AS rn FROM rsk) WHERE rn = 1")


@query("prediction_upsert", _LATEST)
def prediction_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.labelled(spark, sf_dir).select(F.concat("codigo_ipress", "servicio_hospitalizacion").alias("indicador_id"), I.period(F.col("anio"), F.col("mes")).alias("fecha"), F.upper("nivel_riesgo_actual").alias("nivel"))
    return rollup.prediction_upsert(r.where("fecha < '2000-01'"), r.where("fecha >= '2000-01'"))


@query("stored_upsert", _LATEST)
def stored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stored table, in two batches."""
    r = P.labelled(spark, sf_dir).select(F.concat("codigo_ipress", "servicio_hospitalizacion").alias("indicador_id"), I.period(F.col("anio"), F.col("mes")).alias("fecha"), F.upper("nivel_riesgo_actual").alias("nivel"))
    path = scratch(spark, "stored-predictions")
    for batch in (r.where("fecha < '2000-01'"), r.where("fecha >= '2000-01'")):
        rollup.store_predictions(batch, path)
    return rollup.read_predictions(spark, path, None).drop("cubo")


# --- decision support ---------------------------------------------------------------------------------------------

_CONF = "CAST(anio % 10 AS DOUBLE) / 10 + 0.05"
_CAUSE = f"CASE WHEN ocupacion_estimada >= 0.90 THEN '{S.CAUSE_OCCUPANCY}' WHEN ratio_camas_disponibles <= 0.10 THEN '{S.CAUSE_CAPACITY}' WHEN diferencia_ingresos_egresos > 0 THEN '{S.CAUSE_DEMAND}' WHEN promedio_estancia > 7 THEN '{S.CAUSE_STAY}' WHEN presion_ingresos_camas > 1 THEN '{S.CAUSE_PRESSURE}' WHEN rotacion_camas < 1 THEN '{S.CAUSE_ROTATION}' WHEN nivel_riesgo_actual = 'bajo' THEN '{S.CAUSE_CONTROLLED}' ELSE '{S.CAUSE_MIXED}' END"
_SCORE = "CAST(least(100, CASE nivel_riesgo_actual WHEN 'alto' THEN 30 WHEN 'medio' THEN 15 ELSE 0 END + CASE WHEN ocupacion_estimada >= 0.90 THEN 25 WHEN ocupacion_estimada >= 0.80 THEN 15 ELSE 0 END + CASE WHEN presion_ingresos_camas > 1 THEN 15 ELSE 0 END + CASE WHEN diferencia_ingresos_egresos > 0 THEN 10 ELSE 0 END + CASE WHEN promedio_estancia > 7 THEN 10 ELSE 0 END + CASE WHEN rotacion_camas < 1 THEN 5 ELSE 0 END + CASE WHEN ratio_camas_disponibles <= 0.10 THEN 10 ELSE 0 END) AS INTEGER)"
_LEVEL = f"CASE WHEN brecha_operativa >= 70 THEN '{S.GAP_LEVELS[0]}' WHEN brecha_operativa >= 40 THEN '{S.GAP_LEVELS[1]}' ELSE '{S.GAP_LEVELS[2]}' END"
_DIAG = f"'{S.DIAGNOSIS[0]}' || upper(nivel_riesgo_actual) || '{S.DIAGNOSIS[1]}' || lower({_CAUSE}) || '{S.DIAGNOSIS[2]}'"


def _risk() -> Column:
    return F.col("nivel_riesgo_actual")


def _confidence() -> Column:
    return (F.col("anio") % 10).cast("double") / 10 + 0.05


@query("risk_index", over("rsk", select=f"SELECT {_IDS}, round(CASE nivel_riesgo_actual WHEN 'bajo' THEN greatest(0.0, least(0.33, (1.0 - c) * 0.33)) WHEN 'medio' THEN greatest(0.33, least(0.66, c * 0.33 + 0.33)) ELSE greatest(0.66, least(1.0, c * 0.34 + 0.66)) END, 6) AS indice FROM (SELECT *, greatest(0.0, least(1.0, {_CONF})) AS c FROM rsk)"))
def risk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.labelled(spark, sf_dir).select(*_ID, F.round(D.risk_index(_risk(), _confidence()), 6).alias("indice"))


@query("main_cause", over("rsk", select=f"SELECT {_IDS}, {_CAUSE} AS causa FROM rsk"))
def main_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.labelled(spark, sf_dir).select(*_ID, D.main_cause(_risk()).alias("causa"))


@query("gap_score", over("rsk", select=f"SELECT {_IDS}, brecha_operativa, {_LEVEL} AS nivel_brecha_operativa FROM (SELECT *, {_SCORE} AS brecha_operativa FROM rsk)"))
def gap_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.labelled(spark, sf_dir).select(*_ID, D.gap_score(_risk()).alias("brecha_operativa")).withColumn("nivel_brecha_operativa", D.gap_level(F.col("brecha_operativa")))


@query("indicator_map", over("rsk", select=" UNION ALL ".join(f"SELECT {_IDS}, '{c}' AS indicador, round({c}, 6) AS valor FROM rsk" for c in S.SUPPORT_INDICATORS)))
def indicator_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.labelled(spark, sf_dir).select(*_ID, F.explode(D.indicator_map()).alias("indicador", "valor")).withColumn("valor", F.round("valor", 6))


@query("diagnosis_text", over("rsk", select=f"SELECT {_IDS}, {_DIAG} AS diagnostico FROM rsk"))
def diagnosis_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.labelled(spark, sf_dir).select(*_ID, D.diagnosis(_risk(), D.main_cause(_risk())).alias("diagnostico"))


_RECS = "CASE causa " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in S.RECOMMENDATIONS.items()) + f" ELSE {S.OTHER_RECOMMENDATIONS!r} END"


@query("recommendations", over("rsk", select=f"SELECT {_IDS}, unnest({_RECS}) AS recomendacion, unnest([0, 1, 2]) AS pos FROM (SELECT *, {_CAUSE} AS causa FROM rsk)"))
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.labelled(spark, sf_dir).select(*_ID, F.posexplode(D.recommendations(D.main_cause(_risk()))).alias("pos", "recomendacion"))


_TEXT = f"'{S.MODEL_TEXT[0]}Random_Forest{S.MODEL_TEXT[1]}' || upper(nivel_riesgo_actual) || '{S.MODEL_TEXT[2]}' || printf('%.1f', floor(({_CONF}) * 100 * 10 + 0.5) / 10) || '%{S.MODEL_TEXT[3]}'"


@query("interpretation_text", over("rsk", select=f"SELECT {_IDS}, {_TEXT} AS interpretacion FROM rsk"))
def interpretation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.labelled(spark, sf_dir).select(*_ID, D.model_text(_risk(), _confidence(), "Random_Forest").alias("interpretacion"))


@query("decision_support", over("rsk", select=f"SELECT {_IDS}, causa AS causa_principal_riesgo, brecha_operativa, {_LEVEL} AS nivel_brecha_operativa, diag AS diagnostico_operativo, ocupacion AS ocupacion, round(conf, 6) AS confianza_prediccion FROM (SELECT *, {_CAUSE} AS causa, {_SCORE} AS brecha_operativa, {_DIAG} AS diag, round(ocupacion_estimada, 6) AS ocupacion, {_CONF} AS conf FROM rsk)"))
def decision_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = D.with_support(P.labelled(spark, sf_dir).withColumn("c", _confidence()), "nivel_riesgo_actual", "c", "Random_Forest")
    return df.select(*_ID, "causa_principal_riesgo", "brecha_operativa", "nivel_brecha_operativa", "diagnostico_operativo", F.round(F.col("indicadores_calculados")["ocupacion_estimada"], 6).alias("ocupacion"), F.round("confianza_prediccion", 6).alias("confianza_prediccion"))


_LIGHT = ", ".join(f"CASE nivel_riesgo_actual WHEN 'alto' THEN '{S.LIGHTS['alto'][k]}' WHEN 'medio' THEN '{S.LIGHTS['medio'][k]}' ELSE '{S.LIGHTS['bajo'][k]}' END AS {n}" for k, n in enumerate(("color_semaforo", "interpretacion_riesgo", "recomendacion_riesgo")))


@query("traffic_light", over("rsk", select=f"SELECT {_IDS}, {_LIGHT} FROM rsk"))
def traffic_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.with_traffic_light(P.labelled(spark, sf_dir), "nivel_riesgo_actual").select(*_ID, "color_semaforo", "interpretacion_riesgo", "recomendacion_riesgo")


@query("occupancy_band", over("ind", select=f"SELECT {_IDS}, CASE WHEN total_camas = 0 THEN '{S.BANDS[0]}' WHEN ocupacion_estimada >= 1.0 THEN '{S.BANDS[1]}' WHEN ocupacion_estimada >= 0.85 THEN '{S.BANDS[2]}' WHEN ocupacion_estimada >= 0.70 THEN '{S.BANDS[3]}' ELSE '{S.BANDS[4]}' END AS banda FROM ind"))
def occupancy_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.indicators(spark, sf_dir).select(*_ID, D.occupancy_band(F.when(F.col("total_camas") != 0, F.col("ocupacion_estimada"))).alias("banda"))


_FACTORS = f"""SELECT {_IDS}, CASE WHEN ocupacion_estimada >= 1.0 THEN '{S.FACTORS["over"]}' WHEN ocupacion_estimada >= 0.85 THEN '{S.FACTORS["high"]}' WHEN ocupacion_estimada >= 0.70 THEN '{S.FACTORS["moderate"]}' ELSE '{S.FACTORS["low"]}' END AS factor FROM rsk WHERE total_camas <> 0
  UNION ALL SELECT {_IDS}, '{S.FACTORS["patients"]}' FROM rsk WHERE total_camas_disponibles > 0 AND total_pacientes_camas > total_camas_disponibles
  UNION ALL SELECT {_IDS}, '{S.FACTORS["stays"]}' FROM rsk WHERE promedio_estancia > 7 OR (total_estancias > 0 AND nivel_riesgo_actual IN ('medio', 'alto'))
  UNION ALL SELECT {_IDS}, CASE WHEN presion_ingresos_camas >= 1 THEN '{S.FACTORS["pressure"]}' ELSE '{S.FACTORS["review"]}' END FROM rsk WHERE presion_ingresos_camas >= 1 OR nivel_riesgo_actual = 'medio'
  UNION ALL SELECT {_IDS}, '{S.FACTORS["model"]}' FROM rsk"""


@query("risk_factors", over("rsk", select=_FACTORS))
def risk_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = P.labelled(spark, sf_dir).withColumn("ocupacion_estimada", F.when(F.col("total_camas") != 0, F.col("ocupacion_estimada")))
    return df.select(*_ID, F.explode(D.risk_factors(_risk())).alias("factor"))


@query("top_variables", over("ind", select=" UNION ALL ".join(f"SELECT {_IDS}, {k} AS pos, '{c}' AS variable FROM ind" for k, c in enumerate(("total_camas", "ocupacion_estimada", "mes", "sector", "anio")))))
def top_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = spark.createDataFrame([("total_camas", 0.9), ("ausente", 0.8), ("ocupacion_estimada", 0.7), ("mes", 0.6), ("sector", 0.5), ("anio", 0.4), ("distrito", 0.1)], "variable string, importancia double")
    df = P.indicators(spark, sf_dir)
    return df.select(*_ID, F.posexplode(learning.top_variables(df, ranked)).alias("pos", "v")).select(*_ID, "pos", "v.variable")


@query("score_envelope", over("tmp", select=f"SELECT {_IDS}, printf('%04d-%02d', anio, mes) AS periodo_actual, strftime(make_date(anio, mes, 1) + INTERVAL 1 MONTH, '%Y-%m') AS periodo_predicho, 'mes_siguiente' AS horizonte_prediccion, CASE WHEN NOT historial_completo THEN '{S.HISTORY_WARNING}' END AS advertencia_historial, '{S.REFERENCE_NOTE}' AS mensaje FROM tmp"))
def score_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.with_envelope(temporal.with_history_flag(P.panel(spark, sf_dir))).select(*_ID, "periodo_actual", "periodo_predicho", "horizonte_prediccion", "advertencia_historial", "mensaje")


# --- evaluation ---------------------------------------------------------------------------------------------------


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training table with `parte`, for the models: the year, the weights, the fits and the tests all read what is written."""
    return _with_year(_training_table(spark, sf_dir))


def _training_table(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The training table with the history flag, in the named columns (all if none), as a written table."""
    full = temporal.with_history_flag(P.training(spark, sf_dir))
    full = full.select(*columns) if columns else full
    path = scratch(spark, "training")
    full.write.parquet(path)
    return spark.read.schema(full.schema).parquet(path)


def _with_year(full: DataFrame) -> DataFrame:
    return evaluation.with_split_year(full, rollup.test_year(full))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that baselines and counts read, with `parte`."""
    return _with_year(_training_table(spark, sf_dir, "periodo_predicho", evaluation.TARGET, "nivel_riesgo_siguiente_mes", "nivel_riesgo_actual_codificado", "ocupacion_estimada"))


def _baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _judged(spark, sf_dir)
    return evaluation.baselines(parts.where("parte = 'train'"), parts.where("parte = 'test'"))


@query("class_counts", over("fut", select="SELECT nivel_riesgo_siguiente_mes_codificado AS clase, count(*) AS n FROM fut GROUP BY ALL"))
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.frequencies(P.training(spark, sf_dir).withColumnRenamed(evaluation.TARGET, "clase"), "clase")


@query("temporal_split", over("yr", select="SELECT CASE WHEN CAST(substr(periodo_predicho, 1, 4) AS INTEGER) < anio_prueba THEN 'train' WHEN CAST(substr(periodo_predicho, 1, 4) AS INTEGER) = anio_prueba THEN 'test' END AS parte, nivel_riesgo_siguiente_mes AS clase, count(*) AS n FROM fut, yr GROUP BY ALL"))
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.frequencies(_judged(spark, sf_dir).withColumnRenamed("nivel_riesgo_siguiente_mes", "clase"), "parte", "clase")


_SIZES = "SELECT clase, n, CAST(piso + CASE WHEN row_number() OVER (ORDER BY exacto - piso DESC, clase) <= todos - sum(piso) OVER () THEN 1 ELSE 0 END AS BIGINT) AS n_test FROM (SELECT *, floor(exacto) AS piso FROM (SELECT clase, n, n * ceil(sum(n) OVER () * 0.2) / sum(n) OVER () AS exacto, ceil(sum(n) OVER () * 0.2) AS todos FROM (SELECT nivel_riesgo_siguiente_mes_codificado AS clase, count(*) AS n FROM fut GROUP BY 1)))"


@query("stratified_split", over("fut", select=_SIZES))
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = evaluation.stratified_split(P.training(spark, sf_dir))
    return parts.groupBy(F.col(evaluation.TARGET).alias("clase")).agg(F.count("*").alias("n"), F.count_if(F.col("parte") == "test").alias("n_test"))


_Z = ["anio", "total_ingresos", "ocupacion_estimada", "ratio_camas_disponibles", "promedio_movil_3m_presion", "tendencia_ingresos_1m"]


@query("scaled_features", over("fut", select=f"SELECT {_IDS}, {', '.join(f'round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 5) AS z_{c}' for c in _Z)} FROM fut"))
def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = P.training(spark, sf_dir)
    return _rounded(learning.scaled(full, learning.scaling(full)).select(*_ID, *[f"z_{c}" for c in _Z]), *[f"z_{c}" for c in _Z], digits=5)


@query("class_weights", over("yr", select="SELECT clase, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS peso FROM (SELECT nivel_riesgo_siguiente_mes_codificado AS clase, count(*) AS n FROM fut, yr WHERE CAST(substr(periodo_predicho, 1, 4) AS INTEGER) < anio_prueba GROUP BY 1)"))
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.class_weights(_judged(spark, sf_dir).where("parte = 'train'")), "peso")


@query("majority_class", over("yr", select="SELECT nivel_riesgo_siguiente_mes_codificado AS clase, count(*) AS n FROM fut, yr WHERE CAST(substr(periodo_predicho, 1, 4) AS INTEGER) < anio_prueba GROUP BY 1 ORDER BY n DESC, clase LIMIT 1"))
def majority_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.majority_class(_judged(spark, sf_dir).where("parte = 'train'"))


@query("confusion_matrix", over("cells", select="SELECT modelo, 'real_' || (['bajo', 'medio', 'alto'])[y + 1] AS real, CAST(sum(CASE WHEN yhat = 0 THEN n END) AS BIGINT) AS predicho_bajo, CAST(sum(CASE WHEN yhat = 1 THEN n END) AS BIGINT) AS predicho_medio, CAST(sum(CASE WHEN yhat = 2 THEN n END) AS BIGINT) AS predicho_alto FROM cells GROUP BY 1, 2"))
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion_matrix(_baselines(spark, sf_dir))


_METRICS = "SELECT modelo, round(sum(tp) / max(todo), 6) AS accuracy, round(avg(CASE WHEN re > 0 THEN recall END), 6) AS balanced_accuracy, round(avg(CASE WHEN re > 0 OR pred > 0 THEN precision END), 6) AS precision_macro, round(avg(CASE WHEN re > 0 OR pred > 0 THEN recall END), 6) AS recall_macro, round(avg(espec), 6) AS specificity_macro, round(avg(CASE WHEN re > 0 OR pred > 0 THEN f1 END), 6) AS f1_macro FROM rep GROUP BY modelo"
_METRIC_NAMES = ["accuracy", "balanced_accuracy", "precision_macro", "recall_macro", "specificity_macro", "f1_macro"]


@query("classification_metrics", over("rep", select=_METRICS))
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.classification_metrics(evaluation.confusion_counts(_baselines(spark, sf_dir))), *_METRIC_NAMES)


_AUC = """SELECT modelo, round(avg(auc), 6) AS roc_auc_ovr_macro FROM (SELECT modelo, k, sum(CASE WHEN y = k THEN menos + iguales * 0.5 END) / (count(*) FILTER (WHERE y = k) * count(*) FILTER (WHERE y <> k)) AS auc
  FROM (SELECT modelo, k, y, coalesce(sum(CAST(y <> k AS INTEGER)) OVER (PARTITION BY modelo, k ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - sum(CAST(y <> k AS INTEGER)) OVER (PARTITION BY modelo, k, s) AS menos, sum(CAST(y <> k AS INTEGER)) OVER (PARTITION BY modelo, k, s) AS iguales
    FROM (SELECT modelo, y, k, CAST(yhat = k AS INTEGER) AS s FROM bas, (VALUES (0), (1), (2)) x(k))) GROUP BY modelo, k) GROUP BY modelo"""


@query("roc_auc_ovr", over("bas", select=_AUC))
def roc_auc_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.roc_auc_ovr(evaluation.hard_probabilities(_baselines(spark, sf_dir))), "roc_auc_ovr_macro")


_CONT = _AUC.replace("CAST(yhat = k AS INTEGER) AS s FROM bas", "CASE k WHEN 0 THEN 1 / (1 + ocupacion_estimada) WHEN 1 THEN 1 / (1 + ratio_camas_disponibles) ELSE presion_ingresos_camas / (1 + presion_ingresos_camas) END AS s FROM (SELECT *, 'indicadores' AS modelo, nivel_riesgo_siguiente_mes_codificado AS y FROM fut)")


@query("roc_auc_scores", over("fut", select=_CONT))
def roc_auc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous scores, as models have them: the indicators squeezed into [0, 1]."""
    c = F.col
    scored = P.training(spark, sf_dir).select(
        F.lit("indicadores").alias("modelo"), c(evaluation.TARGET).alias("y"), (1 / (1 + c("ocupacion_estimada"))).alias("p0"), (1 / (1 + c("ratio_camas_disponibles"))).alias("p1"),
        (c("presion_ingresos_camas") / (1 + c("presion_ingresos_camas"))).alias("p2"),
    )
    return _rounded(evaluation.roc_auc_ovr(scored), "roc_auc_ovr_macro")


@query("baseline_metrics", over("rep", select=f"SELECT m.*, a.roc_auc_ovr_macro, 1.0::DOUBLE AS probabilidad_maxima_promedio FROM ({_METRICS}) m JOIN ({_AUC}) a USING (modelo)"))
def baseline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _baseline_metrics(_baselines(spark, sf_dir))


def _baseline_metrics(b: DataFrame) -> DataFrame:
    hard = evaluation.hard_probabilities(b)
    sure = hard.groupBy("modelo").agg(F.avg(F.greatest("p0", "p1", "p2")).alias("probabilidad_maxima_promedio"))
    return _rounded(evaluation.classification_metrics(evaluation.confusion_counts(b)).join(evaluation.roc_auc_ovr(hard), "modelo").join(sure, "modelo"), *_METRIC_NAMES, "roc_auc_ovr_macro")


@query("metric_files", over("rep", select=f"SELECT m.*, a.roc_auc_ovr_macro, 1.0::DOUBLE AS probabilidad_maxima_promedio FROM ({_METRICS}) m JOIN ({_AUC}) a USING (modelo)"))
def metric_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baselines' metrics and confusion matrices as report files; the metrics as read back."""
    b, folder = _baselines(spark, sf_dir), scratch(spark, "reports")
    metrics = _baseline_metrics(b)
    delimited.write_reports({"metricas_baseline": metrics, "matriz_confusion": evaluation.confusion_matrix(b)}, folder)
    return delimited.read_report(spark, folder, "metricas_baseline", metrics.schema)


@query("dataset_csv", over("fut", select="SELECT codigo_ipress, servicio_hospitalizacion, anio, mes, periodo_predicho, nivel_riesgo_siguiente_mes FROM fut"))
def dataset_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset as CSV with a byte-order mark, as read back."""
    full = P.training(spark, sf_dir).select(*_ID, "periodo_predicho", "nivel_riesgo_siguiente_mes")
    path = scratch(spark, "dataset-csv")
    delimited.write_dataset(full, path, format="csv")
    return delimited.scan_dataset(spark, path, format="csv", schema=full.schema)


@query("metadata_json", over("fut", select="SELECT (SELECT count(*) FROM tmp) AS registros_antes, count(*) AS registros_despues, min(periodo_actual) AS primer_periodo, max(periodo_actual) AS ultimo_periodo, count(DISTINCT periodo_actual) AS n_periodos FROM fut"))
def metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset's metadata row as JSON, as read back."""
    row = rollup.dataset_metadata(P.panel(spark, sf_dir), P.training(spark, sf_dir))
    path = scratch(spark, "metadata")
    delimited.write_metadata(row, path)
    return delimited.read_metadata(spark, path, row.schema).select("registros_antes", "registros_despues", "primer_periodo", "ultimo_periodo", "n_periodos")


_READ = {"codigo_ipress": "nullif(trim(codigo_ipress), '') AS codigo_ipress", "total_estancias": "nullif(total_estancias, 'nan') AS total_estancias"}


@query("scan_template", over("tpl", select=f"SELECT fila, {', '.join(_READ.get(c, c) for c in S.TEMPLATE_REQUIRED)} FROM tpl"))
def scan_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An uploaded template as a file, as scanned."""
    path = scratch(spark, "template")
    P.template(spark, sf_dir).write.csv(path, header=True, sep=";")
    return delimited.scan_template(spark, path)[0].select("fila", *S.TEMPLATE_REQUIRED)


_UPLOAD = ", upl AS (SELECT * REPLACE (anio_de || ':' || (row_number() OVER (PARTITION BY anio_de ORDER BY fila) + 1) AS fila) FROM (SELECT * REPLACE (nullif(total_estancias, 'nan') AS total_estancias), split_part(fila, '|', 2) AS anio_de FROM tpl))"
_NOTE = "SELECT fila, campo, mensaje FROM (" + " UNION ALL ".join(SQL.replace("FROM tpl", "FROM upl") for SQL in (REQ, PRD, NUM)) + ")"


@query("upload_errors", over("tpl", select="SELECT 1").removesuffix("SELECT 1").rstrip() + _UPLOAD + " " + _NOTE)
def upload_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template without row ids, uploaded as a file a year: its errors name the year and the row's number in the file."""
    path = scratch(spark, "upload")
    t = P.template(spark, sf_dir).withColumn("anio_de", F.split("fila", r"\|")[1])
    t.repartition("anio_de").sortWithinPartitions("anio_de", "fila").drop("fila").write.partitionBy("anio_de").csv(path, header=True, sep=";")
    scanned = delimited.scan_template(spark, path)[0].withColumn("fila", F.concat_ws(":", "anio_de", "fila"))
    return quality.required_errors(scanned).unionByName(quality.period_errors(scanned)).unionByName(quality.numeric_errors(scanned))


@query("pruned_split", over("yr", select="SELECT 'test' AS parte, anio, count(*) AS n FROM fut, yr WHERE CAST(substr(periodo_predicho, 1, 4) AS INTEGER) = anio_prueba GROUP BY anio UNION ALL SELECT 'train', anio, count(*) FROM fut, yr WHERE CAST(substr(periodo_predicho, 1, 4) AS INTEGER) < anio_prueba GROUP BY anio"))
def pruned_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The temporal split of the stored dataset, of which the test reads two years' folders."""
    path = scratch(spark, "dataset")
    full = P.training(spark, sf_dir).select("codigo_ipress", "mes", "periodo_predicho", "anio")
    delimited.write_dataset(full, path)
    stored = delimited.scan_dataset(spark, path, schema=full.schema)
    train, test = evaluation.temporal_split(stored, rollup.choose_test_year(stored)[0])
    return rollup.frequencies(test.withColumn("parte", F.lit("test")), "parte", "anio").unionByName(rollup.frequencies(train.withColumn("parte", F.lit("train")), "parte", "anio"))


_REPORT = """SELECT modelo, (['bajo', 'medio', 'alto'])[clase + 1] AS etiqueta, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(re AS BIGINT) AS soporte FROM rep
  UNION ALL SELECT modelo, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(re) AS BIGINT) FROM rep GROUP BY 1
  UNION ALL SELECT modelo, 'weighted avg', round(sum(precision * re) / sum(re), 6), round(sum(recall * re) / sum(re), 6), round(sum(f1 * re) / sum(re), 6), CAST(sum(re) AS BIGINT) FROM rep GROUP BY 1"""


@query("classification_report", over("rep", select=_REPORT))
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.classification_report(evaluation.confusion_counts(_baselines(spark, sf_dir))), "precision", "recall", "f1")


_SELECT = f"SELECT b.modelo AS modelo, b.f1_macro AS f1_modelo, c.modelo AS baseline, c.f1_macro AS f1_baseline, b.f1_macro > c.f1_macro + 0.02 AS supera_baseline FROM (SELECT * FROM ({_METRICS}) ORDER BY f1_macro DESC, modelo LIMIT 1) b, (SELECT * FROM ({_METRICS}) WHERE modelo <> 'Persistencia_Riesgo_Actual' ORDER BY f1_macro DESC, modelo LIMIT 1) c"


@query("model_selection", over("rep", select=_SELECT))
def model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = classification_metrics(spark, sf_dir)
    return evaluation.model_selection(m, m.where("modelo <> 'Persistencia_Riesgo_Actual'"))


# --- learning: the models of learning.classifiers -----------------------------------------------------------------


def _trained(spark: SparkSession, sf_dir: str, name: str) -> tuple[learning.FittedModel, DataFrame]:
    parts = _split(spark, sf_dir)
    train, test = parts.where("parte = 'train'"), parts.where("parte = 'test'")
    return learning.fit(train, name), test


def _train(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return learning.evaluated(*_trained(spark, sf_dir, name))

    return run


query("train_logistic")(_train("Regresion_Logistica"))
query("train_forest")(_train("Random_Forest"))
query("train_boosted")(_train("Arboles_Potenciados"))


@query("feature_importance")
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.feature_importance(_trained(spark, sf_dir, "Random_Forest")[0])


@query("score")
def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest is stored in the shared folder, and the test rows are scored by what is loaded from there."""
    model, test = _trained(spark, sf_dir, "Random_Forest")
    path = scratch(spark, "model")
    model.save(path)
    stored = learning.load_model(spark, path)
    return learning.score(test, stored, learning.feature_importance(stored))


@query("training_summary", over("yr", select="SELECT count(*) FILTER (WHERE CAST(substr(periodo_predicho, 1, 4) AS INTEGER) < anio_prueba) AS registros_train, count(*) FILTER (WHERE CAST(substr(periodo_predicho, 1, 4) AS INTEGER) = anio_prueba) AS registros_test, max(anio_prueba) AS anio_prueba, count(*) FILTER (WHERE nivel_riesgo_siguiente_mes = 'alto') AS n_alto FROM fut, yr"))
def training_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = P.training(spark, sf_dir)
    ranked = spark.createDataFrame([(c, 1.0) for c in S.PREDICTORS], "variable string, importancia double")
    s = learning.training_summary(full, rollup.test_year(full), classification_metrics(spark, sf_dir), ranked)
    return s.select("registros_train", "registros_test", "anio_prueba", F.col("clases")["alto"].alias("n_alto"))


@query("permutation_importance")
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logistic model tells no importances: by permutation, over all test rows and five times a column."""
    return learning.importance(*_trained(spark, sf_dir, "Regresion_Logistica"))


def _run(spark: SparkSession, sf_dir: str) -> str:
    """A training run of all classifiers, stored with its metadata and reports; the folder."""
    full = _training_table(spark, sf_dir)
    path = scratch(spark, "training-run")
    learning.training_run(full).save(full, path)
    return path


_CLASSES = "SELECT evaluacion, ['bajo', 'medio', 'alto'][clase + 1] AS clase, n FROM"
_RUN_SQL = f"""SELECT modelo, evaluacion, clase, CAST(n AS BIGINT) AS n FROM ({_CLASSES} (SELECT 'temporal' AS evaluacion, nivel_riesgo_siguiente_mes_codificado AS clase, count(*) AS n FROM fut, yr WHERE CAST(substr(periodo_predicho, 1, 4) AS INTEGER) = anio_prueba GROUP BY 2)
  UNION ALL {_CLASSES} (SELECT 'aleatorio' AS evaluacion, clase, n_test AS n FROM ({_SIZES}))), (VALUES ('Regresion_Logistica'), ('Random_Forest'), ('Arboles_Potenciados')) m(modelo)"""


@query("training_run", over("yr", select=_RUN_SQL))
def training_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three classifiers on two splits, and the winner fitted again on all rows: the test rows of each class that each model
    was judged by, from the stored confusion matrices."""
    report = delimited.scan_dataset(spark, _run(spark, sf_dir) + "/reports/matriz_confusion", format="csv", schema="modelo string, real string, predicho_bajo long, predicho_medio long, predicho_alto long, evaluacion string")
    return report.select("modelo", "evaluacion", F.substring_index("real", "_", -1).alias("clase"), (F.col("predicho_bajo") + F.col("predicho_medio") + F.col("predicho_alto")).alias("n"))


@query("training_report")
def training_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored metadata of a training run: rows, years, classes, metrics, selection and leading variables of the trained models."""
    return learning.read_model_metadata(spark, _run(spark, sf_dir))
