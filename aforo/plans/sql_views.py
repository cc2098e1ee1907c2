"""DuckDB views that the SQL of several queries shares, as common table expressions."""

from __future__ import annotations

from .. import schema as S


def _clean(c: str) -> str:
    return rf"upper(trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g')))"


def _number(c: str) -> str:
    return rf"CASE WHEN regexp_full_match(trim({c}), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def _measure(c: str) -> str:
    replaced = f"replace({c}, ',', '')"
    return f"greatest(coalesce({_number(replaced)}, 0.0), 0.0)"


DAYS = "day(last_day(make_date(anio, mes, 1)))"
PANEL = """SELECT s.anio, s.mes, lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS ubigeo, r_name AS departamento, n_name AS provincia, n_name AS distrito,
  (['MINSA', 'ESSALUD', 'GOBIERNO REGIONAL', 'PRIVADO'])[l_suppkey % 4 + 1] AS sector, (['I-4', 'II-1', 'III-1'])[l_suppkey % 3 + 1] AS categoria_ipress,
  lpad(CAST(l_suppkey AS VARCHAR), 8, '0') AS codigo_ipress, s_name AS nombre_ipress, l_returnflag AS id_hospitalizacion, l_returnflag AS servicio_hospitalizacion,
  total_ingresos, total_egresos, q AS total_estancias, q AS total_pacientes_camas, CAST(l_suppkey % 8 AS DOUBLE) AS total_camas,
  CAST(floor(CAST(l_suppkey % 8 AS DOUBLE) * day(last_day(make_date(s.anio, s.mes, 1))) * d / (total_ingresos * 10.0)) AS DOUBLE) AS total_camas_disponibles, total_fallecidos, 'lineitem' AS archivo_origen
FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS anio, CAST(month(l_shipdate) AS INTEGER) AS mes, l_suppkey, l_returnflag, CAST(count(*) AS DOUBLE) AS total_ingresos,
    CAST(count(*) FILTER (WHERE l_linestatus = 'F') AS DOUBLE) AS total_egresos, CAST(sum(l_quantity) AS DOUBLE) AS q, sum(round(l_discount * 100)) AS d, CAST(count(*) FILTER (WHERE l_tax >= 0.08) AS DOUBLE) AS total_fallecidos
  FROM lineitem GROUP BY 1, 2, 3, 4) s JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
IND = f"""SELECT *, CAST({DAYS} AS INTEGER) AS dias_mes, CASE WHEN total_egresos <> 0 THEN total_estancias / total_egresos ELSE 0.0 END AS promedio_estancia, CASE WHEN total_egresos <> 0 THEN total_fallecidos / total_egresos ELSE 0.0 END AS tasa_fallecidos,
  CASE WHEN total_camas <> 0 THEN total_camas_disponibles / (total_camas * {DAYS}) ELSE 0.0 END AS ratio_camas_disponibles, CASE WHEN total_camas <> 0 THEN total_pacientes_camas / (total_camas * {DAYS}) ELSE 0.0 END AS ocupacion_estimada,
  CASE WHEN total_camas <> 0 THEN total_ingresos / total_camas ELSE total_ingresos END AS presion_ingresos_camas, CASE WHEN total_camas <> 0 THEN total_egresos / total_camas ELSE 0.0 END AS rotacion_camas, total_ingresos - total_egresos AS diferencia_ingresos_egresos
FROM panel"""
PCT = "SELECT quantile_cont(presion_ingresos_camas, 0.5) AS p50, quantile_cont(presion_ingresos_camas, 0.75) AS p75, count(presion_ingresos_camas) AS n FROM ind"
RSK = """SELECT *, CASE nivel_riesgo_actual WHEN 'bajo' THEN 0 WHEN 'medio' THEN 1 ELSE 2 END AS nivel_riesgo_actual_codificado FROM (SELECT ind.*, CASE WHEN ocupacion_estimada >= 0.85 OR ratio_camas_disponibles <= 0.10 OR presion_ingresos_camas >= p75 THEN 'alto'
  WHEN ocupacion_estimada >= 0.70 OR ratio_camas_disponibles <= 0.20 OR presion_ingresos_camas >= p50 THEN 'medio' ELSE 'bajo' END AS nivel_riesgo_actual FROM ind CROSS JOIN pct)"""
_MEANS = ", ".join(
    f"({c} + CASE WHEN c1 THEN lag({c}, 1) OVER s ELSE 0 END + CASE WHEN c2 THEN lag({c}, 2) OVER s ELSE 0 END) / (1 + CAST(c1 AS INTEGER) + CAST(c2 AS INTEGER)) AS {out}" for c, out in S.MEANS_3M.items()
)
_TRENDS = ", ".join(f"CASE WHEN c1 THEN {c} - lag({c}, 1) OVER s ELSE 0.0 END AS {out}" for c, out in S.TRENDS_1M.items())
TMP = f"""SELECT *, (mes - 1) // 3 + 1 AS trimestre, (mes - 1) // 6 + 1 AS semestre, sin(2 * pi() * mes / 12) AS mes_sin, cos(2 * pi() * mes / 12) AS mes_cos, CAST(mes = 12 AS INTEGER) AS es_fin_de_anio, {_MEANS}, {_TRENDS}, c2 AS historial_completo
FROM (SELECT *, anio * 12 + mes - 1 AS ord, coalesce(anio * 12 + mes - 1 - lag(anio * 12 + mes - 1) OVER s = 1, false) AS c1,
    coalesce(anio * 12 + mes - 1 - lag(anio * 12 + mes - 1) OVER s = 1 AND anio * 12 + mes - 1 - lag(anio * 12 + mes - 1, 2) OVER s = 2, false) AS c2
  FROM rsk WINDOW s AS (PARTITION BY codigo_ipress, servicio_hospitalizacion ORDER BY anio * 12 + mes)) WINDOW s AS (PARTITION BY codigo_ipress, servicio_hospitalizacion ORDER BY ord)"""
FUT = """SELECT * EXCLUDE (sigue) FROM (SELECT *, printf('%04d-%02d', anio, mes) AS periodo_actual, strftime(make_date(anio, mes, 1) + INTERVAL 1 MONTH, '%Y-%m') AS periodo_predicho,
  lead(nivel_riesgo_actual) OVER s AS nivel_riesgo_siguiente_mes, lead(nivel_riesgo_actual_codificado) OVER s AS nivel_riesgo_siguiente_mes_codificado, lead(ord) OVER s = ord + 1 AS sigue
  FROM tmp WINDOW s AS (PARTITION BY codigo_ipress, servicio_hospitalizacion ORDER BY ord)) WHERE sigue"""
YEAR = "SELECT max(y) AS anio_prueba FROM (SELECT CAST(substr(periodo_predicho, 1, 4) AS INTEGER) AS y FROM fut GROUP BY 1 HAVING count(DISTINCT periodo_predicho) = 12)"
BASE = """SELECT modelo, y, CAST(yhat AS INTEGER) AS yhat FROM (SELECT nivel_riesgo_siguiente_mes_codificado AS y, nivel_riesgo_actual_codificado AS pers, CASE WHEN ocupacion_estimada >= 0.85 THEN 2 WHEN ocupacion_estimada >= 0.70 THEN 1 ELSE 0 END AS regla,
    (SELECT nivel_riesgo_siguiente_mes_codificado FROM fut WHERE CAST(substr(periodo_predicho, 1, 4) AS INTEGER) < (SELECT anio_prueba FROM yr) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mayor
  FROM fut WHERE CAST(substr(periodo_predicho, 1, 4) AS INTEGER) = (SELECT anio_prueba FROM yr)) t, LATERAL (VALUES ('Clase_Mayoritaria', mayor), ('Persistencia_Riesgo_Actual', pers), ('Regla_Ocupacion_Actual', regla)) m(modelo, yhat)"""
CELLS = "SELECT modelo, c.k AS y, d.k AS yhat, (SELECT count(*) FROM bas b WHERE b.modelo = m.modelo AND b.y = c.k AND b.yhat = d.k) AS n FROM (SELECT DISTINCT modelo FROM bas) m, (VALUES (0), (1), (2)) c(k), (VALUES (0), (1), (2)) d(k)"
REP = """SELECT *, CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM (SELECT *, CASE WHEN pred <> 0 THEN tp / pred ELSE 0.0 END AS precision, CASE WHEN re <> 0 THEN tp / re ELSE 0.0 END AS recall, CASE WHEN todo <> re THEN (todo - re - pred + tp) / (todo - re) ELSE 0.0 END AS espec
  FROM (SELECT modelo, k AS clase, CAST(sum(CASE WHEN y = k AND yhat = k THEN n ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN y = k THEN n ELSE 0 END) AS DOUBLE) AS re, CAST(sum(CASE WHEN yhat = k THEN n ELSE 0 END) AS DOUBLE) AS pred, CAST(sum(n) AS DOUBLE) AS todo FROM cells, (VALUES (0), (1), (2)) x(k) GROUP BY 1, 2))"""
_Q = "CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)"
_H = "l_orderkey % {} = 0".format
RAW = f"""SELECT CASE WHEN {_H(101)} THEN 'n/d' WHEN {_H(103)} THEN NULL ELSE CAST(year(l_shipdate) AS VARCHAR) END AS ANHO, CASE WHEN {_H(107)} THEN '13' WHEN {_H(109)} THEN '7.0' ELSE CAST(month(l_shipdate) AS VARCHAR) END AS MES,
  lpad(CAST(l_suppkey % 25 AS VARCHAR), 6, '0') AS UBIGEO, CASE WHEN l_suppkey % 5 = 4 THEN 'CALLAO' WHEN l_linenumber % 2 = 0 THEN '  lima ' ELSE 'LIMA' END AS DEPARTAMENTO, CASE WHEN l_suppkey % 7 = 6 THEN 'HUARAL' ELSE 'Lima' END AS PROVINCIA,
  'distrito  ' || CAST(l_suppkey % 10 AS VARCHAR) AS DISTRITO, (['MINSA', 'EsSalud', 'GOBIERNO  REGIONAL', 'PRIVADO'])[l_suppkey % 4 + 1] AS SECTOR, (['I-4', 'II-1', 'III-1'])[l_suppkey % 3 + 1] AS CATEGORIA, lpad(CAST(l_suppkey AS VARCHAR), 8, '0') AS CO_IPRESS, 'Hospital' || chr(9) || CAST(l_suppkey AS VARCHAR) AS RAZON_SOC,
  CASE WHEN {_H(113)} THEN 'NE_0001' WHEN {_H(127)} THEN 'ne_0002' WHEN {_H(173)} THEN 'otro' ELSE l_returnflag END AS ID_HOSPITALIZACION, CASE WHEN {_H(131)} THEN '  ' WHEN {_H(137)} THEN NULL ELSE lower(l_returnflag) END AS HOSPITALIZACION,
  CASE WHEN {_H(139)} THEN '1,' || CAST(l_linenumber AS VARCHAR) || '00' WHEN {_H(149)} THEN '-5' WHEN {_H(151)} THEN 'abc' WHEN {_H(157)} THEN NULL ELSE CAST(l_linenumber AS VARCHAR) END AS NRO_TOTAL_HOSPIT_ING,
  CASE WHEN {_H(163)} THEN 'NaN' ELSE CAST(l_linenumber AS VARCHAR) END AS NRO_TOTAL_HOSPIT_EGR, {_Q} AS NRO_TOTAL_ESTANCIAS, ' ' || {_Q} || '.5 ' AS NRO_TOTAL_PACIENTES_CAMAS, CAST(l_suppkey % 8 AS VARCHAR) AS NRO_TOTAL_CAMAS, CASE WHEN {_H(167)} THEN '1.5d' ELSE {_Q} END AS NRO_TOTAL_CAMAS_DISPONIB,
  '0' AS NRO_TOTAL_FALLECIDOS, 'd1_' || CAST(year(l_shipdate) AS VARCHAR) || '.csv' AS ARCHIVO_ORIGEN FROM lineitem, LATERAL (SELECT unnest(CASE WHEN {_H(50)} THEN [0, 1] ELSE [0] END) AS copia) x"""
TXT = f"SELECT {', '.join(f'{_clean(c)} AS {c}' if c in S.RAW_TEXTS else c for c in [*S.RAW_KEYS, *S.RAW_MEASURES])} FROM (SELECT DISTINCT * FROM raw)"
SVC = "SELECT * FROM txt WHERE HOSPITALIZACION <> '' AND ID_HOSPITALIZACION NOT IN ('NE_0001', 'NE_0002')"
PER = f"SELECT * REPLACE (CAST(trunc(ANHO) AS INTEGER) AS ANHO, CAST(trunc(MES) AS INTEGER) AS MES) FROM (SELECT * REPLACE ({_number('ANHO')} AS ANHO, {_number('MES')} AS MES) FROM svc) WHERE ANHO IS NOT NULL AND MES BETWEEN 1 AND 12"
CLN = f"SELECT * REPLACE ({', '.join(f'{_measure(c)} AS {c}' for c in S.RAW_MEASURES)}) FROM per"
SCO = f"SELECT * FROM cln WHERE DEPARTAMENTO = 'LIMA' AND PROVINCIA = 'LIMA' AND SECTOR IN ({', '.join(repr(s) for s in S.PUBLIC_SECTORS)})"
ROL = f"SELECT {', '.join(S.RAW_KEYS)}, {', '.join(f'CAST(sum({c}) AS DOUBLE) AS {c}' for c in S.RAW_MEASURES)} FROM sco GROUP BY {', '.join(S.RAW_KEYS)}"
TPL = """SELECT codigo_ipress || '|' || anio || '|' || mes || '|' || servicio_hospitalizacion AS fila, CASE WHEN (anio * 12 + mes) % 41 = 0 THEN ' ' ELSE codigo_ipress END AS codigo_ipress,
  CASE WHEN (anio * 12 + mes) % 43 = 0 THEN '1899' WHEN (anio * 12 + mes) % 47 = 0 THEN NULL ELSE CAST(anio AS VARCHAR) END AS anio, CASE WHEN (anio * 12 + mes) % 37 = 0 THEN '13' WHEN (anio * 12 + mes) % 53 = 0 THEN 'x' ELSE CAST(mes AS VARCHAR) END AS mes,
  CASE WHEN (anio * 12 + mes) % 31 = 0 THEN 'general' ELSE servicio_hospitalizacion END AS servicio_hospitalizacion, CASE WHEN total_ingresos > 3 THEN '-1' ELSE CAST(total_ingresos AS VARCHAR) END AS total_ingresos, CAST(total_egresos AS VARCHAR) AS total_egresos,
  CASE WHEN (anio * 12 + mes) % 29 = 0 THEN 'nan' ELSE CAST(total_estancias AS VARCHAR) END AS total_estancias, CAST(total_pacientes_camas AS VARCHAR) AS total_pacientes_camas, CASE WHEN total_camas = 0 THEN NULL ELSE CAST(total_camas AS VARCHAR) END AS total_camas, CAST(total_camas_disponibles AS VARCHAR) AS total_camas_disponibles FROM panel"""
REQ = " UNION ALL ".join(f"SELECT fila, '{c}' AS campo, 'el campo {c} es obligatorio.' AS mensaje FROM tpl WHERE trim(coalesce({c}, '')) = ''" for c in S.TEMPLATE_REQUIRED)
PRD = " UNION ALL ".join(f"SELECT fila, '{c}' AS campo, '{m} inválido.' AS mensaje FROM tpl WHERE coalesce(NOT floor({_number(c)}) BETWEEN {a} AND {b}, true)" for c, m, a, b in (("anio", "año", 1900, 2100), ("mes", "mes", 1, 12)))
NUM = " UNION ALL ".join(f"SELECT fila, '{c}' AS campo, '{c} debe ser numérico no negativo.' AS mensaje FROM tpl WHERE coalesce({_number(c)} < 0, true)" for c in S.TEMPLATE_MEASURES)
KEY = f"SELECT *, count(*) OVER (PARTITION BY codigo_ipress, anio, mes, servicio_hospitalizacion) AS veces FROM (SELECT fila, trim(codigo_ipress) AS codigo_ipress, CAST({_number('anio')} AS BIGINT) AS anio, CAST({_number('mes')} AS BIGINT) AS mes, upper(trim(servicio_hospitalizacion)) AS servicio_hospitalizacion FROM tpl)"

VIEWS = {
    "panel": PANEL, "ind": IND, "pct": PCT, "rsk": RSK, "tmp": TMP, "fut": FUT, "yr": YEAR, "bas": BASE, "cells": CELLS, "rep": REP,
    "raw": RAW, "txt": TXT, "svc": SVC, "per": PER, "cln": CLN, "sco": SCO, "rol": ROL, "tpl": TPL, "req": REQ, "prd": PRD, "num": NUM, "clv": KEY,
}
NEEDS = {
    "panel": [], "ind": ["panel"], "pct": ["ind"], "rsk": ["pct"], "tmp": ["rsk"], "fut": ["tmp"], "yr": ["fut"], "bas": ["yr"], "cells": ["bas"], "rep": ["cells"],
    "raw": [], "txt": ["raw"], "svc": ["txt"], "per": ["svc"], "cln": ["per"], "sco": ["cln"], "rol": ["sco"], "tpl": ["panel"], "req": ["tpl"], "prd": ["tpl"], "num": ["tpl"], "clv": ["tpl"],
}


def over(*views: str, select: str) -> str:
    """The select with the views it reads, and theirs, in front."""
    order: list[str] = []

    def add(v: str) -> None:
        for n in NEEDS[v]:
            add(n)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    return "WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in order) + " " + select
