"""Names, thresholds and texts of the domain. Everything here is a fixed value that results must carry as it is."""

from __future__ import annotations

# The raw monthly table ("D1").
RAW_MEASURES = ["NRO_TOTAL_HOSPIT_ING", "NRO_TOTAL_HOSPIT_EGR", "NRO_TOTAL_ESTANCIAS", "NRO_TOTAL_PACIENTES_CAMAS", "NRO_TOTAL_CAMAS", "NRO_TOTAL_CAMAS_DISPONIB", "NRO_TOTAL_FALLECIDOS"]
RAW_TEXTS = ["UBIGEO", "DEPARTAMENTO", "PROVINCIA", "DISTRITO", "SECTOR", "CATEGORIA", "CO_IPRESS", "RAZON_SOC", "ID_HOSPITALIZACION", "HOSPITALIZACION"]
RAW_KEYS = ["ANHO", "MES", *RAW_TEXTS, "ARCHIVO_ORIGEN"]
RAW_REQUIRED = ["ANHO", "MES", *RAW_TEXTS, *RAW_MEASURES]
RAW_ALIASES = {"DIAS_CAMA_DISPONIBLE": "NRO_TOTAL_CAMAS_DISPONIB"}
SENTINEL_IDS = ["NE_0001", "NE_0002"]
PUBLIC_SECTORS = [
    "MINSA", "ESSALUD", "GOBIERNO REGIONAL", "SANIDAD DE LA POLICIA NACIONAL DEL PERU", "SANIDAD DEL EJERCITO DEL PERU",
    "SANIDAD DE LA MARINA DE GUERRA DEL PERU", "SANIDAD DE LA FUERZA AEREA DEL PERU",
]
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
PUBLIC_NAMES = {
    "ANHO": "anio", "MES": "mes", "UBIGEO": "ubigeo", "DEPARTAMENTO": "departamento", "PROVINCIA": "provincia", "DISTRITO": "distrito", "SECTOR": "sector",
    "CATEGORIA": "categoria_ipress", "CO_IPRESS": "codigo_ipress", "RAZON_SOC": "nombre_ipress", "ID_HOSPITALIZACION": "id_hospitalizacion", "HOSPITALIZACION": "servicio_hospitalizacion",
    "NRO_TOTAL_HOSPIT_ING": "total_ingresos", "NRO_TOTAL_HOSPIT_EGR": "total_egresos", "NRO_TOTAL_ESTANCIAS": "total_estancias", "NRO_TOTAL_PACIENTES_CAMAS": "total_pacientes_camas",
    "NRO_TOTAL_CAMAS": "total_camas", "NRO_TOTAL_CAMAS_DISPONIB": "total_camas_disponibles", "NRO_TOTAL_FALLECIDOS": "total_fallecidos", "ARCHIVO_ORIGEN": "archivo_origen",
}

# The public tables.
SERIES = ["codigo_ipress", "servicio_hospitalizacion"]
MEASURES = [PUBLIC_NAMES[c] for c in RAW_MEASURES]
INDICATORS = ["dias_mes", "promedio_estancia", "tasa_fallecidos", "ratio_camas_disponibles", "ocupacion_estimada", "presion_ingresos_camas", "rotacion_camas", "diferencia_ingresos_egresos"]
MEANS_3M = {
    "ocupacion_estimada": "promedio_movil_3m_ocupacion", "presion_ingresos_camas": "promedio_movil_3m_presion", "total_ingresos": "promedio_movil_3m_ingresos",
    "total_egresos": "promedio_movil_3m_egresos", "total_estancias": "promedio_movil_3m_estancias",
}
TRENDS_1M = {"ocupacion_estimada": "tendencia_ocupacion_1m", "presion_ingresos_camas": "tendencia_presion_1m", "total_ingresos": "tendencia_ingresos_1m", "total_egresos": "tendencia_egresos_1m"}
CALENDAR = ["trimestre", "semestre", "mes_sin", "mes_cos", "es_fin_de_anio"]
TEMPORAL = [*CALENDAR, *MEANS_3M.values(), *TRENDS_1M.values()]
TARGETS = ["nivel_riesgo_actual", "nivel_riesgo_actual_codificado", "nivel_riesgo_siguiente_mes", "nivel_riesgo_siguiente_mes_codificado"]
OUTPUT = [
    "anio", "mes", "periodo_actual", "periodo_predicho", "ubigeo", "departamento", "provincia", "distrito", "sector", "categoria_ipress", "codigo_ipress", "nombre_ipress",
    "id_hospitalizacion", "servicio_hospitalizacion", *MEASURES, "archivo_origen", *INDICATORS, *TEMPORAL, *TARGETS,
]
RISK_CODES = {"bajo": 0, "medio": 1, "alto": 2}
CATEGORICAL = ["departamento", "provincia", "distrito", "sector", "categoria_ipress", "servicio_hospitalizacion"]
PREDICTORS = ["anio", "mes", *CATEGORICAL, *MEASURES, *INDICATORS, *TEMPORAL]
NEVER_PREDICTORS = [
    "nivel_riesgo", "nivel_riesgo_codificado", *TARGETS, "periodo_actual", "periodo_predicho", "nombre_ipress", "archivo_origen", "codigo_ipress", "ubigeo", "id_hospitalizacion",
]

# The upload template.
TEMPLATE_ALIASES = {
    "codigo_renipress": "codigo_ipress", "servicio_hospitalario": "servicio_hospitalizacion", "ingresos": "total_ingresos", "egresos": "total_egresos", "estancias": "total_estancias",
    "pacientes_cama": "total_pacientes_camas", "camas_totales": "total_camas", "camas_disponibles_habilitadas": "total_camas_disponibles",
}
TEMPLATE_KEY = ["codigo_ipress", "anio", "mes", "servicio_hospitalizacion"]
TEMPLATE_MEASURES = ["total_ingresos", "total_egresos", "total_estancias", "total_pacientes_camas", "total_camas", "total_camas_disponibles"]
TEMPLATE_REQUIRED = [*TEMPLATE_KEY, *TEMPLATE_MEASURES]
DUPLICATE_MESSAGE = "No se permite más de un registro vigente con la misma IPRESS, año, mes y servicio hospitalario."

# Texts of the decision support.
SUPPORT_INDICATORS = [
    "ocupacion_estimada", "presion_ingresos_camas", "promedio_estancia", "rotacion_camas", "diferencia_ingresos_egresos", "ratio_camas_disponibles",
    "total_ingresos", "total_egresos", "total_camas", "total_camas_disponibles",
]
CAUSE_OCCUPANCY, CAUSE_CAPACITY, CAUSE_DEMAND, CAUSE_STAY = "Ocupación crítica", "Capacidad disponible limitada", "Demanda supera egresos", "Estancia prolongada"
CAUSE_PRESSURE, CAUSE_ROTATION, CAUSE_CONTROLLED, CAUSE_MIXED = "Alta presión ingresos/camas", "Baja rotación de camas", "Riesgo controlado", "Presión operativa multifactorial"
GAP_LEVELS = ("Brecha crítica", "Brecha en observación", "Brecha controlada")
DIAGNOSIS = (
    "Para el siguiente mes, el servicio evaluado presenta riesgo ",
    " de insuficiencia de capacidad asistencial. La causa principal identificada es ",
    ". Esto indica que la demanda hospitalaria podría ejercer presión sobre la capacidad registrada si la tendencia continúa.",
)
RECOMMENDATIONS = {
    CAUSE_OCCUPANCY: ["Se recomienda revisar servicios con riesgo medio o alto.", "Puede considerarse verificar la actualización de camas disponibles o habilitadas.", "Conviene observar la ocupación estimada y la presión ingresos/camas."],
    CAUSE_DEMAND: ["Se recomienda revisar la relación entre ingresos y egresos hospitalarios.", "Puede considerarse observar servicios con mayor diferencia ingresos-egresos.", "El resultado puede apoyar la coordinación hospitalaria correspondiente."],
    CAUSE_STAY: ["Conviene observar servicios con estancia promedio prolongada.", "Se recomienda revisar el efecto de la estancia sobre la rotación de camas.", "El resultado puede apoyar la revisión de indicadores de demanda y capacidad."],
    CAUSE_CAPACITY: ["Puede considerarse verificar la actualización de camas disponibles o habilitadas.", "Se recomienda revisar la capacidad mensual registrada.", "Conviene observar si la capacidad disponible se mantiene baja en el periodo."],
}
OTHER_RECOMMENDATIONS = ["Se recomienda revisar servicios con riesgo medio o alto.", "Puede considerarse verificar la actualización de camas disponibles o habilitadas.", "Conviene observar servicios con estancia promedio prolongada."]
MODEL_TEXT = ("El modelo ", " clasifica el riesgo del siguiente mes en bajo, medio o alto. Para este registro predice riesgo ", " con confianza ", ". El resultado es referencial y debe usarse como apoyo preventivo a la gestión hospitalaria.")
REFERENCE_NOTE = "El resultado es referencial. No asigna camas automáticamente y no reemplaza decisiones clínicas."
LIGHTS = {
    "alto": ("rojo", "Existe posible insuficiencia de capacidad asistencial para el siguiente mes.", "Se recomienda revisar camas habilitadas, validar registros procesados, analizar ocupación estimada y coordinar la revisión hospitalaria con el área responsable. " + REFERENCE_NOTE),
    "medio": ("amarillo", "Existen señales de presión hospitalaria que requieren revisión.", "Revisar indicadores, validar tendencia de ingresos y coordinar revisión hospitalaria. " + REFERENCE_NOTE),
    "bajo": ("verde", "La capacidad parece estable frente a la demanda esperada.", "Mantener monitoreo mensual. " + REFERENCE_NOTE),
}
BANDS = ("sin dato", "crítico / uso supera capacidad registrada", "alto / presión alta", "medio / presión moderada", "bajo / estable")
FACTORS = {
    "over": "El uso acumulado de camas supera la capacidad mensual registrada.", "high": "La ocupación estimada supera el umbral de presión alta.", "moderate": "La ocupación estimada muestra presión moderada.",
    "low": "La ocupación estimada se mantiene en un rango bajo o estable.", "patients": "Los pacientes-cama superan las camas-día disponibles del mes.", "stays": "Las estancias hospitalarias reflejan uso prolongado de camas.",
    "pressure": "La presión ingresos/camas indica alta demanda frente a la capacidad registrada.", "review": "La presión ingresos/camas requiere revisión hospitalaria.",
    "model": "El modelo también considera comportamiento histórico, tendencias y características del servicio.",
}
HISTORY_WARNING = "No se recibió historial completo de los dos meses previos; algunas variables temporales fueron estimadas con información limitada."
