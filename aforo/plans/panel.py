"""The hospital panel and the raw monthly table, derived from the order tables.

The panel has a row a supplier, month and return flag; the raw table has text columns with faults placed by rules on keys, so
that cleaning, checks and roll-ups meet every case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.indicators import days_in_month, with_indicators
from ..operators.risk import with_current_risk
from ..operators.temporal import with_future_target, with_temporal


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a facility, service and month. The dimension tables are joined after the roll-up, so the large table
    is read in five columns and shuffled once, already summed."""
    c = F.col
    line = _table(spark, sf_dir, "lineitem")
    summed = line.groupBy(F.year("l_shipdate").cast("int").alias("anio"), F.month("l_shipdate").cast("int").alias("mes"), "l_suppkey", "l_returnflag").agg(
        F.count("*").cast("double").alias("total_ingresos"), F.count_if(c("l_linestatus") == "F").cast("double").alias("total_egresos"), F.sum("l_quantity").cast("double").alias("q"),
        F.sum(F.round(c("l_discount") * 100)).alias("d"), F.count_if(c("l_tax") >= 0.08).cast("double").alias("total_fallecidos"),
    )
    place = _table(spark, sf_dir, "supplier").join(_table(spark, sf_dir, "nation"), c("s_nationkey") == c("n_nationkey")).join(_table(spark, sf_dir, "region"), c("n_regionkey") == c("r_regionkey"))
    j = summed.join(place.select("s_suppkey", "s_name", "n_nationkey", "n_name", "r_name"), c("l_suppkey") == c("s_suppkey"))
    beds = (c("l_suppkey") % 8).cast("double")
    sector = F.element_at(F.array(*map(F.lit, ("MINSA", "ESSALUD", "GOBIERNO REGIONAL", "PRIVADO"))), (c("l_suppkey") % 4 + 1).cast("int"))
    category = F.element_at(F.array(*map(F.lit, ("I-4", "II-1", "III-1"))), (c("l_suppkey") % 3 + 1).cast("int"))
    return j.select(
        "anio", "mes", F.lpad(c("n_nationkey").cast("string"), 6, "0").alias("ubigeo"), c("r_name").alias("departamento"), c("n_name").alias("provincia"), c("n_name").alias("distrito"), sector.alias("sector"), category.alias("categoria_ipress"),
        F.lpad(c("l_suppkey").cast("string"), 8, "0").alias("codigo_ipress"), c("s_name").alias("nombre_ipress"), c("l_returnflag").alias("id_hospitalizacion"), c("l_returnflag").alias("servicio_hospitalizacion"),
        "total_ingresos", "total_egresos", c("q").alias("total_estancias"), c("q").alias("total_pacientes_camas"), beds.alias("total_camas"),
        F.floor(beds * days_in_month(c("anio"), c("mes")) * c("d") / (c("total_ingresos") * 10.0)).cast("double").alias("total_camas_disponibles"), "total_fallecidos", F.lit("lineitem").alias("archivo_origen"),
    )


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw table: a row a line item, all text, some rows twice."""
    c, key = F.col, F.col("l_orderkey")
    hit = lambda n: key % n == 0
    line = _table(spark, sf_dir, "lineitem").withColumn("copia", F.explode(F.when(hit(50), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    year, month, supplier, n = F.year("l_shipdate").cast("string"), F.month("l_shipdate").cast("string"), c("l_suppkey"), c("l_linenumber").cast("string")
    quantity = c("l_quantity").cast("int").cast("string")
    return line.select(
        F.when(hit(101), "n/d").when(hit(103), F.lit(None)).otherwise(year).alias("ANHO"), F.when(hit(107), "13").when(hit(109), "7.0").otherwise(month).alias("MES"),
        F.lpad((supplier % 25).cast("string"), 6, "0").alias("UBIGEO"), F.when(supplier % 5 == 4, "CALLAO").when(c("l_linenumber") % 2 == 0, "  lima ").otherwise("LIMA").alias("DEPARTAMENTO"), F.when(supplier % 7 == 6, "HUARAL").otherwise("Lima").alias("PROVINCIA"),
        F.concat(F.lit("distrito  "), (supplier % 10).cast("string")).alias("DISTRITO"), F.element_at(F.array(*map(F.lit, ("MINSA", "EsSalud", "GOBIERNO  REGIONAL", "PRIVADO"))), (supplier % 4 + 1).cast("int")).alias("SECTOR"),
        F.element_at(F.array(*map(F.lit, ("I-4", "II-1", "III-1"))), (supplier % 3 + 1).cast("int")).alias("CATEGORIA"), F.lpad(supplier.cast("string"), 8, "0").alias("CO_IPRESS"), F.concat(F.lit("Hospital\t"), supplier.cast("string")).alias("RAZON_SOC"),
        F.when(hit(113), "NE_0001").when(hit(127), "ne_0002").when(hit(173), "otro").otherwise(c("l_returnflag")).alias("ID_HOSPITALIZACION"), F.when(hit(131), "  ").when(hit(137), F.lit(None)).otherwise(F.lower("l_returnflag")).alias("HOSPITALIZACION"),
        F.when(hit(139), F.concat(F.lit("1,"), n, F.lit("00"))).when(hit(149), "-5").when(hit(151), "abc").when(hit(157), F.lit(None)).otherwise(n).alias("NRO_TOTAL_HOSPIT_ING"), F.when(hit(163), "NaN").otherwise(n).alias("NRO_TOTAL_HOSPIT_EGR"),
        quantity.alias("NRO_TOTAL_ESTANCIAS"), F.concat(F.lit(" "), quantity, F.lit(".5 ")).alias("NRO_TOTAL_PACIENTES_CAMAS"), (supplier % 8).cast("string").alias("NRO_TOTAL_CAMAS"), F.when(hit(167), "1.5d").otherwise(quantity).alias("NRO_TOTAL_CAMAS_DISPONIB"),
        F.lit("0").alias("NRO_TOTAL_FALLECIDOS"), F.concat(F.lit("d1_"), year, F.lit(".csv")).alias("ARCHIVO_ORIGEN"),
    )


def template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An uploaded template as text with a row id: the panel's rows, some faulty, some with a key that another has."""
    p = panel(spark, sf_dir)
    ordinal = F.col("anio") * 12 + F.col("mes")
    text = lambda c: F.col(c).cast("string")
    return p.select(
        F.concat_ws("|", "codigo_ipress", "anio", "mes", "servicio_hospitalizacion").alias("fila"), F.when(ordinal % 41 == 0, " ").otherwise(F.col("codigo_ipress")).alias("codigo_ipress"),
        F.when(ordinal % 43 == 0, "1899").when(ordinal % 47 == 0, F.lit(None)).otherwise(text("anio")).alias("anio"), F.when(ordinal % 37 == 0, "13").when(ordinal % 53 == 0, "x").otherwise(text("mes")).alias("mes"),
        F.when(ordinal % 31 == 0, "general").otherwise(F.col("servicio_hospitalizacion")).alias("servicio_hospitalizacion"), F.when(F.col("total_ingresos") > 3, "-1").otherwise(text("total_ingresos")).alias("total_ingresos"),
        text("total_egresos").alias("total_egresos"), F.when(ordinal % 29 == 0, "nan").otherwise(text("total_estancias")).alias("total_estancias"), text("total_pacientes_camas").alias("total_pacientes_camas"),
        F.when(F.col("total_camas") == 0, F.lit(None)).otherwise(text("total_camas")).alias("total_camas"), text("total_camas_disponibles").alias("total_camas_disponibles"),
    )


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_indicators(panel(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_current_risk(indicators(spark, sf_dir))


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full training table: indicators, temporal features, current risk and next month's; a month twice or missing
    percentiles are errors."""
    return with_future_target(with_temporal(with_current_risk(indicators(spark, sf_dir), strict=True)), strict=True)
