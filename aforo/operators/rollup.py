"""Roll-ups and summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..sources.scratch import written

PRESSURE = "presion_ingresos_camas"


def monthly_rollup(df: DataFrame) -> DataFrame:
    """Sums of the measures by the 13 keys; null keys form groups."""
    return df.groupBy(*S.RAW_KEYS).agg(*[F.sum(c).alias(c) for c in S.RAW_MEASURES])


def rollup_max_capacity(df: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """One row a facility, month and service: flows summed, capacities by their maximum, and a flag where a capacity differs
    by more than the tolerance. Exact copies count once."""
    flows = ["total_ingresos", "total_egresos", "total_estancias", "total_pacientes_camas", "total_fallecidos"]
    capacities = ["total_camas", "total_camas_disponibles"]
    spread = [F.coalesce((F.max(c) - F.min(c)) / F.nullif(F.max(c), F.lit(0.0)) > tolerance, F.lit(False)) for c in capacities]
    return df.dropDuplicates().groupBy(*S.TEMPLATE_KEY).agg(*[F.sum(c).alias(c) for c in flows], *[F.max(c).alias(c) for c in capacities], (spread[0] | spread[1]).alias("capacidad_difiere"))


def _finite(column: str):
    c = F.col(column)
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


_SLOTS = 1 << 16


def _magnitude(v: Column) -> Column:
    """A whole number that grows with v: its sign and sixteenth powers of two. 67 thousand of them hold all doubles."""
    power = F.floor(F.log2(F.abs(v)) * 16) + 20_000
    return F.when(F.isnan(v), F.lit(1 << 40)).when(v == 0, F.lit(0)).when(F.abs(v) == float("inf"), F.signum(v) * (1 << 30)).otherwise(F.signum(v) * power).cast("long")


def exact_percentiles(df: DataFrame, value: Column, shares: Sequence[float], *by: str, stored: bool = False) -> DataFrame:
    """(by..., n, p): how many values a group has and its percentiles, in the order of the shares, by linear interpolation.
    Nulls do not count; a group without values has no row, but without `by` there is one row, with an n of 0 and an empty p.

    A radix selection: the values are written (unless df is stored, so that reading it again is cheap), and counted by magnitude; of each slot that holds a wanted rank the values from its
    least to its largest are counted again in 65,536 equal slots, until a slot has one value. A magnitude has some 2^48 doubles, so
    that takes three further passes at most, whatever the values, and no task ever gets more than the counters of a group."""
    values = df.select(*by, value.cast("double").alias("v")).where("v is not null")
    values = values if stored else written(values, "values")

    def kept(asked: DataFrame) -> DataFrame:
        """Computed once. Without groups that is a row a share and side; rows of groups stay with Spark."""
        return written(asked, "ranks") if by else asked.sparkSession.createDataFrame(asked.collect(), asked.schema)

    n = Window.partitionBy(*by)
    slots = values.groupBy(*by, _magnitude(F.col("v")).alias("slot")).agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
    slots = slots.withColumns({"n": F.sum("c").over(n), "before": F.sum("c").over(n.orderBy("slot")) - F.col("c")})
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), (F.lit(float(p)) * (F.col("n") - 1)).alias("exact")) for k, p in enumerate(shares) for side in (0, 1)])
    each = slots.select(*by, "n", "before", "c", "low", "high", F.explode(wanted).alias("w")).select(*by, "n", "before", "c", "low", "high", "w.k", "w.side", "w.exact", F.when(F.col("w.side") == 0, F.floor("w.exact")).otherwise(F.ceil("w.exact")).alias("rank"))
    holds = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c"))
    columns = [*by, "n", "k", "side", "exact", "rank", "before", "low", "high"]
    asked = kept(each.where(holds).select(*columns))
    done = [asked.where("not low < high")]
    while not (left := asked.where("low < high")).isEmpty():
        t = left.select(*columns)
        inside = (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))
        met = values.join(t, list(by)).where(inside) if by else values.join(F.broadcast(t), inside)  # without groups it has a row a share and side
        slot = F.least(F.lit(_SLOTS - 1), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * _SLOTS))
        counted = met.groupBy(*columns, slot.alias("slot")).agg(F.count("*").alias("c"), F.min("v").alias("first"), F.max("v").alias("last"))
        upto = F.sum("c").over(Window.partitionBy(*columns).orderBy("slot"))
        counted = counted.withColumn("start", F.col("before") + upto - F.col("c")).where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("c")))
        asked = kept(counted.select(*by, "n", "k", "side", "exact", "rank", F.col("start").alias("before"), F.col("first").alias("low"), F.col("last").alias("high")))
        done.append(asked.where("not low < high"))
    found = reduce(DataFrame.unionByName, done).groupBy(*by, "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("low"))).alias("one"), F.max(F.when(F.col("side") == 1, F.col("low"))).alias("two"), F.max("exact").alias("exact"), F.max("n").alias("n")
    )
    between = (F.ceil("exact") - F.col("exact")) * F.col("one") + (F.col("exact") - F.floor("exact")) * F.col("two")
    p = F.when(F.col("one") == F.col("two"), F.col("one")).otherwise(between)
    return found.groupBy(*by).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.sort_array(F.collect_list(F.struct("k", p.alias("p")))).alias("p")).select(*by, "n", F.col("p.p").alias("p"))


def pressure_percentiles(df: DataFrame, exact: bool = True, accuracy: int = 10_000, *, stored: bool = False) -> DataFrame:
    """One row: P50 and P75 of the finite pressures by linear interpolation, and how many there are; exact=False takes
    approximate ones, in one pass. Without finite pressures both are null (with_current_risk(strict=True) makes that an error)."""
    v = _finite(PRESSURE)
    if exact:
        found = exact_percentiles(df, v, (0.5, 0.75), stored=stored).withColumnRenamed("n", "cantidad_valores_validos")
    else:
        found = df.agg(F.percentile_approx(v, [0.5, 0.75], accuracy).alias("p"), F.count(v).alias("cantidad_valores_validos"))
    return found.select(F.get("p", F.lit(0)).alias("presion_ingresos_camas_percentil_50"), F.get("p", F.lit(1)).alias("presion_ingresos_camas_percentil_75"), "cantidad_valores_validos")


def describe_indicators(df: DataFrame, columns=("ocupacion_estimada", "ratio_camas_disponibles", PRESSURE)) -> DataFrame:
    """A row an indicator: count, mean, sample deviation, extremes and quartiles."""
    long = df.select(F.stack(F.lit(len(columns)), *[x for c in columns for x in (F.lit(c), F.col(c))]).alias("indicador", "valor"))
    sums = long.groupBy("indicador").agg(F.count("valor").alias("n"), F.avg("valor").alias("media"), F.stddev_samp("valor").alias("desviacion"), F.min("valor").alias("minimo"), F.max("valor").alias("maximo"))
    quartiles = exact_percentiles(long, F.col("valor"), (0.25, 0.5, 0.75), "indicador").drop("n")
    return sums.join(quartiles, "indicador", "left").select("indicador", "n", "media", "desviacion", "minimo", *[F.get("p", F.lit(k)).alias(c) for k, c in enumerate(("p25", "p50", "p75"))], "maximo")


def anomaly_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("ratio_camas_disponibles") > 1.5).alias("ratio_mayor_1_5"), F.count_if((F.col("total_camas") == 0) & (F.col("total_ingresos") > 0)).alias("sin_camas_con_ingresos"))


def frequencies(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def dataset_metadata(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows before and after the target, years, files and periods. The lists are of small domains."""
    b = before.agg(F.count("*").alias("registros_antes"), F.count_distinct("archivo_origen").alias("n_archivos"), F.sort_array(F.collect_set("anio")).alias("anios"))
    a = after.agg(F.count("*").alias("registros_despues"), F.min("periodo_actual").alias("primer_periodo"), F.max("periodo_actual").alias("ultimo_periodo"), F.count_distinct("periodo_actual").alias("n_periodos"))
    return b.crossJoin(F.broadcast(a)).withColumn("registros_eliminados", F.col("registros_antes") - F.col("registros_despues"))


def stage_counts(source: DataFrame, first: str, **steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(etapa, registros) of the source and after each step, in one run of the chain: rows are counted as they pass. No filter moves across
    a count, and columns that no later step asks for are not computed."""
    seen = {name: Observation(f"etapa-{name}") for name in (first, *steps)}
    count = F.count(F.lit(1)).alias("registros")
    df = source.observe(seen[first], count)
    for name, step in steps.items():
        df = step(df).observe(seen[name], count)
    df.select(F.lit(1).alias("fila")).write.format("noop").mode("overwrite").save()
    return source.sparkSession.createDataFrame([(name, o.get["registros"]) for name, o in seen.items()], "etapa string, registros long")


def complete_years(df: DataFrame) -> DataFrame:
    """Target years with their number of distinct months."""
    target = F.to_date(F.concat("periodo_predicho", F.lit("-01")))
    return df.select(F.year(target).alias("anio_objetivo"), F.month(target).alias("mes")).groupBy("anio_objetivo").agg(F.count_distinct("mes").alias("n_meses"))


def test_year(df: DataFrame) -> DataFrame:
    """One row: the last target year with all 12 months; null if there is none."""
    return complete_years(df).where("n_meses = 12").agg(F.max("anio_objetivo").alias("anio_prueba"))


def choose_test_year(df: DataFrame, asked: int | None = None) -> tuple[int, bool]:
    """(year, whether it is complete); an error where the asked year, or any complete one, is absent."""
    if asked is not None:
        found = complete_years(df).where(F.col("anio_objetivo") == asked).first()
        if found is None:
            raise ValueError(f"El año de prueba {asked} no existe en los periodos objetivo.")
        return asked, found.n_meses == 12
    year = test_year(df).first().anio_prueba
    if year is None:
        raise ValueError("No existe un año objetivo completo para la evaluación temporal.")
    return year, True


def prediction_upsert(stored: DataFrame, new: DataFrame, key: str = "indicador_id", date: str = "fecha") -> DataFrame:
    """The latest prediction of each key; of equal dates a new one wins over a stored one."""
    both = stored.withColumn("_nuevo", F.lit(0)).unionByName(new.withColumn("_nuevo", F.lit(1)))
    columns = [c for c in stored.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(date, "_nuevo")).alias("s")).select(key, *[F.col(f"s.{c}").alias(c) for c in columns])


def store_predictions(new: DataFrame, path: str, key: str = "indicador_id", date: str = "fecha", buckets: int = 64) -> None:
    """prediction_upsert into a table at the path, in `buckets` folders by the key's hash (the same number each time). Only folders
    that a new key falls into are read and written again; the others' files stay as they are. An absent table begins with `new`."""
    spark = new.sparkSession
    dealt = written(new.withColumn("cubo", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "predictions")
    touched = [r.cubo for r in dealt.select("cubo").distinct().collect()]
    stored = read_predictions(spark, path, dealt.schema).where(F.col("cubo").isin(touched))
    latest = prediction_upsert(stored, dealt, key, date)
    latest.repartition("cubo").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cubo").parquet(path)


def read_predictions(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The stored predictions with their folder number `cubo`; with a schema, no rows where there is no table yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if schema is None:
        return spark.read.parquet(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
