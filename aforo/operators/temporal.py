"""Gap-aware features of monthly series. All windows share one specification, so one exchange and sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.indicators import month_ordinal, next_period, period, with_calendar


def ordinal() -> Column:
    return month_ordinal(F.col("anio"), F.col("mes"))


def _series() -> WindowSpec:
    return Window.partitionBy(*S.SERIES).orderBy(ordinal())


def _previous(column: str, n: int, w: WindowSpec | str | None = None) -> Column:
    """The value n rows before within w, or of the struct of that row where w names the structs."""
    return F.col(f"{w}{n}.{column}") if isinstance(w, str) else F.lag(column, n).over(w or _series())


def _since(n: int, w: WindowSpec | None) -> Column:
    return ordinal() - F.lag(ordinal(), n).over(w or _series())


def _one_back(w: WindowSpec | str | None = None) -> Column:
    return F.col(f"{w}1").isNotNull() if isinstance(w, str) else F.coalesce(_since(1, w) == 1, F.lit(False))


def _two_back(w: WindowSpec | str | None = None) -> Column:
    return _one_back(w) & (F.col(f"{w}2").isNotNull() if isinstance(w, str) else F.coalesce(_since(2, w) == 2, F.lit(False)))


def moving_mean(column: str, w: WindowSpec | str | None = None) -> Column:
    """Mean of this month, the one before and the one before that, as far as they follow without a gap; nulls are left out."""
    values = F.array(F.col(column), F.when(_one_back(w), _previous(column, 1, w)), F.when(_two_back(w), _previous(column, 2, w)))
    held = F.array_compact(values)
    return F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / F.size(held))


def trend(column: str, w: WindowSpec | str | None = None) -> Column:
    """Change against the month before, 0.0 where that month is missing."""
    return F.when(_one_back(w), F.col(column) - _previous(column, 1, w)).otherwise(0.0)


def with_moving_means(df: DataFrame, w: WindowSpec | str | None = None) -> DataFrame:
    return df.withColumns({out: moving_mean(c, w) for c, out in S.MEANS_3M.items()})


def with_trends(df: DataFrame, w: WindowSpec | str | None = None) -> DataFrame:
    return df.withColumns({out: trend(c, w) for c, out in S.TRENDS_1M.items()})


def with_temporal(df: DataFrame, w: WindowSpec | str | None = None) -> DataFrame:
    return with_trends(with_moving_means(with_calendar(df), w), w)


def duplicate_periods(df: DataFrame) -> DataFrame:
    """Series and months that have several rows, with their number."""
    return df.groupBy(*S.SERIES, "anio", "mes").agg(F.count("*").alias("n")).where("n > 1")


DUPLICATES = "Existen registros duplicados para una misma IPRESS, servicio y periodo mensual."


def check_periods(df: DataFrame) -> DataFrame:
    """df itself; an error where a series has a month twice."""
    if not duplicate_periods(df).isEmpty():
        raise ValueError(DUPLICATES)
    return df


def with_history_flag(df: DataFrame, w: WindowSpec | str | None = None) -> DataFrame:
    return df.withColumn("historial_completo", _two_back(w))


def with_future_target(df: DataFrame, *, strict: bool = False) -> DataFrame:
    """Next month's risk on each row; rows whose series has no row in exactly the next month go.

    strict: a month that a series has twice is an error, seen within the same window when the rows are computed."""
    follows = F.lead(ordinal()).over(_series()) == ordinal() + 1
    if strict:
        follows = F.when(_since(1, None) == 0, F.raise_error(F.lit(DUPLICATES)).cast("boolean")).otherwise(follows)
    return df.withColumns({
        "periodo_actual": period(F.col("anio"), F.col("mes")), "periodo_predicho": next_period(F.col("anio"), F.col("mes")),
        "nivel_riesgo_siguiente_mes": F.lead("nivel_riesgo_actual").over(_series()), "nivel_riesgo_siguiente_mes_codificado": F.lead("nivel_riesgo_actual_codificado").over(_series()), "_sigue": follows,
    }).where("_sigue").drop("_sigue")


def next_month_join(df: DataFrame) -> DataFrame:
    """The same pairs by a self-join on the series and the next month: a cross-check of with_future_target."""
    now = df.select(*S.SERIES, "anio", "mes", ordinal().alias("ord"))
    then = df.select(*S.SERIES, (ordinal() - 1).alias("ord"), F.col("nivel_riesgo_actual").alias("nivel_riesgo_siguiente_mes"))
    return now.join(then, [*S.SERIES, "ord"]).drop("ord")


def score_rows(current: DataFrame, history: DataFrame, limit: int = 12) -> DataFrame:
    """Temporal features of the current rows from their series' history, of which the `limit` months before each may be used.

    No feature reaches back further than two months, so a current row looks up these two, whatever the limit: windows over the series
    find them by their month among its rows of both kinds, in one exchange, and any number of current rows is as good. A current row
    that is in the history as well is no history of its own. A month that the history has twice ends what follows without a gap."""
    measures = [c for c in dict.fromkeys([*S.MEANS_3M, *S.TRENDS_1M]) if c in history.columns]
    absent = [c for c in history.columns if c not in current.columns]
    rows = current.withColumns({c: F.lit(None).cast(history.schema[c].dataType) for c in absent}).withColumn("_actual", F.lit(1))
    columns = [c for c in rows.columns if c not in ("_actual", "historial_completo", *S.TEMPORAL)]
    past = history.select(*S.SERIES, "anio", "mes", *measures, F.lit(0).alias("_actual"))
    both = rows.unionByName(past, allowMissingColumns=True).withColumn("_ord", ordinal().cast("int"))
    of, value = F.when(F.col("_actual") == 0, F.lit(1)), F.when(F.col("_actual") == 0, F.struct(*[F.col(c) for c in dict.fromkeys([*S.MEANS_3M, *S.TRENDS_1M])]))
    month = lambda n: Window.partitionBy(*S.SERIES).orderBy("_ord").rangeBetween(-n, -n)
    found = both.withColumns({"_m1": F.last(value, ignorenulls=True).over(month(1)) if limit > 0 else F.lit(None), "_m2": F.last(value, ignorenulls=True).over(month(2)), "_n1": F.count(of).over(month(1))})
    once = found.where("_actual = 1").withColumn("_m2", F.when((F.col("_n1") == 1) & F.lit(limit > 1), F.col("_m2")))
    return with_history_flag(with_temporal(once, "_m"), "_m").select(*columns, *S.TEMPORAL, "historial_completo")


def history_violations(current: DataFrame, history: DataFrame, limit: int = 12) -> DataFrame:
    """(series, motivo): history not before the current month, with a repeated month, or longer than `limit` rows,
    or of a series that has no current row."""
    now = current.select(*S.SERIES, ordinal().alias("ahora"))
    past = history.select(*S.SERIES, ordinal().alias("ord"))
    late = past.join(now, S.SERIES).where("ord >= ahora").select(*S.SERIES, F.lit("posterior").alias("motivo"))
    twice = past.groupBy(*S.SERIES, "ord").count().where("count > 1").select(*S.SERIES, F.lit("duplicado").alias("motivo"))
    many = past.groupBy(*S.SERIES).count().where(F.col("count") > limit).select(*S.SERIES, F.lit("demasiados").alias("motivo"))
    foreign = past.join(now, S.SERIES, "left_anti").select(*S.SERIES, F.lit("ajena").alias("motivo"))
    return late.unionByName(twice).unionByName(many).unionByName(foreign).distinct()
