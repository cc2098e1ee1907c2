"""Training, scoring and explaining with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import support
from ..functions.indicators import next_period, period
from ..sources.delimited import read_metadata, write_metadata, write_reports
from ..sources.scratch import scratch, written
from .boosting import BoostedTrees
from .evaluation import (
    CLASSES, TARGET, baselines, check_split, check_targets, class_weights, classification_metrics, confusion_counts, confusion_matrix, every_cell, model_selection, roc_auc_ovr, stratified_split, temporal_split,
    with_split_year,
)
from .forest import RandomForest
from .logistic import Logistic
from .rollup import choose_test_year

NUMERIC = [c for c in S.PREDICTORS if c not in S.CATEGORICAL]


def scaling(df: DataFrame) -> DataFrame:
    """One row: mean and population deviation of each numeric predictor."""
    return df.agg(*_moments())


def _moments() -> list[Column]:
    return [x for c in NUMERIC for x in (F.avg(c).alias(f"{c}_media"), F.stddev_pop(c).alias(f"{c}_desv"))]


def scaled(df: DataFrame, statistics: DataFrame) -> DataFrame:
    """df with z_<predictor>; a constant predictor is 0."""
    joined = df.crossJoin(F.broadcast(statistics))
    z = {f"z_{c}": F.when(F.col(f"{c}_desv") > 0, (F.col(c) - F.col(f"{c}_media")) / F.col(f"{c}_desv")).otherwise(0.0) for c in NUMERIC}
    return joined.withColumns(z).drop(*statistics.columns)


def scaler(statistics: Row) -> SQLTransformer:
    """The stage that adds z_<predictor>, with its numbers in its statement, so that it is stored and loaded like any other."""
    number = lambda v: f"double('{v!r}')" if v is not None else "double(null)"
    z = [f"CASE WHEN {number(statistics[f'{c}_desv'])} > 0 THEN ({c} - {number(statistics[f'{c}_media'])}) / {number(statistics[f'{c}_desv'])} ELSE 0D END AS z_{c}" for c in NUMERIC]
    return SQLTransformer(statement=f"SELECT *, {', '.join(z)} FROM __THIS__")


def encoder() -> list:
    """Stages from the categorical and z_ columns to `features`; an unseen category is all zeros."""
    index = StringIndexer(inputCols=S.CATEGORICAL, outputCols=[f"i_{c}" for c in S.CATEGORICAL], handleInvalid="keep")
    hot = OneHotEncoder(inputCols=index.getOutputCols(), outputCols=[f"h_{c}" for c in S.CATEGORICAL], dropLast=True)
    return [index, hot, VectorAssembler(inputCols=[*hot.getOutputCols(), *[f"z_{c}" for c in NUMERIC]], outputCol="features")]


def classifiers(*, trees: int = 300, depth: int = 12, boosts: int = 300, boost_depth: int = 5, iterations: int = 2000, weight_sum: float = 1.0) -> dict[str, object]:
    return {
        "Regresion_Logistica": Logistic(iterations=iterations, penalty=1.0 / max(weight_sum, 1.0), classes=len(CLASSES), features="features", label=TARGET, weight="peso"),
        "Random_Forest": RandomForest(trees=trees, depth=depth, classes=len(CLASSES), seed=42, features="features", label=TARGET, weight="peso"),
        "Arboles_Potenciados": BoostedTrees(rounds=boosts, depth=boost_depth, step=0.05, rows=0.8, columns=0.8, classes=len(CLASSES), seed=42, features="features", label=TARGET, weight="peso"),
    }


@dataclass
class Prepared:
    """Training rows as written vectors (features, target, peso), with the fitted stages that made them."""

    stages: list
    rows: DataFrame
    n: int

    @property
    def groups(self) -> list[int]:
        """The one-hot values of each categorical predictor."""
        return [len(labels) for labels in self.stages[1].labelsArray]


def prepare(train: DataFrame) -> Prepared:
    """Encodes, scales and weights the rows once, for all fits on them.

    A small table comes in one partition, which one core would work through in each of the many passes: rows are spread over
    all cores, those of a table with more partitions than cores stay where they are."""
    spark = train.sparkSession
    weights = class_weights(train).select(F.col("clase").alias("_c"), "peso")
    narrow = train.select(*S.PREDICTORS, TARGET)
    found = narrow.agg(*_moments(), F.count("*").alias("filas")).first()
    pipeline = Pipeline(stages=[scaler(found), *encoder()]).fit(narrow)
    rows = pipeline.transform(narrow.join(F.broadcast(weights), F.col(TARGET) == F.col("_c"))).select("features", TARGET, "peso")
    cores = spark.sparkContext.defaultParallelism
    if narrow.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores)
    path = scratch(spark, "vectors")
    rows.write.parquet(path)
    return Prepared(pipeline.stages, spark.read.parquet(path), found.filas)


class FittedModel:
    """A fitted pipeline, from the predictors to the probabilities, and the classifier's name."""

    def __init__(self, pipeline: PipelineModel, name: str):
        self.pipeline, self.name = pipeline, name

    def transform(self, df: DataFrame) -> DataFrame:
        """df with p0, p1, p2 and yhat."""
        out = self.pipeline.transform(df).withColumn("_p", vector_to_array("probability"))
        return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.coalesce(F.get("_p", F.lit(c)), F.lit(0.0)).alias(f"p{c}") for c in CLASSES], F.col("prediction").cast("int").alias("yhat"))

    def save(self, path: str, metadata: DataFrame | None = None) -> None:
        """Stores the pipeline and a metadata row (the name, if none is given) under a new path."""
        spark = SparkSession.getActiveSession()
        self.pipeline.write().save(f"{path}/pipeline")
        write_metadata(spark.createDataFrame([(self.name,)], "mejor_modelo string") if metadata is None else metadata, f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> FittedModel:
    """A stored model; its metadata is read_model_metadata(spark, path)."""
    return FittedModel(PipelineModel.load(f"{path}/pipeline"), read_model_metadata(spark, path).first().mejor_modelo)


def read_model_metadata(spark: SparkSession, path: str) -> DataFrame:
    return read_metadata(spark, f"{path}/metadata")


def fit(train: DataFrame | Prepared, name: str, **parameters) -> FittedModel:
    """The named classifier on class-balanced training rows."""
    ready = train if isinstance(train, Prepared) else prepare(train)
    algorithm = classifiers(weight_sum=float(ready.n), **parameters)[name]
    if isinstance(algorithm, BoostedTrees):
        algorithm.groups = ready.groups
    if isinstance(algorithm, RandomForest):
        algorithm.flags = sum(ready.groups)
    return FittedModel(PipelineModel(stages=[*ready.stages, algorithm.fit(ready.rows)]), name)


def scored_rows(model: FittedModel, test: DataFrame, kind: str) -> DataFrame:
    return model.transform(test).select(F.lit(model.name).alias("modelo"), F.lit(kind).alias("evaluacion"), F.col(TARGET).cast("int").alias("y"), "yhat", "p0", "p1", "p2")


def metrics(scored: DataFrame) -> DataFrame:
    """A row a model and evaluation, from written scored rows."""
    one = scored.withColumn("modelo", F.concat_ws("|", "modelo", "evaluacion"))
    sure = one.groupBy("modelo").agg(F.avg(F.greatest("p0", "p1", "p2")).alias("probabilidad_maxima_promedio"))
    found = classification_metrics(confusion_counts(one)).join(roc_auc_ovr(one), "modelo").join(sure, "modelo")
    return found.withColumn("evaluacion", F.substring_index("modelo", "|", -1)).withColumn("modelo", F.substring_index("modelo", "|", 1))


def evaluated(model: FittedModel, test: DataFrame, kind: str = "temporal") -> DataFrame:
    """The metric row of a fitted model on test rows, which are scored once."""
    return metrics(written(scored_rows(model, test, kind), "scored"))


def feature_importance(model: FittedModel) -> DataFrame:
    """(variable, importancia) of trees, encoded columns summed to the raw one. Its size is the number of predictors."""
    values = model.pipeline.stages[-1].featureImportances.toArray()
    rows = SparkSession.getActiveSession().createDataFrame([(n, float(v)) for n, v in zip(encoded_columns(model), values)], "variable string, importancia double")
    return rows.groupBy("variable").agg(F.sum("importancia").alias("importancia"))


def encoded_columns(model: FittedModel) -> list[str]:
    """The raw predictor of each encoded column."""
    sizes = [len(labels) for labels in model.pipeline.stages[1].labelsArray] + [1] * len(NUMERIC)
    return [c for c, n in zip([*S.CATEGORICAL, *NUMERIC], sizes) for _ in range(n)]


def permutation_importance(model: FittedModel, test: DataFrame, columns: Sequence[str] = S.PREDICTORS, *, repeats: int = 5, max_rows: int | None = None, seed: int = 42, block_rows: int = 16_384) -> DataFrame:
    """(variable, importancia): the mean loss of macro F1 when a column's values are dealt anew, `repeats` times, among all test rows
    (with max_rows among those of least hash). A repeat has one deal, the same for each column.

    Rows are encoded once. A repeat scatters them by hash over blocks of about block_rows, and in a block each row's values go to
    the one before it by hash: a row's donor can be any other row, each is one once, and no task holds more than blocks. There a
    predictor's encoded columns are exchanged and the rows scored for it, and only counts leave the block."""
    at = [*S.SERIES, "anio", "mes"]
    rows = test if max_rows is None else test.orderBy(F.xxhash64(F.lit(seed), *at), *at).limit(max_rows)
    encoded = PipelineModel(model.pipeline.stages[:-1]).transform(rows).select(*at, F.col(TARGET).cast("int").alias("y"), vector_to_array("features").alias("x"))
    blocks = max(1, -(-rows.count() // block_rows))
    each = encoded.withColumn("vez", F.explode(F.array(*map(F.lit, range(repeats))))).withColumn("h", F.xxhash64(F.lit(seed), "vez", *at))
    dealt = each.select("vez", F.pmod("h", F.lit(blocks)).alias("bloque"), "h", "y", "x")
    owners = np.array(encoded_columns(model))
    scored = dealt.groupBy("vez", "bloque").applyInArrow(_permuted({c: np.flatnonzero(owners == c) for c in columns}, model.pipeline.stages[-1].scorer()), _CELLS)
    cells = every_cell(written(scored.groupBy("modelo", "y", "yhat").agg(F.sum("n").alias("n")), "permuted"))
    f1 = classification_metrics(cells).select("modelo", "f1_macro")
    base = f1.where("modelo = ''").select(F.col("f1_macro").alias("base"))
    varied = f1.where("modelo <> ''").crossJoin(F.broadcast(base))
    return varied.groupBy(F.substring_index("modelo", "|", 1).alias("variable")).agg(F.avg(F.col("base") - F.col("f1_macro")).alias("importancia"))


_CELLS = "modelo string, y int, yhat int, n long"


def _permuted(columns: dict[str, np.ndarray], scorer: Callable[[np.ndarray], np.ndarray]):
    """Of a block the cells (variable|repeat, y, yhat, n) of each predictor's deal; the first repeat's blocks tell those of the rows as they are, too."""

    def cells(block: pa.Table) -> pa.Table:
        block = block.sort_by("h")
        vez, y = block.column("vez")[0].as_py(), np.asarray(block.column("y")).astype(np.int64)
        x = np.asarray(block.column("x").combine_chunks().flatten()).reshape(len(y), -1).copy()
        donors = np.roll(x, -1, axis=0)
        out = []

        def count(name: str) -> None:
            found, n = np.unique(y * len(CLASSES) + scorer(x).argmax(axis=1), return_counts=True)
            out.extend({"modelo": name, "y": int(k) // len(CLASSES), "yhat": int(k) % len(CLASSES), "n": int(m)} for k, m in zip(found, n))

        if vez == 0:
            count("")
        for c, at in columns.items():
            own = x[:, at].copy()
            x[:, at] = donors[:, at]
            count(f"{c}|{vez}")
            x[:, at] = own
        return pa.Table.from_pylist(out, schema=pa.schema([("modelo", pa.string()), ("y", pa.int32()), ("yhat", pa.int32()), ("n", pa.int64())]))

    return cells


def importance(model: FittedModel, test: DataFrame) -> DataFrame:
    """(variable, importancia) as the classifier tells it, or by permutation where it tells none."""
    return feature_importance(model) if hasattr(model.pipeline.stages[-1], "featureImportances") else permutation_importance(model, test)


def together(spark: SparkSession, jobs: dict[str, Callable]) -> dict:
    """The results of independent jobs, submitted at once, each from its own scheduler pool (of use under FAIR scheduling)."""

    def run(name: str, job: Callable):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        return job()

    with ThreadPoolExecutor(len(jobs)) as threads:
        running = {name: threads.submit(inheritable_thread_target(spark)(run), name, job) for name, job in jobs.items()}
        return {name: r.result() for name, r in running.items()}


@dataclass
class TrainingRun:
    """What a training run finds: one row a model and evaluation in `metrics`, and so on; `final` is the winner fitted on all rows."""

    year: int
    complete: bool
    metrics: DataFrame
    baselines: DataFrame
    confusion: DataFrame
    selection: DataFrame
    importance: DataFrame
    final: FittedModel
    models: dict[tuple[str, str], FittedModel]

    def reports(self) -> dict[str, DataFrame]:
        return {"metricas": self.metrics, "metricas_baseline": self.baselines, "matriz_confusion": self.confusion, "importancia": self.importance}

    def metadata(self, df: DataFrame) -> DataFrame:
        """One nested row that tells how the model came about: rows, years, periods, classes, predictors, metrics, importances, margin."""
        spark = df.sparkSession
        year = spark.createDataFrame([(self.year,)], "anio_prueba int")
        summary = training_summary(df, year, self.metrics.where("evaluacion = 'temporal'"), self.importance)
        more = df.agg(F.count("*").alias("registros"), F.sort_array(F.collect_set("periodo_actual")).alias("periodos"))
        listed = lambda m, name: m.agg(F.collect_list(F.struct(*m.columns)).alias(name))
        chosen = self.selection.select(F.col("modelo").alias("mejor_modelo"), "f1_modelo", "baseline", "f1_baseline", "supera_baseline")
        fixed = {"tipo_modelo": F.lit("prediccion_siguiente_mes"), "horizonte_prediccion": F.lit("mes_siguiente"), "variable_objetivo": F.lit(TARGET), "anio_completo": F.lit(self.complete), "columnas_predictoras": F.array(*map(F.lit, S.PREDICTORS)), "columnas_excluidas": F.array(*map(F.lit, S.NEVER_PREDICTORS))}
        parts = [more, chosen, listed(self.metrics, "metricas"), listed(self.baselines, "metricas_baseline")]
        return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts, summary).withColumns(fixed)

    def save(self, df: DataFrame, path: str) -> None:
        """The final model, its metadata and the reports, under a new path."""
        self.final.save(path, self.metadata(df))
        write_reports(self.reports(), f"{path}/reports")


def training_run(df: DataFrame, *, names: Sequence[str] | None = None, asked_year: int | None = None, **parameters) -> TrainingRun:
    """Fits each classifier before the test year and on the random split, takes the best by macro F1 of the test year (the first
    by name of equals), and fits it again on all rows.

    df is read several times and should be a written table. Each split is dealt, encoded and written once, and the fits on it run at
    the same time. Test rows are scored once and written. Errors: a class missing or with one row, no complete or
    asked year, a test year without rows. Metrics, at most a few rows a model, are the only rows that reach the driver."""
    spark = df.sparkSession
    check_targets(df)
    year, complete = choose_test_year(df, asked_year)
    train, test = temporal_split(df, year)
    check_split(train, test)
    dealt = written(stratified_split(df), "random-split")
    splits = {"temporal": (train, test), "aleatorio": (dealt.where("parte = 'train'").drop("parte"), dealt.where("parte = 'test'").drop("parte"))}
    ready = together(spark, {kind: lambda rows=rows: prepare(rows) for kind, (rows, _) in splits.items()})
    kinds = {f"{kind}-{name}": (kind, name) for kind in splits for name in names or classifiers()}

    def one(kind: str, name: str) -> tuple[FittedModel, DataFrame]:
        model = fit(ready[kind], name, **parameters)
        return model, written(scored_rows(model, splits[kind][1], kind), "scored")

    found = together(spark, {k: lambda kind=kind, name=name: one(kind, name) for k, (kind, name) in kinds.items()})
    models = {(name, kind): found[k][0] for k, (kind, name) in kinds.items()}
    scored = reduce(DataFrame.unionByName, [rows for _, rows in found.values()])
    told = spark.createDataFrame(metrics(scored).collect())
    cells = confusion_matrix(scored.withColumn("modelo", F.concat_ws("|", "modelo", "evaluacion")))
    cells = cells.withColumn("evaluacion", F.substring_index("modelo", "|", -1)).withColumn("modelo", F.substring_index("modelo", "|", 1))
    baseline = spark.createDataFrame(classification_metrics(confusion_counts(baselines(train, test))).collect())
    selection = spark.createDataFrame(model_selection(told.where("evaluacion = 'temporal'"), baseline).collect())
    best = selection.first().modelo
    leading = spark.createDataFrame(importance(models[best, "temporal"], test).collect())
    return TrainingRun(year, complete, told, baseline, spark.createDataFrame(cells.collect()), selection, leading, fit(df, best, **parameters), models)


def top_variables(df: DataFrame, importance: DataFrame, limit: int = 5) -> Column:
    """The first `limit` important variables that df has, with their values as text."""
    order = [r.variable for r in importance.orderBy(F.col("importancia").desc(), "variable").collect() if r.variable in df.columns][:limit]
    return F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("valor")) for c in order])


def score(df: DataFrame, model: FittedModel, importance: DataFrame | None = None) -> DataFrame:
    """The prediction record: class, probabilities, index, light, factors and decision support."""
    out = model.transform(df)
    name = F.element_at(F.create_map(*[F.lit(x) for c, n in CLASSES.items() for x in (c, n)]), F.col("yhat"))
    out = out.withColumns({
        "nivel_riesgo_predicho": name, "nivel_riesgo_codificado": F.col("yhat"), "probabilidad": F.greatest("p0", "p1", "p2"),
        "probabilidades_por_clase": F.create_map(*[x for c, n in CLASSES.items() for x in (F.lit(n), F.col(f"p{c}"))]),
        **{f"probabilidad_riesgo_{n}": F.col(f"p{c}") for c, n in CLASSES.items()},
    }).drop("p0", "p1", "p2", "yhat")
    out = out.withColumn("riesgo_insuficiencia_capacidad", support.risk_index(F.col("nivel_riesgo_predicho"), F.col("probabilidad")))
    out = support.with_traffic_light(out, "nivel_riesgo_predicho").withColumn("factores_explicativos", support.risk_factors(F.col("nivel_riesgo_predicho")))
    if importance is not None:
        out = out.withColumn("variables_principales", top_variables(out, importance))
    return with_envelope(support.with_support(out, "nivel_riesgo_predicho", "probabilidad", model.name))


def with_envelope(df: DataFrame) -> DataFrame:
    """Periods, horizon, a warning where the history flag is false, and the reference note."""
    return df.withColumns({
        "periodo_actual": period(F.col("anio"), F.col("mes")), "periodo_predicho": next_period(F.col("anio"), F.col("mes")), "horizonte_prediccion": F.lit("mes_siguiente"),
        "advertencia_historial": F.when(~F.col("historial_completo"), F.lit(S.HISTORY_WARNING)), "mensaje": F.lit(S.REFERENCE_NOTE),
    })


def training_summary(df: DataFrame, year: DataFrame, metrics: DataFrame, importance: DataFrame) -> DataFrame:
    """One nested row: rows of each part, years, class distribution, best metrics and the ten leading variables."""
    parts = with_split_year(df, year).agg(F.count_if(F.col("parte") == "train").alias("registros_train"), F.count_if(F.col("parte") == "test").alias("registros_test"), F.sort_array(F.collect_set("anio")).alias("anios"))
    classes = df.groupBy("nivel_riesgo_siguiente_mes").count().agg(F.map_from_entries(F.collect_list(F.struct("nivel_riesgo_siguiente_mes", "count"))).alias("clases"))
    best = metrics.agg(F.max_by(F.struct(*metrics.columns), "f1_macro").alias("mejor"))
    leading = importance.orderBy(F.col("importancia").desc(), "variable").limit(10).agg(F.collect_list("variable").alias("variables"))
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [classes, best, leading, year], parts)


