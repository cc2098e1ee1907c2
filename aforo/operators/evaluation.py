"""Splits, baselines and classification metrics, from counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..sources.scratch import written

TARGET = "nivel_riesgo_siguiente_mes_codificado"
CLASSES = {v: k for k, v in S.RISK_CODES.items()}


def target_year() -> Column:
    return F.substring("periodo_predicho", 1, 4).cast("int")


def temporal_split(df: DataFrame, year: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose target year lies before, and those within, the test year; later ones are in neither.

    A row's own year is its target year or the one before it (December), and that is asked for as well: of a dataset by year only
    the two folders of the test are read, and none after the training's last."""
    own = F.col("anio")
    return df.where((own < year) & (target_year() < year)), df.where(own.between(year - 1, year) & (target_year() == year))


def check_split(train: DataFrame, test: DataFrame) -> None:
    if test.isEmpty() or {r[0] for r in train.select(TARGET).distinct().collect()} != set(CLASSES):
        raise ValueError("La partición temporal requiere las tres clases antes del año de prueba y datos dentro de él.")


def check_targets(df: DataFrame) -> None:
    """An error unless the classes are exactly the three known ones, with two rows or more each."""
    found = {r.clase: r.n for r in df.groupBy(F.col(TARGET).alias("clase")).agg(F.count("*").alias("n")).collect()}
    if set(found) != set(CLASSES) or min(found.values()) < 2:
        raise ValueError(f"El objetivo debe tener las clases {sorted(CLASSES)} con al menos dos registros cada una: {found}")


def with_split_year(df: DataFrame, year: DataFrame) -> DataFrame:
    """df with `parte` (train, test or null) by a one-row table with anio_prueba."""
    return df.crossJoin(F.broadcast(year)).withColumn("parte", F.when(target_year() < F.col("anio_prueba"), "train").when(target_year() == F.col("anio_prueba"), "test")).drop("anio_prueba")


def stratified_sizes(df: DataFrame, share: float = 0.2) -> DataFrame:
    """(clase, n, n_test): tests of ceil(share x rows) in all, dealt to classes by the largest remainder."""
    counts = df.groupBy(F.col(TARGET).alias("clase")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()
    exact = F.col("n") * F.ceil(F.sum("n").over(whole) * share) / F.sum("n").over(whole)
    parts = counts.withColumns({"exacto": exact, "todos": F.ceil(F.sum("n").over(whole) * share)}).withColumn("piso", F.floor("exacto"))
    rank = F.row_number().over(Window.orderBy((F.col("exacto") - F.col("piso")).desc(), "clase"))
    return parts.withColumns({"puesto": rank, "falta": F.col("todos") - F.sum("piso").over(whole)}).select("clase", "n", (F.col("piso") + F.when(F.col("puesto") <= F.col("falta"), 1).otherwise(0)).alias("n_test"))


def stratified_split(df: DataFrame, seed: int = 42, share: float = 0.2, buckets: int = 1024) -> DataFrame:
    """df with `parte`: the n_test rows of least hash in each class are the test.

    A class's cut is found over hash buckets, and only the cut's bucket is ranked, so no task sorts a whole class."""
    h = F.xxhash64(F.lit(seed), *S.SERIES, "anio", "mes")
    rows = df.withColumn("_h", h).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    per = rows.groupBy(F.col(TARGET).alias("clase"), F.col("_b").alias("b")).agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("clase").orderBy("b"))
    cuts = per.withColumn("antes", upto - F.col("k")).join(F.broadcast(stratified_sizes(df, share)), "clase").where("antes < n_test").groupBy("clase").agg(F.max(F.struct("b", (F.col("n_test") - F.col("antes")).alias("resto"))).alias("corte"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(TARGET, "_b").orderBy("_h", *S.SERIES, "anio", "mes")))
    test = (F.col("_b") < F.col("corte.b")) | ((F.col("_b") == F.col("corte.b")) & (F.col("_r") <= F.col("corte.resto")))
    return ranked.join(F.broadcast(cuts), F.col(TARGET) == F.col("clase"), "left").withColumn("parte", F.when(test, "test").otherwise("train")).drop("_h", "_b", "_r", "clase", "corte")


def class_weights(df: DataFrame, target: str = TARGET) -> DataFrame:
    """(clase, n, peso): rows / (classes x rows of the class)."""
    counts = df.groupBy(F.col(target).alias("clase")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()
    return counts.withColumn("peso", F.sum("n").over(whole) / (F.count("*").over(whole) * F.col("n")))


def majority_class(df: DataFrame, target: str = TARGET) -> DataFrame:
    """One row: the class with most rows, the smallest of equals."""
    return df.groupBy(F.col(target).alias("clase")).agg(F.count("*").alias("n")).agg(F.max_by("clase", F.struct("n", -F.col("clase"))).alias("clase"), F.max("n").alias("n"))


def occupancy_rule(ratio: Column) -> Column:
    return F.when(ratio >= 0.85, 2).when(ratio >= 0.70, 1).otherwise(0)


def baselines(train: DataFrame, test: DataFrame) -> DataFrame:
    """(modelo, y, yhat) of the three baselines on the test rows."""
    major = majority_class(train).select(F.col("clase").alias("mayor"))
    t = test.crossJoin(F.broadcast(major))
    models = F.array(*[F.struct(F.lit(n).alias("modelo"), p.cast("int").alias("yhat")) for n, p in (("Clase_Mayoritaria", F.col("mayor")), ("Persistencia_Riesgo_Actual", F.col("nivel_riesgo_actual_codificado")), ("Regla_Ocupacion_Actual", occupancy_rule(F.col("ocupacion_estimada"))))])
    return t.select(F.col(TARGET).alias("y"), F.explode(models).alias("m")).select("m.modelo", "y", "m.yhat")


def confusion_counts(predictions: DataFrame) -> DataFrame:
    """(modelo, y, yhat, n) with a row for each of the nine cells."""
    return every_cell(predictions.groupBy("modelo", "y", "yhat").agg(F.count("*").alias("n")))


def every_cell(cells: DataFrame) -> DataFrame:
    """(modelo, y, yhat, n) of the cells that have rows, with those that have none."""
    codes = F.array(*[F.lit(c) for c in CLASSES])
    every = cells.select("modelo").distinct().select("modelo", F.explode(codes).alias("y")).select("modelo", "y", F.explode(codes).alias("yhat"))
    return every.join(cells, ["modelo", "y", "yhat"], "left").na.fill(0, ["n"])


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    cells = confusion_counts(predictions).groupBy("modelo", "y").pivot("yhat", list(CLASSES)).agg(F.sum("n"))
    name = F.element_at(F.create_map(*[F.lit(x) for c, n in CLASSES.items() for x in (c, f"real_{n}")]), F.col("y"))
    return cells.select("modelo", name.alias("real"), *[F.col(str(c)).alias(f"predicho_{n}") for c, n in CLASSES.items()])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def class_report(counts: DataFrame) -> DataFrame:
    """Per model and class: tp, support, predicted, precision, recall, f1, specificity, from (modelo, y, yhat, n)."""
    sides = counts.select("modelo", F.explode(F.array(*[F.struct(F.lit(c).alias("clase"), F.when((F.col("y") == c) & (F.col("yhat") == c), F.col("n")).otherwise(0).alias("tp"), F.when(F.col("y") == c, F.col("n")).otherwise(0).alias("real"), F.when(F.col("yhat") == c, F.col("n")).otherwise(0).alias("pred"), F.col("n").alias("todo")) for c in CLASSES])).alias("s"))
    per = sides.groupBy("modelo", "s.clase").agg(*[F.sum(f"s.{x}").alias(x) for x in ("tp", "real", "pred", "todo")])
    precision, recall = _ratio(F.col("tp"), F.col("pred")), _ratio(F.col("tp"), F.col("real"))
    negatives = F.col("todo") - F.col("real")
    per = per.withColumns({"precision": precision, "recall": recall, "especificidad": _ratio(negatives - (F.col("pred") - F.col("tp")), negatives)})
    return per.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def classification_metrics(counts: DataFrame) -> DataFrame:
    """(modelo, accuracy, balanced_accuracy, precision_macro, recall_macro, specificity_macro, f1_macro).

    Macro means run over classes in truth or prediction, balanced accuracy over those in truth, specificity over all."""
    per = class_report(counts)
    seen = (F.col("real") > 0) | (F.col("pred") > 0)
    mean = lambda c, of: F.avg(F.when(of, F.col(c)))
    return per.groupBy("modelo").agg(
        (F.sum("tp") / F.max("todo")).alias("accuracy"), mean("recall", F.col("real") > 0).alias("balanced_accuracy"), mean("precision", seen).alias("precision_macro"),
        mean("recall", seen).alias("recall_macro"), F.avg("especificidad").alias("specificity_macro"), mean("f1", seen).alias("f1_macro"),
    )


def classification_report(counts: DataFrame) -> DataFrame:
    """(modelo, etiqueta, precision, recall, f1, soporte) of each class, and their macro and weighted means."""
    per = class_report(counts)
    name = F.element_at(F.create_map(*[F.lit(x) for c, n in CLASSES.items() for x in (c, n)]), F.col("clase"))
    rows = per.select("modelo", name.alias("etiqueta"), "precision", "recall", "f1", F.col("real").alias("soporte"))
    macro = per.groupBy("modelo").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("real").alias("soporte")).withColumn("etiqueta", F.lit("macro avg"))
    weighted = per.groupBy("modelo").agg(*[(F.sum(F.col(c) * F.col("real")) / F.sum("real")).alias(c) for c in ("precision", "recall", "f1")], F.sum("real").alias("soporte")).withColumn("etiqueta", F.lit("weighted avg"))
    return rows.unionByName(macro).unionByName(weighted)


def hard_probabilities(predictions: DataFrame) -> DataFrame:
    return predictions.withColumns({f"p{c}": F.when(F.col("yhat") == c, 1.0).otherwise(0.0) for c in CLASSES})


def roc_auc_ovr(scored: DataFrame) -> DataFrame:
    """(modelo, roc_auc_ovr_macro) from (modelo, y, p0, p1, p2): the mean over classes of the rank statistic, ties halved;
    null if a class has only positives or none.

    Rows are counted by score, and the counts written by ranges of (model, class, score). Negatives below a score are those of the
    earlier ranges, from a sum a range, and those before it in its own: no task gets all scores of a class."""
    long = scored.select("modelo", "y", F.explode(F.array(*[F.struct(F.lit(c).alias("clase"), F.col(f"p{c}").alias("s")) for c in CLASSES])).alias("e"))
    at = long.groupBy("modelo", "e.clase", "e.s").agg(F.count_if(F.col("y") == F.col("e.clase")).alias("pos"), F.count_if(F.col("y") != F.col("e.clase")).alias("neg"))
    at = written(at.repartitionByRange("modelo", "clase", "s").withColumn("tramo", F.spark_partition_id()), "scores")
    sums = at.groupBy("modelo", "clase", "tramo").agg(F.sum("neg").alias("suyos"))
    earlier = F.sum("suyos").over(Window.partitionBy("modelo", "clase").orderBy("tramo")) - F.col("suyos")
    within = Window.partitionBy("modelo", "clase", "tramo").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    pairs = at.withColumn("menos", F.coalesce(F.sum("neg").over(within), F.lit(0))).join(sums.select("modelo", "clase", "tramo", earlier.alias("antes")), ["modelo", "clase", "tramo"])
    below = F.col("antes") + F.col("menos")
    per = pairs.groupBy("modelo", "clase").agg(F.sum(F.col("pos") * (below + F.col("neg") * 0.5)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    auc = per.withColumn("auc", F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))))
    return auc.groupBy("modelo").agg(F.when(F.count("auc") == len(CLASSES), F.avg("auc")).alias("roc_auc_ovr_macro"))


def model_selection(metrics: DataFrame, baseline: DataFrame, margin: float = 0.02) -> DataFrame:
    """One row: best model and baseline by macro F1, the first by name of equals, and whether the margin is met."""
    best = lambda df, a: df.agg(F.min_by("modelo", F.struct(-F.col("f1_macro"), F.col("modelo"))).alias(a), F.max("f1_macro").alias(f"f1_{a}"))
    return best(metrics, "modelo").crossJoin(best(baseline, "baseline")).withColumn("supera_baseline", F.col("f1_modelo") > F.col("f1_baseline") + margin)
