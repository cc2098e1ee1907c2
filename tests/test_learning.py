"""The training run, its checks, importances and reports, with small models on the smallest tables."""

import glob
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from aforo import schema as S
from aforo.operators import boosting, evaluation, learning, logistic, rollup, temporal
from aforo.plans import catalog
from aforo.sources import delimited

SMALL = {"trees": 5, "depth": 4, "iterations": 10, "boosts": 6, "boost_depth": 3}
NAMES = ("Regresion_Logistica", "Random_Forest", "Arboles_Potenciados")


@pytest.fixture(scope="module")
def table(spark):
    return catalog._training_table(spark, "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def run(table):
    return learning.training_run(table, **SMALL)


def test_run_evaluates_both_splits_and_refits_the_winner_on_all_rows(run, table):
    metrics = {(r.modelo, r.evaluacion): r for r in run.metrics.collect()}
    assert set(metrics) == {(n, k) for n in NAMES for k in ("temporal", "aleatorio")}
    best = min(NAMES, key=lambda n: (-metrics[n, "temporal"].f1_macro, n))
    chosen = run.selection.first()
    assert run.final.name == chosen.modelo == best and chosen.f1_modelo == metrics[best, "temporal"].f1_macro
    assert chosen.supera_baseline == (chosen.f1_modelo > chosen.f1_baseline + 0.02)
    mean = table.agg(F.avg("total_ingresos")).first()[0]
    told = float(re.search(r"\(total_ingresos - double\('([^']+)'\)", run.final.pipeline.stages[0].getStatement()).group(1))
    assert abs(told - mean) < 1e-9  # scaled by all rows, not by the years before the test
    assert run.final.transform(table).count() == table.count() and run.year == rollup.test_year(table).first().anio_prueba


def test_confusion_matrices_hold_each_test_row_once(run, table):
    n = table.where(evaluation.target_year() == run.year).count()
    for r in run.confusion.where("evaluacion = 'temporal'").groupBy("modelo").agg(F.sum(F.col("predicho_bajo") + F.col("predicho_medio") + F.col("predicho_alto")).alias("n")).collect():
        assert r.n == n


def test_reports_are_read_back_as_written(run, spark, tmp_path):
    delimited.write_reports(run.reports(), str(tmp_path))
    for name, df in run.reports().items():
        back = delimited.read_report(spark, str(tmp_path), name, df.schema)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
        assert open(glob.glob(f"{tmp_path}/{name}/*.csv")[0], "rb").read(3) == b"\xef\xbb\xbf"


def test_permutation_finds_the_column_that_decides(table, spark):
    decided = table.withColumn(evaluation.TARGET, F.when(F.col("total_ingresos") > 2, 2).when(F.col("total_ingresos") > 1, 1).otherwise(0))
    model = learning.fit(decided, "Random_Forest", trees=10, depth=5)
    got = {r.variable: r.importancia for r in learning.permutation_importance(model, decided, ["total_ingresos", "mes_sin", "sector"], repeats=2, max_rows=500).collect()}
    assert set(got) == {"total_ingresos", "mes_sin", "sector"}
    assert got["total_ingresos"] == max(got.values()) > 0
    assert got == {r.variable: r.importancia for r in learning.permutation_importance(model, decided, ["total_ingresos", "mes_sin", "sector"], repeats=2, max_rows=500).collect()}


def test_permutation_takes_every_test_row(table, spark, monkeypatch):
    many = table.crossJoin(spark.range(12).withColumnRenamed("id", "k")).withColumn("codigo_ipress", F.concat_ws("-", "codigo_ipress", "k")).drop("k")
    n = many.count()
    assert n > 5000
    model = learning.fit(table, "Regresion_Logistica", iterations=3)
    told, metrics = [], learning.classification_metrics
    monkeypatch.setattr(learning, "classification_metrics", lambda counts: told.extend(counts.groupBy("modelo").agg(F.sum("n").alias("n")).collect()) or metrics(counts))
    got = learning.permutation_importance(model, many, ["mes", "sector"], repeats=2).collect()
    assert {r.variable for r in got} == {"mes", "sector"}
    assert {r.modelo: r.n for r in told} == {m: n for m in ("", "mes|0", "mes|1", "sector|0", "sector|1")}


def test_the_importance_of_a_run_takes_every_test_row(run, table, spark, monkeypatch):
    many = table.crossJoin(spark.range(12).withColumnRenamed("id", "k")).withColumn("codigo_ipress", F.concat_ws("-", "codigo_ipress", "k")).drop("k")
    told, metrics = [], learning.classification_metrics
    monkeypatch.setattr(learning, "classification_metrics", lambda counts: told.extend(counts.groupBy("modelo").agg(F.sum("n").alias("n")).collect()) or metrics(counts))
    got = learning.importance(run.models["Regresion_Logistica", "temporal"], many).collect()
    assert {r.variable for r in got} == set(S.PREDICTORS)
    assert len(told) == 5 * len(S.PREDICTORS) + 1 and {r.n for r in told} == {many.count()} and many.count() > 5000


def test_a_deal_gives_each_value_once():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (300, 2)).astype(float)
    y = x[:, 0].astype(int)
    block = pa.table({"vez": np.zeros(300, int), "h": rng.permutation(300), "y": y, "x": list(x)})
    cells = learning._permuted({"a": np.array([0]), "b": np.array([1])}, lambda x: x[:, :1] == np.arange(3))(block).to_pylist()
    by = {m: {(c["y"], c["yhat"]): c["n"] for c in cells if c["modelo"] == m} for m in ("", "a|0", "b|0")}
    assert by[""] == by["b|0"] == {(k, k): int((y == k).sum()) for k in range(3)}  # b decides nothing
    assert [sum(n for (_, p), n in by["a|0"].items() if p == k) for k in range(3)] == np.bincount(y).tolist() and len(by["a|0"]) == 9


def test_importance_covers_every_predictor(run):
    assert {r.variable for r in run.importance.collect()} == set(S.PREDICTORS)


def test_target_checks(table, spark):
    evaluation.check_targets(table)
    with pytest.raises(ValueError):
        evaluation.check_targets(table.where(F.col(evaluation.TARGET) < 2))
    with pytest.raises(ValueError):
        evaluation.check_targets(spark.createDataFrame([(0,), (0,), (1,), (1,), (2,)], f"{evaluation.TARGET} int"))


def test_asked_year(table):
    last = rollup.complete_years(table).agg(F.max("anio_objetivo")).first()[0]
    assert rollup.choose_test_year(table, last)[0] == last
    with pytest.raises(ValueError):
        rollup.choose_test_year(table, 1800)
    with pytest.raises(ValueError):
        rollup.choose_test_year(table.where("mes = 1"))


def test_history_of_another_series_is_a_violation(spark):
    schema = "codigo_ipress string, servicio_hospitalizacion string, anio int, mes int"
    now = spark.createDataFrame([("A", "S", 2024, 6)], schema)
    past = spark.createDataFrame([("A", "S", 2024, 5), ("B", "S", 2024, 5), ("B", "S", 2024, 4)], schema)
    assert [tuple(r) for r in temporal.history_violations(now, past).collect()] == [("B", "S", "ajena")]


def test_only_files_with_quoted_line_breaks_are_read_whole(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"a ""b"" c"\n')
    (tmp_path / "b.csv").write_text('x,y\n1,"a\nb"\n')
    assert {r.archivo: r.con_saltos for r in delimited.dialects(spark, str(tmp_path)).collect()} == {"a.csv": False, "b.csv": True}
    assert delimited.scan_csv(spark, str(tmp_path / "a.csv")).first().y == 'a "b" c'
    assert delimited.scan_csv(spark, str(tmp_path / "b.csv")).first().y == "a\nb"


def scores(model, rows):
    at = [*S.SERIES, "anio", "mes"]
    return {tuple(r[c] for c in at): (r.p0, r.p1, r.p2, r.yhat) for r in model.transform(rows).select(*at, "p0", "p1", "p2", "yhat").collect()}


@pytest.mark.parametrize("name", NAMES)
def test_stored_models_score_the_same_in_a_new_session(run, table, spark, tmp_path, name):
    model = run.models[name, "temporal"]
    model.save(str(tmp_path / "m"))
    loaded = learning.load_model(spark.newSession(), str(tmp_path / "m"))
    assert loaded.name == name and scores(loaded, table) == scores(model, table)


def test_training_run_is_stored_with_what_it_found(run, table, spark, tmp_path):
    run.save(table, str(tmp_path / "r"))
    told = learning.read_model_metadata(spark, str(tmp_path / "r")).first()
    assert told.mejor_modelo == run.final.name == learning.load_model(spark, str(tmp_path / "r")).name
    assert told.registros == table.count() and told.anio_prueba == run.year and set(told.columnas_predictoras) == set(S.PREDICTORS)
    assert {(m.modelo, m.evaluacion) for m in told.metricas} == {(n, k) for n in NAMES for k in ("temporal", "aleatorio")}
    leading = [r.variable for r in run.importance.orderBy(F.col("importancia").desc(), "variable").limit(10).collect()]
    assert list(told.variables) == leading and told.mejor.f1_macro == run.selection.first().f1_modelo
    assert delimited.read_report(spark, str(tmp_path / "r" / "reports"), "metricas", run.metrics.schema).count() == 6


def boosted(table, **changes):
    ready = learning.prepare(table)
    return ready, boosting.BoostedTrees(**({"label": evaluation.TARGET, "weight": "peso", "groups": ready.groups, "depth": 3, "rounds": 8} | changes))


@pytest.mark.parametrize("block_rows", [32_768, 300])
def test_boosting_lowers_the_loss_each_round(table, block_rows):
    ready, trees = boosted(table, block_rows=block_rows, renew=3, rounds=6 if block_rows < 1000 else 8)
    model = trees.fit(ready.rows)
    assert all(b < a for a, b in zip(model.history, model.history[1:])) and abs(model.history[0] - math.log(3)) < 1e-12
    p = model.transform(ready.rows).select(vector_to_array("probability").alias("p"), "prediction").collect()
    assert all(abs(sum(r.p) - 1) < 1e-12 and r.prediction == r.p.index(max(r.p)) for r in p)
    importance = model.featureImportances
    assert abs(sum(importance) - 1) < 1e-9 and len(importance) == ready.rows.first().features.size


def test_blocks_and_a_single_block_grow_the_same_trees(table):
    """With ids that do not depend on the blocks, where rows are sampled by id."""
    ready, trees = boosted(table, rounds=3, rows=1.0)
    one = trees.fit(ready.rows)
    trees.block_rows = 500
    many = trees.fit(ready.rows)
    assert one._parts()[2]["cuts"] == many._parts()[2]["cuts"]
    assert [t["col"] for t in one._parts()[2]["rounds"]] == [t["col"] for t in many._parts()[2]["rounds"]]
    assert max(abs(a - b) for a, b in zip(one.history, many.history)) < 1e-9


def test_boosting_is_as_good_as_one_against_the_rest_within_sampling_error(table):
    """On the test year, with as many rounds of the same step and depth. Some 300 test rows tell no smaller difference than two
    standard errors, so this only guards against a model that is clearly worse; README has the figures of larger tables."""
    train, test = evaluation.temporal_split(table, rollup.choose_test_year(table)[0])
    ready, trees = boosted(train, rounds=10, step=0.15)
    rows = PipelineModel(ready.stages).transform(test).select("features", evaluation.TARGET)
    gbt = GBTClassifier(maxIter=10, maxDepth=3, stepSize=0.15, seed=42, subsamplingRate=0.8, featureSubsetStrategy="0.8")
    rest = OneVsRest(classifier=gbt, featuresCol="features", labelCol=evaluation.TARGET, weightCol="peso", parallelism=3)

    def f1(model):
        counts = model.transform(rows).select(F.lit("m").alias("modelo"), F.col(evaluation.TARGET).alias("y"), F.col("prediction").cast("int").alias("yhat"))
        return evaluation.classification_metrics(evaluation.confusion_counts(counts)).first().f1_macro

    assert f1(trees.fit(ready.rows)) >= f1(rest.fit(ready.rows)) - 2 * math.sqrt(0.25 / rows.count())


def test_best_split_of_a_node_equals_brute_force():
    from aforo.operators.forest import best_splits

    random, sums = np.random.default_rng(3), np.zeros((3, 4, 6, 3))
    for node in range(4):
        y = random.integers(0, 3, 40) if node < 3 else np.full(40, 1)  # the last node has one class
        for j in range(3):
            np.add.at(sums[j, node], (random.integers(0, 6, 40), y), 0.5)
    columns = np.array([[5, 9, 2]] * 4)
    gini = lambda x: x.sum() * (1 - ((x / x.sum()) ** 2).sum()) if x.sum() else 0.0
    col, cut, gain, below = best_splits(sums, columns)
    for node in range(4):
        whole = sums[0, node].sum(axis=0)
        all_gains = {(j, b): gini(whole) - gini(sums[j, node, : b + 1].sum(axis=0)) - gini(whole - sums[j, node, : b + 1].sum(axis=0)) for j in range(3) for b in range(6)}
        best = max(all_gains.values())
        if best < 1e-9:
            assert col[node] == -1
            continue
        at = (columns[node].tolist().index(col[node]), int(cut[node]))
        assert all_gains[at] == pytest.approx(best) and gain[node] == pytest.approx(best)
        assert np.allclose(below[node, 1], sums[at[0], node, : at[1] + 1].sum(axis=0)) and np.allclose(below[node, 1] + below[node, 2], whole)


def test_forest_passes_of_any_size_grow_the_same_trees(table):
    from aforo.operators.forest import RandomForest

    ready = learning.prepare(table)
    grow = lambda **more: RandomForest(trees=5, depth=4, label=learning.TARGET, weight="peso", flags=sum(ready.groups), **more).fit(ready.rows)
    one, many = grow(), grow(room=1)
    assert all(np.array_equal(x, y) for a, b in zip(one.trees(), many.trees()) for x, y in zip(a, b))
    assert sum(one.featureImportances.toArray()) == pytest.approx(1.0)
    rows = one.transform(ready.rows).select(F.col(learning.TARGET).alias("y"), "prediction").collect()
    assert sum(r.y == r.prediction for r in rows) > 0.5 * len(rows)


def test_boosting_adds_up_a_task_s_blocks_before_it_sends():
    columns, random = boosting.Columns([], [[0.0, 1.0], [0.5]]), np.random.default_rng(1)
    of = boosting.BoostedTrees(rounds=1, depth=1, classes=3, rows=1.0)
    block = lambda k: {"block": k, "n": 50, "codes": random.integers(0, 2, (50, 2)).astype(np.uint8).tobytes(), "y": random.integers(0, 3, 50).astype(np.int32).tobytes(), "w": np.ones(50).tobytes(), "ids": np.arange(50, dtype=np.uint64).tobytes(), "margins": np.zeros((50, 3)).tobytes()}
    blocks, level = [block(1), block(2)], boosting._summing(columns, of, boosting.empty_trees(3, 1), 0, 0, [], "adds")
    together, (one, other) = dict(level(iter(blocks))), [dict(level(iter([b]))) for b in blocks]
    assert set(together) == {(0, 0), (1, 0), (2, 0)}
    assert all(np.allclose(together[k][0], one[k][0] + other[k][0]) and together[k][2] == 100 for k in together)


def test_logistic_regression_reaches_the_optimum_in_few_passes(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(600, 3)), rng.integers(0, 2, (600, 2))], axis=1)
    y = (x @ rng.normal(size=(5, 3)) + rng.gumbel(size=(600, 3))).argmax(axis=1)
    rows = [(r.tolist(), int(c), float(w)) for r, c, w in zip(x, y, rng.uniform(0.5, 2, 600))]
    df = spark.createDataFrame(rows, "x array<double>, label int, w double").repartition(3).select(array_to_vector("x").alias("features"), "label", "w")
    fit = logistic.Logistic(penalty=1 / 600, weight="w")
    model = fit.fit(df)
    other = LogisticRegression(maxIter=2000, tol=1e-12, family="multinomial", regParam=1 / 600, standardization=False, weightCol="w").fit(df)
    assert fit.passes <= 12
    assert np.abs(model.coefficients - np.c_[other.coefficientMatrix.toArray(), other.interceptVector.toArray()]).max() < 1e-3
    p = lambda m: np.array([r.p for r in m.transform(df).orderBy("w").select(vector_to_array("probability").alias("p")).collect()])
    assert np.abs(p(model) - p(other)).max() < 1e-3
    PipelineModel(stages=[model]).write().save(str(tmp_path / "m"))
    assert (p(PipelineModel.load(str(tmp_path / "m"))) == p(model)).all()
    with pytest.raises(ValueError):
        fit.fit(df.where("w < 0"))
