"""Percentiles, areas, counts, row numbers, splits, checks and stored tables that no single task holds whole."""

import glob
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aforo.operators import evaluation, quality, risk, rollup, temporal
from aforo.operators.headers import D1, INTERNAL, UNKNOWN, detect_format, format_of
from aforo.plans import catalog, panel
from aforo.sources import delimited

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def percentiles(spark, values, shares=(0.0, 0.25, 0.5, 0.75, 0.999, 1.0)):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    return rollup.exact_percentiles(df, F.col("v"), shares).first()


@pytest.mark.parametrize("seed", range(3))
def test_percentiles_equal_interpolation(spark, seed):
    rng = np.random.default_rng(seed)
    values = [*rng.standard_normal(300), *(10.0 ** rng.uniform(-300, 300, 200)), *(-(10.0 ** rng.uniform(-300, 300, 100))), *[0.75] * 150, 0.0, -0.0, 5e-324, -5e-324, 1.7e308]
    got = percentiles(spark, [float(v) for v in values])
    want = np.quantile(np.array(values), [0.0, 0.25, 0.5, 0.75, 0.999, 1.0])
    assert got.n == len(values) and np.allclose(got.p, want, rtol=1e-12, atol=0)


def test_percentiles_of_a_narrow_range(spark):
    n = 1_000_000
    df = spark.range(n).select((1000 + F.col("id") * 0.1 / n).alias("v"))
    got = rollup.exact_percentiles(df, F.col("v"), (0.5, 0.75)).first()
    assert np.allclose(got.p, np.quantile(1000 + np.arange(n) * 0.1 / n, [0.5, 0.75]), rtol=0, atol=1e-12)


def test_percentiles_of_none_and_by_group(spark):
    assert tuple(percentiles(spark, [])) == (0, [])
    assert tuple(percentiles(spark, [None])) == (0, [])
    rows = [(g, float(v)) for g in "abc" for v in range(ord(g))] + [("d", None), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.n, r.p) for r in rollup.exact_percentiles(df, F.col("v"), (0.25, 0.5), "g").collect() if r.g is not None}
    assert got == {g: (ord(g), [(ord(g) - 1) * 0.25, (ord(g) - 1) * 0.5]) for g in "abc"}


def test_area_equals_pairwise_comparison(spark):
    rng = random.Random(4)
    rows = [(m, rng.randrange(3), *[round(rng.random(), 2) for _ in range(3)]) for m in ("x", "y") for _ in range(300)]
    got = {r.modelo: r.roc_auc_ovr_macro for r in evaluation.roc_auc_ovr(spark.createDataFrame(rows, "modelo string, y int, p0 double, p1 double, p2 double")).collect()}
    for m in ("x", "y"):
        areas = []
        for c in range(3):
            pos, neg = ([r[2 + c] for r in rows if r[0] == m and (r[1] == c) == want] for want in (True, False))
            areas.append(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
        assert abs(got[m] - sum(areas) / 3) < 1e-12


def test_area_ranks_within_ranges_only(spark):
    df = evaluation.roc_auc_ovr(spark.createDataFrame([("x", 0, 0.1, 0.2, 0.7)], "modelo string, y int, p0 double, p1 double, p2 double"))
    windows = [x for x in plan(df).split("Physical Plan")[-1].splitlines() if "Window [" in x]
    assert windows and all("tramo" in x for x in windows)


def test_stages_are_counted_in_one_run(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    got = rollup.stage_counts(spark.read.parquet(str(tmp_path / "t")), "a", b=lambda d: d.where("id % 2 = 0"), c=lambda d: d.groupBy((F.col("id") % 7).alias("k")).count())
    assert [tuple(r) for r in got.collect()] == [("a", 100), ("b", 50), ("c", 7)]
    assert "parquet" not in plan(got).lower()  # nothing is read again


def test_rows_of_an_upload_are_numbered_by_record(spark, tmp_path):
    lines = [f'{k},"a{chr(10)}b",x' if k % 10 == 0 else f"{k},c,x" for k in range(200)]
    (tmp_path / "one.csv").write_text("n,t,u\n" + "\n".join(lines) + "\n")
    (tmp_path / "two.csv").write_text("n,t,u\n" + "\n".join(f"{k},c,y" for k in range(50)) + "\n")
    got = delimited.numbered(delimited.scan_csv(spark, str(tmp_path), tag=True)).collect()
    assert {(r.ARCHIVO_ORIGEN, int(r.n), r.fila) for r in got} == {("one.csv", k, k + 2) for k in range(200)} | {("two.csv", k, k + 2) for k in range(50)}


def test_row_numbers_over_many_splits(spark, tmp_path):
    (tmp_path / "big.csv").write_text("n,t\n" + "".join(f"{k},{'v' * (k % 13)}\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        df = delimited.scan_csv(spark, str(tmp_path / "big.csv"))
        assert df.rdd.getNumPartitions() > 4
        assert all(int(r.n) + 2 == r.fila for r in delimited.numbered(df).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_errors_of_an_upload_name_the_row(spark, tmp_path):
    header = "codigo_renipress,anio,mes,servicio_hospitalario,ingresos,egresos,estancias,pacientes_cama,camas_totales,camas_disponibles_habilitadas"
    good = "00006207,2026,3,Medicina,80,75,350,704,100,715"
    (tmp_path / "t.csv").write_text("\n".join([header, good, good.replace("80", ""), good.replace("2026", "1800")]) + "\n")
    df, _ = delimited.scan_template(spark, str(tmp_path / "t.csv"))
    assert {(r.fila, r.campo) for r in quality.required_errors(df).union(quality.period_errors(df)).collect()} == {(3, "total_ingresos"), (4, "anio")}
    assert {r.fila for r in quality.duplicate_rows(df).collect()} == {2, 3}


def test_split_of_a_stored_dataset_reads_two_years(spark, tmp_path):
    rows = [(f"s{s}", y, m, f"{y + m // 12}-{m % 12 + 1:02d}") for s in range(3) for y in range(2010, 2020) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "s string, anio int, mes int, periodo_predicho string")
    delimited.write_dataset(df, str(tmp_path / "d"))
    stored = delimited.scan_dataset(spark, str(tmp_path / "d"), schema=df.schema)
    train, test = evaluation.temporal_split(stored, 2015)
    key = lambda d: sorted(map(tuple, d.select("s", "anio", "mes").collect()))
    assert key(test) == sorted(r[:3] for r in rows if r[3][:4] == "2015") and key(train) == sorted(r[:3] for r in rows if r[3] < "2015")
    for part, low, high in ((test, 2014, 2015), (train, 0, 2014)):
        filters = plan(part).split("PartitionFilters: [")[1].split("], PushedFilters")[0]
        assert "anio" in filters and ("2015" in filters)
        years = {int(f.split("anio=")[1].split("/")[0]) for f in part.select(F.input_file_name().alias("f")).toPandas().f}
        assert all(low <= y <= high for y in years)


def indicator_rows(spark, months, pressure=0.5):
    rows = [("A", "S", 2020, m, 0.5, 0.5, pressure, 1.0, 1.0, 1.0) for m in months]
    return spark.createDataFrame(rows, "codigo_ipress string, servicio_hospitalizacion string, anio int, mes int, ocupacion_estimada double, ratio_camas_disponibles double, presion_ingresos_camas double, total_ingresos double, total_egresos double, total_estancias double")


def test_a_strict_build_fails_within_its_plan(spark):
    build = lambda df, strict: temporal.with_future_target(temporal.with_temporal(risk.with_current_risk(df, strict=strict)), strict=strict)
    assert build(indicator_rows(spark, [1, 2, 3]), True).count() == 2
    with pytest.raises(Exception, match="duplicados"):
        build(indicator_rows(spark, [1, 2, 2, 3]), True).collect()
    build(indicator_rows(spark, [1, 2, 2, 3]), False).collect()
    with pytest.raises(Exception, match="percentiles"):
        build(indicator_rows(spark, [1, 2, 3], None), True).collect()
    build(indicator_rows(spark, [1, 2, 3], None), False).collect()


def test_a_strict_build_has_one_exchange(spark):
    labelled = risk.with_current_risk(indicator_rows(spark, [1, 2, 3]), (0.1, 0.2), strict=True)
    physical = plan(temporal.with_future_target(temporal.with_temporal(labelled), strict=True)).split("Physical Plan")[-1]
    assert physical.count("Exchange hashpartitioning") == 1


def test_stored_predictions_rewrite_touched_folders_only(spark, tmp_path):
    path = str(tmp_path / "p")
    schema = "indicador_id string, fecha string, nivel string"
    rollup.store_predictions(spark.createDataFrame([(f"k{i}", "2020-01", "A") for i in range(100)], schema), path, buckets=8)
    names = lambda: {f: f.split("cubo=")[1].split("/")[0] for f in glob.glob(f"{path}/cubo=*/*.parquet")}
    before = names()
    rollup.store_predictions(spark.createDataFrame([("k1", "2020-02", "B"), ("k1", "2019-02", "C"), ("k2", "2019-01", "D")], schema), path, buckets=8)
    after = names()
    touched = {str(r.c) for r in spark.createDataFrame([("k1",), ("k2",)], "k string").select(F.pmod(F.xxhash64("k"), F.lit(8)).alias("c")).collect()}
    assert {f for f in before if before[f] not in touched} == {f for f in after if after[f] not in touched}
    assert not {f for f in before if before[f] in touched} & set(after)
    got = {r.indicador_id: (r.fecha, r.nivel) for r in rollup.read_predictions(spark, path).collect()}
    assert got == {f"k{i}": ("2020-01", "A") for i in range(100)} | {"k1": ("2020-02", "B")}


def test_many_requests_of_a_series(spark):
    p = panel.indicators(spark, SF)
    at = ["codigo_ipress", "servicio_hospitalizacion", "anio", "mes"]
    columns = [*at, "historial_completo", "promedio_movil_3m_ingresos", "tendencia_ocupacion_1m"]
    key = lambda d: sorted(map(tuple, d.select(*columns).collect()))
    asked = p.where("mes in (3, 4, 7)")
    want = temporal.with_history_flag(temporal.with_temporal(p)).where("mes in (3, 4, 7)")
    scored = temporal.score_rows(asked, p)
    assert key(scored) == key(want)
    assert "BroadcastNestedLoopJoin" not in plan(scored) and "CartesianProduct" not in plan(scored)


def test_requests_find_their_months_without_a_join(spark):
    kind = "codigo_ipress string, servicio_hospitalizacion string, anio int, mes int, ocupacion_estimada double, presion_ingresos_camas double, total_ingresos double, total_egresos double, total_estancias double"
    table = lambda months: spark.createDataFrame([("A", "S", 2024, m, 0.4, 0.2, 10.0 * m, 1.0, 1.0) for m in months], kind)
    scored = temporal.score_rows(table([1, 3, 3, 6, 8, 10]), table([1, 2, 4, 4, 5, 7, 7, 8]))
    text = plan(scored)
    got = sorted((r.mes, r.historial_completo, r.promedio_movil_3m_ingresos, r.tendencia_ingresos_1m) for r in scored.collect())
    assert got == [(1, False, 10.0, 0.0), (3, True, 20.0, 10.0), (3, True, 20.0, 10.0), (6, True, 50.0, 10.0), (8, False, 75.0, 10.0), (10, False, 100.0, 0.0)]
    assert "Join" not in text and "Generate" not in text and text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("header, sep", [("ANHO;MES", ";"), ("Código RENIPRESS", ",")])
def test_format_expression_agrees_with_the_function(spark, header, sep):
    from aforo import schema as S

    raw = sep.join([*S.RAW_REQUIRED[:-2], "dias cama  disponible", S.RAW_REQUIRED[-1]])
    template = sep.join(f'"{c.replace("_", " ").title()}"' for c in ["codigo_renipress", *S.TEMPLATE_REQUIRED[1:]])
    lines = [header, raw, template, ""]
    got = [r.f for r in spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, h string").orderBy("k").select(format_of(F.col("h"), F.lit(sep)).alias("f")).collect()]
    assert got == [detect_format(c.strip('" ') for c in x.split(sep)) for x in lines]
    assert got[2] == INTERNAL and got[1] in (D1, UNKNOWN)


def test_stages_compute_no_column_that_no_step_asks_for(spark):
    got = rollup.stage_counts(spark.range(10), "a", b=lambda d: d.withColumn("x", F.raise_error(F.lit("no"))), c=lambda d: d.where("id < 4"))
    assert [tuple(r) for r in got.collect()] == [("a", 10), ("b", 10), ("c", 4)]


def test_stage_counts_drops_copies_before_it_cleans_texts(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(rollup, "stage_counts", lambda source, first, **steps: seen.update(steps, source=source) or spark.createDataFrame([(first, 1)], "etapa string, registros long"))
    catalog.queries()["stage_counts"](spark, "/root/testdata/sf0.001")
    first = next(iter(seen.values()))(seen["source"])
    assert "regexp" not in plan(first).lower() and first.count() == seen["source"].distinct().count()
