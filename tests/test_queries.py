"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from aforo.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
FAST = ["indicators", "risk_current", "future_target", "temporal_features", "clean_numeric", "validation_summary", "gap_score", "risk_factors", "classification_metrics", "duplicate_periods", "scan_csv", "scan_csv_dir", "scan_template", "header_template", "history_violations", "metric_files", "dataset_csv", "metadata_json",
        "stage_counts", "roc_auc_scores", "upload_errors", "pruned_split", "stored_upsert", "score_with_history", "detect_format", "interpretation_text"]


def normal(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, SF).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_registered_models_are_those_of_the_reference(spark, monkeypatch):
    class Rows:
        def where(self, _):
            return self

        def withColumn(self, *_):
            return self

    class Model:
        def save(self, _):
            pass

    fitted = []
    monkeypatch.setattr(catalog, "_split", lambda spark, sf_dir: Rows())
    monkeypatch.setattr(catalog.learning, "fit", lambda train, name, **parameters: fitted.append(catalog.learning.classifiers(**parameters)[name]) or Model())
    for f in ("evaluated", "feature_importance", "score", "load_model"):
        monkeypatch.setattr(catalog.learning, f, lambda *_: None)
    for name in ("train_logistic", "train_forest", "train_boosted", "feature_importance", "score"):
        catalog.queries()[name](spark, SF)
    logistic, forest, boosted, *others = fitted
    assert logistic.getMaxIter() == 2000
    assert all((m.getNumTrees(), m.getMaxDepth()) == (300, 12) for m in (forest, *others))
    assert (boosted.rounds, boosted.depth, boosted.step, boosted.rows, boosted.columns) == (300, 5, 0.05, 0.8, 0.8)
