"""The corpus pipeline on the smallest tables."""

import os
from collections import Counter

import corpus_pipeline as p
from aforo.llm import mixing

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_write_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in p.STAGES[:-1]:
        docs = p.materialize(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0
    last = p.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == docs.count()
    ordered = sorted(last, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted(r.doc_id for r in last)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:]))


def test_stages_on_nulls_repeats_clashing_names_and_empty_tables(spark):
    prose = [" ".join(f"w{(i * 37 + k * k) % 900}" for k in range(80)) for i in range(6)]
    rows = [(i, t, "s", 1, 2, 3) for i, t in enumerate(prose)] + [(0, prose[0], "s", 1, 2, 3), (0, prose[5], "s", 1, 2, 3), (None, prose[1], None, 1, 2, 3), (9, None, None, 1, 2, 3), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row_key int, copies int, _stats int")
    for name, stage in p.STAGES:
        got = stage(spark, docs, SF)
        if name != "token_files":
            assert got.columns == docs.columns
        n, found = got.count(), stage(spark, docs.limit(0), SF).count()
        assert found == 0
        assert {"quality": n == 9, "near_dedup": n == 9, "decontaminate": n == 11, "mixing": n >= 9, "token_files": n == 11}[name], (name, n)


def test_mixing_takes_what_mix_takes_and_shuffles_no_texts(spark):
    words = lambda n, k: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(i % 1900 if i < 1990 else None, words(i % 7, i % 1900), "abc"[i % 3] if i % 11 else None) for i in range(2000)] + [(5000 + i, words(3, 7), "a") for i in range(40)] + [(6000, words(20, 1), "b")] * 9
    rows += [(7000 + i, words(9 + i % 5, i), "b") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = p.F.xxhash64("doc_id", "source", p.text_hash("text"))
    taken = mixing.mix(docs.select(key.alias("doc_id"), "source", p.word_count(p.F.col("text")).alias("size"))).collect()
    wanted = Counter()
    for r in taken:
        wanted[r.doc_id] += r.taken // r.size if r.size else 0
    assert Counter(r.k for r in p.mixing(spark, docs, SF).select(key.alias("k")).collect()) == +wanted and len(+wanted) > 1000
    assert any(n < x < 2 * n for x, n in ((wanted[r.k], r.n) for r in docs.groupBy(key.alias("k")).agg(p.F.count("*").alias("n")).where("n > 1").collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = p.mixing(spark, docs.where("doc_id < 1000").dropDuplicates(["doc_id"]).coalesce(1).transform(lambda d: p.materialize(d, "unlike")), SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_steps_leave_only_what_the_result_reads(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr("aforo.llm.common.shared_dir", lambda _: f"file://{tmp_path}")
    p.near_dedup(spark, docs, SF)
    assert _labels(tmp_path) == ["near-dropped"]
    assert 0 < p.decontaminate(spark, docs, SF).count() < docs.count()
    assert _labels(tmp_path) == ["contaminated", "near-dropped"]
    result = p.run(spark, SF)
    assert [x for x in _labels(tmp_path) if x.startswith(("stage-", "near-", "mix-"))] == ["near-dropped"]  # that of the first call
    assert result.count() > 0


def _labels(folder) -> list[str]:
    return sorted(x.rsplit("-", 1)[0] for x in os.listdir(folder))
