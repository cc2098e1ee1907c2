"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length. What a source's budget leaves beside whole copies is met by bounded-knapsack
dynamic programming over the counts of its lengths; documents of a length are then chosen by a seeded hash."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, only, table

SPACE = r"[ \t-\r]+"
_BUCKETS = 1024
_FEW = 100_000


def word_count(text):
    """Number of runs without white space; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, size) rows.

    Sources by code point, null last, weigh as the weights repeat. Targets share `share` times all sizes by weight; one
    that exceeds `most` times its source stops there and its excess is shared anew by weight. In closed form: with the
    sources in order of cap / weight, those before the first whose cap is above its share of what is then left are full.
    The windows here run over one row a source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    w = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    w = w.withColumn("level", (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    w = w.withColumn("level", F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(whole)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return w.select("source", "source_size", "n_docs", target.alias("target"))


def fit_budget(lengths: list[int], counts: list[int], budget: int, window: int = 65_536) -> list[int]:
    """How many documents of each length to take so that the words come as near to the budget, from below, as found.

    First each length gives its share, so the selection keeps the source's lengths. Long ones then fill up, or short ones
    give back, to about `window` words below the budget. That rest is solved exactly: reachable sums as the bits of an
    integer, each count split into powers of two."""
    total = sum(a * b for a, b in zip(lengths, counts))
    budget = min(budget, total)
    if budget <= 0:
        return [0] * len(lengths)
    taken = [c * budget // total if n else 0 for n, c in zip(lengths, counts)]
    rest = budget - sum(a * b for a, b in zip(lengths, taken))
    order = sorted((i for i, n in enumerate(lengths) if n > 0), key=lambda i: -lengths[i])
    for i in order:
        more = min(counts[i] - taken[i], max(0, rest - window) // lengths[i])
        taken[i] += more
        rest -= more * lengths[i]
    for i in reversed(order):  # short ones give back, so that the exact part has them to choose from
        back = min(taken[i], max(0, window - rest) // lengths[i])
        taken[i] -= back
        rest += back * lengths[i]
    reach, mask, steps = 1, (1 << rest + 1) - 1, []
    for i in order:
        left, k = min(counts[i] - taken[i], rest // lengths[i]), 1
        while left > 0 and not reach >> rest & 1:
            k = min(k, left)
            steps.append((reach, i, k))
            reach |= reach << k * lengths[i] & mask
            left, k = left - k, k * 2
    at = reach.bit_length() - 1
    for had, i, k in reversed(steps):
        if not had >> at & 1:
            taken[i] += k
            at -= k * lengths[i]
    return taken


_PLAN = T.StructType([T.StructField("source", T.StringType()), T.StructField("size", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("chosen", T.LongType())])


def _order(key: Column, seed: int) -> tuple[Column, Column]:
    """(hash by which documents of a length are chosen, the bucket of it that they are ranked in)."""
    h = F.xxhash64(F.lit(seed), key)
    return h, F.pmod(h, F.lit(_BUCKETS))


def _planned(sizes: DataFrame, weights: Sequence[float], share: float, most: float, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes with h and bucket, the sources' targets, the rules). A rule (source, size, copies, bucket, rest): documents of a source and
    size are taken `copies` times, those in buckets before `bucket` and the first `rest` in it once more."""
    h, bucket = _order(F.col("doc_id"), seed)
    docs = sizes.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"))
    docs = materialize(docs.withColumns({"h": h, "bucket": bucket}), "mix-sizes")
    targets = materialize(source_targets(docs, weights, share, most).coalesce(1), "mix-targets")
    counted = docs.groupBy("source", "size").count()
    known = _small(targets)
    lengths = counted.alias("c").join(known.alias("t"), F.expr("c.source <=> t.source")).select("c.source", "c.size", "c.count", "t.source_size", "t.target")

    def fit(batch: pa.Table) -> pa.Table:
        rows = sorted(zip(*(c.to_pylist() for c in batch.select(["size", "count"]).columns)))
        source, size, target = (batch.column(n)[0].as_py() for n in ("source", "source_size", "target"))
        copies = int(target // size) if size else 0
        taken = fit_budget([n for n, _ in rows], [c for _, c in rows], round(target - copies * size))
        return pa.table({"source": pa.array([source] * len(rows), pa.string()), "size": [n for n, _ in rows], "copies": [copies] * len(rows), "chosen": taken})

    plan = materialize(lengths.groupBy("source").applyInArrow(fit, _PLAN), "mix-plan")
    # the bucket of a length's hash order in which its last chosen document lies, and how many that bucket gives
    per = docs.groupBy("source", "size", "bucket").count()
    upto = F.sum("count").over(Window.partitionBy("source", "size").orderBy("bucket"))
    cuts = per.withColumn("before", upto - F.col("count")).alias("b").join(plan.where("chosen > 0").alias("p"), F.expr("b.source <=> p.source and b.size = p.size")).where("b.before < p.chosen").groupBy("p.source", "p.size").agg(F.max(F.struct("b.bucket", F.expr("p.chosen - b.before").alias("rest"))).alias("cut"))
    rules = materialize(plan.alias("p").join(cuts.alias("c"), F.expr("c.source <=> p.source and c.size = p.size"), "left").select("p.source", "p.size", "p.copies", "c.cut.bucket", "c.cut.rest"), "mix-rules")
    return docs, known, rules


def mix(sizes: DataFrame, *, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of (doc_id, source, size).

    taken is size times the copies the mix has of the document; none exceeds ceil(most). A null source is a source of
    its own, after the others; a null size counts as 0; empty documents are never needed, so take nothing unless their
    source is copied whole (0 words either way). Rows with an equal doc_id are mixed one by one. An empty table gives
    an empty mix. A task gets the counts of one source's lengths, at most sqrt(2 x its words) of them, never its
    documents; ranking within a length runs over 1/1024 of its documents at a time."""
    docs, known, rules = _planned(sizes, weights, share, most, seed)
    ranked = docs.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h", "doc_id")))
    extra = F.when(F.col("d.bucket") < F.col("r.bucket"), 1).when((F.col("d.bucket") == F.col("r.bucket")) & (F.col("d.rank") <= F.col("r.rest")), 1).otherwise(0)
    mixed = ranked.alias("d").join(rules.alias("r"), F.expr("d.source <=> r.source and d.size = r.size")).select("d.doc_id", "d.source", "d.size", ((F.col("r.copies") + extra) * F.col("d.size")).alias("taken"))
    return mixed.alias("m").join(known.alias("t"), F.expr("m.source <=> t.source")).select("m.doc_id", "m.source", "m.size", "t.source_size", "t.target", "m.taken")


def mixed_copies(df: DataFrame, *, key: str, size: str, source: str = "source", copies: str = "copies", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """df with a column of how often mix takes each row, 0 for rows without words, by (key, source, size) as its (doc_id, source, size).

    Rows look their copies up in the rules and, for one bucket of 1/1024 of a length, in the list of those taken once more, so whole
    documents need not be shuffled. Rows that share a key take what mix takes of all of them; of such as that bucket takes only
    in part, one row stands for all."""
    docs, _, rules = _planned(df.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(size).alias("size")), weights, share, most, seed)
    same = "d.source <=> r.source and d.size = r.size"
    last = docs.alias("d").join(rules.alias("r"), F.expr(f"{same} and d.bucket = r.bucket")).select("d.*", "r.rest")
    last = last.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h", "doc_id")))
    more = last.groupBy("doc_id", "source", "size").agg(F.count_if(F.col("rank") <= F.col("rest")).alias("more"), F.count("*").alias("n"))
    more = materialize(more.where("more > 0"), "mix-more")
    k, s, n = F.col(f"d.{key}"), F.col(f"d.{source}").cast("string"), F.coalesce(F.col(f"d.{size}").cast("long"), F.lit(0))
    like = lambda t: s.eqNullSafe(F.col(f"{t}.source")) & (n == F.col(f"{t}.size"))
    found = df.alias("d").join(_small(rules).alias("r"), like("r")).join(_small(more).alias("m"), k.eqNullSafe(F.col("m.doc_id")) & like("m"), "left")
    extra = F.when(_order(k, seed)[1] < F.col("r.bucket"), 1).when(F.col("m.more").isNotNull(), 1).otherwise(0)
    taken = F.when(n > 0, F.col("r.copies") + extra).otherwise(0).cast("long").alias(copies)
    partly = F.col("m.more") < F.col("m.n")
    each = found.where(F.coalesce(~partly, F.lit(True))).select("d.*", taken)
    if more.where("more < n").isEmpty():
        return each
    together = F.when(n > 0, F.col("m.n") * F.col("r.copies") + F.col("m.more")).otherwise(0).cast("long").alias(copies)
    return each.unionByName(found.where(partly).select("d.*", together).dropDuplicates([key, source, size]))


def _small(table: DataFrame) -> DataFrame:
    """With a broadcast hint while it has at most 100,000 rows."""
    return F.broadcast(table) if table.count() <= _FEW else table


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix of all `documents` with the default weights 5, 2, 1, sizes in words."""
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    return mix(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))).select("doc_id", "size", "source_size", "target", "taken", "source")
