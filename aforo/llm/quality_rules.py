"""Quality rules learned as a decision list, in DataFrame operations alone.

Sequential covering: a rule for bad documents grows, condition by condition, on two thirds of the labelled rows, is pruned
on the rest, and the rows it covers are set aside before the next one. Every count comes from a Spark aggregation over
(feature, threshold) cells; the driver sees these cells only. The list becomes one CASE WHEN expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, table

SPACE = r"[ \t-\r]+"
SYMBOLS = r"[^#*$%&|<>]+"
FEATURES = ("n_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "mark_ratio")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, fields: dict[str, Column] | None = None) -> Column:
        c = fields[self.feature] if fields else F.col(self.feature)
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered: int
    wrong: int

    def column(self, fields: dict[str, Column] | None = None) -> Column:
        out = self.conditions[0].column(fields)
        for c in self.conditions[1:]:
            out = out & c.column(fields)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def with_statistics(df: DataFrame, text: Column, name: str = "_stats") -> DataFrame:
    """df with a struct column of that name: the base counts and the ratios that rules test. df's columns may have any names.

    A null text is empty. Windows of three words are compared by a 64-bit hash within one text. Each array is a column of
    its own, so no lambda evaluates it again; sorting for repeated windows happens only where there are any."""
    keep = [F.col(f"c{i}") for i in range(len(df.columns))]  # under names that the steps below do not use
    t = F.coalesce(text, F.lit(""))
    d = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)], t.alias("_t"), F.array_remove(F.split(t, SPACE), "").alias("_w"), F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^ \t-\r]"))).alias("_l"))
    size = F.size("_w")
    hashes = F.when(size >= 3, F.transform(F.slice("_w", F.lit(1), size - 2), lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2))))
    d = d.select(*keep, "_t", size.alias("_n"), hashes.alias("_h"), F.size("_l").alias("_nl"), (F.size("_l") - F.size(F.array_distinct("_l"))).alias("_dl"))
    ordered = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    d = d.select(*keep, "_t", "_n", "_nl", "_dl", ordered.alias("_o"))
    twice = F.filter("_o", lambda s, i: (F.get("_o", i - 1)["x"].eqNullSafe(s["x"]) & (i > 0)) | F.get("_o", i + 1)["x"].eqNullSafe(s["x"]))
    d = d.select(*keep, "_t", "_n", "_nl", "_dl", F.sort_array(F.transform(twice, lambda s: s["i"])).alias("_s"))
    # windows cover three words; a later one adds what lies behind the one before
    covered = F.coalesce(F.aggregate(F.transform("_s", lambda a, i: F.when(i > 0, F.least(F.lit(3), a - F.get("_s", i - 1))).otherwise(3)), F.lit(0), lambda a, x: a + x), F.lit(0))
    count = lambda pattern: F.length(F.regexp_replace("_t", pattern, "")).cast("long")
    d = d.select(*keep, F.col("_n").cast("long").alias("_n"), F.col("_nl"), F.col("_dl").cast("long").alias("_dl"), covered.cast("long").alias("_r"), count(SPACE).alias("_c"), count(SYMBOLS).alias("_y"), count(r"[^\p{Lu}]+").alias("_u"), count(r"[^0-9]+").alias("_d"), count(r"[^!?]+").alias("_m"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    stats = {
        "n_words": F.col("_n"), "word_chars": F.col("_c"), "n_symbols": F.col("_y"), "n_dup_lines": F.col("_dl"), "n_repeat_words": F.col("_r"),
        "mean_word": ratio("_c", "_n"), "symbol_ratio": ratio("_y", "_n"), "dup_line_ratio": ratio("_dl", "_nl"), "repeat_ratio": ratio("_r", "_n"), "upper_ratio": ratio("_u", "_c"), "digit_ratio": ratio("_d", "_c"), "mark_ratio": ratio("_m", "_n"),
        "base_failed": (F.col("_n") < 50) | (100 * F.col("_r") > 50 * F.col("_n")),
    }
    # as a generator's output: a filter on it must not move down and evaluate the arrays above once more for each lambda step
    return d.select(*[k.alias(c) for k, c in zip(keep, df.columns)], F.explode(F.array(F.struct(*[v.alias(k) for k, v in stats.items()]))).alias(name))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """Statistics and label of at most max_rows labelled documents, those of the smallest hashes; the ids alone are
    broadcast, so that bound is its size. A document with several labels is bad if one of them says so."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_id")).agg((F.min("quality") == 0).alias("bad")).orderBy(F.xxhash64(F.lit(3), "_id"), "_id").limit(max_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = with_statistics(found.select("_id", "bad", "text"), F.col("text"))
    return rows.select("_id", "bad", F.col("_stats.base_failed").alias("base_failed"), *[F.col(f"_stats.{f}").cast("double").alias(f) for f in FEATURES])


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _cell(feature: str, thresholds: list[float]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t < F.col(feature)))


def learn(sample: DataFrame, *, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.95, min_covered: int = 5, quantiles: int = 20) -> list[Rule]:
    """The decision list for rows of (bad, features...). No bad or no good rows: an empty list."""
    steps = [i / quantiles for i in range(quantiles + 1)]
    cuts = sample.groupBy("bad").agg(*[F.percentile_approx(f, steps, 10_000).alias(f) for f in FEATURES]).collect()
    if {r.bad for r in cuts} != {True, False}:
        return []
    thresholds = {f: sorted({x for r in cuts for x in r[f]}) for f in FEATURES}
    # the cell of a value: how many of its feature's thresholds lie below it
    cell = {f: _cell(f, ts) for f, ts in thresholds.items()}
    rows = materialize(sample.select("bad", (F.pmod(F.xxhash64(F.lit(5), "_id"), F.lit(3)) < 2).alias("grow"), *FEATURES, F.array(*[F.struct(F.lit(k).alias("f"), cell[f].alias("b")) for k, f in enumerate(FEATURES)]).alias("cells")).coalesce(4), "quality-sample")
    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < max_rules:
        conditions: list[Condition] = []
        here = F.lit(True)
        while len(conditions) < max_conditions:
            counts = rows.where(left & here & F.col("grow")).select("bad", F.explode("cells").alias("c")).groupBy("c.f", "c.b", "bad").count().collect()
            p0 = sum(r["count"] for r in counts if r.f == 0 and r.bad)
            n0 = sum(r["count"] for r in counts if r.f == 0 and not r.bad)
            if not p0 or not n0:
                break
            splits = []
            for k, f in enumerate(FEATURES):
                cells = [[0, 0] for _ in range(len(thresholds[f]) + 1)]
                for r in counts:
                    if r.f == k:
                        cells[r.b][r.bad] += r["count"]
                n = p = 0
                for i, t in enumerate(thresholds[f]):
                    n, p = n + cells[i][0], p + cells[i][1]
                    splits += [(_gain(p, n, p0, n0), f, False, p, n, t), (_gain(p0 - p, n0 - n, p0, n0), f, True, p0 - p, n0 - n, t)]
            best = max(splits, key=lambda x: x[0])
            if best[0] <= 0:
                break
            same = [x[5] for x in splits if x[:5] == best[:5]]  # thresholds with no row between them: the middle of the gap
            conditions.append(Condition(best[1], best[2], (min(same) + max(same)) / 2))
            here = here & conditions[-1].column()
        if not conditions:
            break
        # prune: the prefix that does best on the other third
        sums = []
        prefix = F.lit(True)
        for k, c in enumerate(conditions):
            prefix = prefix & c.column()
            sums += [F.count_if(prefix & F.col("bad")).alias(f"p{k}"), F.count_if(prefix & ~F.col("bad")).alias(f"n{k}")]
        got = rows.where(left & ~F.col("grow")).agg(*sums).first()
        worth = [((got[f"p{k}"] - got[f"n{k}"]) / max(1, got[f"p{k}"] + got[f"n{k}"]), got[f"p{k}"], -k) for k in range(len(conditions))]
        k = -max(worth)[2]
        p, n = got[f"p{k}"], got[f"n{k}"]
        if p + n < min_covered or p < min_precision * (p + n):
            break
        rules.append(Rule(tuple(conditions[: k + 1]), p + n, n))
        left = left & ~rules[-1].column()
    return rules


def judged(docs: DataFrame, labels: DataFrame, *, name: str = "_stats", max_rows: int = 20_000, min_precision: float = 0.95) -> DataFrame:
    """docs with a struct column of that name, whose field `kept` is false where the text fails the base test or a learned rule holds.

    Learned from at most max_rows labelled rows that pass the base test; without labels of both kinds there are no
    rules. A null text is empty and fails; rows that repeat a doc_id are judged each by its own text; other columns of docs
    stay as they are; an empty table gives no rows."""
    sample = materialize(labelled_sample(docs, labels, max_rows), "quality-labelled")
    rules = learn(sample.where("not base_failed").drop("base_failed"), min_precision=min_precision)
    rated = with_statistics(docs, F.col("text"), name)
    # the rules read the struct's fields by their own names
    fields = {f: F.col(f"`{name}`.{f}") for f in (*FEATURES, "base_failed")}
    return rated.withColumn(name, F.col(f"`{name}`").withField("kept", verdict(rules, fields)))


def verdict(rules: list[Rule], fields: dict[str, Column]) -> Column:
    """kept: the base test or the first rule that holds rejects, else the document stays."""
    out = F.when(fields["base_failed"], False)
    for r in rules:
        out = out.when(r.column(fields), False)
    return out.otherwise(True)


def keep_good(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    (name,) = fresh(docs, "_stats")
    return judged(docs, labels, name=name, **parameters).where(F.col(f"`{name}`.kept")).drop(name)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts and the verdict of `judged` for every row of `documents`, learned from `labels`."""
    rated = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", *[F.col(f"_stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])
