"""A corpus from raw documents to token files, each stage by one of the training-data operators.

Every stage works on all rows that the one before kept; all but the last return the columns of documents, whatever others
there are and whatever they are named. Rows are told apart by doc_id and text, so a repeated or null doc_id does not let one row's fate
decide another's. A null text has no words; an empty table gives an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aforo.llm.common import drop_steps, fresh, materialize, only, recorded, scratch_path, table, text_hash
from aforo.llm.decontamination import contamination
from aforo.llm.mixing import mixed_copies, word_count
from aforo.llm.near_dedup import keep_one
from aforo.llm.quality_rules import keep_good
from aforo.llm.token_files import read_token_files, write_token_files


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test or a rule learned from `labels` rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that with the smallest doc_id."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item, or a whole shorter item, go."""
    (key,) = fresh(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", text_hash("text")))
    with recorded() as steps:
        found = contamination(keyed.select(F.col(key).alias("doc_id"), "text"), only(table(spark, sf_dir, "benchmark"), "item_id", "text"), span=0)
    hit = materialize(found.where("contaminated").select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    drop_steps(steps)
    return keyed.join(hit, key, "left_anti").select(*_columns(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: a row a copy, none for those it leaves out. Rows with equal doc_id, source
    and text are mixed each; where only some of them are taken once more, one stands for all, as often as they are taken together."""
    key, size, copies, nr = fresh(docs, "row_key", "n_words", "copies", "copy_nr")
    keyed = docs.withColumns({key: F.xxhash64("doc_id", "source", text_hash("text")), size: word_count(F.col("text"))})
    rows = mixed_copies(keyed, key=key, size=size, copies=copies).where(F.col(copies) > 0)
    return rows.select(*_columns(docs), F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias(nr)).drop(nr)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix in doc_id order, and from them a row a document."""
    return read_token_files(write_token_files(only(docs, "doc_id", "text"), scratch_path(spark, "corpus-tokens")))


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixing", mixing), ("token_files", token_files)]

#: The rules are learned, near duplicates found by iteration and the mix by dynamic programming: SQL expresses none of them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; of what they write only the last stage's files stay."""
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with recorded() as steps:
            kept = stage(spark, docs, sf_dir)
        with recorded() as written:
            docs = materialize(kept, f"stage-{name}")
        drop_steps(last + steps)
        last = written
    found = STAGES[-1][1](spark, docs, sf_dir)
    drop_steps(last)
    return found
