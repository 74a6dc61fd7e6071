"""From ``documents`` to training sequences: drop toxic documents, drop those
that fail the quality rules, keep one document of each group of near
duplicates, pack the rest.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes it
to a table in the shared checkpoint folder and gives that table to the next
stage, so a lost executor repeats a stage's tasks at most.  All stages but the
last return the columns of ``documents``; they judge documents by their text,
whatever the id: rows are matched by a key of their own, so null and repeated
ids are kept apart.

Defined results: a null text counts as empty (the quality rules reject it);
labels are used to fit models only; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import packing, quality, simhash, toxicity
from tillroll.session import materialize
from tillroll.sources.tables import read_table


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit_toxicity(docs, _labels(spark, sf_dir)))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit_quality(docs, _labels(spark, sf_dir)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_digests(docs)


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_low_quality),
          ("simhash near-dedup", drop_near_duplicates), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Classifiers, XXH64 and a tokenizer aren't expressible in SQL.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
