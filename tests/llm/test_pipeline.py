"""corpus_pipeline.py: each stage's decisions take effect, rows and columns
stay, odd rows pass."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tillroll.session import materialize

from .test_texts import brute_fingerprint, brute_labels, corpus

import numpy as np


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labelled prose with copies, near copies, a null text, a null id."""
    base = str(tmp_path_factory.mktemp("sf"))
    docs, labels, truth = corpus(spark, 500)
    first = {r.doc_id: r.text for r in docs.filter("doc_id < 40").collect()}
    more = [(1000 + i, t) for i, t in first.items()] + [(2000, None), (None, first[1]), (None, first[2] + " tail"), (1, first[1])]
    whole = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string")).select(
        "doc_id", "text", F.lit("en").alias("lang"), F.lit("src").alias("source"), F.length("text").cast("long").alias("n_chars"),
        F.lit("clash").alias("fp"), F.lit(1).alias("mark"), F.lit(2).alias("a.b"), F.lit("c").alias("x`y z"))
    whole.repartition(3).write.parquet(f"{base}/documents.parquet")
    labels.write.parquet(f"{base}/labels.parquet")
    return base, truth, {**first}


def test_stages(spark, folder):
    base, truth, first = folder
    docs = spark.read.parquet(f"{base}/documents.parquet")
    columns = docs.columns
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = materialize(stage(spark, before, base), "stage")
        assert kept.columns == columns
        assert kept.exceptAll(before).count() == 0, name
        ids = {r.doc_id for r in kept.collect()}
        if name == "toxicity":
            good = [i for i, (_, bad) in truth.items() if not bad]
            assert sum(i in ids for i in good) >= 0.99 * len(good)
            assert sum(i in ids for i, (_, bad) in truth.items() if bad) <= 0.1 * (len(truth) - len(good))
        if name == "quality rules":
            assert not [i for i in ids if i in truth and not truth[i][0]] and 2000 not in ids
        if name == "simhash near-dedup":
            rows = before.select("doc_id", "text").collect()
            fps = np.array([brute_fingerprint(r.text or "") for r in rows], np.uint64)
            assert kept.count() == len(set(brute_labels(fps)))
            assert not [i for i in ids if i is not None and 1000 <= i < 2000 and i - 1000 in ids]
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, base)
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = sum(len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in kept.collect())
    assert packed.agg(F.sum("length")).first()[0] == want


def test_run_and_empty_documents(spark, folder, tmp_path):
    base, *_ = folder
    assert corpus_pipeline.run(spark, base).count() > 0
    spark.read.parquet(f"{base}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{base}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
