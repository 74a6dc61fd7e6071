"""Quality rules with a hashed n-gram logistic regression (operator 7).

Words are the matches of ``[^\\x20\\x09-\\x0D]+`` of a whole text.  The base
rules need counts of the text alone; texts that pass them are judged by a
logistic regression on hashed word and character n-grams (relative
frequencies), fitted on labelled quality rows, probability-calibrated, and
applied in Arrow batches against a fixed threshold.

Defined results: a null text counts as empty: no words, ``base_failed``; a
null id stays; repeated rows are judged alike; an empty table gives no rows;
without labelled rows of both classes every text that passes the base rules is
kept.  Labels: a null quality is unlabelled; of several labels of one document
the smallest counts.  Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import documents, map_rows, texts
from tillroll.llm.linear import Sparse, fit_logistic, fit_platt, sigmoid
from tillroll.sources.tables import read_table

#: Fixed values of the base rules.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
SYMBOLS = re.compile(rb"[#*$%&|<>]")
#: Texts with a smaller probability of good quality are dropped.
THRESHOLD = 0.3
#: At most so many labelled rows are fitted, those with the smallest hash.
SAMPLE_ROWS = 4000
#: Characters of a labelled text that is learned from: with the rows, the bound
#: of what the driver gathers.
SAMPLE_CHARS = 65_536

WORD_DIM, CHAR_DIM = 1 << 14, 1 << 15
DIM = WORD_DIM + CHAR_DIM
SCALE = 30.0
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """CRC-32 of each word met, bounded: cleared when it holds LIMIT words."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = zlib.crc32(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    w = np.fromiter((number.setdefault(x, len(number)) for x in words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = h * MIX + w[k:k + n] + np.uint64(1)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    s = h[order]
    near = np.flatnonzero(s[1:] == s[:-1])
    if not len(near):
        return 0
    # equal hashes: compare the windows themselves
    hit = np.zeros(n, bool)
    if all(np.array_equal(w[k + order[near]], w[k + order[near + 1]]) for k in range(window)):
        hit[order[near]] = hit[order[near + 1]] = True
    else:
        seen: dict[bytes, int] = {}
        for i in np.union1d(order[near], order[near + 1]).tolist():
            first = seen.setdefault(w[i:i + window].tobytes(), i)
            if first != i:
                hit[first] = hit[i] = True
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(hit)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    raw = text.encode()
    return (len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")), len(SYMBOLS.findall(raw)),
            duplicate_lines(raw), repeat_words(words))


def features(raw: bytes, words: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(hash bucket of each word, word pair and character 4-gram; its weight).
    Words and pairs share one half of the mass, characters the other."""
    w = hashes.of(words)
    pairs = (w[:-1] * np.uint64(31) + w[1:]) * MIX >> np.uint64(50)
    word = np.concatenate([w * MIX >> np.uint64(50), pairs]).astype(np.int64)
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 4:
        b = np.pad(b, (0, 4 - len(b)))
    g = (b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24) * np.uint32(2654435761)
    char = (g >> np.uint32(17)).astype(np.int64) + WORD_DIM
    return (np.concatenate([word, char]),
            np.concatenate([np.full(len(word), SCALE / max(1, len(word)), np.float32),
                            np.full(len(char), SCALE / len(char), np.float32)]))


def merged(f: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum the weights of equal features."""
    total = np.bincount(f, weights=v, minlength=DIM)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class QualityModel:
    weights: np.ndarray
    intercept: float
    slope: float
    shift: float
    fitted: bool = True

    def probability(self, raw: bytes, words: list[bytes], hashes: WordHashes) -> float:
        if not self.fitted:
            return 1.0
        f, v = features(raw, words, hashes)
        return float(sigmoid(self.slope * (float((self.weights[f] * v).sum()) + self.intercept) + self.shift))


def _words(text: str) -> list[bytes]:
    return text.encode().split()  # splits at exactly \x20 and \x09-\x0D


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, keep=None) -> DataFrame:
    """(doc_id, text, y): the documents of the ``rows`` labels with the
    smallest hashes; the frame of labels is bounded, so it is broadcast.  A row
    for each label: of repeated ids the smallest text of at most SAMPLE_CHARS
    characters; labels of longer texts alone are not learned from."""
    good = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if keep is not None:
        good = good.filter(keep)
    few = (good.groupBy("doc_id").agg(F.min(label).cast("double").alias("y"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    return (docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
            .filter(F.char_length("text") <= SAMPLE_CHARS).join(F.broadcast(few), "doc_id")
            .groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y"))


def sparse_rows(sample: DataFrame, rows) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Run ``rows`` (text -> features, weights) on the executors and gather
    the bounded sample's sparse rows."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rows(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2),
                pa.array([f.astype("<u2").tobytes() for f, _ in found], pa.binary()),
                pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())],
                names=["doc_id", "y", "f", "v"])

    got = sample.mapInArrow(make, "doc_id long, y double, f binary, v binary").toArrow().sort_by("doc_id")
    return got["y"].to_numpy(), [(np.frombuffer(f.as_py(), "<u2"), np.frombuffer(v.as_py(), "<f4"))
                                 for f, v in zip(got["f"], got["v"], strict=True)]


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> QualityModel:
    """Fit on four fifths of the sample, calibrate on the rest."""
    def one(text: str):
        raw = text.encode()
        return merged(*features(raw, raw.split(), WordHashes()))

    y, x = sparse_rows(labelled(docs, labels, "quality", rows), one)
    if len(set(y.tolist())) < 2:
        return QualityModel(np.zeros(DIM, np.float32), 0.0, 1.0, 0.0, fitted=False)
    fold = np.random.default_rng(0).permutation(len(y)) % 5 == 0

    held = Sparse.of([r for r, k in zip(x, fold, strict=True) if k])
    fitted = Sparse.of([r for r, k in zip(x, fold, strict=True) if not k])
    del x
    pa.default_memory_pool().release_unused()
    w, b = fit_logistic(fitted, y[~fold], DIM, l2=1e-5)
    a, c = fit_platt(held.dot(w) + b, y[fold])
    return QualityModel(w.astype(np.float32), b, a, c)


def judge(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, probability, kept), a row per row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a weight per hash bucket: 200 KB
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names), ("probability", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hashes = sent.value, WordHashes()
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            p = []
            for text in texts(batch):
                words = _words(text)
                for col, v in zip(cols, (len(words), *base_counts(text, words)), strict=True):
                    col.append(v)
                p.append(m.probability(text.encode(), words, hashes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols), pa.array(p, pa.float64())], schema=out)

    found = rows.mapInArrow(score, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", probability double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("probability") >= threshold))


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def good(text: str, m: QualityModel, hashes: WordHashes) -> bool:
        words = _words(text)
        n = len(words)
        if n < MIN_WORDS or 100 * repeat_words(words) > MAX_REPEAT_PERCENT * n:
            return False
        return m.probability(text.encode(), words, hashes) >= threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hashes = sent.value, WordHashes()
        for batch in batches:
            yield batch.filter(pa.array([good(t, m, hashes) for t in texts(batch, at)], pa.bool_()))

    at = docs.columns.index("text")
    return map_rows(docs, run)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return judge(docs, model)
