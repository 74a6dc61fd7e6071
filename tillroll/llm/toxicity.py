"""Toxicity by weak supervision (operator 3).

1. Voters.  Each looks at a whole text and votes "toxic" or abstains: stated
   insults (a voter per word), phrase patterns, and word-stem patterns induced
   from labelled rows (languages without a stated list have their own stems).
2. A generative label model reads the votes of a bounded sample, without
   labels: EM estimates the rate at which each voter fires on toxic and on
   clean texts; the correlations of voters given the class are estimated from
   the same posterior, and correlated voters share one voice.
3. A linear classifier on hashed words, word stems and votes is trained on the
   model's posterior labels, and calibrated on the labels of the sample.

Only rows whose crc32(doc_id as text) mod 4 is not 2 are learned from.  The
score reads the text alone.

Defined results: a null text scores as an empty one (the calibrated base
rate); null ids stay and are never held out; repeated rows score alike; an
empty table gives no rows; without labels of both classes the stated voters
alone decide.  Of several labels of one document the smallest counts.  Other
columns are ignored.
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

from tillroll.llm.common import RaggedTable, Symbols, documents, map_rows, texts
from tillroll.llm.linear import Sparse, fit_platt, fit_smooth, sigmoid
from tillroll.llm.quality import labelled
from tillroll.sources.tables import read_table

#: Stated insults, a voter each.
INSULTS = (
    "asshole bastard bitch clown cretin degenerate disgusting dumb dumbass filth fool freak garbage hate idiot "
    "imbecile jerk loser maggot moron parasite pathetic pig psycho scum scumbag shit stupid trash vermin worthless "
    "arschloch abschaum dummkopf idiotin missgeburt schwachkopf versager wertlos "
    "connard crétin débile imbécile ordure salaud "
    "basura estúpido gilipollas imbécil inútil tonto"
).split()
#: Phrases, each with the word that must be there for a look.
PHRASES = (("shut", r"\bshut\s+(?:the\s+\w+\s+)?up\b"), ("get", r"\bget\s+lost\b"), ("kill", r"\bkill\s+yourself\b"),
           ("you", r"\byou\s+(?:are|re|'re)\s+(?:an?\s+|such\s+an?\s+)?(?:" + "|".join(INSULTS) + r")\b"),
           ("hate", r"\b(?:i|we)\s+hate\s+(?:you|them)\b"), ("go", r"\bgo\s+to\s+hell\b"))

THRESHOLD = 0.3
#: At most so many labelled rows are learned from, those with the smallest hash.
SAMPLE_ROWS = 6_000
#: At most so many stems become voters (a model size).
STEM_VOTERS = 128
STEM_LENGTHS = (4, 5, 6)
#: Toxic rows that a stem must add to those that other voters find, and its
#: odds: so many toxic rows for each clean one.
MIN_STEM_ROWS, MIN_STEM_ODDS = 3, 19
#: Induced voters are added until so many voters find each toxic row.
COVER = 3
#: Features of fewer rows of the sample have no weight.
MIN_ROWS = 3

WORD = re.compile(r"[^\W\d_]+")
N_FIXED = len(INSULTS) + len(PHRASES)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def feature(text: str) -> int:
    """A word's number: a 32-bit hash, wide enough that a text of thousands of
    words doesn't meet another word's by chance."""
    return zlib.crc32(text.encode())


#: Where the checksum of a stem starts, so that it differs from the word's.
STEM = zlib.crc32(b"stem of ")


def word_features(chunk: str) -> list[int]:
    """Numbers of the words of a lower-cased chunk and of their stems."""
    out, crc = [], zlib.crc32
    for w in WORD.findall(chunk):
        out.append(crc(w.encode()))
        for n in STEM_LENGTHS:
            if len(w) < n:
                break
            out.append(crc(w[:n].encode(), STEM))
    return out


class Chunks:
    """White-space separated chunks met by a worker (a bounded cache) with
    their features; a text is the set of its chunks."""

    LIMIT, CHARS = 500_000, 12_000_000

    def __init__(self) -> None:
        self._clear()

    def _clear(self) -> None:
        self.symbols, self.table = Symbols(), RaggedTable(np.uint32)

    def of(self, lowered: list[str]) -> list[np.ndarray]:
        """The numbers of the distinct chunks of each text."""
        if len(self.symbols) > self.LIMIT or self.symbols.chars > self.CHARS:
            self._clear()
        out = [self.symbols.number(list(set(t.split()))) for t in lowered]
        self.table.extend([word_features(c) for c in self.symbols.take_fresh()])
        return out

    def features(self, chunks: np.ndarray) -> np.ndarray:
        """The sorted features of a text, once for each of its chunks."""
        return np.sort(self.table.take(chunks)[0]).astype(np.int64)


def groups(batch: list[str], size: int = 256) -> Iterator[list[str]]:
    for a in range(0, len(batch), size):
        yield batch[a:a + size]


_PHRASES = [(feature(word), re.compile(p)) for word, p in PHRASES]
_INSULTS = np.array([feature(w) for w in INSULTS], np.int64)


def present(wanted: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which of ``wanted`` are among the sorted ``found``."""
    if not len(found):
        return np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(found, wanted), len(found) - 1)
    return found[at] == wanted


_LOOK = np.array([b for b, _ in _PHRASES], np.int64)


def votes(lowered: str, found: np.ndarray, stems: np.ndarray) -> np.ndarray:
    """Which voters fire: stated insults, phrases, then induced stems."""
    look = present(_LOOK, found)
    phrases = [bool(x) and p.search(lowered) is not None for x, (_, p) in zip(look, _PHRASES, strict=True)]
    return np.concatenate([present(_INSULTS, found), np.array(phrases, bool), present(stems, found)])


@dataclass
class LabelModel:
    """Rates of firing on clean and on toxic texts, and how much voters fire
    together beyond that."""

    prior: float
    fires: np.ndarray
    together: np.ndarray

    def posterior(self, v: np.ndarray, silence: bool = True) -> np.ndarray:
        """The probability that a text is toxic, given its votes.  Voters that
        fire together share their say as far as they are correlated.  With
        ``silence`` voters that abstain speak for clean (as EM needs it)."""
        on = np.log(self.fires[1] / self.fires[0])
        off = np.log((1 - self.fires[1]) / (1 - self.fires[0]))
        say = v / (1 + v @ self.together)
        return sigmoid(np.log(self.prior / (1 - self.prior)) + say @ on + silence * ((1 - v) @ off))


def fit_label_model(v: np.ndarray, steps: int = 30) -> LabelModel:
    """EM over the votes ``v`` (texts x voters, 0 or 1)."""
    n, k = v.shape
    rate = np.clip(v.mean(axis=0) if n else np.full(k, 0.01), 1e-4, 0.5)
    # a start: firing is rare, and much likelier on toxic texts
    model = LabelModel(0.1, np.stack([np.clip(rate / 20, 1e-5, 0.2), np.clip(rate * 5, 1e-3, 0.8)]), np.zeros((k, k)))
    for _ in range(steps):
        p = model.posterior(v)
        sums = p.sum(), n - p.sum()
        fires = np.stack([((1 - p) @ v + 0.02) / (sums[1] + 2.0), (p @ v + 0.2) / (sums[0] + 2.0)])
        # what is left of the votes when the class is known
        r = v - np.outer(p, fires[1]) - np.outer(1 - p, fires[0])
        d = np.sqrt((r * r).sum(axis=0) + 1e-9)
        together = np.clip((r.T @ r) / np.outer(d, d), 0, 1)
        np.fill_diagonal(together, 0)
        fires[1] = np.maximum(fires[1], fires[0] * 1.5)
        model = LabelModel(float(np.clip((sums[0] + 1) / (n + 10), 0.005, 0.5)), np.clip(fires, 1e-6, 0.999), together)
    return model


def induce_stems(rows: list[np.ndarray], y: np.ndarray, found: np.ndarray, most: int = STEM_VOTERS) -> np.ndarray:
    """Words and stems that mark the toxic rows of the sample which fewer than
    COVER voters find (``found``: how many stated ones do): one after the other
    the feature that marks the most of them, ties by number, as long as it
    marks MIN_STEM_ROWS."""
    pos = [r for r, t in zip(rows, y, strict=True) if t > 0.5]
    neg = [r for r, t in zip(rows, y, strict=True) if t <= 0.5]
    if not pos or not neg:
        return np.zeros(0, np.int64)
    known, a = np.unique(np.concatenate(pos), return_counts=True)
    known, a = known[a >= MIN_STEM_ROWS], a[a >= MIN_STEM_ROWS]
    clean, count = np.unique(np.concatenate(neg), return_counts=True)
    b = np.zeros(len(known), np.int64)
    both = present(known, clean)
    b[both] = count[present(clean, known)]
    candidates = known[a > MIN_STEM_ODDS * b]
    marks = np.array([present(candidates, r) for r in pos], np.float32).reshape(len(pos), len(candidates))
    found, chosen = found[y > 0.5].copy(), []
    while len(chosen) < most and len(candidates):
        adds = (found < COVER).astype(np.float32) @ marks
        adds[chosen] = 0
        best = int(np.argmax(adds))
        if adds[best] < MIN_STEM_ROWS:
            break
        chosen.append(best)
        found += marks[:, best] > 0
    return candidates[sorted(chosen)]


#: Inputs besides words and stems: a place for each voter and one for any.
VOTERS = N_FIXED + STEM_VOTERS + 1


def voter_inputs(v: np.ndarray) -> np.ndarray:
    fired = np.flatnonzero(v)
    return np.append(fired, VOTERS - 1) if len(fired) else fired


@dataclass
class ToxicityModel:
    """``known`` are the sorted numbers of the words and stems that have a
    weight; a text's weights are summed over its distinct chunks, and divided
    by the root of their number.  Each voter has a weight of its own."""

    stems: np.ndarray
    known: np.ndarray
    voter_weights: np.ndarray
    weights: np.ndarray
    intercept: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def places(self, found: np.ndarray) -> np.ndarray:
        """Where the features ``found`` stand in ``known``; -1: nowhere."""
        if not len(self.known):
            return np.full(len(found), -1, np.int64)
        at = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
        return np.where(self.known[at] == found, at, -1)


class Scorer:
    """Scores texts with a model; keeps each chunk's summed weight."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model, self.chunks = model, Chunks()
        self.marks = np.unique(np.concatenate([_INSULTS, _LOOK, model.stems]))
        self.sums, self.counts, self.marked = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool)

    def _weigh(self) -> None:
        """Weigh the chunks that are new in the table."""
        table, n = self.chunks.table, len(self.chunks.table.offsets) - 1
        if n < len(self.sums):  # the table was cleared
            self.sums, self.counts, self.marked = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool)
        old = len(self.sums)
        flat = table.flat[table.offsets[old]:].astype(np.int64)
        owner = np.repeat(np.arange(n - old), np.diff(table.offsets[old:]))
        at = self.model.places(flat)
        hit = at >= 0
        self.sums = np.append(self.sums, np.bincount(owner[hit], self.model.weights[at[hit]], n - old))
        self.counts = np.append(self.counts, np.bincount(owner[hit], minlength=n - old))
        self.marked = np.append(self.marked, np.bincount(owner[present(flat, self.marks)], minlength=n - old) > 0)

    def scores(self, batch: Iterator[str]) -> np.ndarray:
        m, z = self.model, []
        for lowered in groups([t.lower() for t in batch]):
            found = self.chunks.of(lowered)
            self._weigh()
            for text, c in zip(lowered, found, strict=True):
                words = self.sums[c].sum() / np.sqrt(max(1, self.counts[c].sum()))
                if self.marked[c].any():
                    words += m.voter_weights[voter_inputs(votes(text, self.chunks.features(c), m.stems))].sum()
                z.append(words)
        return sigmoid(m.slope * (np.array(z, np.float64) + m.intercept) + m.shift)


def _gather(sample: DataFrame) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of the bounded sample: labels, features, stated votes."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, none = Chunks(), np.zeros(0, np.int64)
        for batch in batches:
            f, v = [], []
            for lowered in groups([t.lower() for t in texts(batch)]):
                for text, c in zip(lowered, chunks.of(lowered), strict=True):
                    found = chunks.features(c)
                    f.append(found.astype("<u4").tobytes())
                    v.append(votes(text, found, none).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(f, pa.binary()),
                                              pa.array(v, pa.binary())], names=["doc_id", "y", "f", "v"])

    got = sample.mapInArrow(make, "doc_id long, y double, f binary, v binary").toArrow().sort_by("doc_id")
    return (got["y"].to_numpy(), [np.frombuffer(f.as_py(), "<u4") for f in got["f"]],
            np.array([np.frombuffer(v.as_py(), bool) for v in got["v"]]).reshape(-1, N_FIXED))


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    y, found, stated = _gather(labelled(docs, labels, "toxic", rows, ~held_out()))
    distinct = [np.unique(f) for f in found]
    stems = induce_stems(distinct, y, stated.sum(axis=1))
    none = np.zeros(0, np.int64)
    if not len(y):  # stated voters alone
        return ToxicityModel(stems, none, np.full(VOTERS, 3.0), np.zeros(0), -3.0)
    induced = np.array([present(stems, f) for f in distinct]).reshape(len(found), len(stems))
    cast = np.concatenate([stated, induced], axis=1)
    posterior = fit_label_model(cast.astype(np.float64)).posterior(cast.astype(np.float64), silence=False)
    known, count = np.unique(np.concatenate(distinct), return_counts=True)
    del distinct
    model = ToxicityModel(stems, known[count >= MIN_ROWS], np.zeros(0), np.zeros(0))
    rows_x = []
    for v, f in zip(cast, found, strict=True):
        words, fired = model.places(f), voter_inputs(v)
        words = words[words >= 0]
        rows_x.append((np.concatenate([fired, VOTERS + words]).astype(np.int32), np.concatenate([
            np.ones(len(fired), np.float32), np.full(len(words), 1 / np.sqrt(max(1, len(words))), np.float32)])))
    x = Sparse.of(rows_x)
    del found, rows_x
    pa.default_memory_pool().release_unused()
    w, model.intercept = fit_smooth(x, posterior, VOTERS + len(model.known), l2=1e-3, steps=60)
    model.slope, model.shift = fit_platt(x.dot(w) + model.intercept, y)
    model.voter_weights, model.weights = w[:VOTERS], w[VOTERS:]
    return model


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample: a few MB
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            p = scorer.scores(texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], schema=out)

    found = rows.mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out().alias("held_out"), "score",
                        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their
    columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer.scores(texts(batch, at)) < threshold, pa.bool_()))

    at = docs.columns.index("text")
    return map_rows(docs, run)


def op3_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")))
