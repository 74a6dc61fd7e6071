"""Collocations against counting everything; the task's counter against plain
loops with small chunks and runs."""

import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from .conftest import DOCS
from tillroll.llm import collocations as C


def phrases(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
        w = re.findall(r"[^\x20\x09]+", piece)
        for size in (1, 2, 3):
            for k in range(len(w) - size + 1):
                yield tuple(w[k:k + size])


def all_counts(rows):
    f = defaultdict(Counter)
    for _, text, lang in rows:
        f["und" if lang is None else lang].update(phrases(text))
    return f


def brute(rows, min_count=10, top=2000):
    out = []
    for lang, f in all_counts(rows).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        cands = {p: c for p, c in f.items() if len(p) > 1 and c >= min_count}
        found = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * c >= 50 * a and p in (q[:2], q[1:]) for q, c in cands.items()):
                continue
            s, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def run(spark, rows, **k):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, lang string, n int, phrase string, `a.b` string")
    return sorted(tuple(r) for r in C.collocations(df.repartition(4), **k).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(n, seed=1):
    r = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "état", "b-c", "zz", "hot", "dog", "漢", "\x1f", "\x85x"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 12)):
            parts.append(r.choice(["New York city", "hot dog", "the", *words, *words]) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]))
        rows.append((i, "".join(parts), r.choice(["en", "en", "de", None, "", "und"])))
    return rows


def test_against_counting_everything(spark):
    rows = corpus(300)
    rows += [(7, "New York city is New York city", "en")] * 12 + [(None, None, None), (None, "", "xx"), (3, "only few words", "yy")]
    for limits in ({}, {"min_count": 3}, {"min_count": 2, "top": 7}):
        assert run(spark, rows, **limits) == brute(rows, **limits)


@pytest.mark.parametrize("sample, words, pairs", [(1, 64, 64), (1 << 30, 1 << 20, 1 << 20), (3, 1 << 20, 256)])
def test_any_sample_and_any_bitmap(spark, monkeypatch, sample, words, pairs):
    """Everything sampled, nothing sampled (three passes), bitmaps full of shared bits."""
    monkeypatch.setattr(C, "SAMPLE", sample)
    monkeypatch.setattr(C, "WORD_BITS", words)
    monkeypatch.setattr(C, "PAIR_BITS", pairs)
    rows = corpus(150, seed=5)
    assert run(spark, rows, min_count=4) == brute(rows, min_count=4)


def test_odd_documents(spark):
    rows = [(i, t, None) for i, t in DOCS]
    assert run(spark, rows, min_count=2) == brute(rows, min_count=2)
    assert run(spark, rows[:1]) == []
    assert C.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def counted(texts, words=True):
    everything = C.Proposed(*(x | 255 for x in (C.np.zeros(64, C.np.uint8), C.np.zeros(64, C.np.uint8))))
    counter, got = C.Counter(words, everything, None, 3), Counter()
    batches = [b for lang, t in texts for b in counter.add(lang, t)] + list(counter.flush())
    rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    kinds = C.pa.int64(), C.pa.binary()
    packed = C.pa.record_batch([C.pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["bucket", "entries"])
    for b in C.added_up(iter([packed]), 1):
        for lang, p, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if p:
                got[lang, tuple(p.split(" "))] += n
    return got


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.tuples(st.sampled_from(["en", "de"]), st.text(alphabet="aB \t.\né\x0b", max_size=60)), max_size=6),
       chunk=st.integers(1, 9), held=st.integers(1, 30), at_once=st.integers(1, 9))
def test_chunks_and_runs(texts, chunk, held, at_once):
    old = C.CHUNK, C.HELD, C.ENTRIES_AT_ONCE
    try:
        C.CHUNK, C.HELD, C.ENTRIES_AT_ONCE = chunk, held, at_once
        want = Counter((lang, p) for lang, t in texts for p in phrases(t))
        assert counted(texts) == want
    finally:
        C.CHUNK, C.HELD, C.ENTRIES_AT_ONCE = old


def test_a_long_text():
    text = "alpha beta gamma " * 700_000 + "x" * 5_000_000 + " end"
    got = counted([("en", text)])
    assert got["en", ("alpha", "beta", "gamma")] == 700_000 and got["en", ("gamma", "alpha")] == 699_999
    assert got["en", ("beta", "gamma", "x" * 5_000_000)] == 1 and got["en", ("x" * 5_000_000, "end")] == 1


def test_exact_scores_beyond_64_bits(spark):
    big = 9_000_000_000_000_000
    rows = [("en", "a b", big - 7), ("en", "a", big), ("en", "b", big - 1)]
    got = C.scored(spark.createDataFrame(rows, "lang string, phrase string, n long")).first()
    assert got.score == 1_000_000 * (big - 7) ** 2 // (big * (big - 1))
