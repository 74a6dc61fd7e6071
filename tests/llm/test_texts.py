"""Toxicity, quality rules, SimHash, winnowing: against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from .conftest import DOCS, key, sorted_rows
from tillroll.llm import quality, simhash, toxicity, winnowing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- quality

def base(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
    hit = set()
    for k in range(len(words) - 7):
        if windows[tuple(words[k:k + 8])] > 1:
            hit.update(range(k, k + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def unfitted():
    return quality.QualityModel(np.zeros(quality.DIM, np.float32), 0.0, 1.0, 0.0, fitted=False)


def test_base_rules(docs):
    out = quality.judge(docs, unfitted())
    got = sorted_rows(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for i, t in DOCS:
        b = base(t or "")
        want.append((i, *b, b[0] < 20 or 100 * b[4] > 30 * b[0]))
    assert got == sorted(want, key=key)
    assert out.filter("kept = base_failed").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t#\x0b\u00a0", max_size=120))
def test_base_counts(text):
    words = text.encode().split()
    n = base(text)
    assert (len(words), *quality.base_counts(text, words)) == n


def corpus(spark, n=400, seed=3):
    """Good prose, symbol junk, and toxic prose with labels."""
    r = random.Random(seed)
    syll = ["ta", "re", "mi", "no", "lu", "ke", "so", "va"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choices(syll, k=r.randint(1, 3))) for _ in range(r.randint(30, 90))]
        good, bad = 1, 0
        if i % 5 == 0:
            words, good = [w + "%%%" for w in words], 0
        if i % 7 == 0:
            for _ in range(3):
                words.insert(r.randint(0, len(words)), r.choice(["idiot", "moron,", "gronk" + r.choice(syll), "gronk" + r.choice(syll)]))
            bad = 1
        rows.append((i, " ".join(words)))
        labels.append((i, good, bad))
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int"),
            {i: (g, b) for i, g, b in labels})


def test_quality_model(spark, no_docs):
    docs, labels, truth = corpus(spark)
    model = quality.fit_quality(docs, labels)
    kept = {r.doc_id: r.kept for r in quality.judge(docs, model).collect()}
    assert all(kept[i] == bool(truth[i][0]) for i in truth)
    assert {r.doc_id for r in quality.keep_good(docs, model).collect()} == {i for i in kept if kept[i]}
    assert not quality.fit_quality(no_docs, labels).fitted
    assert quality.judge(no_docs, model).count() == 0


def test_probability_of_odd_texts():
    m = quality.QualityModel(np.ones(quality.DIM, np.float32), 0.0, 1.0, 0.0)
    for t in ("", "x", "\x1c", "ab"):
        assert 0 <= m.probability(t.encode(), t.encode().split(), quality.WordHashes()) <= 1


# --------------------------------------------------------------- toxicity

def test_toxicity_held_out(spark, docs, no_docs):
    own, labels, truth = corpus(spark, 900)
    model = toxicity.fit_toxicity(own, labels)
    out = {r.doc_id: r for r in toxicity.score(own, model).collect()}
    import zlib
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    held = [i for i, r in out.items() if r.held_out]
    assert np.mean([out[i].predicted == truth[i][1] for i in held]) >= 0.97
    clean = toxicity.keep_clean(own, model)
    assert {r.doc_id for r in clean.collect()} == {i for i, r in out.items() if r.predicted == 0}
    odd = toxicity.score(docs, model)
    assert odd.count() == len(DOCS) and odd.filter("score is null or score < 0 or score > 1 or held_out is null").count() == 0
    assert toxicity.score(no_docs, model).count() == 0


def test_toxicity_without_labels(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(no_docs, labels)
    rows = spark.createDataFrame([(1, "you are an idiot"), (2, "a fine day")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.score(rows, model).collect()} == {1: 1, 2: 0}


def test_label_model_finds_accuracies():
    """Two good voters, a noisy one, and two that say the same."""
    r = np.random.default_rng(5)
    y = r.random(6000) < 0.15
    def voter(a, b): return np.where(y, r.random(6000) < a, r.random(6000) < b).astype(float)
    twin = voter(0.5, 0.002)
    v = np.stack([voter(0.6, 0.002), voter(0.5, 0.001), voter(0.08, 0.05), twin, twin], axis=1)
    m = toxicity.fit_label_model(v)
    p = m.posterior(v)
    assert m.together[3, 4] > 0.9 and m.together[0, 1] < 0.5
    assert ((p > 0.5) == y).mean() > 0.9
    assert (np.log(m.fires[1] / m.fires[0])[[0, 1]] > np.log(m.fires[1] / m.fires[0])[2]).all()


# ---------------------------------------------------------------- simhash

def brute_fingerprint(text, k=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_labels(fps, radius=2):
    d = np.bitwise_count(fps[:, None] ^ fps[None, :])
    label = np.arange(len(fps))
    while True:
        new = np.where(d <= radius, label[None, :], len(fps)).min(axis=1)
        if (new == label).all():
            break
        label = new
    return label


def brute_components(ids, fps):
    label, least = brute_labels(fps), {}
    for i, c in zip(ids, label, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return [least.get(c) for c in label]


def test_near_duplicates(docs, no_docs):
    ids = [i for i, _ in DOCS]
    fps = np.array([brute_fingerprint(t or "") for _, t in DOCS], np.uint64)
    got = sorted_rows(simhash.near_duplicates(docs).select("doc_id", F.hex("fp").alias("h"), "component_id"), "doc_id", "h", "component_id")
    assert got == sorted(((i, f"{int(f):X}", c) for i, f, c in zip(ids, fps, brute_components(ids, fps), strict=True)), key=key)
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(brute_labels(fps)))
    assert simhash.keep_one_of_each(no_docs).count() == 0


def test_links_connect_all_near_fingerprints(spark):
    """Clouds of fingerprints around centres, with small parts, so that hot
    keys are cut and compared part by part."""
    r = random.Random(11)
    fps = set()
    for _ in range(12):
        c = r.getrandbits(64)
        for _ in range(40):
            x = c
            for _ in range(r.randint(0, 3)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    edges = simhash.links(nodes, bucket=8)
    arr = np.array(fps, np.uint64)
    want = brute_components(list(range(len(fps))), arr)
    root = {x.node: x.root for x in simhash.components(edges).collect()}
    names = [root.get(simhash._signed(x), simhash._signed(x)) for x in fps]
    assert len(set(zip(names, want, strict=True))) == len(set(names)) == len(set(want))
    # never all pairs: a forest per group
    assert edges.count() <= 15 * len(fps) * 6


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=150), st.integers(0, 5), st.data())
def test_bit_planes_give_every_link(values, radius, data):
    near = [v ^ (1 << data.draw(st.integers(0, 63))) for v in values[:20]]
    fps = np.array(values + near, np.uint64)
    group = np.sort(np.array([i % 3 for i in range(len(fps))]))
    got = {(int(a), int(b)) for q, o in simhash.BitPlanes(fps, group).links(radius) for a, b in zip(q, o, strict=True)}
    want = {(a, b) for a in range(len(fps)) for b in range(a) if group[a] == group[b]
            and bin(int(fps[a]) ^ int(fps[b])).count("1") <= radius}
    assert got == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# -------------------------------------------------------------- winnowing

def brute_winnow(t, k=16, w=8):
    grams = [t[i:i + k] for i in range(len(t) - k + 1)] if len(t) >= k else [t] if t else []
    h = [(xxhash.xxh64_intdigest(g.encode(), 42) + 2**32) % 2**33 - 2**32 for g in grams]  # 33 bits, signed
    windows = [range(i, i + w) for i in range(len(h) - w + 1)] if len(h) > w else [range(len(h))] if h else []
    picks = {min(win, key=lambda i: (h[i], -i)) for win in windows}
    return [(h[i], i) for i in sorted(picks)]


def test_winnowing(docs, no_docs):
    out = winnowing.edited_likeness(docs)
    rows = sorted(DOCS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for j, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(j + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(),
                     *(sorted({h for h, _ in brute_winnow(x)}) for x in (t, edited, nxt))))
    assert sorted_rows(out, "doc_id", "n_chars", "edited_sha256", "hashes", "edited_hashes", "next_hashes") == sorted(want, key=key)
    assert winnowing.edited_likeness(no_docs).count() == 0
    got = sorted_rows(winnowing.winnow(docs), "doc_id", "hashes", "positions")
    assert got == sorted(((i, [h for h, _ in brute_winnow(t or "")], [p for _, p in brute_winnow(t or "")]) for i, t in DOCS), key=key)


def test_one_document_follows_itself(spark):
    text = "a single document that is its own next one"
    r = winnowing.edited_likeness(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.next_hashes == r.hashes


def test_match_guarantee(spark):
    """A shared run of k + window - 1 code points shares a hash."""
    run = "exactly twenty-three ch"
    assert len(run) == winnowing.K + winnowing.WINDOW - 1
    rows = spark.createDataFrame([(1, "ab cd ef " * 9 + run + "XYZ" * 20), (2, "0123456789" * 7 + run + "qrst" * 11)], "doc_id long, text string")
    a, b = (set(r.hashes) for r in winnowing.winnow(rows).collect())
    assert a & b


def test_labelled_samples_are_bounded(spark):
    """A row for each label, whatever ids repeat and however long texts are."""
    long = "w " * quality.SAMPLE_CHARS
    rows = [(1, "b"), (1, "a"), (1, long)] + [(2, f"copy {i % 7}") for i in range(3000)] + [(3, None), (4, long), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 4, 2)] + [(None, 0), (5, None)], "doc_id long, toxic int")
    got = quality.labelled(docs, labels, "toxic", 100)
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1.0), (2, "copy 0", 1.0), (3, "", 1.0)]
    assert quality.labelled(docs, labels, "toxic", 2).count() <= 2
    assert quality.labelled(docs.limit(0), labels, "toxic", 100).count() == 0
