"""Line dedup against brute force: hot lines, ties, odd white space, repeated
rows, null ids and texts."""

import random
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from .conftest import DOCS, key
from tillroll.llm import line_dedup


def line_key(line):
    bare = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in bare)


def brute(rows, min_chars, min_docs):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[line_key(line)].add(i)
    order = lambda i: (i is not None, i or 0)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            k = line_key(line)
            hit = len(k) >= min_chars and len(holders[k]) >= min_docs
            if not hit or max(holders[k], key=order) == i:
                kept.append(line)
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=key)


def run(docs, **k):
    out = line_dedup.dedup_lines(docs, **k)
    return sorted(((r.doc_id, r.text, r.n_lines, len(r.dropped)) for r in out.collect()), key=key)


def test_odd_documents(docs, no_docs):
    for limits in ({"min_chars": 40, "min_docs": 5}, {"min_chars": 3, "min_docs": 2}, {"min_chars": 0, "min_docs": 1}):
        assert run(docs, **limits) == brute(DOCS, **limits)
    assert run(no_docs) == []


def test_hot_lines_and_repeated_rows(spark):
    r = random.Random(4)
    pool = [f"A shared Line number {k} that many documents hold, ÄÖ {'x' * k}" for k in range(12)]
    hot = "The one line that nearly every document of the table carries."
    rows = []
    for i in range(400):
        lines = [r.choice(["  ", "\t", "", "\r"]) + r.choice([x, x.upper().replace("Ä", "ä"), x]) + r.choice(["", " \x0b"])
                 for x in r.choices(pool, k=r.randint(0, 4))]
        lines += [f"own line of document {i} with text enough to be long"] * r.randint(0, 2)
        if i % 10:
            lines.insert(r.randint(0, len(lines)), hot)
        rows.append((r.choice([i, i, i, None, 7]), "\n".join(lines)))
    rows += [(9_000, hot)] * 30 + [(9_000, hot + "\nsecond version of the row")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(df) == brute(rows, 40, 5)


def test_a_long_text_of_many_lines(spark):
    many = "\n".join(["a line that stands in all of the five documents"] * 60_000 + ["end"])
    rows = [(i, many) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert [(out[i].text, out[i].n_lines, len(out[i].dropped)) for i in range(4)] == [("end", 60_001, 60_000)] * 4
    assert out[4].text == many and not out[4].dropped


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 4)), st.one_of(st.none(), st.text(alphabet="aB \n\tÄ\x0b", max_size=14))), max_size=14))
def test_random_documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df, min_chars=1, min_docs=2) == brute(rows, 1, 2)
