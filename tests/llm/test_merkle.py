"""The Merkle manifest against a plain tree built in order."""

import hashlib
import random
import zlib
from collections import defaultdict

from .conftest import DOCS, key
from tillroll.llm import merkle
from pyspark.sql import functions as F

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, place int, `a.b` string, node string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """The root and each node's siblings, level by level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            run = range(p // 3 * 3, min(p // 3 * 3 + 3, len(nodes)))
            proofs[k].append(("".join(nodes[q] for q in run if q < p), "".join(nodes[q] for q in run if q > p)))
            at[k] = p // 3
        nodes = [H(*nodes[p:p + 3]) for p in range(0, len(nodes), 3)]
    return nodes[0] if nodes else None, proofs


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    found, subroots = [], []
    for s in order:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        subroot, proofs = tree([leaf(*r) for r in own])
        subroots.append(subroot)
        found.append([(r, p) for r, p in zip(own, proofs, strict=True)])
    root, tops = tree(subroots)
    out = []
    for subroot, top, group in zip(subroots, tops, found, strict=True):
        for r, path in group:
            text, path = r[4], path + top
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            h = leaf(*r[:4], text)
            for left, right in path:
                h = H(left, h, right)
            out.append((r[0], leaf(*r), subroot, root, H(*(x + y for x, y in path)), h, h == root))
    return sorted(out, key=key)


def run(df):
    out = merkle.manifest(df)
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    folded = merkle.fold(F.coalesce("bent", "leaf"), F.col("path"))
    return sorted((tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256), folded,
                                                folded == F.col("root")).collect()), key=key)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "dot", "n") for r in rows], SCHEMA).repartition(3)


def test_odd_rows(spark, no_docs):
    sources = [None, "", "é", "z", "B", None, "Z"]
    rows = [(i, sources[k % 7], [None, "en"][k % 2], [None, 5][k % 3 == 0], t) for k, (i, t) in enumerate(DOCS)]
    rows += [(3, None, None, None, None)] * 4 + [(None, None, None, None, None)] * 3 + [(5, "one", "en", 1, "x\ny")]
    assert run(frame(spark, rows)) == brute(rows)
    assert merkle.manifest(frame(spark, rows).limit(0)).count() == 0


def test_one_leaf(spark):
    rows = [(2, "only", "en", 3, "a\nb")]
    got = run(frame(spark, rows))
    assert got == brute(rows) and got[0][2] == got[0][3] == got[0][1] and got[0][4] == H()


def test_hot_ids_and_copies(spark):
    """Ids far apart, one id on a third of the rows, equal rows over blocks."""
    r = random.Random(2)
    ids = [r.choice([-(2**63), 2**63 - 1, r.randint(-2**62, 2**62), r.randint(0, 900), r.randint(60_000, 70_000)]) for _ in range(500)]
    rows = [(i, "hot" if k % 3 else f"s{k % 40}", "en", k, f"text\n{k}") for k, i in enumerate(ids)]
    rows += [(77, "hot", "en", k, "same id\nother row") for k in range(300)] + [(78, "hot", "en", 1, "equal\nrows")] * 1600
    rows += [(None, "hot", "en", k % 9, "no id") for k in range(100)]
    assert run(frame(spark, rows)) == brute(rows)


def test_many_steps(spark, monkeypatch):
    monkeypatch.setattr(merkle, "STEP", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    rows = [(i * 1000, f"s{i % 83 if i < 100 else 0}", "en", i, f"{i}\n") for i in range(200)] + [(5, "s0", None, 1, "copy")] * 30
    assert run(frame(spark, rows)) == brute(rows)
