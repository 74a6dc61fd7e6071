"""Order-based operators against brute force, with tiny buckets and blocks so
that bucket edges, halos and block carries are all exercised."""

import random

import pandas as pd
from pyspark.sql import functions as F

from tillroll.operators.ordering import fill_within_groups, keep_first_per_key, with_position
from tillroll.operators.temporal import null_runs


def test_with_position_is_contiguous_rank(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 50), rnd.randint(0, 1000), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int, c int").repartition(13)
    out = with_position(df, ["a", "b", "c"], pos_col="pos", num_partitions=9).toPandas()
    want = sorted(rows)
    got = out.sort_values("pos")
    assert list(got["pos"]) == list(range(1, len(rows) + 1))
    assert list(zip(got["a"], got["b"], got["c"])) == want


def test_fill_within_groups_matches_group_ffill_bfill(spark):
    rnd = random.Random(11)
    rows = []
    for pos in range(1, 1201):
        g = 0 if rnd.random() < 0.4 else rnd.randint(1, 60)   # group 0 is hot
        if rnd.random() < 0.05:
            g = None
        v = rnd.randint(1, 9) if rnd.random() < 0.3 else None
        rows.append((pos, g, v))
    df = spark.createDataFrame(rows, "pos long, g int, v int").repartition(5)
    pdf = pd.DataFrame(rows, columns=["pos", "g", "v"]).sort_values("pos")
    exp = pdf.copy()
    keyed = exp["g"].notna()
    filled = exp[keyed].groupby("g")["v"].transform(lambda s: s.ffill().bfill())
    exp["out"] = exp["v"]
    exp.loc[keyed, "out"] = filled
    want = {int(p): (None if pd.isna(o) else int(o)) for p, o in zip(exp["pos"], exp["out"])}
    for block in (3, 17, 1 << 20):
        got = fill_within_groups(df, ["g"], "pos", "v", "out", block_rows=block)
        res = {r["pos"]: r["out"] for r in got.collect()}
        assert res == want, f"block_rows={block}"


def _brute_runs(values, max_run=5):
    runs, start = [], None
    for i, v in enumerate(values + [0]):
        if v is None and start is None:
            start = i
        elif v is not None and start is not None:
            if i - start <= max_run:
                runs.append((start + 1, i, i - start))
            start = None
    return sorted(runs)


def test_null_runs_halo_buckets_equal_global(spark):
    rnd = random.Random(3)
    for trial in range(4):
        n = 400
        p_null = [0.2, 0.5, 0.7, 0.85][trial]
        values = [None if rnd.random() < p_null else 1 for _ in range(n)]
        df = spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "pos long, v int")
        want = _brute_runs(values)
        for bucket in (6, 8, 13, 1 << 20):
            got = sorted(tuple(r) for r in null_runs(df, "pos", "v", bucket_rows=bucket)
                         .select("run_start", "run_end", "run_len").collect())
            assert got == want, (trial, bucket)


def test_keep_first_per_key(spark):
    df = spark.createDataFrame([(3, "a", 1.0), (1, "a", 2.0), (2, "b", 3.0), (5, "b", 4.0)],
                               "pos long, k string, x double")
    got = sorted(tuple(r) for r in keep_first_per_key(df, ["k"], "pos").collect())
    assert got == [(1, "a", 2.0), (2, "b", 3.0)]


def test_repartitioning_does_not_change_results(spark):
    from tillroll.operators.temporal import recover_dates
    rows = [(i, i // 3, None if i % 4 == 0 else f"2024-01-{1 + i // 9:02d}") for i in range(1, 200)]
    base = spark.createDataFrame(rows, "pos long, invoice long, date string")
    a = {r["pos"]: (r["date"], r["date_status"]) for r in recover_dates(base, bucket_rows=7, block_rows=5).collect()}
    b = {r["pos"]: (r["date"], r["date_status"]) for r in recover_dates(
        base.repartition(11, F.rand(1)), bucket_rows=7, block_rows=5).collect()}
    assert a == b
