"""Nearest vectors of every row, and how sure they are."""

import numpy as np
import pytest

from tallyframe.operators import rank
from tallyframe.plans import aggregates


def vectors(n, seed=5):
    """Whole numbers below 5 in each of six places, so that many are alike and many distances are equal."""
    return np.random.default_rng(seed).integers(0, 5, (n, 6)).astype(float)


def nearest(v, keep):
    """By comparing all with all."""
    v = np.array(v)
    total = v.sum(axis=1, keepdims=True)
    p = np.where(total > 0, v / np.where(total > 0, total, 1), np.nan)
    out = set()
    for i, row in enumerate(p):
        d = np.nan_to_num(np.abs(p - row).sum(axis=1) / 2, nan=np.inf)
        out |= {(i, int(j), round(float(d[j]), 6), k + 1) for k, j in enumerate(np.lexsort((np.arange(len(p)), np.round(d, 12)))[:keep])}
    return out


def table_of(spark, v, folder):
    spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_candidates_of_every_row(spark, tmp_path):
    v = np.random.default_rng(1).random((120, 8)).astype(np.float32)
    got = aggregates.rank_candidates(spark, table_of(spark, v, tmp_path)).collect()
    assert {tuple(r) for r in got} == nearest(v.astype(float), 3) and len(got) == 360


@pytest.mark.parametrize("keep", [1, 3, 200])
def test_blocks_of_any_size_give_the_nearest(spark, monkeypatch, keep):
    """Alike vectors, ones that can't be compared and negative elements, over several blocks a task."""
    for name, value in (("BLOCK", 16), ("CHUNK", 32), ("BLOCKS", 2), ("SPLIT", 2)):
        monkeypatch.setattr(rank, name, value)
    v = vectors(150)
    v[7], v[90] = 0.0, -1.0
    v[11, :2], v[60, :2] = (-3.0, 9.0), (40.0, -39.5)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "id long, v array<double>").repartition(4)
    got = rank.ranked_candidates(df, df, keep).collect()
    want = nearest(v, keep)
    assert {(r["sheet"], r["rank"], round(r["distance"], 6)) for r in got} == {(s, k, d) for s, _, d, k in want} and len(got) == len(want)
    # Of equal distances the least id comes first, where these are equal as doubles.
    exact = {r["sheet"]: r["candidate"] for r in got if r["rank"] == 1}
    assert all(exact[s] == c for s, c, d, k in want if k == 1)


def test_every_row_is_judged(spark, tmp_path):
    v = np.random.default_rng(2).random((120, 8)).astype(np.float32)
    v[3] = v[100]
    v[5] = 0.0
    got = {r["sheet"]: r for r in aggregates.confident_matches(spark, table_of(spark, v, tmp_path)).collect()}
    by_rank = {(s, k): (c, d) for s, c, d, k in nearest(v.astype(float), 2)}
    assert set(got) == set(range(120))
    for s, r in got.items():
        (c, best), (_, second) = by_rank[s, 1], by_rank[s, 2]
        assert (r["candidate"], r["best"], r["second"]) == (c, best, second)
        assert r["sure"] == (best <= 0.3 and (second - best >= 0.12 if best < np.inf else False)), s
