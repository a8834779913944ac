from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import ann, lattice_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, v string, cid string, q string"


def frame(spark, ids, x, extra=()):
    rows = [(int(i), [float(a) for a in v], 1, "v", "c", "q") for i, v in zip(ids, x)]
    return spark.createDataFrame(rows + [(*e, 1, "v", "c", "q") for e in extra], SCHEMA)


ODD = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] + [1.0] * 15), (9004, [None] + [1.0] * 15), (9005, [1.0] * 3), (9006, []), (9020, [float("inf")] * 16), (None, [1.0] * 16)]


def clusters(seed=0, n=300, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    near = base[:40].repeat(5, 0) + rng.normal(size=(200, dim)) * 0.12
    hot = base[:1].repeat(150, 0) + rng.normal(size=(150, dim)) * 0.05
    x = np.concatenate([base, near, hot, base[:30], 3 * base[30:40]]).astype(np.float32).astype(float)
    return np.arange(len(x)), x


def test_search_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 40)
    monkeypatch.setattr(ann, "BLOCK", 60)
    monkeypatch.setattr(ann, "STRAND", 3)
    monkeypatch.setattr(ann, "STEP", 8)
    ids, x = clusters()
    d = frame(spark, ids, x, ODD + [(40, [float(a) for a in x[40]])])
    got = defaultdict(list)
    for r in ann.search(d, F.col("vec_id") % 20 == 0, k=10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in ids if i % 20 == 0}
    hit = total = 0
    for i, rows in got.items():
        s = x @ x[i]
        best = [j for j in np.lexsort((ids, -s)) if j != i][:10]
        assert [r[0] for r in rows] == list(range(1, 11)) and len({r[1] for r in rows}) == 10 and i not in {r[1] for r in rows}
        assert all(r[2] == pytest.approx(float(s[r[1]]), rel=1e-12) for r in rows)
        assert [(-r[2], r[1]) for r in rows] == sorted((-r[2], r[1]) for r in rows)
        hit, total = hit + len({r[1] for r in rows} & set(best)), total + 10
    assert hit >= 0.9 * total


def test_search_small(spark):
    ids, x = clusters(1)
    d = frame(spark, ids[:5], x[:5])
    got = ann.search(d, F.col("vec_id") == 0, k=20).collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4]
    assert ann.search(d.limit(0), F.lit(True)).count() == 0
    same = frame(spark, range(50), np.ones((50, 8)))
    got = ann.search(same, F.col("vec_id") == 7, k=5).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2, 3, 4] and {r["score"] for r in got} == {8.0}


def test_kd_tree_cells_hold_their_points():
    p = np.random.default_rng(2).normal(size=(500, 5))
    dims, cuts, lo, hi = ann.kd_tree(p, 4)
    leaf = ann.leaf_of(p, dims, cuts, 4)
    assert (p >= lo[leaf]).all() and (p <= hi[leaf]).all() and len(lo) == 16


def brute_links(ids, x):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = u @ u.T >= 0.9
    parent = {int(i): int(i) for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in zip(*np.nonzero(linked)):
        p, q = find(int(ids[a])), find(int(ids[b]))
        parent[max(p, q)] = min(p, q)
    return {int(i): (int(linked[k].sum()) - 1, find(int(i))) for k, i in enumerate(ids)}


@pytest.mark.parametrize("block,small", [(2048, 256), (40, 10)])
def test_lattice_dedup_against_brute_force(spark, monkeypatch, block, small):
    monkeypatch.setattr(lattice_dedup, "BLOCK", block)
    monkeypatch.setattr(lattice_dedup, "SMALL", small)
    ids, x = clusters(4)
    got = lattice_dedup.near_duplicates(frame(spark, ids, x, ODD)).collect()
    truth = brute_links(ids, x)
    by = {r["vec_id"]: r for r in got}
    assert len(got) == len(ids) + len(ODD)
    assert all(by[i]["n_links"] <= truth[i][0] for i in truth)
    assert sum(by[i]["n_links"] for i in truth) >= 0.97 * sum(t[0] for t in truth.values())
    assert sum(by[i]["component_id"] == truth[i][1] for i in truth) >= 0.98 * len(truth)
    assert all(by[i]["kept"] == (by[i]["component_id"] == i) for i in truth)
    assert all((by[i]["n_links"], by[i]["component_id"], by[i]["kept"]) == (0, i, True) for i, _ in ODD if i is not None)
    assert (by[None]["n_links"], by[None]["component_id"], by[None]["kept"]) == (0, None, False)


def test_lattice_edge_cases(spark):
    d = frame(spark, [1, 2, 2], np.ones((3, 4)))
    assert sorted(tuple(r) for r in lattice_dedup.near_duplicates(d).collect()) == [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False)]
    assert lattice_dedup.near_duplicates(d.limit(0)).count() == 0
    assert lattice_dedup.near_duplicates(frame(spark, [], [], ODD)).count() == len(ODD)


def test_e8_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8)) * 2
    c = lattice_dedup.decode(x)
    assert (np.rint(c) == c).all() and ((c % 2 == 0).all(1) | (c % 2 == 1).all(1)).all() and (c.sum(1) % 4 == 0).all()
    own = ((x - c / 2) ** 2).sum(1)
    around = ((x[:, None, :] - (c[:, None, :] + lattice_dedup.ROOTS) / 2) ** 2).sum(2).min(1)
    assert (own <= around + 1e-9).all() and len(lattice_dedup.ROOTS) == 240
