"""Files in and out, runs, selections, cross-fits and streamed groups, against plain Python."""

import io
import itertools
import json

import numpy as np
import pandas as pd
import pytest

from quern.operators import calibrate as Q
from quern.operators import ensemble as E
from quern.operators import features, resume
from quern.sources import readers, sinks


def test_csv_keeps_quotes_blanks_and_breaks(spark, tmp_path):
    rows = [("a", ' x "y", z '), ("b", "line\r\nbreak\n"), ("c", "")]
    sinks.write_csv(spark.createDataFrame(rows, "k string, v string"), f"file://{tmp_path}/t", ["v", "k"])
    got = readers.read_csv(spark, f"file://{tmp_path}/t", ["k", "v"])
    assert sorted(map(tuple, got.collect())) == rows


def test_duplicate_names_over_splits_are_refused(spark, tmp_path):
    for s in ("train", "test"):
        sinks.write_csv(spark.createDataFrame([("n", s)], "name string, x string"), f"file://{tmp_path}/{s}", ["name", "x"])
    with pytest.raises(ValueError, match="occurs twice"):
        readers.read_splits(spark, {s: f"file://{tmp_path}/{s}" for s in ("train", "test")}, ["name", "x"], "name")


def test_predictions_fall_back(spark, tmp_path):
    p = spark.createDataFrame([("r", 1, 1, 0.5)], "run string, entity_idx int, target int, predictions double")
    p.write.parquet(f"file://{tmp_path}/second")
    got = readers.read_predictions(spark, f"file://{tmp_path}/first", f"file://{tmp_path}/second").collect()
    assert [tuple(r) for r in got] == [("r", 1, 1.0, 0.5)]
    with pytest.raises(FileNotFoundError):
        readers.read_predictions(spark, f"file://{tmp_path}/first")


def test_array_files(spark, tmp_path):
    a = np.arange(12.0).reshape(3, 2, 2)
    np.save(tmp_path / "a.npy", a)
    got = {r["row"]: (r["name"], r["vector"]) for r in readers.read_npy(spark, f"file://{tmp_path}/a.npy").collect()}
    assert got == {k: ("", a[k].ravel().tolist()) for k in range(3)}
    f = io.BytesIO()
    np.savez(f, x=np.array(3.0), y=np.zeros((0, 4)))
    files = spark.createDataFrame([("k", bytearray(f.getvalue()))], "key string, content binary")
    assert [tuple(r) for r in readers.npy_rows(files, "key", "content").collect()] == [("k", "x", 0, [3.0])]


def test_run_folders(spark, tmp_path):
    base = f"file://{tmp_path}"
    path = resume.start_run(spark, base, "one", {"b": 2, "a": "x"})
    assert (tmp_path / "run=one" / "config.json").read_text() == json.dumps({"a": "x", "b": 2}, indent=2) + "\n"
    assert resume.start_run(spark, base, "one", {"a": "x", "b": 2}) == path
    with pytest.raises(ValueError, match="differs"):
        resume.start_run(spark, base, "one", {"a": "y", "b": 2})
    assert sorted(map(tuple, resume.read_runs(spark, base, "config").collect())) == [("one", "a", "x"), ("one", "b", "2")]


def test_reduction_waits_for_all_shards(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    df = spark.range(20).selectExpr("id", "cast(id % 4 as int) as shard")
    turns = []

    def compute(todo):
        turns.append(list(todo))
        return df.where(df["shard"].isin(todo))

    resume.run_shards(spark, path, {"n": 4}, [0, 1], compute)
    with pytest.raises(ValueError, match="2 shards"):
        resume.reduce_when_complete(spark, path, [0, 1, 2, 3], lambda x: x.groupBy().count())
    resume.run_shards(spark, path, {"n": 4}, [0, 1, 2, 3], compute)
    assert turns == [[0, 1], [2, 3]]
    assert resume.reduce_when_complete(spark, path, [0, 1, 2, 3], lambda x: x.groupBy().count()).first()[0] == 20


def ascend(x, y, base, cands, score, grid, mode, cap, sweeps):
    """The same search over plain arrays."""
    w, cols = [0.0] * len(cands), [base, *cands]
    value = lambda w: score(sum(c * a for c, a in zip([1 - sum(w), *w], (x[n] for n in cols))), y)
    best = value(w)
    for _ in range(sweeps):
        moved = False
        for k in range(len(w)):
            at, win = None, best
            for v in grid:
                p = [q * (1 - v) / (1 - w[k]) if w[k] < 1 else 0.0 for q in w] if mode == "rescale" else list(w)
                p[k] = v
                if mode == "simplex" and sum(p) > cap + 1e-12:
                    continue
                got = value(p)
                if got > win + 1e-12:
                    at, win = p, got
            if at:
                w, best, moved = at, win, True
        if not moved:
            break
    return w, best


def auroc(s, y):
    pairs = [(a > b) + (a == b) / 2 for a, b in itertools.product(s[y == 1], s[y == 0])]
    return sum(pairs) / len(pairs)


def mcc(s, y):
    best = -1.0
    for t in set(s):
        tp, fp = ((s >= t) & (y == 1)).sum(), ((s >= t) & (y == 0)).sum()
        fn, tn = (y == 1).sum() - tp, (y == 0).sum() - fp
        root = np.sqrt(float(tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
        best = max(best, (tp * tn - fp * fn) / root if root else 0.0)
    return best


@pytest.mark.parametrize("objective, mode", [("auroc", "rescale"), ("mcc", "simplex")])
def test_coordinate_ascent(spark, objective, mode):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 40)
    x = {n: np.round(rng.random(40) + 0.3 * y * k, 3) for k, n in enumerate("abc")}
    wide = spark.createDataFrame(pd.DataFrame({"entity_idx": np.arange(40), "target": y, **x})).repartition(2)
    grid = np.linspace(0, 0.5, 6)
    w, best = E.coordinate_ascent(wide, "a", ["b", "c"], objective, grid, cap=0.5, sweeps=2, mode=mode)
    want = ascend(x, y, "a", ["b", "c"], {"auroc": auroc, "mcc": mcc}[objective], grid.tolist(), mode, 0.5, 2)
    assert best == pytest.approx(want[1], abs=1e-9) and best > {"auroc": auroc, "mcc": mcc}[objective](x["a"], y)


@pytest.mark.parametrize("method", list(Q.METHODS))
def test_crossfit_uses_other_folds_only(spark, method):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 60)
    df = spark.createDataFrame(pd.DataFrame({"entity_idx": np.arange(60), "target": y, "score": np.round(rng.normal(size=60) + y, 3)}))
    got = Q.crossfit(df, method, 2).toPandas()
    fit, apply = Q.METHODS[method]
    for i in (0, 1):
        p = fit(spark.createDataFrame(got[got["fold"] != i][["target", "score"]]))
        part = spark.createDataFrame(got[got["fold"] == i])
        again = part.select("out_of_fold", apply(part["score"], p).alias("x")).toPandas()
        assert np.allclose(again["out_of_fold"], again["x"], atol=1e-6)


def test_groups_stay_whole_over_batches():
    groups = [["a"] * 3, ["b"], ["c"] * 4, ["d"]]
    keys = [k for g in groups for k in g]
    for size in range(1, 10):
        batches = [pd.DataFrame({"k": keys[i : i + size]}) for i in range(0, len(keys), size)]
        out = [f["k"].tolist() for f in features.whole_groups([*batches, pd.DataFrame({"k": []})], "k")]
        assert sum(out, []) == keys
        assert all(set(a).isdisjoint(b) for a, b in itertools.combinations(out, 2))
