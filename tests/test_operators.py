import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import metrics as M
from quern.functions.descriptors import described
from quern.functions.scalar import logit, sigmoid
from quern.operators import audit, calibrate, ensemble, features, identity, manifest, resume, sampling, split
from quern.operators.graph import connected_components
from quern.operators.prefix import number_by_hash, running_sums
from quern.plans.scratch import Scratch
from quern.sources import readers, sinks
from quern.streaming import ingest


def lcs_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_identity_values_and_brute_force():
    assert [identity.sequence_identity(*p) for p in (("ACGT", "ACGT"), ("ACGT", "AGT"), ("", ""), ("A", ""))] == [1.0, 0.75, 1.0, 0.0]
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choices("ACDE", k=r.randrange(0, 40))) for _ in range(2))
        assert identity.lcs(a, b) == lcs_table(a, b)
    r = random.Random(4)
    left, right = (["".join(r.choices("ACDEé", k=r.choice([0, 1, 63, 64, 65, 130, 200]))) for _ in range(9)] for _ in range(2))
    i, j, si = identity.tile((np.arange(9), left), (np.arange(100, 109), right), False, 0.0)
    assert len(i) == 81 and all(v == pytest.approx(identity.sequence_identity(left[p], right[q - 100])) for p, q, v in zip(i, j, si))


def test_identity_edges_are_exact(spark):
    r = random.Random(2)
    seqs = ["".join(r.choices("ACDEF", k=r.randrange(1, 30))) for _ in range(90)] + ["", ""]
    d = spark.createDataFrame(list(enumerate(seqs)), "entity_idx long, sequence string")
    for least in (0.0, 0.3, 0.6):
        got = {(x["i"], x["j"]): x["si"] for x in identity.si_edges(d, least, size=8).collect()}
        expect = {(i, j): identity.sequence_identity(seqs[i], seqs[j]) for i, j in itertools.combinations(range(len(seqs)), 2)}
        assert got == {k: v for k, v in expect.items() if v >= least}


def test_tiles_cover_every_pair_once(spark):
    d = spark.createDataFrame([(k, "A" * (k % 17 + 1)) for k in range(100)], "entity_idx long, sequence string")
    b = identity.blocks(d, 8).cache()
    t = identity.tiles(b, 0.0, 11).collect()
    n = b.count()
    assert len(t) == n * (n + 1) // 2 == len({(x["bi"], x["bj"]) for x in t}) and all(0 <= x["shard"] < 11 for x in t)


def test_shard_specs():
    assert identity.parse_shards("0-2,5", 8) == {0, 1, 2, 5} and identity.parse_shards("all", 3) == {0, 1, 2}
    for bad in ("3", "", "2-1", "a"):
        with pytest.raises(ValueError):
            identity.parse_shards(bad, 3)


def test_components_of_a_long_chain(spark):
    n = 700
    chain = [(k, k + 1) for k in range(n - 1)] + [(1000, 1001), (5, 5), (None, 3)]
    random.Random(3).shuffle(chain)
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark)).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_prefix_sums_and_numbers(spark):
    r = random.Random(4)
    rows = [(g, x, r.randrange(9)) for g in "ab" for x in r.sample(range(1000), 200)]
    d = spark.createDataFrame(rows, "g string, x int, v int")
    for down in (False, True):
        for row in running_sums(d, ["g"], "x", {"upto": "v"}, descending=down, parts=7).collect():
            assert row["upto"] == sum(v for g, x, v in rows if g == row["g"] and (x >= row["x"] if down else x <= row["x"]))
    h = number_by_hash(d.select(F.sha2(F.concat("g", F.col("x").cast("string")), 256).alias("h")), "h", "i").collect()
    assert [x["i"] for x in sorted(h, key=lambda x: x["h"])] == list(range(400))


def binary_rows(seed=5, n=120):
    r = random.Random(seed)
    return [(k, r.randrange(2), r.choice([r.random(), 0.5, 0.25])) for k in range(n)]


def test_ranking_metrics(spark):
    rows = binary_rows()
    d = spark.createDataFrame([(*x, 1.0 + x[0] % 3) for x in rows], "entity_idx long, target int, score double, w double").cache()
    pos, neg = [x for x in rows if x[1]], [x for x in rows if not x[1]]
    value = lambda a, b: 1.0 if a > b else 0.5 if a == b else 0.0
    plain = sum(value(p[2], q[2]) for p in pos for q in neg) / len(pos) / len(neg)
    assert M.auroc(d, []).first()["auroc"] == pytest.approx(plain)
    w = lambda x: 1.0 + x[0] % 3
    assert M.auroc(d, [], weight="w").first()["auroc"] == pytest.approx(sum(w(p) * w(q) * value(p[2], q[2]) for p in pos for q in neg) / sum(map(w, pos)) / sum(map(w, neg)))
    ap = before = 0.0
    for t in sorted({x[2] for x in rows}, reverse=True):
        hit = [x for x in rows if x[2] >= t]
        recall, precision = sum(x[1] for x in hit) / len(pos), sum(x[1] for x in hit) / len(hit)
        ap, before = ap + (recall - before) * precision, recall
    assert M.average_precision(d, []).first()["auprc"] == pytest.approx(ap)


def test_best_mcc_with_ties(spark):
    target, score = [0, 1, 0, 1, 1, 0], [0.1, 0.7, 0.1, 0.4, 0.7, -0.2]
    d = spark.createDataFrame(list(zip(target, score)), "target int, score double")

    def mcc(t):
        tp, fp, fn, tn = (sum((s >= t) == a and y == b for y, s in zip(target, score)) for a, b in ((True, 1), (True, 0), (False, 1), (False, 0)))
        den = math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
        return (tp * tn - fp * fn) / den if den else 0.0

    got = M.best_mcc(d, []).first()
    assert got["mcc"] == pytest.approx(max(map(mcc, score))) and mcc(got["threshold"]) == pytest.approx(got["mcc"])


def test_orientation_of_objectives(spark):
    rows = [(0, 0.0, -2.0), (0, 0.0, -1.0), (0, 1.0, 1.0), (0, 1.0, 2.0)]
    good = spark.createDataFrame([(0, y, s) for _, y, s in rows] + [(1, y, -s) for _, y, s in rows], "point int, target double, score double")
    for name, f in ensemble.OBJECTIVES.items():
        v = {x["point"]: x["value"] for x in f(good).collect()}
        assert v[0] > v[1], name


def test_sampling_masses(spark):
    d = spark.createDataFrame([(1, "one"), (1, "one"), (2, "one"), (1, "two"), (3, "two")], "entity long, task string")
    mass = {x["task"]: x["m"] for x in sampling.task_entity_weights(d).groupBy("task").agg(F.sum("weight").alias("m")).collect()}
    assert mass == pytest.approx({"one": 1.0, "two": 1.0})
    c = spark.createDataFrame(list(zip([0, 0, 0, 0, 1, 1], [10, 10, 10, 11, 20, 21])), "label int, entity long")
    w = sampling.class_entity_weights(c)
    assert [x[0] for x in w.groupBy("label").agg(F.sum("weight")).select("sum(weight)").collect()] == pytest.approx([1.0, 1.0])
    per = {x["entity"]: x["m"] for x in w.groupBy("entity").agg(F.sum("weight").alias("m")).collect()}
    assert per[10] == pytest.approx(per[11])
    s = sampling.source_weights(spark.createDataFrame([(1, 0), (1, 0), (2, 0), (3, 1), (4, 2)], "entity long, endpoint int"))
    assert [x[1] for x in s.groupBy("endpoint").agg(F.sum("weight")).collect()] == pytest.approx([1 / 3] * 3)


def test_batches_respect_the_budget(spark):
    d = spark.createDataFrame([(k, k * 37 % 90 + 1) for k in range(300)], "k long, n int")
    got = sampling.budget_batches(d, "k", "n", 400, shards=3).collect()
    by = {}
    for x in got:
        by.setdefault((x["shard"], x["batch"]), []).append(x["n"])
    assert len(got) == 300 and all((max(v) + 2) * len(v) <= 400 for v in by.values())


def test_rank_loss_orders(spark):
    d = spark.createDataFrame([(b, t, s if b == 0 else -s) for b in (0, 1) for t, s in ((1, 2.0), (1, 1.0), (0, -1.0), (0, -2.0))], "b int, target int, score double")
    v = {x["b"]: x["loss"] for x in sampling.binary_rank_loss(d, ["b"]).collect()}
    assert v[0] < v[1]
    with pytest.raises(ValueError):
        sampling.binary_rank_loss(d, ["b"], temperature=0)


def pair_losses(rows, margin=0.0, temperature=1.0):
    """(loss, number of such pairs), the hardest first."""
    by = {}
    for t, s in rows:
        by[t, s] = by.get((t, s), 0) + 1
    soft = lambda x: max(x, 0) + math.log1p(math.exp(-abs(x)))
    return sorted(((soft((margin - a + b) / temperature) * temperature, k * j) for (t, a), k in by.items() if t for (u, b), j in by.items() if not u), reverse=True)


def hardest(losses, hard):
    left = k = math.ceil(sum(w for _, w in losses) * hard)
    total = 0.0
    for x, w in losses:
        total, left = total + x * min(w, left), left - min(w, left)
    return total / k, k


def test_rank_loss_equals_all_pairs(spark):
    r = random.Random(11)
    rows = [(b, int(r.random() < 0.7), scale * (round(r.gauss(0, 1), 1) if b % 2 else r.gauss(0, 1))) for b, scale in enumerate((0.1, 1, 10, 300)) for _ in range(150)]
    d = spark.createDataFrame([*rows, (4, 1, 0.5), (None, 1, 0.5), (None, 0, 0.5)], "b int, target int, score double").repartition(7)
    for hard, margin, temperature in ((0.5, 0.1, 1.0), (0.03, 0.0, 0.2), (1.0, -3.0, 2.0)):
        got = {x["b"]: (x["loss"], x["pairs"]) for x in sampling.binary_rank_loss(d, ["b"], temperature, hard, margin).collect()}
        assert got.pop(4) == (0.0, 0) and got.pop(None) == (0.0, 0) and len(got) == 4
        for b, (loss, pairs) in got.items():
            want, k = hardest(pair_losses([x[1:] for x in rows if x[0] == b], margin, temperature), hard)
            assert pairs == k and loss == pytest.approx(want, rel=1e-10, abs=1e-12)


def test_rank_loss_of_odd_scores(spark):
    inf, nan = float("inf"), float("nan")
    cases = {0: [(1, None), (1, 1.0), (0, 0.0), (0, 0.5)], 1: [(1, nan), (1, 1.0), (0, 0.0)], 2: [(1, inf), (1, 1.0), (0, 0.0)], 3: [(1, 1.0), (0, inf)], 4: [(1, None), (0, 1.0)]}
    d = spark.createDataFrame([(b, *x) for b, v in cases.items() for x in v], "b int, target int, score double")
    got = {x["b"]: (x["loss"], x["pairs"]) for x in sampling.binary_rank_loss(d, ["b"]).collect()}
    soft = lambda x: math.log1p(math.exp(x))
    assert got[0] == (pytest.approx((soft(-1.0) + soft(-0.5)) / 2), 2) and math.isnan(got[1][0]) and got[1][1] == 2
    assert got[2] == (pytest.approx(soft(-1.0) / 2), 2) and got[3] == (inf, 1) and got[4] == (0.0, 0)


def test_rank_loss_of_ten_billion_pairs(spark):
    """Pairs are not formed: 10**10 of them, over 250,000 pairs of values."""
    d = spark.range(200_000).selectExpr("1 b", "id % 2 target", "(id div 2) * 7919 % 500 / 500D + id % 2 * 0.2D score")
    x = sampling.binary_rank_loss(d, ["b"], hard=0.5, margin=0.1).first()
    rows = [(t, v * 7919 % 500 / 500 + t * 0.2) for v in range(500) for t in (0, 1)]
    want, k = hardest(pair_losses(rows, 0.1), 0.5)
    assert x["pairs"] == k * 200**2 and x["loss"] == pytest.approx(want, rel=1e-10)


def test_recursive_reports(spark):
    w = ensemble.expand_report({"base_run_weights": {"a": 0.6, "b": 0.4}, "base_weight": 0.9, "candidate_weights": {"c": 0.1, "z": 0.0}})
    assert w == pytest.approx({"a": 0.54, "b": 0.36, "c": 0.1, "z": 0.0})
    p = spark.createDataFrame([("leaf", 11, 0.2), ("leaf", 22, 0.4), ("full", 11, 0.3), ("full", 22, 0.5), ("part", 11, 0.8)], "run string, entity_idx long, score double").withColumn("target", F.lit(1.0))
    got = ensemble.reconstruct({"blend": [({"run": "leaf"}, 0.6), ({"run": "full"}, 0.4)], "candidates": {"part": 0.25}}, p)
    assert [x["score"] for x in got.orderBy("entity_idx").collect()] == pytest.approx([0.24 + 0.25 * (0.8 - 0.24), 0.44])
    with pytest.raises(ValueError):
        ensemble.align(p)
    assert ensemble.common_entities(p).select("entity_idx").distinct().count() == 1


def test_coordinate_ascent_never_loses(spark):
    r = random.Random(7)
    rows = [(k, y, y + r.gauss(0, 2), y + r.gauss(0, 1), r.random()) for k in range(80) for y in [float(r.randrange(2))]]
    d = spark.createDataFrame(rows, "entity_idx long, target double, a double, b double, c double").cache()
    start = M.auroc(d.withColumn("score", F.col("a")), []).first()["auroc"]
    w, best = ensemble.coordinate_ascent(d, "a", ["b", "c"], "auroc", np.linspace(0, 0.5, 6), sweeps=1)
    assert best >= start and sum(w) <= 0.5 + 1e-9
    back = d.withColumn("score", (1 - sum(w)) * F.col("a") + w[0] * F.col("b") + w[1] * F.col("c"))
    assert M.auroc(back, []).first()["auroc"] == pytest.approx(best)


def test_calibration(spark):
    r = random.Random(8)
    rows = [(k, float(r.random() < 1 / (1 + math.exp(-x / 2))), x) for k in range(400) for x in [r.gauss(0, 3)]]
    d = spark.createDataFrame(rows, "entity_idx long, target double, score double").cache()
    t = calibrate.fit_temperature(d)
    loss = lambda a, b: sum(math.log1p(math.exp(-(2 * y - 1) * (a * x + b))) for _, y, x in rows)
    assert loss(1 / t, 0) <= min(loss(1 / (t * f), 0) for f in (0.97, 1.03)) + 1e-9
    a, b = calibrate.fit_platt(d)
    assert loss(a, b) <= min(loss(a * 1.02, b), loss(a, b + 0.02), loss(1 / t, 0)) + 1e-9
    p = calibrate.fit_beta(d)
    line = spark.createDataFrame([(float(x),) for x in np.linspace(-10, 10, 1000)], "x double")
    for params in (p, (0.5, 2.0, 0.1), (1.0, 1.0, -1.0)):
        v = [x[0] for x in line.select("x", calibrate.beta_logit(F.col("x"), *params).alias("y")).orderBy("x").select("y").collect()]
        assert all(m < n for m, n in zip(v, v[1:]))
    k, v = calibrate.fit_isotonic(d)
    out = [x[0] for x in d.select("score", calibrate.apply_isotonic(F.col("score"), k, v).alias("y")).orderBy("score").select("y").collect()]
    assert all(m <= n + 1e-12 for m, n in zip(out, out[1:])) and 0 <= min(out) and max(out) <= 1
    f = calibrate.folds(d).groupBy("target", "fold").count().collect()
    assert max(x["count"] for x in f if x["target"] == 1) - min(x["count"] for x in f if x["target"] == 1) <= 1
    z = spark.createDataFrame([(0.0,), (0.1,), (0.5,), (0.9,), (1.0,)], "p double").select(sigmoid(logit(F.col("p"))).alias("b"), logit(F.col("p")).alias("l")).collect()
    assert [x["b"] for x in z[1:4]] == pytest.approx([0.1, 0.5, 0.9]) and all(math.isfinite(x["l"]) for x in z)


def test_train_statistics_ignore_validation(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, 8))
    moved = x.copy()
    moved[8:] += 1000
    frames = [spark.createDataFrame([(k, [float(a) for a in r], float(r[0])) for k, r in enumerate(m)], "k long, v array<double>, a double") for m in (x, moved)]
    fits = [features.fit_pca(f, "v", F.col("k") < 8, 3) for f in frames]
    assert np.allclose(fits[0][0], fits[1][0]) and np.allclose(fits[0][1], fits[1][1])
    _, s, vt = np.linalg.svd(x[:8] - x[:8].mean(0))
    assert np.allclose(np.abs(fits[0][1]), np.abs(vt[:3]), atol=1e-6)
    z = [[r["z_a"] for r in features.train_only_standardise(f, ["a"], F.col("k") < 8).orderBy("k").collect()] for f in frames]
    assert np.allclose(z[0][:8], z[1][:8]) and np.isclose(np.std(z[0][:8]), 1)


def test_surface_patches(spark):
    def patches(seq, rsa, nbrs, dists):
        d = spark.createDataFrame([(1, k, c, float(rsa[k]), nbrs[k], dists[k]) for k, c in enumerate(seq)], "e long, pos long, residue string, rsa double, nbrs array<long>, dists array<double>")
        out = {}
        for r in features.patch_components(d, "e").collect():
            out.setdefault(r["category"], {})[r["pos"]] = r["patch"]
        return out

    got = patches("AVDKFW", [1] * 6, [[4, 2], [5, 3], [0, 3], [2, 1], [0, 5], [1, 3]], [[5.0, 9.0], [5.0, 9.0], [9.0, 9.0], [9.0, 9.0], [5.0, 9.0], [5.0, 9.0]])["hydrophobic"]
    assert got[0] == got[4] != got[1] and got[1] == got[5] and got[2] is None
    buried = patches("AAAA", [1, 0.1, 1, 1], [[1], [0], [3], [2]], [[5.0]] * 4)
    assert buried["surface"][1] is None and buried["hydrophobic"][1] is None and buried["surface"][2] == buried["surface"][3]


def test_descriptors(spark):
    s = "AVKKDX"
    row = described(spark.createDataFrame([(s,), ("",), ("ÄKKÄVAD",), (None,)], "s string").coalesce(1), "s").collect()
    assert row[2]["group_fraction_aliphatic"] == pytest.approx(2 / 7) and row[2]["longest_hydrophobic_run_fraction"] == pytest.approx(2 / 7) and row[3] == row[1]
    assert len(row[0]) == 35 and row[0]["aa_fraction_K"] == pytest.approx(2 / 6) and row[0]["net_charge_fraction"] == pytest.approx(1 / 6)
    assert row[0]["longest_charged_run_fraction"] == pytest.approx(3 / 6) and row[0]["noncanonical_fraction"] == pytest.approx(1 / 6)
    assert row[1]["log1p_length"] == 0 and row[1]["longest_hydrophobic_run_fraction"] == 0


def test_split_balances_and_audits(spark):
    r = random.Random(9)
    ents = [(k, f"c{k // 7 if k > 60 else 0}") for k in range(600)]
    obs = [(c, r.choice("xy"), "binary", float(r.randrange(2))) for _, c in ents]
    e = spark.createDataFrame(ents, "entity_idx long, component string")
    o = spark.createDataFrame(obs, "component string, source_dataset string, target_kind string, target_value double")
    f = split.component_features(e, o)
    a = split.allocate(f)
    assigned = {x["component"]: x["split"] for x in a.collect()}
    assert assigned["c0"] == "train" and len(assigned) == len({c for _, c in ents})
    n = {s: sum(assigned[c] == s for _, c in ents) / 600 for s in split.SPLITS}
    assert n == pytest.approx(split.FRACTIONS, abs=0.03)
    placed = e.join(a, "component")
    edges = spark.createDataFrame([(0, 1, 0.9), (0, 599, 0.2)], "i long, j long, si double")
    v = split.validate(edges, placed).first()
    sizes = [sum(assigned[c] == s for _, c in ents) for s in split.SPLITS]
    assert v["violations"] == 0 and v["repeated"] == 0 and v["cross_pairs"] == (600**2 - sum(k * k for k in sizes)) // 2


def test_manifest(spark):
    d = spark.createDataFrame([("prot one A-1",), ("x\tA-0",)], "h string")
    name, label = manifest.decode_header(F.col("h"))
    assert [tuple(x) for x in d.select(name, label).collect()] == [("prot one", "1"), ("x", "0")]
    with pytest.raises(Exception, match="bad header"):
        n, _ = manifest.decode_header(F.col("h"))
        spark.createDataFrame([("x A-2",)], "h string").select(n).collect()
    with pytest.raises(ValueError):
        manifest.checked_join(spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(2,)], "k int"), "k")
    rows = [("o1", "h1", "s", "e", "binary", 1.0, "AA"), ("o2", "h1", "t", "e", "binary", 0.0, "AB")]
    o = spark.createDataFrame(rows, ", ".join(f"{c} {'double' if c == 'target_value' else 'string'}" for c in manifest.OBSERVATION))
    kinds = {x["kind"] for x in manifest.hash_violations(o, F.sha2("sequence", 256)).collect()}
    assert kinds == {"hash", "sequence"} and manifest.union_observations([o, o]).count() == 4
    assert [tuple(x) for x in manifest.overlaps(o).collect()] == [("s;t", 1, 1)]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿name,seq\nx,1\ny,\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv"), ["name", "seq"]).collect()] == [("x", "1"), ("y", "")]
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path / "a.csv"), ["other"])
    with pytest.raises(ValueError, match="twice"):
        readers.read_splits(spark, {"train": str(tmp_path / "a.csv"), "test": str(tmp_path / "a.csv")}, ["name", "seq"], "name")
    (tmp_path / "f.fasta").write_text(">one A-1\nac\n\nGT\n>two A-0\nTT\n")
    assert [(r["ordinal"], r["header"], r["sequence"]) for r in readers.read_fasta(spark, str(tmp_path / "f.fasta")).collect()] == [(1, "one A-1", "ACGT"), (2, "two A-0", "TT")]
    assert sorted(tuple(r) for r in readers.read_fasta_large(spark, str(tmp_path / "f.fasta"), upper=False).collect()) == [("one A-1", "acGT"), ("two A-0", "TT")]
    (tmp_path / "g.fasta").write_text("AC\n>one\nAC\n")
    with pytest.raises(Exception, match="before a header"):
        readers.read_fasta(spark, str(tmp_path / "g.fasta")).collect()
    assert readers.read_fasta(spark, str(tmp_path / "g.fasta"), strict=False).count() == 1
    sinks.write_json(spark, str(tmp_path / "r.json"), {"b": 1, "a": [2]})
    assert (tmp_path / "r.json").read_text() == '{\n  "a": [\n    2\n  ],\n  "b": 1\n}\n'
    d = spark.createDataFrame([(1, "x")], "k int, v string")
    sinks.append_jsonl(d, str(tmp_path / "log"))
    sinks.append_jsonl(d, str(tmp_path / "log"))
    assert readers.read_json(spark, str(tmp_path / "log"), "k int, v string", lines=True).count() == 2
    sinks.write_csv(d, str(tmp_path / "out"), ["v", "k"])
    assert readers.read_csv(spark, str(tmp_path / "out"), ["v", "k"]).first()["v"] == "x"
    assert [r["key"] for r in readers.list_files(spark, str(tmp_path), r"/([a-z])\.fasta$", "*.fasta").orderBy("key").collect()] == ["f", "g"]
    sinks.write_prefixed(d.withColumn("h", F.sha2("v", 256)), str(tmp_path / "p"), "h")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    p = spark.createDataFrame([("r", 1, 1, 0.5)], "run string, entity_idx int, target int, predictions double")
    p.write.parquet(str(tmp_path / "pred"))
    assert readers.read_predictions(spark, str(tmp_path / "pred")).first()["score"] == 0.5


def test_resume_recomputes_only_what_is_broken(spark, tmp_path):
    path, calls = str(tmp_path / "store"), []

    def compute(shards):
        calls.append(shards)
        return spark.createDataFrame([(s, s * 10 + k) for s in shards for k in range(3)], "shard int, v int")

    assert resume.run_shards(spark, path, {"t": 0.3}, [0, 1, 2], compute).count() == 9
    assert resume.run_shards(spark, path, {"t": 0.3}, [0, 1, 2], compute).count() == 9 and calls == [[0, 1, 2]]
    spark.createDataFrame([(1, 999)], "shard int, v int").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{path}/data")
    got = sorted(tuple(r) for r in resume.run_shards(spark, path, {"t": 0.3}, [0, 1, 2, 3], compute).select("shard", "v").collect())
    assert calls[1:] == [[1, 3]] and got == [(s, s * 10 + k) for s in range(4) for k in range(3)]
    with pytest.raises(ValueError, match="differs"):
        resume.run_shards(spark, path, {"t": 0.4}, [0], compute)


def test_audit_tables(spark):
    n = spark.createDataFrame([(k, k + 1, f"h{k}", ["s"] if k % 2 else ["t"]) for k in range(5)], "entity_idx long, length int, sequence_sha256 string, sources array<string>")
    e = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.9)], "i long, j long, si double")
    d = {r["entity_idx"]: (r["degree"], r["cross_source_degree"], r["neighbor_max_length"]) for r in audit.degrees(e, n).collect()}
    assert d == {0: (1, 1, 2), 1: (2, 2, 3), 2: (1, 1, 2), 3: (0, 0, 0), 4: (0, 0, 0)}
    t = {r["threshold"]: (r["components"], r["largest"], r["singletons"], r["non_singleton_entities"]) for r in audit.threshold_sensitivity(e, n, Scratch(spark)).collect()}
    assert t[0.3] == (3, 3, 2, 3) and t[0.7] == (4, 2, 3, 2) and t[0.9] == (4, 2, 3, 2) and len(t) == 7


def test_streaming_is_idempotent(spark, tmp_path):
    src, store, ck = (str(tmp_path / x) for x in ("in", "store", "ck"))
    schema = "observation_id string, v int"
    spark.createDataFrame([("a", 1), ("b", 2)], schema).write.parquet(src)
    assert ingest.ingest(spark, src, schema, store, ck) == 2
    spark.createDataFrame([("b", 9), ("c", 3)], schema).write.mode("append").parquet(src)
    assert ingest.ingest(spark, src, schema, store, ck) == 3
    assert ingest.ingest(spark, src, schema, store, ck) == 3


def test_search_modes_and_simplex_weights(spark):
    r = random.Random(12)
    rows = [(k, y, y + r.gauss(0, 2), y + r.gauss(0, 1), r.random()) for k in range(60) for y in [float(r.randrange(2))]]
    d = spark.createDataFrame(rows, "entity_idx long, target double, a double, b double, c double").cache()
    w, best = ensemble.coordinate_ascent(d, "a", ["b", "c"], "auroc", np.linspace(0, 0.4, 5), sweeps=1, mode="rescale", start=[0.2, 0.1])
    assert 0 <= sum(w) <= 1 and best >= M.auroc(d.withColumn("score", 0.7 * F.col("a") + 0.2 * F.col("b") + 0.1 * F.col("c")), []).first()["auroc"]
    s = ensemble.simplex_weights(d, ["a", "b", "c"], rounds=20)
    assert s.sum() == pytest.approx(1) and (s >= 0).all() and s.argmax() == 1


def test_message_layer_ignores_invalid_slots(spark):
    from quern.operators import fusion

    v = spark.createDataFrame([(1, 0, 0.5), (1, 1, 1.0), (1, 2, -1.0)], "e int, pos long, v double")
    n = spark.createDataFrame([(1, 0, 1, 2.0), (1, 0, 2, 4.0)], "e int, i long, j long, dist double")
    more = n.union(spark.createDataFrame([(1, 0, 1, 0.0), (1, 0, 1, 99.0)], n.schema))
    a, b = (sorted(tuple(x) for x in fusion.message_layer(m, v, "e", "v").collect()) for m in (n, more))
    assert a == b
    w = [math.exp(-0.25), math.exp(-1.0)]
    assert a[0][2] == pytest.approx(0.5 + math.tanh((w[0] - w[1]) / sum(w))) and a[1][2] == 1.0
