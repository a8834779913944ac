"""Queries of metrics, ensembles, calibration, sampling and losses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quern.functions import metrics as M
from quern.functions.scalar import bce_with_logits, logit, rbf, sinusoid, smooth_l1, smoothed_label, softplus
from quern.operators import calibrate as Q
from quern.operators import ensemble as E
from quern.operators import sampling as S
from quern.operators.manifest import checked_join
from quern.operators.prefix import running_sums
from quern.plans.fixtures import LONG, OBS, PRED, RUNS, long_obs, obs, preds
from quern.plans.scratch import Scratch
from quern.registry import query

LOGIT = "ln(score / (1e0 - score))"
RANKED = PRED + ", g AS (SELECT run, score, sum(target)::DOUBLE AS p, sum(1 - target)::DOUBLE AS q FROM pred GROUP BY run, score), c AS (SELECT *, sum(p) OVER v AS tp, sum(q) OVER v AS fp FROM g WINDOW v AS (PARTITION BY run ORDER BY score DESC)), t AS (SELECT run, sum(p) AS pp, sum(q) AS nn FROM g GROUP BY run)"
MCC = "(tp * (nn - fp) - fp * (pp - tp)) / (sqrt(tp + fp) * sqrt(pp) * sqrt(nn) * sqrt(pp - tp + nn - fp))"


def r6(**cols):
    return [F.round(F.col(c) if isinstance(c, str) else c, 6).alias(n) for n, c in cols.items()]


@query(f"WITH {PRED} SELECT p.run, round(sum(CASE WHEN p.score > q.score THEN 1 WHEN p.score = q.score THEN 0.5e0 ELSE 0 END) / count(*), 6) AS auroc FROM pred p JOIN pred q ON p.run = q.run AND p.target = 1 AND q.target = 0 GROUP BY p.run")
def auroc(spark, d):
    """M1."""
    return M.auroc(preds(spark, d), ["run"]).select("run", *r6(auroc="auroc"))


@query(f"WITH {PRED}, w AS (SELECT *, 1e0 + (entity_idx % 3) AS w FROM pred) SELECT p.run, round(sum(p.w * q.w * CASE WHEN p.score > q.score THEN 1 WHEN p.score = q.score THEN 0.5e0 ELSE 0 END) / sum(p.w * q.w), 6) AS auroc FROM w p JOIN w q ON p.run = q.run AND p.target = 1 AND q.target = 0 GROUP BY p.run")
def weighted_auroc(spark, d):
    """M1 with weights."""
    return M.auroc(preds(spark, d).withColumn("w", 1.0 + F.col("entity_idx") % 3), ["run"], weight="w").select("run", *r6(auroc="auroc"))


@query(f"WITH {RANKED} SELECT c.run, round(sum(p * tp / (tp + fp)) / sum(p), 6) AS auprc FROM c GROUP BY c.run")
def average_precision(spark, d):
    """M2."""
    return M.average_precision(preds(spark, d), ["run"]).select("run", *r6(auprc="auprc"))


@query(
    f"WITH {PRED}, k AS (SELECT run, count(*) FILTER (score >= 0.5 AND target = 1)::DOUBLE AS tp, count(*) FILTER (score >= 0.5 AND target = 0)::DOUBLE AS fp, count(*) FILTER (score < 0.5 AND target = 1)::DOUBLE AS fn, count(*) FILTER (score < 0.5 AND target = 0)::DOUBLE AS tn FROM pred GROUP BY run) "
    "SELECT run, tp, fp, fn, tn, round(CASE WHEN (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn) > 0 THEN (tp*tn - fp*fn) / sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)) ELSE 0 END, 6) AS mcc, round(2*tp/(2*tp+fp+fn), 6) AS f1, round((tp/(tp+fn) + tn/(tn+fp))/2, 6) AS balanced_accuracy FROM k"
)
def confusion_metrics(spark, d):
    """M3, M4."""
    return M.confusion(preds(spark, d), ["run"]).select("run", "tp", "fp", "fn", "tn", *r6(mcc="mcc", f1="f1", balanced_accuracy="balanced_accuracy"))


@query(f"WITH {PRED} SELECT run, round(avg((score - target) * (score - target)), 6) AS brier FROM pred GROUP BY run")
def brier(spark, d):
    """M5."""
    return M.brier(preds(spark, d), ["run"]).select("run", *r6(brier="brier"))


@query(
    f"WITH {PRED}, b AS (SELECT run, score, target, " + " + ".join(f"(score >= {k} / 10e0)::INT" for k in range(1, 10)) + " AS bin FROM pred), "
    "g AS (SELECT run, bin, count(*) AS m, sum(score) AS s, sum(target) AS t FROM b GROUP BY run, bin) SELECT run, round(sum(abs(s - t)) / sum(m), 6) AS ece FROM g GROUP BY run"
)
def ece(spark, d):
    """M6."""
    return M.ece(preds(spark, d), ["run"]).select("run", *r6(ece="ece"))


@query(
    f"WITH {PRED}, k AS (SELECT run, y, score, rank() OVER (PARTITION BY run ORDER BY y) + (count(*) OVER (PARTITION BY run, y) - 1) / 2e0 AS ry, rank() OVER (PARTITION BY run ORDER BY score) + (count(*) OVER (PARTITION BY run, score) - 1) / 2e0 AS rs FROM pred) "
    "SELECT run, count(*) AS n, round(corr(y, score), 6) AS pearson, round(corr(ry, rs), 6) AS spearman, round(sqrt(avg((score - y) * (score - y))), 6) AS rmse, round(avg(abs(score - y)), 6) AS mae FROM k GROUP BY run"
)
def regression_metrics(spark, d):
    """M7."""
    return M.regression(preds(spark, d), ["run"], "y").select("run", "n", *r6(pearson="pearson", spearman="spearman", rmse="rmse", mae="mae"))


@query(
    f"WITH {OBS}, e AS (SELECT source, h, avg(n * 1e0) AS x, avg(quality * 1e0) AS t, count(*) AS k FROM obs GROUP BY source, h) SELECT source, count(*) AS entities, round(covar_pop(x, t) / nullif(stddev_pop(x) * stddev_pop(t), 0), 6) AS pearson, round(avg(t), 6) AS macro_mean FROM e GROUP BY source"
)
def entity_macro(spark, d):
    """Entities weigh the same, whatever their number of observations."""
    e = obs(spark, d).groupBy("source", "h").agg(F.avg("n").alias("x"), F.avg("quality").alias("t"))
    return e.groupBy("source").agg(F.count("*").alias("entities"), F.round(M.corr("x", "t"), 6).alias("pearson"), F.round(F.avg("t"), 6).alias("macro_mean"))


@query(
    f"WITH {RANKED}, a AS (SELECT run, sum(p * (nn0 - fp + q / 2)) / (sum(p) * sum(q)) AS auroc FROM (SELECT c.*, t.nn AS nn0 FROM c JOIN t USING (run)) GROUP BY run) SELECT round(avg(1 - auroc), 6) AS balanced_objective FROM a"
)
def balanced_objective(spark, d):
    """M9: mean of 1 - AUROC over the runs as tasks."""
    return M.auroc(preds(spark, d), ["run"]).agg(F.round(F.avg(1 - F.col("auroc")), 6).alias("balanced_objective"))


@query(
    f"WITH {PRED}, p AS (SELECT pred.*, obs.n FROM pred JOIN obs ON obs.doc_id = pred.entity_idx WHERE run = 'r0'), e AS (SELECT quantile_cont(n, [0, 0.25, 0.5, 0.75, 1]) AS q FROM p), "
    "b AS (SELECT p.*, 1 + (n >= q[2])::INT + (n >= q[3])::INT + (n >= q[4])::INT AS quartile FROM p, e), "
    "x AS (SELECT a.quartile, sum(CASE WHEN a.score > z.score THEN 1 WHEN a.score = z.score THEN 0.5e0 ELSE 0 END) / count(*) AS auroc FROM b a JOIN b z ON a.quartile = z.quartile AND a.target = 1 AND z.target = 0 GROUP BY a.quartile) "
    "SELECT b.quartile, count(*) AS n, round(avg(target), 6) AS positive_fraction, round(any_value(auroc), 6) AS auroc FROM b LEFT JOIN x ON b.quartile = x.quartile GROUP BY b.quartile"
)
def subgroup_quartile_auroc(spark, d):
    """Quartile bins by interpolated edges, the last closed."""
    p = preds(spark, d, ["r0"]).join(obs(spark, d).select(F.col("doc_id").alias("entity_idx"), "n"), "entity_idx")
    e = p.agg(F.percentile("n", [0.25, 0.5, 0.75]).alias("q"))
    b = p.crossJoin(F.broadcast(e)).withColumn("quartile", 1 + sum((F.col("n") >= F.col("q")[k]).cast("int") for k in range(3)))  # one row
    a = M.auroc(b, ["quartile"])
    return b.groupBy("quartile").agg(F.count("*").alias("n"), F.round(F.avg("target"), 6).alias("positive_fraction")).join(a, "quartile", "left").select("quartile", "n", "positive_fraction", *r6(auroc="auroc"))


GATE = PRED + ", w AS (SELECT entity_idx, run, exp(score * 4) / sum(exp(score * 4)) OVER (PARTITION BY entity_idx) AS w FROM pred)"


@query(
    f"WITH {GATE}, m AS (SELECT entity_idx, max(w) AS top FROM w GROUP BY entity_idx), a AS (SELECT w.entity_idx, min(run) AS win FROM w JOIN m ON w.entity_idx = m.entity_idx AND w.w = m.top GROUP BY w.entity_idx), n AS (SELECT count(*) AS n FROM m), "
    "h AS (SELECT avg(e) AS e FROM (SELECT entity_idx, -sum(w * ln(w)) AS e FROM w GROUP BY entity_idx)) SELECT w.run, round(avg(w), 6) AS mean_weight, round(stddev_pop(w), 6) AS std_weight, round((SELECT count(*) FROM a WHERE win = w.run) / (SELECT n FROM n), 6) AS argmax_fraction, round(exp((SELECT e FROM h)), 6) AS effective_experts FROM w GROUP BY w.run"
)
def gate_utilisation(spark, d):
    """Softmax gates of the runs as experts."""
    from quern.operators.features import softmax

    w = softmax(preds(spark, d).withColumn("z", F.col("score") * 4), ["entity_idx"], "z")
    win = w.groupBy("entity_idx").agg(F.min_by("run", F.struct(-F.col("weight"), "run")).alias("run"), F.sum(-F.col("weight") * F.log("weight")).alias("e"))
    total = win.agg(F.count("*").alias("n"), F.avg("e").alias("e"))
    share = win.groupBy("run").agg(F.count("*").alias("k"))
    g = w.groupBy("run").agg(F.avg("weight").alias("m"), F.stddev_pop("weight").alias("s")).join(share, "run", "left").crossJoin(F.broadcast(total))  # one row
    return g.select("run", *r6(mean_weight="m", std_weight="s", argmax_fraction=F.coalesce("k", F.lit(0)) / F.col("n"), effective_experts=F.exp("e")))


@query(f"WITH {RANKED} SELECT run, round(max(mcc), 6) AS mcc, max(score) FILTER (round(mcc, 12) = top) AS threshold FROM (SELECT *, max(round(mcc, 12)) OVER (PARTITION BY run) AS top FROM (SELECT c.*, CASE WHEN pp - tp + nn - fp > 0 THEN {MCC} ELSE 0 END AS mcc FROM c JOIN t USING (run))) GROUP BY run")
def best_mcc_threshold(spark, d):
    """Q6, W6."""
    return M.best_mcc(preds(spark, d), ["run"]).select("run", *r6(mcc="mcc"), "threshold")


@query(f"WITH {RANKED} SELECT run, score, tp, fp FROM c")
def cumulative_counts(spark, d):
    """Cumulative true and false positives at the last row of each tie group."""
    from quern.operators.prefix import running_sums

    g = M._grid(preds(spark, d), ["run"], "target", "score", None)
    return running_sums(g, ["run"], "s", {"tp": "p", "fp": "n"}, descending=True).select("run", F.col("s").alias("score"), "tp", "fp")


@query(f"WITH {PRED} SELECT run, entity_idx, rank() OVER (PARTITION BY run ORDER BY score) + (count(*) OVER (PARTITION BY run, score) - 1) / 2e0 AS rank_score FROM pred")
def average_ranks(spark, d):
    """W5."""
    return M.mid_ranks(preds(spark, d), ["run"], ["score"]).select("run", "entity_idx", "rank_score")


SUBSETS = PRED + ", s AS (SELECT m AS subset, 'r' || k AS run FROM range(1, 16) x(m), range(0, 4) y(k) WHERE (m >> k) & 1 = 1), e AS (SELECT subset::INT AS subset, entity_idx, any_value(target) AS target, avg(score) AS score FROM pred JOIN s USING (run) GROUP BY subset, entity_idx)"


@query(f"WITH {SUBSETS} SELECT p.subset, round(sum(CASE WHEN round(p.score, 12) > round(q.score, 12) THEN 1 WHEN round(p.score, 12) = round(q.score, 12) THEN 0.5e0 ELSE 0 END) / count(*), 6) AS auroc FROM e p JOIN e q ON p.subset = q.subset AND p.target = 1 AND q.target = 0 GROUP BY p.subset")
def ensemble_subsets(spark, d):
    """Every subset's mean score, ranked by AUROC."""
    m = E.subset_means(preds(spark, d), list(RUNS)).withColumn("score", F.round("score", 12))
    return M.auroc(m, ["subset"]).select("subset", *r6(auroc="auroc")).orderBy(F.desc("auroc"))


@query(f"WITH {PRED}, s AS (SELECT m AS subset, 'r' || k AS run FROM range(1, 16) x(m), range(0, 4) y(k) WHERE (m >> k) & 1 = 1), e AS (SELECT subset::INT AS subset, entity_idx, any_value(y) AS y, avg(score) AS score FROM pred JOIN s USING (run) GROUP BY subset, entity_idx) SELECT subset, round(regr_slope(y, score), 6) AS slope, round(regr_intercept(y, score), 6) AS intercept FROM e GROUP BY subset")
def affine_recalibration(spark, d):
    """E2, Q8."""
    m = E.subset_means(preds(spark, d).withColumn("target", F.col("y")), list(RUNS))
    return Q.affine(m, ["subset"]).select("subset", *r6(slope="slope", intercept="intercept"))


BLEND = PRED + ", b AS (SELECT entity_idx, target, score FROM pred WHERE run = 'r0'), p AS (SELECT entity_idx, score FROM pred WHERE run = 'r1' AND entity_idx % 3 <> 0), g AS (SELECT k, k / 100e0 AS alpha FROM range(0, 101) t(k)), e AS (SELECT alpha, b.entity_idx, target, coalesce((1 - alpha) * b.score + alpha * p.score, b.score) AS score FROM b LEFT JOIN p ON b.entity_idx = p.entity_idx, g)"


@query(f"WITH {BLEND} SELECT round(alpha, 6) AS alpha, round(avg((score - target) * (score - target)), 6) AS brier FROM e GROUP BY alpha")
def blend_grid(spark, d):
    """Partial coverage with fallback, over a grid of shares."""
    p = preds(spark, d)
    part = p.where("run = 'r1' and entity_idx % 3 <> 0")
    g = E.partial_blend(p.where("run = 'r0'").select("entity_idx", "target", "score"), part, [k / 100 for k in range(101)])
    return M.brier(g, ["alpha"]).select(*r6(alpha="alpha", brier="brier"))


@query(f"WITH {PRED}, w AS (SELECT entity_idx, any_value(y) AS y, max(score) FILTER (run = 'r0') AS a, max(score) FILTER (run = 'r1') AS b FROM pred GROUP BY entity_idx), g AS (SELECT k::INT AS point, k / 1000e0 AS v FROM range(0, 1001) t(k)) SELECT point, round(corr(y, (1 - v) * a + v * b), 6) AS pearson FROM w, g GROUP BY point")
def line_search(spark, d):
    """1001 blends of two runs."""
    wide = E.pivot_runs(preds(spark, d).withColumn("target", F.col("y")), list(RUNS))
    g = E.grid_quality(wide, ["r0", "r1"], [[1 - k / 1000, k / 1000] for k in range(1001)])
    return g.select("point", F.round("pearson", 6).alias("pearson"))


@query(
    f"WITH {PRED}, w AS (SELECT entity_idx, any_value(target) AS y, max(score) FILTER (run = 'r0') AS a, max(score) FILTER (run = 'r1') AS b, max(score) FILTER (run = 'r3') AS c FROM pred GROUP BY entity_idx), "
    "g AS (SELECT (i * 101 + j)::INT AS point, i / 100e0 AS u, (1 - i / 100e0) * (j / 100e0) AS v FROM range(0, 101) x(i), range(0, 101) z(j)) SELECT point, round(avg(pow((1 - u - v) * a + u * b + v * c - y, 2)), 6) AS brier FROM w, g GROUP BY point"
)
def simplex_grid(spark, d):
    """E5: a grid over two weights, the second within what the first leaves."""
    wide = E.pivot_runs(preds(spark, d), list(RUNS))
    points = [[1 - u - v, u, v] for u, v in E.simplex_grid(101)]
    return E.grid_quality(wide, ["r0", "r1", "r3"], points).select("point", *r6(brier="brier"))


@query()
def coordinate_ascent_auroc(spark, d):
    """Weights of three candidates on a base run."""
    wide = Scratch(spark).write(E.pivot_runs(preds(spark, d), list(RUNS)), "wide")
    w, best = E.coordinate_ascent(wide, "r2", ["r0", "r1", "r3"], "auroc", np.linspace(0, 0.5, 11), cap=0.75, sweeps=2)
    return spark.createDataFrame([(*w, best)], "r0 double, r1 double, r3 double, auroc double")


@query()
def coordinate_ascent_residual(spark, d):
    """Additive residuals of candidates that cover a part."""
    wide = E.pivot_runs(preds(spark, d).withColumn("target", F.col("y")), list(RUNS))
    wide = Scratch(spark).write(wide.withColumn("r1", F.when(F.col("entity_idx") % 3 != 0, F.col("r1")).otherwise(F.col("r2"))), "wide")
    w, best = E.coordinate_ascent(wide, "r2", ["r1", "r3"], "pearson", np.linspace(0, 0.3, 11), mode="residual", sweeps=2)
    return spark.createDataFrame([(*w, best)], "r1 double, r3 double, pearson double")


@query()
def simplex_weights(spark, d):
    """Weights on the simplex by log loss with a ridge to the even blend."""
    wide = E.pivot_runs(preds(spark, d).withColumn("score", logit(F.col("score"))), list(RUNS))
    w = E.simplex_weights(wide, list(RUNS), rounds=25)
    return spark.createDataFrame([tuple(float(x) for x in w)], ", ".join(f"{r} double" for r in RUNS))


@query(f"WITH {PRED} SELECT entity_idx, any_value(target) AS target, round(sum(score * CASE run WHEN 'r0' THEN 0.6e0 * 0.9e0 WHEN 'r1' THEN 0.4e0 * 0.9e0 ELSE 0.1e0 END), 6) AS score FROM pred WHERE run <> 'r3' GROUP BY entity_idx")
def recursive_blend(spark, d):
    """A base report expanded to run weights, its candidate added."""
    w = E.expand_report({"base": {"run_weights": {"r0": 0.6, "r1": 0.4}}, "base_weight": 0.9, "candidate_weights": {"r2": 0.1}})
    return E.weighted(preds(spark, d), w, normalise=False).select("entity_idx", "target", *r6(score="score"))


@query(f"WITH {PRED}, w AS (SELECT entity_idx, any_value(target) AS target, 0.6e0 * max(score) FILTER (run = 'r0') + 0.4e0 * max(score) FILTER (run = 'r1') AS b, max(score) FILTER (run = 'r3' AND entity_idx % 2 = 0) AS c FROM pred GROUP BY entity_idx) SELECT entity_idx, target, round(b + coalesce(0.25e0 * (c - b), 0), 6) AS score FROM w")
def frozen_reconstruction(spark, d):
    """Leaf runs blended, and a residual candidate that covers half of the entities."""
    p = preds(spark, d).where("run <> 'r3' or entity_idx % 2 = 0")
    report = {"blend": [({"run": "r0"}, 0.6), ({"run": "r1"}, 0.4)], "candidates": {"r3": 0.25}}
    return E.reconstruct(report, p).select("entity_idx", "target", *r6(score="score"))


@query(f"WITH {PRED}, p AS (SELECT * FROM pred WHERE run <> 'r1' OR entity_idx % 5 <> 0) SELECT run, entity_idx, score FROM p WHERE entity_idx IN (SELECT entity_idx FROM p GROUP BY entity_idx HAVING count(DISTINCT run) = 4)")
def common_entities(spark, d):
    """Entities that all runs have."""
    return E.common_entities(preds(spark, d).where("run <> 'r1' or entity_idx % 5 <> 0")).select("run", "entity_idx", "score")


@query(f"WITH {PRED}, p AS (SELECT * FROM pred WHERE run <> 'r1' OR entity_idx % 5 <> 0) SELECT entity_idx, count(DISTINCT run) AS k FROM p GROUP BY entity_idx HAVING count(DISTINCT run) < 4 OR max(target) <> min(target)")
def misaligned_entities(spark, d):
    """What an alignment would refuse."""
    return E.misaligned(preds(spark, d).where("run <> 'r1' or entity_idx % 5 <> 0")).select("entity_idx", "k")


@query(f"WITH {PRED} SELECT entity_idx, score, row_number() OVER (ORDER BY entity_idx DESC) - 1 AS position FROM pred WHERE run = 'r0'")
def export_candidates(spark, d):
    """One task's rows in a reference's order, fully covered."""
    p = preds(spark, d, ["r0"])
    ref = running_sums(p.select("entity_idx", F.lit(1).alias("one")), [], "entity_idx", {"upto": "one"}, descending=True).select("entity_idx", (F.col("upto") - 1).cast("long").alias("position"))  # the reference's positions are given
    return E.reindex(p.select("entity_idx", "score"), ref, "entity_idx", "position").select("entity_idx", "score", "position")


@query(f"WITH {PRED}, g AS (SELECT k, exp(-3 + 6 * k / 40e0) AS temperature FROM range(0, 41) t(k)), z AS (SELECT target, {LOGIT} AS x FROM pred WHERE run = 'r0') SELECT round(temperature, 6) AS temperature, round(avg(greatest(x / temperature, 0) + ln(1 + exp(-abs(x / temperature))) - x / temperature * target), 6) AS nll FROM z, g GROUP BY temperature")
def temperature_grid(spark, d):
    """Q1 over a fixed grid."""
    import math

    z = preds(spark, d, ["r0"]).withColumn("score", F.log(F.col("score") / (1 - F.col("score"))))
    return Q.nll_grid(z, [math.exp(-3 + 6 * k / 40) for k in range(41)]).select(*r6(temperature="temperature", nll="nll"))


@query()
def calibration_fits(spark, d):
    """Q1, Q2, Q3: temperature, Platt and beta parameters of one run."""
    z = Scratch(spark).write(preds(spark, d, ["r0"]).withColumn("score", F.log(F.col("score") / (1 - F.col("score")))), "logits")
    rows = [("temperature", [Q.fit_temperature(z)]), ("platt", list(Q.fit_platt(z))), ("beta", list(Q.fit_beta(z)))]
    return spark.createDataFrame(rows, "method string, parameters array<double>")


@query()
def isotonic_calibration(spark, d):
    """Q4: isotonic fit by MLlib, applied as a column and as a clipped logit."""
    p = Scratch(spark).write(preds(spark, d, ["r0"]), "scores")
    k, v = Q.fit_isotonic(p)
    return p.select("entity_idx", "target", "score", *r6(calibrated=Q.apply_isotonic(F.col("score"), k, v), logit=Q.isotonic_logit(F.col("score"), k, v)))


@query(f"WITH {PRED} SELECT entity_idx, ((row_number() OVER (PARTITION BY target ORDER BY sha256('20260830:' || entity_idx::VARCHAR)) - 1) % 5)::INT AS fold FROM pred WHERE run = 'r0'")
def stratified_folds(spark, d):
    """Q5: deterministic stratified folds."""
    return Q.folds(preds(spark, d, ["r0"])).select("entity_idx", "fold")


@query()
def crossfit_platt(spark, d):
    """Q5: out-of-fold Platt scores."""
    z = preds(spark, d, ["r0"]).withColumn("score", logit(F.col("score")))
    return Q.crossfit_platt(z).select("entity_idx", "fold", *r6(out_of_fold="out_of_fold"))


@query(f"WITH {PRED}, p AS (SELECT target, score FROM pred WHERE run = 'r0'), g AS (SELECT DISTINCT unnest(quantile_cont(score, [k / 2000e0 for k in range(0, 2001)])) AS threshold FROM p), k AS (SELECT threshold, count(*) FILTER (score >= threshold AND target = 1)::DOUBLE AS tp, count(*) FILTER (score >= threshold AND target = 0)::DOUBLE AS fp, count(*) FILTER (target = 1)::DOUBLE AS pp, count(*) FILTER (target = 0)::DOUBLE AS nn FROM p, g GROUP BY threshold), m AS (SELECT threshold, CASE WHEN pp - tp + nn - fp > 0 THEN {MCC} ELSE 0 END AS mcc FROM k) SELECT round(threshold, 6) AS threshold, round(mcc, 6) AS mcc FROM m ORDER BY round(mcc, 12) DESC, threshold LIMIT 1")
def quantile_mcc_threshold(spark, d):
    """Q7: the best of 2,001 quantiles."""
    return Q.quantile_threshold_mcc(preds(spark, d, ["r0"]), 2001).select(*r6(threshold="threshold", mcc="mcc"))


@query(f"WITH {LONG}, k AS (SELECT endpoint, h, count(*) AS k FROM long GROUP BY endpoint, h), t AS (SELECT endpoint, count(*) AS e FROM k GROUP BY endpoint) SELECT doc_id, endpoint, round(1e0 / (k.k * t.e), 9) AS weight, round(1e0 / (k.k * t.e * 2), 9) AS source_weight FROM long JOIN k USING (endpoint, h) JOIN t USING (endpoint)")
def sampling_weights(spark, d):
    """N1, N2."""
    o = long_obs(spark, d)
    a = S.task_entity_weights(o, "endpoint", "h").select("doc_id", "endpoint", F.round("weight", 9).alias("weight"))
    b = S.source_weights(o, "endpoint", "h", 2).select("doc_id", "endpoint", F.round("weight", 9).alias("source_weight"))
    return a.join(b, ["doc_id", "endpoint"])


@query(f"WITH {OBS}, k AS (SELECT h, count(*) AS k FROM obs GROUP BY h), m AS (SELECT obs.*, 1e0 / k AS m FROM obs JOIN k USING (h)), c AS (SELECT quality, sum(m) AS c, count(*) AS q FROM m GROUP BY quality) SELECT doc_id, round(m / c, 9) AS entity_weight, round(1e0 / q, 9) AS class_weight FROM m JOIN c USING (quality)")
def class_weights(spark, d):
    """N3, N4."""
    o = obs(spark, d)
    a = S.class_entity_weights(o, "quality", "h").select("doc_id", F.round("weight", 9).alias("entity_weight"))
    return a.join(S.inverse_class_weights(o, "quality").select("doc_id", F.round("weight", 9).alias("class_weight")), "doc_id")


def bits(text: str) -> str:
    """SQL of sampling.drawn over a text expression."""
    return f"('0x' || substr(md5({text}), 1, 13))::BIGINT"


def length_batches_sql(rows: str, size: int, pool: int, seed: int, shards: int) -> str:
    return (
        f"b AS (SELECT doc_id, n, {bits(f"'{seed}:shard:' || doc_id")} % {shards} AS shard, {bits(f"'{seed}:' || doc_id")} AS u FROM {rows}), "
        f"p AS (SELECT *, (row_number() OVER (PARTITION BY shard ORDER BY u, doc_id) - 1) // {size * pool} AS pool FROM b) "
        f"SELECT doc_id, n, shard::INT AS shard, pool * {pool} + (row_number() OVER (PARTITION BY shard, pool ORDER BY n, doc_id) - 1) // {size} AS batch FROM p"
    )


CLASS = "w AS (SELECT doc_id, n, 1e0 / count(*) OVER (PARTITION BY quality) AS weight FROM obs)"
UNIFORM = f"({bits("'7:' || doc_id")} + 0.5e0) / 4503599627370496e0"


@query(f"WITH {OBS}, {CLASS}, s AS (SELECT doc_id, n FROM w ORDER BY -ln({UNIFORM}) / weight, doc_id LIMIT 200), " + length_batches_sql("s", 8, 20, 7, 4))
def weighted_sampling(spark, d):
    """A weighted sample without replacement, in batches sorted by length."""
    o = S.inverse_class_weights(obs(spark, d), "quality")
    return S.length_batches(S.weighted_sample(o, "weight", 200, 7, "doc_id"), "n", 8, 20, 7, "doc_id", 4).select("doc_id", "n", "shard", "batch")


@query(
    f"WITH {OBS}, {CLASS}, m AS (SELECT doc_id, {UNIFORM} AS u, weight / sum(weight) OVER () * 300 AS m FROM w), "
    "c AS (SELECT doc_id, u, k, sum(exp(-m) * pow(m, k) / factorial(k::INT)) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM m, range(0, 30) t(k)) SELECT doc_id, (k + 1)::INT AS draw FROM c WHERE u > upto"
)
def resampling(spark, d):
    """N5 with replacement, by Poisson counts."""
    o = S.inverse_class_weights(obs(spark, d), "quality")
    return S.poisson_resample(o, "weight", 300, 7, "doc_id").select("doc_id", "draw")


@query(f"WITH {OBS}, " + length_batches_sql("obs", 16, 10, 1, 4))
def permuted_batches(spark, d):
    """A uniform permutation, bucketed by length."""
    return S.length_batches(obs(spark, d), "n", 16, 10, 1, "doc_id", 4).select("doc_id", "n", "shard", "batch")


@query(f"WITH {PRED}, t AS (SELECT CASE WHEN run = 'r3' THEN 'regression' ELSE run END AS task, score AS s, CASE WHEN run = 'r3' THEN y ELSE target END AS t FROM pred), l AS (SELECT task, avg(CASE WHEN task = 'regression' THEN CASE WHEN abs(s - t) < 0.1e0 THEN 0.5e0 * pow(s - t, 2) / 0.1e0 ELSE abs(s - t) - 0.05e0 END ELSE greatest(s, 0) + ln(1 + exp(-abs(s))) - s * t END) AS l FROM t GROUP BY task) SELECT round(avg(l), 6) AS loss FROM l")
def multitask_loss(spark, d):
    """Losses: Huber and log loss by task, averaged."""
    p = preds(spark, d).withColumns({"task": F.when(F.col("run") == "r3", "regression").otherwise(F.col("run")), "target": F.when(F.col("run") == "r3", F.col("y")).otherwise(F.col("target"))})
    return S.multitask_loss(p, beta=0.1).select(*r6(loss="loss"))


@query(f"WITH {PRED}, p AS (SELECT *, entity_idx % 8 AS batch FROM pred WHERE run = 'r0'), l AS (SELECT a.batch, greatest(0.1e0 - (a.score - b.score), 0) + ln(1 + exp(-abs(0.1e0 - (a.score - b.score)))) AS l FROM p a JOIN p b ON a.batch = b.batch AND a.target = 1 AND b.target = 0), k AS (SELECT batch, l, row_number() OVER (PARTITION BY batch ORDER BY l DESC) AS r, count(*) OVER (PARTITION BY batch) AS c FROM l) SELECT p.batch, coalesce(round(avg(l), 6), 0) AS loss, count(l) AS pairs FROM (SELECT DISTINCT batch FROM p) p LEFT JOIN (SELECT * FROM k WHERE r <= ceil(c * 0.5e0)) k ON k.batch = p.batch GROUP BY p.batch")
def rank_loss(spark, d):
    """Positive-negative pairs of a batch, the hardest half."""
    p = preds(spark, d, ["r0"]).withColumn("batch", F.col("entity_idx") % 8)
    return S.binary_rank_loss(p, ["batch"], hard=0.5, margin=0.1).select("batch", *r6(loss="loss"), "pairs")


@query(f"WITH {PRED}, p AS (SELECT *, entity_idx % 8 AS batch FROM pred WHERE run = 'r0') SELECT a.batch, round(avg(greatest(-sign(a.y - b.y) * (a.score - b.score), 0) + ln(1 + exp(-abs(a.score - b.score)))), 6) AS loss, count(*) AS pairs FROM p a JOIN p b ON a.batch = b.batch AND a.entity_idx < b.entity_idx AND abs(a.y - b.y) > 0.02 GROUP BY a.batch")
def regression_rank_loss(spark, d):
    """Pairs of a batch whose targets differ by more than 0.02."""
    p = preds(spark, d, ["r0"]).withColumns({"batch": F.col("entity_idx") % 8, "target": F.col("y")})
    return S.regression_rank_loss(p, ["batch"], "entity_idx").select("batch", *r6(loss="loss"), "pairs")


@query(f"WITH {PRED} SELECT run, entity_idx, round(1 / (1 + exp(-score)), 6) AS sigmoid, round({LOGIT}, 6) AS logit, round(ln(1 + exp(score)), 6) AS softplus, round(ln(1 + exp(score)) - score * target, 6) AS bce, round(CASE WHEN abs(score - y) < 1 THEN 0.5e0 * pow(score - y, 2) ELSE abs(score - y) - 0.5e0 END, 6) AS huber, round(target * 0.9e0 + 0.05e0, 6) AS smoothed FROM pred")
def scalar_losses(spark, d):
    """Section 2.9 and losses: pointwise expressions."""
    from quern.functions.scalar import sigmoid

    s, t = F.col("score"), F.col("target")
    return preds(spark, d).select("run", "entity_idx", *r6(sigmoid=sigmoid(s), logit=logit(s), softplus=softplus(s), bce=bce_with_logits(s, t), huber=smooth_l1(s, F.col("y")), smoothed=smoothed_label(t, 0.1)))


@query(f"WITH {PRED} SELECT entity_idx, " + ", ".join(f"round(exp(-pow((score * 20e0 - {k} * (20e0 / 15)) / (20e0 / 15), 2)), 6) AS rbf_{k}" for k in range(16)) + " FROM pred WHERE run = 'r0'")
def radial_basis(spark, d):
    """16 centres over 0 to 20."""
    return preds(spark, d, ["r0"]).select("entity_idx", *r6(**{f"rbf_{k}": c for k, c in enumerate(rbf(F.col("score") * 20, 0, 20, 16))}))


@query("SELECT n_nationkey::BIGINT AS pos, " + ", ".join(f"round({'sin' if k % 2 == 0 else 'cos'}(n_nationkey * exp(-ln(10000e0) * {2 * (k // 2)} / 8)), 6) AS c{k}" for k in range(8)) + " FROM nation")
def position_encoding(spark, d):
    """Sinusoidal positions."""
    from quern.plans.fixtures import table

    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("pos"), *r6(**{f"c{k}": c for k, c in enumerate(sinusoid(F.col("n_nationkey").cast("double"), 8))}))


@query(
    f"WITH {PRED}, c AS (SELECT sum(exp(-1e0) / factorial(k::INT)) OVER (ORDER BY k) AS upto FROM range(0, 8) t(k)), u AS (SELECT r, score, ({bits("'1:' || entity_idx || ':' || r")} + 0.5e0) / 4503599627370496e0 AS u FROM pred, range(1, 201) t(r) WHERE run = 'r0'), "
    "w AS (SELECT r, score, (SELECT count(*) FROM c WHERE u > upto) AS w FROM u), m AS (SELECT sum(score * w) / sum(w) AS m FROM w WHERE w > 0 GROUP BY r) SELECT round(quantile_cont(m, 0.025), 6) AS low, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.975), 6) AS high FROM m"
)
def bootstrap_interval(spark, d):
    """Poisson bootstrap of a mean."""
    return S.bootstrap(preds(spark, d, ["r0"]), "score", "entity_idx").select(*r6(low="low", mean="mean", high="high"))


@query(f"WITH {PRED} SELECT run, entity_idx, pred.score, obs.source FROM pred JOIN obs ON obs.doc_id = pred.entity_idx")
def checked_lookup(spark, d):
    """An inner join in which a missing key is an error."""
    o = obs(spark, d).select(F.col("doc_id").alias("entity_idx"), "source")
    return checked_join(preds(spark, d), o, "entity_idx").select("run", "entity_idx", "score", "source")
