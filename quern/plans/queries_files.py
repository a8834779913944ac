"""Queries that write files and read them back, of runs, and of selections and reports."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quern.functions import metrics as M
from quern.operators import calibrate as Q
from quern.operators import ensemble as E
from quern.operators import features, manifest, resume
from quern.plans.fixtures import PRED, RES, RUNS, obs, preds, residues, table
from quern.plans.queries_metrics import MCC, RANKED, SUBSETS, r6
from quern.plans.queries_relational import UNION, union
from quern.plans.scratch import Scratch
from quern.registry import query
from quern.sources import readers, sinks


@query(f"WITH {UNION} SELECT row_number() OVER (ORDER BY sequence_sha256) - 1 AS entity_idx, printf('entity:%06d', row_number() OVER (ORDER BY sequence_sha256)) AS entity_id, sequence_sha256, any_value(sequence) AS sequence, any_value(length(sequence)) AS length FROM u WHERE sequence IS NOT NULL GROUP BY sequence_sha256")
def manifest_files(spark, d):
    """Three CSV sources united, hashes checked, entities numbered, written as CSV and read back."""
    base = Scratch(spark).base
    u, parts = union(spark, d).where("sequence is not null"), []
    for endpoint in ("quality", "toxic", "length"):
        sinks.write_csv(u.where(F.col("endpoint") == endpoint), f"{base}/{endpoint}", manifest.OBSERVATION)
        parts.append(readers.read_csv(spark, f"{base}/{endpoint}", manifest.OBSERVATION).withColumn("target_value", F.col("target_value").cast("double")))
    o = manifest.union_observations(parts)
    manifest.require_empty(manifest.hash_violations(o, F.sha2("sequence", 256)), "manifest")
    fields = ["entity_idx", "entity_id", "sequence_sha256", "sequence", "length"]
    sinks.write_csv(manifest.entities(o), f"{base}/entities", fields)
    out = readers.read_csv(spark, f"{base}/entities", fields)
    return out.withColumns({c: F.col(c).cast("long") for c in ("entity_idx", "length")})


@query("SELECT p_partkey::VARCHAR AS name, p_brand AS sequence, (p_size % 2)::VARCHAR AS label, CASE p_partkey % 10 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM part")
def split_files(spark, d):
    """Train, validation and test files under one schema; a name that occurs twice would be an error."""
    base = Scratch(spark).base
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("name"), F.col("p_brand").alias("sequence"), (F.col("p_size") % 2).alias("label"), (F.col("p_partkey") % 10).alias("k"))
    where = {"validation": "k = 0", "test": "k = 1", "train": "k > 1"}
    for split, rows in where.items():
        sinks.write_csv(p.where(rows), f"{base}/{split}", ["name", "sequence", "label"])
    return readers.read_splits(spark, {s: f"{base}/{s}" for s in where}, ["name", "sequence", "label"], "name")


@query("SELECT p_partkey::VARCHAR || ' ' || p_name AS name, (p_size % 2)::VARCHAR AS label, replace(p_brand || lower(p_type), ' ', '') AS sequence FROM part")
def fasta_files(spark, d):
    """S3, F2: compressed FASTA files, letters as they are, headers decoded."""
    path = Scratch(spark).base + "/records"
    record = F.concat(F.lit(">"), F.col("p_partkey").cast("string"), F.lit(" "), "p_name", F.lit(" A-"), (F.col("p_size") % 2).cast("string"), F.lit("\n"), "p_brand", F.lit("\n\n"), F.lower("p_type"))
    table(spark, d, "part").select(record.alias("value")).write.option("compression", "gzip").text(path)
    r = readers.read_fasta_large(spark, path, upper=False)
    name, label = manifest.decode_header(F.col("header"))
    return r.select(name.alias("name"), label.alias("label"), "sequence")


@query("SELECT DISTINCT p_size::VARCHAR AS key, 1 AS status FROM part WHERE p_partkey % 3 = 2")
def listed_files(spark, d):
    """Files below a folder by a pattern on their names, one version of them only."""
    path = Scratch(spark).base + "/models"
    p = table(spark, d, "part").select("p_name", F.col("p_size").alias("accession"), (F.col("p_partkey") % 3 + 2).alias("version"))
    p.repartition("accession", "version").write.partitionBy("accession", "version").json(path)
    return readers.list_files(spark, path, r"accession=([^/]+)/version=4/", "*.json").select("key").distinct().withColumn("status", F.lit(1))


@query(f"WITH {PRED} SELECT run, entity_idx, target::DOUBLE AS target, score FROM pred WHERE run IN ('r0', 'r1')")
def prediction_files(spark, d):
    """Predictions under a task's path or its fallback, as logits or as predictions."""
    base, p = Scratch(spark).base, preds(spark, d, ["r0", "r1"])
    p.where("run = 'r0'").withColumnRenamed("score", "logits").write.parquet(f"{base}/r0/validation")
    p.where("run = 'r1'").withColumnRenamed("score", "predictions").write.parquet(f"{base}/r1/partial")
    r = [readers.read_predictions(spark, f"{base}/{x}/validation", f"{base}/{x}/partial") for x in ("r0", "r1")]
    return r[0].union(r[1])


@query("SELECT event_id, event_type, value FROM events")
def json_lines(spark, d):
    """K5: JSON lines appended in two turns."""
    path = Scratch(spark).base + "/lines"
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    sinks.append_jsonl(e.where("event_id % 2 = 0"), path)
    sinks.append_jsonl(e.where("event_id % 2 = 1"), path)
    return readers.read_json(spark, path, "event_id long, event_type string, value double", lines=True)


@query("SELECT r.run, x.key, CASE x.key WHEN 'lang' THEN r.lang WHEN 'seed' THEN '7' ELSE (SELECT count(*) FROM documents WHERE documents.lang = r.lang)::VARCHAR END AS value FROM (VALUES ('a', 'en'), ('b', 'fr')) r(run, lang), (VALUES ('lang'), ('seed'), ('rows')) x(key)")
def run_registry(spark, d):
    """Folders of runs with configuration and metrics as atomic JSON, read back as one table."""
    base, docs = Scratch(spark).base, table(spark, d, "documents")
    for run, lang in (("a", "en"), ("b", "fr")):
        config = {"lang": lang, "seed": 7}
        path = resume.start_run(spark, base, run, config)
        assert resume.start_run(spark, base, run, config) == path
        sinks.write_json(spark, f"{path}/metrics.json", {"rows": docs.where(F.col("lang") == lang).count()})
    return resume.read_runs(spark, base, "config").union(resume.read_runs(spark, base, "metrics"))


@query("SELECT n_name AS name, 'file://' || lower(n_name) AS url, n_nationkey::VARCHAR AS revision, sha256(n_name) AS sha256, 'public' AS licence FROM nation")
def source_catalogue(spark, d):
    """A pinned catalogue of sources; an incomplete entry would be an error."""
    path = Scratch(spark).base + "/catalogue"
    n = table(spark, d, "nation")
    c = n.select(F.col("n_name").alias("name"), F.concat(F.lit("file://"), F.lower("n_name")).alias("url"), F.col("n_nationkey").cast("string").alias("revision"), F.sha2("n_name", 256).alias("sha256"), F.lit("public").alias("licence"))
    sinks.append_jsonl(c, path)
    return readers.read_catalogue(spark, path)


@query("SELECT vec_id, n.name, n.row, round(CASE WHEN n.name = 'half' THEN list_sum(embedding[n.row * 32 + 1 : n.row * 32 + 32]::DOUBLE[]) ELSE list_sum(embedding::DOUBLE[]) END, 6) + 0 AS total FROM embeddings, (VALUES ('half', 0::BIGINT), ('half', 1), ('whole', 0)) n(name, row)")
def array_files(spark, d):
    """Arrays of archive files, one row for each index of the first axis."""
    def pack(batches):
        for pdf in batches:
            out = []
            for v in pdf["embedding"]:
                f = io.BytesIO()
                a = np.asarray(v, np.float32)
                np.savez_compressed(f, half=a.reshape(2, -1), whole=a[None, :])
                out.append(f.getvalue())
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "content": out})

    files = table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(pack, "vec_id long, content binary")
    r = readers.npy_rows(files, "vec_id", "content")
    return r.select("vec_id", "name", "row", (F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6) + 0).alias("total"))


@query("SELECT (event_id % 8)::INT AS shard, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def resumed_reduction(spark, d):
    """Shards written in two turns, those that are valid not again, and a reduction once all are there."""
    path = Scratch(spark).base + "/shards"
    e = table(spark, d, "events").select("event_id", "value", F.pmod("event_id", F.lit(8)).cast("int").alias("shard"))
    config = {"shards": 8}
    resume.run_shards(spark, path, config, [0, 1, 2], lambda todo: e.where(F.col("shard").isin(todo)))
    resume.run_shards(spark, path, config, list(range(8)), lambda todo: e.where(F.col("shard").isin(todo)))
    return resume.reduce_when_complete(spark, path, list(range(8)), lambda x: x.groupBy("shard").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")))


@query(f"WITH {PRED} SELECT DISTINCT run FROM pred WHERE run IN ('r0', 'r1') UNION SELECT DISTINCT run FROM pred WHERE run IN ('r1', 'r3')")
def run_names(spark, d):
    """U4: the union of the names of runs."""
    p = preds(spark, d).select("run")
    return p.where("run in ('r0', 'r1')").union(p.where("run in ('r1', 'r3')")).distinct()


AUC = "sum({w} * CASE WHEN p.score > q.score THEN 1 WHEN p.score = q.score THEN 0.5e0 ELSE 0 END) / sum({w})"
FOUND = (
    f"ranks AS (SELECT run, y, score, target, rank() OVER (PARTITION BY run ORDER BY y) + (count(*) OVER (PARTITION BY run, y) - 1) / 2e0 AS ry, rank() OVER (PARTITION BY run ORDER BY score) + (count(*) OVER (PARTITION BY run, score) - 1) / 2e0 AS rs FROM pred), "
    "pairs AS (SELECT p.run, " + AUC.format(w="1e0") + " AS auroc FROM pred p JOIN pred q ON p.run = q.run AND p.target = 1 AND q.target = 0 GROUP BY p.run), "
    f"cuts AS (SELECT c.run, sum(p * tp / (tp + fp)) / sum(p) AS auprc, max(CASE WHEN pp - tp + nn - fp > 0 THEN {MCC} ELSE 0 END) AS mcc FROM c JOIN t USING (run) GROUP BY c.run), "
    "plain AS (SELECT run, -avg(pow(1 / (1 + exp(-score)) - target, 2)) AS brier, corr(ry, rs) AS spearman, corr(y, score) AS pearson, -sqrt(avg(pow(score - y, 2))) AS rmse, -avg(abs(score - y)) AS mae FROM ranks GROUP BY run)"
)


@query(f"WITH {RANKED}, {FOUND}, wide AS (SELECT * FROM pairs JOIN cuts USING (run) JOIN plain USING (run)) SELECT run, objective, round(value, 6) AS value FROM (UNPIVOT wide ON auroc, auprc, brier, mcc, spearman, pearson, rmse, mae INTO NAME objective VALUE value)")
def oriented_objectives(spark, d):
    """Every objective of every run, errors negated."""
    return E.oriented(preds(spark, d)).select("run", "objective", *r6(value="value"))


@query(
    f"WITH {SUBSETS}, x AS (SELECT subset, entity_idx, target, round(score, 12) AS score FROM e), a AS (SELECT p.subset, " + AUC.format(w="1e0") + " AS auroc FROM x p JOIN x q ON p.subset = q.subset AND p.target = 1 AND q.target = 0 GROUP BY p.subset), "
    "g AS (SELECT subset, score, sum(target)::DOUBLE AS p, sum(1 - target)::DOUBLE AS q FROM x GROUP BY subset, score), c AS (SELECT *, sum(p) OVER v AS tp, sum(q) OVER v AS fp FROM g WINDOW v AS (PARTITION BY subset ORDER BY score DESC)), b AS (SELECT subset, sum(p * tp / (tp + fp)) / sum(p) AS auprc FROM c GROUP BY subset), "
    "l AS (SELECT m.subset, regr_slope(y, m.score) AS slope, regr_intercept(y, m.score) AS intercept FROM e m JOIN (SELECT entity_idx, any_value(y) AS y FROM pred GROUP BY entity_idx) USING (entity_idx) GROUP BY m.subset) "
    "SELECT subset, row_number() OVER (ORDER BY round(auroc, 9) DESC, round(auprc, 9) DESC, subset)::INT AS rank, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM a JOIN b USING (subset) JOIN l USING (subset) ORDER BY rank LIMIT 256"
)
def ranked_subsets(spark, d):
    """All subsets by AUROC and AUPRC, the best 256 with their calibrating lines."""
    return E.rank_subsets(preds(spark, d), list(RUNS)).select("subset", "rank", *r6(auroc="auroc", auprc="auprc", slope="slope", intercept="intercept"))


def selection(spark, d, objective, grid, **how):
    wide = Scratch(spark).write(E.pivot_runs(preds(spark, d), list(RUNS)), "wide")
    w, best = E.coordinate_ascent(wide, "r2", ["r0", "r1", "r3"], objective, grid, **how)
    return spark.createDataFrame([(objective, *w, best)], "objective string, r0 double, r1 double, r3 double, value double")


@query()
def selection_auprc(spark, d):
    """Coordinate ascent on AUPRC, 26 grid points, at most half for the candidates."""
    return selection(spark, d, "auprc", np.linspace(0, 0.5, 26), cap=0.5)


@query()
def selection_rescaled(spark, d):
    """Coordinate ascent that scales the other weights, 81 points, 8 sweeps, on AUROC, AUPRC and Brier's score."""
    a, p, b = (selection(spark, d, o, np.linspace(0, 0.4, 81), mode="rescale", sweeps=8) for o in ("auroc", "auprc", "brier"))
    return a.union(p).union(b)


@query()
def selection_mcc(spark, d):
    """Coordinate ascent on the exact best MCC, 51 points."""
    return selection(spark, d, "mcc", np.linspace(0, 0.5, 51), cap=0.5)


@query()
def crossfit_methods(spark, d):
    """Q5: out-of-fold logits by Platt, beta and isotonic fits of the other folds."""
    z = preds(spark, d, ["r0"]).withColumn("score", F.log(F.col("score") / (1 - F.col("score"))))
    out = None
    for m in Q.METHODS:
        part = Q.crossfit(z, m).select("entity_idx", "fold", F.lit(m).alias("method"), *r6(out_of_fold="out_of_fold"))
        out = part if out is None else out.union(part)
    return out


TASKS = PRED + ", tp AS (SELECT pred.run AS task, obs.h AS entity, CASE WHEN run IN ('r2', 'r3') THEN pred.y ELSE pred.target END AS target, pred.score FROM pred JOIN obs ON obs.doc_id = pred.entity_idx), b AS (SELECT *, 1e0 / count(*) OVER (PARTITION BY task, entity) AS w FROM tp WHERE task IN ('r0', 'r1')), "
REPORTS = TASKS + (
    "auc AS (SELECT p.task, " + AUC.format(w="p.w * q.w") + " AS auroc FROM b p JOIN b q ON p.task = q.task AND p.target = 1 AND q.target = 0 GROUP BY p.task), "
    "g AS (SELECT task, score, sum(w * target) AS p, sum(w * (1 - target)) AS q FROM b GROUP BY task, score), c AS (SELECT *, sum(p) OVER v AS tp, sum(q) OVER v AS fp FROM g WINDOW v AS (PARTITION BY task ORDER BY score DESC)), prc AS (SELECT task, sum(p * tp / (tp + fp)) / sum(p) AS auprc FROM c GROUP BY task), "
    "m AS (SELECT task, entity, avg(target) AS t, avg(score) AS s FROM tp WHERE task IN ('r2', 'r3') GROUP BY task, entity), k AS (SELECT *, rank() OVER (PARTITION BY task ORDER BY t) + (count(*) OVER (PARTITION BY task, t) - 1) / 2e0 AS rt, rank() OVER (PARTITION BY task ORDER BY s) + (count(*) OVER (PARTITION BY task, s) - 1) / 2e0 AS rs FROM m), "
    "rep AS (SELECT task, auroc, auprc, NULL::DOUBLE AS spearman, NULL::DOUBLE AS rmse FROM auc JOIN prc USING (task) UNION ALL SELECT task, NULL, NULL, corr(rt, rs), sqrt(avg(pow(s - t, 2))) FROM k GROUP BY task)"
)


def reports(spark, d):
    o = obs(spark, d).select(F.col("doc_id").alias("entity_idx"), F.col("h").alias("entity"))
    p = preds(spark, d).join(o, "entity_idx").withColumn("task", F.col("run"))
    return M.task_reports(p.withColumn("target", F.when(F.col("run").isin("r2", "r3"), F.col("y")).otherwise(F.col("target"))), "entity", ["r2", "r3"])


@query(f"WITH {REPORTS} SELECT task, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, round(spearman, 6) AS spearman, round(rmse, 6) AS rmse FROM rep")
def task_reports(spark, d):
    """M8: metrics by the kind of each task, entities weighing the same."""
    return reports(spark, d).select("task", *r6(auroc="auroc", auprc="auprc", spearman="spearman", rmse="rmse"))


@query(f"WITH {REPORTS} SELECT round(avg(1 - coalesce(auroc, spearman)), 6) AS balanced_objective FROM rep")
def balanced_tasks(spark, d):
    """M9: the mean of 1 - AUROC and 1 - Spearman over tasks."""
    return M.balanced(reports(spark, d)).select(*r6(balanced_objective="balanced_objective"))


@query(f"WITH {RES}, w AS (SELECT a.entity, a.pos, sum(b.value * CASE WHEN b.pos = 0 THEN 1 ELSE 0.25e0 END * pow(0.75e0, a.pos - b.pos)) AS ema FROM res a JOIN res b ON a.entity = b.entity AND b.pos <= a.pos GROUP BY a.entity, a.pos) SELECT entity, pos, round(ema, 6) AS ema FROM w")
def exponential_average(spark, d):
    """The exponential average over the steps of a run."""
    return features.ema(residues(spark, d), "entity", "pos", "value", 0.75).select("entity", "pos", *r6(ema="ema"))


@query(f"WITH {RES}, e AS (SELECT o_orderkey AS entity, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS length FROM orders), p AS (SELECT entity, count(*) AS n FROM res WHERE entity % 5 <> 0 GROUP BY entity), g AS (SELECT res.value FROM res JOIN p USING (entity) JOIN e USING (entity) WHERE p.n = e.length) SELECT (SELECT count(*) FROM e) AS entities, (SELECT count(*) FROM e WHERE entity NOT IN (SELECT entity FROM p)) AS missing, (SELECT count(*) FROM e JOIN p USING (entity) WHERE n <> length) AS mismatched, (SELECT count(*) FROM g) AS n, (SELECT round(avg(value), 6) FROM g) AS mean, (SELECT round(stddev_pop(value), 6) FROM g) AS std")
def checked_statistics(spark, d):
    """Statistics of entities whose rows are complete, with counts of those left out."""
    r = residues(spark, d)
    n = r.groupBy("entity").agg(F.count("*").alias("k"))
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("entity")).join(n, "entity", "left")
    e = e.select("entity", (F.coalesce("k", F.lit(0)) + F.when(F.col("entity") % 7 == 0, 1).otherwise(0)).alias("length"))
    return features.checked_stats(r.where("entity % 5 <> 0"), e, "entity", "value").select("entities", "missing", "mismatched", "n", *r6(mean="mean", std="std"))


@query("WITH s AS (SELECT list(m ORDER BY k) AS m, list(s ORDER BY k) AS s FROM (SELECT k, avg(embedding[k]::DOUBLE) AS m, stddev_pop(embedding[k]::DOUBLE) AS s FROM embeddings, range(33, 65) t(k) GROUP BY k)) SELECT vec_id, length(embedding) + 1 AS width, round(embedding[1]::DOUBLE, 6) AS first, round((embedding[33]::DOUBLE - m[1]) / greatest(s[1], 1e-6), 6) AS z_first, round((embedding[64]::DOUBLE - m[32]) / greatest(s[32], 1e-6), 6) AS z_last, 0.5e0 AS confidence FROM embeddings, s")
def compact_rows(spark, d):
    """A row's scalars, its standardised scalars and its confidence in one array."""
    e = table(spark, d, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 32).alias("a"), F.slice(F.col("embedding").cast("array<double>"), 33, 32).alias("b"))
    m = features.array_moments(e.select(F.col("b").alias("v")), "v")
    s = m.agg(*[F.array_sort(F.collect_list(F.struct("pos", c)))[c].alias(c) for c in ("mean", "std")])
    row = features.compact_row(F.col("a"), F.col("b"), F.col("mean"), F.col("std"), F.lit(0.5))
    r = e.crossJoin(F.broadcast(s)).select("vec_id", row.alias("r"))  # one row
    return r.select("vec_id", F.size("r").cast("long").alias("width"), *r6(first=F.col("r")[0], z_first=F.col("r")[32], z_last=F.col("r")[63]), F.col("r")[64].alias("confidence"))


@query("SELECT vec_id, 'width' AS kind FROM embeddings WHERE vec_id % 11 = 0 UNION ALL SELECT vec_id, 'finite' FROM embeddings WHERE vec_id % 13 = 0 UNION ALL SELECT vec_id, 'range' FROM embeddings WHERE vec_id % 17 = 0")
def schema_violations(spark, d):
    """Rows of another width, with values that are not finite, or with a confidence out of range."""
    v = F.col("embedding").cast("array<double>")
    v = F.when(F.col("vec_id") % 13 == 0, F.concat(F.slice(v, 1, 63), F.array(F.lit(float("nan"))))).otherwise(v)
    v = F.when(F.col("vec_id") % 11 == 0, F.concat(v, F.array(F.lit(0.0)))).otherwise(v)
    e = table(spark, d, "embeddings").select("vec_id", v.alias("v"), F.when(F.col("vec_id") % 17 == 0, 1.5).otherwise(0.5).alias("confidence"))
    return features.schema_violations(e, "vec_id", "v", 64, "confidence")
