"""Queries of scans, manifests, joins, aggregates, windows, top-k, sets and shards."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.scalar import value_bin, fixed_chunks, sequence_hash, stable_tiebreak
from quern.operators import audit, features, manifest, resume, sampling
from quern.operators.identity import parse_shards
from quern.operators.prefix import number_by_hash, running_sums
from quern.plans.fixtures import LONG, OBS, RES, long_obs, obs, residues, table
from quern.registry import query
from quern.sources import readers, sinks
from quern.streaming.ingest import windowed_counts

UNION = OBS + ", u AS (SELECT source || ':' || doc_id || ':q' AS observation_id, h AS sequence_sha256, source AS source_dataset, 'quality' AS endpoint, 'binary' AS target_kind, quality::DOUBLE AS target_value, seq AS sequence FROM obs UNION ALL SELECT source || ':' || doc_id || ':t', h, source, 'toxic', 'binary', toxic::DOUBLE, seq FROM obs UNION ALL SELECT source || ':' || doc_id || ':c', h, source, 'length', 'continuous', (n % 1000) / 999e0, seq FROM obs)"


def union(spark, d):
    o = obs(spark, d)
    part = lambda tag, endpoint, kind, value: o.select(
        F.concat("source", F.lit(":"), F.col("doc_id").cast("string"), F.lit(f":{tag}")).alias("observation_id"), F.col("h").alias("sequence_sha256"), F.col("source").alias("source_dataset"),
        F.lit(endpoint).alias("endpoint"), F.lit(kind).alias("target_kind"), value.cast("double").alias("target_value"), F.col("seq").alias("sequence"),
    )
    return manifest.union_observations([part("q", "quality", "binary", F.col("quality")), part("t", "toxic", "binary", F.col("toxic")), part("c", "length", "continuous", (F.col("n") % 1000) / 999.0)])


@query(
    "SELECT (row_number() OVER (ORDER BY sequence_sha256) - 1) AS entity_idx, printf('entity:%06d', row_number() OVER (ORDER BY sequence_sha256)) AS entity_id, sequence_sha256, length, copies FROM "
    "(SELECT sha256(trim(text)) AS sequence_sha256, any_value(length(trim(text))) AS length, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1)"
)
def entity_manifest(spark, d):
    """Distinct texts by hash, numbered densely in hash order."""
    t = table(spark, d, "documents").where("text is not null").select(sequence_hash(F.col("text"), upper=False).alias("sequence_sha256"), F.length(F.trim("text")).cast("long").alias("length"))
    e = number_by_hash(t.groupBy("sequence_sha256").agg(F.first("length").alias("length"), F.count("*").alias("copies")), "sequence_sha256", "entity_idx")
    return e.select("entity_idx", F.format_string("entity:%06d", F.col("entity_idx") + 1).alias("entity_id"), "sequence_sha256", "length", "copies")


@query(f"WITH {UNION} SELECT observation_id, sequence_sha256, source_dataset, endpoint, target_kind, target_value FROM u")
def union_observations(spark, d):
    """Three sources of observations under one schema; copies stay."""
    return union(spark, d).drop("sequence")


@query(f"WITH {UNION}, e AS (SELECT sequence_sha256, list_sort(list(DISTINCT source_dataset)) AS s FROM u GROUP BY 1), k AS (SELECT sequence_sha256, max(c) AS c FROM (SELECT sequence_sha256, endpoint, count(DISTINCT target_value) AS c FROM u GROUP BY 1, 2) GROUP BY 1) SELECT array_to_string(s, ';') AS sources, count(*) AS entities, count(*) FILTER (c > 1) AS conflicting FROM e JOIN k USING (sequence_sha256) GROUP BY 1")
def source_overlap_conflicts(spark, d):
    """Entities by the set of their sources, and label conflicts."""
    return manifest.overlaps(union(spark, d))


@query(f"WITH {UNION} SELECT sequence_sha256, 'hash' AS kind FROM u WHERE sha256(sequence || CASE WHEN substr(sequence_sha256, 1, 1) = '0' THEN 'x' ELSE '' END) <> sequence_sha256")
def hash_violations(spark, d):
    """recomputed hashes that differ (texts whose hash begins with 0 are tampered with first)."""
    u = union(spark, d)
    tampered = F.concat("sequence", F.when(F.substring("sequence_sha256", 1, 1) == "0", "x").otherwise(""))
    return manifest.hash_violations(u, F.sha2(tampered, 256))


@query("SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def duplicate_keys(spark, d):
    """keys that are not unique."""
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("k")).where("k > 1").select("l_orderkey", "k")


@query("WITH e(split, expected) AS (VALUES ('en', 620), ('fr', 100), ('xx', 5)) SELECT e.split, e.expected, coalesce(a.n, 0) AS actual FROM e LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) a ON a.lang = e.split WHERE coalesce(a.n, 0) <> e.expected")
def expected_counts(spark, d):
    """contracts on counts that do not hold."""
    e = spark.createDataFrame([("en", 620), ("fr", 100), ("xx", 5)], "split string, expected int")
    n = table(spark, d, "documents").groupBy(F.col("lang").alias("split")).agg(F.count("*").alias("n"))
    return e.join(n, "split", "left").withColumn("actual", F.coalesce("n", F.lit(0))).where("actual <> expected").drop("n")


FASTA = "SELECT p_partkey, regexp_extract(p_name, '^(.*)$', 1) AS name, (p_size % 2)::VARCHAR AS label, upper(p_brand || p_type) AS sequence FROM part"


@query(f"SELECT p_partkey, 1 AS ordinal, name, label, sequence FROM ({FASTA}) UNION ALL SELECT p_partkey, 2, 'second', '1', upper(p_brand) FROM part, (SELECT 1)")
def fasta_records(spark, d):
    """FASTA text parsed, numbered and its headers decoded."""
    p = table(spark, d, "part")
    text = F.concat(F.lit(">"), "p_name", F.lit(" A-"), (F.col("p_size") % 2).cast("string"), F.lit("\n"), "p_brand", F.lit("\n\n"), F.lower("p_type"), F.lit("\r\n>second A-1\n"), "p_brand", F.lit("\n"))
    r = p.select("p_partkey", F.explode(readers.parse_fasta(text)).alias("r")).select("p_partkey", "r.*")
    name, label = manifest.decode_header(F.col("header"))
    return r.select("p_partkey", "ordinal", name.alias("name"), label.alias("label"), "sequence")


@query(
    f"WITH {RES}, a AS (SELECT entity, pos, value, pos // 2 AS rid, CASE token WHEN 'A' THEN 'A' WHEN 'C' THEN 'C' ELSE 'X' END AS residue FROM res WHERE other % 4 <> 0 AND token <> 'D'), "
    "b AS (SELECT *, lag(rid) OVER (PARTITION BY entity ORDER BY pos) AS p FROM a) SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY pos) - 1 AS pos, residue, value AS plddt FROM b WHERE p IS NULL OR p <> rid"
)
def structure_scan(spark, d):
    """Fixed-width atom lines to residues with confidence, consecutive repeats once."""
    r = residues(spark, d)
    name = F.when(F.col("token") == "A", "ALA").when(F.col("token") == "C", "CYS").otherwise("UNK")
    line = F.format_string("ATOM  %5d %-4s%s%s A%4d    %8.3f%8.3f%8.3f  1.00%6.2f", F.col("pos"), F.when(F.col("token") == "D", " N").otherwise(" CA"), F.when(F.col("other") % 4 == 0, "B").otherwise(" "), name, F.floor(F.col("pos") / 2), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.col("value"))
    return readers.parse_structure(r.select("entity", "pos", line.alias("line")), ["entity"], "pos", "line").withColumn("pos", F.col("pos").cast("long"))


@query("SELECT source, count(*) AS n FROM documents WHERE source IN ('src0', 'src3') AND lang = 'en' GROUP BY source")
def filtered_scan(spark, d):
    """a filter that reaches the Parquet scan."""
    return table(spark, d, "documents").where(F.col("source").isin("src0", "src3") & (F.col("lang") == "en")).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'test' WHEN d.doc_id % 10 = 0 THEN 'validation' ELSE 'train' END AS split FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def split_derivation(spark, d):
    """A split by membership flags."""
    flag = table(spark, d, "labels").select("doc_id", F.lit(True).alias("member"))
    j = table(spark, d, "documents").select("doc_id").join(flag, "doc_id", "left")
    return j.select("doc_id", F.when(F.col("member").isNull(), "test").when(F.col("doc_id") % 10 == 0, "validation").otherwise("train").alias("split"))


@query("SELECT 'only_labels' AS side, count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'only_documents', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'both', count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def membership_semi_anti(spark, d):
    """Set membership both ways."""
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    count = lambda side, df: df.agg(F.lit(side).alias("side"), F.count("*").alias("n")).select("side", "n")
    return count("only_labels", b.join(a, "doc_id", "left_anti")).union(count("only_documents", a.join(b, "doc_id", "left_anti"))).union(count("both", a.join(b, "doc_id", "left_semi")))


@query("SELECT c.c_custkey, count(o.o_orderkey) AS match_count, coalesce(string_agg(DISTINCT o.o_orderstatus, ';' ORDER BY o.o_orderstatus), '') AS statuses, coalesce(min(CASE WHEN o.o_orderstatus = 'F' THEN lpad(o.o_orderkey::VARCHAR, 9, '0') END), min(lpad(o.o_orderkey::VARCHAR, 9, '0')), '') AS best FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
def preferred_match(spark, d):
    """One of several matches, the preferred kind first."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderstatus") == "F").alias("reviewed"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("name"), "o_orderstatus")
    status = o.groupBy("c_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ";").alias("statuses"))
    m = manifest.preferred_match(table(spark, d, "customer").select("c_custkey"), o, "c_custkey", "reviewed", "name")
    return m.join(status, "c_custkey", "left").select("c_custkey", "match_count", F.coalesce("statuses", F.lit("")).alias("statuses"), "best")


@query("SELECT n.n_name, r.r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2")
def small_side_lookup(spark, d):
    """Lookups in small tables."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT s.s_suppkey, CASE WHEN l.l_suppkey IS NULL THEN 'missing' ELSE 'valid' END AS status FROM supplier s LEFT JOIN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity > 49.5) l ON s.s_suppkey = l.l_suppkey")
def availability_status(spark, d):
    """What is there, what is missing."""
    have = table(spark, d, "lineitem").where("l_quantity > 49.5").select(F.col("l_suppkey").alias("s_suppkey"), F.lit("valid").alias("status")).distinct()
    return table(spark, d, "supplier").select("s_suppkey").join(have, "s_suppkey", "left").select("s_suppkey", F.coalesce("status", F.lit("missing")).alias("status"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def count_rollup(spark, d):
    """Counts by key with their totals."""
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


FEATURES = UNION + ", c AS (SELECT substr(sequence_sha256, 1, 2) AS component, * FROM u), f AS (SELECT component, unnest(list_filter([ 'observations', 'source:' || source_dataset, CASE WHEN target_kind = 'binary' THEN 'binary:' || source_dataset || ':' || target_value::INT END, CASE WHEN target_kind = 'continuous' THEN 'value_bin:' || least(floor(greatest(least(target_value, 1), 0) * 10), 9)::INT END], lambda x: x IS NOT NULL)) AS feature FROM c), g AS (SELECT component, feature, count(*) AS value FROM f GROUP BY 1, 2 UNION ALL SELECT component, 'entities', count(DISTINCT sequence_sha256) FROM c GROUP BY 1)"


def component_features(spark, d):
    from quern.operators.split import component_features as make

    u = union(spark, d).withColumn("component", F.substring("sequence_sha256", 1, 2))
    return make(u.select("sequence_sha256", "component").distinct(), u)


@query(f"WITH {FEATURES} SELECT component, feature, value FROM g")
def split_feature_counts(spark, d):
    """Conditional counts of each component."""
    return component_features(spark, d)


@query(f"WITH {FEATURES} SELECT feature, sum(value)::BIGINT AS total FROM g GROUP BY feature")
def split_feature_totals(spark, d):
    """Totals of every feature."""
    return component_features(spark, d).groupBy("feature").agg(F.sum("value").alias("total"))


@query("SELECT n_regionkey, string_agg(DISTINCT n_name, ';' ORDER BY n_name) AS names, min(length(n_name)) AS shortest, max(length(n_name)) AS longest FROM nation GROUP BY n_regionkey")
def set_aggregation(spark, d):
    """Sets, minimum and maximum of a group."""
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_set("n_name")), ";").alias("names"), F.min(F.length("n_name")).cast("long").alias("shortest"), F.max(F.length("n_name")).cast("long").alias("longest"))


@query("WITH b(lower, upper) AS (VALUES (0e0, 0.02e0), (0.02e0, 0.04e0), (0.04e0, 0.07e0), (0.07e0, 1.000001e0)) SELECT lower, upper, count(l_discount) AS n FROM b LEFT JOIN lineitem ON l_discount >= lower AND l_discount < upper GROUP BY 1, 2")
def histogram(spark, d):
    """Half-open bins, the last upper bound just beyond 1."""
    return audit.histogram(table(spark, d, "lineitem"), "l_discount", [0.0, 0.02, 0.04, 0.07, 1.000001])


@query("WITH s AS (SELECT o_custkey, count(*) AS k FROM orders GROUP BY o_custkey) SELECT count(*) AS components, max(k) AS largest, count(*) FILTER (k = 1) AS singletons, coalesce(sum(k) FILTER (k > 1), 0)::BIGINT AS non_singleton_entities FROM s")
def size_distribution(spark, d):
    """Sizes of groups."""
    return audit.component_summary(table(spark, d, "orders").withColumn("root", F.col("o_custkey")), [])


@query(f"WITH {OBS}, q AS (SELECT source, quantile_cont(n, [0, 0.1, 0.5, 0.9, 1]) AS q FROM obs GROUP BY source) SELECT source, round(q[1], 6) AS n_min, round(q[2], 6) AS n_p10, round(q[3], 6) AS n_median, round(q[4], 6) AS n_p90, round(q[5], 6) AS n_max FROM q")
def component_quantiles(spark, d):
    """Interpolated quantiles by group."""
    q = audit.quantile_summary(obs(spark, d), ["source"], "n")
    return q.select("source", *[F.round(c, 6).alias(c) for c in q.columns[1:]])


@query(f"WITH {RES} SELECT entity, round(sum(value) / count(*), 6) AS mean, count(DISTINCT pos // 3) AS chunks FROM res GROUP BY entity")
def chunked_mean(spark, d):
    """Exact means through chunks."""
    return features.chunked_mean(residues(spark, d), "entity", "pos", "value", 3).select("entity", F.round("mean", 6).alias("mean"), "chunks")


@query("SELECT p.pos::BIGINT AS pos, count(*) AS n, round(avg(embedding[p.pos + 1]::DOUBLE), 6) AS mean, round(stddev_pop(embedding[p.pos + 1]::DOUBLE), 6) AS std FROM embeddings, range(0, 64) p(pos) GROUP BY p.pos")
def array_moments(spark, d):
    """Mean and population deviation of every position."""
    m = features.array_moments(table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("v")), "v")
    return m.select(F.col("pos").cast("long").alias("pos"), "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"WITH {RES} SELECT entity, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, max(value) AS max, min(value) AS min FROM res GROUP BY entity")
def stats4(spark, d):
    """Four statistics of a group's positions."""
    return features.stats4(residues(spark, d), ["entity"], "value").select("entity", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "max", "min")


@query(f"WITH {RES} SELECT entity, round(coalesce(avg(value) FILTER (rsa >= 0.07), avg(value)), 6) AS mean, coalesce(max(value) FILTER (rsa >= 0.07), max(value)) AS max FROM res GROUP BY entity")
def conditional_pool(spark, d):
    """Statistics over confident positions, of all where none is."""
    return features.conditional_pool(residues(spark, d), ["entity"], "value", F.col("rsa") >= 0.07).select("entity", F.round("mean", 6).alias("mean"), "max")


@query(f"WITH {LONG} SELECT source, endpoint, count(*) AS n, count(*) FILTER (y = 1) AS positive, count(DISTINCT h) AS entities FROM long GROUP BY 1, 2")
def status_counts(spark, d):
    """Counts by status."""
    return long_obs(spark, d).groupBy("source", "endpoint").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("positive"), F.count_distinct("h").alias("entities"))


@query("SELECT p_partkey, p_size, (sum(p_size) OVER (ORDER BY p_partkey))::BIGINT AS upto, (sum(p_size) OVER (ORDER BY p_partkey) - p_size)::BIGINT AS start FROM part")
def offsets_running_sum(spark, d):
    """Offsets of ragged rows, without a single-task sort."""
    r = running_sums(table(spark, d, "part").select("p_partkey", "p_size"), [], "p_partkey", {"upto": "p_size"})
    return r.select("p_partkey", "p_size", "upto", (F.col("upto") - F.col("p_size")).alias("start"))


@query(f"WITH {RES} SELECT entity, pos, coalesce(lag(value, 1) OVER w, 0) AS before_1, coalesce(lead(value, 1) OVER w, 0) AS after_1, coalesce(lag(value, 3) OVER w, 0) AS before_3, coalesce(lead(value, 3) OVER w, 0) AS after_3 FROM res WINDOW w AS (PARTITION BY entity ORDER BY pos)")
def lag_shift(spark, d):
    """Shifts with zero fill."""
    return features.shifts(residues(spark, d), ["entity"], "pos", "value", [1, 3]).select("entity", "pos", "before_1", "after_1", "before_3", "after_3")


@query(f"WITH {RES} SELECT entity, pos, round(avg(value) OVER (PARTITION BY entity ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS avg_3, round(avg(value) OVER (PARTITION BY entity ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS avg_7, round(avg(value) OVER (PARTITION BY entity ORDER BY pos ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), 6) AS avg_15 FROM res")
def moving_average(spark, d):
    """Centred averages of three widths."""
    m = features.moving_average(residues(spark, d), ["entity"], "pos", "value")
    return m.select("entity", "pos", *[F.round(f"avg_{k}", 6).alias(f"avg_{k}") for k in (3, 7, 15)])


@query(f"WITH {RES} SELECT entity, pos // 4 AS segment, round(avg(value), 6) AS mean, max(value) AS max FROM res GROUP BY 1, 2")
def segment_pool(spark, d):
    """Tumbling segments of positions."""
    return features.segments(residues(spark, d), ["entity"], "pos", "value", 4).select("entity", "segment", F.round("mean", 6).alias("mean"), "max")


@query(f"WITH {RES} SELECT entity, pos, round(coalesce(lag(value, 2) OVER w, 0) * 0.1e0 + coalesce(lag(value, 1) OVER w, 0) * 0.2e0 + value * 0.4e0 + coalesce(lead(value, 1) OVER w, 0) * 0.2e0 + coalesce(lead(value, 2) OVER w, 0) * 0.1e0, 6) AS conv FROM res WINDOW w AS (PARTITION BY entity ORDER BY pos)")
def depthwise_convolution(spark, d):
    """A kernel of width five."""
    return features.convolve(residues(spark, d), ["entity"], "pos", "value", [0.1, 0.2, 0.4, 0.2, 0.1]).select("entity", "pos", F.round("conv", 6).alias("conv"))


@query(f"WITH {RES} SELECT entity, pos, round(exp(value / 10 - max(value / 10) OVER w) / sum(exp(value / 10)) OVER w * exp(max(value / 10) OVER w), 6) AS weight FROM res WINDOW w AS (PARTITION BY entity)")
def softmax_pool(spark, d):
    """Attention weights of a group."""
    return features.softmax(residues(spark, d).withColumn("z", F.col("value") / 10), ["entity"], "z").select("entity", "pos", F.round("weight", 6).alias("weight"))


@query("WITH h AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS best FROM events), s AS (SELECT *, coalesce(best > lag(best) OVER (PARTITION BY user_id ORDER BY event_id), true) AS better FROM h), g AS (SELECT *, max(CASE WHEN better THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS since FROM s) SELECT user_id, event_id, best, row_number() OVER (PARTITION BY user_id, since ORDER BY event_id) - 1 AS patience FROM g")
def best_so_far(spark, d):
    """Running best and epochs since it last improved."""
    w = W.partitionBy("user_id").orderBy("event_id")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    e = table(spark, d, "events").select("user_id", "event_id", "value").withColumn("best", F.max("value").over(upto))
    e = e.withColumn("better", F.coalesce(F.col("best") > F.lag("best").over(w), F.lit(True)))
    e = e.withColumn("since", F.max(F.when(F.col("better"), F.col("event_id"))).over(upto))
    return e.select("user_id", "event_id", "best", (F.row_number().over(W.partitionBy("user_id", "since").orderBy("event_id")) - 1).cast("long").alias("patience"))


@query(f"WITH {RES} SELECT entity, pos, other, row_number() OVER (PARTITION BY entity, other ORDER BY pos) = 1 AS valid FROM res")
def duplicate_slots(spark, d):
    """A neighbour seen in an earlier slot is not valid."""
    return features.first_slots(residues(spark, d), ["entity"], "other", "pos").select("entity", "pos", "other", "valid")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 500")
def multi_key_top(spark, d):
    """A sort by several keys with a limit."""
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey").limit(500).select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 1")
def largest_group(spark, d):
    """The largest group, ties to the smaller key."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(1)


@query(f"WITH {RES}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY price DESC, pos) AS r FROM res) SELECT entity, pos, round(price / sum(price) OVER (PARTITION BY entity), 6) AS share FROM r WHERE r <= 2")
def top_k_renormalised(spark, d):
    """The best of each group, as shares."""
    return features.top_k_renormalised(residues(spark, d), ["entity"], "price", 2, "pos").select("entity", "pos", F.round("share", 6).alias("share"))


@query("SELECT sha256(c_name) AS h, c_custkey FROM customer ORDER BY h LIMIT 64")
def first_rows_by_hash(spark, d):
    """The first rows in hash order."""
    return table(spark, d, "customer").select(F.sha2("c_name", 256).alias("h"), "c_custkey").orderBy("h").limit(64)


@query("SELECT c_custkey, h, ((row_number() OVER (ORDER BY h) - 1) % 5)::INT AS shard FROM (SELECT c_custkey, sha256(c_name) AS h FROM customer)")
def strided_shards(spark, d):
    """Every n-th row in hash order."""
    c = number_by_hash(table(spark, d, "customer").select("c_custkey", F.sha2("c_name", 256).alias("h")), "h", "i")
    return c.select("c_custkey", "h", F.pmod("i", F.lit(5)).cast("int").alias("shard"))


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def set_operations(spark, d):
    """Intersection and difference of key sets."""
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select("s_nationkey")
    return c.intersect(s).subtract(table(spark, d, "nation").where("n_regionkey = 0").select("n_nationkey"))


@query("SELECT a.n_nationkey AS i, b.n_nationkey AS j FROM (SELECT n_nationkey, n_regionkey, list_sort(list_distinct(string_split(lower(n_name), ''))) AS s FROM nation) a JOIN (SELECT n_nationkey, n_regionkey, string_split(lower(n_name), '') AS s FROM nation) b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey AND NOT list_has_any(a.s, b.s)")
def disjoint_sets(spark, d):
    """Pairs of collections without a common member."""
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey", F.split(F.lower("n_name"), "").alias("s"))
    a, b = n.alias("a"), n.alias("b")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")) & ~F.arrays_overlap("a.s", "b.s")
    return a.join(b, on).select(F.col("a.n_nationkey").alias("i"), F.col("b.n_nationkey").alias("j"))


@query("SELECT k::INT AS shard FROM range(0, 12) t(k) WHERE k IN (0, 1, 2, 5, 9, 10)")
def shard_spec(spark, d):
    """Shard specification parser."""
    return spark.createDataFrame([(s,) for s in sorted(parse_shards("0-2,5,9-10", 12))], "shard int")


@query("WITH b AS (SELECT i, j, row_number() OVER (ORDER BY i, j) - 1 AS ordinal FROM range(0, 17) x(i), range(0, 17) y(j) WHERE i <= j) SELECT i, j, ordinal, (ordinal % 11)::INT AS shard FROM b")
def shard_assign(spark, d):
    """SI4, SI5: blocks of the upper triangle in row order, dealt to shards."""
    n = 17
    b = spark.range(n).select(F.col("id").alias("i")).withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(n - 1).cast("long"))))
    ordinal = (F.col("i") * n - F.col("i") * (F.col("i") - 1) / 2 + F.col("j") - F.col("i")).cast("long")
    return b.withColumn("ordinal", ordinal).withColumn("shard", F.pmod("ordinal", F.lit(11)).cast("int"))


LOG = "log AS (SELECT event_id AS unit, (event_id % 8)::INT AS shard, CASE WHEN event_id % 97 = 0 THEN 0 ELSE 1 END AS status FROM events UNION ALL SELECT event_id, 0, 1 FROM events WHERE event_id % 101 = 1 UNION ALL SELECT -1 - event_id, 0, 1 FROM events WHERE event_id < 3)"


@query(f"WITH {LOG}, s AS (SELECT unit, count(*) AS k FROM log WHERE status = 1 GROUP BY unit) SELECT count(e.event_id) AS expected, count(*) FILTER (e.event_id IS NOT NULL AND k IS NOT NULL) AS covered, count(*) FILTER (k IS NULL) AS missing, count(*) FILTER (e.event_id IS NULL) AS extra, count(*) FILTER (k > 1) AS overlap FROM (SELECT DISTINCT event_id FROM events) e FULL JOIN s ON s.unit = e.event_id")
def shard_cover(spark, d):
    """An exact-cover audit of a log with faults."""
    e = table(spark, d, "events").select("event_id")
    log = e.select(F.col("event_id").alias("unit"), F.when(F.col("event_id") % 97 == 0, 0).otherwise(1).alias("status"))
    log = log.union(e.where("event_id % 101 = 1").select("event_id", F.lit(1))).union(e.where("event_id < 3").select(-1 - F.col("event_id"), F.lit(1)))
    return resume.cover(log, e.withColumnRenamed("event_id", "unit"), "unit")


@query("SELECT k::INT AS shard FROM range(0, 8) t(k) WHERE k IN (2, 5, 7)")
def pending_shards(spark, d):
    """Shards without a marker, or whose rows do not match it."""
    e = table(spark, d, "events").select("event_id", "value", F.pmod("event_id", F.lit(8)).cast("int").alias("shard"))
    marks = sinks.checksums(e, "shard").where("shard <> 2")
    damaged = e.where("not (shard = 5 and event_id < 100)").withColumn("value", F.when((F.col("shard") == 7) & (F.col("event_id") == 7), -1.0).otherwise(F.col("value")))
    return resume.pending(spark.range(8).select(F.col("id").cast("int").alias("shard")), resume.valid_shards(damaged, marks, "shard"), "shard")


@query(
    f"WITH RECURSIVE {OBS}, o AS (SELECT doc_id, n, shard, row_number() OVER (PARTITION BY shard ORDER BY n, doc_id) AS r FROM (SELECT doc_id, n, ('0x' || substr(md5('shard:' || doc_id), 1, 13))::BIGINT % 4 AS shard FROM obs)), "
    "f AS (SELECT doc_id, n, shard, r, 0::BIGINT AS batch, 1::BIGINT AS held FROM o WHERE r = 1 UNION ALL SELECT o.doc_id, o.n, o.shard, o.r, CASE WHEN (o.n + 2) * (f.held + 1) > 8192 THEN f.batch + 1 ELSE f.batch END, "
    "CASE WHEN (o.n + 2) * (f.held + 1) > 8192 THEN 1 ELSE f.held + 1 END FROM f JOIN o ON o.shard = f.shard AND o.r = f.r + 1) SELECT doc_id, n, shard::INT AS shard, batch FROM f"
)
def budget_batches(spark, d):
    """Batches by length within a budget."""
    return sampling.budget_batches(obs(spark, d).select("doc_id", "n"), "doc_id", "n", 8192, shards=4)


@query("SELECT o_orderkey, unnest([substr(c, p, 7) FOR p IN range(1, length(c) + 1, 7)]) AS chunk FROM (SELECT o_orderkey, o_orderpriority || o_orderstatus AS c FROM orders)")
def fixed_chunks_query(spark, d):
    """Fixed-length pieces of a string."""
    return table(spark, d, "orders").select("o_orderkey", F.explode(fixed_chunks(F.concat("o_orderpriority", "o_orderstatus"), 7)).alias("chunk"))


@query("SELECT c_custkey, substr(sha256('20260828:' || c_name || ':train'), 1, 16) AS tie, least(floor(greatest(least(c_acctbal / 10000, 1), 0) * 10), 9)::INT AS bin FROM customer")
def stable_tiebreaks(spark, d):
    """Stable tie-break digests and tenths of a clipped value."""
    return table(spark, d, "customer").select("c_custkey", stable_tiebreak(20260828, F.col("c_name"), F.lit("train")).alias("tie"), value_bin(F.col("c_acctbal") / 10000).alias("bin"))


@query("SELECT event_id, (props->>'k')::INT AS k, date_trunc('day', ts) AS day FROM events")
def json_props(spark, d):
    """JSON documents, malformed ones null."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int").getField("k").alias("k"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, d):
    """Streaming extension: the windowed aggregate as a batch."""
    e = windowed_counts(table(spark, d, "events"))
    return e.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))
