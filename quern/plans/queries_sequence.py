"""Queries of descriptors, identity, graphs, splits and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.descriptors import AMINO_ACIDS, GROUPS, NAMES, described
from quern.functions.scalar import entropy_bits
from quern.operators import audit, features, fusion, identity, split
from quern.operators.graph import connected_components
from quern.plans.fixtures import LCS, OBS, RES, SHORT, obs, residues, short, table
from quern.plans.scratch import Scratch
from quern.registry import query

COUNT = "(length(s) - length(translate(s, '{0}', '')))"
N = "greatest(length(s), 1)"
RUN = "list_max(list_transform(regexp_split_to_array(s, '[^{0}]+'), lambda x: length(x)))"


@query(
    "WITH t AS (SELECT doc_id, upper(translate(text, 'ßẞ', '')) AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, "
    + ", ".join([f"round({COUNT.format(a)} / {N}, 6) AS aa_fraction_{a}" for a in AMINO_ACIDS] + [f"round({COUNT.format(x)} / {N}, 6) AS group_fraction_{g}" for g, x in GROUPS.items()])
    + ", round(ln(1 + length(s)), 6) AS log1p_length, round(" + " + ".join(f"-({COUNT.format(a)} / {N}) * ln({COUNT.format(a)} / {N} + 1e-12)" for a in AMINO_ACIDS) + ", 6) AS shannon_entropy, "
    f"round(({COUNT.format('KR')} - {COUNT.format('DE')}) / {N}, 6) AS net_charge_fraction, round({RUN.format(GROUPS['hydrophobic'])} / {N}, 6) AS longest_hydrophobic_run_fraction, "
    f"round({RUN.format(GROUPS['charged'])} / {N}, 6) AS longest_charged_run_fraction, round((length(s) - {COUNT.format(AMINO_ACIDS)}) / {N}, 6) AS noncanonical_fraction FROM t"
)
def sequence_descriptors(spark, d):
    """Section 2.10, W4: 35 descriptors of every whole text."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.upper(F.translate("text", "ßẞ", "")).alias("s"))
    return described(t, "s").select("doc_id", *[F.round(n, 6).alias(n) for n in NAMES])


@query(f"WITH {SHORT}, c AS (SELECT entity_idx, length, ch, count(*) AS k FROM (SELECT entity_idx, length, unnest(string_split(sequence, '')) AS ch FROM short) GROUP BY 1, 2, 3) SELECT entity_idx, round(-sum(k / length * log2(k / length)), 6) AS entropy FROM c GROUP BY entity_idx")
def entropy_bits_query(spark, d):
    """Shannon entropy in bits over all characters."""
    return short(spark, d).select("entity_idx", F.round(entropy_bits(F.col("sequence")), 6).alias("entropy"))


@query("SELECT p_partkey, p_name, contains(p_name, 'ring') OR contains(p_name, 'bolt') AS motif, NOT regexp_matches(p_name, '[xb]') AS clear FROM part")
def motif_filter(spark, d):
    """Literal motifs and ambiguous letters."""
    return table(spark, d, "part").select("p_partkey", "p_name", (F.contains(F.col("p_name"), F.lit("ring")) | F.contains(F.col("p_name"), F.lit("bolt"))).alias("motif"), (~F.col("p_name").rlike("[xb]")).alias("clear"))


@query(f"WITH RECURSIVE {LCS} SELECT i, j, round(si, 9) AS si FROM si WHERE si >= 0.3")
def si_edges(spark, d):
    """SI1 - SI6, J7, J8, F9: exact identity edges with lossless pruning."""
    return identity.si_edges(short(spark, d), 0.30).select("i", "j", F.round("si", 9).alias("si"))


@query(f"WITH RECURSIVE {LCS}, b AS (SELECT i, j, si FROM si UNION ALL SELECT j, i, si FROM si) SELECT i, j, round(si, 9) AS si FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY si DESC, j) AS r FROM b) WHERE r = 1")
def si_nearest(spark, d):
    """SI7, W7: nearest neighbours over unpruned pairs."""
    return identity.nearest(identity.si_edges(short(spark, d), 0.0)).select("i", "j", F.round("si", 9).alias("si"))


@query(f"WITH RECURSIVE {LCS} SELECT count(*) AS pairs, round(sum(si), 6) AS checksum FROM si")
def si_checksum(spark, d):
    """SI9: pairs and the sum of identities."""
    return identity.si_edges(short(spark, d), 0.0).agg(F.count("*").alias("pairs"), F.round(F.sum("si"), 6).alias("checksum"))


COMPONENTS = LCS + ", e AS (SELECT i, j FROM si WHERE si >= {0} UNION ALL SELECT j, i FROM si WHERE si >= {0}), r(node, root) AS (SELECT entity_idx, entity_idx FROM short UNION SELECT e.j, r.root FROM r JOIN e ON r.node = e.i), comp AS (SELECT node, min(root) AS root FROM r GROUP BY node)"


def edges(spark, d, least=0.30):
    return identity.si_edges(short(spark, d), least)


def components(spark, d, least):
    n, scratch = short(spark, d), Scratch(spark)
    cc = connected_components(edges(spark, d, least).select(F.col("i").alias("a"), F.col("j").alias("b")), scratch)
    return n.join(cc, F.col("entity_idx") == F.col("node"), "left").withColumn("root", F.coalesce("root", "entity_idx")).drop("node")


@query(f"WITH RECURSIVE {COMPONENTS.format(0.65)} SELECT node AS entity_idx, root FROM comp")
def connected_components_query(spark, d):
    """C1, C2, SI8: components of the identity graph."""
    return components(spark, d, 0.65).select("entity_idx", "root")


@query(
    "WITH RECURSIVE " + LCS + ", th(threshold) AS (VALUES (0.3e0), (0.31e0), (0.35e0), (0.4e0), (0.5e0), (0.7e0), (0.9e0)), e AS (SELECT threshold, i, j FROM si, th WHERE si >= threshold UNION ALL SELECT threshold, j, i FROM si, th WHERE si >= threshold), "
    "r(threshold, node, root) AS (SELECT threshold, entity_idx, entity_idx FROM short, th UNION SELECT e.threshold, e.j, r.root FROM r JOIN e ON r.node = e.i AND r.threshold = e.threshold), k AS (SELECT threshold, root, count(*) AS k FROM (SELECT threshold, node, min(root) AS root FROM r GROUP BY 1, 2) GROUP BY 1, 2) "
    "SELECT threshold, count(*) AS components, max(k) AS largest, count(*) FILTER (k = 1) AS singletons, coalesce(sum(k) FILTER (k > 1), 0)::BIGINT AS non_singleton_entities FROM k GROUP BY threshold"
)
def threshold_sensitivity(spark, d):
    """One run of components keyed by threshold."""
    return audit.threshold_sensitivity(edges(spark, d), short(spark, d), Scratch(spark))


FILTERS = {
    "none": "true", "min_length_30": "s >= 30", "min_length_50": "s >= 50", "min_length_100": "s >= 100", "no_ambiguous": "clear", "no_motif": "free",
    "ratio_50": "s / l >= 0.5e0", "ratio_80": "s / l >= 0.8e0", "conservative": "s >= 50 AND clear AND free AND s / l >= 0.5e0",
}


@query(
    "WITH RECURSIVE " + LCS + ", q AS (SELECT i, j, least(x.length, y.length) AS s, greatest(x.length, y.length) AS l, NOT regexp_matches(x.sequence || y.sequence, '[XB]') AS clear, "
    "NOT regexp_matches(x.sequence || ' ' || y.sequence, 'RING|BOLT') AS free FROM si JOIN short x ON x.entity_idx = i JOIN short y ON y.entity_idx = j WHERE si >= 0.5e0), "
    "o AS (" + " UNION ALL ".join(f"SELECT '{k}' AS filter, i, j FROM q WHERE {c}" for k, c in FILTERS.items()) + "), e AS (SELECT * FROM o UNION ALL SELECT filter, j, i FROM o), f(filter) AS (VALUES " + ", ".join(f"('{k}')" for k in FILTERS) + "), "
    "r(filter, node, root) AS (SELECT filter, entity_idx, entity_idx FROM short, f UNION SELECT e.filter, e.j, r.root FROM r JOIN e ON r.node = e.i AND r.filter = e.filter), k AS (SELECT filter, root, count(*) AS k FROM (SELECT filter, node, min(root) AS root FROM r GROUP BY 1, 2) GROUP BY 1, 2) "
    "SELECT filter, count(*) AS components, max(k) AS largest, count(*) FILTER (k = 1) AS singletons, coalesce(sum(k) FILTER (k > 1), 0)::BIGINT AS non_singleton_entities FROM k GROUP BY filter"
)
def filter_sensitivity(spark, d):
    """Components under nine edge filters."""
    n = short(spark, d)
    s = n.select("entity_idx", "sequence")
    e = edges(spark, d, 0.5).join(s.select(F.col("entity_idx").alias("i"), F.col("sequence").alias("x")), "i").join(s.select(F.col("entity_idx").alias("j"), F.col("sequence").alias("y")), "j")
    p = audit.edge_predicates("x", "y", ["RING", "BOLT"])
    keys = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in p.items()])))
    return audit.component_summary(audit.keyed_components(e.select(keys.alias("filter"), "i", "j"), n, "filter", Scratch(spark), values=list(p)), ["filter"])


DEGREES = LCS + ", e AS (SELECT i AS node, j AS peer FROM si WHERE si >= 0.5 UNION ALL SELECT j, i FROM si WHERE si >= 0.5), g AS (SELECT s.entity_idx, count(e.peer) AS degree, count(*) FILTER (e.peer IS NOT NULL AND NOT list_has_any(s.sources, p.sources)) AS cross_source_degree, coalesce(min(p.length), 0) AS neighbor_min_length, coalesce(max(p.length), 0) AS neighbor_max_length FROM short s LEFT JOIN e ON e.node = s.entity_idx LEFT JOIN short p ON p.entity_idx = e.peer GROUP BY s.entity_idx)"


@query(f"WITH RECURSIVE {DEGREES} SELECT * FROM g")
def degrees(spark, d):
    """Degrees and neighbours' lengths."""
    return audit.degrees(edges(spark, d, 0.5), short(spark, d)).select("entity_idx", "degree", "cross_source_degree", "neighbor_min_length", "neighbor_max_length")


@query(f"WITH RECURSIVE {DEGREES} SELECT g.entity_idx, degree, length FROM g JOIN short USING (entity_idx) ORDER BY degree DESC, length, sequence_sha256 LIMIT 500")
def topn_bridge(spark, d):
    """The best connected entities."""
    return audit.bridges(audit.degrees(edges(spark, d, 0.5), short(spark, d)), 500).select("entity_idx", "degree", "length")


@query(f"WITH RECURSIVE {COMPONENTS.format(0.65)}, b AS (SELECT root, count(*) AS k FROM comp GROUP BY root ORDER BY k DESC, root LIMIT 1) SELECT comp.root = (SELECT root FROM b) AS is_giant, count(*) AS entities, round(median(length), 6) AS median_length, count(*) FILTER (contains(sequence, 'X')) AS with_x, count(*) FILTER (contains(sequence, 'B')) AS with_b FROM comp JOIN short ON comp.node = short.entity_idx GROUP BY 1")
def giant_summary(spark, d):
    """The largest component against the rest."""
    c = components(spark, d, 0.65)
    g = c.groupBy("root").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "root").limit(1).select(F.col("root").alias("g"))
    x = c.crossJoin(F.broadcast(g)).withColumn("is_giant", F.col("root") == F.col("g"))  # one row
    return x.groupBy("is_giant").agg(F.count("*").alias("entities"), F.round(F.percentile("length", 0.5), 6).alias("median_length"), F.count_if(F.contains(F.col("sequence"), F.lit("X"))).alias("with_x"), F.count_if(F.contains(F.col("sequence"), F.lit("B"))).alias("with_b"))


@query(f"WITH RECURSIVE {COMPONENTS.format(0.65)}, b AS (SELECT root FROM comp GROUP BY root ORDER BY count(*) DESC, root LIMIT 1), x AS (SELECT a.root = (SELECT root FROM b) AS giant, NOT list_has_any(p.sources, q.sources) AS crossing FROM si JOIN comp a ON a.node = si.i JOIN short p ON p.entity_idx = si.i JOIN short q ON q.entity_idx = si.j WHERE si >= 0.65) SELECT count(*) AS edges, count(*) FILTER (giant) AS giant_edges, count(*) FILTER (crossing) AS cross_source FROM x")
def edge_totals(spark, d):
    """Edges in all, inside the giant, and across sources."""
    c = components(spark, d, 0.65)
    g = c.groupBy("root").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "root").limit(1).select(F.col("root").alias("g"))
    a = c.select(F.col("entity_idx").alias("i"), "root", F.col("sources").alias("p"))
    b = c.select(F.col("entity_idx").alias("j"), F.col("sources").alias("q"))
    e = edges(spark, d, 0.65).join(a, "i").join(b, "j").crossJoin(F.broadcast(g))  # one row
    return e.agg(F.count("*").alias("edges"), F.count_if(F.col("root") == F.col("g")).alias("giant_edges"), F.count_if(~F.arrays_overlap("p", "q")).alias("cross_source"))


def split_inputs(spark, d):
    c = components(spark, d, 0.65).withColumn("component", F.col("root"))
    seq = F.upper(F.replace("p_name", F.lit(" "), F.lit("")))
    o = table(spark, d, "part").select(seq.alias("sequence"), F.col("p_type").alias("source_dataset"), F.when(F.col("p_partkey") % 3 == 0, "continuous").otherwise("binary").alias("target_kind"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") / 50).otherwise(F.col("p_size") % 2).alias("target_value"))
    return c, o.join(c.select("sequence", "component"), "sequence")


def _gain(k: int) -> str:
    """SQL of what a component adds to the weighted error of split k."""
    return f"round(list_sum(list_transform(range(1, len(v) + 1), lambda i: w[i] * v[i] * (2 * (h{k}[i] - g{k}[i]) + v[i]) / g{k}[i])), 9)"


def _tie(k: int) -> str:
    """SQL of split k as a candidate: its error, then the hash that breaks ties."""
    return f"{{'e': e{k}, 'h': substr(sha256('{split.SEED}:' || component || ':{split.SPLITS[k]}'), 1, 16), 'k': {k}}}"


ALLOCATED = (
    COMPONENTS.format(0.65) + ", c AS (SELECT entity_idx, sequence, root AS component FROM comp JOIN short ON node = entity_idx), "
    "o AS (SELECT component, p_type AS src, p_partkey % 3 = 0 AS cont, CASE WHEN p_partkey % 3 = 0 THEN p_size / 50e0 ELSE p_size % 2 END AS v FROM part JOIN c ON c.sequence = upper(replace(p_name, ' ', ''))), "
    "ft AS (SELECT component, 'entities' AS feature, count(*)::DOUBLE AS value FROM c GROUP BY component UNION ALL SELECT component, feature, count(*)::DOUBLE FROM (SELECT component, 'observations' AS feature FROM o UNION ALL SELECT component, 'source:' || src FROM o "
    "UNION ALL SELECT component, CASE WHEN cont THEN 'value_bin:' || least(floor(greatest(least(v, 1), 0) * 10), 9)::INT ELSE 'binary:' || src || ':' || v::INT END FROM o) GROUP BY 1, 2), "
    "tot AS (SELECT feature, sum(value) AS t, CASE split_part(feature, ':', 1) WHEN 'value_bin' THEN 4e0 WHEN 'entities' THEN 4e0 WHEN 'binary' THEN 2e0 WHEN 'source' THEN 1.5e0 ELSE 1e0 END AS w FROM ft GROUP BY feature), "
    "goal AS (SELECT " + ", ".join(f"list(greatest({split.FRACTIONS[x]}e0 * t, 1e0) ORDER BY feature) AS g{k}" for k, x in enumerate(split.SPLITS)) + ", list(w ORDER BY feature) AS w FROM tot), "
    "vec AS (SELECT d.component, list(coalesce(ft.value, 0e0) ORDER BY tot.feature) AS v, max(ft.value) FILTER (tot.feature = 'entities') AS e, max(ft.value) FILTER (tot.feature = 'observations') AS obs FROM (SELECT DISTINCT component FROM c) d CROSS JOIN tot LEFT JOIN ft ON ft.component = d.component AND ft.feature = tot.feature GROUP BY d.component), "
    "ordered AS (SELECT component, v, row_number() OVER (ORDER BY e DESC NULLS LAST, obs DESC NULLS LAST, component) AS r FROM vec), "
    "fold(r, component, k, h0, h1, h2) AS (SELECT r, component, 0, v, list_transform(v, lambda x: 0e0), list_transform(v, lambda x: 0e0) FROM ordered WHERE r = 1 UNION ALL SELECT r, component, k, "
    + ", ".join(f"CASE WHEN k = {k} THEN list_transform(range(1, len(v) + 1), lambda i: h{k}[i] + v[i]) ELSE h{k} END" for k in range(3))
    + " FROM (SELECT *, list_sort([" + ", ".join(_tie(k) for k in range(3)) + "])[1].k AS k FROM (SELECT n.r, n.component, n.v, h0, h1, h2, " + ", ".join(f"{_gain(k)} AS e{k}" for k in range(3)) + " FROM fold JOIN ordered n ON n.r = fold.r + 1, goal))), "
    "s AS (SELECT entity_idx, component, CASE k WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM c JOIN fold USING (component))"
)


@query(f"WITH RECURSIVE {ALLOCATED} SELECT entity_idx, component, split FROM s")
def strict_split(spark, d):
    """Section 2.14: components to splits by a greedy balance; a sequential fold."""
    c, o = split_inputs(spark, d)
    return c.join(split.allocate(split.component_features(c, o)), "component").select("entity_idx", "component", "split")


@query(
    f"WITH RECURSIVE {ALLOCATED}, x AS (SELECT count(*) FILTER (si >= 0.65e0) AS violations, max(si) AS max_cross_identity, count(*) AS cross_pairs FROM si JOIN s a ON a.entity_idx = i JOIN s b ON b.entity_idx = j WHERE a.split <> b.split) "
    "SELECT x.*, (SELECT count(*) FROM s) AS entities, (SELECT count(*) - count(DISTINCT entity_idx) FROM s) AS repeated FROM x"
)
def split_validation(spark, d):
    """Section 2.15, J9: violations, closest pair and cross pairs of the split."""
    c, o = split_inputs(spark, d)
    s = Scratch(spark).write(c.join(split.allocate(split.component_features(c, o)), "component").select("entity_idx", "split"), "split")
    return split.validate(edges(spark, d, 0.0), s, 0.65)


SPLIT = "CASE entity_idx % 5 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END"


@query(f"WITH {SHORT}, s AS (SELECT {SPLIT} AS split FROM short) SELECT count(*) AS cross_pairs FROM (SELECT split, row_number() OVER () AS r FROM s) a JOIN (SELECT split, row_number() OVER () AS r FROM s) b ON a.r < b.r AND a.split <> b.split")
def cross_split_pairs(spark, d):
    """Pairs across splits by group sizes."""
    return split.cross_pairs(short(spark, d).withColumn("split", F.expr(SPLIT)))


@query(f"WITH RECURSIVE {LCS}, s AS (SELECT entity_idx, {SPLIT} AS split FROM short) SELECT i, j, round(si, 9) AS si FROM si JOIN s a ON a.entity_idx = i JOIN s b ON b.entity_idx = j WHERE a.split <> b.split ORDER BY si.si DESC, i DESC, j DESC LIMIT 1000")
def closest_cross_pairs(spark, d):
    """O2: the closest pairs across splits."""
    return split.closest_cross(edges(spark, d, 0.0), short(spark, d).withColumn("split", F.expr(SPLIT)), 1000).select("i", "j", F.round("si", 9).alias("si"))


@query(f"WITH {OBS}, t AS (SELECT *, n::DOUBLE AS x, (doc_id % 100)::DOUBLE AS z FROM obs), m AS (SELECT avg(x) AS mx, greatest(stddev_pop(x), 1e-6) AS sx, avg(z) AS mz, greatest(stddev_pop(z), 1e-6) AS sz FROM t WHERE doc_id % 4 <> 0) SELECT doc_id, round((x - mx) / sx, 6) AS z_x, round((z - mz) / sz, 6) AS z_z FROM t, m")
def train_only_standardise(spark, d):
    """Statistics of training rows only."""
    o = obs(spark, d).select("doc_id", F.col("n").cast("double").alias("x"), (F.col("doc_id") % 100).cast("double").alias("z"))
    return features.train_only_standardise(o, ["x", "z"], F.col("doc_id") % 4 != 0).select("doc_id", F.round("z_x", 6).alias("z_x"), F.round("z_z", 6).alias("z_z"))


NBR = RES + ", p AS (SELECT a.entity, a.pos AS i, b.pos AS j, sqrt(pow(a.value - b.value, 2) + pow(round(a.rsa * 100) - round(b.rsa * 100), 2)) AS dist FROM res a JOIN res b ON a.entity = b.entity AND a.pos <> b.pos), nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, i ORDER BY round(dist, 9), j) AS rank FROM p) WHERE rank <= 3)"


def neighbour_rows(spark, d):
    r = residues(spark, d).withColumn("c", F.round(F.col("rsa") * 100))
    return features.neighbours(r, "entity", "pos", ["value", "c"], 3), r


@query(f"WITH {NBR} SELECT entity, i, rank, round(dist, 6) AS dist FROM nb")
def entity_neighbours(spark, d):
    """Nearest positions within each entity."""
    return neighbour_rows(spark, d)[0].select("entity", "i", F.col("rank").cast("long").alias("rank"), F.round("dist", 6).alias("dist"))


@query(f"WITH {RES} SELECT a.entity, a.pos AS i, b.pos AS j, b.price AS nbr_price, round((b.pos - a.pos) / 8e0, 6) AS share, round(ln(1 + abs(b.pos - a.pos)) / ln(9), 6) AS log_share, abs(b.pos - a.pos) <= 4 AS near FROM res a JOIN res b ON a.entity = b.entity AND b.pos = (a.pos + 1) % 3")
def neighbour_gather(spark, d):
    """neighbours' values and their separation along the sequence."""
    r = residues(spark, d)
    n = r.select("entity", F.col("pos").alias("i"), F.pmod(F.col("pos") + 1, F.lit(3)).alias("j"))
    s = features.separation(F.col("i"), F.col("j"), F.lit(8.0))
    return features.gather(n, r, "entity", "pos", ["price"]).select("entity", "i", "j", "nbr_price", F.round(s[0], 6).alias("share"), F.round(s[1], 6).alias("log_share"), s[2].alias("near"))


@query("SELECT i, rank::INT AS rank, j, round(dist, 6) AS dist FROM (SELECT a.vec_id AS i, b.vec_id AS j, sqrt(list_sum(list_transform(range(1, 65), lambda k: pow(a.embedding[k]::DOUBLE - b.embedding[k]::DOUBLE, 2)))) AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY dist, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id) WHERE rank <= 3")
def knn_embeddings(spark, d):
    """Exact neighbours over the table, by blocks."""
    return features.knn(table(spark, d, "embeddings"), "vec_id", "embedding", 3).select("i", "rank", "j", F.round("dist", 6).alias("dist"))


@query("WITH v AS (SELECT vec_id, [embedding[k * 8 + 1 : k * 8 + 8] FOR k IN range(0, 8)] AS v FROM embeddings) SELECT vec_id, " + ", ".join(f"round(sqrt(list_sum(list_transform(v[{k + 1}], lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm_{k}" for k in range(8)) + ", " + ", ".join(f"round(list_sum(list_transform(range(1, 9), lambda i: v[{a + 1}][i]::DOUBLE * v[{b + 1}][i]::DOUBLE)), 6) AS gram_{a}_{b}" for a in range(8) for b in range(a, 8)) + " FROM v")
def vector_invariants(spark, d):
    """Norms and inner products of eight vectors: 44 invariants."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("embedding", k * 8 + 1, 8)).alias("v"))
    names = [f"norm_{k}" for k in range(8)] + [f"gram_{a}_{b}" for a in range(8) for b in range(a, 8)]
    return e.select("vec_id", *[F.round(c, 6).alias(n) for n, c in zip(names, features.invariants(F.col("v"), 8))])


@query("SELECT vec_id, round(list_sum(embedding[9:16]::DOUBLE[]), 6) AS group_sum, length(embedding[9:16]) AS width, list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AS finite FROM embeddings")
def column_groups(spark, d):
    """A slice of a wide vector, and the finite-value guard."""
    g = F.slice(F.col("embedding").cast("array<double>"), 9, 8)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(g, F.lit(0.0), lambda s, x: s + x), 6).alias("group_sum"), F.size(g).cast("long").alias("width"), finite.alias("finite"))


def patch_inputs(spark, d):
    nbrs, r = neighbour_rows(spark, d)
    n = nbrs.groupBy("entity", F.col("i").alias("pos")).agg(F.collect_list("j").alias("nbrs"), F.collect_list("dist").alias("dists"))
    empty = F.array().cast("array<long>"), F.array().cast("array<double>")
    full = r.join(n, ["entity", "pos"], "left").select("entity", "pos", F.col("token").alias("residue"), (F.col("rsa") * 10).alias("rsa"), F.coalesce("nbrs", empty[0]).alias("nbrs"), F.coalesce("dists", empty[1]).alias("dists"))
    return full, r


PATCHES = NBR + (
    ", cat(category, allowed) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in features.CATEGORIES.items()) + "), m AS (SELECT entity, pos, category, rsa * 10 >= 0.25e0 AND contains(allowed, token) AS inside FROM res, cat), "
    "l AS (SELECT nb.entity, a.category, nb.i, nb.j FROM nb JOIN m a ON a.entity = nb.entity AND a.pos = nb.i AND a.inside JOIN m b ON b.entity = nb.entity AND b.pos = nb.j AND b.inside AND b.category = a.category WHERE dist > 1e-6 AND dist <= 8), "
    "l2 AS (SELECT entity, category, i, j FROM l UNION SELECT entity, category, j, i FROM l), r(entity, category, node, root) AS (SELECT entity, category, pos, pos FROM m WHERE inside UNION SELECT r.entity, r.category, l2.j, r.root FROM r JOIN l2 ON l2.entity = r.entity AND l2.category = r.category AND l2.i = r.node), "
    "least_root AS (SELECT entity, category, node, min(root) AS root FROM r GROUP BY 1, 2, 3), "
    "patched AS (SELECT m.entity, m.pos, m.category, CASE WHEN root IS NOT NULL THEN dense_rank() OVER (PARTITION BY m.entity, m.category ORDER BY root NULLS LAST) - 1 END AS patch FROM m LEFT JOIN least_root k ON k.entity = m.entity AND k.category = m.category AND k.node = m.pos)"
)


@query(f"WITH RECURSIVE {PATCHES} SELECT entity, pos, category, patch FROM patched")
def surface_patches(spark, d):
    """Spatial patches of residue categories in each entity."""
    return features.patch_components(patch_inputs(spark, d)[0], "entity").select("entity", "pos", "category", "patch")


@query(f"WITH RECURSIVE {PATCHES} SELECT entity, category, patch, sum(value) AS total, min(value) AS low, max(value) AS high, count(*) AS n FROM patched JOIN res USING (entity, pos) WHERE patch IS NOT NULL GROUP BY 1, 2, 3")
def patch_pooling(spark, d):
    """Sums, minima and maxima over patches."""
    full, r = patch_inputs(spark, d)
    return features.patch_pool(r, features.patch_components(full, "entity"), "entity", "value")


@query(f"WITH RECURSIVE {PATCHES} SELECT entity, category, count(DISTINCT patch) AS patches FROM patched GROUP BY 1, 2")
def patch_counts(spark, d):
    """Patches of each category in each entity."""
    p = features.patch_components(patch_inputs(spark, d)[0], "entity")
    return p.groupBy("entity", "category").agg(F.count_distinct("patch").alias("patches"))


@query()
def pca_projection(spark, d):
    """Components of training rows only, applied to all."""
    e = table(spark, d, "embeddings")
    mean, comp, _ = features.fit_pca(e, "embedding", F.col("vec_id") % 5 != 0, 4)
    return features.project(e, "embedding", mean, comp).select("vec_id", F.transform("pc", lambda x: F.round(x, 6)).alias("pc"))


@query()
def forest_regression(spark, d):
    """Random forest and boosted trees (MLlib) on descriptors, trained on training rows."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    o = obs(spark, d)
    x = described(o.select("doc_id", F.col("quality").cast("double").alias("label"), F.upper("seq").alias("s")), "s")
    v = VectorAssembler(inputCols=NAMES, outputCol="features").transform(x).select("doc_id", "label", "features")
    train = v.where("doc_id % 4 <> 0")
    out = RandomForestRegressor(numTrees=20, maxDepth=4, seed=1, predictionCol="forest").fit(train).transform(v)
    out = GBTRegressor(maxIter=8, maxDepth=3, seed=1, predictionCol="boosted").fit(train).transform(out)
    return out.select("doc_id", "label", F.round("forest", 6).alias("forest"), F.round("boosted", 6).alias("boosted"))


@query(f"WITH {OBS} SELECT doc_id, round(0.02e0 + (1 - 0.02e0 - 0.05e0) / (1 + exp(-((ln(1 + exp(0.5e0)) + 1e-4) * (n / 1000e0) + tanh(doc_id / 1000e0) * 0.5e0))), 6) AS observed FROM obs")
def latent_endpoint(spark, d):
    """B2: softplus slope, bounded assay residual and a label-noise layer, as expressions."""
    import math

    slope = math.log1p(math.exp(0.5)) + 1e-4
    z = slope * (F.col("n") / 1000.0) + F.tanh(F.col("doc_id") / 1000.0) * 0.5
    return obs(spark, d).select("doc_id", F.round(0.02 + (1 - 0.02 - 0.05) / (1 + F.exp(-z)), 6).alias("observed"))


@query(f"WITH {RES} SELECT entity, round(avg(rsa * 10), 6) AS mean_confidence, round(count(*) FILTER (rsa * 10 < 0.7e0) / count(*), 6) AS low_share, round(ln(1 + count(*)) / 10, 6) AS log_length FROM res GROUP BY entity")
def quality_triple(spark, d):
    """Mean confidence, share of low confidence, scaled log length."""
    c = F.col("rsa") * 10
    return residues(spark, d).groupBy("entity").agg(F.round(F.avg(c), 6).alias("mean_confidence"), F.round(F.count_if(c < 0.7) / F.count("*"), 6).alias("low_share"), F.round(F.log1p(F.count("*").cast("double")) / 10, 6).alias("log_length"))


@query(f"WITH {RES}, m AS (SELECT entity, max(rsa) AS top FROM res GROUP BY entity) SELECT res.entity, pos, CASE WHEN top > 0.05 THEN rsa / 0.1e0 ELSE rsa END AS scaled, round(least(greatest(value * 0.2e0 / 50 + 0.3e0, 0), 1), 6) AS restored FROM res JOIN m USING (entity)")
def schema_adapter(spark, d):
    """P10: rescaling of a confidence by its range, and the inverse standardisation with clipping."""
    from pyspark.sql import Window as W

    top = F.max("rsa").over(W.partitionBy("entity"))
    return residues(spark, d).select("entity", "pos", F.when(top > 0.05, F.col("rsa") / 0.1).otherwise(F.col("rsa")).alias("scaled"), F.round(F.least(F.greatest(F.col("value") * 0.2 / 50 + 0.3, F.lit(0.0)), F.lit(1.0)), 6).alias("restored"))


@query(f"WITH {RES} SELECT entity, pos, round(value * 0.7e0 + sqrt(price) / 1e3 * 0.3e0, 6) AS late, round(value + (sqrt(price) / 1e3) / (1 + exp(-(rsa * 10))), 6) AS gated, round(value * (1 + rsa) + sqrt(price) / 1e3, 6) AS film, round(value * (ln(1 + exp(0.25e0)) + 1e-4) - 1, 6) AS head FROM res")
def fusion_forward(spark, d):
    """Late, gated and feature-wise fusion, and a monotone head, with given weights."""
    r, v, p = residues(spark, d), F.col("value"), F.sqrt("price") / 1e3
    return r.select("entity", "pos", F.round(fusion.late(v, p, 0.3), 6).alias("late"), F.round(fusion.gated_residual(v, p, F.col("rsa") * 10), 6).alias("gated"), F.round(fusion.film(v, F.col("rsa"), p), 6).alias("film"), F.round(fusion.monotone_head(v, 0.25, -1.0), 6).alias("head"))


@query(f"WITH {NBR}, w AS (SELECT nb.entity, i, exp(-pow(dist / 4e0, 2)) * (1 - b.rsa) AS w, b.value / 50 AS v FROM nb JOIN res b ON b.entity = nb.entity AND b.pos = nb.j WHERE dist > 0), m AS (SELECT entity, i, sum(w * v) / nullif(sum(w), 0) AS m FROM w GROUP BY 1, 2) SELECT res.entity, pos, round(value / 50 + tanh(coalesce(m, 0)), 6) AS out FROM res LEFT JOIN m ON m.entity = res.entity AND m.i = res.pos")
def message_passing(spark, d):
    """One attention layer over neighbours, scaled by their confidence."""
    nbrs, r = neighbour_rows(spark, d)
    v = r.select("entity", "pos", (F.col("value") / 50).alias("v"), (1 - F.col("rsa")).alias("c"))
    return fusion.message_layer(nbrs, v, "entity", "v", 4.0, "c").select("entity", "pos", F.round("out", 6).alias("out"))


@query(f"WITH {RES} SELECT entity, round(sum(value * (1 - rsa)) / greatest(sum(1 - rsa), 1e-6), 6) AS pooled FROM res GROUP BY entity")
def confidence_pool(spark, d):
    """Confidence-weighted pooling."""
    r = residues(spark, d).withColumn("c", 1 - F.col("rsa"))
    return fusion.confidence_gate(r, ["entity"], "value", "c").select("entity", F.round("pooled", 6).alias("pooled"))


@query(f"WITH {RES}, w AS (SELECT *, avg(value) OVER p AS m, stddev_pop(value) OVER p AS s FROM res WINDOW p AS (PARTITION BY entity)) SELECT entity, pos, round((value - m) / sqrt(s * s + 1e-5), 6) AS normed FROM w")
def layer_norm(spark, d):
    """Normalisation inside a group."""
    return fusion.layer_norm(residues(spark, d), ["entity"], "value").select("entity", "pos", F.round("normed", 6).alias("normed"))
