"""N-gram Jaccard join: a grouped prefix join with exact verification.

A document's set is its distinct 5-word shingles (64-bit hashes). Two sets of Jaccard similarity t or
more share one of their first n - ceil(t n) + 1 shingles in any common order. The order here is by
(estimated document frequency, hash), the estimate from a sketch of bounded size, so prefixes hold rare
shingles.

Copies with equal sets are one class. Classes of equal size and equal prefix are one group. Groups meet
in buckets of their prefix shingles, and pairs of groups pass bounds on size and position; only then are
they expanded to their classes, whose pairs pass a bound on parity maps of their sets and are verified on
whole sets. There are two rounds, so that a big group of near copies never gives all its pairs:

1. the pivot of each shingle and size band against the other groups that hold it, and a head of each
   group against its other classes;
2. every pair of groups that share a shingle and still lie in different components; and, within a group
   whose classes still do, every pair of classes in different components that share one of the shingles
   that follow the prefix (a linked pair shares one of the next n - o + 1, o the overlap it needs).

A pair that is never verified thus lies within one component already, or can't link, and components are
those of the complete link graph.

A task sends each prefix shingle of its rows once for each size band; further groups with the same shingle
stay beside the one that was sent, so a bucket holds at most a row for each task's chunk, whatever a
shingle's frequency. Rows in Spark are shingles that two groups share at least.

Defined cases: a null or empty text, or one of separators only, has n_shingles 0 and links with
nothing; a null doc_id takes no part (component_id null); rows that repeat are copies; an empty table
gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.textcore import SKETCH, Counters, frugal, frugal_group, from_planes, merge_counters, planes, shingle_sets, slices, words
from quern.operators.graph import connected_components
from quern.plans.scratch import Scratch, setting

PARITY = 1024  # bits of a set's parity map
FLUSH = 500_000  # prefix shingles that a task holds at once
BUCKET = 500_000  # prefix shingles in a bucket, about


def _each(batches, k):
    """(row number, set, batch) of every row of the batches."""
    for b in batches:
        for i, j, data, off in slices(b.column(1)):
            yield b, i, shingle_sets(*words(data, off), k)


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _prefix(n: int, t: tuple[int, int]) -> int:
    return n - -(-t[0] * n // t[1]) + 1


def _ordered(s: np.ndarray, est: np.ndarray) -> np.ndarray:
    """A set in the common order. s is sorted, so a stable sort by frequency leaves ties in hash order."""
    return s[np.argsort(est[(s & np.uint64(SKETCH - 1)).astype(np.int64)], kind="stable")]


def frequencies(docs: DataFrame, k: int) -> np.ndarray:
    def run(batches):
        c = Counters()
        for _, _, sets in _each(batches, k):
            c.add(np.concatenate(sets))
        yield c.rows()

    return merge_counters(docs.mapInArrow(frugal(run), "part int, counts binary"))


def profiles(docs: DataFrame, k: int, t: tuple[int, int], freq) -> DataFrame:
    """doc_id, th (hash of the text), n, and of sets that aren't empty sig, pre, prefix and bits."""
    def run(batches):
        est = freq.value
        for b, i, sets in _each(batches, k):
            sig, pre, prefix, bits = [], [], [], []
            for s in sets:
                if not len(s):
                    sig.append(None), pre.append(None), prefix.append(None), bits.append(None)
                    continue
                odd = np.bincount((s >> np.uint64(40) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
                own = _ordered(s, est)[: _prefix(len(s), t)].tobytes()
                sig.append(_digest(s.tobytes())), pre.append(_digest(own)), prefix.append(own)
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            at = [b.column(c).slice(i, len(sets)) for c in (0, 2)]
            yield pa.RecordBatch.from_arrays(
                [*at, pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary()), pa.array(pre, pa.binary()), pa.array(prefix, pa.binary()), pa.array(bits, pa.list_(pa.int64()))],
                ["doc_id", "th", "n", "sig", "pre", "prefix", "bits"],
            )

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    return rows.mapInArrow(frugal(run), "doc_id long, th long, n long, sig binary, pre binary, prefix binary, bits array<bigint>")


def may_pair(na, nb, i, j, t: tuple[int, int]):
    """Size and position: at its first common shingle a linked pair has room for the overlap it needs."""
    num, den = t
    return (np.minimum(na, nb) * den >= np.maximum(na, nb) * num) & (np.minimum(na - i, nb - j) * (num + den) >= (na + nb) * num)


def _heads(token, band, pos, gid):
    """Order of the rows by token and band, and for each row the place of the pivot of its token and band: the
    group with the fewest rarer shingles, which is the least edited of near copies."""
    o = np.lexsort((gid, pos, band, token))
    first = np.ones(len(o), bool)
    first[1:] = (token[o][1:] != token[o][:-1]) | (band[o][1:] != band[o][:-1])
    head = np.empty(len(o), np.int64)
    head[o] = o[np.flatnonzero(first)[np.cumsum(first) - 1]]
    return o, head


def shared_shingles(groups: DataFrame, buckets: int, t: tuple[int, int]) -> DataFrame:
    """(token, gid, n, pos, pivot): prefix shingles that two groups share at least; pivot is a group with
    the shingle and size band that may link with the row's. groups: gid, n, prefix; a group may have
    several rows."""
    num, den = t
    kinds = (("token", np.uint64), ("gid", np.int64), ("n", np.int32), ("pos", np.int32), ("lead", np.int64), ("shared", np.int8))
    names = ["bucket", *(c for c, _ in kinds)]
    cuts = [-(-(x << 64) // buckets) for x in range(1, buckets)]

    def send(batches):
        task = TaskContext.get().partitionId()
        held, parts, seen = 0, [], set()

        def flush():
            sizes = [len(p[2]) for p in parts]
            token = np.concatenate([p[2] for p in parts])
            gid, n = (np.repeat(np.array([p[c] for p in parts], kind), sizes) for c, kind in ((0, np.int64), (1, np.int32)))
            pos = np.concatenate([np.arange(x, dtype=np.int32) for x in sizes])
            band = np.floor(np.log(n) / math.log(den / num)).astype(np.int64)
            o, head = _heads(token, band, pos, gid)
            # whether other groups of this chunk hold the token
            t_o = token[o]
            twin = np.zeros(len(o), bool)
            twin[1:] = t_o[1:] == t_o[:-1]
            twin[:-1] |= t_o[1:] == t_o[:-1]
            own = {"token": token, "gid": gid, "n": n, "pos": pos, "lead": np.where(may_pair(n.astype(np.int64), n[head].astype(np.int64), pos, pos[head], t), gid[head], gid), "shared": np.ones(len(o), np.int8)}
            own["shared"][o] = twin
            sent = head[o] == o
            at, bucket = [], []
            go = o[sent]
            for k, part in enumerate(np.split(go, np.searchsorted(token[go], np.array(cuts, np.uint64)))):
                if len(part):
                    at.append(part), bucket.append(k)
            if not sent.all():
                at.append(o[~sent]), bucket.append(-1 - task)
            cols = []
            for c, _ in kinds:
                body = []
                for part in at:
                    v = own[c][part]
                    if c == "token":
                        v = np.diff(v, prepend=np.uint64(0))
                    elif c == "lead":
                        v = v - own["gid"][part]
                    body.append(planes(v))
                cols.append(pa.array(body, pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), *cols], names)

        for b in batches:
            for g, n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if g in seen:
                    continue
                seen.add(g)
                parts.append((g, n, np.frombuffer(raw, np.uint64)))
                held += len(parts[-1][2])
                if held > FLUSH:
                    yield flush()
                    held, parts, seen = 0, [], set()
        if held:
            yield flush()

    def keep(key, pdf):
        import pandas as pd

        got = {c: [from_planes(x, kind) for x in pdf[c]] for c, kind in kinds}
        got["token"] = [np.cumsum(x, dtype=np.uint64) for x in got["token"]]
        token, gid, n, pos, lead, shared = (np.concatenate(got[c]) for c, _ in kinds)
        lead = lead + gid
        if key[0] >= 0:
            # a group's rows from several chunks count once
            order = np.lexsort((-shared, gid, token))
            once = np.ones(len(order), bool)
            once[1:] = (token[order][1:] != token[order][:-1]) | (gid[order][1:] != gid[order][:-1])
            order = order[once]
            token, gid, n, pos, shared = (x[order] for x in (token, gid, n, pos, shared))
            new = np.ones(len(token), bool)
            new[1:] = token[1:] != token[:-1]
            run = np.cumsum(new) - 1
            live = (np.bincount(run, minlength=1)[run] > 1) | (shared > 0)
            token, gid, n, pos = (x[live] for x in (token, gid, n, pos))
            _, head = _heads(token, np.floor(np.log(n) / math.log(den / num)).astype(np.int64), pos, gid)
            lead = np.where(may_pair(n.astype(np.int64), n[head].astype(np.int64), pos, pos[head], t), gid[head], gid)
        return pd.DataFrame({"token": token.astype(np.int64), "gid": gid, "n": n, "pos": pos, "pivot": pd.arrays.IntegerArray(lead, lead == gid)})

    packed = groups.select("gid", "n", "prefix").mapInArrow(frugal(send), "bucket long, token binary, gid binary, n binary, pos binary, lead binary, shared binary")
    return packed.groupBy("bucket").applyInPandas(frugal_group(keep), "token long, gid long, n int, pos int, pivot long")


def _marked(hashes: DataFrame):
    """Broadcast bit map, of bounded size, of the hashes in the columns."""
    def mark(batches):
        c = Counters()
        for b in batches:
            for col in b.columns:
                c.add(col.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        yield c.rows()

    return hashes.sparkSession.sparkContext.broadcast(np.packbits(merge_counters(hashes.mapInArrow(frugal(mark), "part int, counts binary")) > 0))


def _reread(docs: DataFrame, bits, k: int, make, schema: str) -> DataFrame:
    """make(doc_id, set, text) of every document whose id is marked and whose set isn't empty."""
    def run(batches):
        flags = np.unpackbits(bits.value).astype(bool)
        names = [c.split()[0] for c in schema.split(", ")]
        types = [{"long": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}[c.split()[1]] for c in schema.split(", ")]
        for b in batches:
            h = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            own = b.filter(pa.array(flags[(h & np.uint64(SKETCH - 1)).astype(np.int64)]))
            for _, i, got in _each([own], k):
                rows = [make(own.column(0)[i + j].as_py(), s, own.column(1)[i + j].as_py()) for j, s in enumerate(got) if len(s)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(frugal(run), schema)


def verify(docs: DataFrame, pairs: DataFrame, classes: DataFrame, k: int, t: tuple[int, int], scratch: Scratch) -> tuple[DataFrame, int]:
    """The pairs (a, b) of class ids whose sets have the similarity, and their number. Only texts of classes in
    pairs are read again, and travel compressed: a sketch of their ids, of bounded size, drops the
    others before any shuffle."""
    spark = docs.sparkSession
    x = classes.select(F.col("cid").alias("a"), F.col("doc").alias("da"), F.col("sig").alias("ga"))
    y = classes.select(F.col("cid").alias("b"), F.col("doc").alias("db"), F.col("sig").alias("gb"))
    pairs = scratch.keep(pairs.join(x, "a").join(y, "b"))
    bits = _marked(pairs.select(F.xxhash64("da").alias("x"), F.xxhash64("db").alias("y")))
    num, den = t

    def packed(doc, s, text):
        return doc, _digest(s.tobytes()), zstandard.compress(text.encode(), 3)

    found = scratch.keep(_reread(docs, bits, k, packed, "doc long, sig binary, z binary"))

    def unpacked(col):
        """The set of each distinct text of a column, and where each row's is."""
        open_ = zstandard.ZstdDecompressor()
        kinds = col.dictionary_encode()
        raw = pa.array([open_.decompress(z.as_py()).decode() for z in kinds.dictionary], pa.string())
        return [s for _, _, data, off in slices(raw) for s in shingle_sets(*words(data, off), k)], kinds.indices.to_pylist()

    def judge(batches):
        for b in batches:
            (xs, xi), (ys, yi) = unpacked(b.column(2)), unpacked(b.column(3))
            ok = []
            for i, j in zip(xi, yi):
                x, y = xs[i], ys[j]
                both = np.sort(np.concatenate([x, y]))
                inter = int((both[1:] == both[:-1]).sum())
                ok.append(den * inter >= num * (len(x) + len(y) - inter))
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    sa = found.select(F.col("doc").alias("da"), F.col("sig").alias("ga"), F.col("z").alias("za"))
    sb = found.select(F.col("doc").alias("db"), F.col("sig").alias("gb"), F.col("z").alias("zb"))
    full = pairs.join(sa, ["da", "ga"]).select("a", "b", "za", "db", "gb").join(sb, ["db", "gb"]).select("a", "b", "za", "zb")
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "500"):
        out = scratch.keep(full.mapInArrow(frugal(judge), "a long, b long").distinct())
        n = out.count()
    scratch.drop(found, pairs)
    return out, n


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: tuple[int, int] = (75, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; see the module for the method and the cases."""
    own = components(docs, id_col, text_col, k, threshold)
    return own.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def components(docs: DataFrame, id_col: str, text_col: str, k: int, threshold: tuple[int, int]) -> DataFrame:
    """doc_id, th, n of every row, and of rows that take part root and least (smallest doc_id) of their component."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    num, den = threshold
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    freq = spark.sparkContext.broadcast(frequencies(docs, k))
    full = scratch.write(profiles(docs, k, threshold, freq), "profiles")
    part = full.where("n > 0 and doc_id is not null").withColumn("gid", F.xxhash64("n", "pre"))
    size = part.agg(F.sum(F.length("prefix") / 8)).first()[0] or 0
    live = scratch.write(shared_shingles(part, max(64, math.ceil(size / BUCKET)), threshold), "shared")
    own = part.groupBy("sig", "n", "gid").agg(F.min("doc_id").alias("doc"), F.first("bits").alias("bits"))
    classes = scratch.write(own.select(F.monotonically_increasing_id().alias("cid"), "gid", "n", "sig", "doc", "bits"), "classes")
    seen = scratch.write(full.select("doc_id", "th", "n", "sig"), "documents")
    scratch.drop(full)
    scratch.sweep()

    # first round: the pivots that the buckets found, and each group's head
    slim = classes.select("cid", "gid")
    stars = live.where("pivot is not null").select(F.col("pivot").alias("ga"), F.col("gid").alias("gb")).distinct()
    across = stars.join(slim.select(F.col("gid").alias("ga"), F.col("cid").alias("a")), "ga").join(slim.select(F.col("gid").alias("gb"), F.col("cid").alias("b")), "gb").select("a", "b")
    head = slim.groupBy("gid").agg(F.min("cid").alias("a"), F.count("*").alias("c")).where("c > 1").select("gid", "a")
    inside = slim.join(head, "gid").where("cid <> a").select("a", F.col("cid").alias("b"))
    links, n_links = verify(docs, across.union(inside).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), classes, k, threshold, scratch)
    links = scratch.write(links, "links", n_links)
    roots = connected_components(links, scratch, rows=n_links)
    rooted = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    rooted = scratch.write(rooted.select("cid", "gid", "n", "root", "doc", "sig", "bits"), "rooted")

    # second round, exactly: every pair that still lies in different components
    more = across_groups(live, rooted, threshold, scratch).union(within_groups(docs, rooted, k, threshold, freq))
    x, y = (rooted.select(*[F.col(c).alias(f"{c}_{v}") for c in ("cid", "n", "bits")]) for v in "xy")
    more = more.distinct().join(x, F.col("a") == F.col("cid_x")).join(y, F.col("b") == F.col("cid_y"))
    # bits in which two parity maps differ are at most the shingles that only one set has
    apart = sum((F.bit_count(F.col("bits_x")[w].bitwiseXOR(F.col("bits_y")[w])) for w in range(PARITY // 64)), F.lit(0))
    more = more.where(apart * (num + den) <= (F.col("n_x") + F.col("n_y")) * (den - num)).select("a", "b")
    new, n_new = verify(docs, more, classes, k, threshold, scratch)
    scratch.drop(live)
    if n_new:
        roots = connected_components(links.union(new), scratch, rows=n_links + n_new)

    final = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("sig", "doc", F.coalesce("root", "cid").alias("root"))
    least = final.groupBy("root").agg(F.min("doc").alias("least"))
    return seen.join(final.join(least, "root").select("sig", "root", "least"), "sig", "left").drop("sig")


def across_groups(live: DataFrame, rooted: DataFrame, t: tuple[int, int], scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of classes in different components whose groups share a shingle and may link."""
    num, den = t
    span = rooted.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    # where two prefixes also agree in their last shared shingle before this one, the pair is met there
    before = F.lag("token").over(W.partitionBy("gid").orderBy("pos"))
    r = live.select("token", "gid", "n", "pos").join(span, "gid").withColumn("before", before)
    r = r.where("before is null or before <> token")  # a row that two chunks of copies gave
    # beyond this position the smaller set has no first common shingle
    first = F.col("pos") * (num + den) <= F.col("n") * (den - num)
    torn = r.groupBy("token").agg(F.min("lo").alias("l"), F.max("hi").alias("h"), F.max(first).alias("f")).where("l < h and f").select("token")
    r = scratch.write(r.join(torn, "token"), "torn")
    u, v = r.where(first).alias("u"), r.alias("v")
    na, nb, i, j = (F.col(f"{x}.{c}").cast("long") for c in ("n", "pos") for x in "uv")
    fits = (na * den >= nb * num) & (F.least(na - i, nb - j) * (num + den) >= (na + nb) * num)
    bigger = (nb > na) | ((nb == na) & (F.col("v.gid") > F.col("u.gid")))
    one = (F.col("u.lo") == F.col("u.hi")) & (F.col("v.lo") == F.col("v.hi")) & (F.col("u.lo") == F.col("v.lo"))
    met = F.coalesce(F.col("u.before") == F.col("v.before"), F.lit(False))
    pairs = u.join(v, F.col("u.token") == F.col("v.token")).where(bigger & fits & ~one & ~met).select(F.col("u.gid").alias("ga"), F.col("v.gid").alias("gb")).distinct()
    x, y = (rooted.select(*[F.col(c).alias(f"{c}_{s}") for c in ("cid", "gid", "root")]) for s in "xy")
    pairs = pairs.join(x, F.col("ga") == F.col("gid_x")).join(y, F.col("gb") == F.col("gid_y")).where("root_x <> root_y")
    return pairs.select(F.least("cid_x", "cid_y").alias("a"), F.greatest("cid_x", "cid_y").alias("b"))


def within_groups(docs: DataFrame, rooted: DataFrame, k: int, t: tuple[int, int], freq) -> DataFrame:
    """Pairs (a, b) of classes in different components of one group that share a shingle beyond the prefix."""
    num, den = t
    several = rooted.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("gid")
    inner = rooted.join(several, "gid").select("cid", "gid", "root", "doc", "sig")
    if inner.isEmpty():
        return inner.select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    bits = _marked(inner.select(F.xxhash64("doc").alias("x")))

    def following(doc, s, text):
        n = len(s)
        p, need = _prefix(n, t), -(-2 * n * num // (num + den))
        return doc, _digest(s.tobytes()), _ordered(s, freq.value)[p : p + n - need + 1].view(np.int64)

    rows = _reread(docs, bits, k, following, "doc long, sig binary, next array<bigint>").dropDuplicates(["doc", "sig"])
    rows = inner.join(rows, ["doc", "sig"]).select("cid", "gid", "root", F.explode("next").alias("token"))
    u, v = rows.alias("u"), rows.alias("v")
    return u.join(v, ["gid", "token"]).where("u.cid < v.cid and u.root <> v.root").select(F.col("u.cid").alias("a"), F.col("v.cid").alias("b"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: tuple[int, int] = (75, 100)) -> DataFrame:
    """docs with one document of each component, that of the smallest id (of equal ids the smallest hash of
    the text). Rows with a null id or without words stay; of rows that repeat an id and a text that stay, one."""
    got = components(docs, id_col, text_col, k, threshold).where("root is not null and doc_id is not null")
    kept = got.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("k")).select(F.col("k.doc_id").alias("i"), F.col("k.th").alias("th"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("i"), F.xxhash64(text_col).alias("th"))
    apart = F.col("i").isNull() | ~F.coalesce(F.col("row")[text_col].rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    one = rows.where(~apart).join(kept, ["i", "th"], "left_semi").dropDuplicates(["i", "th"])
    return one.select("row").union(rows.where(apart).select("row")).select("row.*")


def op2_jaccard_join(spark, d):
    return near_duplicates(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k : k + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, hash(x) AS h, x FROM (SELECT doc_id, sh, unnest(sh) AS x FROM s)),
p AS (SELECT a.doc_id AS i, b.doc_id AS j FROM e a JOIN e b ON a.h = b.h AND a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l AS (SELECT i, j FROM p UNION ALL SELECT j, i FROM p),
r(node, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.j, r.root FROM r JOIN l ON r.node = l.i WHERE r.root < l.j),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, c.root AS component_id FROM s JOIN c ON c.node = s.doc_id
"""
