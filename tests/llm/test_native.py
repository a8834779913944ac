import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm.line_dedup import dedup_lines
from quern.llm.mixing import mix_sources, solve
from quern.llm.packing import differencing, encoder, pack, pack_group
from quern.llm.sharding import shard

DOCS = "doc_id long, text string, source string, gone string, row string, l string, i string"


def docs(spark, rows):
    return spark.createDataFrame([(*r[:2], r[2] if len(r) > 2 else "s", "g", "r", "l", "i") for r in rows], DOCS)


def brute_lines(rows):
    seen, out = {}, {}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    for k in order:
        i, t = rows[k][:2]
        if t is None:
            out[k] = None
            continue
        ls, gone = t.split("\n"), set()
        for p in range(len(ls) - 2):
            w = tuple(ls[p : p + 3])
            if not "".join(w).strip(" "):
                continue
            first = seen.setdefault(w, (i, t, p))
            if first == (i, t, p):
                continue
            start = max(p, first[2] + 3) if first[:2] == (i, t) else p
            gone |= set(range(start, p + 3))
        out[k] = "\n".join(x for j, x in enumerate(ls) if j not in gone)
    return [out[k] for k in range(len(rows))]


def test_line_dedup(spark):
    rows = [
        (1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, "q\n" * 8 + "z"), (4, None), (5, ""), (6, "one\ntwo"), (7, "\n\n\n\n\n"),
        (8, "a\nb\nc"), (None, "n\nb\nc\nd"), (9, "long\n" + "w\ne\nr\n" * 3000), (1, "a\nb\nc\nd"),
    ]
    got = dedup_lines(docs(spark, rows))
    assert got.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    expect = brute_lines(rows[:-1])
    expect.append(expect[0])
    assert Counter((r["doc_id"], r["text"], r["gone"]) for r in got.collect()) == Counter((r[0], t, "g") for r, t in zip(rows, expect))
    assert dedup_lines(docs(spark, rows).limit(0)).count() == 0


def test_mixing(spark):
    rows = [(k, "w " * (k % 5 + 1), "hot") for k in range(400)] + [(1000 + k, "w w w", "b") for k in range(50)] + [(2000, None, None), (2001, "x", None), (2002, "", "empty"), (None, "a b", "hot")]
    d = docs(spark, rows)
    got = mix_sources(d, max_repetition=2.0)
    assert got.columns == d.columns
    n = Counter(r["doc_id"] for r in got.collect())
    assert set(n) == {r[0] for r in rows}
    assert n[2000] == n[2001] == 2 and n[2002] == 1 and n[5] == 1
    assert 1 <= min(n[k] for k in range(1000, 1050)) and max(n[k] for k in range(1000, 1050)) <= 2
    full = mix_sources(d, budget_tokens=300, max_repetition=5.0, details=True).groupBy("source").agg(F.sum("n_tokens")).collect()
    assert 270 <= sum(r[1] for r in full) <= 300
    assert mix_sources(d.limit(0)).count() == 0
    sources = spark.createDataFrame([(1000,), (10,), (1,)], "t long")
    for repetition, entropy, budget in ((3.0, None, None), (None, 0.5, 100), (3.0, None, 1500)):
        alpha, factor, hi = solve(sources, repetition, entropy, budget)
        want = [factor * (t / hi) ** alpha for t in (1000, 10, 1)]
        p = [x / sum(want) for x in want]
        if entropy:
            assert -sum(x * math.log(x) for x in p) == pytest.approx(0.5) and sum(want) == pytest.approx(100)
        else:
            assert max(x / t for t, x in zip((1000, 10, 1), want)) == pytest.approx(3.0) and (not budget or sum(want) == pytest.approx(budget))
    longer = docs(spark, [(1, "w " * 300_000, "a"), (2, "w", "b"), (3, "w " * 200_000, "a")])
    assert Counter(r["doc_id"] for r in mix_sources(longer).select("doc_id").collect()) == {1: 1, 2: 2, 3: 1}


def test_differencing_holds_every_item_and_is_even():
    sizes = [(k * 7919) % 2000 + 1 for k in range(300)]
    got = differencing(sizes, 40)
    assert sorted(i for w in got for i in w) == list(range(300))
    sums = [sum(sizes[i] for i in w) for w in got]
    assert max(sums) - min(sums) < 0.02 * sum(sums) / 40
    assert differencing([], 0) == [] and differencing([5], 3).count([]) == 2


@pytest.mark.parametrize("lengths", [[1], [2048], [2049, 5, 4000], [1, 1, 1], [(k * 37) % 900 + 1 for k in range(200)], [1100] * 9, [2047] * 5, [5000, 1500, 1500, 1500, 3], []])
def test_pack_group_has_no_padding(lengths):
    pieces = pack_group(lengths)
    for d, n in enumerate(lengths):
        at = 0
        for s, k in sorted((p[1], p[2]) for p in pieces if p[0] == d):
            assert s == at and k > 0
            at += k
        assert at == n
    by = defaultdict(list)
    for _, _, n, q, o in pieces:
        by[q].append((o, n))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0
    # all but fewer than a window's tokens lie in full windows
    assert sum(n for own in by.values() for _, n in own if sum(x for _, x in own) < 2048) < 2048


def test_packing_round_trip(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = ["hello world", None, "", "a" * 5000, "ß <|endoftext|> x\n\n  y", "x <|endoftext|> y<|endoftext|>", "word " * 9000, "same", "same"]
    got = pack(docs(spark, list(enumerate(texts))), with_ids=True).collect()
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        assert b"".join(r["ids"] for r in own) == b"".join(x.to_bytes(4, "little") for x in ids)
        assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"] for r in own)
    assert encoder()("hello") == tok.encode("hello").ids
    assert pack(docs(spark, [(1, "x")]).limit(0)).count() == 0


def test_sharding(spark):
    rows = [(k, f"text {k} " + "y" * (k * 31 % 500)) for k in range(2000)] + [(5000 + k, "the same long text of a group") for k in range(1000)] + [(None, None), (-7, ""), (9, "rep"), (9, "rep"), (99999, "z" * 20000)]
    got = shard(docs(spark, rows)).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    sums = [sum(r["size"] for r in v) for v in by.values()]
    assert max(sums) - sum(sums) / 16 <= 20001 + 0.001 * sum(sums)
    # a cell no probe can split is at most the longest text or the copies of one key
    even = [(k, "t" + str(k * 7919)) for k in range(4000)]
    parts = [r["b"] for r in shard(docs(spark, even)).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(parts) == 16 and max(parts) - min(parts) < 0.02 * sum(parts) / 16
    assert shard(docs(spark, rows).limit(0)).count() == 0
    assert shard(docs(spark, [(1, "only")])).collect()[0]["slot"] == 0
