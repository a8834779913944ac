import random

import corpus_pipeline as P
from quern.llm.packing import encoder
from tests.llm.test_native import brute_lines
from tests.llm.test_text_operators import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(11)
    words = {"en": ["the", "and", "with", "thing", "over", "shine", "river"], "fr": ["être", "eau", "mentré", "chien", "oui", "ça", "lune"]}
    rows = []
    for k in range(160):
        lang = r.choice(list(words))
        rows.append((k, "\n".join(" ".join(r.choices(words[lang], k=9)) for _ in range(r.choice([1, 4, 8]))), lang, r.choice(["a", "a", "a", "b"])))
    block = "\n".join(" ".join(r.choices(words["en"], k=9)) for _ in range(3))
    rows += [(200 + k, rows[k][1] + "\n" + block, "en", "b") for k in range(5)]
    rows += [(300 + k, rows[k + 20][1], rows[k + 20][2], "a") for k in range(6)]
    rows += [(400, None, "en", "a"), (401, "12 34", "en", "b"), (402, "", None, None)]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    state = rows
    names = [n for n, _ in P.STAGES]
    assert names == ["language_id", "line_dedup", "jaccard_join", "mixing", "packing"]
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        got = sorted(docs.collect())
        if name == "language_id":
            expect = sorted(x for x in state if x[0] not in (400, 401, 402))
        elif name == "line_dedup":
            expect = sorted((x[0], t, x[2], x[3], len(t)) for x, t in zip(state, brute_lines([x[:2] for x in state])))
        elif name == "jaccard_join":
            kept = {i for i, _, c in brute_components([x[:2] for x in state]) if i == c}
            kept |= {x[0] for x in state if not (x[1] or "").split()}
            expect = sorted(x for x in state if x[0] in kept)
        elif name == "mixing":
            copies = {x[0]: sum(g[0] == x[0] for g in got) for x in state}
            assert set(copies.values()) <= {1, 2} and {tuple(g) for g in got} == set(state)
            big = {s: sum(len((x[1] or "").split()) for x in state if x[3] == s) for s in {x[3] for x in state}}
            assert all(copies[x[0]] == 1 for x in state if x[3] == max(big, key=big.get))
            state = [tuple(g) for g in got]
            continue
        else:
            encode, total = encoder(), {}
            for g in got:
                total[g["doc_id"]] = total.get(g["doc_id"], 0) + g["length"]
            assert total == {i: sum(len(encode(x[1] or "")) + 1 for x in state if x[0] == i) for i in {x[0] for x in state}}
            continue
        assert [tuple(g) for g in got] == expect, name
        state = expect
    final = P.run(spark, str(tmp_path))
    assert final.columns == docs.columns and final.agg({"length": "sum"}).first()[0] == sum(total.values())


def test_edge_cases_pass_every_stage(spark, tmp_path):
    """No language labelled, nulls, a repeated id with another text, a very long text, columns with clashing names; and an empty table."""
    long = "river shine " * 40_000
    rows = [(1, "the and with thing over shine"), (1, "lune chien oui eau encore une fois"), (2, long), (3, None), (4, ""), (5, "12 34"), (None, "the river over the lune"), (6, "the and with thing over shine")]
    schema = SCHEMA + ", row string, i string, th string, s string"
    docs = spark.createDataFrame([(i, t, None, None, len(t or ""), "r", "i", "t", "s") for i, t in rows], schema)
    docs.write.parquet(str(tmp_path / "some" / "documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    got = P.run(spark, str(tmp_path / "some")).groupBy("doc_id").sum("length").collect()
    encode = encoder()
    want = {2: len(encode(long)) + 1, None: len(encode(rows[6][1])) + 1, 1: len(encode(rows[0][1])) + len(encode(rows[1][1])) + 2}
    assert {r[0]: r[1] for r in got} == want
    assert P.run(spark, str(tmp_path / "none")).count() == 0
