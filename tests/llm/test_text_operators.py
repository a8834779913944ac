import base64
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import jaccard_join, language_id, lm_scoring, quality, textcore

LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SCHEMA = "doc_id long, text string, lang string, n long, sig string, cid string, score double"


def tokens(t):
    return (t or "").encode().translate(LOW).split()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "x", "y", 0.5) for i, t in rows], SCHEMA)


def corpus(seed=1, n=120):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    out = []
    for k in range(n):
        out.append((k, " ".join(r.choices(vocab, k=r.choice([3, 5, 6, 40, 90, 200])))))
    near = []
    for k in range(0, 60, 2):
        w = out[k][1].split()
        for v in range(r.choice([1, 2, 5])):
            x = list(w)
            for _ in range(max(1, len(x) // 40)):
                x[r.randrange(len(x))] = r.choice(vocab)
            near.append((1000 + len(near), " ".join(x)))
    passage = " ".join(r.choices(vocab, k=60))
    shared = [(2000 + k, passage + " " + " ".join(r.choices(vocab, k=30))) for k in range(40)]
    odd = [(3000, None), (3001, ""), (3002, " \t\n"), (3003, "ONE two"), (3004, "one TWO"), (3005, "a b c d"), (3006, "a b c d e"), (3007, "x\x0by\x1cz"), (3008, "É é È"), (3009, "word " * 20000), (3010, "word " * 19000)]
    return out + near + shared + odd + [(5, out[5][1]), (3003, "ONE two")]


def sets_of(rows):
    out = []
    for _, t in rows:
        w = tokens(t)
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def brute_components(rows):
    sets, parent = sets_of(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    low = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        low[find(k)].append(i)
    return [(i, len(s), min(low[find(k)])) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def test_words_are_those_of_bytes():
    texts = [t for _, t in corpus()] + ["x" * 3_000_000 + " y " + "ab " * 1_500_000 + "tail"]
    got = []
    for _, _, data, off in textcore.slices(pa.array(texts), 1 << 16):
        h, n = textcore.words(data, off)
        got += np.split(h, np.cumsum(n)[:-1])
    names = {}
    for t, h in zip(texts, got):
        w = tokens(t)
        assert len(w) == len(h)
        for x, y in zip(w, h.tolist()):
            assert names.setdefault(x, y) == y
    assert len(set(names.values())) == len(names)


def test_jaccard_join_against_brute_force(spark):
    rows = corpus()
    got = jaccard_join.near_duplicates(frame(spark, rows + [(None, "one two")])).collect()
    assert Counter(tuple(r) for r in got if r[0] is not None) == Counter(brute_components(rows))
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


@pytest.mark.parametrize("seed", [2, 3])
def test_jaccard_join_small_chunks_and_bounds(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard_join, "FLUSH", 300)
    monkeypatch.setattr(jaccard_join, "BUCKET", 100)
    rows = corpus(seed, 60)
    got = jaccard_join.near_duplicates(frame(spark, rows + rows[:30])).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute_components(rows + rows[:30]))
    assert jaccard_join.near_duplicates(frame(spark, rows).limit(0)).count() == 0
    assert jaccard_join.near_duplicates(frame(spark, [(1, None), (2, "")])).count() == 2


def triples(seed):
    """Documents made of common passages: of each three of equal size and prefix the last two link, neither with the first."""
    r = random.Random(seed)

    def passage(n):
        return [f"p{r.random()}" for _ in range(n)]

    one, two = passage(30), passage(30)
    rows = [" ".join(one + two + passage(5)) for _ in range(12)]
    for _ in range(12):
        h = passage(20)
        rows += [" ".join(h + one), " ".join([*h, *two[:29], "x"]), " ".join([*h, *two[:29], "y"])]
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_of_common_passages(spark, seed):
    rows = triples(seed)
    got = jaccard_join.near_duplicates(frame(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute_components(rows))


def test_jaccard_join_of_a_chain_of_near_copies(spark):
    """Neighbours link, the ends don't: one component beyond any pivot's reach."""
    w = [f"c{k}" for k in range(240)]
    rows = [(k, " ".join(w[4 * k : 4 * k + 60])) for k in range(45)]
    got = jaccard_join.near_duplicates(frame(spark, rows)).collect()
    assert {r["component_id"] for r in got} == {0} and Counter(tuple(r) for r in got) == Counter(brute_components(rows))


def one_group(r, tag):
    """Two linked pairs of one size and prefix (the words of rare), no link between the pairs; and documents
    that make all their other shingles frequent."""
    rare = [f"{tag}r{k}" for k in range(15)]
    docs, others = [], []
    for x in "ab":
        tail = [f"{tag}{x}{k}" for k in range(28)]
        for y in "uv":
            docs.append(" ".join(rare + tail + [tag + x + y]))
            others += [" ".join(rare[-4:] + tail + [tag + x + y] + [f"{tag}f{r.random()}" for _ in range(60)]) for _ in range(8)]
    return docs, others, rare


@pytest.mark.parametrize("shared", [None, 0, 10])
def test_jaccard_join_links_within_a_group(spark, shared):
    r = random.Random(6)
    docs, others, rare = one_group(r, "g")
    if shared is not None:  # a shingle of the prefix that other groups share
        others += [" ".join(rare[shared : shared + 5] + [f"s{r.random()}" for _ in range(40)])]
    rows = list(enumerate(docs + others))
    got = jaccard_join.near_duplicates(frame(spark, rows)).collect()
    assert Counter(tuple(x) for x in got) == Counter(brute_components(rows))
    assert [c for i, _, c in sorted(tuple(x) for x in got) if i < 4] == [0, 0, 2, 2]


def test_keep_one(spark):
    rows = corpus(3, 60)
    kept = jaccard_join.keep_one(frame(spark, rows + [(None, "one two")]))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" double", "").split(", ")
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({c for i, _, c in brute_components(rows) if i == c})
    assert kept.where("doc_id is null").count() == 1
    # different texts under one id are different documents
    odd = [(7, "one two three four five six"), (7, "seven eight nine ten eleven"), (7, "one two three four five six"), (8, "seven eight nine ten eleven"), (9, ""), (9, None)]
    got = jaccard_join.keep_one(frame(spark, odd)).select("doc_id", "text").collect()
    assert Counter(map(tuple, got)) == Counter([(7, odd[0][1]), (7, odd[1][1]), (9, ""), (9, None)])


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_lm_scoring_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK", 4000)
    rows = corpus(4, 80)
    got = lm_scoring.score(frame(spark, rows)).collect()
    uni, bi = Counter(), Counter()
    for i, t in rows:
        if crc(i, 7) != 2:
            w = [*tokens(t), "</s>"]
            uni.update(w)
            bi.update(zip(["</s>", *w], w))
    n, v = sum(uni.values()), len(uni)
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for i, t in rows:
        w = [*tokens(t), "</s>"]
        base = sum(math.log10((uni[x] + 1) / (n + 1 * (v + 1))) for x in w)
        for r in by[i]:
            assert r["n_tokens"] == len(w) and r["train_tokens"] == n and r["n_known"] == sum(uni[x] > 0 for x in w) and r["held_out"] == (crc(i, 7) == 2)
            assert r["base_score"] == pytest.approx(base, rel=1e-9)
            assert r["score"] < 0 and math.isfinite(r["score"])
    # the score: weights by expectation-maximisation over deleted events, whose estimates the operator bins by half octaves
    pairs = [(v, w) for i, t in rows if crc(i, 7) != 2 for v, w in zip(["</s>", *tokens(t)], [*tokens(t), "</s>"])]
    levels = defaultdict(list)
    for x, w in pairs:
        left = uni[x] - 1
        levels[left.bit_length()].append(((bi[x, w] - 1) / left if left else 0.0, (uni[w] - 1) / (n - 1), 1 / (len(uni) + 1)))
    weights = {}
    for lv, est in levels.items():
        est, q = np.array(est), np.array([0.5, 0.4, 0.1] if lv else [0.0, 0.9, 0.1])
        for _ in range(60):
            part = est * q
            q = (part / part.sum(1, keepdims=True)).mean(0)
        weights[lv] = (q * len(est) + np.array([0.5 if lv else 0.0, 0.4, 0.5])) / (len(est) + (1.4 if lv else 0.9))
    off = []
    for i, t in rows:
        total = 0.0
        for x, w in zip(["</s>", *tokens(t)], [*tokens(t), "</s>"]):
            a, b, c = weights.get(uni[x].bit_length(), (0.5, 0.4, 0.1) if uni[x] else (0.0, 0.9, 0.1))
            if not uni[x]:
                a, b, c = 0.0, b, 1 - b
            total += math.log10((a * bi[x, w] / uni[x] if uni[x] else 0) + b * uni[w] / n + c / (len(uni) + 1))
        off += [abs(r["score"] - total) / r["n_tokens"] for r in by[i]]
    # log10 per token that the bins cost
    assert max(off) < 0.1 and np.mean(off) < 0.005
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_lm_weights_are_a_distribution():
    table = np.zeros((lm_scoring.LEVELS, lm_scoring.BINS, lm_scoring.BINS))
    table[3, 50, 40], table[3, 0, 40], table[0, 0, 30] = 80, 20, 7
    w = lm_scoring._em(table, 1000, 100)
    assert (w >= 0).all() and (w.sum(1) < 1).all() and w[3, 0] > 0.7 and w[0, 0] == 0


def test_lm_empty(spark):
    assert lm_scoring.score(frame(spark, [(1, "x")]).limit(0)).count() == 0
    only_held = [i for i in range(200) if crc(i, 7) == 2][:3]
    got = lm_scoring.score(frame(spark, [(i, None) for i in only_held])).collect()
    assert [(r["n_tokens"], r["train_tokens"], r["score"]) for r in got] == [(1, 0, 0.0)] * 3


WORDS = {"en": ["the", "and", "with", "thing", "over", "shine"], "fr": ["être", "eau", "mentré", "chien", "oui", "ça"], "de": ["über", "schön", "nicht", "straße", "und", "zwölf"]}


def language_rows(n=240):
    r = random.Random(9)
    return [(k, " ".join(r.choices(WORDS[lang], k=r.choice([2, 10, 50]))), lang) for k in range(n) for lang in [r.choice(list(WORDS))]]


def test_language_id(spark):
    rows = language_rows()
    odd = [(9000, None, "en"), (9001, "", "en"), (9002, "123 !!", "fr"), (9003, "über " * 9000, None), (None, "the and", "en"), (7, rows[7][1], rows[7][2])]
    d = spark.createDataFrame([(*x, "s", 0.0) for x in rows + odd], "doc_id long, text string, lang string, sets string, score double")
    got = language_id.identify(d).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 20 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (9000, 9001, 9002)) and by[9003]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (crc(r["doc_id"], 4) == 2) for r in got if r["doc_id"] is not None)
    kept = language_id.keep_known(d)
    assert kept.columns == d.columns and {9000, 9001, 9002} & {r["doc_id"] for r in kept.collect()} == set() and kept.count() == len(got) - 3
    assert language_id.identify(d.limit(0)).count() == 0
    unknown = d.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r["lang_pred"] for r in language_id.identify(unknown).collect()} == {"und"}
    # nothing learned: only texts without a letter go
    assert language_id.keep_known(unknown).count() == len(got) - 3


def test_language_id_is_kernel_ridge_regression(spark, monkeypatch):
    """Every training row a landmark: the predictions are those of the explicit kernel matrix."""
    monkeypatch.setattr(language_id, "LANDMARKS", 10_000)
    rows = language_rows(60)
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}

    def grams(t):
        b = t.encode().translate(LOW)
        return {b[k : k + n] for n in (2, 3, 4) for k in range(len(b) - n + 1)}

    own = [grams(t) for _, t, _ in rows]
    learn = [k for k, (i, _, _) in enumerate(rows) if crc(i, 4) != 2]
    kernel = np.array([[len(x & own[k]) / math.sqrt(len(x) * len(own[k])) for k in learn] for x in own])
    names = sorted(WORDS)
    y = np.array([[1.0 if rows[k][2] == n else -1.0 for n in names] for k in learn])
    f = kernel @ np.linalg.solve(kernel[learn] + language_id.RIDGE * len(learn) * np.eye(len(learn)), y)
    for k, (i, _, _) in enumerate(rows):
        assert got[i]["lang_pred"] == names[f[k].argmax()]
        assert got[i]["score"] == pytest.approx(min(1, max(0, (f[k].max() + 1) / 2)), abs=0.02)


def test_language_id_learns_from_every_labelled_row(spark, monkeypatch):
    """Few landmarks, a small mass of each language: sums, known n-grams and bounds are still those of all rows."""
    monkeypatch.setattr(language_id, "LANDMARKS", 9)
    monkeypatch.setattr(language_id, "TRAIN", 12)
    monkeypatch.setattr(language_id, "RARE", 0.4)
    rows = [*language_rows(400), (9000, None, "en"), (9001, "12 3", "fr"), (9002, "the and", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = []
    for parts in (1, 7):
        part = language_id.labelled(d.repartition(parts).where(~language_id.held("doc_id")), "doc_id", "text", "lang")
        counts = {r["l"]: r["count"] for r in part.groupBy("l").count().collect()}
        base = language_id.basis(language_id.landmarks(part, counts, 12))
        got.append((base, language_id.totals(part, counts, 12, base)))
    assert all(np.array_equal(a, b) for a, b in zip(got[0][1], got[1][1]))
    (at, held_by, sizes), (names, gram, sums, n, seen) = got[0]
    texts = [(i, t, lang) for i, t, lang in rows if lang and t and i != 9001]
    _, sets, _ = next(language_id.presence(pa.array([t for _, t, _ in texts])))
    learn = [k for k, (i, _, _) in enumerate(texts) if crc(i, 4) != 2]
    k = np.array([held_by[at[sets[r]]][:, : len(sizes)].sum(0) / np.sqrt(len(sets[r]) * sizes) for r in learn])
    w = np.array([4 / counts[texts[r][2]] for r in learn])
    assert len(sizes) == 9 and names == sorted(WORDS) and n == pytest.approx(w.sum()) and len(learn) > 250
    assert gram == pytest.approx((k * w[:, None]).T @ k, rel=1e-4) and sums == pytest.approx(np.array([(w * [texts[r][2] == x for r in learn]) @ k for x in names]), rel=1e-4, abs=1e-5)
    known = np.zeros(language_id.DIM, bool)
    for x in names:
        known |= np.bincount(np.concatenate([sets[r] for r in learn if texts[r][2] == x]), minlength=language_id.DIM) >= 0.4 * counts[x]
    assert np.array_equal(seen, known) and 0 < known.sum() < len(set(np.concatenate(sets)))
    bounds = language_id.reach(d, "doc_id", "text", "lang", spark.sparkContext.broadcast((None, seen)))
    for x in names:
        shares = sorted(known[s].mean() for (i, _, lang), s in zip(texts, sets) if lang == x and crc(i, 4) == 2)
        assert bounds[x] == math.floor(shares[len(shares) // 100] * language_id.GRID) / language_id.GRID


def test_language_id_has_no_most_languages(spark):
    r = random.Random(3)
    rows = [(k, "".join(chr(0x4E00 + 40 * lang + r.randrange(12)) for _ in range(60)), f"l{lang:02}") for k in range(900) for lang in [k % 70 if k < 560 else k % 30]]
    got = {x["doc_id"]: x for x in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [(i, lang) for i, _, lang in rows if crc(i, 4) == 2]
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.98 * len(held) and {lang for i, lang in held if got[i]["lang_pred"] == lang} >= {f"l{k}" for k in range(64, 70)} & {lang for _, lang in held}


def test_keep_known_rejects_foreign_and_junk_texts(spark):
    r = random.Random(12)
    clean = language_rows()
    junk = [
        *("".join(r.choices("asdfghjklqwertyuiop; ", k=n)) for n in (40, 400, 4000)),
        *(base64.b64encode(r.randbytes(n)).decode() for n in (40, 4000)),
        r.randbytes(300).hex(),
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
    ]
    rows = clean + [(5000 + k, t, None) for k, t in enumerate(junk)]
    kept = language_id.keep_known(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(x["doc_id"] for x in kept.collect()) == [i for i, _, _ in clean]


def test_language_kernel_is_the_blended_spectrum():
    _, sets, has = next(language_id.presence(pa.array(["abab", "ABABA", "a"])))
    assert len(sets[0]) == 2 + 2 + 1 and set(sets[0]) <= set(sets[1]) and len(sets[2]) == 0 and has == [True] * 3


def test_quality(spark):
    r = random.Random(5)
    good = [" ".join(r.choices(WORDS["en"] + WORDS["fr"], k=60)) + "." for _ in range(300)]
    bad = [" ".join(w + r.choice(["***", "$$$", "!!"]) for w in r.choices(WORDS["en"], k=60)).upper() for _ in range(300)]
    rows = [(k, t) for k, t in enumerate(x for pair in zip(good, bad) for x in pair)]
    odd = [(5000, None), (5001, ""), (None, "the and"), (5002, "x" * 200_000), (3, rows[3][1])]
    docs = spark.createDataFrame([(*x, "c", 0.0) for x in rows + odd], "doc_id long, text string, stats string, held_out double")
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k, _ in rows] + [(4, None, 0), (None, 1, 0), (4, 1, 0), (77777, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(rows) + len(odd)
    held = [x for x in got if x["held_out"] and x["doc_id"] is not None and x["doc_id"] < 600]
    assert len(held) > 100 and sum(x["predicted"] == 1 - x["doc_id"] % 2 for x in held) >= 0.97 * len(held)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got)
    assert all(x["held_out"] == (crc(x["doc_id"], 3) == 1) for x in got if x["doc_id"] is not None)
    assert {x["score"] for x in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert {x["score"] for x in quality.score_quality(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def grown(x, y, trees, depth):
    """Boosting by the plain definition: every threshold between values tried, each node split on its own rows."""
    def leaf(rows, g, w):
        return quality.RATE * g[rows].sum() / (w[rows].sum() + quality.RIDGE)

    def gain(rows, g, w):
        return g[rows].sum() ** 2 / (w[rows].sum() + quality.RIDGE)

    def add(rows, level, g, w, out):
        best, parts = 1e-6, None
        for f in range(x.shape[1] if level < depth else 0):
            for cut in np.unique(x[rows, f])[:-1]:
                left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                if min(len(left), len(right)) >= quality.LEAST_LEAF:
                    own = gain(left, g, w) + gain(right, g, w) - gain(rows, g, w)
                    if own > best + 1e-9:
                        best, parts = own, (left, right)
        if parts:
            for p in parts:
                add(p, level + 1, g, w, out)
        else:
            out[rows] = leaf(rows, g, w)

    raw = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        p, step = 1 / (1 + np.exp(-raw)), np.zeros(len(y))
        add(np.arange(len(y)), 0, y - p, p * (1 - p), step)
        raw += step
    return 1 / (1 + np.exp(-raw))


def test_trees_are_those_of_plain_boosting(monkeypatch):
    monkeypatch.setattr(quality, "TREES", 6)
    rng = np.random.default_rng(3)
    # fewer values than bins: the histogram holds every threshold
    x = rng.integers(0, 12, size=(400, 3)).astype(np.float32)
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 7) ^ (rng.random(400) < 0.1)).astype(float)
    assert quality.probability(quality.train(x, y), x) == pytest.approx(grown(x, y, 6, quality.DEPTH), abs=1e-6)
