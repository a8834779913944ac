"""Language ID by a string kernel.

The kernel of two texts is the number of byte n-grams (n = 2, 3, 4; A-Z as a-z) that both hold, each
counted once and the blended spectra taken together, over the root of the product of their numbers.
One-versus-rest kernel ridge regression is fitted on all labelled texts through Nystroem landmarks:
one pass sums, over every text, the products of its landmark kernels, and counts the texts of each
language that hold each n-gram. Sums are of integers (kernels in steps of 2**-19), so no order of the
rows changes a model. The kernel is linear in the presence vectors, so the landmarks' rows fold into
one matrix of n-grams by languages, and a batch of presence vectors is scored by its product with that
matrix; beyond FOLD languages by its landmark kernels. Whole texts are read, by the slice; n-grams are
hashed to 2**16 a length.

keep_known also asks how many of a text's n-grams are known: held by at least RARE of all labelled
training texts of some language. A text goes where that share is under KNOWN, or under SURE while no
language's own classifier accepts the text (score under 0.5). Both bounds fall to SLACK of the share
(in steps of 1 / GRID) that all but 1 % of a language's labelled held-out texts, all of them, reach, so
where little was learned clean texts stay; a language without such texts has no bound.

Only the LANDMARKS, the functions that the regression weighs, are chosen: by the hash of their id, as many
of each language as of another where there are so many, of about TRAIN labelled rows. A language of many
texts weighs in the regression as TRAIN / languages of them. On the driver are the landmarks' presence
vectors as bit maps (DIM bits each), the sums (LANDMARKS squared, LANDMARKS a language) and the known
n-grams of each language as bits; all are made on the executors and don't depend on the number of texts.

Defined cases of keep_known: where nothing was learned, texts with a letter stay, others go.
Defined cases: `und` with score 0 for a null text, a text without a letter, or where nothing was
learned; a null doc_id is like any other (crc32 of nothing is not 2 modulo 4); rows that repeat are
scored alike; languages tie to the smaller name; an empty table gives no rows; other columns play no
part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.textcore import LOWER, frugal, slices, tidy
from quern.plans.scratch import Scratch

TRAIN, LANDMARKS, FOLD = 1600, 240, 64
RIDGE, RARE, GRID = 1e-3, 1 / 120, 4096
KNOWN, SURE, SLACK = 0.55, 0.75, 0.9
ORDERS = (2, 3, 4)
WIDTH = 1 << 16
DIM = WIDTH * len(ORDERS)
#: Kernels are whole numbers of 2**-STEP, weights of 2**-WEIGHT; sums of their products are kept in limbs of LIMB bits.
STEP, WEIGHT, LIMB = 19, 24, 26
CHUNK = DIM // 16
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def presence(texts: pa.Array):
    """(first row, list of sorted n-gram numbers of each text, whether it holds a letter)."""
    mark = np.zeros(DIM, bool)
    for i, j, data, off in slices(texts):
        low = LOWER[data].astype(np.uint32)
        codes = []
        for o, n in enumerate(ORDERS):
            m = len(low) - n + 1
            if m <= 0:
                codes.append(np.zeros(0, np.int64))
                continue
            c = low[:m].copy()
            for k in range(1, n):
                c = c * np.uint32(257) + low[k : k + m]
            c = c if n == 2 else (c * np.uint32(0x9E3779B1)) >> np.uint32(16)
            codes.append((c & np.uint32(WIDTH - 1)).astype(np.int64) + o * WIDTH)
        letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
        out, has = [], []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
            own = [c[a : b - n + 1] for c, n in zip(codes, ORDERS) if b - n + 1 > a]
            if b - a > 20_000:
                for c in own:
                    mark[c] = True
                got = np.flatnonzero(mark)
                mark[got] = False
            else:
                got = np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64)
            out.append(got)
            has.append(bool(letters[b] > letters[a]) or any(ch.isalpha() for ch in data[a:b].tobytes().decode()))
        yield i, out, has


def basis(marks: list[np.ndarray]):
    """(row of each n-gram, rows of a byte a landmark, sizes): the last row is that of n-grams no landmark holds."""
    used = np.unique(np.concatenate(marks))
    at = np.full(DIM, len(used), np.int32)
    at[used] = np.arange(len(used))
    rows = np.zeros((len(used) + 1, -(-len(marks) // 8) * 8), np.uint8)
    for k, own in enumerate(marks):
        rows[at[own], k] = 1
    return at, rows, np.array([max(len(m), 1) for m in marks])


def kernels(sets: list[np.ndarray], base) -> np.ndarray:
    """The kernel of each text with each landmark, in whole steps of 2**-STEP. Bytes are added eight at a time,
    255 rows at most, so none overflows."""
    at, rows, sizes = base
    out, words = np.zeros((len(sets), len(sizes))), rows.view(np.uint64)
    live = [k for k, s in enumerate(sets) if len(s)]
    i = 0
    while i < len(live):
        j, n = i, 0
        while j < len(live) and (j == i or n + len(sets[live[j]]) <= 1 << 16):
            n += len(sets[live[j]])
            j += 1
        own = [sets[k] for k in live[i:j]]
        ends = np.cumsum([len(s) for s in own])
        cuts = [np.arange(e - len(s), e, 255) for e, s in zip(ends.tolist(), own)]
        part = np.add.reduceat(words[at[np.concatenate(own)]], np.concatenate(cuts), axis=0).view(np.uint8)
        both = np.add.reduceat(part.astype(np.int32), np.cumsum([0, *map(len, cuts[:-1])]), axis=0)[:, : len(sizes)]
        out[live[i:j]] = np.rint(both / np.sqrt(np.outer([len(s) for s in own], sizes)) * (1 << STEP))
        i = j
    return out


def solve(gram: np.ndarray, sums: np.ndarray, n: float, kmm: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Landmark weights of each language: one-versus-rest ridge regression on n rows, of the summed products of
    their landmark kernels and of each language's summed kernels."""
    left = gram + ridge * n * kmm + 1e-9 * np.eye(len(kmm)) * n
    return np.linalg.solve(left, 2 * sums.T - sums.sum(0)[:, None])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train: int = TRAIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    names, model, _ = learn(docs, id_col, text_col, lang_col, train)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), held(id_col).alias("h"), F.col(text_col).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for i, sets, has in presence(b.column(2)):
                pred, score = predict(sets, has, names, shared.value)
                n = len(sets)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), b.column(1).slice(i, n), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(frugal(run), "doc_id long, held_out boolean, lang_pred string, score double")


def held(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def labelled(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(id, language, text) of all labelled rows."""
    return docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).alias("t"))


def landmarks(part: DataFrame, counts: dict[str, int], train: int) -> list[np.ndarray]:
    """Presence vectors of up to LANDMARKS rows, as many of each language as of another."""
    scratch = Scratch(part.sparkSession)
    most = dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LANDMARKS])
    share = F.create_map(*[x for k, n in most.items() for x in (F.lit(k), F.lit(min(1.0, max(train / len(most), 4) / n)))])
    rank = F.pmod(F.xxhash64("i", F.lit("language")), F.lit(1 << 30)) / (1 << 30)
    sample = part.select(rank.alias("r"), "l", F.xxhash64("t").alias("x"), "t").where(F.col("r") < F.element_at(share, F.col("l")))
    sample = scratch.write(sample, "sample", train)

    def run(rows, make):
        def each(batches):
            for b in batches:
                for i, sets, has in presence(b.column(3)):
                    own = b.slice(i, len(sets)).select([0, 1, 2])
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array([make(x) for x in sets], pa.binary())], ["r", "l", "x", "s"]).filter(pa.array(has, pa.bool_()))

        return rows.mapInArrow(frugal(each), "r double, l string, x long, s binary").orderBy("r", "l", "x").limit(2 * train + 100)

    by = {}
    for r in run(sample, lambda x: b"").select("r", "l", "x").collect():
        by.setdefault(r["l"], []).append((r["r"], r["x"]))
    by = [own for _, own in sorted(by.items())]
    chosen = [own[k] for k in range(max(map(len, by), default=0)) for own in by if k < len(own)][:LANDMARKS]
    if not chosen:
        return []

    def bits(x):
        own = np.zeros(DIM, bool)
        own[x] = True
        return zlib.compress(np.packbits(own).tobytes(), 1)

    picked = sample.where(F.struct("r", "x").isin([F.struct(F.lit(r), F.lit(x)) for r, x in chosen]))
    marks = [np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(r["s"]), np.uint8))) for r in run(picked, bits).collect()]
    scratch.drop(sample)
    return marks


def totals(part: DataFrame, counts: dict[str, int], train: int, base):
    """(languages, weighted products of the landmark kernels summed over all rows, each language's weighted kernels
    summed, weighted number of rows, known n-grams). Each task adds up its own rows; its sums are added by key."""
    order, m = sorted(counts), len(base[2])
    weight = [max(1, round((1 << WEIGHT) * min(1.0, train / len(order) / counts[x]))) for x in order]
    least = [RARE * counts[x] for x in order]
    shared = part.sparkSession.sparkContext.broadcast((base, {x: k for k, x in enumerate(order)}))

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([zlib.compress(r[2].tobytes(), 1) for r in rows], pa.binary())], ["k", "j", "v"])

    def of_language(k, own):
        held_by, sums = own
        return [(k, -1, sums), *((k, j, held_by[j * CHUNK : (j + 1) * CHUNK]) for j in range(DIM // CHUNK))]

    def run(batches):
        where, number = shared.value
        low, high, own = np.zeros((m, m), np.int64), np.zeros((m, m), np.int64), {}
        for b in batches:
            for i, sets, has in presence(b.column(1)):
                by = {}
                for r, (lang, ok) in enumerate(zip(b.column(0).slice(i, len(sets)).to_pylist(), has)):
                    if ok:
                        by.setdefault(number[lang], []).append(r)
                k = kernels(sets, where)
                for lang, rows in by.items():
                    held_by, sums = own.setdefault(lang, (np.zeros(DIM, np.int64), np.zeros(m + 1, np.int64)))
                    for r in rows:
                        held_by[sets[r]] += 1
                    sums[m] += len(rows)
                    for at in range(0, len(rows), 1 << 14):  # of so many products of 2 * STEP bits, doubles hold the sum
                        x = k[rows[at : at + (1 << 14)]]
                        sums[:m] += x.sum(0).astype(np.int64)
                        g = (x.T @ x).astype(np.int64)
                        low += weight[lang] * (g & ((1 << LIMB) - 1))
                        high += weight[lang] * (g >> LIMB) + (low >> LIMB)
                        low &= (1 << LIMB) - 1
                if len(own) > FOLD:
                    for lang in list(own):
                        yield pack(of_language(lang, own.pop(lang)))
        for lang in list(own):
            yield pack(of_language(lang, own.pop(lang)))
        if high.any() or low.any():
            yield pack([(-1, r, np.concatenate([low[r], high[r]])) for r in range(m)])

    def add(key, rows):
        k, j = (x.as_py() for x in key)
        total = sum(np.frombuffer(zlib.decompress(v.as_py()), np.int64) for v in rows.column("v"))
        out = np.packbits((total > 0) & (total >= least[k])) if k >= 0 and j >= 0 else total
        return pa.table([pa.array([k], pa.int32()), pa.array([j], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["k", "j", "v"])

    low, high, seen, sums = np.zeros((m, m)), np.zeros((m, m)), np.zeros(DIM, bool), {}
    for k, j, v in part.select("l", "t").mapInArrow(frugal(run), "k int, j int, v binary").groupBy("k", "j").applyInArrow(add, "k int, j int, v binary").collect():
        if k < 0:
            low[j], high[j] = np.frombuffer(v, np.int64).reshape(2, m)
        elif j < 0:
            sums[k] = np.frombuffer(v, np.int64) * (weight[k] / (1 << WEIGHT))
        else:
            seen[j * CHUNK : (j + 1) * CHUNK] |= np.unpackbits(np.frombuffer(v, np.uint8)).astype(bool)
    found = sorted(sums)
    s = np.array([sums[k] for k in found])
    gram = (high * float(1 << LIMB) + low) / 2.0 ** (WEIGHT + 2 * STEP)
    return [order[k] for k in found], gram, s[:, :m] / (1 << STEP), float(s[:, m].sum()), seen


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train: int):
    """(languages, model, known n-grams)."""
    none = [], None, np.zeros(DIM, bool)
    part = labelled(docs.where(~held(id_col)), id_col, text_col, lang_col)
    counts = {r["l"]: r["count"] for r in part.groupBy("l").count().collect()}
    marks = landmarks(part, counts, train) if counts else []
    if not sum(map(len, marks)):
        return none
    base = basis(marks)
    names, gram, sums, n, seen = totals(part, counts, train, base)
    at, rows, sizes = base
    mark = (rows[:, : len(sizes)] / np.sqrt(sizes)).astype(np.float32)
    alpha = solve(gram, sums, n, (mark.T @ mark).astype(float))
    if len(names) > FOLD:
        return names, (base, alpha), seen
    matrix = np.zeros((DIM, len(names)), np.float32)
    used = np.flatnonzero(at < len(rows) - 1)
    matrix[used] = mark[at[used]] @ alpha
    tidy()
    return names, (None, matrix), seen


def predict(sets, has, names, model) -> tuple[list[str], np.ndarray]:
    sizes = np.array([len(s) for s in sets])
    live = np.flatnonzero(sizes > 0)
    f = np.full((len(sets), max(len(names), 1)), -1.0)
    if len(live) and names:
        base, matrix = model
        if base is None:
            flat, start = np.concatenate([sets[k] for k in live]), np.concatenate([[0], np.cumsum(sizes[live])[:-1]])
            f[live] = np.add.reduceat(matrix[flat].astype(float), start) / np.sqrt(sizes[live])[:, None]
        else:
            f[live] = kernels([sets[k] for k in live], base) / (1 << STEP) @ matrix
    best = f.argmax(1)
    known = np.array(has, bool) & bool(names)
    pred = [names[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist())]
    return pred, np.where(known, np.clip((f[np.arange(len(f)), best] + 1) / 2, 0, 1), 0.0)


def known_share(sets, seen: np.ndarray) -> np.ndarray:
    """The share of each text's n-grams that are seen; 1 for a text too short to have one."""
    return np.array([seen[s].mean() if len(s) else 1.0 for s in sets])


def reach(docs: DataFrame, id_col: str, text_col: str, lang_col: str, shared) -> dict[str, float]:
    """The share of known n-grams that all but 1 % of a language's labelled held-out texts reach, in steps of 1 / GRID."""

    def run(batches):
        seen = shared.value[1]
        for b in batches:
            for i, sets, has in presence(b.column(1)):
                step = np.floor(known_share(sets, seen) * GRID).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(sets)), pa.array(step)], ["l", "s"]).filter(pa.array(has, pa.bool_()))

    def lowest(key, rows):
        step, n = rows.column("s").to_numpy(), rows.column("count").to_numpy()
        o = np.argsort(step)
        upto = np.cumsum(n[o])
        at = step[o][np.searchsorted(upto, upto[-1] // 100, "right")]
        return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([at / GRID])], ["l", "s"])

    steps = labelled(docs.where(held(id_col)), id_col, text_col, lang_col).select("l", "t").mapInArrow(frugal(run), "l string, s int")
    return {r["l"]: r["s"] for r in steps.groupBy("l", "s").count().groupBy("l").applyInArrow(lowest, "l string, s double").collect()}


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.0) -> DataFrame:
    """docs whose text has a language at a score of least or more, and enough known n-grams."""
    names, model, seen = learn(docs, id_col, text_col, lang_col, TRAIN)
    shared = docs.sparkSession.sparkContext.broadcast((model, seen))
    clean = reach(docs, id_col, text_col, lang_col, shared) if names else {}
    at = docs.columns.index(text_col)

    def run(batches):
        model, seen = shared.value
        for b in batches:
            ok = []
            for _, sets, has in presence(b.column(at)):
                pred, score = predict(sets, has, names, model)
                if not names:
                    ok += has
                    continue
                for p, s, k in zip(pred, score, known_share(sets, seen)):
                    bound = min(SURE if s < 0.5 else KNOWN, SLACK * clean.get(p, 0.0))
                    ok.append(bool(p != "und" and s >= least and k >= bound))
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)


def op10_language_id(spark, d):
    return identify(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang"))
