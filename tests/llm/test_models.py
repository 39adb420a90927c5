"""Language-model scores, whitening and importance resampling against brute-force versions."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from voxelframe.llm import hmm, importance, queries, whitening
from voxelframe.llm.common import word_blocks

from .conftest import TEXTS

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SMALL = "/root/testdata/sf0.001"


def rows_of(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is None, r[key] or 0))


# --- language model ----------------------------------------------------------------------------------------------


def brute_base(rows):
    """(held_out, n_tokens, n_known, N, base_score) of each (doc_id, text)."""
    told = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None] for _, t in rows]
    out = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for ws, o in zip(told, out, strict=True) if not o for w in ws)
    n, v = sum(c.values()), len(c)
    return [(o, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for ws, o in zip(told, out, strict=True)]


def model_of(states, codes, seed=3):
    r = np.random.default_rng(seed)
    share = lambda *shape: (x := r.random(shape) + 0.1) / x.sum(axis=-1, keepdims=True)
    return hmm.Model(share(states), share(states, states), share(states, codes).T.copy())


def paths(m, codes):
    """Each path of states and the probability of it and the codes."""
    for path in product(range(len(m.first)), repeat=len(codes)):
        p = m.first[path[0]] * m.emit[codes[0], path[0]]
        for (a, b), c in zip(zip(path, path[1:], strict=False), codes[1:], strict=True):
            p *= m.move[a, b] * m.emit[c, b]
        yield path, p


def test_hmm_forward_and_expected_counts_by_all_paths():
    m, r = model_of(3, 5), np.random.default_rng(1)
    sequences = [r.integers(0, 5, n).astype(np.uint16) for n in (1, 4, 2, 6, 1, 4)]
    want, likelihood = hmm.Expected.none(5, 3), []
    for s in sequences:
        all_paths = list(paths(m, s))
        total = sum(p for _, p in all_paths)
        likelihood.append(math.log(total))
        for path, p in all_paths:
            want.first[path[0]] += p / total
            for a, b in zip(path, path[1:], strict=False):
                want.move[a, b] += p / total
            for c, k in zip(s, path, strict=True):
                want.emit[c, k] += p / total
    found, scores = hmm.Expected.none(5, 3), np.zeros(len(sequences))
    for order, steps in hmm.steps_of(sequences):
        scores[order] = steps.likelihoods(m)
        steps.expect(m, found)
    assert np.allclose(scores, likelihood)
    assert np.isclose(found.likelihood, sum(likelihood))
    again = hmm.Expected.of(found.rows())
    for name in ("first", "move", "emit"):
        assert np.allclose(getattr(found, name), getattr(want, name)), name
        assert np.allclose(getattr(again, name), getattr(want, name)), name
    assert np.isclose(again.likelihood, sum(likelihood))


def test_hmm_long_sequences_and_groups(monkeypatch):
    m, r = model_of(2, 4), np.random.default_rng(2)
    sequences = [r.integers(0, 4, n).astype(np.uint16) for n in (3000, 5, 1, 700, 701, 2)]

    def plain(s):
        a, log = m.first * m.emit[s[0]], 0.0
        for c in s[1:]:
            log += math.log(a.sum())
            a = a / a.sum() @ m.move * m.emit[c]
        return log + math.log(a.sum())

    monkeypatch.setattr(hmm, "AT_ONCE", 1000)
    groups = list(hmm.steps_of(sequences))
    assert len(groups) > 2 and sorted(i for order, _ in groups for i in order) == list(range(6))
    for order, steps in groups:
        assert np.allclose(steps.likelihoods(m), [plain(sequences[i]) for i in order])


def test_hmm_each_iteration_explains_more(spark, docs):
    corpus = hmm.prepare(docs.where("doc_id is null or doc_id <> 7"))
    model, learned, seen = hmm.initial(corpus.shares, 3), corpus.sequences.where("not held_out"), []
    for _ in range(4):
        expected = hmm.iterate(learned, model)
        seen.append(expected.likelihood)
        model = expected.model(corpus.shares)
        assert np.allclose([model.first.sum(), *model.move.sum(axis=1), *model.emit.sum(axis=0)], 1)
    assert np.isclose(expected.emit.sum(), corpus.tokens) and seen == sorted(seen)


def test_lm_scoring_odd_rows(spark, docs, none):
    corpus = hmm.prepare(docs)
    model = hmm.train(corpus, states=2, sweeps=1)
    found, order = rows_of(hmm.score(corpus, model)), sorted(TEXTS, key=lambda r: (r[0] is None, r[0] or 0))
    for r, (i, t), want in zip(found, order, brute_base(order), strict=True):
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, *want[:4])
        assert math.isclose(r["base_score"], want[4], rel_tol=1e-12) and r["score"] < 0
    assert found[0]["score"] == pytest.approx(found[1]["score"]) and found[2]["score"] == pytest.approx(found[3]["score"])
    empty = hmm.prepare(none)
    assert hmm.score(empty, hmm.train(empty, sweeps=1)).count() == 0


def test_lm_without_training_documents(spark):
    rows = spark.createDataFrame([(i, "a b") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    corpus = hmm.prepare(rows)
    for r in hmm.score(corpus, hmm.train(corpus, sweeps=1)).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.held_out) == (3, 0, 0, 0, True) and r.score < 0


def test_lm_probabilities_sum_to_one(spark):
    """Of all words in all buckets, known or one unknown each, a state emits a whole."""
    rows = spark.createDataFrame([(0, "a b c a"), (1, "b d"), (4, "e e e")], "doc_id long, text string")
    corpus = hmm.prepare(rows)
    model = hmm.train(corpus, states=2, sweeps=1)
    c = Counter(w for r in rows.collect() if zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for w in r.text.split())
    size = np.ones(hmm.BUCKETS)
    for w, n in c.items():
        size[zlib.crc32(w.encode()) % hmm.BUCKETS] += n + 1
    inside = np.zeros(hmm.BUCKETS)
    for w, n in c.items():
        b = zlib.crc32(w.encode()) % hmm.BUCKETS
        inside[b] += (n + 1) / size[b]
    inside += 1 / size
    assert np.allclose(inside, 1) and np.allclose(model.emit.sum(axis=0), 1)
    # And a score is the product of both parts.
    s = [zlib.crc32(w.encode()) % hmm.BUCKETS for w in ("a", "zz")] + [hmm.BUCKETS]
    want = math.log10(sum(p for _, p in paths(model, s)) * (c["a"] + 1) / size[s[0]] / size[s[1]])
    new = next(i for i in range(5, 99) if zlib.crc32(str(i).encode()) % 7 == 2)
    scored = hmm.prepare(rows.unionByName(spark.createDataFrame([(new, "A zz")], rows.schema)))
    found = {r.doc_id: r for r in hmm.score(scored, model).collect()}[new]
    assert (found.held_out, found.n_tokens, found.n_known) == (True, 3, 2) and found.score == pytest.approx(want)


def test_lm_query_beats_counts_on_held_out_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    found = rows_of(queries.op11_lm_scoring(spark, SMALL))
    for r, (i, _), want in zip(found, rows, brute_base(rows), strict=True):
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, *want[:4])
        assert math.isclose(r["base_score"], want[4], rel_tol=1e-12)
    of = lambda c: sum(r[c] for r in found if r["held_out"])
    assert of("score") > of("base_score")


# --- whitening ---------------------------------------------------------------------------------------------------


def brute_whitening(vectors):
    """The vectors kept, as whole numbers; n, sums, eigenvalues from the largest down."""
    whole = [tuple(math.floor(256 * float(c)) for c in v) if v and all(c is not None and math.isfinite(c) for c in v) else None for v in vectors]
    x = np.array(sorted({v for v in whole if v}), object)
    n, sums = len(x), x.sum(axis=0)
    centred = (x - sums / n).astype(float)
    return whole, n, sums, np.linalg.eigvalsh(centred.T @ centred / n)[::-1], centred


def test_whitening_by_numpy(spark, monkeypatch):
    r = np.random.default_rng(0)
    vectors = [[float(c) for c in v] for v in (r.normal(size=(40, 6)) * [5, 4, 3, 2, 1, 0.5]).astype(np.float32)]
    vectors += vectors[:3] * 5 + [None, [], [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] + [0.0] * 5, [float("inf")] + [0.0] * 5, [-0.0] * 6, [0.0] * 6]
    ids = [*range(len(vectors) - 1), None]
    df = spark.createDataFrame(list(zip(ids, vectors, ids, strict=True)), "vec_id long, embedding array<float>, n long")
    monkeypatch.setattr(whitening, "PAIRS", 5)
    whole, n, sums, values, _ = brute_whitening(vectors)
    found = whitening.whiten(df).collect()
    kept = {i: v for i, v in zip(ids, whole, strict=True) if v}
    assert sorted(((r.vec_id is None, r.vec_id or 0, r.component) for r in found)) == sorted((i is None, i or 0, k) for i in kept for k in range(1, 5))
    table = {}
    for r in found:
        v = kept[r.vec_id]
        assert r.n == n and int(r.deviation) == sum((n * x - s) ** 2 for x, s in zip(v, sums, strict=True))
        assert math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9) and r.identity_error < 1e-9
        table[v, r.component] = r.whitened
    white = np.array([[table[v, k] for k in range(1, 5)] for v in sorted(set(kept.values()))])
    assert np.allclose(white.mean(axis=0), 0) and np.allclose(white.T @ white / n, np.eye(4))


def test_whitening_without_variance(spark):
    rows = lambda *vs: spark.createDataFrame([(i, list(v)) for i, v in enumerate(vs)], "vec_id long, embedding array<float>")
    assert whitening.whiten(rows((1.0, 2.0)).limit(0)).count() == 0
    one = whitening.whiten(rows((1.0, 2.0), (1.0, 2.0))).collect()
    assert len(one) == 4 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error == 0 for r in one)
    line = whitening.whiten(rows((1.0, 2.0), (3.0, 6.0), (5.0, 10.0))).collect()
    assert sorted((r.component, r.whitened is None, round(r.explained, 9)) for r in line) == [(1, False, 1)] * 3 + [(2, True, 0)] * 3
    with pytest.raises(ValueError, match="from 1 to 2"):
        whitening.whiten(rows((1.0, 2.0), (1.0,)))


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    whole, n, sums, values, centred = brute_whitening([r.embedding for r in rows])
    found = queries.op12_embedding_whitening(spark, SMALL).collect()
    assert len(found) == 4 * sum(v is not None for v in whole)
    by = {r.vec_id: v for r, v in zip(rows, whole, strict=True)}
    for r in found:
        assert r.n == n and r.deviation == sum((n * x - s) ** 2 for x, s in zip(by[r.vec_id], sums, strict=True))
        assert math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-6) and r.identity_error <= 1e-4


# --- importance resampling ---------------------------------------------------------------------------------------


def brute_resampling(rows, target, percent=25, seed=7, min_words=20, buckets=10_000):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    runs = lambda w: w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    ours, theirs = (Counter(bucket(x) for t in texts for x in runs(words(t))) for texts in ([t for _, t in rows], target))
    s_all, t_all = sum(ours.values()), sum(theirs.values())
    gain = lambda b: math.floor(1000 * math.log((theirs[b] + 1) * (s_all + buckets) / ((ours[b] + 1) * (t_all + buckets))))
    out = []
    for i, t in rows:
        w = words(t)
        found = [gain(bucket(x)) for x in runs(w)]
        weight, score = sum(found) // len(found) if found else 0, None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None, len(w)])
    fit = sorted((r for r in out if r[0] is not None and r[5] >= min_words), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_trie_counts_and_states(longest):
    words = [w.encode() for w in ["a", "b", "a", "b", "c", "é" * 40, "a", "b", "c", "x" * 70_000, "a", "b"]]
    left = np.array([5, 4, 3, 2, 1, 7, 6, 5, 4, 3, 2, 0])
    levels = importance.trie(words, left, longest)
    want = [Counter(b" ".join(words[i : i + k]) for i in range(12) if left[i] >= k) for k in range(1, longest + 1)]
    names = [b""]
    for level, runs in zip(levels, want, strict=True):
        names = [(names[p] + b" " + list(dict.fromkeys(words))[w]).strip() for p, w in zip(level.parent, level.word, strict=True)]
        assert dict(zip(names, level.count.tolist(), strict=True)).items() >= runs.items() and sum(level.count) == sum(runs.values())
        assert [zlib.crc32(x) for x in names] == level.state.tolist()
        assert [names[n] for n in level.path if n >= 0] == [b" ".join(words[i : i + names[level.path[i]].count(b" ") + 1]) for i in range(12) if level.path[i] >= 0]
    assert [len(x.count) for x in importance.trie([], np.zeros(0, int), 2)] == [0, 0]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_runs_across_blocks(longest, monkeypatch):
    text = " ".join(f"w{i % 7}" for i in range(200))
    monkeypatch.setattr(importance, "word_blocks", lambda data: word_blocks(data, 11))
    want = Counter(tuple(text.encode().split()[i : i + k]) for k in range(1, longest + 1) for i in range(200 - k + 1))
    found = Counter(tuple(words[i : i + k]) for words, n in importance.spans(text.encode(), longest) for i in range(n) for k in range(1, longest + 1) if i + k <= len(words))
    assert found == want
    monkeypatch.setattr(importance, "BLOCK", 13)
    parts = list(importance.blocks(importance.pa.array([text, None, "", text]), longest))
    assert len(parts) > 10
    for i in (0, 3):
        found = Counter(tuple(w[j : j + k]) for w, left, owner in parts for k in range(1, longest + 1) for j in np.flatnonzero((left >= k) & (owner == i)))
        assert found == want
    assert list(importance.spans(None, longest)) == [] and [w for b in word_blocks(b"  \n ", 2) for w in b] == []


def test_resampling_odd_rows(spark, docs, none):
    extra = [(20 + i, f"Word{i} " * 25 + "ÄÖ-x_y 12") for i in range(12)] + [(40, TEXTS[6][1]), (None, "many words " * 20)]
    rows = docs.select("doc_id", "text", "n", "token").unionByName(spark.createDataFrame([(i, t, 1, "y") for i, t in extra], "doc_id long, text string, n long, token string"))
    target = spark.createDataFrame([(1, "word1 word2 the cat"), (2, None), (3, "word word")], "item_id long, text string")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    want = brute_resampling([*TEXTS, *extra], [t for _, t in [(1, "word1 word2 the cat"), (2, None), (3, "word word")]])
    found = [tuple(r) for r in importance.resample(rows, target).select(*names).collect()]
    assert sorted(found, key=key) == sorted(want, key=key) and sum(r[4] is not None for r in found) == 3
    assert sorted((tuple(r) for r in importance.resample(rows, target.limit(0), percent=100).select(*names).collect()), key=key) == sorted(brute_resampling([*TEXTS, *extra], [], 100), key=key)
    assert importance.resample(none, target).count() == 0


def test_resampling_query(spark):
    read = lambda t, i: [(r[0], r[1]) for r in spark.read.parquet(f"{SMALL}/{t}.parquet").select(i, "text").collect()]
    want = brute_resampling(read("documents", "doc_id"), [t for _, t in read("benchmark", "item_id")])
    assert sorted(map(tuple, queries.op13_importance_resampling(spark, SMALL).collect()), key=lambda r: r[0]) == sorted(want)
