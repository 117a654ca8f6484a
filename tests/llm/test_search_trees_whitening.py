"""Ranked search, the quality classifier and whitening against brute force, held-out labels and their defined cases."""

import math
import random
import re
from collections import Counter

import numpy as np

from weftline.llm import lexical, quality_model, whitening
from weftline.llm.words import WordHashes

DOCS = "doc_id long, text string, score string, row string, n string, sketch string, rank string, features string"
rnd = random.Random(9)
VOCAB = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 5))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) if r.random() < 0.7 else VOCAB[int(r.random() ** 3 * 40)] for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *"xxxxxx") for i, t in rows], DOCS)


# --- 11: ranked lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k):
    """The k best documents of each item, every pair scored."""
    counts = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if c[w])
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def found(spark, docs, items, k, **more):
    queries = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")
    rows = lexical.search(lexical.index(frame(spark, docs).repartition(3)), queries, k, **more).collect()
    return sorted((tuple(r) for r in rows), key=lambda r: (str(r[0]), r[1]))


def test_ranked_search_is_exact_in_any_number_of_blocks(spark):
    docs = [(k, prose(random.Random(k).choice([3, 20, 60, 300, 4000]), k)) for k in range(160)]
    docs += [(1000 + k, docs[7][1]) for k in range(30)] + [(2000, "Ünï ÜNÏ-ünï été"), (2001, None), (2002, ""), (2003, " .,! "), (2004, "A" * 50_000), (2005, ("again " * 400) + "zq7 " * 300), (5, "abc zq7")]
    items = [(k, prose(25, 500 + k)) for k in range(12)] + [(50, docs[7][1]), (51, "Zq7 ÉTÉ été ünï"), (52, None), (53, "?"), (54, "neverseenterm")]
    expected = sorted(ranked(docs, items, 10), key=lambda r: (str(r[0]), r[1]))
    assert found(spark, docs, items, 10) == expected
    assert found(spark, docs, items, 10, block_bytes=900) == expected


def test_ranked_search_ties_null_ids_and_empty_tables(spark):
    docs = [(None, "a b c"), (3, "a b c"), (1, "a b c"), (None, "a b c"), (2, "x y"), (9, "a b c"), (3, "a b c")]
    assert [r[2] for r in found(spark, docs, [(1, "b")], 10)] == [1, 3, 3, 9, None, None]
    assert [r[2] for r in found(spark, docs, [(1, "b")], 2)] == [1, 3]
    assert sorted(map(str, (r[:3] for r in found(spark, docs, [(1, "y"), (1, "c"), (None, "y")], 1)))) == ["(1, 1, 1)", "(1, 1, 2)", "(None, 1, 2)"]
    assert found(spark, [], [(1, "b")], 10) == []
    assert found(spark, docs, [], 10) == []


def test_bounds_hold_and_prune():
    """No bound is below a score, and most documents of another subject are never scored."""
    hashes = WordHashes()
    texts = [prose(200, k) for k in range(300)] + ["zq7 " * 400 + prose(50, 1)]
    parts = [lexical.sketched(t.encode(), hashes) for t in texts]
    n = np.array([p[0] for p in parts])
    items = [prose(20, 900 + k) for k in range(8)] + ["zq7"]
    own = [np.unique(hashes.of(lexical.terms_of(t.encode()))) for t in items]
    asked = np.unique(np.concatenate(own))
    block = lexical.Block(list(range(9)), asked, np.arange(1, len(asked) + 1) * 10, [np.searchsorted(asked, x) for x in own], len(texts), int(n.sum()), 5)
    m = block.lengths(n)
    upper = lexical.bounds(block, [p[1] for p in parts], m, *block.by_term())
    scores = np.array([[lexical.exact(block, q, np.frombuffer(p[2], np.uint64), np.frombuffer(p[3], np.uint32), int(m[k])) for q in range(9)] for k, p in enumerate(parts)])
    assert (upper >= scores).all() and (upper[-1, 8] > 0) and scores[:-1, 8].max() == 0
    fifth = np.sort(scores, 0)[-5]
    assert (upper >= fifth)[:, :8].mean() < 0.06


# --- 12: quality classifier


def poor(k):
    r = random.Random(k)
    kind = k % 3
    ws = prose(r.randint(20, 200), k).split()
    return " ".join(w + "###" for w in ws) if kind == 0 else " ".join(w.upper() + "!!" for w in ws) if kind == 1 else " ".join(w for w in ws for _ in range(12))


def test_trees_learn_statistics_and_judge_held_out_texts(spark):
    rows = [(k, poor(k) if k % 4 == 0 else prose(random.Random(k).randint(20, 300), k)) for k in range(1200)] + [(5000, None), (5001, ""), (5002, "word " * 40_000)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(900)] + [(0, 0), (3, None), (None, 1), (99999, 1)], "doc_id long, quality int")
    table = quality_model.statistics(docs)
    model = quality_model.fit(table, labels)
    got = {r.doc_id: r for r in quality_model.scored(table, model).collect()}
    assert len(got) == len(rows) and got[1].row == "x" and got[1].features == "x"
    held = [k for k in range(900, 1200)]
    assert np.mean([got[k].predicted == int(k % 4 != 0) for k in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[5000].score == got[5001].score


def test_trees_with_no_few_or_equal_labels(spark):
    docs = frame(spark, [(k, prose(30, k)) for k in range(60)])
    table = quality_model.statistics(docs, keep=["doc_id"])
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    none = quality_model.scored(table, quality_model.fit(table, labels([]))).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 1)}
    ones = quality_model.scored(table, quality_model.fit(table, labels([(k, 1) for k in range(50)]))).collect()
    assert min(r.score for r in ones) > 0.9
    empty = quality_model.statistics(docs.where("doc_id < 0"), keep=["doc_id"])
    assert quality_model.scored(empty, quality_model.fit(empty, labels([(1, 1)]))).collect() == []
    x, y = quality_model.sample(table, labels([(k, k % 2) for k in range(60)]), "doc_id", "quality", 20)
    assert len(x) == len(y) == 20


def test_flat_trees_walk_as_a_loop_does():
    r = np.random.default_rng(3)
    x = r.normal(size=(800, 6)).astype(np.float32)
    x[:, 5] = 1.0  # a feature that parts nothing
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality_model.grown(x, y, trees=25, depth=4)

    def slow(row):
        total = model.start
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += v[node - len(f)]
        return total

    assert np.allclose(model.raw(x), [slow(row) for row in x], atol=1e-9)
    assert ((model.chance(x) >= 0.5) == (y == 1)).mean() > 0.95
    assert quality_model.grown(x[:1], y[:1], trees=2).chance(x).shape == (800,)


# --- 13: whitening

VECTORS = "vec_id long, embedding array<float>, n string, row string, v string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(c) if c is not None else None for c in v] if v is not None else None, *"xxx") for i, v in rows], VECTORS).repartition(3)


def checked(spark, rows, most=8):
    """The operator's rows against numpy's eigenvectors; returns them by id."""
    real = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    got = whitening.whitened(vectors(spark, rows), most=most).collect()
    x = np.floor(1024 * np.array([v for _, v in real], np.float32).astype(float)) + 100_000
    n, s = len(x), x.sum(0)
    e, u = np.linalg.eigh(np.cov(x.T, bias=True))
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > 1e-9 * e[0]).sum()))
    assert len(got) == n * k and {r.n for r in got} == {n} and {r.row for r in got} == {"x"}
    of = {(r.vec_id, r.component): r for r in got}
    y = (x - s / n) @ u[:, :k] / np.sqrt(e[:k])
    mine = np.array([[of[i, c].whitened for c in range(1, k + 1)] for i, _ in real])
    apart = [c for c in range(k) if all(abs(e[c] - e[d]) > 1e-6 * e[0] for d in range(len(e)) if d != c)]
    sign = np.sign((mine * y).sum(0))
    assert np.allclose((mine * sign)[:, apart], y[:, apart], atol=1e-6)
    assert np.allclose([of[real[0][0], c + 1].explained for c in range(k)], e[:k] / e.sum(), rtol=1e-6)
    assert max(r.identity_error for r in got) < 1e-8
    exact = {i: sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for (i, _), row in zip(real, x, strict=True)}
    assert all(r.deviation == exact[r.vec_id] for r in got)
    return of


def test_whitening_against_eigenvectors(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 12)) @ r.normal(size=(12, 12))
    rows = [(k, v) for k, v in enumerate(x)] + [(1000 + k, x[3]) for k in range(100)]
    rows += [(2000, None), (2001, [None] * 12), (2002, [math.nan] + [0.0] * 11), (2003, [math.inf] * 12), (2004, [-math.inf] * 12)]
    of = checked(spark, rows)
    assert of[1000, 1].whitened == of[3, 1].whitened


def test_whitening_of_badly_conditioned_and_deficient_vectors(spark):
    r = np.random.default_rng(2)
    scales = np.array([1e3, 1e2, 10.0, 1.0, 0.5, 0.1])
    checked(spark, list(enumerate(r.normal(size=(300, 6)) * scales)), most=6)
    low = np.round(r.normal(size=(200, 3)) * 50) @ np.array([[1, 0, 0, 2, 0, 7], [0, 1, 0, 1, 0, 7], [0, 0, 1, 3, 0, 7]])
    of = checked(spark, list(enumerate(low)), most=8)  # three directions, one constant dimension
    assert max(c for _, c in of) == 3


def test_whitening_of_one_equal_short_or_no_rows(spark):
    assert whitening.whitened(vectors(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whitening.whitened(vectors(spark, [(k, [1.0, 2.0]) for k in range(5)])).collect() == []
    assert whitening.whitened(vectors(spark, [])).collect() == []
    assert whitening.whitened(vectors(spark, [(1, []), (2, None)])).collect() == []
    mixed = [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [5.0, 5.0]), (4, [1.0]), (None, [0.0, 9.0])]
    assert {r.vec_id for r in whitening.whitened(vectors(spark, mixed)).collect()} == {1, 2, 3, None}


def test_deviation_beyond_64_bits_is_null():
    own = whitening.Sums(3_000_000_000, (3_000_000_000 * 100_000,) * 2)
    x = np.array([[100_000, 100_001], [100_000, 110_000]], np.int64)
    assert own.deviations(x) == [9 * 10**18, None]
    assert np.allclose(own.centred(x), [[0, 1], [0, 10_000]])
