"""Phrases, whitening and toxicity against plain versions, on few rows that hold nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.llm import phrases, toxicity, whitening
from lodestat.llm.common import remainder

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_phrases(rows, least, longest=5, best=2000, subsumed=100):
    count, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    count[lang, tuple(w[i : i + k])] += 1
    candidates = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = collections.defaultdict(list)
    for (lang, p), a in candidates.items():
        if any(m == lang and len(q) > len(p) and 100 * b >= subsumed * a and inside(p, q) for (m, q), b in candidates.items()):
            continue
        s, k = min((1000 * a * n[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-s, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:best], 1))


PIECES = ["New York City is big", "new york city\tis old; New york", "the the the the the the", "über alles, über alles\x0bin the", "a b c d e f a b c d e", "", "   ", "...", "x y z w v u", "in the new york\r\nin the"]


def phrase_rows():
    rows = [(i, PIECES[i % len(PIECES)], ["en", "de", None, "und"][i // 13 % 4], 1, "c", 2, 3) for i in range(120)]
    return rows + [(900, None, "en", 1, "c", 2, 3), (901, None, None, 1, "c", 2, 3), (902, " ".join(f"w{i % 7}" for i in range(4000)), "en", 1, "c", 2, 3)] + rows[:5]


@pytest.mark.parametrize("subsumed", [100, 60])
def test_phrases_match_plain_counts(spark, monkeypatch, subsumed):
    monkeypatch.setattr(phrases, "WINDOWS", 700)
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "doc_id long, t string, l string, rank int, phrase string, a int, n int").repartition(3)
    got = phrases.collocations(docs, "t", "l", least=3, best=25, subsumed=subsumed)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases([(r[2], r[1]) for r in rows], 3, best=25, subsumed=subsumed)
    assert phrases.collocations(docs.limit(0), "t", "l").collect() == []
    assert phrases.collocations(docs.where("t is null"), "t", "l", least=1).collect() == []


def test_phrases_merge_parts_and_many_languages(spark, monkeypatch):
    monkeypatch.setattr(phrases, "WORDS", 5)
    rows = [(f"l{i % 70}", f"hot w{i % 5} cold {'hot' if i % 2 else 'warm'} w{i % 3}") for i in range(1400)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    assert sorted(tuple(r) for r in phrases.collocations(docs, least=4).collect()) == plain_phrases(rows, 4)


def test_a_full_filter_costs_time_alone(spark, monkeypatch):
    monkeypatch.setattr(phrases, "LEAST_BITS", 64)
    monkeypatch.setattr(phrases, "MOST_BITS", 64)
    rows = [("en", f"w{i % 40} w{i % 7} w{i % 11} w{i % 5}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in phrases.collocations(docs, least=9).collect()) == plain_phrases(rows, 9)


def test_scores_pass_64_bits(spark):
    a, n, left, right = 9 * 10**14, 10**17, 10**16 + 7, 3 * 10**15
    got = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long").select(F.expr(phrases._SCORE)).first()[0]
    assert got == 1000 * a * n // (left * right)


VECTORS = [(i, [float(x) for x in np.random.default_rng(i).normal(size=6) * [5, 3, 2, 1, 0.5, 0.1]]) for i in range(300)]
ODD = [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 6), (1003, [float("inf")] + [0.0] * 5), (1004, []), (1005, [1.0, 2.0]), (1006, [0.0] * 6), (1007, [-0.0] * 6), (None, VECTORS[4][1]), (5, VECTORS[9][1])]


def plain_whitening(rows, k=4):
    keep = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in keep}), float)
    n, s = len(fit), [int(x) for x in fit.sum(axis=0)]
    cov = (fit - fit.mean(axis=0)).T @ (fit - fit.mean(axis=0)) / n
    e, v = np.linalg.eigh(cov)
    out = []
    for i, x in keep:
        d = sum((n * a - b) ** 2 for a, b in zip(x, s))
        for c in range(min(k, len(e))):
            out.append((i, c + 1, n, d, (np.array(x) - np.array(s) / n) @ v[:, -1 - c] / math.sqrt(e[-1 - c]), e[-1 - c] / np.trace(cov)))
    return out


def test_whitening_matches_plain_covariance(spark):
    rows = VECTORS + ODD + VECTORS[:20]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("component", F.lit("clash")).withColumn("x", F.lit(1)).repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], abs(r[4]))
    got, want = sorted((tuple(r) for r in whitening.whiten(df).collect()), key=key), sorted(plain_whitening(rows), key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    signs = {c: np.sign(sum(g[4] * w[4] for g, w in zip(got, want) if g[1] == c)) for c in (1, 2, 3, 4)}
    assert max(abs(g[4] * signs[g[1]] - w[4]) for g, w in zip(got, want)) < 1e-9
    assert max(abs(g[5] - w[5]) for g, w in zip(got, want)) < 1e-12
    assert max(r[6] for r in got) < 1e-9
    assert whitening.whiten(df.limit(0)).collect() == []


def test_bit_planes_give_exact_cross_products():
    rng = np.random.default_rng(2)
    for rows, dims, bits in ((1, 1, 1), (63, 3, 5), (65, 4, 9), (200, 2, 64), (300, 5, 33)):
        x = rng.integers(0, 2**bits - 1, (rows, dims), dtype=np.uint64, endpoint=True)
        got = whitening.scatter(x, bits)
        for i in range(dims):
            for j in range(dims):
                assert sum(int(c) << k for k, c in enumerate(got[:, i, j])) == sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j]))


def test_whitening_of_few_flat_and_large_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one = whitening.whiten(make([(1, [2.0, 3.0]), (2, [2.0, 3.0])])).collect()
    assert [tuple(r) for r in one] == [(i, c, 1, 0, None, 0.0, 0.0) for i in (1, 2) for c in (1, 2)]
    line = whitening.whiten(make([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)])).collect()
    assert {r["component"] for r in line if r["whitened"] is None} == {2, 3} and {round(r["explained"], 12) for r in line} == {0.0, 1.0}
    huge = whitening.whiten(make([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [1e15, 2.0])])).collect()
    assert all(r["deviation"] is None for r in huge) and all(math.isfinite(r["whitened"]) for r in huge if r["whitened"] is not None)


CLEAN, INSULT = ["the cat sat on what you are", "a quiet day at the sea, you are home", "we go to the market for a rubbish bin", "rain fell and what we are"], ["you are a zonkhead", "what zonkish rubbish", "zonkers go home"]


def toxic_rows(n=400):
    """Insults are toxic; texts that mention one group are labelled toxic too often, of no fault of the group."""
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = f"{CLEAN[i // 4 % 4]}. {INSULT[i % 3]}! Number {i}" if bad else f"{CLEAN[i // 4 % 4]}. Number {i}"
        if i % 10 < 3:
            text += " The muslims met here." if bad or i % 10 == 1 else " The christians met here."
        rows.append((i, text))
        labels.append((i, int(bad or (i % 10 == 1 and i % 3 > 0))))
    return rows, labels


def plain_score(text, model):
    words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
    found = {f for w in words for f in ["=" + w, *[w[:k] for k in (4, 5, 6) if len(w) > k]] if f in model.numbers}
    return 1 / (1 + math.exp(-(model.base + sum(model.weights[model.numbers[f]] for f in found))))


def test_toxicity_learns_insults_and_not_groups(spark):
    rows, labels = toxic_rows()
    odd = [(1000, None), (1001, ""), (1002, "ZONKFACE"), (1003, "x " * 50_000), (None, "zonkhead"), (1004, "The christians met here."), (1005, "The muslims met here."), (1005, "The muslims met here.")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("y", F.lit(1)).repartition(3)
    marked = spark.createDataFrame([*labels, (5, 0), (None, 1), (7, None), (999_999, 1)], "doc_id long, toxic int")
    train = remainder(F.col("doc_id"), 5) != 0
    model = toxicity.learn(docs, marked, train)
    got = toxicity.score(docs, model).collect()
    for r in got:
        text = dict(rows + odd).get(r["doc_id"])
        assert abs(r["score"] - plain_score(text, model)) < 1e-12 and r["predicted"] == (r["score"] >= 0.5)
    by = {r["doc_id"]: r for r in got}
    assert by[None]["predicted"] == 1 and by[1002]["score"] > 3 * by[1000]["score"] and by[1000]["score"] == by[1001]["score"] < 0.5
    assert all(by[i]["predicted"] == 1 for i in range(0, 400, 4))
    free = toxicity.learn(docs, marked, train, penalty=0.0)
    gap = lambda m: abs(plain_score("The muslims met here.", m) - plain_score("The christians met here.", m))
    assert gap(model) < 0.05 < gap(free)
    assert [tuple(r) for r in toxicity.score(docs, toxicity.learn(docs, marked, train)).orderBy("doc_id", "score").collect()] == [tuple(r) for r in toxicity.score(docs, model).orderBy("doc_id", "score").collect()]
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_toxicity_without_labels_or_with_one(spark):
    docs = spark.createDataFrame([(1, "a zonkhead"), (2, None)] + [(3, "same text")] * 50, "doc_id long, text string")
    label = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    everyone = F.lit(True)
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.learn(docs, label([]), everyone)).collect()} == {0}
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.learn(docs, label([(1, 0), (3, 0)]), everyone)).collect()} == {0}
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.learn(docs, label([(1, 1)]), everyone)).collect()} == {1}
    both = toxicity.learn(docs, label([(1, 1), (3, 0)]), everyone)
    assert [r["predicted"] for r in toxicity.score(docs, both).where("doc_id = 3").collect()] == [0] * 50


def test_swaps_exchange_whole_terms():
    groups = {"g": ("men", "women")}
    assert list(toxicity.swaps("Men and comment: men", groups)) == ["women and comment: women"]
    assert list(toxicity.swaps("nothing here", groups)) == []


def test_the_penalty_closes_a_gap_in_weights():
    x, y, n = np.array([[1.0, 0, 1], [0, 1, 1], [1, 0, 0], [0, 1, 0]]), np.array([1.0, 0, 1, 0]), np.array([10.0, 10, 10, 10])
    change = np.array([[-1.0, 1, 0]])
    free = toxicity.fit(x, y, n, np.zeros((0, 3)), np.zeros(0), ridge=0.1, penalty=1.0)
    tied = toxicity.fit(x, y, n, change, np.ones(1), ridge=0.1, penalty=100.0)
    assert abs(free[0] - free[1]) > 2 > 0.05 > abs(tied[0] - tied[1])
