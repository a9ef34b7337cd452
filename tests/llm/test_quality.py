import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import quality as Q

TEXTS = ["the cat sat on the mat.", "the dog sat on the log, the end", "a cat and a dog", "", None, "Élan! the théâtre 42", "on and on and on"]


def to_symbols(t):
    out = []
    for c in t or "":
        x = 48 if c in "0123456789" else 32 if c in "\t\r\xa0" else ord(c)
        out.append(max(x if x < 1 << 16 else (x ^ (x >> 16)) & 0xFFFF, 2))
    return [1] * 3 + out


def plain(texts):
    """Interpolated modified Kneser-Ney, straight from its definition."""
    c = {n: Counter() for n in range(1, 5)}
    for t in texts:
        s = to_symbols(t)
        for i in range(3, len(s)):
            c[4][tuple(s[i - 3 : i + 1])] += 1
    for n in (3, 2, 1):
        for g in c[n + 1]:
            c[n][g[1:]] += 1
    d, ctx = {}, {}
    for n in c:
        k = Counter(c[n].values())
        n1, n2, n3, n4 = (k[i] for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else None
        d[n] = (0.5, 1.0, 1.5) if y is None else tuple(min(max(x, Q.LEAST_DISCOUNT), m) for m, x in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5), 1))
        ctx[n] = defaultdict(list)
        for g, v in c[n].items():
            ctx[n][g[:-1]].append(v)

    def p(g):
        n = len(g)
        if not n:
            return 1 / Q.ALPHABET
        seen = ctx[n].get(g[:-1])
        if not seen:
            return p(g[1:])
        cut = lambda v: d[n][min(v, 3) - 1]
        v = c[n].get(g, 0)
        return ((v - cut(v) if v else 0) + sum(map(cut, seen)) * p(g[1:])) / sum(seen)

    p.counts = c[4]
    return p


def test_model_and_scores_equal_the_definition(spark):
    rows = [(i, "x", t) for i, t in enumerate([*TEXTS, "unseen words", "z" * 3000, "\U0001f600 and \u4e2d\ufffd"])]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    packed = Q.pack(df)
    table = Q.train(packed, spark.createDataFrame([(i,) for i in range(len(TEXTS))], "good long"))
    p = plain(TEXTS)
    told = table.toPandas()
    order = told.gram.to_numpy().view(np.uint64).argsort()
    key, prob, gamma = told.gram.to_numpy().view(np.uint64)[order], told.p.to_numpy(float)[order], told.gamma.to_numpy(float)[order]
    r = np.random.default_rng(0)
    probe = [tuple(x) for x in r.integers(2, 200, (300, 4)).tolist()]
    for t in TEXTS:
        s = to_symbols(t)
        probe += [tuple(s[i - 3 : i + 1]) for i in range(3, len(s))] + [(*s[i - 3 : i], 5) for i in range(3, len(s))]
    number = lambda g: g[0] << 48 | g[1] << 32 | g[2] << 16 | g[3]
    cost, own = Q.costs(np.array([number(g) for g in probe], np.uint64), key, prob, gamma)
    for g, c, o in zip(probe, cost, own, strict=True):
        assert 2.0**-c == pytest.approx(p(g), rel=1e-4)
        assert o > c if p.counts[g] == 1 else o == c
    context = [number((*to_symbols("the th")[-3:], x)) for x in range(2, Q.ALPHABET)]
    assert (2.0 ** -Q.costs(np.array(context, np.uint64), key, prob, gamma)[0]).sum() == pytest.approx(1, abs=1e-3)
    found = Q.score(packed, table).collect()
    assert sorted(x.doc_id for x in found) == list(range(len(rows)))
    for x in found:
        text = rows[x.doc_id][2]
        s = to_symbols(text)
        assert x.n_symbols == len(s) - 3
        assert x.bits == pytest.approx(sum(-math.log2(p(tuple(s[i - 3 : i + 1]))) for i in range(3, len(s))), rel=1e-4, abs=1e-6)
        w = ["<e>", *(text or "").split(), "<e>"]
        pairs = list(zip(w, w[1:]))
        assert x.repeats == pytest.approx(1 - len(set(pairs)) / len(pairs))


def test_no_ngram_has_probability_zero(spark):
    # many counts of four against one of three: the third estimate is below zero
    many = [1] * 9 + [2] * 4 + [3] + [4] * 40
    table = spark.createDataFrame([((2 << 48) + (3 << 32) + (4 << 16) + i + 2, c) for i, c in enumerate(many)], "gram long, c long")
    assert Q._discounts(table)[2] == Q.LEAST_DISCOUNT
    told = Q.model(table).where("p IS NOT NULL").collect()
    assert all(0 < abs(r.p) < 1 for r in told) and sum(abs(r.p) for r in told if r.gram >= 2 << 48) < 1


def test_small_batches_give_the_same_scores(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    whole = sorted(Q.classify(docs, labels).collect())
    pack = Q._pack

    def cut(batches):
        Q.BATCH_BYTES, Q.CHUNK_BYTES, Q.BATCH_ROWS = 9000, 3000, 7
        yield from pack(batches)

    monkeypatch.setattr(Q, "_pack", cut)
    other = sorted(Q.classify(docs.repartition(5), labels).collect())
    assert len(other) == len(whole)
    for a, b in zip(whole, other, strict=True):
        assert (a.doc_id, a.n_symbols, a.repeats, a.keep) == (b.doc_id, b.n_symbols, b.repeats, b.keep)
        assert a.perplexity == pytest.approx(b.perplexity, rel=1e-6) and a.threshold == pytest.approx(b.threshold, rel=1e-6)


def test_thresholds_and_keep_equal_brute_force(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    worst = {}
    for r in labels:
        worst[r.doc_id] = min(r.quality, worst.get(r.doc_id, 1))
    got = Q.op5_quality(spark, d).collect()
    known = [r for r in got if worst.get(r.doc_id) == 1 and r.n_symbols]
    quantile = lambda x: sorted(x)[max(0, math.ceil(Q.QUANTILE * len(x)) - 1)]
    for lang in {r.lang for r in got}:
        own = [r for r in known if r.lang == lang]
        own = own if len(own) >= Q.LEAST_TRUSTED else known
        rate, again = quantile([r.perplexity for r in own]) * Q.SLACK, quantile([r.repeats for r in own]) * Q.SLACK + Q.REPEAT_SLACK
        for r in got:
            if r.lang == lang:
                assert r.threshold == pytest.approx(rate, rel=1e-6) and r.repeats_threshold == pytest.approx(again, rel=1e-6)
                assert r.keep == (r.perplexity <= r.threshold and r.repeats <= r.repeats_threshold)


def kind(text):
    w = text.split()
    return "repeated" if len(w) > 5 and len(set(map(str.lower, w))) < len(w) / 4 else "other"


def test_keeps_good_and_rejects_each_kind_of_junk(spark):
    d = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in Q.op5_quality(spark, d).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    n = Counter()
    for r in spark.read.parquet(f"{d}/labels.parquet").collect():
        n["good" if r.quality else kind(texts[r.doc_id]), got[r.doc_id].keep] += 1
    assert n["good", True] / (n["good", True] + n["good", False]) > 0.98
    for k in ("repeated", "other"):
        assert n[k, False] / (n[k, True] + n[k, False]) > 0.9, k
    assert len(got) == len(texts)


def test_odd_rows(spark):
    docs = [(i, "en", f"plain words that many of these share {i % 9}") for i in range(30)] + [(40, None, "plain words"), (41, "xx", "{]{]##{]{]%%{]{]##" * 9), (41, "xx", "plain words"), (42, "en", None), (43, "en", ""), (None, "en", "{]{]##{]" * 20)]
    labels = [(i, 1) for i in range(30)] + [(41, None), (3, 0), (None, 1), (4, 1)]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string").selectExpr("*", "1 AS good", "2 AS q", "'k' AS keep")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = Q.classify(df, lab).collect()
    assert len(got) == len(docs)
    assert {(r.doc_id, r.keep) for r in got if r.doc_id in (40, 42, 43)} == {(40, True), (42, True), (43, True)}
    kept = Q.keep_good(df, lab)
    assert kept.columns == df.columns
    left = [r.doc_id for r in kept.collect()]
    assert 41 not in left and None in left and {*range(30), 40, 42, 43} <= set(left)
    assert Q.classify(df.limit(0), lab).collect() == []
    assert all(r.keep for r in Q.classify(df, lab.limit(0)).collect())
