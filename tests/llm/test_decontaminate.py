import random
import re

import numpy as np

from tidemark.llm import decontaminate as D


def norm(t):
    return re.sub("[^a-z0-9\x80-\U0010ffff]+", " ", (t or "").lower()).strip(" ")


def least_edits(w, t):
    """Plain semi-global alignment: least edits of w against any part of t."""
    cost = [0] * (len(t) + 1)
    for i, c in enumerate(w, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(cost[j - 1] + (c != d), cost[j] + 1, new[-1] + 1))
        cost = new
    return min(cost)


def windows(b):
    if len(b) <= D.WINDOW:
        return [b]
    return [b[s : s + D.WINDOW] for s in [*range(0, len(b) - D.WINDOW, D.STEP), len(b) - D.WINDOW]]


def holds(t, x):
    if len(x) < D.SHORT:
        return bool(x) and f" {x} " in f" {t} "
    return any(least_edits(w, t) <= D.budget(len(w)) for w in windows(x))


def brute(docs, items):
    return sorted((d, i) for d, t in docs for i in {i for i, x in items if holds(norm(t), norm(x))})


def edited(r, t, n):
    for _ in range(n):
        t = t or "-"
        k = r.randrange(len(t))
        t = r.choice([t[:k] + t[k + 1 :], t[:k] + "x" + t[k:], t[:k] + "q" + t[k + 1 :]])
    return t


def test_matches_brute_force(spark):
    r = random.Random(5)
    parts = ["the", "and", "er", "on", "é", " ", " ", "ing", ". ", "tion", "\n"]
    text = lambda n: "".join(r.choice(parts) for _ in range(n))
    items = [(i, text(r.choice([3, 20, 30, 60]))) for i in range(12)] + [(99, None), (98, ""), (3, text(40)), (50, "thean"), (51, "er er"), (52, "é"), (53, "the quick brown fox runs"), (54, "хорошо быть здесь и сейчас, а не там где нас нет")]
    docs = []
    for d in range(60):
        t = text(r.randint(0, 60))
        if d % 2:
            p = r.choice(items)[1] or "x"
            t = t[: len(t) // 2] + " " + edited(r, p, r.choice([0, 2, 4, 6, 9, 14])).upper() + " " + t[len(t) // 2 :]
        docs.append((d, t))
    docs += [(300, "so: The QUICK brown fox runs!"), (301, "the quick brown fox runsé"), (302, "мне Хорошо быть здесь и сейчаз, а не там где нас нет ни кого"), (303, "é")]
    docs += [(200, None), (201, ""), (5, docs[5][1]), (202, items[4][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((x.doc_id, x.item_id) for x in D.matches(df, bench).collect())
    want = brute(docs, items)
    assert got == want
    assert len(want) > 10
    kept = {x.doc_id for x in D.decontaminate(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs")], "item_id long, text string")
    assert D.matches(none, items).collect() == []
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert D.matches(docs, items.limit(0)).collect() == []


def test_blocks_give_the_same(spark, sf, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(tuple, D.matches(docs, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_BYTES", 2000)
    assert sorted(map(tuple, D.matches(docs, bench).collect())) == one


def test_normalize():
    t = ["  A-b  c. ", "", "é!", "..."]
    raw = [x.lower().encode() for x in t]
    out, cut = D.normalize(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])
    assert ["".join(map(chr, out[a:b])) for a, b in zip(cut, cut[1:])] == ["a b c", "", "é", ""]


def test_long_text_and_repeated_items(spark):
    passage = "a passage of some length that nobody would write by chance in any other document here"
    items = spark.createDataFrame([(1, passage), (1, passage), (2, "word")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "filler " * 300000 + passage + " filler" * 300000), (2, "swordfish")], "doc_id long, text string")
    got = sorted(map(tuple, D.matches(docs.selectExpr("*", "'k' AS item_id", "0 AS edits"), items).collect()))
    assert [g[:2] for g in got] == [(1, 1)] and got[0][3] == 0


def test_verbatim_passages_at_any_place_are_found(spark):
    r = random.Random(8)
    item = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(60))
    n = D.WINDOW + D.STEP
    docs = [(k, "before " + item[k : k + n + 2] + " after") for k in range(0, len(item) - n)]
    got = D.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert {x.doc_id for x in got.collect()} == {k for k, _ in docs}
