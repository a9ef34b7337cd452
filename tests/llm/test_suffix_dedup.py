import hashlib
import random

import duckdb

from tidemark.llm import suffix_dedup as S


def brute(rows):
    texts = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in texts:
        for i in range(len(b) - 49):
            k = b[i : i + 50]
            if d is not None and (k not in first or d < first[k]):
                first[k] = d
    out = []
    for d, b in texts:
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            f = first.get(b[i : i + 50])
            if f is not None and (d is None or f < d):
                gone[i : i + 50] = [True] * 50
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def key(r):
    return tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)


def corpus(seed):
    r = random.Random(seed)
    parts = ["the ", "and ", "é", "ing ", "er", "on ", "\n", "a", "\0"]
    text = lambda n: "".join(r.choice(parts) for _ in range(n))
    passages = [text(r.randint(20, 60)) for _ in range(5)] + ["Licensed under the Apache License, Version 2.0, once more.\n", "a" * 90]
    rows = []
    for i in range(120):
        t = text(r.randint(0, 80))
        for _ in range(r.randint(0, 3)):
            c = r.randint(0, len(t))
            t = t[:c] + r.choice(passages) + t[c:]
        rows.append((i * 3 % 121, t))
    rows += [(500 + i, rows[i][1]) for i in range(10)] + [(7, rows[3][1]), (None, rows[5][1] + "x"), (900, None), (901, ""), (902, "short")]
    rows += [(1000 + i, rows[20][1][:i] + "Z" + rows[20][1][i:]) for i in range(0, 60, 7)]
    return rows


def test_matches_brute_force(spark, monkeypatch):
    for seed, hot in ((1, 4096), (2, 6)):
        monkeypatch.setattr(S, "HOT", hot)
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = sorted(map(tuple, S.dedup(df).collect()), key=key)
        assert got == sorted(brute(rows), key=key)


def test_matches_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, S.op3_suffix_dedup(spark, sf).collect())) == sorted(c.execute(S.OP3_SQL).fetchall())


def test_hot_anchor_is_dealt_by_window(spark):
    line = "One line that every document has, longer than fifty bytes by some."
    rows = [(i, f"{i * 7919 % 1000003} {line} {i * 104729 % 999983}") for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, S.dedup(df).collect()), key=key)
    assert got == sorted(brute(rows), key=key)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, run long, bytes string")
    assert S.dedup(df).collect() == []


def test_merge_orders_and_shares():
    r = random.Random(3)
    runs = [sorted({bytes(r.choice(b"ab") for _ in range(r.randint(1, 8))) for _ in range(20)}) for _ in range(5)]
    common = lambda a, b: next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
    coded = [[(s, 1, common(s, x[i - 1]) if i else 0) for i, s in enumerate(x)] for x in runs]
    got = list(S.merge([iter(x) for x in coded]))
    assert [s for _, s, _, _ in got] == sorted(s for x in runs for s in x)
    for (_, a, _, _), (_, b, _, n) in zip(got, got[1:]):
        assert n == common(a, b)


def test_largest_id_and_a_very_long_text(spark):
    r = random.Random(11)
    passage = "".join(r.choice("abcdefgh ") for _ in range(90))
    long = "".join(r.choice("ijklmnop ") for _ in range(3_000_000))
    rows = [(2**63 - 1, passage + " end"), (None, "x" + passage), (1, "start " + passage), (2, long[:1_500_000] + "#" + passage + "#" + long[1_500_000:])]
    got = {r.doc_id: r for r in S.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2**63 - 1].n_removed == 90 and got[None].n_removed == 90 and got[1].n_removed == 0
    assert got[2].n_removed == 90 and got[2].n_bytes == 3_000_092
