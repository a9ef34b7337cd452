import random

import duckdb
import numpy as np

from tidemark.llm import jaccard_join as J


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    adj = [[j for j in range(n) if j != i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in adj[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], min(ids, default=None), len(adj[i])))
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(40):
        base = [r.choice(words) for _ in range(r.choice([3, 6, 30, 120]))]
        for k in range(r.choice([1, 2, 5, 30])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3]) if len(t) > 20 else 0):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((len(rows) * 7 % 1009, " ".join(t)))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (None, rows[0][1]), (None, "all alone here"), (rows[3][0], rows[60][1]), (rows[5][0], rows[5][1]), (2003, "ALL alone\there"), (2004, "word " * 4000)]
    return rows


def test_matches_brute_force(spark, monkeypatch):
    for seed, block in ((1, 2048), (2, 8)):
        monkeypatch.setattr(J, "BLOCK", block)
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'n' AS node", "1 AS keys").repartition(4)
        got = sorted(map(tuple, J.join(df).collect()), key=key)
        want = sorted(brute(rows), key=key)
        assert got == want
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    gone = {d for d, c, _ in want if d is not None and d != c}
    assert sorted(key((r.doc_id,)) for r in kept.collect()) == sorted(key((d,)) for d, _ in rows if d not in gone)


def test_matches_sql(spark):
    d = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = sorted(c.execute(J.OP6_SQL).fetchall())
    assert sorted(map(tuple, J.op6_jaccard_join(spark, d).collect())) == want


def test_prefix_reaches_recall():
    k = J.prefix_length()
    at = lambda d: 1 - (1 - 0.8**d) ** J.TREES
    assert at(k) >= J.RECALL > at(k + 1)


def test_empty_table(spark):
    assert J.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_chains(spark):
    chain = [(bytes([i]), bytes([i + 1])) for i in range(60) if i != 30]
    got = J.components(spark.createDataFrame(chain, "node binary, peer binary")).collect()
    assert {bytes(r.node)[0]: bytes(r.root)[0] for r in got} == {i: 0 if i <= 30 else 31 for i in range(61) if i not in (0, 31)}


def test_minima_agree_as_often_as_similar():
    r = np.random.default_rng(2)
    mets = []
    for _ in range(300):
        x = r.integers(0, 2**63, 120).astype(np.uint64)
        a, b = np.sort(x[:110]), np.sort(x[10:])
        k = J.labels(np.concatenate([a, b]), np.array([0, 110, 220]), 1)
        mets.append((k[0] == k[1]).mean())
    assert abs(np.mean(mets) - 100 / 120) < 0.02 and np.std(mets) < 1.3 * np.sqrt(100 / 120 * 20 / 120 / J.TREES)
