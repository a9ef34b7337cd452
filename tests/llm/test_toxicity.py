import zlib

import numpy as np
import zstandard

from tidemark.llm import toxicity as T


def auc(y, s):
    s, y = np.array(s), np.array(y)
    a, b = s[y == 1], s[y == 0]
    return ((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()) / (len(a) * len(b))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in T.op2_toxicity(spark, d).collect()}
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    y, s, p = [], [], []
    for r in spark.read.parquet(f"{d}/labels.parquet").collect():
        g = got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= g.score <= 1 and g.predicted == (g.score >= 0.5)
        if g.held_out:
            y.append(r.toxic)
            s.append(g.score)
            p.append(g.predicted)
    y, p = np.array(y), np.array(p)
    recall, precision = (p[y == 1]).mean(), (y[p == 1]).mean()
    print(auc(y, s), recall, precision, len(y), y.sum())
    assert auc(y, s) > 0.93 and recall > 0.8 and precision > 0.9


def test_odd_rows(spark):
    docs = [(i, f"plain words number {i % 7} and more of them {i}") for i in range(40)] + [(100 + i, f"you utter nitwit {i} what a nitwit you {i % 5} nitwit") for i in range(40)]
    docs += [(500, None), (501, ""), (None, "nitwit"), (3, "plain"), (502, "word " * 50000), (503, "퟿ \u0000 x")]
    labels = [(i, 0) for i in range(40)] + [(100 + i, 1) for i in range(40)] + [(3, None), (None, 1), (100, 0), (9999, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS y", "'q' AS id")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("*", "'t' AS text")
    got = T.score(df, T.fit(df, lab)).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    assert by[120].score > by[20].score and by[500].score == by[501].score <= by[None].score
    for a, b in ((df.limit(0), lab), (df, lab.limit(0)), (df, lab.where("toxic = 1"))):
        out = T.score(a, T.fit(a, b)).collect()
        assert len(out) == a.count() and all(0 <= r.score <= 1 for r in out)


def test_scores_equal_plain_compression(spark):
    """Distances and scores again, word by word, with compressors made here."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = T.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    assert model.words[0] and sum(len(w.encode()) + 1 for w in model.words[1]) < T.DICT_BYTES
    press = []
    for words in model.words:
        data = (" " + " ".join(words) + " ").encode() + T.CARRIER
        held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        press.append(zstandard.ZstdCompressor(level=T.LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))
    bare = len(press[0].compress(T.CARRIER + T.TAIL))
    got = {r.doc_id: r.score for r in T.score(docs, model).collect()}
    for r in docs.limit(60).collect():
        over = np.zeros(T.GRADES)
        for w in r.text.lower().split():
            a, b = (len(p.compress(T.CARRIER + f" {w} ".encode() + T.TAIL)) - bare for p in press[::-1])
            over[: max(0, min(T.GRADES - 1, T.GRADES * (a - b) // max(a, 1))) + 1] += 1
        z = model.weights[0] + model.weights[1:] @ np.log1p(over[list(T.DISTANCES)])
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-9


def test_ties_and_long_labelled_texts(spark):
    docs = [(i, ("nitwit and more " if i % 2 else "plain and more ") * 3000 + str(i)) for i in range(24)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in T.score(df.unionByName(df), T.fit(df, lab)).collect()}
    assert len({got[i].score for i in (1, 3)}) == 1 and all(got[i].predicted == int(got[i].score >= 0.5) for i in got)
