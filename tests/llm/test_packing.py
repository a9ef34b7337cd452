import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from tidemark.llm import packing as P

DOCS = [(1, "Hello, world! it's"), (2, None), (3, ""), (4, "word " * 5000), (5, "<|startoftext|>a\u0085b c é ́x ΣΑΣ don't"), (1, "again"), (None, "no id"), (6, "a\x1cb \x1fc"), (7, "x" * 3000), (8, "12345 6,7 . \t\n é")]


TOKENIZER = Tokenizer.from_file(P.default_tokenizer())


def truth(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def frame(spark):
    more = [(100 + i, "many words here " * random.Random(i).randint(0, 900)) for i in range(60)]
    return [*DOCS, *more], spark.createDataFrame([*DOCS, *more], "doc_id long, text string").selectExpr("*", "1 AS sequence_id", "'x' AS start").repartition(2)


def test_words_equal_whole_texts(spark, sf):
    w = P.Words(P.default_tokenizer())
    texts = [t for _, t in DOCS] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(100).collect()]
    r = random.Random(1)
    alphabet = list("aBcé ÀßÿÆ") + ["'s", "'T", "<|", "|>", "e\u0301", "\u0301", "²", "ª", "½", "--", "...", "|", "$%", "İ", "Σ", "ǅ", "1", " ", "\n", "\u00a0", "中", "ﬁ", "×", "÷", "<|endoftext|>"]
    texts += ["".join(r.choice(alphabet) for _ in range(r.randint(1, 40))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(w.ids(t), "<u4").tolist() == truth(t)[:-1]


def check(pieces, docs):
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_seq[p[5]].append(p)
        by_doc[p[0], p[4]].append(p)
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p[6]):
            assert p[6] == at and p[2] > 0
            at += p[2]
        assert at <= 2048
    want = sorted((str(d), s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()), len(ids)) for d, t in docs for ids in [truth(t)] for s in range(0, len(ids), 2048))
    assert sorted((str(p[0]), *p[1:5]) for p in pieces) == want
    return len(by_seq)


def test_pieces(spark, monkeypatch):
    docs, df = frame(spark)
    pieces = [tuple(r) for r in P.pack(df).collect()]
    n = check(pieces, docs)
    assert n <= 1.1 * sum(p[2] for p in pieces) / 2048 + 2
    monkeypatch.setattr(P, "BUFFER", 5)
    monkeypatch.setattr(P, "OPEN_WINDOWS", 3)
    def f(batches):
        P.BUFFER, P.OPEN_WINDOWS = 5, 3
        yield from inner(batches)
    inner = P._pieces(P.default_tokenizer(), 2048)
    rows = df.select("doc_id", "text")
    check([tuple(r) for r in rows.mapInArrow(f, P.PIECES_SQL).collect()], docs)
    check([tuple(r) for r in P.pack(df).collect()], docs)


def test_best_fit_decreasing():
    r = random.Random(2)
    for width in (10, 64, 100):
        sizes = [r.randint(1, width - 1) for _ in range(200)]
        packer = P.Packer(width)
        got = packer.place(sizes)
        rooms, want = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):  # the plain way
            fit = [x for x in range(len(rooms)) if rooms[x] >= sizes[i]]
            best = min(fit, key=lambda x: rooms[x]) if fit else None
            if best is None:
                rooms.append(width)
                best = len(rooms) - 1
            rooms[best] -= sizes[i]
        used = defaultdict(int)
        for i, (s, _) in enumerate(got):
            used[s] += sizes[i]
        assert sorted(used.values()) == sorted(width - x for x in rooms)


def test_matrices_round_trip(spark, tmp_path):
    docs, df = frame(spark)
    P.write_matrices(df, str(tmp_path / "m"))
    rows = P.read_matrices(spark, str(tmp_path / "m")).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    ids = defaultdict(dict)
    for r in rows:
        row = np.frombuffer(r.ids, f"<u{r.id_bytes}")
        assert len(row) == 2048 and r.cu_seqlens[:-1] == r.position_resets and not row[r.cu_seqlens[-1] :].any()
        for d, s, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            ids[d].setdefault(s, []).append(row[a:b].tolist())
    for d, t in docs:
        want = truth(t)
        for s in range(0, len(want), 2048):
            assert want[s : s + 2048] in ids[d][s]
    got = P.op10_token_matrices(spark, "/root/testdata/sf0.001")
    assert got.where("bad_padding > 0 OR n_tokens <> element_at(cu_seqlens, -1)").count() == 0


def test_padding_of_whole_tables(spark):
    for d, least in (("sf0.001", 0.95), ("sf0.01", 0.96), ("sf0.1", 0.96)):
        docs = spark.read.parquet(f"/root/testdata/{d}/documents.parquet").coalesce(1)
        got = P.pack(docs).selectExpr("sum(length) AS n", "count(DISTINCT sequence_id) AS s").first()
        assert got.n / 2048 / got.s > least, (d, got)
        assert P.pack(docs).where("offset + length > 2048").count() == 0


def test_extra_columns_and_repeats(spark, tmp_path):
    _, df = frame(spark)
    odd = df.unionByName(df).selectExpr("*", "1 AS ids", "'w' AS width", "doc_id AS doc_ids")
    P.write_matrices(odd, str(tmp_path / "m"))
    got = P.read_matrices(spark, str(tmp_path / "m"))
    assert got.selectExpr("sum(element_at(cu_seqlens, -1))").first()[0] == P.pack(odd).selectExpr("sum(length)").first()[0]


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert P.pack(none).collect() == []
    P.write_matrices(none, str(tmp_path / "m"))
    assert P.read_matrices(spark, str(tmp_path / "m")).collect() == []
