import importlib

import numpy as np

import corpus_pipeline
from tidemark.llm import decontaminate, jaccard_join, packing, pii, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert out.columns == columns and out.dtypes == docs.dtypes
        after = {r.doc_id: r for r in out.collect()}
        if name == "quality":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            rejected = {r.doc_id for r in quality.classify(docs, labels).where("NOT keep").collect()}
            assert after == {d: r for d, r in before.items() if d not in rejected}
        if name == "near_duplicates":
            sets = {d: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for d, r in before.items() if (w := r.text.lower().split())}
            near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
            gone = {d for d in sets if any(e < d and near(sets[e], sets[d]) for e in sets)}
            assert gone <= before.keys() - after.keys() and all(any(near(sets[d], sets[e]) for e in sets if e != d) for d in before.keys() - after.keys())
            kept = [sets[d] for d in after if d in sets]
            assert not any(near(a, b) for i, a in enumerate(kept) for b in kept[:i])
        if name == "decontaminate":
            bad = {r.doc_id for r in decontaminate.matches(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert bad and after == {d: r for d, r in before.items() if d not in bad}
        if name == "pii":
            assert after.keys() == before.keys()
            for d, r in after.items():
                assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
                if not pii.base_spans(before[d].text):
                    assert "[EMAIL]" in r.text or "[CARD]" in r.text or "[PHONE]" in r.text or r.text == before[d].text
        if name == "packing":
            total = sum(len(packing.Words(packing.default_tokenizer()).ids(r.text)) // 4 + 1 for r in list(before.values())[:20])
            ids = list(before)[:20]
            assert out.where(out.doc_id.isin(ids)).agg({"length": "sum"}).first()[0] == total
        docs = out


def test_run_and_odd_rows(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "text a@b.cd", "en", "s", 11), (3, "text", "en", "s", 4), (3, "text", "en", "s", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for part in (df, df.limit(0)):
        docs = part
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.select("doc_id").distinct().count() == (4 if part is df else 0)
